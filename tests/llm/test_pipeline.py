"""The corpus pipeline stage by stage against brute force, on odd rows and on an empty table; what the stages' operators do with odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lexquarry.llm import mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, key long, kept boolean, FIRST string, findings string"
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def rows():
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ther", "onta", "bles", "inga") for b in ("ion", "est", "ou", "and", "ish", "er")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = []
    for i in range(60):
        t = text(r.randint(40, 90))
        out.append((i, t))
        if i % 10 == 0:
            w = t.split()
            w[5] = "changed"
            out += [(100 + i, t), (200 + i, "  ".join(w))]  # an exact copy and a near one
    out += [(300, None), (301, ""), (302, "too short"), (303, "again " * 50), (None, text(60)), (304, f'{text(30)} token = "{KEY}" {text(30)}'), (305, text(4000)), (0, out[0][1])]
    return [(i, t, "en", [None, "a", "b", "c"][(i or 0) % 4], len(t or ""), 7, True, "x", "y") for i, t in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def words(t):
    return WORD.findall(t or "")


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = dict(corpus_pipeline.STAGES)
    one = at["quality rules"](spark, docs, folder)
    assert one.columns == docs.columns
    kept = [tuple(r) for r in one.collect()]
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in rows() if verdict[r[0]])
    assert not any(verdict[i] for i in (300, 301, 302, 303)) and verdict[0] and verdict[304]

    two = at["n-gram Jaccard join"](spark, spark.createDataFrame(kept, KIND), folder)
    got = [tuple(r) for r in two.collect()]
    sets = [{tuple(x.lower() for x in words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for _, t, *_ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    stays, seen = [], []
    for i in order:  # near copies here are at one step from the first
        if not any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in seen):
            stays.append(kept[i])
        seen.append(i)
    assert sorted(map(repr, got)) == sorted(map(repr, stays)) and two.columns == docs.columns

    three = at["secret scans"](spark, spark.createDataFrame(got, KIND), folder)
    masked = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and len(masked) == len(got)
    for r in got:
        assert masked[r[0]].text == r[1].replace(KEY, "[SECRET]") and masked[r[0]].n_chars == len(masked[r[0]].text) and masked[r[0]].findings == "y"
    assert KEY not in masked[304].text

    rows3 = [tuple(r) for r in three.collect()]
    four = at["mixing sources to target weights"](spark, spark.createDataFrame(rows3, KIND), folder)
    mixed = four.collect()
    assert four.columns == docs.columns and {r.key for r in mixed} == {7}
    size = {}
    for r in rows3:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    goal = dict(zip(size, mixing.targets(list(size.items())), strict=True))
    for s in size:
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - goal[s]) < 2
    for r in mixed:
        assert f" {' '.join(words(r.text))} " in f" {' '.join(words(masked[r.doc_id].text))} "

    five = at["best-fit packing"](spark, spark.createDataFrame([tuple(r) for r in mixed], KIND), folder).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for r in mixed:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(repr(r.doc_id), p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(np.array(ids[p : p + 2048], dtype="<u4").tobytes())) for p in range(0, len(ids), 2048)]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in five) == sorted(want)
    ends = {}
    for r in sorted(five, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted(want)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_ties():
    """A score at the threshold is kept; one micro-unit below is not."""
    text = pa.array(["one two three four five six seven eight nine ten"], pa.large_string())
    for value, kept in ((-250_000, True), (-250_001, False)):
        assert quality.verdicts(text, np.full(quality.BUCKETS, value, dtype=np.int64), -250_000)[6].tolist() == [kept]


def test_packing_salts(spark, monkeypatch):
    """Pieces of one length over many salts, and a very long text."""
    monkeypatch.setattr(packing, "SALTED", 7)
    long = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:5] for i in range(20_000))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words here").alias("text")).unionByName(spark.createDataFrame([(9000, long), (None, None)], "doc_id long, text string"))
    rows = packing.pack(docs.repartition(5), public_tokenizers.path(packing.TOKENIZER)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and sum(r.piece == 0 for r in rows) == 3002
    total = sum(r.length for r in rows)
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 2048 and len(by) <= -(-total // 2048) + 2
    pieces = sorted((r.start, r.length) for r in rows if r.doc_id == 9000)
    assert [s for s, _ in pieces] == [2048 * i for i in range(len(pieces))] and all(n == 2048 for _, n in pieces[:-1])
