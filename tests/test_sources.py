"""Readers, sinks and reports."""

import json
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from lexquarry import config
from lexquarry.operators import reports
from lexquarry.sources import readers, sinks


def test_index_and_files(spark, tmp_path):
    f = lambda p, s, c: {"path": p, "status": s, "checksum": c}
    entries = [
        {"numero": "1", "files": [f("", "downloaded", "x"), f("a.pdf", "Downloaded", "same")]}, {"numero": "2", "files": [f("b.pdf", "downloaded", "same")]}, {"numero": "3", "files": [f("c.pdf", "pending", "c")]},
        {"numero": "4", "files": [f("gone.pdf", "downloaded", "g")]}, {"numero": "5", "files": [f("d.pdf", "downloaded", "g")]}, {"numero": "6", "files": [f("d.pdf", "downloaded", "")]}, {"numero": "7", "files": None}, "no object",
    ]
    (tmp_path / "i.json").write_text(json.dumps(entries))
    (tmp_path / "pdf" / "deep").mkdir(parents=True)
    for name in ("pdf/a.pdf", "pdf/deep/b.pdf", "pdf/note.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    index = readers.gazette_index(spark, f"{tmp_path}/i.json")
    assert index.count() == 7 and readers.pdf_files(spark, f"{tmp_path}/pdf").count() == 2
    there = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",), ("d.pdf",)], "path string")
    pick = lambda **kw: [r.numero for r in readers.selected_files(index, there, "numero", **kw).orderBy("numero").collect()]
    assert pick() == ["1", "5", "6"] and pick(most=2) == ["1", "5"] and pick(by_checksum=False) == ["1", "2", "5"]


def test_elements(spark, tmp_path):
    rows = [
        {"content": "c", "cleaned_content": "c", "embedding": [1, 2], "metadata": {"chunk_id": "k1", "page_number": None, "gaceta_normas": ["a", "b"], "source": "s"}},
        {"cleaned_content": "solo", "embedding": [1], "metadata": {"chunk_id": "k2", "page_number": 4}}, {"cleaned_content": " ", "embedding": [1], "metadata": {"chunk_id": "k3"}}, {"cleaned_content": "x", "metadata": {"chunk_id": "k4"}}, {"cleaned_content": "x", "embedding": [1], "metadata": {}},
    ]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    e = readers.elements(spark, f"{tmp_path}/e.json")
    assert readers.valid_elements(e, False).count() == 3
    got = {r.id: r for r in readers.index_rows(readers.valid_elements(e)).collect()}
    assert set(got) == {"k1", "k2"} and got["k1"].metadata.page_number == -1 and got["k1"].metadata.gaceta_normas == '["a","b"]' and got["k2"].document == "solo" and got["k2"].metadata.source == ""
    assert "coordinates" not in got["k1"].metadata.asDict()
    rich = readers.enriched(e, {"gaceta_numero": F.lit("9"), "source": F.lit("new")}).first().metadata
    assert (rich.gaceta_numero, rich.source, rich.chunk_id) == ("9", "new", "k1")
    s = sinks.embedding_statistics(e).first()
    assert (s.total, s.valid, s.empty, s.dimension) == (5, 4, 1, 2)


def test_queries(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "1", "query_type": "t", "query": "q"}]))
    assert readers.queries(spark, f"{tmp_path}/q.json").count() == 1
    (tmp_path / "bad.json").write_text(json.dumps([{"query_id": "1", "query": "q"}]))
    with pytest.raises(Exception, match="query_type"):
        readers.queries(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "j.json").write_text(json.dumps([{"query_id": "1", "relevant_docs": ["a"]}, {"query_id": "2", "relevant_docs": []}, {"query_id": "3"}]))
    assert [r.query_id for r in readers.judgements(spark, f"{tmp_path}/j.json").collect()] == ["1"]
    store = spark.createDataFrame([("a", "x" * 300), ("b", " l1 \n\n  l2  z")], "id string, text string")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "id string")
    got = {r.id: (r.p, r.r) for r in readers.lookup(store, ids, "id", ["text"]).select("id", readers.preview(F.col("text")).alias("p"), readers.readable(F.col("text")).alias("r")).collect()}
    assert got["a"][0] == "x" * 200 + "..." and got["b"][1] == "l1\nl2 z" and len(got) == 2


def test_html(spark):
    pages = spark.createDataFrame([(1, "http://a.cu/x/", "<title> T &amp; u</title><td>1<th>2<a href='/y'>l</a><a href=z>"), (2, "http://a.cu", "<td <"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.links, r.n_cells) for r in readers.html_rows(pages, "url").collect()}
    assert got[1] == ("T & u", ["http://a.cu/y", "http://a.cu/x/z"], 2) and got[2][0] == got[3][0] == readers.DEFAULT_TITLE and got[3][1:] == ([], 0)
    assert readers.html_rows(pages).where("page_id = 1").first().links == ["/y", "z"]


def test_tables(spark, tmp_path):
    g = spark.createDataFrame([("b", "2", "f", "t"), ("a", "1", "f", "t"), ("", "3", "f", "t")], "checksum string, numero string, fecha string, tipo_edicion string")
    n = spark.createDataFrame([("n1", "a", 0, "high", "Ley"), ("n2", "b", 0, "low", "Ley"), ("n3", "", 0, "high", "Acuerdo")], "norm_id string, checksum string, ordinal_position int, match_confidence string, tipo string")
    d = spark.createDataFrame([("n1", "b", "a"), ("n2", "zz", "")], "norm_id string, kept_checksum string, superseded_checksum string")
    for _ in range(2):  # writing twice leaves one copy
        sinks.write_norm_tables(g, n, d, f"{tmp_path}/t")
    read = lambda x: spark.read.parquet(f"{tmp_path}/t/{x}")
    assert {r.checksum: r.id for r in read("gacetas").collect()} == {"": 1, "a": 2, "b": 3}
    assert sorted((r.norm_id, r.gaceta_id, r.id) for r in read("normas").collect() if r.gaceta_id) == [("n1", 2, 2), ("n2", 3, 3)] and read("normas").where("gaceta_id is null").count() == 1
    assert {(r.norm_id, r.kept_gaceta_id, r.superseded_gaceta_id) for r in read("norma_duplicates").collect()} == {("n1", 3, 2), ("n2", None, None)}
    sinks.processing_report(g, n, d, f"{tmp_path}/p")
    assert [(r.match_confidence, r.n) for r in spark.read.json(f"{tmp_path}/p/match_confidence").orderBy("position").collect()] == [("high", 2), ("low", 1)]
    assert spark.read.json(f"{tmp_path}/p/totals").first().norms == 3
    reports.written(n, f"{tmp_path}/c")
    assert reports.reread(spark, f"{tmp_path}/c", n.schema.simpleString().replace("struct<", "").replace(">", "").replace(":", " ")).count() == 3


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "query_id int, answer string")
    assert sinks.append_log(rows, f"{tmp_path}/log") and sinks.append_log(rows, f"{tmp_path}/log") and spark.read.json(f"{tmp_path}/log").count() == 2
    (tmp_path / "file").write_text("x")
    assert sinks.append_log(rows, f"{tmp_path}/file/below") is False


def test_vectors(spark, tmp_path):
    e = spark.createDataFrame([("a", "uno"), (None, "malo"), ("c", " "), ("d", None)], "chunk_id string, cleaned_content string")

    def encoder():
        def run(texts):
            if any("malo" in t for t in texts):
                raise RuntimeError("no")
            return [[3.0, 4.0] if t == "passage: uno" else [0.0, 0.0] for t in texts]

        return run

    got = [(r.cleaned_content, r.embedding) for r in sinks.embed(e, encoder, batch=1).collect()]
    assert got == [("uno", [0.6, 0.8]), ("malo", []), (" ", []), (None, [])]
    ids = [r.chunk_id for r in sinks.with_ids(e, "chunk_id", "cleaned_content").collect()]
    assert ids[0] == "a" and len(ids[1]) == 64 and ids == [r.chunk_id for r in sinks.with_ids(e, "chunk_id", "cleaned_content").collect()]
    sinks.write_vectors(sinks.embed(e, encoder, batch=1, normalize=False), f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").where("chunk_id = 'a'").first().norm == 5.0


def test_config(spark):
    spark.conf.set("spark.lexquarry.top_k", "7")
    try:
        c = config.load(spark, candidate_k=20, max_chars=None)
    finally:
        spark.conf.unset("spark.lexquarry.top_k")
    assert (c.top_k, c.candidate_k, c.max_chars, c.fusion_strategy) == (7, 20, 12_000, "hybridrank")
    with pytest.raises(ValueError):
        config.Config(candidate_k=0)


def test_statistics(spark):
    r = random.Random(3)
    values = [round(r.uniform(-0.3, 0.5), 4) for _ in range(15)] + [0.0, 0.1, -0.1, 0.1]
    pairs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "query_id int, difference double")
    wins, losses = sum(v > 1e-6 for v in values), sum(v < -1e-6 for v in values)
    s = reports.sign_test(pairs).first()
    n = wins + losses
    assert (s.wins, s.losses, s.ties) == (wins, losses, 1) and s.p_value == pytest.approx(min(1, 2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n))
    assert reports.binomial_two_sided(10, 3) == pytest.approx(0.0923, abs=5e-5) and reports.binomial_two_sided(0, 0) is None
    nz = sorted((v for v in values if abs(v) > 1e-6), key=abs)
    rank = lambda v: sum(abs(x) < abs(v) for x in nz) + (sum(abs(x) == abs(v) for x in nz) + 1) / 2
    plus, minus = sum(rank(v) for v in nz if v > 0), sum(rank(v) for v in nz if v < 0)
    w = reports.signed_rank(pairs).first()
    assert (w.n, w.w_plus, w.w_minus, w.statistic) == (n, plus, minus, min(plus, minus)) and w.z < 0
    assert reports.signed_rank(pairs.limit(3)).first().statistic is None
    b = reports.bootstrap(pairs, 2000).first()
    mean = sum(values) / len(values)
    assert abs(b["mean"] - mean) < 0.01 and b.ci_lower < mean < b.ci_upper and b.resamples == 2000
    assert tuple(b) == tuple(reports.bootstrap(pairs.repartition(3), 2000).first())


def test_labels(spark):
    assert [reports.metric_label(m, 10) for m in reports.METRICS] == ["Recall@10", "Precision@10", "F1@10", "MRR", "MAP", "nDCG@10"]
    assert [reports.metric_column(reports.metric_label(m, 5)) for m in reports.METRICS] == list(reports.METRICS)
    rows = spark.createDataFrame([("hybridrank_a0.5_b0.5",), ("weighted_a0.3",), ("bm25_only",), ("rrf_k60",)], "s string")
    assert [r.f for r in rows.select(reports.family(F.col("s")).alias("f")).collect()] == ["hybridrank", "weighted", "baseline", "classic"]


def test_parsed(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"uno|dos")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parse(data):
        if data == b"bad":
            raise ValueError("no")
        return [(x, i + 1, "Text") for i, x in enumerate(data.decode().split("|"))]

    rows = readers.parsed_elements(readers.pdf_files(spark, str(tmp_path)), parse).orderBy("position").collect()
    assert [(r.content, r.page_number, r.position, len(r.chunk_id)) for r in rows] == [("uno", 1, 0, 64), ("dos", 2, 1, 64)] and rows[0].chunk_id != rows[1].chunk_id


def test_stream(spark, tmp_path):
    """New files of a stream are handled once, also after a restart; windows over a stream with a watermark."""
    from lexquarry.streaming import monitor

    src, done = f"{tmp_path}/in", f"{tmp_path}/out"
    kind = "ts timestamp, event_type string, value double"
    rows = lambda *x: spark.createDataFrame(x, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    handle = lambda batch, _: batch.write.mode("append").parquet(done)
    for day in ("01", "02"):
        rows((f"2024-01-{day} 10:05:00", "a", 1.0), (f"2024-01-{day} 10:55:00", "a", 2.0)).write.mode("append").parquet(src)
        monitor.ingest(spark.readStream.schema(kind).parquet(src), handle, f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(done).count() == 4
    stream = monitor.windowed(spark.readStream.schema(kind).parquet(src)).writeStream.format("memory").queryName("windows_seen").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("windows_seen").collect()) == [(2, 3.0), (2, 3.0)]


def test_linking_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ley", "Ley", "1", 2000, "r", "exact", "deroga"), ("a", "ley", "Ley", "2", None, "r", "unresolved", "menciona"), ("b", "ley", "Ley", "3", 2001, "r", "ambiguous", "menciona")], "source string, tipo_norm string, tipo string, numero string, year int, raw string, confidence string, relation_type string")
    sinks.linking_report(rows, f"{tmp_path}/l")
    assert tuple(spark.read.json(f"{tmp_path}/l/totals").select("found", "resolved", "ambiguous", "unresolved").first()) == (3, 1, 1, 1)
    assert spark.read.json(f"{tmp_path}/l/unresolved").count() == 2 and spark.read.json(f"{tmp_path}/l/tipo_norm").first().n == 2


def test_keys(spark):
    from lexquarry.operators import adaptive, structure

    rows = spark.createDataFrame([("s", "1", "f"), ("", "1", "f"), (None, "1", None), ("", "", None)], "c string, n string, f string")
    assert [r.k for r in rows.select(structure.grouping_key(F.col("c"), F.col("n"), F.col("f")).alias("k")).collect()] == ["s", "1_f", "1_", None]
    space = adaptive.search_space(spark)
    got = [r.p for r in space.where("config in (140, 300)").orderBy("config").select(adaptive.params_json().alias("p")).collect()]
    assert [json.loads(x) for x in got] == [{"alpha": 0.7, "beta": 0.2, "k": 10.0, "normalizer": "minmax"}, {"alpha": 0.1, "normalizer": "minmax"}]
    ranked = reports.competition_rank(spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "x string, v double"), "v")
    assert sorted((r.x, r["rank"]) for r in ranked.collect()) == [("a", 1), ("b", 1), ("c", 3)]
