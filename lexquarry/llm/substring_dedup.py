"""Operator 9: removal of long passages that an earlier document has, by super-k-mer partitioning.

1. A pass over all documents counts hashed M-word grams: an order of grams from rare to frequent.
2. Each task hashes its K-word windows. A window whose words also start in a smaller document of the same task is decided
   there; of each distinct window all occurrences in its first document travel. Consecutive travelling windows that share a minimiser
   (the window's first gram in the order) are one super-k-mer, packed as one string of words for its minimiser's bucket. With rare
   grams first, the windows at the edge of a very common passage take grams that reach out of it and spread over buckets.
3. A bucket numbers its words, sorts its windows by hash, compares the words of equal hashes exactly, and sends the
   windows that start in a smaller document back to their documents.
4. Documents, shuffled once by row key, drop the covered words.

A null text has no words (the digest of nothing); a null doc_id counts as larger than any other and stays null; rows
repeated with one doc_id do not remove each other; texts under K words lose nothing. Long texts are processed whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import NULL_ID, U64, by_bytes, coarse, coded_words, hashed_counts, hashed_id, mixed, spans, split_words, strings, text_array, window_hashes, window_rows, word_hashes

K = 50
M = 4
SKETCH = 1 << 18
WINDOWS_A_BUCKET = 200_000
SENT = "bucket long, blob binary"
GONE = "key long, doc_id long, windows binary"


def gram_hashes(bounds: np.ndarray, codes: np.ndarray, words: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, dtype=U64)
    return hashes, window_hashes(hashes, m)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def pack_super_kmers(docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, words: list[bytes]) -> bytes:
    """Runs of words with their row key, doc_id and first window."""
    head = np.concatenate([keys.astype("<i8"), docs.astype("<i8"), starts.astype("<i8"), lengths.astype("<i8")]).tobytes()
    return zstandard.compress(struct.pack("<q", len(docs)) + head + b"\n".join(words), 1)


def unpack_super_kmers(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    data = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<q", data)
    keys, docs, starts, lengths = np.frombuffer(data, dtype="<i8", count=4 * n, offset=8).reshape(4, n)
    return keys, docs, starts, lengths, data[8 + 32 * n :]


def repeated(order_key: np.ndarray, docs: np.ndarray, at: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows that also start in a smaller document, windows in the first document of their words): both as flags.

    order_key: hashes of the windows; at: where each starts in codes. Equal hashes are compared word by word with the first
    of their group; windows whose words differ from it (a collision) are settled by another pass.
    """
    n = len(order_key)
    again, first = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    todo = np.arange(n)
    while len(todo):
        order = todo[np.lexsort((at[todo], docs[todo], order_key[todo]))]
        key = order_key[order]
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        head = order[new][group]
        follows = np.flatnonzero(~new)
        equal = np.ones(len(order), dtype=bool)
        for i in range(k) if len(follows) else ():
            equal[follows] &= codes[at[order[follows]] + i] == codes[at[head[follows]] + i]
        same, least = order[equal], docs[head[equal]]
        again[same] = docs[same] > least
        first[same] = docs[same] == least
        todo = order[~equal]
    return again, first


def runs_of(flags_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of consecutive numbers in a sorted array."""
    if not len(flags_at):
        return flags_at, flags_at
    begin = np.flatnonzero(np.append(True, np.diff(flags_at) != 1))
    return flags_at[begin], np.diff(np.append(begin, len(flags_at)))


def gone_rows(keys: np.ndarray, docs: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """One row per document: its removed windows as (first, length) runs."""
    order = np.lexsort((windows, keys))
    keys, docs, windows = keys[order], docs[order], windows[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    blobs = []
    for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
        blobs.append(np.stack(runs_of(np.unique(windows[a:b])), axis=1).astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys[cuts], pa.int64()), pa.array(docs[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["key", "doc_id", "windows"])


def repeated_windows(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """key, doc_id, windows: for documents (key, doc_id not null, text), runs of windows that also start in a smaller doc_id."""

    def grams(batch: pa.RecordBatch) -> np.ndarray:
        bounds, codes, words = coded_words(text_array(batch.column("text")))
        at, _ = window_rows(bounds, m)
        return (gram_hashes(bounds, codes, words, m)[1][at] % U64(SKETCH)).astype(np.int64)

    counts = hashed_counts(docs.select("text"), grams, SKETCH)
    n_buckets = max(8, int(counts.sum()) // WINDOWS_A_BUCKET)
    rank = coarse(counts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=6 << 20):
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            bounds, codes, words = coded_words(text_array(batch.column("text")))
            at, rows = window_rows(bounds, k)
            if not len(at):
                continue
            hashes, gram = gram_hashes(bounds, codes, words, m)
            order = (rank[(gram % U64(SKETCH)).astype(np.int64)].astype(U64) << U64(56)) | (gram >> U64(8))
            least = sliding_min(order, k - m + 1)[at]
            window = window_hashes(hashes, k)[at]
            again, first = repeated(window, ids[rows], at, codes, k)
            if again.any():
                got = gone_rows(keys[rows[again]], ids[rows[again]], (at - bounds[rows])[again])
                for i in range(got.num_rows):  # they ride along to a bucket of their own document's
                    blob = struct.pack("<qqq", -1, got.column("key")[i].as_py(), got.column("doc_id")[i].as_py()) + got.column("windows")[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([n_buckets + got.column("key")[i].as_py() % n_buckets], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])
            go = np.flatnonzero(first)
            begin = np.append(True, (np.diff(at[go]) != 1) | (np.diff(rows[go]) != 0) | (least[go][1:] != least[go][:-1]))
            begin = np.flatnonzero(begin)
            size = np.diff(np.append(begin, len(go)))
            head = go[begin]
            bucket = (mixed(least[head]) % U64(n_buckets)).astype(np.int64)
            table = np.array([w.encode() for w in strings(words)], dtype=object)
            order_b = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(bucket[order_b]) != 0))
            out_b, out_blob = [], []
            for a, b in zip(edges, np.append(edges[1:], len(order_b)), strict=True):
                sel = order_b[a:b]
                n = size[sel] + k - 1
                index = np.repeat(at[head[sel]], n) + spans(n)
                out_b.append(int(bucket[sel[0]]))
                r = rows[head[sel]]
                out_blob.append(pack_super_kmers(ids[r], at[head[sel]] - bounds[r], size[sel], keys[r], table[codes[index]].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_blob, pa.binary())], ["bucket", "blob"])

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for blob in batch.column("blob"):
                blob = blob.as_py()
                if key[0].as_py() >= n_buckets:
                    _, row_key, doc = struct.unpack_from("<qqq", blob)
                    yield pa.RecordBatch.from_arrays([pa.array([row_key], pa.int64()), pa.array([doc], pa.int64()), pa.array([blob[24:]], pa.binary())], ["key", "doc_id", "windows"])
                else:
                    parts.append(unpack_super_kmers(blob))
        if not parts:
            return
        keys, docs_, starts, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
        text = pa.array([b"\n".join(p[4] for p in parts)], pa.large_binary()).cast(pa.large_string(), safe=False)
        codes = split_words(text)[1].dictionary_encode().indices.to_numpy().astype(np.int64)
        n = size + k - 1
        begin = np.cumsum(n) - n
        at = np.repeat(begin, size) + spans(size)
        run = np.repeat(np.arange(len(size)), size)
        window = window_hashes(mixed(codes.astype(U64) + U64(1)), k)[at]
        again, _ = repeated(window, docs_[run], at, codes, k)
        if again.any():
            yield gone_rows(keys[run[again]], docs_[run[again]], (starts[run] + at - begin[run])[again])

    sent = docs.mapInArrow(send, SENT)
    return sent.groupBy("bucket").applyInArrow(settle, GONE)


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) for every row of `docs` (doc_id, text)."""
    keyed = docs.select(hashed_id().alias("key"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gone = repeated_windows(keyed, k, m).groupBy("key", "doc_id").agg(F.collect_list("windows").alias("windows"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=4 << 20):
            bounds, words = split_words(text_array(batch.column("text")))
            lost = np.zeros(len(words) + 1, dtype=np.int64)
            for i, runs in enumerate(batch.column("windows").to_pylist()):
                for blob in runs or ():
                    pairs = np.frombuffer(blob, dtype="<i8").reshape(-1, 2)
                    np.add.at(lost, bounds[i] + pairs[:, 0], 1)
                    np.add.at(lost, bounds[i] + pairs[:, 0] + pairs[:, 1] + k - 1, -1)
            kept = np.cumsum(lost)[:-1] == 0
            total = np.concatenate([[0], np.cumsum(kept)])
            offsets = total[bounds]
            left = words.filter(pa.array(kept))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left)
            ids = pc.if_else(pc.equal(batch.column("doc_id"), NULL_ID), pa.scalar(None, pa.int64()), batch.column("doc_id"))
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(n - np.diff(offsets)), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return keyed.join(gone, ["key", "doc_id"], "left").select("doc_id", "text", "windows").mapInArrow(drop, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM win),
f AS (SELECT s, min(doc_id) AS d FROM h GROUP BY s),
gone AS (SELECT h.doc_id, h.i FROM h JOIN f USING (s) WHERE h.doc_id > f.d),
lost AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM gone) GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN lost USING (doc_id)),
k AS (SELECT doc_id, ws, [ws[p] for p in range(1, len(ws) + 1) if NOT list_contains(ps, p)] AS kept FROM j)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""
