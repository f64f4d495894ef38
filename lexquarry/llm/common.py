"""What the operators share: the cluster's folder, Arrow word arrays, hashed counters, components.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D everywhere, as in the contracts.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
NULL_ID = 2**63 - 1  # a null doc_id sorts after every other


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where none is configured and all run on this machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        current = jsc.getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexquarry-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables written in the shared folder and read again, dropped together. They cut the lineage, survive lost executors, and small
    files are read together, so tables that loops make from one another do not gather partitions as checkpoints would."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        """A new folder that goes with the tables."""
        path = f"{shared_dir(self.spark).rstrip('/')}/lexquarry-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.folder("table")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete what was kept; nothing that reads it may be used any more."""
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        self.paths = []


def kept_table(df: DataFrame) -> DataFrame:
    """A table in the shared folder that the result itself still reads."""
    return Tables(df.sparkSession).keep(df)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hashed_id(column: str = "doc_id"):
    """Row key: rows that repeat a doc_id with another text stay apart."""
    return F.xxhash64(F.col(column), F.col("text"))


# ---------------------------------------------------------------- word arrays


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Large strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(texts):
        return texts
    # offsets from 0 on: some kernels of Arrow take a slice's data from the buffer's start
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), data])


def trim() -> None:
    """Give memory that is free back to the system: workers live on after a task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_bytes(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches again, each of about `most` bytes of text (a longer text is alone): bounds the memory of a step."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            room = most - size
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + room, "right"))
            stop = max(stop, start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - (ends[start - 1] if start else 0))
            if stop < batch.num_rows or size >= most:
                yield joined(held)
                held, size = [], 0
            start = stop
    if held:
        yield joined(held)
    held.clear()
    trim()


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, all words in order)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.binary_length(flat).to_numpy() > 0
    if not full.all():
        seen = np.concatenate([[0], np.cumsum(full)])
        bounds = seen[bounds]
        flat = flat.filter(pa.array(full))
    return bounds, flat


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, code of each word, the distinct words that the codes number)."""
    bounds, flat = split_words(texts)
    coded = flat.dictionary_encode()
    return bounds, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words; equal on every machine."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, strings(words)), dtype=U64, count=len(words))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries (order counts); len - k + 1 of them, text bounds not regarded."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=U64)
        for i in range(k):
            total = total * U64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(total)


def window_rows(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each window that stays inside one text, its text's row)."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(len(rows)) + first, rows


def spans(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in lengths, one after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths)


def symbol_bytes() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# ---------------------------------------------------------------- hashed counters


def hashed_counts(df: DataFrame, counts_of: Callable[[pa.RecordBatch], np.ndarray], n_buckets: int, planes: int = 1) -> np.ndarray:
    """Sums of `planes` x `n_buckets` counters over all rows: one vector per task, summed by chunk in the cluster.

    counts_of(batch) gives bucket numbers (with plane * n_buckets added). The result has a fixed size whatever the
    input's, so it may go to the driver.
    """
    size = n_buckets * planes
    chunk = min(size, 1 << 12)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in by_bytes(batches):
            total += np.bincount(counts_of(batch), minlength=size)
        blocks = total.reshape(-1, chunk)
        rows = np.flatnonzero(blocks.any(axis=1))
        some = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows), some), pa.int32()), pa.array(rows, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in rows], pa.binary())], ["some", "chunk", "counts"]
        )

    def summed(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, dtype=np.int64)
        for batch in rows:
            for blob in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    kinds = "chunk int, counts binary"
    out = np.zeros(size, dtype=np.int64)
    # in two steps, so that a group never holds more than a few hundred tasks' vectors
    parts = df.mapInArrow(partial, "some int, " + kinds).groupBy("chunk", "some").applyInArrow(summed, kinds)
    for row in parts.groupBy("chunk").applyInArrow(summed, kinds).collect():
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)
    return out.reshape(planes, n_buckets) if planes > 1 else out


def coarse(counts: np.ndarray) -> np.ndarray:
    """Counters on a logarithmic scale in one byte: enough to order n-grams from rare to frequent."""
    return np.minimum(255, np.floor(np.log2(counts + 1.0) * 6)).astype(np.uint8)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, tables: Tables, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Large-star and small-star rounds, kept in `tables`.

    A node with very many links (the centre of a large group) is only a join key whose partition adaptive execution
    splits, and an aggregation key that is combined before the shuffle. Self links and repeated links are allowed.
    """
    def summary(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()

    now = tables.keep(edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a < b").distinct())
    seen = summary(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        now = tables.keep(small.select("e.a", "e.b").where("a < b").distinct())
        last, seen = seen, summary(now)
        if last == seen:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
