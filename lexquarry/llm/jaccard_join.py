"""Operator 3: near-duplicate documents by an exact n-gram Jaccard join with prefix filtering.

1. Each document's distinct shingles are sent, packed, to buckets by hash; a bucket counts in how many different sets (classes of
   equal sets count once) each shingle is. Only shingles that two or more sets have go back to their class: a shingle
   that no other set has can be in no intersection, so it only counts.
2. A class with n shingles, of which `rare` are in no other set, links with nothing if its prefix of n - ceil(t n) + 1 is all
   rare. The others are put in order from rare to frequent, by exact document frequency; what is left of the prefix is posted.
3. Candidates are class pairs that share a prefix token and pass the length and positional filters. First each token's
   documents are tried against one of them only (linear in the group's size) and links are joined into components; this repeats with another one. Then every pair
   that shares a token, lies in different components and passes the length, positional and suffix filters is a candidate, so
   no component is missed and pairs inside a large group of copies are never listed.
4. A distinct candidate pair is verified once: the suffix filter bounds the overlap by the parity of counts in 512 ranges of hash
   values before any set moves, then the sets' shared shingles are intersected.

A shingle of a great part of all documents would make its bucket hot. Counters over hashed shingles show them beforehand; their
frequency is the counter's, and they go straight to their class.

Shingles are compared by hashes of 48 bits and more (64 less what small corpora do not need), equal sets by 64 bits of a digest. Null, empty and wordless texts
have no set and link with nothing (component_id is their own doc_id); fewer words than `k` make one shingle. Rows that repeat
a doc_id are documents of their own; a null doc_id counts as larger than any other. Whole texts are used; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import NULL_ID, U64, Tables, by_bytes, coded_words, components, cut, hashed_counts, hashed_id, mixed, spans, text_array, window_hashes, window_rows, word_hashes

K = 5
PERCENT = 75
SKETCH = 1 << 18
SHINGLES_A_BUCKET = 1_500_000
TAIL = 48  # bits of a shingle's hash within its bucket
RANGES = 512  # of hash values, each with the parity of how many shared shingles fall in it
COMMON, ABOVE = 1 << 16, 4  # a counter over both COMMON and ABOVE times the mean shows shingles of a great part of all documents
ROUNDS = 3  # linear rounds before the exact one, unless one of them finds no link
FOUND = "kind int, bucket long, blob binary, key long, doc_id long, node long, n long"
PARITY = [f"r{i}" for i in range(RANGES // 64)]
LISTS = f"node long, n long, rare long, {' long, '.join(PARITY)} long, tokens binary"


def shingles(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text row) of every k-word shingle, with repeats; ASCII letters in lower case."""
    bounds, codes, words = coded_words(pc.ascii_lower(texts))
    hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, dtype=U64)
    at, rows = window_rows(bounds, k)
    out = window_hashes(hashes, k)[at] if len(at) else np.empty(0, dtype=U64)
    counts = np.diff(bounds)
    for n in range(1, k):  # the whole sequence as one
        short = np.flatnonzero(counts == n)
        if len(short):
            h = window_hashes(hashes, n)[bounds[short]] ^ mixed(np.full(len(short), n, dtype=U64))
            out, rows = np.concatenate([out, h]), np.concatenate([rows, short])
    return out, rows


def sets(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of each text's distinct shingles, ascending."""
    hashes, rows = shingles(texts, k)
    order = np.argsort(hashes)
    small = np.uint16 if len(texts) < 1 << 16 else np.int64
    order = order[np.argsort(rows[order].astype(small), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])) if len(rows) else np.empty(0, dtype=bool)
    return np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(texts)))]), hashes[new]


def least_overlap(a, b, percent: int = PERCENT):
    """The least intersection of sets of sizes a and b that makes 100 * intersection >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.where(n > 0, n - -((-percent * n) // 100) + 1, 0)


# ---------------------------------------------------------------- packed lists that move


def packed(nodes: np.ndarray, n: np.ndarray, counts: np.ndarray, tokens: np.ndarray, width: int, high: int = 0, times: np.ndarray | None = None) -> bytes:
    """Classes with their set sizes, and for each of them `counts` tokens, of which `width` bytes are written and `high` bits are the same, with how many sets have each."""
    low = np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    body = struct.pack("<qqqQ", len(nodes), len(tokens), width, high) + nodes.astype("<i8").tobytes() + n.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + low
    return zstandard.compress(body + (np.minimum(times, 2**32 - 1).astype("<u4").tobytes() if times is not None else b""), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, n, counts, tokens, times) of a blob; times is empty if it has none."""
    data, at, out = zstandard.decompress(blob), 32, []
    d, m, width, high = struct.unpack_from("<qqqQ", data)
    for kind in ("<i8", "<u4", "<u4"):
        out.append(np.frombuffer(data, dtype=kind, count=d, offset=at).astype(np.int64))
        at += int(kind[2]) * d
    tokens = np.zeros((m, 8), dtype=np.uint8)
    tokens[:, :width] = np.frombuffer(data, dtype=np.uint8, count=m * width, offset=at).reshape(m, width)
    times = np.frombuffer(data, dtype="<u4", offset=at + m * width).astype(np.int64)
    return *out, tokens.view("<u8").reshape(-1) | U64(high), times


def joined_parts(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(5))


def first_of(nodes: np.ndarray) -> np.ndarray:
    """A flag at the first place of every class."""
    out = np.zeros(len(nodes), dtype=bool)
    out[np.unique(nodes, return_index=True)[1]] = True
    return out


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in the array) of every bucket there is."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def node_bucket(nodes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mixed(nodes.view(U64)) % U64(n_buckets)).astype(np.int64)


def found_rows(kind: int, m: int, **columns) -> pa.RecordBatch:
    fields = [x.split() for x in FOUND.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns["kind"] = np.full(m, kind)
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(m, kinds[t]) for c, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [c for c, _ in fields])


def shared_shingles(docs: DataFrame, counts: np.ndarray, bits: int, k: int = K, common: int = COMMON) -> DataFrame:
    """FOUND. Kind 0: a document's key, doc_id, class (node: 64 bits of its set's digest, null without a set) and set size.
    Kind 1: for a bucket of classes, packed, those of their shingles that several classes have."""
    import xxhash

    n_buckets = 1 << bits
    drop = U64(max(0, 64 - bits - TAIL))
    tail = U64(64 - bits) - drop
    hot = counts > max(common, ABOVE * float(counts.mean()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, most=4 << 20):
            bounds, hashes = sets(text_array(batch.column("text")), k)
            n = np.diff(bounds)
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            view = memoryview(hashes).cast("B") if len(hashes) else memoryview(b"")
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * a : 8 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)), dtype=U64, count=len(n)).view(np.int64)
            info = struct.pack("<q", len(n)) + np.stack([keys, ids, nodes, n]).astype("<i8").tobytes()
            out_b, out_blob = [n_buckets + int(abs(int(keys[0]))) % n_buckets], [zstandard.compress(info, 1)]
            row = np.repeat(np.arange(len(n)), n)
            go = first_of(nodes)[row]  # of equal sets one is sent
            row, hashes = row[go], hashes[go]
            counter, token = (hashes % U64(SKETCH)).astype(np.int64), hashes >> drop

            def sent(sel: np.ndarray, to: int, width: int, times: np.ndarray | None = None) -> None:
                used = np.flatnonzero(np.diff(row[sel], prepend=-1))  # each row's tokens stand together
                out_b.append(to)
                out_blob.append(packed(nodes[row[sel[used]]], n[row[sel[used]]], np.diff(np.append(used, len(sel))), token[sel], width, 0, times))

            rare, often = np.flatnonzero(~hot[counter]), np.flatnonzero(hot[counter])
            for b, sel in by_bucket((token[rare] >> tail).astype(np.uint16 if bits <= 16 else np.int64)):
                sent(rare[sel], b, TAIL // 8)
            for b, sel in by_bucket(node_bucket(nodes, n_buckets)[row[often]]):  # these pass by the counting
                sent(often[sel], 2 * n_buckets + b, 8, counts[counter[often[sel]]])
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_blob, pa.binary())], ["bucket", "blob"])

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = key[0].as_py(), []
        for batch in batches:
            for blob in (b.as_py() for b in batch.column("blob")):
                if bucket >= 2 * n_buckets:
                    yield found_rows(1, 1, bucket=[bucket - 2 * n_buckets], blob=[blob])
                elif bucket >= n_buckets:
                    data = zstandard.decompress(blob)
                    keys, ids, nodes, n = np.frombuffer(data, dtype="<i8", offset=8).reshape(4, -1)
                    yield found_rows(0, len(n), key=keys, doc_id=ids, node=pa.array(nodes, mask=n == 0), n=n)
                else:
                    parts.append(unpacked(blob))
        if not parts:
            return
        nodes, n, size, token, _ = joined_parts(parts)
        parts.clear()
        one = first_of(nodes)  # a class from several tasks
        token, nodes, n, size = token[np.repeat(one, size)] & ((U64(1) << tail) - U64(1)), nodes[one], n[one], size[one]
        order = np.argsort(token)
        times = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(token[order]) != 0)), len(order)))
        each = np.empty(len(order), dtype=np.int64)
        each[order] = np.repeat(times, times)
        seen = np.concatenate([[0], np.cumsum(each > 1)])
        begin = seen[np.cumsum(size) - size]
        size = seen[np.cumsum(size)] - begin
        token, each = token[each > 1], each[each > 1]
        some = np.flatnonzero(size)
        for b, sel in by_bucket(node_bucket(nodes[some], n_buckets)):
            sel = some[sel]
            at = np.repeat(begin[sel], size[sel]) + spans(size[sel])
            yield found_rows(1, 1, bucket=[b], blob=[packed(nodes[sel], n[sel], size[sel], token[at], TAIL // 8, bucket << int(tail), each[at])])

    return docs.mapInArrow(send, "bucket long, blob binary").groupBy("bucket").applyInArrow(count, FOUND)


def possible_lists(found: DataFrame, percent: int) -> DataFrame:
    """LISTS of the classes that can link at all: their shared shingles from rare to frequent, how many are in no other set
    (`rare`), and the parity of the number of shared ones in each of RANGES ranges of hash values."""

    def order(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, n, size, token, times = joined_parts([unpacked(b.as_py()) for batch in batches for b in batch.column("blob")])
        ids, first, place = np.unique(nodes, return_index=True, return_inverse=True)
        place = np.repeat(place, size)
        sort = np.lexsort((token, times, place))
        place, token = place[sort], token[sort]
        # common shingles come once from each task that has the class
        new = np.append(True, (np.diff(place) != 0) | (np.diff(token) != 0)) if len(token) else np.empty(0, dtype=bool)
        place, token = place[new], token[new]
        n, shared = n[first], np.bincount(place, minlength=len(ids))
        ranges = np.zeros((len(ids), RANGES), dtype=np.uint8)  # may overflow, which keeps the parity
        np.add.at(ranges, (place, (mixed(token) % U64(RANGES)).astype(np.int64)), 1)
        parity = np.packbits(ranges & 1, axis=1).view("<i8")
        ends = np.cumsum(shared)
        keep = np.flatnonzero(n - shared < prefix_length(n, percent))
        data = token.astype("<u8")
        for a in range(0, len(keep), 1024):
            some = keep[a : a + 1024]
            blobs = pa.array([data[ends[i] - shared[i] : ends[i]].tobytes() for i in some], pa.binary())
            columns = (ids[some], n[some], (n - shared)[some], *parity[some].T)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), blobs], [x.split()[0] for x in LISTS.split(", ")])

    return found.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(order, LISTS)


def prefix_postings(lists: DataFrame, percent: int) -> DataFrame:
    """token, node, n, rare, pos: the prefix of every class, without what no other class has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "tokens", 4 << 20):
            nodes, n, rare = (batch.column(c).to_numpy() for c in ("node", "n", "rare"))
            left = prefix_length(n, percent) - rare
            tokens = [np.frombuffer(t.as_py(), dtype="<i8", count=c) for t, c in zip(batch.column("tokens"), left, strict=True)]
            row, pos = np.repeat(np.arange(len(n)), left), spans(left)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (np.concatenate(tokens), nodes[row], n[row], rare[row], rare[row] + pos))], ["token", "node", "n", "rare", "pos"])

    return lists.select("node", "n", "rare", "tokens").mapInArrow(run, "token long, node long, n long, rare long, pos long")


# ---------------------------------------------------------------- pairs


def similar_sizes(percent: int, a: str = "", b: str = "2") -> Column:
    """Length and positional filters for a common token of classes with the columns n, pos and n2, pos2."""
    n, m, pos, qos = (F.col(x) for x in (f"n{a}", f"n{b}", f"pos{a}", f"pos{b}"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - pos - 1, m - qos - 1) >= needed(n, m, percent))


def needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


def similar_ranges(percent: int, a: str = "", b: str = "2") -> Column:
    """The suffix filter: where the numbers of shared shingles in a range differ in parity, a shingle is in one set only."""
    apart = F.lit(0)
    for c in PARITY:
        apart = apart + F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b)))
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    shared = n - F.col(f"rare{a}") + m - F.col(f"rare{b}")
    return shared - apart >= 2 * needed(n, m, percent)


def verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            need = least_overlap(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            link = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)):
                both = np.frombuffer(x.as_py() + y.as_py(), dtype="<u8").copy()
                both.sort()
                link[i] = np.count_nonzero(both[1:] == both[:-1]) >= need[i]
            yield pa.RecordBatch.from_arrays([pa.array(a[link]), pa.array(b[link])], ["a", "b"])

    sizes = lambda c: lists.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "rare", *PARITY)))
    pairs = pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(similar_ranges(percent, "_a", "_b")).select("a", "b", "n_a", "n_b")
    tokens = lambda c: lists.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    return pairs.join(tokens("a"), "a").join(tokens("b"), "b").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def renamed(rows: DataFrame, step: DataFrame, column: str) -> DataFrame:
    """`rows` with the component in `column` replaced by that which it joined in `step` (node, component)."""
    joined = step.select(F.col("node").alias(column), F.col("component").alias("joined"))
    return rows.join(joined, column, "left").withColumn(column, F.coalesce("joined", column)).select(*rows.columns)


def between(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (a, b) of classes as links of the components (node, component) that they are in."""
    for end in ("a", "b"):
        links = renamed(links, parts, end)
    return links.where("a <> b").distinct()


def linked_parts(lists: DataFrame, tables: Tables, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """node, component of every class that links with another one."""

    def candidates(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).where("a < b").distinct()

    posted = tables.keep(prefix_postings(lists, percent))
    parts = tables.keep(lists.select("node", F.col("node").alias("component")).limit(0))
    at = posted.withColumn("part", F.col("node"))
    tried = tables.keep(lists.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    turn, linear = 0, True
    while True:
        # the tokens whose classes are not yet in one component, each with a class of its largest one: first that with the fewest
        # shingles of its own, which is the likeliest to be what others are copies of, then others
        own = -F.col("rare") if turn == 0 else F.lit(0)
        one = F.max(F.struct(own.alias("own"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "pos"))
        heads = at.groupBy("token", "part").agg(F.count("*").alias("size"), one.alias("head"))
        heads = heads.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("size", "head", "part")).alias("most")).where("parts > 1")
        heads = heads.select("token", F.col("most.part").alias("largest"), *(F.col(f"most.head.{c}").alias(f"{c}2") for c in ("node", "n", "pos")))
        at = tables.keep(at.join(heads, "token"))
        if at.isEmpty():
            break
        if linear:
            # each class outside a token's largest component against that class inside it
            found = at.where("part <> largest").where(similar_sizes(percent))
        else:
            # every pair of different components that may link
            ranges = at.drop("node2", "n2", "pos2").join(lists.select("node", *PARITY), "node")
            others = ranges.where("part <> largest").select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "part", "rare", *PARITY)))
            found = ranges.join(others, "token").where("part <> part2 and (part = largest or node < node2)").where(similar_sizes(percent) & similar_ranges(percent))
        found = tables.keep(candidates(found).join(tried, ["a", "b"], "left_anti"))
        step = tables.keep(components(between(verified(found, lists, percent), parts), tables))
        known = renamed(parts, step, "component")
        parts = tables.keep(known.unionByName(step.join(known, "node", "left_anti")))
        if not linear:
            break
        turn += 1
        linear = turn < rounds and not step.isEmpty()
        tried = tried.union(found)
        at = renamed(at.select("token", "node", "n", "rare", "pos", "part"), step, "part")
    return parts


def link_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """key, doc_id, n, component (a class, null without shingles) for every row of `docs` (doc_id, text), as a checkpoint."""
    keyed = docs.select(hashed_id().alias("key"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = hashed_counts(keyed.select("text"), lambda b: (shingles(text_array(b.column("text")), k)[0] % U64(SKETCH)).astype(np.int64), SKETCH)
    bits = max(3, (int(counts.sum()) // SHINGLES_A_BUCKET).bit_length())
    tables = Tables(docs.sparkSession)
    found = tables.keep(shared_shingles(keyed, counts, bits, k, common))
    lists = tables.keep(possible_lists(found, percent))
    parts = linked_parts(lists, tables, percent)
    rows = found.where("kind = 0").select("key", "doc_id", "node", "n").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    # a document without a set is alone
    rows = cut(rows.select("key", "doc_id", "n", F.when(F.col("n") > 0, F.col("part")).alias("component")))
    tables.drop()
    return rows


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text)."""
    rows = link_classes(docs, k, percent, common)
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = lambda c: F.when(c != NULL_ID, c)
    rows = rows.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
