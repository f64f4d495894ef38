"""Operator 6: WARC archives with an external index merge.

Writing: each task writes gzip members, a record each, to an archive of its own in the output folder (a new name for each
attempt, so a repeated task leaves no half file in the way) and yields its run of index entries: URL key, timestamp,
page, file, offset, length. The entries are kept as a table, so nothing that was written is written again.

Index: every run is sorted by (URL key, timestamp, page), cut at splitting keys that come from about SAMPLE keys, chosen by hash,
and sent as packed slices. The task of a key range merges its slices of all runs with a loser tree. Ranges in
order are the globally ordered capture histories. A URL that has a third of all captures is split too, since timestamp
and page are part of the key.

Reading: the archives' bytes are dealt out evenly in ranges of file and offset, so that each is read in order; members are parsed, and their
digests computed again.

Of records with equal payloads of `least` bytes or more, that with the largest page_id is the response and the others are
revisits of it (in the same row order for repeated page_ids: each row is a record; all rows of the largest page_id are
responses). Smaller payloads are always responses. Null html is an empty payload, a null url is "" (key ")/"), blanks and control characters in one become %20, a null page_id
is kept and counts as smaller than any other. Capture times follow from page_id, as `pages` has none.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import Tables, by_bytes, cut, shuffle_width

LEAST = 1000
SAMPLE = 20_000  # keys from which the splitting keys are chosen, about
READ = 64 << 20  # bytes of archives that a task reads, about
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
ENTRY = "urlkey string, ts string, page_id long, file string, offset long, length long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the path and query in lower case."""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"{url.lower()})/"
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def capture_time(page_id: int | None) -> datetime:
    return FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (1 << 30))


def record_id(page_id, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}')}>"


def record(page_id, url: str, payload: bytes, digest: str, refers_to, refers_url: str | None) -> bytes:
    """A WARC/1.1 record: a response holds the payload, a revisit only says where it is."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}"]
        head += [f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {capture_time(refers_to):%Y-%m-%dT%H:%M:%SZ}", f"X-Refers-To-Page-ID: {refers_to}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, HTTP payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else ("file://" + folder.removeprefix("file:")))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), digest, refers_to, refers_url for every row: which record each page becomes."""
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    leaders = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("l")).where("n > 1")
    rows = rows.join(leaders.select("digest", F.col("l.page_id").alias("leader"), F.col("l.url").alias("leader_url")), "digest", "left")
    same = F.col("leader").isNull() | (F.coalesce(F.col("page_id"), F.lit(-(2**63))) == F.col("leader"))
    return rows.select("page_id", "url", "payload", "digest", F.when(~same, F.col("leader")).alias("refers_to"), F.when(~same, F.col("leader_url")).alias("refers_url"))


def write_archives(records: DataFrame, folder: str, tables: Tables, level: int = 1) -> DataFrame:
    """Write the records of `revisits` to archives in `folder`; gives the entries (ENTRY), kept in `tables`. Lossless and re-runnable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        name, out, at = f"run-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in by_bytes(batches, "payload"):
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            rows = []
            for row in batch.to_pylist():
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_url"])) + packer.flush()
                out.write(member)
                rows.append((url_key(row["url"]), f"{capture_time(row['page_id']):%Y%m%d%H%M%S}", row["page_id"], name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], NAMES)
        if out is not None:
            out.close()

    return tables.keep(records.mapInArrow(run, ENTRY))


# ---------------------------------------------------------------- index merge


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so the next winner costs one path of matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        n = max(1, len(runs))
        self.size = n
        self.losers = [-1] * n
        for i in range(len(runs)):
            self.play(i)

    def before(self, a: int, b: int) -> bool:
        """An unplayed place (-1) wins, so that every leaf enters; an exhausted run loses."""
        if a == -1 or b == -1:
            return a == -1
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node > 0:
            if self.before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs:
            winner = self.losers[0]
            head = self.heads[winner] if winner >= 0 else None
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self.play(winner)


def sort_key(entry: tuple) -> tuple:
    """URL key and timestamp first; page, file and offset make it total."""
    urlkey, ts, page, file, offset, _ = entry
    return urlkey, ts, -(2**63) if page is None else page, file, offset


def merged_index(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """`part`, `position` and the entries' columns: the entries of all runs in global order (part, then position)."""
    ranges = ranges or shuffle_width(entries.sparkSession)
    keys = ("urlkey", "ts", "page_id", "file", "offset")
    each = max(1, entries.count() // SAMPLE)
    sample = entries.where(F.pmod(F.xxhash64(*keys), F.lit(each)) == 0).select(*keys, "length").collect()
    sample = sorted(sort_key(tuple(r)) for r in sample)
    splits = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left

        for batch in batches:  # a run: what a batch holds, sorted
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True), key=sort_key)
            edges, parts, blobs = [0, *(bisect_left(rows, s, key=sort_key) for s in splits), len(rows)], [], []
            for i in range(len(edges) - 1):
                if edges[i] < edges[i + 1]:
                    parts.append(i)
                    blobs.append(packed_run(rows[edges[i] : edges[i + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "run"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [unpacked_run(b.as_py()) for batch in batches for b in batch.column("run")]
        tree, done, held = LoserTree([((sort_key(e), e[5]) for e in r) for r in runs]), 0, []

        def rows():
            n = len(held)
            cols = list(zip(*held, strict=True))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["part", "position", *NAMES]
            )

        for (urlkey, ts, page, file, offset), length in tree:
            held.append((urlkey, ts, None if page == -(2**63) else page, file, offset, length))
            if len(held) == 4096:
                yield rows()
                done += len(held)
                held = []
        if held:
            yield rows()

    cut_runs = entries.mapInArrow(sorted_runs, "part int, run binary")
    return cut_runs.groupBy("part").applyInArrow(merge, "part int, position long, " + ENTRY)


def packed_run(rows: list[tuple]) -> bytes:
    lines = "\n".join("\x1f".join("" if v is None else str(v) for v in r) for r in rows)
    return zlib.compress(struct.pack("<q", len(rows)) + lines.encode(), 1)


def unpacked_run(blob: bytes) -> list[tuple]:
    rows = []
    for line in zlib.decompress(blob)[8:].decode().split("\n"):
        urlkey, ts, page, file, offset, length = line.split("\x1f")
        rows.append((urlkey, ts, int(page) if page else None, file, int(offset), int(length)))
    return rows


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null of a revisit), read through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        files: dict[str, object] = {}
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[name] = system.open_input_file(f"{root}/{name}")
                headers, payload = parse(gzip.decompress(files[name].read_at(length, offset)))
                revisit = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the payload is not what its digest says")
                page, to = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                rows.append((int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(to) if to else None, int(headers["X-Payload-Length"]) if revisit else len(payload), digest, None if revisit else payload))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        for f in files.values():
            f.close()

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    width = max(shuffle_width(index.sparkSession), int(index.agg(F.sum("length")).first()[0] or 0) // READ)
    return index.select("file", "offset", "length").repartitionByRange(width, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, kinds)


def query(spark, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    folder = tables.folder("warc")
    entries = write_archives(revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder, tables)
    index = tables.keep(merged_index(entries))
    back = cut(read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    tables.drop()
    return back


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS m FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM d
"""
