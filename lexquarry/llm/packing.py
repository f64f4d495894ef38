"""Operator 10: packing by patterns whose repeat counts come from non-negative least squares.

Documents are encoded, closed with id 0 and cut into pieces of at most `capacity` tokens. The histogram of piece lengths
(at most `capacity` numbers, whatever the corpus) goes to the driver. Patterns of up to three length classes that fill a
sequence are enumerated; a non-negative least squares fit gives how often each repeats, rounded down; what is left of the
histogram is packed by filling the largest length's gap with the largest lengths that fit, a whole group of equal
sequences at a time. The plan, of bounded size, says for a length class and a rank in it which sequence takes the piece.
Ranks are local ranks in salted groups plus offsets from the groups' counts, so no length gathers in one task.

Null texts are empty (one piece with the closing id), null doc_ids are allowed, repeated rows are packed each. Whole
texts are encoded; a chunk between ASCII white space has the same ids wherever it stands, so distinct chunks are encoded
once by the library.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import by_bytes, coded_words, cut, spans, strings, symbol_bytes, text_array

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SALTED = 100_000  # pieces of one length that are ranked in one group, about
GRID = 8  # tokens in a length class of the fitted patterns
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"

MARK = "\x01"  # closes a word, in place of the vocabulary's word end
WORD_END = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed: the tokenizer file's own
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of distinct chunks, many in one call.

    The vocabulary's ids are its merges' ranks, so merging the adjacent pair whose joined bytes have the least id is the
    same procedure, provided that each vocabulary string alone becomes itself; strings that do not are left out (they
    never arise). A chunk with a character that the two libraries could treat differently goes to the file's library.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            read = json.load(f)
        vocab = read["model"]["vocab"]
        if read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN or read["model"]["end_of_word_suffix"] != WORD_END:
            raise ValueError(f"{path}: not the kind of vocabulary that this encoder knows")
        back = symbol_bytes()
        special = {t["content"] for t in read["added_tokens"]}
        ranks = {}
        for s, i in vocab.items():
            if s in special:
                continue
            closed = s.endswith(WORD_END) and s != WORD_END
            key = bytes(back[c] for c in (s[: -len(WORD_END)] if closed else s)) + MARK.encode() * closed
            if MARK.encode() not in key[: len(key) - closed] or len(key) == 1:
                ranks[key] = i
        self.ids = tiktoken.Encoding("words", pat_str=f"[^{MARK}\n]*{MARK}|\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (self.line_id,) = self.ids("\n")
        self.close = regex.compile(PATTERN).sub
        self.good: set[str] = set(map(chr, range(0x21, 0x7F)))
        self.bad: set[str] = {MARK}
        self.special = special

    def learn(self, characters: set[str]) -> None:
        for c in characters - self.good - self.bad:
            simple = not unicodedata.category(c).startswith("M") and c not in "\u03a3\u0130" and not "\u1100" <= c <= "\u11ff"
            probes = (c, f"a{c}", f"{c}b", f"1{c}", f"!{c}")
            same = simple and all(self.tok.normalizer.normalize_str(s) == s.lower() for s in probes)
            same = same and all([s[p[1][0] : p[1][1]] for p in self.tok.pre_tokenizer.pre_tokenize_str(s)] == self.close("\\g<0>\n", s).split("\n")[:-1] for s in map(str.lower, probes))
            (self.good if same else self.bad).add(c)

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, how many each has)."""
        text = "\n".join(chunks) + "\n"
        self.learn(set(text) - {"\n"})
        apart = []
        if not self.bad.isdisjoint(text) or any(s in text for s in self.special):
            apart = [i for i, c in enumerate(chunks) if not self.bad.isdisjoint(c) or any(s in c for s in self.special)]
            left_out = set(apart)
            text = "\n".join("" if i in left_out else c for i, c in enumerate(chunks)) + "\n"
        ids = np.array(self.ids(self.close(f"\\g<0>{MARK}", text.lower())), dtype="<u4")
        ends = np.flatnonzero(ids == self.line_id)
        counts = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.line_id]
        if apart:
            lists = np.split(ids, np.cumsum(counts)[:-1])
            for i in apart:
                lists[i] = np.array(self.tok.encode(chunks[i], add_special_tokens=False).ids, dtype="<u4")
            ids, counts = np.concatenate(lists), np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return ids, counts


def encoded(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of every text with end_id after each, offsets)."""
    bounds, codes, words = coded_words(texts)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    ids, counts = _encoders[path].chunk_ids(strings(words)) if len(words) else (np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64))
    begins = np.cumsum(counts) - counts
    per_word = counts[codes] if len(codes) else np.empty(0, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(per_word)])
    per_text = total[bounds[1:]] - total[bounds[:-1]]
    offsets = np.concatenate([[0], np.cumsum(per_text + 1)])
    out = np.full(offsets[-1], end_id, dtype="<u4")
    mask = np.ones(len(out), dtype=bool)
    mask[offsets[1:] - 1] = False
    if len(codes):
        out[mask] = ids[np.repeat(begins[codes], per_word) + spans(per_word)]
    return out, offsets


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 and a salt for ranking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            ids, offsets = encoded(text_array(batch.column("text")), path, end_id)
            lengths = np.diff(offsets)
            n = -(-lengths // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = spans(n)
            start = piece * capacity
            length = np.minimum(capacity, lengths[row] - start)
            view, at = memoryview(ids).cast("B"), (offsets[row] + start) * 4
            crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(at, at + length * 4, strict=True)), dtype=np.int64, count=len(row))
            salt = (crc ^ (crc >> 11) ^ (row * 7919)) & 0x7FFFFFFF
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(salt, pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |Ax - target| with x >= 0 by active sets. Column j of A has ones (added up) at the rows columns[j] that are >= 0."""
    n_rows, n = len(target), len(columns)
    padded = np.where(columns >= 0, columns, n_rows)
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)

    def dense(js):
        a = np.zeros((n_rows + 1, len(js)))
        for c in range(padded.shape[1]):
            np.add.at(a, (padded[js, c], np.arange(len(js))), 1.0)
        return a[:-1]

    limit = 1e-7 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 2 * n_rows):
        js = np.flatnonzero(passive)
        rest = np.append(target - dense(js) @ x[js] if len(js) else target, 0.0)
        gain = rest[padded].sum(axis=1)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= limit:
            break
        passive[best] = True
        while True:
            js = np.flatnonzero(passive)
            a = dense(js)
            fit = np.linalg.lstsq(a, target, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[js] = fit
                break
            low = fit <= 0
            step = np.min(x[js][low] / np.maximum(x[js][low] - fit[low], 1e-300))
            x[js] += step * (fit - x[js])
            passive[js[(x[js] <= 1e-12)]] = False
            x[~passive] = 0
            if not passive[best]:
                return x
    return x


def patterns(capacity: int, grid: int) -> np.ndarray:
    """Length classes (class c holds lengths from c * grid + 1 to (c + 1) * grid) of one, two or three pieces that fill a sequence."""
    n = capacity // grid  # sizes 1..n in units of the grid
    found = [(n, 0, 0)] + [(a, n - a, 0) for a in range((n + 1) // 2, n)]
    found += [(a, b, n - a - b) for a in range(-(-n // 3), n - 1) for b in range(-(-(n - a) // 2), min(a, n - a - 1) + 1)]
    return np.array(found, dtype=np.int64) - 1  # -1: no piece


def plan(histogram: np.ndarray, capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, slot): piece `first rank + i` of a length goes to sequence `first + i`.

    histogram[l] pieces have length l. Each sequence's lengths sum to capacity at most and its slots are numbered from 0.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros_like(left)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def give(length: int, count: int, first: int, slot: int) -> None:
        out.append((length, int(taken[length]), count, first, slot))
        taken[length] += count
        left[length] -= count

    give(capacity, int(left[capacity]), 0, 0)  # a full piece is a sequence
    sequence += int(taken[capacity])
    n = capacity // grid
    classes = np.add.reduceat(left, np.arange(1, capacity + 1, grid))
    # only patterns whose classes all hold pieces can repeat
    all_patterns = patterns(capacity, grid)
    held = np.append(classes > 0, True)
    usable = all_patterns[held[all_patterns].all(axis=1)]
    if len(usable):
        repeats = np.floor(nnls(usable, classes.astype(float)) + 1e-9).astype(np.int64)
        room = classes.copy()
        for j in np.argsort(-repeats, kind="stable"):
            used = np.bincount(usable[j][usable[j] >= 0], minlength=n)
            count = int(min(repeats[j], *(room[c] // used[c] for c in np.flatnonzero(used))))
            if count <= 0:
                continue
            room -= used * count
            for slot, c in enumerate(x for x in usable[j] if x >= 0):
                # the class's pieces in order of length, as runs of equal length
                done = 0
                for length in range((c + 1) * grid, c * grid, -1):
                    take = int(min(left[length], count - done))
                    if take:
                        give(length, take, sequence + done, slot)
                        done += take
            sequence += count
    # residuals: the largest length that is left, then the largest that fits its gap, as many alike sequences at once as there are
    while left.any():
        gap, members = capacity, []
        trial = left.copy()
        while gap:
            fitting = np.flatnonzero(trial[: gap + 1])
            if not len(fitting):
                break
            length = int(fitting[-1])
            k = int(min(trial[length], gap // length))
            members.append((length, k))
            trial[length] -= k
            gap -= k * length
        count = int(min(left[length] // k for length, k in members))
        slot = 0
        for length, k in members:
            for _ in range(k):
                give(length, count, sequence, slot)
                slot += 1
        sequence += count
    return out


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Add sequence_id and offset to pieces (a materialised table as `pieces` gives)."""
    salts = max(64, cut_pieces.count() // SALTED)
    cut_pieces = cut_pieces.withColumn("salt", F.col("salt") % salts)
    counts = cut_pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    per_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_length:
        histogram[row.length] = row.n
    rows = sorted(plan(histogram, capacity, grid))
    starts = np.array([x[0] * (1 << 44) + x[1] for x in rows], dtype=np.int64)
    first, slot = np.array([x[3] - x[1] for x in rows], dtype=np.int64), np.array([x[4] for x in rows], dtype=np.int64)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_pieces.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("length").to_numpy() * (1 << 44) + batch.column("rank").to_numpy()
            j = np.searchsorted(starts, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[j] + batch.column("rank").to_numpy()), pa.array(slot[j])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "slot"],
            )

    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, slot long"
    )
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, grid: int = GRID) -> DataFrame:
    """Encode, cut and pack every row of `docs` (doc_id, text). Each row is encoded once; its pieces are checkpointed."""
    return packed(cut(pieces(docs, path, capacity, end_id)), capacity, grid)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
