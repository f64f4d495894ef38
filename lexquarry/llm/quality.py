"""Operator 2: quality rules by a hashed n-gram log-likelihood ratio, after deterministic base rules.

Target: unigrams and bigrams of a trusted sample (documents labelled quality 1; at most `trusted` of them, those with the
least hash of their id). Raw: the same of every document. Both are multinomials over `BUCKETS` hashed n-grams; raw counts
cover the whole corpus and are summed in the cluster, so only tables of fixed size reach the driver. A document's score is
the mean over its n-grams of log(p_target / p_raw), held in whole micro-units so that it is the same on every machine and
in every order; it is kept if the score is at least `threshold` and no base rule fails.

Tokens: runs of letters and digits and runs of other characters inside a word, so that marks hung on words count.
Null texts have no words (base_failed, not kept). A null doc_id is never trusted. Repeated rows are scored each. Without
any labelled row the ratio is 0 everywhere and only the base rules decide. Texts are scored whole; memory follows blocks of
about 4 MB of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import U64, by_bytes, coded_words, hashed_counts, mixed, strings, text_array, window_hashes, window_rows

BUCKETS = 1 << 16
TRUSTED = 50_000
THRESHOLD = -0.25
PRIOR = 20.0
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+"
RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
)


def ngrams(bounds: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every unigram and bigram, text row of each). A word's inner n-grams are found once per distinct word."""
    import regex
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    pieces = list(map(regex.compile(TOKEN).findall, strings(words)))
    n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    flat = [p for ps in pieces for p in ps]
    coded = pa.array(flat, pa.large_string()).dictionary_encode()
    each = np.fromiter(map(digest, strings(coded.dictionary)), dtype=U64, count=len(coded.dictionary))
    hashes = each[coded.indices.to_numpy()] if len(flat) else np.empty(0, dtype=U64)
    begins = np.cumsum(n) - n
    per_word = n[codes]
    total = np.concatenate([[0], np.cumsum(per_word)])
    index = np.arange(total[-1]) - np.repeat(total[:-1], per_word) + np.repeat(begins[codes], per_word)
    tokens = hashes[index]
    token_bounds = total[bounds]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(token_bounds))
    pairs = window_hashes(tokens, 2)
    inside = rows[1:] == rows[:-1] if len(rows) else np.empty(0, dtype=bool)
    single = (mixed(tokens) % U64(BUCKETS)).astype(np.int64)
    double = (pairs[inside] % U64(BUCKETS)).astype(np.int64) if len(pairs) else np.empty(0, dtype=np.int64)
    return np.concatenate([single, double]), np.concatenate([rows, rows[1:][inside] if len(rows) else rows])


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """Sorted doc_ids of the trusted sample: at most `most` rows, the same at every run."""
    rows = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.sort(np.array([r.doc_id for r in rows], dtype=np.int64))


def ratios(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each bucket in whole micro-units."""

    def buckets(batch: pa.RecordBatch) -> np.ndarray:
        bounds, codes, words = coded_words(text_array(batch.column("text")))
        bucket, row = ngrams(bounds, codes, words)
        ids = pc.fill_null(batch.column("doc_id"), -1).to_numpy()
        at = np.minimum(np.searchsorted(trusted, ids), max(len(trusted) - 1, 0))
        good = (trusted[at] == ids) if len(trusted) else np.zeros(len(ids), dtype=bool)
        return np.concatenate([bucket, bucket[good[row]] + BUCKETS])

    raw, target = hashed_counts(docs.select("doc_id", "text"), buckets, BUCKETS, planes=2)
    if not target.any():
        return np.zeros(BUCKETS, dtype=np.int64)
    # A prior of PRIOR raw n-grams in each bucket: a bucket that the corpus has hardly seen says nothing, so a clean text of
    # rare words is not held against the sample for words that only it has.
    share = target.sum() / raw.sum()
    return np.round(1e6 * np.log((target + PRIOR * share) / ((raw + PRIOR) * share))).astype(np.int64)


def repeat_words(bounds: np.ndarray, codes: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each text, the words inside k-word windows found twice or more in it."""
    n_rows = len(bounds) - 1
    at, rows = window_rows(bounds, k)
    if not len(at):
        return np.zeros(n_rows, dtype=np.int64)
    keys = window_hashes(mixed(codes.astype(U64) + U64(1)), k)[at]
    with np.errstate(over="ignore"):
        keys = mixed(keys + rows.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(covered, at[again], 1)
    np.add.at(covered, at[again] + k, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def dup_lines(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
            out[i] = len(lines) - len(set(lines))
    return out


_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS.encode())] = True


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def verdicts(text: pa.Array, ratio: np.ndarray, limit: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of each text."""
    texts = text_array(text)
    bounds, codes, words = coded_words(texts)
    n_words = np.diff(bounds)
    chars = pc.utf8_length(words).to_numpy().astype(np.int64)
    word_chars = per_text(chars[codes], bounds)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    n_symbols = per_text(_symbol[data], offsets - offsets[0])
    repeats = repeat_words(bounds, codes)
    bucket, row = ngrams(bounds, codes, words)
    n_grams = np.bincount(row, minlength=len(n_words))
    value = ratio[bucket]
    # in two parts, so that float sums of whole numbers stay exact
    total = np.bincount(row, value >> 20, minlength=len(n_words)).astype(np.int64) * (1 << 20) + np.bincount(row, value & 0xFFFFF, minlength=len(n_words)).astype(np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
    kept = ~failed & (total >= limit * n_grams)
    score = np.where(n_grams > 0, total / np.maximum(n_grams, 1) / 1e6, 0.0)
    return [n_words, word_chars, n_symbols, dup_lines(strings(texts)), repeats, failed, kept, score]


def quality_rules(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns and the score for every row of `docs` (doc_id, text)."""
    ratio, limit = ratios(docs, trusted_ids(labels, trusted)), round(1e6 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, verdicts(batch.column("text"), ratio, limit))], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def kept_documents(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, whatever their names. Only texts go to Python, and verdicts back."""
    ratio, limit = ratios(docs, trusted_ids(labels, trusted)), round(1e6 * threshold)

    def kept(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = by_bytes([pa.RecordBatch.from_arrays([column], ["text"])])
            yield pa.array(np.concatenate([verdicts(b.column("text"), ratio, limit)[6] for b in parts] or [np.empty(0, dtype=bool)]))

    return docs.where(F.arrow_udf(kept, "boolean")("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
