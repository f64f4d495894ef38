"""Operator 1: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are itself and its character 3- to 5-grams with marks at both ends, hashed into `BUCKETS` vectors; so a
misspelling that was never seen still has most of a known word's n-grams. A passage is the average of its words' vectors
and each word's vector the average of its features'. The softmax over two classes is linear in it. A document's score is
that of its most toxic passage of `SPAN` words (passages overlap), since a few words in a long text would vanish in
its average; training follows the same rule: the passage that scores highest stands for its document, in both classes.

Labels come only from rows whose crc32 of the doc_id as text leaves another remainder than 1 modulo 3, at most `LABELLED`
of them (those with the least hash of their id; half of the room is for each class), of texts up to `LONGEST` characters. Only the text
enters a score.

A null text is empty; empty texts score the model's bias, which training holds low by an empty text of class 0. A null doc_id
is held_out false and never trains. Repeated rows are scored each. Texts are scored whole. With no labelled row of some
class the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.common import U64, by_bytes, coded_words, mixed, spans, text_array

BUCKETS = 1 << 16
DIM = 8
SPAN = 2  # words of a passage: of 2, 3 and 4 the one with the best recall when a part of the training rows was held back
LABELLED = 8_000
LONGEST = 50_000  # characters: labelled rows with longer texts do not train, which bounds the sample's bytes
EPOCHS = 60  # at every size
BATCH = 64
CUT = 0.7
TRIM = ".,;:!?\"'()[]{}<>*&%$#|~`+=_/\\-"


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature buckets of every distinct word one after another, how many each word has)."""
    words = pc.utf8_trim(pc.utf8_lower(words.cast(pa.large_string())), characters=TRIM)
    marked = pc.binary_join_element_wise(*(pa.scalar(c, pa.large_string()) if isinstance(c, str) else c for c in ("<", words, ">", "")))
    points = np.frombuffer("".join(marked.to_numpy(zero_copy_only=False)).encode("utf-32-le"), dtype=np.uint32).astype(U64)
    n = pc.utf8_length(marked).to_numpy().astype(np.int64)
    begin = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    left = n[word] - spans(n)  # characters from here to the word's end
    out, of = [], []
    with np.errstate(over="ignore"):
        # the word itself
        power = mixed(spans(n).astype(U64) + U64(77))
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(points * power, dtype=U64)])
        out.append(mixed(sums[begin + n] - sums[begin]))
        of.append(np.arange(len(n)))
        rolled = mixed(points + U64(11))
        for size in range(2, 6):
            rolled = rolled[:-1] * U64(0x9E3779B97F4A7C15) + points[size - 1 :] if len(rolled) > 1 else rolled[:0]
            if size >= 3:
                ok = np.flatnonzero(left[: len(rolled)] >= size)
                out.append(mixed(rolled[ok] + U64(size)))
                of.append(word[ok])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (np.concatenate(out)[order] % U64(BUCKETS)).astype(np.int64), np.bincount(of, minlength=len(n))


def passages(n_words: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, first word in it, words) of each passage; a text of up to `span` words is one, an empty one none."""
    step = max(1, span // 2)
    count = np.where(n_words > 0, 1 + -(-np.maximum(n_words - span, 0) // step), 0)
    row = np.repeat(np.arange(len(n_words)), count)
    start = np.minimum(spans(count) * step, np.maximum(n_words[row] - span, 0))
    return row, start, np.minimum(span, n_words[row])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """`margin` holds each feature's part of the score, as the softmax over the embeddings is linear; `bias` the rest."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias

    def word_margins(self, words: pa.Array) -> np.ndarray:
        f, n = features(words)
        return np.add.reduceat(self.margin[f].astype(np.float64), np.cumsum(n) - n) / n if len(n) else np.empty(0)

    def score(self, texts: pa.Array) -> np.ndarray:
        bounds, codes, words = coded_words(texts)
        # whole micro-units: the same sum for a text wherever it stands in a batch
        each = np.round(1e6 * self.word_margins(words)).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each[codes])])
        row, start, size = passages(np.diff(bounds))
        at = bounds[row] + start
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row, (total[at + size] - total[at]) / size / 1e6)
        return sigmoid(np.where(np.isfinite(best), best, 0.0) + self.bias)


def train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Joint training of embeddings and softmax by Adagrad on the passages that stand for their documents."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    bounds, codes, words = coded_words(pa.array(texts, pa.large_string()))
    f, n = features(words)
    begin = np.cumsum(n) - n
    row, start, size = passages(np.diff(bounds))
    at = bounds[row] + start
    class_weight = len(labels) / 2 / np.maximum(1, np.bincount(labels, minlength=2))
    g_emb, g_weight, g_bias = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(epochs):
        margin = emb @ (weight[:, 1] - weight[:, 0])
        each = np.add.reduceat(margin[f], begin) / n
        total = np.concatenate([[0], np.cumsum(each[codes])])
        value = (total[at + size] - total[at]) / size
        order = np.lexsort((value + rng.normal(0, 1e-9, len(value)), row))
        last = np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True))
        chosen = order[last]
        other = rng.integers(0, len(row), len(chosen))
        other = other[labels[row[other]] == 0]  # any passage of a clean text is clean
        # in the first rounds every passage of a toxic text counts, as the highest says nothing yet
        picked = np.concatenate([chosen, other]) if epoch >= 3 else np.concatenate([np.flatnonzero(labels[row] == 1), chosen, other])
        rng.shuffle(picked)
        for i in range(0, len(picked), BATCH):
            p = picked[i : i + BATCH]
            w_index = codes[np.repeat(at[p], size[p]) + spans(size[p])]
            owner = np.repeat(np.arange(len(p)), size[p])
            f_n = n[w_index]
            f_index = f[np.repeat(begin[w_index], f_n) + spans(f_n)]
            share = np.repeat(1 / (f_n * size[p][owner]), f_n)
            owner_f = np.repeat(owner, f_n)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(owner_f)) + 1])
            hidden = np.add.reduceat(emb[f_index] * share[:, None], edges, axis=0)
            z = hidden @ weight + bias
            prob = np.exp(z - z.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            y = labels[row[p]]
            prob[np.arange(len(p)), y] -= 1
            delta = prob * class_weight[y][:, None] / len(p)
            g = delta @ weight.T
            used, back = np.unique(f_index, return_inverse=True)
            grad = np.zeros((len(used), DIM))
            for d in range(DIM):
                grad[:, d] = np.bincount(back, g[owner_f, d] * share, minlength=len(used))
            gw, gb = hidden.T @ delta, delta.sum(axis=0)
            g_emb[used] += (grad**2).mean(axis=1)
            g_weight += gw**2
            g_bias += gb**2
            emb[used] -= 0.3 * grad / np.sqrt(g_emb[used])[:, None]
            weight -= 0.1 * gw / np.sqrt(g_weight)
            bias -= 0.05 * gb / np.sqrt(g_bias)
        bias -= 0.02 * np.array([-1, 1]) * sigmoid(bias[1] - bias[0])  # the empty text of class 0
    return Model((emb @ (weight[:, 1] - weight[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """Training rows (doc_id, text, toxic) of at most `most` labelled documents, at most half of them of a class."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for c in (0, 1)]
    ids = F.broadcast(ids[0].union(ids[1]))  # bounded by `most`
    return docs.where(~held_out()).where(F.length(F.coalesce("text", F.lit(""))) <= LONGEST).join(ids, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model | None:
    """The model, trained in one task of the cluster on the bounded sample; the driver gets one vector of BUCKETS numbers."""

    def learn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)), key=lambda r: r[:2])
        y = np.array([r[2] for r in rows], dtype=np.int64)
        if len(set(y.tolist())) == 2:
            model = train([r[1] for r in rows], y)
            yield pa.RecordBatch.from_arrays([pa.array([model.margin.tobytes()], pa.binary()), pa.array([model.bias])], ["margin", "bias"])

    sample = labelled(docs, labels, most).withColumn("one", F.lit(1))
    found = sample.groupBy("one").applyInArrow(learn, "margin binary, bias double").collect()
    return Model(np.frombuffer(bytes(found[0].margin), dtype=np.float32), found[0].bias) if found else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = text_array(batch.column("text"))
            value = model.score(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
