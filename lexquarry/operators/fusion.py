"""Score normalizers and fusion strategies over rankings (query_id, retriever, doc_id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def lists():
    return Window.partitionBy("query_id", "retriever")



def minmax(s: Column, w) -> Column:
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    return F.when(hi == lo, 1.0).otherwise((s - lo) / F.nullif(hi - lo, F.lit(0.0)))


def zscore(s: Column, w) -> Column:
    sd = F.stddev_pop(s).over(w)
    return F.when((sd == 0) | (F.min(s).over(w) == F.max(s).over(w)), 0.0).otherwise((s - F.avg(s).over(w)) / F.nullif(sd, F.lit(0.0)))


def sum_share(s: Column, w) -> Column:
    return F.coalesce(F.try_divide(s, F.sum(s).over(w)), F.lit(0.0))


NORMALIZERS = {"minmax": minmax, "zscore": zscore, "sum": sum_share, "identity": lambda s, w: s}


def get_normalizer(name: str):
    if name not in NORMALIZERS:
        raise ValueError(f"unknown normalizer {name!r}; one of {sorted(NORMALIZERS)}")
    return NORMALIZERS[name]


def best(fused: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Top k of each query by score, then doc_id; k <= 0 gives nothing."""
    fused = fused.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def wide(rankings: DataFrame, value: Column, retrievers: list[str]) -> DataFrame:
    """A row per (query, document), a column per retriever in a fixed order; null where a list has not the document."""
    return rankings.withColumn("value", value).groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("retriever") == r, F.col("value"))).alias(r) for r in retrievers))


def added(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def rrf(rankings: DataFrame, retrievers: list[str], top: int = 10, k: float = 60) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    w = wide(rankings, 1.0 / (F.col("rank") + k), retrievers)
    return best(w.withColumn("score", added([zero(r) for r in retrievers])), top)


def borda(rankings: DataFrame, retrievers: list[str], top: int = 10) -> DataFrame:
    w = wide(rankings, (F.count("*").over(lists()) - F.col("rank") + 1).cast("double"), retrievers)
    return best(w.withColumn("score", added([zero(r) for r in retrievers])), top)


def combsum(rankings: DataFrame, retrievers: list[str], top: int = 10, normalizer: str = "minmax") -> DataFrame:
    w = wide(rankings, get_normalizer(normalizer)(F.col("score"), lists()), retrievers)
    return best(w.withColumn("score", added([zero(r) for r in retrievers])), top)


def combmnz(rankings: DataFrame, retrievers: list[str], top: int = 10, normalizer: str = "minmax") -> DataFrame:
    """Only positive normalized scores count and add."""
    w = wide(rankings, get_normalizer(normalizer)(F.col("score"), lists()), retrievers)
    positive = [F.greatest(zero(r), F.lit(0.0)) for r in retrievers]
    return best(w.withColumn("score", added([(p > 0).cast("int") for p in positive]) * added(positive)), top)


def need(retrievers: list[str], *names: str) -> None:
    for n in names:
        if n not in retrievers:
            raise ValueError(f"no ranking of {n!r}")


def weighted(rankings: DataFrame, retrievers: list[str], top: int = 10, alpha: float = 0.5, normalizer: str = "minmax", sparse: str = "bm25", dense: str = "dense") -> DataFrame:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    need(retrievers, sparse, dense)
    w = wide(rankings, get_normalizer(normalizer)(F.col("score"), lists()), retrievers)
    return best(w.withColumn("score", alpha * zero(sparse) + (1 - alpha) * zero(dense)), top)


def hybridrank(rankings: DataFrame, retrievers: list[str], top: int = 10, alpha: float = 0.7, beta: float = 0.2, k: float = 10, normalizer: str = "minmax", rrf_normalizer: str = "minmax", sparse: str = "bm25", dense: str = "dense") -> DataFrame:
    """beta * normalized RRF over the union + (1 - beta) * weighted normalized scores."""
    need(retrievers, sparse, dense)
    norm, rank = get_normalizer(normalizer)(F.col("score"), lists()), 1.0 / (F.col("rank") + k)
    rows = rankings.withColumn("norm", norm).withColumn("rr", rank)
    columns = [F.max(F.when(F.col("retriever") == r, F.col("rr"))).alias(f"rr_{r}") for r in retrievers]
    columns += [F.max(F.when(F.col("retriever") == r, F.col("norm"))).alias(f"s_{r}") for r in (sparse, dense)]
    w = rows.groupBy("query_id", "doc_id").agg(*columns).withColumn("rrf", added([zero(f"rr_{r}") for r in retrievers]))
    union = get_normalizer(rrf_normalizer)(F.col("rrf"), Window.partitionBy("query_id"))
    return best(w.withColumn("u", union).withColumn("score", beta * F.col("u") + (1 - beta) * (alpha * zero(f"s_{sparse}") + (1 - alpha) * zero(f"s_{dense}"))), top)


STRATEGIES = {"rrf": rrf, "borda": borda, "combsum": combsum, "combmnz": combmnz, "weighted": weighted, "hybridrank": hybridrank}


def get_fusion_strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown fusion strategy {name!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def pool(rankings: DataFrame, sparse: str = "bm25", dense: str = "dense") -> DataFrame:
    """The union of two rankings with both scores and their sources; documents of both come first, then by the higher raw score, then in the
    order in which they are met: the sparse list's, then the dense list's."""
    met = F.min(F.struct((F.col("retriever") != sparse).alias("late"), "rank")).alias("met")
    w = wide(rankings, F.col("score"), [sparse, dense]).join(rankings.groupBy("query_id", "doc_id").agg(met), ["query_id", "doc_id"])
    both = F.col(sparse).isNotNull() & F.col(dense).isNotNull()
    order = Window.partitionBy("query_id").orderBy(both.desc(), F.greatest(sparse, dense).desc(), "met")
    sources = F.array_compact(F.array(F.when(F.col(sparse).isNotNull(), "BM25"), F.when(F.col(dense).isNotNull(), "Dense")))
    return w.withColumn("both", both).withColumn("sources", sources).withColumn("position", F.row_number().over(order)).drop("met")


def overlap(rankings: DataFrame, k: int, sparse: str = "bm25", dense: str = "dense") -> DataFrame:
    """Shared and own documents of the two top-k lists of each query, and shared / k."""
    w = wide(rankings.where(F.col("rank") <= k), F.col("score"), [sparse, dense])
    shared = F.count_if(F.col(sparse).isNotNull() & F.col(dense).isNotNull())
    return w.groupBy("query_id").agg(
        shared.alias("shared"), F.count_if(F.col(dense).isNull()).alias("sparse_only"), F.count_if(F.col(sparse).isNull()).alias("dense_only"), (shared / F.lit(float(k))).alias("overlap")
    )
