"""Evaluation reports over rows (strategy, query_id, query_type, top_k, metrics), and the statistics of paired comparisons."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("recall", "precision", "f1", "mrr", "map", "ndcg")
TIE = 1e-6
#: From where on a query is easy, below where it is hard, and the deviation that makes strategies differ.
EASY, HARD, SPREAD = 0.8, 0.5, 0.1


def metric_label(name: str, k: int) -> str:
    """`recall` at 10 is `Recall@10`; MRR and MAP carry no k."""
    return {"recall": f"Recall@{k}", "precision": f"Precision@{k}", "f1": f"F1@{k}", "mrr": "MRR", "map": "MAP", "ndcg": f"nDCG@{k}"}[name]


def metric_column(label: str) -> str:
    return label.lower().split("@")[0]


def strategy_summary(results: DataFrame, by: str = "strategy", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean metrics of each strategy to 4 digits, the best recall first; strategies of equal recall by name."""
    means = results.groupBy(by).agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics))
    return means.withColumn("position", F.row_number().over(Window.orderBy(F.desc(metrics[0]), by)))  # a row per strategy


def competition_rank(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """`rank`: 1 for the greatest value; equal values share the least place."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return rows.withColumn("rank", F.rank().over(w.orderBy(F.desc(value))))


def best_by_metric(grid: DataFrame, metrics: tuple[str, ...] = METRICS, config: str = "config") -> DataFrame:
    """metric, config, best_score: for each metric the first configuration with the greatest mean."""
    rows = grid.unpivot([config], list(metrics), "metric", "value")
    top = Window.partitionBy("metric").orderBy(F.desc("value"), config)
    return rows.withColumn("_n", F.row_number().over(top)).where("_n = 1").select("metric", config, F.col("value").alias("best_score"))


def leave_one_out_summary(folds: DataFrame, by: str = "strategy") -> DataFrame:
    """Mean train and test objectives, the sample deviation of the test's, and their gap."""
    train, test = F.avg("train"), F.avg("test")
    return folds.groupBy(by).agg(train.alias("mean_train"), test.alias("mean_test"), F.stddev_samp("test").alias("std_test"), (train - test).alias("overfitting_gap"), F.count("*").alias("n"))


def paired(folds: DataFrame, a: str, b: str, value: str = "test") -> DataFrame:
    """query_id, a, b, difference (b less a, 4 digits) and winner of each query that both have; up to TIE it is a tie."""
    pick = lambda s: F.max(F.when(F.col("strategy") == s, F.col(value)))
    rows = folds.groupBy("query_id").agg(pick(a).alias("a"), pick(b).alias("b")).where("a is not null and b is not null")
    d = F.col("b") - F.col("a")
    return rows.select("query_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round(d, 4).alias("difference"), F.when(F.abs(d) <= TIE, "tie").when(d > 0, b).otherwise(a).alias("winner"))


def paired_summary(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: queries, wins, ties, and mean, median, population deviation, least and greatest difference."""
    d, won = F.col("difference"), lambda w: F.count_if(F.col("winner") == w)
    return pairs.agg(
        F.count("*").alias("n"), won(b).alias("wins"), won(a).alias("losses"), won("tie").alias("ties"), F.avg(d).alias("mean"), F.median(d).alias("median"),
        F.stddev_pop(d).alias("std"), F.min(d).alias("least"), F.max(d).alias("greatest"),
    )


# ---------------------------------------------------------------- statistics of differences (one row per query)


def binomial_two_sided(wins: int, losses: int) -> float | None:
    """The exact probability of a split at least as uneven, if both sides were alike."""
    n = wins + losses
    if not n:
        return None
    return min(1.0, sum(comb(n, i) for i in range(n + 1) if comb(n, i) <= comb(n, wins)) / 2**n)


def sign_test(pairs: DataFrame) -> DataFrame:
    """wins, losses, ties, p_value. The table of probabilities follows from the three counts, which are all that reaches the driver."""
    d = F.col("difference")
    row = pairs.agg(F.count_if(d > TIE).alias("w"), F.count_if(d < -TIE).alias("l"), F.count_if(F.abs(d) <= TIE).alias("t")).first()
    return pairs.sparkSession.createDataFrame([(row.w, row.l, row.t, binomial_two_sided(row.w, row.l))], "wins long, losses long, ties long, p_value double")


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """mean, ci_lower, ci_upper, resamples: percentiles of the means of resamples with replacement.

    Resample r's i-th draw is a hash of (seed, r, i), so the result does not depend on partitions: each resample is a task's own rows.
    """
    values = pairs.agg(F.array_sort(F.collect_list("difference")).alias("v"))  # as many numbers as queries of the evaluation
    draws = pairs.sparkSession.range(resamples).crossJoin(F.broadcast(values))  # one row
    n = F.size("v")
    picked = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("v", (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), n) + 1).cast("int")))
    means = draws.where(n > 0).select((F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / n).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"), F.count("*").alias("resamples"))


def signed_rank(pairs: DataFrame, least: int = 6) -> DataFrame:
    """n, w_plus, w_minus, statistic, z: signed ranks of the differences that are not 0, equal sizes share their mean rank; the statistic is the smaller
    sum, z its normal approximation with the correction for ties. Under `least` differences there is no statistic."""
    rows = pairs.where(F.abs("difference") > TIE).select("difference", F.round(F.abs("difference"), 9).alias("size"))
    ties = Window.partitionBy("size")
    ranked = rows.withColumn("first", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("size"))).withColumn("alike", F.count("*").over(ties))  # a row per query
    ranked = ranked.withColumn("r", F.col("first") + (F.col("alike") - 1) / 2)
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("r"))), F.lit(0.0))
    # each of t equal sizes adds its share of t cubed less t
    out = ranked.agg(F.count("*").alias("n"), total(F.col("difference") > 0).alias("w_plus"), total(F.col("difference") < 0).alias("w_minus"), F.coalesce(F.sum(F.col("alike") * F.col("alike") - 1), F.lit(0)).alias("_t"))
    n, enough = F.col("n"), F.col("n") >= least
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, spread)
    return out.select("n", "w_plus", "w_minus", F.when(enough, F.least("w_plus", "w_minus")).alias("statistic"), F.when(enough, z).alias("z"))


# ---------------------------------------------------------------- classifiers


def confusion(predicted: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """gold and a column of counts for each type, in the types' order by name; types without a row have zeros. predicted: gold, kind."""
    types = tuple(sorted(types))
    spark = predicted.sparkSession
    all_of = spark.createDataFrame([(t,) for t in types], "gold string")
    counts = predicted.where(F.col("gold").isin(*types)).groupBy("gold").pivot("kind", list(types)).count()
    return all_of.join(counts, "gold", "left").na.fill(0)


def classification_summary(predicted: DataFrame) -> DataFrame:
    """classifier, gold (null: all), accuracy, n; blank predictions do not count. predicted: classifier, gold, kind."""
    rows = predicted.where(F.coalesce("kind", F.lit("")) != "")
    right = F.avg((F.col("kind") == F.col("gold")).cast("double"))
    return rows.groupingSets([["classifier"], ["classifier", "gold"]], "classifier", "gold").agg(F.round(right, 4).alias("accuracy"), F.count("*").alias("n")).select("classifier", "gold", "accuracy", "n")


# ---------------------------------------------------------------- per query and per type


def family(strategy: Column) -> Column:
    """The family that a strategy's name says."""
    return F.when(strategy.contains("hybridrank"), "hybridrank").when(strategy.contains("weighted"), "weighted").when(strategy.contains("only"), "baseline").otherwise("classic")


def pivoted(results: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """Mean value by row and column, and the mean of the columns that a row has (`mean`)."""
    table = results.groupBy(row).pivot(column, values).avg(value)
    have = F.filter(F.array(*(F.col(f"`{v}`") for v in values)), lambda x: x.isNotNull())
    return table.withColumn("mean", F.try_divide(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have)))


def usage(results: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and column, 0 where there is none."""
    return results.groupBy(row).pivot(column, values).count().na.fill(0)


def overlap_summary(overlaps: DataFrame, by: str = "query_type") -> DataFrame:
    """Mean overlap by type and k, and a row GLOBAL for each k over all queries (not the mean of the types' means)."""
    rows = overlaps.groupingSets([[by, "top_k"], ["top_k"]], by, "top_k").agg(F.avg("overlap").alias("overlap"), F.count("*").alias("n"))
    return rows.select(F.coalesce(by, F.lit("GLOBAL")).alias(by), "top_k", "overlap", "n")


def best_per_query(results: DataFrame, value: str, by: tuple[str, ...] = ("query_id", "query_type")) -> DataFrame:
    """Each query's best strategy (of equals the first by name), its value, the runner-up's and the gap."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), "strategy")
    rows = results.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    pick = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    return rows.groupBy(*by).agg(pick("strategy", 1).alias("strategy"), pick(value, 1).alias("best"), pick(value, 2).alias("second")).withColumn("gap", F.col("best") - F.col("second"))


def winners(best: DataFrame, by: str) -> DataFrame:
    return best.groupBy(by).agg(F.count("*").alias("wins"))


def query_summary(results: DataFrame, value: str) -> DataFrame:
    """Mean, greatest, least and sample deviation of each query over the strategies, its difficulty and whether strategies differ."""
    rows = results.groupBy("query_id", "query_type").agg(F.avg(value).alias("mean"), F.max(value).alias("greatest"), F.min(value).alias("least"), F.stddev_samp(value).alias("std"))
    return rows.withColumn("difficulty", F.when(F.col("mean") >= EASY, "easy").when(F.col("mean") >= HARD, "medium").otherwise("hard")).withColumn("differs", F.coalesce(F.col("std") > SPREAD, F.lit(False)))


def with_best(summary: DataFrame, best: DataFrame) -> DataFrame:
    return summary.join(best.select("query_id", F.col("strategy").alias("best_strategy"), "gap"), "query_id", "left")


def deltas(results: DataFrame, value: str, reference: str, baselines: tuple[str, ...]) -> DataFrame:
    """strategy, mean, delta (to the reference strategy) and percent (over the best baseline; null where that is 0)."""
    means = results.groupBy("strategy").agg(F.avg(value).alias("mean"))
    fixed = means.agg(F.max(F.when(F.col("strategy") == reference, F.col("mean"))).alias("r"), F.max(F.when(F.col("strategy").isin(*baselines), F.col("mean"))).alias("b"))
    rows = means.crossJoin(F.broadcast(fixed))  # one row
    return rows.select("strategy", "mean", (F.col("mean") - F.col("r")).alias("delta"), F.try_divide(100 * (F.col("mean") - F.col("b")), F.col("b")).alias("percent"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """column, n, the most frequent first; equal counts by value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), F.col(column).asc_nulls_first())))  # a row per value


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct, nulls of each."""
    one = rows.agg(*(F.struct(F.count_distinct(c).alias("distinct"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in columns))
    return reduce(DataFrame.unionByName, (one.select(F.lit(c).alias("column"), f"{c}.distinct", f"{c}.nulls") for c in columns))


def audit(corpus: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row: ids of both sides, those that only one has, and whether they agree."""
    a, b = corpus.select(key).distinct().withColumn("_a", F.lit(1)), index.select(key).distinct().withColumn("_b", F.lit(1))
    rows = a.join(b, key, "full_outer").agg(F.count("_a").alias("in_corpus"), F.count("_b").alias("in_index"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unknown"))
    return rows.withColumn("agrees", (F.col("missing") == 0) & (F.col("unknown") == 0))


def processing_totals(gazettes: DataFrame, norms: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row of counts over the structured tables."""
    count = lambda d, name: d.agg(F.count("*").alias(name))
    return count(gazettes, "gazettes").crossJoin(count(norms, "norms")).crossJoin(count(unmatched, "unmatched"))  # one row each


def top(rows: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(value), tie).limit(n)


def written(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def reread(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
