"""Hand-computed cases."""

import math

import pytest

from lexquarry.operators import fusion, metrics


def rows(spark, **lists):
    out = []
    for retriever, docs in lists.items():
        out += [(1, retriever, d, float(s), i + 1) for i, (d, s) in enumerate(docs)]
    return spark.createDataFrame(out, "query_id int, retriever string, doc_id string, score double, rank int")


BOTH = ["bm25", "dense"]


def got(df):
    return [(r.doc_id, r.score) for r in df.orderBy("rank").collect()]


def test_rrf(spark):
    r = rows(spark, bm25=[("d1", 15.2), ("d2", 12.1), ("d3", 8.5)], dense=[("d3", 0.92), ("d1", 0.85), ("d4", 0.78)])
    out = got(fusion.rrf(r, BOTH))
    assert [d for d, _ in out] == ["d1", "d3", "d2", "d4"]
    assert out[0][1] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)


def test_borda(spark):
    assert got(fusion.borda(rows(spark, bm25=[("d1", 3), ("d2", 2), ("d3", 1)], dense=[("d3", 0.92), ("d1", 0.85)]), BOTH)) == [("d1", 4.0), ("d3", 3.0), ("d2", 2.0)]


def test_comb(spark):
    assert got(fusion.combsum(rows(spark, bm25=[("d1", 10), ("d2", 5)], dense=[("d2", 0.9), ("d1", 0.8)]), BOTH)) == [("d1", 1.0), ("d2", 1.0)]
    assert got(fusion.combmnz(rows(spark, bm25=[("d1", 10), ("d2", 5)], dense=[("d1", 0.9), ("d3", 0.8)]), BOTH)) == [("d1", 4.0), ("d2", 0.0), ("d3", 0.0)]


def test_weighted_and_errors(spark):
    r = rows(spark, bm25=[("d1", 10), ("d2", 5)], dense=[("d2", 0.9), ("d1", 0.8)])
    assert got(fusion.weighted(r, BOTH, alpha=0.7))[0] == ("d1", 0.7)
    with pytest.raises(ValueError, match="dense"):
        fusion.weighted(r, ["bm25"])
    with pytest.raises(ValueError):
        fusion.get_fusion_strategy("nothing")


def measure(spark, retrieved, relevant, k):
    r = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(retrieved)], "query_id int, doc_id string, rank int")
    q = spark.createDataFrame([(1, d) for d in relevant], "query_id int, doc_id string")
    return metrics.metrics_at(r, q, k).first()


def test_metrics(spark):
    assert measure(spark, ["d1", "d2", "d3", "d4"], ["d1", "d3", "d5"], 2).recall == pytest.approx(1 / 3)
    assert measure(spark, ["d1", "d2", "d3", "d4"], ["d1", "d3", "d5"], 3).precision == pytest.approx(2 / 3)
    assert measure(spark, ["d1", "d2", "d3"], ["d3", "d4"], 10).mrr == pytest.approx(1 / 3)
    assert measure(spark, ["d1", "d2", "d3", "d4"], ["d2", "d3"], 10).map == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert measure(spark, ["d1", "d2", "d3"], ["d2"], 3).ndcg == pytest.approx(1 / math.log2(3))
    m = measure(spark, ["d1", "d2"], ["d1"], 10)
    assert (m.used_k, m.precision) == (2, 0.5)
