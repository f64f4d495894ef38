"""The whole search space, its fusion, the policy by type and leave-one-out against brute force."""

import random
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import adaptive
from lexquarry.plans import registry


@pytest.fixture(scope="module")
def space(spark):
    return [r.asDict() for r in adaptive.search_space(spark).orderBy("config").collect()]


def test_search_space(space):
    assert [c["config"] for c in space] == list(range(354))
    assert [sum(c["strategy"] == s for c in space) for s in ("hybridrank", "weighted")] == [300, 54]
    assert {c["candidate_k"] for c in space if c["strategy"] == "weighted"} == {20, 50, 100} and {c["candidate_k"] for c in space[:300]} == {50}
    f = space[adaptive.FALLBACK]
    assert (f["strategy"], f["alpha"], f["beta"], f["k"], f["normalizer"]) == ("hybridrank", 0.7, 0.2, 10.0, "minmax")
    assert {"grid_search", "best_by_type", "loo_cv", "policy_fit"} <= set(registry.queries()) & set(registry.oracle_sql())


def normalized(values, how):
    lo, hi = min(values.values()), max(values.values())
    if how == "minmax":
        return {d: 1.0 if hi == lo else (v - lo) / (hi - lo) for d, v in values.items()}
    return {d: 0.0 if hi == lo else (v - fmean(values.values())) / pstdev(values.values()) for d, v in values.items()}


def brute(lists, c):
    lists = {r: docs[: c["candidate_k"]] for r, docs in lists.items()}
    s, d = (normalized(dict(lists[r]), c["normalizer"]) for r in ("bm25", "dense"))
    score = {x: c["alpha"] * s.get(x, 0.0) + (1 - c["alpha"]) * d.get(x, 0.0) for x in {*s, *d}}
    if c["strategy"] == "hybridrank":
        rr = dict.fromkeys(score, 0.0)
        for docs in lists.values():
            for i, (x, _) in enumerate(docs):
                rr[x] += 1 / (c["k"] + i + 1)
        u = normalized(rr, "minmax")
        score = {x: c["beta"] * u[x] + (1 - c["beta"]) * v for x, v in score.items()}
    return sorted(((x, round(v, 9)) for x, v in score.items()), key=lambda p: (-p[1], p[0]))[:10]


def test_fuse_whole_space(spark, space):
    r = random.Random(5)
    lists = {q: {n: [(x, s) for x, s in zip(r.sample(range(300), 110), sorted((r.expovariate(0.2) for _ in range(110)), reverse=True))] for n in ("bm25", "dense")} for q in range(2)}
    rows = [(q, n, x, s, i + 1) for q, two in lists.items() for n, docs in two.items() for i, (x, s) in enumerate(docs)]
    ranked = spark.createDataFrame(rows, "query_id int, retriever string, doc_id int, score double, rank int")
    got = {}
    for x in adaptive.fuse_configs(ranked, adaptive.search_space(spark)).orderBy("config", "query_id", "rank").collect():
        got.setdefault((x.config, x.query_id), []).append((x.doc_id, x.score))
    assert set(got) == {(c["config"], q) for c in space for q in lists}
    for (config, q), found in got.items():
        want = brute(lists[q], space[config])
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=3e-9), space[config]
        assert [d for d, _ in found] == [d for d, _ in want], space[config]


def test_policy_and_leave_one_out(spark):
    r = random.Random(6)
    value = {(c, q): round(r.random(), 9) for c in range(354) for q in range(9)}
    value |= {(353, q): 0.999 for q in range(0, 9, 2)}  # a weighted optimum
    kind = lambda q: "few" if q in (1, 3) else "odd" if q % 2 else "even"
    rows = spark.createDataFrame([(c, q, kind(q), v) for (c, q), v in value.items()], "config int, query_id int, kind string, objective double")
    want = {}
    for k in ("few", "odd", "even"):
        of = [q for q in range(9) if kind(q) == k]
        mean = {c: round(fmean(value[c, q] for q in of), 9) for c in range(354)}
        few = len(of) < 3
        c = adaptive.FALLBACK if few else min(mean, key=lambda c: (-mean[c], c))
        want[k] = (c, pytest.approx(mean[c], abs=2e-9), len(of), few)
    got = {x.kind: (x.config, x.objective, x.n, x.fallback) for x in adaptive.policy(rows, ["kind"]).collect()}
    assert got == want and got["few"][3] and got["even"][0] == 353
    for x in adaptive.leave_one_out(rows.drop("kind")).collect():
        others = {c: sum(round(value[c, q] * 1e9) for q in range(9) if q != x.query_id) for c in range(354)}
        assert x.config == min(others, key=lambda c: (-others[c], c)) and x.test == pytest.approx(value[x.config, x.query_id])


def test_judged_without_pairs(spark):
    """Numbers of relevant documents from the sizes of labels give what all pairs give, and only ranked documents are judged."""
    from lexquarry.operators import metrics
    from lexquarry.plans import registry

    d = "/root/testdata/sf0.001"
    v = registry.table(spark, d, "embeddings").select("vec_id", "label")
    pairs = v.join(v.where("vec_id % 50 = 0").selectExpr("vec_id div 50 as query_id", "label"), "label").select("query_id", F.col("vec_id").alias("doc_id"))
    r = registry.near(spark, d)
    q, n = registry.relevant(spark, d, r), registry.totals(spark, d)
    assert 0 < q.count() < pairs.count() and q.count() <= r.count()
    want, got = (sorted(map(tuple, x.collect())) for x in (metrics.metrics_at(r, pairs, 10), metrics.metrics_at(r, q, 10, totals=n)))
    assert want == got and want
