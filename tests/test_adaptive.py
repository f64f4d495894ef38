"""Classifiers, the policy and adaptive retrieval, on the cases that the specification lists."""

from pyspark.sql import functions as F

from lexquarry import engine
from lexquarry.operators import adaptive

Q = "query_id long, text string"


def test_rules(spark):
    q = [(1, "Decreto-Ley 114 de 2025 sobre asociaciones"), (2, "en qué año se estableció el reglamento de comercio exterior"), (3, "qué norma crea el régimen especial y qué resolución establece el procedimiento"), (4, "licencia"), (5, "protección del medio ambiente en Cuba"), (6, None)]
    got = {r.query_id: (r.kind, r.confidence, r.classifier) for r in adaptive.classify_by_rules(spark.createDataFrame(q, Q)).collect()}
    assert [got[i][:2] for i in range(1, 7)] == [("referencia_exacta", 0.9), ("temporal_historica", 0.9), ("multi_hop", 0.9), ("ambigua", 0.7), ("semantica", 0.55), ("ambigua", 0.7)]
    assert {x[2] for x in got.values()} == {"rule_based"}
    oracle = adaptive.classify_by_oracle(spark.createDataFrame(q, Q), spark.createDataFrame([(4, "multi_hop")], "query_id long, kind string")).collect()
    assert [tuple(r) for r in oracle] == [(4, "multi_hop", 1.0, "ground_truth", "oracle")]


def test_model_and_hybrid(spark):
    def model(asked):
        text = asked[-1]["content"]
        if "limite" in text:
            raise RuntimeError("HTTP 429")
        if "roto" in text:
            raise RuntimeError("boom")
        return {
            "uno": '{"query_type": "multi_hop", "confidence": 0.8, "reason": "r"}', "dos": 'Claro: {"query_type": "semantica", "confidence": 7} listo', "tres": "no es json",
            "cuatro": '{"query_type": "otra", "confidence": 0.9}', "cinco": '{"query_type": "ambigua"}', "seis": '{"query_type": "multi_hop", "confidence": 0.2}',
        }[text.split('"')[1].split()[0]]

    words = ["uno", "dos", "tres", "cuatro", "cinco", "seis", "limite", "roto"]
    q = spark.createDataFrame([(i, f"{w} sobre la protección del medio ambiente") for i, w in enumerate(words)] + [(99, "Ley 5 de 2020")], Q)
    some = q.where("query_id < 99")
    got = {r.query_id: (r.kind, round(r.confidence, 2), r.classifier) for r in adaptive.classify_by_model(some, model, delay=0.0).collect()}
    fallback = ("semantica", 0.55)
    assert got == {
        0: ("multi_hop", 0.8, "llm"), 1: ("semantica", 1.0, "llm"), 2: (*fallback, "llm_parse_fallback"), 3: (*fallback, "llm_invalid_type_fallback"), 4: ("ambigua", 0.7, "llm"),
        5: ("multi_hop", 0.2, "llm"), 6: (*fallback, "llm_exhausted_fallback"), 7: (*fallback, "llm_fallback"),
    }
    hybrid = {r.query_id: (r.kind, r.classifier) for r in adaptive.classify_hybrid(q, adaptive.classify_by_model(some, model, delay=0.0)).collect()}
    assert hybrid[99] == ("referencia_exacta", "hybrid_rules") and hybrid[0] == ("multi_hop", "hybrid_llm") and hybrid[5] == hybrid[6] == ("semantica", "hybrid_rules_llm_low_conf")
    assert {r.classifier for r in adaptive.classify_hybrid(q).collect()} == {"hybrid_rules", "hybrid_rules_no_llm"}


def test_backoff():
    waits, calls = [], []

    def limited(_):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("rate limit")
        return "{}"

    assert adaptive.ask(limited, "x", sleep=waits.append) == ("{}", "llm") and waits == [1.0, 2.0]


def test_signals(spark):
    rows = [(1, "bm25", d, 15.0 - i, i + 1) for i, d in enumerate([1, 2, 3, 4])] + [(1, "dense", d, 0.95 - i / 10, i + 1) for i, d in enumerate([1, 3, 5, 6])] + [(2, "bm25", 9, 3.0, 1)]
    r = spark.createDataFrame(rows, "query_id int, retriever string, doc_id int, score double, rank int")
    got = {x.query_id: x for x in adaptive.retrieval_signals(r, 4).collect()}
    assert got[1].overlap == 0.5 and round(got[1].gap, 9) == 14.05 and got[2].top1_dense is None and got[2].gap is None and got[2].overlap == 0.0


def test_policy(spark):
    value = [(c, q, 0.9 if (c, q % 2) in ((7, 0), (9, 1)) else 0.1 + c / 10_000) for c in (7, 9, adaptive.FALLBACK) for q in range(7)]
    objectives = spark.createDataFrame(value, "config int, query_id long, objective double")
    kinds = spark.createDataFrame([(q, "semantica" if q % 2 == 0 else "ambigua" if q < 5 else "multi_hop") for q in range(7)], "query_id long, kind string")
    policy = adaptive.fit_policy(objectives, kinds)
    got = {r.kind: (r.config, r.n, r.fallback) for r in policy.collect()}
    assert got == {"semantica": (7, 4, False), "ambigua": (None, 2, True), "multi_hop": (None, 1, True)}
    classified = spark.createDataFrame([(1, "semantica", 0.9), (2, "semantica", 0.49), (3, "ambigua", 0.9), (4, "otra", 0.9)], "query_id long, kind string, confidence double")
    chosen = {r.query_id: (r.config, r.fallback_used) for r in adaptive.select_config(classified, policy).collect()}
    f = adaptive.FALLBACK
    assert chosen == {1: (7, False), 2: (f, True), 3: (f, True), 4: (f, True)}
    assert {r.config for r in adaptive.select_config(classified, None).collect()} == {f}
    folds = {r.query_id: (r.config, r.fallback_used) for r in adaptive.adaptive_leave_one_out(objectives, kinds).collect()}
    assert folds == {q: (7, False) if q % 2 == 0 else (f, True) for q in range(7)}
    assert {r.kind for r in adaptive.assigned(spark.range(2).withColumnRenamed("id", "query_id"), kinds.where("query_id = 1")).collect()} == {"ambigua", "semantica"}


def test_engine(spark):
    import pytest

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ley de aguas", "decreto de minas", "ley de minas y aguas", *["otra cosa"] * 4])], "doc_id long, text string")
    from lexquarry.operators import rag, retrieval
    from lexquarry.plans import store

    folder = store.shared_folder(spark) + "/engine-test"
    retrieval.build_index(docs, folder)
    bm25 = engine.BM25Retriever(retrieval.load_index(spark, folder))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "doc_id long, embedding array<double>")
    encode = lambda q: q.select("query_id", F.when(F.col("text").contains("minas"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))
    dense = engine.DenseRetriever(vectors, encode)
    q = spark.createDataFrame([(1, "minas"), (2, "aguas"), (3, "")], Q)
    assert {(r.query_id, r.doc_id) for r in dense.retrieve(q, 1).collect()} == {(1, 1), (2, 0), (3, 0)} and dense.retrieve(q, 0).count() == 0
    hybrid = engine.HybridRetriever({"bm25": bm25, "dense": dense}, "rrf", 3)
    assert {r.doc_id for r in hybrid.retrieve(q.where("query_id = 1"), 2).collect()} == {1, 2}
    for bad in (lambda: engine.HybridRetriever({}), lambda: engine.HybridRetriever({"bm25": bm25}, candidate_k=0), lambda: engine.HybridRetriever({"bm25": bm25}, "none")):
        with pytest.raises(ValueError):
            bad()
    results, info = engine.AdaptiveRetriever({"bm25": bm25, "dense": dense}, adaptive.classify_by_rules).retrieve_with_metadata(q, 0)
    assert results.count() > 0 and {r.fallback_used for r in info.collect()} == {True}
    fragments = docs.select("doc_id", F.col("text").alias("content"), F.lit("Ley").alias("tipo"))
    pipeline = engine.RAGPipeline(bm25, engine.FragmentStore(fragments.withColumn("fragment_id", F.col("doc_id")).drop("doc_id")), rag.echo)
    answered, found = pipeline.run(q)
    got = {r.query_id: r.formatted for r in answered.collect()}
    assert got[3] == rag.NO_SOURCES and got[1].startswith("minas [Fuente 1]") and got[2].startswith("aguas") and "Fuentes Consultadas" in got[1] and pipeline.log(answered, found).count() == 3
