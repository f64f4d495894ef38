"""Query signals, rule-based query types, the fusion search space, policy fitting and leave-one-out choice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.operators import fusion

#: Query types in the order of their rules, and the patterns of the signals.
TYPES = ("referencia_exacta", "temporal_historica", "multi_hop", "ambigua", "compleja_hibrida", "semantica")
PATTERNS = {
    "has_norm": r"(?i)\b(decreto[\s\-]*ley|decreto|ley|resolución|resolucion|acuerdo|instrucción|instruccion|dictamen)\b",
    "has_reference": r"(?i)(decreto[\s\-]*ley|decreto|ley|resolución|resolucion|acuerdo|instrucción|instruccion|dictamen|GOC)[\s\-]*(?:No\.?\s*)?\d+",
    "has_number": r"(?:No\.?\s*|\b)\d{1,5}\b",
    "has_year": r"\b(19|20)\d{2}\b",
    "has_temporal": r"(?i)(en qué año|cuándo|cuando|fecha|vigente|vigencia|aprobó|aprobo|surgió|surgio|se estableció|se establecio|origen)",
    "has_multi_hop": r"(?i)(qué norma.*y qué|que norma.*y que|qué norma.*establece|que norma.*establece|qué resolución.*deroga|que resolucion.*deroga|modifica|deroga|complementa|relación entre|relacion entre|cuál.*y cuál|cual.*y cual|qué norma crea.*y qué|que norma crea.*y que)",
}
ALPHAS, BETAS, KS, NORMALIZERS = (0.5, 0.6, 0.7, 0.8, 0.9), (0.0, 0.1, 0.2, 0.3, 0.4, 0.5), (10, 20, 40, 60, 100), ("minmax", "zscore")
CANDIDATES, WEIGHTED_ALPHAS, WEIGHTED_CANDIDATES = 50, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (20, 50, 100)
#: Hybrid rank with alpha 0.7, beta 0.2, k 10, minmax: its ordinal in the whole space; a type of fewer than LEAST queries takes it.
FALLBACK, LEAST = 140, 3


def signals(queries: DataFrame, text: str = "text") -> DataFrame:
    """Static signals of every query: words and six flags."""
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit(r"[^ \t\n\r\f\x0B]+"))
    return queries.withColumn("n_words", n).withColumns({k: t.rlike(p.replace("(?i)", "(?iu)")) for k, p in PATTERNS.items()})


def rule_type() -> tuple[Column, Column]:
    """(query type, confidence) over the columns of `signals`."""
    f = F.col
    rules = [
        (f("has_reference") & (f("has_number") | f("has_year")), TYPES[0], 0.9),
        (f("has_temporal"), TYPES[1], 0.9),
        (f("has_multi_hop"), TYPES[2], 0.9),
        ((f("n_words") <= 3) & ~f("has_reference"), TYPES[3], 0.7),
        (f("has_norm") & (f("n_words") > 12), TYPES[4], 0.7),
    ]
    kind, sure = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for test, name, confidence in rules:
        kind, sure = kind.when(test, name), sure.when(test, confidence)
    return kind.otherwise(TYPES[5]), sure.otherwise(0.55)


def search_space(spark: SparkSession, alphas=ALPHAS, betas=BETAS, ks=KS, normalizers=NORMALIZERS, weighted_alphas=WEIGHTED_ALPHAS, weighted_candidates=WEIGHTED_CANDIDATES) -> DataFrame:
    """config (its ordinal), strategy, alpha, beta, k, normalizer, candidate_k: the hybrid rank configurations, nested in this order,
    then the weighted ones (alpha, normalizer, candidate_k; beta and k are null). By default 300 and 54."""
    rows = [("hybridrank", a, float(b), float(k), n, CANDIDATES) for a in alphas for b in betas for k in ks for n in normalizers]
    rows += [("weighted", a, None, None, n, c) for a in weighted_alphas for n in normalizers for c in weighted_candidates]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "config int, strategy string, alpha double, beta double, k double, normalizer string, candidate_k int")


def params_json() -> Column:
    """A configuration's parameters as JSON, keys in order; what it has not is left out."""
    return F.to_json(F.struct("alpha", "beta", "k", "normalizer"))


def fuse_configs(rankings: DataFrame, configs: DataFrame, top: int = 10, sparse: str = "bm25", dense: str = "dense", picked: DataFrame | None = None) -> DataFrame:
    """config, query_id, doc_id, score, rank: fusion by every configuration (or, with `picked`, by the query's own one of (query_id, config))
    over candidates that are retrieved once.

    Scores are normalized over the first candidate_k of each list, so `rankings` must reach to the largest one. `configs` is a
    table of a few hundred rows by construction, which is broadcast. Its product with the candidates is dealt out by query
    beforehand, as the product itself is large.
    """
    lists = Window.partitionBy("candidate_k", "query_id", "retriever")
    rankings = rankings.join(F.broadcast(configs.select("candidate_k").distinct()), F.col("rank") <= F.col("candidate_k"))
    s = F.col("score")
    rows = rankings.withColumn("mm", fusion.minmax(s, lists)).withColumn("zs", fusion.zscore(s, lists))
    pick = lambda r, c: F.max(F.when(F.col("retriever") == r, F.col(c)))
    docs = rows.groupBy("candidate_k", "query_id", "doc_id").agg(*(pick(r, c).alias(f"{c}_{r}") for r in (sparse, dense) for c in ("mm", "zs", "rank")))
    width = int(rankings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if picked is None:
        c = docs.repartition(width, "query_id").join(F.broadcast(configs), "candidate_k")
    else:
        c = docs.join(picked, "query_id").join(F.broadcast(configs), ["candidate_k", "config"])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumn("rr", zero(1 / (F.col("k") + F.col(f"rank_{sparse}"))) + zero(1 / (F.col("k") + F.col(f"rank_{dense}"))))
    union = Window.partitionBy("config", "query_id")
    c = c.withColumn("u", fusion.minmax(F.col("rr"), union))
    norm = lambda x: zero(F.when(F.col("normalizer") == "minmax", F.col(f"mm_{x}")).otherwise(F.col(f"zs_{x}")))
    linear = F.col("alpha") * norm(sparse) + (1 - F.col("alpha")) * norm(dense)
    score = F.when(F.col("strategy") == "weighted", linear).otherwise(F.col("beta") * F.col("u") + (1 - F.col("beta")) * linear)
    c = c.withColumn("score", F.round(score, 9))
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), "doc_id")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("config", "query_id", "doc_id", "score", "rank")


def best_config(objectives: DataFrame, by: list[str], least: int = 0) -> DataFrame:
    """by, config, objective, n: the first configuration with the greatest mean objective (rounded to 9 digits); groups of fewer than
    `least` queries have none."""
    mean = objectives.groupBy(*by, "config").agg(F.round(F.avg("objective"), 9).alias("objective"), F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy(*by).orderBy(F.desc("objective"), "config") if by else Window.orderBy(F.desc("objective"), "config")
    return mean.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def policy(objectives: DataFrame, by: list[str], least: int = LEAST, fallback: int = FALLBACK) -> DataFrame:
    """by, config, objective, n, fallback: as best_config, but groups of fewer than `least` queries take the configuration `fallback`."""
    mean = objectives.groupBy(*by, "config").agg(F.round(F.avg("objective"), 9).alias("objective"), F.count("*").alias("n"))
    few = F.col("n") < least
    order = Window.partitionBy(*by).orderBy(F.desc("objective"), "config")
    left = mean.withColumn("fallback", few).where(~few | (F.col("config") == fallback))
    return left.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def leave_one_out(objectives: DataFrame) -> DataFrame:
    """query_id, config, train, test: for each query the configuration that is best on all others, and its objective on the query.

    The mean over the others is (sum - own) / (n - 1) over whole 1e-9 units, which is exact and needs no pairs of queries.
    """
    unit = objectives.withColumn("o", F.round(F.col("objective") * 1e9).cast("long"))
    all_of = Window.partitionBy("config")
    unit = unit.withColumn("others", F.sum("o").over(all_of) - F.col("o")).withColumn("n", F.count("*").over(all_of) - 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("others"), "config")
    first = unit.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("query_id", "config", F.round(F.try_divide("others", "n") / 1e9, 9).alias("train"), F.round(F.col("objective"), 9).alias("test"))


# ---------------------------------------------------------------- signals of retrieval


def retrieval_signals(rankings: DataFrame, k: int = 10, sparse: str = "bm25", dense: str = "dense") -> DataFrame:
    """query_id, overlap, top1_sparse, top1_dense, gap: shared documents of the first k over k, both best scores and their
    difference; a query that one retriever has no result for lacks that score and the gap."""
    w = fusion.wide(rankings, F.col("rank"), [sparse, dense])
    shared = F.count_if((F.col(sparse) <= k) & (F.col(dense) <= k))
    overlap = w.groupBy("query_id").agg((shared / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias("overlap"))
    first = lambda r: F.max(F.when((F.col("retriever") == r) & (F.col("rank") == 1), F.col("score")))
    best = rankings.groupBy("query_id").agg(first(sparse).alias("top1_sparse"), first(dense).alias("top1_dense"))
    return overlap.join(best, "query_id").withColumn("gap", F.col("top1_sparse") - F.col("top1_dense"))


# ---------------------------------------------------------------- classifiers: query_id, text to query_id, kind, confidence, reason, classifier

CLASSIFIED = "query_id long, kind string, confidence double, reason string, classifier string"
#: Why a rule says what it says.
REASONS = ("referencia legal con número o año", "patrón temporal detectado", "patrón multi-hop detectado", "consulta corta sin referencia legal", "tipo de norma con consulta extensa", "fallback semántico")
REASON_OF = dict(zip(TYPES, REASONS, strict=True))
INSTRUCTION = (
    "Clasifica la consulta en exactamente una categoría y devuelve SOLO JSON válido: "
    '{"query_type": "...", "confidence": 0.0, "reason": "..."}. Categorías: '
    + ", ".join(TYPES)
)


def classify_by_rules(queries: DataFrame, label: str = "rule_based") -> DataFrame:
    kind, sure = rule_type()
    reason = F.element_at(F.create_map(*(F.lit(x) for pair in REASON_OF.items() for x in pair)), F.col("kind"))
    rows = signals(queries.select("query_id", "text")).withColumn("kind", kind).withColumn("confidence", sure)
    return rows.select("query_id", "kind", "confidence", reason.alias("reason"), F.lit(label).alias("classifier"))


def classify_by_oracle(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """The kinds that `gold` (query_id, kind) has; a query without one is left out, as nothing can be said of its text."""
    return queries.select("query_id").join(gold.select("query_id", "kind"), "query_id").select("query_id", "kind", F.lit(1.0).alias("confidence"), F.lit("ground_truth").alias("reason"), F.lit("oracle").alias("classifier"))


def limited(message: str) -> bool:
    message = message.lower()
    return "429" in message or "rate limit" in message or "rate_limited" in message


def ask(generate: Callable[[list[dict]], str], text: str, attempts: int = 5, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str]:
    """(reply, outcome): only a rate limit is tried again, after twice the time each; outcome is `llm` or the label of the fallback."""
    for i in range(attempts):
        try:
            return generate([{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": f'Consulta:\n"{text}"'}]), "llm"
        except Exception as error:  # a client may raise anything
            if not limited(str(error)):
                return None, "llm_fallback"
            if i + 1 < attempts:
                sleep(delay * 2**i)
    return None, "llm_exhausted_fallback"


def parsed_reply(reply: Column) -> Column:
    """struct<query_type,confidence,reason> of a reply that is JSON or has a flat JSON object in it; null otherwise."""
    kind = "query_type string, confidence string, reason string"
    tried = lambda c: F.from_json(c, kind)
    whole, inner = F.trim(reply), F.regexp_extract(reply, r"\{[^{}]*\}", 0)
    flat = whole.rlike(r"^\{") & F.json_object_keys(whole).isNotNull()
    return F.when(flat, tried(whole)).when((inner != "") & F.json_object_keys(inner).isNotNull(), tried(inner))


def classify_by_model(queries: DataFrame, generate: Callable[[list[dict]], str], attempts: int = 5, delay: float = 1.0) -> DataFrame:
    """Kinds from an injected generator; whatever fails, is no JSON or names no known kind falls back to the rules under a label of its own."""
    rows = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [ask(generate, t, attempts, delay) for t in b["text"]]
            yield pd.DataFrame({"query_id": b["query_id"], "reply": [g[0] for g in got], "outcome": [g[1] for g in got]})

    replies = rows.mapInPandas(run, "query_id long, reply string, outcome string").withColumn("p", parsed_reply(F.col("reply")))
    known = F.col("p.query_type").isin(*TYPES)
    label = F.when(F.col("outcome") != "llm", F.col("outcome")).when(F.col("p").isNull(), "llm_parse_fallback").when(~F.coalesce(known, F.lit(False)), "llm_invalid_type_fallback").otherwise("llm")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(p.confidence as double)"), F.lit(0.7))))
    rules = classify_by_rules(rows).withColumnsRenamed({c: f"rule_{c}" for c in ("kind", "confidence", "reason", "classifier")})
    both = replies.withColumn("label", label).join(rules, "query_id")
    pick = lambda own, rule: F.when(F.col("label") == "llm", own).otherwise(F.col(rule))
    return both.select("query_id", pick(F.col("p.query_type"), "rule_kind").alias("kind"), pick(sure, "rule_confidence").alias("confidence"), pick(F.coalesce("p.reason", F.lit("")), "rule_reason").alias("reason"), F.col("label").alias("classifier"))


def classify_hybrid(queries: DataFrame, model: DataFrame | None = None, rules_from: float = 0.85, model_from: float = 0.65) -> DataFrame:
    """The rules where they are sure, else the model's answer where that is sure and no fallback, else the rules."""
    rules = classify_by_rules(queries)
    columns = ("kind", "confidence", "reason", "classifier")
    if model is None:
        return rules.withColumn("classifier", F.when(F.col("confidence") >= rules_from, "hybrid_rules").otherwise("hybrid_rules_no_llm"))
    rows = rules.join(model.withColumnsRenamed({c: f"m_{c}" for c in columns}), "query_id", "left")
    sure = F.col("confidence") >= rules_from
    other = ~sure & F.coalesce((F.col("m_confidence") >= model_from) & ~F.col("m_classifier").contains("fallback"), F.lit(False))
    picked = [F.when(other, F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in columns[:3]]
    return rows.select("query_id", *picked, F.when(sure, "hybrid_rules").when(other, "hybrid_llm").otherwise("hybrid_rules_llm_low_conf").alias("classifier"))


# ---------------------------------------------------------------- the policy and its use


@dataclass(frozen=True)
class AdaptiveOptions:
    candidate_k: int = 50
    top_k: int = 10
    least_confidence: float = 0.5
    least_queries: int = LEAST
    fallback: int = FALLBACK


def assigned(queries: DataFrame, classified: DataFrame, default: str = "semantica") -> DataFrame:
    """query_id, kind: a query that has no class is of the default one."""
    return queries.select("query_id").join(classified.select("query_id", "kind"), "query_id", "left").withColumn("kind", F.coalesce("kind", F.lit(default)))


def fit_policy(objectives: DataFrame, kinds: DataFrame, least: int = LEAST) -> DataFrame:
    """kind, config, objective, n, fallback for every kind of the training queries: the first configuration with the greatest mean
    objective; kinds of fewer than `least` queries have no configuration of their own (config is null, fallback true)."""
    rows = objectives.join(kinds, "query_id")
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    best = best_config(rows, ["kind"], least).select("kind", "config", "objective")
    return counts.join(best, "kind", "left").withColumn("fallback", F.col("config").isNull()).select("kind", "config", "objective", "n", "fallback")


def select_config(classified: DataFrame, policy: DataFrame | None, options: AdaptiveOptions = AdaptiveOptions()) -> DataFrame:
    """`classified` with config and fallback_used: the policy's configuration for the kind where the class is sure enough and the kind
    has one, else the fallback. fallback_used compares configurations, so a learned one that equals the fallback counts too."""
    if policy is None:
        return classified.withColumn("config", F.lit(options.fallback)).withColumn("fallback_used", F.lit(True))
    learned = policy.select("kind", F.col("config").alias("_learned"))
    config = F.when(F.col("confidence") < options.least_confidence, F.lit(options.fallback)).otherwise(F.coalesce("_learned", F.lit(options.fallback)))
    rows = classified.join(learned, "kind", "left").withColumn("config", config).drop("_learned")
    return rows.withColumn("fallback_used", F.col("config") == options.fallback)


def adaptive_retrieve(queries: DataFrame, rankings: DataFrame, classified: DataFrame, policy: DataFrame | None, options: AdaptiveOptions = AdaptiveOptions()) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score, rank; query_id, kind, confidence, config, fallback_used and all signals). The candidates are always the
    first `candidate_k`, whatever a configuration says of them."""
    space = search_space(queries.sparkSession).withColumn("candidate_k", F.lit(options.candidate_k))
    chosen = select_config(classified, policy, options)
    fused = fuse_configs(rankings, space, options.top_k, picked=chosen.select("query_id", "config"))
    info = chosen.join(signals(queries.select("query_id", "text")).drop("text"), "query_id").join(retrieval_signals(rankings.where(F.col("rank") <= options.candidate_k)), "query_id", "left")
    return fused.select("query_id", "doc_id", "score", "rank"), info


def adaptive_leave_one_out(objectives: DataFrame, kinds: DataFrame, confidence: DataFrame | None = None, options: AdaptiveOptions = AdaptiveOptions()) -> DataFrame:
    """query_id, kind, config, fallback_used, objective: for each query the policy fitted on all others, applied to the query.

    Fitting without a query needs no second pass: its kind's sum less its own objective, over one query less, in whole 1e-9 units.
    """
    rows = objectives.join(kinds, "query_id").withColumn("o", F.round(F.col("objective") * 1e9).cast("long"))
    w = Window.partitionBy("kind", "config")
    rows = rows.withColumn("others", F.sum("o").over(w) - F.col("o")).withColumn("n", F.count("*").over(w) - 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("others"), "config")
    learned = rows.where(F.col("n") >= options.least_queries).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "config")
    chosen = kinds.join(learned, "query_id", "left").withColumn("config", F.coalesce("config", F.lit(options.fallback)))
    if confidence is not None:
        chosen = chosen.join(confidence.select("query_id", "confidence"), "query_id").withColumn("config", F.when(F.col("confidence") < options.least_confidence, F.lit(options.fallback)).otherwise(F.col("config"))).drop("confidence")
    chosen = chosen.withColumn("fallback_used", F.col("config") == options.fallback)
    return chosen.join(objectives, ["query_id", "config"]).select("query_id", "kind", "config", "fallback_used", F.round("objective", 9).alias("objective"))


# ---------------------------------------------------------------- named strategies

#: The strategies that are compared, each with its fusion and parameters.
STRATEGIES = {
    "bm25_only": ("baseline", {"retriever": "bm25"}),
    "dense_only": ("baseline", {"retriever": "dense"}),
    "rrf_k60": ("rrf", {"k": 60}),
    "rrf_k100": ("rrf", {"k": 100}),
    "borda": ("borda", {}),
    "combsum_minmax": ("combsum", {"normalizer": "minmax"}),
    "combsum_zscore": ("combsum", {"normalizer": "zscore"}),
    "combmnz_minmax": ("combmnz", {"normalizer": "minmax"}),
    "weighted_a0.3": ("weighted", {"alpha": 0.3}),
    "weighted_a0.5": ("weighted", {"alpha": 0.5}),
    "weighted_a0.7": ("weighted", {"alpha": 0.7}),
    "hybridrank_a0.5_b0.5": ("hybridrank", {"alpha": 0.5, "beta": 0.5}),
    "hybridrank_a0.7_b0.5": ("hybridrank", {"alpha": 0.7, "beta": 0.5}),
    "hybridrank_a0.5_b0.7": ("hybridrank", {"alpha": 0.5, "beta": 0.7}),
    "hybridrank_a0.7_b0.3": ("hybridrank", {"alpha": 0.7, "beta": 0.3}),
    "hybridrank_a0.3_b0.7": ("hybridrank", {"alpha": 0.3, "beta": 0.7}),
}
FINAL = {k: v for k, v in STRATEGIES.items() if k.split("_a0")[0] not in ("weighted", "hybridrank") or k in ("weighted_a0.7", "hybridrank_a0.7_b0.3")} | {
    "weighted_optimized": ("weighted", {"alpha": 0.7, "normalizer": "minmax", "candidate_k": 20}),
    "hybridrank_optimized": ("hybridrank", {"alpha": 0.7, "beta": 0.2, "k": 10, "normalizer": "minmax", "rrf_normalizer": "minmax"}),
}


def fuse_named(rankings: DataFrame, strategies: dict = STRATEGIES, top: int = 20, candidate_k: int = 50) -> DataFrame:
    """strategy, query_id, doc_id, score, rank: every strategy's list over the first candidates of both retrievers."""
    out = None
    for name, (kind, given) in strategies.items():
        options = dict(given)
        rows = rankings.where(F.col("rank") <= options.pop("candidate_k", candidate_k))
        if kind == "baseline":
            found = rows.where((F.col("retriever") == options["retriever"]) & (F.col("rank") <= top)).select("query_id", "doc_id", "score", "rank")
        else:
            # dealt out anew, as lists that lie alike would be made one after the other in one task, which holds all their sorts
            found = fusion.get_fusion_strategy(kind)(rows, ["bm25", "dense"], top, **options).repartition("query_id", "doc_id")
        found = found.select(F.lit(name).alias("strategy"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def config_label(name: str, strategies: dict = FINAL) -> str:
    """`weighted(alpha=0.7, normalizer=minmax)`; a baseline's own name."""
    kind, options = strategies[name]
    return name if kind == "baseline" else f"{kind}({', '.join(f'{k}={v}' for k, v in sorted(options.items()) if k != 'candidate_k')})"
