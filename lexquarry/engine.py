"""The engine's objects: retrievers, hybrid and adaptive retrieval, a fragment store and the answering pipeline, all over batches of queries.

queries: query_id, text. Rankings: query_id, retriever, doc_id, score, rank.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import adaptive, fusion, rag, retrieval


class Retriever(Protocol):
    name: str

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class Reranker(Protocol):
    def rerank(self, queries: DataFrame, rankings: DataFrame, k: int) -> DataFrame: ...


class Classifier(Protocol):
    """query_id, text to query_id, kind, confidence, reason, classifier."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class BM25Retriever:
    """Over an index as `retrieval.load_index` gives; k1 and b may change without a new index."""

    index: retrieval.Index
    k1: float = retrieval.K1
    b: float = retrieval.B
    tokenize: Callable = retrieval.tokens
    name: str = "bm25"

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieval.bm25(self.index, queries, k, self.k1, self.b, self.tokenize)


@dataclass(frozen=True)
class DenseRetriever:
    """Over vectors (doc_id, embedding). encode(queries) gives query_id, embedding; query texts go to it with the prompt `query: `."""

    vectors: DataFrame
    encode: Callable[[DataFrame], DataFrame]
    prompt: str = "query: "
    name: str = "dense"

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.withColumn("text", F.concat(F.lit(self.prompt), F.coalesce("text", F.lit("")))) if "text" in queries.columns else queries
        return retrieval.dense(self.vectors, self.encode(asked), k)


@dataclass(frozen=True)
class HybridRetriever:
    """The first candidate_k of every retriever, fused."""

    retrievers: dict[str, Retriever]
    strategy: str = "hybridrank"
    candidate_k: int = 50
    options: dict = field(default_factory=dict)
    reranker: Reranker | None = None

    def __post_init__(self):
        if not self.retrievers:
            raise ValueError("at least one retriever is needed")
        if self.candidate_k <= 0:
            raise ValueError("candidate_k must be positive")
        fusion.get_fusion_strategy(self.strategy)

    @property
    def name(self) -> str:
        return f"hybrid_{self.strategy}({'+'.join(self.retrievers)})"

    def candidates(self, queries: DataFrame) -> DataFrame:
        out = None
        for name, r in self.retrievers.items():
            rows = r.retrieve(queries, self.candidate_k).withColumn("retriever", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        return out

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        fused = fusion.get_fusion_strategy(self.strategy)(self.candidates(queries), list(self.retrievers), k, **self.options)
        return self.reranker.rerank(queries, fused, k) if self.reranker else fused


@dataclass(frozen=True)
class AdaptiveRetriever:
    """Each query's own fusion: its class says which learned configuration applies."""

    retrievers: dict[str, Retriever]
    classify: Classifier
    policy: DataFrame | None = None
    options: adaptive.AdaptiveOptions = adaptive.AdaptiveOptions()
    name: str = "adaptive"

    def retrieve_with_metadata(self, queries: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Results, and a row of class, configuration and signals for each query; k of 0 or None takes the default."""
        options = adaptive.AdaptiveOptions(self.options.candidate_k, k or self.options.top_k, self.options.least_confidence, self.options.least_queries, self.options.fallback)
        rankings = HybridRetriever(self.retrievers, candidate_k=options.candidate_k).candidates(queries)
        return adaptive.adaptive_retrieve(queries, rankings, self.classify(queries), self.policy, options)

    def retrieve(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        return self.retrieve_with_metadata(queries, k)[0]


@dataclass(frozen=True)
class FragmentStore:
    """Fragments by id; `key` is what rankings call doc_id."""

    fragments: DataFrame
    key: str = "fragment_id"

    def get(self, ids: list) -> DataFrame:
        return self.fragments.where(F.col(self.key).isin(ids))

    def resolve(self, rankings: DataFrame) -> tuple[DataFrame, DataFrame]:
        return rag.get_fragments(rankings.withColumnRenamed("doc_id", self.key), self.fragments, self.key)


@dataclass(frozen=True)
class RAGPipeline:
    """Retrieval, context, generation and citation for a batch of queries."""

    retriever: Retriever
    store: FragmentStore
    generate: Callable[[list[dict]], str]
    context: rag.ContextOptions = rag.ContextOptions()
    top_k: int = 10
    system: str | None = None
    provider: str = "injected"

    def run(self, queries: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(query_id, context, answer, n_retrieved, formatted; the fragments). Queries without fragments answer that there are no sources."""
        found, _ = self.store.resolve(self.retriever.retrieve(queries, k or self.top_k))
        answered = rag.answers(queries, found, self.generate, self.context, self.system)
        cited = rag.formatted_answers(answered, found)
        return answered.join(cited, "query_id", "left").withColumn("formatted", F.coalesce("formatted", "answer")), found

    def log(self, answered: DataFrame, fragments: DataFrame) -> DataFrame:
        return rag.interaction_log(answered, fragments, self.retriever.name, self.provider)
