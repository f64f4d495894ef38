"""Options with their defaults; a session's `spark.lexquarry.*` settings override them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    candidate_k: int = 50
    fusion_strategy: str = "hybridrank"
    max_fragments: int = 8
    max_chars: int = 12_000
    min_cleaned_length: int = 10
    temperature: float = 0.1
    max_tokens: int = 2048
    corpus: str = "normas"

    def __post_init__(self):
        if self.top_k < 0 or self.candidate_k <= 0:
            raise ValueError("top_k must not be negative and candidate_k must be positive")


def load(spark: SparkSession, **overrides) -> Config:
    """Defaults, then the session's settings, then the overrides that are not None."""
    found = {}
    for f in fields(Config):
        value = spark.conf.get(f"spark.lexquarry.{f.name}", None)
        if value is not None:
            found[f.name] = type(f.default)(value)
    return replace(Config(**found), **{k: v for k, v in overrides.items() if v is not None})
