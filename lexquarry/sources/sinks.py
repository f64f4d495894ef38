"""Sinks: JSON and tables, surrogate ids, reports, the interaction log, vector rows and resumable work."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.operators import reports

logger = logging.getLogger(__name__)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def surrogate_ids(rows: DataFrame, order: list, column: str = "id") -> DataFrame:
    """`column`: 1, 2, ... in the given total order. Ranges of the order are numbered apart, so no task holds all rows."""
    spread = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    kept = spread.persist()
    counts = kept.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    return kept.join(F.broadcast(before), "_part").withColumn(column, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def write_norm_tables(gazettes: DataFrame, norms: DataFrame, duplicates: DataFrame, folder: str) -> None:
    """The three tables anew, with surrogate ids by (checksum, numero, fecha) and (gazette, ordinal); duplicates name gazettes by the id of their checksum, null without one."""
    spark = gazettes.sparkSession
    surrogate_ids(gazettes, ["checksum", "numero", "fecha"]).write.mode("overwrite").parquet(f"{folder}/gacetas")
    g = spark.read.parquet(f"{folder}/gacetas")
    ids = g.where("coalesce(checksum, '') <> ''").groupBy("checksum").agg(F.max("id").alias("gaceta_id"))
    keyed = norms.join(ids, "checksum", "left").drop("checksum")
    surrogate_ids(keyed, ["gaceta_id", "ordinal_position", "norm_id"]).write.mode("overwrite").parquet(f"{folder}/normas")
    side = lambda c: ids.select(F.col("checksum").alias(f"{c}_checksum"), F.col("gaceta_id").alias(f"{c}_gaceta_id"))
    both = duplicates.join(side("kept"), "kept_checksum", "left").join(side("superseded"), "superseded_checksum", "left")
    both.drop("kept_checksum", "superseded_checksum").write.mode("overwrite").parquet(f"{folder}/norma_duplicates")


def write_relationships(relationships: DataFrame, folder: str) -> None:
    """What was there goes, so writing twice leaves one copy."""
    relationships.write.mode("overwrite").parquet(folder)


def processing_report(gazettes: DataFrame, norms: DataFrame, unmatched: DataFrame, folder: str) -> None:
    """Totals and histograms of confidence and kind."""
    write_json(reports.processing_totals(gazettes, norms, unmatched), f"{folder}/totals")
    for c in ("match_confidence", "tipo"):
        write_json(reports.histogram(norms, c), f"{folder}/{c}")
    write_json(unmatched, f"{folder}/issues")


def linking_report(linked: DataFrame, folder: str) -> None:
    """Counters, histograms of relation, method and the kinds that stay unresolved, and those references."""
    from lexquarry.operators import linking

    write_json(linking.counters(linked), f"{folder}/totals")
    for c, rows in (("relation_type", linked), ("confidence", linked), ("tipo_norm", linking.unresolved(linked))):
        write_json(reports.histogram(rows, c), f"{folder}/{c}")
    write_json(linking.unresolved(linked).select("source", "tipo", "numero", "year", "raw", "confidence"), f"{folder}/unresolved")


def append_log(rows: DataFrame, path: str) -> bool:
    """One JSON line an interaction. A log that cannot be written is no reason to fail: the error is reported and False returned."""
    try:
        rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode("append").json(path)
        return True
    except Exception as error:  # whatever the file system raises
        logger.warning("the interaction log was not written: %s", error)
        return False


# ---------------------------------------------------------------- vectors

Encoder = Callable[[list[str]], list[list[float]]]


def embed(elements: DataFrame, encoder: Callable[[], Encoder], text: str = "cleaned_content", prompt: str = "passage: ", batch: int = 64, normalize: bool = True) -> DataFrame:
    """`elements` with `embedding` by an injected encoder; encoder() is called once in each task. Empty texts and texts whose batch
    fails get an empty vector; lengths become 1 if asked for."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for rows in batches:
            texts = [t or "" for t in rows.column(text).to_pylist()]
            out: list[list[float]] = [[] for _ in texts]
            full = [i for i, t in enumerate(texts) if t.strip()]
            for a in range(0, len(full), batch):
                some = full[a : a + batch]
                try:
                    vectors = model([prompt + texts[i] for i in some])
                except Exception as error:  # an encoder may raise anything
                    logger.warning("%d texts were not encoded: %s", len(some), error)
                    continue
                for i, v in zip(some, vectors, strict=True):
                    length = sum(x * x for x in v) ** 0.5 if normalize else 1.0
                    out[i] = [x / length for x in v] if length else list(v)
            yield rows.append_column("embedding", pa.array(out, pa.list_(pa.float64())))

    kept = elements.drop("embedding")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def with_ids(elements: DataFrame, key: str = "chunk_id", *parts: str) -> DataFrame:
    """`key` where it is missing: a digest of the given columns, the same at every run."""
    made = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)), 256)
    return elements.withColumn(key, F.coalesce(F.nullif(key, F.lit("")), made))


def write_vectors(rows: DataFrame, folder: str) -> None:
    """The vector index anew: rows with their length, so that a cosine needs a product only."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows.withColumn("norm", norm).write.mode("overwrite").parquet(folder)


def embedding_statistics(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: elements, those with and without a vector, and the vectors' dimension (null without any)."""
    n = F.coalesce(F.size(embedding), F.lit(0))
    return rows.agg(F.count("*").alias("total"), F.count_if(n > 0).alias("valid"), F.count_if(n <= 0).alias("empty"), F.max(F.when(n > 0, n)).alias("dimension"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def vocabulary(rows: DataFrame, tokens: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Distinct alphabetic terms of more than two letters."""
    return rows.select(F.explode(tokens(F.coalesce(text, F.lit("")))).alias("term")).where(F.col("term").rlike(r"^\p{L}{3,}$")).distinct()
