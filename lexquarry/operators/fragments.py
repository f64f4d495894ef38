"""Index fragments of norms: the join with their gazettes, split texts, identifiers and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import legal as L
from lexquarry.functions.text import squeeze


def norm_rows(norms: DataFrame, gazettes: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """norms (gaceta_id, ...) with their gazette's number, date, edition, url and checksum; without rows that `duplicates`
    (norm_id, superseded) says another gazette supersedes. None: all rows."""
    g = gazettes.select(F.col("id").alias("gaceta_id"), *(F.col(c).alias(f"gaceta_{c}") for c in ("numero", "fecha", "tipo_edicion", "pdf_url", "checksum")))
    rows = norms.join(g, "gaceta_id")
    if duplicates is None:
        return rows
    gone = duplicates.where("superseded is not null").select("norm_id", F.col("superseded").alias("gaceta_id")).distinct()
    return rows.join(gone, ["norm_id", "gaceta_id"], "left_anti")


def metadata(index: Column, total: Column, label: Column, fragment: Column) -> Column:
    """The 30 fields of a fragment; text that is missing is empty, numbers 0, pages -1."""
    text = lambda c, name=None: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name or c)
    whole = lambda c, default: F.coalesce(F.col(c).cast("int"), F.lit(default)).alias(c)
    said = lambda value, name: F.lit(value).alias(name)
    return F.struct(
        fragment.alias("chunk_id"), said("normas.db", "source"), said("NormaIndexFragment", "type"), said("normas.db", "filename"), said("norma", "document_type"), said("sqlite", "filetype"),
        whole("page_start", -1).alias("page_number"), said("normas", "corpus_type"), text("norm_id", "norma_id"), fragment.alias("fragment_id"), index.cast("int").alias("fragment_index"), total.cast("int").alias("fragment_total"),
        label.alias("fragment_label"), text("tipo"), text("numero"), whole("year", 0), text("organismo", "organismo_emisor"), text("goc_code"), F.coalesce(F.col("gaceta_id").cast("long"), F.lit(0)).alias("gaceta_id"),
        text("gaceta_numero"), text("gaceta_fecha"), text("gaceta_tipo_edicion"), text("gaceta_pdf_url"), text("gaceta_checksum"), F.col("_checksum").alias("gaceta_checksum_12"), whole("page_start", -1), whole("page_end", -1),
        text("match_confidence"), whole("ordinal_position", 0), text("raw_metadata_string"),
    )


def build_fragments(rows: DataFrame) -> DataFrame:
    """fragment_id, content, cleaned_content, metadata for each part of every row of `norm_rows`; norms without text give none."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    prefix = squeeze(F.concat(blank("tipo"), F.lit(" "), blank("numero"), F.lit(" de "), blank("year"), F.lit(" - "), blank("organismo")))
    checksum = L.checksum_12(F.col("gaceta_checksum"), F.col("gaceta_numero"), F.col("gaceta_fecha"), F.col("gaceta_tipo_edicion"))
    parts = rows.withColumn("_checksum", checksum).withColumn("_prefix", prefix).withColumn("_parts", L.split_norm(F.col("text")))
    parts = parts.drop("text").withColumn("_total", F.size("_parts")).select("*", F.posexplode("_parts").alias("_i", "_p")).drop("_parts")
    fragment = L.fragment_id(F.col("norm_id"), F.col("_checksum"), F.col("goc_code"), F.col("ordinal_position"), F.col("_i"))
    content = F.concat(F.col("_prefix"), F.lit(". "), F.col("_p.label"), F.lit(". "), F.col("_p.text"))  # its parts have single blanks
    return parts.select(fragment.alias("fragment_id"), content.alias("content"), F.lower(content).alias("cleaned_content"), metadata(F.col("_i"), F.col("_total"), F.col("_p.label"), fragment).alias("metadata"))
