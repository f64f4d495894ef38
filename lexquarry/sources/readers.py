"""Sources with declared schemas: tables, indices of gazettes, elements, queries and judgements, pages."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

GAZETTE_INDEX = "tipo_edicion string, fecha string, numero string, normas array<string>, pdf_url string, files array<struct<path string, status string, checksum string>>"
ELEMENT = (
    "content string, cleaned_content string, embedding array<double>, metadata struct<source string, page_number int, type string, filetype string, filename string, chunk_id string, document_type string, "
    "gaceta_tipo_edicion string, gaceta_fecha string, gaceta_numero string, gaceta_normas array<string>, gaceta_pdf_url string, gaceta_checksum string, gaceta_relative_path string, corpus_type string, norma_id string, fragment_id string>"
)
QUERY = "query_id string, query_type string, query string"
JUDGEMENT = QUERY + ", pool_docs array<string>, relevant_docs array<string>, pool_normas array<string>, relevant_normas array<string>"
DEFAULT_TITLE = "Sin título"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """`rows` in as many partitions as there are cores, if a small input has fewer: for work that costs more than moving the rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of a JSON array each, or of a JSON object in each line; items that are no objects are dropped, one of them does not spoil its file.
    A file of an array is one task's; large inputs belong in lines, or better in tables."""
    value = F.trim("value")
    items = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.split(value, r"\r?\n"))
    rows = spark.read.text(path, wholetext=True).select(F.explode(items).alias("item")).where(F.ltrim("item").startswith("{"))
    return rows.select(F.from_json("item", schema).alias("r")).select("r.*")


def gazette_index(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, GAZETTE_INDEX)


def elements(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, ELEMENT)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)


def parsed_elements(files: DataFrame, parse) -> DataFrame:
    """source, position, content, page_number, type, chunk_id: parse(bytes) gives (content, page, type) of each element of a file, in order.

    The parser is injected, as none is part of the engine; ids are digests of file and place, the same at every run. A file that cannot be parsed gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    found = list(parse(bytes(content)))
                except Exception as error:  # a parser may raise anything
                    logger.warning("%s was not parsed: %s", path, error)
                    continue
                out += [(path, i, text, page, kind) for i, (text, page, kind) in enumerate(found)]
            yield pd.DataFrame(out, columns=["source", "position", "content", "page_number", "type"])

    rows = files.select("path", "content").mapInPandas(run, "source string, position int, content string, page_number int, type string")
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", "source", F.col("position").cast("string")), 256))


def downloaded(index: DataFrame) -> DataFrame:
    """`index` with `file`: the first file that is downloaded and has a path."""
    good = F.filter("files", lambda f: (F.lower(f["status"]) == "downloaded") & (F.coalesce(f["path"], F.lit("")) != ""))
    return index.withColumn("file", F.try_element_at(good, F.lit(1)))


def selected_files(index: DataFrame, files: DataFrame, order: str, by_checksum: bool = True, most: int | None = None) -> DataFrame:
    """The entries to load, in order: with a downloaded file that is there (`files`: path), the first of each checksum (of each path, where there is
    none or it does not count), at most `most`.

    A file that is missing does not hide a later one of its checksum.
    """
    rows = downloaded(index).where("file is not null").withColumn("_path", F.col("file.path")).join(files.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi")
    checksum = F.coalesce(F.col("file.checksum"), F.lit(""))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(order))
    same = F.when(checksum != "", F.concat(F.lit("c:"), checksum)).otherwise(F.concat(F.lit("p:"), "_path")) if by_checksum else F.col("_path")
    rows = rows.withColumn("_key", same).withColumn("_n", first("_key")).where("_n = 1")
    if most is not None:
        rows = rows.orderBy(order).limit(most)
    return rows.drop("_n", "_key", "_path")


def enriched(elements: DataFrame, entry: dict[str, Column]) -> DataFrame:
    """`elements` whose metadata take the gazette's fields, whatever they had of them."""
    meta = F.col("metadata")
    for name, value in entry.items():
        meta = meta.withField(name, value)
    return elements.withColumn("metadata", meta)


def valid_elements(rows: DataFrame, require_embedding: bool = True) -> DataFrame:
    """Elements with an id and cleaned text, and with a vector if it is asked for."""
    test = (F.coalesce("metadata.chunk_id", F.lit("")) != "") & (F.trim(F.coalesce("cleaned_content", F.lit(""))) != "")
    return rows.where(test & (F.coalesce(F.size("embedding"), F.lit(0)) > 0) if require_embedding else test)


def safe_value(c: Column, kind: str) -> Column:
    """A metadata value as a vector store takes it: text, numbers and booleans as they are, lists and objects as JSON, null as empty."""
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c, F.lit("")) if kind == "string" else c


KEPT_METADATA = ("chunk_id", "source", "type", "filename", "document_type", "filetype", "page_number", "corpus_type", "tipo", "numero", "year", "organismo_emisor", "goc_code", "page_start", "page_end", "match_confidence", "ordinal_position", "raw_metadata_string")
KEPT_PREFIXES = ("gaceta_", "norma_", "fragment_")


def index_rows(rows: DataFrame) -> DataFrame:
    """id, document, embedding (doubles), metadata of valid elements: known fields only, a page that is missing is -1."""
    fields = [f for f in rows.schema["metadata"].dataType.fields if f.name in KEPT_METADATA or f.name.startswith(KEPT_PREFIXES)]
    kept = [F.coalesce("metadata.page_number", F.lit(-1)).alias("page_number") if f.name == "page_number" else safe_value(F.col(f"metadata.{f.name}"), f.dataType.simpleString()).alias(f.name) for f in fields]
    return rows.select(F.col("metadata.chunk_id").alias("id"), F.coalesce("content", "cleaned_content").alias("document"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.struct(*kept).alias("metadata"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries; a row without one of the three keys is an error."""
    rows = spark.read.schema(QUERY).option("mode", "FAILFAST").json(path, multiLine=True)
    missing = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a query lacks {c}"))).otherwise(F.col(c)).alias(c)
    return rows.select(*map(missing, ("query_id", "query_type", "query")))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """Judged queries that have a relevant document."""
    return json_rows(spark, path, JUDGEMENT).where(F.size("relevant_docs") > 0)


def lookup(store: DataFrame, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of the ids that the store has."""
    return store.select(key, *columns).join(ids.select(key).distinct(), key, "left_semi")


def preview(c: Column, n: int = 200) -> Column:
    """The first n characters, `...` where there is more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.coalesce(c, F.lit("")))


def readable(c: Column) -> Column:
    """Blank lines go, runs of blanks become one, none at a line's ends."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# ---------------------------------------------------------------- pages


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.title, self.tag, self.cells = [], None, None, 0

    def handle_starttag(self, tag, attrs):
        self.tag = tag
        self.cells += tag in ("td", "th")
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        self.tag = None

    def handle_data(self, data):
        if self.tag == "title" and self.title is None:
            self.title = data.strip()


def html_rows(pages: DataFrame, url: str | None = None) -> DataFrame:
    """page_id, title, links, n_cells of each page's html; broken html gives what was read, a page without a title the default one.
    With `url`, the column of the page's own address, links are absolute."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, base, html in zip(b["page_id"], b["base"], b["html"], strict=True):
                p = _Page()
                p.feed(html or "")
                out.append((page, p.title or DEFAULT_TITLE, [urljoin(base, x) for x in p.links] if base else p.links, p.cells))
            yield pd.DataFrame(out, columns=["page_id", "title", "links", "n_cells"])

    base = F.coalesce(F.col(url), F.lit("")) if url else F.lit("")
    return pages.select("page_id", base.alias("base"), "html").mapInPandas(run, "page_id long, title string, links array<string>, n_cells int")
