"""Context, prompts, citations and batch answering over retrieved fragments, with an injected generator.

fragments: query_id, rank, score, fragment_id, content and the metadata columns of `FIELDS`; what is missing of them counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("norma_id", "tipo", "numero", "organismo_emisor", "goc_code", "gaceta_numero", "gaceta_fecha", "gaceta_tipo_edicion", "gaceta_pdf_url", "fragment_label", "match_confidence")

# ---------------------------------------------------------------- fixed values: texts that go to the generator and to the reader

NO_SOURCES = "No se encontraron fuentes relevantes para responder la consulta."
SYSTEM = (
    "Eres un asistente juridico especializado en legislacion cubana.\n"
    "Responde solo con informacion presente en los fragmentos oficiales proporcionados.\n\n"
    "Reglas:\n"
    "1. Si la informacion no aparece en las fuentes, dilo explicitamente.\n"
    "2. Cita con las etiquetas [Fuente N] del contexto.\n"
    "3. Identifica tipo de norma, numero, anno y organismo emisor cuando aplique.\n"
    "4. Distingue menciones de modificaciones, derogaciones o complementos.\n"
    "5. Si varias normas son relevantes, resume su relacion.\n"
    "6. Usa lenguaje juridico preciso y accesible.\n"
    "7. No inventes, extrapoles ni supongas.\n"
    "8. Al final, lista las fuentes utilizadas."
)
USER = (
    "Contexto (fragmentos de la Gaceta Oficial de Cuba):\n\n{context}\n\n---\n\nPregunta: {query}\n\n"
    "Responde basandote exclusivamente en los fragmentos anteriores. Cita con [Fuente N] y lista las fuentes consultadas al final."
)
CITED = r"(?iU)\[Fuente\s+(\d+)\]"
ANSWER_CHARS = 500


@dataclass(frozen=True)
class ContextOptions:
    max_fragments: int = 8
    max_chars: int = 12_000
    include_metadata: bool = True
    deduplicate_by_norma: bool = False


def typed(fragments: DataFrame) -> DataFrame:
    """Text fields as text (missing: empty), year as a number (0 if it is none), page_start and page_end likewise (-1)."""
    have = set(fragments.columns)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in FIELDS}
    number = {c: F.coalesce(F.expr(f"try_cast(`{c}` as int)"), F.lit(d)) if c in have else F.lit(d) for c, d in (("year", 0), ("page_start", -1), ("page_end", -1))}
    return fragments.withColumns(text | number).withColumn("content", F.coalesce("content", F.lit("")))


def citation_key() -> Column:
    """`Resolución 41/2026 (GOC-...)`."""
    return F.concat(F.format_string("%s %s/%d", "tipo", "numero", "year"), F.when(F.col("goc_code") != "", F.concat(F.lit(" ("), "goc_code", F.lit(")"))).otherwise(""))


def source_label() -> Column:
    return F.concat(F.format_string("%s %s/%d", "tipo", "numero", "year"), F.when(F.col("organismo_emisor") != "", F.concat(F.lit(" — "), "organismo_emisor")).otherwise(""))


def page_range() -> Column:
    """`Pag. 3`, `Pags. 3-5`; null where the first page is unknown."""
    a, b = F.col("page_start"), F.col("page_end")
    return F.when(a <= 0, F.lit(None)).when(a == b, F.concat(F.lit("Pag. "), a)).otherwise(F.concat(F.lit("Pags. "), a, F.lit("-"), b))


def _some(c: str, before: str = "") -> Column:
    return F.when(F.col(c) != "", F.concat(F.lit(before), c))


def block(number: Column, include_metadata: bool = True) -> Column:
    """A source of the context: header, metadata, section, a rule and the content, closed by a newline."""
    first = F.concat(F.lit("[Fuente "), number, F.lit("] "), F.format_string("%s %s/%d - %s", "tipo", "numero", "year", "organismo_emisor"))
    meta = F.concat_ws(" | ", _some("gaceta_numero", "Gaceta Oficial No. "), _some("gaceta_fecha"), _some("goc_code"), page_range())
    header = F.concat_ws("\n", first, F.nullif(meta, F.lit("")), _some("fragment_label", "Seccion: ")) if include_metadata else first
    return F.concat(header, F.lit("\n---\n"), "content", F.lit("\n"))


def context(fragments: DataFrame, options: ContextOptions = ContextOptions()) -> DataFrame:
    """query_id, context, n_sources: the first fragments, of which one per norm stays if asked, numbered anew; the first block always
    enters, then others up to the first that would exceed the budget. Joining newlines do not count."""
    rows = typed(fragments).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= options.max_fragments)
    if options.deduplicate_by_norma:
        rows = rows.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "norma_id").orderBy("_r"))).where("_d = 1")
    order = Window.partitionBy("query_id").orderBy("_r")
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("_block", block(F.col("_i"), options.include_metadata))
    rows = rows.withColumn("_sum", F.sum(F.length("_block")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("_i") == 1) | (F.col("_sum") <= options.max_chars))
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_block"))).alias("bs"))
    return g.select("query_id", F.array_join(F.transform("bs", lambda b: b["_block"]), "\n").alias("context"), F.size("bs").alias("n_sources"))


def messages(query: Column, text: Column, system: str | None = None) -> Column:
    """array<struct<role,content>>: the system's and the user's message."""
    before, between, after = USER.split("{context}")[0], *USER.split("{context}")[1].split("{query}")
    user = F.concat(F.lit(before), text, F.lit(between), query, F.lit(after))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system or SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def cited_sources(answer: Column) -> Column:
    """The numbers that an answer cites, ascending, each once."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITED), F.lit(1)), lambda x: x.cast("int"))))


def citations(answers: DataFrame) -> DataFrame:
    """query_id, valid, invalid, uncited: cited numbers split by the number of retrieved fragments (n_retrieved), and the rest of those."""
    n = F.col("n_retrieved")
    every = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    rows = answers.withColumn("_c", cited_sources(F.col("answer"))).withColumn("_e", every)
    return rows.select("query_id", F.array_intersect("_c", "_e").alias("valid"), F.array_except("_c", "_e").alias("invalid"), F.array_except("_e", "_c").alias("uncited"))


def entry() -> Column:
    """A cited source in the bibliography."""
    gazette = F.when((F.col("gaceta_numero") != "") & (F.col("gaceta_fecha") != ""), F.concat(F.lit("Gaceta Oficial No. "), "gaceta_numero", F.lit(", "), "gaceta_fecha"))
    meta = F.nullif(F.concat_ws(" | ", gazette, _some("goc_code"), page_range()), F.lit(""))
    first = F.concat(F.lit("**[Fuente "), "number", F.lit("]** "), F.format_string("%s %s/%d", "tipo", "numero", "year"))
    return F.concat_ws("\n", first, F.concat(F.lit("  *"), "organismo_emisor", F.lit("*")), F.concat(F.lit("  "), meta))


def formatted_answers(answers: DataFrame, fragments: DataFrame) -> DataFrame:
    """query_id, formatted: the answer with its bibliography; cited sources with their data, the others by their key."""
    rows = typed(fragments).withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", entry().alias("entry"), citation_key().alias("key")))).alias("fs"))
    joined = answers.join(lists, "query_id").withColumn("_c", cited_sources(F.col("answer")))
    used = F.transform(F.filter("fs", lambda f: F.array_contains("_c", f["number"])), lambda f: F.concat(f["entry"], F.lit("\n\n")))
    other = F.transform(F.filter("fs", lambda f: ~F.array_contains("_c", f["number"])), lambda f: F.concat(F.lit("- "), f["key"], F.lit("\n")))
    rest = F.when(F.size(other) > 0, F.concat(F.lit("**Otras fuentes recuperadas:**\n"), F.array_join(other, ""), F.lit("\n"))).otherwise("")
    # lines are joined by newlines, so the last one's own is not written
    body = F.concat(F.lit("---\n**Fuentes Consultadas**\n\n"), F.array_join(used, ""), rest)
    return joined.select("query_id", F.concat("answer", F.lit("\n\n"), F.regexp_replace(body, r"\n\z", "")).alias("formatted"))


def sources_list(fragments: DataFrame) -> DataFrame:
    """query_id, sources: a line `[Fuente N] label` for each fragment."""
    rows = typed(fragments).withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    line = F.concat(F.lit("[Fuente "), "number", F.lit("] "), source_label())
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("ls")).select("query_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("sources"))


def get_fragments(rankings: DataFrame, store: DataFrame, key: str = "fragment_id") -> tuple[DataFrame, DataFrame]:
    """(the ranked fragments that the store has, ranked anew from 1; query_id and id of those that it has not)."""
    found = rankings.join(store, key)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank), rankings.join(store.select(key), key, "left_anti").select("query_id", key)


def answers(queries: DataFrame, fragments: DataFrame, generate: Callable[[list[dict]], str], options: ContextOptions = ContextOptions(), system: str | None = None) -> DataFrame:
    """query_id, context, answer, n_retrieved; queries without fragments get NO_SOURCES without a call."""
    n = fragments.groupBy("query_id").agg(F.count("*").cast("int").alias("n_retrieved"))
    rows = queries.select("query_id", "text").join(context(fragments, options), "query_id", "left").join(n, "query_id", "left").na.fill({"n_retrieved": 0, "context": "", "text": ""})
    rows = rows.withColumn("messages", messages(F.col("text"), F.col("context"), system))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["answer"] = [generate([dict(x) for x in m]) if n else NO_SOURCES for m, n in zip(b["messages"], b["n_retrieved"], strict=True)]
            yield b[["query_id", "context", "answer", "n_retrieved"]]

    return rows.select("query_id", "messages", "context", "n_retrieved").mapInPandas(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, context string, answer string, n_retrieved int")


def interaction_log(answered: DataFrame, fragments: DataFrame, retriever: str, provider: str) -> DataFrame:
    """A row for each query as the log has it: the sources' ids and keys, the answer's first characters."""
    rows = typed(fragments)
    docs = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fragment_id", "score", citation_key().alias("key")))).alias("fs"))
    out = answered.join(docs, "query_id", "left")
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    listed = F.coalesce(F.transform("fs", lambda f: F.struct(f["fragment_id"].alias("fragment_id"), f["score"].alias("score"))), none("array<struct<fragment_id:string,score:double>>"))
    return out.select("query_id", F.lit(retriever).alias("retriever"), F.lit(provider).alias("provider"), listed.alias("retrieved_docs"), F.coalesce(F.transform("fs", lambda f: f["key"]), none("array<string>")).alias("sources"), F.substring("answer", 1, ANSWER_CHARS).alias("answer"))


def echo(asked: list[dict]) -> str:
    """A deterministic generator for tests: the question's first letters and two sources, of which the second may not exist."""
    question = asked[-1]["content"].split("Pregunta: ", 1)[1].split("\n", 1)[0]
    return f"{question[:40]} [Fuente 1] y [fuente 99]"


GENERATORS: dict[str, Callable[..., Callable[[list[dict]], str]]] = {"echo": lambda **_: echo}


def get_generator(name: str, **options) -> Callable[[list[dict]], str]:
    """A registered provider's generator: providers are factories (options to a function of messages), so that clients are injected."""
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; one of {sorted(GENERATORS)}")
    return GENERATORS[name](**options)
