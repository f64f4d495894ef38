"""Context, citations, answers and the log, on the cases that the specification lists."""

import pytest
from pyspark.sql import functions as F

from lexquarry.operators import rag

FRAGMENT = "query_id long, rank int, score double, fragment_id string, content string, norma_id string, tipo string, numero string, year string, organismo_emisor string, goc_code string, gaceta_numero string, gaceta_fecha string, fragment_label string, page_start int, page_end int"


def row(rank, content="texto", norma="n", **kw):
    base = dict(query_id=1, rank=rank, score=1.0 / rank, fragment_id=f"f{rank}", content=content, norma_id=norma, tipo="Ley", numero="5", year="2020", organismo_emisor="Consejo", goc_code="GOC-1", gaceta_numero="9", gaceta_fecha="03 Marzo, 2021", fragment_label="ARTÍCULO 1", page_start=3, page_end=4)
    return tuple((base | kw).values())


def test_context(spark):
    f = spark.createDataFrame([row(1, "x" * 5000), row(2, "y" * 900), row(3, "z" * 5000)], FRAGMENT)
    c = rag.context(f, rag.ContextOptions(max_chars=6300)).first()
    assert c.n_sources == 2 and "[Fuente 2]" in c.context and "[Fuente 3]" not in c.context
    assert c.context.startswith("[Fuente 1] Ley 5/2020 - Consejo\nGaceta Oficial No. 9 | 03 Marzo, 2021 | GOC-1 | Pags. 3-4\nSeccion: ARTÍCULO 1\n---\nxxxx")
    assert rag.context(f, rag.ContextOptions(max_chars=10)).first().n_sources == 1  # the first always enters
    assert rag.context(f, rag.ContextOptions(include_metadata=False)).first().context.startswith("[Fuente 1] Ley 5/2020 - Consejo\n---\n")


def test_context_per_norm(spark):
    f = spark.createDataFrame([row(1, norma="a"), row(2, norma="a"), row(3, norma="b", year="invalid", page_start=7, page_end=7, gaceta_numero=None)], FRAGMENT)
    c = rag.context(f, rag.ContextOptions(deduplicate_by_norma=True)).first()
    assert c.n_sources == 2 and "[Fuente 3]" not in c.context and "[Fuente 2] Ley 5/0 - Consejo\n03 Marzo, 2021 | GOC-1 | Pag. 7" in c.context


def test_typed(spark):
    f = rag.typed(spark.createDataFrame([(1, 1, None)], "query_id int, rank int, content string")).first()
    assert (f.year, f.page_start, f.page_end, f.tipo, f.content) == (0, -1, -1, "", "")


def test_citations(spark):
    a = spark.createDataFrame([(1, "Según [Fuente 2] y [fuente  9], [Fuente 2].", 3), (2, "nada", 0)], "query_id long, answer string, n_retrieved int")
    got = {r.query_id: (r.valid, r.invalid, r.uncited) for r in rag.citations(a).collect()}
    assert got == {1: ([2], [9], [1, 3]), 2: ([], [], [])}
    f = spark.createDataFrame([row(1, goc_code=""), row(2), row(3, page_start=0)], FRAGMENT)
    text = rag.formatted_answers(a, f).first().formatted
    assert text == (
        "Según [Fuente 2] y [fuente  9], [Fuente 2].\n\n---\n**Fuentes Consultadas**\n\n**[Fuente 2]** Ley 5/2020\n  *Consejo*\n  Gaceta Oficial No. 9, 03 Marzo, 2021 | GOC-1 | Pags. 3-4\n\n"
        "**Otras fuentes recuperadas:**\n- Ley 5/2020\n- Ley 5/2020 (GOC-1)\n"
    )
    assert rag.sources_list(f).first().sources.split("\n")[1] == "[Fuente 2] Ley 5/2020 — Consejo"


def test_answers(spark):
    f = spark.createDataFrame([row(1)], FRAGMENT)
    q = spark.createDataFrame([(1, "qué ley"), (2, "sin fuentes"), (3, None)], "query_id long, text string")
    asked = []
    got = {r.query_id: r for r in rag.answers(q, f, rag.get_generator("echo")).collect()}
    assert got[1].answer == "qué ley [Fuente 1] y [fuente 99]" and got[2].answer == got[3].answer == rag.NO_SOURCES and not asked
    log = {r.query_id: r for r in rag.interaction_log(rag.answers(q, f, rag.echo), f, "bm25", "echo").collect()}
    assert log[1].sources == ["Ley 5/2020 (GOC-1)"] and log[1].retrieved_docs[0].fragment_id == "f1" and log[2].sources == [] and log[2].retrieved_docs == []
    m = spark.range(1).select(rag.messages(F.lit("¿q?"), F.lit("ctx"), "otro sistema").alias("m")).first().m
    assert [x.role for x in m] == ["system", "user"] and m[0].content == "otro sistema" and "ctx" in m[1].content and "Pregunta: ¿q?" in m[1].content
    with pytest.raises(ValueError):
        rag.get_generator("other")


def test_store(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, fragment_id string, rank int")
    found, missing = rag.get_fragments(r, spark.createDataFrame([("c", "x"), ("a", "y")], "fragment_id string, content string"))
    assert sorted((x.fragment_id, x["rank"]) for x in found.collect()) == [("a", 1), ("c", 2)] and [x.fragment_id for x in missing.collect()] == ["b"]
