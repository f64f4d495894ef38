"""Names, headers, references and their resolution, fragments and cleaning, on the cases that the specification lists."""

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import legal as L
from lexquarry.functions import text as T
from lexquarry.operators import cleaning, fragments, linking, structure

NORMS = "id long, norm_id string, tipo string, numero string, year int, organismo string, goc_code string, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Decreto Ley 114 de 2025 de Consejo de Estado", ("Decreto Ley", "114", 2025, "Consejo de Estado", "decreto_ley_114_2025_consejo_de_estado")),
        ("Decreto-Ley  114 de 2025  de Consejo de Estado", ("Decreto Ley", "114", 2025, "Consejo de Estado", "decreto_ley_114_2025_consejo_de_estado")),
        ("Constitución de 2019 de Asamblea Nacional del Poder Popular", ("Constitución", "s/n", 2019, "Asamblea Nacional del Poder Popular", "constitucion_s-n_2019_asamblea_nacional_del_poder_popular")),
        ("Proclama S/N de 2026 de Consejo de Estado", ("Proclama", "S/N", 2026, "Consejo de Estado", "proclama_s-n_2026_consejo_de_estado")),
        ("ACUERDO X - 6 de 2020 de Órgano", ("ACUERDO", "X - 6", 2020, "Órgano", "acuerdo_x - 6_2020_organo")),
    ],
)
def test_names(spark, name, want):
    p = L.parse_norm_name(F.lit(name))
    r = spark.range(1).select(p.alias("p"), L.norm_id(p).alias("i")).first()
    assert (r.p.tipo, r.p.numero, r.p.year, r.p.organismo, r.i) == want and r.p.raw == name.strip()


def test_no_names(spark):
    assert all(one(spark, L.parse_norm_name(F.lit(s))) is None for s in ("", "  ", "una frase", "Ley sin datos", "Ley 5 de 20 de X"))
    assert one(spark, L.parse_norm_name(F.lit(None).cast("string"))) is None


def test_headers(spark):
    h = lambda s: (lambda x: x and tuple(x))(one(spark, L.header_identity(F.lit(s))))
    assert h("ACUERDO X-144 DE 2025") == ("Acuerdo", "X-144")
    assert h("Firmante\nHAGO SABER:\nRESOLUCION No. 41/2026 dispone") == ("Resolucion", "41")
    assert h('DECRETO-LEY 114 "DE LA ASOCIACION"') == ("Decreto Ley", "114")
    assert h("nada aqui") is None and h("x" * 1500 + " LEY 5 DE 2020") is None
    assert [one(spark, T.normalize_numero(F.lit(s))) for s in ("8/2026", "08", "003", "X-144", "s/n", "X - 6")] == ["8", "8", "3", "x-144", "s/n", "x-6"]
    assert one(spark, T.normalize_tipo(F.lit("Decreto-Ley  Única"))) == "decreto ley unica"


def test_issuers(spark):
    same = lambda a, b: one(spark, L.same_issuer(L.issuer_words(F.lit(a)), L.issuer_words(F.lit(b))))
    assert same("ministra de Finanzas y Precios", "Ministerio de Finanzas y Precios")
    assert not same("Ministerio de Salud", "Consejo de Estado") and not same("", "Consejo") and not same("de la", "Consejo")


def references(spark, text, norm_id="x"):
    return linking.extract_references(spark.createDataFrame([(1, norm_id, "Ley", "1", 2020, "Consejo", "", text)], NORMS))


def test_references(spark):
    r = references(spark, "DISPOSICIONES FINALES. Se deroga la Resolución No. 41 de 2026 del Ministerio de Finanzas y Precios, y nada más.").collect()
    assert [(x.tipo_norm, x.numero, x.year, x.organismo, x.relation_type) for x in r] == [("resolucion", "41", 2026, "Ministerio de Finanzas y Precios", "deroga")]
    r = references(spark, "Vista la Ley 7 de 2020, y otra vez la Ley 07 de 2020; el Decreto-Ley 3 de 5 de mayo de 2019.").collect()
    assert sorted((x.tipo_norm, x.numero, x.year, x.relation_type) for x in r) == [("decreto ley", "3", 2019, "menciona"), ("ley", "7", 2020, "menciona")]
    assert references(spark, "La Ley 7 de 2020.", "ley_7_2020_consejo").count() == 0
    assert references(spark, None).count() == 0 and references(spark, "").count() == 0


def test_loose_references(spark):
    n = spark.createDataFrame([(1, "x", "Ley", "1", 2020, "C", "", "Se derogan los Acuerdos 5204 y 5209. Aquí el artículo 9."), (2, "y", "Ley", "2", 2020, "C", "", "la Ley 177 rige"), (3, "z", "Ley", "3", 2020, "C", "", "Se modifica la Ley 177 de 2020.")], NORMS)
    dated = linking.extract_references(n)
    r = linking.extract_loose(n, dated).collect()
    assert sorted((x.source, x.tipo_norm, x.numero, x.relation_type) for x in r) == [("x", "acuerdos", "5204", "deroga"), ("x", "acuerdos", "5209", "deroga")]


def test_references_are_read_in_one_pass(spark):
    """Both sorts by one Python pass, which keeps the first of each key itself; what `places` finds is what the patterns find."""
    text = "Se modifica la Ley 7, la Ley 07 de 2020, y la Ley 7 de 2020. Queda derogado el instruccıón 5."
    m = linking.mentions(spark.createDataFrame([(1, "x", "Ley", "1", 2020, "C", "", text)], NORMS))
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Window" not in plan
    rows = [(x.loose, x.tipo_norm, x.numero, x.year, x.relation_type) for x in m.orderBy("seq").collect()]
    assert rows == [(False, "ley", "7", 2020, "deroga"), (True, "ley", "7", None, "deroga"), (True, "instruccıon", "5", None, "deroga")]
    for t in ("Quedan derogados", "SE MODIFICÓ", "en lo  que complementa", "deja sin efecto", "sin vigor", "nada", "se adicionan", "ſe deroga"):
        assert T.relation_of(t, T.small_letters(t), 0, len(t)) == one(spark, T.relation_type(F.lit(t))), t
    for t in ("Decreto-Ley", "Resolución Conjunta", "INSTRUCCIÓN", "Ley"):
        assert L._plain_tipo(t) == one(spark, T.normalize_tipo(F.lit(t)))
    for t in ("08", "8/2026", "X-144", "s/n", "000", "0/2020", "12/20201"):
        assert L._plain_numero(t) == one(spark, T.normalize_numero(F.lit(t)))


def test_resolution(spark):
    rows = [
        (1, "resolucion_41_2026_finanzas", "Resolución", "41", 2026, "Ministerio de Finanzas", "G1", ""),
        (2, "resolucion_41_2025_salud", "Resolución", "41", 2025, "Ministerio de Salud", "G2", ""),
        (3, "resolucion_41_2025_cultura", "Resolución", "041", 2025, "Instituto de Cultura", "G3", ""),
        (4, "ley_177_2020_anpp", "Ley", "177", 2020, "Asamblea", "G4", "Se deroga la Resolución 41 de 2026, y la Resolución 41 de 2025 del Instituto de Cultura, así como la Resolución 9 de 2000. Se modifica el Decreto 5."),
        (5, "decreto_5_2020_salud", "Decreto", "5", 2020, "Ministerio de Salud", "G5", "Queda derogada la Resolución 41 de 2025, sin más. Se modifica la Ley 177."),
        (6, "acuerdo_1_2020_otro", "Acuerdo", "1", 2020, "Otro", "G6", "Queda derogada la Resolución 41 de 2025, sin más."),
    ]
    n = spark.createDataFrame(rows, NORMS)
    linked = linking.link_all(n)
    got = sorted((x.source[:3], x.tipo_norm, x.numero, x.year or 0, x.confidence, x.target) for x in linked.collect())
    assert got == [
        ("acu", "resolucion", "41", 2025, "ambiguous", None),
        ("dec", "ley", "177", 0, "exact_loose", "ley_177_2020_anpp"),
        ("dec", "resolucion", "177", 0, "unresolved", None),  # the number after "y" anywhere in the window continues a list, that of "Ley" too
        ("dec", "resolucion", "41", 2025, "source_org", "resolucion_41_2025_salud"),
        ("ley", "decreto", "5", 0, "exact_loose", "decreto_5_2020_salud"),
        ("ley", "resolucion", "41", 2025, "fuzzy", "resolucion_41_2025_cultura"),
        ("ley", "resolucion", "41", 2026, "exact", "resolucion_41_2026_finanzas"),
        ("ley", "resolucion", "9", 2000, "unresolved", None),
    ]
    assert tuple(linking.counters(linked).first()) == (8, 5, 1, 2)
    r = {(x.source_goc_code, x.target_goc_code, x.relation_type) for x in linking.relationships(linked, n).collect()}
    assert ("G4", "G1", "deroga") in r and ("G5", "G4", "deroga") in r and len(r) == 5
    # a norm in two gazettes is two candidates
    twice = spark.createDataFrame([*rows, (7, *rows[0][1:])], NORMS)
    assert [x.confidence for x in linking.link_all(twice).where("numero = '41' and year = 2026").collect()] == ["ambiguous"]


def test_resolution_of_repeated_norms(spark):
    """Norms that share a key and references that ask the same count as one each where candidates meet."""
    text = "Queda derogada la Resolución 41 de 2025, sin más. Se modifica el Acuerdo 3."
    rows = [(i, f"resolucion_41_2025_{i % 3}", "Resolución", "41", 2025, f"Ministerio {'abc'[i % 3]}x", f"G{i}", "") for i in range(600)]
    rows += [(1000 + i, "decreto_5_2020_bx", "Decreto", "5", 2020, "Ministerio bx", "", text) for i in range(300)]
    n = spark.createDataFrame([*rows, (2000, "acuerdo_3_2020_cx", "Acuerdo", "3", 2020, "Consejo cx", "A", "")], NORMS)
    index = linking.build_index(n)
    assert sorted((x.norm_id, x.n, x.row, x.goc_code) for x in index.collect()) == [("acuerdo_3_2020_cx", 1, 2000, "A"), ("decreto_5_2020_bx", 300, 1000, "")] + [(f"resolucion_41_2025_{i}", 200, i, f"G{597 + i}") for i in range(3)]
    linked = linking.link_all(n, index)
    assert {(r.tipo_norm, r.confidence, r.target, r["count"]) for r in linked.groupBy("tipo_norm", "confidence", "target").count().collect()} == {("resolucion", "ambiguous", None, 300), ("acuerdo", "exact_loose", "acuerdo_3_2020_cx", 300)}
    assert "collect_list" not in linked._jdf.queryExecution().optimizedPlan().toString()


def test_segments(spark):
    text = "SUMARIO (GOC-2026-1-O1) .. ( GOC-2026-2-O1 )\nGOC-2026-1-O1 uno\nvea goc-2026-1-o1\nGOC-2026-2-EX5 dos "
    b = "array(named_struct('offset', 0L, 'page', 1L), named_struct('offset', 45L, 'page', 2L), named_struct('offset', 80L, 'page', 3L))"
    t = spark.createDataFrame([("g", text), ("h", "sin codigos")], "g string, text string").withColumn("b", F.expr(b))
    got = [tuple(r) for r in structure.segments(t, "g", "text", "b").orderBy("ordinal").collect()]
    assert [x[1:4] for x in got] == [(0, "GOC-2026-1-O1", "GOC-2026-1-O1 uno\nvea goc-2026-1-o1"), (1, "GOC-2026-2-EX5", "GOC-2026-2-EX5 dos")]
    assert got[0][4:] == (2, 3) and got[1][4:] == (3, 3)
    assert [r.s for r in t.select(structure.summary_text(F.col("text")).alias("s")).collect()] == ["SUMARIO (GOC-2026-1-O1) .. ( GOC-2026-2-O1 )", "sin codigos"]


def test_split(spark):
    split = lambda s: [tuple(x) for x in one(spark, L.split_norm(F.lit(s)))]
    words = lambda n, p="w": " ".join(f"{p}{i}" for i in range(n))
    assert split("") == [] and split(" corto  texto ") == [("Norma completa", "corto texto")]
    long = split("ARTÍCULO 1. " + " ".join(f"palabra{i}" for i in range(900)))
    assert len(long) == 3 and long[1][0] == "ARTÍCULO 1 parte 2" and "palabra320 " in long[1][1] and long[-1][1].endswith("palabra899")
    two = split(f"ARTÍCULO 1. {words(240)}. ARTÍCULO 2. {words(240, 'v')}.")
    assert [x[0] for x in two] == ["ARTÍCULO 1", "ARTÍCULO 2"]
    small = split(f"Texto. CAPÍTULO I {words(30)}. ARTÍCULO 1. {words(430, 'v')}. ANEXO fin.")
    # the chapter waits for the article, whose text then is too long for the annex
    assert [x[0] for x in small][:1] == ["CAPÍTULO I parte 1"] and small[-1][0] == "ANEXO fin".split()[0] + " fin"


def test_texts_are_split_once(spark):
    """No filter on the parts is made, which would split every text a second time."""
    n = spark.createDataFrame([("a b",)], "text string").select(F.posexplode(L.split_norm(F.col("text"))))
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and "Filter" not in plan and n.count() == 1


def test_fragment_ids(spark):
    n = spark.createDataFrame([(1, "resolucion_1_2026_ministerio_test", "Resolución", "1", 2026, "Ministerio Test", "GOC-2026-001-O1", "Texto.", 5, 1), (2, "ley_2_2026_x", "Ley", "2", 2026, "X", None, "Otro.", 6, 7)], NORMS + ", gaceta_id long, ordinal_position int")
    for c in ("page_start", "page_end"):
        n = n.withColumn(c, F.lit(None).cast("int"))
    n = n.withColumn("match_confidence", F.lit(None).cast("string")).withColumn("raw_metadata_string", F.lit(None).cast("string"))
    g = spark.createDataFrame([(5, "1", "f", "O", "u", "abcdef1234567890"), (6, "2", None, "O", "u", "")], "id long, numero string, fecha string, tipo_edicion string, pdf_url string, checksum string")
    rows = {r.metadata.norma_id: r for r in fragments.build_fragments(fragments.norm_rows(n, g)).collect()}
    assert rows["resolucion_1_2026_ministerio_test"].fragment_id == "resolucion_1_2026_ministerio_test__abcdef123456__GOC-2026-001-O1__f000"
    assert rows["ley_2_2026_x"].fragment_id.endswith("__ord007__f000") and rows["ley_2_2026_x"].metadata.page_start == -1 and len(rows["ley_2_2026_x"].metadata) == 30
    assert rows["ley_2_2026_x"].content == "Ley 2 de 2026 - X. Norma completa. Otro." and rows["ley_2_2026_x"].cleaned_content == "ley 2 de 2026 - x. norma completa. otro."
    gone = spark.createDataFrame([("ley_2_2026_x", 6), ("otra", None)], "norm_id string, superseded long")
    assert fragments.build_fragments(fragments.norm_rows(n, g, gone)).count() == 1


def test_cleaning(spark):
    clean = lambda s, kind="CompositeElement": one(spark, cleaning.cleaned(F.lit(s), F.lit(kind)))
    assert clean("Vea el Art. 5 y el Inciso b) del Decreto-Ley No. 15/2020 {hoy} ~ en https://x.cu/a o a@b.cu fin") == "vea el art. 5 y el inciso b) del decreto-ley no. 15/2020 hoy en o fin"
    assert clean("Página 12\n  15 \n___\nGaceta Oficial No. 3 Ordinaria de 4 de mayo de 2020\nTexto\xa0 ﬁnal") == "texto final"
    assert clean("POR   CUANTO : {se} dispone") == "por cuanto: {se} dispone"  # a header keeps its marks
    assert clean("Tabla  ~  Ley 5", "Table") == "Tabla ~ __legal_ref_0__"
    assert clean("  ") == "" and clean(None) == ""
    e = spark.createDataFrame([("corto", "x"), ("un texto que basta", None), (None, "x")], "content string, type string")
    assert [r.cleaned_content for r in cleaning.clean_documents(e).collect()] == ["un texto que basta"]


def test_cleaning_makes_every_step_once(spark):
    e = spark.createDataFrame([("Vea el Art. 5 {x} de hoy", "x"), ("sin nada a@b.cu que guardar : aquí", None)], "content string, type string").repartition(1)
    out = cleaning.clean_documents(e)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(https?://") == 1 and plan.count("_nfkc(") == 1 and plan.index("Filter") < plan.index("_nfkc(")
    one_by_one = e.select("content", cleaning.cleaned(F.col("content"), F.lit("x")).alias("c"))
    assert out.columns == ["content", "type", "cleaned_content"] and {(r.content, r.cleaned_content) for r in out.collect()} == {tuple(r) for r in one_by_one.collect()}


def test_cleaning_of_what_patterns_need(spark):
    """Digits of other scripts, letters that count as i, a colon without a digit, a word that has @ twice."""
    clean = lambda s: one(spark, cleaning.cleaned(F.lit(s), F.lit("x")))
    assert clean("El artículo ٣ {y} el İnciso b) ~ rigen") == "el artículo ٣ y el " + "İnciso b)".lower() + " rigen"
    assert clean("Teléfonos: - \n POR CUANTO : se dispone {z}") == "por cuanto: se dispone {z}" and clean("uno x@y@z dos@ @tres fin") == "uno fin"


def test_unicode(spark):
    assert one(spark, L.unaccented(F.lit("Órgano ÀÈ ñ ø"))) == "Organo AE n ø" and one(spark, L.nfkc(F.lit("ﬁ ½"))) == "fi 1⁄2"
    assert one(spark, L.unaccented(F.lit(None).cast("string"))) is None
    assert one(spark, L.dispositions(F.lit("texto DISPOSICION FINAL y fin"))) == "DISPOSICION FINAL y fin" and one(spark, L.dispositions(F.lit("nada"))) is None
