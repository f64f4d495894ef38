"""Structuring, linking, fragments and cleaning on whole tables, with the SQL that checks them.

The tables hold no legal texts, so orders stand in for norms and customers for gazettes: names, headers, codes and references are
written from their columns, and the SQL says from the columns alone what must be found in the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import legal as L
from lexquarry.functions import text as T
from lexquarry.operators import cleaning, fragments, linking, reports, structure
from lexquarry.plans import store
from lexquarry.sources.readers import spread, table

KINDS = ("Resolución", "Acuerdo", "Decreto Ley", "Ley", "Instrucción")
CAPITALS = ("RESOLUCIÓN", "ACUERDO", "DECRETO-LEY", "LEY", "INSTRUCCIÓN")
SLUGS = ("resolucion", "acuerdo", "decreto ley", "ley", "instruccion")


def _sql(names: tuple[str, ...], of: str = "k") -> str:
    return f"CASE {of} % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


NUMBER = "CASE WHEN k % 11 = 0 THEN 's/n' ELSE CAST(k % 400 AS STRING) END"
_PAD = "repeat('x ', 150)"
TEXT = f"""concat({_sql(CAPITALS)}, ' ', numero, '/', year, ' cuerpo. ', {_PAD}, 'DISPOSICIONES FINALES. Se deroga la Resolución No. ', (k + 5) % 400, ' de ', 2000 + (k + 5) % 3, ' del Consejo de NATION_', k % 25,
 ', con efecto. ', {_PAD}, 'Queda modificado el Acuerdo ', (k * 7) % 400, ' por esta norma. ', {_PAD}, 'Se cita la ', tipo, ' ', numero, ' de ', year, ', y nada más.')"""


def orders(spark, d) -> DataFrame:
    return spread(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("gaceta_id")))


def norms(spark, d, text: str = TEXT) -> DataFrame:
    rows = orders(spark, d).withColumn("tipo", F.expr(_sql(KINDS))).withColumn("numero", F.expr(NUMBER)).withColumn("year", F.expr("cast(2000 + k % 3 as int)")).withColumn("organismo", F.expr("concat('Consejo de NATION_', gaceta_id % 25)"))
    rows = rows.withColumn("goc_code", F.expr("concat('GOC-', year, '-', k, '-O', k % 30)")).withColumn("text", F.expr(text)).withColumnRenamed("k", "id")
    return rows.withColumn("norm_id", L.norm_id(F.struct("tipo", "numero", "year", "organismo")))


def gazettes(spark, d) -> DataFrame:
    months = F.array(*map(F.lit, (m.capitalize() for m in T.MONTHS)))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    fecha = F.concat(F.format_string("%02d", F.expr("1 + id % 28")), F.lit(" "), F.element_at(months, F.expr("cast(1 + id % 12 as int)")), F.lit(", "), F.expr("2000 + id % 7"))
    return c.select(
        "id", F.expr("cast(id % 90 as string)").alias("numero"), fecha.alias("fecha"), F.expr("if(id % 2 = 0, 'Ordinaria', 'Extraordinaria')").alias("tipo_edicion"), F.expr("concat('https://gacetas.example/', id)").alias("pdf_url"),
        F.when(F.col("id") % 7 == 0, "").otherwise(F.md5("c_name")).alias("checksum"),
    )


# ---------------------------------------------------------------- queries


def names(spark, d) -> DataFrame:
    """Names and headers are written and parsed again."""
    rows = norms(spark, d).withColumn("name", F.concat("tipo", F.lit("  "), "numero", F.lit(" de "), "year", F.lit(" de "), "organismo")).withColumn("p", L.parse_norm_name(F.col("name"))).withColumn("h", L.header_identity(F.col("text")))
    key = L.reference_key(F.col("p.tipo"), F.col("p.numero"), F.col("p.year"))
    return rows.select("id", "p.tipo", "p.numero", "p.year", "p.organismo", L.norm_id(F.col("p")).alias("norm_id"), F.col("h.tipo").alias("header_tipo"), F.col("h.numero").alias("header_numero"), key["tipo"].alias("key_tipo"))


def chunks(spark, d) -> DataFrame:
    """A gazette's pages: a summary on page 0, then a norm on each."""
    body = f"concat('GOC-', 2000 + k % 3, '-', k, '-O', k % 30, '\n', {_sql(CAPITALS)}, ' ', {NUMBER}, '/', 2000 + k % 3, ' texto de la norma ', k)"
    rows = orders(spark, d).select("gaceta_id", F.expr("k % 50 + 1").alias("page"), F.col("k").alias("pos"), F.expr(body).alias("content"))
    heads = rows.select("gaceta_id").distinct().selectExpr("gaceta_id", "0L as page", "-1L as pos", "concat('SUMARIO (GOC-2020-1-O1) y ( GOC-2020-2-O2 ) de ', gaceta_id) as content")
    return rows.unionByName(heads)


def segmented(spark, d) -> DataFrame:
    texts = structure.concatenated(chunks(spark, d), "gaceta_id", "page", "content", "pos")
    return structure.segments(texts, "gaceta_id", "text", "boundaries").select("gaceta_id", "ordinal", "goc_code", F.md5("text").alias("digest"), "page_start", "page_end")


def summaries(spark, d) -> DataFrame:
    texts = structure.concatenated(chunks(spark, d), "gaceta_id", "page", "content", "pos")
    first = structure.first_of_group(chunks(spark, d).where("page > 0"), "gaceta_id", "pos", ["pos"])
    return texts.join(first, "gaceta_id").select("gaceta_id", structure.summary_text(F.col("text")).alias("summary"), F.col("pos").alias("first_norm"))


LEFT = "CASE WHEN k % 19 = 0 THEN NULL ELSE {kind} END AS kind, CASE WHEN k % 19 = 0 THEN NULL ELSE CAST(k % 400 AS STRING) END AS number, k AS lid"
RIGHT = "{kind} AS kind, CASE WHEN k % 13 = 0 THEN 's/n' ELSE CAST((k + CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END) % 400 AS STRING) END AS number, k AS rid"


def greedy(spark, d) -> DataFrame:
    """A gazette's segments and the identities that its index names: some without a number, some with another one, some missing."""
    o = orders(spark, d)
    left = o.selectExpr("gaceta_id AS g", *LEFT.format(kind=_sql(SLUGS)).replace(", CASE", "\x00CASE").replace(", k AS", "\x00k AS").split("\x00"))
    right = o.where("k % 17 <> 0").selectExpr("gaceta_id AS g", *RIGHT.format(kind=_sql(SLUGS)).replace(", CASE", "\x00CASE").replace(", k AS", "\x00k AS").split("\x00"))
    return structure.greedy_match(left, right, "g", "kind", "number", "lid", "rid")


def mentioned(spark, d) -> DataFrame:
    """What the norms' texts mention, read from them by the first query that needs it."""
    made = lambda: linking.mentions(norms(spark, d), context=False).drop("at", "tipo", "context")
    return store.kept(spark, "mentions", [f"{d}/orders.parquet"], made)


def extracted(spark, d) -> DataFrame:
    return linking.dated_of(mentioned(spark, d)).select(F.col("source_row").alias("id"), "tipo_norm", "numero", "year", "organismo", "relation_type", "raw")


def extracted_loose(spark, d) -> DataFrame:
    m = mentioned(spark, d)
    return linking.loose_of(m, linking.dated_of(m)).select(F.col("source_row").alias("id"), "tipo_norm", "numero", "relation_type", "raw")


def index_of(spark, d) -> DataFrame:
    """The norms by key and id, built by the first query that needs them."""
    return store.kept(spark, "norms", [f"{d}/orders.parquet"], lambda: linking.build_index(norms(spark, d)))


def links(spark, d) -> DataFrame:
    return linking.link_all(norms(spark, d), index_of(spark, d), mentioned(spark, d))


def linked(spark, d) -> DataFrame:
    return links(spark, d).select(F.col("source_row").alias("id"), "source", "tipo_norm", "numero", "year", "confidence", "target")


def relations(spark, d) -> DataFrame:
    return linking.relationships(links(spark, d), index_of(spark, d))


def link_counts(spark, d) -> DataFrame:
    return linking.counters(links(spark, d))


def link_histogram(spark, d) -> DataFrame:
    return reports.histogram(links(spark, d), "confidence").select("confidence", "n", "position")


def dispositions(spark, d) -> DataFrame:
    return norms(spark, d).select("id", F.md5(L.dispositions(F.col("text"))).alias("digest"))


_WORDS = "array_join(transform(sequence(0, {n}), i -> concat('{p}', i)), ' ')"
LONG = f"""CASE k % 3 WHEN 0 THEN concat('Texto  breve de la norma ', k) WHEN 1 THEN concat('inicio ', {_WORDS.format(n=498, p='v')}, ' fin') ELSE
 concat('Preambulo texto. ARTÍCULO 1. ', {_WORDS.format(n=99, p='a')}, '. ARTÍCULO 2. ', {_WORDS.format(n=399, p='b')}, '. ARTÍCULO 3: ', {_WORDS.format(n=19, p='c')}, '.') END"""


def superseded(spark, d) -> DataFrame:
    """Of the gazettes that have one norm, the latest keeps it."""
    n = norms(spark, d).select("norm_id", "gaceta_id", F.col("id").alias("pos")).join(gazettes(spark, d).select(F.col("id").alias("gaceta_id"), "fecha"), "gaceta_id")
    return structure.superseded(n, "norm_id", "gaceta_id", T.gazette_date(F.col("fecha")), "pos")


def fragment_rows(spark, d) -> DataFrame:
    rows = norms(spark, d).drop("text").withColumn("ordinal_position", F.expr("cast(id % 1000 as int)")).withColumn("goc_code", F.expr("if(id % 4 = 0, '', goc_code)"))
    rows = rows.withColumns({"page_start": F.expr("if(id % 2 = 0, cast(id % 60 as int), null)"), "page_end": F.lit(None).cast("int"), "match_confidence": F.lit("high"), "raw_metadata_string": F.lit(None).cast("string")})
    rows = fragments.norm_rows(rows, gazettes(spark, d), superseded(spark, d))
    return fragments.build_fragments(rows.withColumn("text", F.expr(re.sub(r"\bk\b", "id", LONG))))  # texts are written where they are split, none is shuffled


def fragment_digests(spark, d) -> DataFrame:
    m = lambda *xs: [F.col(f"metadata.{x}") for x in xs]
    return fragment_rows(spark, d).select("fragment_id", F.md5("content").alias("digest"), F.md5("cleaned_content").alias("clean_digest"), *m("norma_id", "fragment_index", "fragment_total", "fragment_label", "page_number", "page_end", "year", "gaceta_numero", "gaceta_fecha", "gaceta_checksum_12", "ordinal_position", "raw_metadata_string"))


def unaccented(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(L.unaccented(F.col("text"))).alias("digest"))


NOISE = "Gaceta Oficial No. 12 Ordinaria de 3 de marzo de 2021\nPágina 7\n  15  \nTeléfonos: 7 878-4435\nGOC-2021-12-EX5\n____\nPOR  CUANTO : el correo a@b.cu y https://x.cu/y dicen {~}\n"


def elements(spark, d) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    noisy = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(NOISE), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return docs.select("doc_id", noisy.alias("content"), F.expr("if(doc_id % 10 = 0, 'Table', 'CompositeElement')").alias("type"))


def cleaned(spark, d) -> DataFrame:
    return cleaning.clean_documents(elements(spark, d)).select("doc_id", "type", F.md5("cleaned_content").alias("digest"))


def queries() -> dict:
    return {
        "norm_names": names,
        "goc_segments": segmented,
        "gazette_summaries": summaries,
        "greedy_match": greedy,
        "extract_references": extracted,
        "extract_loose_references": extracted_loose,
        "link_resolution": linked,
        "norm_relationships": relations,
        "linking_counters": link_counts,
        "linking_histogram": link_histogram,
        "dispositions_section": dispositions,
        "norm_fragments": fragment_digests,
        "clean_elements": cleaned,
        "strip_accents": unaccented,
    }


# ---------------------------------------------------------------- SQL


def _cast(x: str) -> str:
    return x.replace("STRING", "VARCHAR")


_N = f"""n AS (SELECT k AS id, c AS gaceta_id, {_sql(KINDS)} AS tipo, {_sql(SLUGS)} AS slug, {_sql(CAPITALS)} AS caps, {_cast(NUMBER)} AS numero, CAST(2000 + k % 3 AS INTEGER) AS year, 'Consejo de NATION_' || (c % 25) AS organismo,
 'GOC-' || (2000 + k % 3) || '-' || k || '-O' || (k % 30) AS goc_code,
 replace({_sql(SLUGS)}, ' ', '_') || '_' || replace({_cast(NUMBER)}, '/', '-') || '_' || (2000 + k % 3) || '_consejo_de_nation' || (c % 25) AS norm_id FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))"""
# what the texts name: the repealed resolution, an agreement without a year, and the norm itself where it has no number
_DATED = """SELECT id, norm_id AS source, organismo AS own, 0 AS seq, 'resolucion' AS tipo_norm, CAST((id + 5) % 400 AS VARCHAR) AS numero, CAST(2000 + (id + 5) % 3 AS INTEGER) AS year, 'Consejo de NATION_' || (id % 25) AS organismo, 'deroga' AS relation_type,
 'Resolución No. ' || ((id + 5) % 400) || ' de ' || (2000 + (id + 5) % 3) || ' del Consejo de NATION_' || (id % 25) AS raw FROM n
 UNION ALL SELECT id, norm_id, organismo, 1, slug, 's/n', year, NULL, 'menciona', tipo || ' s/n de ' || year FROM n WHERE numero = 's/n'"""
_LOOSE = "SELECT id, norm_id AS source, organismo AS own, 'acuerdo' AS tipo_norm, CAST((id * 7) % 400 AS VARCHAR) AS numero, 'modifica' AS relation_type, 'Acuerdo ' || ((id * 7) % 400) AS raw FROM n"
_LINKED = f"""{_N}, dated AS ({_DATED}), loose AS ({_LOOSE}),
cd AS (SELECT d.id, d.seq, any_value(d.source) AS source, any_value(d.tipo_norm) AS tipo_norm, any_value(d.numero) AS numero, any_value(d.year) AS year, any_value(d.relation_type) AS relation_type, any_value(d.raw) AS raw, count(n.id) AS cands, min(n.norm_id) AS lone,
  min_by(n.norm_id, n.id) FILTER (n.organismo = d.organismo) AS fuzzy, count(n.id) FILTER (n.organismo = d.own) AS own_n, min(n.norm_id) FILTER (n.organismo = d.own) AS own_id
  FROM dated d LEFT JOIN n ON n.slug = d.tipo_norm AND n.numero = d.numero AND n.year = d.year GROUP BY d.id, d.seq),
cl AS (SELECT d.id, any_value(d.source) AS source, any_value(d.tipo_norm) AS tipo_norm, any_value(d.numero) AS numero, any_value(d.relation_type) AS relation_type, any_value(d.raw) AS raw, count(n.id) AS cands, min(n.norm_id) AS lone, count(n.id) FILTER (n.organismo = d.own) AS own_n, min(n.norm_id) FILTER (n.organismo = d.own) AS own_id
  FROM loose d LEFT JOIN n ON n.slug = d.tipo_norm AND n.numero = d.numero AND n.norm_id <> d.source GROUP BY d.id),
lk AS (SELECT id, source, tipo_norm, numero, year, relation_type, raw, CASE WHEN cands = 0 THEN 'unresolved' WHEN cands = 1 THEN 'exact' WHEN fuzzy IS NOT NULL THEN 'fuzzy' WHEN own_n = 1 THEN 'source_org' ELSE 'ambiguous' END AS confidence,
   CASE WHEN cands = 1 THEN lone WHEN cands > 1 AND fuzzy IS NOT NULL THEN fuzzy WHEN cands > 1 AND own_n = 1 THEN own_id END AS target FROM cd
 UNION ALL SELECT id, source, tipo_norm, numero, NULL, relation_type, raw, CASE WHEN cands = 0 THEN 'unresolved' WHEN cands = 1 THEN 'exact_loose' WHEN own_n = 1 THEN 'source_org_loose' ELSE 'ambiguous' END, CASE WHEN cands = 1 THEN lone WHEN cands > 1 AND own_n = 1 THEN own_id END FROM cl)"""
_RESOLVED = ", ".join(f"'{x}'" for x in linking.RESOLVED)
_MONTHS = ", ".join(f"'{m.capitalize()}'" for m in T.MONTHS)
_LIST = lambda n, p: f"array_to_string([('{p}' || i) for i in range({n})], ' ')"
_FRAGMENTS = f"""WITH {_N}, g AS (SELECT c_custkey AS id, CAST(c_custkey % 90 AS VARCHAR) AS numero, printf('%02d', 1 + c_custkey % 28) || ' ' || [{_MONTHS}][1 + c_custkey % 12] || ', ' || (2000 + c_custkey % 7) AS fecha,
  CASE WHEN c_custkey % 2 = 0 THEN 'Ordinaria' ELSE 'Extraordinaria' END AS edition, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE md5(c_name) END AS checksum, (2000 + c_custkey % 7) * 10000 + (1 + c_custkey % 12) * 100 + 1 + c_custkey % 28 AS day FROM customer),
r AS (SELECT n.*, g.numero AS gn, g.fecha AS gf, g.edition, g.checksum, row_number() OVER (PARTITION BY norm_id ORDER BY day DESC, n.id DESC) AS nth FROM n JOIN g ON g.id = n.gaceta_id),
gone AS (SELECT DISTINCT norm_id, gaceta_id FROM r WHERE nth > 1),
s AS (SELECT * FROM r ANTI JOIN gone USING (norm_id, gaceta_id)),
p AS (SELECT *, 0 AS i, 1 AS total, 'Norma completa' AS label, 'Texto breve de la norma ' || id AS t FROM s WHERE id % 3 = 0
 UNION ALL SELECT *, 0, 2, 'Norma completa parte 1', array_to_string((['inicio'] || [('v' || j) for j in range(499)] || ['fin'])[1:380], ' ') FROM s WHERE id % 3 = 1
 UNION ALL SELECT *, 1, 2, 'Norma completa parte 2', array_to_string((['inicio'] || [('v' || j) for j in range(499)] || ['fin'])[321:], ' ') FROM s WHERE id % 3 = 1
 UNION ALL SELECT *, 0, 2, 'ARTÍCULO 1', 'Preambulo texto. ARTÍCULO 1. ' || {_LIST(100, 'a')} || '.' FROM s WHERE id % 3 = 2
 UNION ALL SELECT *, 1, 2, 'ARTÍCULO 2', 'ARTÍCULO 2. ' || {_LIST(400, 'b')} || '. ARTÍCULO 3: ' || {_LIST(20, 'c')} || '.' FROM s WHERE id % 3 = 2),
f AS (SELECT *, CASE WHEN checksum <> '' THEN substr(checksum, 1, 12) ELSE substr(sha1(gn || '|' || gf || '|' || edition), 1, 12) END AS c12, tipo || ' ' || numero || ' de ' || year || ' - ' || organismo || '. ' || label || '. ' || t AS content FROM p)
SELECT replace(norm_id, '/', '_') || '__' || c12 || '__' || CASE WHEN id % 4 = 0 THEN printf('ord%03d', id % 1000) ELSE goc_code END || '__' || printf('f%03d', i) AS fragment_id, md5(content) AS digest, md5(lower(content)) AS clean_digest, norm_id AS norma_id, CAST(i AS INTEGER) AS fragment_index,
  CAST(total AS INTEGER) AS fragment_total, label AS fragment_label, CAST(CASE WHEN id % 2 = 0 THEN id % 60 ELSE -1 END AS INTEGER) AS page_number, CAST(-1 AS INTEGER) AS page_end, year, gn AS gaceta_numero, gf AS gaceta_fecha, c12 AS gaceta_checksum_12, CAST(id % 1000 AS INTEGER) AS ordinal_position, '' AS raw_metadata_string FROM f"""


def _clean_sql() -> str:
    base = "regexp_replace(regexp_replace(content, '(https?://[^\\s]+)|(www\\.[^\\s]+)', '', 'g'), '\\S*@\\S*\\s?', '', 'g')"
    body = "replace(t0, 'GOC-2021-12-EX5', '__legal_ref_0__')"  # what is kept is hidden first
    for p in cleaning.REMOVED:
        body = f"regexp_replace({body}, '(?mi){p}', '', 'g')"
    for p, to in cleaning.REWRITTEN[:4]:
        body = f"regexp_replace({body}, '(?i){p}', '{to}', 'g')"
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    head = " OR ".join(f"regexp_matches(b, '(?i){p}')" for p in (*cleaning.HEADERS[:3], r"^[\p{L}\p{N}_]+(?:\s+[\p{L}\p{N}_]+){0,3}:$"))
    noise = NOISE.replace("\n", "' || chr(10) || '")
    marks = cleaning.PUNCTUATION.replace("'", "''")
    return f"""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{noise}' || coalesce(text, '') ELSE text END AS content, CASE WHEN doc_id % 10 = 0 THEN 'Table' ELSE 'CompositeElement' END AS type FROM documents),
a AS (SELECT *, {base} AS t0 FROM e WHERE trim(coalesce(content, '')) <> ''),
b AS (SELECT *, {squeeze(body)} AS b FROM a),
c AS (SELECT doc_id, type, {squeeze(f"CASE WHEN type = 'Table' THEN replace(t0, 'GOC-2021-12-EX5', '__legal_ref_0__') ELSE lower(replace(CASE WHEN {head} THEN b ELSE regexp_replace(b, '[^{cleaning.WORD_CLASS}\\s{marks}]', '', 'g') END, '__legal_ref_0__', 'GOC-2021-12-EX5')) END")} AS cleaned FROM b)
SELECT doc_id, type, md5(cleaned) AS digest FROM c WHERE length(cleaned) >= 10"""


def oracle_sql() -> dict[str, str]:
    left, right = _cast(LEFT.format(kind=_sql(SLUGS))), _cast(RIGHT.format(kind=_sql(SLUGS)))
    out = {
        "norm_names": f"WITH {_N} SELECT id, tipo, numero, year, organismo, norm_id, tipo AS header_tipo, numero AS header_numero, slug AS key_tipo FROM n",
        "goc_segments": f"""WITH {_N} SELECT gaceta_id, CAST(row_number() OVER (PARTITION BY gaceta_id ORDER BY id % 50, id) - 1 AS INTEGER) AS ordinal, goc_code, md5(goc_code || chr(10) || caps || ' ' || numero || '/' || year || ' texto de la norma ' || id) AS digest, id % 50 + 1 AS page_start, id % 50 + 1 AS page_end FROM n""",
        "gazette_summaries": "SELECT o_custkey AS gaceta_id, 'SUMARIO (GOC-2020-1-O1) y ( GOC-2020-2-O2 ) de ' || o_custkey AS summary, min(o_orderkey) AS first_norm FROM orders GROUP BY o_custkey",
        "greedy_match": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS g FROM orders), l AS (SELECT g, {left} FROM o), r AS (SELECT g, {right} FROM o WHERE k % 17 <> 0),
a AS (SELECT x.g, lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY g, kind, number ORDER BY lid) AS n FROM l WHERE kind IS NOT NULL) x JOIN (SELECT *, row_number() OVER (PARTITION BY g, kind, number ORDER BY rid) AS n FROM r) y USING (g, kind, number, n)),
l1 AS (SELECT * FROM l ANTI JOIN a USING (lid)), r1 AS (SELECT * FROM r ANTI JOIN a USING (rid)),
b AS (SELECT x.g, lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY lid) AS n FROM l1 WHERE kind IS NOT NULL) x JOIN (SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY rid) AS n FROM r1 WHERE number = 's/n') y USING (g, kind, n)),
l2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lid) AS n, count(*) OVER (PARTITION BY g) AS size FROM l1 ANTI JOIN b USING (lid)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rid) AS n, count(*) OVER (PARTITION BY g) AS size FROM r1 ANTI JOIN b USING (rid)),
c AS (SELECT x.g, lid, rid FROM l2 x JOIN r2 y USING (g, n, size))
SELECT g, lid, rid, 'high' AS phase FROM a UNION ALL SELECT g, lid, rid, 'medium' FROM b UNION ALL SELECT g, lid, rid, 'low' FROM c UNION ALL SELECT g, lid, NULL, 'none' FROM l2 ANTI JOIN c USING (lid)""",
        "extract_references": f"WITH {_N} SELECT id, tipo_norm, numero, year, organismo, relation_type, raw FROM ({_DATED})",
        "extract_loose_references": f"WITH {_N} SELECT id, tipo_norm, numero, relation_type, raw FROM ({_LOOSE})",
        "link_resolution": f"WITH {_LINKED} SELECT id, source, tipo_norm, numero, year, confidence, target FROM lk",
        "norm_relationships": f"""WITH {_LINKED}, code AS (SELECT norm_id, max_by(goc_code, id) AS code FROM n GROUP BY norm_id)
SELECT source, target, relation_type, s.code AS source_goc_code, t.code AS target_goc_code, raw AS raw_reference_text, confidence AS resolution_method FROM lk JOIN code s ON s.norm_id = source JOIN code t ON t.norm_id = target WHERE confidence IN ({_RESOLVED})""",
        "linking_counters": f"WITH {_LINKED} SELECT count(*) AS found, count(*) FILTER (confidence IN ({_RESOLVED})) AS resolved, count(*) FILTER (confidence = 'ambiguous') AS ambiguous, count(*) FILTER (confidence = 'unresolved') AS unresolved FROM lk",
        "linking_histogram": f"WITH {_LINKED} SELECT confidence, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, confidence) AS INTEGER) AS position FROM lk GROUP BY confidence",
        "dispositions_section": f"""WITH {_N} SELECT id, md5('DISPOSICIONES FINALES. Se deroga la Resolución No. ' || ((id + 5) % 400) || ' de ' || (2000 + (id + 5) % 3) || ' del Consejo de NATION_' || (id % 25) || ', con efecto. ' || repeat('x ', 150)
 || 'Queda modificado el Acuerdo ' || ((id * 7) % 400) || ' por esta norma. ' || repeat('x ', 150) || 'Se cita la ' || tipo || ' ' || numero || ' de ' || year || ', y nada más.') AS digest FROM n""",
        "norm_fragments": _FRAGMENTS,
        "clean_elements": _clean_sql(),
        "strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents",
    }
    return out
