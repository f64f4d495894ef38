"""Structuring: ordered concatenation with page boundaries, as-of pages, duplicates, greedy matching, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import legal as L


def concatenated(chunks: DataFrame, group: str, page: str, content: str, position: str) -> DataFrame:
    """group, text and boundaries (offset, page): contents in page order (null page is 0; ties by position) joined by newlines."""
    rows = chunks.select(F.col(group), F.struct(F.coalesce(page, F.lit(0)).cast("long").alias("page"), F.col(position).cast("long").alias("pos"), F.coalesce(content, F.lit("")).alias("content")).alias("c"))
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<offset:bigint,page:bigint>>)").alias("out"))
    step = lambda a, c: F.struct((a["at"] + F.length(c["content"]) + 1).cast("long").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("offset"), c["page"].alias("page")))).alias("out"))
    return g.select(group, F.array_join(F.transform("cs", lambda c: c["content"]), "\n").alias("text"), F.aggregate("cs", start, step, lambda a: a["out"]).alias("boundaries"))


def page_of(boundaries: Column, offset: Column) -> Column:
    """The page of the last boundary at or before offset; before the first it is the first's, without boundaries 0."""
    found = F.try_element_at(F.filter(boundaries, lambda b: b["offset"] <= offset), F.lit(-1))
    return F.coalesce(found["page"], F.try_element_at(boundaries, F.lit(1))["page"], F.lit(0))


def first_occurrence(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (which must be total)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def superseded(rows: DataFrame, key: str, holder: str, date: Column, position: str) -> DataFrame:
    """key, kept, superseded: of a key's rows the latest by date stays, among equal dates the last by position."""
    w = Window.partitionBy(key).orderBy(date.desc(), F.desc(position))
    all_of = Window.partitionBy(key)
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_of", F.count("*").over(all_of)).where("_of > 1")
    marked = marked.withColumn("kept", F.max(F.when(F.col("_n") == 1, F.col(holder))).over(all_of))
    return marked.where("_n > 1").select(key, "kept", F.col(holder).alias("superseded"))


def without_superseded(rows: DataFrame, gone: DataFrame, key: str, holder: str) -> DataFrame:
    """Anti-join on (key, holder); null holders are never excluded."""
    return rows.join(gone.where(F.col("superseded").isNotNull()).select(F.col(key), F.col("superseded").alias(holder)), [key, holder], "left_anti")


def greedy_match(left: DataFrame, right: DataFrame, group: str, kind: str, number: str, lid: str, rid: str, unnumbered: str = "s/n") -> DataFrame:
    """One-to-one assignment of segments (left) to identities (right) in order of ids: group, lid, rid, phase (null rid: unmatched).

    By (kind, number) where the segment has a kind (`high`); then, among the rest, an identity without a number goes by kind alone
    (`medium`); then by place where as many segments as identities are left in a group (`low`); else `none`. Each phase takes the
    first of both sides that is still free, so equal keys are numbered on both sides and meet on the number: windows over the
    union of both sides decide a phase, and no side is read again or joined to itself.
    """
    side = lambda d, i, s: d.select(F.col(group).alias("g"), F.col(kind).alias("kind"), F.col(number).alias("number"), F.col(i).alias("id"), F.lit(s).alias("side"))
    rows = side(left, lid, 0).unionByName(side(right, rid, 1)).withColumn("to", F.lit(None).cast(left.schema[lid].dataType)).withColumn("phase", F.lit("none"))

    def phase(rows: DataFrame, keys: list[str], takes, name: str, counts: bool = False) -> DataFrame:
        free = (F.col("phase") == "none") & takes
        rows = rows.withColumn("free", free)
        nth = Window.partitionBy(*keys, "free", "side").orderBy("id")
        rows = rows.withColumn("nth", F.when(F.col("free"), F.row_number().over(nth)))
        pair = Window.partitionBy(*keys, "free", "nth")
        other = F.when(F.col("side") == 0, F.max(F.when(F.col("side") == 1, F.col("id"))).over(pair)).otherwise(F.max(F.when(F.col("side") == 0, F.col("id"))).over(pair))
        met = F.col("free") & F.col("other").isNotNull()
        if counts:
            n = lambda s: F.count_if(F.col("free") & (F.col("side") == s)).over(Window.partitionBy(*keys))
            rows = rows.withColumn("as_many", n(0) == n(1))
            met = met & F.col("as_many")
        rows = rows.withColumn("other", other)
        return rows.withColumn("to", F.when(met, F.col("other")).otherwise(F.col("to"))).withColumn("phase", F.when(met, name).otherwise(F.col("phase"))).select("g", "kind", "number", "id", "side", "to", "phase")

    known, bare = F.col("kind").isNotNull(), (F.col("side") == 0) | F.col("number").eqNullSafe(F.lit(unnumbered))
    rows = phase(rows, ["g", "kind", "number"], known & F.col("number").isNotNull(), "high")
    rows = phase(rows, ["g", "kind"], known & bare, "medium")
    rows = phase(rows, ["g"], F.lit(True), "low", counts=True)
    return rows.where("side = 0").select(F.col("g").alias(group), F.col("id").alias(lid), F.col("to").alias(rid), "phase")


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared words over the smaller set's, of two arrays of words; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def resolve(references: DataFrame, norms: DataFrame, keys: list[str], words: str, least: float = 0.6) -> DataFrame:
    """Left equi join of references on `keys`, then tiers: one candidate is exact; a named organism that fits one or more takes the
    first (fuzzy); one of the source's own organism (source_org); several left is ambiguous; none is unresolved.

    references: ref_id, keys, org_words, source_org; norms: norm_id, org, keys, `words` (array). Repeated norm rows are candidates each.

    References that ask the same are resolved once, against one row for the norms that share keys, org and words: what meets grows with
    the different of both, and no list of candidates is made.
    """
    like = F.struct("norm_id", "org", "_w")
    some = norms.select(*keys, "norm_id", "org", F.col(words).alias("_w")).where("norm_id is not null")
    some = some.groupBy(*keys, "org", "_w").agg(F.count("*").alias("n"), F.min("norm_id").alias("norm_id"))
    asks = [*keys, "org_words", "source_org"]
    rows = references.select(*asks).distinct().join(some, keys, "left")
    fuzzy, own = overlap_coefficient(F.col("_w"), F.col("org_words")) >= least, F.col("org") == F.col("source_org")
    first = lambda test: F.min(F.when(test, like))["norm_id"]
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    here = F.col("norm_id").isNotNull()
    g = rows.groupBy(*asks).agg(count(here).alias("n"), first(here).alias("lone"), first(here & fuzzy).alias("fuzzy"), count(here & own).alias("own_n"), first(here & own).alias("own"))
    n = F.col("n")
    tier = F.when(n == 0, "unresolved").when(n == 1, "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").when(F.col("own_n") == 1, "source_org").otherwise("ambiguous")
    to = F.when(n == 1, F.col("lone")).when(n > 1, F.coalesce("fuzzy", F.when(F.col("own_n") == 1, F.col("own"))))
    answers = g.select(*(F.col(k).alias(f"_{k}") for k in asks), to.alias("norm_id"), tier.alias("confidence"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in asks]
    return references.join(answers, same).select("ref_id", "norm_id", "confidence")


def segments(texts: DataFrame, group: str, text: str, boundaries: str) -> DataFrame:
    """group, ordinal, goc_code, text, page_start, page_end: a text cut where its codes stand, each code's first place counts (whatever its case);
    codes in parentheses belong to a summary. Texts without codes give no row."""
    found = texts.select(group, F.col(text).alias("t"), F.col(boundaries).alias("b"), L.codes(F.col(text)).alias("cs"))
    first = F.filter("cs", lambda c, i: ~F.exists(F.slice("cs", 1, i), lambda e: F.upper(e["code"]) == F.upper(c["code"])))
    rows = found.withColumn("cs", first).select(group, "t", "b", "cs", F.posexplode("cs").alias("ordinal", "c"))
    end = F.coalesce(F.try_element_at("cs", F.col("ordinal") + 2)["at"], F.length("t"))
    piece = F.trim(F.regexp_replace(F.call_function("substring", "t", F.col("c.at") + 1, end - F.col("c.at")), r"(?U)^\s+|\s+$", ""))
    return rows.select(group, "ordinal", F.col("c.code").alias("goc_code"), piece.alias("text"), page_of(F.col("b"), F.col("c.at")).alias("page_start"), page_of(F.col("b"), end - 1).alias("page_end"))


def summary_text(text: Column) -> Column:
    """What stands before the first code that is not in parentheses; the whole text without one."""
    at = F.try_element_at(L.codes(text), F.lit(1))["at"]
    return F.when(at.isNull(), text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), at), r"(?U)^\s+|\s+$", ""))


def first_of_group(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The columns of each group's first row."""
    return rows.groupBy(group).agg(F.min_by(F.struct(*columns), order).alias("r")).select(group, "r.*")


def grouping_key(checksum: Column, numero: Column, fecha: Column) -> Column:
    """The checksum, else `numero_fecha`; null where a row has none of the three, so that it can be left out."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.when(blank(checksum) != "", checksum).when((blank(numero) != "") | (blank(fecha) != ""), F.concat_ws("_", blank(numero), blank(fecha)))
