"""Text functions as column expressions, and the few that need Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal terms that are kept although they are function-like, Spanish function words, months.
LEGAL_TERMS = ("ley", "decreto", "artículo", "inciso", "apartado", "resolución", "ordenanza", "disposición", "reglamento", "norma", "código", "constitución", "derecho", "deber", "obligación", "responsabilidad")
STOP_WORDS = ("a", "al", "and", "con", "de", "del", "el", "en", "es", "for", "in", "is", "la", "las", "los", "of", "on", "para", "por", "que", "se", "su", "the", "to", "un", "una", "with", "y")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
ACCENTED, PLAIN = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # runs that are one blank stay as they are


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://[^ \t\n]+|www\.[^ \t\n]+", "")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^ \t\n\r\f\x0B]+"))


def normalize_numero(c: Column) -> Column:
    """`8/2026` and `08` become `8`, `X - 6` becomes `x-6`; `s/n` stays."""
    head = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)\s*-\s*", "-"), r"/\d{4}$", "")
    return F.when(head.rlike(r"^\d+$"), F.regexp_replace(head, r"^0+(?=\d)", "")).otherwise(head)


def normalize_tipo(c: Column) -> Column:
    return strip_accents(F.lower(squeeze(F.regexp_replace(c, "-", " "))))


NOT_TOKEN = r"[^\p{L}\p{N}]+"
DROPPED = tuple(w for w in STOP_WORDS if w not in LEGAL_TERMS)


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric words of more than a letter, without function words but with legal terms and numbers."""
    return F.filter(F.split(F.lower(c), NOT_TOKEN), lambda w: (F.length(w) > 1) & ~w.isin(*DROPPED))


def gazette_date(c: Column) -> Column:
    """`DD Month, YYYY` as struct<y,m,d>, (0,0,0) where it does not parse: such a date is the oldest."""
    day, month, year = (F.regexp_extract(c, r"^\s*(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})", i) for i in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("int")
    ok = (day != "") & (number > 0)
    part = lambda x: F.when(ok, x.cast("int")).otherwise(0)
    return F.struct(part(F.nullif(year, F.lit(""))).alias("y"), part(number).alias("m"), part(F.nullif(day, F.lit(""))).alias("d"))


def safe_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fragment_id(norma: Column, checksum: Column, code: Column, index: Column) -> Column:
    return F.concat_ws("__", norma, F.substring(checksum, 1, 12), code, F.concat(F.lit("f"), F.lpad(index.cast("string"), 3, "0")))


#: Phrases of each relation.
RELATIONS = {
    "deroga": r"(?iu)se\s+derog[aó]|queda[n]?\s+derogad[oa]s?|dejar\s+sin\s+efecto|deja[n]?\s+sin\s+efecto|queda\s+sin\s+efecto|sin\s+vigor",
    "modifica": r"(?iu)se\s+modific[aó]|queda[n]?\s+modificad[oa]s?|se\s+adicion[aó]n?|se\s+sustituye[n]?|se\s+reemplaz[aó]|se\s+suprim[eó]|queda[n]?\s+redactad[oa]s?",
    "complementa": r"(?iu)complement[aó]r?|en\s+lo\s+que\s+complementa",
}


def relation_type(context: Column) -> Column:
    """The first relation that the context names, else menciona."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in RELATIONS.items():
        out = out.when(context.rlike(pattern), name)
    return out.otherwise("menciona")


#: How every phrase of a relation begins, and what it has in it, in small letters: cheap to look for.
BEGINS = {"deroga": ("se", "queda", "deja", "sin"), "modifica": ("se", "queda"), "complementa": ("complement", "en")}
STEMS = {"deroga": ("derog", "efecto", "vigor"), "modifica": ("modific", "adicion", "sustituye", "reemplaz", "suprim", "redactad"), "complementa": ("complement",)}
_relations = {name: re.compile(pattern.replace("(?iu)", "(?i)").replace(r"\s", r"[ \t\n\x0b\f\r]")) for name, pattern in RELATIONS.items()}


def small_letters(text: str) -> str | None:
    """The text in small letters; None where a letter has no small one of its own length, or a pattern takes it for another letter."""
    small = text.lower()
    return small if len(small) == len(text) and "ı" not in small and "ſ" not in small else None


def places(small: str, begins: tuple[str, ...], start: int, end: int) -> list[int]:
    """Where one of `begins` stands from start up to end, in order."""
    found = []
    for word in begins:
        at = small.find(word, start, end)
        while at >= 0:
            found.append(at)
            at = small.find(word, at + 1, end)
    return sorted(found)


def relation_of(text: str, small: str | None, start: int, end: int) -> str:
    """`relation_type` of text[start:end] in Python; small: `small_letters` of the text."""
    for name, pattern in _relations.items():
        if small is None:
            found = pattern.search(text, start, end)
        else:
            found = any(small.find(stem, start, end) >= 0 for stem in STEMS[name]) and any(pattern.match(text, at, end) for at in places(small, BEGINS[name], start, end))
        if found:
            return name
    return "menciona"


def windows(c: Column, size: int = 380, overlap: int = 60) -> Column:
    """Word windows as array<struct<part,text>>: a step of size - overlap, the last is the first that reaches the end."""
    words = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    step, n = size - overlap, F.size(words)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step).cast("int"))
    return F.when(n == 0, F.expr("cast(array() as array<struct<part:int,text:string>>)")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("part"), F.array_join(F.slice(words, i * step + 1, F.lit(size)), " ").alias("text")))
    )


def merged_blocks(sizes: Column, small: int = 80, most: int = 450) -> Column:
    """Blocks below `small` words join what follows; a small rest at the end joins the block before if both stay within `most`."""
    empty = F.struct(F.expr("cast(array() as array<int>)").alias("done"), F.lit(0).alias("open"))

    def step(acc, size):
        total = acc["open"] + size
        return F.when(total < small, F.struct(acc["done"].alias("done"), total.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(total)).alias("done"), F.lit(0).alias("open")))

    def finish(acc):
        last = F.try_element_at(acc["done"], F.lit(-1))
        joins = (F.size(acc["done"]) > 0) & (last + acc["open"] <= most)
        head = F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0)))
        return F.when(acc["open"] == 0, acc["done"]).when(joins, F.concat(head, F.array(last + acc["open"]))).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(sizes, empty, step, finish)
