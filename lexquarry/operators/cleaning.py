"""The cleaning chain of extracted elements: columns only, legal references are kept as they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions import legal as L
from lexquarry.functions.text import squeeze

# ---------------------------------------------------------------- fixed values: what is kept, what is removed, what is rewritten

KEPT = (
    r"(?:Art[íi]culo|Art\.|ARTÍCULO)\s*\d+[a-z]?|(?:Art[íi]culo|Art\.|ARTÍCULO)\s*\d+\s*(?:bis|ter|quater|quinquies)\b|(?:Art[íi]culo|Art\.|ARTÍCULO)\s*\d+[º°]"
    r"|(?:Inciso|INCISO)\s*[a-z]\)|(?:Apartado|APARTADO)\s*\d+|(?:Ley|LEY)\s*(?:No\.|Número|N[úu]mero)?\s*\d+(?:/\d+)?"
    r"|(?:Decreto|DECRETO)(?:-Ley|-LEY)?\s*(?:No\.|Número)?\s*\d+(?:/\d+)?|(?:Resolución|RESOLUCIÓN)\s*(?:No\.|Número)?\s*\d+(?:/\d+)?|GOC-\d+-\w+-EX\d+"
)
REMOVED = (
    r"Gaceta Oficial No\.\s*\d+.*?de.*?\d{4}",
    r"EXTRAORDINARIA(?:\s+ESPECIAL)?\s+AÑO\s+C\w+",
    r"LA HABANA,.*?\d{4}",
    r"Sitio Web:\s*https?://www\.gacetaoficial\.gob\.cu/?",
    r"Calle Zanja No\.\s*\d+.*?Centro Habana",
    r"Teléfonos:\s*[\d\-\s]+",
    r"^\s*Página\s+\d+\s*$",
    r"^\s*\d+\s*$",
    r"^\s*\[\s*\d+\s*\]\s*$",
    r"^\s*(?:GOC|goc)-\d{4}-(?:o|O|ext?\.?|EX|exe|EXE)\d+[_\d]*\s*$",
    r"^\s*GOC-\d+-\w+-EX\d+\s*$",
    r"^_{3,}$",
    r"^-+$",
)
REWRITTEN = ((r"POR\s+CUANTO\s*:", "POR CUANTO:"), (r"CONSIDERANDO\s*:", "CONSIDERANDO:"), (r"RESUELVO\s*:", "RESUELVO:"), (r"DISPONGO\s*:", "DISPONGO:"), (r"Art[íi]culo\s+(\d+)", "Artículo $1"), (r"Art\.\s*(\d+)", "Artículo $1"))
HEADERS = (r"^(?:LEY|DECRETO|RESOLUCIÓN|ORDENANZA)", r"^(?:ARTÍCULO|CAPÍTULO|SECCIÓN|TÍTULO)", r"^(?:POR CUANTO|CONSIDERANDO|RESUELVO|DISPONGO)", r"^\w+(?:\s+\w+){0,3}:$")
PUNCTUATION = r".,!?;:()\[\]%\-/°ªº_"
WORD_CLASS = r"\p{L}\p{N}_"  # marks of their own are no word characters
LEAST = 10  # characters of a cleaned element

# what must be there for a pattern to match, cheap to look for: what is kept begins so and has a digit or is an Inciso; all other patterns need a
# digit, but for these, which need a colon, and the last, which need neither. Removing makes no character that was not there.
BEGINS = r"(?=(?-iu:[Aa][RrPp]|[Ii\u0130\u0131]|[LlDdRr][Ee]|[Gg][Oo]))"
WITH_COLON, PLAIN = (1, 3, 5, 11, 12), (1, 11, 12)  # of REMOVED
REWRITTEN_WITH_COLON = 4  # the first of REWRITTEN

OPEN, CLOSE = "__legal_ref_", "__"
LINES = "(?iumUd)"  # anchors at every line, and only \n ends one


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(https?://[^\s]+)|(www\.[^\s]+)", "")


def without_emails(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<!\S)\S*@\S*\s?", "")  # a word with @, tried where a word begins


def legal_references(c: Column) -> Column:
    """References in the order in which they stand."""
    found = F.regexp_extract_all(c, F.lit(f"{L.FLAGS}{BEGINS}({KEPT})"), F.lit(1))
    return F.when(c.rlike(r"(?iu)\p{Nd}|inciso"), found).otherwise(F.when(c.isNotNull(), F.expr("cast(array() as array<string>)")))


def masked(c: Column) -> Column:
    """The text with the i-th reference as `__legal_ref_i__`."""
    parts = F.split(c, f"{L.FLAGS}{BEGINS}(?:{KEPT})")
    return F.concat_ws("", F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), i - 1, F.lit(CLOSE), p))))


def unmasked(c: Column, references: Column) -> Column:
    """Each placeholder back as its reference."""
    return F.aggregate(F.transform(references, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), c, lambda t, x: F.replace(t, F.concat(F.lit(OPEN), x["i"], F.lit(CLOSE)), x["r"]))


def without_headers(c: Column, patterns=REMOVED) -> Column:
    """Lines and phrases that a gazette's pages repeat."""
    for p in patterns:
        c = F.regexp_replace(c, LINES + p, "")
    return c


def legal_formatting(c: Column, patterns=REWRITTEN) -> Column:
    for p, to in patterns:
        c = F.regexp_replace(c, L.FLAGS + p, to)
    return c


def standardized(c: Column) -> Column:
    """legal_formatting(without_headers(c)), less the patterns that cannot match. c is taken several times."""
    some = lambda of: [REMOVED[i] for i in of]
    with_colon = legal_formatting(without_headers(c, some(WITH_COLON)), REWRITTEN[:REWRITTEN_WITH_COLON])
    return F.when(c.rlike(r"\p{Nd}"), legal_formatting(without_headers(c))).when(c.contains(":"), with_colon).otherwise(without_headers(c, some(PLAIN)))


def important_header(c: Column) -> Column:
    return L.any_of(*(F.trim(c).rlike(L.FLAGS + p) for p in HEADERS))


def alphanumeric(c: Column, punctuation: str = PUNCTUATION) -> Column:
    return F.regexp_replace(c, rf"(?U)[^{WORD_CLASS}\s{punctuation}]", "")


def without_links(content: Column) -> Column:
    return without_emails(without_urls(F.coalesce(content, F.lit(""))))


def finished(content: Column, kind: Column, hidden: Column, body: Column, references: Column, lemmatize=None) -> Column:
    body = unmasked(F.when(important_header(body), body).otherwise(alphanumeric(body)), references)
    body = lemmatize(body) if lemmatize else F.lower(body)
    return squeeze(F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "").when(kind == "Table", hidden).otherwise(body))


def cleaned(content: Column, kind: Column, lemmatize=None) -> Column:
    """The cleaned text of an element. Tables keep their case, marks and placeholders; other elements lose the gazette's headers, and
    marks unless they are a header themselves. `lemmatize` (column to column) takes the place of lower-casing. Empty text stays empty.
    One expression makes its steps several times: for tables there is `clean_documents`."""
    text = without_links(content)
    hidden = masked(text)
    return finished(content, kind, hidden, squeeze(L.nfkc(standardized(hidden))), legal_references(text), lemmatize)


def clean_documents(elements: DataFrame, content: str = "content", kind: str = "type", least: int = LEAST, lemmatize=None) -> DataFrame:
    """`elements` with cleaned_content, without those whose cleaned text has fewer than `least` characters. Rows have no order.

    Every step is a column of its own, as an expression that takes a step's result twice would have it made twice. _row is there for the
    filter, which does not go below the columns that have it: there it would make all steps again.
    """
    rows = elements.withColumn("_text", without_links(F.col(content))).withColumn("_references", legal_references(F.col("_text")))
    rows = rows.withColumn("_hidden", F.when(F.size("_references") == 0, F.col("_text")).otherwise(masked(F.col("_text")))).withColumn("_body", squeeze(L.nfkc(standardized(F.col("_hidden")))))
    text = finished(F.col(content), F.coalesce(F.col(kind), F.lit("CompositeElement")), F.col("_hidden"), F.col("_body"), F.col("_references"), lemmatize)
    rows = rows.withColumns({"cleaned_content": text, "_row": F.monotonically_increasing_id()})
    return rows.where((F.length(F.trim("cleaned_content")) >= least) & (F.col("_row") >= 0)).drop("_text", "_hidden", "_references", "_body", "_row")
