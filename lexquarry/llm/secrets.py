"""Operator 5: secret scans with a random forest that removes false positives, in DataFrame functions only.

A candidate is a run of 16 or more characters of `[A-Za-z0-9_+/-]` with a digit in it, a signed web token, or whatever is assigned (`=` or `:`) to a
name like a secret's, up to white space, a quote or one of `` `<>,; ``, of any length and characters. Its features are its length, the
changes between kinds of characters, the share that a dictionary covers (the corpus's `DICTIONARY` most frequent words, counted over all
documents, and pieces of ordinary words), its shares of digits, capitals, distinct
characters and symbols, whether it is hexadecimal, all digits or has a known prefix, what its path and its own word look like, and what
its neighbouring words say. The forest is trained on the driver from labelled findings (a bounded table, `FINDINGS` rows,
generated by rule; their features come from the same expressions) and becomes one SQL expression, so that a document is
scanned within its row: no Python, no shuffle and no explosion before the verdicts.

Null and empty texts have no findings; a null doc_id or source is kept as null; repeated rows give their findings each;
a candidate that repeats in a text is a finding at each place. Whole texts are scanned, and long ones within their row.
Columns of other names pass through `redact` unchanged.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.common import fresh

SPACE = r"[\x20\x09-\x0D]+"
CANDIDATE = r"[A-Za-z0-9_+/\-]{16,}"
#: A signed web token, or a run with a digit.
WITH_DIGIT = r"(?:eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}|(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{16,})"
#: A name like a secret's and what assigns to it; then the value.
ASSIGN = r"(?i:token|secret|passw|pwd|api|key|auth|bearer|credential|access)[A-Za-z0-9_.\-]*[\"']?[\x20\x09-\x0D]*[:=]+[\x20\x09-\x0D]*[\"']?"
VALUE = r"([^\x20\x09-\x0D\"'`<>,;]*[^\x20\x09-\x0D\"'`<>,;:=.)\]}])"
MASK = "[SECRET]"
FINDINGS = 3000
TREES, DEPTH, LEAF = 15, 6, 4
CUT = 0.5
DICTIONARY = 1000
#: Pieces of ordinary words; what they cover is unlikely to be random.
PIECES = (
    "tion ment ness able ible ance ence ship hood less ward wise ling ology graph phone photo micro inter under trans super "
    "the and for with from that this have will your about which their there would could other into more some time than "
    "example sample test demo dummy value string number index image style class function return import object array list "
    "version update release build system service server client user admin name file path page content message window "
    "language project company business public private personal general national international information product market"
).split()
GOOD = r"(?i)(token|secret|passw|pwd|api|key|auth|bearer|credential|access)"
BAD = r"(?i)(sha|commit|md5|hash|digest|checksum|uuid|guid|etag|version|phone|tel|card|isbn|order|invoice|example|sample|dummy|placeholder|test|revision|blob)"
PREFIX = r"^(AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abp]-|sk_live_|eyJ[A-Za-z0-9_-]{10,})"
NAMES = ("length", "changes", "covered", "digits", "capitals", "distinct", "hex", "numeric", "prefix", "pathlike", "assigned", "quoted", "good", "bad", "bad_path", "symbols", "code")


def number(c: Column) -> Column:
    return c.cast("double")


def dictionary(docs: DataFrame, n: int = DICTIONARY) -> tuple[str, ...]:
    """The n most frequent words of 4 to 12 small letters in all documents (of equally frequent ones the first by name)."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?<![A-Za-z0-9_])[a-z]{4,12}(?![A-Za-z0-9_])"), F.lit(0))).alias("w"))
    return tuple(r.w for r in words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n).collect())


def features(core: Column, word: Column, before: Column, after: Column, path: Column, words: tuple[str, ...] = ()) -> list[Column]:
    """`NAMES` as doubles. before: up to three words before; after: the next word; path: where the text is from; words: the dictionary. All not null."""
    n = F.length(core)
    count = lambda p: F.length(core) - F.length(F.regexp_replace(core, p, ""))
    changes = F.regexp_count(core, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    covered = F.length(core) - F.length(F.regexp_replace(F.lower(core), "|".join(sorted({*PIECES, *words}, key=lambda w: (-len(w), w))), ""))
    near = F.concat_ws(" ", before, F.call_function("substring_index", word, core, F.lit(1)))
    return [
        number(n), changes / n, covered / n, count("[0-9]") / n, count("[A-Z]") / n, F.size(F.array_distinct(F.split(core, ""))) / n,
        number(core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), number(core.rlike("^[0-9_+/\\-]+$")), number(core.rlike(PREFIX)),
        number(word.rlike(r"(://|/[^/]+/|@|\\|\.[a-z]{2,4}\b)")), number(F.concat(before, F.call_function("substring_index", word, core, F.lit(1))).rlike(r"[:=]\s*[\"']?$")),
        number(word.rlike("[\"']")), number(near.rlike(GOOD)), number(F.concat_ws(" ", near, after).rlike(BAD)), number(path.rlike(r"(?i)(test|fixture|example|lock|vendor|docs?/)")),
        F.length(F.regexp_replace(core, r"[A-Za-z0-9_+/\-]", "")) / n, number(core.rlike(r"[(){}\[\]$*]|\.[A-Za-z_]+[.(\[]|^(self|os|config|env)\.|://")),
    ]


# ---------------------------------------------------------------- labelled findings


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, str, str, int]]:
    """(core, word, before, after, path, label): findings of known kinds as reviewers label them."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, upper, alnum = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    plain = lambda: "".join(r.choice("the an er on re ing st ion en ou at ha es un de le ci ar ch ie au".split()) for _ in range(r.randint(1, 4)))
    out = []
    for i in range(n):
        before, after, path, word = f"{plain()} {plain()} {plain()}", plain(), r.choice(["src", "app/config.py", "blog", "wiki", "forum", "mail"]), None
        secret = i % 2 == 0
        if secret:
            kind = r.randrange(7)
            core = [lambda: "AKIA" + pick(upper, 16), lambda: pick(hexa, r.choice([32, 40, 64])), lambda: "ghp_" + pick(alnum, 36), lambda: pick(hexa, r.randint(16, 24)), lambda: pick(alnum + "+/", r.randint(20, 44)), lambda: pick(alnum, r.randint(16, 40)), lambda: f"eyJ{pick(alnum, r.randint(15, 33))}.eyJ{pick(alnum + '-_', r.randint(20, 60))}.{pick(alnum + '-_', r.randint(22, 43))}"][kind]()
            if kind not in (0, 2, 6) or r.random() < 0.3:
                name = r.choice(["token", "secret", "password", "api_key", "apikey", "auth", "passwd", "access_key", "bearer", "pwd"])
                style = r.randrange(4)
                if style == 0:
                    word = f"{name}={core}"
                elif style == 1:
                    before, word = f"{plain()} {name} =", f'"{core}"'
                elif style == 2:
                    before, word = f"{plain()} {plain()} {name}:", core
                else:
                    word = f"{name}='{core}'"
        else:
            kind = r.randrange(8)
            if kind == 0:
                core, before = pick(hexa, r.choice([32, 40, 64])), f"{plain()} {r.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'revision', 'digest'])} {r.choice(['', ':', '=', 'is'])}".strip()
            elif kind == 1:
                u = pick(hexa, 32)
                core, before = f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", f"{plain()} {plain()} {r.choice(['uuid', 'id', 'guid', plain()])}"
            elif kind == 2:
                core = r.choice(["3", "4", "5"]) + pick("0123456789", r.choice([15, 15, 17]))
                before = f"{plain()} {plain()} {r.choice(['card', 'order', plain(), plain()])}"
            elif kind == 3:
                core = "-".join(r.choice(PIECES) for _ in range(r.randint(3, 5))) + "-" + pick("0123456789", r.randint(1, 4))
                word = f"https://example.com/{core}"
            elif kind == 4:
                core = "_".join(r.choice(PIECES) for _ in range(r.randint(3, 5))) + str(r.randint(1, 99))
            elif kind == 5:
                core, path = "/".join(r.choice(PIECES) for _ in range(r.randint(3, 5))) + f"/v{r.randint(1, 9)}", "docs/readme"
            elif kind == 6:
                core, path = pick(hexa, r.choice([32, 40])), r.choice(["tests/fixture.txt", "package.lock", "vendor/list"])
                word = r.choice([core, f"example={core}"])
            else:
                core = (plain() + plain() + plain() + plain() + plain() + plain())[: r.randint(18, 30)].ljust(17, "e") + str(r.randint(1, 99))
            core = core.ljust(16, "0")
            word = word.replace(word.split("/")[-1] if kind == 3 else core, core) if word else None
        out.append((core, word or r.choice([core, core, core + ".", core + ","]), before, after, path, int(secret)))
    return out


def labelled_assignments(n: int = FINDINGS // 2, seed: int = 6) -> list[tuple[str, str, str, str, str, int]]:
    """The same of short, digitless or broken values that are assigned to a name like a secret's."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice("the an er on re ing st ion en ou at ha es un de le ci ar ch ie au".split()) for _ in range(r.randint(1, 4)))
    letters, digits, marks = string.ascii_letters, string.digits, "!@#%&*?.^+=~-_"
    some = lambda: r.choice([word, lambda: r.choice(PIECES)])()
    good = [
        lambda: some() + pick(digits, r.randint(2, 4)), lambda: some().capitalize() + pick(digits, r.randint(1, 4)) + r.choice("!@#?&%"), lambda: pick(letters + digits, r.randint(7, 15)), lambda: pick(letters, r.randint(8, 24)),
        lambda: pick(letters + digits, r.randint(4, 8)) + r.choice(marks) + pick(letters + digits + marks, r.randint(2, 8)) + pick(letters + digits, 1), lambda: some() + r.choice("!@.#%&") + some() + pick(digits, r.randint(0, 2)), lambda: pick("0123456789abcdef", r.randint(8, 15)),
    ]
    bad = [
        word, lambda: r.choice(PIECES), lambda: r.choice("string str none None null true false True False int bytes required optional text hidden public private read write each any all yes no".split()), lambda: pick(digits, r.randint(1, 3)),
        lambda: f"your_{r.choice(['password', 'token', 'key', 'secret'])}", lambda: r.choice("x*.") * r.randint(3, 8) + "x", lambda: f"${{{some().upper()}_{r.choice(['KEY', 'TOKEN'])}", lambda: f"{r.choice(['self', 'config', 'os.environ', 'settings'])}.{some()}",
        lambda: f"get_{some()}(", lambda: f"{some()}-{some()}", lambda: f"{some()}_{some()}", lambda: f"<{some()}"[1:], lambda: some().capitalize(),
    ]
    out = []
    for i in range(n):
        core, name = r.choice(good if i % 2 == 0 else bad)(), r.choice("token secret password api_key apikey auth passwd access_key bearer pwd db_password key access credential".split())
        before, value, style = f"{word()} {word()} {word()}", core, r.randrange(4)
        if style == 0:
            value = f"{name}={core}"
        elif style == 1:
            before, value = f"{word()} {name} =", f'"{core}"'
        elif style == 2:
            before = f"{word()} {word()} {name}:"
        else:
            value = f"{name}='{core}'"
        out.append((core, value, before, word(), r.choice(["src", "app/config.py", "blog", "wiki", "forum", "mail"]), 1 - i % 2))
    return out


# ---------------------------------------------------------------- the forest


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree: a probability, or (feature, threshold, below or equal, above)."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = (0.0, None, None)
    base = y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], size=5, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= LEAF) & (len(y) - k >= LEAF)]
        if len(k):
            left, right = t[k - 1] / k, (t[-1] - t[k - 1]) / (len(y) - k)
            gain = base - (k * left * (1 - left) + (len(y) - k) * right * (1 - right)) / len(y)
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-12:
                best = (float(gain[j]), int(f), float((v[k[j]] + v[k[j] - 1]) / 2))
    if best[1] is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], rng))
    return out


def expression(tree, values: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(values[f] <= t, expression(low, values)).otherwise(expression(high, values))


def probability(trees: list, values: list[Column]) -> Column:
    total = expression(trees[0], values)
    for t in trees[1:]:
        total = total + expression(t, values)
    return total / float(len(trees))


_forests: dict[tuple, list] = {}


def trained(spark: SparkSession, words: tuple[str, ...] = (), n: int = FINDINGS, seed: int = 5) -> list:
    """The forest for a dictionary, from the labelled findings; features come from the engine's own expressions."""
    if (words, n, seed) not in _forests:
        rows = labelled_findings(n, seed) + labelled_assignments(n // 2, seed + 1)
        table = spark.createDataFrame(rows, "core string, word string, before string, after string, path string, label int").coalesce(1)
        made = table.select("label", *(f.alias(c) for c, f in zip(NAMES, features(*map(F.col, ("core", "word", "before", "after", "path")), words), strict=True))).collect()
        data = np.array([[float(v) for v in r] for r in made])
        _forests[words, n, seed] = forest(data[:, 1:], data[:, 0])
    return _forests[words, n, seed]


def model(docs: DataFrame) -> tuple[list, tuple[str, ...]]:
    """(forest, dictionary) for a corpus."""
    words = dictionary(docs)
    return trained(docs.sparkSession, words), words


# ---------------------------------------------------------------- scanning


def scanned(docs: DataFrame, trees: list, words_of: tuple[str, ...] = (), path: str = "source", to: str = "findings") -> DataFrame:
    """`docs` with the column `to`: array of (word_index, core, score), an empty array where there is nothing."""
    text = F.coalesce("text", F.lit(""))
    where = F.coalesce(F.col(path), F.lit("")) if path in docs.columns else F.lit("")
    words = F.split(text, SPACE)
    word_at = lambda ws, i: F.coalesce(F.try_element_at(ws, i), F.lit(""))  # noqa: E731  1-based

    def of_word(ws: Column, i: Column) -> Column:
        word = F.element_at(ws, i + 1)
        before = F.concat_ws(" ", *(F.when(i >= k, word_at(ws, F.greatest(i + 1 - k, F.lit(1)))).otherwise("") for k in (3, 2, 1)))
        runs = F.regexp_extract_all(word, F.lit(WITH_DIGIT), F.lit(0))
        given = F.regexp_extract_all(word, F.lit(ASSIGN + VALUE), F.lit(1))
        first = F.when(before.rlike(ASSIGN + "$"), F.regexp_extract(word, r"^[\"']?" + VALUE, 1)).otherwise("")
        cores = F.concat(runs, F.filter(F.concat(given, F.array(first)), lambda c: (c != "") & ~F.array_contains(runs, c)))
        return F.transform(
            cores,
            lambda core: F.struct(i.alias("word_index"), core.alias("core"), F.array(*features(core, word, before, word_at(ws, i + 2), where, words_of)).alias("f")),
        )

    def all_of(ws: Column) -> Column:
        indices = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.element_at(ws, i + 1).rlike(f"{WITH_DIGIT}|{ASSIGN}") | word_at(ws, F.greatest(i, F.lit(1))).rlike("[:=][\"']?$"))
        return F.flatten(F.transform(indices, lambda i: of_word(ws, i)))

    def judged(found: Column) -> Column:
        return F.transform(found, lambda c: F.struct(c["word_index"].alias("word_index"), c["core"].alias("core"), probability(trees, [c["f"][j] for j in range(len(NAMES))]).alias("score")))

    nothing = F.expr("cast(array() as array<struct<word_index: int, core: string, score: double>>)")
    likely = text.rlike("[0-9]") & text.rlike(WITH_DIGIT) | text.rlike(ASSIGN)
    # arrays of one element carry the words and the raw findings, so that each is computed once
    raw = F.flatten(F.transform(F.array(words), all_of))
    return docs.withColumn(to, F.when(likely, judged(raw)).otherwise(nothing))


def findings(docs: DataFrame) -> DataFrame:
    """One row per finding: doc_id, nth (in its text), word_index, finding_length, finding_sha256, score, is_secret."""
    trees, dictionary_ = model(docs)
    columns = ["doc_id", "text"] + (["source"] if "source" in docs.columns else [])
    found = scanned(docs.select(*columns), trees, dictionary_).select("doc_id", F.posexplode("findings").alias("nth", "f"))
    return found.select(
        "doc_id", "nth", F.col("f.word_index").alias("word_index"), F.length("f.core").alias("finding_length"), F.sha2("f.core", 256).alias("finding_sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= CUT).alias("is_secret")
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every secret in the text replaced by MASK; all columns stay. A null text stays null.

    A long run is replaced wherever it stands, another value only where it is assigned.
    """
    trees, dictionary_ = model(docs)
    (own,) = fresh(docs, "findings")
    secrets = F.sort_array(F.array_distinct(F.transform(F.filter(own, lambda c: c["score"] >= CUT), lambda c: F.struct(F.length(c["core"]).alias("n"), c["core"].alias("core")))), False)
    here = lambda core: F.concat(F.lit(f"({ASSIGN})\\Q"), F.replace(core, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9_+/-])"))
    masked = lambda t, core: F.when(core.rlike(f"^{WITH_DIGIT}$"), F.replace(t, core, F.lit(MASK))).otherwise(F.regexp_replace(t, here(core), F.lit(f"$1{MASK}")))
    out = scanned(docs, trees, dictionary_, to=own).withColumn("text", F.aggregate(secrets, F.col("text"), lambda t, s: masked(t, s["core"])))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
