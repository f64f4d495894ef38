from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators import adaptive, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dates_and_numbers(spark):
    date = lambda s: tuple(one(spark, T.gazette_date(F.lit(s))))
    assert date("03 Marzo, 2026") == (2026, 3, 3)
    assert date("invalid") == (0, 0, 0)
    assert [one(spark, T.normalize_numero(F.lit(s))) for s in ("8/2026", "08", "003", "X-144")] == ["8", "8", "3", "x-144"]


def test_boundaries_and_pages(spark):
    c = spark.createDataFrame([("g", 1, "aaaa", 0), ("g", 2, "bbbb", 1)], "g string, page int, content string, pos int")
    r = structure.concatenated(c, "g", "page", "content", "pos").first()
    assert r.text == "aaaa\nbbbb" and [tuple(b) for b in r.boundaries] == [(0, 1), (5, 2)]
    b = F.expr("array(named_struct('offset',0,'page',1),named_struct('offset',100,'page',2),named_struct('offset',200,'page',3))")
    assert [one(spark, structure.page_of(b, F.lit(x))) for x in (50, 150, 250, 100)] == [1, 2, 3, 2]


def test_windows(spark):
    words = " ".join(f"palabra{i}" for i in range(900))
    w = one(spark, T.windows(F.lit(words)))
    assert len(w) == 3 and w[1].text.split()[0] == "palabra320" and w[-1].text.split()[-1] == "palabra899"


def test_merge_small_blocks(spark):
    f = lambda *x: one(spark, T.merged_blocks(F.array(*map(F.lit, x))))
    assert f(50, 60, 100, 20) == [110, 120]
    assert f(440, 20) == [440, 20] and f(10) == [10]


def test_query_rules(spark):
    kind, sure = adaptive.rule_type()
    q = spark.createDataFrame([("Decreto-Ley 114 de 2025 sobre asociaciones",), ("en qué año se estableció el reglamento de comercio exterior",), ("licencia",), ("protección del medio ambiente en Cuba",)], "text string")
    got = adaptive.signals(q).select(kind, sure).collect()
    assert [tuple(r) for r in got] == [("referencia_exacta", 0.9), ("temporal_historica", 0.9), ("ambigua", 0.7), ("semantica", 0.55)]


def test_greedy_match(spark):
    left = spark.createDataFrame([(1, "ley", "1", 1), (1, "ley", "2", 2), (1, "acuerdo", "3", 3), (2, "ley", "5", 4), (2, "ley", "9", 5), (3, None, None, 6)], "g int, kind string, number string, lid int")
    right = spark.createDataFrame([(1, "ley", "1", 10), (1, "ley", "s/n", 11), (2, "ley", "7", 12), (3, "ley", "7", 13)], "g int, kind string, number string, rid int")
    got = {r.lid: (r.rid, r.phase) for r in structure.greedy_match(left, right, "g", "kind", "number", "lid", "rid").collect()}
    # an identity with another number is not taken by kind
    assert got == {1: (10, "high"), 2: (11, "medium"), 3: (None, "none"), 4: (None, "none"), 5: (None, "none"), 6: (13, "low")}


def test_entry_without_llm(tmp_path):
    """The entry module imports and answers where the language-model parts are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "lexquarry", tmp_path / "lexquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_retrieval' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_repeated_candidates(spark):
    """References that ask the same meet norms that are alike as one: right counts, and no lists of candidates."""
    norms = spark.createDataFrame([(i, i % 2, "o" + str(i % 3), ["w" + str(i % 3)]) for i in range(90)] + [(100, 7, "o1", ["w9"]), (101, 8, "o1", ["a"]), (102, 8, "o2", ["b"])], "norm_id long, key int, org string, words array<string>")
    refs = spark.createDataFrame([(i, 0, ["w1"], "o1") for i in range(50)] + [(60, 1, ["no"], "o2"), (61, 7, ["x"], None), (62, 8, ["x"], "o2"), (63, 9, ["x"], "o2"), (64, None, None, None)], "ref_id long, key int, org_words array<string>, source_org string")
    got = structure.resolve(refs, norms, ["key"], "words")
    want = {i: (4, "fuzzy") for i in range(50)} | {60: (None, "ambiguous"), 61: (100, "exact"), 62: (102, "source_org"), 63: (None, "unresolved"), 64: (None, "unresolved")}
    assert {r.ref_id: (r.norm_id, r.confidence) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
