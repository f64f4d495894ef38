"""Greedy matching against brute force: random groups, and the registered query over a whole table."""

import random

from lexquarry.operators import structure
from lexquarry.plans import registry

SLUGS = ("resolucion", "acuerdo", "decreto ley", "ley", "instruccion")


def brute(left, right):
    """left: (group, kind, number, lid), right: (group, kind, number, rid); every row takes the first that is free, phase by phase."""
    free, out, todo = sorted(right, key=lambda r: r[3]), {}, sorted(left, key=lambda x: x[3])
    fits = (("high", lambda x, r: x[1] is not None and x[2] is not None and x[:3] == r[:3]), ("medium", lambda x, r: x[1] is not None and x[:2] == r[:2] and r[2] == "s/n"))
    for phase, test in fits:
        for x in list(todo):
            if r := next((r for r in free if test(x, r)), None):
                out[x[3]] = (x[0], r[3], phase)
                free.remove(r)
                todo.remove(x)
    for g in {x[0] for x in todo}:
        a, b = [x for x in todo if x[0] == g], [r for r in free if r[0] == g]
        for i, x in enumerate(a):
            out[x[3]] = (g, b[i][3], "low") if len(a) == len(b) else (g, None, "none")
    return out


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.lid for r in rows})
    return {r.lid: (r.g, r.rid, r.phase) for r in rows}


def test_greedy_match_groups(spark):
    r = random.Random(7)
    left = [(r.randrange(12), r.choice(["a", "b", None]), r.choice(["1", "2", "s/n", None]), i) for i in range(60)]
    right = [(r.randrange(12), r.choice("ab"), r.choice(["1", "2", "s/n"]), 100 + i) for i in range(60)]
    s = "g int, kind string, number string, "
    want = brute(left, right)
    assert {p for *_, p in want.values()} == {"high", "medium", "low", "none"}
    assert got(structure.greedy_match(spark.createDataFrame(left, s + "lid int"), spark.createDataFrame(right, s + "rid int"), "g", "kind", "number", "lid", "rid")) == want


def test_greedy_query_takes_every_row(spark, tmp_path):
    r = random.Random(8)
    orders = [(k, r.randrange(40)) for k in range(500)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    left = [(g, None if k % 19 == 0 else SLUGS[k % 5], None if k % 19 == 0 else str(k % 400), k) for k, g in orders]
    right = [(g, SLUGS[k % 5], "s/n" if k % 13 == 0 else str((k + (k % 23 == 0)) % 400), k) for k, g in orders if k % 17]
    want = brute(left, right)
    assert len(want) == 500 and got(registry.queries()["greedy_match"](spark, str(tmp_path))) == want
