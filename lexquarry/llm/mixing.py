"""Operator 8: mixing sources to target weights by a low-discrepancy source schedule.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share `share` times all words; a target stops
at `most` times its source's size and the excess is shared again by weight. Slot i of the mix has the
van der Corput point of i (its binary digits mirrored at the point), which the sources' cumulative shares map to a source; a
slot's rank among its source's slots says which of the source's equal-token blocks it takes. Blocks cut the source's documents, shuffled by hash, every
target / slots words; when a pass over the source ends the next begins, so nothing exceeds `most` passes.

Everything is DataFrame operations. Ranks and running sums are made in two steps (within a range of slots or of hash
values, and over the ranges' totals), so a source with a third of all rows is not one task. Only one row per source goes to the
driver, whose number is the number of sources. Reruns agree: order is by hash, then by all columns.

A null text has size 0; documents of size 0 are in no block and take 0. A null source is a source. Rows that repeat are
documents of their own as long as they differ in doc_id or text; rows alike in both share what is taken evenly, as each
has its own place in the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm.common import cut, fresh

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_TOKENS = 4096
RANGE_SLOTS = 1 << 16
RANGES = 1 << 10  # ranges of hash values within a source
SOURCES = 100_000  # a table of more is not forced into a broadcast
DIGITS = 52
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """The documents with their number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(totals: list[tuple], share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> list[float]:
    """Target words of each (source, size), in code point order with null last."""
    order = sorted(range(len(totals)), key=lambda i: (totals[i][0] is None, [ord(c) for c in totals[i][0] or ""]))
    left = share * sum(n for _, n in totals)
    weight = {i: weights[k % len(weights)] for k, i in enumerate(order)}
    out, open_ = [0.0] * len(totals), set(order)
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total >= most * totals[i][1]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = most * totals[i][1]
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def shares(sized: DataFrame, share: float = SHARE, most: float = MOST) -> list[tuple]:
    """(source, size, target) of every source."""
    totals = [(r.source, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    totals.sort(key=lambda t: (t[0] is None, [ord(c) for c in t[0] or ""]))
    return [(s, n, t) for (s, n), t in zip(totals, targets(totals, share, most), strict=True)]


def per_source(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= SOURCES else table


def schedule(spark, n_slots: int, goals: list[float]) -> DataFrame:
    """slot, place (of the source), rank (of the slot among the source's): van der Corput points through cumulative shares.

    A source has the points from its lower edge up to its upper one. Edges and points meet in as many cells of equal width as
    there are sources, so a cell has two sources or so on average, and their number is not bounded by the plan.
    """
    total, run, low, edges = sum(goals), 0.0, 0.0, []
    for place, g in enumerate(goals):
        run += g
        high = run / total if place < len(goals) - 1 else 2.0
        if low < high:
            edges.append((place, low, high))
        low = high
    cells = float(len(goals))
    cell = lambda x: F.floor(F.least(F.col(x), F.lit(1.0)) * cells)
    bounds = spark.createDataFrame(edges, "place int, low double, high double").withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    mirrored = F.conv(F.rpad(F.reverse(F.bin("id")), DIGITS, "0"), 2, 10)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (mirrored.cast("double") / float(1 << DIGITS)).alias("u"))
    slots = slots.withColumn("cell", cell("u")).join(per_source(bounds, len(goals)), "cell").where("low <= u and u < high").select("slot", "place")
    slots = slots.withColumn("range", F.floor(F.col("slot") / RANGE_SLOTS))
    before = slots.groupBy("place", "range").count()
    before = before.select("place", "range", F.coalesce(F.sum("count").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("place", "range").orderBy("slot")
    return slots.withColumn("rank", F.row_number().over(within) - 1).join(before, ["place", "range"]).select("slot", "place", (F.col("rank") + F.col("before")).alias("rank"))




def mix(docs: DataFrame, sized: DataFrame, found: list[tuple], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: slot, source, doc_id, key, size, pass, place (in the source), first and last word (0-based, last excluded) that the slot takes.

    `sized`: key (of the row), doc_id, source, size.
    """
    spark = docs.sparkSession
    goals = [t for _, _, t in found]
    total = sum(goals)
    n_slots = max(1, -(-int(total) // block_tokens))
    slots = cut(schedule(spark, n_slots, goals)) if total > 0 else spark.createDataFrame([], "slot long, place int, rank long")
    counted = {r.place: r.n for r in slots.groupBy("place").agg(F.count("*").alias("n")).collect()}
    # a source that no point met, if it has a target, gets one slot at the end
    late = [(n_slots + i, i, 0) for i, g in enumerate(goals) if int(g) > 0 and i not in counted]
    if late:
        slots = slots.union(spark.createDataFrame(late, "slot long, place int, rank long"))
        counted |= {p: 1 for _, p, _ in late}
    rows = [(s, i, int(n), int(t), counted.get(i, 0)) for i, (s, n, t) in enumerate(found) if int(t) > 0 and n > 0]
    table = spark.createDataFrame(rows, "source string, place int, source_size long, goal long, slots long")

    # each document's place in its source's shuffled order
    order = ["h", "doc_id", "key"]
    placed = sized.where("size > 0").join(per_source(table, len(rows)), F.col("sized_source").eqNullSafe(F.col("source")))  # one row per source
    placed = placed.withColumn("h", F.xxhash64("key", F.lit(8))).withColumn("range", F.floor(F.col("h") / F.lit(float(2**64 // RANGES))))
    sums = placed.groupBy("place", "range").agg(F.sum("size").alias("n"))
    before = sums.select("place", "range", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.coalesce(F.sum("size").over(Window.partitionBy("place", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("c", running).join(before, ["place", "range"]).withColumn("c", F.col("c") + F.col("before"))
    # its words' places in the passes that the goal reaches, and the blocks there; the first goal % slots blocks have a word more
    passes = F.sequence(F.lit(0), F.floor((F.col("goal") - 1) / F.col("source_size")).cast("int"))
    placed = placed.withColumn("pass", F.explode(passes)).withColumn("from", F.col("c") + F.col("pass") * F.col("source_size"))
    placed = placed.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal"))).where("from < to")
    placed = placed.withColumn("base", F.expr("goal div slots")).withColumn("longer", F.expr("goal % slots"))
    block = lambda w: F.expr(f"if({w} < longer * (base + 1), ({w}) div (base + 1), longer + ({w} - longer * (base + 1)) div greatest(base, 1))")
    placed = placed.withColumn("rank", F.explode(F.sequence(block("from"), block("(to - 1)"))))
    edge = lambda r: F.expr(f"({r}) * base + least({r}, longer)")
    placed = placed.withColumn("a", F.greatest("from", edge("rank"))).withColumn("b", F.least("to", edge("(rank + 1)"))).where("a < b")
    return placed.join(slots, ["place", "rank"]).select(
        "slot", "source", "doc_id", "key", "size", "pass", F.col("c").alias("place"), (F.col("a") - F.col("from")).alias("first"), (F.col("b") - F.col("from")).alias("last")
    )


def prepared(docs: DataFrame) -> DataFrame:
    """key, doc_id, sized_source, size of every row; the key also numbers rows that are alike."""
    rows = sizes(docs).select(F.xxhash64("doc_id", "text", "source").alias("key"), "doc_id", F.col("source").alias("sized_source"), "size")
    return rows


def taken(docs: DataFrame, share: float = SHARE, most: float = MOST, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs` (doc_id, text, source)."""
    spark = docs.sparkSession
    sized = cut(prepared(docs))
    found = shares(sized.withColumnRenamed("sized_source", "source"), share, most)
    words = mix(docs, sized, found, block_tokens).groupBy("key").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    # rows alike in every part of the key took their words together
    alike = sized.groupBy("key").agg(F.count("*").alias("alike"))
    words = words.join(alike, "key").withColumn("whole", F.expr("taken div alike")).withColumn("more", F.col("taken") % F.col("alike"))
    table = spark.createDataFrame([(s, int(n), float(t)) for s, n, t in found], "source string, source_size long, target double")
    out = sized.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).join(words, "key", "left")
    got = F.coalesce(F.col("whole") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0), F.lit(0))
    out = out.join(per_source(table, len(found)), F.col("sized_source").eqNullSafe(F.col("source")))
    return out.select("doc_id", "size", "source_size", "target", got.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE, most: float = MOST, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows with the columns of `docs`: for each pass over a document a row with the words that the mix takes of it.

    A text that a pass takes whole is unchanged; of others the words that are taken are joined by one space.
    """
    sized = cut(prepared(docs))
    found = shares(sized.withColumnRenamed("sized_source", "source"), share, most)
    parts = mix(docs, sized, found, block_tokens).groupBy("key", "place", "pass").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("size").alias("size"))
    key, first, last, size = fresh(docs, "key", "first", "last", "size")
    parts = parts.select(F.col("key").alias(key), F.col("first").alias(first), F.col("last").alias(last), F.col("size").alias(size))
    whole = (F.col(first) == 0) & (F.col(last) == F.col(size))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    some = F.array_join(F.slice(words, (F.col(first) + 1).cast("int"), (F.col(last) - F.col(first)).cast("int")), " ")
    # rows alike in doc_id, text and source have one key, and a part for each of them
    once = docs.withColumn(key, F.xxhash64("doc_id", "text", "source")).dropDuplicates([key])
    return once.join(parts, key).withColumn("text", F.when(whole, F.col("text")).otherwise(some)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
