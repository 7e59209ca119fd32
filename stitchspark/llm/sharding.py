"""Balanced label propagation: documents of equal texts move to each other's shards while every shard keeps its quota of rows.

In each round the documents of a group turn to the shards that hold most of it (as many shards as the group needs). A shard takes no more linked
documents than its quota and those that leave it allow, and the documents without links that they displace fill the places that have become free, so
the counts of rows never differ by more than one. Moves are ranked by positions in hashed cells; no task holds a shard or a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cell_bits, doc_id, doc_key, positions, whole_text

SHARDS, ROUNDS = 16, 6


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), index + 1)


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: as many numbers as there are shards."""
    found = dict(tuple(r) for r in df.groupBy("label").agg(F.count("*")).collect())
    return [found.get(b, 0) for b in range(shards)]


def feasible(wish: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Of the moves between shards, as many as leave no shard with more arrivals than its room and its own leavers make place for."""
    wish, changed = dict(wish), True
    while changed:
        changed = False
        for b, free in enumerate(room):
            into = sorted(((n, a) for (a, t), n in wish.items() if t == b), reverse=True)
            excess = sum(n for n, _ in into) - sum(n for (a, _), n in wish.items() if a == b) - free
            for n, a in into:
                less = min(n, max(0, excess))
                excess -= less
                wish[a, b] -= less
                changed |= less > 0
    return wish


def propagate(rows: DataFrame, shards: int, n: int, scratch: Scratch, least: int, rounds: int = ROUNDS) -> DataFrame:
    """rows: id (of the row), key, copy, g (group), m (its size), at (hash), label (balanced at the start) and other columns. Rows with better labels.

    Groups of more than `least` documents count as linked here; the others make place for them."""
    quota = [n // shards + (b < n % shards) for b in range(shards)]
    bits = cell_bits(n)
    for k in range(1, rounds + 1):
        linked = rows.filter(F.col("m") > least)
        held = linked.groupBy("g", "m", "label").agg(F.count("*").alias("c"))
        place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("c"), F.xxhash64("g", "label"), "label")) - 1
        needs = F.ceil(F.col("m") / max(1, n // shards)).cast("int")
        wants = held.withColumn("place", place).groupBy("g", needs.alias("needs")).agg(F.sort_array(F.collect_list(F.struct("place", "label"))).alias("all"))
        wants = wants.select("g", F.transform(F.slice("all", 1, F.col("needs")), lambda x: x["label"]).alias("wanted"))
        wants = scratch.keep(wants.filter(F.size("wanted") > 0), f"wants-{least}-{k}")
        move = linked.join(wants, "g").filter(~F.array_contains("wanted", F.col("label")))
        move = move.select("id", "key", "copy", "at", "label", F.element_at("wanted", F.pmod("at", F.size("wanted")).cast("int") + 1).alias("target"))
        move = scratch.keep(move, f"moves-{least}-{k}")
        room = [q - s for q, s in zip(quota, _by_shard(linked, shards))]
        wish = {(r["label"], r["target"]): r["count"] for r in move.groupBy("label", "target").count().collect()}
        allowed = feasible(wish, room)
        limit = _at([allowed.get((a, b), 0) for a in range(shards) for b in range(shards)], F.col("label") * shards + F.col("target"))
        taken = positions(move, ["label", "target"], "at", ["key", "copy"], bits, out="rank").filter(F.col("rank") < limit)
        taken = scratch.keep(taken.select("id", "target"), f"taken-{least}-{k}")
        if taken.isEmpty():
            break
        moved = linked.join(taken, "id", "left").withColumn("label", F.coalesce("target", "label")).drop("target")
        moved = scratch.keep(moved, f"linked-{least}-{k}")
        # Documents without links: those beyond what a shard has left for them go where places are free, in order.
        single = rows.filter(F.col("m") <= least)
        free = [q - s for q, s in zip(quota, _by_shard(moved, shards))]
        alone = _by_shard(single, shards)
        over = [max(0, a - f) for a, f in zip(alone, free)]
        lack = [max(0, f - a) for a, f in zip(alone, free)]
        upto = [sum(lack[:b + 1]) for b in range(shards)]
        ranked = positions(single, ["label"], "at", ["key", "copy"], bits, out="rank")
        number = F.col("rank") + _at([sum(over[:b]) for b in range(shards)], F.col("label"))
        goal = reduce(lambda rest, b: F.when(number < upto[b], F.lit(b)).otherwise(rest), reversed(range(shards)), F.col("label"))
        single = ranked.withColumn("label", F.when(F.col("rank") < _at(over, F.col("label")), goal).otherwise(F.col("label")).cast("int")).drop("rank")
        rows = scratch.keep(moved.unionByName(single), f"rows-{least}-{k}")
    return rows


def numbered(docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """docs: id, key, g and other columns. Adds copy, which counts the rows of the same key and text from 0, and at, a hash of the three."""
    again = scratch.keep(docs.groupBy("key", "g").agg(F.count("*").alias("_")).filter("_ > 1").drop("_"), "again")
    if again.isEmpty():
        docs = docs.withColumn("copy", F.lit(0).cast("long"))
    else:
        same = scratch.keep(docs.select("id", "key", "g", F.xxhash64("id").alias("spread")).join(again, ["key", "g"], "left_semi"), "same")
        docs = docs.join(positions(same, ["key", "g"], "spread", ["id"], cell_bits(n), out="copy").select("id", "copy"), "id", "left").fillna(0, ["copy"])
    return scratch.keep(docs.withColumn("at", F.when(F.col("copy") == 0, F.xxhash64("key", "g")).otherwise(F.xxhash64("key", "g", "copy"))), "numbered")


def shard(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("rows": counts of rows at most one apart), shard, slot, grown_shard (null) for each row of `df` (doc_id, text).

    A null text is an empty text of size 1; empty texts are a group. Repeated rows are documents each for itself that link to each other. A null doc_id
    is handled as the last id. An empty table gives no rows."""
    scratch = Scratch(df.sparkSession)
    text = whole_text()
    docs = df.select(doc_key().alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("g"))
    docs = scratch.keep(docs.withColumn("id", F.monotonically_increasing_id()), "docs")
    groups = scratch.keep(docs.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"), "groups")
    n = docs.count()
    docs = numbered(docs, n, scratch)
    rows = docs.join(groups, "g", "left").fillna(1, ["m"])
    rows = positions(scratch.keep(rows, "grouped"), [], "at", ["key", "copy"], cell_bits(n), out="r")
    rows = scratch.keep(rows.withColumn("label", (F.col("r") % shards).cast("int")).drop("r"), "rows-0")
    # Groups that need much of a shard first; the small ones then find each other in what is left.
    for least in sorted({max(1, n // shards // 2), 1}, reverse=True):
        rows = propagate(rows, shards, n, scratch, least)
    slots = positions(rows, ["label"], "at", ["key", "copy"], cell_bits(n), out="slot")
    return slots.select(doc_id("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("label").alias("shard"), "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
