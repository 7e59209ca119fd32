"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mix belongs to the source in whose share of the unit interval the fractional part of t times the golden ratio falls. The slots of a
source are ranked, its documents are put in a fixed random order and cut into blocks of equal numbers of words, and the slot of rank r takes block
r modulo the number of blocks: a source that is wanted more than once is read again from its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cell_bits, doc_id_of, doc_key, fresh, n_words, one_of_each, positions, whole_text

WEIGHTS = (5, 2, 1)
#: No document is taken more often.
PASSES = 3
BLOCK_WORDS = 64
#: The fractional part of the golden ratio, in 2**31 parts (odd, so that 2**31 slots have different points).
GOLDEN = 1327217885
_ONE = 2**31
_CELLS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """source_key, source_size, target of each source. One row per source is ordered in one task.

    Shares are by weight; where that is over `passes` times a source's size, it is held there and the rest is shared anew. Sources are filled in order
    of the level at which they are full, so a running total of the full ones gives the level of the others."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source_key").isNull(), "source_key")
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("cap", F.lit(passes) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", F.col("source_key").isNull(), "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("_level", F.col("_left") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    level = F.first(F.when(F.col("_level") <= F.col("full_at"), F.col("_level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("source_key", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * level, F.col("cap").cast("double"))).alias("target"))


def schedule(shares: DataFrame, slots: int, scratch: Scratch) -> DataFrame:
    """slot, source_no, rank: the source of each slot and the slot's rank in its source. shares: source_no, low, high (in 2**31 parts)."""
    point = (F.col("id") % _ONE * GOLDEN) % _ONE
    width = _ONE // _CELLS
    made = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point / width).alias("cell"))
    held = (shares.filter("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))))
    placed = made.join(held, "cell").filter("point >= low and point < high").select("slot", "source_no")
    placed = scratch.keep(placed.withColumn("at", F.shiftleft("slot", 64 - max(1, slots.bit_length()))), "placed")
    return positions(placed, ["source_no"], "at", [], cell_bits(slots), out="rank").select("slot", "source_no", "rank")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: doc_id, source, size, source_size, target, taken for each row of `df` (doc_id, text, source). Parts: slot, doc_id, text_hash,
    pass, first, words: what each slot of the mix takes, as words of a document (its text's hash tells repeated ids apart).

    A null text has no words and is never taken; a null source is a source of its own, the last. Rows that repeat a doc_id are mixed each for itself, in
    an order that their texts settle. An empty table, or one without words, gives targets and takings of 0."""
    scratch = Scratch(df.sparkSession)
    order = F.shiftleft(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), doc_key().cast("string"))), 1, 15), 16, 10).cast("long"), 4)
    docs = scratch.keep(df.select(F.monotonically_increasing_id().alias("row"), doc_key().alias("key"), F.col("source").alias("source_key"), n_words(whole_text()).alias("size"),
                                  F.xxhash64(whole_text()).alias("text_hash"), order.alias("at")), "docs")
    total = docs.agg(F.sum("size")).first()[0] or 0
    sources = targets(docs.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, passes)
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col("source_key").isNull(), "source_key")
    upto = F.round(F.sum("target").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) / max(total, 1) * _ONE).cast("long")
    sources = sources.withColumn("source_no", F.row_number().over(in_order)).withColumn("high", F.least(upto, F.lit(_ONE).cast("long")))
    sources = scratch.keep(sources.withColumn("low", F.lag("high", 1, 0).over(in_order)), "sources")

    slots = -(-total // block_words)
    made = scratch.keep(schedule(sources.select("source_no", "low", "high"), slots, scratch), "slots")
    wanted = made.groupBy("source_no").agg((F.count("*") * block_words).alias("wanted"))
    limits = scratch.keep(sources.join(wanted, "source_no", "left").withColumn("wanted", F.least(F.coalesce("wanted", F.lit(0)), F.col("source_size") * passes)), "limits")
    rows = scratch.keep(docs.join(limits.select("source_key", "source_no", "source_size", "target", "wanted"), docs["source_key"].eqNullSafe(limits["source_key"]))
                        .select("row", "key", "text_hash", "at", docs["source_key"].alias("source"), "size", "source_no", "source_size", "target", "wanted"), "rows")
    rows = scratch.keep(positions(rows, ["source_no"], "at", ["key", "text_hash", "row"], cell_bits(docs.count()), F.col("size"), "start"), "placed-rows")

    # A source's stream of words, again from its start after its end, in blocks: which words of which document each slot takes.
    again = F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1 - F.col("start")) / F.col("source_size")))
    read = rows.filter("size > 0 and wanted > start").withColumn("pass", F.explode(again)).withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
    to = F.least(F.col("from") + F.col("size"), F.col("wanted"))
    read = read.withColumn("to", to).withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))))
    first = F.greatest(F.col("from"), F.col("rank") * block_words)
    cut = read.withColumn("words", F.least(F.col("to"), (F.col("rank") + 1) * block_words) - first).withColumn("first", first - F.col("from"))
    parts = cut.join(made, ["source_no", "rank"]).select("slot", "row", "key", "text_hash", "source", "size", "pass", "first", "words")
    parts = scratch.keep(parts, "parts")
    out = rows.join(parts.groupBy("row").agg(F.sum("words").alias("taken")), "row", "left")
    documents = out.select("key", "text_hash", doc_id_of(F.col("key")).alias("doc_id"), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, parts


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The mix as rows of `df`: a row for each time that a document is read. No document is cut: where a source's target ends inside one, it is read whole if
    half of its words or more are wanted, and else left out, so a source is off its target by half a document at most. Rows without words are never read."""
    documents, parts = mix(df, **how)
    name = lambda c: F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c), F.lit("")))
    reads = parts.groupBy("row", "key", "text_hash", "source", "pass", "size").agg(F.sum("words").alias("words")).filter(F.col("words") * 2 >= F.col("size"))
    reads = reads.groupBy("key", "text_hash", name("source").alias("source")).agg(F.count("*").cast("int").alias("reads"))
    same = documents.groupBy("key", "text_hash", name("source").alias("source")).agg(F.count("*").alias("rows"))
    identity = {"key": doc_key(), "text_hash": F.xxhash64(whole_text()), "source": name("source")}
    rows = one_of_each(df, identity, same.join(reads, list(identity), "left_semi"))
    names = {k: fresh(df, f"_{k}") for k in (*identity, "reads")}
    reads = reads.select(*(F.col(k).alias(n) for k, n in names.items()))
    again = rows.withColumns({names[k]: c for k, c in identity.items()}).join(reads, [names[k] for k in identity])
    return again.withColumn(names["reads"], F.explode(F.sequence(F.lit(1), F.col(names["reads"])))).select(*(F.col(f"`{c}`") for c in df.columns))
