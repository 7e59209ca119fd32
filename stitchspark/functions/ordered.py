"""Ordered work on groups that may be too large for one task.

A group (a design, a sample) is cut into blocks of its order.  Each block is an independent
window; what a block needs from its predecessors travels either as one copied boundary row
(:func:`previous_values`) or as one total per block (:func:`running_totals`, :func:`order_number`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16


def block_number(seq: str, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(seq) / F.lit(rows)).cast("long")


def previous_values(df: DataFrame, keys: list[str], seq: str, prev: dict[str, Column | str],
                    rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the value of the preceding row (``seq - 1``) of the same key for each entry of ``prev``.

    ``seq`` is dense per key.  The last row of a block is also sent to the next block, so the
    largest task holds ``rows + 1`` rows however large the key is.
    """
    here = F.struct(block_number(seq, rows).alias("b"), F.lit(False).alias("copy"))
    onward = F.struct((block_number(seq, rows) + 1).alias("b"), F.lit(True).alias("copy"))
    at_end = F.pmod(F.col(seq), F.lit(rows)) == rows - 1
    spread = (
        df.withColumn("_to", F.explode(F.when(at_end, F.array(here, onward)).otherwise(F.array(here))))
        .withColumn("_blk", F.col("_to.b")).withColumn("_copy", F.col("_to.copy")).drop("_to")
    )
    w = W.partitionBy(*keys, "_blk").orderBy(seq)
    cols = {name: F.lag(F.col(c) if isinstance(c, str) else c).over(w) for name, c in prev.items()}
    return spread.withColumns(cols).filter(~F.col("_copy")).drop("_copy", "_blk")


def running_totals(df: DataFrame, keys: list[str], seq: str, totals: dict[str, Column],
                   rows: int = BLOCK_ROWS) -> DataFrame:
    """Add inclusive running sums over the order of each key."""
    blocked = df.withColumn("_blk", block_number(seq, rows))
    w = W.partitionBy(*keys, "_blk").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumns({f"_l_{n}": F.sum(e).over(w) for n, e in totals.items()})
    per_block = blocked.groupBy(*keys, "_blk").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in totals.items()])
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    out = local.join(carried, [*keys, "_blk"])
    return (
        out.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in totals})
        .drop("_blk", *[f"_l_{n}" for n in totals], *[f"_o_{n}" for n in totals])
    )


def order_number(df: DataFrame, keys: list[str], order: list[Column], coarse: Column, out: str,
                 coarse_ascending: bool = True) -> DataFrame:
    """1-based position of each row in the total order of its key.

    ``coarse`` is a function of the order that never decreases along it (never increases when
    ``coarse_ascending`` is false).  Only rows of one (key, coarse) cell share a task.
    """
    cells = df.withColumn("_cell", coarse)
    per_cell = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cell_order = F.col("_cell").asc() if coarse_ascending else F.col("_cell").desc()
    before = W.partitionBy(*keys).orderBy(cell_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_cell.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = cells.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(*order)))
    joined = local.join(offsets, on=_null_safe(local, offsets, [*keys, "_cell"]))
    kept = [local[c] for c in local.columns if c not in ("_rn", "_cell")]
    return joined.select(*kept, (local["_rn"] + offsets["_off"]).cast("long").alias(out))


def in_file_order(table: DataFrame, keys: list[Column], values: list[str]) -> DataFrame:
    """Keys and values of a table's rows, brought together by key and, within a key, in the order of the files and of their rows.

    An aggregate by all these keys needs no other shuffle and adds doubles up in this order, so that its result doesn't depend on how files are split among
    tasks. It takes a row at a time; the sort beneath it may spill.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = table.select(*keys, *values, *place)
    names = [n for n in rows.columns if n not in (*values, "_file", "_row")]
    return rows.repartition(*names).sortWithinPartitions(*names, "_file", "_row").drop("_file", "_row")


def _null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      bin_width: float) -> DataFrame:
    """Exact linear-interpolated quantiles per key without gathering a key's values in one task.

    Values are counted, binned by ``bin_width``; the bins that hold the wanted ranks are found from
    the bin totals and only their distinct values are ordered.
    """
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_bin", F.floor(F.col("_v") / F.lit(float(bin_width))).cast("long"))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_bc"))
    along = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("_end", F.sum("_bc").over(along)).withColumn("_n", F.sum("_bc").over(W.partitionBy(*keys)))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), F.lit(float(p)).alias("p"))
        for name, p in probs.items() for side in ("lo", "hi")
    ])
    spots = (
        bins.withColumn("_w", F.explode(wanted))
        .withColumn("_pos", F.col("_w.p") * (F.col("_n") - 1))
        .withColumn("_rank", F.when(F.col("_w.side") == "lo", F.floor("_pos")).otherwise(F.ceil("_pos")).cast("long"))
        .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_bc")))
        .select(*keys, "_bin", F.col("_w.name").alias("_name"), F.col("_w.side").alias("_side"),
                (F.col("_rank") - (F.col("_end") - F.col("_bc"))).alias("_within"),
                (F.col("_pos") - F.floor("_pos")).alias("_frac"))
    )
    in_bin = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ends = counted.join(spots.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").withColumn(
        "_vend", F.sum("_c").over(in_bin))
    hit = ends.join(spots, [*keys, "_bin"]).filter(
        (F.col("_within") < F.col("_vend")) & (F.col("_within") >= F.col("_vend") - F.col("_c")))
    aggs = []
    for name in probs:
        pick = lambda side: F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col("_v")))
        frac = F.max(F.when(F.col("_name") == name, F.col("_frac")))
        aggs.append((pick("lo") + (pick("hi") - pick("lo")) * frac).alias(name))
    return hit.groupBy(*keys).agg(*aggs)


