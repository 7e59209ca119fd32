"""URL filters by a temporal list join.

Lists of hosts, domains and paths change over time. The dated entries of a key become validity intervals, and a capture is decided by the entries that
were active when it was fetched: an as-of join of captures and intervals. Intervals and captures are cut by periods, so the join is an equality of key
and period with a comparison of times behind it; neither a busy host nor a key with a long history is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PERIOD_DAYS = 30


def _period(at: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / (86400 * days))


def intervals(entries: DataFrame, scratch: Scratch, days: int = PERIOD_DAYS) -> DataFrame:
    """list, key, verdict, valid_from, valid_to (null: open) of entries (list, key, verdict, action, effective_at).

    `add` opens an interval and the next entry of the same list and key ends it; `remove` only ends one. Of entries of the same instant the greatest
    (action, verdict) holds. Entries without a list, key, action or time say nothing."""
    kept = entries.filter("list is not null and key is not null and action is not null and effective_at is not null")
    one = kept.groupBy("list", "key", "effective_at").agg(F.max(F.struct("action", "verdict")).alias("e"))
    one = scratch.keep(one.select("list", "key", "effective_at", "e.*", _period(F.col("effective_at"), days).alias("period")), "entries")
    # What follows the last entry of a period is the first one of the next period that has any.
    by_key = Window.partitionBy("list", "key").orderBy("period")
    firsts = one.groupBy("list", "key", "period").agg(F.min("effective_at").alias("first")).withColumn("next_first", F.lead("first").over(by_key)).drop("first")
    inside = Window.partitionBy("list", "key", "period").orderBy("effective_at")
    ends = one.withColumn("next_in", F.lead("effective_at").over(inside)).join(firsts, ["list", "key", "period"])
    return (ends.filter("action = 'add'").select("list", "key", "verdict", F.col("effective_at").alias("valid_from"), F.coalesce("next_in", "next_first").alias("valid_to")))


def url_keys(url: Column) -> Column:
    """What a list can name of a URL: its host, the host's parent domains of two labels or more, and host and first path part."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.when(F.size(labels) > 1, parents).otherwise(F.array(host))
    return F.when(F.length(host) > 0, F.concat(keys, F.when(F.length(first) > 0, F.array(F.concat_ws("/", host, first))).otherwise(F.array().cast("array<string>"))))


def decide(captures: DataFrame, entries: DataFrame, days: int = PERIOD_DAYS) -> DataFrame:
    """capture_id, fetched_at, n_active, verdict, key, list, valid_from for each row of `captures` (capture_id, url, fetched_at).

    The longest key decides; among equal ones `block` before others, then the later interval, then list and key by name; n_active counts all entries
    that are active. Captures without a match, without a URL that has a host, or without a time have n_active 0 and nulls. Rows that repeat id, URL and
    time are decided once and returned each. Empty lists decide nothing."""
    scratch = Scratch(captures.sparkSession)
    rows = captures.select("capture_id", "url", "fetched_at")
    once = rows.distinct().withColumn("capture", F.xxhash64("capture_id", "url", "fetched_at"))
    asked = once.withColumn("key", F.explode(url_keys(F.col("url")))).withColumn("period", _period(F.col("fetched_at"), days))
    asked = scratch.keep(asked.filter("fetched_at is not null").select("capture", "key", "period", "fetched_at"), "asked")
    last = asked.agg(F.max("period")).first()[0]
    held = intervals(entries, scratch, days)
    until = F.coalesce(_period(F.col("valid_to"), days), F.lit(last))
    held = held.withColumn("period", F.explode(F.sequence(_period(F.col("valid_from"), days), F.greatest(until, _period(F.col("valid_from"), days)))))
    held = scratch.keep(held, "intervals")
    met = asked.join(held, ["key", "period"]).filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    order = F.struct(F.length("key"), (F.col("verdict") == "block"), F.col("valid_from"), F.col("list"), F.col("key"))
    best = met.groupBy("capture").agg(F.count("*").alias("n_active"), F.max_by(F.struct("verdict", "key", "list", "valid_from"), order).alias("best"))
    out = rows.withColumn("capture", F.xxhash64("capture_id", "url", "fetched_at")).join(best, "capture", "left")
    return out.select("capture_id", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.verdict").alias("verdict"),
                      F.col("best.key").alias("key"), F.col("best.list").alias("list"), F.col("best.valid_from").alias("valid_from"))
