"""Exact copies by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted (by hash, then by content) and numbered; then adjacent
pairs of numbers are sorted and numbered, again and again, until each document has one number. Two documents that need as many rounds have the same
number exactly if their blocks are the same one by one: there is nothing that can collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, cell_bits, doc_id, doc_id_of, doc_key, one_of_each, positions, whole_text

BLOCK_BYTES = 4096


def one_space(text: Column) -> Column:
    """Each run of white space as one space; single spaces need no replacement."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def _blocks(bodies: DataFrame, size: int) -> DataFrame:
    """One row per block; an empty text is one empty block."""
    n = F.greatest(F.ceil(F.octet_length("body") / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * size + 1, F.lit(size)))
    return bodies.select("key", "sha", n.alias("n"), F.posexplode(cut).alias("idx", "block")).withColumn("h", F.xxhash64("block"))


def _numbered(distinct: DataFrame, hashed: str, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Names for distinct keys: their place in the order of hash and keys."""
    distinct = scratch.keep(distinct, f"{name}-keys")
    named = positions(distinct, [], hashed, keys, cell_bits(distinct.count()), out="name")
    named = scratch.keep(named.select(*dict.fromkeys([hashed, *keys]), "name"), name)
    scratch.drop(f"{name}-keys")
    return named


def _groups(df: DataFrame, block_bytes: int, scratch: Scratch) -> DataFrame:
    """key, sha, rows (how many have this id and text), keep (the least key of the text), group_size."""
    bodies = df.select(doc_key().alias("key"), one_space(whole_text()).cast("binary").alias("body")).withColumn("sha", F.sha2("body", 256))
    docs = bodies.groupBy("key", "sha").agg(F.count("*").alias("rows"))
    blocks = _blocks(bodies, block_bytes)
    # Rows that repeat id and text have the same blocks; one of them stands for all.
    parts = scratch.keep(blocks.drop("block").distinct(), "parts")

    # Blocks of the same hash: compared in full, and numbered within the hash.
    contents = blocks.groupBy("h", "block").agg(F.count("*").alias("_"))
    mixed = scratch.keep(contents.groupBy("h").agg(F.count("*").alias("contents")).filter("contents > 1"), "mixed")
    keyed = parts.withColumn("tie", F.lit(0))
    if not mixed.isEmpty():
        ties = (contents.join(mixed, "h", "left_semi").withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy("block")))
                .select("h", "block", "tie"))
        keyed = parts.join(blocks.join(ties, ["h", "block"]).select("key", "sha", "idx", "tie").distinct(), ["key", "sha", "idx"], "left").fillna(0, ["tie"])
        keyed = scratch.keep(keyed, "keyed")
    names = _numbered(keyed.groupBy("h", "tie").agg(F.count("*").alias("_")).drop("_"), "h", ["h", "tie"], scratch, "names-0")
    held = scratch.keep(keyed.join(names, ["h", "tie"]).select("key", "sha", "n", "idx", "name"), "held-0")
    for name in ("parts", "mixed", "keyed", "names-0"):
        scratch.drop(name)

    most, level = held.agg(F.max("n")).first()[0] or 1, 0
    ended = held.filter("n = 1").select("key", "sha", F.lit(0).alias("level"), "name")
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = (held.filter("n > 1").groupBy("key", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("idx") / 2).cast("int").alias("idx"))
                 .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")))
        pairs = scratch.keep(pairs.withColumn("h", F.xxhash64("a", "b")), f"pairs-{level}")
        names = _numbered(pairs.select("h", "a", "b").distinct(), "h", ["a", "b"], scratch, f"names-{level}")
        held = scratch.keep(pairs.join(names, ["h", "a", "b"]).select("key", "sha", "n", "idx", "name"), f"held-{level}")
        scratch.drop(f"pairs-{level}")
        scratch.drop(f"names-{level}")
        ended = ended.unionByName(held.filter("n = 1").select("key", "sha", F.lit(level).alias("level"), "name"))
    member = scratch.keep(docs.join(ended, ["key", "sha"]), "member")
    for at in range(level + 1):
        scratch.drop(f"held-{at}")
    groups = scratch.keep(member.groupBy("level", "name").agg(F.min("key").alias("keep"), F.sum("rows").alias("group_size")), "groups")
    return member.join(groups, ["level", "name"]).select("key", "sha", "rows", "keep", "group_size")


def exact_groups(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of `df` (doc_id, text; other columns are not read).

    A null text is an empty text, and all empty texts are one group. Each row is a document for itself: of rows that repeat the smallest doc_id of a
    group one is kept, whichever it is. A null doc_id sorts after all others; a group without ids keeps one row too. A text of any length is cut into
    blocks. An empty table gives no rows."""
    found = _groups(df, block_bytes, Scratch(df.sparkSession)).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    kept = (F.col("key") == F.col("keep")) & (F.col("again") == 1)
    return found.select(doc_id("key").alias("doc_id"), doc_id_of(F.col("keep")).alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame) -> DataFrame:
    """The rows of `df` that stay, one of each group of equal texts: one of the smallest doc_id, or of none. All columns of `df` are kept."""
    stay = _groups(df, BLOCK_BYTES, Scratch(df.sparkSession)).filter("key = keep").select("key", "sha", "rows")
    return one_of_each(df, {"key": doc_key(), "sha": F.sha2(one_space(whole_text()).cast("binary"), 256)}, stay)
