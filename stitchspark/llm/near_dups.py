"""Near copies by MinHash: universal hash minima, banding, verification by signature and by full sets, alternating large and small stars.

Sets that are equal are one node. In each bucket of a band every node is first held against the bucket's smallest node, so a bucket of any size gives
no more candidates than it has nodes. Where that leaves a bucket in several components, the nodes outside its largest component are held against all
of its nodes, block against block inside tasks: by signature first, then, with the texts of the nodes that are alike, by full sets; only links between
components leave a task. So every pair that shares a bucket is decided or
already connected, and none is listed for the mere sharing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch, doc_id, doc_key, one_of_each, whole_text

SHINGLE = 5
BANDS, ROWS = 40, 5
#: Links share `SHARE` hundredths of the union; a signature passes at `LEAST` of its minima (5 standard errors below the share).
SHARE, LEAST = 75, 0.6
#: Nodes and characters of a block, on average.
BLOCK, BLOCK_CHARS = 512, 2_000_000
_SEED = np.random.default_rng(20240501)
_FACTOR = _SEED.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_SEED.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_B = _SEED.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]


class _Words(dict):
    """64-bit hashes of words, looked up by the word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(SHINGLE, len(h))
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        mixed += h[j:len(h) - k + 1 + j] * _FACTOR[j]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of a * x + b (mod 2**64) for each hash function, of which the upper 32 bits are kept."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        v = found[i:i + 4096] * _A
        v += _B
        np.minimum(least, v.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = _Words()
    for batch in batches:
        sets = [shingles(t, words) for t in batch["text"]]
        yield pd.DataFrame({"key": batch["key"], "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets], "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                            "minima": [minima(s) if len(s) else None for s in sets]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with both texts to links: the full sets decide."""
    words, last, held = _Words(), None, None
    for batch in batches:
        linked = []
        for u, a, b in zip(batch["u"], batch["text_u"], batch["text_v"]):
            if u != last or held is None:
                last, held = u, shingles(a, words)
            other = shingles(b, words)
            both = len(np.intersect1d(held, other, assume_unique=True))
            linked.append(100 * both >= SHARE * (len(held) + len(other) - both))
        yield batch.loc[np.array(linked, bool), ["u", "v"]]


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two blocks of nodes of one bucket to the nodes whose texts :func:`_compare` may ask for: at most all of them, whatever the number of pairs."""
    columns = ("bucket", "band", "nodes", "comps", "sigs", "nodes2", "comps2", "sigs2")
    for batch in batches:
        out = set()
        for bucket, band, nodes, comps, sigs, nodes2, comps2, sigs2 in zip(*(batch[c] for c in columns)):
            a, b, other = np.stack(list(sigs)), np.stack(list(sigs2)), np.asarray(comps2)
            for i in range(len(a)):
                same = b == a[i]
                hits = np.flatnonzero((same.mean(1) >= LEAST) & (other != comps[i]))
                hits = hits[same[hits].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
                if len(hits):
                    out.add((bucket, nodes[i]))
                    out.update((bucket, nodes2[j]) for j in hits.tolist())
        yield pd.DataFrame(sorted(out), columns=["bucket", "node"], dtype="int64")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two blocks of nodes of one bucket to links between components: signatures first, then the full sets, each pair in its first shared bucket only.

    Components that a link has joined are one from then on, so a task gives fewer links than it has nodes, however many pairs are similar."""
    words, columns = _Words(), ("band", "nodes", "comps", "sigs", "texts", "nodes2", "comps2", "sigs2", "texts2")
    for batch in batches:
        out = set()
        for band, nodes, comps, sigs, texts, nodes2, comps2, sigs2, texts2 in zip(*(batch[c] for c in columns)):
            joined: dict[int, int] = {}
            def root(c):
                while c in joined:
                    c = joined[c]
                return c
            sets: dict[tuple[int, int], np.ndarray] = {}
            def of(side, k):
                if (side, k) not in sets:
                    sets[side, k] = shingles((texts, texts2)[side][k], words)
                return sets[side, k]
            a, b, other = np.stack(list(sigs)), np.stack(list(sigs2)), np.asarray(comps2)
            for i in range(len(a)):
                same = b == a[i]
                for j in np.flatnonzero((same.mean(1) >= LEAST) & (other != comps[i])).tolist():
                    c, d = root(comps[i]), root(comps2[j])
                    if c == d or int(same[j].reshape(BANDS, ROWS).all(1).argmax()) != band:
                        continue
                    x, y = of(0, i), of(1, j)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= SHARE * (len(x) + len(y) - both):
                        joined[max(c, d)] = min(c, d)
                        out.add((min(nodes[i], nodes2[j]), max(nodes[i], nodes2[j])))
        yield pd.DataFrame(sorted(out), columns=["u", "v"], dtype="int64")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: u, v, kept as a table; texts: node, text. Links between the pairs' full sets."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("u", "v"))
    return pairs.join(right, "v").join(left, "u").mapInPandas(_verify, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the least node that can be reached) of all nodes of the edges u, v, by alternating large and small stars.

    A star's centre takes the least of its neighbours as an aggregate, and the edges are joined to it, so that no node's neighbours are gathered."""
    edges = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, step = mark(edges), 0
    while now[0]:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{name}-large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        edges, before = scratch.keep(small, f"{name}-{step}"), now
        scratch.drop(f"{name}-{step - 1}")
        scratch.drop(f"{name}-large-{step}")
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _grouped(df: DataFrame) -> DataFrame:
    """key, text_hash, n_shingles, comp (the least key of the row's group), kept (one text of each group) for each row of `df`. A node is a set, whatever ids
    its texts have."""
    scratch = Scratch(df.sparkSession)
    docs = df.select(doc_key().alias("key"), F.xxhash64(whole_text()).alias("text_hash"), "text")
    sketch = scratch.keep(docs.mapInPandas(_sketch, "key long, text_hash long, n_shingles long, set_key binary, minima array<int>"), "sketch")
    sets = sketch.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("key", "text_hash")).alias("head"), F.first("minima").alias("sig"))
    sets = scratch.keep(sets.select(F.monotonically_increasing_id().alias("node"), "set_key", "head.key", "head.text_hash", "sig"), "sets")
    bands = F.array(*(F.xxhash64(F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)))
    bands = scratch.keep(sets.select("node", F.posexplode(bands).alias("band", "bucket")), "bands")
    leaders = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    leaders = scratch.keep(leaders, "leaders")
    shared = scratch.keep(bands.join(leaders, "bucket"), "shared")

    # What is asked of a node again and again is read from the nodes that share a bucket, not from all.
    involved = shared.select("node").distinct()
    heads = scratch.keep(sets.join(involved, "node", "left_semi").select("node", "key", "text_hash", "sig"), "heads")
    sig = lambda c: heads.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))

    # Every node against the leaders of its buckets.
    pairs = scratch.keep(shared.filter("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "pairs-1")
    agree = F.aggregate(F.zip_with("sig_u", "sig_v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    pairs = scratch.keep(pairs.join(sig("v"), "v").join(sig("u"), "u").filter(agree >= int(np.ceil(LEAST * BANDS * ROWS))).select("u", "v"), "pairs-2")
    scratch.drop("pairs-1")
    texts = scratch.keep(docs.join(heads.drop("sig"), ["key", "text_hash"]).select("node", "text"), "texts")
    if not texts.groupBy("node").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        texts = scratch.keep(texts.groupBy("node").agg(F.first("text").alias("text")), "texts-once")
    links = scratch.keep(_verified(pairs, texts), "links-1")
    scratch.drop("pairs-2")
    found = components(links, scratch, "stars-1")

    # Buckets that are still in several components: the rest against all.
    part = shared.select("bucket", "band", "node").join(found, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("comp"))
    part = scratch.keep(part, "part")
    sizes = part.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    broken = (sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("most"))
              .filter("m > most").select("bucket", "main", F.ceil(F.col("m") / BLOCK).alias("blocks"), F.ceil((F.col("m") - F.col("most")) / BLOCK).alias("blocks2")))
    rows = scratch.keep(part.join(broken, "bucket"), "open")

    def gathered(rows, n, suffix, *kinds):
        # One bucket's blocks meet anyhow: dealt by the bucket, they are moved once.
        at = F.pmod(F.xxhash64("node", F.lit(suffix)), F.col(n)).alias(f"at{suffix}")
        return rows.repartition("bucket").groupBy("bucket", at).agg(F.first("band").alias(f"band{suffix}"), *(F.collect_list(c).alias(f"{out}{suffix}") for c, out in kinds))

    def against(rows, *kinds):
        return gathered(rows, "blocks", "", *kinds).join(gathered(rows.filter("comp <> main"), "blocks2", "2", *kinds), "bucket")

    # Signatures first, without a text; texts go only to the buckets where a pair of alike nodes asks for them.
    kinds = (("node", "nodes"), ("comp", "comps"), ("sig", "sigs"))
    signed = rows.join(heads.select("node", "sig"), "node")
    asked = scratch.keep(against(signed, *kinds).mapInPandas(_alike, "bucket long, node long").distinct(), "asked")
    rows = scratch.keep(rows.join(asked, ["bucket", "node"], "left_semi").join(heads.select("node", "sig"), "node").join(texts, "node"), "open-texts")
    heavy = rows.groupBy("bucket").agg(F.ceil(F.sum(F.length("text")) / BLOCK_CHARS).alias("heavy"))
    rows = rows.join(heavy, "bucket").withColumns({c: F.greatest(c, "heavy") for c in ("blocks", "blocks2")})
    more = against(rows, *kinds, ("text", "texts")).mapInPandas(_compare, "u long, v long").distinct()
    links = scratch.keep(links.unionByName(more), "links")
    for name in ("open", "asked", "open-texts", "part", "shared", "bands", "leaders", "texts", "texts-once", "heads"):
        scratch.drop(name)

    # Copies of a set follow their node; the least id of a group stands for it, and of its texts one.
    final = scratch.keep(components(links, scratch, "stars"), "components")
    member = sets.select("node", "set_key", "key", "text_hash").join(final, "node", "left").select("set_key", "key", "text_hash", F.coalesce("component", "node").alias("component"))
    member = scratch.keep(member, "member")
    least = member.groupBy("component").agg(F.min(F.struct("key", "text_hash")).alias("least"))
    least = scratch.keep(member.join(least, "component").select("set_key", "least"), "least")
    return (sketch.drop("minima").join(least, "set_key", "left")
            .select("key", "text_hash", "n_shingles", F.coalesce("least.key", "key").alias("comp"),
                    F.coalesce((F.col("key") == F.col("least.key")) & (F.col("text_hash") == F.col("least.text_hash")), F.lit(True)).alias("kept")))


def near_groups(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `df` (doc_id, text; other columns are not read).

    Null and empty texts, and texts of white space, have an empty set and are linked with nothing. Texts of fewer than five words are one shingle.
    Rows that repeat a doc_id with other texts are linked by their texts only; component_id is the least doc_id of a row's group, and kept says whether it
    is the row's own. Null doc_ids come after all others and are returned as null (kept: null). An empty table gives no rows."""
    kept = F.when(F.col("key") != NO_ID, F.col("key") == F.col("comp"))
    return _grouped(df).select(doc_id("key").alias("doc_id"), "n_shingles", doc_id("comp").alias("component_id"), kept.alias("kept"))


def drop_near_copies(df: DataFrame) -> DataFrame:
    """The rows of `df` that stay, one of each group: one of the smallest doc_id, or of none. Rows whose text has no words all stay."""
    wordy = F.max(F.col("n_shingles") > 0)
    stay = _grouped(df).filter("kept").groupBy("key", "text_hash").agg(F.when(wordy, F.count("*")).otherwise(1).alias("rows"))
    return one_of_each(df, {"key": doc_key(), "text_hash": F.xxhash64(whole_text())}, stay)
