"""Source divergence audit by length-bucketed packing.

Terms are found in the UTF-8 bytes of whole texts. Those of up to 8 bytes become one 64-bit word and those of up to 16 bytes two, most significant byte
first; no term holds a zero byte, so words and terms stand for each other. Words are radix-sorted 16 bits at a time and equal neighbours are counted as
runs. Longer terms go to a bucket for each length, which is sorted as bytes. Tasks send counts per language, source and term only; sources of a language
are compared block of terms by block of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A term is kept where so many documents of its language have it.
LEAST_DOCS = 10
#: Terms that are reported per language and source.
TOP = 10
SCALE = 1_000_000_000
#: Bytes of text that are sorted at a time; kept terms of a block; sources of a tile.
SLICE, BLOCK, TILE = 8_000_000, 8192, 32
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
_LETTER = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)


def find_terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of each term of the texts that lie in `data` between `bounds`."""
    letter = _LETTER[data]
    before, after = np.empty_like(letter), np.empty_like(letter)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    inner = bounds[bounds < len(data)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    after[-1:] = False
    start = np.flatnonzero(letter & ~before)
    length = np.flatnonzero(letter & ~after) + 1 - start
    return start, length, np.searchsorted(bounds, start, "right") - 1


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of 64-bit words, the first word weighing most: a counting sort for each 16 bits, the last ones first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _word(data: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """Bytes `at` to `at + 7` of each term as one word, zeros after its end."""
    word = np.zeros(len(start), np.uint64)
    for j in range(at, at + 8):
        byte = np.where(length > j, data[np.minimum(start + j, len(data) - 1)], 0)
        word = (word << np.uint64(8)) | byte.astype(np.uint64)
    return word


def _bytes_of(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed terms one after the other, and their lengths."""
    table = np.stack([w.astype(">u8").view(np.uint8).reshape(-1, 8) for w in words], 1).reshape(len(words[0]), -1)
    return table[table != 0], (table != 0).sum(1)


def count_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (group, term): bytes of the terms, their lengths, group, sum of weights, number of documents.

    Terms come in order of group and document; all sorts are stable, so a term's run is in that order too."""
    datas, found = [], []

    def add(rows: np.ndarray, new: np.ndarray, terms) -> None:
        new[1:] |= group[rows][1:] != group[rows][:-1]
        first = np.flatnonzero(new)
        other = new | np.r_[True, doc[rows][1:] != doc[rows][:-1]]
        body, sizes = terms(first)
        datas.append(body)
        found.append(np.stack([sizes, group[rows][first], np.add.reduceat(weight[rows], first), np.add.reduceat(other.astype(np.int64), first)]))

    for low, high in ((0, 8), (8, 16)):
        some = np.flatnonzero((length > low) & (length <= high))
        if len(some):
            words = [_word(data, start[some], length[some], at) for at in range(0, high, 8)]
            order = radix_order(words)
            words = [w[order] for w in words]
            new = np.r_[True, np.any([w[1:] != w[:-1] for w in words], 0)]
            add(some[order], new, lambda first, words=words: _bytes_of([w[first] for w in words]))
    long = np.flatnonzero(length > 16)
    for size in np.unique(length[long]):
        some = long[length[long] == size]
        table = np.ascontiguousarray(data[start[some][:, None] + np.arange(size)]).view(f"S{size}")[:, 0]
        order = np.argsort(table, kind="stable")
        table = table[order]
        new = np.r_[True, table[1:] != table[:-1]]
        add(some[order], new, lambda first, table=table, size=size: (table[first].view(np.uint8), np.full(len(first), size)))
    if not found:
        return (np.empty(0, np.uint8), *np.empty((4, 0), np.int64))
    return (np.concatenate(datas), *np.concatenate(found, 1))


def _count_long(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """As `count_runs`, for one text of any length: counted in pieces that end between terms, then the pieces' counts as weights."""
    parts, at = [], 0
    while at < len(data):
        to = at + SLICE
        while to < len(data) and _LETTER[data[to]]:
            to += 1
        piece = data[at:to]
        start, length, _ = find_terms(piece, np.array([0]))
        zero = np.zeros(len(start), np.int64)
        parts.append(count_runs(piece, start, length, zero, zero, zero + 1))
        at = to
    body, length, weight = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    zero = np.zeros(len(length), np.int64)
    return count_runs(body, np.cumsum(length) - length, length, zero, zero, weight)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and bounds of a column of texts without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to lang, source, term, n, docs: the counts of a slice of documents at a time."""
    for batch in batches:
        data, bounds = _texts(batch.column("text"))
        pair = pd.DataFrame({"l": pd.factorize(batch.column("lang").to_pandas())[0], "s": pd.factorize(batch.column("source").to_pandas())[0]})
        code = pair.groupby(["l", "s"], sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        size = np.diff(bounds)[order]
        slice_of = np.cumsum(size) // SLICE
        slice_of[size > SLICE] = -1 - np.flatnonzero(size > SLICE)  # a long text for itself
        for one in np.unique(slice_of):
            rows = order[slice_of == one]
            if one < 0:
                body, length, group, n, docs = _count_long(_LOWER[data[bounds[rows[0]]:bounds[rows[0] + 1]]])
            else:
                text = _LOWER[np.concatenate([data[bounds[i]:bounds[i + 1]] for i in rows])]
                at = np.r_[0, np.cumsum(bounds[rows + 1] - bounds[rows])]
                start, length, doc = find_terms(text, at)
                body, length, group, n, docs = count_runs(text, start, length, code[rows][doc], doc, np.ones(len(doc), np.int64))
                # One row of each group, from which the names are taken.
                group = np.searchsorted(code[rows], group)
            names = pa.array(rows[group])
            term = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body)))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(names), batch.column("source").take(names), term.cast(pa.string()), pa.array(n), pa.array(docs)],
                                             ["lang", "source", "term", "n", "docs"])


def term_counts(df: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of all terms of `df` (lang, source, text without nulls)."""
    made = df.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (of + 2 * terms)), exact for counts of any size."""
    whole = F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE), F.nullif((of + 2 * terms).cast("decimal(20,0)"), F.lit(0)))
    return whole.cast("long") + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), F.nullif(p + q, F.lit(0)))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block's terms, for each two sources of two tiles: how far they are apart there, less how far two sources without the term are.

    Rows without a term give a source's share of terms that it doesn't have."""
    none = pdf[pdf["term"].isna()].drop_duplicates("no").sort_values("no")
    some = pdf[pdf["term"].notna()]
    no, base = none["no"].to_numpy(), none["p"].to_numpy()
    code, terms = pd.factorize(some["term"])
    p = np.tile(base, (len(terms), 1))
    p[code, np.searchsorted(no, some["no"].to_numpy())] = some["p"].to_numpy()
    head, out = pdf.iloc[0], []
    for i in np.flatnonzero(no // TILE == head["a"]):
        j = np.flatnonzero((no // TILE == head["b"]) & (no > no[i]))
        if len(j):
            value = ((p[:, [i]] - p[:, j]) ** 2 // (p[:, [i]] + p[:, j])).sum(0) - len(terms) * ((base[i] - base[j]) ** 2 // (base[i] + base[j]))
            out.append(pd.DataFrame({"lang": head["lang"], "x": no[i], "y": no[j], "value": value}))
    return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "x": [], "y": [], "value": []})


def divergence(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ, of `df` (text, lang, source; other columns are not read).

    Null texts, languages and sources count as ''. A row is a document, whatever it repeats. Sources without terms are compared by the shares that they
    give to kept terms; where a language keeps no term, all pairs have value 0 and there are no term rows. A language with one source has no pairs. An
    empty table gives no rows. Counts may be of any size; values are sums of long."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.keep(term_counts(rows), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).filter(F.col("docs") >= least_docs)
    kept = scratch.keep(kept.select("lang", "term", "total"), "kept")
    used = scratch.keep(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "used")
    scratch.drop("counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    groups = rows.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("n").alias("source_n")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").fillna(0, ["source_n", "terms", "lang_n"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = scratch.keep(groups.withColumn("base", F.coalesce(_share(F.lit(0), F.col("source_n"), F.col("terms")), F.lit(0).cast("long"))), "groups")

    both = used.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("source_n"), F.col("terms")), "q": _share(F.col("total"), F.col("lang_n"), F.col("terms"))})
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shown = both.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    shown = shown.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)

    # Terms in blocks, sources in tiles: every two tiles of a language meet in each of its blocks.
    blocks, tile = F.ceil(F.col("terms") / BLOCK), F.floor(F.col("no") / TILE)
    last = groups.groupBy("lang").agg(F.floor(F.max("no") / TILE).alias("last"))
    entries = both.select("lang", "term", "no", "p", F.pmod(F.xxhash64("term"), blocks).alias("block"), tile.alias("tile"))
    marks = (groups.filter("terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .select("lang", F.lit(None).cast("string").alias("term"), "no", F.col("base").alias("p"), "block", tile.alias("tile")))
    met = entries.unionByName(marks).join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    met = met.select("lang", "term", "no", "p", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    sums = met.groupBy("lang", "block", "a", "b").applyInPandas(_compare, "lang string, x long, y long, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("more"))

    g, h = groups.alias("g"), groups.select("lang", F.col("source").alias("item"), F.col("no").alias("no2"), F.col("base").alias("base2")).alias("h")
    pairs = g.join(h, "lang").filter("no <> no2").withColumns({"x": F.least("no", "no2"), "y": F.greatest("no", "no2")}).join(sums, ["lang", "x", "y"], "left")
    far = F.when(F.col("terms") > 0, F.col("terms") * _apart(F.col("base"), F.col("base2")) + F.coalesce("more", F.lit(0))).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", far.cast("long").alias("value")).withColumn("rank", F.row_number().over(place))
    return pairs.unionByName(shown)
