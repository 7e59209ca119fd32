"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a context of up to `DEPTH` words. Its next-word distribution is smoothed by that of the context without its oldest word, down to
the unigram base: each word that follows it gives up a part of its count, and the shorter context shares out what is given up. A context stays in the tree if its suffix does, if it occurs often enough, and if its distribution diverges from its suffix's: over
all training words that follow it, each counted as if it were left out, the log ratio of the two must add up to a threshold. A word is scored from the
longest context before it that is in the tree.

Documents are packed into batches of words once. What a batch has to know of the corpus it asks for by 64-bit keys of word sequences: its own counts go
to the buckets of a key, are added up there, and the totals come back. Longer sequences are asked for only where their context occurs often enough and
their suffix more than once (else they count as unseen, which leaves their share of the chances unused), so no count is ever estimated. No task holds more than a batch or a bucket, and both are of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The longest context; occurrences that a context needs; the log ratio that it must gain, in nats; what each word that follows gives up of its count.
DEPTH, LEAST, GAIN, DISCOUNT = 2, 4, 2.0, 0.8
#: Words of a batch, and of the corpus for each bucket; slices in which batches hear their answers, one after the other, so that no more than a slice is
#: there twice.
BATCH, BUCKET, SLICES = 300_000, 1_200_000, 4
#: Gains and shares of words are added up as whole numbers, so that their order doesn't matter.
_UNIT = 1_000_000_000
_END = np.uint64(xxhash.xxh3_64_intdigest(b" "))
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Kinds of totals: counts of sequences have the number of their words; numbers of different words after a context, and gains of contexts, this and theirs.
_TYPES, _GAIN = 100, 200
_KEPT = "batch long, vocabulary binary, words binary, sizes binary, lead binary, train binary, ids array<bigint>, held array<boolean>, rows array<bigint>"
_ASKED = "batch long, kind int, bucket int, keys binary, counts binary"


class _Words(dict):
    """64-bit hashes of words, looked up by the word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _blob(a: np.ndarray) -> bytes:
    """An array of whole numbers in as few bytes as its largest needs, first bytes of all first, and so on, compressed."""
    kind = np.int64 if len(a) and a.min() < 0 else np.min_scalar_type(a.max() if len(a) else 0)
    planes = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), -1).T)
    return np.dtype(kind).char.encode() + _ZIP.compress(planes.tobytes())


def _array(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(_UNZIP.decompress(data[1:]), np.uint8).reshape(kind.itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(kind)[:, 0]
    return a if kind == np.uint64 else a.astype(np.int64)


def _keys(data: bytes) -> np.ndarray:
    return _array(data).astype(np.uint64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, held, train, text to batches of about `BATCH` words. A longer text is cut into pieces, each led by the `DEPTH` words before it."""
    words, part, made = _Words(), TaskContext.get().partitionId() << 40, 0
    waiting: list[tuple] = []

    def packed() -> pa.RecordBatch:
        nonlocal made, waiting
        all_words = np.concatenate([w[0] for w in waiting])
        vocabulary, index, n = np.unique(all_words, return_inverse=True, return_counts=True)
        # Frequent words have small numbers, which take less room.
        order = np.argsort(-n, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        vocabulary, index = vocabulary[order], rank[index]
        sizes, lead, train = (np.array([w[k] for w in waiting], t) for k, t in ((1, np.int64), (2, np.int64), (5, np.uint8)))
        cells = [part + made, _blob(vocabulary), _blob(index), _blob(sizes), _blob(lead), _blob(train), [w[3] for w in waiting], [w[4] for w in waiting], [w[6] for w in waiting]]
        kinds = [pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        made, waiting = made + 1, []
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [x.split()[0] for x in _KEPT.split(", ")])

    row, n = part, 0
    for batch in batches:
        for doc_id, held, train, text in zip(*(batch.column(c) for c in ("doc_id", "held", "train", "text"))):
            found = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            hashed = np.append(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)), _END)
            row += 1
            for at in range(0, len(hashed), BATCH):
                lead = min(at, DEPTH)
                piece = hashed[at - lead:at + BATCH]
                waiting.append((piece, len(piece), lead, doc_id.as_py(), held.as_py(), train.as_py(), row))
                n += len(piece)
                if n >= BATCH:
                    yield packed()
                    n = 0
    if waiting:
        yield packed()


class _Batch:
    """The words of a batch, and what is known of them so far. Arrays have an entry for each word, with the numbers of the sequence that it ends."""

    def __init__(self, row: dict):
        self.row = row
        self.vocabulary, self.index = _keys(row["vocabulary"]), _array(row["words"])
        self.sizes, self.lead = _array(row["sizes"]), _array(row["lead"])
        first = np.cumsum(self.sizes) - self.sizes
        self.first, self.piece = first, np.repeat(np.arange(len(first)), self.sizes)
        self.offset = np.arange(len(self.index)) - first[self.piece]
        self.scored = self.offset >= self.lead[self.piece]
        self.own = (self.scored & (_array(row["train"])[self.piece] > 0)).astype(np.int64)
        self._keys = [None, self.vocabulary[self.index]]

    def keys(self, order: int) -> np.ndarray:
        while len(self._keys) <= order:
            last, words = self._keys[-1], self._keys[1]
            h = np.zeros_like(last)
            h[1:] = (last[:-1] ^ (last[:-1] >> np.uint64(29))) * _ODD[0] + words[1:]
            h = (h ^ (h >> np.uint64(32))) * _ODD[1]
            self._keys.append(h ^ (h >> np.uint64(29)))
        return self._keys[order]

    def counts(self, order: int) -> np.ndarray:
        known = _array(self.row[f"n{order}"])
        return known[self.index] if order == 1 else known

    def followers(self, depth: int) -> np.ndarray:
        """How many different words follow the context of `depth` words before each word."""
        known = _array(self.row[f"t{depth}"])
        if depth == 1:
            known = np.concatenate([known[:1], known[self.index[:-1]]])
        return known

    def before(self, order: int) -> np.ndarray:
        """Counts of the context of so many words before each word; 0 where a piece has no such context."""
        n = np.zeros(len(self.index), np.int64)
        n[1:] = self.counts(order)[:-1]
        n[self.offset < order] = 0
        return n

    def level(self) -> np.ndarray:
        """The length of the longest context in the tree that was found so far."""
        return _array(self.row["level"]) if self.row.get("level") else np.zeros(len(self.index), np.int64)

    def contexts(self, depth: int) -> np.ndarray:
        """Words whose context of `depth` words occurs often enough."""
        return np.flatnonzero(self.before(depth) >= LEAST)

    def open_contexts(self, depth: int) -> np.ndarray:
        """Those whose context of one word less is in the tree."""
        return np.flatnonzero((self.level() == depth - 1) & (self.before(depth) >= LEAST))

    def open_sequences(self, order: int) -> np.ndarray:
        """Words that end sequences which may follow a context often enough and occur elsewhere too."""
        if order == 2:
            return np.flatnonzero(self.offset >= 1)
        return np.flatnonzero((self.offset >= order - 1) & (self.before(order - 1) >= LEAST) & (self.counts(order - 1) >= 2))

    def chances(self, depth: int, n: int, types: int, out: int) -> list[np.ndarray]:
        """Chances of each word after contexts of 0 to `depth` words, with `out` occurrences of the word itself left out."""
        p = [(self.counts(1) - out + 0.5) / max(n - out + 0.5 * (types + 1), 0.5)]
        for d in range(1, depth + 1):
            here, followers = self.counts(d + 1), self.followers(d)
            if d > 1 and not out:
                here = np.where(self.counts(d) < 2, 0, here)
            followers = np.maximum(followers - out * (here == 1), 1)
            p.append((np.maximum(here - out - DISCOUNT, 0) + DISCOUNT * followers * p[-1]) / np.maximum(self.before(d) - out, 1))
        return p

    def asked(self, step: int, n: int, types: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """kind, distinct keys in order, what this batch adds to each."""
        if step == 0:
            order = np.argsort(self.vocabulary)
            yield 1, self.vocabulary[order], np.bincount(self.index, self.own, len(self.vocabulary)).astype(np.int64)[order]
        if 1 <= step <= DEPTH:
            some = self.contexts(step)
            yield _TYPES + step, *_summed(self.keys(step)[some - 1], np.rint(_UNIT / np.maximum(self.counts(step + 1)[some], 1)).astype(np.int64) * self.own[some])
        if step >= 2:
            some = self.open_contexts(step - 1)
            p = self.chances(step - 1, n, types, 1)
            gain = np.rint(_UNIT * np.log(np.where(self.own > 0, p[-1] / p[-2], 1)[some])).astype(np.int64)
            yield _GAIN + step - 1, *_summed(self.keys(step - 1)[some - 1], gain)
        if step + 2 <= DEPTH + 1:
            some = self.open_sequences(step + 2)
            yield step + 2, *_summed(self.keys(step + 2)[some], self.own[some])

    def told(self, step: int, totals: dict[int, np.ndarray]) -> dict[str, bytes]:
        """What a step's totals add to the batch."""
        def of(kind: int, keys: np.ndarray) -> np.ndarray:
            return totals[kind][np.unique(keys, return_inverse=True)[1]] if len(keys) else np.empty(0, np.int64)

        found = {}
        if step == 0:
            counts = np.empty(len(self.vocabulary), np.int64)
            counts[np.argsort(self.vocabulary)] = totals[1]
            found["n1"] = _blob(counts)
        if 1 <= step <= DEPTH:
            some = self.contexts(step)
            if step == 1:  # by word
                followers = np.zeros(len(self.vocabulary), np.int64)
                used = np.unique(self.index[some - 1])
                followers[used[np.argsort(self.vocabulary[used])]] = totals.get(_TYPES + 1, 0)
            else:
                followers = np.zeros(len(self.index), np.int64)
                followers[some] = of(_TYPES + step, self.keys(step)[some - 1])
            found[f"t{step}"] = _blob(followers)
        if step >= 2:
            some, level = self.open_contexts(step - 1), self.level().copy()
            level[some[of(_GAIN + step - 1, self.keys(step - 1)[some - 1]) > 0]] = step - 1
            found["level"] = _blob(level)
        if step + 2 <= DEPTH + 1:
            some, n = self.open_sequences(step + 2), self.own.copy()
            n[some] = of(step + 2, self.keys(step + 2)[some])
            found[f"n{step + 2}"] = _blob(n)
        return found

    def sums(self, n: int, types: int) -> list[np.ndarray]:
        """Per piece: words, known words, base and score."""
        p, level, known = self.chances(DEPTH, n, types, 0), self.level(), self.counts(1) > 0
        by_level = np.choose(level, p)
        add = lambda x: np.add.reduceat(np.where(self.scored, x, 0), self.first)
        return [add(np.ones(len(level), np.int64)), add(known.astype(np.int64)), add(np.log10(p[0])), add(np.log10(by_level))]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _ask(step: int, buckets: int, n: int, types: int):
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for kind, keys, counts in _Batch(row).asked(step, n, types):
                cuts = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                some = np.flatnonzero(cuts[1:] > cuts[:-1])
                cut = lambda a: pa.array([_blob(a[cuts[b]:cuts[b + 1]]) for b in some], pa.binary())
                # Keys are in order, so their differences are smaller numbers.
                steps = np.diff(keys, prepend=np.uint64(0))
                steps[cuts[some]] = keys[cuts[some]]
                yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(some), pa.int64()), pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), cut(steps), cut(counts)],
                                                 [x.split()[0] for x in _ASKED.split(", ")])
    return ask


def _add_up(asked: pa.Table) -> pa.Table:
    """All that was asked of one bucket to what its totals say, in the same order; types: distinct keys with a total above 0, in one row."""
    parts = [np.cumsum(_keys(k), dtype=np.uint64) for k in asked["keys"].to_pylist()]
    counts = np.concatenate([_array(c) for c in asked["counts"].to_pylist()])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]]
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    per_key = np.empty_like(counts)
    per_key[order] = total[np.cumsum(new) - 1]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    types, kind = np.zeros(len(parts), np.int64), asked["kind"][0].as_py()
    types[0] = (total > 0).sum()
    if kind > _GAIN:
        per_key = (per_key >= GAIN * _UNIT).astype(np.int64)
    elif kind > _TYPES:
        per_key = np.rint(per_key / _UNIT).astype(np.int64)
    return pa.table({"batch": asked["batch"], "kind": asked["kind"], "bucket": asked["bucket"], "totals": pa.array([_blob(x) for x in np.split(per_key, cuts)], pa.binary()), "types": types})


def _told(row: dict, step: int) -> dict:
    totals: dict[int, list] = {}
    for a in sorted(row.pop("answers") or [], key=lambda a: (a["kind"], a["bucket"])):
        totals.setdefault(a["kind"], []).append(_array(a["totals"]))
    return row | _Batch(row).told(step, {k: np.concatenate(v) for k, v in totals.items()})


def _hear(step: int, names: list[str]):
    def hear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            row = _told(row, step)
            lists = {"ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "rows": pa.list_(pa.int64()), "batch": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], lists.get(c, pa.binary())) for c in names], names)
    return hear


def _finish(step: int, n: int, types: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            row = _told(row, step)
            words, known, base, score = _Batch(row).sums(n, types)
            yield pa.RecordBatch.from_arrays([pa.array(row["rows"], pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(words), pa.array(known), pa.array(base), pa.array(score)],
                                             ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return finish


def score(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `df` (doc_id, text; other columns are not read).

    A null or empty text has one token, its end. Rows that repeat an id or a text are documents of their own, learned from and scored each. Rows without
    a doc_id are not held out and not learned from. Without training rows all chances are those of one unknown word. A text of any length is scored
    whole, in pieces that know the words before them. An empty table gives no rows. Words are known by 64-bit hashes."""
    scratch = Scratch(df.sparkSession)
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held"), F.coalesce(rest != 1, F.lit(False)).alias("train"), "text")
    kept, kinds = scratch.keep(docs.mapInArrow(_pack, _KEPT), "words-0"), _KEPT
    sizes = kept.mapInArrow(_sizes, "words long, trained long").agg(F.sum("words"), F.sum("trained")).first()
    slice_of = F.pmod(F.xxhash64("batch"), F.lit(SLICES))
    parts = [kept.filter(slice_of == i) for i in range(SLICES)]
    buckets, n, types = (sizes[0] or 0) // BUCKET + 1, sizes[1] or 0, 0
    for step in range(DEPTH + 2):
        asked = kept.mapInArrow(_ask(step, buckets, n, types), _ASKED)
        told = scratch.keep(asked.groupBy("kind", "bucket").applyInArrow(_add_up, "batch long, kind int, bucket int, totals binary, types long"), f"told-{step}")
        if step == 0:
            types = told.filter("kind = 1").agg(F.sum("types")).first()[0] or 0
        heard = lambda batches, told: batches.join(told.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("answers")), "batch", "left")
        if step > DEPTH:
            break
        new = [*(["n1"] if step == 0 else [f"t{step}"]), *(["level"] if step == 2 else []), *([f"n{step + 2}"] if step + 2 <= DEPTH + 1 else [])]
        kinds = ", ".join([kinds, *(f"{c} binary" for c in new)])
        hear = _hear(step, [x.split()[0] for x in kinds.split(", ")])
        for i, part in enumerate(parts):
            parts[i] = scratch.keep(heard(part, told.filter(slice_of == i)).mapInArrow(hear, kinds), f"words-{step + 1}-{i}")
            if step:
                scratch.drop(f"words-{step}-{i}")
        if not step:
            scratch.drop("words-0")
        kept = functools.reduce(DataFrame.unionByName, parts)
        scratch.drop(f"told-{step}")
    made = heard(kept, told).mapInArrow(_finish(step, n, types), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = made.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        b = _Batch(row)
        yield pa.RecordBatch.from_arrays([pa.array([len(b.index)]), pa.array([int(b.own.sum())])], ["words", "trained"])
