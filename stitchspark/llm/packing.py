"""Best-fit packing by minimum bin slack.

Documents become token ids and pieces of at most `size` tokens. Pieces are dealt to groups of bounded size by a hash; in a group, each bin takes the
longest piece left and the combination of other lengths that leaves the least slack, found by a subset-sum program whose states are the bits of an
integer. Groups are packed apart, so only the last bins of a group can stay open.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, doc_id, doc_key, doc_key_of

SIZE = 2048
#: Pieces that are packed together; a larger group leaves fewer open bins and takes one task longer.
GROUP_PIECES = 20_000
#: A run of characters that the quick encoder would take a time for that grows with its square.
_LONG = re.compile(r"\S{2000}|\s{2000}")


class _Encoder:
    """Ids of whole texts. `ranks` is the vocabulary of `vocabulary` as ranks: the same ids in a third of the time, but not for endless words
    and special tokens."""

    def __init__(self, vocabulary: str, ranks: str | None):
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, then id 0."""
        text = text or ""
        if self.quick is None or _LONG.search(text) or any(x in text for x in self.special):
            found = self.whole.encode(text, add_special_tokens=False).ids
        else:
            found = self.quick.encode_ordinary(text)
        found.append(0)
        return np.array(found, "<u4")


@cache
def _encoder(vocabulary: str, ranks: str | None) -> _Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return _Encoder(vocabulary, ranks)


def _cuts(n: int, size: int, short_first: bool) -> list[tuple[int, int]]:
    """Start and end of the pieces of `n` ids: all of `size` but the last, or with `short_first` all but the first."""
    first = (n - 1) % size + 1 if short_first else min(n, size)
    ends = list(range(first, n, size)) + [n]
    return list(zip([0, *ends], ends))


def _pieces(vocabulary: str, ranks: str | None, size: int, with_ids: bool, short_first: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.ids(text)
                for k, (start, end) in enumerate(_cuts(len(ids), size, short_first)):
                    part = ids[start:end]
                    row = (doc, k, start, len(part), zlib.crc32(part))
                    rows.append((*row, part.astype("int32")) if with_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    return cut


def pieces(df: DataFrame, size: int = SIZE, tokenizer: str | None = None, with_ids: bool = True, short_first: bool = False) -> DataFrame:
    """doc_id (NO_ID for null), piece, start, length, ids_crc32 and (with_ids) the ids of each piece of each row of `df`.

    tokenizer: the file of another vocabulary. short_first: a cut document's first piece takes what is over, not its last."""
    files = (tokenizer, None) if tokenizer else (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = df.select(doc_key().alias("doc_id"), "text")
    return docs.mapInPandas(_pieces(*files, size, with_ids, short_first), kinds)


def fill(lengths: list[int], room: int, counts: dict[int, int]) -> list[int]:
    """The lengths, longest first, whose sum is the largest that fits; counts: how many there are of each."""
    sums, steps, full = 1, [], 1 << room
    mask = 2 * full - 1
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            more = (sums | sums << length) & mask
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums & full:
            break
    left, taken = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def bins(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each piece."""
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    where: dict[int, list[int]] = {}
    for i in order.tolist():
        where.setdefault(int(lengths[i]), []).append(i)
    counts = {n: len(x) for n, x in where.items()}
    left = sorted(counts, reverse=True)
    k = 0
    while left:
        chosen = [left[0]]
        counts[left[0]] -= 1
        if left[0] < size:
            chosen += fill([n for n in left if counts[n]], size - left[0], counts)
        for n in chosen[1:]:
            counts[n] -= 1
        place = 0
        for n in chosen:
            i = where[n].pop()
            at[i], offset[i] = k, place
            place += n
        k += 1
        if any(not counts[n] for n in chosen):
            left = [n for n in left if counts[n]]
    return at, offset


def _packed(size: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable")
        at, offset = bins(pdf["length"].to_numpy(), size)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"], out["offset"] = pdf["part"].to_numpy() * np.int64(2**32) + at, offset
        return out

    return pack


def pack(df: DataFrame, size: int = SIZE, tokenizer: str | None = None, short_first: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of `df` (doc_id, text; other columns are not read).

    A null or empty text is one piece, the end id alone. Rows that repeat, or have no doc_id, are packed each for itself. Only documents of more than
    `size` ids are cut, as `pieces` says. An empty table gives no rows."""
    scratch = Scratch(df.sparkSession)
    made = scratch.keep(pieces(df, size, tokenizer, with_ids=False, short_first=short_first), "pieces")
    parts = max(1, -(-made.filter(F.col("length") < size).count() // GROUP_PIECES))
    # Full pieces are sequences of their own; they need no company.
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    full = (made.filter(F.col("length") == size)
            .withColumn("sequence_id", F.lit(parts).cast("long") * F.lit(2**32) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")))
    rest = made.filter(F.col("length") < size).withColumn("part", dealt)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.groupBy("part").applyInPandas(_packed(size), kinds).unionByName(full)
    return packed.withColumn("doc_id", doc_id("doc_id"))


def sequences(df: DataFrame, size: int = SIZE, tokenizer: str | None = None, short_first: bool = False) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, at most `size` ids each."""
    made, place = pieces(df, size, tokenizer, short_first=short_first), pack(df, size, tokenizer, short_first)
    both = made.withColumnRenamed("doc_id", "d").join(place.select(doc_key_of(F.col("doc_id")).alias("d2"), "piece", "ids_crc32", "length", "sequence_id", "offset"),
                                                      (F.col("d") == F.col("d2")) & (made["piece"] == place["piece"]) & (made["ids_crc32"] == place["ids_crc32"]))
    packed = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "d", "ids"))).alias("p"))
    return packed.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.d").alias("doc_ids"))
