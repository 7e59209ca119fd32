"""Toxicity by subword bags: character n-gram embeddings, averaged over a word's bag and fed to a linear softmax.

Embeddings and softmax are trained together in numpy on a bounded sample of labelled documents. A document is as toxic as its most toxic bag, so a
few words in a long text count; while training, that bag stands for its document. As softmax and average are linear, each n-gram has one number in the
end, and misspelt or unseen words get theirs from the n-grams that they share with known ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id, doc_key

#: Hashed n-grams, their lengths, the size of an embedding.
BUCKETS, GRAMS, WIDTH = 2**17, (3, 4, 5), 4
#: The most documents of label 1 and of label 0 that are learned from, the first by hash; they are brought to the driver.
SAMPLE = (1000, 2000)
#: The cut of scores is where the share of toxic documents found, less so many times the share of clean ones, is largest.
CLEAN_COST = 3
EPOCHS, RATE, DECAY, LEAST_TEXTS = 60, 0.1, 0.01, 4
FLOOR = 0.1
_WORD = re.compile(r"\w+")


def held_out(number: Column) -> Column:
    return F.coalesce(F.crc32(number.cast("string")) % 5 == 0, F.lit(False))


def grams(word: str) -> list[int]:
    """Buckets of a word's character n-grams, and of the word itself."""
    w = f"<{word}>"
    return [zlib.crc32(w[i:i + n].encode("utf-8", "replace")) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)] + [zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS]


def words_of(text: str | None) -> list[str]:
    """The distinct words of a whole text."""
    return sorted(set(_WORD.findall((text or "").lower())))


def _rows(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by index."""
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Scores of the n-gram buckets and a bias: the logit of a bag is the mean score of its n-grams plus the bias."""
    vocabulary: dict[str, int] = {}
    docs = [[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)] for t in texts]
    if not vocabulary or len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), -20.0 if not labels.any() else 0.0
    bags = [grams(w) for w in vocabulary]
    gram, gram_of = np.concatenate([np.array(b) for b in bags]), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    per_word = np.array([len(b) for b in bags], np.float32)[:, None]
    word = np.concatenate([np.array(d, np.int64) for d in docs if d])
    doc = np.repeat([i for i, d in enumerate(docs) if d], [len(d) for d in docs if d])
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, len(doc)])
    y = labels[doc[first]].astype(np.float32)
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    v, b = rng.normal(0, 0.3, WIDTH).astype(np.float32), 0.0
    # N-grams of few different texts say nothing; they stay at zero, and so do those that are never seen.
    pairs = np.unique(np.stack([word, np.unique([zlib.crc32(t.encode("utf-8", "replace")) for t in texts], return_inverse=True)[1][doc]], 1), axis=0)
    spread = np.bincount(pairs[:, 0], minlength=len(bags))
    seen = np.flatnonzero(np.bincount(gram, spread[gram_of], BUCKETS) >= LEAST_TEXTS)
    e[np.setdiff1d(np.arange(BUCKETS), seen)] = 0
    own = np.minimum(np.searchsorted(seen, gram), len(seen) - 1)
    known = seen[own] == gram
    square = np.zeros((len(seen), WIDTH), np.float32)
    for epoch in range(EPOCHS):
        words = _rows(gram_of, e[gram], len(bags)) / per_word
        logit = np.clip((words @ v)[word] + b, -30, 30)
        # The bag that stands for its document: the most toxic one, more and more sharply.
        top = np.maximum.reduceat(logit, first)
        soft = np.exp((logit - np.repeat(top, size)) * (1 if epoch < 10 else 8))
        share = soft / np.repeat(np.add.reduceat(soft, first), size)
        likely = 1 / (1 + np.exp(-logit))
        # Bags of clean documents are clean, whichever is the top.
        clean = np.repeat((1 - y) * balance / size, size)
        miss = np.repeat(balance, size) * share * (likely - np.repeat(y, size)) + clean * likely
        of_word = np.bincount(word, miss, len(bags)).astype(np.float32)[:, None]
        d_v, d_b, d_word = (of_word * words).sum(0), float(miss.sum()), of_word * v[None, :] / per_word
        d_e = _rows(own[known], d_word[gram_of[known]], len(seen))
        # Steps by the running size of the gradients, with a floor common to all: n-grams that many toxic windows share move far, others hardly do.
        square = 0.9 * square + 0.1 * d_e**2
        pace = np.sqrt(square) + FLOOR * float(np.sqrt(square.max()))
        e[seen] = e[seen] * (1 - DECAY) - RATE * d_e / np.maximum(pace, 1e-12)
        v, b = v * (1 - DECAY) - 0.5 * d_v, b - 0.5 * d_b
    return (e @ v).astype(np.float32), float(b)


class _Scores(dict):
    """Scores of words by the mean of their n-grams'."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = s = float(self.table[grams(word)].mean())
        return s


def document_logit(text: str | None, scores: _Scores, bias: float) -> float:
    """That of the most toxic bag."""
    return max(map(scores.__getitem__, words_of(text)), default=-20.0 - bias) + bias


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, float, float]:
    """Bucket scores, bias and the cut of logits. Learned from a bounded number of labelled documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), "toxic")
    first = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(n)
    chosen = first(1, sample[0]).unionByName(first(0, sample[1]))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min(F.struct("toxic", "text")).alias("r"))
    rows = rows.select("l_id", "r.text", "r.toxic").toPandas().sort_values("l_id")
    texts, y, apart = rows["text"].tolist(), rows["toxic"].to_numpy(dtype="int64"), np.arange(len(rows)) % 4 == 3
    table, bias = train([t for t, a in zip(texts, apart) if not a], y[~apart])
    scores, y = _Scores(table), y[apart]
    logits = np.array([document_logit(t, scores, bias) for t, a in zip(texts, apart) if a])
    if not 0 < y.sum() < len(y):
        return table, bias, 0.0
    order = np.argsort(logits)
    missed = np.cumsum(y[order]) / y.sum() - CLEAN_COST * np.cumsum(1 - y[order]) / (1 - y).sum()
    k = min(int(np.argmin(missed)), len(order) - 2)
    return table, bias, float((logits[order[k]] + logits[order[k + 1]]) / 2)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text); labels: doc_id, toxic.

    Null and empty texts, and texts without a word, score near 0. Rows with a null doc_id are not held out and never learned from. Of labels or documents
    that repeat an id one is learned from. Without labels of both kinds every document gets the same score. Empty documents give no rows."""
    model = fit(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bias, cut = model
        scores = _Scores(table)
        for batch in batches:
            logit = np.clip(np.array([document_logit(t, scores, bias) for t in batch["text"]], float) - cut, -30, 30)
            p = 1 / (1 + np.exp(-logit))
            yield pd.DataFrame({"key": batch["key"], "held_out": batch["held_out"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    rows = docs.select(doc_key().alias("key"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(score, "key long, held_out boolean, score double, predicted int").select(doc_id("key").alias("doc_id"), "held_out", "score", "predicted")
