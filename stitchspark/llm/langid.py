"""Language identification: multinomial logistic regression on TF-IDF of character n-grams, sparse by FTRL with elastic-net penalties, calibrated.

Document frequencies of hashed n-grams are counted over every document that may be learned from. The weights are trained in numpy on a bounded sample
of labelled documents by follow-the-regularised-leader; then a temperature is fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id, doc_key

BUCKETS, GRAMS = 2**15, (1, 2, 3)
#: The most labelled documents of a language that are learned from, the first by hash; where there are more languages than `LANGUAGES`, all are learned
#: from fewer documents each, but not from fewer than `FEWEST`.
SAMPLE, LANGUAGES, FEWEST = 400, 64, 10
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 0.02, 0.01
_MIX = np.array([2654435761, 2246822519, 3266489917], np.uint64)


def held_out(number: Column) -> Column:
    return F.coalesce(F.crc32(number.cast("string")) % 4 == 2, F.lit(False))


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of a whole lower-cased text, in order, with repeats."""
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k:len(c) - n + 1 + k]) * _MIX[k]
                h ^= h >> np.uint64(15)
            out.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights, of length one. Frequencies count by their square roots."""
    tf = np.bincount(features(text), minlength=BUCKETS)
    found = np.flatnonzero(tf)
    w = np.sqrt(tf[found]) * idf[found]
    return found, w / max(float(np.sqrt((w * w).sum())), 1e-12)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per bucket and task: in how many documents it is."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            df[np.unique(features(text))] += 1
            n += 1
    found = np.flatnonzero(df)
    yield pd.DataFrame({"bucket": np.r_[-1, found], "n": np.r_[n, df[found]]})


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 11) -> np.ndarray:
    """Weights by FTRL-proximal: coordinates whose gradients have not outweighed the first penalty stay at zero."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    rng = np.random.default_rng(seed)
    weights = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            p = _softmax(x @ w)
            p[y[k]] -= 1
            g = x[:, None] * p[None, :]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fine grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def drawn(known: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """doc_id, text, lang, place: the documents of the least hashes of each language, `sample` at most. sizes: the documents of each language."""
    # A bound from the count, at least doubled, then the exact cut of what is left.
    share = known.sparkSession.createDataFrame([(x, min(1.0, (2 * sample + 64) / n)) for x, n in sizes.items()], "lang string, share double")
    h = F.xxhash64("doc_id")
    few = known.join(F.broadcast(share), "lang").filter(F.pmod(h, F.lit(10**12)) < F.col("share") * 10**12)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text"))) - 1
    return few.select("doc_id", "text", "lang", h.alias("h"), place.alias("place")).filter(F.col("place") < sample)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str], float]:
    """idf, weights, languages, temperature."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.select("text").mapInPandas(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(counts.loc[counts["bucket"] == -1, "n"].sum())
    idf = np.full(BUCKETS, np.log(total + 1) + 1)
    counts = counts[counts["bucket"] >= 0]
    idf[counts["bucket"].to_numpy()] = np.log((total + 1) / (counts["n"].to_numpy() + 1)) + 1
    by_lang = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    sizes = {r["lang"]: r["n"] for r in by_lang}
    langs = sorted(sizes)
    if not langs:
        return idf, np.zeros((BUCKETS, 1)), ["und"], 1.0
    found = drawn(known, sizes, min(sample, max(FEWEST, sample * LANGUAGES // len(langs)))).toPandas().sort_values(["h", "doc_id", "lang", "place"])
    number = {x: i for i, x in enumerate(langs)}
    y = np.array([number[x] for x in found["lang"]], int)
    rows = [vector(t, idf) for t in found["text"]]
    apart = found["place"].to_numpy() % 5 == 4  # of each language, so that a rare one is learned too
    w = train([r for r, a in zip(rows, apart) if not a], y[~apart], len(langs))
    logits = np.array([r[1] @ w[r[0]] for r, a in zip(rows, apart) if a]).reshape(-1, len(langs))
    return idf, w, langs, temperature(logits, y[apart])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang).

    Null and empty texts, and texts without a letter, are `und` with score 0. Rows with a null doc_id are not held out and never learned from; without
    any labelled document all is `und`. Repeated rows are predicted each for itself. An empty table gives no rows."""
    model = fit(docs)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, w, langs, t = model
        for batch in batches:
            named, sure = [], []
            for text in batch["text"]:
                if not has_letter(text):
                    named.append("und")
                    sure.append(0.0)
                    continue
                i, x = vector(text, idf)
                p = _softmax((x @ w[i]) / t)
                named.append(langs[int(p.argmax())])
                sure.append(float(p.max()))
            yield pd.DataFrame({"key": batch["key"], "held_out": batch["held_out"], "lang_pred": named, "score": sure})

    rows = docs.select(doc_key().alias("key"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(predict, "key long, held_out boolean, lang_pred string, score double").select(doc_id("key").alias("doc_id"), "held_out", "lang_pred", "score")
