"""Source divergence, centroids and the suffix tree against SQL and brute force, with the odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stitchspark.llm import centroids, source_terms, suffix_tree
from stitchspark.llm.queries import SQL

KIND = "doc_id long, text string, lang string, source string, n_chars long, term string, n int, docs long, p long, q long, total string, value double"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def texts(n=80, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABZéß中") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 18, 40])))
    vocabulary = [word() for _ in range(60)]
    rows = [(i, rng.choice(" \n,;0[`{").join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "", "x\x00y"]), rng.choice(["a", "b", None, "", "c\x00", "é"])) for i in range(n)]
    return rows + [(1, rows[1][1], rows[1][2], rows[1][3]), (None, rows[2][1], "en", "a"), (900, None, "en", "no terms"), (901, " 12 ", None, "b"), (902, "word", "alone", "a"), (903, "", "bare", "a"), (904, None, "bare", "b")]


def sql(name, **tables):
    with duckdb.connect() as c:
        for k, v in tables.items():
            c.register(k, v)
        return c.execute(SQL[name]).fetchall()


def arrow(rows):
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))})


@pytest.mark.parametrize("rows", [texts(), texts(300, 4), []])
def test_divergence(spark, rows):
    df = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, "x", 0.5) for r in rows], KIND).repartition(3)
    assert sorted(map(tuple, source_terms.divergence(df).collect())) == sorted(sql("op11_length_bucketed_divergence", documents=arrow(rows)))


def test_divergence_of_more_sources_than_a_tile(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.choice([1, 9, 20]) for _ in range(8)), "en", f"s{rng.randrange(75)}") for i in range(600)]
    df = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, "x", 0.5) for r in rows], KIND)
    assert sorted(map(tuple, source_terms.divergence(df).collect())) == sorted(sql("op11_length_bucketed_divergence", documents=arrow(rows)))


def test_shares_of_large_counts(spark):
    n, of, terms = 2**62, 2**62 + 5, 12345
    row = spark.createDataFrame([(n, of, terms)], "n long, of long, terms long").select(source_terms._share(*(source_terms.F.col(c) for c in ("n", "of", "terms")))).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (of + 2 * terms)


def test_runs_of_a_long_text(monkeypatch):
    text = "".join(r[1] or "" for r in texts(300, 9)) + "z" * 700 + " é" * 50
    want = collections.Counter(t.translate({c: c + 32 for c in range(65, 91)}).encode() for t in TERM.findall(text))
    monkeypatch.setattr(source_terms, "SLICE", 64)
    data = source_terms._LOWER[np.frombuffer(text.encode(), np.uint8)]
    body, length, _, n, docs = source_terms._count_long(data)
    ends = np.cumsum(length)
    assert {bytes(body[e - k:e]): c for e, k, c in zip(ends, length, n)} == dict(want) and set(docs.tolist()) == {1}


def test_radix_order():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 3000, dtype=np.uint64) << np.uint64(61), rng.integers(0, 2**64, 3000, dtype=np.uint64) >> rng.integers(0, 64, 3000).astype(np.uint64)
    assert (source_terms.radix_order([a, b]) == np.lexsort([b, a])).all()
    assert len(source_terms.radix_order([a[:0]])) == 0


def nearest(v, ks):
    return min(((sum((x - y) ** 2 for x, y in zip(v, k)), i) for i, k in enumerate(ks)))


def brute_clusters(rows, clusters=8, rounds=10):
    kept = [(i, [min(max(math.floor(x * 1024), -2**27), 2**27) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:clusters]
    ks = [x for _, x in first]
    for _ in range(rounds):
        at = [nearest(x, ks)[1] for _, x in kept]
        for k in set(at):
            own = [x for (_, x), a in zip(kept, at) if a == k]
            ks[k] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(x, ks)[::-1]) for i, x in kept]
    of = collections.Counter()
    for _, k, d in found:
        of[k] += d
    return [(i, k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, ks[k])).encode()).hexdigest()) for i, k, d in found]


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_clusters(spark, n):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.choice([0, 0.5, -0.25, rng.gauss(0, 1)]))) for _ in range(64)]) for i in range(n)]
    if n == 200:
        rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (300, None), (301, [0.1] * 63), (302, [0.1] * 63 + [None]), (303, [float("nan")] + [0.1] * 63), (304, [float("inf")] + [0.1] * 63), (305, [3e38] + [-3e38] * 63), (306, [])]
    df = spark.createDataFrame([(i, e, 1, 2, "x", 3) for i, e in rows], "vec_id long, embedding array<float>, label int, x int, cluster string, distance long").repartition(3)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert order and sorted(map(tuple, centroids.cluster(df).collect()), key=key) == sorted(brute_clusters(rows), key=key)


def test_orchard_search():
    rng = np.random.default_rng(2)
    for many in (1, 2, 3, 8, 40):
        ks, v = rng.integers(-3, 4, (many, 4)), rng.integers(-4, 5, (500, 4))
        apart = ((v[:, None] - ks[None]) ** 2).sum(2)
        at, near = centroids.search(v, ks)
        assert (at == apart.argmin(1)).all() and (near == apart.min(1)).all()


def brute_scores(rows, depth=suffix_tree.DEPTH, least=suffix_tree.LEAST, discount=suffix_tree.DISCOUNT):
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]) for i, t in rows]
    rest = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    train = [w for i, w in docs if rest(i) not in (None, 1)]
    n = collections.Counter(tuple(w[j:j + k]) for w in train for k in range(1, depth + 2) for j in range(len(w) - k + 1))
    followers = collections.Counter(g[:-1] for g in n)
    tokens, types = sum(map(len, train)), len([g for g in n if len(g) == 1])

    def chances(w, i, d, out):
        p = (n[w[i],] - out + 0.5) / (tokens - out + 0.5 * (types + 1))
        for k in range(1, d + 1):
            context, here = tuple(w[i - k:i]), n[tuple(w[i - k:i + 1])]
            if k > 1 and not out and n[tuple(w[i - k + 1:i + 1])] < 2:
                here = 0
            p = (max(here - out - discount, 0) + discount * (followers[context] - (out and here == 1)) * p) / (n[context] - out)
        return p

    tree = {()}
    for d in range(1, depth + 1):
        gains = collections.Counter()
        for w in train:
            for i in range(d, len(w)):
                c = tuple(w[i - d:i])
                if c[1:] in tree and n[c] >= least:
                    gains[c] += math.log(chances(w, i, d, 1) / chances(w, i, d - 1, 1))
        tree |= {c for c, g in gains.items() if g >= suffix_tree.GAIN}
    out = []
    for i, w in docs:
        score = 0
        for j in range(len(w)):
            d = max(k for k in range(min(j, depth) + 1) if tuple(w[j - k:j]) in tree)
            score += math.log10(chances(w, j, d, 0))
        base = sum(math.log10((n[x,] + 0.5) / (tokens + 0.5 * (types + 1))) for x in w)
        out.append((i, rest(i) == 1, len(w), sum(n[x,] > 0 for x in w), tokens, base, score))
    return out, tree


def sentences(n=150, seed=8):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    after = {w: [rng.choice(words) for _ in range(3)] for w in words}
    rows = []
    for i in range(n):
        w = [rng.choice(words)]
        while rng.random() > 0.02:
            w.append(rng.choice(after.get(w[-1], words)) if rng.random() < 0.8 else rng.choice(words) if rng.random() < 0.9 else f"new{rng.randrange(10**6)}")
        rows.append((i, rng.choice([" ", "  ", "\n", " \x0b"]).join(w).replace("w1", "W1")))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (2000, "İ ß É " * 50), (2001, " ".join(rows[5][1] for _ in range(200)))]


def compare_scores(df, rows):
    want, tree = brute_scores(rows)
    got = [tuple(r) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2:5], round(r[5], 6), round(r[6], 3))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6)
    return tree


def test_suffix_tree(spark):
    rows = sentences()
    df = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "doc_id long, text string, batch int, words string, kind int").repartition(4)
    tree = compare_scores(suffix_tree.score(df), rows)
    assert {len(c) for c in tree} == set(range(suffix_tree.DEPTH + 1))


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, None)], [(1, None)]])
def test_suffix_tree_of_little(spark, rows):
    compare_scores(suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_pieces_of_a_long_text(monkeypatch):
    """A text that is cut has the sequences and scores of the whole one."""
    monkeypatch.setattr(suffix_tree.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    text = " ".join(random.Random(4).choice("abcde") for _ in range(500))
    batch = pa.RecordBatch.from_pydict({"doc_id": [7], "held": [False], "train": [True], "text": [text]})
    found = []
    for size in (10**6, 37):
        monkeypatch.setattr(suffix_tree, "BATCH", size)
        n = collections.Counter()
        for row in map(lambda b: b.to_pylist()[0], suffix_tree._pack(iter([batch]))):
            x = suffix_tree._Batch(row)
            for k in range(1, suffix_tree.DEPTH + 2):
                n.update(x.keys(k)[(x.offset >= k - 1) & (x.own > 0)].tolist())
        found.append(n)
    assert found[0] == found[1] and sum(found[0].values()) == sum(501 - k for k in range(suffix_tree.DEPTH + 1))
