"""The document operators against brute force on small tables, with nulls, empty and long texts, repeats, empty tables and clashing column names."""

import collections
import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stitchspark.llm import exact_dups, langid, mixing, near_dups, packing, pii, quality, sharding, toxicity, url_lists
from stitchspark.llm.queries import RUN, SQL

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, name int, _gone long, size string, h double"
WORD = r"[^\x20\x09-\x0D]+"


def made(n=60, seed=1):
    """(doc_id, text, lang, source): texts, copies with other white space, near copies, and the odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeghilmnorst") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))
        if i % 7 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1].replace(" ", "  ", 1)
        if i % 7 == 5 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    return rows + [(n, None, "en", "a"), (n + 1, "", None, "b"), (n + 2, " \n\t ", "en", None), (n + 3, long, "en", "a"), (n + 4, long + " end", "en", "a"),
                   (None, "no id at all", "en", "a"), (None, None, None, None), (5, rows[5][1], rows[5][2], rows[5][3]), (6, "a second text of six", "en", "b")]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "s", 0.5) for r in ROWS], KIND).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    return re.findall(WORD, text or "")


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (near_dups.near_groups(empty), quality.quality(empty), mixing.mix(empty)[0], sharding.shard(empty), pii.personal_data(empty), packing.pack(empty),
               toxicity.toxicity(empty, labels), exact_dups.exact_groups(empty), langid.identify(empty)):
        assert df.count() == 0
    entries = spark.createDataFrame([], "list string, key string, verdict string, action string, effective_at timestamp")
    assert url_lists.decide(spark.createDataFrame([], "capture_id long, url string, fetched_at timestamp"), entries).count() == 0


def test_near_groups(docs):
    sets = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i].append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    group = {i: i for i in sets}
    find = lambda x: x if group[x] == x else find(group[x])
    order = lambda i: 2**63 if i is None else i
    for a in sets:
        for b in sets:
            if order(a) < order(b) and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)), key=order)
                group[y] = x
    got = near_dups.near_groups(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, find(i)) for i in sets}
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == collections.Counter((i, len(s)) for i, x in sets.items() for s in x)


def test_near_groups_in_one_bucket(spark):
    """A long chain of texts, each near its neighbours only, is one group; a passage that all share links nothing."""
    chain = [" ".join(f"w{j}" for j in range(k * 12, k * 12 + 120)) for k in range(30)]
    passage = " ".join(f"p{j}" for j in range(60))
    shared = [passage + " " + " ".join(f"q{i}_{j}" for j in range(60)) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chain + shared)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_groups(df).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[i] == i for i in range(30, 330))


def test_repeated_ids_link_nothing(spark):
    """Unrelated texts of one id, or without an id, are no bridge; what resembles nothing that stays, stays."""
    text = lambda name, end="": " ".join(f"{name}{j}" for j in range(80)) + end
    rows = [(3, text("x", " more")), (7, text("x")), (7, text("y")), (9, text("y", " more")), (None, text("z")), (None, text("v")), (None, text("v")),
            (20, text("z", " more")), (21, text("v", " more")), (22, text("w")), (22, text("w")), (22, text("w", " more"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_groups(df).collect())
    once = collections.Counter((r["doc_id"], r["component_id"]) for r in near_dups.near_groups(df).collect())
    assert once == collections.Counter([(3, 3), (7, 3), (7, 7), (9, 7), (None, 20), (None, 21), (None, 21), (20, 20), (21, 21), (22, 22), (22, 22), (22, 22)])
    assert got[7, 3, False] == got[7, 7, True] == got[9, 7, False] == 1 and got[22, 22, True] == 3
    stay = collections.Counter(near_dups.drop_near_copies(df).select("doc_id", "text").collect())
    assert stay[3, rows[0][1]] == stay[7, rows[2][1]] == 1 and not stay[7, rows[1][1]] and not stay[9, rows[3][1]]
    assert sum(n for (i, _), n in stay.items() if i == 22) == 1 and sum(n for (i, _), n in stay.items() if i is None) == 0


def test_components(spark):
    from stitchspark.llm.common import Scratch
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in near_dups.components(edges, Scratch(spark), "t").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100}


def test_exact_groups(docs):
    for block in (16, 4096):
        got = exact_dups.exact_groups(docs, block).collect()
        sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        order = lambda i: 2**63 if i is None else i
        by = collections.defaultdict(list)
        for i, t, *_ in ROWS:
            by[sha(t)].append(i)
        want = collections.Counter((i, min(g, key=order), len(g), k == 0, s) for s, g in by.items() for k, i in enumerate(sorted(g, key=order)))
        assert collections.Counter(map(tuple, got)) == want
    stay = exact_dups.drop_copies(docs)
    assert stay.columns == docs.columns and sorted(order(r["doc_id"]) for r in stay.collect()) == sorted(order(min(g, key=order)) for g in by.values())


def test_one_row_of_each_text_stays(spark):
    """Rows that share the smallest id, or have none, are told apart."""
    rows = [(None, "the same text of no id"), (None, "the same  text of no id"), (None, "the same text of no id"), (None, "the same text of no id")] + [(5, "five words are in here now")] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _row int")
    one = exact_dups.drop_copies(df)
    assert one.columns == df.columns and sorted(str(r["doc_id"]) for r in one.collect()) == ["5", "None"]
    assert sorted(str(r["doc_id"]) for r in near_dups.drop_near_copies(df).collect()) == ["5", "None"]
    assert collections.Counter((r["doc_id"], r["kept"]) for r in exact_dups.exact_groups(df).collect()) == {(None, True): 1, (None, False): 3, (5, True): 1, (5, False): 2}


def test_quality_statistics(docs):
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w, t = words(t), t or ""
        seen, covered = collections.Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)), set()
        for j in range(len(w) - 4):
            if seen[tuple(w[j:j + 5])] > 1:
                covered.update(range(j, j + 5))
        lines = [x for x in t.split("\n") if words(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    got = quality.quality(docs)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got.collect()) == want
    assert got.filter("base_failed and kept").count() == 0


def test_quality_outliers(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 200)))
    rows = [(i, text(), "en", "a") for i in range(400)] + [(1000 + i, text().replace(" ", "### "), "en", "a") for i in range(12)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in got if i >= 1000) and all(got[i] for i in got if i < 1000)


@pytest.mark.parametrize("junk", (120, 267, 360))
def test_quality_outliers_that_are_many(spark, junk):
    """A quarter, 40 and 47 % of a group are junk."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 200)))
    rows = [(i, text(), "en", "a") for i in range(400)] + [(1000 + i, " ".join(w + rng.choice(["###", "", "%%$"]) for w in text().split()), "en", "a") for i in range(junk)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in got if i >= 1000) and all(got[i] for i in got if i < 1000)


def test_mix(docs):
    documents, parts = mixing.mix(docs, block_words=8)
    rows = documents.collect()
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    total, left = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2)))
    target, rest = {}, total
    while left:  # shares by weight; full sources leave
        full = [s for s in left if rest * left[s] / sum(left.values()) > 3 * sizes[s]]
        if not full:
            target |= {s: rest * w / sum(left.values()) for s, w in left.items()}
            break
        for s in full:
            target[s] = 3 * sizes[s]
            del left[s]
        rest = total - sum(target.values())
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    for s in sizes:
        of = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in of} == {sizes[s]} and all(abs(r["target"] - target[s]) < 1e-6 * total for r in of)
        assert abs(sum(r["taken"] for r in of) - target[s]) <= 8 * 8
    assert parts.agg(F.sum("words")).first()[0] == sum(r["taken"] for r in rows)
    again = mixing.mix(docs.repartition(5), block_words=8)[0].collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again)
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    whole = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    assert set(whole) <= {(i, t, s) for i, t, _, s in ROWS} and all(n <= 3 * sum((i, t, s) == (a, b, c) for a, b, _, c in ROWS) for (i, t, s), n in whole.items())
    longest = max(len(words(t)) for _, t, _, _ in ROWS)
    for s in sizes:
        assert abs(sum(n * len(words(t)) for (_, t, x), n in whole.items() if x == s) - target[s]) <= longest / 2 + 8 * 8


def test_shards(spark, docs):
    for df, n in ((docs, len(ROWS)), (spark.createDataFrame([(i, "the same" if i % 3 == 0 else f"text {i // 2}") for i in range(600)], "doc_id long, text string"), 600)):
        got = sharding.shard(df).collect()
        count = collections.Counter(r["shard"] for r in got)
        assert len(got) == n and max(count.values()) - min(count[b] for b in range(16)) <= 1
        assert all(sorted(r["slot"] for r in got if r["shard"] == b) == list(range(count[b])) for b in count)
    spread = collections.defaultdict(set)
    for r in got:
        spread[r["text_crc32"]].add(r["shard"])
    # A third of the rows need 6 shards; of the hundred pairs few are apart, though hardly a document is left to change places with.
    assert len(spread[zlib.crc32(b"the same")]) <= 7 and sum(len(x) > 1 for x in spread.values()) <= 6


@pytest.mark.parametrize("same", (7, None))
def test_shards_of_identical_rows(spark, same):
    """A third of the rows repeat an id, or have none, and a text: each is dealt for itself."""
    df = spark.createDataFrame([(same if i % 3 == 0 else 1000 + i, "the same" if i % 3 == 0 else f"text {i // 2}") for i in range(600)], "doc_id long, text string").repartition(3)
    got = sharding.shard(df).collect()
    count = collections.Counter(r["shard"] for r in got)
    assert len(got) == 600 and set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == b) == list(range(count[b])) for b in count)
    assert len({r["shard"] for r in got if r["doc_id"] == same}) <= 7


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
              (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))
    for k, (pattern, good) in enumerate(checks):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_personal_data(spark):
    texts = ["mail a.b@c.d.e, a@b.c_d@e.f x@y @z.w a@@b.c", "ß😀 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111", "+1 (555) 123-4567 +12 +++49 30 1234567",
             'token = "740d10cfb38a379bfbce847f43f32482d573dc8b" for b9a81ebc', "", None, "1" * 50_000, "a." * 30_000 + "@b" + ".c" * 30_000, "1 2 3 4 " * 8_000, "1.2." * 20_000]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, r = base(t), got[i]
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (i, said, r["spans"][:200])
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[0] == k for x in want) for k in pii.KINDS[:4]]
        assert {x for x in said.split(",") if x} <= set(r["spans"].split(","))


def test_long_tokens(spark):
    """Tokens of any length are candidates, in linear time."""
    hexes = "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(40))
    token = lambda n: re.sub("[0-9]{9,}", lambda m: "a" * len(m[0]), hexes[:n])
    texts = [f'{name} = "{token(n)}" here' for n in (20, 80, 81, 128, 2000) for name in ("token", "api key")] + ["plain words without anything of the kind 12345678"] * 3
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts[:10]):
        assert got[i] == f"secret:{t.index(chr(34)) + 1}:{t.rindex(chr(34))}", (i, got[i])
    old = r"(?<![A-Za-z0-9_])(?=[A-Za-z_.-]{0,79}[0-9])[A-Za-z0-9][A-Za-z0-9_.-]{6,78}[A-Za-z0-9](?![A-Za-z0-9_])"
    rng = random.Random(9)
    short = ["".join(rng.choice("ab1_.- ") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    long = ["a_." * 100_000 + "1", "1_." * 100_000, "a." * 100_000, "_1" * 100_000, "-.a1" * 50_000]
    spans = lambda c: [[(x["s"], x["v"]) for x in r[0]] for r in df.select(c).collect()]
    df = spark.createDataFrame([(t,) for t in short], "text string")
    assert spans(pii.candidate_spans(F.col("text"))) == [[(m.start(), m[0]) for m in re.finditer(old, t)] for t in short]
    df = spark.createDataFrame([(t,) for t in long], "text string")
    assert [[len(v) for _, v in x] for x in spans(pii.candidate_spans(F.col("text")))] == [[300_001], [], [], [], [199_998]]


def test_labelers():
    yes, no = sum(2 * 3**i for i in range(4)), 0
    post = pii.reliabilities({yes: 50, no: 200, 1 + 3 + 9 + 27: 10})
    assert post[yes] > 0.95 and post[no] < 0.05
    chance = pii.classifier({(yes, 0b1111111): 50, (no, 0): 200}, post)
    assert chance[0b1111111] > 0.9 and chance[0] < 0.1


def test_packing(docs):
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[(i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack(docs).collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        x.sort()
        assert sum(n for _, n in x) <= 2048 and [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))]
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 2


def test_packing_query_cuts_a_short_first_piece(spark, tmp_path):
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "one two", 2: None, 3: "a " * 5000, 4: "a " * 2047, 5: "a " * 2048, 6: " a" * 4095}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        start = 0
        for k in range(-(-len(ids) // 2048)):
            end = len(ids) - 2048 * (-(-len(ids) // 2048) - 1 - k)
            want.add((i, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start = end
    got = RUN["op6_minimum_bin_slack"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want


def test_token_ids_of_odd_texts():
    files = [packing.public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    tokenizer, encoder = Tokenizer.from_file(files[0]), packing._Encoder(*files)
    for t in ("", " ", "a  b", "a \n b", " a", "a ", "a  b", "it's  5\t\tx", "é  z", "a <|endoftext|> b", "x<|endoftext|>", "日本 語", "\x1c a \x85 b", "ab" * 3000, "a" + " " * 3000 + "b", "\u00e9" * 1990):
        assert encoder.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [0], repr(t)


@settings(deadline=None)
@given(st.text(max_size=60))
def test_token_ids_of_any_text(text):
    files = [packing.public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    encoder = packing._encoder(*files)
    assert encoder.ids(text).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids + [0]


def test_fill():
    assert sum(packing.fill([9, 7, 5, 3], 15, {9: 1, 7: 1, 5: 1, 3: 1})) == 15
    assert packing.fill([8], 7, {8: 4}) == []


def test_toxicity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeimnorstu") for _ in range(rng.randint(3, 7)))
    known, rows, labels = [word() for _ in range(300)], [], []
    for i in range(500):
        w = [rng.choice(known) for _ in range(rng.randint(20, 120))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["zwackhead", "quozzlejunk"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    odd = [(1000, None), (1001, ""), (1002, "1 2 3"), (None, "zwackheads here"), (7, rows[7][1])]
    got = toxicity.toxicity(spark.createDataFrame(rows + odd, "doc_id long, text string"), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == 505 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    test = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in test) >= 0.95 * len(test)
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1  # a spelling that was never seen
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))


def test_language(spark):
    rng = random.Random(6)
    letters = {"en": "aethionsr", "de": "eninschäü", "fr": "éèeuoailç"}
    rows = [(i, " ".join("".join(rng.choice(letters[g]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))), g) for i, g in ((i, rng.choice("en de fr".split())) for i in range(240))]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 ;; 3", None), (None, "the sine hat", None), (3, *rows[3][1:])]
    got = langid.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()
    assert len(got) == 245 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (500, 501, 502))
    test = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert test and sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in test) >= 0.95 * len(test)


def test_every_language_is_learned(spark):
    """70 languages, the rarest of 3 documents."""
    rng = random.Random(7)
    word = lambda k: "".join(chr(0x4E00 + 30 * k + rng.randrange(30)) for _ in range(rng.randint(2, 6)))
    rows = [(1000 * k + i, " ".join(word(k) for _ in range(40)), f"l{k:02}") for k in range(70) for i in range(8 if k < 64 else 3)]
    learned = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    rare = {f"l{k}" for k in range(64, 70) if any(i in learned for i, _, g in rows if g == f"l{k}")}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert rare and all(got[i] == g for i, _, g in rows if g in rare)
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 50, "b").otherwise("a").alias("lang"))
    found = collections.Counter(r["lang"] for r in langid.drawn(many, {"a": 59_950, "b": 50}, 20).collect())
    assert found == {"a": 20, "b": 20}


def test_url_lists(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rng = random.Random(8)
    keys = ["a.example.com", "example.com", "b.example.com", "b.example.com/x", "other.org"]
    entries = [(rng.choice("pq"), rng.choice(keys), rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), at(rng.randint(0, 300))) for _ in range(120)] + [("p", None, "block", "add", at(1)), ("p", "other.org", "block", "add", None)]
    captures = [(i, rng.choice(["http://A.example.com/y", "https://u@b.example.com:80/x/z?q", "http://b.example.com", "other.org", None, "", "ftp://other.org/#f"]), at(rng.randint(0, 330))) for i in range(200)]
    captures += [(None, "http://example.com", at(200)), (1, captures[1][1], captures[1][2]), (900, "http://example.com", None)]
    got = url_lists.decide(spark.createDataFrame(captures, "capture_id long, url string, fetched_at timestamp"), spark.createDataFrame(entries, "list string, key string, verdict string, action string, effective_at timestamp")).collect()
    assert len(got) == len(captures)
    by = collections.defaultdict(dict)
    for name, key, verdict, action, when in entries:
        if key and when:
            by[name, key][when] = max(by[name, key].get(when, ("", "")), (action, verdict))
    for r, (i, url, when) in zip(sorted(got, key=lambda r: (r["capture_id"] is None, r["capture_id"] or 0)), sorted(captures, key=lambda c: (c[0] is None, c[0] or 0))):
        host = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").lower())
        asked = set()
        if host and when:
            labels = host[1].split(".")
            asked = {".".join(labels[k:]) for k in range(len(labels) - 1)} | {host[1] + "/" + p for p in re.findall(r"://[^/?#]+/([^/?#]+)", url)}
        met = []
        for (name, key), said in by.items():
            past = [t for t in said if when and t <= when]
            if key in asked and past and said[max(past)][0] == "add":
                met.append((len(key), said[max(past)][1] == "block", max(past), name, key))
        assert r["n_active"] == len(met)
        assert (r["verdict"], r["key"]) == (("block" if max(met)[1] else "allow", max(met)[4]) if met else (None, None))


def test_pipeline(spark, docs):
    rows = docs.unionByName(docs.filter("doc_id % 9 = 1 or doc_id is null"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "pack"]
    one = corpus_pipeline.quality_rules(spark, rows, "").persist()
    assert one.columns == rows.columns
    fine = collections.Counter((r["doc_id"], r["n_words"]) for r in quality.quality(rows).collect() if r["kept"])
    assert collections.Counter((r["doc_id"], len(words(r["text"]))) for r in one.collect()) == fine
    two = corpus_pipeline.exact_dedup(spark, one, "").persist()
    flat = lambda df: sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in df.collect())
    assert sorted(set(flat(one))) == flat(two) and two.columns == rows.columns
    three = corpus_pipeline.near_dedup(spark, two, "").persist()
    groups = near_dups.near_groups(two).collect()
    assert sorted(str(r["doc_id"]) for r in three.collect()) == sorted([str(c) for c in {r["component_id"] for r in groups if r["n_shingles"]}] + [str(r["doc_id"]) for r in groups if not r["n_shingles"]])
    assert three.columns == rows.columns
    four = corpus_pipeline.source_mix(spark, three, "").persist()
    assert four.columns == rows.columns and 0 < four.count()
    assert corpus_pipeline.pack(spark, four, "").filter("piece = 0").count() == four.count()


def test_queries():
    assert sum(bool(re.match(r"op\d+_", k)) for k in RUN) == 13 and "pipeline" in RUN and set(SQL) <= set(RUN)


def test_texts_are_asked_for_by_signature():
    """Of a bucket's blocks only nodes of pairs that are alike, in several components and first together in this band ask for their texts."""
    sig = np.arange(near_dups.BANDS * near_dups.ROWS, dtype=np.int32)
    near, far, late = sig.copy(), sig + 10_000, sig.copy()
    near[-60:] += 1
    late[0] += 1  # shares no first band, but the second
    block = {"nodes": [1, 2, 3, 4, 5], "comps": [1, 2, 3, 1, 5], "sigs": [sig, near, far, sig, late]}
    row = {"bucket": 7, "band": 0} | block | {f"{k}2": v for k, v in block.items()}
    got = pd.concat(near_dups._alike(iter([pd.DataFrame([row])])))
    assert sorted(got.itertuples(index=False, name=None)) == [(7, 1), (7, 2), (7, 4)]
    later = pd.concat(near_dups._alike(iter([pd.DataFrame([row | {"band": 1}])])))
    assert sorted(later["node"]) == [1, 2, 4, 5]
