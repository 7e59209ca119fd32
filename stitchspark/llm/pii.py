"""Personal data by weak supervision.

Base kinds are found by pattern and check. Beyond them, candidate spans (tokens with digits) get votes from labelers that look at the token's shape, at
a gazetteer of words that announce personal data, and at the characters around it. Expectation maximisation over the counts of vote patterns estimates
how reliable each labeler is; the posteriors then train a logistic classifier on features of the span, which decides. Patterns of votes and features
are bounded (3 ** 4 and 2 ** 7), so only their counts leave Spark; spans stay where their documents are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound, doc_id, doc_key, whole_text

KINDS = ("email", "ip", "card", "phone", "secret", "number")
# Possessive quantifiers, and starts only where a run of characters begins or the last match ended: the leftmost matches of the plain patterns, in
# time that does not grow with the square of a run.
_MAIL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of 8 characters or more with a digit among them, that hold a candidate at most: from the first word (of letters, digits and `_`) that starts with
#: a letter or digit, to the last that ends with one. Possessive, and only where a run starts: the time is linear in a run, however long.
RUN = r"(?<![A-Za-z0-9_.-])(?=[A-Za-z_.-]*+[0-9])[A-Za-z0-9_.-]{8,}+"
LEAD = r"^(?:_[A-Za-z0-9_]*+|[.-]++)*+"
CANDIDATE = r"^[A-Za-z0-9][A-Za-z0-9_.-]*[A-Za-z0-9](?![A-Za-z0-9_])"
#: Words that announce personal data.
GAZETTEER = ("account", "api", "bearer", "card", "code", "contact", "id", "iban", "key", "login", "passwd", "password", "phone", "pin", "secret", "ssn", "tel", "token", "user")
AROUND = 24
#: The posterior from which the classifier adds a span.
LEAST = 0.9


def spans(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, value) in code points, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    def place(pieces: Column, values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("out"))
        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.char_length(F.get(pieces, i))
            e = s + F.char_length(F.get(values, i))
            return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), F.get(values, i).alias("v"))).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), start, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.when(text.rlike(pattern), bound(found, lambda v: bound(F.split(text, pattern), lambda p: place(p, v)))).otherwise(none)


def candidate_spans(text: Column) -> Column:
    """Tokens of 8 characters or more as an array of (start, end, value)."""
    def trim(c: Column) -> Column:
        rest = F.regexp_replace(c["v"], LEAD, "")
        value = F.when(rest.rlike("[0-9]"), F.regexp_extract(rest, CANDIDATE, 0)).otherwise("")
        s = c["s"] + F.char_length(c["v"]) - F.char_length(rest)
        return F.struct(s.alias("s"), (s + F.char_length(value)).alias("e"), value.alias("v"))
    return F.filter(F.transform(spans(text, RUN), trim), lambda c: c["e"] - c["s"] >= 8)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    n = lambda x: F.char_length(_digits(x["v"]))
    return {
        "email": spans(text, EMAIL),
        "ip": F.filter(spans(text, IP), lambda x: x["v"].rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": F.filter(spans(text, CARD), lambda x: F.when(n(x).between(12, 19), F.call_function("luhn_check", _digits(x["v"]))).otherwise(False)),
        "phone": F.filter(spans(text, PHONE), lambda x: n(x).between(9, 15)),
    }


def _candidates(text: Column, base: Column) -> Column:
    """Candidates outside base spans with their votes (1, 0 or -1: abstains) and features (0 or 1), as numbers v and f."""
    words = "|".join(GAZETTEER)
    def look(c: Column) -> Column:
        value, before = c["v"], F.substring(text, F.greatest(c["s"] - AROUND + 1, F.lit(1)), F.least(c["s"], F.lit(AROUND)))
        after = F.substring(text, c["e"] + 1, F.lit(1))
        digits = F.char_length(_digits(value))
        hexes, numbers = value.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"), value.rlike("^[0-9][0-9.-]*$")
        mixed = value.rlike("[A-Za-z]") & (digits * 10 >= F.char_length(value) * 2)
        announced = before.rlike(rf"(?i)(?<![a-z])(?:{words})s?(?![a-z])")
        assigned, quoted = before.rlike("[=:]\\s*[\"']?$"), before.rlike("[\"']$") & after.rlike("^[\"']")
        vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
        votes = [vote(hexes | (digits >= 9), digits < 4), vote(announced, F.lit(False)), vote(assigned | quoted, before.rlike("[A-Za-z,.] $")),
                 vote(mixed & (F.char_length(value) >= 20), F.char_length(value) < 10)]
        flags = [hexes, numbers, mixed, F.char_length(value) >= 20, announced, assigned, quoted]
        code = sum((((v + 1) * 3**i) for i, v in enumerate(votes)), F.lit(0))
        bits = sum((f.cast("int") * 2**i for i, f in enumerate(flags)), F.lit(0))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.when(numbers, "number").otherwise("secret").alias("kind"), code.alias("v"), bits.alias("f"))
    free = F.filter(candidate_spans(text), lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return F.transform(free, look)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posteriors of vote patterns by expectation maximisation: a prior, and for each labeler and truth how often it votes what."""
    votes = {code: [code // 3**i % 3 - 1 for i in range(4)] for code in counts}
    post = {code: _sigmoid(sum({1: 1.5, 0: -1.5, -1: 0}[x] for x in v) - 0.5) for code, v in votes.items()}
    for _ in range(rounds):
        sides = []
        for side in (1, 0):
            weight = {c: n * (post[c] if side else 1 - post[c]) for c, n in counts.items()}
            total = sum(weight.values())
            table = [[(sum(w for c, w in weight.items() if votes[c][i] == x) + 1) / (total + 3) for x in (-1, 0, 1)] for i in range(4)]
            sides += [math.log(total + 1), table]
        last, post = post, {c: _sigmoid(sides[0] - sides[2] + sum(math.log(sides[1][i][x + 1] / sides[3][i][x + 1]) for i, x in enumerate(v))) for c, v in votes.items()}
        if max((abs(post[c] - last[c]) for c in post), default=0) < 1e-6:
            break
    return post


def classifier(counts: dict[tuple[int, int], int], post: dict[int, float], rounds: int = 300) -> dict[int, float]:
    """Probabilities of feature patterns: logistic regression on the posteriors as soft labels, by gradient descent with momentum."""
    pooled: dict[int, list[float]] = {}
    for (code, bits), n in counts.items():
        x = pooled.setdefault(bits, [0.0, 0.0])
        x[0] += n
        x[1] += n * post[code]
    rows = [([1.0, *(float(b >> i & 1) for i in range(7))], n, y) for b, (n, y) in pooled.items()]
    total = sum(n for _, n, _ in rows) or 1
    w, move = [0.0] * 8, [0.0] * 8
    for _ in range(rounds):
        slope = [1e-4 * x for x in w]
        for x, n, y in rows:
            miss = (n * _sigmoid(sum(a * b for a, b in zip(w, x))) - y) / total
            slope = [g + miss * b for g, b in zip(slope, x)]
        move = [0.9 * m - 0.5 * g for m, g in zip(move, slope)]
        w = [a + m for a, m in zip(w, move)]
    return {b: _sigmoid(sum(a * x for a, x in zip(w, [1.0, *(float(b >> i & 1) for i in range(7))]))) for b in range(2**7)}


def personal_data(df: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans (all, as text) and found (all, as structs) for each row of `df` (doc_id, text).

    A null text is an empty text; without spans, the hash is that of an empty string. Repeated rows are returned each for itself. An empty table gives no
    rows. Spans beyond the base kinds are `secret` (keys and tokens) and `number` (identifiers of digits); none overlaps a base span."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(doc_key().alias("key"), whole_text().alias("body"))
    found = base_spans(F.col("body"))
    typed = lambda k, a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("base", F.sort_array(F.concat(*(typed(k, a) for k, a in found.items()))))
    rows = rows.withColumn("more", bound(F.col("base"), lambda b: _candidates(F.col("body"), b))).drop("body")
    rows = scratch.keep(rows, "spans")
    seen = rows.select(F.explode("more").alias("c")).groupBy("c.v", "c.f").agg(F.count("*").alias("n")).collect()  # 3**4 * 2**7 rows at most
    counts: dict[int, int] = {}
    for r in seen:
        counts[r["v"]] = counts.get(r["v"], 0) + r["n"]
    chance = classifier({(r["v"], r["f"]): r["n"] for r in seen}, reliabilities(counts))
    good = F.array(*(F.lit(chance[b] >= LEAST) for b in range(2**7)))
    kind = lambda c: F.when(c["kind"] == "number", KINDS.index("number")).otherwise(KINDS.index("secret"))
    added = F.transform(F.filter("more", lambda c: F.get(good, c["f"])), lambda c: F.struct(c["s"].alias("s"), kind(c).alias("k"), c["e"].alias("e")))
    rows = rows.withColumn("found", F.sort_array(F.concat("base", added)))
    names = F.array(*map(F.lit, KINDS))
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(doc_id("key").alias("doc_id"), *(count(k) for k in found), F.sha2(said("base"), 256).alias("base_sha256"), said("found").alias("spans"), "found")

