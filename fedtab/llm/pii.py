"""Personal data by weak supervision.

Patterns propose spans; five labelers vote on each (form, checksum or gazetteer,
context, boundary, length). Expectation-maximisation over the counts of all vote
patterns estimates how reliable each labeler is and how likely each pattern is
personal data, and a linear span classifier is trained on those likelihoods.

Only DataFrame functions touch texts and spans. What reaches the driver is one
row per vote pattern, a number fixed by the kinds and labelers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedtab.llm.quality_rules import let

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: One pattern per kind. They match what the plain patterns match, leftmost and without overlap, but look at
#: each run of characters once: possessive repeats, and no start within a run unless a match has just ended there.
#: A card's run of fewer than 7 digits has at most 11 characters, too few for any card or vote, and is passed over.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){6,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl se no dk fi ie pt eu us ca au nz in cn jp kr br mx ru"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
ISSUERS = "4 51 52 53 54 55 34 37 6011 65 35 36 38"
RESERVED_NETS = r"^0*(?:0|127|2[2-5][0-9])\."
#: Words before a span that speak for it, and what before it speaks against it.
SPEAKS_FOR = (r"(?i)(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|ip|host|server|address|card|visa|credit|account"
              r"|token|secret|password|passwd|pwd|api[_-]?key|key)\W{0,4}$")
SPEAKS_AGAINST = r"(?i)(?:[$#/\\]|version|v\.|isbn|no\.)\s?$"
#: Usual lengths of the matched text.
LENGTHS = {"email": (6, 64), "ip": (7, 15), "card": (14, 23), "phone": (10, 24), "secret": (16, 128)}
LABELERS = ("form", "listed", "context", "boundary", "length")
ROUNDS, STEPS, RATE = 40, 300, 0.5
#: Prior votes behind the belief that a labeler is right more often than not; it settles small tables.
BELIEF = 5.0


def running(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """``op`` over each prefix of an array of integers, itself included, starting with ``start``.

    An array of n values falls into blocks of about the square root of n: a prefix is the blocks before and a part of
    its own block, so the work is n times that root and nothing is copied n times.
    """
    def blocked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")

        def of(w: Column) -> Column:
            fold = lambda x: F.aggregate(x, F.lit(start), op)
            whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda b: fold(F.slice(v, b * w + 1, w)))
            before = F.aggregate(whole, F.array(F.lit(start)), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))
            return let(before, lambda p: F.transform(v, lambda x, i: let(F.floor(i / w).cast("int"), lambda b: op(
                F.get(p, b), fold(F.slice(v, b * w + 1, i - b * w + 1))))))
        return let(width, of)
    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the mod-10 check (at most 19 digits are looked at)."""
    n = F.length(value)
    digit = lambda i: F.substring(value, n - i, F.lit(1)).cast("int")
    part = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(19)) - 1), lambda i: part(digit(i), i))
    return (n > 0) & (F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _starts_with(value: Column, prefixes: str) -> Column:
    return value.rlike("^(?:" + "|".join(prefixes.split()) + ")")


def _is_base(kind: str, value: Column) -> Column:
    """Whether a match is one of the base kinds."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, before: Column, after: Column) -> Column:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    n = F.length(_digits(m))
    form = {"email": m.rlike(r"\.[A-Za-z]{2,}$"), "ip": m.rlike(OCTETS), "card": _is_base("card", m),
            "phone": n.between(10, 15), "secret": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")}[kind]
    listed = {"email": m.rlike(r"(?i)\.(?:" + "|".join(TOP_DOMAINS.split()) + ")$"), "ip": ~m.rlike(RESERVED_NETS),
              "card": _starts_with(_digits(m), ISSUERS),
              "phone": _starts_with(F.substring(m, 2, 3), COUNTRY_CODES), "secret": F.lit(None).cast("boolean")}[kind]
    clean = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    low, high = LENGTHS[kind]
    usual = F.char_length(m).between(low, high)
    return F.array(_vote(form, ~form), _vote(listed, ~listed), _vote(before.rlike(SPEAKS_FOR), before.rlike(SPEAKS_AGAINST)),
                   _vote(clean, ~clean), _vote(usual, ~usual))


def _candidates(kind: str, text: Column) -> Column:
    """Array of ``(start, kind, end, base, votes)`` of one kind, in code points from 0, end exclusive."""
    pattern, number = PATTERNS[kind], F.lit(KINDS.index(kind))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in ("card", "secret"):
        needed = text.rlike("[0-9]")
    else:
        needed = F.contains(text, F.lit(NEEDS[kind]))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>>>")

    def spans(m: Column) -> Column:
        def placed(g: Column) -> Column:
            step = F.transform(m, lambda x, i: F.char_length(F.get(g, i)) + F.char_length(x))
            ends = running(step, lambda a, x: a + x, 0)
            one = lambda e: F.transform(m, lambda x, i: F.struct(
                (F.get(e, i) - F.char_length(x)).alias("start"), number.alias("kind"), F.get(e, i).alias("end"),
                _is_base(kind, x).alias("base"),
                _votes(kind, x, F.right(F.get(g, i), F.lit(24)), F.left(F.get(g, i + 1), F.lit(1))).alias("votes")))
            return let(ends, one)
        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), placed)).otherwise(empty)
    # Runs too short for any card are not worth a vote.
    out = F.when(needed, let(found, spans)).otherwise(empty)
    return F.filter(out, lambda s: s["end"] - s["start"] >= 12) if kind == "card" else out


def candidates(text: str | Column) -> Column:
    """All proposed spans of a text in order of start, then kind; a null text has none."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return let(t, lambda x: F.array_sort(F.concat(*[_candidates(k, x) for k in KINDS])))


@dataclass(frozen=True)
class SpanModel:
    """Reliability of each labeler and the weights of the span classifier."""

    weights: tuple[float, ...]
    agrees: tuple[float, ...]

    def accepts(self, span: Column) -> Column:
        """Base spans stay; others by the classifier."""
        kind, votes = span["kind"], span["votes"]
        total = F.get(F.array(*[F.lit(w) for w in self.weights[:len(KINDS)]]), kind)
        for i in range(len(LABELERS)):
            up, down = self.weights[len(KINDS) + 2 * i:len(KINDS) + 2 * i + 2]
            v = F.get(votes, F.lit(i))
            total = total + F.when(v == 1, F.lit(up)).when(v == -1, F.lit(down)).otherwise(F.lit(0.0))
        return span["base"] | (total > 0)


def estimate(counts: dict[tuple[int, tuple[int, ...], bool], int]) -> tuple[dict, list[float]]:
    """Posterior of every (kind, votes, base) pattern and each labeler's agreement with it, by expectation-maximisation.

    Two hidden classes, independent votes given the class, one prior per kind.
    Base spans are known to be of the first class and stay there: they tie down
    which class is which.
    """
    post = {p: 1.0 if p[2] else min(0.95, max(0.05, 0.5 + 0.15 * sum(p[1]))) for p in counts}
    for _ in range(ROUNDS):
        prior, table = {}, {}
        for k in {p[0] for p in counts}:
            n = sum(c for p, c in counts.items() if p[0] == k)
            prior[k] = (1 + sum(c * post[p] for p, c in counts.items() if p[0] == k)) / (2 + n)
        for i in range(len(LABELERS)):
            for side in (True, False):
                share = {v: BELIEF * (2 + v if side else 2 - v) for v in (-1, 0, 1)}
                for p, c in counts.items():
                    share[p[1][i]] += c * (post[p] if side else 1 - post[p])
                total = sum(share.values())
                table[i, side] = {v: s / total for v, s in share.items()}
        for p in counts:
            if p[2]:
                continue
            yes, no = math.log(prior[p[0]]), math.log(1 - prior[p[0]])
            for i, v in enumerate(p[1]):
                yes += math.log(table[i, True][v])
                no += math.log(table[i, False][v])
            post[p] = 1 / (1 + math.exp(min(60.0, max(-60.0, no - yes))))
    agrees = []
    for i in range(len(LABELERS)):
        right = sum(c * (post[p] if p[1][i] > 0 else 1 - post[p]) for p, c in counts.items() if p[1][i])
        voted = sum(c for p, c in counts.items() if p[1][i])
        agrees.append(right / voted if voted else 0.5)
    return post, agrees


def train(counts: dict[tuple[int, tuple[int, ...], bool], int], post: dict) -> list[float]:
    """Weights of a logistic span classifier on (kind, votes), by gradient steps over the pattern counts."""
    def features(p):
        yield p[0]
        for i, v in enumerate(p[1]):
            if v:
                yield len(KINDS) + 2 * i + (v < 0)
    rows = [(list(features(p)), math.log1p(c), post[p]) for p, c in counts.items()]
    w = [0.0] * (len(KINDS) + 2 * len(LABELERS))
    total = sum(c for _, c, _ in rows) or 1.0
    for _ in range(STEPS):
        g = [1e-4 * x for x in w]
        for at, c, y in rows:
            z = sum(w[i] for i in at)
            miss = c / total * (1 / (1 + math.exp(-min(60.0, max(-60.0, z)))) - y)
            for i in at:
                g[i] += miss
        w = [x - RATE * 4 * d for x, d in zip(w, g, strict=True)]
    return w


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Fit the span model on the vote patterns of all texts: one counting pass, combined before its shuffle."""
    spans = docs.select(F.explode(candidates(text)).alias("s"))
    rows = spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"),
                         F.col("s.base").alias("base")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["kind"], tuple(r["votes"]), r["base"]): r["n"]
              for r in sorted(rows, key=lambda r: (r["kind"], r["votes"], r["base"]))}
    post, agrees = estimate(counts)
    return SpanModel(tuple(train(counts, post)), tuple(agrees))


def _named(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, model: SpanModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_email, n_ip, n_card, n_phone, n_spans, base, spans)`` of every row.

    ``base`` and ``spans`` are ``kind:start:end`` joined by commas. A null or
    empty text has no span; spans of different kinds may overlap; equal rows give
    equal rows; null keys are kept; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), F.filter(candidates(text), model.accepts).alias("s"))

    def of(spans: Column, kind: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    def digest(s: Column) -> Column:
        base = F.filter(s, lambda x: x["base"])
        return let(base, lambda b: F.struct(
            *[of(b, i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.size(s).cast("long").alias("n_spans"),
            _named(b).alias("base"), _named(s).alias("spans")))
    return rows.select(F.col("key").alias(key), let(F.col("s"), digest).alias("d")).select(key, "d.*")


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """Replace every span of ``text`` by ``<KIND>``; of overlapping spans the first (then the first kind) is replaced whole.

    All other columns and rows stay as they are; null texts stay null.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def apart(spans: Column) -> Column:
        """Spans merged where they overlap: the first one's kind, the furthest end."""
        def merged(reach: Column) -> Column:
            # A span that starts where all before it have ended is the first of its group.
            first = F.filter(F.transform(spans, lambda s, i: F.when((i == 0) | (F.get(reach, i - 1) <= s["start"]), i)),
                             lambda i: i.isNotNull())
            return let(first, lambda f: F.transform(f, lambda i, g: F.struct(
                F.get(spans, i)["start"].alias("start"), F.get(spans, i)["kind"].alias("kind"),
                F.get(reach, F.coalesce(F.get(f, g + 1), F.size(spans)) - 1).alias("end"))))
        return let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), 0), merged)

    def rebuilt(t: Column) -> Column:
        def pieces(s: Column) -> Column:
            end = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
            parts = F.transform(s, lambda x, i: F.concat(F.substring(t, end(i) + 1, x["start"] - end(i)), F.get(names, x["kind"])))
            return F.concat(F.array_join(parts, ""), F.substring(t, end(F.size(s)) + 1, F.char_length(t)))
        kept = F.filter(candidates(t), model.accepts)
        return let(kept, lambda s: F.when(F.size(s) == 0, t).otherwise(let(apart(s), pieces)))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), let(F.col(text), rebuilt)))
