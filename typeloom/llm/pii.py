"""Personal data by weak supervision, in DataFrame expressions only.

Candidates come from strict patterns (their spans are kept as they are) and from wider ones
(obfuscated addresses, national numbers, unusual separators). Labelers vote on a candidate:
the strict pattern with its checks, gazetteers (top-level domains, issuer prefixes, calling
codes, plausible octets), words to its left that speak for or against it, and what it touches.
How often each pattern of votes occurs is counted over all candidates of all documents; from
these counts expectation-maximisation estimates each labeler's reliability, and a logistic span
classifier is trained on the resulting soft labels, from the votes and from features of the span
that no labeler sees (its kind, length, digits and separators). It decides, as a Spark expression, which
candidates of the wider patterns are added. The count table has a row per pattern of votes and
features, whose number doesn't depend on the data; it is all that reaches the driver.

Defined results: null text counts as empty; a document without spans has zero counts and empty
`spans`; added spans never overlap strict ones or each other (of two that would, the one that begins
first counts, and of those the kind listed first); repeated rows give equal results; an empty table
gives an empty result; other columns are ignored unless carried, and may have any name but one with
two underscores first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import stash

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns. Possessive, and begun only where a match could begin, they find what the
#: plain forms find, without backtracking over long runs.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\(\[\{](?i:at)[\)\]\}] ?[A-Za-z0-9-]++(?: ?(?:[\(\[\{](?i:dot)[\)\]\}]|\.) ?[A-Za-z0-9-]++){1,5}+",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A text can hold the kind only if it holds this; tested before the pattern runs.
NEEDS = {("email", True): "@", ("phone", True): "+", ("ip", True): ".", ("email", False): "at", ("ip", False): ":"}

TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "nl", "it", "ch", "at")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
SPEAKS_FOR = r"(?i)(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|mastercard|credit|ip|host|server|address)\b[^A-Za-z0-9]{0,3}$"
SPEAKS_AGAINST = r"(?i)(?:version|ver|isbn|issn|sku|order|invoice|no|nr|section|chapter|build|release|#)[. :#]{0,3}$"
LEFT, RIGHT = 24, 8
LABELERS = ("strict", "gazetteer", "context", "against", "touching")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once; named in a lambda, a column would be worked out at every call."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def fold_before(a: Column, zero: Column, combine: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For each entry of an array, the fold (of an associative operation) of those before it; near linear in its length."""
    fold = lambda x: F.aggregate(x, zero, combine)
    part = lambda i: F.floor(i / block).cast("int")

    def over(a: Column) -> Column:
        folds = F.transform(F.sequence(F.lit(0), part(F.size(a) - 1)), lambda b: fold(F.slice(a, b * block + 1, block)))
        starts = F.aggregate(folds, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
        return let(starts, lambda starts: F.transform(a, lambda _, i: combine(F.get(starts, part(i)), fold(F.slice(a, part(i) * block + 1, i % block)))))

    return let(a, over)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit test."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        return F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """The checks of the strict patterns beyond their regular expressions."""
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str, strict: bool) -> Column:
    none = F.array().cast("array<string>")
    pattern = (STRICT if strict else WIDE)[kind]
    gate = text.contains(NEEDS[kind, strict]) if (kind, strict) in NEEDS else text.rlike("[0-9]{4}" if not strict else "[0-9][ -]?[0-9]")
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


_NO_SPANS = "array<struct<start:int,end:int,m:string,left:string,right:string,kind:int,strict:boolean>>"


def _spans(text: Column, m: Column, gaps: Column, kind: str, strict: bool) -> Column:
    """Matches with their offsets in code points and what stands on either side."""
    steps = F.zip_with(gaps, m, lambda g, x: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(x), F.lit(0)))

    def span(x: Column, i: Column, before: Column) -> Column:
        start = F.get(before, i) + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"), (start + F.length(x)).alias("end"), x.alias("m"), F.substring(F.get(gaps, i), -LEFT, LEFT).alias("left"), F.substring(F.get(gaps, i + 1), 1, RIGHT).alias("right"),
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(strict).alias("strict"),
        )

    placed = let(fold_before(steps, F.lit(0), lambda p, q: p + q), lambda before: F.transform(m, lambda x, i: span(x, i, before)))
    return F.when(F.size(m) > 0, F.filter(placed, lambda s: passes(kind, s["m"]) if strict else F.lit(True))).otherwise(F.array().cast(_NO_SPANS))


#: Beyond any place in a text.
_FAR = 2**31 - 1


def _clear(base: Column, wide: Column) -> Column:
    """`wide` spans that touch neither a base span nor a wide one before them: one sweep from either side over all spans in order."""
    item = lambda late: lambda s: F.struct(s["start"].alias("start"), F.lit(late).alias("late"), s["kind"].alias("kind"), s["end"].alias("end"), s.alias("s"))
    spans = F.array_sort(F.concat(F.transform(base, item(0)), F.transform(wide, item(1))))

    def sweep(spans: Column) -> Column:
        seen = fold_before(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda p, q: F.greatest(p, q))
        ahead = fold_before(F.transform(F.reverse(spans), lambda x: F.when(x["late"] == 0, x["start"]).otherwise(F.lit(_FAR))), F.lit(_FAR), lambda p, q: F.least(p, q))
        rows = F.arrays_zip(spans.alias("x"), seen.alias("seen"), F.reverse(ahead).alias("ahead"))
        free = F.filter(rows, lambda r: (r["x"]["late"] == 1) & (r["seen"] <= r["x"]["start"]) & (r["ahead"] >= r["x"]["end"]))
        return F.transform(free, lambda r: r["x"]["s"])

    return let(spans, sweep)


def candidates(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, `__base` (spans of the strict patterns) and `__wide` (other candidates, none overlapping them)."""
    if bad := [c for c in carry if c.startswith("__")]:
        raise ValueError(f"rename {bad} first: names with two underscores are used within")
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*carry, text.alias("__text"))
    ways = [(k, s) for s in (True, False) for k in KINDS]
    df = df.withColumns({f"__m_{k}_{s}": _found(F.col("__text"), k, s) for k, s in ways})
    df = df.withColumns({f"__g_{k}_{s}": F.when(F.size(f"__m_{k}_{s}") > 0, F.split("__text", (STRICT if s else WIDE)[k], -1)) for k, s in ways})
    df = df.withColumns({f"__s_{k}_{s}": _spans(F.col("__text"), F.col(f"__m_{k}_{s}"), F.col(f"__g_{k}_{s}"), k, s) for k, s in ways})
    df = df.withColumns({"__base": F.concat(*(F.col(f"__s_{k}_True") for k in KINDS)), "__any": F.concat(*(F.col(f"__s_{k}_False") for k in KINDS))})
    return df.select(*carry, "__base", F.when(F.size("__any") > 0, _clear(F.col("__base"), F.col("__any"))).otherwise(F.col("__any")).alias("__wide"))


def votes(s: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 for personal data, -1 against, 0 for no opinion."""
    kind, m = s["kind"], s["m"]
    yes = lambda cond, other=0: F.when(cond, F.lit(1)).otherwise(F.lit(other))
    tld = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind == 0, yes(tld.isin(*TLDS), -1))
        .when(kind == 1, yes(~m.rlike(r"(?:^|\.)0[0-9]|^0\."), -1))
        .when(kind == 2, yes(_digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), -1))
        .otherwise(yes(F.when(m.startswith("+"), m.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})")).otherwise(m.rlike(r"^\(?[2-9][0-9]{2}")), -1))
    )
    return [
        yes(s["strict"]),
        gazetteer,
        yes(s["left"].rlike(SPEAKS_FOR)),
        F.when(s["left"].rlike(SPEAKS_AGAINST), F.lit(-1)).otherwise(F.lit(0)),
        F.when(s["left"].rlike(r"[A-Za-z0-9_/=]$") | s["right"].rlike(r"^[A-Za-z0-9_/=@]"), F.lit(-1)).otherwise(F.lit(1)),
    ]


SPAN_FEATURES = (*(f"is_{k}" for k in KINDS), "long", "many_digits", "separated")


def span_features(s: Column) -> list[Column]:
    """0 or 1 for each of SPAN_FEATURES: what the span itself shows."""
    m = s["m"]
    yes = [*(s["kind"] == k for k in range(len(KINDS))), F.length(m) > 16, F.length(_digits(m)) >= 10, m.rlike(r"[0-9A-Za-z][ ()/:_-][ ()0-9A-Za-z]")]
    return [F.when(y, F.lit(1)).otherwise(F.lit(0)) for y in yes]


@dataclass
class SpanClassifier:
    """Weights of each labeler's vote for either value, weights of the span's own features, and a bias."""

    reliability: dict[str, tuple[float, float]]
    weights: list[tuple[float, float]]
    features: list[float]
    bias: float

    def accepts(self, s: Column) -> Column:
        logit = F.lit(self.bias)
        for (plus, minus), v in zip(self.weights, votes(s), strict=True):
            logit = logit + F.when(v == 1, F.lit(plus)).when(v == -1, F.lit(minus)).otherwise(F.lit(0.0))
        for w, f in zip(self.features, span_features(s), strict=True):
            logit = logit + w * f
        return logit > 0


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: Candidates that the prior of the reliabilities is worth: it gives way as soon as there are more.
PRIOR = 20.0
#: Of a labeler for a true and for a false candidate, the chances of its votes before any is seen: right in four of five cases.
GIVEN = {1: {1: 0.6, 0: 0.25, -1: 0.15}, 0: {1: 0.15, 0: 0.25, -1: 0.6}}

Votes = tuple[int, ...]


def estimate(patterns: dict[Votes, int], rounds: int = 50) -> tuple[dict[Votes, float], list[dict[int, dict[int, float]]]]:
    """By expectation-maximisation over counted votes: the chance that candidates of each pattern are true, and each labeler's chances of its votes.

    Votes are taken as independent given the truth; the prior keeps the classes from changing roles.
    """
    j = len(LABELERS)
    rate = [{z: dict(GIVEN[z]) for z in (0, 1)} for _ in range(j)]
    total, share, soft = sum(patterns.values()), 0.5, {}
    for _ in range(rounds):
        for v in patterns:
            like = {z: math.log(share if z else 1 - share) + sum(math.log(rate[k][z][v[k]]) for k in range(j)) for z in (0, 1)}
            soft[v] = _sigmoid(like[1] - like[0])
        share = (sum(n * soft[v] for v, n in patterns.items()) + 0.5 * PRIOR) / (total + PRIOR)
        for k in range(j):
            for z in (0, 1):
                weight = {x: PRIOR * GIVEN[z][x] for x in (1, 0, -1)}
                for v, n in patterns.items():
                    weight[v[k]] += n * (soft[v] if z else 1 - soft[v])
                whole = sum(weight.values())
                rate[k][z] = {x: w / whole for x, w in weight.items()}
    return soft, rate


def aggregate_votes(patterns: list[tuple[Votes, Votes, int]], steps: int = 600) -> SpanClassifier:
    """A logistic regression on the soft labels that `estimate` gives; `patterns` are votes, span features and how often they occur together."""
    j, by_votes = len(LABELERS), {}
    for v, _, n in patterns:
        by_votes[v] = by_votes.get(v, 0) + n
    soft, rate = estimate(by_votes)
    reliability = {name: (rate[k][1][1], rate[k][0][-1]) for k, name in enumerate(LABELERS)}

    # Every pattern weighs by the logarithm of its count, so that frequent ones don't drown the rest.
    x = [[*(float(y == 1) for y in v), *(float(y == -1) for y in v), *map(float, f)] for v, f, _ in patterns]
    y, weight = [soft[v] for v, _, _ in patterns], [1 + math.log(n) for _, _, n in patterns]
    w, bias, whole = [0.0] * (2 * j + len(SPAN_FEATURES)), 0.0, sum(weight) or 1.0
    for _ in range(steps):
        grad, gb = [0.002 * a for a in w], 0.0
        for row, target, often in zip(x, y, weight, strict=True):
            d = often * (_sigmoid(bias + sum(a * b for a, b in zip(w, row, strict=True) if b)) - target) / whole
            gb += d
            grad = [g + d * b for g, b in zip(grad, row, strict=True)]
        bias -= gb
        w = [a - g for a, g in zip(w, grad, strict=True)]
    return SpanClassifier(reliability, list(zip(w[:j], w[j : 2 * j], strict=True)), w[2 * j :], bias)


def train(found: DataFrame) -> SpanClassifier:
    """Count votes and features of all candidates, and learn from the counts."""
    every = found.select(F.explode(F.concat("__base", "__wide")).alias("s"))
    voted = every.select(*(v.cast("int").alias(n) for n, v in zip(LABELERS, votes(F.col("s")), strict=True)), *(f.alias(n) for n, f in zip(SPAN_FEATURES, span_features(F.col("s")), strict=True)))
    counted = voted.groupBy(*LABELERS, *SPAN_FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 32 patterns of votes, times 32 of features
    return aggregate_votes(sorted((tuple(r[n] for n in LABELERS), tuple(r[n] for n in SPAN_FEATURES), r["n"]) for r in counted))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, by start and then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def detect(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, `__base` and `__spans`: strict spans, and those with what the classifier adds."""
    found = stash(candidates(docs, carry), "pii-candidates")
    model = train(found)
    return found.select(*carry, "__base", F.concat("__base", F.filter("__wide", model.accepts)).alias("__spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of strict spans by kind, base_sha256 and spans."""
    of = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return detect(docs).select("doc_id", *map(of, range(4)), F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    columns = docs.columns
    df = detect(docs, tuple(columns))
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        more = F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, more).otherwise(acc["done"]).alias("done"))

    clean = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["done"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return df.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))).select(*columns)
