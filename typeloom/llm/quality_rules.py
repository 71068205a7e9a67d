"""Quality rules: a learned decision list over text statistics, emitted as a Spark conditional.

Statistics of whole texts are counted over their bytes in batches. From labelled documents,
sequential covering learns an ordered list: a rule is grown by adding the threshold condition
of the highest information gain on one part of the sample, pruned on the other part from its
last condition back, and kept if it is precise there; what it covers is set aside, and the
next rule is learned from the rest. The list is a chain of WHEN conditions on the statistics.

The fitting is bounded: a sample of at most 1.2 * `PER_CLASS` + 60 documents a class; of each statistic, `THRESHOLDS`
candidate thresholds among bad documents and as many among all, evenly by rank; `LONGEST` conditions a
rule and `MOST` rules. The judging isn't: every text is counted whole.

Defined results: a null or empty text has zero statistics and fails the base rules; without
labels of both classes the list is empty and only the base rules decide; repeated rows are
judged alike; equal labels of one id count once; an empty table gives an empty result; other columns are
ignored unless carried, and a carried name that is added (in any case) is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm import bytewords as bw
from typeloom.llm.common import bound_batches, in_order, labelled_sample, refuse_clashes, tidy

PER_CLASS = 3000
THRESHOLDS, LONGEST, MOST = 64, 3, 12
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims", "n_echoes", "n_lines")
#: Statistics that conditions are about: interpretable ratios of the counts.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word_chars": ("word_chars", "n_words"),
}


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _UPPER, _EXCLAIM, _NEWLINE = _bytes("#*$%&|<>"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("!"), _bytes("\n")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return bw.mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def count_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each row."""
    rows = len(offsets) - 1
    s, e, row = bw.words_of(data, offsets)
    h = bw.span_hashes(data, s, e)
    words = np.bincount(row, minlength=rows)
    out = {"n_words": words}
    inside = ~bw.SPACE[data]
    out["word_chars"] = _per_row(inside & ((data & 0xC0) != 0x80), offsets)
    for name, of in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_exclaims", _EXCLAIM)):
        out[name] = _per_row(of[data], offsets)
    out["n_echoes"] = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows)

    ls, le, lrow = bw.words_of(data, offsets, _NEWLINE)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    full = seen[le] > seen[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    lines = np.bincount(lrow, minlength=rows)
    distinct, first = np.unique(_in_row(bw.span_hashes(data, ls, le), lrow), return_index=True)
    out["n_lines"], out["n_dup_lines"] = lines, lines - np.bincount(lrow[first], minlength=rows)

    repeated = np.zeros(len(h), bool)
    if len(h) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        k = [np.uint64(x) for x in (0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
        window = _in_row(bw.mix64(h[at] * k[0] + bw.mix64(h[at + 1] * k[1] + bw.mix64(h[at + 2] * k[2]))), row[at])
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for d in range(3):
            repeated[at[twice] + d] = True
    out["n_repeat_words"] = np.bincount(row[repeated], minlength=rows)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and the COUNTS of each row's text."""
    bound_batches(docs.sparkSession)
    refuse_clashes(carry, *COUNTS, "base_failed", "kept")
    schema = docs.select(*carry).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bw.ranges(whole, budget=2 << 20):
                got = count_statistics(*bw.texts_of(b.column(b.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carry), *(pa.array(got[c]) for c in COUNTS)], names=[*carry, *COUNTS])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(tidy(run), schema)


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] > self.threshold if self.above else x[self.stat] <= self.threshold

    def column(self) -> Column:
        num, den = RATIOS[self.stat]
        ratio = F.col(num) / F.greatest(F.lit(1), F.col(den))
        return ratio > self.threshold if self.above else ratio <= self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are of low quality."""

    conditions: tuple[Condition, ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def ratios_of(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: counts[a] / np.maximum(1, counts[b]) for k, (a, b) in RATIOS.items()}


def _thresholds(v: np.ndarray, most: int = THRESHOLDS) -> np.ndarray:
    """Midpoints between neighbouring values, `most` of them, evenly by rank."""
    u = np.unique(v)
    if len(u) < 2:
        return np.zeros(0)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else mid[np.unique(np.linspace(0, len(mid) - 1, most).astype(int))]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    held, rule = np.ones(len(bad), bool), []
    while len(rule) < longest and (~bad & held).any():
        p0, n0 = int((bad & held).sum()), int((~bad & held).sum())
        best, gain = None, 1e-9
        for stat, v in x.items():
            for t in _thresholds(v[held & bad]).tolist() + _thresholds(v[held]).tolist():
                for above in (True, False):
                    c = Condition(stat, above, float(t))
                    hit = held & c.holds(x)
                    p1, n1 = int((bad & hit).sum()), int((~bad & hit).sum())
                    if p1:
                        g = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = c, g
        if best is None:
            break
        # The cut between the classes is moved to the middle of the gap around it.
        v = x[best.stat]
        inside, outside = v[held & best.holds(x)], v[held & ~best.holds(x)]
        if len(outside):
            t = (inside.min() + outside.max()) / 2 if best.above else (inside.max() + outside.min()) / 2
            best = Condition(best.stat, best.above, float(t))
        rule.append(best)
        held &= best.holds(x)
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, longest: int = LONGEST, most: int = MOST, precise: float = 0.9) -> list[Rule]:
    """Rules in order. `part`: True where a row is for growing, False where it is for pruning."""
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most and (bad & left & part).sum() >= 3:
        grow, prune = left & part, left & ~part
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], longest)
        if not conditions:
            break

        def worth(cs: list[Condition], on: np.ndarray) -> float:
            hit = on & Rule(tuple(cs)).covers(x)
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            return (p - n) / (p + n) if p + n else -1.0

        cut = max(range(1, len(conditions) + 1), key=lambda k: (worth(conditions[:k], prune), -k))
        rule = Rule(tuple(conditions[:cut]))
        hit = left & rule.covers(x)
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        on_prune = worth(list(rule.conditions), prune)
        if p < precise * (p + n) or -1.0 < on_prune < 2 * precise - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def train(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from labelled documents whose crc32(doc_id) mod 3 is not 1; every third of them, in an order by hash, prunes."""
    sample, _ = labelled_sample(docs, labels, "quality", PER_CLASS)
    rows = in_order(statistics(sample.withColumn("text_key", F.xxhash64("text")), ("doc_id", "y", "text_key")), "text_key", "y")
    x = ratios_of({c: np.array([r[c] for r in rows], np.float64) for c in COUNTS})
    return learn_list(x, np.array([r["y"] for r in rows], int) == 0, np.arange(len(rows)) % 3 != 0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as nested conditionals: False at the first rule that fits, else True."""
    out = F.lit(True)
    for rule in reversed(rules):
        meets = F.lit(True)
        for c in rule.conditions:
            meets = meets & c.column()
        out = F.when(meets, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, the base statistics, base_failed and kept."""
    failed = base_failed()
    return statistics(docs, carry).select(*carry, *COUNTS[:5], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
