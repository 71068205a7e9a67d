"""Rules: what to look for, how to repair it, and the signature that a style's stamp hashes.

A rule is metadata on the driver that emits Column expressions. There are three kinds.
`replace` repairs every match with a literal, `conform` with a spelling worked out from the
text itself, and `detect` only reports, after an optional predicate on the match.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeloom.functions.chars import java_pattern
from typeloom.functions.matches import let


def encoded(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class Ballot:
    """Counts which of several spellings a text uses. Earlier candidates win ties.

    A match of the pattern votes for the candidate that equals it; other matches abstain.
    """

    candidates: tuple[str, ...]
    source: str
    flags: str = "g"

    def __post_init__(self) -> None:
        if len(self.candidates) < 2:
            raise ValueError("a ballot with one candidate decides nothing")
        if "g" not in self.flags:
            raise ValueError("a ballot's pattern must be global")

    @property
    def signature(self) -> str:
        return encoded([*self.candidates, self.source, self.flags])

    def votes(self, text: Column) -> Column:
        """array<bigint> of votes, in the order of the candidates."""
        found = F.regexp_extract_all(text, F.lit(java_pattern(self.source, self.flags)), F.lit(0))
        fresh = F.transform(F.array(*map(F.lit, self.candidates)), lambda c: F.size(F.filter(found, lambda m: m == c)).cast("long"))
        # Most texts hold no candidate, and need no pattern.
        return F.when(reduce(Column.__or__, map(text.contains, self.candidates)), fresh).otherwise(F.array_repeat(F.lit(0).cast("long"), len(self.candidates)))

    def verdict(self, votes: Column) -> Column:
        """The candidate with most votes."""
        best, most = F.lit(self.candidates[0]), F.get(votes, F.lit(0))
        for i, c in enumerate(self.candidates[1:], 1):
            n = F.get(votes, F.lit(i))
            best, most = F.when(n > most, F.lit(c)).otherwise(best), F.greatest(n, most)
        return best

    def minority(self, votes: Column) -> Column:
        """Candidates that got votes and lost; empty unless two or more got any."""
        pairs = F.filter(F.arrays_zip(F.array(*map(F.lit, self.candidates)).alias("c"), votes.alias("n")), lambda p: p["n"] > 0)
        names = F.transform(pairs, lambda p: p["c"])
        lost = F.filter(names, lambda c: c != self.verdict(votes))
        return F.when(F.size(names) > 1, lost).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Spelling:
    """A spelling that is imposed, or one that conforms to the ballot of the text at hand."""

    imposed: str | None = None
    ballot: Ballot | None = None

    @property
    def signature(self) -> str:
        return f"impose {encoded(self.imposed)}" if self.ballot is None else f"conform {self.ballot.signature}"

    def of(self, text: Column) -> Column:
        return F.lit(self.imposed) if self.ballot is None else self.ballot.verdict(self.ballot.votes(text))


def impose(spelling: str) -> Spelling:
    return Spelling(imposed=spelling)


def conform(ballot: Ballot) -> Spelling:
    return Spelling(ballot=ballot)


#: A predicate on (text, match, minority candidates) that keeps a match.
Keep = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    summary: str
    cite: str
    severity: str
    kind: str
    source: str
    flags: str
    params: tuple[str, ...] = ()
    #: What a repair writes before and after the spelling; for `replace`, the literal is the spelling.
    spelling: Spelling | None = None
    before: str = ""
    after: str = ""
    keep: Keep | None = field(default=None, compare=False)
    ballot: Ballot | None = None
    #: Added to a finding's index and length.
    shift: tuple[int, int] = (0, 0)
    #: A text without any of these can't match; spares it the pattern.
    triggers: tuple[str, ...] = ()
    #: What makes the JVM's pattern of the translated one: conditions on a match that a pattern can tell.
    narrowed: Callable[[str], str] | None = field(default=None, compare=False)
    #: For a rule with `keep`, a pattern of which there are as many matches as the rule has findings.
    tally: str | None = field(default=None, compare=False)

    @property
    def fixable(self) -> bool:
        return self.spelling is not None

    @property
    def pattern(self) -> str:
        plain = java_pattern(self.source, self.flags)
        return self.narrowed(plain) if self.narrowed else plain

    @property
    def signature(self) -> str:
        parts = (self.kind, self.id, self.summary, self.cite, self.severity, self.source, self.flags, *self.params)
        return "\0".join(map(encoded, parts))

    def repair(self, text: Column) -> Column:
        """What each match is replaced with."""
        assert self.spelling is not None
        return F.concat(F.lit(self.before), self.spelling.of(text), F.lit(self.after))

    def possible(self, text: Column) -> Column:
        out = F.lit(not self.triggers)
        for t in self.triggers:
            out = out | text.contains(t)
        return out

    def count(self, text: Column) -> Column:
        """How many findings a text has; null for a null text. No match is placed."""
        pattern = F.lit(self.tally or self.pattern)
        if self.fixable:
            n = F.size(self.wrong(text))
        elif self.ballot is not None:
            found = F.regexp_extract_all(text, pattern, F.lit(0))
            lost = self.ballot.minority(self.ballot.votes(text))
            n = let(lost, lambda lost: F.when(F.size(lost) > 0, F.size(F.filter(found, lambda m: F.array_contains(lost, m)))).otherwise(F.lit(0)))
        elif self.keep is None or self.tally:
            n = F.regexp_count(text, pattern)
        else:
            return F.lit(None)
        return F.when(self.possible(text), n).otherwise(F.when(text.isNotNull(), F.lit(0)))

    def fix(self, text: Column) -> Column:
        if self.spelling is None:
            return text
        return F.when(self.possible(text), F.regexp_replace(text, F.lit(self.pattern), self.repair(text))).otherwise(text)

    def wrong(self, text: Column) -> Column:
        """Matches (texts) of a fixable rule that its repair would change."""
        found = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        return let(self.repair(text), lambda right: F.filter(found, lambda m: m != right))


def _global(flags: str, rule_id: str) -> None:
    if "g" not in flags:
        raise ValueError(f"rule {rule_id}: the pattern must be global")


def replace_rule(id: str, summary: str, cite: str, source: str, replacement: str, flags: str = "gu", severity: str = "error", triggers: tuple[str, ...] = ()) -> Rule:
    """Repairs every match with a literal."""
    _global(flags, id)
    if "$" in replacement or "\\" in replacement:
        raise ValueError(f"rule {id}: the replacement must be a literal")
    return Rule(id, summary, cite, severity, "replace", source, flags, (replacement,), impose(replacement), triggers=triggers)


def conform_rule(id: str, summary: str, cite: str, source: str, spelling: Spelling, flags: str = "gu", severity: str = "error", before: str = "", after: str = "", triggers: tuple[str, ...] = ()) -> Rule:
    """Repairs every match with the spelling of its text, worked out once per text."""
    _global(flags, id)
    return Rule(id, summary, cite, severity, "conform", source, flags, (spelling.signature,), spelling, before, after, triggers=triggers)


def detect_rule(
    id: str, summary: str, cite: str, source: str, flags: str = "gu", severity: str = "error", keep: Keep | None = None, ballot: Ballot | None = None, shift: tuple[int, int] = (0, 0),
    triggers: tuple[str, ...] = (), narrowed: Callable[[str], str] | None = None, tally: str | None = None,
) -> Rule:
    """Reports matches that `keep` lets through; with a ballot, `keep` sees the text's minority spellings."""
    _global(flags, id)
    params = () if ballot is None else (ballot.signature,)
    return Rule(id, summary, cite, severity, "detect", source, flags, params, keep=keep, ballot=ballot, shift=shift, triggers=triggers, narrowed=narrowed, tally=tally)
