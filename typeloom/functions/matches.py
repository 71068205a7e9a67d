"""Matches of a pattern with their positions, and predicates about where a match stands.

A text is cut at its matches; positions are running sums over the pieces, taken in two levels
so that a text with many matches doesn't cost the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeloom.functions.chars import WHITE, utf16_length


def no_texts() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once; named in a lambda, a column would be worked out at every call."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def running(a: Column, combine: Callable[[Column, Column], Column], zero: Column, block: int = 16) -> Column:
    """Inclusive running combination (of an associative operation) of an array, in two levels."""
    part = lambda i: F.floor(i / block).cast("int")
    fold = lambda x: F.aggregate(x, zero, combine)

    def over(a: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), part(F.size(a) - 1)), lambda b: fold(F.slice(a, b * block + 1, block)))
        before = F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))
        return let(before, lambda before: F.transform(a, lambda _, i: combine(F.get(before, part(i)), fold(F.slice(a, part(i) * block + 1, i % block + 1)))))

    return let(a, over)


def positioned(m: Column, gaps: Column) -> Column:
    """array<struct<m, gap, start, index, line, column>> from matches and the texts between them.

    `start` is 0-based in code points, `index` in UTF-16 units; `line` and `column` (UTF-16) are
    1-based; `gap` is the text since the match before.
    """

    def extent(s: Column) -> Column:
        """Code points, units, newlines, and units since the last newline."""
        rows = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
        units = utf16_length(s)
        tail = F.when(s.contains("\n"), utf16_length(F.substring_index(s, "\n", -1))).otherwise(units)
        return F.struct(F.length(s).alias("points"), units.alias("units"), rows.alias("rows"), tail.alias("tail"))

    def after(x: Column, y: Column) -> Column:
        tail = F.when(y["rows"] > 0, y["tail"]).otherwise(x["tail"] + y["tail"])
        return F.struct((x["points"] + y["points"]).alias("points"), (x["units"] + y["units"]).alias("units"), (x["rows"] + y["rows"]).alias("rows"), tail.alias("tail"))

    nothing = F.struct(*(F.lit(0).alias(n) for n in ("points", "units", "rows", "tail")))
    # What stands between two matches' beginnings: a match and the gap that follows it.
    extents = F.transform(m, lambda _, i: F.when(i == 0, extent(F.get(gaps, i))).otherwise(after(extent(F.get(m, i - 1)), extent(F.get(gaps, i)))))
    placed = F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("gap"), running(extents, after, nothing).alias("at"))
    return F.transform(
        placed,
        lambda z: F.struct(
            z["m"].alias("m"), z["gap"].alias("gap"), z["at"]["points"].alias("start"), z["at"]["units"].alias("index"), (z["at"]["rows"] + 1).alias("line"), (z["at"]["tail"] + 1).alias("column"),
        ),
    )


def first_other(text: Column, pattern: str, m: Column, right: Column) -> Column:
    """struct<m, start> of the first match of `pattern` in `text` that isn't `right`; null without one. `m` are its matches."""
    k = F.array_position(F.transform(m, lambda x: x != right), True).cast("int")
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x))
    gaps = F.split(text, pattern, -1)
    place = let(k, lambda k: F.when(k > 0, F.struct(F.get(m, k - 1).alias("m"), (total(F.slice(gaps, 1, k)) + total(F.slice(m, 1, k - 1))).alias("start"))))
    return F.when(F.size(m) > 0, place)


#: A token is looked for so far on either side; one that goes on beyond counts as machine-made.
TOKEN_SCAN = 128


def in_prose(pattern: str) -> str:
    """`pattern` (java.util.regex, its first character no hyphen) where the token around its start isn't machine-made.

    The same as `looks_machine`, but asked by the pattern itself: the token's part before the start
    and the part from it on are looked over, at most TOKEN_SCAN characters each, and no text is cut.
    """
    plain = f"[^{WHITE}=/]"
    before = rf"(?<=(?:\A|[{WHITE}])(?:[^{WHITE}=/\-]{plain}{{0,{TOKEN_SCAN - 1}}})?)"
    return rf"(?={pattern}){before}(?={plain}{{0,{TOKEN_SCAN}}}+(?:[{WHITE}]|\z)){pattern}"


def looks_machine(text: Column, start: Column) -> Column:
    """Whether the token around a 0-based place is code, an address or an option rather than prose."""
    lo = F.greatest(start - TOKEN_SCAN, F.lit(0))
    left = F.regexp_extract(F.substring(text, lo + 1, start - lo), f"([^{WHITE}]*)\\z", 1)
    right = F.regexp_extract(F.substring(text, start + 1, TOKEN_SCAN), f"^([^{WHITE}]*)", 1)
    a, b = start - F.length(left), start + F.length(right)
    white = lambda at: F.substring(text, at, 1).rlike(f"[{WHITE}]")
    bounded = ((a == 0) | white(a)) & ((b >= F.length(text)) | white(b + 1))
    token = F.concat(left, right)
    return ~bounded | token.contains("://") | token.contains("=") | token.contains("/") | token.startswith("-")
