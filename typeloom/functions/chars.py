"""Characters, translation of pattern sources to the JVM's dialect, and making text visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_BREAK = "\u00a0"
NARROW_NO_BREAK = "\u202f"
THIN = "\u2009"
RIGHT_SINGLE_QUOTE = "’"
LEFT_SINGLE_QUOTE = "‘"

#: Unicode white space as ECMAScript's \s has it, for use inside a character class.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Characters that take two UTF-16 units.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"

#: How characters that can't be told apart by eye are named in an excerpt.
NAMES = (
    ("\u00a0", "<NBSP>"),
    ("\u202f", "<NNBSP>"),
    ("\u2009", "<THINSP>"),
    ("’", "<RSQUO>"),
    ("‘", "<LSQUO>"),
    ("“", "<LDQUO>"),
    ("”", "<RDQUO>"),
    ("„", "<BDQUO>"),
    ("«", "<LAQUO>"),
    ("»", "<RAQUO>"),
)

_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def java_pattern(source: str, flags: str = "gu") -> str:
    """The java.util.regex pattern that matches what an ECMAScript pattern of this source matches.

    White space is spelt out, `$` is the very end unless the m flag is set, and flags become an
    inline group.
    """
    out, inside, i = [], False, 0
    while i < len(source):
        c = source[i]
        if c == "\\" and i + 1 < len(source):
            pair = source[i : i + 2]
            if pair in (r"\s", r"\S"):
                if inside and pair == r"\S":
                    raise ValueError(r"\S inside a class is not supported")
                out.append(WHITE if inside else f"[{'^' if pair == chr(92) + 'S' else ''}{WHITE}]")
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[":
            out.append(r"\[" if inside else c)
            inside = True
        elif c == "]":
            inside = False
            out.append(c)
        elif c == "$" and not inside and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    inline = "".join(f for f in ("s", "i", "m") if f in flags)
    return (f"(?{inline}{'u' if 'i' in inline else ''})" if inline else "") + "".join(out)


def quoted(text: Column) -> Column:
    """The text as a JSON string literal, non-ASCII characters as they are."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = [chr(c) for c in range(32)]
    escaped = reduce(lambda acc, c: F.replace(acc, F.lit(c), F.lit(_SHORT.get(c, f"\\u{ord(c):04x}"))), controls, plain)
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def reveal(text: Column) -> Column:
    """The quoted text with easily confused characters named."""
    return reduce(lambda acc, n: F.replace(acc, F.lit(n[0]), F.lit(n[1])), NAMES, quoted(text))


def excerpt(text: Column, start: Column, length: Column, radius: int = 25) -> Column:
    """A revealed window around a match (0-based, in code points)."""
    begin = F.greatest(start - radius, F.lit(0))
    return reveal(F.substring(text, begin + 1, start + length + radius - begin))


def clipped(text: Column, most: int = 120) -> Column:
    """The beginning of a text, revealed."""
    return F.when(F.length(text) <= most, reveal(text)).otherwise(F.concat(reveal(F.substring(text, 1, most)), F.lit("...")))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.when(text.rlike(ASTRAL), F.regexp_count(text, F.lit(ASTRAL))).otherwise(F.lit(0))
