"""Styles: ordered rules under a name, stamped with a hash of what the rules are.

Rule wordings, sources of authority, patterns and their order below are fixed values: a style's
stamp is a hash of them, and text normalized under one stamp is comparable only with the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from typeloom.functions.chars import LEFT_SINGLE_QUOTE, NARROW_NO_BREAK, NO_BREAK
from typeloom.plans import builders as b
from typeloom.plans.rules import Ballot, Rule, conform, impose

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _mixed(data: bytes, seed: int) -> str:
    """32-bit FNV-1a of `data` from `seed`, finished with murmur3's avalanche, as 8 hex digits."""
    low = 0xFFFFFFFF
    h = seed
    for byte in data:
        h = (h ^ byte) * 0x01000193 & low
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & low
    return f"{h ^ h >> 16:08x}"


def stamp_of(rules: Iterable[Rule]) -> str:
    """12 hex digits that change with any rule's declaration and with their order."""
    data = "\n".join(r.signature for r in rules).encode()
    return _mixed(data, 0x811C9DC5) + _mixed(data, 0x9E3779B9)[:4]


@dataclass(frozen=True)
class Style:
    name: str
    standard: str
    rules: tuple[Rule, ...]
    stamp: str
    lang: str | None = None

    @property
    def id(self) -> str:
        return f"{self.name}@{self.stamp}"

    def rule(self, id: str) -> Rule:
        return next(r for r in self.rules if r.id == id)


def compose(name: str, standard: str, rules: Iterable[Rule], lang: str | None = None) -> Style:
    """A style of the given rules, in their order."""
    rules = tuple(rules)
    if not _NAME.fullmatch(name):
        raise ValueError(f"a style's name is letters, digits, dots, dashes and underscores, not {name!r}")
    if not rules:
        raise ValueError(f"style {name} has no rules")
    ids = [r.id for r in rules]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"style {name} has rule {twice[0]} more than once")
    return Style(name, standard, rules, stamp_of(rules), lang)


def derive(base: Style, name: str | None = None, lang: str | None = None, standard: str | None = None, drop: Iterable[str] = (), replace: Iterable[Rule] = (), add: Iterable[Rule] = ()) -> Style:
    """A style like `base`: rules left out, replaced where they stand, or added at the end."""
    have, gone = [r.id for r in base.rules], set(drop)
    swap, more = {r.id: r for r in replace}, list(add)
    if missing := sorted((gone | set(swap)) - set(have)):
        raise ValueError(f"style {base.name} has no rule {missing[0]} to drop or replace")
    if both := sorted(gone & set(swap)):
        raise ValueError(f"rule {both[0]} is both dropped and replaced")
    if there := [r.id for r in more if r.id in have]:
        raise ValueError(f"style {base.name} has rule {there[0]} already; replace it")
    rules = [swap.get(r.id, r) for r in base.rules if r.id not in gone] + more
    return compose(name or base.name, standard or base.standard, rules, lang or base.lang)


_DUDEN = "Duden, Die deutsche Rechtschreibung, Richtlinien"
_LEXIQUE = "Imprimerie nationale, Lexique des règles typographiques (2002)"
_ORTOGRAFIA = "RAE, Ortografía de la lengua española (2010)"
_HANDLEIDING = "Nederlandse Taalunie, Technische Handleiding (oktober 2016)"
_TAALADVIES = "Taaladvies.net (Nederlandse Taalunie, INT, Onze Taal)"
_EITHER = f"['{LEFT_SINGLE_QUOTE}]"


def _agreed(topic: str) -> str:
    return f"The Chicago Manual of Style (17th ed., 2017) and New Hart's Rules (Oxford, 2014), on {topic}"


_GERMAN = (
    b.apostrophe("German", "[']", f'{_DUDEN}, "Apostroph"'),
    b.space_before_punctuation("German", f'{_DUDEN}, "Zeichensetzung"'),
    b.straight_double_quote("German quotation marks are a matched pair", f'{_DUDEN}, "Anführungszeichen"'),
)


def _closed_up(summary: str, cite: str, mark: str, side: str, guard: bool = True) -> Rule:
    return b.inner_space(summary, cite, mark, side, b.ANY_SPACE, guard)


_quotes = f'{_DUDEN}, "Anführungszeichen"'
DE_CH = compose("de-CH", "Duden", [
    *_GERMAN,
    _closed_up("Space after the opening guillemet `«`; Swiss German sets `«Wort»` closed up", _quotes, "«", "open"),
    _closed_up("Space before the closing guillemet `»`; Swiss German sets `«Wort»` closed up", _quotes, "»", "close"),
    b.guillemet_direction("«", "German and Austrian", _quotes),
], "de-CH")

DE_DE = compose("de-DE", "Duden", [
    *_GERMAN,
    _closed_up("Space after the opening low quotation mark; German sets it closed up", _quotes, "„", "open", guard=False),
    _closed_up("Space after the opening guillemet `»`; German sets `»Wort«` closed up", _quotes, "»", "open"),
    _closed_up("Space before the closing guillemet `«`; German sets `»Wort«` closed up", _quotes, "«", "close"),
    b.guillemet_direction("»", "Swiss and French", _quotes),
], "de-DE")

EN = compose("en", "Chicago and New Hart's Rules, where they agree", [
    b.apostrophe("English", _EITHER, _agreed("the apostrophe")),
    b.apostrophe_elision(_EITHER, "(?:twas|tis|em)", r"(?:[\s.,;:!?)]|$)", ("tis", "em"), _agreed("the apostrophe")),
    b.decade_apostrophe(_EITHER, _agreed("the apostrophe before a shortened decade")),
    b.double_hyphen("English sets a dash, U+2014 closed up or U+2013 spaced", _agreed("dashes")),
    b.space_before_punctuation("English", _agreed("spacing around punctuation")),
    b.straight_double_quote("English quotation marks are a matched curly pair, double or single", _agreed("quotation marks")),
], "en")

_comillas, _signos = f'{_ORTOGRAFIA}, "Las comillas"', f'{_ORTOGRAFIA}, "Los signos de interrogación y de exclamación"'
ES = compose("es", "Real Academia Española", [
    _closed_up("Space after an opening guillemet; Spanish sets `«texto»` closed up", _comillas, "«", "open"),
    _closed_up("Space before a closing guillemet; Spanish sets `«texto»` closed up", _comillas, "»", "close"),
    b.opening_mark_space(_signos),
    b.unpaired_mark("?", _signos),
    b.unpaired_mark("!", _signos),
    b.space_before_punctuation("Spanish", f'{_ORTOGRAFIA}, "Los signos de puntuación"'),
    b.straight_double_quote('Spanish quotation marks are `«»` then `""`', _comillas),
], "es")

_NO_BREAKS = f"[{NO_BREAK}{NARROW_NO_BREAK}]"
#: Which no-break space a French text uses inside guillemets and before high punctuation.
WIDTH = Ballot((NARROW_NO_BREAK, NO_BREAK), "(?<=«)(.)|(.)(?=»)|(.)(?=[;!?])", "gs")
_ponctuation, _guillemets = f'{_LEXIQUE}, "Ponctuation"', f'{_LEXIQUE}, "Guillemets"'
FR = compose("fr", "Imprimerie nationale", [
    b.apostrophe("French", "[']", f'{_LEXIQUE}, "Apostrophe"'),
    b.colon_spacing(_ponctuation),
    b.require_space_before_punctuation("Breaking space before `; ! ?`; French requires a no-break space", _ponctuation, b.ANY_SPACE_OR_THIN, _NO_BREAKS, "[;!?]", conform(WIDTH)),
    b.inner_space("Opening guillemet whose inner space is breaking, doubled or missing", _guillemets, "«", "open", b.ANY_SPACE_OR_THIN, True, conform(WIDTH), _NO_BREAKS),
    b.inner_space("Closing guillemet whose inner space is breaking, doubled or missing", _guillemets, "»", "close", b.ANY_SPACE_OR_THIN, True, conform(WIDTH), _NO_BREAKS),
    b.minority_report("mixed-no-break-space", "Both U+00A0 and U+202F used inside guillemets or before `; ! ?`", f'{_LEXIQUE}, "Guillemets" and "Ponctuation"', WIDTH, f"(?<=«)({_NO_BREAKS})|({_NO_BREAKS})(?=»)|({_NO_BREAKS})(?=[;!?])", "g"),
    b.missing_punctuation_space(_ponctuation),
    b.straight_double_quote("French quotation marks are the guillemets", _guillemets),
], "fr")

_OPENING = r"(?<![\p{L}\p{N}])([‘“„])(?=[^\s])"
#: Which system of quotation marks a Dutch text opens its quotations with.
QUOTES = Ballot(("“", "‘", "„"), _OPENING, "gu")
NL = compose("nl", "Nederlandse Taalunie", [
    b.apostrophe("Dutch", _EITHER, f'{_HANDLEIDING}, hoofdstuk 11 "Het weglatingsteken"'),
    b.apostrophe_elision(_EITHER, "(?:ns|[stnkmr])", r"[ \-]", ("s", "t"), f'{_HANDLEIDING}, hoofdstuk 11 "Het weglatingsteken"'),
    b.apostrophe_after_symbol(_EITHER, f"{_HANDLEIDING}, paragraaf 11.5"),
    b.minority_report("mixed-quotation-marks", "More than one system of quotation marks used in the same text", f'{_TAALADVIES}, "Dubbele of enkele aanhalingstekens bij een citaat"', QUOTES, _OPENING, "gu"),
    b.ij_capital(f"{_HANDLEIDING}, paragraaf 2.4"),
    b.space_before_punctuation("Dutch", f'{_TAALADVIES}, "Wel of geen spaties voor en na leestekens en symbolen"'),
    b.straight_double_quote("Dutch quotation marks are a matched curly pair", f'{_TAALADVIES}, "Dubbele of enkele aanhalingstekens bij een citaat"'),
], "nl")

STYLES: tuple[Style, ...] = (DE_CH, DE_DE, EN, ES, FR, NL)


def with_width(width: str) -> Style:
    """French with one no-break space imposed, for a corpus whose choice has been surveyed."""
    if width not in (NO_BREAK, NARROW_NO_BREAK):
        raise ValueError("the width is U+00A0 or U+202F; nothing else is a French no-break space")
    one = impose(width)
    return derive(FR, drop=["mixed-no-break-space"], replace=[
        b.require_space_before_punctuation("Space before `; ! ?` that is not the corpus's no-break space", _ponctuation, b.ANY_SPACE_OR_THIN, None, "[;!?]", one),
        b.inner_space("Opening guillemet whose inner space is not the corpus's no-break space", _guillemets, "«", "open", b.ANY_SPACE_OR_THIN, True, one),
        b.inner_space("Closing guillemet whose inner space is not the corpus's no-break space", _guillemets, "»", "close", b.ANY_SPACE_OR_THIN, True, one),
    ])


def style_for(tag: str) -> Style | None:
    """The style of exactly this language tag, whatever its case; a region is never guessed."""
    return next((s for s in STYLES if s.lang and s.lang.lower() == tag.lower()), None)
