"""Builders of the rules that styles share: a wording and a pattern, with holes for a language.

Fixed values: summaries, rule names and pattern sources are hashed into the published stamps, so
they stand here as those stamps need them.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from typeloom.functions.chars import LEFT_SINGLE_QUOTE, NARROW_NO_BREAK, NO_BREAK, RIGHT_SINGLE_QUOTE, THIN
from typeloom.functions.matches import in_prose
from typeloom.plans.rules import Ballot, Rule, Spelling, conform_rule, detect_rule, impose, replace_rule

ANY_SPACE = f"[ {NO_BREAK}{NARROW_NO_BREAK}]"
ANY_SPACE_OR_THIN = f"[ {NO_BREAK}{NARROW_NO_BREAK}{THIN}]"
_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}])"


def run_start(spaces: str) -> str:
    """An assertion that a run of `spaces` begins here, which leaves one way to match it."""
    return f"(?<!{spaces})"


def wrong_apostrophe_marks(wrong: str) -> str:
    return "Straight quote or U+2018" if LEFT_SINGLE_QUOTE in wrong else "Straight apostrophe"


def _marks(wrong: str) -> tuple[str, ...]:
    return tuple(c for c in ("'", LEFT_SINGLE_QUOTE) if c in wrong)


def apostrophe(language: str, wrong: str, cite: str) -> Rule:
    return replace_rule("apostrophe", f"{wrong_apostrophe_marks(wrong)} between letters; {language} uses U+2019", cite, rf"(?<=\p{{L}}){wrong}(?=\p{{L}})", RIGHT_SINGLE_QUOTE, triggers=_marks(wrong))


def apostrophe_elision(wrong: str, clitics: str, boundary: str, examples: tuple[str, ...], cite: str) -> Rule:
    for word in examples:
        if not re.match(f"(?:{clitics})(?:{boundary})", word + " "):
            raise ValueError(f"{word!r} is given as an example of the clitics and isn't one")
    such = " or ".join(f"`{RIGHT_SINGLE_QUOTE}{w}`" for w in examples)
    return replace_rule("apostrophe-elision", f"{wrong_apostrophe_marks(wrong)} on a word-initial elision such as {such}", cite, f"{_NOT_AFTER_WORD}{wrong}(?={clitics}{boundary})", RIGHT_SINGLE_QUOTE, triggers=_marks(wrong))


def apostrophe_after_symbol(wrong: str, cite: str) -> Rule:
    return detect_rule("apostrophe-after-symbol", "Straight quote after a digit or symbol where Dutch takes U+2019", cite, rf"(?<=[\p{{N}}@&+]){wrong}(?=\p{{L}})", narrowed=in_prose, triggers=_marks(wrong))


def decade_apostrophe(wrong: str, cite: str) -> Rule:
    return replace_rule("decade-apostrophe", f"{wrong_apostrophe_marks(wrong)} on a decade such as `{RIGHT_SINGLE_QUOTE}90s`", cite, f"{_NOT_AFTER_WORD}{wrong}(?=[0-9]0s{_NOT_BEFORE_WORD})", RIGHT_SINGLE_QUOTE, triggers=_marks(wrong))


def colon_spacing(cite: str) -> Rule:
    return replace_rule("colon-spacing", "Breaking space before a colon; French requires U+00A0", cite, " (?=:)", NO_BREAK, flags="g", triggers=(" :",))


def double_hyphen(instead: str, cite: str) -> Rule:
    return detect_rule("double-hyphen", f"Double hyphen between words; {instead}", cite, r"(?<=\p{L})--(?=\p{L})", narrowed=in_prose, triggers=("--",))


def guillemet_direction(opens: str, convention: str, cite: str) -> Rule:
    foreign = {"«": "»", "»": "«"}[opens]
    way = {"«": "outward", "»": "inward"}[foreign]
    return detect_rule("guillemet-direction", f"Guillemets point {way} (`{foreign}Wort{opens}`), which is the {convention} setting", cite, rf"{foreign}(?=[\p{{L}}\p{{N}}])", triggers=(foreign,))


def ij_capital(cite: str) -> Rule:
    return detect_rule("ij-capital", "Word-initial `Ij`; the Dutch digraph capitalises as `ij` or `IJ`, never `Ij`", cite, rf"{_NOT_AFTER_WORD}Ij(?=\p{{Ll}})", triggers=("Ij",))


#: The marks whose inner side has a rule, and the family that names it.
FAMILIES = {"«": "guillemet", "»": "guillemet", "„": "low-quote"}
#: By side and by whether a single space of some class counts as right: the pattern of mark and run, and where the mark goes in a repair.
_INNER = {
    ("open", False): ("{outer}{mark}{run}", "before"),
    ("open", True): ("{outer}{mark}(?!{right}(?!{spaces})){run}", "before"),
    ("close", False): ("{start}{run}{mark}{outer}", "after"),
    ("close", True): ("{start}(?!{right}{mark}){run}{mark}{outer}", "after"),
}
_OUTER = {("open", True): _NOT_AFTER_WORD, ("close", True): _NOT_BEFORE_WORD}


def inner_space(summary: str, cite: str, mark: str, side: str, spaces: str, guard: bool, spelling: Spelling | None = None, admissible: str | None = None) -> Rule:
    """The space on the inner side of a quotation mark: none without `spelling`, else that spelling.

    A single space of the class `admissible` counts as right whichever it is.
    """
    row = _INNER.get((side, admissible is not None))
    if mark not in FAMILIES or row is None:
        raise ValueError(f"no rule for the {side!r} side of {mark!r}")
    shape, where = row
    source = shape.format(outer=_OUTER.get((side, guard), ""), start=run_start(spaces), mark=mark, spaces=spaces, right=admissible, run=spaces + ("*" if spelling else "+"))
    return conform_rule(f"{FAMILIES[mark]}-{side}-space", summary, cite, source, spelling or impose(""), triggers=(mark,), **{where: mark})


def minority_report(id: str, summary: str, cite: str, ballot: Ballot, source: str, flags: str) -> Rule:
    """Reports the spellings that lost a text's ballot."""
    return detect_rule(id, summary, cite, source, flags, "warning", keep=lambda _, m, minority: F.array_contains(minority, m["m"]), ballot=ballot)


def missing_punctuation_space(cite: str) -> Rule:
    return detect_rule("missing-punctuation-space", "No space at all before `; : ! ?`, where French requires one", cite, r"""\p{L}[;:!?](?=[\s»)\]"'’]|$)""", shift=(1, -1), triggers=(";", ":", "!", "?"))


def opening_mark_space(cite: str) -> Rule:
    return replace_rule("opening-mark-space", "Space after `¿` or `¡`; the mark is set against the word it opens", cite, f"(?<=[¿¡]){ANY_SPACE}+", "", triggers=("¿", "¡"))


def space_before_punctuation(language: str, cite: str) -> Rule:
    return detect_rule("punctuation-spacing", f"Space before `; : ! ?`, which {language} does not take", cite, rf"\p{{L}}{ANY_SPACE}+[;:!?]", narrowed=in_prose, shift=(1, -2), triggers=(";", ":", "!", "?"))


def require_space_before_punctuation(summary: str, cite: str, spaces: str, admissible: str | None, marks: str, spelling: Spelling) -> Rule:
    """`marks` is a class of single characters."""
    return conform_rule("punctuation-spacing", summary, cite, f"{f'(?!{admissible})' if admissible else ''}{spaces}(?={marks})", spelling, triggers=tuple(marks.strip("[]")))


def straight_double_quote(instead: str, cite: str) -> Rule:
    return detect_rule("straight-double-quote", f"Straight double quote; {instead}", cite, '"', "g", "warning", triggers=('"',))


#: What each mark needs before it, and its rule's name.
PAIRS = {"?": ("¿", "unpaired-question"), "!": ("¡", "unpaired-exclamation")}


def unpaired_mark(mark: str, cite: str) -> Rule:
    """A closing mark of a sentence that no opening mark begins."""
    opener, id = PAIRS[mark]
    follows = r"(?<=[\p{L}\p{N}\p{Pf}\p{Pe}'’])"
    closed = follows + in_prose(f"[{mark}]")

    def keep(text, m, _):
        # The marks themselves end sentences, so all of this sentence is in the text since the match before.
        sentence = F.substring_index(F.translate(m["gap"], ".!?…", "\n\n\n\n"), "\n", -1)
        return ~m["gap"].contains(opener) | ~sentence.contains(opener)

    # As many matches as findings: sentences from their beginning to the mark, without the opener.
    tally = rf"(?<![^.!?\n…])[^.!?\n…{opener}]*+{closed}"
    return detect_rule(id, f"Sentence ends in `{mark}` with no opening `{opener}`", cite, re.sub(r"([?])", r"\\\1", mark), "g", keep=keep, triggers=(mark,), narrowed=lambda plain: f"(?={plain}){closed}", tally=tally)
