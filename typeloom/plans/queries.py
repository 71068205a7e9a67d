"""Queries over the driver's tables, one per operator, each with SQL of its own making.

The generated documents hold hardly any of the marks that the rules are about. So each document
is preceded by a carrier sentence, chosen by its id; every text is read whole. The SQL shares no
pattern with the rules: its engine has no look-around, so it marks what it finds and counts marks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.chars import NARROW_NO_BREAK, NO_BREAK, THIN, excerpt
from typeloom.functions.matches import looks_machine
from typeloom.operators import engine
from typeloom.plans import builders
from typeloom.plans.rules import detect_rule, replace_rule
from typeloom.plans.styles import QUOTES, STYLES, Style, compose, derive, with_width
from typeloom.sources.texts import dealt

Query = Callable[[SparkSession, str], DataFrame]

N, W = NO_BREAK, NARROW_NO_BREAK
CARRIERS = (
    "It's the reader's choice, isn't it?",
    "‘Tis said 'tis late; get 'em, 'twas so.",
    "Cars of the '60s, songs of the ‘70s -- not all--were loud.",
    "See well--known and --flag x--y http://a.b/c--d k=v--w for it",
    "What ! Why ? So ; thus : end",
    f"Odd{N}! and wide{W}? and a/b ! and -x : done",
    'He said "no" and "yes".',
    "Er sagte „ Wort“ und » Wort « dann »Wort« und «Wort».",
    "Das war's : er ging » weiter« und kam ;",
    f"Elle a dit «{N}mot{N}» puis «{W}mot{W}» et « mot » et «mot».",
    f"Quoi ! Non{THIN}? Si{N}; oui{W}! voilà : fin  !",
    f"«{N}{N}deux{N} » l'eau d'un été! non? si;",
    f"Bien{W}? Mal{W}! Vu{W}; «{N}tout{N}»",
    "¿ Qué? ¡ Vaya! Y tú? Ven! (ya)! 'así'!",
    "« texto » y «texto » y « texto» url http://x.y/z? a=b! -no!",
    "Hola. ¿Cómo? Bien? ¡Sí! No! Nunca...!",
    "'s Morgens en ‘t huis, auto's en 'ns tijd",
    "Alle foto‘s van 2010's en een B5'tje, @'q &'z http://c'd 7'u/v",
    "“Noord” en ‘zuid’, „oost” of “west”",
    "Ijs en Ijzer maar niet IJs; Ijsland ! klaar",
    "plain words without any mark at all",
    "tab\tand 'quote' at end's end'",
    f"aaa{' ' * 12}« b »{' ' * 9}c",
    "naïve café — l'œuvre ; l'été : « ça » !",
)

# ---- the Spark side -------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def planted(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    carrier = F.get(F.array(*map(F.lit, CARRIERS)), (F.col("doc_id") % len(CARRIERS)).cast("int"))
    return documents(spark, sf_dir).select("doc_id", "source", *more, F.concat(carrier, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


def normalize_query(style: Style, spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.changed(planted(spark, sf_dir), style).select("doc_id", F.md5(F.col("fixed")).alias("fixed_md5"), F.length("fixed").cast("long").alias("n_chars"), "changed")


def counted(style: Style, spark: SparkSession, sf_dir: str) -> DataFrame:
    """style, rule, severity, fixable, docs and findings: one row per rule of the style."""
    return engine.finding_totals(planted(spark, sf_dir), (style,))


def check_rows(style: Style, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the style, with its place and excerpt."""
    found = engine.check(planted(spark, sf_dir).select("doc_id", "text"), style)
    return found.select("doc_id", "rule", *(F.col(c).cast("long").alias(c) for c in ("index", "length", "line", "column")), "excerpt")


def all_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.finding_totals(planted(spark, sf_dir), STYLES)


def severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_counted(spark, sf_dir).rollup("style", "severity").agg(F.sum("findings").alias("findings"))


def coverage_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_counted(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("styles"), F.count_if(F.col("findings") > 0).alias("reached"))


def unfixable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.unfixable(all_counted(spark, sf_dir)).groupBy("style").agg(F.sum("findings").alias("undecided"))


def strict_exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.sum(F.when(F.col("severity") == "error", F.col("findings")).otherwise(0))
    return all_counted(spark, sf_dir).groupBy("style").agg((errors > 0).cast("int").alias("exit_code"), (F.sum("findings") > 0).cast("int").alias("strict_exit_code"))


def line_column_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = compose("quotes", "ours", [builders.straight_double_quote("none", "ours")])
    pages = dealt(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text")))
    return engine.check(pages, quotes).select("page_id", F.col("index").cast("long").alias("index"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"))


def excerpt_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark, sf_dir)
    at = (F.length("text") / 2).cast("int")
    return docs.select("doc_id", excerpt(F.col("text"), at, F.lit(1)).alias("middle"), excerpt(F.col("text"), F.lit(10), F.lit(3), 10).alias("start"))


def token_is_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark, sf_dir)
    at = F.instr("text", "b") - 1
    return docs.where(at >= 0).select("doc_id", looks_machine(F.col("text"), at).alias("machine"))


def width_survey(by: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine.survey_width(planted(spark, sf_dir), by)
    return got.select(*by, "full", "narrow", F.when(F.col("verdict") == N, "full").otherwise("narrow").alias("verdict"), "minority_count")


def quote_system_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine.survey(planted(spark, sf_dir), QUOTES, ("source",))
    return got.select("source", *(F.get("votes", F.lit(i)).alias(n) for i, n in enumerate(("double", "single", "low"))), "verdict", "minority")


def minority_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of the losing width in each text that mixes widths."""
    fr = next(s for s in STYLES if s.name == "fr")
    mixed = compose("mixed", "ours", [fr.rule("mixed-no-break-space")])
    return engine.check(planted(spark, sf_dir).select("doc_id", "text"), mixed).groupBy("doc_id").agg(F.min("index").cast("long").alias("first"), F.count(F.lit(1)).alias("n"))


def after_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fixable rules still find in each document once it is normalized, by style."""
    out = None
    for style in STYLES:
        fixable = compose(style.name, style.standard, [r for r in style.rules if r.fixable])
        fixed = engine.normalize(planted(spark, sf_dir).select("text"), style)
        one = engine.finding_totals(fixed, (fixable,)).groupBy("style").agg(F.sum("findings").alias("left_over"))
        out = one if out is None else out.unionByName(one)
    return out


def normalize_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the style of its own language."""
    fixed = engine.normalize_by_language(planted(spark, sf_dir, "lang"))
    return fixed.select("doc_id", "style", F.md5("fixed").alias("fixed_md5"), (F.col("fixed") != F.col("text")).alias("changed"))


def file_report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report per document: whether German (DE) fixing changes it, and how many findings it has."""
    style = next(s for s in STYLES if s.name == "de-DE")
    got = engine.report(planted(spark, sf_dir), style, "doc_id")
    return got.select(F.col("file").alias("doc_id"), "changed", F.size("findings").cast("long").alias("findings"))


PING_PONG = compose("ping-pong", "ours", [replace_rule("to-b", "a to b", "ours", "a", "b", triggers=("a",)), replace_rule("to-a", "b to a", "ours", "b", "a", triggers=("b",)), replace_rule("double", "c doubled", "ours", "c", "cc", triggers=("c",))])


def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a style that breaks every promise breaks them, over all documents."""
    return engine.audit(planted(spark, sf_dir).select("doc_id", "text"), PING_PONG).drop("ordinal")


def style_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each style its stamp, and how many rules it has and can fix, in their order."""
    rules = engine.catalog(spark, (*STYLES, with_width(NO_BREAK), with_width(NARROW_NO_BREAK)))
    ordered = F.array_sort(F.collect_list(F.struct("position", F.col("fixable").cast("int").cast("string").alias("bit"))))
    return rules.groupBy("style", "stamp").agg(F.count(F.lit(1)).alias("rules"), F.count_if("fixable").alias("fixable"), F.array_join(F.transform(ordered, lambda x: x["bit"]), "").alias("bits"))


def derive_drop_replace_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English without its quote rule, with ellipses added and its dashes replaced, over all documents."""
    en = next(s for s in STYLES if s.name == "en")
    own = derive(en, name="house", drop=["straight-double-quote"], replace=[detect_rule("double-hyphen", "any double hyphen", "ours", "--", triggers=("--",))], add=[replace_rule("ellipsis", "three dots", "ours", r"\.\.\.", "…", triggers=("...",))])
    return counted(own, spark, sf_dir)


# ---- the SQL side ---------------------------------------------------------------------------

_L = r"\p{L}"
_X = r"[^\p{L}\p{N}]"
_SP = f"[ {N}{W}]"
_SPT = f"[ {N}{W}{THIN}]"
_NB = f"[{N}{W}]"
_WHITE = "\t\n\x0b\x0c\r    -     　﻿"
_MARK = "§"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sub(t: str, pattern: str, to: str, times: int = 1) -> str:
    for _ in range(times):
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(to)}, 'g')"
    return t


def _marks(t: str) -> str:
    """How many marks a text holds; the tables' texts hold none of their own."""
    return f"(length({t}) - length(replace({t}, '{_MARK}', '')))"


def _times(t: str, s: str) -> str:
    return f"((length({t}) - length(replace({t}, {_q(s)}, ''))) // {len(s)})"


def _widths(t: str, w: str) -> str:
    ends = "".join(f" + {_times(t, w + e)} - {_times(t, '«' + w + e)}" for e in "»;!?")
    return f"({_times(t, '«' + w)}{ends})"


def _machine(tok: str) -> str:
    return f"(contains({tok}, '://') OR contains({tok}, '=') OR contains({tok}, '/') OR starts_with({tok}, '-') OR length({tok}) > 128)"


_TOKENS = f"regexp_extract_all(t, {_q(f'[^{_WHITE}]+|[{_WHITE}]')})"
_PROSE = f"array_to_string(list_transform({_TOKENS}, lambda w: CASE WHEN {_machine('w')} THEN regexp_replace(w, '[!?]', '.', 'g') ELSE w END), '')"
#: As _PROSE, but machine-made tokens are blanked, for what is told within a token.
_SPOKEN = f"array_to_string(list_transform({_TOKENS}, lambda w: CASE WHEN {_machine('w')} THEN '' ELSE w END), '')"


def _spaced() -> str:
    found = f"regexp_extract_all(t, {_q(f'[^{_WHITE}]*{_L}{_SP}+[;:!?]')})"
    word = f"regexp_replace(m, {_q(f'{_SP}+[;:!?]$')}, '')"
    return f"len(list_filter({found}, lambda m: NOT {_machine(word)}))"


def _unpaired(mark: str, opener: str) -> str:
    before = r"[\p{L}\p{N}\p{Pf}\p{Pe}''’]"
    end = rf"{before}\{mark}$"
    found = f"regexp_extract_all({_PROSE}, '[^.!?\n…]*\\{mark}')"
    return f"len(list_filter({found}, lambda m: regexp_matches(m, '{end}') AND NOT contains(m, '{opener}')))"


_EITHER, _PLAIN = "['‘]", "[']"


def _counts() -> dict[tuple[str, str], str]:
    """Findings of one text `t` by style and rule, as SQL."""
    apostrophe = lambda w: _marks(_sub("t", f"({_L}){w}({_L})", rf"\1{_MARK}\2", 2))
    opened = lambda m: _marks(_sub("t", f"(^|{_X}){m}{_SP}+", rf"\1{_MARK}", 2))
    closed = lambda m: _marks(_sub("t", rf"{_SP}+{m}({_X}|$)", rf"{_MARK}\1", 2))
    points = lambda m: _marks(_sub("t", rf"{m}([\p{{L}}\p{{N}}])", rf"{_MARK}\1"))
    quotes = _times("t", '"')
    votes = [_marks(_sub("t", f"(^|{_X}){c}([^{_WHITE}])", rf"\1{_MARK}\2", 4)) for c in "“‘„"]
    won = f"greatest({', '.join(votes)})"
    used = " + ".join(f"({v} > 0)::INT" for v in votes)
    out = {
        **{(s, "apostrophe"): apostrophe(_PLAIN) for s in ("de-CH", "de-DE", "fr")},
        **{(s, "apostrophe"): apostrophe(_EITHER) for s in ("en", "nl")},
        **{(s.name, "straight-double-quote"): quotes for s in STYLES},
        **{(s, "punctuation-spacing"): _spaced() for s in ("de-CH", "de-DE", "en", "es", "nl")},
        **{(s, "guillemet-open-space"): opened("«") for s in ("de-CH", "es")},
        **{(s, "guillemet-close-space"): closed("»") for s in ("de-CH", "es")},
        ("de-CH", "guillemet-direction"): points("»"),
        ("de-DE", "guillemet-direction"): points("«"),
        ("de-DE", "low-quote-open-space"): _marks(_sub("t", f"„{_SP}+", _MARK)),
        ("de-DE", "guillemet-open-space"): opened("»"),
        ("de-DE", "guillemet-close-space"): closed("«"),
        ("en", "apostrophe-elision"): _marks(_sub("t", rf"(^|{_X}){_EITHER}((?:twas|tis|em)(?:[{_WHITE}.,;:!?)]|$))", rf"\1{_MARK}\2", 2)),
        ("en", "decade-apostrophe"): _marks(_sub("t", rf"(^|{_X}){_EITHER}([0-9]0s(?:{_X}|$))", rf"\1{_MARK}\2", 2)),
        ("en", "double-hyphen"): _marks(_sub(_SPOKEN, f"({_L})--({_L})", rf"\1{_MARK}\2", 2)),
        ("es", "opening-mark-space"): _marks(_sub("t", f"([¿¡]){_SP}+", rf"\1{_MARK}")),
        ("es", "unpaired-question"): _unpaired("?", "¿"),
        ("es", "unpaired-exclamation"): _unpaired("!", "¡"),
        ("fr", "colon-spacing"): _times("t", " :"),
        ("fr", "punctuation-spacing"): _marks(_sub("t", f"[ {THIN}]([;!?])", rf"{_MARK}\1")),
        ("fr", "guillemet-open-space"): _marks(_sub(_sub("t", f"«({_NB})([^ {N}{W}{THIN}]|$)", r"⟦\1\2", 2), f"(^|{_X})«{_SPT}*", rf"\1{_MARK}", 2)),
        ("fr", "guillemet-close-space"): _marks(_sub(_sub("t", f"(^|[^ {N}{W}{THIN}])({_NB})»", r"\1\2⟧", 2), rf"{_SPT}*»({_X}|$)", rf"{_MARK}\1", 2)),
        ("fr", "mixed-no-break-space"): f"least({_widths('t', W)}, {_widths('t', N)})",
        ("fr", "missing-punctuation-space"): f"""len(regexp_extract_all(t, {_q(rf'''{_L}[;:!?](?:[{_WHITE}»)\]"'’]|$)''')}))""",
        ("nl", "apostrophe-elision"): _marks(_sub("t", rf"(^|{_X}){_EITHER}((?:ns|[stnkmr])[ \-])", rf"\1{_MARK}\2", 2)),
        ("nl", "apostrophe-after-symbol"): _marks(_sub(_SPOKEN, rf"([\p{{N}}@&+]){_EITHER}({_L})", rf"\1{_MARK}\2", 2)),
        ("nl", "mixed-quotation-marks"): f"CASE WHEN {used} > 1 THEN {' + '.join(votes)} - {won} ELSE 0 END",
        ("nl", "ij-capital"): _marks(_sub("t", rf"(^|{_X})Ij(\p{{Ll}})", rf"\1{_MARK}\2", 2)),
    }
    return out


_END = "¤"
_BLANK = f"array_to_string(list_transform({_TOKENS}, lambda w: CASE WHEN {_machine('w')} THEN regexp_replace(regexp_replace(w, '[!?]', '.', 'g'), '[^.…\n]', '0', 'g') ELSE w END), '')"


def _held(t: str, before: str, match: str, after: str, times: int = 1) -> str:
    """`t` with marks around each match, which stands between two contexts; a context that two matches share needs a pass for each."""
    return _sub(t, f"({before})({match})({after})", rf"\1{_MARK}\2{_END}\3", times)


def _places() -> dict[tuple[str, str], str]:
    """The text `t` with marks around each match, by style and rule; all else keeps its place."""
    open_ = rf"^|[^\p{{L}}\p{{N}}{_MARK}]"
    apostrophe = lambda w: _held("t", _L, w, _L, 2)
    # Marks that a letter or digit stands next to outside aren't meant; they are put out of the way first.
    begin = lambda m, spaces, t="t": _held(_sub(t, rf"([\p{{L}}\p{{N}}]){m}", r"\1⟦"), "", f"{m}{spaces}", "")
    end = lambda m, spaces, t="t": _held(_sub(t, rf"{m}([\p{{L}}\p{{N}}])", r"⟧\1"), "", f"{spaces}{m}", "")
    points = lambda m: _held("t", "", m, r"[\p{L}\p{N}]")
    spaced = _held(_BLANK, "", f"{_L}{_SP}+[;:!?]", "")

    def unpaired(mark: str, opener: str) -> str:
        sentence = rf"(^|[.!?\n…{_END}])([^.!?\n…{opener}{_MARK}{_END}]*[\p{{L}}\p{{N}}\p{{Pf}}\p{{Pe}}'’])(\{mark})"
        return _sub(_BLANK, sentence, rf"\1\2{_MARK}\3{_END}", 2)

    lost = f"CASE WHEN {_widths('t', N)} > {_widths('t', W)} THEN {_q(W)} ELSE {_q(N)} END"
    mixed = f"replace(t, '«' || {lost}, '«{_MARK}' || {lost} || '{_END}')"
    for e in "»;!?":
        mixed = f"replace({mixed}, {lost} || '{e}', '{_MARK}' || {lost} || '{_END}{e}')"
    return {
        **{(s, "apostrophe"): apostrophe(_PLAIN) for s in ("de-CH", "de-DE", "fr")},
        **{(s, "apostrophe"): apostrophe(_EITHER) for s in ("en", "nl")},
        **{(s.name, "straight-double-quote"): _held("t", "", '"', "") for s in STYLES},
        **{(s, "punctuation-spacing"): spaced for s in ("de-CH", "de-DE", "en", "es", "nl")},
        **{(s, "guillemet-open-space"): begin("«", f"{_SP}+") for s in ("de-CH", "es")},
        **{(s, "guillemet-close-space"): end("»", f"{_SP}+") for s in ("de-CH", "es")},
        ("de-CH", "guillemet-direction"): points("»"),
        ("de-DE", "guillemet-direction"): points("«"),
        ("de-DE", "low-quote-open-space"): _held("t", "", f"„{_SP}+", ""),
        ("de-DE", "guillemet-open-space"): begin("»", f"{_SP}+"),
        ("de-DE", "guillemet-close-space"): end("«", f"{_SP}+"),
        ("en", "apostrophe-elision"): _held("t", open_, _EITHER, rf"(?:twas|tis|em)(?:[{_WHITE}.,;:!?)]|$)", 2),
        ("en", "decade-apostrophe"): _held("t", open_, _EITHER, rf"[0-9]0s(?:{_X}|$)", 2),
        ("en", "double-hyphen"): _held(_BLANK, _L, "--", _L, 2),
        ("es", "opening-mark-space"): _held("t", "[¿¡]", f"{_SP}+", ""),
        ("es", "unpaired-question"): unpaired("?", "¿"),
        ("es", "unpaired-exclamation"): unpaired("!", "¡"),
        ("fr", "colon-spacing"): _held("t", "", " ", ":"),
        ("fr", "punctuation-spacing"): _held("t", "", f"[ {THIN}]", "[;!?]"),
        ("fr", "guillemet-open-space"): begin("«", f"{_SPT}*", _sub("t", f"«({_NB})([^ {N}{W}{THIN}]|$)", r"⟦\1\2", 2)),
        ("fr", "guillemet-close-space"): end("»", f"{_SPT}*", _sub("t", f"(^|[^ {N}{W}{THIN}])({_NB})»", r"\1\2⟧", 2)),
        ("fr", "mixed-no-break-space"): f"CASE WHEN least({_widths('t', W)}, {_widths('t', N)}) > 0 THEN {mixed} ELSE t END",
        ("fr", "missing-punctuation-space"): _held("t", "", f"{_L}[;:!?]", rf"""[{_WHITE}»)\]"'’]|$"""),
        ("nl", "apostrophe-elision"): _held("t", open_, _EITHER, r"(?:ns|[stnkmr])[ \-]", 2),
        ("nl", "apostrophe-after-symbol"): _held(_BLANK, r"[\p{N}@&+]", _EITHER, _L, 2),
        ("nl", "mixed-quotation-marks"): _held("t", open_, "[“‘„]", f"[^{_WHITE}]", 4),
        ("nl", "ij-capital"): _held("t", open_, "Ij", r"\p{Ll}", 2),
    }


#: By rule, where SQL tells a match by itself: what a finding's start and length are beyond the match's.
_SHIFTS = {"missing-punctuation-space": (1, -1)} | {"punctuation-spacing": (1, -2)}


def _rows_sql(style: Style) -> str:
    """Places and excerpts from the marked texts: lengths of what stands before each mark."""
    marked = _places()
    votes = [_marks(_sub("t", f"(^|{_X}){c}([^{_WHITE}])", rf"\1{_MARK}\2", 4)) for c in "“‘„"]
    won = f"CASE WHEN {votes[0]} >= greatest({votes[1]}, {votes[2]}) THEN '“' WHEN {votes[1]} >= {votes[2]} THEN '‘' ELSE '„' END"
    parts = []
    for rule in style.rules:
        begin, more = (0, 0) if rule.id == "punctuation-spacing" and style.name == "fr" else _SHIFTS.get(rule.id, (0, 0))
        lost = f" AND m <> {won}" if rule.id == "mixed-quotation-marks" else ""
        cut = f"SELECT doc_id, t, string_split({marked[style.name, rule.id]}, '{_MARK}') AS p FROM planted"
        each = f"SELECT doc_id, t, p, unnest(range(2, len(p) + 1)) AS i FROM ({cut})"
        at = f"SELECT doc_id, t, split_part(p[i], '{_END}', 1) AS m, length(replace(array_to_string(p[1:i-1], ''), '{_END}', '')) + {begin} AS a FROM ({each})"
        parts.append(f"SELECT doc_id, t, '{rule.id}' AS rule, a, length(m) + {more} AS n FROM ({at}) WHERE true{lost}")
    window = _revealed("substr(t, greatest(a - 25, 0) + 1, a + n + 25 - greatest(a - 25, 0))")
    before = "substr(t, 1, a)"
    return f"""WITH {_DOCS}, f AS ({' UNION ALL '.join(parts)})
SELECT doc_id, rule, a::BIGINT AS "index", n::BIGINT AS length, (length({before}) - length(replace({before}, chr(10), '')) + 1)::BIGINT AS line,
(length(regexp_extract({before}, '[^\n]*$')) + 1)::BIGINT AS "column", {window} AS excerpt FROM f"""


_DOCS = f"planted AS (SELECT doc_id, source, list_extract([{', '.join(map(_q, CARRIERS))}], CAST(doc_id % {len(CARRIERS)} AS INT) + 1) || chr(10) || coalesce(text, '') AS t FROM documents)"


def _counted_sql(style: Style, sql: dict[str, str]) -> str:
    cols = ", ".join(f"({sql[r.id]}) AS c{i}" for i, r in enumerate(style.rules))
    rows = " UNION ALL ".join(f"SELECT '{style.name}' AS style, '{r.id}' AS rule, '{r.severity}' AS severity, {str(r.fixable).lower()} AS fixable, count_if(c{i} > 0)::BIGINT AS docs, coalesce(sum(c{i}), 0)::BIGINT AS findings FROM per" for i, r in enumerate(style.rules))
    return f"WITH {_DOCS}, per AS MATERIALIZED (SELECT {cols} FROM planted) {rows}"


def _of_style(style: Style) -> dict[str, str]:
    return {rule: sql for (s, rule), sql in _counts().items() if s == style.name}


#: Stands for the columns to take from the normalized texts.
_COLUMNS = "<columns>"


def _fixed_sql(label: str) -> str:
    return _normalized_sql(label).replace(_COLUMNS, "doc_id, md5(t) AS fixed_md5, length(t)::BIGINT AS n_chars, t <> t0 AS changed")


def _left_over_sql(style: Style) -> str:
    sql = _of_style(style)
    total = " + ".join(f"({sql[r.id]})" for r in style.rules if r.fixable)
    return _normalized_sql(style.name).replace(_COLUMNS, f"'{style.name}' AS style, coalesce(sum({total}), 0)::BIGINT AS left_over")


def _by_language_sql() -> str:
    """Each document's row of the fixed texts of its language's style."""
    parts = [(tag, next(s for s in STYLES if s.name == name)) for tag, name in engine.BY_LANGUAGE.items()]
    rows = [f"SELECT f.doc_id, '{s.id}' AS style, f.fixed_md5, f.changed FROM ({_fixed_sql(s.name)}) f JOIN documents d USING (doc_id) WHERE lower(d.lang) = '{tag}'" for tag, s in parts]
    tags = ", ".join(f"'{tag}'" for tag, _ in parts)
    others = f"WITH {_DOCS} SELECT p.doc_id, NULL::VARCHAR AS style, md5(p.t) AS fixed_md5, false AS changed FROM planted p JOIN documents d USING (doc_id) WHERE d.lang IS NULL OR lower(d.lang) NOT IN ({tags})"
    return " UNION ALL ".join(f"(SELECT * FROM ({x}))" for x in [*rows, others])


def _audit_sql() -> str:
    """What the three rules a to b, b to a and c to cc break, by the definition of each promise."""
    n = lambda t, c: _times(t, c)
    near = lambda t, c: _revealed(f"substr({t}, greatest(strpos({t}, '{c}') - 26, 0) + 1, strpos({t}, '{c}') + 25 - greatest(strpos({t}, '{c}') - 26, 0))")
    again = "fixing what is fixed gives another text"
    sample = f"CASE WHEN length(t) <= 120 THEN {_revealed('t')} ELSE {_revealed('substr(t, 1, 120)')} || '...' END AS sample"
    states = "replace(t, 'a', 'b') AS s1, replace(replace(t, 'a', 'b'), 'b', 'a') AS s2, replace(replace(replace(t, 'a', 'b'), 'b', 'a'), 'c', 'cc') AS s3"
    row = lambda prop, rule, culprit, detail, where: f"SELECT doc_id, '{prop}' AS property, '{rule}' AS rule, {culprit} AS culprit, sample, {detail} AS detail FROM st WHERE {where}"
    none = "NULL::VARCHAR"
    rows = [
        *(row("idempotence", rule, none, f"'{again}'", f"{fix.format(fix.format('t'))} <> {fix.format('t')}") for rule, fix in (("to-b", "replace({}, 'a', 'b')"), ("to-a", "replace({}, 'b', 'a')"), ("double", "replace({}, 'c', 'cc')"))),
        row("non-interference", "to-b", "'to-a'", f"'to-a undoes it: ' || {n('s2', 'a')} || ' to repair anew'", f"{n('s1', 'a')} = 0 AND {n('s2', 'a')} > 0"),
        row("non-interference", "to-b", "'double'", f"'double undoes it: ' || {n('s3', 'a')} || ' to repair anew'", f"{n('s1', 'a')} = 0 AND {n('s2', 'a')} = 0 AND {n('s3', 'a')} > 0"),
        row("non-interference", "to-a", "'double'", f"'double undoes it: ' || {n('s3', 'b')} || ' to repair anew'", f"{n('s2', 'b')} = 0 AND {n('s3', 'b')} > 0"),
        row("idempotence", "normalize", none, f"'{again}'", "replace(replace(replace(s3, 'a', 'b'), 'b', 'a'), 'c', 'cc') <> s3"),
        *(row("conformance", rule, none, f"'left in the normalized text: ' || {near('s3', c)}", f"{n('s3', c)} > 0") for rule, c in (("to-b", "a"), ("to-a", "b"), ("double", "c"))),
    ]
    return f"WITH {_DOCS}, st AS MATERIALIZED (SELECT doc_id, t, {sample}, {states} FROM planted) " + " UNION ALL ".join(rows)


def _catalog_sql() -> str:
    """The published stamps (fixed values), and what the survey of the rules says of each style's rules."""
    stamps = {"fr": "4ed7f1b2db8f", "es": "8a1408a1e177", "de-DE": "69f15e8b27a9", "de-CH": "f4928d1e43d1", "nl": "54bd114c5488", "en": "cde694363e76"}
    fixable = {"de-CH": "100110", "de-DE": "1001110", "en": "111000", "es": "1110000", "fr": "11111000", "nl": "1100000"}
    shape = [(s, stamps[s], bits) for s, bits in fixable.items()] + [("fr", x, "1111100") for x in ("659c8ecb848a", "d45bfd9cec02")]
    rows = ", ".join(f"('{s}', '{stamp}', {len(bits)}, {bits.count('1')}, '{bits}')" for s, stamp, bits in shape)
    return f"SELECT style, stamp, n::BIGINT AS rules, f::BIGINT AS fixable, bits FROM (VALUES {rows}) v(style, stamp, n, f, bits)"


def _normalized_sql(label: str) -> str:
    """The normalized text `t` (and the given one, `t0`), step by step in common table expressions."""
    apostrophe = lambda t, w: _sub(t, f"({_L}){w}({_L})", r"\1’\2", 2)
    opened = lambda t, m: _sub(t, f"(^|{_X}){m}{_SP}+", rf"\1{m}", 2)
    closed = lambda t, m: _sub(t, rf"{_SP}+{m}({_X}|$)", rf"{m}\1", 2)
    steps: list[str]
    if label == "de-CH":
        steps = [apostrophe("t", _PLAIN), opened("t", "«"), closed("t", "»")]
    elif label == "de-DE":
        steps = [apostrophe("t", _PLAIN), _sub("t", f"„{_SP}+", "„"), opened("t", "»"), closed("t", "«")]
    elif label == "es":
        steps = [opened("t", "«"), closed("t", "»"), _sub("t", f"([¿¡]){_SP}+", r"\1")]
    elif label == "en":
        steps = [apostrophe("t", _EITHER), _sub("t", rf"(^|{_X}){_EITHER}((?:twas|tis|em)(?:[{_WHITE}.,;:!?)]|$))", r"\1’\2", 2), _sub("t", rf"(^|{_X}){_EITHER}([0-9]0s(?:{_X}|$))", r"\1’\2", 2)]
    elif label == "nl":
        steps = [apostrophe("t", _EITHER), _sub("t", rf"(^|{_X}){_EITHER}((?:ns|[stnkmr])[ \-])", r"\1’\2", 2)]
    else:
        width = {"fr": f"CASE WHEN {_widths('t', N)} > {_widths('t', W)} THEN {_q(N)} ELSE {_q(W)} END", "fr_00a0": _q(N), "fr_202f": _q(W)}[label]
        put = lambda t, pattern, to: f"replace({_sub(t, pattern, to, 2)}, '{_MARK}', {width})"
        if label == "fr":
            guarded = _sub("t", f"«({_NB})([^ {N}{W}{THIN}]|$)", r"⟦\1\2", 2)
            shut = _sub("t", f"(^|[^ {N}{W}{THIN}])({_NB})»", r"\1\2⟧", 2)
            stop = f"[ {THIN}]([;!?])"
        else:
            guarded, shut, stop = "t", "t", f"{_SPT}([;!?])"
        steps = [
            apostrophe("t", _PLAIN), f"replace(t, ' :', {_q(N + ':')})", put("t", stop, rf"{_MARK}\1"),
            f"replace({put(guarded, f'(^|{_X})«{_SPT[:-1]}{_MARK}]*', rf'{chr(92)}1«{_MARK}')}, '⟦', '«')",
            f"replace({put(shut, rf'{_SPT[:-1]}{_MARK}]*»({_X}|$)', rf'{_MARK}»{chr(92)}1')}, '⟧', '»')",
        ]
    ctes = [_DOCS, "s0 AS (SELECT doc_id, t, t AS t0 FROM planted)"]
    ctes += [f"s{i + 1} AS MATERIALIZED (SELECT doc_id, {step} AS t, t0 FROM s{i})" for i, step in enumerate(steps)]
    return f"WITH {', '.join(ctes)} SELECT {_COLUMNS} FROM s{len(steps)}"


def _all_counted_sql() -> str:
    return " UNION ALL ".join(f"(SELECT * FROM ({_counted_sql(s, _of_style(s))}))" for s in STYLES)


def _revealed(t: str) -> str:
    q = f"""replace(replace(replace(replace({t}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t')"""
    for c, name in ((N, "NBSP"), (W, "NNBSP"), (THIN, "THINSP"), ("’", "RSQUO"), ("‘", "LSQUO"), ("“", "LDQUO"), ("”", "RDQUO"), ("„", "BDQUO"), ("«", "LAQUO"), ("»", "RAQUO")):
        q = f"replace({q}, {_q(c)}, '<{name}>')"
    return f"""'"' || {q} || '"'"""


_HOUSE = {
    **{r: s for (k, r), s in _counts().items() if k == "en"},
    "double-hyphen": _times("t", "--"),
    "ellipsis": _times("t", "..."),
}


def _house() -> Style:
    en = next(s for s in STYLES if s.name == "en")
    rules = [r for r in en.rules if r.id != "straight-double-quote"]
    return compose("house", "ours", [*rules, replace_rule("ellipsis", "three dots", "ours", r"\.\.\.", "…")])


def _survey_sql(by: str) -> str:
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""WITH {_DOCS}, v AS (SELECT {key}coalesce(sum({_widths('t', N)}), 0)::BIGINT AS "full", coalesce(sum({_widths('t', W)}), 0)::BIGINT AS narrow FROM planted{group})
SELECT {key}"full", narrow, CASE WHEN "full" > narrow THEN 'full' ELSE 'narrow' END AS verdict, least("full", narrow) AS minority_count FROM v"""


def _quotes_sql() -> str:
    votes = [_marks(_sub("t", f"(^|{_X}){c}([^{_WHITE}])", rf"\1{_MARK}\2", 4)) for c in "“‘„"]
    sums = ", ".join(f'coalesce(sum({v}), 0)::BIGINT AS "{n}"' for v, n in zip(votes, ("double", "single", "low"), strict=True))
    return f"""WITH {_DOCS}, v AS (SELECT source, {sums} FROM planted GROUP BY source),
w AS (SELECT *, CASE WHEN "double" >= greatest(single, low) THEN '“' WHEN single >= low THEN '‘' ELSE '„' END AS verdict FROM v)
SELECT *, CASE WHEN "double" > 0 AND verdict <> '“' THEN '“' WHEN single > 0 AND verdict <> '‘' THEN '‘' WHEN low > 0 AND verdict <> '„' THEN '„' END AS minority FROM w"""


def _minority_sql() -> str:
    lost = f"CASE WHEN {_widths('t', N)} > {_widths('t', W)} THEN {_q(W)} ELSE {_q(N)} END"
    spots = ", ".join([f"nullif(strpos(t, '«' || lost), 0) + 1", *(f"nullif(strpos(t, lost || '{e}'), 0)" for e in "»;!?")])
    n = f"least({_widths('t', N)}, {_widths('t', W)})"
    return f"WITH {_DOCS}, m AS (SELECT doc_id, t, {n} AS n, {lost} AS lost FROM planted) SELECT doc_id, (least({spots}) - 1)::BIGINT AS first, n::BIGINT AS n FROM m WHERE n > 0"


def _report_sql() -> str:
    style = next(s for s in STYLES if s.name == "de-DE")
    sql = _of_style(style)
    total = " + ".join(f"({sql[r.id]})" for r in style.rules)
    return f"SELECT f.doc_id, f.changed, ({total})::BIGINT AS findings FROM ({_fixed_sql('de-DE')}) f JOIN (WITH {_DOCS} SELECT * FROM planted) p USING (doc_id)"


def _token_sql() -> str:
    at = "strpos(t, 'b')"
    token = f"regexp_extract(substr(t, 1, {at} - 1), {_q(f'[^{_WHITE}]*$')}) || regexp_extract(substr(t, {at}), {_q(f'^[^{_WHITE}]*')})"
    return f"WITH {_DOCS}, k AS (SELECT doc_id, {token} AS w FROM planted WHERE {at} > 0) SELECT doc_id, {_machine('w')} AS machine FROM k"


QUERIES: dict[str, Query] = {
    **{f"normalize_{s.name.lower().replace('-', '_')}": partial(normalize_query, s) for s in STYLES},
    "normalize_fr_00a0": partial(normalize_query, with_width(NO_BREAK)),
    "normalize_fr_202f": partial(normalize_query, with_width(NARROW_NO_BREAK)),
    **{f"findings_{s.name.lower().replace('-', '_')}": partial(counted, s) for s in STYLES},
    **{f"check_rows_{s.name.lower().replace('-', '_')}": partial(check_rows, s) for s in STYLES},
    "severity_totals": severity_totals,
    "coverage_by_rule": coverage_by_rule,
    "unfixable_findings": unfixable_findings,
    "strict_exit_status": strict_exit_status,
    "line_column_positions": line_column_positions,
    "excerpt_reveal": excerpt_reveal,
    "token_is_machine": token_is_machine,
    "width_survey_global": partial(width_survey, ()),
    "width_survey_by_source": partial(width_survey, ("source",)),
    "quote_system_verdict": quote_system_verdict,
    "minority_positions": minority_positions,
    "after_normalize": after_normalize,
    "normalize_by_language": normalize_by_language,
    "file_report_nested": file_report_nested,
    "audit_violations": audit_violations,
    "style_catalog": style_catalog,
    "derive_drop_replace_add": derive_drop_replace_add,
}

ORACLES: dict[str, str] = {
    **{f"normalize_{s.name.lower().replace('-', '_')}": _fixed_sql(s.name) for s in STYLES},
    "normalize_fr_00a0": _fixed_sql("fr_00a0"),
    "normalize_fr_202f": _fixed_sql("fr_202f"),
    **{f"findings_{s.name.lower().replace('-', '_')}": _counted_sql(s, _of_style(s)) for s in STYLES},
    **{f"check_rows_{s.name.lower().replace('-', '_')}": _rows_sql(s) for s in STYLES},
    "severity_totals": f"SELECT style, severity, sum(findings)::BIGINT AS findings FROM ({_all_counted_sql()}) GROUP BY ROLLUP (style, severity)",
    "coverage_by_rule": f"SELECT rule, count(*)::BIGINT AS styles, count_if(findings > 0)::BIGINT AS reached FROM ({_all_counted_sql()}) GROUP BY rule",
    "unfixable_findings": f"SELECT style, sum(findings)::BIGINT AS undecided FROM ({_all_counted_sql()}) WHERE NOT fixable GROUP BY style",
    "strict_exit_status": f"SELECT style, (sum(CASE WHEN severity = 'error' THEN findings ELSE 0 END) > 0)::INT AS exit_code, (sum(findings) > 0)::INT AS strict_exit_code FROM ({_all_counted_sql()}) GROUP BY style",
    "line_column_positions": """WITH hits AS (SELECT page_id, html, unnest(list_filter(range(1, length(html) + 1), lambda i: substr(html, i, 1) = '"')) AS i FROM pages),
cut AS (SELECT page_id, i, substr(html, 1, i - 1) AS before FROM hits)
SELECT page_id, (i - 1)::BIGINT AS "index", (length(before) - length(replace(before, chr(10), '')) + 1)::BIGINT AS line, length(regexp_extract(before, '[^\n]*$')) + 1 AS "column" FROM cut""",
    "excerpt_reveal": f"WITH {_DOCS}, w AS (SELECT doc_id, t, (length(t) // 2) AS a FROM planted) SELECT doc_id, {_revealed('substr(t, greatest(a - 25, 0) + 1, a + 26 - greatest(a - 25, 0))')} AS middle, {_revealed('substr(t, 1, 23)')} AS start FROM w",
    "token_is_machine": _token_sql(),
    "width_survey_global": _survey_sql(""),
    "width_survey_by_source": _survey_sql("source"),
    "quote_system_verdict": _quotes_sql(),
    "minority_positions": _minority_sql(),
    "after_normalize": " UNION ALL ".join(f"(SELECT * FROM ({_left_over_sql(s)}))" for s in STYLES),
    "normalize_by_language": _by_language_sql(),
    "file_report_nested": _report_sql(),
    "audit_violations": _audit_sql(),
    "style_catalog": _catalog_sql(),
    "derive_drop_replace_add": _counted_sql(_house(), _HOUSE),
}
