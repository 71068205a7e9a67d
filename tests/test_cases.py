"""Cases of every style, shapes that patterns must take in linear time, and the doors that texts come and go by."""

import io
import json
import sys
import time

import pytest
from pyspark.sql import functions as F

from typeloom import cli
from typeloom.functions.chars import NARROW_NO_BREAK as W
from typeloom.functions.chars import NO_BREAK as N
from typeloom.functions.chars import THIN
from typeloom.functions.matches import in_prose, looks_machine
from typeloom.operators import engine
from typeloom.plans.queries import CARRIERS
from typeloom.plans.rules import detect_rule
from typeloom.plans.styles import DE_CH, DE_DE, EN, ES, FR, NL, STYLES, compose, with_width
from typeloom.sources import texts
from typeloom.streaming import streams

#: style, text, the text normalized, and the rules that report on the given text, in order.
CASES = [
    (EN, "Don't say o'clock", "Don’t say o’clock", ["apostrophe", "apostrophe"]),
    (EN, "‘tis and 'em, not 'tisn", "’tis and ’em, not 'tisn", ["apostrophe-elision", "apostrophe-elision"]),
    (EN, "'30s but '305s", "’30s but '305s", ["decade-apostrophe"]),
    (EN, "the dogs' bowls", "the dogs' bowls", []),
    (EN, "let x = a ? b : c", "let x = a ? b : c", ["punctuation-spacing", "punctuation-spacing"]),
    (EN, "a--b a--b=c", "a--b a--b=c", ["double-hyphen"]),
    (EN, 'so "quoted"', 'so "quoted"', ["straight-double-quote", "straight-double-quote"]),
    (FR, "qu'il l’a", "qu’il l’a", ["apostrophe"]),
    (FR, "ici : là", f"ici{N}: là", ["colon-spacing"]),
    (FR, "Oui ; non ! Si ?", f"Oui{W}; non{W}! Si{W}?", ["punctuation-spacing"] * 3),
    (FR, f"«{N}a{N}» ; «b»", f"«{N}a{N}»{N}; «{N}b{N}»", ["punctuation-spacing", "guillemet-open-space", "guillemet-close-space"]),
    (FR, f"«{W}a{W}» et{N}!", f"«{W}a{W}» et{N}!", ["mixed-no-break-space"]),
    (FR, "mot!", "mot!", ["missing-punctuation-space"]),
    (FR, f"x{THIN}! «{THIN}y{THIN}»", f"x{W}! «{W}y{W}»", ["punctuation-spacing", "guillemet-open-space", "guillemet-close-space"]),
    (FR, "a «  b  » c", f"a «{W}b{W}» c", ["guillemet-open-space", "guillemet-close-space"]),
    (FR, "x«a»y", f"x«a{W}»y".replace(f"{W}»y", "»y"), []),
    (DE_DE, "„  Ja“ und » nein «", "„Ja“ und »nein«", ["low-quote-open-space", "guillemet-open-space", "guillemet-close-space"]),
    (DE_DE, "«Ja»", "«Ja»", ["guillemet-direction"]),
    (DE_DE, "Wer ?", "Wer ?", ["punctuation-spacing"]),
    (DE_CH, "« Ja » und »Nein«", "«Ja» und »Nein«", ["guillemet-open-space", "guillemet-close-space", "guillemet-direction"]),
    (ES, "¿ Ya? ¡ Sí!", "¿Ya? ¡Sí!", ["opening-mark-space", "opening-mark-space"]),
    (ES, "Ya? ¿Ya? Ven!", "Ya? ¿Ya? Ven!", ["unpaired-question", "unpaired-exclamation"]),
    (ES, "¡Ven ya! Y tú, ven!?", "¡Ven ya! Y tú, ven!?", ["unpaired-exclamation"]),
    (NL, "'t huis, foto's, 's nachts", "’t huis, foto’s, ’s nachts", ["apostrophe-elision", "apostrophe", "apostrophe-elision"]),
    (NL, "de 1980's en c'4'd", "de 1980's en c'4'd", ["apostrophe-after-symbol", "apostrophe-after-symbol"]),
    (NL, "“a” en ‘b’ en “c”", "“a” en ‘b’ en “c”", ["mixed-quotation-marks"]),
    (NL, "Ijzel, IJs, Ij", "Ijzel, IJs, Ij", ["ij-capital"]),
    (with_width(N), "a ! «b»", f"a{N}! «{N}b{N}»", ["punctuation-spacing", "guillemet-open-space", "guillemet-close-space"]),
]


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "n int, text string")


def test_cases(spark):
    for style in dict.fromkeys(c[0].id for c in CASES):
        mine = [c for c in CASES if c[0].id == style]
        df = engine.find(engine.changed(table(spark, [c[1] for c in mine]), mine[0][0]), mine[0][0])
        for r in df.collect():
            _, text, after, rules = mine[r.n]
            assert (r.fixed, [f.rule for f in r.findings]) == (after, rules), text
            assert r.changed == (after != text)


def test_what_stays_alone(spark):
    """Neither empty texts nor code of other kinds is rewritten by styles that have no rule for it."""
    alone = ["", " ", "\n\n", "C:\\a\\b", "/usr/bin/x", "<a href=x>", "{}", "```\ncode\n```", "1:2", "https://a.b/c?d=e&f=g", "a\tb\r\nc", "12:30", "--flag", "SELECT 1;", "data:,x"]
    for style in STYLES:
        got = engine.normalize(table(spark, alone), style).orderBy("n").collect()
        assert [r.text for r in got] == alone


def test_counts_are_those_of_placed_findings(spark):
    odd = ["a" * 126 + "!", "b" * 127 + "!", "c" * 128 + "!", "d" * 129 + "!", "x " + "e" * 127 + "! y", "f! " * 200, "¡a! b! c?! ¿d? e?", "=g! -h! i/! j! k ! l=m !", "ok😀! " + "😀" * 40 + "a!", "a--b c--d=e -f--g h--i"]
    df = table(spark, [*CARRIERS, *odd, None])
    for style in [*STYLES, with_width(N)]:
        placed = engine.check(df, style).groupBy("n", "rule").count().collect()
        counted = engine.rule_counts(df, style).select("n", F.explode("counts").alias("rule", "k")).where("k > 0").collect()
        assert sorted(map(tuple, placed)) == sorted(map(tuple, counted)), style.name
        totals = {(r.rule, r.docs, r.findings) for r in engine.finding_totals(df, (style,)).collect()}
        assert {(r, d, f) for r, d, f in totals if f} == {(r, len({n for n, q, _ in placed if q == r}), sum(k for _, q, k in placed if q == r)) for r in {q for _, q, _ in placed}}


def test_own_predicates_are_counted_too(spark):
    own = compose("own", "ours", [detect_rule("x-first", "s", "c", "x", keep=lambda text, m, _: m["start"] < 3), EN.rule("straight-double-quote")])
    row = engine.rule_counts(table(spark, ['x"xxxx']), own).first()
    assert row.counts == {"x-first": 2, "straight-double-quote": 1}


def test_a_pattern_knows_machine_made_tokens(spark):
    words = ["plain!", "a/b!", "k=v!", "-x!", "x" * 127 + "!", "x" * 128 + "!", "x" * 129 + "!", "!" + "y" * 126, "!" + "y" * 127, "!" + "y" * 128, "\u00a0z!\u3000", "a!b/c", "http://q!"]
    df = table(spark, [x for w in words for x in (w, f"so {w} then", f"{w}\n")])
    at = F.instr("text", "!") - 1
    for r in df.select("text", looks_machine(F.col("text"), at).alias("m"), F.regexp_like("text", F.lit(in_prose("[!]"))).alias("p")).collect():
        assert r.m != r.p, r.text


SHAPES = {
    "spaces": " " * 20_000, "no-break": N * 20_000, "narrow": W * 20_000, "thin": THIN * 20_000, "mixed": (" " + N + W + THIN) * 5_000, "run to a mark": "a" + " " * 20_000 + "»", "token": "x" * 20_000,
    "address": "http://a.b/" + "c?d=e!" * 2_000, "marks": "«»" * 10_000, "sentences": "Quoi ! « mot » l'eau ; ¿ Ya? ven! a--b \"c\" " * 1_500, "exclaims": "a!" * 10_000,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_take_linear_time(spark, shape):
    text = SHAPES[shape]
    df = table(spark, [text])
    for style in STYLES:
        engine.normalize(df, style).write.format("noop").mode("overwrite").save()
    began = time.time()
    for style in STYLES:
        engine.normalize(df, style).write.format("noop").mode("overwrite").save()
        engine.finding_totals(df, (style,)).collect()
    assert time.time() - began < 2.0 * 2 * len(STYLES)


def test_clashing_columns_are_refused(spark):
    df = table(spark, ["It's"]).withColumns({"fixed": F.lit(1), "Line": F.lit(2)})
    for call in (lambda: engine.changed(df, EN), lambda: engine.check(df, EN), lambda: engine.find(df.withColumn("findings", F.lit(1)), EN), lambda: engine.audit(df.withColumn("detail", F.lit(1)), EN), lambda: engine.find(df.withColumn("__m0", F.lit(1)), EN), lambda: engine.normalize_by_language(df.withColumn("lang", F.lit("en")))):
        with pytest.raises(ValueError, match="rename"):
            call()
    assert engine.check(df.drop("Line", "fixed").withColumn("other", F.lit(3)), EN).first()["other"] == 3


def test_language_decides_the_style(spark):
    rows = [(0, "de", "» a « it's"), (1, "DE", "„ a“"), (2, "fr", "a !"), (3, "xx", "a !"), (4, None, "it's"), (5, "en", "it's"), (6, "nl", None)]
    df = spark.createDataFrame(rows, "n int, lang string, text string")
    got = {r.n: (r.style, r.fixed) for r in engine.normalize_by_language(df).collect()}
    assert got == {0: (DE_DE.id, "»a« it’s"), 1: (DE_DE.id, "„a“"), 2: (FR.id, f"a{W}!"), 3: (None, "a !"), 4: (None, "it's"), 5: (EN.id, "it’s"), 6: (NL.id, None)}
    swiss = engine.normalize_by_language(df, dispatch=engine.BY_LANGUAGE | {"de": "de-CH"})
    assert swiss.where("n = 0").first()["style"] == DE_CH.id


def test_totals_failing_and_report_lines(spark, tmp_path):
    df = texts.from_values(spark, ["It's \"so\"", "fine"], "<here>")
    found = engine.check(df, EN)
    assert engine.totals(found).first()[:] == (3, 1, 2, 2) and engine.unfixable(found).count() == 2
    assert engine.failing(found) and not engine.failing(found.where("severity = 'warning'")) and engine.failing(found.where("severity = 'warning'"), strict=True)
    assert not engine.failing(found.limit(0), strict=True)
    lines = [r.said for r in texts.report_lines(found).collect()]
    assert any(x.startswith("<here>:1:3  fixable apostrophe  ") and len(x.split("\n")) == 3 for x in lines)
    assert any(x.startswith("<here>:1:6  warning straight-double-quote  ") for x in lines)
    texts.write_findings(df, EN, f"{tmp_path}/found")
    assert spark.read.parquet(f"{tmp_path}/found").count() == 3


def test_streams_fix_and_survey(spark, tmp_path):
    df = spark.createDataFrame([("a", "Quoi !"), ("a", f"«{N}b{N}»"), ("b", f"c{W}!"), ("b", None)], "source string, text string")
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    streams.start(streams.fix_stream(source, FR), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {r.fixed for r in spark.read.parquet(f"{tmp_path}/out").where("changed").collect()} == {f"Quoi{W}!"}
    query = streams.width_stream(source, ("source",)).writeStream.format("memory").queryName("widths").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.source, r.full, r.narrow) for r in spark.table("widths").collect()} == {("a", 2, 0), ("b", 0, 1)}


def test_stdin_and_the_filter_form(spark, monkeypatch, capsys):
    def run(text, *args):
        monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
        return cli.main([*args, "--style", "en", "--no-config"], spark), *capsys.readouterr()

    code, out, err = run("It's", "check", "-")
    assert code == 1 and "<stdin>:1:3" in out and not err
    code, out, err = run("It's \ufeff\r\n", "fix", "-", "--write")
    assert out == "It’s \ufeff\r\n" and "<stdin>" in err and code == 1
    code, out, err = run("fine", "fix", "-", "--write")
    assert (code, out) == (0, "fine") and "none" in err
    code, out, _ = run("It's", "fix", "-", "--json")
    assert json.loads(out)["files"][0]["changed"] is True
