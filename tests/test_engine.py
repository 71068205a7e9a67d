"""Rules, positions, properties, composition, config, command line and streams."""

import json

import pytest
from pyspark.sql import functions as F

from typeloom import cli
from typeloom.functions.chars import NARROW_NO_BREAK, NO_BREAK, java_pattern
from typeloom.operators import engine
from typeloom.plans import builders
from typeloom.plans.queries import CARRIERS, PING_PONG
from typeloom.plans.rules import Ballot, detect_rule, replace_rule
from typeloom.plans.styles import DE_DE, EN, ES, FR, NL, STYLES, compose, derive, style_for, with_width
from typeloom.sources import config, texts
from typeloom.streaming import streams

STAMPS = {"fr": "4ed7f1b2db8f", "es": "8a1408a1e177", "de-DE": "69f15e8b27a9", "de-CH": "f4928d1e43d1", "nl": "54bd114c5488"}


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "n int, text string")


def found(spark, style, text):
    rows = engine.find(table(spark, [text]), style).first()["findings"]
    return [(f["rule"], f["index"], f["length"], f["line"], f["column"]) for f in rows]


def test_stamps():
    assert {s.name: s.stamp for s in STYLES if s.name in STAMPS} == STAMPS


@pytest.mark.parametrize(("style", "before", "after"), [
    (EN, "It's ‘tis the '90s", "It’s ’tis the ’90s"),
    (FR, "Quoi ! « mot » l'eau : non", f"Quoi{NARROW_NO_BREAK}! «{NARROW_NO_BREAK}mot{NARROW_NO_BREAK}» l’eau{NO_BREAK}: non"),
    (FR, f"«{NO_BREAK}a{NO_BREAK}» et « b »", f"«{NO_BREAK}a{NO_BREAK}» et «{NO_BREAK}b{NO_BREAK}»"),
    (DE_DE, "Sie sang « La Mer » leise", "Sie sang« La Mer »leise"),
    (ES, "¿ Qué? « a »", "¿Qué? «a»"),
    (NL, "'s Morgens auto's", "’s Morgens auto’s"),
])
def test_fixes(spark, style, before, after):
    assert engine.normalize(table(spark, [before]), style).first()["text"] == after


def test_positions_beyond_the_first_plane_and_across_line_ends(spark):
    quotes = compose("q", "ours", [builders.straight_double_quote("x", "y")])
    assert found(spark, quotes, '😀"\r\na "b"\n"') == [("straight-double-quote", 2, 1, 1, 3), ("straight-double-quote", 7, 1, 2, 3), ("straight-double-quote", 9, 1, 2, 5), ("straight-double-quote", 11, 1, 3, 1)]
    many = "é" * 10 + '"\n' * 500
    got = found(spark, quotes, many)
    assert len(got) == 500 and got[0][1:] == (10, 1, 1, 11) and got[-1][1:] == (10 + 2 * 499, 1, 500, 1)


def test_machine_made_tokens_are_left_alone(spark):
    assert [r for r, *_ in found(spark, EN, "see well--known --flag a--b=c http://x--y")] == ["double-hyphen"]
    assert found(spark, ES, "Ven! ¡Ya! http://a/b! " + "x" * 200 + "! .!")[0][:2] == ("unpaired-exclamation", 3)
    assert len(found(spark, ES, "Ven! ¡Ya! http://a/b! " + "x" * 200 + "! .!")) == 1


def test_null_and_empty(spark):
    df = table(spark, [None, "", " "])
    for style in STYLES:
        assert engine.check(df, style).count() == 0
        assert [r.text for r in engine.normalize(df, style).orderBy("n").collect()] == [None, "", " "]


def test_every_rule_is_reached_and_settles(spark):
    df = table(spark, CARRIERS)
    for style in [*STYLES, with_width(NO_BREAK)]:
        counts = engine.rule_counts(df, style).select(F.explode("counts")).groupBy("key").agg(F.sum("value")).collect()
        assert all(n > 0 for _, n in counts) and len(counts) == len(style.rules)
        assert engine.audit(df, style).count() == 0


def test_audit_bites(spark):
    got = {(r.property, r.rule) for r in engine.audit(table(spark, ["abc"]), PING_PONG).collect()}
    assert ("non-interference", "to-b") in got and ("idempotence", "double") in got and ("conformance", "double") in got


def test_composition_refuses():
    a, c = replace_rule("a", "s", "c", "x", "y"), detect_rule("c", "s", "c", "z")
    base = compose("base", "ours", [a, c])
    assert base.stamp != compose("base", "ours", [c, a]).stamp
    assert [r.id for r in derive(base, drop=["a"], add=[replace_rule("d", "s", "c", "q", "r")]).rules] == ["c", "d"]
    for broken in (
        lambda: compose("bad name", "ours", [a]), lambda: compose("x", "ours", []), lambda: compose("x", "ours", [a, a]), lambda: derive(base, drop=["no"]), lambda: derive(base, add=[a]),
        lambda: derive(base, replace=[replace_rule("no", "s", "c", "x", "y")]), lambda: derive(base, drop=["a"], replace=[a]), lambda: replace_rule("a", "s", "c", "x", "$1"),
        lambda: replace_rule("a", "s", "c", "x", "y", flags="u"), lambda: Ballot(("a",), "a"), lambda: with_width(" "), lambda: builders.inner_space("s", "c", "?", "open", "x", True),
    ):
        with pytest.raises(ValueError):
            broken()
    assert style_for("DE-de") is DE_DE and style_for("de") is None and java_pattern(r"a\s[\s]$") .endswith(r"\z")


def test_survey(spark):
    df = table(spark, [f"«{NO_BREAK}a{NO_BREAK}»", f"b{NARROW_NO_BREAK}!", None])
    row = engine.survey_width(df).first()
    assert (row.full, row.narrow, row.verdict, row.minority, row.minority_count) == (2, 1, NO_BREAK, NARROW_NO_BREAK, 1)


def test_config(tmp_path):
    (tmp_path / ".git").mkdir()
    assert config.find_config(tmp_path) is None
    path = tmp_path / "typeloom_config.py"
    path.write_text("from typeloom.plans.styles import EN, derive\nSTYLES = [derive(EN, drop=['double-hyphen'])]\n")
    (tmp_path / "sub").mkdir()
    assert config.find_config(tmp_path / "sub") == str(path)
    own = config.load_config(path)
    assert config.resolve_style("EN", own) is own.styles[0] and [x.shadowed for x in config.available(own) if x.style is EN] == [True]
    (tmp_path / ".typeloom_config.py").write_text("")
    with pytest.raises(ValueError):
        config.find_config(tmp_path)
    for text in ("", "STYLES = []", "STYLES = [1]", "1/0", "from typeloom.plans.styles import EN\nSTYLES = [EN, EN]"):
        path.write_text(text)
        with pytest.raises(ValueError):
            config.load_config(path)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.txt").write_text("It's -- \"so\" ;\n", encoding="utf-8")
    run = lambda *a: cli.main(["--no-config" if x == "NC" else x for x in a], spark)
    assert run("check", "a.txt", "--style", "en", "NC") == 1
    assert "a.txt:1:3  fixable apostrophe" in capsys.readouterr().out
    assert run("check", "a.txt", "--style", "en", "NC", "--json") == 1
    assert {f["rule"] for f in json.loads(capsys.readouterr().out)["files"][0]["findings"]} == {"apostrophe", "straight-double-quote"}
    assert run("fix", "a.txt", "--style", "en", "NC", "--write") == 1 and (tmp_path / "a.txt").read_text(encoding="utf-8").startswith("It’s")
    assert run("check", "a.txt", "--style", "en", "NC") == 0 and run("check", "a.txt", "--style", "en", "NC", "--strict") == 1
    assert run("styles", "NC") == 0 and "fr@4ed7f1b2db8f" in capsys.readouterr().out
    for bad in (("check", "a.txt", "NC"), ("check", "--style", "en", "NC"), ("check", "no.txt", "--style", "en", "NC"), ("check", "a.txt", "--style", "de", "NC"), ("check", "a.txt", "--style", "en", "--write", "NC")):
        assert run(*bad) == 2


def test_files_tables_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("l'eau\nQuoi !", encoding="utf-8")
    df = texts.read_files(spark, f"{tmp_path}/in/x.txt")
    assert df.count() == 1 and engine.check(df, FR).count() == 2
    texts.write_fixed(df, FR, f"{tmp_path}/fixed")
    assert texts.read_table(spark, f"{tmp_path}/fixed").first()["style"] == FR.id
    texts.write_report(df, FR, "file", f"{tmp_path}/report")
    assert len(json.loads(spark.read.text(f"{tmp_path}/report").first()[0])["findings"]) == 2
    df.write.parquet(f"{tmp_path}/table")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/table")
    streams.start(streams.check_stream(source, FR), f"{tmp_path}/found", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/found").count() == 2
