"""Checking, normalizing, surveying and auditing a table of texts under a style.

Everything here is a projection of Spark expressions over rows, or an ordinary aggregate: no
shuffle to check or fix, no Python per row. Checks read the original text; fixes run one on the
result of the other, in the style's order.

A null text has no findings and stays null. Other columns ride along; where one has the name of
a column that is added, or of the engine's own (two underscores first), the call is refused with a
message, since neither could be told apart later.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import matches as mt
from typeloom.functions.chars import clipped, excerpt, utf16_length
from typeloom.plans.rules import Ballot, Rule
from typeloom.plans.styles import STYLES, WIDTH, Style

FINDING = "struct<index:int,rule:string,length:int,line:int,column:int,severity:string,fixable:boolean,summary:string,cite:string,excerpt:string>"


FIELDS = ("style", "rule", "severity", "fixable", "index", "length", "line", "column", "excerpt", "summary", "cite")


def _refuse_clashes(columns: list[str], *added: str) -> None:
    """Spark's names don't differ by case alone."""
    taken = {a.lower() for a in added}
    bad = [c for c in columns if c.lower() in taken or c.startswith("__")]
    if bad:
        raise ValueError(f"rename {', '.join(map(repr, bad))} first: columns of that name are added, or used within")


def _found(text: Column, rule: Rule) -> Column:
    return F.when(rule.possible(text), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(mt.no_texts())


def _by_rule(rules: list[Rule], i: Column, values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), i)


def _keep(rules: list[Rule], text: Column, i: Column, m: Column, aid: Column) -> Column:
    """Whether a match of rule `i` counts. `aid`: the repair of a fixable rule, the minority of a rule with a ballot."""
    out = F.when(_by_rule(rules, i, [r.fixable for r in rules]), m["m"] != F.get(aid, F.lit(0)))
    for test in dict.fromkeys(r.keep for r in rules if r.keep):
        out = out.when(i.isin(*(n for n, r in enumerate(rules) if r.keep is test)), test(text, m, aid))
    return out.otherwise(F.lit(True))


def _located(df: DataFrame, rules: list[Rule], text: str) -> DataFrame:
    """`df` with `__at`: for each rule that found anything, its number `i` and its kept matches `k`.

    Each pattern runs once a text. What follows is one expression over all rules, and not one a
    rule, which keeps plans small.
    """
    t = F.col(text)
    df = df.withColumns({f"__m{n}": _found(t, r) for n, r in enumerate(rules)})

    def job(n: int, r: Rule) -> Column:
        some = F.size(f"__m{n}") > 0
        return F.struct(F.lit(n).alias("i"), F.col(f"__m{n}").alias("m"), F.when(some, F.split(t, r.pattern, -1)).alias("gaps"), _aid(r, t, some).alias("aid"))

    df = df.withColumn("__jobs", F.filter(F.array(*(job(n, r) for n, r in enumerate(rules))), lambda j: F.size(j["m"]) > 0))
    kept = lambda j: F.filter(mt.positioned(j["m"], j["gaps"]), lambda m: _keep(rules, t, j["i"], m, j["aid"]))
    return df.withColumn("__at", F.transform("__jobs", lambda j: F.struct(j["i"].alias("i"), kept(j).alias("k"))))


def _aid(rule: Rule, text: Column, some: Column) -> Column:
    if rule.fixable:
        return F.when(some, F.array(rule.repair(text)))
    if rule.ballot is not None:
        return F.when(some, rule.ballot.minority(rule.ballot.votes(text)))
    return F.lit(None).cast("array<string>")


def _finding(rules: list[Rule], text: Column, i: Column, m: Column) -> Column:
    of = lambda values: _by_rule(rules, i, values)
    begin, more = of([r.shift[0] for r in rules]), of([r.shift[1] for r in rules])
    return F.struct(
        (m["index"] + begin).alias("index"), of([r.id for r in rules]).alias("rule"), (utf16_length(m["m"]) + more).cast("int").alias("length"), m["line"].alias("line"), (m["column"] + begin).alias("column"),
        of([r.severity for r in rules]).alias("severity"), of([r.fixable for r in rules]).alias("fixable"), of([r.summary for r in rules]).alias("summary"), of([r.cite for r in rules]).alias("cite"),
        excerpt(text, m["start"] + begin, F.length(m["m"]) + more).alias("excerpt"),
    )


def find(df: DataFrame, style: Style, text: str = "text", into: str = "findings") -> DataFrame:
    """`df` with an array of findings per row, sorted by index and then rule."""
    columns, rules = df.columns, list(style.rules)
    _refuse_clashes(columns, into)
    df = _located(df, rules, text)
    each = F.flatten(F.transform("__at", lambda j: F.transform(j["k"], lambda m: _finding(rules, F.col(text), j["i"], m))))
    return df.select(*columns, F.array_sort(each).alias(into))


def check(df: DataFrame, style: Style, text: str = "text") -> DataFrame:
    """One row per finding: the other columns of `df`, the style's id, and the finding's fields."""
    rest = [c for c in df.columns if c != text]
    _refuse_clashes(rest, *FIELDS)
    rows = find(df, style, text, "__findings").select(*rest, F.lit(style.id).alias("style"), F.explode("__findings").alias("f"))
    return rows.select(*rest, "style", "f.rule", "f.severity", "f.fixable", "f.index", "f.length", "f.line", "f.column", "f.excerpt", "f.summary", "f.cite")


def unfixable(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("fixable"))


def _tally(rule: Rule, text: str) -> Column:
    return F.coalesce(rule.count(F.col(text)), F.lit(0))


def rule_counts(df: DataFrame, style: Style, text: str = "text", into: str = "counts") -> DataFrame:
    """`df` with a map from rule id to number of findings; no match is placed, and no excerpt cut."""
    columns, rules = df.columns, list(style.rules)
    _refuse_clashes(columns, into)
    placed = [r for r in rules if r.keep and not r.tally and r.ballot is None]
    if placed:  # predicates of one's own see each match
        df = _located(df, placed, text)
    n = lambda i: F.size(F.flatten(F.transform(F.filter("__at", lambda j: j["i"] == i), lambda j: j["k"])))
    each = [F.greatest(n(placed.index(r)), F.lit(0)) if r in placed else _tally(r, text) for r in rules]
    return df.select(*columns, F.map_from_arrays(F.array(*(F.lit(r.id) for r in rules)), F.array(*each)).alias(into))


def finding_totals(df: DataFrame, styles: tuple[Style, ...] = STYLES, text: str = "text") -> DataFrame:
    """style, rule, severity, fixable, docs and findings: a row per rule of each style, of one scan of `df`."""
    counted, given = df.select(F.col(text).alias("text")), [(k, s) for k, s in enumerate(styles)]
    for k, style in given:
        counted = rule_counts(counted, style, "text", f"c{k}")
    counted = counted.select(*(f"c{k}" for k, _ in given))
    cells = [(k, s, i, r) for k, s in given for i, r in enumerate(s.rules)]
    one = counted.agg(*(x for k, _, i, r in cells for x in (F.sum(F.col(f"c{k}")[r.id]).cast("long").alias(f"n{k}_{i}"), F.count_if(F.col(f"c{k}")[r.id] > 0).alias(f"d{k}_{i}"))))
    row = lambda k, s, i, r: F.struct(F.lit(s.name).alias("style"), F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.fixable).alias("fixable"), F.coalesce(F.col(f"d{k}_{i}"), F.lit(0)).alias("docs"), F.coalesce(F.col(f"n{k}_{i}"), F.lit(0)).alias("findings"))
    return one.select(F.explode(F.array(*(row(*c) for c in cells))).alias("r")).select("r.*")


def normalize(df: DataFrame, style: Style, text: str = "text", into: str | None = None) -> DataFrame:
    """`df` with `text` (or a new column `into`) fixed. Each rule is a stage of its own, since it names its text more than once."""
    into, state = into or text, text
    for rule in (r for r in style.rules if r.fixable):
        df, state = df.withColumn(into, rule.fix(F.col(state))), into
    return df if state == into else df.withColumn(into, F.col(text))


def changed(df: DataFrame, style: Style, text: str = "text") -> DataFrame:
    """`df` with the columns `fixed` and `changed`."""
    _refuse_clashes(df.columns, "fixed", "changed")
    return normalize(df, style, text, "fixed").withColumn("changed", ~F.col("fixed").eqNullSafe(F.col(text)))


def survey(df: DataFrame, ballot: Ballot, by: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Votes for each candidate over all texts (or of each group), the verdict, and the first candidate that lost."""
    n = len(ballot.candidates)
    voted = df.select(*by, ballot.votes(F.col(text)).alias("v"))
    sums = voted.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.get("v", F.lit(i))), F.lit(0)) for i in range(n))).alias("votes"))
    rows = sums.withColumns({"verdict": ballot.verdict(F.col("votes")), "lost": ballot.minority(F.col("votes"))})
    rows = rows.withColumn("minority", F.get("lost", F.lit(0)))
    count = reduce(lambda acc, c: F.when(F.col("minority") == c[1], F.get("votes", F.lit(c[0]))).otherwise(acc), enumerate(ballot.candidates), F.lit(0).cast("long"))
    return rows.select(*by, "votes", "verdict", "minority", count.alias("minority_count"))


def survey_width(df: DataFrame, by: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Which no-break space a French corpus uses: full, narrow, verdict, minority, minority_count."""
    got = survey(df, WIDTH, by, text)
    return got.select(*by, F.get("votes", F.lit(1)).alias("full"), F.get("votes", F.lit(0)).alias("narrow"), "verdict", "minority", "minority_count")


def audit(df: DataFrame, style: Style, text: str = "text") -> DataFrame:
    """Where a style breaks its promises on sample texts: property, rule, culprit, sample and detail.

    A fix repeated must change nothing (idempotence, of each rule and of the whole); a rule must
    not bring back what an earlier one repaired (non-interference); after normalizing, no fixable
    rule may still report (conformance).
    """
    rules = [r for r in style.rules if r.fixable]
    columns = [c for c in df.columns if c != text]
    _refuse_clashes(columns, "ordinal", "property", "rule", "culprit", "sample", "detail")
    df = df.select(*columns, F.col(text).alias("__s0"))
    for i, r in enumerate(rules):
        df = df.withColumns({f"__s{i + 1}": r.fix(F.col(f"__s{i}")), f"__o{i}": r.fix(F.col("__s0"))})
    last = f"__s{len(rules)}"
    df = df.withColumns({f"__t{i}": r.fix(F.col(f"__o{i}")) for i, r in enumerate(rules)})
    df = normalize(df, style, last, "__again")
    left = {(e, i): F.coalesce(r.count(F.col(f"__s{i + 1}")), F.lit(0)) for e, r in enumerate(rules) for i in range(e, len(rules))}
    df = df.withColumns({f"__w{e}_{i}": n for (e, i), n in left.items()})
    # Only the first of what is left is told, so nothing else is placed.
    df = df.withColumns({f"__r{i}": r.repair(F.col(last)) for i, r in enumerate(rules)})
    df = df.withColumns({f"__m{i}": F.when(r.possible(F.col(last)), F.regexp_extract_all(F.col(last), F.lit(r.pattern), F.lit(0))).otherwise(mt.no_texts()) for i, r in enumerate(rules)})
    df = df.withColumns({f"__f{i}": mt.first_other(F.col(last), r.pattern, F.col(f"__m{i}"), F.col(f"__r{i}")) for i, r in enumerate(rules)})

    none = F.lit(None).cast("string")
    sample = clipped(F.col("__s0"))

    def violation(broken: Column, prop: str, rule: str, detail: Column, culprit: Column = none) -> Column:
        return F.when(broken, F.struct(F.lit(prop).alias("property"), F.lit(rule).alias("rule"), culprit.alias("culprit"), sample.alias("sample"), detail.alias("detail")))

    again = F.lit("fixing what is fixed gives another text")
    out = [violation(F.col(f"__t{i}") != F.col(f"__o{i}"), "idempotence", r.id, again) for i, r in enumerate(rules)]
    for i, later in enumerate(rules):
        for e in range(i - 1, -1, -1):
            # Settled: nothing left after its own fix, and nothing brought back since.
            settled = reduce(lambda acc, k, e=e: acc & (F.col(f"__w{e}_{k}") == 0), range(e, i), F.lit(True))
            back = F.col(f"__w{e}_{i}")
            said = F.concat(F.lit(f"{later.id} undoes it: "), back.cast("string"), F.lit(" to repair anew"))
            out.append(violation(settled & (back > 0), "non-interference", rules[e].id, said, F.lit(later.id)))
    out.append(violation(F.col("__again") != F.col(last), "idempotence", "normalize", again))
    for i, r in enumerate(rules):
        first = F.col(f"__f{i}")
        said = F.concat(F.lit("left in the normalized text: "), excerpt(F.col(last), first["start"], F.length(first["m"])))
        out.append(violation(first.isNotNull(), "conformance", r.id, said))
    rows = df.select(*columns, F.posexplode(F.filter(F.array(*out), lambda v: v.isNotNull())).alias("ordinal", "v"))
    return rows.select(*columns, "ordinal", "v.property", "v.rule", "v.culprit", "v.sample", "v.detail")


def report(df: DataFrame, style: Style, file: str, text: str = "text", config: str | None = None) -> DataFrame:
    """One row per text: `file`, whether fixing changes it, and its findings, nested."""
    df = df.select(F.col(file).alias("file"), F.col(text).alias("text"))
    return find(changed(df, style), style).select("file", "changed", "findings", F.lit(style.id).alias("style"), F.lit(style.standard).alias("standard"), F.lit(config).alias("config"))


#: Which style a language tag of the data stands for; German without a region is taken as Germany's.
BY_LANGUAGE = {"de": "de-DE", "en": "en", "es": "es", "fr": "fr", "nl": "nl"}


def normalize_by_language(df: DataFrame, lang: str = "lang", text: str = "text", into: str = "fixed", dispatch: dict[str, str] = BY_LANGUAGE) -> DataFrame:
    """`df` with `into`, the text fixed in the style of its row's language, and `style`, that style's id.

    One projection for all languages; a text of another language, or none, stays and has a null style.
    """
    _refuse_clashes(df.columns, into, "style")
    columns, of = df.columns, {s.name: s for s in STYLES}
    tag, state = F.lower(F.col(lang)), text
    for name, tags in ((n, [t for t, m in dispatch.items() if m == n]) for n in dict.fromkeys(dispatch.values())):
        for rule in (r for r in of[name].rules if r.fixable):
            df, state = df.withColumn(into, F.when(tag.isin(tags), rule.fix(F.col(state))).otherwise(F.col(state))), into
    named = reduce(lambda acc, m: F.when(tag == m[0], F.lit(of[m[1]].id)).otherwise(acc), dispatch.items(), F.lit(None).cast("string"))
    return df.select(*columns, into, named.alias("style"))


def totals(findings: DataFrame) -> DataFrame:
    """Findings, errors, warnings, and those that need a decision."""
    return findings.agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(~F.col("fixable")).alias("undecided"),
    )


def failing(findings: DataFrame, strict: bool = False) -> bool:
    """Whether a check fails: any error, or with `strict` any finding."""
    return bool((findings if strict else findings.where("severity = 'error'")).limit(1).count())


def catalog(spark: SparkSession, styles: tuple[Style, ...] = STYLES) -> DataFrame:
    """Every rule of the given styles: style, position, rule, kind, severity, fixable, pattern, summary, cite."""
    rows = [(s.name, s.stamp, s.lang, s.standard, i, r.id, r.kind, r.severity, r.fixable, r.source, r.summary, r.cite) for s in styles for i, r in enumerate(s.rules)]
    return spark.createDataFrame(rows, "style string, stamp string, lang string, standard string, position int, rule string, kind string, severity string, fixable boolean, pattern string, summary string, cite string")
