"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is filed under one literal token that each URL it can match must contain; of its
tokens, the one that the fewest rules share. A URL is cut into tokens, the tokens fetch
candidate rules from the index, and only those candidates run their regular expression.
All of it is Spark expressions: no Python, no shuffle of the pages while the index is small
enough to be a literal (`LITERAL_RULES`), an equi-join on the token beyond.

Host rules are named in the result; patterns of one's own only give a verdict where no host rule fits.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the
default verdict. Repeated rows are judged alike, an empty table gives an empty result, and
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is a literal map in the plan.
LITERAL_RULES = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """`name` is reported; `regex` (Java) runs on host + path; `tokens` are literal tokens any match contains."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    #: Higher wins; ties go to the name that sorts first.
    rank: int
    #: Whether the result names it.
    shown: bool = True


def tokens_of(literal: str) -> tuple[str, ...]:
    """The tokens of a string: maximal runs of ASCII letters and digits, lower-cased."""
    return tuple(re.findall(r"[a-z0-9]+", literal.lower()))


def _java_quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_\- ])", r"\\\1", text)


def host_rule(verdict: str, spelled: str) -> UrlRule:
    """A rule such as ``example.net/en/``: the host and its subdomains, with paths that start so.

    Only tokens that are delimited on both sides in the pattern are indexed: those of the host,
    and path segments that end within the rule.
    """
    host, slash, rest = spelled.partition("/")
    path = slash + rest
    whole = tokens_of(host) + tokens_of(path[: path.rfind("/") + 1])
    return UrlRule(spelled, verdict, rf"^(?:[^/]*\.)?{_java_quote(host)}(?={_java_quote(path)})", whole, len(spelled))


def pattern_rule(name: str, verdict: str, regex: str, literal: str, rank: int = 0) -> UrlRule:
    """A general pattern, below any host rule; `literal` is text that any match holds, delimited by other characters."""
    return UrlRule(name, verdict, regex, tokens_of(literal), rank, shown=False)


def segment_rule(verdict: str, segment: str) -> UrlRule:
    """A segment of the path, in any case, with or without an ending."""
    return pattern_rule(f"/{segment}", verdict, rf"(?i)/{_java_quote(segment)}(?:[/.]|$)", f"/{segment}/")


def ending_rule(verdict: str, ending: str) -> UrlRule:
    """The ending of a path's last segment, in any case."""
    return pattern_rule(f".{ending}", verdict, rf"(?i)/[^/]*\.{_java_quote(ending)}$", f".{ending}")


def index_rules(rules: list[UrlRule]) -> dict[str, list[UrlRule]]:
    """Rules by their rarest literal token (ties: the longest, then the first in code-point order)."""
    often = Counter(t for r in rules for t in set(r.tokens))
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token to be indexed by")
        index.setdefault(min(set(r.tokens), key=lambda t: (often[t], -len(t), t)), []).append(r)
    return index


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _rule_struct(r: UrlRule) -> Column:
    return F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.shown).alias("shown"))


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id_col`, host, path, rule (null if none fits) and verdict for each row of `pages`."""
    index = index_rules(rules)
    host, path = split_url(F.col(url_col))
    df = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    toks = F.array_distinct(F.split(F.translate(F.concat("host", "path"), UPPER, LOWER), "[^a-z0-9]+"))
    best = lambda found: F.sort_array(F.transform(found, lambda r: F.struct((-r["rank"]).alias("o"), r["name"].alias("name"), r["verdict"].alias("verdict"), r["shown"].alias("shown"))))
    target = F.concat("host", "path")
    if len(rules) <= LITERAL_RULES:
        table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_rule_struct, rs)))])
        fetched = F.flatten(F.transform(F.filter(toks, lambda t: t.isin(*index)), lambda t: F.element_at(table, t)))
        fits = F.filter(fetched, lambda r: F.regexp_like(target, r["regex"]))
        df = df.withColumn("__best", F.get(best(fits), 0))
    else:
        spark = pages.sparkSession
        rows = [(t, r.rank, r.name, r.verdict, r.regex, r.shown) for t, rs in index.items() for r in rs]
        table = spark.createDataFrame(rows, "token string, rank int, name string, verdict string, regex string, shown boolean")
        hits = df.select("host", "path").distinct().withColumn("token", F.explode(toks)).join(table, "token").where(F.regexp_like(target, F.col("regex")))
        first = hits.groupBy("host", "path").agg(F.min(F.struct((-F.col("rank")).alias("o"), "name", "verdict", "shown")).alias("__best"))
        df = df.join(first, ["host", "path"], "left")
    return df.select(id_col, "host", "path", F.when(F.col("__best.shown"), F.col("__best.name")).alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))
