"""URL filters: rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` with at least zero
*literal tokens*: alphanumeric runs that any matching URL contains as whole
runs. Each rule is filed under the one of its tokens that is rarest among the
URLs to judge. A URL's own tokens fetch the rules filed under them, and only
those run their expressions. Up to ``INLINE`` rules travel inside the plan, and the
whole judgement happens inside the row: no shuffle, no join, no Python. A longer list
is a table that distinct hosts and paths meet by token; also without Python.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules whose index travels inside the plan; a longer list is joined.
INLINE = 5_000


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows; ``tokens`` are whole runs in every match."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    is_pattern: bool = False


def prefix_rule(verdict: str, host: str, path: str = "") -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    tail = re.escape(path) if path else "(?=/|$)"
    runs = re.findall(r"[0-9A-Za-z]+", host + path)
    if path and re.search(r"[0-9A-Za-z]$", path):
        runs = runs[:-1]  # the last run may go on in the URL
    return Rule(host + path, verdict, f"(?s)^(?:[^/]*\\.)?{re.escape(host)}{tail}", tuple(dict.fromkeys(runs)))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A wildcard pattern: ``*`` any text, ``^`` a non-alphanumeric or the end,
    a leading ``||`` the start of the host or of one of its labels."""
    body = pattern.removeprefix("||")
    regex = "".join({"*": ".*", "^": "(?:[^0-9A-Za-z]|$)"}.get(c) or re.escape(c) for c in body)
    start = r"(?s)^(?:[^/]*\.)?" if body != pattern else "(?s)"
    runs = [m for m in re.finditer(r"[0-9A-Za-z]+", body)]
    whole = [m[0] for m in runs if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and body != pattern) and m.end() < len(body) and body[m.end()] != "*"]
    return Rule(pattern, verdict, start + regex, tuple(dict.fromkeys(whole)), True)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; '' if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; '' if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(target, "[^0-9A-Za-z]+"))


def token_counts(urls: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``; one row per rule token reaches the driver."""
    if not tokens:
        return {}
    target = F.concat(url_host(F.col(url_col)), url_path(F.col(url_col)))
    found = F.array_intersect(_tokens(target), F.array(*map(F.lit, tokens)))
    rows = urls.select(F.explode(found).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[list[list[dict]], list[dict]]:
    size = 1
    while size < 2 * len(rules):
        size *= 2
    filed: dict[str, list[dict]] = {}
    always = []
    for r in rules:
        row = {"token": "", "regex": r.regex, "rule": r.name, "verdict": r.verdict, "chars": len(r.name), "prefix": 0 if r.is_pattern else 1}
        if r.tokens:
            row["token"] = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            filed.setdefault(row["token"], []).append(row)
        else:
            always.append(row)
    return [filed, size], always


ROW = "struct<prefix:int,chars:int,rule:string,verdict:string,regex:string,token:string>"


def _in_row(urls: DataFrame, url_col: str, target: Column, rules: list[Rule]) -> Column:
    """The best fitting rule of ``target``, from an index inside the plan."""
    counts = token_counts(urls, url_col, sorted({t for r in rules for t in r.tokens}))
    (filed, size), always = _index(rules, counts)
    buckets: list[list[dict]] = [[] for _ in range(size)]
    spark = urls.sparkSession
    if filed:
        names = sorted(filed)
        placed = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("t")).select("t", F.pmod(F.xxhash64("t"), F.lit(size)).alias("b")).collect()
        for t, b in placed:
            buckets[b].extend(filed[t])
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{ROW}>>")
    rest = F.from_json(F.lit(json.dumps(always)), f"array<{ROW}>")
    fetched = F.flatten(F.transform(_tokens(target), lambda t: F.filter(F.element_at(index, (F.pmod(F.xxhash64(t), F.lit(size)) + 1).cast("int")), lambda r: r["token"] == t)))
    return F.array_max(F.filter(F.concat(fetched, rest), lambda r: F.rlike(target, r["regex"])))


def _by_join(urls: DataFrame, url_col: str, rules: list[Rule]) -> DataFrame:
    """(target, best): the best fitting rule of each distinct target that has one."""
    spark = urls.sparkSession
    targets = urls.select(F.concat(url_host(F.col(url_col)), url_path(F.col(url_col))).alias("target")).distinct()
    rows = [(i, list(r.tokens), 0 if r.is_pattern else 1, len(r.name), r.name, r.verdict, r.regex) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "n int, tokens array<string>, prefix int, chars int, rule string, verdict string, regex string")
    filed = table.select("n", F.explode("tokens").alias("token"))
    known = filed.select("token").distinct()
    tokens = targets.select("target", F.explode(_tokens(F.col("target"))).alias("token")).join(known, "token", "left_semi")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rank = F.struct(F.coalesce("urls", F.lit(0)), -F.length("token"), "token")
    filed = filed.join(counts, "token", "left").groupBy("n").agg(F.min_by("token", rank).alias("token"))
    index = table.drop("tokens").join(filed, "n")
    fitting = tokens.join(index, "token").where(F.rlike("target", F.col("regex")))
    best = lambda token: F.struct("prefix", "chars", "rule", "verdict", "regex", token.alias("token"))
    fits = [fitting.select("target", best(F.col("token")).alias("best"))]
    bare = [r for r in rules if not r.tokens]
    for a in range(0, len(bare), INLINE):  # every URL runs these, whatever their number
        some = F.from_json(F.lit(json.dumps(_index(bare[a : a + INLINE], {})[1])), f"array<{ROW}>")
        fits.append(targets.select("target", F.array_max(F.filter(some, lambda r: F.rlike(F.col("target"), r["regex"]))).alias("best")).where("best is not null"))
    out = fits[0]
    for more in fits[1:]:
        out = out.unionByName(more)
    return out.groupBy("target").agg(F.max("best").alias("best"))


def judge(urls: DataFrame, rules: list[Rule], url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule, pattern and verdict to every row of ``urls``.

    The longest fitting prefix rule decides (equal lengths: the greater rule
    string); where none fits, the longest fitting pattern rule does and is
    shown in ``pattern``; else ``otherwise``. A null URL or one without
    ``://`` has an empty host and path, which no prefix rule fits. Columns of
    ``urls`` named like a result are replaced; all others stay. Rows are neither
    dropped nor merged; an empty table gives an empty one; no rules: ``otherwise``.
    """
    at, best, key = (fresh(urls, c) for c in ("_judged", "_best", "_target"))
    host, path = url_host(F.col(f"`{url_col}`")), url_path(F.col(f"`{url_col}`"))
    df = urls.withColumn(at, F.struct(host.alias("host"), path.alias("path")))
    target = F.concat(F.col(f"`{at}`.host"), F.col(f"`{at}`.path"))
    if len(rules) <= INLINE:
        df = df.withColumn(best, _in_row(urls, url_col, target, rules))
    else:
        found = _by_join(urls, url_col, rules).toDF(key, best)
        df = df.join(found, target == F.col(f"`{key}`"), "left")
    of = lambda c: F.col(f"`{best}`.{c}")
    by_prefix = of("prefix") == 1
    out = {
        "host": F.col(f"`{at}`.host"),
        "path": F.col(f"`{at}`.path"),
        "rule": F.when(by_prefix, of("rule")),
        "pattern": F.when(~by_prefix, of("rule")),
        "verdict": F.coalesce(of("verdict"), F.lit(otherwise)),
    }
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in out]
    return df.select(*kept, *(v.alias(k) for k, v in out.items()))
