"""URL filters (operator 1), DataFrame functions only.

Two kinds of rules: `host/path` rules fit a host with all its subdomains and paths that start with theirs, and pattern
rules are regular expressions over the whole url. Each rule is indexed by the rarest of its literal tokens (rarest in
the urls at hand; the counting job returns a number per rule token). A url's own tokens fetch candidate rules, and
only those run their regular expressions. A pattern with alternatives is best given as a rule for each, as only the words
that all matches have are its tokens. Rules without a literal token are candidates of every url.

The index is a constant in the plan, as buckets by token hash, up to `MAX_IN_PLAN` rules; a larger rule set is joined
by token with the distinct urls instead, in a shuffle that Spark may split, and its verdicts are joined back; its rules
without a token stay in the plan.

Verdicts: the longest `host/path` rule that fits (then: the longer host, then block) decides; else a pattern rule that
fits blocks; else the url is allowed. Null urls and urls without `://` have empty host and path, and only rules without
`host/` could fit them. Very long urls are judged whole. Repeated rows are judged each; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

MAX_IN_PLAN = 20_000
BUCKETS = 1024

#: (verdict, rule)
SITE_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: (pattern over host and path, both as in the url, the literal tokens that any match has whole)
PATTERNS = [
    *((rf"(^|\.){word}\.", (word,)) for word in ("adserver", "doubleclick", "adservice")),
    *((f"/{word}/", (word,)) for word in ("casino", "betting", "poker")),
    (r"(^|\.)xxx/", ("xxx",)),
]


class Rule(NamedTuple):
    verdict: str
    rule: str | None  # None: a pattern
    regex: str  # over host and path, joined
    tokens: tuple[str, ...]
    weight: int  # the larger wins


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def compile_rules(site_rules: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, Sequence[str]]]) -> list[Rule]:
    """Site rules as regular expressions. Their tokens: all of the host, and those of the path that end inside it."""
    out = []
    for verdict, rule in site_rules:
        host, slash, path = rule.partition("/")
        path = slash + path
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        inner = re.sub("[A-Za-z0-9]+$", "", path)
        weight = (len(rule) << 20) + (len(host) << 4) + (verdict == "block")
        out.append(Rule(verdict, rule, f"^([^/?#]*\\.)?{_quoted(host)}{_quoted(path)}", tuple(dict.fromkeys(tokens(host) + tokens(inner))), weight))
    return out + [Rule("block", None, p, tuple(t), 0) for p, t in patterns]


def _quoted(text: str) -> str:
    return re.sub(r"([^\w/ ])", r"\\\1", text, flags=re.ASCII)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _tokens_of(where: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(where), F.lit("([a-z0-9]+)"), 1))


def _indexed(rules: list[Rule], urls: DataFrame) -> list[tuple[str, int]]:
    """(its rarest literal token, or '' if it has none; rule number) of each rule."""
    known = sorted({t for r in rules for t in r.tokens})
    seen = {}
    if known:
        hits = F.array_intersect(_tokens_of(F.concat("_host", "_path")), F.array(*map(F.lit, known)) if len(known) < 100 else F.from_json(F.lit(json.dumps(known)), "array<string>"))
        seen = dict(urls.select(F.explode(hits).alias("t")).groupBy("t").count().collect())
    return [(min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t), default=""), k) for k, r in enumerate(rules)]


def judge(pages: DataFrame, site_rules: Sequence[tuple[str, str]] = SITE_RULES, patterns: Sequence[tuple[str, Sequence[str]]] = PATTERNS, max_in_plan: int = MAX_IN_PLAN) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = parts(F.col("url"))
    pages = pages.select("page_id", "url").select("page_id", "url", host.alias("_host"), path.alias("_path"))
    rules = compile_rules(site_rules, patterns)
    index = _indexed(rules, pages)
    where = F.concat("_host", "_path")
    pages, spark = pages.withColumn("_where", where), pages.sparkSession

    def best(candidates: Column) -> Column:
        fits = F.filter(candidates, lambda r: F.rlike("_where", r["regex"]))
        return F.array_max(F.transform(fits, lambda r: F.struct(r["weight"].alias("weight"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))

    kind = "struct<token:string,regex:string,weight:bigint,verdict:string,rule:string>"
    rows = [{"token": t, "regex": rules[k].regex, "weight": rules[k].weight, "verdict": rules[k].verdict, "rule": rules[k].rule} for t, k in index]
    always = F.from_json(F.lit(json.dumps([r for r in rows if not r["token"]])), f"array<{kind}>")
    if len(rules) <= max_in_plan:
        buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
        known = sorted({t for t, _ in index if t})
        own = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(known)), "array<string>")).alias("t"))
        at = dict(own.select("t", F.pmod(F.xxhash64("t"), F.lit(BUCKETS))).collect())
        for r in rows:
            if r["token"]:
                buckets[at[r["token"]]].append(r)
        table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{kind}>>")
        fetched = F.flatten(F.transform("_tokens", lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")), lambda r: r["token"] == t)))
        judged = pages.withColumn("_tokens", _tokens_of(F.col("_where"))).withColumn("_best", best(F.concat(fetched, always)))
    else:
        table = spark.createDataFrame([(r["token"], r["regex"], r["weight"], r["verdict"], r["rule"]) for r in rows if r["token"]], "token string, regex string, weight bigint, verdict string, rule string")
        urls = pages.select("_where").distinct()
        hits = urls.withColumn("token", F.explode(_tokens_of(F.col("_where")))).join(table, "token").where(F.rlike("_where", "regex"))
        hits = hits.groupBy("_where").agg(F.max(F.struct("weight", "verdict", "rule")).alias("_fetched"))
        judged = pages.join(hits, "_where", "left").withColumn("_best", F.greatest(F.col("_fetched"), best(always)))
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '(^|\.)(adserver|doubleclick|adservice)\.|/(casino|betting|poker)/|(^|\.)xxx/') THEN 'block'
            ELSE 'allow' END AS verdict FROM c
"""
