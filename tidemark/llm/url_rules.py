"""URL filter rules found by their rarest literal token; only fetched rules run their pattern.

A rule is `host/path`. It fits the host itself and all subdomains if the URL's path starts with the rule's path.
The longest fitting rule wins (ties: the greater string, which two different rules of one length that both fit
cannot reach except across subdomains). Everything is DataFrame expressions.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and gets the default
verdict; repeated URLs get equal answers; columns of the input are kept, and helper columns start with `_u_`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(UPPER, LOWER))

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    @property
    def tokens(self) -> list[str]:
        """Host labels, and the path segments that the rule closes with a slash: literals that any fitting URL has."""
        closed = self.path.split("/")[1:-1]
        return list(dict.fromkeys([f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in closed]))

    @property
    def pattern(self) -> str:
        """A Java pattern for host followed by path."""
        literal = "".join(x if re.match(r"[0-9A-Za-z_/-]", x) else f"\\x{{{ord(x):x}}}" for x in self.host + self.path)
        return rf"(?s)^(?:[^/]*\.)?{literal}"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def rarest_tokens(parsed: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """For each rule the token of its own that fewest URLs of the table have; counted over all of them."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_intersect("_u_tokens", F.array(*map(F.lit, wanted)))
    seen = parsed.select(F.explode(tokens).alias("t")).groupBy("t").count()
    counts = {x["t"]: x["count"] for x in seen.collect()}  # a row for each token of the rules at most
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules}


def judge_urls(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", inline_rules: int = 256) -> DataFrame:
    """df with host, path, rule and verdict. Up to inline_rules rules are looked up in a literal map, without a
    shuffle; more of them are joined to the exploded tokens of the distinct URLs."""
    spark = df.sparkSession
    parsed = df.withColumn("_u_host", url_host(F.col(url))).withColumn("_u_path", url_path(F.col(url)))
    parsed = parsed.withColumn("_u_tokens", url_tokens(F.col("_u_host"), F.col("_u_path")))
    subject = F.concat("_u_host", "_u_path")
    if not rules:
        best = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
        judged = parsed.withColumn("_u_best", best)
    elif len(rules) <= inline_rules:
        index: dict[str, list[Rule]] = {}
        for rule, token in rarest_tokens(parsed, rules).items():
            index.setdefault(token, []).append(rule)
        entries = [x for token, found in sorted(index.items()) for x in (F.lit(token), F.array(*[F.struct(F.lit(len(r.text)).alias("n"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")) for r in found]))]
        lists = F.transform(F.array_intersect("_u_tokens", F.array(*map(F.lit, sorted(index)))), lambda t: F.create_map(*entries)[t])
        fetched = F.flatten(lists)
        fits = F.filter(fetched, lambda c: F.call_function("rlike", subject, c["pattern"]))
        best = F.array_max(F.transform(fits, lambda c: F.struct(c["n"].alias("n"), c["rule"].alias("rule"), c["verdict"].alias("verdict"))))
        judged = parsed.withColumn("_u_best", best)
    else:
        rarest = rarest_tokens(parsed, rules)
        rows = [(rarest[r], len(r.text), r.text, r.verdict, r.pattern) for r in rules]
        held = spark.createDataFrame(rows, "t string, n int, rule string, verdict string, pattern string")
        one = parsed.groupBy("_u_host", "_u_path").agg(F.first("_u_tokens").alias("_u_tokens"))
        fetched = one.select("_u_host", "_u_path", F.explode("_u_tokens").alias("t")).join(held, "t")
        fits = fetched.where(F.call_function("rlike", subject, F.col("pattern")))
        best = fits.groupBy("_u_host", "_u_path").agg(F.max(F.struct("n", "rule", "verdict")).alias("_u_best"))
        judged = parsed.join(best, ["_u_host", "_u_path"], "left")
    out = {"host": F.col("_u_host"), "path": F.col("_u_path"), "rule": F.col("_u_best.rule"), "verdict": F.coalesce(F.col("_u_best.verdict"), F.lit(default))}
    return judged.withColumns(out).drop("_u_host", "_u_path", "_u_tokens", "_u_best")
