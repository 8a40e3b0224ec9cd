"""URL filters: rules for hosts and paths, and logistic regression on hashed character n-grams of host and path.

DataFrame functions only. A rule fits its host and all subdomains where the url's path starts with the rule's; of those
that fit the longest (host and path together) wins, the first in order among equals. Urls that no rule fits get the
classifier's verdict. It is trained from a small labelled table of urls by gradient descent: each turn is one
aggregation of the slopes by bucket, so only as many numbers as there are buckets reach the driver.

Null urls and urls without `://` have an empty host and path, which only a rule with both empty would fit. Repeated
rows get equal results; an empty label table leaves all weights at 0, which means allow. Outputs replace input
columns of their name, other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BUCKETS = 1 << 10
#: Urls to learn from, at most.
SAMPLE = 2000
UPPER, BELOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, BELOW)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Add `host` and `path`."""
    return df.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})


def ruled(rules: list[Rule], host_of: Column, path_of: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # what comes last here asks first: the longest, and the first of equals
        fits = ((host_of == r.host) | host_of.endswith("." + r.host)) & path_of.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host_of: Column, path_of: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Buckets of all runs of so many characters in the host, and apart from these in the path, with an end mark on either side."""

    def of(text: Column, kind: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.lit(kind), framed.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*(of(text, kind, n) for text, kind in ((host_of, "h"), (path_of, "p")) for n in sizes))


def margin(buckets: Column, weights: list[float]) -> Column:
    """Bias, the last weight, plus the mean weight of the buckets, times the root of their number."""
    table = F.lit(weights)
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1))
    return total / F.sqrt(F.size(buckets).cast("double")) + F.lit(weights[-1])


def fit(labelled: DataFrame, url: str = "url", label: str = "label", turns: int = 25, rate: float = 4.0, decay: float = 1e-4) -> list[float]:
    """Weights from a table of urls and labels (1: block, 0: allow; others and nulls are left out)."""
    rows = parsed(labelled.where(F.col(label).isin(0, 1)).select(F.col(url).alias("url"), F.col(label).cast("double").alias("y")), "url")
    rows = saved(rows.select("y", grams(F.col("host"), F.col("path")).alias("buckets")).where(F.size("buckets") > 0).coalesce(4), "url-labels")
    weights, n = [0.0] * (BUCKETS + 1), rows.count()
    for turn in range(turns if n else 0):
        slope = rows.select((F.col("y") - 1 / (1 + F.exp(-margin(F.col("buckets"), weights)))).alias("g"), "buckets")
        bias = F.array(F.lit(BUCKETS))
        each = slope.select(F.explode(F.concat("buckets", bias)).alias("b"), (F.col("g") / F.sqrt(F.size("buckets").cast("double"))).alias("s"), "g")
        for b, s, g in each.groupBy("b").agg(F.sum("s"), F.sum("g")).collect():
            weights[b] += rate / math.sqrt(1 + turn / 5) * ((g if b == BUCKETS else s) / n - decay * weights[b])
    return weights


def judge(df: DataFrame, rules: list[Rule], weights: list[float], url: str = "url", limit: float = 0.5) -> DataFrame:
    """Add `host, path, rule, verdict string` (allow or block) and `block_score double`, the classifier's probability."""
    rows = parsed(df, url).withColumn("__rule", ruled(rules, F.col("host"), F.col("path"))).withColumn("block_score", 1 / (1 + F.exp(-margin(grams(F.col("host"), F.col("path")), weights))))
    own = F.when(F.col("block_score") > limit, "block").otherwise("allow")
    return rows.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), own)}).drop("__rule")


def labelled_by_rules(df: DataFrame, rules: list[Rule], url: str = "url", most: int = SAMPLE) -> DataFrame:
    """A small labelled table: of the distinct urls that rules decide, those with the smallest hash, up to `most`."""
    rows = parsed(df.select(F.col(url).alias("url")), "url").select("url", ruled(rules, F.col("host"), F.col("path")).alias("r")).where("r IS NOT NULL")
    first = rows.groupBy("url").agg(F.first("r").alias("r")).orderBy(F.xxhash64("url"), "url").limit(most)
    return first.select("url", (F.col("r.verdict") == "block").cast("int").alias("label"))
