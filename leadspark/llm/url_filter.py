"""URL filters: expressions of hosts and paths, matched by short hash prefixes.

A URL is expanded into every combination of a host suffix and a path prefix that a rule
could have. Expressions meet the rules in an equi join on the first four bytes of their
digest; the full digest decides, then the precedence of the rules that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: What becomes of a URL that no rule fits.
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``verdict, host, path`` rows of a short list; a long one is read from a table."""
    rows = [F.struct(*(F.lit(x).alias(k) for x, k in zip(r, ("verdict", "host", "path"), strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    place = F.locate("://", url)
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "(?s)^[^?#]*", 0)
    return lower_ascii(host), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "\\."))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of ``labels`` labels times path prefixes of ``lengths`` characters, as ``array<string>``."""
    hosts = F.array_compact(F.array(*(F.when(_labels(host) >= n, F.substring_index(host, ".", -n)) for n in labels)))
    paths = F.array_compact(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    ``rules`` has ``verdict, host, path``; a rule fits its host and all subdomains when the
    URL's path starts with the rule's. The longest rule wins, then the longer host, then
    block over allow. Null URLs and those without ``://`` have empty host and path, no rule
    and the default verdict. Equal URLs are expanded once; repeated rows all stay; an empty
    table gives no rows. Rules with a null are ignored. Only distinct URLs and short
    expressions are shuffled, and only if there are many rules: a short list goes to the
    tasks by Spark's own size threshold.
    """
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select("verdict", lower_ascii(F.col("host")).alias("host"), "path")
    shape = rules.agg(F.collect_set(_labels(F.col("host"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = url_parts(F.col("url"))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = own.filter(F.col("url").isNotNull()).select("url").distinct()
    if shape.labels:
        found = urls.select("url", F.explode(expressions(host, path, sorted(shape.labels), sorted(shape.lengths))).alias("expr"))
    else:
        found = urls.select("url", F.lit(None).cast("string").alias("expr")).filter("false")
    digest = lambda c: F.unhex(F.sha2(c, 256))
    found = found.select("url", digest(F.col("expr")).alias("digest")).withColumn("short", F.substring("digest", 1, 4))
    known = rules.withColumn("rule", F.concat("host", "path")).withColumn("rule_digest", digest(F.col("rule")))
    known = known.select(F.substring("rule_digest", 1, 4).alias("short"), "rule_digest", "rule", "verdict", F.length("host").alias("host_length"))
    hits = found.join(known, "short").filter("digest = rule_digest")
    rank = F.struct(F.length("rule").alias("l"), F.col("host_length").alias("h"), F.col("verdict").alias("v"), F.col("rule").alias("r"))
    best = hits.groupBy("url").agg(F.max(rank).alias("best")).select("url", F.col("best.r").alias("rule"), F.col("best.v").alias("found"))
    return own.join(best, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("found", F.lit(default)).alias("verdict")
    )
