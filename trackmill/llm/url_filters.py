"""Operator 4: URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle

#: Between the reversed host and the path of a key.
MARK = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null and no :// give an empty text."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the
    page's path starts with the rule's; the longest rule text wins, then the longer host,
    then the smaller verdict. Pages without a fitting rule get a null rule and ``default``.

    With hosts reversed by labels, a rule is a key prefix, which is an interval of keys.
    A page probes one key per ancestor of its host, no deeper than the deepest rule. The
    sorted sweep over interval bounds and probes keeps a stack: its depth is a running sum
    of opened and closed intervals, and what is on top after a bound is the last interval
    opened at that depth. Probes take the top of the last bound before them, carried over
    from earlier range partitions where their own has none.

    Null, empty and malformed urls have an empty host and path and no rule. Rules with a
    null or empty host are ignored, a null path is empty, repeated rules count once. Urls
    are swept once however many rows carry them; repeated rows all come back. Existing
    columns named host, path, rule or verdict are replaced.
    """
    taken = {"host", "path", "rule", "verdict"}
    parsed = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c.lower() not in taken],
        host_of(F.col(f"`{url}`")).alias("host"),
        path_of(F.col(f"`{url}`")).alias("path"),
    )
    clean = rules.filter(F.col("host") > "").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    labels = F.reverse(F.split("host", r"\."))
    clean = clean.withColumn("labels", labels)
    depth = clean.agg(F.max(F.size("labels"))).first()[0] or 0
    probes = (
        parsed.filter(F.col("host") > "")
        .select("host", "path")
        .distinct()
        .withColumn("labels", F.reverse(F.split("host", r"\.")))
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(depth, 1))))))
        .select("host", "path", _key(F.slice("labels", 1, F.col("n"))).alias("at"))
    )
    swept = _sweep(_bounds(clean), probes)
    order = F.struct(F.length("top.rule"), F.length("top.host"))
    best = swept.filter("top.rule is not null").groupBy("host", "path").agg(F.max_by("top", order).alias("top"))
    return parsed.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in parsed.columns],
        F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
    )


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(MARK), F.col("path")).cast("binary")


def _bounds(rules: DataFrame) -> DataFrame:
    """Both ends of each rule's interval with the rule on top of the stack behind it. No key contains byte FF."""
    rule = F.struct(F.concat("host", "path").alias("rule"), F.col("host").alias("host"), "verdict")
    keyed = rules.select(_key(F.col("labels")).alias("at"), F.col("labels")[0].alias("root"), rule.alias("own"))
    ends = keyed.select(F.concat("at", F.lit(b"\xff")).alias("at"), "root", F.lit(-1).alias("step"), F.lit(None).cast(keyed.schema["own"].dataType).alias("own"))
    starts = keyed.select("at", "root", F.lit(1).alias("step"), "own")
    along = W.partitionBy("root").orderBy("at")
    nested = starts.unionByName(ends).withColumn("depth", F.sum("step").over(along))
    level = W.partitionBy("root", "depth").orderBy("at")
    top = F.when(F.col("depth") > 0, F.last("own", ignorenulls=True).over(level))
    return nested.select("at", F.struct(top.alias("top")).alias("bound"))


def _sweep(bounds: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes with the top of the stack at their key."""
    kind = bounds.schema["bound"].dataType
    events = bounds.select("at", "bound", F.lit("").alias("host"), F.lit("").alias("path")).unionByName(
        probes.select("at", F.lit(None).cast(kind).alias("bound"), "host", "path")
    )
    ordered = events.withColumn("later", F.col("bound").isNull())
    # The partition numbers are read twice, so they are settled first.
    ordered = settle(ordered.repartitionByRange("at", "later", "host", "path").withColumn("part", F.spark_partition_id()))
    lasts = ordered.filter("bound is not null").groupBy("part").agg(F.max_by("bound", "at").alias("last"))
    # One row for each partition at most.
    parts = ordered.select("part").distinct().join(lasts, "part", "left")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("part").orderBy("at", "later")
    seen = ordered.withColumn("seen", F.last("bound", ignorenulls=True).over(inside)).filter("later")
    return seen.join(carried, "part").select("host", "path", F.coalesce("seen", "carried").getField("top").alias("top"))


#: Fixed values of query op4.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL = r"""
with p as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages
), r(rule_host, rule_path, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), u as (select distinct host, path from p),
best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         arg_max(verdict, length(rule_host || rule_path)) as verdict
  from u join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
)
select page_id, p.host, p.path, rule, coalesce(verdict, 'allow') as verdict
from p left join best on p.host = best.host and p.path = best.path
"""


def pages_to_verdicts(pages: DataFrame) -> DataFrame:
    """The contract of query op4."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
