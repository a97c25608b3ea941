"""URL filters as a sort-merge range join: reversed-host keys, a sorted sweep, a stack of active nested rules.

The key of host a.b.c is `c.b.a.`, so a rule's host and all subdomains are the interval of keys that begin with the
rule's key, and such intervals nest. Sorted together, an interval's start sets the stack of rule hosts in force, its end
sets the stack of what encloses it, and a url takes the last stack before it: as many hosts as its own has labels, at most.

The paths that begin with a rule's path are an interval too. Under each host of its stack a url is sorted among that
host's rule paths and takes the last one at or before it, with the stack of those that it begins with: every rule path
that the url's path begins with is in it. So a host may have any number of rules.

Host intervals never leave their top-level label, so both sweeps run by label; a label's urls are dealt over parts of
about PART_ROWS, and its rules, few beside the urls, go to each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import written

#: Urls of a label in one part, about, until it has MAX_PARTS; beyond, parts grow instead.
PART_ROWS, MAX_PARTS = 4096, 10_000
#: Parts over which urls under no rule's host are dealt.
OTHER_PARTS = 4096
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url):
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _label(key):
    return F.substring_index(key, ".", 1)


def _hosts(rules: DataFrame) -> DataFrame:
    """key, rank, depth, stack: from key on (rank 0 ends come before rank 1 starts) these keys of rule hosts are in force."""
    keys = rules.select("key").distinct()
    labels = F.split(F.substring("key", F.lit(1), F.char_length("key") - 1), r"\.", -1)
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    above = keys.select("key", F.explode(chain).alias("above")).join(keys.select(F.col("key").alias("above")), "above")
    stacks = above.groupBy("key").agg(F.array_sort(F.collect_list("above")).alias("all"))  # as many as the host has labels
    # of the strings that begin with a key, the first that is greater ends in / instead of the last .
    after = F.concat(F.substring("key", F.lit(1), F.char_length("key") - 1), F.lit("/"))
    depth = F.char_length("key").alias("depth")
    starts = stacks.select("key", F.lit(1).alias("rank"), depth, F.col("all").alias("stack"), _label(F.col("key")).alias("label"))
    ends = stacks.select(after.alias("key"), F.lit(0).alias("rank"), depth, F.array_except("all", F.array("key")).alias("stack"), _label(F.col("key")).alias("label"))
    return starts.unionByName(ends)


def _paths(rules: DataFrame) -> DataFrame:
    """under, path, rank 0, stack: each rule's path with all rules of its host whose paths it begins with, the longest first."""
    begun = rules.select(F.col("key").alias("under"), "path", F.explode(F.sequence(F.lit(0), F.char_length("path"))).alias("n")).withColumn("short", F.substring("path", F.lit(1), F.col("n")))
    held = rules.select(F.col("key").alias("under"), F.col("path").alias("short"), F.struct((-F.char_length(F.concat("host", "path"))).alias("order"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("r"))
    return begun.join(held, ["under", "short"]).groupBy("under", "path").agg(F.array_sort(F.collect_list("r")).alias("stack")).withColumn("rank", F.lit(0))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns in `carry` of each page, host, path, rule (host and path of the one that decides, or null), verdict.

    rules has verdict, host, path. A rule fits its host and all subdomains where the url's path starts with the rule's;
    the longest (host and path together, then by code point) wins; without one the verdict is `otherwise`. A null url,
    or one without ://, has an empty host and path and fits no rule. Rules with a null or an empty host, a null path or
    verdict are passed over, repeated rules count once, of one rule's verdicts the least by code point. Without rules,
    every verdict is `otherwise`. Repeated pages are rows of their own. Other columns are not read.
    """
    inner = [f"_c{k}" for k in range(len(carry))]
    named = rules.where("host is not null and host <> '' and path is not null and verdict is not null").select(F.lower("host").alias("host"), "path", "verdict")
    own = written(named.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", host_key(F.col("host"))))
    urls = pages.select(*[F.col(c).alias(n) for c, n in zip(carry, inner, strict=True)], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumns({"rank": F.lit(2), "depth": F.lit(0), "label": _label(F.col("key")), "_row": F.monotonically_increasing_id()})
    # labels with several parts: a row for each PART_ROWS urls at most
    total = pages.count()
    full = max(PART_ROWS, -(-total // MAX_PARTS))
    parts = urls.groupBy(F.col("label").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / full).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.broadcast(written(parts))
    several = lambda df: df.join(parts, F.col("label") == F.col("_of"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    everywhere = lambda df: several(df).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_of")
    dealt = several(urls).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")).drop("_parts", "_of")

    # of ends at one key the outermost is last; nothing starts between a start and the urls at its key
    sweep = Window.partitionBy("label", "_part").orderBy("key", "rank", F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.unionByName(everywhere(_hosts(own)), allowMissingColumns=True)
    under = both.withColumn("_in_force", F.last("stack", ignorenulls=True).over(sweep)).where("rank = 2")
    each = under.select(*inner, "host", "path", "_row", "_part", F.explode_outer("_in_force").alias("under")).withColumns({"rank": F.lit(1), "_other": F.when(F.col("under").isNull(), F.pmod(F.xxhash64("_row"), F.lit(OTHER_PARTS)))})

    there = everywhere(_paths(own).withColumn("label", _label(F.col("under")))).drop("label")
    sweep = Window.partitionBy("under", "_part", "_other").orderBy("path", "rank").rowsBetween(Window.unboundedPreceding, 0)
    swept = each.unionByName(there, allowMissingColumns=True).withColumn("_in_force", F.when(F.col("under").isNotNull(), F.last("stack", ignorenulls=True).over(sweep))).where("rank = 1")
    won = F.try_element_at(F.filter("_in_force", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    best = swept.withColumn("_won", won).groupBy("_row").agg(*[F.first(n).alias(n) for n in (*inner, "host", "path")], F.min("_won").alias("_won"))
    return best.select(*[F.col(n).alias(c) for c, n in zip(carry, inner, strict=True)], "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(otherwise)).alias("verdict"))


def url_report(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame([*RULES], "verdict string, host string, path string")
    return judge(pages, rules)


ORACLE = r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC) = 1
"""
