"""URL filter: sort-merge range joins of reversed-host and path keys, in DataFrame functions only.

A host becomes a canonical key of its labels from last to first, each followed by a dot
(`www.example.com` -> `com.example.www.`).  A rule's host is then the interval of all keys that start
with its own, and two such intervals are nested or apart; so are the intervals of paths that start with the paths of one host's rules.
Both are swept in the same way.  Distinct keys and rule keys are range-partitioned and sorted together; a running `last` gives the rule
that opened most recently, whose precomputed chain of enclosing rules is the stack at that point, and those of the stack
still open there hold the key.  What a range partition inherits from those before it is a running maximum over one row for each partition.

The first sweep finds the rule hosts that hold each distinct host (no more than it has labels), the second the longest rule path of each of
these that begins each distinct path.  So no row carries all rules of a host.  The join back to the urls is an ordinary equi-join on
host and path, so one url with a third of the rows is split by adaptive skew handling, and only urls and ids are ever read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first `://` to `/`, `?`, `#` or the end, ASCII lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def stacks(rules: DataFrame, prefixes: Column) -> DataFrame:
    """(group, key, stack): each rule key with all rules (key, action) of its group that are among its `prefixes`, from the outermost."""
    up = rules.select("group", F.col("key").alias("up"), F.struct("key", "action").alias("rule"))
    chain = rules.select("group", "key", F.explode(prefixes).alias("up")).join(up, ["group", "up"])
    return chain.groupBy("group", "key").agg(F.array_sort(F.collect_list("rule")).alias("stack"))


def swept(points: DataFrame, opened: DataFrame, partitions: int | None = None) -> DataFrame:
    """(group, key, stack): each point (group, key) with the rules of `opened` (group, key, stack) whose key begins the point's, from the outermost."""
    spark = points.sparkSession
    events = points.select("group", "key", F.lit(1).alias("kind"), F.lit(None).cast(opened.schema["stack"].dataType).alias("stack"))
    events = events.unionByName(opened.select("group", "key", F.lit(0).alias("kind"), "stack")).withColumn("held", F.when(F.col("kind") == 0, F.struct("group", "stack")))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = events.drop("stack").repartitionByRange(n, "group", "key").withColumn("part", F.spark_partition_id())
    events = staged(events, "url-sweep")  # one fixed split into ranges, whatever is run again later
    last = events.filter("kind = 0").groupBy("part").agg(F.max_by("held", F.struct("group", "key")).alias("last"))
    parts = events.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = parts.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("group", "key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("open", F.last("held", ignorenulls=True).over(sweep)).filter("kind = 1")
    found = found.join(F.broadcast(carried), "part", "left").withColumn("open", F.coalesce("open", "carried"))  # as many rows as range partitions
    within = F.when(F.col("open.group") == F.col("group"), F.filter("open.stack", lambda r: F.col("key").startswith(r["key"])))
    return found.select("group", "key", within.alias("stack")).filter(F.size("stack") > 0)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict added (columns of these names are replaced; all others stay, whatever their names).

    `rules`: host, path, action.  A rule fits its host and all subdomains when the url's path starts
    with the rule's path; the longest `host || path` wins, then the longer host.  A url without a fitting rule,
    null and malformed ones included, gets rule null and the default verdict.  Hosts and paths of any length are compared whole.  Repeated
    rows are all judged.  Of rules with equal host and path, `block` wins; rules without a host are ignored.  An empty rule table or page
    table is fine.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").filter("host is not null and host <> ''")
    rules = staged(rules.groupBy("host", "path").agg(F.max("action").alias("action")).select("host", host_key(F.col("host")).alias("group"), F.col("path").alias("key"), "action"), "url-rules")
    out = ("host", "path", "rule", "verdict")
    urls = pages.drop(*(c for c in out if c in pages.columns)).withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    # Hosts: all in one group; the action of a rule host is its name.
    hosts = rules.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("host").alias("action")).distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    over = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    seen = urls.select("host").distinct()
    held = swept(seen.select(F.lit("").alias("group"), host_key(F.col("host")).alias("key")), stacks(hosts, over)).select("key", F.explode("stack").alias("by")).select("key", F.col("by.key").alias("group"), F.col("by.action").alias("rule_host"))
    pairs = urls.select("host", "path").distinct().withColumn("key", host_key(F.col("host"))).join(held, "key")
    pairs = staged(pairs.select("host", "path", "group", "rule_host"), "url-pairs")
    # Paths: a group for each rule host.
    begins = F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring("key", F.lit(1), n))
    fits = swept(pairs.select("group", F.col("path").alias("key")).distinct(), stacks(rules.select("group", "key", "action"), begins))
    fits = fits.select("group", F.col("key").alias("path"), F.element_at("stack", -1).alias("by"))
    rule = F.concat("rule_host", "by.key")
    best = pairs.join(fits, ["group", "path"]).groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), F.col("by.action").alias("action"))).alias("best"))
    best = staged(best.select("host", "path", "best.rule", F.col("best.action").alias("verdict")), "url-best")
    joined = urls.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return joined.select(*(c for c in urls.columns if c not in out), *out)
