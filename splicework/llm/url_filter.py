"""URL rules by a sort-merge range join, in DataFrame functions only.

A host is keyed by its labels in reverse, each followed by a dot
(``www.example.com`` is ``com.example.www.``). A rule's host and all its
subdomains are then one interval of keys, intervals nest or are disjoint, and a
sweep over sorted keys needs only the rules that are active: the stack. Each
interval's start carries the stack from there on (its own rules on top of those of
the enclosing hosts), its end the stack without them. Distinct hosts are merged
with these boundaries in key order; a host takes the stack of the last boundary
before it. Pages join their host's stack, and the longest rule whose path starts
the page's path wins.

Defined cases: a null url, or one without ``://``, has empty host and path and
matches no rule; repeated urls are judged alike; without rules every url gets the
default verdict; of equal rules the blocking one wins; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

DEFAULT_VERDICT = "allow"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(at, stack): from key ``at`` on, the rules in ``stack`` are active. ``rules``
    has host, path and verdict."""
    by_host = rules.groupBy("host").agg(F.array_sort(F.collect_set(F.struct("path", "verdict"))).alias("own"))
    labels = F.split(F.col("host"), r"\.", -1)
    up = by_host.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "parent"))
    active = up.join(by_host.select(F.col("host").alias("parent"), "own"), "parent")
    flat = lambda keep: F.flatten(F.collect_list(F.when(keep, F.transform("own", lambda r: F.struct(F.col("parent").alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"))))))
    nested = active.groupBy("host").agg(flat(F.lit(True)).alias("inside"), flat(F.col("up") > 0).alias("outside"))
    key = host_key(F.col("host"))
    # '/' follows '.', so this is the first key after all that start with the host's key.
    after = F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/"))
    keyed = nested.withColumn("k", key)
    return keyed.select(F.col("k").alias("at"), F.col("inside").alias("stack")).unionAll(keyed.select(after.alias("at"), F.col("outside").alias("stack")))


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, stack: the sweep. ``hosts`` holds distinct hosts.

    Hosts and boundaries are range-partitioned by key; each part is swept by a
    window, and starts with the stack of the last boundary in the parts before it.
    """
    bounds = _boundaries(rules)
    events = hosts.select(host_key(F.col("host")).alias("at"), "host", F.lit(None).cast(bounds.schema["stack"].dataType).alias("stack"), F.lit(1).alias("kind")).unionAll(
        bounds.select("at", F.lit(None).cast("string").alias("host"), "stack", F.lit(0).alias("kind"))
    )
    parts = stash(events.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "urlsweep")
    last = parts.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("at"))).alias("top"))
    carried = last.select("part", F.last("top", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = parts.withColumn("seen", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    return swept.join(carried, "part").select("host", F.coalesce("seen", "carried").alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """id, host, path, rule and verdict of every page."""
    url = F.col(url_col)
    split = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    stacks = active_rules(split.select("host").distinct(), rules)
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")))
    return (
        split.join(stacks, "host", "left")
        .withColumn("best", F.array_max(ranked))
        .select(F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
