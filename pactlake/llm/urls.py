r"""URL rules as a sort-merge range join, in DataFrame operations only.

A host is keyed by its labels in reverse, each followed by a dot, so a rule's host and all subdomains
are the keys with one prefix: an interval. Prefix intervals are nested or apart. In a sweep over the
sorted starts, ends and keys the number of open intervals is a running sum, and the innermost one is
the last start at that depth: slot `depth` of the stack of open rules. The same sweep then finds, below
each rule host that is open, the longest rule path that starts the url's path.

Sweeps run over distinct keys, so a hot host or url is one row, in ranges of keys that Spark balances;
what is open where a range begins comes from one small row for each range and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pactlake.llm.tables import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Above every byte of UTF-8.
_TOP = "FF"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; without :// or for null empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _labels_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def innermost(spark: SparkSession, points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, prefix): for each of the distinct strings `key` the longest `prefix` that starts it, of the
    distinct strings `prefix`, or null."""
    key = F.col("prefix").cast("binary")
    none = F.lit(None).cast("string")
    kinds = [
        points.select(F.col("key").cast("binary").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("opens"), none.alias("prefix")),
        prefixes.select(key.alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("opens"), "prefix"),
        prefixes.select(F.concat(key, F.unhex(F.lit(_TOP))).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("opens"), none.alias("prefix")),
    ]
    events = kinds[0].union(kinds[1]).union(kinds[2]).repartitionByRange("at", "kind")
    events = written(spark, "events", events.withColumn("range", F.spark_partition_id()))
    order = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    sums = events.groupBy("range").agg(F.sum("opens").alias("opened"))
    carried = sums.select("range", F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("open_before"))
    depths = events.join(carried, "range").withColumn("depth", F.col("open_before") + F.sum("opens").over(order))
    depths = depths.drop("open_before", "opens")
    slot = Window.partitionBy("range", "depth").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = depths.withColumn("top", F.last("prefix", ignorenulls=True).over(slot))
    # What a depth's slot holds where a range begins: the last start at that depth in earlier ranges.
    last = depths.where("kind = 1").groupBy("range", "depth").agg(F.max_by("prefix", "at").alias("held"))
    ranges = events.agg(F.max("range")).first()[0] or 0
    until = F.coalesce(F.lead("range").over(Window.partitionBy("depth").orderBy("range")), F.lit(ranges))
    slots = last.withColumn("until", until).where(F.col("until") > F.col("range"))
    slots = slots.select("depth", "held", F.explode(F.sequence(F.col("range") + 1, F.col("until"))).alias("range"))
    found = here.where("kind = 2").join(slots, ["range", "depth"], "left")
    top = F.when(F.col("depth") > 0, F.coalesce("top", "held"))
    return found.select(F.col("at").cast("string").alias("key"), top.alias("prefix"))


def judged(spark: SparkSession, pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: host, path, verdict. A rule fits its host and all subdomains where the url's path starts with
    the rule's; the longest (host and path together, then host) wins, and of rules alike the larger
    verdict, which is block. No rule: null and `otherwise`. Rules with a null host, path or verdict fit
    nothing. A null url has an empty host and path. Columns other than page_id and url are not
    looked at; rows listed more than once are judged as often.
    """
    lowered = F.translate("host", _UPPER, _UPPER.lower())
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy(lowered.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("host_key", _labels_key(F.col("host")))
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = written(spark, "urls", urls.select("host", "path").distinct())
    hosts = rules.select(F.col("host_key").alias("prefix")).distinct()
    keys = seen.select(_labels_key(F.col("host")).alias("key")).distinct()
    inner = innermost(spark, keys, hosts).where("prefix is not null")
    # The rule hosts that hold a rule host: at most as many as it has labels.
    part = F.split("prefix", r"\.")
    outer = F.transform(
        F.sequence(F.lit(1), F.size(part) - 1),
        lambda n: F.concat(F.array_join(F.slice(part, 1, n), "."), F.lit(".")),
    )
    chains = hosts.select("prefix", F.explode(outer).alias("host_key"))
    chains = chains.join(hosts.select(F.col("prefix").alias("host_key")), "host_key", "left_semi")
    open_hosts = inner.join(chains, "prefix").select("key", "host_key")
    found = seen.withColumn("key", _labels_key(F.col("host"))).join(open_hosts, "key")
    # A key below a rule host: its own key, a byte that no label has, and the path.
    below = F.concat_ws("/", "host_key", "path")
    found = written(spark, "open", found.select("host", "path", below.alias("key")))
    rules = rules.withColumn("prefix", below)
    fits = innermost(spark, found.select("key").distinct(), rules.select("prefix"))
    size = F.struct(F.length("rule").alias("long"), F.length("rule_host").alias("host_long"), "rule", "verdict")
    named = rules.select("prefix", F.concat("host", "path").alias("rule"), F.col("host").alias("rule_host"), "verdict")
    best = found.join(fits.join(named, "prefix"), "key").groupBy("host", "path").agg(F.max(size).alias("best"))
    best = written(spark, "verdicts", best.select("host", "path", "best.rule", "best.verdict"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )


def allowed(spark: SparkSession, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages, all their columns, whose url is not blocked."""
    found = judged(spark, pages.select("url").distinct().withColumn("page_id", F.col("url")), rules)
    blocked = written(spark, "blocked", found.where("verdict = 'block'").select(F.col("page_id").alias("url")))
    return pages.join(blocked, "url", "left_anti").select(*[f"`{c}`" for c in pages.columns])
