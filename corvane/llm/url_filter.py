"""URL rules by a sort-merge range join over reversed hosts.

A host becomes its labels from the last to the first, each followed by a dot
(``a.example.net`` to ``net.example.a.``). The key of a rule's host is then a prefix of the
keys of that host and all its subdomains, and these form one interval of the sorted keys.
Rule keys and distinct host keys are swept in order: a rule key opens with the stack of
rules it lies in, and a host takes over the stack of the last rule opened, less the rules
whose interval has closed. The path is matched on the host's stack, url by url.

The sweep is split by ranges of keys; a range begins with the stack the ranges before it
left open, which is one row for each range. Urls of one host are one row in the sweep,
however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import keep

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_key(host: Column) -> Column:
    """Labels from last to first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``(rule, verdict)`` rows of pairs ``(verdict, rule)``."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """``(key, stack)``: for each rule host the rules of that host and of all hosts above it.

    A host has few labels, so its stack is found by its own prefixes. The rows of one host
    with the same path are one rule; of two verdicts ``block`` stands.
    """
    cut = F.instr("rule", "/")
    host = F.translate(F.when(cut > 0, F.col("rule").substr(F.lit(1), cut - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    parsed = rules.filter(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).select(
        reversed_key(host).alias("key"), F.when(cut > 0, F.col("rule").substr(cut, F.length("rule"))).otherwise(F.lit("/")).alias("path"), "rule", "verdict")
    one = parsed.groupBy("key", "path").agg(F.max(F.struct("verdict", "rule")).alias("r"))
    entry = F.struct(F.length("r.rule").alias("size"), F.col("key").alias("host"), "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    own = one.select("key", entry.alias("entry"))
    dots = F.size(F.split("key", r"\.")) - 1
    prefix = F.expr("substring_index(key, '.', _i)")
    hosts = own.select("key").distinct().withColumn("_i", F.explode(F.sequence(F.lit(1), dots)))
    above = hosts.select("key", F.concat(prefix, F.lit(".")).alias("above"))
    return above.join(own.select(F.col("key").alias("above"), "entry"), "above").groupBy("key").agg(F.collect_list("entry").alias("stack"))


def swept(hosts: DataFrame, stacks: DataFrame) -> DataFrame:
    """``(key, stack)`` of distinct ``hosts (key)``: the rules whose interval holds the key."""
    kind = stacks.schema["stack"].dataType
    events = stacks.select("key", F.lit(0).alias("_kind"), "stack").unionByName(
        hosts.select("key", F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("stack")))
    ranges = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(events.repartitionByRange(ranges, "key", "_kind").withColumn("_range", F.spark_partition_id()), "url-events")
    # what is open where a range begins: one row for each range
    last = placed.groupBy("_range").agg(F.max_by("stack", F.when(F.col("_kind") == 0, F.col("key"))).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    border = last.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_open"))
    order = Window.partitionBy("_range").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("_kind = 1")
    opened = carried.join(F.broadcast(border), "_range").withColumn("stack", F.coalesce("stack", "_open"))
    return opened.select("key", F.filter("stack", lambda r: F.startswith(F.col("key"), r["host"])).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` of each ``url``.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the
    rule's; a rule without a slash fits every path that starts with one. The longest rule
    wins, then the deeper host. A url no rule fits has a null rule and the ``default`` verdict,
    as has a null url, one without ``://`` and, for rules of the whole host, one with an empty
    path. Rules that are null or have another verdict are no rules. Other columns are handed
    through, but for those with the names of the results, which are replaced; repeated rows
    give one result each.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    names = pages.columns
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("_key", reversed_key(F.col("host")))
    stacks = swept(rows.select(F.col("_key").alias("key")).distinct(), rule_stacks(rules)).filter(F.size("stack") > 0)
    found = rows.join(stacks.withColumnRenamed("key", "_key"), "_key", "left")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host"].alias("host"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = found.withColumn("_best", best)
    return judged.select(
        *names, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
