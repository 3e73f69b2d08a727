"""Mixing sources to target weights by Poisson replication.

A source with ``size`` characters and target share ``w`` of a mix of ``total`` characters
has the mean repetition rate ``w * total / size``. Each document takes a number of copies
from the Poisson distribution of that mean, by inverting it at a uniform number hashed from
seed and document; so any task, tried again, draws the same. A rate above ``STEP`` is the
sum of equal parts, each drawn with a hash of its own, which keeps the inversion exact
where ``exp(-rate)`` would vanish. Copies are dealt out by a hash of document and copy and
sorted by it within the partition: a global shuffle that moves the text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep

STEP = 16.0
SEED = 42
_TERMS = 96  # P(Poisson(16) > 96) is below 1e-40


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from 52 bits of the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None) -> DataFrame:
    """``(source_key, rate, parts, ladder)`` of each source; ``ladder`` is the cumulative distribution of a part."""
    sizes = docs.groupBy("_source").agg(F.sum("_size").alias("size"))
    if weights is None:
        share = F.lit(1.0)
    else:
        chosen = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        share = F.coalesce(F.create_map(*chosen)[F.col("_source")], F.lit(0.0)) if chosen else F.lit(0.0)
    shares = sizes.withColumn("share", F.when(F.col("size") > 0, F.greatest(share, F.lit(0.0))).otherwise(0.0))
    # one row
    sums = shares.agg(F.sum("share").alias("shares"), F.sum("size").alias("all"))
    aim = F.col("all").cast("double") if total is None else F.lit(float(total))
    rate = F.when((F.col("share") > 0) & (F.col("shares") > 0), F.col("share") / F.col("shares") * aim / F.col("size")).otherwise(0.0)
    rated = shares.crossJoin(F.broadcast(sums)).select("_source", rate.alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    climb = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("ladder")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"), (acc["sum"] + acc["p"] * mean / k).alias("sum"),
            F.concat(acc["ladder"], F.array(acc["sum"] + acc["p"] * mean / k)).alias("ladder")),
        lambda acc: acc["ladder"])
    return rated.withColumn("parts", parts).withColumn("ladder", climb)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs (doc_id, text, source)`` replicated by source, with ``copy`` (from 1), ``rate`` and ``shuffle_key``.

    ``weights`` are shares by source, 1 each if not given; a source it does not name has none.
    ``total`` is the expected number of characters, that of ``docs`` if not given. A null source
    is the source ''; null and empty texts weigh nothing but are replicated with their source,
    and a source that weighs nothing is left out. Rows that repeat an id draw the same number.
    Other columns are handed through, but for those with the names of the results, which are
    replaced; an empty table gives no rows.
    """
    docs = docs.drop("copy", "rate", "shuffle_key")
    names = docs.columns
    known = docs.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("_size", F.coalesce(F.char_length("text"), F.lit(0)))
    met = known.join(F.broadcast(bounded(keep(rates(known.select("_source", "_size"), weights, total), "rates"))), "_source")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(seed), F.col("doc_id"), j))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("ladder", lambda c: c <= u)))
    counted = met.withColumn("_n", copies).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.lit("place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    placed = counted.withColumn("shuffle_key", key)
    return placed.select(*names, "copy", "rate", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def bounded(per_source: DataFrame, limit: int = 10_000) -> DataFrame:
    """The table of sources, if it has at most ``limit`` rows; else an error, not a large broadcast."""
    if per_source.count() > limit:
        raise ValueError(f"more than {limit} sources to weigh")
    return per_source
