"""Keyed helpers shared by the operators: latest row, top-k, skew-safe look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_ROWS = 1_000_000
SALTS = 64  # of a top-k round
DEAL_BYTES = 64 * 1024 * 1024
SMALL_BYTES = 4 * 1024 * 1024


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether the planner's size estimate of ``df`` lies within ``limit`` bytes.

    No job runs: the estimate comes from file sizes and plan statistics.
    """
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def deal_out(df: DataFrame) -> DataFrame:
    """Spread a scan of at most ``DEAL_BYTES`` that has fewer splits than there are cores.

    A small file in one row group would be one task. Anything larger keeps its splits,
    whatever the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = is_small(df, DEAL_BYTES) and df._jdf.rdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, with a 1-based rank.

    The ``row_number() <= k`` filter directly over the window lets the optimizer
    keep only ``k`` rows per group and map task before the shuffle, so a hot
    group sends ``k`` times tasks rows, never itself. The optimizer does so up to
    ``windowGroupLimitThreshold``; for larger ``k`` a salted round does the same.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > limit:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(SALTS))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(first))
            .filter(F.col("_rn") <= k)
            .drop("_salt", "_rn")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key; order-safe, unlike ``dropDuplicates``."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last row wins: the newest row of each key by ``seq``."""
    return first_per_key(df, keys, [F.col(seq).desc()])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``current`` with the same key.

    Within either side the row with the larger ``seq`` wins.
    """
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return first_per_key(both, keys, [F.col("_side").desc(), F.col(seq).desc()]).drop("_side")


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    weight: str,
    how: str = "left",
    hot_rows: int | None = None,
    spread: list[str] | None = None,
    join_hint: str | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim`` where a few keys may own a large share of ``fact``.

    ``dim`` carries in ``weight`` how many fact rows each key has. Keys at or over
    ``hot_rows`` are salted by their weight, one salt for each ``hot_rows`` of it: their fact
    rows are spread so far and only their dim rows are repeated. There are at most ``rows / hot_rows`` such keys,
    which bounds the list of hot keys; the planner broadcasts it by its size.
    ``weight`` is dropped. ``join_hint`` is Spark's hint for the join to ``dim``.
    """
    hot_rows = hot_rows or HOT_ROWS
    salts = F.ceil(F.col(weight) / hot_rows).cast("int")
    hot = dim.filter(F.col(weight) >= hot_rows).groupBy(*keys).agg(F.max(salts).alias("_hot"))
    spread_by = spread or [c for c in fact.columns if c not in keys] or keys
    tagged = fact.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.col("_hot")).cast("int"))
        .otherwise(0),
    ).drop("_hot")
    copies = F.when(F.col(weight) >= hot_rows, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    spread_dim = dim.withColumn("_salt", F.explode(copies)).drop(weight)
    if join_hint:
        spread_dim = spread_dim.hint(join_hint)
    return tagged.join(spread_dim, [*keys, "_salt"], how).drop("_salt")


def seen_before(df: DataFrame, keys: list[str], pos: str, flag: str = "seen_before") -> DataFrame:
    """True for every row that is not the first of its key in ``pos`` order.

    The first position is aggregated map-side and joined back, so no task ever
    holds all copies of one key, as a window over the key would.
    """
    firsts = df.groupBy(*keys).agg(F.min(pos).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (
        lookup(df, firsts, keys, "_n", spread=[pos])
        .withColumn(flag, F.coalesce(F.col(pos) > F.col("_first"), F.lit(False)))
        .drop("_first")
    )


def breakdowns(df: DataFrame, keys: list[str], dims: list[str], value: Column, out: str) -> DataFrame:
    """Independent group-bys over several columns in one pass.

    Rows ``(keys, dimension, label, out)``: the input is scanned once and each row
    feeds one small struct per dimension into the same partial aggregation.
    """
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dims
    ])
    return (
        df.select(*keys, value.alias("_v"), F.explode(entries).alias("_e"))
        .groupBy(*keys, F.col("_e.dimension").alias("dimension"), F.col("_e.label").alias("label"))
        .agg(F.sum("_v").alias(out))
    )


def constants(spark, rows: list[tuple], names: str) -> DataFrame:
    """A table of constants as a local relation: known size, no Python rows."""
    def text(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{value!r}D" if isinstance(value, float) else repr(value)

    values = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
