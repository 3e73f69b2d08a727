"""Exact deduplication with keyed streaming state.

Arrivals are skinny rows: digest of the normalised text, length, stable identifier and
where the content lies. A streaming aggregation keyed by digest, without watermark and so
without expiry, keeps in RocksDB for each digest the arrival to keep and how many there
were; partial aggregation sends one row for each task and digest, however hot the digest.
The state is read back with the state reader. Every hit is then checked on full bytes:
the texts of repeated digests meet the kept text in salted groups, and texts that share
only the digest become groups of their own.

``keep_state`` goes on with the state it finds below its checkpoint; ``exact_duplicates``
judges one whole table and so starts with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, fresh_path, keep

HOT_ROWS = 500
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no space reserved ahead for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def arrivals(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """``(digest, shorter, doc_id, place)``: what the state needs of a document.

    ``shorter`` is minus the code points, so that the smallest row is the one to keep;
    ``place`` is the file that holds the content.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.sha2(normalised(F.col("text")), 256).substr(1, digest_chars).alias("digest"),
        (-F.char_length(text)).cast("bigint").alias("shorter"), "doc_id", F.input_file_name().alias("place"))


def keep_state(arrived: DataFrame, checkpoint: str) -> None:
    """Fold a stream of arrivals into the state below ``checkpoint``; returns when all is worked off."""
    first = F.min(F.struct("shorter", F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    kept = arrived.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(digest, keep_id, keep_length, keep_place, n)`` of every digest in the state."""
    state = spark.read.format("statestore").load(checkpoint)
    first, n = (F.col(f"value.`{f.name}`") for f in state.schema["value"].dataType.fields)
    return state.select(
        F.col("key.digest").alias("digest"), first["doc_id"].alias("keep_id"), (-first["shorter"]).alias("keep_length"),
        first["place"].alias("keep_place"), n.alias("n"))


def state_of(arrived: DataFrame, checkpoint: str) -> DataFrame:
    """State after the batch of ``arrived`` rows, which pass through the stream from a table."""
    spark = arrived.sparkSession
    landed = fresh_path(spark, "arrivals")
    arrived.write.parquet(landed)
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        keep_state(spark.readStream.schema(arrived.schema).parquet(landed), checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_state(spark, checkpoint)


def exact_duplicates(docs: DataFrame, carry: list[str] | None = None, digest_chars: int = 64, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The columns ``carry`` of every row, with ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are without white space; null counts as empty, and empty texts
    equal one another. Of a group the row with the most code points, then the smallest
    ``doc_id`` stays; a null id comes last. Of rows that repeat the id and length of the row
    that stays one is kept. ``carry`` is all columns unless given; columns with the names of
    the results are replaced. ``digest_chars`` cuts the digest (tests use it to force
    collisions). An empty table gives no rows.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    names = [c for c in (docs.columns if carry is None else carry) if c not in results]
    own = [F.col(f"_own.{c}").alias(c) for c in names]
    state = state_of(arrivals(docs, digest_chars), fresh_path(docs.sparkSession, "dedup-state"))
    sha = F.sha2(normalised(F.col("text")), 256)
    beside = [] if "text" in names else ["text"]
    rows = docs.select(F.struct(*names).alias("_own"), "doc_id", *beside, sha.alias("_sha"), sha.substr(1, digest_chars).alias("digest"))
    text = F.coalesce(F.col("text" if beside else "_own.text"), F.lit(""))
    met = rows.join(state, "digest")
    # the text goes no further than the rows that have a partner
    checked = keep(met.select(
        "_own", "doc_id", "_sha", "digest", "keep_id", "keep_length", "n", F.char_length(text).alias("_length"),
        F.when(F.col("n") > 1, normalised(text)).alias("_norm"), F.monotonically_increasing_id().alias("_row")), "dedup-hits")
    hits = checked.filter(F.col("n") > 1)
    standing = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("keep_length"))
    salts = F.ceil(F.col("n") / hot_rows).cast("int")
    chosen = hits.filter(standing).groupBy("digest").agg(F.min_by(F.struct(F.col("_row").alias("keep_row"), F.col("_norm").alias("keep_norm"), salts.alias("salts")), "_row").alias("_k"))
    chosen = chosen.select("digest", "_k.keep_row", "_k.keep_norm", F.explode(F.sequence(F.lit(0), F.col("_k.salts") - 1)).alias("_salt"))
    compared = hits.withColumn("_salt", F.pmod(F.xxhash64("_row"), salts).cast("int")).join(chosen, ["digest", "_salt"], "left")
    judged = compared.withColumn("_same", F.coalesce(F.col("_norm") == F.col("keep_norm"), F.lit(False)))
    result = lambda keep_id, size, kept: [*own, keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256")]
    alone = checked.filter(F.col("n") == 1).select(*result(F.col("keep_id"), F.lit(1).cast("bigint"), F.lit(True)))
    # texts that share only the digest: how many a state row counted wrongly, and groups of their own
    apart = judged.filter(~F.col("_same"))
    lost = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("_lost"), F.max(salts).alias("_salts"))
    lost = lost.select("digest", "_lost", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    hit = judged.filter("_same").join(lost, ["digest", "_salt"], "left").select(
        *result(F.col("keep_id"), F.col("n") - F.coalesce("_lost", F.lit(0)), F.col("_row") == F.col("keep_row")))
    first = F.min(F.struct((-F.col("_length")).alias("l"), F.col("doc_id").isNull().alias("x"), "doc_id", "_row"))
    best = apart.groupBy("digest", "_norm").agg(first.alias("_b"), F.count(F.lit(1)).alias("_size"))
    other = apart.join(best, ["digest", "_norm"]).select(*result(F.col("_b.doc_id"), F.col("_size"), F.col("_row") == F.col("_b._row")))
    return alone.unionByName(hit).unionByName(other)
