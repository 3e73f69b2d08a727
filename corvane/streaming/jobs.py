"""Structured Streaming forms: event tail, minute counts, index upkeep, loop guard."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators import ordered
from corvane.operators.relational import latest_per_key, union_all
from corvane.operators.state import GUARD_TTL, Guard, guard_step
from corvane.session import exists, run_dir


def read_stream(spark: SparkSession, folder: str, schema, files: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; ``per_trigger`` bounds one poll."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def tail_json(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New JSON lines of a folder; lines that are no objects are skipped.

    The checkpoint of the query takes the place of a byte offset.
    """
    rows = (
        spark.readStream.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", per_trigger).json(folder)
    )
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def run_available(stream: DataFrame, each_batch, mode: str = "append", checkpoint: str | None = None) -> None:
    """Work off what is there through ``each_batch(df, batch_id)``, then stop.

    With the same ``checkpoint`` a later run goes on where this one ended; without one it
    starts from the beginning in a folder of its own.
    """
    place = checkpoint or run_dir(stream.sparkSession, "stream-checkpoint")
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", place)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def to_table(stream: DataFrame, mode: str = "append", table: str | None = None) -> str:
    """Write every batch below its own ``batch`` folder and return the table path.

    A batch that is tried again overwrites its own folder, so nothing is doubled. A named
    ``table`` keeps its checkpoint beside it, so a later run adds what is new. A stream
    without a batch leaves an empty table.
    """
    spark, schema = stream.sparkSession, stream.schema
    named = table is not None
    table = table or run_dir(spark, "stream-table")

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(table, f"batch={batch_id}"))

    run_available(stream, write, mode, f"{table}-checkpoint" if named else None)
    if not exists(spark, table):
        spark.createDataFrame([], schema).write.parquet(os.path.join(table, "batch=-1"))
    return table


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row of each key of a table written in update mode."""
    return latest_per_key(spark.read.parquet(path), keys, "batch").drop("batch")


def minute_counts(events: DataFrame, ts: str = "ts", label: str = "operation") -> DataFrame:
    """Calls per minute and label; run in update mode, so late events still count."""
    return events.groupBy(F.date_trunc("minute", ts).alias("bucket"), label).agg(F.count(F.lit(1)).alias("calls"))


def minute_counts_bounded(events: DataFrame, late: str = "10 minutes", ts: str = "ts", label: str = "operation") -> DataFrame:
    """The same with a watermark: state is dropped ``late`` after its minute."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), label).agg(
        F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("bucket"), label, "calls")


class IndexTable:
    """Log of index rows by document; the newest version of a document is what counts.

    A batch writes one version with the rows of the documents it touches and a marker for
    each of them, so a shortened document loses its last rows and a removed one all of them;
    documents it does not touch are not written again. Versions are numbered on from what is
    committed. The token of a batch tells a retry, which overwrites its own version. After
    ``most_open`` versions a base version with all live rows is written, and reads begin there.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "doc_id", most_open: int = 16) -> None:
        self.spark, self.root, self.schema, self.key, self.most_open = spark, root, schema, key, most_open

    BASE = "base"

    def versions(self) -> list[tuple[int, str]]:
        """Committed ``(version, token)`` in order."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
        done = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        parts = [p.getName().removeprefix("version=").split("-", 1) for p in done]
        return sorted((int(number), token) for number, token in parts)

    def _path(self, version: int, token: str) -> str:
        return os.path.join(self.root, f"version={version}-{token}")

    def open_versions(self) -> list[tuple[int, str]]:
        """The last base and the versions after it: what a read touches."""
        done = self.versions()
        bases = [i for i, (_, token) in enumerate(done) if token == self.BASE]
        return done[bases[-1]:] if bases else done

    def compact(self) -> None:
        """Write all live rows as a base; the versions before it are read no more."""
        done = self.versions()
        if done and done[-1][1] != self.BASE:
            rows = self.read()
            rows.select(F.col(self.key).alias("_key"), F.struct(*rows.columns).alias("_row")).write.mode("overwrite").parquet(self._path(done[-1][0] + 1, self.BASE))

    def read(self) -> DataFrame:
        """Rows of every document's newest version."""
        empty = self.spark.createDataFrame([], self.schema)
        kept = f"_key {empty.schema[self.key].dataType.simpleString()}, _row struct<{self.schema}>"
        logs = [self.spark.read.schema(kept).parquet(self._path(v, t)).withColumn("_version", F.lit(v)) for v, t in self.open_versions()]
        if not logs:
            return empty
        log = union_all(logs)
        newest = log.groupBy("_key").agg(F.max("_version").alias("_version"))
        return log.join(newest, ["_key", "_version"]).filter("_row IS NOT NULL").select("_row.*")

    def replace(self, rows: DataFrame, touched: DataFrame, token: str) -> None:
        """Documents of ``touched (key)`` now have ``rows``, which may be none."""
        done = self.versions()
        known = [v for v, t in done if t == token]
        version = known[0] if known else (done[-1][0] + 1 if done else 0)
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        kept = rows.select(F.col(self.key).alias("_key"), F.struct(*columns).alias("_row"))
        markers = touched.select(F.col(self.key).alias("_key")).distinct().withColumn("_row", F.lit(None).cast(kept.schema["_row"].dataType))
        kept.unionByName(markers).write.mode("overwrite").parquet(self._path(version, token))
        if not known and len(self.open_versions()) > self.most_open:
            self.compact()


def changed_digests(snapshots: DataFrame, key: str, seq: str) -> DataFrame:
    """Snapshots ``(key, seq, digest)`` that differ from the one before."""
    rows = ordered.with_previous(ordered.ranged(snapshots, key, seq), key, seq, "digest", "_before_digest")
    return rows.filter(F.col("_before_digest").isNull() | (F.col("_before_digest") != F.col("digest"))).drop("_before_digest", "_range")


def guard_stream(events: DataFrame, key: str, seq: str, second: str, event: str, ttl: int = GUARD_TTL) -> DataFrame:
    """Loop guard on a stream: one state per question, one outcome per event."""
    kind = events.schema[key].dataType.simpleString()
    order = events.schema[seq].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # one trigger's rows of one question, put in order; the trigger bounds their number
        rows = pd.concat(list(batches)).sort_values(seq)
        guard = Guard(*state.get) if state.exists else None
        outcomes, retries = [], []
        for at, what in zip(rows[second].tolist(), rows[event].tolist()):
            guard, outcome = guard_step(guard, what, at, ttl)
            outcomes.append(outcome)
            retries.append(guard.retries if guard else 0)
        yield pd.DataFrame({key: k[0], seq: rows[seq], "outcome": outcomes, "retries": retries})
        if guard is None:
            state.remove()
        else:
            state.update((guard.opened, guard.retries, guard.waiting))

    return events.select(key, seq, second, event).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {seq} {order}, outcome string, retries int",
        "opened double, retries int, waiting boolean", "append", GroupStateTimeout.NoTimeout)
