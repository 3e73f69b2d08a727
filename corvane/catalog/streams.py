"""Streams with state, timers, joins and byte offsets over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.registry import query, table
from corvane.catalog.stateful import BUDGET_SQL
from corvane.session import run_dir
from corvane.streaming import jobs, keyed, tail

QUARTERS = (0.25, 0.5, 0.75)
# a tail for each so many events, and how many run side by side at most
SHARE_EVENTS, TAIL_SHARES = 25_000, 8


def arrivals(spark, sf):
    """The events in four lots, each later than the one before, as they would arrive."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    cuts = e.agg(F.percentile_approx("ts", list(QUARTERS), 10_000)).first()[0] or []
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        yield e.filter((F.lit(True) if low is None else F.col("ts") > F.lit(low)) & (F.lit(True) if high is None else F.col("ts") <= F.lit(high)))


def run_lots(spark, sf, job, mode: str, last=None) -> str:
    """``job`` over a stream of the lots; it stops after each and goes on from its checkpoint. The table's path."""
    landing, out = run_dir(spark, "arrivals"), run_dir(spark, "stream-table")
    schema = "event_id bigint, user_id bigint, event_type string, ts timestamp"
    with keyed.state_store(spark):
        for lot in [*arrivals(spark, sf), *([last] if last is not None else [])]:
            lot.write.mode("append").parquet(landing)
            jobs.to_table(job(lambda: spark.readStream.schema(schema).parquet(landing)), mode, out)
    return out


@query("stream_budget_windows", BUDGET_SQL)
def q_budget(spark, sf):
    """Budget windows kept as value state, which timers give back once the window has passed."""
    path = run_lots(spark, sf, lambda events: keyed.budget_stream(events(), "user_id", "ts", limit=2, window=86400), "update")
    return jobs.latest_updates(spark, path, ["user_id", "window_start"])


@query("stream_expiring_guard", """
WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS s, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'ask' END AS ev,
   row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
g AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, false AS ex, 0::DOUBLE AS opened, 0 AS retries, false AS waiting, '' AS outcome FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id, ev <> 'succeeded' AND (ev = 'ask' OR live), CASE WHEN outcome = 'started' THEN s ELSE opened END,
    CASE WHEN ev = 'succeeded' OR NOT live THEN 0 WHEN ev = 'failed' THEN retries + 1 ELSE retries END,
    ev = 'ask' AND outcome <> 'ingest_retry_exhausted', outcome
  FROM (SELECT *, CASE WHEN ev = 'succeeded' THEN 'cleared' WHEN ev = 'failed' THEN CASE WHEN live THEN 'retry_counted' ELSE 'ignored' END
      WHEN live AND waiting THEN 'pending' WHEN live AND retries >= 3 THEN 'ingest_retry_exhausted' ELSE 'started' END AS outcome
    FROM (SELECT e.*, ex, opened, retries, waiting, ex AND s - opened <= 86400 AS live FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)))
SELECT user_id, event_id, outcome, retries FROM g WHERE n > 0""")
def q_guard(spark, sf):
    """The loop guard with entries that are forgotten for good after their time to live."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("ask")
    path = run_lots(spark, sf, lambda events: keyed.expiring_guard(events().withColumn("event", kind), "user_id", "event_id", "ts", "event", ttl=86400), "append")
    return spark.read.parquet(path).drop("batch")


@query("stream_settled_asks", """
WITH a AS (SELECT event_id AS ask_id, user_id, ts FROM events WHERE event_type NOT IN ('purchase', 'error')),
o AS (SELECT event_id AS outcome_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS outcome FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT ask_id, arg_min({'i': outcome_id, 'o': outcome}, {'t': o.ts, 'i': outcome_id}) AS first
  FROM a JOIN o ON a.user_id = o.user_id AND o.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS GROUP BY 1)
SELECT ask_id, CASE first.o WHEN 'succeeded' THEN 'retry_local' WHEN 'failed' THEN 'ingest_failed' ELSE 'pending' END AS status, first.i AS outcome_id
FROM a LEFT JOIN f USING (ask_id)""")
def q_settled(spark, sf):
    """Asks joined with the outcomes of their jobs as two streams; an ask whose time ran out is pending."""
    outcome = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed")

    def job(events):
        asks = events().filter(outcome.isNull()).select(F.col("user_id").alias("key"), F.col("event_id").alias("ask_id"), F.col("ts").alias("asked_at"))
        done = events().filter(outcome.isNotNull()).select(
            F.col("user_id").alias("key"), F.col("event_id").alias("outcome_id"), outcome.alias("outcome"), F.col("ts").alias("done_at"))
        return keyed.asks_with_outcomes(asks, done, "12 HOURS")

    # markers far behind the last event, one for each side, move the watermark past all of them
    late = table(spark, sf, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("ts")).filter("ts IS NOT NULL")
    marker = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("event_id"), F.lit(i).cast("bigint").alias("user_id"), F.lit(t).alias("event_type")) for i, t in ((-1, "view"), (-2, "purchase"))]))
    last = late.select("ts", marker.alias("m")).select("m.event_id", "m.user_id", "m.event_type", "ts")
    path = run_lots(spark, sf, job, "append", last)
    return keyed.settled(spark.read.parquet(path).filter("ask_id >= 0"))


@query("stream_capped_tail", """
SELECT event_id, user_id, event_type, 1 AS seen FROM events""")
def q_tail(spark, sf):
    """Events appended as JSON lines in three writes, tailed by byte offset, some thousand a batch; each write is a run."""
    folder, out = run_dir(spark, "tail-log"), run_dir(spark, "tail-table")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    shares = max(1, min(TAIL_SHARES, e.count() // SHARE_EVENTS))
    broken = e.filter("event_id % 90 = 0").select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "us')).alias("value"))
    blank = e.filter("event_id % 70 = 0").select(F.lit("").alias("value"))

    def into(share: int):
        return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/share={share}/batch={batch}")

    for rest in range(3):
        lot = e.filter(F.col("event_id") % 3 == rest).select(F.to_json(F.struct("*")).alias("value"))
        lot.unionByName(broken).unionByName(blank).repartition(max(2, shares), F.xxhash64("value")).write.mode("append").text(folder)
        tail.drain_all([
            (tail.tail_events(spark, folder, "event_id bigint, user_id bigint, event_type string", 4000, n, shares), into(n), f"{out}-checkpoint-{n}")
            for n in range(shares)])
    return spark.read.parquet(out).groupBy("event_id", "user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("seen"))
