"""Keyed state, site resolution and streaming over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import sqltext as S
from corvane.catalog.registry import query, table
from corvane.operators import chunking, state
from corvane.session import run_dir
from corvane.streaming import jobs

BUDGET_SQL = """
WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events),
w AS (SELECT user_id, min(s) AS window_start FROM e GROUP BY user_id
  UNION ALL SELECT user_id, nxt FROM (SELECT w.user_id, (SELECT min(e.s) FROM e WHERE e.user_id = w.user_id AND e.s > w.window_start + 86400) AS nxt FROM w) WHERE nxt IS NOT NULL),
j AS (SELECT e.user_id, w.window_start, count(*) AS n FROM e JOIN w ON e.user_id = w.user_id AND e.s BETWEEN w.window_start AND w.window_start + 86400 GROUP BY ALL)
SELECT user_id, window_start, n AS requests, least(n, 2) AS allowed, n - least(n, 2) AS denied FROM j"""


@query("budget_windows", BUDGET_SQL)
def q_budget(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return state.budget_windows(e, "user_id", "second", limit=2, window=86400)


def guard_events(spark, sf):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("ask")
    return table(spark, sf, "events").select(
        "user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("second"), kind.alias("event"))


GUARD_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS s, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'ask' END AS ev,
   row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS event_id, false AS ex, 0::DOUBLE AS opened, 0 AS retries, false AS waiting, '' AS outcome FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id, ev <> 'succeeded' AND (ev = 'ask' OR ex), CASE WHEN outcome = 'started' THEN s ELSE opened END,
    CASE WHEN ev = 'succeeded' THEN 0 WHEN ev = 'failed' THEN CASE WHEN ex THEN retries + 1 ELSE 0 END WHEN live THEN retries ELSE 0 END,
    ev = 'ask' AND outcome <> 'ingest_retry_exhausted', outcome
  FROM (SELECT *, CASE WHEN ev = 'succeeded' THEN 'cleared' WHEN ev = 'failed' THEN CASE WHEN ex THEN 'retry_counted' ELSE 'ignored' END
      WHEN live AND waiting THEN 'pending' WHEN live AND retries >= 3 THEN 'ingest_retry_exhausted' ELSE 'started' END AS outcome
    FROM (SELECT e.*, ex, opened, retries, waiting, ex AND s - opened <= 86400 AS live FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1)))
SELECT user_id, event_id, outcome, retries FROM g WHERE n > 0"""


@query("loop_guard", GUARD_SQL)
def q_guard(spark, sf):
    return state.loop_guard(guard_events(spark, sf), "user_id", "event_id", "second", "event", ttl=86400)


@query("answer_statuses", """
SELECT event_id, CASE WHEN value > 90 THEN 'ok' WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'error' THEN 'ingest_failed' WHEN event_id % 11 = 0 THEN 'ok'
  WHEN event_id % 13 = 0 THEN 'index_not_ready' WHEN event_id % 5 = 0 THEN 'web_search_budget_exhausted' WHEN event_id % 7 >= 3 THEN 'ingest_retry_exhausted'
  WHEN event_id % 17 = 0 THEN 'web_search_unavailable' WHEN user_id % 4 = 0 THEN 'no_confident_answer' WHEN user_id % 6 = 1 THEN 'ingest_launch_failed' ELSE 'ok' END AS status FROM events""")
def q_answers(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    rows = e.select(
        "event_id", (F.col("value") > 90).alias("confident"),
        F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").alias("job_state"),
        (i % 11 == 0).alias("guard_pending"), (i % 13 != 0).alias("index_ready"), (i % 5 != 0).alias("budget_left"),
        (i % 7).cast("int").alias("retries"), F.when(i % 17 != 0, "ok").alias("search_status"),
        F.when(F.col("user_id") % 4 == 0, 0).otherwise(1).alias("accepted"), (F.col("user_id") % 6 != 1).alias("launched"))
    return state.answer_status(rows).select("event_id", "status")


@query("query_keys", f"SELECT conv_id, turn, sha256(lower({S.squash('text')})) AS query_key FROM conversations")
def q_keys(spark, sf):
    return table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", state.query_key(F.col("text")).alias("query_key"))


@query("refresh_groups", """
SELECT page_id, array_to_string(list_concat(CASE WHEN contains(lower(url), 'course') THEN ['/catalog', '/course', '/program'] ELSE [] END,
  CASE WHEN p <> '' THEN ['/' || p] ELSE [] END), ',') AS areas
FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/'), lambda s: s <> '')[1:2], '/') AS p FROM pages)""")
def q_refresh(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").select(
        "page_id", F.array_join(state.refresh_groups(F.col("url"), F.array("url")), ",").alias("areas"))


@query("site_resolution", r"""
WITH s AS (SELECT DISTINCT source || '.example.org' AS site_id, source AS name FROM documents),
tok AS (SELECT site_id, unnest([replace(site_id, '.', '_'), name]) AS t FROM s),
r AS (SELECT doc_id AS rid, CASE WHEN doc_id % 3 = 0 THEN source || '.example.org' WHEN doc_id % 29 = 1 THEN 'nowhere' ELSE '' END AS site_id,
   CASE WHEN doc_id % 2 = 0 THEN 'the ' || source || ' site' WHEN doc_id % 31 = 1 THEN 'src1' WHEN doc_id % 37 = 1 THEN '' ELSE lang END AS hint FROM documents),
h AS (SELECT *, trim(regexp_replace(lower(hint), '[^a-z0-9]+', '_', 'g'), '_') AS hs FROM r),
m AS (SELECT rid, count(DISTINCT tok.site_id) AS n, min(tok.site_id) AS match FROM h JOIN tok ON contains(hs, t) OR contains(t, hs) WHERE h.site_id = '' AND hs <> '' GROUP BY rid)
SELECT h.rid, CASE WHEN h.site_id <> '' THEN s.site_id WHEN hs <> '' AND n = 1 THEN match END AS resolved,
 CASE WHEN h.site_id <> '' THEN CASE WHEN s.site_id IS NULL THEN 'site_not_found' ELSE '' END
  WHEN hs <> '' THEN CASE WHEN n = 1 THEN '' WHEN n > 1 THEN 'ambiguous_university' ELSE 'site_not_found' END ELSE 'site_required' END AS error
FROM h LEFT JOIN s USING (site_id) LEFT JOIN m ON m.rid = h.rid""")
def q_sites(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    k = F.col("doc_id")
    host = F.concat("source", F.lit(".example.org"))
    sites = d.select(host.alias("site_id"), F.col("source").alias("name"), host.alias("domain"), F.lit(True).alias("enabled")).distinct()
    asked = d.select(
        k.alias("rid"), F.when(k % 3 == 0, host).when(k % 29 == 1, "nowhere").otherwise("").alias("site_id"),
        F.when(k % 2 == 0, F.concat(F.lit("the "), "source", F.lit(" site"))).when(k % 31 == 1, "src1").when(k % 37 == 1, "").otherwise(F.col("lang")).alias("hint"))
    return state.resolve_sites(asked, sites)


@query("stream_minute_counts", """
SELECT date_trunc('minute', ts)::TIMESTAMP AS bucket, event_type AS operation, count(*) AS calls FROM events GROUP BY ALL""")
def q_stream_minutes(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = jobs.read_stream(spark, sf, schema, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"))
    path = jobs.to_table(jobs.minute_counts(stream), "update")
    return jobs.latest_updates(spark, path, ["bucket", "operation"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_index_upkeep", f"""
WITH last AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3),
{S.chunk_ctes('last')} SELECT doc_id, chunk_index::INTEGER AS chunk_index, sha256(text) AS checksum FROM chunks""")
def q_stream_index(spark, sf):
    """Two runs: some documents come only with the second, which also shortens and removes others."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    landing, root = run_dir(spark, "landing"), run_dir(spark, "stream-index")
    index = jobs.IndexTable(spark, root, "doc_id bigint, chunk_index int, text string")

    def upkeep(df, batch_id):
        chunks = chunking.explode_chunks(df.filter("text IS NOT NULL")).select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text")
        index.replace(chunks, df, f"upkeep{batch_id}")

    k = F.col("doc_id")
    late, shorter, gone = k % 7 == 1, k % 5 == 2, k % 11 == 3
    cut = F.when(gone, None).when(shorter, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text")).alias("text")
    for change in (docs.filter(~late), docs.filter(late | shorter | gone).select("doc_id", cut)):
        change.write.mode("append").parquet(landing)
        jobs.run_available(jobs.read_stream(spark, landing, docs.schema), upkeep, checkpoint=f"{root}-checkpoint")
    return index.read().select("doc_id", "chunk_index", F.sha2("text", 256).alias("checksum"))


@query("stream_loop_guard", GUARD_SQL)
def q_stream_guard(spark, sf):
    schema = table(spark, sf, "events").schema
    e = jobs.read_stream(spark, sf, schema, "events.parquet")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("ask")
    rows = e.select(
        "user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("second"), kind.alias("event"))
    path = jobs.to_table(jobs.guard_stream(rows, "user_id", "event_id", "second", "event", ttl=86400))
    return spark.read.parquet(path).drop("batch")


@query("stream_event_tail", "SELECT event_id, user_id, event_type FROM events")
def q_stream_tail(spark, sf):
    schema = table(spark, sf, "events").schema
    tail = jobs.read_stream(spark, sf, schema, "events.parquet", 1).select("event_id", "user_id", "event_type")
    return spark.read.parquet(jobs.to_table(tail)).drop("batch")


@query("changed_snapshots", """
SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def q_changed(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("digest"))
    return jobs.changed_digests(rows, "user_id", "event_id").select("event_id", "user_id")
