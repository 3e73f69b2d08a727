"""Run metrics and call traces over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.registry import query, table
from corvane.operators import metrics

_MODELS = ("openai/gpt-4.1-mini", "openai/gpt-4.1", "unlisted", "google/gemini-2.5-flash")


def metric_events(spark, sf):
    """Events as metric events: a user is a run, an event type an operation."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    emb = kind == "signup"
    pick = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("user_id") % 4 + 1).cast("int"))
    whole = F.floor("value").cast("long")
    return e.select(
        (F.col("user_id") % 3).cast("string").alias("site_id"), F.col("user_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.when(emb, "embedding").otherwise("").alias("event_type"),
        F.when(kind == "view", "").otherwise("stage-1").alias("stage"), kind.alias("operation"),
        F.lit("main").alias("provider"), F.when(emb, "text-embedding-3-small").otherwise(pick).alias("model"),
        F.when(~emb & (kind != "error"), k).alias("prompt_tokens"),
        F.when(~emb & (kind != "error"), whole).alias("completion_tokens"),
        F.when(kind == "view", k + whole).alias("total_tokens"),
        F.when(emb & (k % 10 != 0), k * 10).alias("input_tokens"),
        F.when(~emb, whole).alias("latency_ms"), F.when(kind == "click", 1).alias("retry_count"),
        F.when(emb, 1).alias("document_count"), F.when(emb, k).alias("chunk_count"), F.when(emb, k).alias("vector_count"),
        F.lit(None).cast("long").alias("reused_vector_count"), F.lit(None).cast("long").alias("skipped_chunk_count"),
        F.lit(None).cast("long").alias("failed_chunk_count"), F.when(emb, whole).alias("duration_ms"),
        F.when(kind == "purchase", F.col("value") / 1000.0).alias("cost_usd"),
        F.when(kind == "purchase", "reported").alias("cost_source"),
    )


_CASE = "CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MODELS)) + " END"
_LLM = " ".join(f"WHEN '{m}' THEN prompt / 1000000.0::DOUBLE * {i}::DOUBLE + completion / 1000000.0::DOUBLE * {o}::DOUBLE" for m, i, o in metrics.TEXT_PRICES)
EVENTS = f"""
ev0 AS (SELECT *, (props->>'$.k')::BIGINT AS k, floor(value)::BIGINT AS whole, event_type = 'signup' AS emb FROM events),
ev AS (SELECT (user_id % 3)::VARCHAR AS site_id, user_id AS run_id, ts, event_type AS operation, emb, CASE WHEN emb THEN 'text-embedding-3-small' ELSE {_CASE} END AS model,
  CASE WHEN event_type = 'view' THEN 'unknown' ELSE 'stage-1' END AS stage,
  CASE WHEN NOT emb AND event_type <> 'error' THEN k END AS prompt, CASE WHEN NOT emb AND event_type <> 'error' THEN whole END AS completion,
  CASE WHEN event_type = 'view' THEN k + whole END AS total_tokens, CASE WHEN emb AND k % 10 <> 0 THEN k * 10 END AS input_tokens,
  CASE WHEN NOT emb THEN whole END AS latency_ms, CASE WHEN event_type = 'click' THEN 1 END AS retry, CASE WHEN emb THEN k END AS k_emb, CASE WHEN emb THEN whole END AS dur,
  CASE WHEN event_type = 'purchase' THEN value / 1000.0::DOUBLE END AS cost_usd FROM ev0),
costed AS (SELECT *, coalesce(total_tokens, prompt + completion) AS total,
  CASE WHEN cost_usd IS NOT NULL THEN cost_usd WHEN emb THEN CASE WHEN input_tokens > 0 THEN round(input_tokens / 1000000.0::DOUBLE * 0.02::DOUBLE, 8) END
   WHEN prompt > 0 OR completion > 0 THEN round(CASE model {_LLM} END, 8) END AS amount FROM ev),
costs AS (SELECT *, CASE WHEN cost_usd IS NOT NULL THEN 'reported' WHEN amount IS NOT NULL THEN 'estimated' ELSE 'unknown' END AS src FROM costed)"""


def _lattice(amount: str, src: str, of: str) -> str:
    known = f"count(*) FILTER ({of} AND {amount} IS NOT NULL)"
    miss = f"count(*) FILTER ({of} AND {amount} IS NULL)"
    one = f"min({src}) FILTER ({of} AND {amount} IS NOT NULL)"
    top = f"max({src}) FILTER ({of} AND {amount} IS NOT NULL)"
    return (
        f"CASE WHEN {known} = 0 THEN 'unknown' WHEN {miss} > 0 THEN 'partial' WHEN {one} = {top} AND {one} IN ('reported', 'estimated') THEN {one} ELSE 'mixed' END"
    )


_KNOWN = lambda c, of: f"CASE WHEN count(*) FILTER ({of}) = 0 THEN 0 ELSE sum({c}) FILTER ({of}) END::BIGINT"
RUNS = f"""
{EVENTS},
r0 AS (SELECT site_id, run_id, min(ts) AS started_at, max(ts) AS completed_at, count(*) AS event_count, count(*) FILTER (NOT emb) AS llm_requests,
  {_KNOWN('prompt', 'NOT emb')} AS prompt_tokens, {_KNOWN('completion', 'NOT emb')} AS completion_tokens, {_KNOWN('total', 'NOT emb')} AS llm_tokens,
  coalesce(sum(retry) FILTER (NOT emb), 0)::BIGINT AS retry_count, coalesce(sum(latency_ms) FILTER (NOT emb), 0)::BIGINT AS latency_ms,
  round(sum(amount) FILTER (NOT emb), 8) AS llm_cost, {_lattice('amount', 'src', 'NOT emb')} AS llm_cost_source,
  count(*) FILTER (emb) AS embedding_requests, {_KNOWN('input_tokens', 'emb')} AS embedding_tokens, count(*) FILTER (emb) AS document_count,
  coalesce(sum(k_emb) FILTER (emb), 0)::BIGINT AS chunk_count, coalesce(sum(dur) FILTER (emb), 0)::BIGINT AS embedding_duration_ms,
  round(sum(amount) FILTER (emb), 8) AS embedding_cost, {_lattice('amount', 'src', 'emb')} AS embedding_cost_source,
  bool_or(NOT emb AND total IS NULL) AS w1, bool_or(emb AND input_tokens IS NULL) AS w2, bool_or(amount IS NULL) AS w3 FROM costs GROUP BY ALL),
runs AS (SELECT *, CASE WHEN llm_tokens IS NOT NULL OR embedding_tokens IS NOT NULL THEN coalesce(llm_tokens, 0) + coalesce(embedding_tokens, 0) END AS total_model_tokens,
  CASE WHEN llm_cost IS NOT NULL OR embedding_cost IS NOT NULL THEN round(coalesce(llm_cost, 0) + coalesce(embedding_cost, 0), 8) END AS cost,
  CASE WHEN llm_cost IS NULL AND embedding_cost IS NULL THEN 'unknown' WHEN (llm_requests > 0 AND llm_cost IS NULL) OR (embedding_requests > 0 AND embedding_cost IS NULL) THEN 'partial'
   WHEN llm_cost IS NULL THEN CASE WHEN embedding_cost_source IN ('reported', 'estimated') THEN embedding_cost_source ELSE 'mixed' END
   WHEN embedding_cost IS NULL THEN CASE WHEN llm_cost_source IN ('reported', 'estimated') THEN llm_cost_source ELSE 'mixed' END
   WHEN llm_cost_source = embedding_cost_source AND llm_cost_source IN ('reported', 'estimated') THEN llm_cost_source ELSE 'mixed' END AS cost_source,
  concat_ws(',', CASE WHEN w2 THEN 'missing_embedding_tokens' END, CASE WHEN w1 THEN 'missing_llm_tokens' END, CASE WHEN w3 THEN 'unknown_cost' END) AS warnings,
  ((epoch_us(completed_at) - epoch_us(started_at)) // 1000)::BIGINT AS duration_ms FROM r0)"""
_RUN_COLUMNS = (
    "site_id", "run_id", "started_at", "completed_at", "event_count", "llm_requests", "prompt_tokens", "completion_tokens", "llm_tokens",
    "retry_count", "latency_ms", "llm_cost", "llm_cost_source", "embedding_requests", "embedding_tokens", "document_count", "chunk_count",
    "embedding_duration_ms", "embedding_cost", "embedding_cost_source", "total_model_tokens", "cost", "cost_source", "warnings", "duration_ms")


def _summaries(spark, sf):
    return metrics.run_summaries(metric_events(spark, sf), metrics.price_table(spark))


@query("run_summaries", f"WITH {RUNS} SELECT {', '.join(_RUN_COLUMNS)} FROM runs")
def q_runs(spark, sf):
    return _summaries(spark, sf).withColumn("warnings", F.array_join("warnings", ",")).withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "completed_at")}).select(*_RUN_COLUMNS)


@query("cost_by_run", f"WITH {RUNS} SELECT run_id, cost, cost_source, llm_cost_source, embedding_cost_source FROM runs")
def q_cost(spark, sf):
    return _summaries(spark, sf).select("run_id", "cost", "cost_source", "llm_cost_source", "embedding_cost_source")


@query("token_breakdowns", f"""
WITH {EVENTS}, b AS (SELECT run_id, unnest(['stage', 'provider', 'model', 'operation']) AS dimension, unnest([stage, 'main', model, operation]) AS label,
  coalesce(total_tokens, input_tokens, 0) AS t FROM ev)
SELECT run_id, dimension, label, sum(t)::BIGINT AS tokens FROM b GROUP BY ALL""")
def q_breakdowns(spark, sf):
    return metrics.token_breakdowns(metric_events(spark, sf), ("run_id",))


_STATUS = "CASE run_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'canceled' ELSE 'running' END"


@query("rollups", f"""
WITH {RUNS}, at_time AS (SELECT max(ts) - INTERVAL 5 MINUTE AS t FROM events),
w AS (SELECT unnest(['30d', '60d', '90d', '365d', 'all_time']) AS "window", unnest([30, 60, 90, 365, NULL]) AS days),
r AS (SELECT *, 'site' || (run_id // 25) AS own_site, {_STATUS} AS status FROM runs),
m AS (SELECT s.own_site AS the_site, w."window", r.* FROM (SELECT DISTINCT own_site FROM r) s CROSS JOIN w CROSS JOIN at_time LEFT JOIN r ON r.own_site = s.own_site
  AND (days IS NULL OR epoch_us(completed_at - to_days((run_id * 3)::INT)) >= (floor(epoch(t))::BIGINT - days * 86400) * 1000000))
SELECT the_site AS site_id, "window", count(run_id) AS run_count, count(*) FILTER (status = 'completed') AS successful_run_count, count(*) FILTER (status = 'failed') AS failed_run_count,
  count(*) FILTER (status = 'canceled') AS canceled_run_count, {_KNOWN('total_model_tokens', 'run_id IS NOT NULL')} AS total_tokens, {_KNOWN('llm_tokens', 'run_id IS NOT NULL')} AS llm_tokens,
  {_KNOWN('embedding_tokens', 'run_id IS NOT NULL')} AS embedding_tokens, round(sum(cost), 6) AS total_cost, {_lattice('cost', 'cost_source', 'run_id IS NOT NULL')} AS total_cost_source,
  coalesce(sum(duration_ms), 0)::BIGINT AS total_duration_ms, coalesce(floor(sum(duration_ms) / nullif(count(run_id), 0)), 0)::BIGINT AS average_duration_ms,
  coalesce(sum(document_count), 0)::BIGINT AS document_count, coalesce(sum(chunk_count), 0)::BIGINT AS chunk_count FROM m GROUP BY 1, 2""")
def q_rollups(spark, sf):
    k = F.col("run_id") % 4
    runs = _summaries(spark, sf).withColumn(
        "status", F.when(k == 0, "completed").when(k == 1, "failed").when(k == 2, "canceled").otherwise("running"))
    # the runs are dated back by their number, so that the windows differ and some sites have none in the near ones
    runs = runs.withColumn("started_at", F.col("completed_at") - F.make_dt_interval(days=(F.col("run_id") * 3).cast("int")))
    runs = runs.withColumn("site_id", F.concat(F.lit("site"), F.floor(F.col("run_id") / 25).cast("string")))
    as_of = table(spark, sf, "events").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 5 MINUTES")).alias("t")).first()["t"]
    out = metrics.rollups(runs, F.lit(as_of))
    return out.withColumn("total_cost", F.round("total_cost", 6)).drop("embedding_cost", "embedding_cost_source", "vector_count")


@query("run_list", f"WITH {RUNS} SELECT run_id, started_at FROM runs ORDER BY started_at DESC, run_id LIMIT 100")
def q_run_list(spark, sf):
    return metrics.run_list(_summaries(spark, sf)).select("run_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


def trace(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "ts", F.when(F.col("event_type") == "error", "other").otherwise("main").alias("provider"),
        F.col("event_type").alias("operation"), F.concat(F.lit("m"), F.col("user_id") % 7).alias("model"),
        F.when(F.col("event_id") % 9 == 0, "failed").otherwise("ok").alias("status"), (F.col("event_id") % 13 == 0).alias("is_summary"),
        k.alias("prompt_tokens"), F.floor("value").cast("long").alias("completion_tokens"), (k + F.floor("value").cast("long")).alias("total_tokens"),
        F.when(k % 5 != 0, F.col("value")).alias("latency_ms"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("double") / 8.0).alias("cost_usd"))


TRACE = """
tr AS (SELECT ts, event_type AS operation, 'm' || (user_id % 7) AS model, (props->>'$.k')::BIGINT AS k, floor(value)::BIGINT AS whole, value,
  CASE WHEN event_type = 'purchase' THEN floor(value) / 8.0::DOUBLE END AS cost FROM events WHERE event_type <> 'error' AND event_id % 13 <> 0)"""


def _calls(spark, sf):
    return metrics.trace_calls(trace(spark, sf), "main")


@query("calls_per_minute", f"WITH {TRACE} SELECT date_trunc('minute', ts)::TIMESTAMP AS bucket, operation, count(*) AS calls FROM tr GROUP BY ALL")
def q_calls(spark, sf):
    return metrics.calls_per_minute(_calls(spark, sf)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("tokens_per_minute", f"""
WITH {TRACE} SELECT date_trunc('minute', ts)::TIMESTAMP AS bucket, sum(k)::DOUBLE AS prompt_tokens, sum(whole)::DOUBLE AS completion_tokens,
 sum(k + whole)::DOUBLE AS total_tokens FROM tr GROUP BY ALL""")
def q_tokens(spark, sf):
    return metrics.tokens_per_minute(_calls(spark, sf)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("model_counts", f"WITH {TRACE} SELECT model, count(*) AS calls FROM tr GROUP BY model ORDER BY calls DESC, model LIMIT 5")
def q_models(spark, sf):
    return metrics.model_counts(_calls(spark, sf), 5)


@query("latency_table", f"WITH {TRACE} SELECT operation, model, value AS latency_ms FROM tr WHERE k % 5 <> 0")
def q_latency(spark, sf):
    return metrics.latency_table(_calls(spark, sf))


@query("cost_by_operation", f"WITH {TRACE} SELECT operation, sum(coalesce(cost, 0)) AS cost_usd FROM tr GROUP BY 1 HAVING sum(coalesce(cost, 0)) > 0")
def q_cost_operation(spark, sf):
    return metrics.cost_breakdown(_calls(spark, sf), "operation")


@query("cost_by_model", f"WITH {TRACE} SELECT model, sum(coalesce(cost, 0)) AS cost_usd FROM tr GROUP BY 1 HAVING sum(coalesce(cost, 0)) > 0")
def q_cost_model(spark, sf):
    return metrics.cost_breakdown(_calls(spark, sf), "model")


@query("call_summary", """
SELECT count(*) AS total_calls, round(avg(CASE WHEN (props->>'$.k')::BIGINT % 5 <> 0 THEN value END), 2) AS avg_latency_ms FROM events""")
def q_call_summary(spark, sf):
    return metrics.call_summary(trace(spark, sf))


@query("call_counts", """
WITH b AS (SELECT unnest(['provider', 'status']) AS dimension, unnest([CASE WHEN event_type = 'error' THEN 'other' ELSE 'main' END, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'ok' END]) AS label FROM events)
SELECT dimension, label, count(*) AS n FROM b GROUP BY ALL""")
def q_call_counts(spark, sf):
    return metrics.call_counts(trace(spark, sf))


@query("last_events", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def q_last(spark, sf):
    return metrics.last_events(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 200)


@query("last_events_per_user", """
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def q_last_user(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return metrics.last_events(e, "event_id", 5, ["user_id"])


@query("stalled_jobs", """
WITH j AS (SELECT user_id, max(ts) AS last_event_at, arg_max(event_type, event_id) AS et FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, et = 'view' AND floor(epoch(now)) - floor(epoch(last_event_at)) >= 300 AS stalled, CASE WHEN et = 'view' AND user_id % 2 = 0 THEN 'stale' WHEN et = 'view' THEN 'running' ELSE et END AS job_status FROM j CROSS JOIN n""")
def q_stalled(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("t")).first()["t"]
    jobs = e.groupBy("user_id").agg(F.max("ts").alias("last_event_at"), F.max_by("event_type", "event_id").alias("et"))
    jobs = jobs.select(
        "user_id", "last_event_at", F.when(F.col("et") == "view", "running").otherwise(F.col("et")).alias("status"),
        (F.col("user_id") % 2 == 1).alias("session_alive"))
    return metrics.reconcile(metrics.stalled(jobs, F.lit(now))).select("user_id", "stalled", "job_status")
