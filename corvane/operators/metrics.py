"""Run summaries, cost resolution, breakdowns, windows, and call traces.

Metric events: ``site_id, run_id, timestamp, event_type, stage, operation, provider, model``
plus the measures below. Unknown measures are NULL and never counted as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.numbers import sum_known
from corvane.functions.text import first_filled
from corvane.operators.relational import breakdowns, constants, top_k

# List prices in USD for a million tokens.
EMBEDDING_PRICES = (
    ("openai/text-embedding-3-small", 0.02), ("text-embedding-3-small", 0.02),
    ("openai/text-embedding-3-large", 0.13), ("text-embedding-3-large", 0.13),
)
TEXT_PRICES = (
    ("deepseek/deepseek-v4-flash", 0.0983, 0.1966), ("openai/gpt-4.1-mini", 0.40, 1.60),
    ("openai/gpt-4.1", 2.00, 8.00), ("anthropic/claude-sonnet-4.5", 3.00, 15.00),
    ("google/gemini-2.5-flash", 0.30, 2.50),
)
COST_SOURCES = ("reported", "estimated", "partial", "mixed")
WINDOWS = (("30d", 30), ("60d", 60), ("90d", 90), ("365d", 365), ("all_time", None))


def price_table(spark, text_prices=TEXT_PRICES, embedding_prices=EMBEDDING_PRICES) -> DataFrame:
    """``(kind, model, input_price, output_price)``; a fresh list takes the fixed one's place."""
    rows = [("llm", m, i, o) for m, i, o in text_prices] + [("embedding", m, p, 0.0) for m, p in embedding_prices]
    return constants(spark, rows, "kind, price_model, input_price, output_price")


def merge_prices(fetched: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fetched prices, filled up with the fallback for models they lack."""
    return fetched.unionByName(fallback.join(fetched, ["kind", "price_model"], "left_anti"))


def event_kind(event_type: Column, operation: Column) -> Column:
    explicit = F.lower(F.trim(event_type))
    return F.coalesce(
        F.nullif(explicit, F.lit("")), F.when(F.lower(operation).contains("embed"), "embedding").otherwise("llm"))


def with_cost(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``kind``, resolved ``total`` tokens, ``amount`` and ``amount_source``.

    A reported amount stands; else tokens are priced by the model's list price; else the
    amount is unknown.
    """
    e = events.withColumn("kind", event_kind(F.col("event_type"), F.col("operation")))
    e = e.join(F.broadcast(prices), (prices["kind"] == e["kind"]) & (prices["price_model"] == e["model"]), "left").drop(
        prices["kind"])
    only_total = F.col("total_tokens").isNotNull() & F.col("prompt_tokens").isNull() & F.col("completion_tokens").isNull()
    prompt = F.when(only_total, F.col("total_tokens")).otherwise(F.coalesce("prompt_tokens", F.lit(0)))
    completion = F.when(only_total, 0).otherwise(F.coalesce("completion_tokens", F.lit(0)))
    million = F.lit(1_000_000.0)
    text_cost = F.when(
        (prompt > 0) | (completion > 0),
        F.round(prompt / million * F.col("input_price") + completion / million * F.col("output_price"), 8))
    vector_cost = F.when(
        (F.col("input_tokens") > 0) & (F.col("input_price") > 0),
        F.round(F.col("input_tokens") / million * F.col("input_price"), 8))
    given = F.col("cost_usd").isNotNull() & (first_filled(F.col("cost_source"), F.lit("unknown")) != "unknown")
    estimate = F.when(F.col("kind") == "embedding", vector_cost).otherwise(text_cost)
    tag = F.when(F.col("cost_source").isin(*COST_SOURCES), F.col("cost_source")).otherwise("unknown")
    return e.withColumns({
        "total": F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")),
        "amount": F.when(given, F.col("cost_usd")).otherwise(estimate),
        "amount_source": F.when(given, tag).when(estimate.isNotNull(), "estimated").otherwise("unknown"),
    }).drop("price_model", "input_price", "output_price")


def _lattice(amount: Column, source: Column, of: Column) -> tuple[Column, Column]:
    """Aggregated amount and its source over the rows ``of`` selects.

    None known: unknown. Some unknown: partial. One source: that one, if reported or
    estimated. Else mixed.
    """
    known = F.count_if(of & amount.isNotNull())
    missing = F.count_if(of & amount.isNull())
    counted = F.when(of & amount.isNotNull(), source)
    one = (F.min(counted) == F.max(counted)) & F.min(counted).isin("reported", "estimated")
    total = F.when(known > 0, F.round(F.sum(F.when(of, amount)), 8))
    label = (
        F.when(known == 0, "unknown").when(missing > 0, "partial").when(one, F.min(counted)).otherwise("mixed")
    )
    return total, label


def _pair(first: tuple[str, str], second: tuple[str, str], use_first: Column, use_second: Column):
    """Combine two already aggregated costs of one row by the same rules."""
    a, sa, b, sb = F.col(first[0]), F.col(first[1]), F.col(second[0]), F.col(second[1])
    lacks = (use_first & a.isNull()) | (use_second & b.isNull())
    has_a, has_b = use_first & a.isNotNull(), use_second & b.isNotNull()
    total = F.round(F.when(has_a, a).otherwise(0.0) + F.when(has_b, b).otherwise(0.0), 8)
    same = F.when(has_a & has_b, sa == sb).otherwise(True)
    only = F.when(has_a, sa).otherwise(sb)
    label = (
        F.when(~has_a & ~has_b, "unknown").when(lacks, "partial")
        .when(same & only.isin("reported", "estimated"), only).otherwise("mixed")
    )
    return F.when(has_a | has_b, total), label


def run_summaries(events: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("site_id", "run_id")) -> DataFrame:
    """One row per run: times, token sums, costs with source, warnings.

    Always rebuilt from all events of the run, so late events are never dropped. Every
    measure is a partial aggregate; a run of any size is combined map-side first.
    """
    e = with_cost(events, prices)
    llm, emb = F.col("kind") == "llm", F.col("kind") == "embedding"
    known = lambda c, of: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0)).cast("long")
    llm_cost, llm_source = _lattice(F.col("amount"), F.col("amount_source"), llm)
    emb_cost, emb_source = _lattice(F.col("amount"), F.col("amount_source"), emb)
    ts = F.col("timestamp")
    s = e.groupBy(*keys).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("completed_at"), F.count(F.lit(1)).alias("event_count"),
        F.count_if(llm).alias("llm_requests"), sum_known(F.col("prompt_tokens"), llm).alias("prompt_tokens"),
        sum_known(F.col("completion_tokens"), llm).alias("completion_tokens"), sum_known(F.col("total"), llm).alias("llm_tokens"),
        known("retry_count", llm).alias("retry_count"), known("latency_ms", llm).alias("latency_ms"),
        llm_cost.alias("llm_cost"), llm_source.alias("llm_cost_source"),
        F.count_if(emb).alias("embedding_requests"), sum_known(F.col("input_tokens"), emb).alias("embedding_tokens"),
        *[known(c, emb).alias(c) for c in (
            "document_count", "chunk_count", "vector_count", "reused_vector_count", "skipped_chunk_count", "failed_chunk_count")],
        known("duration_ms", emb).alias("embedding_duration_ms"),
        emb_cost.alias("embedding_cost"), emb_source.alias("embedding_cost_source"),
        F.bool_or(llm & F.col("total").isNull()).alias("_no_llm"),
        F.bool_or(emb & F.col("input_tokens").isNull()).alias("_no_emb"),
        F.bool_or((llm | emb) & F.col("amount").isNull()).alias("_no_cost"),
    )
    total, source = _pair(
        ("llm_cost", "llm_cost_source"), ("embedding_cost", "embedding_cost_source"),
        F.col("llm_requests") > 0, F.col("embedding_requests") > 0)
    warnings = F.array_compact(F.array(
        F.when(F.col("_no_emb"), F.lit("missing_embedding_tokens")), F.when(F.col("_no_llm"), F.lit("missing_llm_tokens")),
        F.when(F.col("_no_cost"), F.lit("unknown_cost"))))
    tokens = F.when(
        F.col("llm_tokens").isNotNull() | F.col("embedding_tokens").isNotNull(),
        F.coalesce("llm_tokens", F.lit(0)) + F.coalesce("embedding_tokens", F.lit(0)))
    length = F.coalesce(F.floor((F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1000)), F.lit(0))
    return s.withColumns({
        "total_model_tokens": tokens, "cost": total, "cost_source": source, "warnings": warnings,
        "duration_ms": length.cast("long"),
        "health": F.when(F.size(warnings) > 0, "partial").otherwise("complete"),
    }).drop("_no_llm", "_no_emb", "_no_cost")


def token_breakdowns(events: DataFrame, keys: tuple[str, ...] = ("site_id", "run_id")) -> DataFrame:
    """Tokens by stage, provider, model and operation of each run in one pass."""
    dims = ["stage", "provider", "model", "operation"]
    rows = events.select(
        *keys, *[first_filled(F.col(d), F.lit("unknown")).alias(d) for d in dims],
        F.coalesce("total_tokens", "input_tokens", F.lit(0)).alias("_tokens"))
    return breakdowns(rows, list(keys), dims, F.col("_tokens"), "tokens")


def rollups(summaries: DataFrame, as_of: Column, windows=WINDOWS, site: str = "site_id") -> DataFrame:
    """Totals of each site's runs started within each look-back window.

    Windows overlap and have no upper end; a run without a start counts only in all
    time. Each run row lists the windows it belongs to. Every site has a row for every
    window, with zeros where it has no run.
    """
    since = F.unix_seconds(as_of)
    entries = F.array(*[
        F.struct(F.lit(name).alias("window"), (F.lit(None) if days is None else since - days * 86400).cast("long").alias("cutoff"))
        for name, days in windows])
    start = F.coalesce("started_at", "completed_at")
    member = F.filter(entries, lambda w: w["cutoff"].isNull() | (F.unix_micros(start) >= w["cutoff"] * 1_000_000))
    rows = summaries.withColumn("window", F.explode(F.transform(member, lambda w: w["window"]))).withColumn("_run", F.lit(True))
    every = summaries.select(site).distinct().withColumn("window", F.explode(F.array(*[F.lit(name) for name, _ in windows]))).withColumn("_run", F.lit(False))
    rows = rows.unionByName(every, allowMissingColumns=True)
    run, runs = F.col("_run"), F.count_if(F.col("_run"))
    status = F.lower(F.coalesce("status", F.lit("")))
    cost, source = _lattice(F.col("cost"), F.col("cost_source"), run)
    emb, emb_source = _lattice(F.col("embedding_cost"), F.col("embedding_cost_source"), run)
    long_sum = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy(site, "window").agg(
        runs.alias("run_count"), F.count_if(status.isin("complete", "completed")).alias("successful_run_count"),
        F.count_if(status == "failed").alias("failed_run_count"),
        F.count_if(status.isin("canceled", "cancelled")).alias("canceled_run_count"),
        sum_known(F.col("total_model_tokens"), run).alias("total_tokens"), sum_known(F.col("llm_tokens"), run).alias("llm_tokens"),
        sum_known(F.col("embedding_tokens"), run).alias("embedding_tokens"),
        cost.alias("total_cost"), source.alias("total_cost_source"), emb.alias("embedding_cost"), emb_source.alias("embedding_cost_source"),
        long_sum("duration_ms").alias("total_duration_ms"),
        F.when(runs > 0, F.floor(long_sum("duration_ms") / runs)).otherwise(0).cast("long").alias("average_duration_ms"),
        long_sum("document_count").alias("document_count"), long_sum("chunk_count").alias("chunk_count"),
        long_sum("vector_count").alias("vector_count"))


def run_list(summaries: DataFrame, limit: int = 100) -> DataFrame:
    """Newest runs first."""
    return summaries.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


# ----------------------------------------------------------------------- traces
def trace_calls(trace: DataFrame, provider: str) -> DataFrame:
    """Calls of a provider with a readable time; summary rows are left out."""
    ts = trace.schema["ts"].dataType.simpleString()
    when = F.try_to_timestamp("ts") if ts == "string" else F.col("ts").cast("timestamp")
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return trace.filter(
        (F.coalesce("provider", F.lit("")) == provider) & ~F.coalesce("is_summary", F.lit(False))
    ).withColumns({"ts": when, "operation": label("operation"), "model": label("model")}).filter("ts IS NOT NULL")


def calls_per_minute(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.date_trunc("minute", "ts").alias("bucket"), "operation").agg(F.count(F.lit(1)).alias("calls"))


TOKEN_COLUMNS = ("prompt_tokens", "completion_tokens", "total_tokens")


def tokens_per_minute(calls: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    return calls.groupBy(F.date_trunc("minute", "ts").alias("bucket")).agg(*[F.sum(number(c)).alias(c) for c in TOKEN_COLUMNS])


def model_counts(calls: DataFrame, limit: int = 12) -> DataFrame:
    """Most called models; ties are cut and ordered by model name."""
    counts = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    return counts.orderBy(F.col("calls").desc(), "model").limit(max(1, limit))


def latency_table(calls: DataFrame) -> DataFrame:
    value = F.col("latency_ms").cast("string").try_cast("double")
    return calls.withColumn("latency_ms", value).filter("latency_ms IS NOT NULL").select(
        "operation", "model", "latency_ms").orderBy(F.col("latency_ms").desc())


def cost_breakdown(calls: DataFrame, group_by: str) -> DataFrame:
    """Positive cost sums by operation or model."""
    if group_by not in ("operation", "model"):
        raise ValueError(f"unsupported group_by: {group_by}")
    cost = F.coalesce(F.col("cost_usd").cast("string").try_cast("double"), F.lit(0.0))
    return calls.groupBy(group_by).agg(F.sum(cost).alias("cost_usd")).filter("cost_usd > 0")


def call_summary(events: DataFrame) -> DataFrame:
    """Calls and mean latency over all events."""
    return events.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"))


def call_counts(events: DataFrame) -> DataFrame:
    rows = events.select(*[first_filled(F.col(c), F.lit("unknown")).alias(c) for c in ("provider", "status")])
    return breakdowns(rows, [], ["provider", "status"], F.lit(1), "n")


def last_events(events: DataFrame, seq: str, limit: int, keys: list[str] | None = None) -> DataFrame:
    """The last ``limit`` events in order; of each key when keys are given."""
    if not keys:
        return events.orderBy(F.col(seq).desc()).limit(limit)
    return top_k(events, keys, [F.col(seq).desc()], limit, "_r").drop("_r")


def stalled(jobs: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Running jobs whose last event is at least ``seconds`` old."""
    age = F.unix_seconds(now) - F.unix_seconds("last_event_at")
    return jobs.withColumn("stalled", (F.lower("status") == "running") & F.coalesce(age >= seconds, F.lit(False)))


def reconcile(jobs: DataFrame) -> DataFrame:
    """A running job without a live session is stale."""
    dead = (F.lower("status") == "running") & ~F.coalesce("session_alive", F.lit(False))
    return jobs.withColumn("job_status", F.when(dead, "stale").otherwise(F.col("status"))).withColumn("stale_running", dead)
