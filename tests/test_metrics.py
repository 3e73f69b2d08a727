import datetime

import pytest
from pyspark.sql import functions as F

from corvane.operators import metrics, quality

UTC = datetime.timezone.utc
MEASURES = (
    "prompt_tokens", "completion_tokens", "total_tokens", "input_tokens", "latency_ms", "retry_count", "document_count",
    "chunk_count", "vector_count", "reused_vector_count", "skipped_chunk_count", "failed_chunk_count", "duration_ms",
)
SCHEMA = ("site_id string, run_id string, timestamp timestamp, event_type string, stage string, operation string, provider string, "
          "model string, " + ", ".join(f"{m} long" for m in MEASURES) + ", cost_usd double, cost_source string")


def event(run, **fields):
    base = {"site_id": "s", "run_id": run, "timestamp": datetime.datetime(2026, 5, 1, tzinfo=UTC), "event_type": "", "stage": "a",
            "operation": "compile", "provider": "p", "model": "openai/gpt-4.1", "cost_usd": None, "cost_source": None}
    base |= {m: None for m in MEASURES}
    base |= fields
    return tuple(base[c.split()[0]] for c in SCHEMA.split(", "))


def runs(spark, events):
    rows = metrics.run_summaries(spark.createDataFrame(events, SCHEMA), metrics.price_table(spark))
    return {r["run_id"]: r for r in rows.collect()}


def test_unknown_is_not_zero(spark):
    got = runs(spark, [
        event("unknown", model="nobody"), event("empty_total", prompt_tokens=3, completion_tokens=4, model="nobody"),
        event("embed", operation="embed_chunks", input_tokens=1_000_000, model="text-embedding-3-small"),
    ])
    assert got["unknown"]["llm_tokens"] is None and got["unknown"]["cost"] is None and got["unknown"]["cost_source"] == "unknown"
    assert got["unknown"]["embedding_tokens"] == 0 and got["unknown"]["warnings"] == ["missing_llm_tokens", "unknown_cost"]
    assert got["empty_total"]["llm_tokens"] == 7
    assert got["embed"]["cost"] == 0.02 and got["embed"]["cost_source"] == "estimated" and got["embed"]["health"] == "complete"


def test_cost_sources(spark):
    reported = {"cost_usd": 0.5, "cost_source": "reported"}
    got = runs(spark, [
        event("one", total_tokens=1, **reported), event("one", total_tokens=1, **reported),
        event("mixed", total_tokens=1, **reported), event("mixed", total_tokens=1_000_000),
        event("partial", total_tokens=1, **reported), event("partial", total_tokens=5, model="nobody"),
        event("two", total_tokens=1, **reported), event("two", operation="embed", input_tokens=1_000_000, model="text-embedding-3-small"),
    ])
    assert got["partial"]["llm_cost_source"] == "partial"  # one partial part makes the run mixed
    assert {k: (r["cost"], r["cost_source"]) for k, r in got.items()} == {
        "one": (1.0, "reported"), "mixed": (2.5, "mixed"), "partial": (0.5, "mixed"), "two": (0.52, "mixed")}


def test_rollups_of_five_runs(spark):
    as_of = datetime.datetime(2026, 5, 29, tzinfo=UTC)
    events = [event(f"r{i}", timestamp=as_of - datetime.timedelta(days=age), total_tokens=tokens)
              for i, (age, tokens) in enumerate([(5, 10), (45, 45), (80, 75), (200, 200), (500, 400)])]
    summaries = metrics.run_summaries(spark.createDataFrame(events, SCHEMA), metrics.price_table(spark)).withColumn(
        "status", F.when(F.col("run_id") == "r1", "failed").otherwise("completed")).withColumn("site_id", F.lit("s"))
    old = summaries.filter("run_id = 'r4'").withColumn("site_id", F.lit("old"))
    rows = metrics.rollups(summaries.unionByName(old), F.lit(as_of)).collect()
    other = {r["window"]: (r["run_count"], r["total_tokens"], r["total_cost_source"], r["average_duration_ms"]) for r in rows if r["site_id"] == "old"}
    assert len(other) == 5 and all(other[w] == (0, 0, "unknown", 0) for w in ("30d", "60d", "90d", "365d")) and other["all_time"][:2] == (1, 400)
    got = {r["window"]: r for r in rows if r["site_id"] == "s"}
    assert {w: r["total_tokens"] for w, r in got.items()} == {"30d": 10, "60d": 55, "90d": 130, "365d": 330, "all_time": 730}
    assert got["60d"]["failed_run_count"] == 1 and got["all_time"]["successful_run_count"] == 4


def test_trace_tables(spark):
    rows = spark.createDataFrame([
        ("main", "compile", "a", "ok", "2026-05-01T10:00:10Z", 100, 20, 120, 500, 0.01, False),
        ("main", "answer", "b", "ok", "2026-05-01T10:00:50Z", 40, 10, 50, 800, 0.02, None),
        ("main", "answer", "b", "ok", "not a time", 1, 1, 2, 9, 1.0, False), ("main", "all", "b", "ok", "2026-05-01T10:00:50Z", 1, 1, 2, 9, 1.0, True),
        ("other", "x", "c", "ok", "2026-05-01T10:00:50Z", 1, 1, 2, 9, 1.0, False), ("main", None, None, "ok", "2026-05-01T10:01:00Z", None, 1, None, None, 0.0, False),
    ], "provider string, operation string, model string, status string, ts string, prompt_tokens long, completion_tokens long, total_tokens long, latency_ms long, cost_usd double, is_summary boolean")
    calls = metrics.trace_calls(rows, "main")
    assert {(r["operation"], r["calls"]) for r in metrics.calls_per_minute(calls).collect()} == {("compile", 1), ("answer", 1), ("unknown", 1)}
    minutes = metrics.tokens_per_minute(calls).orderBy("bucket").collect()
    assert [tuple(r)[1:] for r in minutes] == [(140.0, 30.0, 170.0), (0.0, 1.0, 0.0)]
    assert [tuple(r) for r in metrics.model_counts(calls, 2).collect()] == [("a", 1), ("b", 1)]
    assert [r["latency_ms"] for r in metrics.latency_table(calls).collect()] == [800.0, 500.0]
    assert {r["model"]: r["cost_usd"] for r in metrics.cost_breakdown(calls, "model").collect()} == {"a": 0.01, "b": 0.02}
    with pytest.raises(ValueError):
        metrics.cost_breakdown(calls, "status")


def test_breakdowns(spark):
    rows = spark.createDataFrame([event("r", total_tokens=5), event("r", input_tokens=7, stage="", model="m")], SCHEMA)
    got = {(r["dimension"], r["label"]): r["tokens"] for r in metrics.token_breakdowns(rows).collect()}
    assert got[("stage", "a")] == 5 and got[("stage", "unknown")] == 7 and got[("operation", "compile")] == 12


def test_summary_reads_its_records_once(spark):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def action(n):
        looked.add(1)
        return ("approved", "cleaned", "odd")[n % 3]

    records = spark.range(9).select("id", F.concat(F.lit("s"), "id").alias("source_id"), action.asNondeterministic()("id").alias("action"))
    got = {r["action"]: (r["n"], r["examples"]) for r in quality.summarize(records, "id", examples=2).collect()}
    assert got == {"approved": (3, ["s0", "s3"]), "cleaned": (3, ["s1", "s4"]), "needs_review": (3, ["s2", "s5"]), "quarantined": (0, [])}
    assert looked.value == 9
