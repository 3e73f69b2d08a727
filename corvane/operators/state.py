"""Keyed state as batch folds: the web-search budget and the loop guard.

A fold needs its key's events in order. Where the state is certain to be empty, a key's
sequence is cut into segments that are folded apart, so a busy key is spread over tasks.
Within a segment rows are sorted and streamed through one function that carries the
state, so memory does not grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import ordered

BUDGET_LIMIT, BUDGET_WINDOW = 10, 3600
GUARD_TTL, MAX_RETRIES = 3600, 3


def _ordered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.repartition(key, "segment").sortWithinPartitions(key, "segment", *order)


def budget_windows(
    requests: DataFrame, key: str, second: str, limit: int = BUDGET_LIMIT, window: int = BUDGET_WINDOW
) -> DataFrame:
    """Budget windows per key: ``(key, window_start, requests, allowed, denied)``.

    A window opens at the first request more than ``window`` seconds after the last
    one opened; at most ``limit`` requests in it are allowed. Requests of the same second
    share a fate, so they are counted per second before the shuffle: a key has at most
    one row for each second of its life, whatever its number of requests. A pause longer
    than the window always opens a new one, so the seconds are cut there.
    """
    per_second = requests.groupBy(key, F.col(second).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType([
        T.StructField(key, requests.schema[key].dataType), T.StructField("window_start", T.LongType()),
        T.StructField("requests", T.LongType()), T.StructField("allowed", T.LongType()), T.StructField("denied", T.LongType()),
    ])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, total = None, 0, 0
        done: list[tuple] = []
        for batch in batches:
            for k, part, at, n in zip(*(batch[c].tolist() for c in (key, "segment", "second", "n"))):
                if current is None or (k, part) != current or at - start > window:
                    if current is not None:
                        done.append((current[0], start, total))
                    current, start, total = (k, part), at, 0
                total += n
            yield shaped(done)
            done = []
        if current is not None:
            yield shaped([(current[0], start, total)])

    def shaped(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[key, "window_start", "requests"])
        out["allowed"] = out["requests"].clip(upper=limit)
        out["denied"] = out["requests"] - out["allowed"]
        return out

    rows = ordered.with_previous(ordered.ranged(per_second, key, "second"), key, "second", "second", "before")
    pause = F.col("second") - F.col("before") > window
    return _ordered(ordered.with_running_count(rows, key, "second", pause, "segment"), key, "second").mapInPandas(fold, schema)


class Guard:
    """State of one question: opened at, waiting for its job, failed retries."""

    __slots__ = ("opened", "retries", "waiting")

    def __init__(self, opened: float = 0.0, retries: int = 0, waiting: bool = False) -> None:
        self.opened, self.retries, self.waiting = opened, retries, waiting


def guard_step(state: Guard | None, event: str, at: float, ttl: int = GUARD_TTL) -> tuple[Guard | None, str]:
    """Next state and outcome of one event.

    ``succeeded`` clears the question. ``failed`` ends the wait and counts a retry. An
    ``ask`` is pending while an entry waits that is not older than ``ttl``; an older
    entry is forgotten with its retries; three retries are the end; else a job starts.
    """
    if event == "succeeded":
        return None, "cleared"
    if event == "failed":
        if state is None:
            return None, "ignored"
        return Guard(state.opened, state.retries + 1, False), "retry_counted"
    if state is not None and at - state.opened > ttl:
        state = None
    if state is not None and state.waiting:
        return state, "pending"
    if state is not None and state.retries >= MAX_RETRIES:
        return state, "ingest_retry_exhausted"
    return Guard(at, state.retries if state else 0, True), "started"


def loop_guard(events: DataFrame, key: str, seq: str, second: str, event: str, ttl: int = GUARD_TTL) -> DataFrame:
    """Outcome of every event in order: ``(key, seq, outcome, retries)``.

    A success forgets a question, so each question's events are cut after its successes.
    """
    schema = T.StructType([
        T.StructField(key, events.schema[key].dataType), T.StructField(seq, events.schema[seq].dataType),
        T.StructField("outcome", T.StringType()), T.StructField("retries", T.IntegerType()),
    ])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            outcomes, retries = [], []
            for k, part, at, what in zip(*(batch[c].tolist() for c in (key, "segment", second, event))):
                if current is None or (k, part) != current:
                    current, state = (k, part), None
                state, outcome = guard_step(state, what, at, ttl)
                outcomes.append(outcome)
                retries.append(state.retries if state else 0)
            yield pd.DataFrame({key: batch[key], seq: batch[seq], "outcome": outcomes, "retries": retries})

    rows = ordered.with_previous(ordered.ranged(events.select(key, seq, second, event), key, seq), key, seq, event, "before")
    rows = ordered.with_running_count(rows, key, seq, F.col("before") == "succeeded", "segment")
    return _ordered(rows, key, seq).mapInPandas(fold, schema)


# Ordered statuses of an answer; the first test that holds decides.
def answer_status(df: DataFrame) -> DataFrame:
    """Add ``status`` and ``provenance`` of each question from the state columns.

    ``confident, job_state, guard_pending, index_ready, budget_left, retries, search_status,
    accepted, launched``.
    """
    chain = (
        (F.col("confident"), "ok", "wiki"), (F.col("job_state") == "succeeded", "ok", "wiki"),
        (F.col("job_state") == "failed", "ingest_failed", "none"), (F.col("guard_pending"), "ok", "web_provisional"),
        (~F.col("index_ready"), "index_not_ready", "none"), (~F.col("budget_left"), "web_search_budget_exhausted", "none"),
        (F.col("retries") >= MAX_RETRIES, "ingest_retry_exhausted", "none"),
        (F.coalesce(F.col("search_status"), F.lit("")) != "ok", None, "none"),
        (F.coalesce(F.col("accepted"), F.lit(0)) == 0, "no_confident_answer", "none"),
        (~F.col("launched"), "ingest_launch_failed", "none"),
    )
    status = provenance = None
    for test, name, origin in chain:
        test = F.coalesce(test, F.lit(False))
        value = F.lit(name) if name else F.coalesce(F.nullif("search_status", F.lit("")), F.lit("web_search_unavailable"))
        status = F.when(test, value) if status is None else status.when(test, value)
        provenance = F.when(test, origin) if provenance is None else provenance.when(test, origin)
    return df.withColumn("status", status.otherwise("ok")).withColumn("provenance", provenance.otherwise("web_provisional"))


# Question words and the site areas to crawl again for them.
REFRESH_AREAS = (
    ("registrar", ("/registrar", "/enrollment-services")), ("schedule", ("/registrar", "/academic-calendar", "/course-schedule")),
    ("course", ("/catalog", "/course", "/program")), ("tuition", ("/tuition", "/financial-aid", "/bursar")),
    ("housing", ("/housing", "/student-life")), ("admission", ("/admission", "/apply")),
)


def refresh_groups(question, urls):
    """Distinct areas named by the question and by the evidence URLs, at most twelve."""
    from corvane.functions.urls import path_parts

    none = F.array().cast("array<string>")
    low = F.lower(question)
    named = F.concat(*[
        F.when(low.contains(word), F.array(*[F.lit(p) for p in paths])).otherwise(none) for word, paths in REFRESH_AREAS])
    seen = F.transform(
        F.filter(urls, lambda u: F.size(path_parts(u)) > 0),
        lambda u: F.concat(F.lit("/"), F.array_join(F.slice(path_parts(u), 1, 2), "/")))
    return F.slice(F.array_distinct(F.concat(named, seen)), 1, 12)


def query_key(question):
    """Digest of a question without regard to case and spacing."""
    from corvane.functions.text import collapse_space, text_or_empty

    return F.sha2(F.lower(collapse_space(text_or_empty(question))), 256)


def resolve_sites(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """Site of each request ``(rid, site_id, hint)``: explicit id, else one fuzzy match.

    ``sites (site_id, name, domain, enabled)``. A hint matches a site when either slug
    contains the other. Both directions are equi-joins: site slugs with the spans of the
    hint, and the hint with the spans of the site slugs. Without id and hint the only
    enabled site is taken.
    """
    from corvane.functions.text import slug

    names = sites.select("site_id", F.explode(F.array_distinct(F.filter(
        F.array(*[slug(F.col(c), "_") for c in ("site_id", "name", "domain")]), lambda v: v != ""))).alias("token"))
    asked = requests.withColumn("_h", slug(F.col("hint"), "_")).withColumn("_id", F.trim(F.coalesce("site_id", F.lit(""))))
    hints = asked.filter("_id = '' AND _h <> ''").select("rid", "_h")

    def spans(c: str):
        return F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.length(c)),
            lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(F.col(c), i, n)))))

    inside_hint = hints.select("rid", F.explode(spans("_h")).alias("token")).join(names, "token").select("rid", "site_id")
    inside_name = hints.withColumnRenamed("_h", "span").join(
        names.select("site_id", F.explode(spans("token")).alias("span")), "span").select("rid", "site_id")
    fuzzy = inside_hint.unionByName(inside_name).distinct().groupBy("rid").agg(
        F.count(F.lit(1)).alias("n"), F.min("site_id").alias("match"))
    only = sites.filter("enabled").agg(F.count(F.lit(1)).alias("n_on"), F.min("site_id").alias("on"))
    exact = sites.select(F.col("site_id").alias("_id"), F.lit(True).alias("known")).distinct()
    rows = asked.join(exact, "_id", "left").join(fuzzy, "rid", "left").join(F.broadcast(only), F.lit(True))
    return rows.select(
        "rid",
        F.when(F.col("_id") != "", F.when(F.col("known"), F.col("_id"))).when(
            F.col("_h") != "", F.when(F.col("n") == 1, F.col("match"))).when(F.col("n_on") == 1, F.col("on")).alias("resolved"),
        F.when(F.col("_id") != "", F.when(F.col("known"), "").otherwise("site_not_found")).when(
            F.col("_h") != "", F.when(F.col("n") == 1, "").when(F.col("n") > 1, "ambiguous_university").otherwise("site_not_found"))
        .when(F.col("n_on") == 1, "").otherwise("site_required").alias("error"))
