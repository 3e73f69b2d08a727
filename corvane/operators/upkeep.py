"""Live status, retention, counts and small record helpers of a running site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import documents
from corvane.operators.relational import first_per_key, top_k

# Page states that are counted, and run states that a pause does not touch.
STATES = ("queued", "running", "success", "failed", "cancelled")
ENDED = ("cancelled", "completed", "failed")
WAITING = ("paused", "pausing", "initializing")


def live_status(pages: DataFrame, runs: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Counts by state of each run's pages, the first running url, and the run's state.

    pages ``(keys, pos, url, status)``, runs ``(keys, state, paused)``. A page without a state
    is queued; other states are not counted. A run that is not over is pausing while pages
    run, then paused; without a pause it runs again.
    """
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("queued"))
    counts = pages.groupBy(*keys).agg(
        *[F.count_if(status == s).alias(s) for s in STATES], F.min_by("url", F.when(status == "running", F.col(pos))).alias("current_url"))
    rows = runs.join(counts, keys, "left").fillna(0, list(STATES))
    state = F.lower(F.coalesce("state", F.lit("")))
    return rows.withColumn("state", F.when(state.isin(*ENDED), F.col("state")).when(
        F.col("paused"), F.when(F.col("running") > 0, "pausing").otherwise("paused")).when(state.isin(*WAITING), "running").otherwise(F.col("state"))).drop("paused")


def expired_runs(runs: DataFrame, keep: int = 20, site: str = "site_id", at: str = "modified") -> DataFrame:
    """Runs beyond the ``keep`` newest of their site; equal times go by run id.

    The newest are found per site with a bounded window; what is not among them goes.
    """
    order = [F.col(at).desc(), F.col("run_id")]
    newest = top_k(runs.select(site, "run_id", at), [site], order, keep).select(site, "run_id")
    return runs.join(newest, [site, "run_id"], "left_anti")


def page_type_counts(pages: DataFrame) -> DataFrame:
    """``(page_type, pages, guides, sources)`` of ``pages (path, explicit_type)``."""
    kind = documents.page_type(F.col("explicit_type"), F.col("path"))
    rows = pages.select("path", kind.alias("page_type"))
    inside = lambda view: F.count_if(documents.in_view(F.col("page_type"), F.col("path"), view))
    return rows.groupBy("page_type").agg(F.count(F.lit(1)).alias("pages"), inside("guides").alias("guides"), inside("sources").alias("sources"))


def site_counts(runs: DataFrame, site: str = "site_id") -> DataFrame:
    """Runs, states and latest run of each site; ``runs (site, run_id, status, started_at)``."""
    status = F.lower(F.coalesce("status", F.lit("")))
    return runs.groupBy(site).agg(
        F.count(F.lit(1)).alias("run_count"), F.count_if(status.isin("complete", "completed")).alias("completed"),
        F.count_if(status == "running").alias("running"), F.max_by("run_id", F.struct("started_at", "run_id")).alias("latest_run_id"))


def by_score(scored: DataFrame, pos: str) -> DataFrame:
    """Scored urls, the best first; equal scores stay in order."""
    return scored.orderBy(F.col("score").desc(), pos)


def packet_targets(links: DataFrame) -> DataFrame:
    """Stale pages with all their changed sources in order; ``links (source_id, page_id)``."""
    return links.groupBy("page_id").agg(
        F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.lit("source_hash_changed").alias("reason"))


def missing_in_index(pages: DataFrame, index_lines: DataFrame) -> DataFrame:
    """Pages ``(path)`` that no line ``(line)`` of the index names.

    A line names the paths in it, and what follows any of their slashes: an equi-join, not a
    search of every path in the whole text.
    """
    named = F.regexp_extract_all("line", F.lit(r"[\w./-]+\.md"), F.lit(0))
    words = index_lines.select(F.explode(named).alias("name")).distinct()
    parts = F.split("name", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return pages.select("path").join(words.select(F.explode(tails).alias("path")).distinct(), "path", "left_anti")


def original_urls(pdfs: DataFrame, scraped: DataFrame, pos: str) -> DataFrame:
    """``pdfs (pdf_source_id, source_path)`` with ``original_url``, '' when none is known.

    ``scraped (pos, url, pdf_path, raw_html_path, meta_pdf_path)``: a file path names the url of
    its last manifest entry; a url names itself; paths come first.
    """
    given = scraped.withColumn("url", X.strip(X.text_or_empty(F.col("url")))).filter("url <> ''")
    path = lambda c: F.regexp_replace(X.strip(X.text_or_empty(F.col(c))), r"(?<=.)/+$", "")
    files = F.array(*[F.struct(F.lit(i).alias("i"), path(c).alias("key")) for i, c in enumerate(("pdf_path", "raw_html_path", "meta_pdf_path"))])
    by_path = given.select(pos, "url", F.explode(files).alias("f")).select(pos, F.col("f.i").alias("i"), F.col("f.key").alias("key"), "url", F.lit(0).alias("turn")).filter("key <> ''")
    last = first_per_key(by_path, ["key"], [F.col(pos).desc(), F.col("i").desc()]).select("key", "url", "turn")
    known = last.unionByName(given.select(F.col("url").alias("key"), "url", F.lit(1).alias("turn")).distinct())
    asked = pdfs.withColumn("key", path("source_path"))
    met = asked.join(first_per_key(known, ["key"], [F.col("turn")]).drop("turn"), "key", "left")
    return met.select(*pdfs.columns, F.when(F.col("key") == "", "").otherwise(F.coalesce("url", F.lit(""))).alias("original_url"))


def ordered_distinct(rows: DataFrame, key: str, pos: str, value: str, out: str) -> DataFrame:
    """Distinct non-blank values of each key in order of first appearance.

    Repeats go before the values are gathered, so a list is as long as its result.
    """
    trimmed = rows.select(key, pos, X.strip(X.text_or_empty(F.col(value))).alias("_v")).filter("_v <> ''")
    first = trimmed.groupBy(key, "_v").agg(F.min(pos).alias("_p"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda s: s["_v"]).alias(out))


def failure_record(url: Column, reason: Column, context: Column) -> Column:
    """Map of a failure: ``context`` entries win over url and reason."""
    base = F.create_map(F.lit("url"), url, F.lit("reason"), reason)
    own = F.map_filter(base, lambda k, v: ~F.map_contains_key(context, k))
    return F.map_concat(own, context)


def store_text(value: Column) -> Column:
    """Text without control characters other than line breaks and tabs."""
    return F.regexp_replace(X.text_or_empty(value), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def store_id(value: Column) -> Column:
    """Identifier of a value in the vector store."""
    return F.concat(F.lit("d"), F.sha1(value))


def source_id_list(value: Column) -> Column:
    """Ids of a JSON list; any other text is one id, none for a blank one."""
    listed = F.from_json(value, "array<string>")
    one = F.when(X.strip(X.text_or_empty(value)) == "", F.array().cast("array<string>")).otherwise(F.array(value))
    return F.when(value.rlike(r"(?s)^\s*\[") & listed.isNotNull(), listed).otherwise(one)
