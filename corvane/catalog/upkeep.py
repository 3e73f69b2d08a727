"""Live status, retention, counts and record helpers over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.registry import ORACLES, query, table
from corvane.catalog.sources import EDGES, _links
from corvane.operators import upkeep


def _runs(spark, sf):
    """A run for each user, a site for every 25 of them, its state from the last event."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.max("event_id").alias("modified"))
    k = F.col("user_id") % 5
    state = F.when(k == 0, "completed").when(k == 1, "running").when(k == 2, "paused").when(k == 3, "initializing").otherwise("cancelled")
    return e.select(
        F.concat(F.lit("site"), F.floor(F.col("user_id") / 25).cast("string")).alias("site_id"), F.col("user_id").alias("run_id"), state.alias("state"),
        (F.col("last") == "error").alias("paused"), "modified")


RUNS = """
runs AS (SELECT 'site' || (user_id // 25) AS site_id, user_id AS run_id, ['completed', 'running', 'paused', 'initializing', 'cancelled'][user_id % 5 + 1] AS state,
  arg_max(event_type, event_id) = 'error' AS paused, max(event_id) AS modified FROM events GROUP BY user_id)"""


@query("live_status", f"""
WITH {RUNS}, p AS (SELECT user_id AS run_id, event_id, 'u' || event_id AS url, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'odd' END AS st FROM events),
c AS (SELECT run_id, count(*) FILTER (st = 'queued') AS queued, count(*) FILTER (st = 'running') AS running, count(*) FILTER (st = 'success') AS success, count(*) FILTER (st = 'failed') AS failed,
  0::BIGINT AS cancelled, arg_min(url, event_id) FILTER (st = 'running') AS current_url FROM p GROUP BY 1)
SELECT run_id, queued, running, success, failed, cancelled, current_url, CASE WHEN state IN ('completed', 'cancelled') THEN state
  WHEN paused THEN CASE WHEN running > 0 THEN 'pausing' ELSE 'paused' END WHEN state IN ('paused', 'initializing') THEN 'running' ELSE state END AS state FROM runs JOIN c USING (run_id)""")
def q_live(spark, sf):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "success").when(kind == "error", "failed").when(kind == "click", "running").when(kind == "view", "").otherwise("odd")
    pages = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", F.concat(F.lit("u"), "event_id").alias("url"), status.alias("status"))
    return upkeep.live_status(pages, _runs(spark, sf).select("run_id", "state", "paused"), ["run_id"], "event_id")


@query("expired_runs", f"""
WITH {RUNS} SELECT site_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY modified DESC, run_id) AS n FROM runs) WHERE n > 20""")
def q_expired(spark, sf):
    return upkeep.expired_runs(_runs(spark, sf)).select("site_id", "run_id")


@query("site_counts", f"""
WITH {RUNS} SELECT site_id, count(*) AS run_count, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'running') AS running,
  arg_max(run_id, modified) AS latest_run_id FROM runs GROUP BY 1""")
def q_site_counts(spark, sf):
    return upkeep.site_counts(_runs(spark, sf).select("site_id", "run_id", F.col("state").alias("status"), F.col("modified").alias("started_at")))


@query("page_type_counts", """
WITH p AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'pages/' || source || '/' || doc_id || '.md' WHEN 1 THEN 'pages/schools/' || doc_id || '.md' WHEN 2 THEN 'x/catalog-pdf/' || doc_id || '.md' ELSE doc_id || '-guide.md' END AS path,
   CASE WHEN doc_id % 9 = 0 THEN upper(lang) ELSE '' END AS given FROM documents),
k AS (SELECT *, length(path) - length(replace(path, '/', '')) AS depth, contains(path, 'catalog-pdf') AS shard FROM p),
t AS (SELECT *, CASE WHEN given <> '' THEN lower(given) WHEN shard THEN 'source' WHEN starts_with(path, 'pages/schools/') OR ends_with(path, '-guide.md') THEN 'semantic' WHEN depth <= 1 THEN 'category' ELSE 'unknown' END AS page_type FROM k)
SELECT page_type, count(*) AS pages, count(*) FILTER (NOT (page_type = 'source' OR shard) AND (page_type IN ('semantic', 'category') OR starts_with(path, 'pages/schools/') OR ends_with(path, '-guide.md'))) AS guides,
  count(*) FILTER (page_type = 'source' OR shard) AS sources FROM t GROUP BY 1""")
def q_page_types(spark, sf):
    k, doc = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("pages/"), "source", F.lit("/"), doc, F.lit(".md"))).when(k == 1, F.concat(F.lit("pages/schools/"), doc, F.lit(".md"))).when(
        k == 2, F.concat(F.lit("x/catalog-pdf/"), doc, F.lit(".md"))).otherwise(F.concat(doc, F.lit("-guide.md")))
    given = F.when(F.col("doc_id") % 9 == 0, F.upper("lang")).otherwise("")
    return upkeep.page_type_counts(table(spark, sf, "documents", "doc_id", "source", "lang").select(path.alias("path"), given.alias("explicit_type")))


@query("urls_by_score", ORACLES["url_scores"])
def q_by_score(spark, sf):
    from corvane.catalog.registry import QUERIES

    scored = QUERIES["url_scores"](spark, sf)
    return upkeep.by_score(scored, "page_id")


@query("packet_targets", f"""
WITH {EDGES} SELECT page_id, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_ids, 'source_hash_changed' AS reason FROM links GROUP BY 1""")
def q_targets(spark, sf):
    changed, links = _links(spark, sf)
    return upkeep.packet_targets(links).withColumn("source_ids", F.array_join(F.col("source_ids").cast("array<string>"), ","))


@query("lint_missing_index", """
WITH p AS (SELECT DISTINCT 'wiki/pages/' || source || '-' || lang || '.md' AS path FROM documents),
i AS (SELECT DISTINCT 'wiki/pages/' || source || '-' || lang || '.md' AS path FROM documents WHERE doc_id % 3 = 0)
SELECT path FROM p WHERE path NOT IN (SELECT path FROM i)""")
def q_missing_index(spark, sf):
    path = F.concat(F.lit("wiki/pages/"), "source", F.lit("-"), "lang", F.lit(".md"))
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    lines = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("* [Page](sites/a/"), path, F.lit(") of "), "lang").alias("line"))
    return upkeep.missing_in_index(d.select(path.alias("path")).distinct(), lines)


@query("pdf_original_urls", """
WITH s AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN page_id % 2 = 0 THEN '/pdf/' || (page_id % 50) ELSE '' END AS pdf, '/raw/' || page_id AS raw FROM pages WHERE trim(coalesce(url, '')) <> ''),
k AS (SELECT page_id, 0 AS i, pdf AS key, trim(url) AS url, 0 AS turn FROM s WHERE pdf <> '' UNION ALL SELECT page_id, 1, raw, trim(url), 0 FROM s),
l AS (SELECT key, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id DESC, i DESC) AS n FROM k) WHERE n = 1),
q AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/pdf/' || (page_id % 60) WHEN 1 THEN '/raw/' || page_id ELSE trim(coalesce(url, '')) END AS path FROM pages)
SELECT q.page_id AS pdf_source_id, coalesce(l.url, u.url, '') AS original_url FROM q LEFT JOIN l ON l.key = q.path
  LEFT JOIN (SELECT DISTINCT trim(url) AS url FROM s) u ON u.url = rtrim(q.path, '/')""")
def q_pdf_urls(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url")
    k = F.col("page_id")
    scraped = p.select(
        "page_id", "url", F.when(k % 2 == 0, F.concat(F.lit("/pdf/"), (k % 50).cast("string"))).alias("pdf_path"), F.concat(F.lit("/raw/"), k.cast("string"), F.lit("/")).alias("raw_html_path"),
        F.lit("").alias("meta_pdf_path"))
    asked = F.when(k % 3 == 0, F.concat(F.lit("/pdf/"), (k % 60).cast("string"))).when(k % 3 == 1, F.concat(F.lit("/raw/"), k.cast("string"))).otherwise(F.trim(F.coalesce("url", F.lit(""))))
    return upkeep.original_urls(p.select(k.alias("pdf_source_id"), asked.alias("source_path")), scraped, "page_id").select("pdf_source_id", "original_url")


@query("section_lists", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS p FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, '|' ORDER BY p) AS sections FROM f GROUP BY 1""")
def q_sections(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("section_path"))
    return upkeep.ordered_distinct(e, "user_id", "event_id", "section_path", "sections").withColumn("sections", F.array_join("sections", "|"))


@query("store_rows", """
SELECT doc_id, 'd' || sha1(doc_id || ':' || source) AS id, translate(text, chr(1) || chr(127), '  ') AS text, CASE WHEN doc_id % 3 = 0 THEN source || '|' || lang WHEN doc_id % 3 = 1 THEN source ELSE '' END AS source_ids FROM documents""")
def q_store(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "source", "lang")
    k = F.col("doc_id") % 3
    ids = F.when(k == 0, F.to_json(F.array("source", "lang"))).when(k == 1, F.col("source")).otherwise("")
    return d.select(
        "doc_id", upkeep.store_id(F.concat_ws(":", "doc_id", "source")).alias("id"), upkeep.store_text(F.col("text")).alias("text"), F.array_join(upkeep.source_id_list(ids), "|").alias("source_ids"))


@query("failure_records", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'own' ELSE 'u' || event_id END AS url, event_type AS reason, user_id::VARCHAR AS mode FROM events WHERE event_type = 'error'""")
def q_failures(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    mode = F.create_map(F.lit("mode"), F.col("user_id").cast("string"))
    context = F.when(F.col("user_id") % 2 == 0, F.map_concat(mode, F.create_map(F.lit("url"), F.lit("own")))).otherwise(mode)
    record = upkeep.failure_record(F.concat(F.lit("u"), "event_id"), F.col("event_type"), context)
    return e.select("event_id", record.alias("r")).select("event_id", *[F.col("r")[k].alias(k) for k in ("url", "reason", "mode")])
