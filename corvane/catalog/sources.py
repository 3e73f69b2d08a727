"""Registry merge, upserts, lineage and lint over derived source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.registry import query, table
from corvane.operators import lineage, registry, relational

T0, T1 = "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"


def previous(spark, sf):
    """Registry before the batch: every document but those first seen in it."""
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    k = F.col("doc_id")
    return d.filter(k % 11 != 0).select(
        F.concat(F.lit("raw_"), k).alias("source_id"), F.lit("web").alias("source_kind"), F.col("source").alias("title"),
        F.sha2("text", 256).alias("checksum"), F.when(k % 7 == 0, "needs-review").otherwise("ready").alias("status"),
        F.lit(T0).alias("first_seen_at"), F.lit(T0).alias("last_seen_at"), F.lit(T0).alias("last_changed_at"),
        F.when(k % 2 == 0, "integrated").otherwise("pending").alias("wiki_status"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("wiki/pages/"), "source", F.lit(".md")))).alias("wiki_page_paths"))


def incoming(spark, sf):
    """The batch: some texts edited, some failed, some not seen again."""
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    k = F.col("doc_id")
    text = F.when(k % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return d.filter(k % 13 != 0).select(
        k.alias("pos"), F.concat(F.lit("raw_"), k).alias("source_id"), F.lit("web").alias("source_kind"),
        F.col("source").alias("title"), F.sha2(text, 256).alias("checksum"),
        F.when(k % 23 == 0, "failed").otherwise("ready").alias("status"),
        F.when(k % 23 == 0, "parse failed").alias("error_reason"))


MERGE = f"""
prev AS (SELECT 'raw_' || doc_id AS source_id, sha256(text) AS checksum, CASE WHEN doc_id % 7 = 0 THEN 'needs-review' ELSE 'ready' END AS status,
   CASE WHEN doc_id % 2 = 0 THEN 'integrated' ELSE 'pending' END AS wiki_status, CASE WHEN doc_id % 2 = 0 THEN 'wiki/pages/' || source || '.md' ELSE '' END AS paths
  FROM documents WHERE doc_id % 11 <> 0),
inc0 AS (SELECT doc_id, 'raw_' || doc_id AS source_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END) AS checksum,
   CASE WHEN doc_id % 23 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents WHERE doc_id % 13 <> 0),
firsts AS (SELECT checksum, arg_min(source_id, doc_id) AS first_id FROM inc0 WHERE status = 'ready' GROUP BY checksum),
inc AS (SELECT i.source_id, i.checksum, CASE WHEN status = 'ready' AND first_id <> source_id THEN 'needs-review' ELSE status END AS status,
   CASE WHEN status = 'failed' THEN 'parse failed' WHEN first_id <> source_id THEN 'duplicate_checksum:' || first_id ELSE '' END AS error_reason
  FROM inc0 i LEFT JOIN firsts f USING (checksum)),
cases AS (SELECT coalesce(p.source_id, i.source_id) AS source_id, p.source_id IS NOT NULL AS had, i.source_id IS NOT NULL AS touched,
   p.checksum AS pc, i.checksum AS ic, p.status AS ps, i.status AS ist, p.wiki_status AS pw, coalesce(p.paths, '') AS paths, coalesce(i.error_reason, '') AS ie,
   CASE WHEN i.source_id IS NULL THEN 'keep' WHEN i.status <> 'ready' THEN 'bad' WHEN p.source_id IS NULL THEN 'new' WHEN p.checksum = i.checksum THEN 'same' ELSE 'changed' END AS c
  FROM prev p FULL JOIN inc i USING (source_id)),
merged AS (SELECT source_id, touched, CASE WHEN c IN ('keep', 'same') THEN pc ELSE ic END AS checksum, CASE WHEN c IN ('keep', 'same') THEN ps ELSE ist END AS status,
   CASE c WHEN 'bad' THEN ist WHEN 'new' THEN 'new' WHEN 'same' THEN 'unchanged' WHEN 'changed' THEN 'changed' ELSE CASE WHEN ps = 'ready' THEN 'new' ELSE ps END END AS change_state,
   CASE WHEN had THEN '{T0}' ELSE '{T1}' END AS first_seen_at, CASE c WHEN 'keep' THEN '{T0}' ELSE '{T1}' END AS last_seen_at,
   CASE WHEN c IN ('keep', 'same') THEN '{T0}' ELSE '{T1}' END AS last_changed_at,
   CASE c WHEN 'keep' THEN pw WHEN 'same' THEN pw WHEN 'changed' THEN 'pending' WHEN 'bad' THEN coalesce(pw, 'pending') ELSE 'pending' END AS wiki_status,
   CASE WHEN had THEN paths ELSE '' END AS wiki_page_paths, CASE WHEN c = 'changed' THEN pc ELSE '' END AS previous_checksum,
   CASE WHEN c IN ('keep', 'same') THEN '' ELSE ie END AS error_reason FROM cases)"""


def _merged(spark, sf):
    return registry.merge(previous(spark, sf), incoming(spark, sf), T1)


@query("registry_merge", f"WITH {MERGE} SELECT * FROM merged")
def q_merge(spark, sf):
    return _merged(spark, sf).select(
        "source_id", "touched", "checksum", "status", "change_state", "first_seen_at", "last_seen_at", "last_changed_at",
        "wiki_status", F.array_join("wiki_page_paths", ",").alias("wiki_page_paths"),
        F.coalesce("previous_checksum", F.lit("")).alias("previous_checksum"), "error_reason")


@query("registry_change_counts", f"""
WITH {MERGE} SELECT name, count(*) AS n FROM (SELECT change_state AS name FROM merged WHERE touched
 UNION ALL SELECT status FROM merged WHERE touched AND status <> change_state) GROUP BY name""")
def q_counts(spark, sf):
    return registry.change_counts(_merged(spark, sf))


@query("registry_counters", f"""
WITH {MERGE}, e AS (SELECT unnest(['source_kind', 'status', 'change_state']) AS dimension, unnest(['web', status, change_state]) AS label FROM merged
 UNION ALL SELECT 'quality_action', 'quarantined' FROM merged WHERE starts_with(error_reason, 'duplicate_checksum'))
SELECT dimension, label, count(*) AS n FROM e GROUP BY ALL""")
def q_counters(spark, sf):
    return registry.status_counters(_merged(spark, sf))


@query("wiki_progress", f"""
WITH {MERGE} SELECT 'web' AS source_kind, count(*) AS ready, count(*) FILTER (wiki_status = 'integrated') AS integrated,
 count(*) FILTER (wiki_status <> 'integrated' OR change_state = 'changed') AS pending, count(*) FILTER (change_state = 'changed') AS changed FROM merged WHERE status = 'ready'""")
def q_progress(spark, sf):
    return registry.wiki_progress(_merged(spark, sf))


@query("build_candidates", f"WITH {MERGE} SELECT source_id FROM merged WHERE status = 'ready' AND wiki_status <> 'integrated'")
def q_candidates(spark, sf):
    return registry.build_candidates(_merged(spark, sf), resume=True).select("source_id")


@query("registry_rollback", f"""
WITH {MERGE} SELECT source_id, CASE WHEN change_state = 'changed' THEN 'needs-review' ELSE status END AS status,
 CASE WHEN change_state = 'changed' THEN 'rollback:job-1' ELSE error_reason END AS error_reason FROM merged""")
def q_rollback(spark, sf):
    rows = _merged(spark, sf)
    job = rows.filter("change_state = 'changed'").select("source_id")
    return registry.roll_back(rows, job, "job-1").select("source_id", "status", "error_reason")


@query("registry_page", f"WITH {MERGE} SELECT source_id, status FROM merged ORDER BY source_id LIMIT 50 OFFSET 100")
def q_page(spark, sf):
    return registry.page(_merged(spark, sf), 100, 50).select("source_id", "status")


@query("registry_duplicates", """
WITH f AS (SELECT sha256(text) AS c, arg_min('raw_' || doc_id, doc_id) AS first_id FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN first_id <> 'raw_' || doc_id THEN 'needs-review' ELSE 'ready' END AS status,
  CASE WHEN first_id <> 'raw_' || doc_id THEN 'duplicate_checksum:' || first_id ELSE '' END AS error_reason FROM documents JOIN f ON c = sha256(text)""")
def q_reg_dups(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    rows = registry.with_defaults(d.select(
        "doc_id", F.concat(F.lit("raw_"), "doc_id").alias("source_id"), F.sha2("text", 256).alias("checksum"),
        F.lit("ready").alias("status")), T1)
    return registry.mark_duplicates(rows, "doc_id", T1).select("doc_id", "status", "error_reason")


@query("find_by_url", """
WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/+($|\\?)', '\\1') AS k, page_id % 5 <> 0 AS ready FROM pages)
SELECT page_id, (SELECT min('web_' || r.page_id) FROM c r WHERE r.ready AND r.k = c.k) AS source_id FROM c""")
def q_find(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url")
    reg = p.select(
        F.concat(F.lit("web_"), "page_id").alias("source_id"), F.col("url").alias("original_url"),
        F.when(F.col("page_id") % 5 != 0, "ready").otherwise("failed").alias("status"))
    return registry.find_by_url(reg, p).select("page_id", "source_id")


@query("upsert_last_wins", """
WITH b AS (SELECT user_id, event_type, value, event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS side FROM events)
SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY side DESC, event_id DESC) AS rn FROM b) WHERE rn = 1""")
def q_upsert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return relational.upsert(
        e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], "event_id")


@query("latest_state", """
SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("status"), "event_id")
    return relational.latest_per_key(e, ["user_id"], "event_id")


@query("unfinished_urls", """
WITH s AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT p.page_id FROM pages p LEFT JOIN s ON s.user_id = p.page_id WHERE s.event_type IS DISTINCT FROM 'purchase'""")
def q_unfinished(spark, sf):
    # resume of a scrape: pages whose latest state is not a success
    e = table(spark, sf, "events").select(F.col("user_id").alias("page_id"), "event_type", "event_id")
    states = relational.latest_per_key(e, ["page_id"], "event_id").select("page_id", "event_type")
    pages = table(spark, sf, "pages", "page_id")
    done = states.filter("event_type = 'purchase'")
    return pages.join(done, "page_id", "left_anti")


EDGES = """
edges AS (SELECT DISTINCT l_partkey AS source_id, l_orderkey AS page_id FROM lineitem),
ph AS (SELECT p_partkey AS source_id, sha256(p_name || p_type) AS old_hash,
   sha256(p_name || p_type || CASE WHEN p_size > 40 THEN p_brand ELSE '' END) AS new_hash FROM part),
changed AS (SELECT * FROM ph WHERE old_hash <> new_hash),
links AS (SELECT e.* FROM edges e JOIN changed USING (source_id))"""


def _links(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    base = F.concat("p_name", "p_type")
    old = part.select(F.col("p_partkey").alias("source_id"), F.sha2(base, 256).alias("content_hash"))
    new = part.select(F.col("p_partkey").alias("source_id"), F.sha2(
        F.concat(base, F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise("")), 256).alias("content_hash"))
    edges = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("source_id"), F.col("l_orderkey").alias("page_id")).distinct()
    changed = lineage.transitions(old, new)
    return changed, lineage.stale_links(changed, edges)


@query("stale_transitions", f"""
WITH {EDGES} SELECT c.source_id, old_hash, new_hash, count(l.page_id) AS affected_pages, 'source_hash_changed' AS reason
FROM changed c LEFT JOIN links l USING (source_id) GROUP BY ALL""")
def q_transitions(spark, sf):
    return lineage.transition_counts(*_links(spark, sf))


@query("stale_links", f"WITH {EDGES} SELECT source_id, page_id FROM links")
def q_links(spark, sf):
    return _links(spark, sf)[1]


@query("stale_pages", f"""
WITH {EDGES} SELECT page_id, count(*) AS changed_sources, min(source_id) AS first_source_id, max(source_id) AS last_source_id FROM links GROUP BY page_id""")
def q_stale_pages(spark, sf):
    return lineage.stale_pages(_links(spark, sf)[1])


@query("packet_checks", """
SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'job_id, target_page_id, and target_page_path must be non-empty'
  WHEN o_orderstatus = 'P' THEN 'unsupported stale_reason' WHEN o_orderkey % 17 = 0 THEN 'source_hashes must be a non-empty object'
  WHEN o_orderkey % 7 = 0 THEN 'evidence reference contains forbidden raw payload fields' ELSE '' END AS error FROM orders""")
def q_packets(spark, sf):
    k = F.col("o_orderkey")
    ref = F.when(k % 7 == 0, F.create_map(F.lit("payload"), F.lit("x"))).otherwise(F.create_map(F.lit("chunk_id"), F.lit("c")))
    packets = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 19 == 0, " ").otherwise("job").alias("job_id"), k.cast("string").alias("target_page_id"),
        F.concat(F.lit("pages/"), k).alias("target_page_path"),
        F.when(F.col("o_orderstatus") == "P", "other").otherwise("source_hash_changed").alias("stale_reason"),
        F.when(k % 17 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("a"), F.lit("b"))).alias("source_hashes"),
        F.array(ref).alias("evidence_refs"))
    return lineage.check_packets(packets).select("o_orderkey", "error")


def _wiki_files(spark, sf):
    """Pages with frontmatter built from the documents, one in a few without citations."""
    k = F.col("doc_id")
    head = F.concat(
        F.lit("---\ntitle: T "), k, F.lit("\nsource_ids:\n  - raw_"), k, F.lit("\n  - raw_"), k + 1,
        F.when(k % 3 == 0, "").otherwise(F.lit("\nsource_paths:\n  - raw_sources/a.md")), F.lit("\n---\n\n"))
    tail = F.when(k % 4 == 0, "\nContradiction: one of both").otherwise("\n## Sources\n")
    return table(spark, sf, "documents", "doc_id", "text").select(
        F.format_string("wiki/pages/%09d.md", k).alias("path"),
        F.concat(F.when(k % 5 == 0, F.lit("")).otherwise(head), "text", tail).alias("text"))


@query("lint_orphans", f"""
WITH {MERGE}, w AS (SELECT DISTINCT 'wiki/pages/' || source || '.md' AS path FROM documents)
SELECT path FROM w WHERE path NOT IN (SELECT wiki_page_paths FROM merged WHERE wiki_status = 'integrated' AND status = 'ready')""")
def q_orphans(spark, sf):
    pages = table(spark, sf, "documents", "source").select(
        F.concat(F.lit("wiki/pages/"), "source", F.lit(".md")).alias("path")).distinct()
    reg = _merged(spark, sf).filter("status = 'ready'")
    return lineage.orphan_pages(pages, reg)


@query("lint_missing_citations", """
SELECT printf('wiki/pages/%09d.md', doc_id) AS path FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0 OR (doc_id % 4 = 0 AND NOT contains(text, '## Sources'))""")
def q_missing(spark, sf):
    return lineage.missing_citations(_wiki_files(spark, sf))


@query("lint_contradictions", """
WITH p AS (SELECT doc_id AS k, '---' || chr(10) || 'title: T ' || doc_id || chr(10) || 'source_ids:' || chr(10) || '  - raw_' || doc_id || chr(10) || '  - raw_' || (doc_id + 1)
   || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'source_paths:' || chr(10) || '  - raw_sources/a.md' END || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS before
  FROM documents WHERE doc_id % 4 = 0 AND doc_id % 5 <> 0)
SELECT 'raw_' || CASE WHEN k % 6 = 0 THEN k + 1 ELSE k END AS source_id, printf('wiki/pages/%09d.md', k) AS path,
  (length(before) - length(replace(before, chr(10), '')) + 1)::INTEGER AS line_number, 'Contradiction: one of both' AS reason FROM p""")
def q_contradictions(spark, sf):
    queued = table(spark, sf, "documents", "doc_id").filter("doc_id % 6 = 0").select(
        F.concat(F.lit("raw_"), "doc_id").alias("source_id"))
    return lineage.contradictions(_wiki_files(spark, sf), queued)


@query("lint_stale_checksums", f"""
WITH {MERGE}, f AS (SELECT 'raw_' || doc_id AS source_id, sha256(text) AS file_sum FROM documents)
SELECT m.source_id FROM merged m JOIN f USING (source_id) WHERE status = 'ready' AND checksum <> file_sum""")
def q_stale_sums(spark, sf):
    files = table(spark, sf, "documents", "doc_id", "text").select(
        F.concat(F.lit("raw_"), "doc_id").alias("markdown_path"), F.sha2("text", 256).alias("file_checksum"))
    reg = _merged(spark, sf).withColumn("markdown_path", F.col("source_id"))
    return lineage.stale_checksums(reg, files)


@query("review_queue", """
WITH l AS (SELECT conv_id, turn, role, text, replace(replace(text, chr(10), ' '), ':', ' ') AS flat FROM conversations)
SELECT 'q' || conv_id || '-' || turn AS path, 3 AS line_number, 's' || turn AS source_id, trim(flat) AS reason,
  CASE WHEN contains(lower(flat), 'contradiction') OR contains(lower(flat), 'conflict') THEN 'contradiction' ELSE 'review' END AS type, role AS heading FROM l WHERE trim(flat) <> ''""")
def q_review(spark, sf):
    flat = F.regexp_replace("text", "[\n:]", " ")
    queue = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").select(
        F.concat(F.lit("q"), "conv_id", F.lit("-"), "turn").alias("path"),
        F.concat(F.lit("# "), "role", F.lit("\n\n- [ ] `s"), "turn", F.lit("` reason = "), flat, F.lit("\n- [x] done")).alias("text"))
    return lineage.review_items(queue)
