"""Whole runs over the tables: index builds, sidecars, packets, ingest reports, and the helpers they use."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.catalog import answers as A
from corvane.catalog import quality as Q
from corvane.catalog import sqltext as S
from corvane.catalog.corpus import QUESTIONS, TFIDF, index_rows, questions
from corvane.catalog.crawling import _KEPT, POLICY, pages
from corvane.catalog.documents import TOPIC_SQL
from corvane.catalog.registry import query, table
from corvane.functions import leadership as L
from corvane.functions import text as X
from corvane.functions.vectors import digest_chain_embedding, fit_dimensions, hashed_tokens_embedding
from corvane.operators import confidence, crawl, metrics, retrieval
from corvane.plans import ask, index, ingest, maintenance
from corvane.session import run_dir, through_table
from corvane.sources import files, sidecars

NOW = "2026-03-01T00:00:00Z"


# ------------------------------------------------------------------- index builds
def _written(spark, sf, again: bool = False) -> tuple:
    """An index of the catalogue corpus with its manifest; ``again`` builds it over a previous one that lacks some chunks."""
    rows = A.ranked_docs(spark, sf).withColumn("checksum", F.sha2("text", 256))
    embed = hashed_tokens_embedding(A.DIMS)
    new, previous = run_dir(spark, "index"), None
    if again:
        # the previous index had other texts for every fifth chunk and none for every seventh
        before = rows.withColumn("checksum", F.when(F.crc32("id") % 5 == 0, "other").otherwise(F.col("checksum"))).filter(F.crc32("id") % 7 != 0)
        old = run_dir(spark, "index-before")
        index.write_index(index.build(before, embed, dimensions=A.DIMS), old, A.DIMS, NOW)
        previous = index.read_documents(spark, old)
    index.write_index(index.build(rows, embed, previous, dimensions=A.DIMS), new, A.DIMS, NOW)
    return index.read_documents(spark, new), index.read_manifest(spark, new), embed


@query("index_manifest_counts", f"""
WITH {S.INDEX}, f AS (SELECT count(*) FILTER (corpus = 'raw') AS raw, count(*) FILTER (corpus = 'wiki') AS wiki FROM idx),
t AS (SELECT count(DISTINCT term) AS terms FROM (SELECT unnest({S.toks('text')}) AS term FROM idx))
SELECT unnest(['raw_index_count', 'wiki_index_count', 'term_count', 'vector_dimensions', 'vector_leg_enabled', 'counts_add_up']) AS figure,
  unnest([raw, wiki, terms, {A.DIMS}, 1, 1]) AS n FROM f, t""")
def q_manifest(spark, sf):
    """Figures of a manifest read back, of a build that kept what it could of the one before."""
    _, manifest, _ = _written(spark, sf, again=True)
    both = manifest["changed_document_count"] + manifest["skipped_document_count"] == manifest["raw_index_count"] + manifest["wiki_index_count"]
    figures = [(k, int(manifest[k])) for k in ("raw_index_count", "wiki_index_count", "term_count", "vector_dimensions", "vector_leg_enabled")]
    return spark.createDataFrame([*figures, ("counts_add_up", int(both and 0 < manifest["changed_document_count"] < manifest["raw_index_count"] + manifest["wiki_index_count"]))], "figure string, n bigint")


@query("asked_index_evidence", f"""
{A.CHAIN}, {A.RERANK}, {A.EVIDENCE}
SELECT qid, rank::INTEGER AS rank, id, path, combined FROM evidence""")
def q_asked(spark, sf):
    """An index built, written, read and asked; the evidence of every question."""
    docs, manifest, embed = _written(spark, sf)
    _, evidence = ask.query_index(docs, questions(spark, sf), embed, manifest, A.DIMS)
    return evidence.select("qid", "rank", "id", "path", "combined")


@query("asked_index_statuses", f"""
{A.CHAIN}, {A.RERANK}, {A.EVIDENCE}
SELECT q.qid, 'ok' AS status, '' AS reason, count(e.id) AS evidence_count FROM questions q JOIN evidence e USING (qid) GROUP BY 1
UNION ALL SELECT qid, 'insufficient_evidence', 'no_related_candidates', 0 FROM questions WHERE qid NOT IN (SELECT qid FROM evidence)
UNION ALL SELECT qid + 1000000, 'ok', 'empty_query_or_zero_limit', 0 FROM questions
UNION ALL SELECT qid + 2000000, 'embedding_unavailable', 'embedding_dimension_mismatch', NULL FROM questions
UNION ALL SELECT qid + 3000000, 'missing_index', 'missing_index', NULL FROM questions""")
def q_statuses(spark, sf):
    """Statuses of questions with evidence, of blank ones, and of an index that is unfit or not there."""
    docs, manifest, embed = _written(spark, sf)
    asked = questions(spark, sf)
    blank = asked.select((F.col("qid") + 1_000_000).alias("qid"), F.lit(" ?! ").alias("query"))
    first, _ = ask.query_index(docs, asked.unionByName(blank), embed, manifest, A.DIMS)
    unfit, _ = ask.query_index(docs, asked.withColumn("qid", F.col("qid") + 2_000_000), embed, manifest, A.DIMS + 1)
    gone, _ = ask.query_index(docs, asked.withColumn("qid", F.col("qid") + 3_000_000), embed, {}, A.DIMS)
    cols = ("qid", "status", "reason")
    count = F.lit(None).cast("bigint").alias("evidence_count")
    return first.select(*cols, "evidence_count").unionByName(unfit.select(*cols, count)).unionByName(gone.select(*cols, count))


@query("source_search_top5", f"""
WITH {S.INDEX}, {QUESTIONS}, {A.RDOCS}, {TFIDF.replace('FROM idx', "FROM (SELECT * FROM idx WHERE corpus = 'raw')")},
planned AS (SELECT qid, query, 'none' AS query_type, '' AS education_level, '' AS role, '' AS intent, '' AS academic_interest FROM questions),
dr AS (SELECT * FROM rdocs WHERE corpus = 'raw'),
{A.hashed_sql('dvec', 'dr', 'id', "title || chr(10) || text")},
fused AS (SELECT qid, id, score AS lexical, NULL::DOUBLE AS bm25, NULL::DOUBLE AS retrieval_vector, NULL::VARCHAR AS reason, rank AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM tfidf) WHERE rank <= 50), {A.RERANK}
SELECT qid, rank::INTEGER AS rank, id, path, combined FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {A.ORDER}) AS rank FROM reranked) WHERE rank <= 5""")
def q_sources(spark, sf):
    """Raw sources alone, where several chunks of one path may stay."""
    docs = A.built_index(spark, sf)
    found = ask.search_sources(docs, questions(spark, sf), hashed_tokens_embedding(A.DIMS))
    return found.select("qid", "rank", "id", "path", "combined")


@query("model_reranked", f"""
{A.CHAIN}, {A.RERANK},
m AS (SELECT qid, id, (length(id) % 5) / 4.0 AS ms, row_number() OVER (PARTITION BY qid ORDER BY length(id) % 5 DESC, id) AS mr FROM reranked WHERE length(id) % 2 = 0),
j AS (SELECT r.* EXCLUDE (combined), ms, mr, CASE WHEN ms IS NOT NULL THEN round(ms + 0.05::DOUBLE * citation + 0.02::DOUBLE * CASE WHEN updated_at <> '' THEN 0.05 ELSE 0 END, 6) ELSE combined END AS combined
  FROM reranked r LEFT JOIN m USING (qid, id))
SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY ms IS NULL, mr, {A.ORDER}))::INTEGER AS place, combined::DOUBLE AS combined, ms IS NOT NULL AS by_model FROM j""")
def q_model(spark, sf):
    """Candidates put in the order of a model that knows half of them."""
    rows = through_table(A._reranked(spark, sf), "reranked")
    value = F.length("id") % 5
    first = Window.partitionBy("qid").orderBy(value.desc(), "id")
    model = rows.filter(F.length("id") % 2 == 0).select("qid", "id", (value / 4.0).alias("model_score"), F.row_number().over(first).alias("model_rank"))
    merged = retrieval.merge_model_scores(rows, model)
    return merged.select("qid", "id", "place", "combined", (F.get("ranking_reasons", F.lit(0)) == "model_rerank").alias("by_model"))


_PERSON_SQL = L.PERSON_FIRST.replace(r"(?<!Associate\s)", "").replace("'", "''")
_OFFICE_SQL = L.OFFICE_FIRST.replace(r"(?<!Associate\s)", "").replace("'", "''")
_NEXT_SQL = L.NEXT_PERSON.replace("'", "''")


def _holder(pattern: str, name: int, office: int, role: int, joiner: str) -> str:
    part = lambda group: f"trim(regexp_extract(hay, '(?i){pattern}', {group}))"
    return (
        f"{{'name': {part(name)}, 'office': {part(office)}, 'joiner': '{joiner}', "
        f"'role': trim(regexp_split_to_array({part(role)}, '{_NEXT_SQL}')[1], ' ,;:-')}}")


def _usable(m: str) -> str:
    return f"{m}.name <> '' AND len(regexp_split_to_array({m}.name, '\\s+')) >= 2 AND length({m}.role) >= 8"


@query("office_holders", rf"""
WITH e AS (SELECT c_nationkey AS qid, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank, CASE c_custkey % 5
   WHEN 0 THEN 'Open day for all' WHEN 1 THEN 'Meet our alumni networking group, Ann B. Lee, Director of Events and Fairs.' WHEN 2 THEN 'Ann B. Lee, Dean of Arts.'
   WHEN 3 THEN 'Jo ' || c_mktsegment || ' Roe, Ph.D., Program Director of ' || lower(c_mktsegment) || ' studies Max Q. Poe, Ph.D. and others.' ELSE 'Mia C. Tan - Head of the ' || c_mktsegment || ' laboratory; more' END AS snippet FROM customer),
h AS (SELECT *, 'People' || chr(10) || snippet AS hay FROM e WHERE rank <= 8),
f AS (SELECT *, {_holder(_PERSON_SQL, 1, 2, 3, ' is ')} AS one, {_holder(_OFFICE_SQL, 3, 1, 2, ' — ')} AS two FROM h WHERE NOT regexp_matches(hay, '(?i){L.SOCIAL_EVENT}')),
g AS (SELECT qid, rank, c_custkey, CASE WHEN {_usable('one')} THEN one WHEN {_usable('two')} THEN two END AS m FROM f)
SELECT qid, m.name, m.role, m.office, m.name || m.joiner || m.office || ' of ' || m.role || '.' AS answer, 'c' || c_custkey AS source_id
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM g WHERE m IS NOT NULL) WHERE n = 1""")
def q_holders(spark, sf):
    """The first of eight evidence rows of a question that names who holds an office."""
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    snippet = (
        F.when(k % 5 == 0, "Open day for all").when(k % 5 == 1, "Meet our alumni networking group, Ann B. Lee, Director of Events and Fairs.").when(k % 5 == 2, "Ann B. Lee, Dean of Arts.")
        .when(k % 5 == 3, F.concat(F.lit("Jo "), segment, F.lit(" Roe, Ph.D., Program Director of "), F.lower(segment), F.lit(" studies Max Q. Poe, Ph.D. and others.")))
        .otherwise(F.concat(F.lit("Mia C. Tan - Head of the "), segment, F.lit(" laboratory; more"))))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    evidence = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("qid"), rank.alias("rank"), F.lit("People").alias("title"), snippet.alias("snippet"), F.lit("p").alias("path"), F.concat(F.lit("c"), k).alias("source_id"))
    return confidence.office_holder(evidence).select("qid", "holder.name", "holder.role", "holder.office", "holder.answer", "holder.source_id")


# ---------------------------------------------------------------- files and registry
@query("markdown_tree", """
SELECT source || '/' || doc_id || '.md' AS path, length(text) AS chars, sha256(text) AS checksum, octet_length(encode(text))::BIGINT AS size_bytes FROM documents""")
def q_tree(spark, sf):
    """A markdown file for every document, written by tasks and scanned again."""
    root = run_dir(spark, "tree")
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    files.write_markdown_tree(d.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text"), root)
    return files.read_markdown_tree(spark, root).select("path", F.length("text").cast("bigint").alias("chars"), "checksum", F.col("size_bytes").cast("bigint").alias("size_bytes"))


_MARKED = """CASE WHEN doc_id % 9 = 0 THEN '../' || doc_id || '.md' WHEN doc_id % 10 = 0 THEN 'raw/none-' || doc_id || '.md' ELSE 'raw/' || doc_id || '.md' END"""


def _raw(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "source", "lang")
    k = F.col("doc_id")
    path = F.when(k % 9 == 0, F.concat(F.lit("../"), k, F.lit(".md"))).when(k % 10 == 0, F.concat(F.lit("raw/none-"), k, F.lit(".md"))).otherwise(F.concat(F.lit("raw/"), k, F.lit(".md")))
    rows = d.select(
        F.concat(F.lit("web_"), k).alias("source_id"), path.alias("markdown_path"), F.when(k % 8 == 0, "failed").otherwise("Ready").alias("status"), F.lit("web").alias("source_kind"),
        F.when(k % 6 == 0, "").otherwise(F.col("source")).alias("title"), F.lit("web.markdown").alias("parser"), F.lit("").alias("original_url"),
        F.when(k % 4 == 0, "").otherwise(NOW).alias("last_changed_at"), F.lit("2026-01-01").alias("last_seen_at"))
    return index.raw_chunks(rows, d.filter(k % 10 != 0).select(F.concat(F.lit("raw/"), k, F.lit(".md")).alias("path"), "text"))


@query("raw_index_chunks", f"""
WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN 'web_' || doc_id ELSE source END AS title, sha256(text) AS file_checksum,
  CASE WHEN doc_id % 4 = 0 THEN '2026-01-01' ELSE '{NOW}' END AS updated_at FROM documents WHERE doc_id % 8 <> 0 AND doc_id % 9 <> 0 AND doc_id % 10 <> 0),
{S.chunk_ctes('r')} SELECT 'raw:web_' || doc_id || ':' || chunk_index AS id, title, file_checksum AS checksum, updated_at, text FROM chunks""")
def q_raw_chunks(spark, sf):
    return _raw(spark, sf)[0].select("id", "title", "checksum", "updated_at", "text")


@query("raw_index_invalid", f"""
SELECT 'web_' || doc_id AS source_id, {_MARKED} AS path, CASE WHEN doc_id % 9 = 0 THEN 'path_escapes_site_root' ELSE 'raw_source_missing' END AS reason
FROM documents WHERE doc_id % 8 <> 0 AND (doc_id % 9 = 0 OR doc_id % 10 = 0)""")
def q_raw_invalid(spark, sf):
    return _raw(spark, sf)[1]


@query("json_documents", """
SELECT doc_id, source, lang FROM documents""")
def q_json(spark, sf):
    """Whole-file JSON arrays of two hundred rows each, some with more after the array, others that are no objects."""
    root = run_dir(spark, "json")
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    parts = max(1, d.count() // 200)
    arrays = d.groupBy(F.pmod("doc_id", F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "source", "lang"))).alias("value"))
    odd = F.when(F.col("part") % 3 == 0, F.concat("value", F.lit("\n[{\"doc_id\": -1}] trailing"))).when(F.col("part") % 3 == 1, F.concat(F.lit("[7, null, "), F.substring("value", 2, 2_000_000_000))).otherwise(F.col("value"))
    arrays.select("part", odd.alias("value")).write.partitionBy("part").text(root)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType())])
    return files.read_json_document(spark, root, schema)


@query("latest_report", """
SELECT count(*) AS events, min(event_id) AS first_event FROM events WHERE event_type = 'purchase'""")
def q_latest(spark, sf):
    """Reports written one after another; the newest that parses counts, not the broken one after it."""
    root = run_dir(spark, "reports")
    e = table(spark, sf, "events")
    for kind in ("view", "purchase", None):
        value = F.to_json(F.struct(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event")))
        row = e.agg(F.lit("{broken").alias("value")) if kind is None else e.filter(F.col("event_type") == kind).agg(value.alias("value"))
        row.select("value").write.mode("append").text(root)
    newest = files.latest_report(spark, root, "part-*")
    return newest.select(F.from_json("value", "events bigint, first_event bigint").alias("r")).select("r.*")


@query("pruned_registry", """
WITH cur AS (SELECT 'old_' || doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'web' END AS source_kind, doc_id // 10 AS pdf, doc_id FROM documents)
SELECT source_id, source_kind FROM cur WHERE NOT (source_kind = 'pdf' AND pdf IN (SELECT doc_id // 10 FROM documents WHERE doc_id % 20 < 10 AND doc_id % 2 = 0)
  AND NOT (doc_id % 20 < 10 AND doc_id % 4 = 0))""")
def q_pruned(spark, sf):
    """Old rows of a PDF go when a batch brings the PDF under new ids, unless the batch has the row itself."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents", "doc_id")
    pdf = F.create_map(F.lit("pdf_source_id"), F.concat(F.lit("pdf"), F.expr("doc_id div 10")))
    current = d.select(F.concat(F.lit("old_"), k).alias("source_id"), F.when(k % 3 == 0, "pdf").otherwise("web").alias("source_kind"), pdf.alias("provenance"))
    batch = d.filter((k % 20 < 10) & (k % 2 == 0)).select(
        F.concat(F.when(k % 4 == 0, "old_").otherwise("new_"), k).alias("source_id"), F.lit("pdf").alias("source_kind"), pdf.alias("provenance"))
    return ingest.prune_replaced(current, batch).select("source_id", "source_kind")


@query("reconciled_jobs", """
SELECT o_orderkey, CASE WHEN running AND NOT alive THEN 'stale' ELSE status END AS job_status, running AND NOT alive AS stale_running
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Running' WHEN 'F' THEN 'done' ELSE 'running' END AS status, o_orderstatus <> 'F' AS running, coalesce(o_orderkey % 4 = 0, false) AND o_orderkey % 3 <> 0 AS alive FROM orders)""")
def q_reconciled(spark, sf):
    k = F.col("o_orderkey")
    jobs = table(spark, sf, "orders").select(
        k, F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"),
        F.when(k % 3 != 0, k % 4 == 0).alias("session_alive"))
    return metrics.reconcile(jobs).select("o_orderkey", "job_status", "stale_running")


@query("urls_to_scrape", f"""
WITH {POLICY}, d AS (SELECT p.url, page_id, 'map-' || (page_id % 7) AS source_sitemap, 'cat-' || (page_id % 4) AS path_category, {_KEPT} AS kept, scheme, netloc FROM policy p JOIN u USING (page_id))
SELECT url, source_sitemap, path_category FROM d WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 17 <> 0 AND kept AND scheme IN ('http', 'https') AND netloc <> ''
UNION ALL SELECT 'https://new.example.org/p/' || page_id, 'approved', 'other' FROM d WHERE page_id % 10 = 0""")
def q_to_scrape(spark, sf):
    """Approved URLs joined with the discovered ones; unknown ones stay, refused and unfit ones go."""
    k = F.col("page_id")
    rows = pages(spark, sf).select(
        "url", F.concat(F.lit("map-"), k % 7).alias("source_sitemap"), F.concat(F.lit("cat-"), k % 4).alias("path_category"), (k % 5 != 0).alias("selected"),
        F.when(k % 17 == 0, "operator_rejected_area").alias("excluded_reason"))
    new = pages(spark, sf).filter(k % 10 == 0)
    approved = pages(spark, sf).filter(k % 3 == 0).select("url").unionByName(new.select(F.concat(F.lit("https://new.example.org/p/"), k).alias("url"))).unionByName(
        new.select(F.concat(F.lit("mailto:p"), k, F.lit("@example.org")).alias("url")))
    return crawl.urls_to_scrape(rows, approved).select("url", "source_sitemap", "path_category")


# --------------------------------------------------------------------- small functions
@query("slugs", r"""
SELECT doc_id, trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '_', 'g'), '_') AS token FROM documents""")
def q_slugs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text", "source", "lang").select(
        "doc_id", X.slug(F.substring("text", 1, 80)).alias("slug"), X.slug(F.concat_ws(" / ", "source", "lang"), "_").alias("token"))


@query("digest_vectors", """
WITH s AS (SELECT doc_id, unhex(sha256(text)) AS seed FROM documents),
b1 AS (SELECT *, unhex(sha256(seed || seed)) AS x1 FROM s), b2 AS (SELECT *, unhex(sha256(x1 || seed)) AS x2 FROM b1), b3 AS (SELECT *, unhex(sha256(x2 || seed)) AS x3 FROM b2),
h AS (SELECT doc_id, substring(hex(x1) || hex(x2) || hex(x3), 1, 160) AS t FROM b3),
v AS (SELECT doc_id, i, (('0x' || substring(t, 2 * i + 1, 2))::INT) / 127.5 - 1.0 AS x FROM h, range(80) u(i))
SELECT doc_id, i::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def q_digest_vectors(spark, sf):
    """The degraded embedding: bytes of a chain of digests, at unit length."""
    d = table(spark, sf, "documents", "doc_id", "text").select("doc_id", digest_chain_embedding(80)(F.col("text")).alias("v"))
    return d.select("doc_id", F.posexplode("v").alias("pos", "value"))


@query("fitted_vectors", """
WITH e AS (SELECT vec_id, w, i, CASE WHEN i < len(embedding) THEN embedding[i + 1]::DOUBLE ELSE 0.0 END AS x
  FROM embeddings, (VALUES (48), (80)) s(w), range(80) u(i) WHERE i < w)
SELECT vec_id, w AS dimensions, i::INTEGER AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id, w)), 6) + 0.0 AS value FROM e""")
def q_fitted(spark, sf):
    """Vectors cut and padded to other dimensions, at unit length."""
    v = table(spark, sf, "embeddings")
    both = [v.select("vec_id", F.lit(w).alias("dimensions"), F.posexplode(fit_dimensions(F.col("embedding"), w)).alias("pos", "value")) for w in (48, 80)]
    rows = both[0].unionByName(both[1])
    return rows.withColumn("value", F.col("value") + 0.0)


# ------------------------------------------------------------------------- sidecars
def _sidecar(spark, sf, late: bool):
    """JSON text beside each document; the late one is written differently for some and changed for others."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    plain = F.concat(F.lit('{"pages": '), k % 9, F.lit(', "parser": "'), F.col("source"), F.lit('"}'))
    turned = F.concat(F.lit('{ "parser":"'), F.col("source"), F.lit('",\n "pages":'), k % 9, F.lit(" }"))
    changed = F.concat(F.lit('{"pages": '), k % 9 + 1, F.lit(', "parser": "'), F.col("source"), F.lit('"}'))
    text = F.when(k % 11 == 0, F.concat(F.lit("["), k, F.lit(", 1]"))).when(k % 13 == 0, F.lit("{broken"))
    text = text.when(F.lit(late) & (k % 3 == 0), turned).when(F.lit(late) & (k % 5 == 0), changed).otherwise(plain)
    return sidecars.parse_sidecars(d.filter(k % 17 != 0).select(F.concat(k, F.lit(".json")).alias("path"), text.alias("content")))


@query("sidecar_reuse", """
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '{"value":[' || doc_id || ',1]}' WHEN doc_id % 13 = 0 THEN '{}'
   ELSE '{"pages":' || (doc_id % 9 + CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN 1 ELSE 0 END) || ',"parser":"' || source || '"}' END AS metadata,
  NOT (doc_id % 17 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 = 0) AND doc_id % 19 <> 0 AS reused FROM documents""")
def q_sidecars(spark, sf):
    """Chunks keep their vectors if neither text nor the content of the sidecar changed, however it is written."""
    d = table(spark, sf, "documents", "doc_id", "text")
    chunks = d.select(
        "doc_id", F.concat(F.lit("raw:"), "doc_id").alias("id"), F.sha2("text", 256).alias("checksum"), F.lit("1600/200").alias("chunk_settings"),
        F.concat("doc_id", F.lit(".json")).alias("metadata_path"))
    old = sidecars.with_sidecars(chunks, _sidecar(spark, sf, False)).withColumns({
        "index_version": F.lit(index.INDEX_VERSION), "embedding_space": F.lit(index.DENSE), "vector": F.array(F.lit(1.0), F.lit(0.0)),
        "checksum": F.when(F.col("doc_id") % 19 == 0, "other").otherwise(F.col("checksum"))})
    late = through_table(_sidecar(spark, sf, True), "sidecars")
    kept, changed = index.split_reusable(sidecars.with_sidecars(chunks, late), old, 2)
    both = kept.select("doc_id", "metadata_path", F.lit(True).alias("reused")).unionByName(changed.select("doc_id", "metadata_path", F.lit(False).alias("reused")))
    said = late.select(F.col("path").alias("metadata_path"), F.to_json("metadata").alias("metadata"))
    return both.join(said, "metadata_path", "left").select("doc_id", "metadata", "reused")


# -------------------------------------------------------------------------- packets
def _packets(spark, sf):
    """Seven packets of stale pages; one fails in its second table and is tried again, one is committed twice."""
    store = maintenance.PacketStore(spark, run_dir(spark, "packets"), maintenance.STALE_TABLES, most_open=3)
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    k = F.col("doc_id")
    for n in range(7):
        part = d.filter(k % 7 == n)
        source = F.concat(F.lit("raw_"), k).alias("source_id")
        before = part.select(source, F.sha2("text", 256).alias("content_hash"))
        after = part.filter(k % 11 != 0).select(source, F.sha2(F.when(k % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
        edges = part.select(source, F.explode(F.array(F.concat(F.lit("page_"), "source"), F.concat(F.lit("page_"), F.expr("doc_id div 20")))).alias("page_id")).distinct()
        tables = maintenance.stale_packet(before, after, edges)
        if n == 3:
            fails = F.when(F.col("changed_sources") > 0, F.raise_error(F.lit("no space left")).cast("bigint")).otherwise(F.col("changed_sources"))
            try:
                store.commit(f"run-{n}", {**tables, "stale_pages": tables["stale_pages"].withColumn("changed_sources", fails)})
            except Exception as exc:
                if "no space left" not in str(exc):
                    raise
        store.commit(f"run-{n}", tables)
        if n == 2:
            store.commit(f"run-{n}", tables)
    return store


_STALE = """
t AS (SELECT 'run-' || (doc_id % 7) AS packet_id, doc_id, 'raw_' || doc_id AS source_id, sha256(text) AS old_hash, sha256(text || '!') AS new_hash, source FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 3 = 0),
l AS (SELECT DISTINCT packet_id, source_id, new_hash, unnest(['page_' || source, 'page_' || (doc_id // 20)]) AS page_id FROM t)"""


@query("maintenance_transitions", f"""
WITH {_STALE} SELECT t.packet_id, t.source_id, old_hash, t.new_hash, count(DISTINCT page_id) AS affected_pages, 'source_hash_changed' AS reason FROM t JOIN l USING (packet_id, source_id) GROUP BY ALL""")
def q_transitions(spark, sf):
    return _packets(spark, sf).read("transitions")


@query("maintenance_pages", f"""
WITH {_STALE} SELECT packet_id, page_id, count(*) AS changed_sources, min(source_id) AS first_source_id, max(source_id) AS last_source_id, string_agg(source_id || '=' || substring(new_hash, 1, 8), ',' ORDER BY source_id) AS sources
FROM l GROUP BY ALL""")
def q_packet_pages(spark, sf):
    store = _packets(spark, sf)
    hashes = store.read("source_map").groupBy("packet_id", "page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", F.substring("hash", 1, 8).alias("h")))), lambda x: F.concat(x["source_id"], F.lit("="), x["h"])), ",").alias("sources"))
    return store.read("stale_pages").join(hashes, ["packet_id", "page_id"])


# ---------------------------------------------------------------------- ingest report
@query("ingest_stage_totals", rf"""
WITH {Q.ASSESS},
a AS (SELECT assessed.*, source, CASE WHEN action = 'quarantined' THEN 'failed' WHEN action = 'needs_review' THEN 'needs-review' ELSE 'ready' END AS st,
    CASE WHEN action = 'cleaned' THEN cleaned_text ELSE assessed.text END AS stored FROM assessed JOIN documents USING (doc_id) WHERE doc_id % 19 <> 0),
f AS (SELECT sha256(stored) AS ck, min(doc_id) AS first FROM a WHERE st = 'ready' GROUP BY 1),
m AS (SELECT a.*, CASE WHEN st = 'ready' AND first <> doc_id THEN 'needs-review' ELSE st END AS status FROM a LEFT JOIN f ON ck = sha256(stored)),
c AS (SELECT CASE WHEN status = 'ready' THEN 'new' ELSE status END AS change_state, status FROM m),
n AS (SELECT unnest(list_distinct([change_state, status])) AS figure FROM c),
p AS (SELECT doc_id, {TOPIC_SQL} AS slug FROM (SELECT *, lower(source || chr(10) || 'https://x.edu/' || source || '/' || doc_id || chr(10) || substring(stored, 1, 1000)) AS h FROM m WHERE status = 'ready'))
SELECT 'normalize' AS stage, unnest(['rows', 'failed', 'needs_review', 'characters']) AS figure,
  unnest([count(*), count(*) FILTER (st = 'failed'), count(*) FILTER (st = 'needs-review'), coalesce(sum(length(stored)) FILTER (st <> 'failed'), 0)::BIGINT]) AS n FROM a
UNION ALL SELECT 'merge', figure, count(*) FROM n GROUP BY figure
UNION ALL SELECT 'pages', 'page_pieces', count(*) FROM p""")
def q_ingest(spark, sf):
    """Totals of the stages of an ingest run over the documents, counted by the stages' own writes."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    manifest = d.select(
        k.alias("pos"), F.concat(F.lit("https://x.edu/"), "source", F.lit("/"), k).alias("url"), F.when(k % 19 == 0, "failed").otherwise("success").alias("status"),
        F.col("text").alias("markdown"), F.concat(F.lit("run/"), k, F.lit(".md")).alias("markdown_path"))
    wiki = d.filter(k % 50 == 0).select(F.concat(F.lit("wiki/pages/"), k, F.lit(".md")).alias("path"), "text")
    empty = spark.createDataFrame([], "source_id string, checksum string")
    report = ingest.ingest(empty, manifest, wiki, hashed_tokens_embedding(64), run_dir(spark, "site"), NOW, "run", dimensions=64)
    if report["status"] != "complete":
        raise RuntimeError(json.dumps(report))
    return ingest.stage_totals(spark, report).filter("stage IN ('normalize', 'merge') OR figure = 'page_pieces'")
