"""PDF pages, tables, scaffolded pages over documents and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import sqltext as S
from corvane.catalog.registry import query, table
from corvane.functions import text as X
from corvane.operators import documents as D
from corvane.operators import quality


def pdf_pages(spark, sf):
    """Documents of one source as the pages of a PDF."""
    return table(spark, sf, "documents", "doc_id", "source", "text").select(
        F.col("source").alias("pdf_source_id"), F.concat(F.lit("/data/"), "source", F.lit(".pdf")).alias("source_path"),
        F.lit("").alias("original_url"), F.col("doc_id").alias("page_number"), "text")


@query("pdf_gate", """
SELECT source AS pdf_source_id, count(*) AS page_count, sum(len(regexp_extract_all(text, '[A-Za-z0-9]')))::BIGINT AS meaningful_chars,
 CASE WHEN sum(length(text)) * 400 > 26214400 THEN 'too_large' WHEN sum(len(regexp_extract_all(text, '[A-Za-z0-9]'))) <= 8 THEN 'ocr_required'
  WHEN sum(len(regexp_extract_all(text, '[A-Za-z0-9]'))) < 80 THEN 'low_text' END AS reason FROM documents GROUP BY source""")
def q_gate(spark, sf):
    pages = pdf_pages(spark, sf)
    files = pages.groupBy("pdf_source_id").agg((F.sum(F.length("text")) * 400).alias("size_bytes"))
    return D.gate_pdfs(files, pages).select("pdf_source_id", "page_count", "meaningful_chars", "reason")


@query("pdf_page_gate", """
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]')) <= 8 THEN 'ocr_required' WHEN len(regexp_extract_all(text, '[A-Za-z0-9]')) < 80 THEN 'low_text' END AS reason FROM documents""")
def q_page_gate(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", D.low_text_reason(X.meaningful_chars(F.col("text")), F.lit(1)).alias("reason"))


@query("pdf_chunk_ids", """
WITH c AS (SELECT source, doc_id, i, substring(text, i * 1000 + 1, 1200) AS text
  FROM (SELECT source, doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents))
SELECT source || printf('-p%04d-c%04d-', doc_id, i) || substring(sha256(text), 1, 16) AS chunk_id, length(text)::INTEGER AS char_count FROM c""")
def q_chunk_ids(spark, sf):
    return D.pdf_chunks(pdf_pages(spark, sf)).select("chunk_id", "char_count")


# the greedy fold over a page's blocks, one block at a time
PARTS = rf"""
WITH RECURSIVE p AS (SELECT doc_id, source, {S.strip('text')} AS c FROM documents WHERE {S.strip('text')} <> ''),
b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(c, '\n{{2,}}'), lambda v: {S.strip('v')}), lambda v: v <> '') AS bs FROM p WHERE length(c) > 20000),
f AS (SELECT doc_id, 0 AS i, []::VARCHAR[] AS done, '' AS opened, bs FROM b
  UNION ALL SELECT doc_id, i + 1,
    CASE WHEN length(bs[i + 1]) > 20000 THEN list_concat(CASE WHEN opened <> '' THEN list_append(done, opened) ELSE done END,
        list_transform(range(0, ceil(length(bs[i + 1]) / 20000.0)::BIGINT), lambda j: {S.strip('substring(bs[i + 1], (j * 20000 + 1)::BIGINT, 20000)')}))
      WHEN opened = '' OR length(opened) + 2 + length(bs[i + 1]) <= 20000 THEN done ELSE list_append(done, opened) END,
    CASE WHEN length(bs[i + 1]) > 20000 THEN '' WHEN opened = '' OR length(opened) + 2 + length(bs[i + 1]) > 20000 THEN bs[i + 1] ELSE opened || chr(10) || chr(10) || bs[i + 1] END, bs
  FROM f WHERE i < len(bs)),
parts AS (SELECT doc_id, [c] AS ps FROM p WHERE length(c) <= 20000
  UNION ALL SELECT doc_id, list_filter(CASE WHEN opened <> '' THEN list_append(done, opened) ELSE done END, lambda v: v <> '') FROM f WHERE i = len(bs)),
x AS (SELECT doc_id, source, len(ps) AS part_count, unnest(ps) || chr(10) AS markdown, unnest(range(1, len(ps) + 1)) AS k FROM parts JOIN p USING (doc_id)),
y AS (SELECT *, CASE WHEN part_count > 1 THEN k ELSE 0 END AS part_index FROM x)"""


@query("pdf_page_parts", PARTS + """
SELECT 'pdf_' || substring(sha1('pdf:' || '/data/' || source || '.pdf#page=' || printf('%04d', doc_id) || CASE WHEN part_index > 0 THEN '-part=' || printf('%03d', part_index) ELSE '' END), 1, 16) AS source_id,
  source || '.pdf p. ' || doc_id || CASE WHEN part_index > 0 THEN ' part ' || part_index ELSE '' END AS title, part_index::INTEGER AS part_index, part_count::INTEGER AS part_count,
  sha256(markdown) AS checksum, '' AS section_path, length(markdown)::INTEGER AS char_count FROM y""")
def q_parts(spark, sf):
    return D.pdf_page_parts(pdf_pages(spark, sf), "2026-01-01T00:00:00Z").select(
        "source_id", "title", "part_index", "part_count", "checksum", "section_path", "char_count")


@query("pdf_fallbacks", """
WITH s AS (SELECT DISTINCT source AS id FROM documents WHERE doc_id % 3 = 0), c AS (SELECT source AS id, count(*) AS n, count(*) FILTER (trim(text) <> '') AS u FROM documents WHERE lang = 'en' GROUP BY 1),
q AS (SELECT DISTINCT source AS id FROM documents WHERE lang = 'fr'), p AS (SELECT DISTINCT source AS id FROM documents WHERE source IN ('src3', 'src4')),
j AS (SELECT coalesce(s.id, c.id, q.id) AS id, coalesce(n, 0) AS n, coalesce(u, 0) AS u, q.id IS NOT NULL AS inq FROM s FULL JOIN c USING (id) FULL JOIN q USING (id))
SELECT id AS pdf_source_id, n AS chunk_count, CASE WHEN n > 0 THEN 'text' ELSE 'pdf_chunks' END AS parser, CASE WHEN u > 0 THEN 'ready' ELSE 'failed' END AS status,
 CASE WHEN u > 0 THEN '' WHEN inq THEN 'low_text' WHEN n > 0 THEN 'PDF source produced no usable markdown chunks' ELSE 'PDF source produced no usable markdown' END AS error_reason
FROM j WHERE id NOT IN (SELECT id FROM p)""")
def q_fallbacks(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "lang", "text")
    key = F.col("source").alias("pdf_source_id")
    path = F.concat(F.lit("/data/"), "source").alias("path")
    sources = d.filter("doc_id % 3 = 0").select(key, path).distinct()
    chunks = d.filter("lang = 'en'").select(key, path.alias("source_path"), F.lit("text").alias("parser"), "text")
    quarantine = d.filter("lang = 'fr'").select(key, path, F.lit("low_text").alias("reason"), F.lit("").alias("detail")).distinct()
    pages = d.filter("source IN ('src3', 'src4')").select(key)
    return D.pdf_fallbacks(sources, chunks, quarantine, pages).drop("source_path")


@query("pdf_chunk_texts", f"""
SELECT source AS pdf_source_id, doc_id AS page_number, {S.strip('text')} AS text FROM documents WHERE {S.strip('text')} <> ''""")
def q_chunk_texts(spark, sf):
    return D.chunk_texts(pdf_pages(spark, sf).withColumn("chunk_index", F.lit(0))).drop("chunk_index")


def _with_tables(spark, sf):
    """Conversation texts followed by a small table of their own words."""
    words = X.tokens(F.col("text"))
    cell = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("-"))
    body = F.concat(
        F.lit("# Head "), "conv_id", F.lit("\n\n## Turn "), "turn", F.lit("\n\n"), "text", F.lit("\n\n| a | b |\n| --- | :---: |\n| "),
        cell(0), F.lit(" | "), cell(1), F.lit(" |\n| "), cell(2), F.lit(" | x |\nend\n| no | table |\n\n| c |\n|---|\n"))
    return table(spark, sf, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", body.alias("text"))


@query("markdown_tables", f"""
WITH t AS (SELECT conv_id, turn, {S.toks('text')} AS w FROM conversations)
SELECT conv_id, turn, printf('p%04d-t001', turn) AS table_id, 2 AS row_count, '| a | b |' || chr(10) || '| --- | :---: |' || chr(10) || '| ' || coalesce(w[1], '-') || ' | ' || coalesce(w[2], '-') || ' |' || chr(10) || '| ' || coalesce(w[3], '-') || ' | x |' AS markdown FROM t
UNION ALL SELECT conv_id, turn, printf('p%04d-t002', turn), 0, '| c |' || chr(10) || '|---|' FROM t""")
def q_tables(spark, sf):
    rows = D.table_rows(_with_tables(spark, sf), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", D.table_id(F.col("turn"), F.col("table_no")).alias("table_id"), "row_count", "markdown")


@query("section_paths", """
SELECT conv_id, turn, 'Head ' || conv_id || ' > Turn ' || turn AS section_path FROM conversations""")
def q_sections(spark, sf):
    return _with_tables(spark, sf).select("conv_id", "turn", D.section_path(F.col("text")).alias("section_path"))


@query("document_quality", rf"""
WITH t AS (SELECT conv_id, turn, '# Head ' || conv_id || chr(10) || chr(10) || '## Turn ' || turn || chr(10) || chr(10) || text || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | :---: |' || chr(10) || '| '
    || coalesce({S.toks('text')}[1], '-') || ' | ' || coalesce({S.toks('text')}[2], '-') || ' |' || chr(10) || '| ' || coalesce({S.toks('text')}[3], '-') || ' | x |' || chr(10) || 'end' || chr(10) || '| no | table |'
    || chr(10) || chr(10) || '| c |' || chr(10) || '|---|' || chr(10) AS body FROM conversations),
l AS (SELECT conv_id, turn, lower({S.squash('line')}) AS norm FROM (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS line FROM t)),
r AS (SELECT DISTINCT conv_id FROM (SELECT conv_id, turn, norm FROM l WHERE norm <> '' GROUP BY ALL HAVING count(*) >= 3 AND len(string_split(norm, ' ')) <= 8)),
u AS (SELECT conv_id, count(DISTINCT turn) AS pages, sum(length(body)) AS chars, count(*) * 2 AS tables FROM t GROUP BY 1),
q AS (SELECT u.*, r.conv_id IS NOT NULL AS repeated, format('{{:.2f}}', chars::DOUBLE / pages)::DOUBLE AS per_page FROM u LEFT JOIN r USING (conv_id))
SELECT conv_id, pages AS page_coverage_count, 0::BIGINT AS empty_section_count, repeated AS repeated_header_footer_detected, tables AS table_count, per_page AS chars_per_page,
  concat_ws(',', CASE WHEN per_page < 80 THEN 'low_chars_per_page' END, CASE WHEN repeated THEN 'repeated_header_footer_detected' END) AS warnings FROM q""")
def q_doc_quality(spark, sf):
    rows = _with_tables(spark, sf)
    units = quality.repeated_header_footer(rows).select(
        "conv_id", F.col("turn").alias("page_number"), F.length("text").alias("char_count"), F.col("repeated_header_footer").alias("repeated"))
    tables = D.table_rows(rows, ["conv_id", "turn"])
    return D.document_quality(units, tables, ["conv_id"]).withColumn("warnings", F.array_join("warnings", ","))


def _customer_tables(spark, sf):
    """Customers as one sheet per nation, ragged by market segment."""
    c = table(spark, sf, "customer")
    ragged = F.when(F.col("c_mktsegment") == "BUILDING", F.array("c_name", "c_mktsegment")).otherwise(
        F.array("c_name", "c_mktsegment", F.concat(F.col("c_custkey").cast("string"), F.lit("|x"))))
    return c.select("c_nationkey", F.col("c_custkey").alias("pos"), ragged.alias("cells"))


@query("table_to_markdown", """
WITH c AS (SELECT c_nationkey, c_custkey AS pos, CASE WHEN c_mktsegment = 'BUILDING' THEN [c_name, c_mktsegment] ELSE [c_name, c_mktsegment, c_custkey || '\\|x'] END AS cells FROM customer),
w AS (SELECT c_nationkey, max(len(cells)) AS w, min(pos) AS head FROM c GROUP BY 1),
p AS (SELECT c.c_nationkey, pos, head, w, CASE WHEN len(cells) < w THEN list_append(cells, '') ELSE cells END AS cells FROM c JOIN w USING (c_nationkey))
SELECT c_nationkey, pos, 0 AS part, '| ' || array_to_string(cells, ' | ') || ' |' AS line FROM p
UNION ALL SELECT c_nationkey, pos, 1, '| ' || CASE WHEN w = 2 THEN '--- | ---' ELSE '--- | --- | ---' END || ' |' FROM p WHERE pos = head""")
def q_to_markdown(spark, sf):
    return D.markdown_rows(_customer_tables(spark, sf), ["c_nationkey"], "pos")


@query("tabular_review", """
WITH c AS (SELECT c_nationkey, c_custkey AS pos, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 3 END AS n FROM customer)
SELECT c_nationkey, count(*) - 1 AS data_rows, (sum(n) - arg_min(n, pos))::BIGINT AS meaningful_cells,
 CASE WHEN count(*) <= 1 THEN 'Tabular source produced no data rows' WHEN sum(n) - arg_min(n, pos) <= 0 THEN 'Tabular source produced no meaningful data cells' ELSE '' END AS review_reason FROM c GROUP BY 1""")
def q_review(spark, sf):
    return D.tabular_review(_customer_tables(spark, sf), ["c_nationkey"], "pos")


def _sources(spark, sf):
    return table(spark, sf, "documents", "doc_id", "source", "text").select(
        F.concat(F.lit("raw_"), "doc_id").alias("source_id"), F.lit("web").alias("source_kind"), F.col("source").alias("title"),
        F.lit("").alias("url"), F.col("text").alias("body"), F.col("doc_id").alias("pos"))


TOPIC_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(h, '{n}')" for n in needles) + f" THEN '{slug}'" for slug, _, needles in D.TOPICS) + " ELSE source END"


@query("wiki_pages", f"""
WITH t AS (SELECT *, {TOPIC_SQL} AS slug FROM (SELECT *, lower(source || chr(10) || chr(10) || substring(text, 1, 1000)) AS h FROM documents))
SELECT slug, count(*) AS source_count, 'wiki/pages/' || slug || '.md' AS path FROM t GROUP BY slug""")
def q_wiki_pages(spark, sf):
    return D.scaffold_pages(_sources(spark, sf))[0].select("slug", "source_count", "path")


@query("wiki_page_pieces", rf"""
WITH t AS (SELECT *, {TOPIC_SQL} AS slug FROM (SELECT *, lower(source || chr(10) || chr(10) || substring(text, 1, 1000)) AS h FROM documents)),
l AS (SELECT doc_id, slug, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: v <> '' AND NOT starts_with(v, '---')), lambda v: trim(ltrim(v, '# '))) AS ls FROM t)
SELECT slug, doc_id AS pos, 'raw_' || doc_id AS source_id, substring({S.strip("array_to_string(ls, chr(10))")}, 1, 1200) AS excerpt FROM l""")
def q_pieces(spark, sf):
    return D.scaffold_pages(_sources(spark, sf))[1]


@query("page_types", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'semantic' WHEN contains(rel, '-pdf-') THEN 'source' WHEN starts_with(rel, 'pages/schools/') OR ends_with(rel, '-guide.md') THEN 'semantic'
  WHEN length(rel) - length(replace(rel, '/', '')) <= 1 THEN 'category' ELSE 'unknown' END AS page_type
FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'pages/schools/' WHEN 1 THEN 'pages/a/b/' WHEN 2 THEN 'pages/x-pdf-' ELSE 'pages/' END || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '-guide.md' ELSE '.md' END AS rel FROM orders)""")
def q_page_types(spark, sf):
    k = F.col("o_orderkey")
    folder = F.when(k % 5 == 0, "pages/schools/").when(k % 5 == 1, "pages/a/b/").when(k % 5 == 2, "pages/x-pdf-").otherwise("pages/")
    rel = F.concat(folder, k, F.when(k % 7 == 0, "-guide.md").otherwise(".md"))
    return table(spark, sf, "orders").select(
        "o_orderkey", D.page_type(F.when(F.col("o_orderstatus") == "F", "Semantic"), rel).alias("page_type"))


@query("page_list", """
SELECT 'p' || o_orderkey AS path, o_orderpriority AS category, o_orderstatus AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'semantic' ELSE 'source' END AS page_type
FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END, lower(o_orderpriority), lower(o_orderstatus), 'p' || o_orderkey LIMIT 200""")
def q_page_list(spark, sf):
    pages = table(spark, sf, "orders").select(
        F.concat(F.lit("p"), "o_orderkey").alias("path"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, "semantic").otherwise("source").alias("page_type"))
    return D.list_pages(pages)


@query("frontmatter", """
SELECT doc_id, 'T ' || doc_id AS title, source || ',' || lang AS tags, substring(ltrim(text, chr(10) || ' '), 1) AS body FROM documents""")
def q_frontmatter(spark, sf):
    page = F.concat(F.lit("---\ntitle: T "), "doc_id", F.lit("\ntags:\n  - "), "source", F.lit("\n  - "), "lang", F.lit("\n---\n\n"), "text").alias("p")
    rows = table(spark, sf, "documents", "doc_id", "source", "lang", "text").select("doc_id", page)
    p = F.col("p")
    return rows.select(
        "doc_id", X.frontmatter_scalar(p, "title").alias("title"), F.array_join(X.frontmatter_list(p, "tags"), ",").alias("tags"),
        X.strip_frontmatter(p).alias("body"))


@query("embedding_plan", f"""
WITH {S.INDEX}, t AS (SELECT corpus, greatest(1, ceil(least(length(title || chr(10) || text), 8000) / 4.0))::BIGINT AS n FROM idx)
SELECT corpus, count(*) AS chunks, sum(n)::BIGINT AS estimated_input_tokens, round(sum(n) / 1000000.0::DOUBLE * 0.02, 6)::DOUBLE AS estimated_cost_usd, ceil(count(*) / 64.0)::BIGINT AS batches FROM t GROUP BY corpus""")
def q_plan(spark, sf):
    from corvane.catalog.corpus import index_rows
    from corvane.plans.index import embedding_plan

    return embedding_plan(index_rows(spark, sf), 0.02, "corpus")
