"""Retrieval legs, fusion, reranking, evidence and confidence over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import sqltext as S
from corvane.catalog.corpus import BM25, QUESTIONS, TFIDF, index_rows, questions
from corvane.catalog.registry import ORACLES, query, table
from corvane.functions import intent
from corvane.functions import leadership as L
from corvane.functions import text as X
from corvane.functions.vectors import hashed_tokens_embedding
from corvane.operators import confidence, neighbours, ranking, retrieval
from corvane.plans import lexical
from corvane.session import run_dir, through_table

DIMS = 256
FOLDERS = (
    ("src0", "schools/cox-school-of-business"),
    ("src1", "schools/meadows-school-of-the-arts"),
    ("src2", "schools/dedman-school-of-law"),
)


def ranked_docs(spark, sf, vectors: bool = False):
    """Index rows with page paths, citations and routing taken from their columns."""
    wiki = F.col("corpus") == "wiki"
    folder = F.col("source")
    for source, name in FOLDERS:
        folder = F.when(F.col("source") == source, name).otherwise(folder)
    name = F.when(F.col("lang") == "de", "/graduate.md").otherwise(".md")
    wiki_path = F.concat(F.lit("wiki/pages/"), folder, F.lit("/"), F.col("doc_id"), name)
    raw_path = F.concat(F.lit("raw_sources/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    own = F.concat(F.lit("raw_"), F.col("doc_id"))
    cites = F.array(*[F.concat(F.lit("raw_"), F.col("doc_id") + i) for i in (1, 2, 3)])
    none = F.array().cast("array<string>")
    audiences = (
        F.when(F.col("lang") == "en", F.array(F.lit("graduate"))).when(F.col("lang") == "fr", F.array(F.lit("undergraduate")))
        .when(F.col("lang") == "de", F.array(F.lit("researcher"))).otherwise(none)
    )
    intents = (
        F.when(F.col("source") == "src5", F.array(F.lit("study"), F.lit("pay")))
        .when(F.col("source") == "src6", F.array(F.lit("explore")))
        .when(F.col("source") == "src7", F.array(F.lit("research"))).otherwise(none)
    )
    rows = index_rows(spark, sf).select(
        "id", "corpus", "title", "text",
        F.when(wiki, "wiki").otherwise("web").alias("source_kind"),
        F.when(wiki, wiki_path).otherwise(raw_path).alias("path"),
        F.when(wiki, wiki_path).otherwise(own).alias("source_id"),
        F.when(wiki, cites).otherwise(F.array(own)).alias("source_ids"),
        F.array("source").alias("tags"),
        F.when(F.col("lang") == "fr", "").otherwise("2026-01-01").alias("updated_at"),
        F.when(wiki & F.col("source").isin(*[s for s, _ in FOLDERS]), "semantic").when(wiki, "source").otherwise("").alias("page_type"),
        F.lit("curated-wiki").alias("source_priority"),
        F.struct(
            audiences.alias("audiences"), none.alias("roles"), intents.alias("intents"),
            F.when(F.col("lang") == "en", F.array(F.lit("computer"))).otherwise(none).alias("academic_interests"),
        ).alias("routing"),
    )
    if vectors:
        embed = hashed_tokens_embedding(DIMS)
        rows = rows.withColumn("vector", embed(F.concat_ws("\n", "title", "text")))
    return rows


def built_index(spark, sf):
    """The index rows with vectors, written once and read by every leg."""
    return through_table(ranked_docs(spark, sf, vectors=True), "index")


def planned(spark, sf):
    q = questions(spark, sf)
    return q.withColumn("_t", intent.query_type(F.col("query"))).select(
        "qid", "query", "_t.query_type", intent.profile(F.col("query")).alias("profile"))


# --------------------------------------------------------------------- SQL side
def _any(hay: str, needles) -> str:
    return "(" + " OR ".join(f"contains({hay}, '" + n.replace("'", "''") + "')" for n in needles) + ")"


def _case(hay: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_any(hay, n)} THEN '{label}'" for label, n in rules) + " ELSE '' END"


_RE = lambda parts: "|".join(f"(?:{p})" for p in parts).replace("'", "''")


def type_sql(q: str, want: str) -> str:
    n = f"lower({S.squash(q)})"
    multi = " AND ".join(_any(n, w) for w in (intent.SCHOOL_WORDS, intent.COURSE_WORDS, intent.MONEY_WORDS, intent.PROCESS_WORDS))
    out = {
        "type": ("factual", "reasoning", "factual", "factual", "reasoning"),
        "reason": ("student_multi_aspect_fact", "reasoning_marker", "factual_marker", "short_fact_like_query", "default_reasoning"),
    }[want]
    return (
        f"CASE WHEN {multi} THEN '{out[0]}' WHEN regexp_matches({n}, '{_RE(intent.REASONING)}') THEN '{out[1]}' "
        f"WHEN regexp_matches({n}, '{_RE(intent.FACTUAL)}') THEN '{out[2]}' WHEN len({S.content(n)}) <= 6 THEN '{out[3]}' ELSE '{out[4]}' END"
    )


def profile_sql(q: str, name: str, rules) -> str:
    hay = f"lower({q} || '    ')"
    expr = _case(hay, rules)
    if name == "academic_interest":
        expr = rf"CASE WHEN ({expr}) = '' AND regexp_matches({hay}, '\bnetwork\s+engineering\b') THEN 'engineering' ELSE ({expr}) END"
    return expr


PLANNED = f"""
planned AS (SELECT qid, query, {type_sql('query', 'type')} AS query_type,
  {', '.join(f"{profile_sql('query', n, r)} AS {n}" for n, r in intent.PROFILE_FIELDS)} FROM questions)"""

FOLDER_SQL = "CASE source " + " ".join(f"WHEN '{s}' THEN '{f}'" for s, f in FOLDERS) + " ELSE source END"
WIKI_PATH = f"'wiki/pages/' || {FOLDER_SQL} || '/' || doc_id || CASE WHEN lang = 'de' THEN '/graduate.md' ELSE '.md' END"
RDOCS = f"""
rdocs AS (SELECT id, corpus, title, text,
  CASE WHEN corpus = 'wiki' THEN 'wiki' ELSE 'web' END AS source_kind,
  CASE WHEN corpus = 'wiki' THEN {WIKI_PATH} ELSE 'raw_sources/' || source || '/' || doc_id || '.md' END AS path,
  CASE WHEN corpus = 'wiki' THEN {WIKI_PATH} ELSE 'raw_' || doc_id END AS source_id,
  CASE WHEN corpus = 'wiki' THEN ['raw_' || (doc_id + 1), 'raw_' || (doc_id + 2), 'raw_' || (doc_id + 3)] ELSE ['raw_' || doc_id] END AS source_ids,
  source AS tag,
  CASE WHEN lang = 'fr' THEN '' ELSE '2026-01-01' END AS updated_at,
  CASE WHEN corpus = 'wiki' AND source IN ({', '.join(f"'{s}'" for s, _ in FOLDERS)}) THEN 'semantic' WHEN corpus = 'wiki' THEN 'source' ELSE '' END AS page_type,
  CASE lang WHEN 'en' THEN ['graduate'] WHEN 'fr' THEN ['undergraduate'] WHEN 'de' THEN ['researcher'] ELSE [] END AS audiences,
  CASE source WHEN 'src5' THEN ['study', 'pay'] WHEN 'src6' THEN ['explore'] WHEN 'src7' THEN ['research'] ELSE [] END AS intents,
  CASE lang WHEN 'en' THEN ['computer'] ELSE [] END AS interests
  FROM idx)"""

_WANTED = " OR ".join(
    f"({_any('ql', words)} AND contains(path, 'wiki/pages/schools/{slug}'))" for slug, words in intent.SCHOOL_PAGES)
_SEVERAL = " + ".join(f"{_any('ql', g)}::INT" for g in (intent.COURSE_WORDS, intent.MONEY_WORDS, intent.ADMISSION_WORDS))
BOOST = f"""
pairs AS (SELECT q.qid, lower(q.query) AS ql, d.id, d.path, d.page_type, b.score
  FROM questions q CROSS JOIN (SELECT * FROM rdocs WHERE corpus = 'wiki') d LEFT JOIN bm25 b ON b.qid = q.qid AND b.id = d.id
  WHERE b.score IS NOT NULL OR d.page_type = 'semantic'),
boosted AS (SELECT qid, id, CASE WHEN page_type = 'semantic' THEN coalesce(score, 0) * 4 + 25
    + CASE WHEN {_WANTED} THEN 60 ELSE 0 END
    + CASE WHEN {_any('ql', intent.GRADUATE_WORDS)} AND ends_with(path, '/graduate.md') THEN 20 ELSE 0 END
    + CASE WHEN {_SEVERAL} >= 2 AND ({_WANTED}) THEN 30 ELSE 0 END
  ELSE score * 0.85 END AS score FROM pairs),
wiki_hits AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM boosted) WHERE rank <= 50)"""

SUPPORT = f"""
cited AS (SELECT DISTINCT qid, source_id FROM (SELECT w.qid, unnest(d.source_ids) AS source_id FROM wiki_hits w JOIN rdocs d USING (id))),
raw_tf AS (SELECT id, source_id, term, count(*) AS tf FROM (
    SELECT id, source_id, unnest({S.content("title || chr(10) || text")}) AS term FROM rdocs WHERE corpus = 'raw') GROUP BY ALL),
support_all AS (SELECT c.qid, d.id, CASE WHEN sum(t.tf) IS NULL THEN 0.01::DOUBLE * 0.05::DOUBLE ELSE least(sum(t.tf)::DOUBLE * 0.05::DOUBLE, 0.25::DOUBLE) END AS score
  FROM cited c JOIN (SELECT id, source_id FROM rdocs WHERE corpus = 'raw') d USING (source_id)
  LEFT JOIN (SELECT qid, id, tf FROM raw_tf JOIN bm_q USING (term)) t ON t.qid = c.qid AND t.id = d.id GROUP BY c.qid, d.id),
support AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM support_all) WHERE rank <= 50)"""


def hashed_sql(name: str, source: str, key: str, text: str) -> str:
    """Sparse unit vectors of the token-hash embedding."""
    return f"""
{name}_t AS (SELECT {key} AS k, unnest({S.toks(f"substring({text}, 1, 8000)")}) AS tok FROM {source}),
{name}_s AS (SELECT k, (('0x' || substring(sha256(tok), 1, 8))::BIGINT % {DIMS}) AS slot,
   sum(CASE WHEN (('0x' || substring(sha256(tok), 9, 2))::BIGINT % 2) = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM {name}_t GROUP BY ALL),
{name} AS (SELECT k, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY k)), 6) AS v FROM {name}_s WHERE v <> 0)"""


VECTOR = f"""
{hashed_sql('dvec', 'rdocs', 'id', "title || chr(10) || text")},
vq_text AS (SELECT qid, array_to_string(CASE WHEN len({S.content('query')}) > 0 THEN {S.content('query')} ELSE {S.toks('query')} END, ' ') AS txt FROM questions),
{hashed_sql('qvec', 'vq_text', 'qid', 'txt')},
vec_all AS (SELECT q.k AS qid, d.k AS id, greatest(round(sum(q.v * d.v), 9), 0.0) AS score FROM qvec q JOIN dvec d USING (slot) GROUP BY ALL),
vec_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vec_all WHERE score >= 0.05) WHERE rank <= 50)"""

FUSED = """
placed AS (
  SELECT qid, id, rank AS pos, score AS lexical, NULL::DOUBLE AS vec, 'bm25_wiki_match' AS reason, 0 AS leg FROM wiki_hits
  UNION ALL SELECT qid, id, rank + 50, score, NULL, 'bm25_cited_raw_support', 0 FROM support
  UNION ALL SELECT qid, id, rank, NULL, score, 'vector_candidate', 1 FROM vec_hits),
turns AS (SELECT p.*, CASE WHEN leg = CASE WHEN query_type = 'factual' THEN 0 ELSE 1 END THEN 0 ELSE 1 END AS turn FROM placed p JOIN planned USING (qid)),
firsts AS (SELECT qid, id, min(turn * 1000 + pos) AS place, arg_min(reason, turn * 1000 + pos) AS reason,
   coalesce(max(lexical), 0.0) AS lexical, max(lexical) AS bm25, max(vec) AS retrieval_vector FROM turns GROUP BY qid, id),
fused AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS pos FROM firsts) WHERE pos <= 50)"""

CHAIN = f"""
WITH {S.INDEX}, {QUESTIONS}, {PLANNED}, {RDOCS},
{BM25.format(docs="(SELECT * FROM rdocs WHERE corpus = 'wiki')")}, {BOOST}, {SUPPORT}, {VECTOR}, {FUSED}"""


def _slug_list(v: str) -> str:
    return rf"trim(regexp_replace(lower({v}), '[^a-z0-9]+', '-', 'g'), '-')"


_LEAD_OK = f"(NOT regexp_matches(hay, '(?i){L.SOCIAL_EVENT}'))"
_PERSON = L.PERSON_FIRST.replace(r"(?<!Associate\s)", "").replace("'", "''")
_OFFICE = L.OFFICE_FIRST.replace(r"(?<!Associate\s)", "").replace("'", "''")
RERANK = rf"""
qinfo AS (SELECT *, {S.toks('query')} AS toks, lower(query) AS ql, {_any(f"lower({S.squash('query')})", intent.LEADER_HINTS)} AS leader FROM planned),
qfull_src AS (SELECT qid, query AS txt FROM questions),
{hashed_sql('qfull', 'qfull_src', 'qid', 'txt')},
cos AS (SELECT f.qid, f.id, greatest(sum(q.v * d.v), 0.0) AS vec FROM fused f JOIN qfull q ON q.k = f.qid JOIN dvec d ON d.k = f.id AND d.slot = q.slot GROUP BY ALL),
cand AS (SELECT f.qid, f.id, f.lexical, f.bm25, f.retrieval_vector, f.reason, d.* EXCLUDE (id), q.* EXCLUDE (qid), coalesce(c.vec, 0.0) AS vec,
    lower(d.title) AS title_l, lower(d.title || chr(10) || d.text) AS hay_l, d.title || chr(10) || d.text AS hay
  FROM fused f JOIN rdocs d USING (id) JOIN qinfo q USING (qid) LEFT JOIN cos c ON c.qid = f.qid AND c.id = f.id),
cand_raw AS (SELECT DISTINCT qid, source_id FROM cand WHERE corpus = 'raw'),
cand_cites AS (SELECT DISTINCT qid, unnest(source_ids) AS source_id FROM cand WHERE corpus = 'wiki'),
best AS (SELECT qid, coalesce(max(lexical) FILTER (corpus = 'wiki'), 0.0) AS best_wiki FROM cand GROUP BY qid),
parts AS (SELECT c.*, best_wiki,
  corpus = 'wiki' AND EXISTS (SELECT 1 FROM cand_raw r WHERE r.qid = c.qid AND list_contains(c.source_ids, r.source_id)) AS cites,
  corpus <> 'wiki' AND EXISTS (SELECT 1 FROM cand_cites r WHERE r.qid = c.qid AND r.source_id = c.source_id) AS is_cited,
  len(list_filter(list_distinct(toks), lambda t: contains(title_l, t))) * 0.4::DOUBLE
   + len(list_intersect(list_distinct(toks), string_split_regex(hay_l, '[^\pL\pN_]+'))) * 0.1::DOUBLE
   + CASE WHEN len(toks) > 0 AND contains(hay_l, array_to_string(toks, ' ')) THEN 0.8 ELSE 0 END AS keyword,
  intent <> '' AND list_contains(intents, {_slug_list('intent')}) AS r_intent,
  role <> '' AND list_contains(audiences, {_slug_list('role')}) AS r_role,
  education_level <> '' AND list_contains(audiences, {_slug_list('education_level')}) AS r_level,
  academic_interest <> '' AND list_contains(list_append(interests, tag), {_slug_list('academic_interest')}) AS r_interest,
  (education_level IN ('early learner', 'secondary student') AND (list_contains(audiences, 'graduate') OR list_contains(audiences, 'researcher')))
   OR (intent <> '' AND len(intents) > 0 AND NOT list_contains(intents, {_slug_list('intent')}) AND NOT list_contains(intents, 'explore')) AS r_off,
  leader AND NOT {_LEAD_OK} AS l_social,
  leader AND {_LEAD_OK} AND (regexp_matches(hay, '(?i){_PERSON}') OR regexp_matches(hay, '(?i){_OFFICE}')) AS l_named,
  leader AND {_LEAD_OK} AND (contains(ql, 'network engineering') OR contains(hay_l, 'network-engineering')) AND regexp_matches(hay, '(?i)\bnetwork\s+engineering\b') AS l_net,
  leader AND {_LEAD_OK} AND {_any('ql', ('director', 'chair', 'dean', 'who'))} AND regexp_matches(hay, '(?i)\bdirector\b') AS l_dir
  FROM cand c JOIN best USING (qid)),
scored AS (SELECT *,
  CASE WHEN corpus = 'wiki' THEN 0.15 ELSE 0 END + CASE WHEN r_intent THEN 0.9 ELSE 0 END + CASE WHEN r_role THEN 0.6 ELSE 0 END
   + CASE WHEN r_level THEN 0.5 ELSE 0 END + CASE WHEN r_interest THEN 0.5 ELSE 0 END - CASE WHEN r_off THEN 1.4 ELSE 0 END AS route,
  CASE WHEN l_social THEN -0.6 ELSE 0 END + CASE WHEN l_named THEN 1.1 ELSE 0 END + CASE WHEN l_net THEN 0.5 ELSE 0 END + CASE WHEN l_dir THEN 0.25 ELSE 0 END AS lead_boost,
  CASE WHEN cites THEN 0.4 WHEN is_cited THEN 0.25 ELSE 0 END AS citation
  FROM parts),
reranked AS (SELECT *, round(lexical + 1.5 * vec + keyword + CASE WHEN corpus = 'wiki' THEN 1.2 ELSE 0 END
   + CASE WHEN corpus = 'wiki' AND query_type = 'reasoning' THEN 0.8 ELSE 0 END + route
   + CASE WHEN updated_at <> '' THEN 0.05 ELSE 0 END + citation + lead_boost, 6)::DOUBLE AS combined,
  list_filter([CASE WHEN corpus = 'wiki' THEN 'wiki_synthesis_boost' END, CASE WHEN cites THEN 'cites_raw_candidate' END,
   CASE WHEN is_cited THEN 'cited_by_wiki_candidate' END, CASE WHEN keyword <> 0 THEN 'keyword_match' END,
   CASE WHEN corpus = 'wiki' AND query_type = 'reasoning' THEN 'reasoning_wiki_priority' END, CASE WHEN vec > 0 THEN 'vector_match' END,
   CASE WHEN corpus = 'wiki' THEN 'routed_wiki_candidate' END, CASE WHEN r_intent THEN 'intent_route_match' END,
   CASE WHEN r_role THEN 'profile_role_match' END, CASE WHEN r_level THEN 'education_level_match' END,
   CASE WHEN r_interest THEN 'academic_interest_match' END, CASE WHEN r_off THEN 'profile_scope_penalty' END,
   CASE WHEN corpus <> 'wiki' AND best_wiki < lexical * 0.5 THEN 'raw_source_fallback' END], lambda v: v IS NOT NULL) AS base_reasons,
  list_filter([CASE WHEN l_social THEN 'social_networking_penalty' END, CASE WHEN l_named THEN 'leadership_pattern_boost' END,
   CASE WHEN l_net THEN 'network_engineering_match' END, CASE WHEN l_dir THEN 'director_term_match' END], lambda v: v IS NOT NULL) AS lead_reasons
  FROM scored)"""
ORDER = "combined DESC, CASE WHEN source_kind = 'wiki' THEN 0 ELSE 1 END, path, id"
EVIDENCE = f"""
per_path AS (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY {ORDER}) AS pn FROM reranked),
evidence AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER}) AS rank FROM per_path WHERE pn = 1) WHERE rank <= 5)"""


# -------------------------------------------------------------------- the queries
@query("wiki_bm25_boosted", f"""
{CHAIN} SELECT qid, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score, rank::INTEGER AS rank FROM wiki_hits""")
def q_boosted(spark, sf):
    docs = through_table(ranked_docs(spark, sf), "index").filter("corpus = 'wiki'")
    q = questions(spark, sf)
    best = ranking.bm25_top(docs.withColumn("page_class", retrieval.page_class()), q, 50, by=("page_class",))
    return retrieval.boost_semantic(best, docs, q, 50).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("lexical_leg", f"""
{CHAIN} SELECT qid, id, pos::INTEGER AS pos, round(lexical::DECIMAL(28, 11), 6)::DOUBLE AS lexical, reason FROM placed WHERE leg = 0""")
def q_lexical(spark, sf):
    docs = through_table(ranked_docs(spark, sf), "index")
    leg = retrieval.lexical_leg(docs, questions(spark, sf))
    return leg.select("qid", "id", "pos", F.round("lexical", 6).alias("lexical"), "reason")


@query("vector_leg", f"""
{CHAIN} SELECT qid, id, rank::INTEGER AS pos, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score FROM vec_hits""")
def q_vector(spark, sf):
    leg = retrieval.vector_leg(ranked_docs(spark, sf, True), questions(spark, sf), hashed_tokens_embedding(DIMS))
    return leg.select("qid", "id", "pos", F.round("retrieval_vector", 6).alias("score"))


@query("vector_leg_exact", f"""
{CHAIN.replace('greatest(round(sum(q.v * d.v), 9), 0.0)', 'greatest(((sum(round(q.v * 1000000)::BIGINT * round(d.v * 1000000)::BIGINT) + 500)::HUGEINT // 1000)::DOUBLE / 1000000000.0, 0.0)')}
SELECT qid, id, rank::INTEGER AS pos, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score FROM vec_hits""")
def q_vector_exact(spark, sf):
    """The vector leg against sums of whole numbers, which no order of adding can change."""
    return q_vector(spark, sf)


@query("hybrid_leg", f"""
WITH {S.INDEX}, {QUESTIONS}, {TFIDF},
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, corpus ORDER BY score DESC, id) AS rank FROM tfidf)
SELECT qid, id, (rank + CASE WHEN corpus = 'wiki' THEN 50 ELSE 0 END)::INTEGER AS pos, round(score::DECIMAL(28, 11), 6)::DOUBLE AS lexical FROM ranked WHERE rank <= 50""")
def q_hybrid(spark, sf):
    return retrieval.hybrid_leg(index_rows(spark, sf), questions(spark, sf)).select(
        "qid", "id", "pos", F.round("lexical", 6).alias("lexical"))


def _fused(spark, sf, docs):
    return retrieval.candidates(docs, planned(spark, sf), hashed_tokens_embedding(DIMS), "auto")


@query("fused_candidates", f"""
{CHAIN} SELECT qid, id, pos::INTEGER AS pos, round(lexical::DECIMAL(28, 11), 6)::DOUBLE AS lexical, round(retrieval_vector::DECIMAL(28, 11), 6)::DOUBLE AS retrieval_vector, reason,
  'hybrid_fused' AS strategy FROM fused""")
def q_fused(spark, sf):
    return _fused(spark, sf, built_index(spark, sf)).select(
        "qid", "id", "pos", F.round("lexical", 6).alias("lexical"),
        F.round("retrieval_vector", 6).alias("retrieval_vector"), "reason", "strategy")


def _reranked(spark, sf):
    docs = built_index(spark, sf)
    return retrieval.rerank(_fused(spark, sf, docs), docs, planned(spark, sf), hashed_tokens_embedding(DIMS))


@query("rerank_scores", f"""
{CHAIN}, {RERANK}
SELECT qid, id, round(vec, 6) AS vector_score, round(keyword, 6) AS keyword, round(route, 6)::DOUBLE AS route, citation::DOUBLE AS citation, combined,
  array_to_string(list_concat(CASE WHEN len(base_reasons) = 0 THEN ['lexical_match'] ELSE base_reasons END, lead_reasons), ',') AS reasons FROM reranked""")
def q_rerank(spark, sf):
    return _reranked(spark, sf).select(
        "qid", "id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword", 6).alias("keyword"),
        F.round("route", 6).alias("route"), "citation", "combined", F.array_join("ranking_reasons", ",").alias("reasons"))


SNIPPET = rf"""
snip AS (SELECT *, {S.squash('text')} AS flat FROM evidence),
snip2 AS (SELECT *, coalesce(list_min(list_filter(list_transform(toks, lambda t: instr(lower(flat), t) - 1), lambda p: p >= 0)), 0) AS hit FROM snip),
snip3 AS (SELECT *, greatest(0, hit - 80) AS st FROM snip2),
snip4 AS (SELECT *, CASE WHEN length(flat) <= 320 THEN flat ELSE
  CASE WHEN st > 0 THEN '...' ELSE '' END || trim(substring(flat, st + 1, 320)) || CASE WHEN st + 320 < length(flat) THEN '...' ELSE '' END END AS snippet FROM snip3)"""


@query("evidence_top5", f"""
{CHAIN}, {RERANK}, {EVIDENCE}, {SNIPPET}
SELECT qid, rank::INTEGER AS rank, id, path, combined, snippet, reason || ',' || array_to_string(
  list_concat(CASE WHEN len(base_reasons) = 0 THEN ['lexical_match'] ELSE base_reasons END, lead_reasons), ',') AS reasons FROM snip4""")
def q_evidence(spark, sf):
    return retrieval.evidence(_reranked(spark, sf)).select(
        "qid", "rank", "id", "path", "combined", "snippet", F.array_join("ranking_reasons", ",").alias("reasons"))


@query("index_evidence_top5", ORACLES["evidence_top5"])
def q_index_evidence(spark, sf):
    """The same from stored postings: written once, then asked without reading the texts for candidates."""
    docs, root = built_index(spark, sf), run_dir(spark, "lexical-index")
    lexical.write_postings(docs, root)
    asked, embed = planned(spark, sf), hashed_tokens_embedding(DIMS)
    found = retrieval.candidates(docs, asked, embed, "auto", postings=lexical.StoredPostings(spark, root))
    return retrieval.evidence(retrieval.rerank(found, docs, asked, embed)).select(
        "qid", "rank", "id", "path", "combined", "snippet", F.array_join("ranking_reasons", ",").alias("reasons"))


@query("confidence", f"""
{CHAIN}, {RERANK}, {EVIDENCE},
agg AS (SELECT qid, max(combined) AS best, max(combined) FILTER (rank = 1) AS a, max(combined) FILTER (rank = 2) AS b FROM evidence GROUP BY qid),
t AS (SELECT qid, coalesce(a / CASE WHEN best = 0 THEN 1 ELSE best END, 0) AS top, coalesce(b / CASE WHEN best = 0 THEN 1 ELSE best END, 0) AS second, best IS NOT NULL AS st
  FROM questions LEFT JOIN agg USING (qid))
SELECT qid, st AND top >= 0.4 AND top - second >= 0.05 AS confident, round(top, 6) AS top_score, round(top - second, 6) AS top_two_gap, st AS citation_present FROM t""")
def q_confidence(spark, sf):
    out = confidence.assess(questions(spark, sf).select("qid"), retrieval.evidence(_reranked(spark, sf)))
    return out.select("qid", "confident", "top_score", "top_two_gap", "citation_present")


USER_TURNS = "turns_u AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user')"


@query("query_type", f"""
SELECT conv_id, turn, {type_sql('text', 'type')} AS query_type, {type_sql('text', 'reason')} AS classifier_reason FROM conversations""")
def q_type(spark, sf):
    t = intent.query_type(F.col("text"))
    return table(spark, sf, "conversations", "conv_id", "turn", "text").withColumn("_t", t).select(
        "conv_id", "turn", "_t.query_type", "_t.classifier_reason")


@query("query_profile", f"""
SELECT conv_id, turn, {', '.join(f"{profile_sql('text', n, r)} AS {n}" for n, r in intent.PROFILE_FIELDS)} FROM conversations""")
def q_profile(spark, sf):
    return table(spark, sf, "conversations", "conv_id", "turn", "text").withColumn(
        "_p", intent.profile(F.col("text"))).select("conv_id", "turn", "_p.*")


_NQ = f"lower({S.squash('text')})"
_PERSON_SQL = rf"({_NQ} <> '' AND (regexp_matches({_NQ}, '\bwho\b') OR {_any(_NQ, intent.LEADER_HINTS)}))"


@query("person_lookup", rf"""
WITH x AS (SELECT *, {_NQ} AS low, {S.squash('text')} AS original, {_PERSON_SQL} AS person, {_any(_NQ, intent.LEADER_HINTS)} AS leader FROM conversations),
y AS (SELECT *, regexp_matches(low, '\bnetworking\b') AND NOT contains(low, 'network engineering') AND (person OR regexp_matches(low, '\b(?:program|major|degree|ms|m\.s)\b')) AS nw,
  leader AND regexp_matches(low, '\bsmu\b') AND NOT contains(low, 'lyle') AS home FROM x),
z AS (SELECT *, array_to_string(list_filter(list_concat(CASE WHEN nw THEN [{', '.join(f"'{v}'" for v in intent.NETWORK_EXPANSIONS)}] ELSE [] END,
   CASE WHEN home THEN ['{intent.HOME_SCHOOL}'] ELSE [] END), lambda v: NOT contains(low, v)), ' ') AS extra FROM y)
SELECT conv_id, turn, person AS person_lookup, leader AS leadership,
  CASE WHEN nw THEN regexp_replace(original, '(?i)\bnetworking\b', 'network engineering', 'g') ELSE original END || CASE WHEN extra <> '' THEN ' ' || extra ELSE '' END AS effective FROM z""")
def q_person(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "text")
    return rows.withColumn("_x", intent.expanded_query(F.col("text"))).select(
        "conv_id", "turn", intent.is_person_lookup(F.col("text")).alias("person_lookup"),
        intent.is_leadership(F.col("text")).alias("leadership"), F.col("_x.effective").alias("effective"))


@query("vector_top10", """
WITH p AS (SELECT q.vec_id AS qid, d.vec_id AS id, greatest(round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9), 0.0) AS score
  FROM embeddings q CROSS JOIN embeddings d),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p WHERE score >= 0.05)
SELECT qid, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def q_vector10(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = neighbours.nearest(v, v.select(F.col("id").alias("qid"), "vector"), 10, 0.05)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_top3_per_label", """
WITH p AS (SELECT q.vec_id AS qid, d.label, d.vec_id AS id, greatest(round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9), 0.0) AS score
  FROM embeddings q CROSS JOIN embeddings d),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM p WHERE score >= 0.05)
SELECT qid, label, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def q_vector_label(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    found = neighbours.nearest(v, v.select(F.col("id").alias("qid"), "vector"), 3, 0.05, partition="label")
    return found.select("qid", "label", "id", F.round("score", 6).alias("score"), "rank")


_SCHOOL_SLUGS = [s for s, _ in intent.SCHOOL_PAGES]
_HITS = "len(list_filter(list_distinct(ct), lambda t: contains(hay, t)))"


@query("next_pages", f"""
WITH {S.CORPUS}, {QUESTIONS},
pages_n AS (SELECT '/' || source || '/' || doc_id AS path, title, text AS summary, source, lang, (length(text) % 100)::DOUBLE AS priority,
   CASE WHEN corpus = 'wiki' THEN 'semantic' ELSE 'source' END AS page_type FROM corpus_docs),
base AS (SELECT path, title, page_type, substring(CASE WHEN summary <> '' THEN summary ELSE 'Relevant linked/navigation page' END, 1, 240) AS why,
   lower(title || ' ' || summary || ' ' || lang || ' ' || source) AS hay, priority / 100.0 + CASE WHEN page_type = 'semantic' THEN 5.0 ELSE 0 END AS base FROM pages_n),
q AS (SELECT qid, {S.content('query')} AS ct, lower(query) AS ql FROM questions),
p AS (SELECT qid, path, title, page_type, why, round({_HITS} + base, 9)::DOUBLE AS score
  FROM q CROSS JOIN base WHERE NOT path = '/src1/' || qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, title, path) AS rank FROM p WHERE score > 0)
SELECT qid, rank::INTEGER AS rank, path, title, page_type, why, score FROM r WHERE rank <= 5""")
def q_next_pages(spark, sf):
    from corvane.catalog.corpus import corpus_docs

    pages = corpus_docs(spark, sf).select(
        F.concat_ws("/", F.lit(""), "source", "doc_id").alias("path"), "title", F.col("text").alias("summary"),
        F.array("lang").alias("tags"), F.array("source").alias("entities"),
        (F.length("text") % 100).cast("double").alias("priority"),
        F.when(F.col("corpus") == "wiki", "semantic").otherwise("source").alias("page_type"),
    )
    q = questions(spark, sf)
    shown = q.select("qid", F.concat(F.lit("/src1/"), F.col("qid")).alias("path"))
    return retrieval.next_pages(pages, q, shown)


@query("snippets", rf"""
WITH {S.CORPUS}, {QUESTIONS}, s AS (SELECT d.doc_id, {S.toks('q.query')} AS toks, {S.squash('d.text')} AS flat FROM corpus_docs d JOIN questions q ON q.qid = length(d.text) % (SELECT count(*) FROM questions)),
s2 AS (SELECT *, coalesce(list_min(list_filter(list_transform(toks, lambda t: instr(lower(flat), t) - 1), lambda p: p >= 0)), 0) AS hit FROM s),
s3 AS (SELECT *, greatest(0, hit - 80) AS st FROM s2)
SELECT doc_id, CASE WHEN length(flat) <= 320 THEN flat ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || trim(substring(flat, st + 1, 320))
  || CASE WHEN st + 320 < length(flat) THEN '...' ELSE '' END END AS snippet FROM s3""")
def q_snippets(spark, sf):
    q = questions(spark, sf).select("qid", X.tokens(F.col("query")).alias("tokens"))
    docs = table(spark, sf, "documents", "doc_id", "text").withColumn("qid", (F.length("text") % q.count()).cast("long"))
    return docs.join(q, "qid").select("doc_id", X.snippet(F.col("text"), F.col("tokens")).alias("snippet"))


@query("keyword_scores", rf"""
WITH {S.CORPUS}, {QUESTIONS}, s AS (SELECT d.doc_id, {S.toks('q.query')} AS toks, lower(d.title) AS title_l, lower(d.title || chr(10) || d.text) AS hay_l
  FROM corpus_docs d JOIN questions q ON q.qid = length(d.text) % (SELECT count(*) FROM questions))
SELECT doc_id, round(len(list_filter(list_distinct(toks), lambda t: contains(title_l, t))) * 0.4::DOUBLE
   + len(list_intersect(list_distinct(toks), string_split_regex(hay_l, '[^\pL\pN_]+'))) * 0.1::DOUBLE
   + CASE WHEN len(toks) > 0 AND contains(hay_l, array_to_string(toks, ' ')) THEN 0.8 ELSE 0 END, 6) AS score FROM s""")
def q_keyword(spark, sf):
    from corvane.catalog.corpus import corpus_docs

    q = questions(spark, sf).select("qid", X.tokens(F.col("query")).alias("tokens"))
    docs = corpus_docs(spark, sf).withColumn("qid", (F.length("text") % q.count()).cast("long"))
    return docs.join(q, "qid").select(
        "doc_id", F.round(X.keyword_score(F.col("tokens"), F.col("title"), F.col("text")), 6).alias("score"))
