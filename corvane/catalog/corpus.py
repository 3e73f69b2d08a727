"""Tokens, chunks, postings and lexical ranking over the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import sqltext as S
from corvane.catalog.registry import ORACLES, query, table
from corvane.functions import text as X
from corvane.operators import chunking, ranking
from corvane.plans import eager, lexical
from corvane.session import run_dir


def corpus_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as wiki pages (labelled good) and raw sources."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("quality") == 1, "wiki").otherwise("raw").alias("corpus"),
        F.concat_ws(" ", "source", "lang", "doc_id").alias("title"),
    )


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the corpus as index rows."""
    return chunking.explode_chunks(corpus_docs(spark, sf)).select(
        F.concat_ws(":", "corpus", "doc_id", "chunk_index").alias("id"),
        "corpus", "doc_id", "source", "lang", "title", "text", "chunk_index",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark passages as queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query("tokens", f"""
SELECT doc_id, array_to_string({S.toks('text')}, ' ') AS tokens FROM documents""")
def q_tokens(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("content_tokens", f"""
SELECT doc_id, array_to_string({S.content('text')}, ' ') AS tokens FROM documents""")
def q_content_tokens(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.array_join(X.content_tokens(F.col("text")), " ").alias("tokens"))


@query("chunks_1600", f"""
WITH {S.chunk_ctes('(SELECT doc_id, text FROM documents)')}
SELECT doc_id, chunk_index::INTEGER AS chunk_index, text FROM chunks""")
def q_chunks(spark, sf):
    return chunking.explode_chunks(table(spark, sf, "documents", "doc_id", "text"))


@query("chunks_1800", f"""
WITH {S.chunk_ctes('(SELECT doc_id, text FROM documents)', 1800, 200)}
SELECT doc_id, chunk_index::INTEGER AS chunk_index, text FROM chunks""")
def q_chunks_1800(spark, sf):
    return chunking.explode_chunks(table(spark, sf, "documents", "doc_id", "text"), size=1800)


@query("page_chunks_1200", """
SELECT doc_id, i::INTEGER AS chunk_index, substring(text, i * 1000 + 1, 1200) AS text
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents)""")
def q_page_chunks(spark, sf):
    return chunking.explode_page_chunks(table(spark, sf, "documents", "doc_id", "text"))


@query("postings", f"""
WITH {S.INDEX}, t AS (SELECT corpus, id, unnest({S.toks('text')}) AS term FROM idx)
SELECT corpus, id, term, count(*)::INTEGER AS tf FROM t GROUP BY ALL""")
def q_postings(spark, sf):
    return ranking.build_postings(index_rows(spark, sf))


@query("term_stats", f"""
WITH {S.INDEX}, t AS (SELECT corpus, id, unnest({S.toks('text')}) AS term FROM idx)
SELECT corpus, term, count(DISTINCT id) AS df, count(*) AS total_tf FROM t GROUP BY ALL""")
def q_term_stats(spark, sf):
    return ranking.term_stats(ranking.build_postings(index_rows(spark, sf)))


@query("chunk_lengths", f"""
WITH {S.INDEX}
SELECT corpus, count(*) AS n_docs, sum(dl)::BIGINT AS total_terms, round(avg(dl), 6) AS avgdl
FROM (SELECT corpus, len({S.content("title || chr(10) || text")}) AS dl FROM idx) WHERE dl > 0 GROUP BY corpus""")
def q_chunk_lengths(spark, sf):
    dl = F.size(X.content_tokens(F.concat_ws("\n", "title", "text"))).alias("dl")
    return (
        index_rows(spark, sf).select("corpus", dl).filter("dl > 0").groupBy("corpus")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_terms"), F.round(F.avg("dl"), 6).alias("avgdl"))
    )


BM25 = f"""
bm_doc AS (SELECT id, corpus, {S.content("title || chr(10) || text")} AS t FROM {{docs}}),
bm_body AS (SELECT id, corpus, t, len(t) AS dl FROM bm_doc WHERE len(t) > 0),
bm_stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bm_body),
bm_q AS (SELECT DISTINCT qid, unnest(CASE WHEN len({S.content('query')}) > 0 THEN {S.content('query')} ELSE {S.toks('query')} END) AS term FROM questions),
bm_tf AS (SELECT id, corpus, dl, term, count(*) AS tf FROM (SELECT id, corpus, dl, unnest(t) AS term FROM bm_body)
          WHERE term IN (SELECT term FROM bm_q) GROUP BY ALL),
bm_df AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY term),
bm25 AS (
  SELECT qid, corpus, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5))
         * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM bm_tf JOIN bm_df USING (term) JOIN bm_q USING (term) CROSS JOIN bm_stat
  GROUP BY qid, corpus, id)"""
QUESTIONS = "questions AS (SELECT item_id AS qid, text AS query FROM benchmark)"


@query("bm25_top5", f"""
WITH {S.INDEX}, {QUESTIONS}, {BM25.format(docs='idx')},
ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm25)
SELECT qid, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5""")
def q_bm25(spark, sf):
    top = ranking.bm25_top(index_rows(spark, sf), questions(spark, sf), 5)
    return top.select("qid", "id", F.round("score", 6).alias("score"), "rank")


TFIDF = f"""
ti_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.toks('query')}) AS term FROM questions) GROUP BY ALL),
ti_n AS (SELECT corpus, count(*) AS n FROM idx GROUP BY corpus),
ti_tf AS (SELECT corpus, id, term, count(*) AS tf FROM (SELECT corpus, id, unnest({S.toks('text')}) AS term FROM idx)
          WHERE term IN (SELECT term FROM ti_q) GROUP BY ALL),
ti_df AS (SELECT corpus, term, count(*) AS df FROM ti_tf GROUP BY ALL),
tfidf AS (
  SELECT qid, corpus, id, round(sum(tf * qtf * (ln((n + 1.0) / (df + 1.0)) + 1.0)), 9) AS score
  FROM ti_tf JOIN ti_df USING (corpus, term) JOIN ti_n USING (corpus) JOIN ti_q USING (term)
  GROUP BY qid, corpus, id)"""


@query("tfidf_top5", f"""
WITH {S.INDEX}, {QUESTIONS}, {TFIDF},
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, corpus ORDER BY score DESC, id) AS rank FROM tfidf)
SELECT qid, corpus, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5""")
def q_tfidf(spark, sf):
    top = ranking.tfidf_top(index_rows(spark, sf), questions(spark, sf), 5)
    return top.select("qid", "corpus", "id", F.round("score", 6).alias("score"), "rank")


def _stored_index(spark, sf):
    root = run_dir(spark, "lexical-index")
    lexical.write_postings(index_rows(spark, sf), root)
    return lexical.StoredPostings(spark, root)


@query("index_bm25_top5", ORACLES["bm25_top5"])
def q_index_bm25(spark, sf):
    """Postings written and then asked: the answer reads no text."""
    top = _stored_index(spark, sf).bm25_top(questions(spark, sf), 5)
    return top.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("index_tfidf_top5", ORACLES["tfidf_top5"])
def q_index_tfidf(spark, sf):
    top = _stored_index(spark, sf).tfidf_top(questions(spark, sf), 5)
    return top.select("qid", "corpus", "id", F.round("score", 6).alias("score"), "rank")


@query("bm25_all_scores", f"""
WITH {S.INDEX}, {QUESTIONS}, {BM25.format(docs='idx')}
SELECT qid, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score FROM bm25""")
def q_bm25_all(spark, sf):
    return ranking.bm25_scores(index_rows(spark, sf), questions(spark, sf)).select(
        "qid", "id", F.round("score", 6).alias("score"))


@query("tfidf_all_scores", f"""
WITH {S.INDEX}, {QUESTIONS}, {TFIDF}
SELECT qid, corpus, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score FROM tfidf""")
def q_tfidf_all(spark, sf):
    return ranking.tfidf_scores(index_rows(spark, sf), questions(spark, sf)).select(
        "qid", "corpus", "id", F.round("score", 6).alias("score"))


def _eager_words(expr: str) -> str:
    stops = ", ".join(f"'{w}'" for w in eager.STOP_WORDS)
    return rf"list_filter(regexp_extract_all(lower({expr}), '{eager.WORD}'), lambda w: w NOT IN ({stops}))"


@query("eager_bm25_top5", f"""
WITH {S.INDEX}, {QUESTIONS},
d AS (SELECT id, {_eager_words("title || chr(10) || text")} AS t FROM idx WHERE corpus = 'wiki'),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
c AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
q AS (SELECT DISTINCT qid, unnest({_eager_words("query")}) AS term FROM questions),
r AS (SELECT qid, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (1.0 - 0.75 + 0.75 * dl / mean)))), 9) AS score
  FROM c JOIN f USING (term) JOIN q USING (term), s GROUP BY 1, 2)
SELECT qid, id, round(score::DECIMAL(28, 11), 6)::DOUBLE AS score, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r WHERE score > 0) WHERE rank <= 5""")
def q_eager(spark, sf):
    """Scores computed with the index of the wiki chunks; a question only adds up slices."""
    root = run_dir(spark, "eager")
    eager.write_scores(index_rows(spark, sf).filter("corpus = 'wiki'"), root)
    return eager.eager_top(spark, root, questions(spark, sf), 5).select("qid", "id", F.round("score", 6).alias("score"), "rank")
