"""Postings and lexical scores for many queries over one scan of the corpus.

Tables used here:

* docs      ``(id, corpus, title, text, ...)``, one row per indexed chunk
* queries   ``(qid, query)``
* postings  ``(corpus, id, term, tf)``
* scores    ``(qid, corpus, id, score)``

Two forms of both scores. ``bm25_top`` and ``tfidf_top`` give the best ``k`` of a small
query set: document frequencies first, then one pass that scores blocks of chunks as
matrix products and shuffles only each task's best rows. ``bm25_scores`` and
``tfidf_scores`` give every score, for query sets of any size; of a small one ``bm25_scores``
makes them in the same blocks and shuffles none.

Shuffle plan of the full scores: the token rows are first cut down to the
query vocabulary where they are read, then partitioned once by ``id``. Term counts,
the join to the query terms and the per-query sums all keep that partitioning, so
the wide ``(qid, id)`` rows are never exchanged; only each task's best ``k`` rows of a
query are. The one join on ``term`` against a shuffled side salts hot terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_tokens, search_tokens, tokens
from corvane.operators.blocks import BLOCK_CELLS, block_scores, block_top_k, token_weights
from corvane.operators.relational import is_small, lookup, top_k

K1, B = 1.5, 0.75
SCORE_DIGITS = 9


def term_rows(docs: DataFrame, tokens_of, cols: list[str]) -> DataFrame:
    return docs.select(*cols, F.explode(tokens_of).alias("term"))


def build_postings(docs: DataFrame) -> DataFrame:
    """Term frequency per chunk over all tokens of its text."""
    return (
        term_rows(docs, tokens(F.col("text")), ["corpus", "id"])
        .groupBy("corpus", "id", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency and total frequency of each term and corpus."""
    return postings.groupBy("corpus", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("total_tf")
    )


def query_terms(queries: DataFrame, tokens_of) -> DataFrame:
    """``(qid, term, qtf)``; ``qtf`` counts repeats of a term in its query."""
    return (
        queries.select("qid", F.explode(tokens_of).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _vocabulary_rows(docs: DataFrame, tokens_of, terms: DataFrame, cols: list[str], small: bool) -> DataFrame:
    """Token rows of the query vocabulary only, partitioned by chunk."""
    vocabulary = terms.select("term").distinct()
    if small:
        vocabulary = F.broadcast(vocabulary)
    hits = term_rows(docs, tokens_of, cols).join(vocabulary, "term", "left_semi")
    # a given number of partitions is not coalesced: these rows are few bytes but much work
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        hits.repartition(parts, "id")
        .groupBy(*cols, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _weigh(hits: DataFrame, weighted: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Attach the query weights to the postings.

    A small query set is broadcast. A large one is joined by term with the terms of
    high document frequency salted.
    """
    if small:
        return hits.join(F.broadcast(weighted.drop("df")), keys)
    return lookup(hits, weighted, keys, "df", how="inner", spread=["id"])


def _round_score(total):
    # summation order differs between plans; equal texts must tie exactly
    return F.round(total, SCORE_DIGITS).alias("score")


def bm25_scores(
    docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, carry: tuple[str, ...] = ()
) -> DataFrame:
    """BM25 of every matching chunk for every query over ``docs``.

    The text is title and body without stop words; query terms are distinct; chunks
    without content tokens count neither for N nor for the average length. Small columns
    named in ``carry`` travel with the chunk, which saves a join of all scores later.
    """
    small = _small_terms(queries, search_tokens(F.col("query")))
    if small is None:
        return bm25_joined(docs, queries, k1, b, carry)
    body, weigh = _bm25_blocks(docs, ["id", "corpus", *carry], small, k1, b)
    scores = block_scores(
        body, small[0], queries.schema["qid"].dataType, ["corpus", "id", *carry], lambda batch: weigh(batch, np.arange(batch.num_rows)), _block_rows(small[1]))
    return scores.withColumn("score", _round_score(F.col("score"))).filter(F.col("score") > 0)


def bm25_joined(
    docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, carry: tuple[str, ...] = ()
) -> DataFrame:
    """The same by a join of chunks and queries on their terms, for query sets of any size."""
    terms = query_terms(queries, search_tokens(F.col("query"))).select("qid", "term")
    # no filter on the length: it would be pushed below and tokenise every text twice
    tokenised = docs.select("id", "corpus", *carry, content_tokens(F.concat_ws("\n", "title", "text")).alias("_t"))
    body = tokenised.withColumn("dl", F.size("_t"))
    corpus = body.agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.sum("dl").alias("_all")).select(
        "n_docs", (F.col("_all") / F.col("n_docs")).alias("avgdl"))
    small = is_small(queries)
    hits = _vocabulary_rows(body, F.col("_t"), terms, ["id", "corpus", *carry, "dl"], small)
    dfs = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(dfs, "term").join(F.broadcast(corpus), F.lit(True)).select(
        "qid", "term", "avgdl", "df",
        F.ln(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    )
    part = F.col("idf") * (F.col("tf") * (k1 + 1.0)) / (
        F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    )
    return (
        _weigh(hits, weighted, ["term"], small)
        .groupBy("qid", "corpus", "id", *carry)
        .agg(_round_score(F.sum(part)))
        .filter(F.col("score") > 0)
    )


def tfidf_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Sum over query tokens, repeats counted, of ``tf * (ln((N+1)/(df+1)) + 1)``.

    N and df are taken within each corpus.
    """
    terms = query_terms(queries, tokens(F.col("query")))
    sizes = docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_docs"))
    small = is_small(queries)
    hits = _vocabulary_rows(docs, tokens(F.col("text")), terms, ["id", "corpus"], small)
    dfs = hits.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(dfs, "term").join(sizes, "corpus").select(
        "corpus", "term", "qid", "df",
        (F.col("qtf") * (F.ln((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0)).alias("w"),
    )
    return (
        _weigh(hits, weighted, ["corpus", "term"], small)
        .groupBy("qid", "corpus", "id")
        .agg(_round_score(F.sum(F.col("tf") * F.col("w"))))
    )


MAX_MATRIX_CELLS = 8_000_000


def _small_terms(queries: DataFrame, tokens_of) -> tuple[list, dict, list[tuple]] | None:
    """Query ids, vocabulary positions and ``(qid, term, qtf)``; None for a large set.

    Small means that a dense matrix of terms by queries fits a task.
    """
    if not is_small(queries):
        return None
    rows = query_terms(queries, tokens_of).limit(MAX_MATRIX_CELLS // 4 + 1).collect()
    qids = sorted({r["qid"] for r in rows})
    places = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    if len(qids) * len(places) > MAX_MATRIX_CELLS or len(rows) > MAX_MATRIX_CELLS // 4:
        return None
    return qids, places, [(r["qid"], r["term"], r["qtf"]) for r in rows]


def _corpus_stats(rows: DataFrame, places: dict, keys: list[str]) -> tuple[dict, dict]:
    """``(totals, df)`` of the token rows in one pass over their texts.

    ``totals[keys]`` is ``(chunks, chunks with tokens, tokens)``; ``df[keys + (term,)]`` counts
    the chunks holding a vocabulary term. The totals ride along as the empty term. The
    vocabulary is bounded by the caller, and so is what is collected here.
    """
    spark = rows.sparkSession
    vocabulary = spark.createDataFrame(pa.table({"term": pa.array(["", *places], pa.string())}))
    with_total = F.concat(F.array_distinct("tokens"), F.array(F.lit("")))
    per_chunk = rows.select(*keys, F.explode(with_total).alias("term"), F.size("tokens").alias("n"))
    found = per_chunk.join(F.broadcast(vocabulary), "term").groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("df"), F.count_if(F.col("n") > 0).alias("filled"), F.sum("n").alias("n")).collect()
    totals = {tuple(r[k] for k in keys): (r["df"], r["filled"], r["n"]) for r in found if r["term"] == ""}
    return totals, {(*(r[k] for k in keys), r["term"]): r["df"] for r in found if r["term"]}


def _bm25_blocks(docs: DataFrame, cols: list[str], small: tuple[list, dict, list[tuple]], k1: float, b: float):
    """Tokenised chunks, and the scores (queries by documents) of rows of a batch of them."""
    qids, places, rows = small
    body = docs.select(*cols, content_tokens(F.concat_ws("\n", "title", "text")).alias("tokens"))
    totals, df = _corpus_stats(body, places, [])
    _, n_docs, total = totals.get((), (0, 0, 0))
    matrix = np.zeros((len(places), len(qids)))
    where = {q: i for i, q in enumerate(qids)}
    for qid, term, _ in rows:
        if (term,) in df:
            matrix[places[term], where[qid]] = np.log(1.0 + (n_docs - df[term,] + 0.5) / (df[term,] + 0.5))
    mean = total / n_docs if n_docs else 1.0
    shared = docs.sparkSession.sparkContext.broadcast((list(places), matrix))

    def weigh(batch, positions):
        terms, weights = shared.value
        tf, lengths = token_weights(batch, positions, pa.array(terms, pa.string()))
        return ((tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * lengths[:, None] / mean)) @ weights).T

    return body, weigh


def bm25_top(
    docs: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = (), k1: float = K1, b: float = B
) -> DataFrame:
    """``(qid, by..., id, score, rank)``: best ``k`` chunks of each query and group by BM25."""
    small = _small_terms(queries, search_tokens(F.col("query")))
    order = [F.col("score").desc(), F.col("id")]
    if small is None:
        carry = tuple(c for c in by if c != "corpus")
        return top_k(bm25_joined(docs, queries, k1, b, carry).select("qid", *by, "id", "score"), ["qid", *by], order, k)
    qids, places, _ = small
    body, weigh = _bm25_blocks(docs, ["id", *by], small, k1, b)

    def score(batch, positions, key):
        return weigh(batch, positions)

    return block_top_k(
        body, qids, queries.schema["qid"].dataType, list(by), k, score, lambda s: s > 0, _block_rows(places))


def _block_rows(places: dict) -> int:
    return max(16, BLOCK_CELLS // max(len(places), 1))


def tfidf_top(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(qid, corpus, id, score, rank)``: best ``k`` chunks of each query and corpus."""
    small = _small_terms(queries, tokens(F.col("query")))
    if small is None:
        return top_candidates(tfidf_scores(docs, queries), k)
    qids, places, rows = small
    body = docs.select("id", "corpus", tokens(F.col("text")).alias("tokens"))
    totals, df = _corpus_stats(body, places, ["corpus"])
    sizes = {corpus: n for (corpus,), (n, _, _) in totals.items()}
    where = {q: i for i, q in enumerate(qids)}
    matrices = {c: np.zeros((len(places), len(qids))) for c in sizes}
    for corpus, n in sizes.items():
        for qid, term, qtf in rows:
            if (corpus, term) in df:
                matrices[corpus][places[term], where[qid]] = qtf * (np.log((n + 1.0) / (df[corpus, term] + 1.0)) + 1.0)
    shared = docs.sparkSession.sparkContext.broadcast((list(places), matrices))

    def score(batch, positions, key):
        terms, weights = shared.value
        tf, _ = token_weights(batch, positions, pa.array(terms, pa.string()))
        return (tf @ weights[key[0]]).T

    return block_top_k(
        body, qids, queries.schema["qid"].dataType, ["corpus"], k, score, lambda s: s > 0, _block_rows(places))


def top_candidates(scores: DataFrame, k: int, keys: tuple[str, ...] = ("qid", "corpus")) -> DataFrame:
    """Best ``k`` chunks per query and corpus: score descending, then id."""
    return top_k(scores, list(keys), [F.col("score").desc(), F.col("id")], k)
