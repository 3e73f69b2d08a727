"""Question answering legs for a batch of queries: candidates, fusion, evidence.

docs carries ``id, corpus, source_kind, source_id, source_ids, path, title, text, tags,
updated_at, page_type, source_priority, routing, vector``; queries ``(qid, query)``. All legs work on keys and
scores; titles and text are joined in at the end, for the kept candidates only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import intent, leadership
from corvane.functions import text as X
from corvane.functions.vectors import cosine
from corvane.operators import neighbours, ranking
from corvane.operators.blocks import BLOCK_CELLS, block_top_k
from corvane.operators.relational import first_per_key, top_k, union_all
from corvane.session import through_table

MAX_CANDIDATES = 50
MAX_EVIDENCE = 5
SUPPORT_FACTOR, SUPPORT_CAP, SUPPORT_FLOOR = 0.05, 0.25, 0.01
MIN_VECTOR_SCORE = 0.05


def plan_queries(queries: DataFrame) -> DataFrame:
    """Effective query text, type, asker profile and ranking tokens of each query."""
    expanded = queries.withColumn("_x", intent.expanded_query(F.col("query")))
    return expanded.select(
        "qid",
        F.col("query").alias("original_query"),
        F.col("_x.effective").alias("query"),
        F.col("_x.expansions").alias("expansions"),
        intent.is_person_lookup(F.col("query")).alias("person_lookup"),
    ).withColumn("_t", intent.query_type(F.col("query"))).select(
        "*", "_t.query_type", "_t.classifier_reason", intent.profile(F.col("query")).alias("profile"),
    ).drop("_t")


# --------------------------------------------------------------------- wiki leg
# A page class is a small bit set: semantic, plain source, graduate page, school folders.
SEMANTIC, PLAIN, GRADUATE, FIRST_FOLDER = 1, 2, 4, 8


def _bits(tests) -> Column:
    return sum((F.when(test, bit).otherwise(0) for test, bit in tests), F.lit(0)).cast("int")


def page_class() -> Column:
    """All a page's boost depends on beside its score."""
    path = F.col("path")
    semantic = (F.col("page_type") == "semantic") | (F.col("source_priority") == "semantic-wiki")
    folders = [
        (path.contains(f"wiki/pages/schools/{slug}"), FIRST_FOLDER << i) for i, (slug, _) in enumerate(intent.SCHOOL_PAGES)]
    return _bits([
        (semantic, SEMANTIC), (F.col("page_type") == "source", PLAIN), (path.endswith("/graduate.md"), GRADUATE), *folders])


def _boosted(score: Column) -> Column:
    kind = F.col("page_class")
    school = kind.bitwiseAND(F.col("wanted")) != 0
    bonus = (
        F.when(school, 60.0).otherwise(0.0)
        + F.when(F.col("grad") & (kind.bitwiseAND(F.lit(GRADUATE)) != 0), 20.0).otherwise(0.0)
        + F.when(F.col("several") & school, 30.0).otherwise(0.0)
    )
    return (
        F.when(kind.bitwiseAND(F.lit(SEMANTIC)) != 0, score * 4.0 + 25.0 + bonus)
        .when(kind.bitwiseAND(F.lit(PLAIN)) != 0, score * 0.85).otherwise(score)
    )


def boost_semantic(best: DataFrame, wiki: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` wiki chunks per query after the page-type boost.

    ``best`` are the best ``k`` BM25 rows of each query and ``page_class``. A semantic page scores ``4 * s + 25`` plus bonuses even
    without a hit; a scored ``source`` page is damped. Within one class the boost keeps
    the order of the scores, so ``k`` rows of each class are enough. Pages without a hit
    score by class alone: of each class only the first ``2k`` ids can reach a top ``k``,
    as either ``k`` scored pages of the class beat them all, or at least ``k`` of those
    ids are unscored.
    """
    low = F.lower(X.text_or_empty(F.col("query")))
    wants = queries.select(
        "qid",
        _bits([(X.contains_any(low, words), FIRST_FOLDER << i) for i, (_, words) in enumerate(intent.SCHOOL_PAGES)]).alias("wanted"),
        intent.wants_graduate(F.col("query")).alias("grad"),
        intent.wants_several_aspects(F.col("query")).alias("several"),
    )
    hit = best.join(wants, "qid").select("qid", "id", _boosted(F.col("score")).alias("score"))
    semantic = wiki.select("id", page_class().alias("page_class")).filter(F.col("page_class").bitwiseAND(F.lit(SEMANTIC)) != 0)
    first = top_k(semantic, ["page_class"], [F.col("id")], 2 * k, "_r").select(F.lit(1).alias("_one"), "id", "page_class")
    quiet = wants.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").select(
        "qid", "id", _boosted(F.lit(0.0)).alias("score"))
    either = hit.unionByName(quiet).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top_k(either, ["qid"], [F.col("score").desc(), F.col("id")], k)


def raw_support(docs: DataFrame, wiki_hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Raw chunks of the sources the wiki candidates cite: ``(qid, id, score, rank)``.

    The score is capped; a cited chunk without any query term keeps a floor score. Of
    each source only its first ``2k`` chunks can fill places with the floor score.
    """
    cited = (
        wiki_hits.select("qid", "id").join(docs.filter("corpus = 'wiki'").select("id", "source_ids"), "id")
        .select("qid", F.explode("source_ids").alias("source_id")).filter("source_id <> ''").distinct()
    )
    raw = docs.filter("corpus = 'raw'").join(cited.select("source_id").distinct(), "source_id", "left_semi")
    terms = ranking.query_terms(queries, X.search_tokens(F.col("query"))).select("qid", "term")
    hits = (
        raw.select("id", "source_id", F.explode(X.content_tokens(F.concat_ws("\n", "title", "text"))).alias("term"))
        .groupBy("id", "source_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        .join(terms, "term").join(cited, ["qid", "source_id"])
        .groupBy("qid", "id").agg(F.sum("tf").cast("double").alias("n"))
        .select("qid", "id", F.least(F.col("n") * SUPPORT_FACTOR, F.lit(SUPPORT_CAP)).alias("score"))
    )
    fillers = top_k(raw.select("source_id", "id"), ["source_id"], [F.col("id")], 2 * k, "_r").drop("_r")
    floor = cited.join(fillers, "source_id").select(
        "qid", "id", F.lit(SUPPORT_FLOOR * SUPPORT_FACTOR).alias("score")
    )
    best = hits.unionByName(floor).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], [F.col("score").desc(), F.col("id")], k)


def lexical_leg(docs: DataFrame, queries: DataFrame, k: int = MAX_CANDIDATES, postings=None) -> DataFrame:
    """BM25 wiki candidates, then the raw chunks they cite.

    ``(qid, id, pos, lexical, bm25, reason)`` with ``pos`` the place in the leg. With stored
    ``postings`` the candidates are found there, without reading the texts.
    """
    wiki = docs.filter("corpus = 'wiki'")
    classed = wiki.withColumn("page_class", page_class())
    if postings is None:
        best = ranking.bm25_top(classed, queries, k, by=("page_class",))
    else:
        best = postings.bm25_top(queries, k, "wiki", classed.select("id", "page_class"))
    ranked = through_table(boost_semantic(best, wiki, queries, k), "wiki-hits")
    support = raw_support(docs, ranked, queries, k)
    both = ranked.select("qid", "id", F.col("rank").alias("pos"), "score", F.lit("bm25_wiki_match").alias("reason")).unionByName(
        support.select("qid", "id", (F.col("rank") + k).alias("pos"), "score", F.lit("bm25_cited_raw_support").alias("reason"))
    )
    return both.select("qid", "id", "pos", F.col("score").alias("lexical"), F.col("score").alias("bm25"), "reason")


def vector_leg(docs: DataFrame, queries: DataFrame, embed, k: int = MAX_CANDIDATES) -> DataFrame:
    """Nearest chunks of both corpora: ``(qid, id, pos, retrieval_vector, reason)``."""
    content = F.array_join(X.search_tokens(F.col("query")), " ")
    asked = queries.select("qid", embed(F.when(content != "", content).otherwise(F.col("query"))).alias("vector"))
    # the embeddings are rounded to six decimals
    found = neighbours.nearest(docs.select("id", "vector"), asked, k, MIN_VECTOR_SCORE, decimals=6)
    return found.select(
        "qid", "id", F.col("rank").alias("pos"), F.col("score").alias("retrieval_vector"),
        F.lit("vector_candidate").alias("reason"),
    )


def hybrid_leg(docs: DataFrame, queries: DataFrame, k: int = MAX_CANDIDATES, postings=None) -> DataFrame:
    """TF-IDF candidates of the raw, then of the wiki corpus."""
    best = ranking.tfidf_top(docs, queries, k) if postings is None else postings.tfidf_top(queries, k)
    return best.select(
        "qid", "id", (F.col("rank") + F.when(F.col("corpus") == "wiki", k).otherwise(0)).alias("pos"),
        F.col("score").alias("lexical"),
    )


def fuse(lexical: DataFrame, vector: DataFrame, queries: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """Rank concatenation: the leading leg first, then the other, first place kept.

    The lexical leg leads for factual, the vector leg for reasoning queries.
    ``(qid, id, pos, lexical, bm25, retrieval_vector, reason)``, at most ``k`` a query.
    """
    null = F.lit(None).cast("double")
    left = lexical.select("qid", "id", "pos", "lexical", "bm25", null.alias("retrieval_vector"), "reason", F.lit(0).alias("leg"))
    right = vector.select("qid", "id", "pos", null.alias("lexical"), null.alias("bm25"), "retrieval_vector", "reason", F.lit(1).alias("leg"))
    leads = queries.select("qid", F.when(F.col("query_type") == "factual", 0).otherwise(1).alias("lead"))
    placed = left.unionByName(right).join(leads, "qid").withColumn("turn", (F.col("leg") != F.col("lead")).cast("int"))
    merged = placed.groupBy("qid", "id").agg(
        F.min(F.struct("turn", "pos")).alias("place"),
        F.min_by("reason", F.struct("turn", "pos")).alias("reason"),
        F.coalesce(F.max("lexical"), F.lit(0.0)).alias("lexical"),
        F.max("bm25").alias("bm25"),
        F.max("retrieval_vector").alias("retrieval_vector"),
    )
    return top_k(merged, ["qid"], [F.col("place")], k, "pos").drop("place")


def candidates(
    docs: DataFrame, queries: DataFrame, embed, strategy: str = "auto", k: int = MAX_CANDIDATES, postings=None
) -> DataFrame:
    """Candidates of each query under one retrieval strategy, with its name.

    ``auto`` fuses both legs and falls back to TF-IDF for queries without any
    fused hit; ``bm25`` and ``vector`` force one leg; ``hybrid`` is TF-IDF.
    """
    cols = ["qid", "id", "pos", "lexical", "bm25", "retrieval_vector", "reason", "strategy"]
    null = F.lit(None).cast("double")

    def shaped(df: DataFrame, name: str) -> DataFrame:
        for column in ("lexical", "bm25", "retrieval_vector"):
            if column not in df.columns:
                df = df.withColumn(column, F.lit(0.0) if column == "lexical" else null)
        if "reason" not in df.columns:
            df = df.withColumn("reason", F.lit(None).cast("string"))
        return df.withColumn("strategy", F.lit(name)).select(*cols)

    if strategy in ("bm25", "wiki_bm25", "factual"):
        return shaped(lexical_leg(docs, queries, k, postings), "wiki_bm25")
    if strategy in ("vector", "reasoning"):
        return shaped(vector_leg(docs, queries, embed, k), "vector")
    if strategy not in ("auto", "mcp_auto"):
        return shaped(hybrid_leg(docs, queries, k, postings), "hybrid")
    fused = fuse(lexical_leg(docs, queries, k, postings), vector_leg(docs, queries, embed, k), queries, k)
    fused = through_table(shaped(fused, "hybrid_fused"), "candidates")
    missed = queries.join(fused.select("qid").distinct(), "qid", "left_anti")
    if missed.isEmpty():
        return fused
    return fused.unionByName(shaped(hybrid_leg(docs, missed, k, postings), "hybrid_fallback"))


# ----------------------------------------------------------------------- rerank
def _bonuses(parts) -> tuple[Column, Column]:
    """Sum and reasons of ``(applies, bonus, reason)`` rules."""
    total = sum((F.when(test, bonus).otherwise(0.0) for test, bonus, _ in parts), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, _, reason in parts]))
    return total, reasons


def rerank(
    cands: DataFrame, docs: DataFrame, queries: DataFrame, embed=None, with_profile: bool = True,
    vector_enabled: bool = True,
) -> DataFrame:
    """Explainable combined score of every candidate, all parts as columns.

    combined = lexical + 1.5 vector + keyword + wiki priority + reasoning priority + route
    + freshness + citation + leadership. ``ranking_reasons`` lists the reasons in a
    fixed order.
    """
    q = queries.withColumn("tokens", X.tokens(F.col("query")))
    q = q.withColumn("leader", intent.is_leadership(F.col("query")))
    if embed is not None:
        q = q.withColumn("query_vector", embed(F.col("query")))
    if "query_type" not in q.columns:
        q = q.withColumn("query_type", intent.query_type(F.col("query"))["query_type"])
    rows = cands.join(docs, "id").join(
        q.select("qid", "query", "tokens", "leader", "query_type", *[c for c in ("query_vector", "profile") if c in q.columns]), "qid"
    )
    per_query = Window.partitionBy("qid")
    wiki = F.col("corpus") == "wiki"
    rows = (
        rows.withColumn("_raw_ids", F.collect_set(F.when(~wiki, F.col("source_id"))).over(per_query))
        .withColumn("_cited", F.array_distinct(F.flatten(F.collect_list(F.when(wiki, F.col("source_ids"))).over(per_query))))
        .withColumn("_best_wiki", F.coalesce(F.max(F.when(wiki, F.col("lexical"))).over(per_query), F.lit(0.0)))
    )
    cites = wiki & F.arrays_overlap("source_ids", "_raw_ids")
    cited = ~wiki & F.array_contains("_cited", F.col("source_id"))
    zero = F.lit(0.0)
    vector = cosine(F.col("vector"), F.col("query_vector")) if embed is not None and vector_enabled else zero
    route, route_reasons = zero, F.array().cast("array<string>")
    if with_profile and "profile" in q.columns:
        route, route_reasons = _bonuses(
            intent.route_parts(F.col("profile"), F.col("corpus"), F.col("routing"), F.col("tags"))
        )
    lead, lead_reasons = _bonuses(leadership.boost_parts(F.col("query"), F.col("title"), F.col("text")))
    reasoning = wiki & (F.col("query_type") == "reasoning")
    scored = (
        rows.withColumn("vector_score", vector)
        .withColumn("keyword", X.keyword_score(F.col("tokens"), F.col("title"), F.col("text")))
        .withColumn("source_priority", F.when(wiki, 1.2).otherwise(0.0))
        .withColumn("reasoning_wiki_priority", F.when(reasoning, 0.8).otherwise(0.0))
        .withColumn("route", route)
        .withColumn("freshness", F.when(F.col("updated_at") != "", 0.05).otherwise(0.0))
        .withColumn("citation", F.when(cites, 0.4).when(cited, 0.25).otherwise(0.0))
        .withColumn("leadership", F.when(F.col("leader"), lead).otherwise(0.0))
    )
    base_reasons = F.array_compact(F.array(
        F.when(wiki, F.lit("wiki_synthesis_boost")),
        F.when(cites, F.lit("cites_raw_candidate")),
        F.when(cited, F.lit("cited_by_wiki_candidate")),
        F.when(F.col("keyword") != 0, F.lit("keyword_match")),
        F.when(reasoning, F.lit("reasoning_wiki_priority")),
        F.when(F.col("vector_score") > 0, F.lit("vector_match")),
    ))
    fallback = F.when(
        ~wiki & (F.col("_best_wiki") < F.col("lexical") * 0.5), F.array(F.lit("raw_source_fallback"))
    ).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(base_reasons, route_reasons, fallback)
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("lexical_match"))).otherwise(reasons)
    combined = (
        F.col("lexical") + 1.5 * F.col("vector_score") + F.col("keyword") + F.col("source_priority")
        + F.col("reasoning_wiki_priority") + F.col("route") + F.col("freshness") + F.col("citation") + F.col("leadership")
    )
    return (
        scored.withColumn("combined", F.round(combined, 6))
        .withColumn("ranking_reasons", F.concat(reasons, F.when(F.col("leader"), lead_reasons).otherwise(F.array().cast("array<string>"))))
        .drop("_raw_ids", "_cited", "_best_wiki", "query_vector")
    )


EVIDENCE_ORDER = ("combined", "kind_rank", "path", "id")


def final_order() -> list[Column]:
    """Combined score, wiki before others, path, id."""
    wiki_last = F.when(F.col("source_kind") == "wiki", 0).otherwise(1)
    return [F.col("combined").desc(), wiki_last, F.col("path"), F.col("id")]


def merge_model_scores(reranked: DataFrame, model: DataFrame) -> DataFrame:
    """Order by a model's scores ``(qid, id, model_score, model_rank)``.

    Rows the model left out follow in their own order. ``place`` holds the order.
    """
    joined = reranked.join(model, ["qid", "id"], "left")
    has = F.col("model_score").isNotNull()
    total = F.round(F.col("model_score") + 0.05 * F.col("citation") + 0.02 * F.col("freshness"), 6)
    joined = joined.withColumn("combined", F.when(has, total).otherwise(F.col("combined"))).withColumn(
        "ranking_reasons",
        F.when(has, F.concat(F.array(F.lit("model_rerank")), F.col("ranking_reasons"))).otherwise(F.col("ranking_reasons")),
    )
    window = Window.partitionBy("qid").orderBy(has.desc(), F.col("model_rank"), *final_order())
    return joined.withColumn("place", F.row_number().over(window))


def evidence(reranked: DataFrame, limit: int = MAX_EVIDENCE, distinct_paths: bool = True) -> DataFrame:
    """Top rows per query after keeping the first row of each path."""
    rows = reranked
    if distinct_paths:
        rows = rows.withColumn("_key", F.when(F.col("path") != "", F.col("path")).otherwise(F.col("id")))
        rows = first_per_key(rows, ["qid", "_key"], final_order()).drop("_key")
    rows = top_k(rows, ["qid"], final_order(), limit)
    annotated = F.when(
        F.col("reason").isNotNull() & ~F.array_contains("ranking_reasons", F.col("reason")),
        F.concat(F.array(F.col("reason")), F.col("ranking_reasons")),
    ).otherwise(F.col("ranking_reasons"))
    return rows.withColumn("ranking_reasons", annotated).withColumn(
        "snippet", X.snippet(F.col("text"), F.col("tokens"))
    )


# ------------------------------------------------------------------- next pages
TYPE_BONUS = ("semantic", "navigation", "concept", "entity", "workflow", "process")


QUERY_PART = 2000  # queries scored together


def next_pages(pages: DataFrame, queries: DataFrame, shown: DataFrame, limit: int = 5, query_part: int = QUERY_PART) -> DataFrame:
    """Pages to open next for each query, except those already shown.

    pages ``(path, title, summary, tags, entities, priority, page_type)``, shown ``(qid, path)``.
    A page scores one per distinct query token that is a substring of its words, plus 8 for a
    school the query names, plus its own base score. Queries are taken in parts of bounded
    size. For a part the pages are scored where they are read, block by block, and each task
    keeps its best rows of a query; only those are shuffled. A page's row is found by title
    and path, which also order equal scores.
    """
    base = pages.select(
        F.concat_ws("\x00", F.coalesce("title", F.lit("")), "path").alias("id"), "path", "title", "page_type",
        F.substring(X.first_filled(F.col("summary"), F.lit("Relevant linked/navigation page")), 1, 240).alias("why"),
        (F.coalesce(F.col("priority"), F.lit(0.0)) / 100.0 + F.when(F.col("page_type").isin(*TYPE_BONUS), 5.0).otherwise(0.0)).alias("base"),
        F.array_distinct(X.tokens(F.concat_ws(" ", "title", "summary", F.array_join("tags", " "), F.array_join("entities", " ")))).alias("words"),
        intent.school_folders(F.col("path")).alias("folders"),
    )
    asked = queries.select(
        "qid", F.array_distinct(X.content_tokens(F.col("query"))).alias("terms"), intent.wanted_schools(F.col("query")).alias("wanted"))
    parts = max(1, -(-queries.count() // query_part))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    seen = shown.join(queries.select("qid"), "qid", "left_semi").groupBy("qid").agg(F.collect_set("path").alias("shown"))
    asked = asked.join(seen, "qid", "left")
    found = [
        block_top_k(
            base.select("id", "path", "base", "words", "folders"), [r["qid"] for r in rows], queries.schema["qid"].dataType, [], limit,
            _page_scores(rows, queries.sparkSession), lambda s: s > 0, max(16, BLOCK_CELLS // max(len(rows), 500)))
        for rows in (asked.filter(F.col("_part") == i).orderBy("qid").collect() for i in range(parts))]
    best = union_all(found)
    return best.join(base.select("id", "path", "title", "page_type", "why"), "id").select(
        "qid", "rank", "path", "title", "page_type", "why", "score")


def token_rows(words: pa.ListArray, inside) -> tuple[np.ndarray, np.ndarray]:
    """Row and token number of each query token inside a row's words; ``inside(word)`` is asked once for all rows."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words.flatten())
    if not len(coded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_word = [inside(w) for w in coded.dictionary.to_pylist()]
    counts = np.array([len(o) for o in of_word])
    codes, rows = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(words)), sizes)
    hit = counts[codes] > 0
    codes, rows = codes[hit], rows[hit]
    n = counts[codes]
    starts = (np.cumsum(counts) - counts)[codes] - (np.cumsum(n) - n)
    return np.repeat(rows, n), np.concatenate(of_word)[np.repeat(starts, n) + np.arange(n.sum())]


def _page_scores(rows: list, spark):
    """Scores of page blocks for the queries ``rows (qid, terms, wanted, shown)``."""
    terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    folders = {f: i for i, f in enumerate(sorted({f for r in rows for f in r["wanted"] or []}))}
    by_term, by_folder = np.zeros((len(terms), len(rows)), np.float32), np.zeros((len(folders), len(rows)), np.float32)
    hidden: dict[str, list[int]] = {}
    for q, r in enumerate(rows):
        by_term[[terms[t] for t in r["terms"]], q] = 1
        by_folder[[folders[f] for f in r["wanted"] or []], q] = 1
        for path in r["shown"] or []:
            hidden.setdefault(path, []).append(q)
    lengths = sorted({len(t) for t in terms})
    shared = spark.sparkContext.broadcast((terms, lengths, folders, by_term, by_folder, hidden))
    known: dict[str, np.ndarray] = {}

    def inside(word: str) -> np.ndarray:
        """Numbers of the query tokens that are substrings of a word."""
        got = known.get(word)
        if got is None:
            terms_, lengths_ = shared.value[:2]
            spans = {word[i : i + n] for n in lengths_ if n <= len(word) for i in range(len(word) - n + 1)}
            if len(known) >= 200_000:
                known.clear()
            got = known[word] = np.array([terms_[s] for s in spans if s in terms_], np.int64)
        return got

    def score(batch, positions, key):
        terms_, _, folders_, by_term_, by_folder_, hidden_ = shared.value
        cut = batch.take(pa.array(positions))
        has, of = np.zeros((len(positions), len(terms_)), np.float32), np.zeros((len(positions), len(folders_)), np.float32)
        has[token_rows(cut.column("words"), inside)] = 1
        for i, own in enumerate(cut.column("folders").to_pylist()):
            of[i, [folders_[f] for f in own or [] if f in folders_]] = 1
        points = has @ by_term_ + 8.0 * ((of @ by_folder_) > 0)
        total = points.astype(np.float64) + cut.column("base").to_numpy(zero_copy_only=False)[:, None]
        for i, path in enumerate(cut.column("path").to_pylist()):
            total[i, hidden_.get(path, [])] = -np.inf
        return total.T

    return score
