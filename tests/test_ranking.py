import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions.text import STOP_WORDS
from corvane.operators import neighbours, ranking, relational, retrieval
from corvane.plans import lexical
from corvane.session import shared_dir

TEXTS = [
    ("wiki", "Tuition", "tuition and fee schedule tuition due in march"), ("wiki", "Housing", "housing and dining for students"),
    ("raw", "Fees", "the fee for housing is listed with the tuition"), ("raw", "Dean", "Jane Doe, Dean of Network Engineering Studies"),
    ("wiki", "Empty", "the of and"), ("raw", "Copy", "the fee for housing is listed with the tuition"),
]
QUERIES = ["tuition fee fee", "what is the", "housing", "nothing matches here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", c, t, x) for i, (c, t, x) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id string, corpus string, title string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "qid int, query string")


def content(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]


def loop_bm25(query):
    terms = dict.fromkeys(content(query) or re.findall("[a-z0-9]+", query.lower()))
    bags = {f"d{i}": Counter(content(f"{t}\n{x}")) for i, (_, t, x) in enumerate(TEXTS)}
    bags = {k: b for k, b in bags.items() if b}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for k, bag in bags.items():
        score = 0.0
        for term in terms:
            df = sum(term in b for b in bags.values())
            if bag[term]:
                idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                score += idf * bag[term] * 2.5 / (bag[term] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / mean))
        if score > 0:
            out[k] = score
    return out


@pytest.mark.parametrize("small", [True, False])
def test_bm25_against_a_loop(spark, docs, queries, small, monkeypatch):
    # the second run takes the salted join, with every term hot
    monkeypatch.setattr(ranking, "is_small", lambda df: small)
    monkeypatch.setattr(relational, "HOT_ROWS", 1)
    got = ranking.bm25_scores(docs, queries).collect()
    for qid, query in enumerate(QUERIES):
        mine = {r["id"]: r["score"] for r in got if r["qid"] == qid}
        assert mine == pytest.approx(loop_bm25(query), abs=1e-8)


def test_block_scores_equal_the_full_scores(spark, docs, queries, monkeypatch):
    from corvane.operators import blocks

    many = docs.crossJoin(spark.range(30).withColumnRenamed("id", "n")).withColumn("id", F.concat_ws("-", "id", "n")).repartition(3).drop("n")
    order = [F.col("score").desc(), F.col("id")]
    monkeypatch.setattr(ranking, "BLOCK_CELLS", 200)  # several blocks in each task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    full = relational.top_k(ranking.bm25_scores(many, queries).select("qid", "corpus", "id", "score"), ["qid", "corpus"], order, 7)
    assert ranking.bm25_top(many, queries, 7, by=("corpus",)).exceptAll(full).isEmpty() and full.count() > 20
    full = ranking.top_candidates(ranking.tfidf_scores(many, queries), 7)
    block = ranking.tfidf_top(many, queries, 7)
    assert block.exceptAll(full).isEmpty() and full.exceptAll(block).isEmpty()
    monkeypatch.setattr(ranking, "is_small", lambda df: False)
    assert ranking.bm25_top(many, queries, 7).count() == ranking.bm25_top(many, queries, 7, by=("corpus",)).filter("rank <= 7").select("qid").distinct().count() * 7
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert blocks.DIGITS == ranking.SCORE_DIGITS


def test_tfidf_counts_repeats_within_corpus(docs, queries):
    got = {(r["qid"], r["id"]): r["score"] for r in ranking.tfidf_scores(docs, queries).collect()}
    idf = lambda n, df: math.log((n + 1) / (df + 1)) + 1
    assert got[(0, "d0")] == pytest.approx(2 * idf(3, 1) + 2 * idf(3, 1), abs=1e-8)
    assert got[(0, "d2")] == pytest.approx(idf(3, 2) + 2 * idf(3, 2), abs=1e-8)
    assert (3, "d0") not in got


def test_top_candidates_tie_by_id(docs, queries):
    top = ranking.top_candidates(ranking.tfidf_scores(docs, queries), 1).filter("qid = 0 AND corpus = 'raw'").collect()
    assert [r["id"] for r in top] == ["d2"]


def test_neighbours_of_large_shards_hold_tiles_of_scores(spark):
    import tracemalloc

    rng = np.random.default_rng(3)
    few = rng.normal(size=(60, 8)).round(1)
    docs, queries = few[rng.integers(0, 60, 9000)], few[rng.integers(0, 60, 2000)]
    tracemalloc.start()
    q, d, s = neighbours._best(queries, docs, 5, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all scores at once are 144 MB, and ordering them takes as much again
    assert peak < 120_000_000
    scores = np.maximum(np.round(queries @ docs.T, 9), 0.0)
    for row in range(0, 2000, 37):
        want = [i for i in np.argsort(-scores[row], kind="stable")[:5] if scores[row, i] >= 0.05]
        assert d[q == row].tolist() == want and s[q == row].tolist() == scores[row, want].tolist()
    table = spark.createDataFrame([(i, few[i % 60].tolist()) for i in range(900)], "id long, vector array<double>")
    asked = table.select(F.col("id").alias("qid"), "vector")
    rows = lambda **limits: sorted(map(tuple, neighbours.nearest(table, asked, 5, 0.05, **limits).collect()))
    assert rows(max_queries=10, shard_cells=2400) == rows(max_queries=10) == rows()


def test_neighbours_all_paths_agree(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(60, 8))
    q = rng.normal(size=(9, 8))
    docs = spark.createDataFrame([(f"v{i:02d}", int(i % 3), [float(x) for x in v]) for i, v in enumerate(d)], "id string, part int, vector array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid int, vector array<double>")
    for partition in (None, "part"):
        want = set()
        for qi in range(9):
            for p in (range(3) if partition else [None]):
                pool = [(f"v{i:02d}", max(0.0, round(float(q[qi] @ v), 9))) for i, v in enumerate(d) if p is None or i % 3 == p]
                best = sorted((x for x in pool if x[1] >= 0.05), key=lambda x: (-x[1], x[0]))[:4]
                want |= {(qi, p, i, round(s, 6)) for i, s in best}
        for limits in ({}, {"max_queries": 4, "shard_cells": 100}):
            found = neighbours.nearest(docs, queries, 4, 0.05, partition, **limits).collect()
            got = {(r["qid"], r["part"] if partition else None, r["id"], round(r["score"], 6)) for r in found}
            assert got == want


def test_next_pages_against_all_pairs(spark):
    words = ["tuition", "fees", "housing", "cox", "program", "deadline"]
    rows = [(f"wiki/p{i}", f"{words[i % 6]} page {i}", f"about {words[(i + 1) % 6]}s", [words[(i + 2) % 6]], [], float(i % 7), "semantic" if i % 4 == 0 else "source")
            for i in range(40)]
    pages = spark.createDataFrame(rows, "path string, title string, summary string, tags array<string>, entities array<string>, priority double, page_type string")
    asked = ["housing fee", "the program deadline", "zzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    shown = [(q, f"wiki/p{n}") for q in range(3) for n in (0, 4, 8, 12, 16)]
    got = retrieval.next_pages(pages, queries, spark.createDataFrame(shown, "qid int, path string")).collect()
    parts = retrieval.next_pages(pages, queries, spark.createDataFrame(shown, "qid int, path string"), query_part=1).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))
    nobody = retrieval.next_pages(pages, queries.limit(0), spark.createDataFrame([], "qid int, path string"))
    assert nobody.collect() == []
    for qid, query in enumerate(asked):
        scored = []
        for path, title, summary, tags, _, priority, kind in rows:
            if (qid, path) in shown:
                continue
            hay = f"{title} {summary} {' '.join(tags)} ".lower()
            score = sum(t in hay for t in set(content(query))) + priority / 100 + (5.0 if kind == "semantic" else 0)
            if score > 0:
                scored.append((-round(score, 9), title, path))
        assert [(r["path"]) for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == [s[2] for s in sorted(scored)[:5]]


def test_semantic_boost_reaches_unscored_pages(spark):
    rows = [(f"w{i}", f"wiki/pages/schools/cox-school-of-business/{i}.md" if i % 2 else f"wiki/pages/x{i}.md", "semantic" if i < 8 else "source", "") for i in range(12)]
    wiki = spark.createDataFrame(rows, "id string, path string, page_type string, source_priority string")
    queries = spark.createDataFrame([(1, "mba tuition and application"), (2, "plain words")], "qid int, query string")
    scores = spark.createDataFrame([(1, "w0", 2.0), (1, "w9", 3.0), (2, "w10", 1.0)], "qid int, id string, score double")
    scores = scores.join(wiki.select("id", retrieval.page_class().alias("page_class")), "id")
    got = retrieval.boost_semantic(scores, wiki, queries, 5).collect()
    for qid, wanted, several in ((1, True, True), (2, False, False)):
        base = {r[1]: r[2] for r in [(1, "w0", 2.0), (1, "w9", 3.0), (2, "w10", 1.0)] if r[0] == qid}
        full = {}
        for i, path, kind, _ in rows:
            if kind == "semantic":
                school = wanted and "cox" in path
                full[i] = base.get(i, 0) * 4 + 25 + (60 if school else 0) + (30 if several and school else 0)
            elif i in base:
                full[i] = base[i] * 0.85
        want = sorted(full.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(r["id"], r["score"]) for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])] == want


def test_raw_support_floor_and_cap(spark):
    docs = spark.createDataFrame([
        ("w1", "wiki", "w1", ["s1", "s2"], "", ""), ("r1", "raw", "s1", ["s1"], "", "fee " * 9), ("r2", "raw", "s1", ["s1"], "", "fee"),
        ("r3", "raw", "s2", ["s2"], "", "nothing"), ("r4", "raw", "s9", ["s9"], "", "fee"),
    ], "id string, corpus string, source_id string, source_ids array<string>, title string, text string")
    hits = spark.createDataFrame([(7, "w1")], "qid int, id string")
    queries = spark.createDataFrame([(7, "fee")], "qid int, query string")
    got = {r["id"]: r["score"] for r in retrieval.raw_support(docs, hits, queries, 50).collect()}
    assert got == pytest.approx({"r1": 0.25, "r2": 0.05, "r3": 0.0005})


def test_top_k_is_limited_before_the_shuffle(docs, queries, capsys):
    ranking.top_candidates(ranking.tfidf_scores(docs, queries), 3).explain("formatted")
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_large_k_takes_the_salted_round(spark):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    rows = spark.range(500).select(F.lit(1).alias("g"), F.col("id"))
    got = relational.top_k(rows, ["g"], [F.col("id")], 7).orderBy("rank").collect()
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert [r["id"] for r in got] == list(range(7))


@pytest.mark.parametrize("limits", [{}, {"max_queries": 1, "shard_cells": 8}])
def test_vectors_of_another_length_take_no_part(spark, limits):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, []), (6, [1.0, 0.0, 0.0])], "id int, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0]), (4, None), (5, [])], "qid int, vector array<double>")
    got = {(r["qid"], r["id"], r["score"]) for r in neighbours.nearest(docs, queries, 5, 0.0, **limits).collect()}
    assert got == {(1, 1, 1.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 1.0)}
    assert neighbours.nearest(docs, queries.limit(0), 5, **limits).collect() == []


def test_next_pages_after_eight_shown(spark):
    pages = spark.createDataFrame([(f"/p{i:02d}", f"T{i:02d}", "", [], [], float(i), "semantic") for i in range(30)],
                                  "path string, title string, summary string, tags array<string>, entities array<string>, priority double, page_type string")
    queries = spark.createDataFrame([(1, "nothing here")], "qid int, query string")
    shown = spark.createDataFrame([(1, f"/p{i:02d}") for i in range(22, 30)], "qid int, path string")
    assert [r["path"] for r in retrieval.next_pages(pages, queries, shown).orderBy("rank").collect()] == ["/p21", "/p20", "/p19", "/p18", "/p17"]


def test_stored_postings_give_the_same_best(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "raw" if i % 3 else "wiki", f"title {i % 5}", " ".join(["common"] * (i % 4) + [f"w{i % 7}", "Rare" if i == 5 else "x"])) for i in range(40)],
                                 "id string, corpus string, title string, text string")
    queries = spark.createDataFrame([(1, "common w3"), (2, "rare title"), (3, "absent"), (4, "")], "qid int, query string")
    lexical.write_postings(docs, str(tmp_path / "index"))
    rows = lambda df: sorted((r["qid"], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    index = lexical.StoredPostings(spark, str(tmp_path / "index"))
    stored = index.bm25_top(queries, 5)
    assert rows(stored) == rows(ranking.bm25_top(docs, queries, 5))
    assert rows(index.tfidf_top(queries, 3)) == rows(ranking.tfidf_top(docs, queries, 3))
    wiki = docs.filter("corpus = 'wiki'")
    assert rows(index.bm25_top(queries, 5, "wiki")) == rows(ranking.bm25_top(wiki, queries, 5))
    plan = stored._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term" in plan and "text#" not in plan


def test_stored_postings_make_no_row_for_each_pair(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:03}", "raw" if i % 3 else "wiki", "t", f"common w{i % 7} " * (1 + i % 4)) for i in range(60)] + [("none", "raw", "t", "--")],
                                 "id string, corpus string, title string, text string")
    queries = relational.constants(spark, [(i, f"common w{i % 9} common") for i in range(30)], "qid, query")
    lexical.write_postings(docs, str(tmp_path / "index"))
    index = lexical.StoredPostings(spark, str(tmp_path / "index"))
    classes = docs.select("id", F.col("corpus").alias("class"))
    rows = lambda df, by: sorted((r["qid"], r[by], r["id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    found = {"tfidf": index.tfidf_top(queries, 4), "bm25": index.bm25_top(queries, 4, classes=classes)}
    assert rows(found["tfidf"], "corpus") == rows(ranking.tfidf_top(docs, queries, 4), "corpus")
    assert rows(found["bm25"], "class") == rows(ranking.bm25_top(docs.withColumn("class", F.col("corpus")), queries, 4, by=("class",)), "class")
    for top in found.values():  # scored in blocks, not joined and summed by question and chunk
        plan = top._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate [qid" not in plan
    assert index.bm25_top(queries.limit(0), 4).count() == index.tfidf_top(queries.limit(0), 4).count() == 0


def test_stored_terms_are_counted_where_they_are_read(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a", "raw", "The Sun", "sun, SUN and moon"), ("b", "raw", None, "the of"), ("c", "wiki", "x", "")], "id string, corpus string, title string, text string")
    plan = lexical.counted_terms(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan
    root = str(tmp_path / "terms")
    lexical.write_postings(docs, root)
    plain = {(r["corpus"], r["id"], r["term"], r["tf"]) for r in spark.read.parquet(f"{root}/plain_postings").collect()}
    assert plain == {(r["corpus"], r["id"], r["term"], r["tf"]) for r in ranking.build_postings(docs).collect()}
    content = {(r["id"], r["dl"], r["term"], r["tf"]) for r in spark.read.parquet(f"{root}/content_postings").collect()}
    assert content == {("a", 4, "sun", 3), ("a", 4, "moon", 1), ("c", 1, "x", 1)}
    sizes = {r["corpus"]: (r["n_docs"], r["n_filled"], r["n_tokens"]) for r in spark.read.parquet(f"{root}/content_sizes").collect()}
    assert sizes == {"raw": (2, 1, 4), "wiki": (1, 1, 1)}


def test_stored_postings_leave_nothing_else_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "raw", "The title", f"word w{i} the") for i in range(20)], "id string, corpus string, title string, text string")
    scratch = shared_dir(spark)
    before = set(os.listdir(scratch))
    lexical.write_postings(docs, str(tmp_path / "index"))
    assert set(os.listdir(scratch)) == before  # what is written on the way is gone
    parts = list((tmp_path / "index" / "plain_postings").glob("part-*"))
    assert parts and all(".zstd." in p.name for p in parts)
    rows = lambda kind, term: sorted((r["id"], r["dl"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "index" / f"{kind}_postings")).filter(F.col("term") == term).collect())
    assert rows("plain", "the") == sorted((f"d{i}", 3, 1) for i in range(20)) and rows("content", "the") == [] == rows("plain", "title")
    assert rows("content", "title") == sorted((f"d{i}", 3, 1) for i in range(20))


def test_page_words_are_looked_up_once():
    asked = []

    def inside(word):
        asked.append(word)
        return np.array({"ab": [0, 2], "c": [1]}.get(word, []), np.int64)

    words = pa.array([["ab", "c", "x"], [], None, ["x"], ["c", "ab"]], pa.list_(pa.string()))
    for part, want in ((words, {(0, 0), (0, 2), (0, 1), (4, 1), (4, 0), (4, 2)}), (words.slice(3), {(1, 1), (1, 0), (1, 2)}), (words.slice(1, 2), set())):
        asked.clear()
        assert set(zip(*map(list, retrieval.token_rows(part, inside)))) == want
        assert len(asked) == len(set(asked))


def test_full_scores_of_a_small_query_set_shuffle_no_pairs(spark, docs, queries, monkeypatch):
    monkeypatch.setattr(ranking, "is_small", lambda df: True)
    monkeypatch.setattr(ranking, "BLOCK_CELLS", 40)
    many = docs.crossJoin(spark.range(30).withColumnRenamed("id", "n")).withColumn("id", F.concat_ws("-", "id", "n")).drop("n")
    block = ranking.bm25_scores(many, queries, carry=("title",))
    joined = ranking.bm25_joined(many, queries, carry=("title",))
    assert block.columns == joined.columns and block.count() == joined.count() > 100
    assert block.exceptAll(joined.select(block.columns)).isEmpty()
    assert "Aggregate" in joined._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in block._jdf.queryExecution().executedPlan().toString()
