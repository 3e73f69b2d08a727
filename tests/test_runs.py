"""Stored packets, sidecars, CSV records, sitemaps, approvals and eager scores against brute force."""

import csv
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.vectors import hashed_tokens_embedding
from corvane.operators import approvals, crawl, neighbours
from corvane.plans import eager, index, ingest, maintenance
from corvane.sources import files, sidecars

TABLES = {"a": "x bigint", "b": "y string"}


def packet(spark, n, fail=False):
    b = spark.range(n).select(F.concat(F.lit("y"), "id").alias("y"))
    if fail:
        b = b.withColumn("y", F.when(F.col("y") != "", F.raise_error(F.lit("disk full"))).otherwise(F.col("y")))
    return {"a": spark.range(n).select(F.col("id").alias("x")), "b": b}


def seen(store, table):
    return sorted((r["packet_id"], r[1]) for r in store.read(table).collect())


def test_packets_show_all_their_tables_or_none(spark, tmp_path):
    store = maintenance.PacketStore(spark, str(tmp_path / "s"), TABLES, most_open=3)
    assert seen(store, "a") == [] and store.folders("a") == []
    with pytest.raises(Exception, match="disk full"):
        store.commit("p0", packet(spark, 2, fail=True))
    assert seen(store, "a") == [] and not store.committed("p0")
    assert store.commit("p0", packet(spark, 2)) and not store.commit("p0", packet(spark, 2))
    assert seen(store, "a") == [("p0", 0), ("p0", 1)] and seen(store, "b") == [("p0", "y0"), ("p0", "y1")]
    with pytest.raises(ValueError):
        store.commit("p1", {"a": spark.range(1)})


def test_reads_touch_few_folders(spark, tmp_path):
    store = maintenance.PacketStore(spark, str(tmp_path / "s"), TABLES, most_open=2)
    for n in range(7):
        assert store.commit(f"p{n}", packet(spark, 1))
        assert len(store.folders("a")) <= 3
    again = maintenance.PacketStore(spark, str(tmp_path / "s"), TABLES, most_open=2)
    assert [p for p, _ in seen(again, "b")] == [f"p{n}" for n in range(7)]
    # packets inside a snapshot are still known
    assert not any(again.commit(f"p{n}", packet(spark, 1)) for n in range(7)) and len(seen(again, "a")) == 7
    again.compact()
    assert len(again.folders("a")) == 1 and len(seen(again, "a")) == 7


def test_sidecars_are_judged_by_content(spark, tmp_path):
    texts = {"a.json": '{"b": 1, "a": {"d": [1, 2.50], "c": "é"}}', "b.json": '{"a":{"c":"é","d":[1,2.5]},"b":1}', "c.json": "[1]", "d.json": "{no", "e.json": "null", "f.json": '"x"'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "h.txt").write_text("{}")
    rows = {os.path.basename(r["path"]): r for r in sidecars.read_sidecars(spark, str(tmp_path)).withColumn("m", F.to_json("metadata")).drop("metadata").collect()}
    assert {k: r["m"] for k, r in rows.items()} == {
        "a.json": '{"a":{"c":"é","d":[1,2.5]},"b":1}', "b.json": '{"a":{"c":"é","d":[1,2.5]},"b":1}', "c.json": '{"value":[1]}', "d.json": "{}", "e.json": '{"value":null}',
        "f.json": '{"value":"x"}'}
    assert rows["a.json"]["digest"] == rows["b.json"]["digest"] != rows["c.json"]["digest"] and rows["a.json"]["checksum"] != rows["b.json"]["checksum"]
    assert [rows[k]["readable"] for k in sorted(rows)] == [True, True, True, False, True, True]
    bare = sidecars.parse_sidecars(spark.createDataFrame([("g", ""), ("h", None)], "path string, content string"))
    assert [(r[0], r[1]) for r in bare.select(F.to_json("metadata"), "readable").collect()] == [("{}", False)] * 2


def test_reuse_looks_at_sidecars_where_both_sides_have_them(spark):
    chunk = "id string, checksum string, chunk_settings string"
    now = spark.createDataFrame([("a", "1", "s"), ("b", "1", "s")], chunk)
    old = now.withColumns({"index_version": F.lit(index.INDEX_VERSION), "embedding_space": F.lit(index.DENSE), "vector": F.array(F.lit(1.0))})
    digest = F.when(F.col("id") == "a", "x").otherwise("")
    kept, changed = index.split_reusable(now.withColumn("parser_digest", F.lit("")), old.withColumn("parser_digest", digest), 1)
    assert [r["id"] for r in kept.collect()] == ["b"] and [r["id"] for r in changed.collect()] == ["a"]
    assert index.split_reusable(now.withColumn("parser_digest", F.lit("")), old, 1)[0].count() == 2


def test_csv_records_equal_the_csv_module(spark, tmp_path):
    random.seed(11)
    parts = ["a", "b", '"', '""', ",", "\n", "\r\n", " ", "é", '"x\ny"', ',"p, q"', ",\n"]
    want = {}
    for i in range(5):
        text = ("﻿" if i == 0 else "") + "".join(random.choice(parts) for _ in range((3, 20, 60, 90, 0)[i])) + ('\n"' + "long\n" * 60 + '",end' if i == 3 else "")
        path = tmp_path / f"{i}.csv"
        path.write_text(text, encoding="utf-8", newline="")
        with open(path, encoding="utf-8-sig", newline="") as f:
            want[path.name] = list(csv.reader(f))
    got = {name: [] for name in want}
    for r in files.read_csv_rows(spark, str(tmp_path), split_bytes=80).collect():
        got[os.path.basename(r["path"])].append((tuple(r["pos"]), r["cells"]))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == want


def test_sitemap_walk_ends_in_cycles(spark):
    index_of = lambda *children: "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"
    urls = lambda *locs: "<urlset>" + "".join(f"<url><loc>https://a.edu/{u}</loc></url>" for u in locs) + "</urlset>"
    maps = [("r", index_of("a", "b", "r")), ("a", index_of("c", "r", "gone")), ("b", urls("x", "admission")), ("c", urls("admission", "y")), ("lost", urls("z")), ("bad", "<urlset")]
    entries = crawl.parse_sitemaps(spark.createDataFrame(maps, "sitemap string, xml string"))
    visited = crawl.visit_sitemaps(entries, spark.createDataFrame([("r",), ("r",)], "sitemap string"))
    assert {tuple(r) for r in visited.collect()} == {("r", 0, True), ("a", 1, True), ("b", 1, True), ("c", 2, True), ("gone", 2, False)}
    found = crawl.discovered_by_visits(entries, visited, "www.a.edu")
    assert {(r["url"], r["source_sitemap"], r["depth"]) for r in found.collect()} == {("https://a.edu/x", "b", 1), ("https://a.edu/admission", "b", 1), ("https://a.edu/y", "c", 2)}
    chain = spark.createDataFrame([(f"s{i}", index_of(f"s{i + 1}")) for i in range(6)], "sitemap string, xml string")
    with pytest.raises(RuntimeError):
        crawl.visit_sitemaps(crawl.parse_sitemaps(chain), spark.createDataFrame([("s0",)], "sitemap string"), rounds=4)


def test_sitemap_seeds(spark):
    sites = spark.createDataFrame([("https://a.edu/x", "User-agent: *\nSITEMAP: https://a.edu/one.xml \nSitemap:\nsitemap:https://a.edu/two.xml"), ("http://b.edu", None), ("http://c.edu/", "Disallow: /")], "site_url string, robots string")
    got = {}
    for r in crawl.sitemap_seeds(sites).collect():
        got.setdefault(r["site_url"], set()).add(r["sitemap"])
    assert got["https://a.edu/x"] == {"https://a.edu/one.xml", "https://a.edu/two.xml"}
    assert got["http://b.edu"] == {f"http://b.edu{p}" for p in crawl.COMMON_SITEMAPS} and len(got["http://c.edu/"]) == 4


@pytest.mark.parametrize("part_words", [100_000, 1])
def test_approval_words_and_limits(spark, part_words, monkeypatch):
    monkeypatch.setattr(approvals, "PART_WORDS", part_words)
    urls = ["https://a.edu/housing/rooms", "https://a.edu/housing/rooms/2", "https://a.edu/tuition", "https://a.edu/law/x", "https://a.edu/login", "https://a.edu/", "https://a.edu/apply/now", "https://a.edu/tuition"]
    rows = spark.createDataFrame([(i, u, "", None, "operator_rejected_area" if i == 1 else None) for i, u in enumerate(urls)], "pos bigint, url string, title string, lastmod string, excluded_reason string")
    said = [(1, "approve housing"), (2, "approve law pages"), (3, "take https://a.edu/new/one. and top 1"), (4, None), (5, "2 urls"), (6, "tuition but avoid housing"), (7, "zzzz"), (8, "path:/tuition/ please zzzz")]
    got = {}
    for r in approvals.approval_candidates(spark.createDataFrame(said, "msg_id bigint, message string"), rows).orderBy("msg_id", "place").collect():
        got.setdefault(r["msg_id"], []).append(r["url"].removeprefix("https://a.edu/"))
    every = [u.removeprefix("https://a.edu/") for u in (urls[0], urls[2], urls[3], urls[5], urls[6])]
    assert got[1] == ["housing/rooms"] and got[2] == ["law/x"] and got[3] == ["new/one"]
    assert got[4] == every and got[5] == every[:2] and got[6] == ["tuition"] and got[7] == every and got[8] == ["tuition"]


def test_approval_lists_stop_at_the_number_asked(spark, monkeypatch):
    stored = {}
    keep = approvals.through_table
    monkeypatch.setattr(approvals, "through_table", lambda df, label: stored.setdefault(label, keep(df, label)))
    rows = spark.createDataFrame([(i, f"https://a.edu/housing/r{i}", "", None, None) for i in range(30)], "pos bigint, url string, title string, lastmod string, excluded_reason string")
    new = " ".join(f"https://a.edu/new/n{i}" for i in range(1010))
    said = spark.createDataFrame([(1, "top 2 housing"), (2, f"add {new}")], "msg_id bigint, message string")
    got = {}
    for r in approvals.approval_candidates(said, rows).orderBy("msg_id", "place").collect():
        got.setdefault(r["msg_id"], []).append(r["url"])
    assert got[1] == ["https://a.edu/housing/r0", "https://a.edu/housing/r1"]
    assert got[2][:1010] == new.split(" ") and [r.msg_id for r in stored["message-groups"].collect()].count(1) == 2


def test_message_terms(spark):
    said = [("approve Tuition and student-life pages", ["tuition", "bursar", "billing", "payment", "cost", "housing", "dining", "student-life", "health", "counseling", "parking", "orientation", "accessibility"]),
            ("scrape everything, do not include tuition", ["everything"]), ("", []), (None, [])]
    df = spark.createDataFrame([(m,) for m, _ in said], "m string")
    assert [r[0] for r in df.select(approvals.message_terms(F.col("m"))).collect()] == [w for _, w in said]
    roots = df.sparkSession.createDataFrame([(["law"],), (["dedman", "law"],), (["schools", "dedman", "law"],), (["cox"],), ([],)], "t array<string>")
    assert [r[0] for r in roots.select(approvals.term_roots(F.col("t"))).collect()] == [sorted(crawl.school_roots(t)) for t in (["law"], ["dedman", "law"], ["schools", "dedman", "law"], ["cox"], [])]


def test_eager_scores_without_text_or_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "wiki", "T", "the cat sat"), ("b", "wiki", "T", "cat cat dog"), ("c", "wiki", "", ""), ("d", "wiki", "T", "été déjà vu")], "id string, corpus string, title string, text string")
    asked = spark.createDataFrame([(1, "cat cat"), (2, "the of"), (3, "ÉTÉ"), (4, None)], "qid int, query string")
    eager.write_scores(docs, str(tmp_path / "e"))
    got = {(r["qid"], r["id"]): r["score"] for r in eager.eager_top(spark, str(tmp_path / "e"), asked, 5).collect()}
    idf, mean = np.log(1 + (4 - 2 + 0.5) / 2.5), (2 + 3 + 0 + 3) / 4
    want = lambda tf, length: round(idf * tf / (tf + 1.5 * (0.25 + 0.75 * length / mean)), 9)
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "a"): want(1, 2), (1, "b"): want(2, 3)}
    assert {k for k in got if k[0] > 1} == {(3, "d")}
    assert {r["id"] for r in eager.eager_top(spark, str(tmp_path / "none"), asked, 5, docs).collect()} >= {"a", "b"}
    with pytest.raises(FileNotFoundError):
        eager.eager_top(spark, str(tmp_path / "none"), asked, 5)


def test_scores_of_six_decimals_are_exact():
    rng = np.random.default_rng(3)
    left, right = np.round(rng.normal(size=(9, 40)) / 7, 6), np.round(rng.normal(size=(30, 40)) / 7, 6)
    exact = [[sum(round(a * 10**6) * round(b * 10**6) for a, b in zip(x, y)) for y in right] for x in left]
    want = [[((e + 500) // 1000) / 10**9 for e in row] for row in exact]
    assert neighbours._dots(left, right, 6).tolist() == want
    order = rng.permutation(40)
    assert (neighbours._dots(left, right, 6) == neighbours._dots(left[:, order], right[:, order], 6)).all()


def test_ingest_counts_start_no_jobs_of_their_own(spark, tmp_path):
    totals = ingest.Totals()
    totals.of("x", spark.range(10), rows=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1)).write.parquet(str(tmp_path / "x"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    before = jobs()
    assert totals.get("x") == {"rows": 10, "odd": 5} and jobs() == before
    broken = ingest.ingest(spark.createDataFrame([], "source_id string, checksum string"), spark.range(1), spark.range(1), hashed_tokens_embedding(8), str(tmp_path / "s"), "2026-01-01T00:00:00Z", "run")
    assert broken["status"] == "failed" and broken["failed_stage"] == "normalize"
    assert ingest.stage_totals(spark, {"normalized": {"rows": 1}, "pages": 2}).count() == 2


def test_markdown_files_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "w")
    files.write_markdown_tree(spark.createDataFrame([("a/b.md", "long text"), ("c.md", "x")], "path string, text string"), root)
    files.write_markdown_tree(spark.createDataFrame([("a/b.md", "é")], "path string, text string"), root)
    assert {(r["path"], r["text"]) for r in files.read_markdown_tree(spark, root).collect()} == {("a/b.md", "é"), ("c.md", "x")}


def test_markdown_tree_of_small_files_has_few_tasks(spark, tmp_path):
    root = tmp_path / "t"
    want = {}
    for i in range(400):
        path = f"{'a b/c.d/' if i % 2 else ''}e{i % 3}/n {i}.md"
        want[path] = "ü" * (i % 5)
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(want[path])
    for hidden in ("_h/x.md", ".h.md", "e0/_x.md", "e0/x.txt"):
        (root / hidden).parent.mkdir(exist_ok=True)
        (root / hidden).write_text("no")
    tree = files.read_markdown_tree(spark, str(root))
    rows = tree.collect()
    assert {r["path"]: r["text"] for r in rows} == want and all(r["size_bytes"] == len(want[r["path"]].encode()) for r in rows)
    assert {int(r["modified_at"].timestamp()) for r in rows} == {int((root / p).stat().st_mtime) for p in want}
    assert tree.rdd.getNumPartitions() <= 8
    (tmp_path / "none").mkdir()
    assert files.read_markdown_tree(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception):
        files.read_markdown_tree(spark, str(tmp_path / "missing")).count()


def test_eager_scores_read_texts_once(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        looked.add(1)
        return "the cat sat" if n % 2 else ""

    docs = spark.range(6).select(F.col("id").cast("string").alias("id"), F.lit("wiki").alias("title"), text.asNondeterministic()("id").alias("text"))
    eager.write_scores(docs, str(tmp_path / "e"))
    # six chunks of 12 words: cat and sat stand in three of them
    idf, share = np.log(1 + (6 - 3 + 0.5) / 3.5), 1 / (1 + 1.5 * (0.25 + 0.75 * 3 / (12 / 6)))
    got = {r["id"]: r["score"] for r in eager.eager_top(spark, str(tmp_path / "e"), spark.createDataFrame([(1, "cat")], "qid int, query string"), 9).collect()}
    assert got == {i: round(idf * share, 9) for i in ("1", "3", "5")}
    assert looked.value == 6
