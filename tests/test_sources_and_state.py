import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import session
from corvane.functions.html import extract_content
from corvane.operators import documents, lineage, quality, registry, relational, state
from corvane.sources import files
from corvane.streaming import jobs

T0, T1 = "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"


# ------------------------------------------------------------------- relational
@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_lookup_with_a_hot_key(spark, hot_rows):
    # one key owns most rows; salted and plain plans must agree
    fact = spark.range(900).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    dim = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low")).filter("k % 7 <> 3")
    for how in ("left", "inner"):
        got = relational.lookup(fact, dim, ["k"], "n", how, hot_rows=hot_rows)
        want = fact.join(dim.drop("n"), ["k"], how)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_seen_before_and_upsert(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "pos int, k string")
    got = {r["pos"]: r["seen_before"] for r in relational.seen_before(rows, ["k"], "pos").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}
    old = spark.createDataFrame([("a", 9, "old"), ("b", 1, "old")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 1, "n1"), ("a", 2, "n2")], "k string, seq int, v string")
    assert {r["k"]: r["v"] for r in relational.upsert(old, new, ["k"], "seq").collect()} == {"a": "n2", "b": "old"}


# ---------------------------------------------------------------------- quality
def test_quality_actions(spark):
    menu = "\n".join(["Home", "About", "Search", "Menu"] * 3)
    rows = spark.createDataFrame([
        (0, "Students may apply for housing before the deadline in May each year."), (1, menu + "\nThe fee is 5 dollars."),
        (2, "hello"), (3, "call 214-768"), (4, "%PDF-1.4 1 0 obj stream"), (5, "a\x00b"), (6, "You are being redirected to a page"),
        (7, "- [a](http://a)\n- [b](http://b)\ntext here"), (8, ""),
    ], "i int, text string")
    got = {r["i"]: r for r in quality.assess(rows).collect()}
    assert [got[i]["action"] for i in range(9)] == [
        "approved", "cleaned", "needs_review", "approved", "quarantined", "quarantined", "quarantined", "cleaned", "needs_review"]
    assert got[1]["cleaned_text"] == "The fee is 5 dollars.\n" and got[4]["reasons"] == ["starts_with_pdf_signature", "contains_pdf_object_stream"]
    assert got[4]["recommended_parser_route"] == "pdf" and got[7]["link_line_ratio"] == round(2 / 3, 4)


def test_failure_classes(spark):
    c = F.col
    rows = spark.createDataFrame([
        (200, "text/html", 900, 0.1, None, None), (403, "text/html", 9, 0.0, None, None), (500, None, 9, 0.0, None, None),
        (200, "application/pdf", 9, 0.0, None, None), (200, "text/html", 0, 0.0, None, None), (200, "", 500, 0.5, None, None),
        (None, None, 0, 0.0, "TimeoutError", "x"), (None, None, 0, 0.0, "E", "robots deny"), (None, None, 0, 0.0, "E", "captcha"), (None, None, 0, 0.0, "E", ""),
    ], "s int, t string, n int, d double, e string, m string")
    got = [r[0] for r in rows.select(quality.failure_class(c("s"), c("t"), c("n"), c("d"), c("e"), c("m"))).collect()]
    assert got == [None, "blocked", "http_error", "non_html", "empty_content", "too_low_signal", "timeout", "robots_disallowed", "blocked", "parse_error"]
    score = spark.range(1).select(quality.scrape_score(F.lit(None).cast("string"), F.lit(2000), F.lit(3000), F.lit(0.5))).first()[0]
    assert score == 45 + 17.5 + 10 - 10


def test_html_body(spark):
    page = ("<html><head><title>T</title><script>x()</script></head><body><nav><a href='/n'>N</a></nav><h1>Big</h1>"
            "<p>One <b>two</b><!-- no --> three <a href='/x'>link</a></p><ul><li>i</li></ul><footer>f</footer></body></html>")
    row = spark.createDataFrame([(page,)], "h string").select(extract_content("h").alias("c")).first()["c"]
    assert row["text"] == "Big One two three link i" and row["text_length"] == len(row["text"])
    assert row["link_density"] == pytest.approx(1 / 6) and "# Big" in row["markdown"] and "[link](/x)" in row["markdown"]


# --------------------------------------------------------------------- registry
def reg(spark, rows):
    cols = "source_id string, checksum string, status string, wiki_status string, first_seen_at string, pos int"
    return spark.createDataFrame(rows, cols)


def test_merge_cases(spark):
    old = reg(spark, [("keep", "1", "ready", "integrated", T0, 0), ("same", "2", "needs-review", "integrated", T0, 0),
                      ("diff", "3", "ready", "integrated", T0, 0), ("bad", "4", "ready", "integrated", T0, 0)]).drop("pos")
    new = reg(spark, [("same", "2", "ready", None, None, 0), ("diff", "33", "READY", None, None, 1), ("bad", "44", "failed", None, None, 2),
                      ("new", "5", "ready", None, None, 3), ("twin", "5", "ready", None, None, 4), ("odd", "6", "strange", None, None, 5)])
    merged = registry.merge(old, new, T1)
    got = {r["source_id"]: r for r in merged.collect()}
    assert {k: r["change_state"] for k, r in got.items()} == {
        "keep": "new", "same": "unchanged", "diff": "changed", "bad": "failed", "new": "new", "twin": "needs-review", "odd": "needs-review"}
    assert got["same"]["status"] == "needs-review" and got["same"]["last_seen_at"] == T1  # the old row is kept whole
    assert got["diff"]["previous_checksum"] == "3" and got["diff"]["wiki_status"] == "pending" and got["diff"]["first_seen_at"] == T0
    assert got["bad"]["wiki_status"] == "integrated" and got["twin"]["error_reason"] == "duplicate_checksum:new"
    assert got["keep"]["last_seen_at"] == T1 or got["keep"]["last_seen_at"] is not None
    counts = {r["name"]: r["n"] for r in registry.change_counts(merged).collect()}
    assert counts == {"unchanged": 1, "needs-review": 3, "changed": 1, "ready": 2, "failed": 1, "new": 1}


def test_registry_log_reader(spark, tmp_path):
    path = tmp_path / "registry.jsonl"
    path.write_text('{"source_id":"a","checksum":"1"}\nnot json\n\n{"source_id":"a","checksum":"2","status":"weird"}\n{"checksum":"x"}\n[1]\n')
    rows, corrupt = files.read_registry(spark, str(path), T0)
    assert [(r["source_id"], r["checksum"], r["status"]) for r in rows.collect()] == [("a", "2", "needs-review")]
    assert corrupt.filter("value = 'not json'").count() == 1


def test_json_and_csv_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"url":"u1"},{"url":"u2"},7] trailing')
    (tmp_path / "b.json").write_text("{broken")
    schema = T.StructType([T.StructField("url", T.StringType())])
    got = files.read_json_document(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], schema)
    assert {r["url"] for r in got.collect()} == {"u1", "u2"}
    (tmp_path / "t.csv").write_text('﻿a,b\n"x|y",2,3\n', encoding="utf-8")
    rows = files.read_csv_rows(spark, str(tmp_path / "t.csv"))
    lines = [r["line"] for r in documents.markdown_rows(rows, ["path"], "pos").orderBy("pos", "part").collect()]
    assert lines == ["| a | b |  |", "| --- | --- | --- |", "| x\\|y | 2 | 3 |"]
    (tmp_path / "l.jsonl").write_text('{"url":"a"}\nnope\n{"url":"b"}\n')
    assert {r["url"] for r in files.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema).collect()} == {"a", "b"}


def test_csv_rows_keep_empty_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',a,b\n,,\n"",x\nz,\n')
    rows = files.read_csv_rows(spark, str(tmp_path / "t.csv")).orderBy("pos").collect()
    assert [r["cells"] for r in rows] == [["", "a", "b"], ["", "", ""], ["", "x"], ["z", ""]]


def test_markdown_tree_and_vectors(spark, tmp_path):
    (tmp_path / "w" / "x").mkdir(parents=True)
    (tmp_path / "w" / "x" / "a.md").write_text("# A\n")
    (tmp_path / "w" / "b.txt").write_text("no")
    rows = files.read_markdown_tree(spark, str(tmp_path / "w")).collect()
    assert [(r["path"], r["text"]) for r in rows] == [("x/a.md", "# A\n")]
    good = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>")
    assert files.replace_vectors(good, str(tmp_path / "v1"), 2) == 1
    with pytest.raises(ValueError):
        files.replace_vectors(good, str(tmp_path / "v2"), 3)
    assert not (tmp_path / "v2").exists()


# ---------------------------------------------------------------------- lineage
def test_stale_chain(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source_id string, content_hash string")
    new = spark.createDataFrame([("a", "9"), ("b", "2"), ("d", "4"), ("c", "8")], "source_id string, content_hash string")
    edges = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p3")], "source_id string, page_id string")
    changed = lineage.transitions(old, new)
    links = lineage.stale_links(changed, edges)
    assert {tuple(r) for r in links.collect()} == {("a", "p1"), ("a", "p2")}
    assert {r["source_id"]: r["affected_pages"] for r in lineage.transition_counts(changed, links).collect()} == {"a": 2, "c": 0}
    bad = spark.createDataFrame([(0, " ", "h"), (1, "x", ""), (2, "x", "h1"), (3, "x", "h2")], "pos int, source_id string, content_hash string")
    valid, errors = lineage.check_hashes(bad)
    assert [r["content_hash"] for r in valid.collect()] == ["h2"] and errors.count() == 2


def test_contradictions_walk_in_path_order(spark):
    def page(ids, clash=True):
        return "---\ntitle: t\nsource_ids:\n" + "".join(f"  - {i}\n" for i in ids) + "---\n\n" + ("A contradiction here\n" if clash else "fine\n")

    specs = [["a", "b"], ["a", "c"], ["a", "c", "b", "d"], ["z"], ["q", "a"], ["a"]]
    pages = spark.createDataFrame([(f"p{i}", page(ids)) for i, ids in enumerate(specs)] + [("p9", page(["n"], False))], "path string, text string")
    queued = spark.createDataFrame([("q",)], "source_id string")
    taken, want = {"q"}, set()
    for i, ids in enumerate(specs):
        pick = next((s for s in ids if s not in taken), None)
        if pick:
            taken.add(pick)
            want.add((pick, f"p{i}"))
    assert {(r["source_id"], r["path"]) for r in lineage.contradictions(pages, queued).collect()} == want


def test_review_items(spark):
    text = "# Top\n- [ ] `s1` reason = a conflict in text\n## Low\n- [ ] plain: check this\n- [x] done\n"
    got = [tuple(r) for r in lineage.review_items(spark.createDataFrame([("q", text)], "path string, text string")).orderBy("line_number").collect()]
    assert got == [("q", 2, "s1", "a conflict in text", "contradiction", "Top"), ("q", 4, "", "check this", "review", "Low")]


# -------------------------------------------------------------------- documents
def test_sections_and_tables(spark):
    text = "# A\n## B\n| h | i |\n|---|:---:|\n| 1 | 2 |\n\n| x |\n| - |\n## C\n| h |\n| --- |\n"
    rows = spark.createDataFrame([(1, text), (2, "no heads"), (3, "### X\n# Y\n## Z\n### W")], "k int, text string")
    paths = [r[0] for r in rows.orderBy("k").select(documents.section_path(F.col("text"))).collect()]
    assert paths == ["A > C", "", "Y > Z > W"]
    tables = [(r["k"], r["table_no"], r["row_count"]) for r in documents.table_rows(rows, ["k"]).orderBy("k", "table_no").collect()]
    assert tables == [(1, 1, 1), (1, 2, 0)]


def test_scaffold(spark):
    rows = spark.createDataFrame([("s1", "web", "Fees", "u", "# Head\nAbout tuition\n---\n", 0), ("s2", "csv", "X", "", "a", 1), ("s3", "web", "My Page!", "", "", 2)],
                                 "source_id string, source_kind string, title string, url string, body string, pos int")
    pages, pieces = documents.scaffold_pages(rows)
    assert {r["slug"]: r["title"] for r in pages.collect()} == {"finance": "Finance", "programs": "Programs", "my-page": "My Page!"}
    assert {r["source_id"]: r["excerpt"] for r in pieces.collect()} == {"s1": "Head\nAbout tuition", "s2": "a", "s3": ""}


# ------------------------------------------------------------------------ state
def loop_windows(times, limit, window):
    out, start, n = [], None, 0
    for at in sorted(times):
        if start is None or at - start > window:
            if start is not None:
                out.append((start, n))
            start, n = at, 0
        n += 1
    return [(s, k, min(k, limit), k - min(k, limit)) for s, k in out + [(start, n)]]


def test_budget_windows_against_a_loop(spark):
    times = {"a": [0, 1, 1, 5, 11, 12, 30, 41, 42], "b": [7] * 20 + [18, 19], "c": [3]}
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, s long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    got = state.budget_windows(rows, "k", "s", limit=3, window=10).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, ts in times.items():
        mine = sorted(tuple(r)[1:] for r in got if r["k"] == k)
        assert mine == loop_windows(ts, 3, 10)


def test_loop_guard_batch_and_stream_agree(spark, tmp_path):
    events = [("q", 1, 0.0, "ask"), ("q", 2, 5.0, "ask"), ("q", 3, 6.0, "failed"), ("q", 4, 7.0, "ask"), ("q", 5, 8.0, "failed"), ("q", 6, 9.0, "ask"),
              ("q", 7, 9.5, "failed"), ("q", 8, 10.0, "ask"), ("q", 9, 60.0, "ask"), ("r", 1, 0.0, "failed"), ("r", 2, 1.0, "ask"), ("r", 3, 2.0, "succeeded"), ("r", 4, 3.0, "ask")]
    rows = spark.createDataFrame(events, "k string, n int, s double, e string")
    want = {("q", 1): "started", ("q", 2): "pending", ("q", 3): "retry_counted", ("q", 4): "started", ("q", 5): "retry_counted", ("q", 6): "started",
            ("q", 7): "retry_counted", ("q", 8): "ingest_retry_exhausted", ("q", 9): "started",
            ("r", 1): "ignored", ("r", 2): "started", ("r", 3): "cleared", ("r", 4): "started"}
    batch = {(r["k"], r["n"]): r["outcome"] for r in state.loop_guard(rows, "k", "n", "s", "e", ttl=20).collect()}
    assert batch == want
    rows.filter("n <= 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("n > 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, per_trigger=1)
    done = spark.read.parquet(jobs.to_table(jobs.guard_stream(stream, "k", "n", "s", "e", ttl=20)))
    assert {(r["k"], r["n"]): r["outcome"] for r in done.collect()} == want


def test_index_log_replaces_removes_and_retries(spark, tmp_path):
    table = jobs.IndexTable(spark, str(tmp_path / "t"), "doc_id bigint, chunk int, text string")
    assert table.read().collect() == []
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, chunk int, text string")
    state = lambda: sorted(tuple(r) for r in table.read().collect())
    first = make((1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"))
    table.replace(first, first, "b0")
    table.replace(make((1, 1, "z")), make((1, 1, ""), (2, 1, "")), "b1")  # shortened and removed
    assert state() == [(1, 1, "z")] and [v for v, _ in table.versions()] == [0, 1]
    table.replace(make((3, 1, "n")), make((3, 1, "")), "b1")  # the batch is tried again
    assert state() == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (3, 1, "n")] and len(table.versions()) == 2


def test_a_later_run_reads_new_files_only(spark, tmp_path):
    landing, seen = str(tmp_path / "in"), []
    rows = spark.range(5).select(F.col("id"))
    for part in (rows.filter("id < 2"), rows.filter("id >= 2")):
        part.coalesce(1).write.mode("append").parquet(landing)
        jobs.run_available(jobs.read_stream(spark, landing, rows.schema), lambda df, n: seen.append((n, df.count())), checkpoint=str(tmp_path / "c"))
    assert seen == [(0, 2), (1, 3)]


def test_empty_stream_leaves_a_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert spark.read.parquet(jobs.to_table(jobs.read_stream(spark, str(tmp_path / "none"), "id int"))).count() == 0


def test_hot_keys_are_salted_by_weight(spark):
    fact = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    dim = fact.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v"))
    got = relational.lookup(fact, dim, ["k"], "n", hot_rows=50)
    assert got.count() == 1000 and got.filter("k = 'hot' AND v <> 899").count() == 0


def test_shared_folder_must_be_named_off_one_machine(spark):
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_json_tail_skips_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"id": 1}) + "\nbroken\n" + json.dumps({"id": 2}) + "\n")
    path = jobs.to_table(jobs.tail_json(spark, str(tmp_path / "in"), "id int"))
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_site_resolution(spark):
    sites = spark.createDataFrame([("x.edu", "Example University", "x.edu", True), ("y.edu", "Other", "y.edu", False)], "site_id string, name string, domain string, enabled boolean")
    asked = spark.createDataFrame([(1, "x.edu", ""), (2, "zz", ""), (3, "", "example"), (4, "", "edu"), (5, "", "the example university site"), (6, "", "")],
                                  "rid int, site_id string, hint string")
    got = {r["rid"]: (r["resolved"], r["error"]) for r in state.resolve_sites(asked, sites).collect()}
    assert got == {1: ("x.edu", ""), 2: (None, "site_not_found"), 3: ("x.edu", ""), 4: (None, "ambiguous_university"), 5: ("x.edu", ""), 6: ("x.edu", "")}


def test_batches_for_python_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from corvane.session import configure

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    configure(spark)
    found = [r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 20_000_000 and max(found) < 6_000_000


def test_stale_packet_sends_no_table_through_the_driver(spark):
    from corvane.plans import maintenance

    hashes = lambda extra: spark.range(50).select(F.concat(F.lit("s"), "id").alias("source_id"), F.sha1(F.concat(F.col("id").cast("string"), F.lit(extra))).alias("content_hash"))
    edges = spark.range(50).select(F.concat(F.lit("s"), "id").alias("source_id"), F.concat(F.lit("p"), F.expr("id div 7")).alias("page_id"))
    for name, rows in maintenance.stale_packet(hashes(""), hashes("!"), edges).items():
        joins = [line for line in rows._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        # the list of hot keys, which is bounded, may be broadcast
        assert not [line for line in joins if "LeftOuter" not in line or "_salt" in line], name
        assert rows.count() == (8 if name == "stale_pages" else 50)
