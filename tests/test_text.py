import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.numbers import round_exact
from corvane.operators import chunking

SAMPLES = [
    "", " ", "The fee is due\n\n\n\non March 1.", "Ñandú café — naïve text", "a\r\nb\rc\x0bd e", "x" * 50 + "\n" * 5 + "y" * 50,
    "\x1c lead and trail \x1f", "Who is the dean?", "line\n", "one\n\ntwo\n\nthree",
]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def one(spark, values, column):
    return [r[0] for r in frame(spark, values).orderBy("i").select(column).collect()]


def test_tokens_and_lines_match_python(spark):
    assert one(spark, SAMPLES, X.tokens(F.col("v"))) == [re.findall("[a-z0-9]+", s.lower()) for s in SAMPLES]
    assert one(spark, SAMPLES, X.split_lines(F.col("v"))) == [s.splitlines() for s in SAMPLES]
    assert one(spark, SAMPLES, X.strip(F.col("v"))) == [s.strip() for s in SAMPLES]
    assert one(spark, SAMPLES, X.collapse_space(F.col("v"))) == [re.sub(r"\s+", " ", s).strip() for s in SAMPLES]


def loop_chunks(text, size, overlap):
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@pytest.mark.parametrize("size,overlap", [(7, 2), (10, 0), (3, 3), (1600, 200)])
def test_chunks_match_a_loop(spark, size, overlap):
    got = chunking.explode_chunks(frame(spark, SAMPLES), "v", size, overlap).orderBy("i", "chunk_index").collect()
    want = [(i, n, c) for i, s in enumerate(SAMPLES) for n, c in enumerate(loop_chunks(s, size, overlap), 1)]
    assert [(r["i"], r["chunk_index"], r["v"]) for r in got] == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n é", max_size=40), min_size=1, max_size=20))
def test_chunks_of_random_text(spark, values):
    got = chunking.explode_chunks(frame(spark, values), "v", 6, 2).orderBy("i", "chunk_index").collect()
    assert [(r["i"], r["v"]) for r in got] == [(i, c) for i, s in enumerate(values) for c in loop_chunks(s, 6, 2)]


def test_page_chunks_keep_tail_windows(spark):
    text = "z" * 1100
    got = chunking.explode_page_chunks(frame(spark, [text, ""]), "v").collect()
    assert [(r["chunk_index"], len(r["v"])) for r in got] == [(0, 1100), (1, 100)]


def test_blocks_are_packed_greedily(spark):
    blocks = ["a" * 4, "b" * 4, "c" * 25, "d" * 3]
    got = chunking.pack_blocks(frame(spark, ["\n\n".join(blocks)]), "v", 10).orderBy("part_index").collect()
    assert [r["v"] for r in got] == ["aaaa\n\nbbbb", "c" * 10, "c" * 10, "c" * 5, "ddd"]
    assert [r["part_index"] for r in got] == [1, 2, 3, 4, 5]


def test_snippet_centres_on_first_hit(spark):
    long = "word " * 100 + "needle here " + "tail " * 100
    got = one(spark, [long, "short text"], X.snippet(F.col("v"), F.array(F.lit("needle"))))
    compact = long.strip()
    start = compact.index("needle") - 80
    assert got[0] == "..." + compact[start : start + 320].strip() + "..."
    assert got[1] == "short text"


def test_keyword_score(spark):
    rows = spark.createDataFrame([("Tuition Fees", "The tuition and fees office, tuitions")], "title string, text string")
    tokens = F.array(F.lit("tuition"), F.lit("fees"), F.lit("tuition"))
    score = rows.select(X.keyword_score(tokens, F.col("title"), F.col("text"))).first()[0]
    assert score == pytest.approx(0.4 * 2 + 0.1 * 2)


def test_frontmatter(spark):
    page = "---\ntitle: Admissions\ntags:\n  - a\n  - b\nschool: cox\n---\n\n# Body\n"
    p = F.col("v")
    cols = F.struct(X.frontmatter_scalar(p, "title"), X.frontmatter_list(p, "tags"), X.frontmatter_list(p, "school"),
                    X.frontmatter_list(p, "none"), X.strip_frontmatter(p))
    got = one(spark, [page, "no marks"], cols)
    assert tuple(got[0]) == ("Admissions", ["a", "b"], ["cox"], [], "# Body\n")
    assert got[1][4] == "no marks"


def test_exact_rounding(spark):
    values = [k / n for n in (32, 160, 4000) for k in range(0, 300, 7)] + [2.675, 1.005, 65.445, -2.5, 0.0, 3000000.5, 2400000.125, 123456789.00005, -7e9 - 0.125, 1e15 + 0.5, 1e300, -1e18]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", round_exact(F.col("v"), 2).alias("a"), round_exact(F.col("v"), 4).alias("b")).collect()
    assert all(r["a"] == round(r["v"], 2) and r["b"] == round(r["v"], 4) for r in got)
