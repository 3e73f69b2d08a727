"""Phrase index, whitening and collocations against brute force, and on odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.llm import collocations, phrase_index, whitening
from tests.llm.test_operators import ODD, docs

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- phrase index -------------------------------------------------------------

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute_phrases(texts, items, width, within):
    """Hit words, items and near items of each text."""
    out = []
    for text in texts:
        words, hit, found, near = bench_words(text), set(), set(), set()
        for item, body in items:
            own = bench_words(body)
            for at in range(max(1, len(own) - width + 1) if own else 0):
                window = own[at : at + width]
                for i in range(len(words) - len(window) + 1):
                    if words[i : i + len(window)] == window:
                        hit |= set(range(i, i + len(window)))
                        found.add(item)
                if any(set(window) <= set(words[i : i + within]) for i in range(len(words))):
                    near.add(item)
        out.append((len(words), len(hit), sorted(found), sorted(near)))
    return out


def test_phrase_index_is_written_and_read_a_few_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "GROUP_BYTES", 4000)
    rng = random.Random(8)
    table = spark.createDataFrame([(i, " ".join(rng.choice("abcdef") + str(rng.randrange(500)) for _ in range(300))) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    index = phrase_index.build_index(table, ["doc_id"], shard_bytes=1000)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in index.inputFiles()]
    assert index.count() >= 50 and sum(groups) >= 10
    sizes, read = [], phrase_index.keep
    monkeypatch.setattr(phrase_index, "keep", lambda df, label, **o: (sizes.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")), read(df, label, **o))[1])
    phrase_index.find(index, spark.createDataFrame([(1, "a1 b2")], "item_id bigint, text string"))
    assert sizes[-1] == str(phrase_index.BATCH_BLOCKS) and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") != sizes[-1]


@pytest.mark.parametrize("part_windows,shard_bytes", [(1_000_000, 1_000_000), (7, 1_000_000), (1_000_000, 90), (5, 60)])
def test_phrases_equal_brute_force(spark, part_windows, shard_bytes):
    random.seed(5)
    letters = ["a", "B", "c", "Dé", "e1", "été"]
    text = lambda n: "".join(random.choice(letters) + random.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(random.choice([1, 2, 3, 4, 6, 9]))) for i in range(9)] + [(3, "b c"), (50, ""), (51, None), (52, " .,")]
    texts = [text(random.randint(0, 40)) for _ in range(25)] + ["", None, items[5][1], items[5][1] * 3, "É é", text(3000)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    index = phrase_index.build_index(table, ["doc_id"], shard_bytes=shard_bytes)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in phrase_index.find(index, bench, width=4, within=6, part_windows=part_windows).collect()}
    want = brute_phrases(texts, items, 4, 6)
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["near_items"]) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        spans = got[i]["spans"]
        assert len({w for s in spans for w in range(s["first"], s["last"] + 1)}) == want[i][1] and all(s["last"] < want[i][0] for s in spans)


def test_phrases_stay_inside_documents(spark):
    table = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "one two three four")], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    rows = phrase_index.find(phrase_index.build_index(table, ["doc_id"]), bench, within=4).collect()
    assert {r["doc_id"]: (r["n_hit"], r["near_items"]) for r in rows} == {1: (0, []), 2: (0, []), 3: (4, [1])}


def test_phrases_on_odd_rows(spark):
    table = docs(spark, ODD).withColumn("items", F.lit("own")).withColumn("n_words", F.lit("own"))
    bench = spark.createDataFrame([(None, "one two three four five"), (7, "word word"), (7, "one")], "item_id bigint, text string")
    index = phrase_index.build_index(table, ["doc_id", "lang", "items", "n_words", "score"])
    got = phrase_index.find(index, bench)
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["near_items"], r["score"]) for r in got.collect()), key=str)
    want = sorted(((i, *b[:2], [x for x in (7, None) if x in b[2]], [], "w") for (i, *_), b in zip(ODD, (
        (len(bench_words(t)), *_plain(t)) for _, t, _, _ in ODD))), key=str)
    assert rows == want
    none = docs(spark, [])
    assert phrase_index.find(phrase_index.build_index(none, ["doc_id"]), bench).count() == 0
    bare = phrase_index.find(index, bench.filter("false")).agg(F.sum("n_hit"), F.sum(F.size("items"))).first()
    assert tuple(bare) == (0, 0)


def _plain(text):
    words, hit, items = bench_words(text), set(), set()
    for item, window in ((None, "one two three four five".split()), (7, ["word", "word"]), (7, ["one"])):
        for i in range(len(words) - len(window) + 1):
            if words[i : i + len(window)] == window:
                hit |= set(range(i, i + len(window)))
                items.add(item)
    return len(hit), items


# --- whitening ----------------------------------------------------------------

def brute_whitening(vectors, k):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return exact, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11)) * 0.1).astype(np.float32).astype(float)
    vectors[7] = vectors[8]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    bad = [(1000, None, "x"), (1001, [1.0, None] + [0.0] * 9, "x"), (1002, [math.inf] + [0.0] * 10, "x"), (1003, [math.nan] * 11, "x"), (1004, [1.0], "x"), (1005, [], "x")]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, n string").repartition(4)
    got = whitening.whiten(table, "embedding", ["vec_id", "n"]).collect()
    deviation, white, explained = brute_whitening(vectors, 8)
    assert len(got) == 300 * 8 and all(r["n"] == 300 for r in got)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(8):
        column = np.array([by[i, k + 1]["whitened"] for i in range(300)])
        sign = np.sign(column @ white[:, k])
        assert np.abs(sign * column - white[:, k]).max() < 1e-9
        assert abs(by[0, k + 1]["explained"] / explained[k] - 1) < 1e-9
    assert [by[i, 1]["deviation"] for i in range(300)] == deviation
    assert by[0, 1]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 5.0]), (None, [3.0, 2.0, 5.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(table, "embedding", ["vec_id"]).collect()
    assert len(got) == 9
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and all(r["identity_error"] < 1e-9 for r in got)
    one = whitening.whiten(table.filter("vec_id = 1"), "embedding", ["vec_id"]).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(i, None, None, 0, None) for i in (1, 2, 3)]
    assert whitening.whiten(table.filter("false"), "embedding", ["vec_id"]).count() == 0


# --- collocations -------------------------------------------------------------

def test_trie_finds_its_keys_only():
    random.seed(1)
    keys = sorted({"".join(random.choice("abcdé ") for _ in range(random.randint(1, 9))).encode() for _ in range(3000)} | {bytes([c, 7]) for c in range(1, 256)})
    trie, states = collocations.Trie.build(keys)
    assert len(set(states)) == len(keys)
    assert [trie.walk(k) for k in keys] == states.tolist()
    prefixes = {k[:i] for k in keys for i in range(len(k) + 1)}
    for _ in range(2000):
        k = bytes(random.choice(b"abcd \x07") for _ in range(random.randint(1, 9)))
        assert (trie.walk(k) >= 0) == (k in prefixes)


def brute_collocations(rows, least, top, contained=50):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            sizes[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        rank = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            longer = [f[q] for q in f if f[q] >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * x >= contained * a for x in longer):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, sizes[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("part_phrases,least,top", [(1_000_000, 3, 15), (4, 3, 2000), (1, 2, 9)])
def test_collocations_equal_brute_force(spark, part_phrases, least, top):
    random.seed(part_phrases)
    words = ["a", "A", "bé", "c-d", "e", "\x00f", "ü"]
    text = lambda n: "".join(random.choice(words) + random.choice([" ", "  ", "\t", ", ", "\n", " "]) for _ in range(n))
    n = 8 if part_phrases == 1 else 40
    rows = [(random.choice(["en", "fr", None, "", "und"]), text(random.randint(0, 30 if n == 40 else 8))) for _ in range(n)]
    rows += [("en", None), ("en", ""), ("xx", None), ("en", "a a a a a"), ("en", "a a a a a"), ("fr", text(400 if n == 40 else 4))]
    table = spark.createDataFrame(rows, "lang string, text string").withColumn("score", F.lit("s")).repartition(3)
    got = collocations.collocations(table, least=least, top=top, part_phrases=part_phrases)
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()) == brute_collocations(rows, least, top)


def test_collocations_of_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    long = "y" * 100
    rows = [("en", "one two three " * 40), ("en", "two three"), ("de", "one two " * 9), ("de", "one two")] + [("en", "word " * 60_000)]
    rows += [("fr", f"{long} z {long}é. " * 12), ("a\0b", "c d " * 11), ("a", "b\0c d " * 11)]
    table = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    got = collocations.collocations(table).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == brute_collocations(rows, 10, 2000)
    assert collocations.collocations(table.filter("false")).count() == 0
    assert collocations.collocations(docs(spark, ODD)).filter("lang = 'en'").select("phrase").collect()[0][0] == "word word word"


def test_collocations_of_words_that_begin_others(spark):
    random.seed(5)
    words = ["a", "ab", "abc", "b", "bc", "x" * 64, "x" * 65]
    rows = [(random.choice(["e", "en", None]), "".join(random.choice(words) + random.choice([" ", " ", "\t", ", "]) for _ in range(60))) for _ in range(25)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    # words and phrases lie in several tries, some in one and their beginnings in another
    got = collocations.collocations(table, least=4, part_phrases=20).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == brute_collocations(rows, 4, 2000)


def test_score_is_exact_past_64_bits(spark):
    a = 3_037_000_501
    row = spark.sql(f"SELECT {a}L AS a, {a + 1}L AS l1, {a + 2}L AS r1").selectExpr(collocations.SCORE.format(k=1) + " AS s").first()
    assert row["s"] == 10**6 * a * a // ((a + 1) * (a + 2))


@pytest.mark.parametrize("length", [1, 2])
def test_proposals_are_the_same_by_numbers_and_by_groups(monkeypatch, length):
    texts = ["a b c a b c. b c a b", "c c c c", "", "a b c d"]
    block = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y"]), pa.array(texts)], names=["lang", "text"])
    phrases = {1: ["a", "b", "c"], 2: ["a b", "b c", "c c"]}[length]
    trie, _ = collocations.Trie.build(sorted(f"1:{lang}{p}".encode() for lang in "xy" for p in phrases))
    known = np.full(1 << collocations.FILTER_BITS >> 3, 255, np.uint8)

    def run():
        positions = collocations.Positions(block, trie, {})
        lang, phrase, n = positions.proposals(positions.accepted(trie, length), length, known)
        return dict(zip(zip(lang.to_pylist(), phrase.to_pylist()), n.tolist()))

    numbers = run()
    monkeypatch.setattr(collocations, "KEY_BITS", 0)
    assert run() == numbers
    assert numbers[("x", "a b") if length == 1 else ("x", "a b c")] == (3 if length == 1 else 2)
    assert ("y", "c d" if length == 1 else "b c d") in numbers and ("x", "c b") not in numbers
