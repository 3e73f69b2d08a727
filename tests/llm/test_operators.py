"""The operators against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import chat, components, context_tree, exact_dedup, language, mixing, pieces, search, simhash, style_tree, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rate string, keep_id string, ids string, score string, host string"
LONG = "word " * 60_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w", "h") for i, t, lang, s in rows], DOCS)


ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "  \n\t", None, "a"), (4, "one", "en", "b"), (4, "one", "en", "b"), (None, "one two three four five", "fr", "b"),
    (6, LONG, "en", "a"), (7, "1234 !!", "en", "a"), (8, "ÉTÉ été ünïcode \x00 nul", "fr", "b"), (9, " one two three four five ", None, "a"), (10, "o n e", "en", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def words_of(text):
    return (text or "").encode().lower().split()


# --- language ---------------------------------------------------------------

def greedy_phrases(sample: list[bytes], text: bytes) -> int:
    """Longest matches with the sample, segment by segment."""
    count = 0
    for at in range(0, len(text), language.SEGMENT):
        part, i = text[at : at + language.SEGMENT], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and any(part[i : i + n + 1] in s for s in sample):
                n += 1
            i += n
            count += 1
    return count


def test_phrases_equal_greedy_longest_matches():
    random.seed(3)
    make = lambda n, letters: "".join(random.choice(letters) for _ in range(n))
    samples = {"x": [make(60, "abc "), make(40, "abd ")], "y": [make(80, "cdeé ")]}
    parser = language.Parser(samples)
    texts = [make(random.randint(1, 3000), "abcdeéz9 ") for _ in range(12)]
    plain = language.classes()
    flat = lambda t: plain[np.frombuffer(language.encoded(t), np.uint8)].tobytes()
    want = [[greedy_phrases([flat(s) for s in samples[k]], flat(t)) for k in parser.languages] for t in texts]
    assert parser.phrases([language.encoded(t) for t in texts]).tolist() == want


def test_language_of_odd_texts(odd, none):
    parser = language.fit(odd)
    rows = language.identify(odd, parser, ["doc_id", "text", "score", "source"]).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: r for r in rows}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert all(0 <= r["score"] <= 1 for r in rows) and found[6]["text"] == LONG
    assert language.identify(none, language.fit(none), ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(none), ["doc_id"]).collect()} == {"und"}


def test_language_learns_only_from_its_fold(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    held = docs(spark, [(i, f"held out {i}", "zz", "s") for i in ids])
    assert language.fit(held).languages == []


def test_language_learns_from_different_texts(spark):
    texts = sorted({f"word{i} of text {i}" for i in range(60)}, key=lambda t: t)
    rows = [(None, t, "en", "s") for t in texts for _ in range(70 if t.startswith("word1") else 1)]
    windows = language.sample_windows(docs(spark, rows), 4, 48, 400)["en"]
    assert len(windows) == len(set(windows)) == 48


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(table.withColumn("held", language.in_fold("doc_id", 4)), language.fit(table), ["lang", "held"])
    share = out.filter("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.98


# --- SimHash -----------------------------------------------------------------

def brute_fingerprint(text):
    words = words_of(text)
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints: dict):
    parent = {k: k for k in prints}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_fingerprints_and_groups(spark):
    random.seed(5)
    base = [random.choice("alpha beta gamma delta eps zeta".split()) for _ in range(300)]
    rows = [(i, " ".join(base[: 300 - i % 7]) if i % 3 else " ".join(random.sample(base, 40)), "en", "s") for i in range(120)]
    rows += [(200, None, "en", "s"), (201, "  ", "en", "s"), (202, LONG, "en", "s")]
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_groups(prints)


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_links_of_dense_and_sparse_fingerprints(spark, cell_rows):
    random.seed(9)
    centre = random.getrandbits(64)
    flip = lambda v, n: v ^ sum(1 << b for b in random.sample(range(64), n))
    values = {centre, 0, (1 << 64) - 1, *(flip(centre, random.randint(1, 4)) for _ in range(150)), *(random.getrandbits(64) for _ in range(200))}
    values |= {flip(v, 4) for v in list(values)[:60]}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    distinct = spark.createDataFrame([(signed(v),) for v in values], "bits bigint")
    links = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.fingerprint_links(distinct, cell_rows=cell_rows).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
    want, got = brute_groups({v: v for v in values}), {v: v for v in values}
    root = lambda k: k if got[k] == k else root(got[k])
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        got[y] = x
    together = lambda of: {frozenset(v for v in values if of(v) == r) for r in {of(v) for v in values}}
    assert together(lambda v: want[v]) == together(root)


def test_simhash_odd_input(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert {(r["fingerprint"], r["component_id"]) for r in blank} == {("0" * 16, 1)}
    assert simhash.simhash_groups(none).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)], "u bigint, v bigint")
    got = {r["u"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- exact dedup ------------------------------------------------------------

def brute_dedup(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", "", t or ""), []).append((-len(t or ""), i is None, i))
    return {n: (min(g)[2], len(g)) for n, g in groups.items()}


@pytest.mark.parametrize("options", [{}, {"digest_chars": 1}, {"hot_rows": 1}])
def test_exact_dedup(spark, odd, options):
    want = brute_dedup(ODD)
    rows = exact_dedup.exact_duplicates(odd, **options).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        plain = re.sub("[\x20\x09-\x0d]+", "", r["text"] or "")
        assert (r["keep_id"], r["group_size"]) == want[plain] and r["text_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(want) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert rows[0]["rate"] == "x"


def test_exact_dedup_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_state_goes_on(spark, odd, tmp_path):
    landed, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in (odd.filter("doc_id < 5"), odd.filter("doc_id >= 5 or doc_id is null")):
        part = exact_dedup.arrivals(part)
        part.write.mode("append").parquet(landed)
        exact_dedup.keep_state(spark.readStream.schema(part.schema).parquet(landed), state)
    sizes = Counter(n for _, n in brute_dedup(ODD).values())
    assert Counter(r["n"] for r in exact_dedup.read_state(spark, state).collect()) == sizes


# --- context trees ----------------------------------------------------------

def brute_scores(rows, depth):
    """Context-tree weighting with explicit nodes, one dictionary for every depth."""
    counts: list[dict] = [{} for _ in range(depth + 1)]

    def events(data):
        flat = b"\n" * depth + data
        for i in range(depth, len(flat)):
            for bit in range(8):
                prefix = (1 << bit) | flat[i] >> (8 - bit)
                yield flat[i - depth : i], prefix, flat[i] >> (7 - bit) & 1

    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    for r in train:
        for context, prefix, one in events(context_tree.normalised(r[1])):
            for d in range(depth + 1):
                counts[d].setdefault((context[depth - d :], prefix), [0, 0])[one] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weight: dict = {}
    own: dict = {}
    for d in range(depth, -1, -1):
        for key, (a, b) in counts[d].items():
            if d == depth:
                weight[d, key] = kt(a, b)
                continue
            below = sum(weight[d + 1, k] for k in counts[d + 1] if k[0][1:] == key[0] and k[1] == key[1])
            weight[d, key] = np.logaddexp(math.log(0.5) + kt(a, b), math.log(0.5) + below)
            own[d, key] = math.exp(math.log(0.5) + kt(a, b) - weight[d, key])

    def chance(context, prefix, one, d=0):
        key = (context[depth - d :], prefix)
        a, b = counts[d].get(key, (0, 0))
        estimate = ((b if one else a) + 0.5) / (a + b + 1)
        if d == depth or (context[depth - d - 1 :], prefix) not in counts[d + 1]:
            return estimate
        return own[d, key] * estimate + (1 - own[d, key]) * chance(context, prefix, one, d + 1)

    tokens = Counter(w for r in train for w in [*words_of(r[1]), b"\n"])
    total, distinct = sum(tokens.values()), len(tokens)
    out = {}
    for i, t, *_ in rows:
        own_tokens = [*words_of(t), b"\n"]
        out[i] = (len(own_tokens), sum(tokens[w] > 0 for w in own_tokens), total, sum(math.log10((tokens[w] + 1) / (total + distinct + 1)) for w in own_tokens),
                  sum(math.log10(chance(*e)) for e in events(context_tree.normalised(t))))
    return out


@pytest.mark.parametrize("depth, block", [(1, 10**6), (2, 60), (3, 200), (5, 10**6)])
def test_context_tree_scores(spark, depth, block):
    rows = [r for r in ODD if r[1] != LONG] + [(i, t, "en", "s") for i, t in enumerate(["the cat sat", "The cat ran on the mat", "a dog sat on a cat", "zebra!", "été the"], 20)]
    want = brute_scores(rows, depth)
    got = context_tree.context_tree_scores(docs(spark, rows), depth=depth, block_bytes=block).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-5)


def test_chances_of_a_byte_sum_to_one(spark):
    rows = [(1, "abab abba", "en", "s"), (3, "baba", "en", "s")]
    tails = [bytes([97, 98, b]).decode("latin-1") for b in range(33, 127)]
    got = context_tree.context_tree_scores(docs(spark, rows + [(100 + i, t, "en", "s") for i, t in enumerate(tails)]), depth=2)
    assert all(r["score"] < 0 for r in got.collect())


def test_context_tree_odd_input(odd, none):
    assert context_tree.context_tree_scores(odd).count() == len(ODD)
    assert context_tree.context_tree_scores(none).collect() == []


# --- urls -------------------------------------------------------------------

URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://a.net"), (5, "http://a.net/x?y"), (6, "HTTP://EXAMPLE.net/en/"), (7, "http://b.example.net/en/z#f"), (8, "http://example.net/fr/"),
    (9, "x://example.com/de/q"), (10, "x://de.example.com/de"), (11, "x://o.org/fr/1"), (12, "x://notexample.net/en/"), (13, "x://net-x/"), (14, "x://.net/"), (15, "x://net./"), (16, "x://a://b.net/"),
    (17, "http://net/"), (17, "http://net/"), (18, "x://a.net/" + "p" * 50_000), (19, "x://a.net?u://b.org/fr/"), (20, "x://ünï.net/\nq")]


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        rhost, slash, tail = rule.partition("/")
        if (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + tail):
            fits.append((len(rule), len(rhost), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


NESTED = url_filter.RULES + (("block", "b.example.net/"), ("allow", "c.b.example.net/en/x"), ("allow", "a.net/p"), ("block", "o.org/"), ("allow", "example.net/"))


@pytest.mark.parametrize("rules", [url_filter.RULES, NESTED])
def test_url_verdicts(spark, rules):
    urls = URLS + [(100 + i, f"http://{h}.example.net/en/{i}") for i, h in enumerate(["c.b", "d.c.b", "b", "a.b", "z"])]
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in urls], "page_id bigint, url string, host string, verdict string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect() if r["rule"])
    want = sorted((i, *brute_verdict(u, rules)) for i, u in urls if brute_verdict(u, rules)[2])
    assert got == want
    rest = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).filter("rule is null").collect()
    assert {r["verdict"] for r in rest} == {"allow"} and len(rest) + len(got) == len(urls)


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect() == []
    some = spark.createDataFrame(URLS, "page_id bigint, url string")
    assert url_filter.filter_urls(some, url_filter.rule_table(spark).limit(0)).filter("rule is not null").count() == 0


# --- mixing -----------------------------------------------------------------

def quantile(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u and k < 96:
        k += 1
        p *= mean / k
        total += p
    return k


def test_mix_draws_poisson_counts(spark):
    rows = [(i, "x" * (10 + i % 5), "en", "big" if i % 3 else "small") for i in range(300)] + [(900, "tiny", "en", "rare")]
    out = mixing.mix(docs(spark, rows), {"big": 1.0, "small": 2.0, "rare": 1.0}, total=8000).collect()
    size = Counter()
    for i, t, _, s in rows:
        size[s] += len(t)
    want = {}
    for i, t, _, s in rows:
        rate = {"big": 1, "small": 2, "rare": 1}[s] / 4 * 8000 / size[s]
        parts = max(1, math.ceil(rate / 16))
        draw = lambda j: int(hashlib.md5(f"42|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52  # noqa: B023, E731
        want[i] = sum(quantile(draw(j), rate / parts) for j in range(1, parts + 1))
    got = Counter(r["doc_id"] for r in out)
    assert got == Counter({i: n for i, n in want.items() if n})
    assert got[900] > 300  # a rate of 500 in 32 parts
    assert all(sorted(r["copy"] for r in out if r["doc_id"] == i) == list(range(1, n + 1)) for i, n in list(got.items())[:20])


def test_mix_odd_input(odd, none):
    out = mixing.mix(odd, total=3 * len(LONG)).collect()
    assert {r["keep_id"] for r in out} == {"y"} and all(r["rate"] > 0 for r in out)
    assert None not in {r["source"] for r in out}  # the null source weighs nothing
    assert mixing.mix(none).collect() == [] and mixing.mix(odd, {}).collect() == []


# --- chat -------------------------------------------------------------------

TURNS = "pair_id bigint, turn bigint, role string, text string, prompt string"


def test_preference_pairs(spark):
    chosen = spark.createDataFrame([
        (1, 0, "user", "hi", "p"), (1, 1, "assistant", "yes", "p"), (1, 1, "assistant", "yes", "p"), (1, 2, "user", "bye", "p"), (1, 3, "assistant", "good", "p"),
        (2, 0, None, None, "p"), (3, 0, "user", "only", "p"), (4, None, "user", "", "p")], TURNS)
    rejected = spark.createDataFrame([
        (1, 0, "user", "hi", "p"), (1, 1, "assistant", "yes", "p"), (1, 2, "assistant", "no", "p"), (2, 0, "", "", "p"), (4, None, "user", "", "p"), (4, 1, "assistant", "<|end|>", "p")], TURNS)
    got = {r["pair_id"]: r for r in chat.preference_pairs(chosen, rejected).collect()}
    one = got[1]
    assert one["n_common"] == 2 and one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert one["chosen"] == "<|user|>\nbye<|end|>\n<|assistant|>\ngood<|end|>\n" and one["rejected"] == "<|assistant|>\nno<|end|>\n"
    for side in ("chosen", "rejected"):
        start, size = map(int, one[f"{side}_mask"].split(":"))
        assert one[side][start : start + size] == {"chosen": "good<|end|>\n", "rejected": "no<|end|>\n"}[side]
    assert got[2]["n_common"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["n_common"] == 0 and got[3]["rejected"] == "" and got[3]["chosen_mask"] == ""
    assert got[4]["n_common"] == 1 and got[4]["rejected_mask"] == "14:15"
    empty = chosen.limit(0)
    assert chat.preference_pairs(empty, empty).collect() == []


# --- pieces -----------------------------------------------------------------

def best_score(vocabulary, text):
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + vocabulary.longest) + 1):
            found = vocabulary.pieces.get(text[i:j])
            cost = found[1] if found else vocabulary.unknown_score if j == i + 1 else -math.inf
            best[j] = max(best[j], best[i] + cost)
    return best[-1]


@pytest.mark.parametrize("seed", range(20))
def test_streaming_viterbi_is_optimal(seed):
    random.seed(seed)
    table = {c: (i, -3 * random.random()) for i, c in enumerate("abc▁")}
    for _ in range(14):
        table.setdefault("".join(random.choice("abc▁") for _ in range(random.randint(2, 6))), (len(table), -6 * random.random()))
    vocabulary = pieces.Vocabulary.of(table, {}, 99, 100)
    text = "".join(random.choice("abcd▁") for _ in range(400))
    viterbi, ids, at = pieces.StreamingViterbi(vocabulary), [], 0
    while at < len(text):
        size = random.randint(1, 40)
        ids += viterbi.feed(text[at : at + size])
        at += size
        assert len(viterbi.text) < 400
    ids += viterbi.finish()
    cost = {i: s for i, s in table.values()}
    assert sum(cost.get(i, vocabulary.unknown_score) for i in ids) == pytest.approx(best_score(vocabulary, text))


def test_viterbi_commits_as_it_goes():
    with open(pieces.MODEL, "rb") as f:
        vocabulary = pieces.Vocabulary(f.read())
    viterbi, held = pieces.StreamingViterbi(vocabulary), 0
    for _ in range(200):
        viterbi.feed("someratherlongwordwithoutanyblank")
        held = max(held, len(viterbi.text))
    assert held < 1000


def test_encoding_round_trip(odd, none):
    back = pieces.decode(pieces.encode(odd, ["doc_id", "text", "ids"]), ["doc_id", "text", "ids"]).collect()
    assert len(back) == len(ODD) and all(r["text"] == r["decoded"] for r in back)
    assert [r["ids"] for r in back if r["doc_id"] in (1, 2)] == [None, []]
    assert pieces.encode(none, ["doc_id"]).collect() == []


def test_decoding_of_bad_ids(spark):
    rows = spark.createDataFrame([(1, [-1, 10**6, 1, 2, 131]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert [r["decoded"] for r in pieces.decode(rows, ["doc_id"]).orderBy("doc_id").collect()] == ["\ufffd", None, ""]


# --- pages ------------------------------------------------------------------

def test_page_text():
    page = style_tree.Page(
        '<!doctype html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Ok?</div>'
        '<article><h1>A &amp;amp; B</h1><p>one\n two<b>three<br>four<p>five<aside>side</aside><form>f<input></form><table><tr><td>x<td>y</table><div class="comments">me</div></article>'
        '<div id="sidebar">s</div><footer>end</footer><!-- open', {})
    assert page.main_text(set()) == "A &amp; B\none twothree four\nfive\nx y"


def site(i, title, body):
    return f'<body><div class="top"><a href="/">Home</a></div><div class="text"><h2>{title}</h2><p>{body}</p></div><div class="tail">All rights reserved</div></body>'


def test_site_style_tree_cuts_what_repeats(spark):
    rows = [(i, f"http://a.b/{i}", site(i, f"Title {i}", f"Story {i} &lt;here&gt;"), "t") for i in range(12)]
    rows += [(50, None, None, "t"), (51, "http://a.b/x", "", "t"), (52, "http://c.d/", site(0, "Alone", "text"), "t"), (53, "http://a.b/long", site(0, "Long", "w " * 50_000), "t"), (0, "http://a.b/0", rows[0][2], "t")]
    rows += [(60 + i, f"http://same.x/{i}", site(0, "Same", "copy"), "t") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = style_tree.main_texts(pages, ["page_id", "url", "text"]).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[3] == "Title 3\nStory 3 <here>" and got[50] == got[51] == ""
    assert got[52] == "Home\nAlone\ntext\nAll rights reserved" and got[53] == "Long\n" + ("w " * 50_000).strip()
    assert got[60] == "Home\nSame\ncopy\nAll rights reserved"  # nothing but copies: nothing is cut
    assert style_tree.main_texts(pages.limit(0), ["page_id"]).collect() == []


def test_importance_of_nodes(spark):
    rows = [("h", site(i, f"T{i}", "b")) for i in range(4)]
    got = {r["importance"] for r in style_tree.node_importance(spark.createDataFrame(rows, "host string, html string")).collect()}
    assert min(got) == pytest.approx(0) and max(got) == pytest.approx(1)


def page_rows(spark, htmls):
    return spark.createDataFrame([(i, f"http://a.b/{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def texts_of(spark, htmls):
    return {r["page_id"]: r["text"] for r in style_tree.main_texts(page_rows(spark, htmls), ["page_id"]).collect()}


def test_tree_cuts_inside_article(spark):
    page = lambda i: f'<body><article><h1>Title {i}</h1><p>Story {i}</p><div class="box"><p>Read our terms</p></div></article><script>track({i})</script></body>'
    got = texts_of(spark, [page(i) for i in range(8)] + [page(3).replace("track(3)", f"track({j})") for j in range(20, 50)])
    assert got[2] == "Title 2\nStory 2" and got[3] == got[20] == "Title 3\nStory 3"  # copies do not erase each other


def test_copies_count_once_without_article(spark):
    page = lambda title, body: f'<body><div class="text"><h2>{title}</h2><p>{body}</p></div><div class="tail">All rights reserved</div></body>'
    got = texts_of(spark, [page("Same", "copied story")] * 60 + [page(f"T{i}", f"story {i}") for i in range(3)])
    assert got[0] == "Same\ncopied story" and got[60] == "T0\nstory 0"


def test_deep_branches_keep_their_text(spark):
    page = lambda i: "<body>" + "<span>" * 150 + f"Deep story {i}" + "</span>" * 150 + f'<div class="n">{i}</div></body>'
    got = texts_of(spark, [page(i) for i in range(6)])
    assert got[4] == "Deep story 4\n4"


# --- search -----------------------------------------------------------------

@pytest.mark.parametrize("block, shard", [(2, 400), (256, 10**6)])
def test_search_is_exact(spark, block, shard):
    random.seed(block)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=random.randint(1, 40))), "en", "s") for i in range(150)]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, rows[3][1], "en", "s"), (503, "Ünique_word", "en", "s"), (None, "w1 w2", "en", "s")]
    table = docs(spark, rows)
    asked = table.filter("doc_id % 10 = 0 or doc_id > 499").select(F.col("doc_id").alias("query_id"), "text")
    asked = asked.unionByName(asked.limit(1))
    got = search.search(search.build_index(table, shard_bytes=shard), asked, k=5, block=block).collect()
    known = {i: search.terms(t) for i, t, *_ in rows if i is not None}
    n, mean = len(known), sum(map(len, known.values())) / len(known)
    df = Counter(t for terms in known.values() for t in set(terms))
    for q in {r["query_id"] for r in got} | {500, 501}:
        tf = Counter(known[q])
        scores = []
        for i, terms in known.items():
            own = Counter(terms)
            s = sum(c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * len(terms) / mean)) for t, c in tf.items() if own[t])
            if s > 0:
                scores.append((-round(s, 9), i))
        want = sorted(scores)[:5]
        mine = sorted({(r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q})
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert [s for *_, s in mine] == pytest.approx([-s for s, _ in want])


def test_bm25_floor_of_earlier_shards_spares_blocks_and_keeps_ties():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 12 if i < 40 else 400, 30)) for i in range(400)]
    table = pa.table({"_id": pa.array(range(1, 401), pa.int64()), "text": texts})
    row = next(search._index_shard((pa.scalar(0),), table.to_batches())).to_pylist()[0]
    shard = search.Shard(row, 30.0, search.K1, search.B, 20)
    names, words, starts, codes, weights = search.packed_queries([{"query": "q", "terms": ["none", "w1", "w2"], "weights": [9.0, 1.5, 1.25]}, {"query": "r", "terms": [], "weights": []}])
    kinds = shard.kinds(words.decode().split(" "))[codes]
    ids, less = shard.top(starts, kinds, weights, 5, np.zeros(2))
    free = shard.scored
    assert names == ["q", "r"] and np.isfinite(less[0]).all() and np.isinf(less[1]).all()
    # a floor at the fifth score keeps all five, one above the best finds none and scores no block
    again = shard.top(starts, kinds, weights, 5, np.array([-less[0, -1], 0.0]))
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == less.tolist() and shard.scored <= free
    above = shard.top(starts, kinds, weights, 5, np.array([-less[0, 0] * 3, 0.0]))
    assert np.isinf(above[1]).all() and shard.scored == 0 < free


def test_search_of_nothing(spark, none, odd):
    asked = odd.select(F.col("doc_id").alias("query_id"), "text")
    assert search.search(search.build_index(none), asked).collect() == []
    assert search.search(search.build_index(odd), asked.limit(0)).collect() == []


def test_columns_of_ids_decode_at_once_without_a_trie():
    table = {c: (i, -1.0) for i, c in enumerate(["▁", "a", "▁b", "é"])}
    vocabulary = pieces.Vocabulary.of(table, {b: 10 + b for b in range(256)}, 4, 270)
    lists = [[0, 1, 2], [], [2], [10 + 0xFF, 1], [-1, 1, 5000], [10 + 0xC3, 10 + 0xA9, 3, 4], [0, 0, 1]]
    bounds = np.cumsum([0, *map(len, lists)])
    got = pieces.decoded_all(vocabulary, np.array(sum(lists, []), np.int32), bounds)
    assert got == ["a b", "", "b", "�a", "a", "éé ⁇ ", " a"]
    assert [pieces.decoded(vocabulary, np.array(ids, np.int32)) for ids in lists] == got
    assert "trie" not in vars(vocabulary)
