"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import chat, collocations, context_tree, exact_dedup, language, mixing, phrase_index, pieces, search, simhash, style_tree, url_filter, whitening
from corvane.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_language_id")
def op2(spark, sf):
    """Cross-parsing entropy over whole texts; learned outside the fold ``crc32(doc_id) mod 4 = 2``."""
    docs = read(spark, sf, "documents", "doc_id", "text", "lang")
    out = language.identify(docs.withColumn("held_out", language.in_fold("doc_id", 4)), language.fit(docs), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy")


OP3_SQL = r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (SELECT page_id, rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1"""


@query("op3_url_filter", OP3_SQL)
def op3(spark, sf):
    """Verdict of every url under the four fixed rules; urls no rule fits are allowed."""
    pages = read(spark, sf, "pages", "page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op4_simhash")
def op4(spark, sf):
    """Fingerprints of four-word shingles, linked at four bits."""
    return simhash.simhash_groups(read(spark, sf, "documents", "doc_id", "text"))


OP6_SQL = """
WITH s AS (SELECT coalesce(source, '') AS source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY 1),
t AS (SELECT source, 1.0::DOUBLE / (count(*) FILTER (size > 0) OVER ()) * (sum(size) OVER ())::DOUBLE / size AS rate, size FROM s),
q AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::INT AS parts FROM t WHERE size > 0),
pmf AS (SELECT source, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p FROM q, range(0, 97) x(k)),
cdf AS (SELECT source, list(c ORDER BY k) AS ladder FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf) GROUP BY 1),
d AS (SELECT doc_id, q.source, rate, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(ladder, lambda c:
    c <= ('0x' || substr(md5('42|' || doc_id || '|' || j), 1, 13))::BIGINT / 4503599627370496.0)))) AS n, length(text) AS n_text
  FROM documents JOIN q ON coalesce(documents.source, '') = q.source JOIN cdf ON q.source = cdf.source)
SELECT doc_id, source, copy, round(rate, 9) AS rate, md5('42|place|' || doc_id || '|' || copy) AS shuffle_key, n_text
FROM (SELECT *, unnest(range(1, n::BIGINT + 1)) AS copy FROM d)"""


@query("op6_poisson_mix", OP6_SQL)
def op6(spark, sf):
    """Every source at the same share of as many characters as there are; whole rows, globally shuffled."""
    mixed = mixing.mix(read(spark, sf, "documents", "doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("copy").cast("bigint").alias("copy"), F.round("rate", 9).alias("rate"), "shuffle_key",
        F.char_length("text").cast("bigint").alias("n_text"))


OP7_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT pair_id, max(turn) AS last, arg_max(text, {'t': turn, 'x': text}) AS answer FROM c WHERE role = 'assistant' GROUP BY 1),
met AS (SELECT c.*, last FROM c LEFT JOIN a USING (pair_id) WHERE last IS NULL OR turn <= last),
sides AS (SELECT 'a' AS side, pair_id, turn, role, text FROM met
  UNION SELECT 'b', pair_id, turn, role, text FROM met WHERE NOT coalesce(turn = last AND role = 'assistant', false)
  UNION SELECT 'b', a.pair_id, a.last, 'assistant', coalesce(o.answer, '') FROM a LEFT JOIN a o ON o.pair_id = xor(a.pair_id, 1)),
n AS (SELECT *, row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) AS i FROM sides),
w AS (SELECT x.pair_id, min(x.i) FILTER (y.i IS NULL OR x.role <> y.role OR x.text <> y.text) - 1 AS cut, count(*) AS size
  FROM n x LEFT JOIN n y ON y.side = 'b' AND x.pair_id = y.pair_id AND x.i = y.i WHERE x.side = 'a' GROUP BY 1),
common AS (SELECT pair_id, coalesce(cut, size) AS n_common FROM w),
r AS (SELECT n.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM n JOIN common USING (pair_id)),
o AS (SELECT *, sum(length(shown)) OVER (PARTITION BY side, pair_id, i > n_common ORDER BY i) - length(shown) AS pos FROM r),
f AS (SELECT pair_id, any_value(n_common)::INTEGER AS n_common,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND i <= n_common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'a' AND i > n_common), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'b' AND i > n_common), '') AS rejected,
  coalesce(string_agg((pos + 5 + length(role))::BIGINT || ':' || (length(text) + 8), ',' ORDER BY i) FILTER (side = 'a' AND i > n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((pos + 5 + length(role))::BIGINT || ':' || (length(text) + 8), ',' ORDER BY i) FILTER (side = 'b' AND i > n_common AND role = 'assistant'), '') AS rejected_mask
  FROM o GROUP BY 1)
SELECT * FROM f"""


@query("op7_preference_pairs", OP7_SQL)
def op7(spark, sf):
    """A pair from every conversation: its last answer against the neighbouring conversation's."""
    return chat.preference_pairs(*chat.contrasted(read(spark, sf, "conversations", "conv_id", "turn", "role", "text")))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, n, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM t
  WINDOW w AS (PARTITION BY n ORDER BY length(x) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g"""


@query("op8_exact_dedup", OP8_SQL)
def op8(spark, sf):
    """Every document with the document of its text that stays."""
    return exact_dedup.exact_duplicates(read(spark, sf, "documents", "doc_id", "text"), carry=["doc_id"])


@query("op10_context_tree")
def op10(spark, sf):
    """Scores of all documents; learned outside the fold ``crc32(doc_id) mod 7 = 2``."""
    return context_tree.context_tree_scores(read(spark, sf, "documents", "doc_id", "text"))


@query("op1_style_tree")
def op1(spark, sf):
    """Main text of every page."""
    return style_tree.main_texts(read(spark, sf, "pages", "page_id", "url", "html"), ["page_id", "url"])


@query("op5_sentencepiece")
def op5(spark, sf):
    """Ids of every whole text and whether they decode to it."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    back = pieces.decode(pieces.encode(docs, ["doc_id", "text"]), ["doc_id", "text", "ids"])
    return back.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), F.hex(F.xxhash64("ids")).alias("ids_digest"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


@query("op9_bm25_top10")
def op9(spark, sf):
    """Whole texts whose id is divisible by 50 as queries, against all documents."""
    docs = read(spark, sf, "documents", "doc_id", "text")
    asked = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(search.build_index(docs), asked)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[i : i + 9] AS words FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) u(i) WHERE len(ws) > 0),
grams AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS gram FROM d, (SELECT DISTINCT len(words) AS k FROM win), unnest(range(1, len(ws) - k + 2)) u(i)),
hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN win ON gram = array_to_string(words, ' ') AND k = len(words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
cf AS (SELECT w, count(*) AS c FROM pos GROUP BY 1),
rare AS (SELECT item_id, words, arg_min(w, (coalesce(c, 0), w)) AS w FROM (SELECT item_id, words, unnest(words) AS w FROM win) LEFT JOIN cf USING (w) GROUP BY 1, 2),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM rare JOIN pos USING (w) JOIN d USING (doc_id), range(15) u(s)
  WHERE list_has_all(ws[greatest(p - s, 1) : p - s + 14], words) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN near USING (doc_id)"""


@query("op11_phrase_index", OP11_SQL)
def op11(spark, sf):
    """Benchmark phrases of ten words in every document; ``n_near`` items have a window within fifteen words."""
    index = phrase_index.build_index(read(spark, sf, "documents", "doc_id", "text"), ["doc_id"])
    found = phrase_index.find(index, read(spark, sf, "benchmark", "item_id", "text"), within=phrase_index.WITHIN)
    ids = F.array_sort(F.transform("items", lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near"))


@query("op12_whitening")
def op12(spark, sf):
    """First eight whitened components of every sound embedding."""
    rows = read(spark, sf, "embeddings", "vec_id", "embedding")
    return whitening.whiten(rows, "embedding", ["vec_id"])


OP13_SQL = r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda v: v <> '') AS ws FROM p),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
    FROM w, range(1, 4) u(k), unnest(range(1, len(ws) - k + 2)) v(i)) GROUP BY ALL),
s AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, i, array_to_string(ws[:i], ' ') AS lp, array_to_string(ws[i + 1 :], ' ') AS rp FROM c, range(1, 3) u(i) WHERE i < k),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, i, (1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner2 AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inner2 ON b.lang = inner2.lang AND b.phrase = part WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN s USING (lang) QUALIFY rank <= 2000"""


@query("op13_collocations", OP13_SQL)
def op13(spark, sf):
    """The first two thousand phrases of two or three words of each language."""
    return collocations.collocations(read(spark, sf, "documents", "lang", "text"))
