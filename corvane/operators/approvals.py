"""URLs chosen by many operator messages at once.

A message names URLs, ``path:`` groups and words; words reach a URL's group when they stand in its
address or title. All messages' words form one automaton that runs over the addresses where they are
read, so an address is scanned once, whatever the number of messages. Only the first ``most`` groups
of a word and the first ``most`` rows of a group can be among the first ``most`` rows of a message,
and of these only as many as the message asks for, which bounds what the joins between messages,
words, groups and rows produce.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import urls as U
from corvane.functions.text import text_or_empty
from corvane.operators import crawl
from corvane.operators.relational import first_per_key, top_k
from corvane.session import through_table

LIMIT, MOST = 50, 500
PART_WORDS = 100_000
# What a word of a message stands for, the words without a meaning, and where a request turns negative.
ALIASES = {
    "registrar": ("registrar", "enrollment-services", "transcript", "records"),
    "calendar": ("academic-calendar", "final-exam", "calendar"),
    "catalog": ("course-catalog", "catalog", "course", "degree", "program"),
    "tuition": ("tuition", "bursar", "billing", "payment", "cost"),
    "aid": ("financial-aid", "financialaid", "scholarship"),
    "housing": ("housing", "dining", "student-life", "health", "counseling", "parking", "orientation", "accessibility"),
    "admission": ("admission", "apply", "application", "transfer", "visit"),
    "cox": ("cox",), "dedmanlaw": ("dedmanlaw", "dedman law", "dedman-law"), "law": ("law",),
    "dedman": ("dedman", "deadman"), "deadman": ("dedman", "deadman"), "meadows": ("meadows",), "lyle": ("lyle",),
    "simmons": ("simmons",), "perkins": ("perkins",),
}
ALL_SCHOOLS = ("cox", "dedman", "dedmanlaw", "meadows", "lyle", "simmons", "perkins")
TERM_STOP = (
    "approve", "approved", "choose", "source", "sources", "scrape", "pages", "urls", "url", "student", "students", "top", "first",
    "best", "limit", "hundred",
)
NEGATIVE = r"(?iU)\b(?:exclude|reject|do not include|avoid|remove)\b"


def _has_word(text: Column, words) -> Column:
    return text.rlike(r"(?U)\b(?:" + "|".join(words) + r")\b")


def message_terms(message: Column) -> Column:
    """Distinct terms of the part of a message before it turns negative: aliases first, then its own words."""
    low = F.lower(F.get(F.split(text_or_empty(message), NEGATIVE, 2), F.lit(0)))
    none = F.array().cast("array<string>")
    named = [F.when(_has_word(low, dict.fromkeys((key, *values))), F.array(*map(F.lit, values))).otherwise(none) for key, values in ALIASES.items()]
    schools = F.when(_has_word(low, ("schools", "colleges")), F.array(*map(F.lit, ALL_SCHOOLS))).otherwise(none)
    own = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9-]{3,}"), F.lit(0)), lambda w: ~w.isin(*TERM_STOP))
    return F.array_distinct(F.concat(*named, schools, own))


def term_roots(terms: Column) -> Column:
    """School roots that the terms name; both law roots go together."""
    plain = F.transform(terms, lambda t: F.replace(F.replace(F.lower(F.trim(t)), F.lit("-"), F.lit("")), F.lit(" "), F.lit("")))
    roots = F.create_map(*[x for k, v in crawl.SCHOOL_TERMS.items() for x in (F.lit(k), F.lit(v))])
    law = F.array(*map(F.lit, sorted(crawl.LAW_TERMS)))
    named = F.array_compact(F.transform(plain, lambda t: F.try_element_at(roots, t)))
    both = F.concat(F.filter(named, lambda r: (r != "dedman") | F.array_contains(plain, "schools")), law)
    return F.array_sort(F.array_distinct(F.when(F.arrays_overlap(plain, law), both).otherwise(named)))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in shared.value:
            found.add_word(word, word)
        found.make_automaton()
        for batch in batches:
            groups, words = [], []
            seen: set = set()
            for group, hay in zip(batch.column("grp").to_pylist(), batch.column("hay").to_pylist()):
                for _, word in found.iter(hay):
                    if (group, word) not in seen:
                        seen.add((group, word))
                        groups.append(group)
                        words.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(words, pa.string())], names=["grp", "term"])

    return run


def term_groups(rows: DataFrame, terms: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``(term, grp)``: the terms that stand in the address or title of some row of a group.

    ``rows (grp, hay)``, ``terms (term)``. An automaton takes at most ``part_words`` terms; more
    make more of them, each one pass over the rows.
    """
    spark = rows.sparkSession
    asked = through_table(terms.select("term").distinct(), "terms")
    parts = max(1, math.ceil(asked.count() / part_words))
    found = None
    for part in range(parts):
        words = [r["term"] for r in asked.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()]
        if not words:
            continue
        shared = spark.sparkContext.broadcast(words)
        hits = through_table(rows.select("grp", "hay").mapInArrow(_scan(shared), "grp string, term string").distinct(), "term-groups")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], "grp string, term string") if found is None else found


def _lists(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``(key, list)``: the rows of each key as one list in the order of ``columns``."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("list"))


def _first(name: str, n: Column) -> Column:
    return F.slice(name, F.lit(1), F.greatest(n, F.lit(0)))


def approval_candidates(messages: DataFrame, discovered: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """``(msg_id, place, url, reason)``: the URLs that each of ``messages (msg_id, message)`` asks for.

    ``discovered (pos, url, title, lastmod, excluded_reason)`` in the order of ``pos``. Named URLs
    that nobody discovered come first, if the policy takes them, then discovered rows of the
    matched groups, or of all groups where a message matches none or has no terms, up to the
    number the message asks for (``limit`` if none, ``most`` at most). Rows an operator rejected and
    rows the policy refuses are passed over.
    """
    u = F.col("url")
    wide = discovered.filter(F.coalesce(u, F.lit("")) != "").select("pos", "url", text_or_empty(F.col("title")).alias("title"), U.group_key(u).alias("grp"), "excluded_reason")
    # the policy is asked once for an address, where the addresses are read
    judged = crawl.with_policy(wide, title="title").withColumn("open", F.col("selected") & (F.coalesce("excluded_reason", F.lit("")) != "operator_rejected_area"))
    # an own number of parts, so that a short table is not one task for those who read it
    dealt = judged.select("pos", "url", "title", "grp", "open").repartition(discovered.sparkSession.sparkContext.defaultParallelism, "url")
    rows = through_table(first_per_key(dealt, ["url"], [F.col("pos")]), "discovered")
    said = messages.select("msg_id", text_or_empty(F.col("message")).alias("message"))
    # the terms are a column of their own before the roots look at them several times
    worded = said.withColumn("terms", message_terms(F.col("message")))
    asked = through_table(worded.select(
        "msg_id", "terms", term_roots(F.col("terms")).alias("roots"), crawl.message_urls(F.col("message")).alias("urls"), crawl.message_subpaths(F.col("message")).alias("subpaths"),
        F.least(F.coalesce(crawl.select_limit(F.col("message")), F.lit(limit)), F.lit(most)).alias("size")), "messages")

    # explicit addresses that are not among the discovered ones
    new = crawl.with_policy(asked.select("msg_id", F.posexplode("urls").alias("at", "url"))).filter("selected").select("msg_id", "at", "url")
    # through a table, as the planner would ask the policy again for all discovered addresses
    explicit = through_table(new, "explicit").join(rows.select("url"), "url", "left_anti").select(
        "msg_id", F.lit(0).alias("side"), F.col("at").cast("bigint").alias("pos"), "url", F.lit("explicit_url").alias("reason"))

    # rows that can be taken, in order, at most ``most`` of each group and of all; a message takes its first ones of each list
    taken = rows.filter("open").select("grp", "pos", "url")
    by_group = through_table(_lists(top_k(taken, ["grp"], [F.col("pos")], most, "_n"), "grp", "pos", "url"), "first-rows")
    anywhere = _lists(taken.orderBy("pos").limit(most).withColumn("all", F.lit("*")), "all", "pos", "url", "grp")
    starts = by_group.select("grp", F.element_at("list", 1)["pos"].alias("start"))

    # groups a message matches by its words; those without a row to take count as matched, too
    hay = F.lower(F.concat_ws("\n", "url", "title")).alias("hay")
    wordy = asked.filter(F.size("roots") == 0).select("msg_id", "size", F.explode("terms").alias("term"))
    hits = term_groups(rows.select("grp", hay), wordy)
    # groups without rows to take come last, and only tell that something matched
    placed = hits.join(starts, "grp", "left").withColumn("start", F.coalesce("start", F.lit(2**62)))
    per_term = _lists(top_k(placed, ["term"], [F.col("start"), F.col("grp")], most, "_n"), "term", "start", "grp")
    named = asked.select("msg_id", "size", F.explode(F.array_distinct(F.concat(
        F.transform("urls", lambda u: U.group_key(u)), F.col("subpaths"), F.transform("roots", lambda r: F.concat(F.lit("/"), r))))).alias("grp"))
    # every group before another one has a row before it, so as many groups as rows are asked for are enough
    matched = wordy.join(per_term, "term").select("msg_id", "size", F.inline(_first("list", F.col("size")))).unionByName(
        named.join(starts, "grp", "left").select("msg_id", "size", F.coalesce("start", F.lit(2**62)).alias("start"), "grp")).distinct()
    groups = top_k(matched, ["msg_id"], [F.col("start"), F.col("grp")], most, "_n").filter(F.col("_n") <= F.greatest("size", F.lit(1)))
    groups = through_table(groups.select("msg_id", "size", "grp", "_n"), "message-groups")
    # no terms at all match every group
    free = asked.filter(((F.size("terms") == 0) & (F.size("roots") == 0)))
    every = free.select("msg_id", "size").unionByName(asked.select("msg_id", "size").join(groups.select("msg_id"), "msg_id", "left_anti")).distinct()
    reason = F.concat(F.lit("subpath:"), "grp").alias("reason")
    # the n-th group's rows follow n - 1 others
    narrow = groups.join(every.select("msg_id"), "msg_id", "left_anti").join(by_group, "grp").select(
        "msg_id", "size", F.inline(_first("list", F.col("size") - F.col("_n") + 1)), reason)
    narrow = top_k(narrow, ["msg_id"], [F.col("pos")], most, "_n").filter(F.col("_n") <= F.col("size")).drop("_n")
    # one pseudo-group of at most ``most`` rows
    broad = every.withColumn("all", F.lit("*")).join(F.broadcast(anywhere), "all").select("msg_id", "size", F.inline(_first("list", F.col("size"))))
    found = narrow.unionByName(broad.select("msg_id", "size", "pos", "url", reason)).select(
        "msg_id", F.lit(1).alias("side"), F.col("pos").cast("bigint").alias("pos"), "url", "reason", "size")
    # addresses named in a message are all kept; discovered ones only up to its number
    in_order = Window.partitionBy("msg_id").orderBy("side", "pos")
    listed = explicit.withColumn("size", F.lit(0)).unionByName(found).withColumn("place", F.row_number().over(in_order))
    return listed.filter((F.col("side") == 0) | (F.col("place") <= F.col("size"))).select("msg_id", "place", "url", "reason")
