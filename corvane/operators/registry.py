"""The source registry: keyed rows, change detection, duplicates, counters.

A registry row is keyed by ``source_id``; missing strings are empty, not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import first_filled, text_or_empty
from corvane.operators.relational import breakdowns, latest_per_key, lookup

STATUSES = ("ready", "failed", "needs-review")
CHANGE_STATES = ("new", "unchanged", "changed", "failed", "needs-review")
INTEGRATED = ("integrated", "complete", "done", "excluded", "not-applicable")

TEXT_FIELDS = (
    "source_kind", "title", "original_url", "original_path", "markdown_path", "metadata_path", "checksum",
    "parser", "status", "change_state", "first_seen_at", "last_seen_at", "last_changed_at", "wiki_status",
    "wiki_integrated_at", "error_reason", "diagnostic_path", "previous_checksum",
)
SCHEMA = T.StructType(
    [T.StructField("source_id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in TEXT_FIELDS]
    + [
        T.StructField("wiki_page_paths", T.ArrayType(T.StringType())),
        T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    ]
)
FIELDS = [f.name for f in SCHEMA.fields]


def normal_status(c: Column) -> Column:
    """Known status in dashed lower case; anything else needs review."""
    s = F.replace(F.lower(F.trim(first_filled(c, F.lit("ready")))), F.lit("_"), F.lit("-"))
    return F.when(s.isin(*STATUSES), s).otherwise("needs-review")


def with_defaults(rows: DataFrame, now: str) -> DataFrame:
    """Registry rows with every field present, statuses normalised, times filled."""
    for field in SCHEMA.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    fill = {c: text_or_empty(F.col(c)) for c in TEXT_FIELDS if c != "previous_checksum"}
    fill |= {c: F.coalesce(c, F.lit(now)) for c in ("first_seen_at", "last_seen_at", "last_changed_at")}
    fill["source_kind"] = F.coalesce("source_kind", F.lit("unknown"))
    fill["title"] = F.coalesce("title", F.lit("Untitled source"))
    fill["wiki_status"] = F.coalesce("wiki_status", F.lit("pending"))
    fill["status"] = normal_status(F.col("status"))
    fill["wiki_page_paths"] = F.coalesce("wiki_page_paths", F.array().cast("array<string>"))
    fill["provenance"] = F.coalesce("provenance", F.create_map().cast("map<string,string>"))
    rows = rows.withColumns(fill)
    by_status = F.when(F.col("status") == "ready", "new").otherwise(F.col("status"))
    return rows.withColumn(
        "change_state", F.when(F.col("change_state").isin(*CHANGE_STATES), F.col("change_state")).otherwise(by_status))


def mark_duplicates(rows: DataFrame, pos: str, now: str) -> DataFrame:
    """Later ready rows with the checksum of another source need review.

    The first ready source of each checksum is aggregated and looked up, so copies of
    one text never meet in one task.
    """
    counted = F.when((F.col("status") == "ready") & (F.col("source_id") != "") & (F.col("checksum") != ""), F.col("checksum"))
    keyed = rows.withColumn("_sum", counted)
    firsts = keyed.filter(F.col("_sum").isNotNull()).groupBy("_sum").agg(
        F.min_by("source_id", pos).alias("_first"), F.count(F.lit(1)).alias("_n"))
    found = lookup(keyed, firsts, ["_sum"], "_n", spread=[pos])
    dup = F.coalesce(F.col("_first") != F.col("source_id"), F.lit(False))
    extra = F.create_map(
        F.lit("duplicate_of_source_id"), F.col("_first"), F.lit("quality_action"), F.lit("quarantined"))
    return found.withColumn("_dup", dup).withColumns({
        "status": F.when(F.col("_dup"), "needs-review").otherwise(F.col("status")),
        "change_state": F.when(F.col("_dup"), "needs-review").otherwise(F.col("change_state")),
        "last_changed_at": F.when(F.col("_dup"), first_filled(F.col("last_changed_at"), F.lit(now))).otherwise(F.col("last_changed_at")),
        "error_reason": F.when(F.col("_dup"), F.concat(F.lit("duplicate_checksum:"), "_first")).otherwise(F.col("error_reason")),
        "provenance": F.when(F.col("_dup"), F.map_concat(
            F.map_filter("provenance", lambda k, _: ~k.isin("duplicate_of_source_id", "quality_action")), extra)).otherwise(F.col("provenance")),
    }).drop("_sum", "_first", "_dup")


def merge(current: DataFrame, incoming: DataFrame, now: str, pos: str = "pos") -> DataFrame:
    """Registry after a batch, with ``touched`` telling the rows the batch named.

    * nothing incoming: the row passes unchanged
    * failed or needs review: the new row, but first seen and page links are kept
    * no previous row: new
    * same checksum: the previous row as it was, only seen again
    * other checksum: the new row, changed and pending, previous checksum kept
    """
    batch = mark_duplicates(with_defaults(incoming, now), pos, now).filter("source_id <> ''")
    batch = latest_per_key(batch, ["source_id"], pos).select(*FIELDS)
    old = with_defaults(current, now).select(*FIELDS)
    joined = old.select("source_id", F.struct(*FIELDS).alias("p")).join(
        batch.select("source_id", F.struct(*FIELDS).alias("i")), "source_id", "full_outer")
    p, i = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"i.{c}"))
    case = (
        F.when(F.col("i").isNull(), "keep").when(i("status").isin("failed", "needs-review"), "bad")
        .when(F.col("p").isNull(), "new").when(p("checksum") == i("checksum"), "same").otherwise("changed")
    )
    joined = joined.withColumn("_case", case)
    c = F.col("_case")
    out = {f: F.when(c.isin("keep", "same"), p(f)).otherwise(i(f)) for f in FIELDS if f != "source_id"}
    had = F.col("p").isNotNull()
    seen = lambda f, default: F.when(had, first_filled(p(f), i(f), F.lit(default))).otherwise(i(f))
    fresh = c.isin("bad", "changed")
    out["first_seen_at"] = F.when(fresh, seen("first_seen_at", now)).otherwise(out["first_seen_at"])
    out["last_seen_at"] = F.when(c == "keep", p("last_seen_at")).otherwise(F.lit(now))
    out["last_changed_at"] = F.when(c == "changed", F.lit(now)).when(
        c.isin("bad", "new"), first_filled(i("last_changed_at"), F.lit(now))).otherwise(out["last_changed_at"])
    out["change_state"] = F.when(c == "bad", i("status")).when(c == "new", "new").when(c == "same", "unchanged").when(
        c == "changed", "changed").otherwise(p("change_state"))
    out["previous_checksum"] = F.when(c == "changed", p("checksum")).otherwise(out["previous_checksum"])
    out["wiki_status"] = F.when(c == "changed", "pending").when(
        (c == "bad") & had, first_filled(p("wiki_status"), i("wiki_status"), F.lit("pending"))).otherwise(out["wiki_status"])
    out["wiki_integrated_at"] = F.when(fresh & had, p("wiki_integrated_at")).otherwise(out["wiki_integrated_at"])
    out["wiki_page_paths"] = F.when(fresh & had, p("wiki_page_paths")).otherwise(out["wiki_page_paths"])
    return joined.select(
        "source_id", *[v.alias(f) for f, v in out.items()], (c != "keep").alias("touched"))


def change_counts(merged: DataFrame) -> DataFrame:
    """Counts of the touched rows by change state, and by status where it differs."""
    rows = merged.filter("touched")
    names = F.array_distinct(F.array("change_state", "status"))
    return rows.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def status_counters(registry: DataFrame) -> DataFrame:
    """Counts by kind, status, change state and quality action in one pass."""
    rows = registry.withColumn("quality_action", F.try_element_at("provenance", F.lit("quality_action")))
    labelled = rows.select(*[
        first_filled(F.col(d), F.lit("unknown")).alias(d) for d in ("source_kind", "status", "change_state")
    ], "quality_action")
    out = breakdowns(
        labelled, [], ["source_kind", "status", "change_state", "quality_action"], F.lit(1), "n")
    return out.filter("label IS NOT NULL")


def wiki_progress(registry: DataFrame) -> DataFrame:
    """Ready, integrated, pending and changed sources of each kind."""
    state = F.lower(F.col("wiki_status"))
    changed = F.lower("change_state") == "changed"
    done = state.isin(*INTEGRATED)
    return registry.filter(F.lower("status") == "ready").groupBy("source_kind").agg(
        F.count(F.lit(1)).alias("ready"), F.count_if(done).alias("integrated"),
        F.count_if(~done | changed).alias("pending"), F.count_if(changed).alias("changed"))


def build_candidates(registry: DataFrame, rebuild: bool = False, resume: bool = False) -> DataFrame:
    """Ready rows a wiki build works on: all, all unfinished, or the pending ones."""
    ready = registry.filter(F.lower("status") == "ready")
    if rebuild:
        return ready
    state = F.lower(F.col("wiki_status"))
    return ready.filter(~state.isin(*INTEGRATED)) if resume else ready.filter(state == "pending")


def roll_back(registry: DataFrame, source_ids: DataFrame, job_id: str) -> DataFrame:
    """Quarantine the sources of a job; readers see them as needing review."""
    hit = source_ids.select("source_id").distinct().withColumn("_hit", F.lit(True))
    rows = registry.join(hit, "source_id", "left")
    return rows.withColumns({
        "status": F.when(F.col("_hit"), "needs-review").otherwise(F.col("status")),
        "error_reason": F.when(F.col("_hit"), f"rollback:{job_id}").otherwise(F.col("error_reason")),
    }).drop("_hit")


def find_by_url(registry: DataFrame, urls: DataFrame) -> DataFrame:
    """First ready registry row of each URL by its canonical form."""
    from corvane.functions.urls import canonical
    from corvane.operators.relational import first_per_key

    ready = registry.filter(F.lower("status") == "ready").select(
        canonical(F.col("original_url")).alias("_c"), "source_id")
    ready = first_per_key(ready, ["_c"], [F.col("source_id")])
    return urls.withColumn("_c", canonical(F.col("url"))).join(ready, "_c", "left").drop("_c")


def page(registry: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of the registry in key order."""
    return registry.orderBy("source_id").offset(offset).limit(limit)


def normalize_scraped(manifest: DataFrame, now: str, run_root: str) -> DataFrame:
    """Registry rows of a scrape run ``(pos, url, status, title, markdown, markdown_path)``.

    Quarantined texts fail, texts needing review wait, cleaned texts are stored in their
    cleaned form. The duplicate flag looks at original texts, the checksum at stored ones.
    """
    from corvane.functions.text import first_heading, stable_digest_id
    from corvane.functions.urls import canonical
    from corvane.operators import quality

    rows = manifest.filter((F.col("status") == "success") & (F.col("markdown_path") != "")).drop("status")
    rows = quality.assess(quality.flag_duplicates(rows, "markdown", "pos"), "markdown", seen="duplicate")
    bad, review = F.col("action") == "quarantined", F.col("action") == "needs_review"
    stored = F.when(F.col("action") == "cleaned", F.col("cleaned_text")).otherwise(F.col("markdown"))
    identity = first_filled(F.col("url"), F.col("markdown_path"))
    tail = first_filled(F.regexp_extract(F.rtrim(identity, F.lit("/")), "([^/]+)$", 1), F.lit("Untitled source"))
    rows = rows.withColumn("_text", F.when(bad, F.col("markdown")).otherwise(stored)).withColumn(
        "checksum", F.sha2("_text", 256)).withColumn(
        "source_id", stable_digest_id(F.lit("web"), canonical(identity)))
    name = F.concat_ws("-", "source_id", F.substring("checksum", 1, 12))
    return with_defaults(rows.select(
        "pos", "source_id", F.lit("web").alias("source_kind"),
        first_heading(F.col("markdown"), tail).alias("title"), F.col("url").alias("original_url"),
        F.col("markdown_path").alias("original_path"),
        F.when(bad, "").otherwise(F.concat(F.lit("raw_sources/web/"), name, F.lit(".md"))).alias("markdown_path"),
        "checksum", F.lit("web.markdown").alias("parser"),
        F.when(bad, "failed").when(review, "needs-review").otherwise("ready").alias("status"),
        F.when(bad | review, F.array_join("reasons", ", ")).otherwise("").alias("error_reason"),
        F.create_map(F.lit("run_root"), F.lit(run_root), F.lit("quality_action"), F.col("action")).alias("provenance"),
        F.when(bad, F.lit(None)).otherwise(F.col("_text")).alias("stored_text"),
    ), now)
