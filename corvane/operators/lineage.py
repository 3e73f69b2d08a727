"""Which pages go stale when sources change, and wiki lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as X
from corvane.operators.relational import first_per_key, lookup
from corvane.operators.registry import INTEGRATED
from corvane.session import through_table


# sources and pages grow with the tables: joined by shuffles, so that no part of them passes through the driver
SHUFFLED = "merge"


def check_hashes(entries: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """``(valid, errors)`` of ``(source_id, content_hash)`` rows; the last valid row wins."""
    no_id = X.strip(X.text_or_empty(F.col("source_id"))) == ""
    no_hash = X.strip(X.text_or_empty(F.col("content_hash"))) == ""
    errors = entries.filter(no_id | no_hash).select(
        pos, F.lit("invalid_source_hash_entry").alias("code"),
        F.when(no_id, "missing required key 'source_id'").otherwise("missing required key 'content_hash'").alias("detail"))
    valid = first_per_key(entries.filter(~no_id & ~no_hash), ["source_id"], [F.col(pos).desc()])
    return valid, errors


def transitions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Sources in both snapshots whose hash differs."""
    old = previous.select("source_id", F.col("content_hash").alias("old_hash"))
    new = current.select("source_id", F.col("content_hash").alias("new_hash"))
    return old.join(new.hint(SHUFFLED), "source_id").filter("old_hash <> new_hash")


def stale_links(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source_id, page_id)`` for every page a changed source feeds.

    ``edges`` are distinct ``(source_id, page_id)`` pairs. One source may feed a large part
    of all pages, so its edges are salted by their count.
    """
    weights = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    dim = changed.select("source_id").join(weights.hint(SHUFFLED), "source_id")
    return lookup(edges, dim, ["source_id"], "_n", how="inner", spread=["page_id"], join_hint=SHUFFLED).select("source_id", "page_id")


def transition_counts(changed: DataFrame, links: DataFrame) -> DataFrame:
    """Each transition with its number of affected pages; pageless ones stay."""
    n = links.groupBy("source_id").agg(F.count(F.lit(1)).alias("affected_pages"))
    return changed.join(n.hint(SHUFFLED), "source_id", "left").select(
        "source_id", "old_hash", "new_hash", F.coalesce("affected_pages", F.lit(0)).alias("affected_pages"),
        F.lit("source_hash_changed").alias("reason"))


def stale_pages(links: DataFrame) -> DataFrame:
    """Stale pages with the count and the least of their changed sources."""
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("changed_sources"), F.min("source_id").alias("first_source_id"),
        F.max("source_id").alias("last_source_id"))


# What an evidence reference must not carry.
FORBIDDEN_KEYS = ("raw_body", "raw_html", "content", "body", "full_text", "payload")
STALE_REASONS = ("source_hash_changed", "missing_source", "manual_revalidate")


def check_packets(packets: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_KEYS) -> DataFrame:
    """Add ``error`` to maintenance packets; the empty string marks a valid one.

    ``(job_id, target_page_id, target_page_path, stale_reason, source_hashes map,
    evidence_refs array<map>)``.
    """
    blank = lambda c: X.strip(X.text_or_empty(F.col(c))) == ""
    keys = F.array(*[F.lit(k) for k in forbidden])
    leaks = F.exists(
        F.coalesce("evidence_refs", F.array().cast("array<map<string,string>>")),
        lambda ref: F.arrays_overlap(F.map_keys(ref), keys))
    return packets.withColumn("error", F.when(
        blank("job_id") | blank("target_page_id") | blank("target_page_path"), "job_id, target_page_id, and target_page_path must be non-empty")
        .when(~F.col("stale_reason").isin(*STALE_REASONS), "unsupported stale_reason")
        .when(F.col("source_hashes").isNull() | (F.size("source_hashes") == 0), "source_hashes must be a non-empty object")
        .when(F.col("evidence_refs").isNull(), "evidence_refs must be a list")
        .when(leaks, "evidence reference contains forbidden raw payload fields").otherwise(""))


# ------------------------------------------------------------------------- lint
def expected_pages(registry: DataFrame) -> DataFrame:
    done = registry.filter(F.lower("wiki_status").isin(*INTEGRATED))
    return done.select(F.explode("wiki_page_paths").alias("path")).distinct()


def orphan_pages(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Pages no integrated source claims."""
    return pages.select("path").join(expected_pages(registry), "path", "left_anti")


def cited_sources(text) -> "F.Column":
    """Source ids of a page: its frontmatter list, else its source lines."""
    listed = X.frontmatter_list(text, "source_ids")
    lines = F.regexp_extract_all(text, F.lit(r"`([^`]+)`\s+-\s+raw_sources/"), F.lit(1))
    return F.when(F.size(listed) > 0, listed).otherwise(lines)


def missing_citations(pages: DataFrame) -> DataFrame:
    """Pages without source ids, source paths or a sources section."""
    paths = F.exists(X.frontmatter_list(F.col("text"), "source_paths"), lambda p: p.startswith("raw_sources/"))
    ok = (F.size(cited_sources(F.col("text"))) > 0) & paths & F.col("text").contains("## Sources")
    return pages.filter(~ok).select("path")


def stale_checksums(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Ready sources whose stored file ``(markdown_path, file_checksum)`` changed."""
    return registry.filter("status = 'ready'").join(files, "markdown_path").filter(
        F.col("checksum") != F.col("file_checksum")).select("source_id")


def review_items(queue: DataFrame) -> DataFrame:
    """Open check boxes of review queues ``(path, text)`` with the heading above.

    A line carries the last heading above it along; a queue, one row before, is as long as
    its lines.
    """
    lines = queue.select("path", F.posexplode(X.split_lines(F.col("text"))).alias("pos", "line")).withColumn(
        "line", X.strip(F.col("line")))
    head = F.when(F.col("line").startswith("#"), X.strip(F.ltrim(F.col("line"), F.lit("#"))))
    sofar = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.filter(F.col("line").startswith("#") | F.col("line").startswith("- [ ]"))
    open_items = marked.withColumn("heading", F.last(head, ignorenulls=True).over(sofar)).filter(F.col("line").startswith("- [ ]"))
    body = X.strip(F.regexp_replace("line", r"^- \[ \]\s*", ""))
    named = X.strip(F.regexp_extract(body, r"\breason\s*=\s*(.+)$", 1))
    tail = X.strip(F.regexp_extract(body, r"^.*:(.*)$", 1))
    reason = F.when(named != "", named).when(body.contains(":"), tail).otherwise(body)
    clash = F.lower(reason).contains("contradiction") | F.lower(reason).contains("conflict")
    return open_items.select(
        "path", (F.col("pos") + 1).alias("line_number"),
        X.strip(F.regexp_extract(body, "`([^`]+)`", 1)).alias("source_id"), reason.alias("reason"),
        F.when(clash, "contradiction").otherwise("review").alias("type"),
        F.coalesce("heading", F.lit("")).alias("heading"))


def contradictions(pages: DataFrame, queued: DataFrame, rounds: int = 1000) -> DataFrame:
    """Contradiction items of pages ``(path, text)`` for sources not queued yet.

    Pages speak in path order, each for its first source id that neither the queue nor an
    earlier page has. All pages propose at once; a source keeps its earliest proposer
    and the others move to their next id, until nobody is turned away. As all sources
    prefer earlier paths, this ends in the same items as walking the pages one by one. It takes
    as many rounds as pages compete for one list of sources; more than ``rounds`` raise.
    """
    hit = F.filter(
        F.transform(X.split_lines(F.col("text")), lambda v, i: F.struct((i + 1).alias("line_number"), X.strip(v).alias("reason"))),
        lambda s: F.lower(s["reason"]).contains("contradiction"))
    rows = pages.select("path", F.get(hit, F.lit(0)).alias("hit"), F.array_distinct(cited_sources(F.col("text"))).alias("ids"))
    wishes = rows.filter("hit IS NOT NULL").select("path", "hit", F.posexplode("ids").alias("pos", "source_id")).join(
        queued.select("source_id").distinct(), "source_id", "left_anti")
    ranked = wishes.withColumn("wish", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).drop("pos")
    wishes = through_table(ranked, "wishes")
    turn = wishes.select("path").distinct().withColumn("wish", F.lit(1))
    for _ in range(rounds):
        asking = wishes.join(turn, ["path", "wish"])
        kept = asking.groupBy("source_id").agg(F.min("path").alias("path"))
        turned_away = asking.join(kept, ["source_id", "path"], "left_anti").select("path", "wish")
        if turned_away.isEmpty():
            return asking.select("source_id", "path", "hit.line_number", "hit.reason")
        moved = turned_away.withColumn("next", F.col("wish") + 1).drop("wish")
        turn = through_table(
            turn.join(moved, "path", "left").select("path", F.coalesce("next", "wish").cast("int").alias("wish")), "turns")
    raise RuntimeError(f"sources are not dealt out after {rounds} rounds")
