"""PDF pages, tables in markdown, tabular sources and scaffolded wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.numbers import round_exact
from corvane.functions.urls import canonical
from corvane.operators.chunking import explode_page_chunks, pack_blocks

MAX_BYTES = 25 * 1024 * 1024
OCR_LIMIT, TEXT_LIMIT = 8, 80


# ------------------------------------------------------------------- structure
def section_path(text: Column, depth: int = 3) -> Column:
    """Heading trail of a text, joined by `` > ``; stops at ``depth`` open headings.

    A heading replaces those of its own and deeper levels.
    """
    heads = F.filter(X.split_lines(text), lambda v: v.rlike(r"^\s{0,3}#{1,4}\s+\S"))

    def step(trail: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^\s{0,3}(#{1,4})\s", 1))
        title = X.collapse_space(F.regexp_extract(line, r"^\s{0,3}#{1,4}\s+(.+?)\s*$", 1))
        longer = F.concat(F.slice(trail, 1, F.greatest(level - 1, F.lit(0))), F.array(title))
        return F.when(F.size(trail) >= depth, trail).otherwise(longer)

    return F.array_join(F.aggregate(heads, F.array().cast("array<string>"), step), " > ")


SEPARATOR_CELL = r"^:?-{3,}:?$"


def is_table_start(header: Column, separator: Column) -> Column:
    """Header row followed by a row of dashes."""
    cells = F.transform(F.split(F.btrim(separator, F.lit("|")), r"\|"), X.strip)
    return header.startswith("|") & separator.startswith("|") & F.forall(cells, lambda c: c.rlike(SEPARATOR_CELL))


def table_rows(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per markdown table: ``keys, table_no, row_count, markdown``.

    A table is a header, a separator and the pipe rows after them. In a run of pipe lines
    the first header opens the table, which takes the rest of the run. A page's lines are
    folded inside its row.
    """
    lines = F.transform(X.split_lines(F.col(text)), X.strip)
    following = F.concat(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), F.array(F.lit("")))
    marked = F.zip_with("_lines", following, lambda line, after: F.struct(
        line.alias("line"), line.startswith("|").alias("piped"), F.coalesce(is_table_start(line, after), F.lit(False)).alias("start")))
    none = F.array().cast("array<string>")

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def step(acc: Column, at: Column) -> Column:
        taken = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(at["line"])).alias("open"))
        return F.when(~at["piped"], F.struct(closed(acc).alias("done"), none.alias("open"))).when(
            at["start"] | (F.size(acc["open"]) > 0), taken).otherwise(acc)

    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("open"))
    tables = pages.select(*keys, lines.alias("_lines")).select(*keys, F.aggregate(marked, zero, step, closed).alias("_tables"))
    return tables.select(*keys, F.posexplode("_tables").alias("_i", "_t")).select(
        *keys, F.array_join("_t", "\n").alias("markdown"), (F.size("_t") - 2).alias("row_count"), (F.col("_i") + 1).alias("table_no"))


def table_id(page_number: Column, table_no: Column) -> Column:
    return F.format_string("p%04d-t%03d", page_number.cast("int"), table_no.cast("int"))


# ------------------------------------------------------------------------- PDF
def low_text_reason(chars: Column, pages: Column) -> Column:
    """Why a PDF is not usable as text, NULL when it is."""
    return (
        F.when(pages == 0, "malformed").when(chars <= OCR_LIMIT, "ocr_required").when(chars < TEXT_LIMIT, "low_text")
    )


def gate_pdfs(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Accept or quarantine PDF files by size and by the letters and digits of all pages.

    ``files (pdf_source_id, path, size_bytes)``, ``pages (pdf_source_id, page_number, text)``.
    """
    texts = pages.groupBy("pdf_source_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum(X.meaningful_chars(F.col("text"))).alias("meaningful_chars"))
    rows = files.join(texts, "pdf_source_id", "left").withColumns({
        "page_count": F.coalesce("page_count", F.lit(0)), "meaningful_chars": F.coalesce("meaningful_chars", F.lit(0))})
    reason = F.when(F.col("size_bytes") > MAX_BYTES, "too_large").otherwise(
        low_text_reason(F.col("meaningful_chars"), F.col("page_count")))
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def pdf_chunks(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Page windows with ids made of source, page, window and a digest of the text."""
    rows = explode_page_chunks(pages, "text", size, overlap)
    digest = F.substring(F.sha2("text", 256), 1, 16)
    return rows.withColumns({
        "char_count": F.length("text"),
        "chunk_id": F.concat(
            F.col("pdf_source_id"), F.format_string("-p%04d-c%04d-", F.col("page_number").cast("int"), F.col("chunk_index")), digest),
    })


def pdf_page_parts(pages: DataFrame, now: str) -> DataFrame:
    """Registry-ready rows of PDF pages, long pages split into parts.

    ``pages (pdf_source_id, source_path, original_url, page_number, text)``.
    """
    rows = pack_blocks(pages, count="part_count").withColumn(
        "part_index", F.when(F.col("part_count") > 1, F.col("part_index")).otherwise(0))
    identity = X.first_filled(canonical(F.col("original_url")), F.col("source_path"), F.col("pdf_source_id"))
    label = F.format_string("#page=%04d", F.col("page_number").cast("int"))
    part = F.when(F.col("part_index") > 0, F.format_string("-part=%03d", F.col("part_index"))).otherwise("")
    # an address loses its fragment in the identity, a path keeps it
    raw = F.concat(identity, label, part)
    stem = X.first_filled(F.regexp_extract("source_path", "([^/]+)$", 1), F.col("pdf_source_id"))
    markdown = F.concat(X.strip(F.col("text")), F.lit("\n"))
    return rows.withColumn("markdown", markdown).select(
        X.stable_digest_id(F.lit("pdf"), canonical(raw)).alias("source_id"), F.lit("pdf").alias("source_kind"),
        F.concat(stem, F.lit(" p. "), "page_number", F.when(F.col("part_index") > 0, F.concat(F.lit(" part "), "part_index")).otherwise("")).alias("title"),
        "pdf_source_id", "page_number", "part_index", "part_count", "markdown", F.sha2("markdown", 256).alias("checksum"),
        section_path(F.col("markdown")).alias("section_path"), F.length("markdown").alias("char_count"),
        F.lit("ready").alias("status"), F.lit(now).alias("first_seen_at"))


def document_quality(units: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Pages, characters a page, tables and warnings of each document.

    ``units`` are page texts ``(keys, page_number, char_count, repeated)``.
    """
    u = units.groupBy(*keys).agg(
        F.countDistinct("page_number").alias("page_coverage_count"), F.sum("char_count").alias("chars"),
        F.count_if(F.col("char_count") == 0).alias("empty_section_count"), F.bool_or("repeated").alias("repeated_header_footer_detected"))
    t = tables.groupBy(*keys).agg(F.count(F.lit(1)).alias("table_count"))
    rows = u.join(t, keys, "left").withColumn("table_count", F.coalesce("table_count", F.lit(0)))
    per_page = F.when(F.col("page_coverage_count") > 0, round_exact(F.col("chars") / F.col("page_coverage_count"), 2)).otherwise(0.0)
    rows = rows.withColumn("chars_per_page", per_page)
    warnings = F.array_compact(F.array(
        F.when((F.col("page_coverage_count") > 0) & (F.col("chars_per_page") < 80), F.lit("low_chars_per_page")),
        F.when(F.col("table_count") == 0, F.lit("no_tables_detected")),
        F.when(F.col("repeated_header_footer_detected"), F.lit("repeated_header_footer_detected"))))
    return rows.withColumn("warnings", warnings).drop("chars")


def pdf_fallbacks(sources: DataFrame, chunks: DataFrame, quarantine: DataFrame, have_pages: DataFrame) -> DataFrame:
    """State of each PDF known only by its sources, chunks or quarantine rows.

    A full outer join of the three by ``pdf_source_id``; those with page files are left out.
    Chunk texts stay rows, see ``chunk_texts``; here they are only counted.
    """
    c = chunks.groupBy("pdf_source_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_if(X.strip(F.col("text")) != "").alias("text_chunks"),
        F.min("source_path").alias("chunk_path"), F.min("parser").alias("p1"), F.max("parser").alias("p2"))
    s = sources.select("pdf_source_id", F.col("path").alias("source_row_path"))
    q = quarantine.select("pdf_source_id", F.col("path").alias("quarantine_path"), "reason", "detail")
    rows = s.join(c, "pdf_source_id", "full_outer").join(q, "pdf_source_id", "full_outer").join(
        have_pages.select("pdf_source_id").distinct(), "pdf_source_id", "left_anti").filter("pdf_source_id <> ''")
    usable = F.coalesce("text_chunks", F.lit(0)) > 0
    some = F.coalesce("chunk_count", F.lit(0)) > 0
    why = X.first_filled(F.col("reason"), F.when(some, "PDF source produced no usable markdown chunks").otherwise(
        "PDF source produced no usable markdown"))
    parser = F.when(F.col("p1").isNull(), "pdf_chunks").when(F.col("p1") == F.col("p2"), F.col("p1")).otherwise("mixed")
    return rows.select(
        "pdf_source_id", X.first_filled(F.col("source_row_path"), F.col("quarantine_path"), F.col("chunk_path")).alias("source_path"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), parser.alias("parser"),
        F.when(usable, "ready").otherwise("failed").alias("status"), F.when(usable, "").otherwise(why).alias("error_reason"))


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """Non-empty chunk texts of each PDF in page and chunk order, as ordered rows.

    A document is their concatenation with blank lines; it is never built in memory, the
    sink writes the ordered rows.
    """
    rows = chunks.withColumn("text", X.strip(F.col("text"))).filter("text <> ''")
    return rows.select("pdf_source_id", "page_number", "chunk_index", "text")


# --------------------------------------------------------------------- tabular
def escape_cell(c: Column) -> Column:
    return X.strip(F.replace(F.replace(X.text_or_empty(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def markdown_rows(rows: DataFrame, keys: list[str], pos: str, cells: str = "cells") -> DataFrame:
    """Markdown line of each table row, padded to the table's widest row.

    ``cells`` is an array; the row with the least ``pos`` is the header, which is followed
    by the separator line. ``(keys, pos, part, line)`` in order; ``part`` 1 is the separator.
    """
    width = rows.groupBy(*keys).agg(F.max(F.size(cells)).alias("_w"), F.min(pos).alias("_head"))
    wide = rows.join(width, keys) if keys else rows.join(F.broadcast(width), F.lit(True))
    padded = F.concat(F.transform(cells, escape_cell), F.array_repeat(F.lit(""), F.col("_w") - F.size(cells)))
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), F.col("_w")))
    lines = F.when(F.col(pos) == F.col("_head"), F.array(line(padded), rule)).otherwise(F.array(line(padded)))
    return wide.select(*keys, pos, F.posexplode(lines).alias("part", "line"))


def tabular_review(rows: DataFrame, keys: list[str], pos: str, cells: str = "cells") -> DataFrame:
    """Data rows, filled cells and the review reason of each table (``''`` when fine)."""
    head = rows.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("data_rows"),
        F.sum(F.size(F.filter(cells, lambda c: X.strip(X.text_or_empty(c)) != ""))).alias("_all"),
        F.min_by(F.size(F.filter(cells, lambda c: X.strip(X.text_or_empty(c)) != "")), pos).alias("_head"))
    filled = F.col("_all") - F.col("_head")
    reason = F.when(F.col("data_rows") <= 0, "Tabular source produced no data rows").when(
        filled <= 0, "Tabular source produced no meaningful data cells").otherwise("")
    return head.select(*keys, "data_rows", filled.alias("meaningful_cells"), reason.alias("review_reason"))


# ------------------------------------------------------------------ wiki pages
# Ordered topics of scaffolded pages.
TOPICS = (
    ("programs", "Programs", ("program",)), ("finance", "Finance", ("tuition", "billing", "finance", "financial")),
    ("admissions", "Admissions", ("admission", "apply", "deadline")),
)


def topic(kind: Column, title: Column, url: Column, body: Column, source_id: Column) -> Column:
    """``struct(slug, title)`` of the wiki page a source belongs to."""
    hay = F.lower(F.concat_ws("\n", title, url, F.substring(body, 1, 1000)))
    own = X.first_filled(title, source_id, F.lit("source"))
    own_slug = F.substring(X.first_filled(X.slug(own), F.lit("source")), 1, 80)
    pair = lambda s, t: F.struct(s.alias("slug"), t.alias("title"))
    chain = F.when(F.lower(kind).isin("excel", "csv", "tabular"), pair(F.lit("programs"), F.lit("Programs")))
    for slug, name, needles in TOPICS:
        chain = chain.when(X.contains_any(hay, needles), pair(F.lit(slug), F.lit(name)))
    return chain.otherwise(pair(own_slug, X.strip(own)))


def excerpt(body: Column, chars: int = 1200) -> Column:
    """Body lines without heading marks, rules and blanks, cut to ``chars``."""
    lines = F.transform(X.split_lines(body), X.strip)
    kept = F.filter(lines, lambda v: (v != "") & ~v.startswith("---"))
    return F.substring(X.strip(F.array_join(F.transform(kept, lambda v: X.strip(F.ltrim(v, F.lit("# ")))), "\n")), 1, chars)


def scaffold_pages(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and their ordered pieces from sources ``(source_id, source_kind, title, url, body, pos)``.

    The pieces ``(slug, pos, source_id, excerpt)`` are rows in order, so a page fed by most
    of the sources is written by many tasks and never assembled in one.
    """
    rows = sources.withColumn("_t", topic(
        F.col("source_kind"), F.col("title"), F.col("url"), F.col("body"), F.col("source_id")))
    pieces = rows.select(
        F.col("_t.slug").alias("slug"), F.col("_t.title").alias("page_title"), "pos", "source_id", excerpt(F.col("body")).alias("excerpt"))
    pages = pieces.groupBy("slug").agg(
        F.min_by("page_title", "pos").alias("title"), F.count(F.lit(1)).alias("source_count"),
        F.count_if(F.col("excerpt") != "").alias("excerpt_count")).withColumn(
        "path", F.concat(F.lit("wiki/pages/"), "slug", F.lit(".md")))
    return pages, pieces.drop("page_title")


def mark_integrated(registry: DataFrame, pieces: DataFrame, now: str) -> DataFrame:
    """Registry with page path and state of every source that went into a page."""
    done = pieces.select("source_id", F.concat(F.lit("wiki/pages/"), "slug", F.lit(".md")).alias("_page"))
    rows = registry.join(done, "source_id", "left")
    hit = F.col("_page").isNotNull()
    return rows.withColumns({
        "wiki_status": F.when(hit, "integrated").otherwise(F.col("wiki_status")),
        "wiki_integrated_at": F.when(hit, F.lit(now)).otherwise(F.col("wiki_integrated_at")),
        "wiki_page_paths": F.when(hit, F.array("_page")).otherwise(F.col("wiki_page_paths")),
    }).drop("_page")


# Page types shown as guides and path marks of PDF shards.
GUIDE_TYPES = ("semantic", "category", "navigation", "concept", "entity", "workflow", "process")
SHARD_MARKERS = ("catalog-pdf", "/pdf-p-", "-pdf-")


def page_type(explicit: Column, rel_path: Column, shards: tuple[str, ...] = SHARD_MARKERS) -> Column:
    given = F.lower(F.trim(X.text_or_empty(explicit)))
    depth = F.length(rel_path) - F.length(F.replace(rel_path, F.lit("/"), F.lit("")))
    return (
        F.when(given != "", given).when(X.contains_any(rel_path, shards), "source")
        .when(rel_path.startswith("pages/schools/") | rel_path.endswith("-guide.md"), "semantic")
        .when(depth <= 1, "category").otherwise("unknown"))


def in_view(kind: Column, rel_path: Column, view: str, guides=GUIDE_TYPES, shards: tuple[str, ...] = SHARD_MARKERS) -> Column:
    shard = X.contains_any(rel_path, shards)
    if view == "all":
        return F.lit(True)
    if view == "sources":
        return (kind == "source") | shard
    depth = F.length(rel_path) - F.length(F.replace(rel_path, F.lit("/"), F.lit("")))
    return ~((kind == "source") | shard) & (
        kind.isin(*guides) | rel_path.startswith("pages/schools/") | rel_path.endswith("-guide.md") | ((kind == "unknown") & (depth <= 1)))


def list_pages(pages: DataFrame, search: str = "", limit: int = 200) -> DataFrame:
    """Pages ``(path, category, title, page_type)`` matching a search, semantic ones first."""
    hay = F.lower(F.concat_ws("\n", "title", "path"))
    rows = pages.filter(hay.contains(search.lower())) if search else pages
    first = F.when(F.col("page_type") == "semantic", 0).otherwise(1)
    return rows.orderBy(first, F.lower("category"), F.lower("title"), "path").limit(limit)
