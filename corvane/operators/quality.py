"""Content quality gate, chrome removal, failure classes and scrape scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.numbers import round_exact
from corvane.functions.text import (
    SPACE, bind, collapse_space, first_filled, split_lines, strip, text_or_empty, word_count,
)
from corvane.operators.relational import constants, seen_before, top_k
from corvane.session import through_table

ACTIONS = ("approved", "cleaned", "needs_review", "quarantined")

# Signals of the quality gate.
CONTACT = (
    r"\b(?:email|phone|contact|office|address|deadline|tuition|fee|cost|admission|admissions|\d{3}[-.\s]\d{3})\b"
)
REDIRECT = r"\b(?:redirecting|you are being redirected|click here if you are not redirected)\b"
PDF_OBJECT = r"\b(?:obj|endobj|xref|trailer|startxref)\b"
CHROME_WORDS = (
    "home", "about", "academics", "admission", "admissions", "apply", "search", "menu", "students",
    "faculty", "staff", "alumni", "contact", "privacy", "copyright",
)
CHROME_STARTS = ("skip to", "search", "menu", "copyright", "privacy")
CHROME_CRUMB = r"^(?:home|about|academics|admissions?|apply|search|menu)(?:\s+/\s+.*)?$"
PHONE = r"\d{3}[-.\s]\d{3}"


def normal_line(line: Column) -> Column:
    return F.lower(collapse_space(line))


def is_chrome(line: Column, normal: Column) -> Column:
    """Navigation or footer line by its normalised text; headings never are."""
    def judge(n: Column) -> Column:
        starts = F.lit(False)
        for start in CHROME_STARTS:
            starts = starts | n.startswith(start)
        bars = F.size(F.filter(F.split(n, r"\|"), lambda p: F.trim(p) != ""))
        return (
            F.when(n == "", False).when(n.contains("@") | n.rlike(PHONE), False)
            .when(starts | n.isin(*CHROME_WORDS), True).when(n.contains(" | ") & (bars >= 4), True)
            .otherwise(n.rlike(CHROME_CRUMB))
        )

    return F.when(F.ltrim(line).startswith("#"), False).otherwise(bind(F.btrim(normal, F.lit("#*- ")), judge))


def with_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_lines`` (line, normal, chrome) and ``_repeated``, the lines seen three times.

    In the sorted list a line seen three times equals the one two places on, so no line
    is compared with all others.
    """
    lines = F.transform(split_lines(F.col(text)), lambda v: F.struct(v.alias("line"), normal_line(v).alias("normal")))
    flagged = F.transform(
        F.col("_lines"), lambda s: F.struct(s["line"], s["normal"], is_chrome(s["line"], s["normal"]).alias("chrome")))
    ordered = F.array_sort(F.filter(F.transform(F.col("_lines"), lambda s: s["normal"]), lambda v: v != ""))
    thrice = F.array_distinct(F.filter(F.col("_sorted"), lambda v, i: F.get(F.col("_sorted"), i + 2) == v))
    return (
        df.withColumn("_lines", lines).withColumn("_lines", flagged).withColumn("_sorted", ordered)
        .withColumn("_repeated", thrice)
    )


def strip_chrome(df: DataFrame, text: str = "text", out: str = "cleaned_text") -> DataFrame:
    """Drop chrome lines that repeat three times or have at most four words.

    A text with nothing left keeps its original form.
    """
    lined = df if "_lines" in df.columns else with_lines(df, text)
    drop = lambda s: s["chrome"] & (s["normal"] != "") & (
        F.array_contains(F.col("_repeated"), s["normal"]) | (F.size(F.split(s["normal"], " ")) <= 4))
    kept = F.transform(F.filter(F.col("_lines"), lambda s: ~drop(s)), lambda s: s["line"])
    joined = strip(F.array_join(kept, "\n"))
    cleaned = bind(joined, lambda c: F.when(c != "", F.concat(c, F.lit("\n"))).otherwise(F.col(text)))
    result = lined.withColumn(out, cleaned)
    return result if lined is df else result.drop("_lines", "_sorted", "_repeated")


def assess(df: DataFrame, text: str = "text", parser_kind: str = "", seen: str | None = None) -> DataFrame:
    """Add the quality record of each text.

    Quarantined: NUL byte, PDF bytes or a redirect stub. Needs review: at most two words
    and no contact signal. Cleaned: chrome or link lines prevail. Else approved.
    ``seen`` names a flag column for texts met before; it adds a reason only.
    """
    t = F.col(text)
    rows = strip_chrome(with_lines(df, text), text)
    normal = F.filter(F.transform(F.col("_lines"), lambda s: s["normal"]), lambda v: v != "")
    link_line = lambda v: (v.startswith("-") | v.startswith("*")) & (v.contains("http") | v.contains("]("))
    rows = (
        rows.withColumn("word_count", word_count(t))
        .withColumn("_cleaned_words", word_count(F.col("cleaned_text")))
        .withColumn("_n", F.size(normal))
        .withColumn("_chrome", F.size(F.filter(F.col("_lines"), lambda s: s["chrome"] & (s["normal"] != ""))))
        .withColumn("_links", F.size(F.filter(F.col("_lines"), lambda s: link_line(strip(s["line"])))))
        .withColumn("checksum", F.sha2(t, 256))
        .withColumn("has_nul_byte", t.contains("\x00"))
        .withColumn("has_pdf_signature", F.ltrim(t).startswith("%PDF"))
        .withColumn("_low", F.lower(t))
    )
    some = lambda c: F.when(F.col("_n") > 0, c).otherwise(0.0)
    boiler = F.least(F.lit(1.0), (F.col("_chrome") + F.size("_repeated")) / F.col("_n"))
    rows = (
        rows.withColumn("_boiler", some(boiler)).withColumn("_link", some(F.col("_links") / F.col("_n")))
        .withColumn("has_pdf_object_stream", t.rlike("(?U)" + PDF_OBJECT) & (
            F.lower(F.substring(t, 1, 2000)).contains("stream") | F.col("has_pdf_signature")))
        .withColumn("redirect_stub", (F.col("_low").rlike("(?U)" + REDIRECT) & (F.col("word_count") <= 80)) | (
            F.col("_low").contains("<meta") & F.col("_low").contains("refresh") & (F.col("word_count") <= 120)))
        .withColumn("duplicate_checksum", F.col(seen) if seen else F.lit(False))
    )
    bad = F.col("has_nul_byte") | F.col("has_pdf_signature") | F.col("has_pdf_object_stream") | F.col("redirect_stub")
    few = (F.col("word_count") <= 2) & ~F.col("_low").rlike("(?U)" + CONTACT)
    noisy = (
        (F.col("_cleaned_words") < F.col("word_count") * 0.75) | (F.col("_boiler") >= 0.3) | (F.col("_link") >= 0.45)
    )
    action = (
        F.when(bad, "quarantined").when(few, "needs_review").when(noisy, "cleaned").otherwise("approved")
    )
    rows = rows.withColumn("action", action)
    flags = (
        ("has_nul_byte", "contains_nul_byte"), ("has_pdf_signature", "starts_with_pdf_signature"),
        ("has_pdf_object_stream", "contains_pdf_object_stream"), ("redirect_stub", "redirect_stub"),
        ("duplicate_checksum", "duplicate_checksum"),
    )
    reasons = F.array_compact(F.array(
        *[F.when(F.col(c), F.lit(r)) for c, r in flags],
        F.when(F.col("action") == "needs_review", F.lit("low_word_count")),
        F.when(F.col("action") == "cleaned", F.lit("high_boilerplate_or_link_ratio")),
    ))
    pdf = F.col("has_pdf_signature") | F.col("has_pdf_object_stream")
    return (
        rows.withColumn("reasons", reasons)
        .withColumn("boilerplate_ratio", round_exact(F.col("_boiler"), 4)).withColumn("link_line_ratio", round_exact(F.col("_link"), 4))
        .withColumn("recommended_parser_route", F.when(pdf, "pdf").otherwise(parser_kind or "markdown"))
        .drop("_lines", "_sorted", "_repeated", "_cleaned_words", "_n", "_chrome", "_links", "_boiler", "_link", "_low")
    )


def repeated_header_footer(df: DataFrame, text: str = "text", out: str = "repeated_header_footer") -> DataFrame:
    """Whether any line of at most eight words occurs three times."""
    lined = with_lines(df, text)
    short = F.exists("_repeated", lambda v: F.size(F.split(v, " ")) <= 8)
    return lined.withColumn(out, short).drop("_lines", "_sorted", "_repeated")


def summarize(records: DataFrame, pos: str, id_col: str = "source_id", examples: int = 5) -> DataFrame:
    """Count and first ``examples`` ids of every action, zero-filled."""
    known = records.withColumn(
        "action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("needs_review"))
    # counts and examples both read the actions, which cost a pass over the texts
    known = through_table(known.select("action", id_col, F.col(pos).alias("_pos")), "actions")
    counts = known.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    first = top_k(known, ["action"], [F.col("_pos")], examples, "_r")
    shown = first.groupBy("action").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", id_col))), lambda s: s[id_col]).alias("examples"))
    every = constants(records.sparkSession, [(a,) for a in ACTIONS], "action")
    return every.join(counts, "action", "left").join(shown, "action", "left").select(
        "action", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


# Ordered topic rejections and the topics students can act on.
TOPIC_BLOCKS = (
    ("giving", ("/giving", "donor", "advancement", "annual report")), ("alumni", ("alumni",)),
    ("old_news", ("/news/", "magazine", "press release")), ("staff_bio", ("bio", "biography", "profile")),
    ("design_demo", ("design system", "component library", "template", "demo")),
    ("admin", ("trustee", "president", "cabinet", "administration")),
)
TOPIC_ALLOWED = (
    "registrar", "enrollment", "calendar", "course", "catalog", "degree", "program", "grades", "gpa",
    "tuition", "financial aid", "scholarship", "billing", "housing", "dining", "health", "counseling",
    "parking", "orientation", "accessibility", "admission", "student",
)


def topic_rejection(title: Column, url: Column, snippet: Column) -> Column:
    from corvane.functions.text import contains_any, first_label

    hay = F.lower(F.concat_ws(" ", title, url, snippet))
    blocked = first_label(hay, TOPIC_BLOCKS)
    return (
        F.when(blocked != "", F.concat(F.lit("student_policy_"), blocked))
        .when(~contains_any(hay, TOPIC_ALLOWED), "student_policy_not_student_actionable").otherwise("")
    )


def gate_candidates(found: DataFrame, domains: DataFrame) -> DataFrame:
    """Accept or reject web results ``(url, title, snippet)`` with all reasons.

    Trusted domain, then address safety, then text quality and topic. A high link ratio
    alone does not reject.
    """
    from corvane.operators.crawl import trusted_domain, url_safety

    rows = trusted_domain(found, domains).withColumn("_safety", url_safety(F.col("url"))).withColumn(
        "_text", F.concat(F.col("title"), F.lit("\n\n"), F.col("snippet"), F.lit("\n\n"), F.col("url")))
    rows = assess(rows, "_text", parser_kind="web-search").withColumn(
        "_topic", topic_rejection(F.col("title"), F.col("url"), F.col("snippet")))
    quality = F.concat(F.col("reasons"), F.array_compact(F.array(
        F.when(F.col("action") == "quarantined", F.lit("source_quality_quarantined")),
        F.nullif("_topic", F.lit("")))))
    reasons = (
        F.when(F.col("trust_reason") != "trusted_domain", F.array("trust_reason"))
        .when(F.col("_safety") != "ok", F.array("_safety")).otherwise(quality)
    )
    rows = rows.withColumn("reasons", reasons)
    harmless = F.array(F.lit("high_boilerplate_or_link_ratio"))
    return rows.withColumn("accepted", F.size(F.array_except("reasons", harmless)) == 0).select(
        *found.columns, "accepted", "reasons")


# --------------------------------------------------------------- scrape results
def failure_class(
    http_status: Column, content_type: Column, text_length: Column, link_density: Column,
    error_name: Column, error_message: Column,
) -> Column:
    """Failure reason of a fetch, NULL for success. Errors first, then status and content."""
    name, msg = F.lower(text_or_empty(error_name)), F.lower(text_or_empty(error_message))
    failed = error_name.isNotNull() | error_message.isNotNull()
    return (
        F.when(failed & (name.contains("timeout") | msg.contains("timeout")), "timeout")
        .when(failed & msg.contains("robot"), "robots_disallowed")
        .when(failed & (msg.contains("blocked") | msg.contains("captcha")), "blocked")
        .when(failed, "parse_error")
        .when(http_status.isin(403, 429), "blocked").when(http_status >= 400, "http_error")
        .when((text_or_empty(content_type) != "") & ~F.lower(content_type).contains("html"), "non_html")
        .when(text_length == 0, "empty_content")
        .when((link_density > 0.25) & (text_length < 700), "too_low_signal")
    )


def scrape_score(failure: Column, text_length: Column, markdown_chars: Column, link_density: Column) -> Column:
    """0-100: 45, up to 35 for text, up to 20 for markdown, less up to 20 for links."""
    part = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top)) / F.lit(float(top))
    penalty = F.when(link_density > 0.25, F.least((link_density - 0.25) * 40.0, F.lit(20.0))).otherwise(0.0)
    score = 45.0 + part(text_length, 4000) * 35.0 + part(markdown_chars, 6000) * 20.0 - penalty
    ok = round_exact(F.greatest(F.lit(0.0), F.least(score, F.lit(100.0))), 2)
    return F.when(text_or_empty(failure) != "", 0.0).otherwise(ok)


def mode_summary(results: DataFrame, mode: str = "mode") -> DataFrame:
    """Success rate, speed, mean quality and medians of each fetch mode."""
    ok = first_filled(F.col("failure_reason")) == ""
    seconds = F.coalesce(F.col("elapsed_sec"), F.lit(0.0))
    won = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0)))
    return results.groupBy(mode).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        round_exact(F.count_if(ok) / F.count(F.lit(1)), 4).alias("success_rate"),
        round_exact(F.avg(seconds), 4).alias("avg_elapsed_sec"),
        F.when(F.sum(seconds) > 0, round_exact(F.count(F.lit(1)) / F.sum(seconds) * 60.0, 2)).otherwise(0.0).alias("pages_per_min"),
        F.coalesce(round_exact(F.avg(won("quality_score")), 2), F.lit(0.0)).alias("avg_quality_success"),
        F.coalesce(F.floor(F.median(won("text_length"))), F.lit(0)).cast("long").alias("median_text_length_success"),
        F.coalesce(F.floor(F.median(won("markdown_chars"))), F.lit(0)).cast("long").alias("median_markdown_chars_success"),
    )


def failure_breakdown(results: DataFrame, mode: str = "mode") -> DataFrame:
    return results.filter(first_filled(F.col("failure_reason")) != "").groupBy(mode, "failure_reason").agg(
        F.count(F.lit(1)).alias("n"))


def best_mode(summary: DataFrame) -> DataFrame:
    """Winning mode by success rate, then quality, then speed."""
    return summary.orderBy(
        F.col("success_rate").desc(), F.col("avg_quality_success").desc(), F.col("pages_per_min").desc()).limit(1)


def settle_attempts(attempts: DataFrame) -> DataFrame:
    """One result per URL from its ordered attempts.

    The next mode is tried only after blocked, timeout or parse errors; the first attempt
    that ends otherwise, or the last one, stands.
    """
    ended = ~F.col("failure_reason").isin("blocked", "timeout", "parse_error") | F.col("failure_reason").isNull()
    last = attempts.groupBy("url").agg(F.min(F.when(ended, F.col("attempt"))).alias("_end"), F.max("attempt").alias("_max"))
    return attempts.join(last, "url").filter(F.col("attempt") == F.coalesce("_end", "_max")).drop("_end", "_max")


def flag_duplicates(df: DataFrame, text: str, pos: str) -> DataFrame:
    """Flag texts whose original checksum came earlier in ``pos`` order."""
    return seen_before(df.withColumn("_sum", F.sha2(F.col(text), 256)), ["_sum"], pos, "duplicate").drop("_sum")


SPACE_RUN = SPACE + "+"
