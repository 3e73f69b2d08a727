"""URL selection: policy, scoring, groups, discovery and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import urls as U
from corvane.functions.text import contains_any, matches_any, text_or_empty
from corvane.operators.relational import first_per_key, latest_per_key, top_k
from corvane.session import through_table

THRESHOLD = 70


def with_policy(
    df: DataFrame, url: str = "url", title: str | None = None, target_year: int = U.TARGET_YEAR
) -> DataFrame:
    """Add ``selected, reason, category, severity`` of the crawl policy.

    Rules apply in order: empty, mail and social links, hard rejects (academic faculty
    profiles are spared the biography rule), contextual rejects unless allow-listed, old
    dated news, dated archives, old years, then allow.
    """
    u = text_or_empty(F.col(url))
    staged = (
        df.withColumn("_u", u)
        .withColumn("_h", U.policy_haystack(F.col("_u"), text_or_empty(F.col(title)) if title else F.lit("")))
        .withColumn("_p", F.lower(U.path(F.col("_u"))))
        .withColumn("_allowed", matches_any(F.col("_h"), U.ALLOW))
        .withColumn("_year", U.oldest_year(F.col("_h")))
        .withColumn("_social", U.social_or_mail(F.col("_u")))
        .withColumn("_archive", U.dated_archive_reason(F.col("_p"), U.oldest_year(F.col("_p")), target_year))
    )
    h = F.col("_h")
    chain = F.when(F.trim("_u") == "", "empty_url").when(F.col("_social") != "", F.col("_social"))
    for reason, pattern in U.HARD_REJECT:
        test = h.rlike("(?dim)" + pattern)
        if reason == "staff_faculty_bio":
            test = test & ~F.col("_p").rlike("(?d)" + U.FACULTY_PROFILE)
        chain = chain.when(test, reason)
    for reason, pattern in U.CONTEXT_REJECT:
        chain = chain.when(~F.col("_allowed") & h.rlike("(?dim)" + pattern), reason)
    old = F.col("_year") < target_year - 1
    reason = (
        chain.when(matches_any(h, U.DATED_NEWS) & (F.col("_year").isNull() | old), "old_dated_news_or_article")
        .when(F.col("_archive") != "", "dated_archive_page")
        .when(old, "old_year_specific_noncanonical_page")
        .when(F.col("_allowed"), "student_canonical_allowlist")
        .otherwise("student_candidate")
    )
    kept = F.col("reason").isin("student_canonical_allowlist", "student_candidate")
    stale = F.col("reason").isin(
        "old_dated_news_or_article", "dated_archive_page", "old_year_specific_noncanonical_page")
    category = (
        F.when(F.col("reason") == "empty_url", "invalid")
        .when(F.col("reason") == "student_canonical_allowlist", "student_canonical")
        .when(F.col("reason") == "student_candidate", "student_candidate")
        .when(stale, "stale").otherwise("non_student_or_noise")
    )
    return (
        staged.withColumn("reason", reason).withColumn("selected", kept).withColumn("category", category)
        .withColumn("severity", F.when(F.col("selected"), "allow").otherwise("hard_reject"))
        .drop("_u", "_h", "_p", "_allowed", "_year", "_social", "_archive")
    )


def apply_policy(discovered: DataFrame) -> DataFrame:
    """Set ``selected`` and ``excluded_reason``; an operator's rejection stands."""
    decided = with_policy(discovered.drop("selected"), title="title" if "title" in discovered.columns else None)
    operator = F.coalesce(F.col("excluded_reason") == "operator_rejected_area", F.lit(False))
    return (
        decided.withColumn(
            "excluded_reason",
            F.when(operator, F.col("excluded_reason")).when(~F.col("selected"), F.col("reason")),
        )
        .withColumn("selected", F.col("selected") & ~operator)
        .drop("reason", "category", "severity")
    )


def urls_to_scrape(discovered: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """URLs of the next scrape: the approved ones if there are any, else the selected.

    Approved URLs nobody discovered are kept as rows of their own. Only http(s) URLs
    that the policy accepts remain.
    """
    if approved is None:
        rows = discovered
    else:
        known = discovered.withColumn("_known", F.lit(True))
        rows = approved.select("url").distinct().join(known, "url", "left").withColumns({
            "source_sitemap": F.when(F.col("_known"), F.col("source_sitemap")).otherwise("approved"),
            "path_category": F.when(F.col("_known"), F.col("path_category")).otherwise("other"),
            "selected": F.coalesce("selected", F.lit(True)),
        }).drop("_known")
    keep = rows.filter(
        F.col("selected") & F.coalesce(F.col("excluded_reason") == "", F.col("excluded_reason").isNull())
        & U.scheme(F.trim("url")).isin("http", "https") & (U.netloc(F.trim("url")) != "")
    )
    decided = with_policy(keep.withColumnRenamed("selected", "_sel"))
    return decided.filter("selected").drop("_sel", "reason", "category", "severity")


def with_score(
    df: DataFrame, now: Column, url: str = "url", lastmod: str = "lastmod", target_year: int = U.TARGET_YEAR
) -> DataFrame:
    """Add ``score``, its four parts and the reason text. ``now`` is given, not read."""
    u = F.col("_u")
    hit = lambda patterns: matches_any(u, patterns, "(?id)")
    lm = F.col(lastmod) if lastmod in df.columns else F.lit(None).cast("string")
    staged = (
        df.withColumn("_u", text_or_empty(F.col(url)))
        .withColumn("_lm", lm)
        .withColumn("_p", F.lower(U.path(u)))
        .withColumn("_noisy", hit(U.NOISY)).withColumn("_low", hit(U.VERY_LOW))
        .withColumn("_high", hit(U.HIGH_VALUE)).withColumn("_top", hit(U.VERY_HIGH))
        .withColumn("_mid", hit(U.MEDIUM_VALUE))
        .withColumn("_old", U.dated_archive_reason(F.col("_p"), U.oldest_year(F.col("_p")), target_year))
        .withColumn("_depth", F.size(U.path_parts(F.col("_p"))))
        .withColumn("_fresh", U.freshness(F.col("_lm"), now, target_year))
    )
    add = lambda test, points: F.when(test, points).otherwise(0)
    old = F.col("_old") != ""
    value = (
        F.lit(50) + add(F.col("_noisy"), -20) + add(F.col("_low"), -25) + add(F.col("_high"), 25)
        + add(F.col("_top"), 15) + add(F.col("_mid"), 10) + add(old, -35)
        + add(F.col("_depth") >= 5, -5) + add(F.col("_depth") >= 7, -10)
    )
    scrape = (
        F.lit(70) + add(F.col("_noisy"), -30) + add(F.col("_low"), -15) + add(F.col("_high"), 15)
        + add(F.col("_top"), 10) + add(F.col("_mid"), 5) + add(old, -25)
        + add(F.col("_depth") >= 5, -10) + add(F.col("_depth") >= 7, -10)
    )
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    year = F.when(U.parse_lastmod(F.col("_lm")).isNotNull(), F.substring("_lm", 1, 4).try_cast("int"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_high"), "high student-value content").when(F.col("_mid"), "moderate student relevance")
        .otherwise("limited direct student value"),
        F.when(year == target_year, "current-year content").when(year == target_year - 1, "previous-year content")
        .when(year < target_year - 2, "stale content"),
        F.when(F.col("_noisy"), F.lit("noisy/technical page")),
        F.when(F.col("_low"), F.lit("administrative/non-student focus")),
        F.when(old, F.col("_old")),
    ))
    scored = (
        staged.withColumn("student_value", clamp(value))
        .withColumn("freshness", clamp(F.when(old, F.least(F.col("_fresh"), F.lit(35))).otherwise(F.col("_fresh"))))
        .withColumn("source_quality", F.when(u.endswith(".edu") | u.contains(".edu/"), 85).otherwise(70))
        .withColumn("scrape_value", clamp(scrape))
        .withColumn("reason", F.array_join(reasons, "; "))
    )
    total = (
        F.col("student_value") * F.lit(0.40) + F.col("freshness") * F.lit(0.25)
        + F.col("source_quality") * F.lit(0.15) + F.col("scrape_value") * F.lit(0.20)
    )
    return scored.withColumn("score", clamp(F.bround(total).cast("int"))).drop(
        "_u", "_lm", "_p", "_noisy", "_low", "_high", "_top", "_mid", "_old", "_depth", "_fresh")


def select_scored(scored: DataFrame, threshold: int = THRESHOLD, url: str = "url") -> DataFrame:
    return scored.filter(F.col("score") >= threshold).select(url, F.col("score").alias("priority"), "reason")


def url_groups(urls: DataFrame, order: str, examples: int = 3) -> DataFrame:
    """Count and first ``examples`` URLs of each group, first by the column ``order``."""
    keyed = urls.select("url", order, U.group_key(F.col("url")).alias("subpath"))
    counts = keyed.groupBy("subpath").agg(F.count(F.lit(1)).alias("n_urls"))
    first = top_k(keyed, ["subpath"], [F.col(order)], examples, "_r")
    shown = first.groupBy("subpath").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "url"))), lambda s: s["url"]).alias("examples")
    )
    return counts.join(shown, "subpath")


def discovery_pool(discovered: DataFrame, exclude_terms: list[str] | None = None) -> DataFrame:
    """Every discovered URL with why it is out of the pool (``''`` when eligible).

    An operator's rejection comes first, then the exclude terms, then the policy.
    """
    decided = with_policy(discovered.drop("selected"), title="title" if "title" in discovered.columns else None)
    operator = F.coalesce(F.col("excluded_reason") == "operator_rejected_area", F.lit(False))
    term = term_matches(F.col("url"), exclude_terms or [])
    out = (
        F.when(operator, "operator_rejected_area").when(term, "operator_exclude_term")
        .when(~F.col("selected"), F.col("reason")).otherwise("")
    )
    return decided.withColumn("pool_reason", out).drop("reason", "category", "severity", "selected")


def reject_counts(pool: DataFrame) -> DataFrame:
    return pool.filter("pool_reason <> ''").groupBy(F.col("pool_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n_urls"))


def pool_totals(pool: DataFrame) -> DataFrame:
    return pool.agg(
        F.count(F.lit(1)).alias("discovered_total"),
        F.count_if(F.col("pool_reason") == "").alias("eligible_total"),
        F.count_if(F.col("pool_reason") != "").alias("rejected_total"),
    )


# ------------------------------------------------------------- operator messages
# Words an operator may use for a school.
SCHOOL_TERMS = {
    "cox": "cox", "dedman": "dedman", "deadman": "dedman", "dedmanlaw": "dedmanlaw", "law": "dedmanlaw",
    "lyle": "lyle", "meadows": "meadows", "simmons": "simmons", "perkins": "perkins",
}
LAW_TERMS = {"dedmanlaw", "law"}
STUDENT_ROOTS = (
    "admission", "enrollment-services", "studentaffairs", "student-life", "libraries", "bursar",
    "financialaid", "student-financial-services", "housing", "dining",
)
STUDENT_MARKERS = (
    "/registrar", "/academic-calendar", "/tuition", "/financial-aid", "/scholarship", "/housing",
    "/dining", "/health", "/accessibility", "/orientation",
)


def school_roots(terms: list[str]) -> set[str]:
    """School roots named by an operator's terms; both law roots go together."""
    plain = {t.strip().lower().replace("-", "").replace(" ", "") for t in terms}
    roots = {SCHOOL_TERMS[t] for t in plain if t in SCHOOL_TERMS}
    if plain & LAW_TERMS:
        roots |= LAW_TERMS
        if "schools" not in plain:
            roots.discard("dedman")
    return roots


def term_matches(url: Column, terms: list[str]) -> Column:
    """Whether a URL or its group matches any term; school names match roots only."""
    roots = school_roots(terms)
    if roots:
        return U.first_segment_root(url).isin(*sorted(roots))
    needles = [
        t.strip().lower().replace("/", " ").replace("-", " ") for t in terms
        if t.strip() and t.strip().lower() not in SCHOOL_TERMS
    ]
    if not needles:
        return F.lit(False)
    hay = F.replace(F.lower(F.concat_ws("\n", url, U.group_key(url))), F.lit("-"), F.lit(" "))
    dashed = F.replace(hay, F.lit(" "), F.lit("-"))
    return contains_any(hay, needles) | contains_any(dashed, [n.replace(" ", "-") for n in needles])


def analysis_counts(pool: DataFrame) -> DataFrame:
    """Per first path segment: eligible URLs and how many are school or student pages."""
    eligible = pool.filter("pool_reason = ''").withColumn(
        "root", F.coalesce(F.lower(F.get(U.path_parts(F.col("url")), F.lit(0))), F.lit("/")))
    title = F.col("title") if "title" in pool.columns else F.lit("")
    hay = F.lower(F.concat_ws("\n", "url", title))
    wanted = F.col("root").isin(*U.SCHOOL_ROOTS, *STUDENT_ROOTS) | contains_any(hay, STUDENT_MARKERS)
    return eligible.groupBy("root").agg(
        F.count(F.lit(1)).alias("n_urls"), F.count_if(wanted).alias("school_or_student"))


def message_urls(message: Column) -> Column:
    return U.links_in(message)


def message_subpaths(message: Column) -> Column:
    """Distinct ``path:`` arguments with one leading slash."""
    raw = F.regexp_extract_all(message, F.lit(r"(?i)\bpath:([^\s,;]+)"), F.lit(1))
    return F.array_distinct(F.transform(
        raw, lambda p: F.when(p == "/", p).otherwise(F.concat(F.lit("/"), F.btrim(p, F.lit("/"))))))


# Words that carry no meaning in operator messages.
REMOVAL_STOP = (
    "remove", "delete", "exclude", "filter", "demove", "noise", "noisy", "bad", "reject", "rejected",
    "approved", "approve", "source", "sources", "url", "urls", "page", "pages", "anything", "with", "from",
    "file", "scrape", "please",
)
ANALYSIS_STOP = (
    "how", "many", "count", "counts", "summary", "summarize", "show", "list", "top", "breakdown", "why",
    "explain", "could", "eligible", "available", "selected", "urls", "url", "select", "selected", "have",
    "we", "the", "for", "from", "and", "group", "groups",
)
ANALYZE_PHRASES = (
    "how many", "how ", "what ", "why ", "explain", "show top", "summarize", "summary", "breakdown",
    "could we select",
)
REMOVE_WORDS = ("remove", "delete", "exclude", "filter", "drop", "demote")
APPROVE_WORDS = ("approve", "add", "include", "select", "choose", "scrape")


def message_words(message: Column, stop: tuple[str, ...]) -> Column:
    words = F.regexp_extract_all(F.lower(message), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop)))


def message_intent(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(contains_any(low, ANALYZE_PHRASES), "analyze").when(contains_any(low, REMOVE_WORDS), "remove")
        .when(contains_any(low, APPROVE_WORDS), "approve").otherwise("analyze")
    )


def select_limit(message: Column) -> Column:
    """Number in "top 20", "choose 20" or "20 urls"; NULL when none is named."""
    patterns = (
        r"(?i)\b(?:top|first|best|up\s+to)\s+(\d{1,6})\b", r"(?i)\bchoose\s+(\d{1,6})\b",
        r"(?i)\b(\d{1,6})\s+(?:urls?|pages?|links?)\b",
    )
    return F.coalesce(*[
        F.nullif(F.nullif(F.regexp_extract(message, p, 1), F.lit("")).try_cast("int"), F.lit(0)) for p in patterns])


def manual_urls(urls: DataFrame, site_host: str, url: str = "url", pos: str = "pos") -> DataFrame:
    """Operator URLs as discovered rows: relative ones resolved, off-domain marked.

    Of equal URLs the last one stays. Relative references are taken from the root.
    """
    raw = F.trim(F.col(url))
    absolute = raw.startswith("http://") | raw.startswith("https://")
    resolved = F.when(absolute, raw).otherwise(
        F.concat(F.lit(f"https://{site_host}/"), F.ltrim(raw, F.lit("/"))))
    rows = urls.filter(raw != "").select(pos, resolved.alias("url"))
    rows = latest_per_key(rows, ["url"], pos)
    decided = with_policy(rows)
    inside = U.same_domain(F.col("url"), F.lit(site_host))
    return decided.select(
        "url", F.lit("manual").alias("source_sitemap"), U.path_category(U.path(F.col("url"))).alias("path_category"),
        (inside & F.col("selected")).alias("selected"),
        F.when(~inside, "off_domain").when(~F.col("selected"), F.col("reason")).alias("excluded_reason"),
    )


def trusted_domain(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Add ``trust_reason``: is the host one of ``domains(domain)`` or below one.

    The host's own suffixes are matched by equality, so no pair of host and domain
    is compared. Rows are judged per distinct host.
    """
    c = U.canonical(F.col(url))
    staged = df.withColumn("_host", U.host(c)).withColumn("_scheme", U.scheme(c))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = staged.select("_host").distinct().filter("_host <> ''")
    trusted = (
        hosts.select("_host", F.explode(suffixes).alias("domain"))
        .join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi")
        .select("_host").distinct().withColumn("_ok", F.lit(True))
    )
    empty = domains.isEmpty()
    reason = (
        F.when(F.col("_scheme") != "https", "https_required").when(F.col("_host") == "", "missing_host")
        .when(F.lit(empty), "trusted_domain_policy_empty").when(F.col("_ok"), "trusted_domain")
        .otherwise("untrusted_domain")
    )
    return staged.join(trusted, "_host", "left").withColumn("trust_reason", reason).drop("_host", "_scheme", "_ok")


def url_safety(url: Column) -> Column:
    """Safety of a URL by scheme and host; only literal addresses are judged.

    Names are not resolved: a look-up inside a task would be neither repeatable nor
    bounded, so callers resolve at fetch time.
    """
    c = U.canonical(url)
    h = U.host(c)
    quad = h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
    private = h.rlike(
        r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^198\.1[89]\."
        r"|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|23\d|24\d|25[0-5])\."
    )
    # a number, hexadecimal, octal or short form is an address in disguise
    odd = h.rlike(r"(?i)^(?:0x[0-9a-f]*|\d+)(?:\.(?:0x[0-9a-f]*|\d+)){0,3}\.?$") & (~quad | h.rlike(r"(?:^|\.)0\d"))
    v6 = h.contains(":") & h.rlike(r"(?i)^(?:::1?$|f[cd]|fe[89ab]|ff|2001:db8)|^::ffff:")
    return (
        F.when(U.scheme(c) != "https", "https_required").when(h == "", "missing_host")
        .when((h == "localhost") | h.endswith(".local"), "blocked_host")
        .when((quad & private) | odd | v6, "blocked_ip").otherwise("ok")
    )


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``(sitemap, kind, loc, lastmod)`` of each entry in sitemap XML text.

    ``kind`` is ``url`` or ``child``. Tags may carry a name-space prefix. Input
    ``(sitemap, xml)``.
    """
    entry = lambda tag: F.regexp_extract_all(
        F.col("xml"), F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), F.lit(1))
    unescape = lambda c: F.replace(F.replace(F.replace(F.replace(
        c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    field = lambda e, tag: F.trim(unescape(F.regexp_extract(
        e, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>\s*(.*?)\s*</(?:\w+:)?{tag}>", 1)))
    root = F.regexp_extract("xml", r"(?s)<(?:\w+:)?(urlset|sitemapindex)[\s>]", 1)
    tagged = sitemaps.withColumn("_root", root)
    entries = F.when(F.col("_root") == "urlset", entry("url")).when(F.col("_root") == "sitemapindex", entry("sitemap"))
    rows = tagged.select(
        "sitemap", F.when(F.col("_root") == "urlset", "url").otherwise("child").alias("kind"),
        F.posexplode(entries).alias("pos", "_e"))
    return rows.select(
        "sitemap", "kind", "pos", field(F.col("_e"), "loc").alias("loc"),
        F.nullif(field(F.col("_e"), "lastmod"), F.lit("")).alias("lastmod"),
    ).filter("loc <> ''")


# Where a sitemap is looked for when robots.txt names none.
COMMON_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap-index.xml")


def sitemap_seeds(sites: DataFrame) -> DataFrame:
    """``(site_url, sitemap)`` to begin with: the ``Sitemap:`` lines of ``robots``, else the common places.

    ``sites (site_url, robots)``; ``robots`` is null where there is no such file.
    """
    named = F.filter(
        F.transform(F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^sitemap:([^\r\n]*)"), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")
    common = F.array(*[F.concat(U.scheme(F.col("site_url")), F.lit("://"), U.netloc(F.col("site_url")), F.lit(p)) for p in COMMON_SITEMAPS])
    return sites.select("site_url", F.explode(F.when(F.size(named) > 0, named).otherwise(common)).alias("sitemap")).distinct()


def visit_sitemaps(entries: DataFrame, seeds: DataFrame, rounds: int = 50) -> DataFrame:
    """``(sitemap, depth, known)`` of every sitemap met from ``seeds (sitemap)`` on.

    ``entries`` are those of ``parse_sitemaps``; a sitemap among them is ``known``, others are named
    but were not fetched. Each round follows the children of the last one's sitemaps that no round
    has visited, so cycles end; the chain of indexes may be ``rounds`` long, a longer one raises.
    """
    links = through_table(entries.filter("kind = 'child'").select("sitemap", F.col("loc").alias("child")).distinct(), "sitemap-links")
    frontier = through_table(seeds.select("sitemap", F.lit(0).alias("depth")).distinct(), "sitemap-round")
    visited = frontier
    for depth in range(1, rounds + 1):
        children = frontier.join(links, "sitemap").select(F.col("child").alias("sitemap"), F.lit(depth).alias("depth")).distinct()
        frontier = through_table(children.join(visited, "sitemap", "left_anti"), "sitemap-round")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    else:
        raise RuntimeError(f"sitemap indexes are nested more than {rounds} deep")
    there = entries.select("sitemap").distinct().withColumn("known", F.lit(True))
    return visited.join(there, "sitemap", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def discovered_by_visits(entries: DataFrame, visited: DataFrame, site_host: str) -> DataFrame:
    """In-domain URLs of the visited sitemaps as discovered rows with ``depth``; the first mention counts.

    Sitemaps nearer to the seeds come first, those of a depth by name.
    """
    met = entries.filter("kind = 'url'").join(visited.filter("known").select("sitemap", "depth"), "sitemap")
    inside = met.filter(U.same_domain(F.col("loc"), F.lit(site_host)))
    first = first_per_key(inside, ["loc"], [F.col("depth"), F.col("sitemap"), F.col("pos")])
    return apply_policy(first.select(
        F.col("loc").alias("url"), F.col("sitemap").alias("source_sitemap"), "depth", "lastmod",
        U.path_category(U.path(F.col("loc"))).alias("path_category"), F.lit("html").alias("content_type_guess"),
        F.lit(None).cast("string").alias("excluded_reason"), F.lit(True).alias("selected"),
    ))


def discovered_from_sitemaps(entries: DataFrame, site_host: str) -> DataFrame:
    """In-domain sitemap URLs as discovered rows, first mention kept, policy applied."""
    inside = entries.filter((F.col("kind") == "url") & U.same_domain(F.col("loc"), F.lit(site_host)))
    first = first_per_key(inside, ["loc"], [F.col("sitemap"), F.col("pos")])
    return apply_policy(first.select(
        F.col("loc").alias("url"), F.col("sitemap").alias("source_sitemap"), "lastmod",
        U.path_category(U.path(F.col("loc"))).alias("path_category"), F.lit("html").alias("content_type_guess"),
        F.lit(None).cast("string").alias("excluded_reason"), F.lit(True).alias("selected"),
    ))
