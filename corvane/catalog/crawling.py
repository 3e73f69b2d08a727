"""URL policy, scoring, grouping and trust over the page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog.registry import query, table
from corvane.functions import urls as U
from corvane.operators import approvals, crawl
from corvane.session import through_table

URI = U.URI.replace("'", "''")
NOW = "TIMESTAMP '2026-06-01 00:00:00'"
_Q = lambda p: p.replace("'", "''")
_ALT = lambda ps: "|".join(f"(?:{_Q(p)})" for p in ps)


def pages(spark, sf):
    return table(spark, sf, "pages", "page_id", "url")


PARTS = rf"""
u0 AS (SELECT page_id, url, lower(regexp_extract(url, '{URI}', 1)) AS scheme, regexp_extract(url, '{URI}', 2) AS netloc,
   regexp_replace(regexp_extract(url, '{URI}', 3), ';[^/]*$', '') AS path, regexp_extract(url, '{URI}', 4) AS ask FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(lower(netloc), '^.*@', ''), ':\d*$', '') AS host, lower(path) AS path_l,
   list_filter(string_split(path, '/'), lambda p: p <> '') AS segs,
   lower(netloc || chr(10) || path || CASE WHEN ask <> '' THEN '?' || ask ELSE '' END || chr(10)) AS hay FROM u0)"""


def year_sql(text: str) -> str:
    compact = U.COMPACT_DATE.replace("|$)", r"|\n?\z)")
    return (
        f"list_min(list_transform(list_concat(list_filter(regexp_extract_all({text}, '[0-9]+'), lambda d: length(d) = 4 AND starts_with(d, '20')), "
        f"regexp_extract_all({text}, '{compact}', 1)), lambda y: y::INT))"
    )


def archive_sql(p: str, year: str) -> str:
    old = f"({year} IS NULL OR {year} < 2025)"
    return (
        f"CASE WHEN regexp_matches({p}, '(?i){U.CRIME_LOG_MONTH}') AND {old} THEN 'historical monthly crime log' "
        f"WHEN regexp_matches({p}, '(?i){_ALT(U.DATED_ARCHIVE)}') AND {old} THEN 'dated archive page' "
        rf"WHEN regexp_matches({p}, '/20\d{{2}}-\d{{2}}-\d{{2}}-') AND {year} < 2025 THEN 'old dated article' "
        f"WHEN {year} < 2025 AND regexp_matches({p}, '{U.OLD_YEAR_PATH}') THEN 'old year-specific page' ELSE '' END"
    )


_HARD = " ".join(
    f"WHEN regexp_matches(hay, '(?im){_Q(p)}')" + (f" AND NOT regexp_matches(path_l, '{U.FACULTY_PROFILE}')" if r == "staff_faculty_bio" else "") + f" THEN '{r}'"
    for r, p in U.HARD_REJECT)
_CTX = " ".join(f"WHEN NOT allowed AND regexp_matches(hay, '(?im){p}') THEN '{r}'" for r, p in U.CONTEXT_REJECT)
_SOC = " OR ".join(f"bare = '{d}' OR ends_with(bare, '.{d}')" for d in U.SOCIAL_DOMAINS)
POLICY = f"""
{PARTS},
p0 AS (SELECT *, regexp_replace(host, '^www\\.', '') AS bare, regexp_matches(hay, '(?im){_ALT(U.ALLOW)}') AS allowed,
   {year_sql('hay')} AS yr, {year_sql('path_l')} AS pyr FROM u),
policy AS (SELECT page_id, url, path, segs, CASE WHEN trim(url) = '' THEN 'empty_url' WHEN scheme = 'mailto' THEN 'mailto_link' WHEN {_SOC} THEN 'social_or_external_profile'
   {_HARD} {_CTX}
   WHEN regexp_matches(hay, '(?im){_ALT(U.DATED_NEWS)}') AND (yr IS NULL OR yr < 2025) THEN 'old_dated_news_or_article'
   WHEN ({archive_sql('path_l', 'pyr')}) <> '' THEN 'dated_archive_page' WHEN yr < 2025 THEN 'old_year_specific_noncanonical_page'
   WHEN allowed THEN 'student_canonical_allowlist' ELSE 'student_candidate' END AS reason FROM p0)"""
_KEPT = "reason IN ('student_canonical_allowlist', 'student_candidate')"


@query("url_policy", f"""
WITH {POLICY} SELECT page_id, {_KEPT} AS selected, reason,
 CASE reason WHEN 'empty_url' THEN 'invalid' WHEN 'student_canonical_allowlist' THEN 'student_canonical' WHEN 'student_candidate' THEN 'student_candidate'
  WHEN 'old_dated_news_or_article' THEN 'stale' WHEN 'dated_archive_page' THEN 'stale' WHEN 'old_year_specific_noncanonical_page' THEN 'stale'
  ELSE 'non_student_or_noise' END AS category,
 CASE WHEN {_KEPT} THEN 'allow' ELSE 'hard_reject' END AS severity FROM policy""")
def q_policy(spark, sf):
    return crawl.with_policy(pages(spark, sf)).select("page_id", "selected", "reason", "category", "severity")


def _pool(spark, sf):
    rows = pages(spark, sf).withColumn(
        "excluded_reason", F.when(F.col("page_id") % 17 == 0, "operator_rejected_area"))
    return crawl.discovery_pool(rows, ["cheap-pills"])


POOL = f"""
{POLICY},
gk AS (SELECT *, CASE WHEN len(segs) = 0 THEN '/' WHEN lower(segs[1]) IN ({', '.join(f"'{r}'" for r in U.SCHOOL_ROOTS)}) OR len(segs) = 1 THEN '/' || segs[1]
   ELSE '/' || segs[1] || '/' || segs[2] END AS subpath FROM policy),
pool AS (SELECT *, CASE WHEN page_id % 17 = 0 THEN 'operator_rejected_area'
   WHEN contains(replace(lower(url || chr(10) || subpath), '-', ' '), 'cheap pills') THEN 'operator_exclude_term'
   WHEN NOT {_KEPT} THEN reason ELSE '' END AS pool_reason FROM gk)"""


@query("url_pool_totals", f"""
WITH {POOL} SELECT count(*) AS discovered_total, count(*) FILTER (pool_reason = '') AS eligible_total,
 count(*) FILTER (pool_reason <> '') AS rejected_total FROM pool""")
def q_pool(spark, sf):
    return crawl.pool_totals(_pool(spark, sf))


@query("url_reject_counts", f"""
WITH {POOL} SELECT pool_reason AS reason, count(*) AS n_urls FROM pool WHERE pool_reason <> '' GROUP BY 1""")
def q_rejects(spark, sf):
    return crawl.reject_counts(_pool(spark, sf))


@query("url_root_counts", f"""
WITH {POOL} SELECT coalesce(lower(segs[1]), '/') AS root, count(*) AS n_urls,
 count(*) FILTER (coalesce(lower(segs[1]), '/') IN ({', '.join(f"'{r}'" for r in (*U.SCHOOL_ROOTS, *crawl.STUDENT_ROOTS))})
   OR {' OR '.join(f"contains(lower(url), '{m}')" for m in crawl.STUDENT_MARKERS)}) AS school_or_student
 FROM pool WHERE pool_reason = '' GROUP BY 1""")
def q_roots(spark, sf):
    return crawl.analysis_counts(_pool(spark, sf))


@query("url_groups", f"""
WITH {POOL}, r AS (SELECT subpath, url, row_number() OVER (PARTITION BY subpath ORDER BY page_id) AS rn, count(*) OVER (PARTITION BY subpath) AS n FROM pool)
SELECT subpath, max(n) AS n_urls, string_agg(url, ' ' ORDER BY rn) FILTER (rn <= 3) AS examples FROM r GROUP BY subpath""")
def q_groups(spark, sf):
    g = crawl.url_groups(pages(spark, sf), "page_id")
    return g.withColumn("examples", F.array_join("examples", " "))


_S = lambda ps: f"regexp_matches(url, '(?i){_ALT(ps)}')"
SCORE = f"""
{PARTS},
s0 AS (SELECT *, {_S(U.NOISY)} AS noisy, {_S(U.VERY_LOW)} AS low, {_S(U.HIGH_VALUE)} AS high, {_S(U.VERY_HIGH)} AS topv, {_S(U.MEDIUM_VALUE)} AS mid,
   {year_sql('path_l')} AS pyr, page_id % 5 AS k, page_id % 900 AS age FROM u),
s1 AS (SELECT *, {archive_sql('path_l', 'pyr')} AS oldr, len(segs) AS depth,
   CASE WHEN k = 0 THEN NULL ELSE {NOW} - to_days(age::INT) END AS lm FROM s0),
s2 AS (SELECT *, CASE WHEN lm IS NULL OR k = 1 THEN 50
   WHEN year(lm) = 2026 THEN CASE WHEN age <= 30 THEN 95 WHEN age <= 90 THEN 90 WHEN age <= 180 THEN 85 ELSE 80 END
   WHEN year(lm) = 2025 THEN CASE WHEN age <= 180 THEN 75 ELSE 70 END WHEN year(lm) >= 2024 THEN 60 WHEN year(lm) >= 2022 THEN 45 ELSE 30 END AS fr FROM s1),
s3 AS (SELECT *, greatest(0, least(100, 50 - 20 * noisy::INT - 25 * low::INT + 25 * high::INT + 15 * topv::INT + 10 * mid::INT - 35 * (oldr <> '')::INT
      - 5 * (depth >= 5)::INT - 10 * (depth >= 7)::INT))::INT AS student_value,
   (CASE WHEN oldr <> '' THEN least(fr, 35) ELSE fr END)::INT AS freshness,
   CASE WHEN ends_with(url, '.edu') OR contains(url, '.edu/') THEN 85 ELSE 70 END AS source_quality,
   greatest(0, least(100, 70 - 30 * noisy::INT - 15 * low::INT + 15 * high::INT + 10 * topv::INT + 5 * mid::INT - 25 * (oldr <> '')::INT
      - 10 * (depth >= 5)::INT - 10 * (depth >= 7)::INT))::INT AS scrape_value FROM s2),
scored AS (SELECT page_id, url, student_value, freshness, source_quality, scrape_value,
   round_even(student_value * 0.40::DOUBLE + freshness * 0.25::DOUBLE + source_quality * 0.15::DOUBLE + scrape_value * 0.20::DOUBLE, 0)::INT AS score,
   concat_ws('; ', CASE WHEN high THEN 'high student-value content' WHEN mid THEN 'moderate student relevance' ELSE 'limited direct student value' END,
     CASE WHEN year(lm) = 2026 THEN 'current-year content' WHEN year(lm) = 2025 THEN 'previous-year content' WHEN year(lm) < 2024 THEN 'stale content' END,
     CASE WHEN noisy THEN 'noisy/technical page' END, CASE WHEN low THEN 'administrative/non-student focus' END, nullif(oldr, '')) AS reason FROM s3)"""


def _scored(spark, sf):
    # sitemap dates derived from the page number: none, without and with a zone
    now = F.lit("2026-06-01 00:00:00").cast("timestamp")
    day = F.date_format(now - F.make_dt_interval(days=(F.col("page_id") % 900).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("page_id") % 5
    rows = pages(spark, sf).withColumn(
        "lastmod", F.when(k == 0, None).when(k == 1, day).when(k == 2, F.concat(day, F.lit("+00:00"))).otherwise(F.concat(day, F.lit("Z"))))
    return crawl.with_score(rows, now)


@query("url_scores", f"WITH {SCORE} SELECT * EXCLUDE (url) FROM scored")
def q_scores(spark, sf):
    return _scored(spark, sf).select(
        "page_id", "student_value", "freshness", "source_quality", "scrape_value", "score", "reason")


@query("url_selected", f"WITH {SCORE} SELECT url, score AS priority, reason FROM scored WHERE score >= 70")
def q_selected(spark, sf):
    return crawl.select_scored(_scored(spark, sf))


@query("url_canonical", f"""
WITH {PARTS} SELECT page_id, scheme || '://' || lower(netloc) || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
  || CASE WHEN ask <> '' THEN '?' || ask ELSE '' END AS canonical, substring(sha1(url), 1, 12) AS slug FROM u""")
def q_canonical(spark, sf):
    return pages(spark, sf).select(
        "page_id", U.canonical(F.col("url")).alias("canonical"), U.url_digest(F.col("url")).alias("slug"))


@query("url_source_ids", f"""
WITH {PARTS} SELECT page_id, 'web_' || substring(sha1('web:' || scheme || '://' || lower(netloc) || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
  || CASE WHEN ask <> '' THEN '?' || ask ELSE '' END), 1, 16) AS source_id FROM u""")
def q_source_ids(spark, sf):
    from corvane.functions.text import stable_digest_id

    return pages(spark, sf).select(
        "page_id", stable_digest_id(F.lit("web"), U.canonical(F.col("url"))).alias("source_id"))


@query("url_category", f"""
WITH {PARTS}, d AS (SELECT *, list_filter(string_split(host, '.'), lambda p: p <> '') AS lab FROM u)
SELECT page_id, CASE WHEN regexp_matches(path_l, 'blog|news|article') THEN 'content' WHEN regexp_matches(path_l, 'docs|guide|kb') THEN 'docs'
  WHEN regexp_matches(path_l, 'product|pricing|features') THEN 'product' WHEN regexp_matches(path_l, 'about|team|careers') THEN 'company' ELSE 'other' END AS category,
  CASE WHEN len(lab) <= 2 THEN array_to_string(lab, '.') WHEN length(lab[-1]) = 2 AND lab[-2] IN ('co','ac','edu','gov','org','net','com') THEN array_to_string(lab[-3:], '.')
  ELSE array_to_string(lab[-2:], '.') END AS domain FROM d""")
def q_category(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select(
        "page_id", U.path_category(U.path(u)).alias("category"), U.registered_domain(U.host(u)).alias("domain"))


@query("trusted_domains", f"""
WITH {PARTS}, allow AS (SELECT DISTINCT regexp_replace(host, '^[^.]+\\.', '') AS domain FROM u WHERE contains(url, '/en/') AND starts_with(host, 'www.'))
SELECT page_id, CASE WHEN scheme <> 'https' THEN 'https_required' WHEN host = '' THEN 'missing_host'
  WHEN EXISTS (SELECT 1 FROM allow WHERE host = domain OR ends_with(host, '.' || domain)) THEN 'trusted_domain' ELSE 'untrusted_domain' END AS trust_reason FROM u""")
def q_trusted(spark, sf):
    p = pages(spark, sf)
    h = U.host(F.col("url"))
    allow = p.filter(F.col("url").contains("/en/") & h.startswith("www.")).select(
        F.regexp_replace(h, r"^[^.]+\.", "").alias("domain")).distinct()
    return crawl.trusted_domain(p, allow).select("page_id", "trust_reason")


# every page's host, and for three of four pages an address made from its number
_ADDRESS = """CASE page_id % 8 WHEN 0 THEN '10.' || (page_id % 256) || '.1.2' WHEN 1 THEN '8.8.' || (page_id % 200) || '.9' WHEN 2 THEN CAST(2130706433 + page_id AS {text})
  WHEN 3 THEN '0x7f00000' || (page_id % 10) WHEN 4 THEN '172.' || (page_id % 40) || '.0.1' WHEN 5 THEN '0' || (page_id % 8) || '.1.1.1' ELSE NULL END"""


@query("url_safety", f"""
WITH {PARTS}, a AS (SELECT page_id, scheme, host, {_ADDRESS.format(text='VARCHAR')} AS made FROM u),
o AS (SELECT *, list_transform(string_split(made, '.'), lambda x: try_cast(x AS BIGINT)) AS n FROM a)
SELECT page_id, CASE WHEN made IS NULL AND scheme <> 'https' THEN 'https_required' WHEN made IS NULL AND host = '' THEN 'missing_host'
  WHEN made IS NULL THEN CASE WHEN host = 'localhost' OR ends_with(host, '.local') THEN 'blocked_host' ELSE 'ok' END
  WHEN len(n) < 4 OR made LIKE '0%' THEN 'blocked_ip' WHEN n[1] IN (0, 10, 127) OR (n[1] = 172 AND n[2] BETWEEN 16 AND 31) THEN 'blocked_ip' ELSE 'ok' END AS safety FROM o""")
def q_safety(spark, sf):
    made = F.expr(_ADDRESS.format(text="STRING"))
    url = F.coalesce(F.concat(F.lit("https://"), made, F.lit("/a")), F.col("url"))
    return pages(spark, sf).select("page_id", crawl.url_safety(url).alias("safety"))


@query("links_in_pages", """
SELECT page_id, array_to_string(l, ' ') AS links FROM (
 SELECT page_id, list_transform(list_filter(list_zip(x, range(1, len(x) + 1)), lambda z: list_position(x, z[1]) = z[2]), lambda z: z[1]) AS l FROM (
  SELECT page_id, list_transform(regexp_extract_all(html, 'https?://[^\\s)\\]}>"'']+'), lambda u: rtrim(u, '.,;')) AS x FROM pages))""")
def q_links(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select(
        "page_id", F.array_join(U.links_in(F.col("html")), " ").alias("links"))


@query("message_intents", f"""
SELECT conv_id, turn, CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in crawl.ANALYZE_PHRASES)} THEN 'analyze'
  WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in crawl.REMOVE_WORDS)} THEN 'remove'
  WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in crawl.APPROVE_WORDS)} THEN 'approve' ELSE 'analyze' END AS intent FROM conversations""")
def q_intents(spark, sf):
    return table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", crawl.message_intent(F.col("text")).alias("intent"))


@query("manual_urls", f"""
WITH {POLICY}, d AS (SELECT p.*, u.path_l, u.netloc FROM policy p JOIN u USING (page_id)),
i AS (SELECT *, lower(netloc) = 'therti.example.org' OR array_to_string(string_split(lower(netloc), '.')[-2:], '.') = 'example.org' AS inside FROM d)
SELECT url, inside AND {_KEPT} AS selected, CASE WHEN NOT inside THEN 'off_domain' WHEN NOT {_KEPT} THEN reason END AS excluded_reason FROM i""")
def q_manual(spark, sf):
    rows = pages(spark, sf).select("url", F.col("page_id").alias("pos"))
    return crawl.manual_urls(rows, "therti.example.org").select("url", "selected", "excluded_reason")


@query("sitemap_discovery", f"""
WITH {POLICY} SELECT p.url, {_KEPT} AS selected, CASE WHEN NOT {_KEPT} THEN reason END AS excluded_reason
FROM policy p JOIN u USING (page_id) WHERE array_to_string(string_split(lower(netloc), '.')[-2:], '.') = 'example.org'""")
def q_sitemaps(spark, sf):
    # one sitemap per host, written from the addresses and parsed back
    u = F.col("url")
    escaped = F.replace(u, F.lit("&"), F.lit("&amp;"))
    # a sitemap holds a bounded number of entries, so each host gets as many as it needs
    shard = F.pmod(F.xxhash64("url"), F.lit(64))
    maps = pages(spark, sf).groupBy(U.host(u).alias("h"), shard.alias("s")).agg(
        F.concat(
            F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>"))), ""),
            F.lit("</urlset>"),
        ).alias("xml")
    ).select(F.concat_ws("-", "h", "s").alias("sitemap"), "xml")
    found = crawl.discovered_from_sitemaps(crawl.parse_sitemaps(maps), "www.example.org")
    return found.select("url", "selected", "excluded_reason")


# Sitemaps made of the pages: a leaf for about twenty of them, an index for four leaves, which also names
# the root again and one that is missing, and a root over three of four indexes.
TREE = f"""
WITH RECURSIVE {POLICY.strip()}, n AS (SELECT greatest(count(*) // 20, 1) AS leaves FROM pages),
leaf AS (SELECT url, page_id % leaves AS l FROM pages, n),
links AS (SELECT DISTINCT 'index-' || (l // 4) AS sitemap, 'leaf-' || l AS child FROM leaf
  UNION SELECT 'root', 'index-' || (l // 4) FROM leaf WHERE (l // 4) % 4 <> 3
  UNION SELECT 'index-' || (l // 4), 'root' FROM leaf UNION SELECT 'index-' || (l // 4), 'missing-' || (l // 4) FROM leaf),
walk AS (SELECT 'root' AS sitemap, 0 AS depth UNION SELECT child, depth + 1 FROM walk JOIN links USING (sitemap) WHERE depth < 6),
visited AS (SELECT sitemap, min(depth) AS depth FROM walk GROUP BY 1)"""


def sitemap_tree(spark, sf):
    """XML of the leaves, indexes and the root; a leaf holds about twenty addresses, however many there are."""
    rows = pages(spark, sf)
    leaves = max(rows.count() // 20, 1)
    placed = rows.select("url", F.pmod("page_id", F.lit(leaves)).alias("l"))
    head, space = '<?xml version="1.0"?>', "http://www.sitemaps.org/schemas/sitemap/0.9"

    def xml(root: str, entry: str, locs):
        body = F.array_join(F.transform(locs, lambda u: F.concat(F.lit(f"<{entry}><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{entry}>"))), "")
        return F.concat(F.lit(f'{head}<{root} xmlns="{space}">'), body, F.lit(f"</{root}>")).alias("xml")

    index = F.concat(F.lit("index-"), F.col("i"))
    leaf = placed.groupBy("l").agg(F.collect_list("url").alias("urls")).select(F.concat(F.lit("leaf-"), "l").alias("sitemap"), xml("urlset", "url", F.col("urls")))
    under = placed.select("l", F.expr("l div 4").alias("i")).distinct()
    members = under.groupBy("i").agg(F.collect_list(F.concat(F.lit("leaf-"), "l")).alias("leaves"))
    middle = members.select(index.alias("sitemap"), xml("sitemapindex", "sitemap", F.concat("leaves", F.array(F.lit("root"), F.concat(F.lit("missing-"), "i")))))
    # the root names indexes in parts of its own, so that it stays small
    named = members.filter("i % 4 <> 3").select(F.lit("root").alias("sitemap"), xml("sitemapindex", "sitemap", F.array(index)))
    return leaf.unionByName(middle).unionByName(named)


@query("sitemap_tree", TREE + f"""
SELECT p.url, 'leaf-' || l AS source_sitemap, depth, {_KEPT} AS selected, CASE WHEN NOT {_KEPT} THEN reason END AS excluded_reason
FROM policy p JOIN u USING (page_id) JOIN leaf ON leaf.url = p.url JOIN visited ON visited.sitemap = 'leaf-' || l
WHERE array_to_string(string_split(lower(netloc), '.')[-2:], '.') = 'example.org'""")
def q_sitemap_tree(spark, sf):
    """A nested sitemap index with cycles and missing members, walked from its root."""
    entries = through_table(crawl.parse_sitemaps(sitemap_tree(spark, sf)), "sitemap-entries")
    visited = crawl.visit_sitemaps(entries, entries.sparkSession.createDataFrame([("root",)], "sitemap string"))
    return crawl.discovered_by_visits(entries, visited, "www.example.org").select("url", "source_sitemap", "depth", "selected", "excluded_reason")


@query("sitemap_visits", TREE + """
SELECT sitemap, depth, NOT starts_with(sitemap, 'missing-') AS known FROM visited""")
def q_sitemap_visits(spark, sf):
    entries = crawl.parse_sitemaps(sitemap_tree(spark, sf))
    return crawl.visit_sitemaps(entries, spark.createDataFrame([("root",)], "sitemap string"))


# messages that name words, numbers, groups, schools, and addresses that are discovered or new
_ASKED = (
    "text", "text || ' choose 7 path:/de'", "'exclude ' || text", "'add https://new.example.org/courses/' || conv_id || ' and https://new.example.org/login, 3 pages'",
    "'approve cox and law'", "'approve 12 urls'", "'top 20 pages of example.net, avoid example'", "'please add fr/' || (conv_id % 900)")
_WORD_HIT = lambda words: "regexp_matches(low, '(^|[^\\p{L}\\p{N}_])(" + "|".join(words) + ")($|[^\\p{L}\\p{N}_])')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ALIAS_SQL = ", ".join(f"CASE WHEN {_WORD_HIT(dict.fromkeys((k, *v)))} THEN {_LIST(v)} ELSE [] END" for k, v in approvals.ALIASES.items())


@query("approval_candidates", f"""
WITH {POOL},
m AS (SELECT conv_id * 100 + turn AS msg_id, CASE conv_id % 8 {' '.join(f"WHEN {i} THEN {x}" for i, x in enumerate(_ASKED))} END AS message FROM conversations),
p AS (SELECT *, lower(regexp_replace(message, '(?is)(^|[^\\p{{L}}\\p{{N}}_])(exclude|reject|do not include|avoid|remove)($|[^\\p{{L}}\\p{{N}}_]).*', '')) AS low FROM m),
t AS (SELECT msg_id, message, list_distinct(flatten([{_ALIAS_SQL}, CASE WHEN {_WORD_HIT(("schools", "colleges"))} THEN {_LIST(approvals.ALL_SCHOOLS)} ELSE [] END,
   list_filter(regexp_extract_all(low, '[a-z0-9][a-z0-9-]{{3,}}'), lambda w: NOT list_contains({_LIST(approvals.TERM_STOP)}, w))])) AS terms FROM p),
a AS (SELECT *, len(list_intersect(list_transform(terms, lambda x: replace(replace(x, '-', ''), ' ', '')), {_LIST(crawl.SCHOOL_TERMS)})) > 0 AS schools,
   list_transform(regexp_extract_all(message, 'https?://[^\\s)\\]}}>"'']+'), lambda u: rtrim(u, '.,;')) AS urls, regexp_extract_all(message, '(?i)path:([^\\s,;]+)', 1) AS paths,
   least(coalesce(nullif(nullif(regexp_extract(message, '(?i)(?:top|first|best|up\\s+to)\\s+(\\d{{1,6}})', 1), '')::INT, 0), nullif(nullif(regexp_extract(message, '(?i)choose\\s+(\\d{{1,6}})', 1), '')::INT, 0),
     nullif(nullif(regexp_extract(message, '(?i)(\\d{{1,6}})\\s+(?:urls?|pages?|links?)', 1), '')::INT, 0), 50), 500) AS size FROM t),
ex AS (SELECT msg_id, 0 AS side, i::BIGINT AS pos, 'https://new.example.org/courses/' || ((msg_id // 100)) AS url, 'explicit_url' AS reason FROM a, range(1) x(i) WHERE len(urls) > 0 AND contains(message, 'new.example.org')),
hit AS (SELECT DISTINCT a.msg_id, gk.subpath FROM a, gk WHERE NOT schools AND list_any_value(list_filter(terms, lambda x: contains(lower(gk.url), x))) IS NOT NULL),
grp AS (SELECT * FROM hit UNION SELECT msg_id, '/' || trim(unnest(paths), '/') FROM a UNION SELECT msg_id, '/courses/' || (msg_id // 100) FROM ex
   UNION SELECT msg_id, '/login' FROM ex UNION SELECT msg_id, '/school' FROM a WHERE schools),
narrowed AS (SELECT DISTINCT msg_id FROM grp WHERE msg_id NOT IN (SELECT msg_id FROM a WHERE len(terms) = 0 AND NOT schools)),
ok AS (SELECT page_id AS pos, url, subpath FROM gk WHERE {_KEPT} AND page_id % 17 <> 0),
c AS (SELECT * FROM ex UNION ALL SELECT a.msg_id, 1, pos, ok.url, 'subpath:' || subpath FROM a, ok
   WHERE a.msg_id NOT IN (SELECT msg_id FROM narrowed) OR EXISTS (SELECT 1 FROM grp WHERE grp.msg_id = a.msg_id AND grp.subpath = ok.subpath)),
r AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY side, pos) AS place FROM c)
SELECT r.msg_id, place::INTEGER AS place, url, reason FROM r JOIN a USING (msg_id) WHERE side = 0 OR place <= size""")
def q_approvals(spark, sf):
    """Candidates of every message of the conversations among the pages' addresses."""
    c = F.col("conv_id")
    said = F.col("text")
    asked = (
        said, F.concat(said, F.lit(" choose 7 path:/de")), F.concat(F.lit("exclude "), said),
        F.concat(F.lit("add https://new.example.org/courses/"), c, F.lit(" and https://new.example.org/login, 3 pages")), F.lit("approve cox and law"),
        F.lit("approve 12 urls"), F.lit("top 20 pages of example.net, avoid example"), F.concat(F.lit("please add fr/"), c % 900))
    message = F.when(c % 8 == 0, asked[0])
    for i, text in enumerate(asked[1:], 1):
        message = message.when(c % 8 == i, text)
    messages = table(spark, sf, "conversations", "conv_id", "turn", "text").select((c * 100 + F.col("turn")).alias("msg_id"), message.alias("message"))
    rows = pages(spark, sf).select(
        F.col("page_id").alias("pos"), "url", F.lit("").alias("title"), F.lit(None).cast("string").alias("lastmod"),
        F.when(F.col("page_id") % 17 == 0, "operator_rejected_area").alias("excluded_reason"))
    return approvals.approval_candidates(messages, rows)
