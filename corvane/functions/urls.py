"""URL parts, the crawl policy, scoring and grouping as column expressions.

URLs are split with the generic URI pattern instead of a strict parser, so a
malformed address yields parts rather than NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import contains_any, matches_any, strip

URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, URI, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, URI, 2)


def path(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(u, URI, 3), ";[^/]*$", "")


def query(u: Column) -> Column:
    return F.regexp_extract(u, URI, 4)


def host(u: Column) -> Column:
    """Host name without user info and port, lower case."""
    bare = F.regexp_replace(F.lower(netloc(u)), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"^\[|\]$", "")


def path_parts(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda p: p != "")


def canonical(u: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no fragment; query kept."""
    raw = strip(u)
    tail = F.rtrim(path(raw), F.lit("/"))
    tail = F.when(F.length(tail) == 0, "/").otherwise(tail)
    ask = F.when(query(raw) != "", F.concat(F.lit("?"), query(raw))).otherwise("")
    full = F.concat(scheme(raw), F.lit("://"), F.lower(netloc(raw)), tail, ask)
    return F.when((scheme(raw) != "") & (netloc(raw) != ""), full).otherwise(raw)


def url_digest(u: Column) -> Column:
    return F.substring(F.sha1(u), 1, 12)


def registered_domain(host_col: Column) -> Column:
    """Last two labels, or three below a two-letter suffix such as ``ac.uk``."""
    labels = F.filter(F.split(F.lower(host_col), r"\."), lambda p: p != "")
    n = F.size(labels)
    deep = (
        (n >= 3)
        & (F.length(F.get(labels, n - 1)) == 2)
        & F.get(labels, n - 2).isin("co", "ac", "edu", "gov", "org", "net", "com")
    )
    keep = F.when(deep, 3).otherwise(2)
    return F.array_join(F.when(n <= 2, labels).otherwise(F.slice(labels, n - keep + 1, keep)), ".")


def same_domain(u: Column, root_host: Column) -> Column:
    own = F.lower(netloc(u))
    return (own == F.lower(root_host)) | (registered_domain(own) == registered_domain(root_host))


# Ordered path classes.
PATH_CATEGORIES = (
    ("content", ("blog", "news", "article")),
    ("docs", ("docs", "guide", "kb")),
    ("product", ("product", "pricing", "features")),
    ("company", ("about", "team", "careers")),
)


def path_category(path_col: Column) -> Column:
    hay = F.lower(path_col)
    chain = None
    for label, needles in PATH_CATEGORIES:
        test = contains_any(hay, needles)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise("other")


# ---------------------------------------------------------------- crawl policy
# The rule patterns of the student-content crawl policy. They are
# data; order matters for the rejecting rules.
TARGET_YEAR = 2026

ALLOW = (
    "/admission", "/enrollment-services", "/registrar", "/academic-calendar", "/final-exam",
    "/course-catalog", "/catalog", "/financial-aid", "/financialaid", "/student-financial-services",
    "/bursar", "/tuition", "/scholarship", "/housing", "/dining", "/student-life", "/studentlife",
    "/health", "/counseling", "/accessibility", "/disability", "/parking", "/orientation", "/apply",
    "/academics", "/degree", "/program", "/major", "/minor",
)

HARD_REJECT = (
    ("class_or_alumni_notes", r"class[-_\s]?notes|alumni[-_\s]?notes"),
    ("auth_or_account", r"/login|/signin|/sso|/auth|/password|/account|/dashboard"),
    ("search_or_listing_noise", r"/search(?:[/?]|$)|/tag/|/tags/|/category/|/filter|/sort|/topics?/|/listing(?:/|$)|[?&](?:s|q|query|search|filter|sort|order|page|p|offset|start|utm_[^=&]+|fbclid|gclid|gbraid|wbraid|mc_cid|mc_eid)="),
    ("calendar_listing_noise", r"/calendar/(?:list|feed|archive|index)|/events/(?:list|category|archive)|/event-calendar(?:/|$)"),
    ("technical_or_generated_noise", r"/feed|/rss|/atom|/xmlrpc|/api/|/ajax|/json|/embed|/print|/download|/export|/wp-content/|/assets/(?:css|js|images?)/"),
    ("draft_test_or_template", r"/staging|/test|/demo|/draft|/brand(?:/|\n|$)|design-components|content-block|slide-show|carousel|brand-web-guidelines|/template(?:/|$)|/component(?:s)?(?:/|$)"),
    ("donor_advancement_or_alumni", r"/donor(?:/|$)|/giving(?:/|$)|/(?:gift|gifts|gift-planning|ways-to-give)(?:/|$)|/advancement(?:/|$)|annual[-_]?report|/annual-report|/campaign(?:/|$)|/fundraising|/development(?:/|$|/(?:about|advancement|campaign|donor|fundraising|gift|giving|office|staff|support|ways-to-give)(?:/|$))"),
    ("alumni_stories_or_events", r"/alumni/(?:stories|events|news|magazine|spotlight)|/alumni-spotlight|/reunion(?:/|$)"),
    ("hr_or_employee", r"/human-resources(?:/|$)|/hr(?:/|$)|/employment(?:/|$)|/(?:employee|employees|faculty-staff)/benefits(?:/|$)|/faculty-staff(?:/|$)|/staff-association|/employee-(?:resources|benefits)|/workday(?:/|$)"),
    ("governance_or_admin", r"/aboutsmu/administration|/office-of-the-president(?:/|$)|/presidents?-office(?:/|$)|/president(?:/|$)|/trustee|/trustees|/board(?:/|$)|/provost|/vice-president|/chancellor|/cabinet(?:/|$)|/governance(?:/|$)"),
    ("generic_news_archive", r"/news/(?:articles/)?archive(?:/|$)"),
    ("staff_faculty_bio", r"(?:^|\n)(?:/[^\n]+)?/(?:faculty|staff)/(?:directory|profiles?|bio(?:graphy)?)(?:/|$)|/(?:faculty|staff)/[a-z0-9]+(?:-[a-z0-9]+)+/?(?:\?|$)|/people/[^/\n]+/?$|/profile/[^/\n]+/?$"),
    ("media_or_asset_noise", r"\.(?:jpe?g|png|gif|svg|webp|zip|mp4|mov)(?:\?|$)|/media/(?:files|assets)(?:/|$)"),
)

CONTEXT_REJECT = (("general_alumni_section", r"/alumni(?:/|$)"),)

DATED_NEWS = (
    r"/(news|stories|story|press-releases?|media|blog|magazine|coxtoday-magazine)/20\d{2}[-/]\d{2}[-/]\d{2}",
    r"/20\d{2}-\d{2}-\d{2}-",
    r"/20\d{2}/\d{2}/\d{2}/",
)

DATED_ARCHIVE = (
    r"/latest-at-lyle/\d{4}-\d{2}/",
    r"/stories/.+20\d{2}",
    r"/press-releases/20\d{6}",
    r"/professors-institute(?:/professors-institute)?-20\d{2}",
    r"/20\d{2}-virtual-graduation",
    r"/symposia-and-workshops/20\d{2}",
    r"/20\d{2}-ntcc-scholars",
    r"/20\d{2}-20\d{2}-faculty-publications",
    r"/20\d{2}-20\d{2}-passport-directory",
    r"/coursedescriptions/(fall|spring)-20\d{2}",
    r"/course-schedule/(fall|spring)-20\d{2}",
    r"alternategrade.*20\d{2}",
)

MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)
CRIME_LOG_MONTH = rf"/crime-log/.*/20\d{{2}}/({'|'.join(MONTHS)})$"
OLD_YEAR_PATH = r"/(tuition|factsheets|directory|schedule|spring|fall)[-_]?"
FACULTY_PROFILE = r"/academics/(?:departments/[^/]+|programs/.+)/faculty/profiles?/"
COMPACT_DATE = r"(?:^|/)(20\d{2})(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[-_/]|$)"

SOCIAL_DOMAINS = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com",
)


def oldest_year(text: Column) -> Column:
    """Smallest free-standing 20xx year or compact date year; NULL when none.

    A maximal run of exactly four digits is the same test as digit look-arounds.
    """
    plain = F.filter(
        F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)),
        lambda d: (F.length(d) == 4) & d.startswith("20"),
    )
    compact = F.regexp_extract_all(text, F.lit(COMPACT_DATE), F.lit(1))
    return F.array_min(F.transform(F.concat(plain, compact), lambda y: y.cast("int")))


def social_or_mail(u: Column) -> Column:
    """Reason for mail links and social profiles, else the empty string."""
    bare = F.regexp_replace(host(u), r"^www\.", "")
    social = F.lit(False)
    for domain in SOCIAL_DOMAINS:
        social = social | (bare == domain) | bare.endswith("." + domain)
    return (
        F.when(scheme(u) == "mailto", "mailto_link")
        .when(social, "social_or_external_profile")
        .otherwise("")
    )


def policy_haystack(u: Column, title: Column) -> Column:
    """Host, path with query and title on separate lines, lower case.

    The line breaks matter: the patterns anchor on line starts and ends.
    """
    ask = F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise("")
    return F.lower(F.concat(netloc(u), F.lit("\n"), path(u), ask, F.lit("\n"), title))


def dated_archive_reason(path_l: Column, year: Column, target_year: int = TARGET_YEAR) -> Column:
    """Reason a page is stale by its path, whatever its sitemap date says.

    ``path_l`` is the lower-case path, ``year`` its oldest year.
    """
    old = year.isNull() | (year < target_year - 1)
    known_old = year.isNotNull() & (year < target_year - 1)
    return (
        F.when(path_l.rlike("(?id)" + CRIME_LOG_MONTH) & old, "historical monthly crime log")
        .when(matches_any(path_l, DATED_ARCHIVE, "(?id)") & old, "dated archive page")
        .when(path_l.rlike(r"(?d)/20\d{2}-\d{2}-\d{2}-") & known_old, "old dated article")
        .when(known_old & path_l.rlike("(?d)" + OLD_YEAR_PATH), "old year-specific page")
        .otherwise("")
    )


# --------------------------------------------------------------------- scoring
# Scoring signals.
HIGH_VALUE = (
    "/admission", "/academics", "/catalog", "/course", "/degree", "/major", "/minor", "/program",
    "/financial-aid", "/financialaid", "/scholarship", "/tuition", "/registrar", "/housing", "/dining",
    "dining", "/student-life", "/studentlife", "/health", "/counseling", "/accessibility",
    "/disability", "/parking", "/orientation", "/apply", "/calendar",
)
MEDIUM_VALUE = (
    "/about", "/news", "/press", "/magazine", "/blog", "/story", "/policy", "/faq", "/handbook",
)
NOISY = (
    "/search", "/tag/", "/login", "/signin", "/feed", "/rss", "/archive", "/staging", "/test", "/demo",
)
VERY_HIGH = ("/admission$", "/registrar$", "/catalog$", "/financial-aid$", "/housing$")
VERY_LOW = (
    "/donor", "/giving", "/development", "/advancement", "/alumni", "/president", "/administration",
)


def parse_lastmod(c: Column) -> Column:
    """Sitemap date with a zone offset as timestamp.

    A value without a zone keeps its year but never counts as fresh, see
    ``freshness``.
    """
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def has_zone(c: Column) -> Column:
    return c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")


def freshness(lastmod: Column, now: Column, target_year: int = TARGET_YEAR) -> Column:
    """0-100 by age; neutral 50 for missing dates and dates without a zone."""
    ts = parse_lastmod(lastmod)
    # the year is read in the offset the text carries
    year = F.substring(lastmod, 1, 4).try_cast("int")
    age = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0))
    this_year = (
        F.when(age <= 30, 95).when(age <= 90, 90).when(age <= 180, 85).otherwise(80)
    )
    return (
        F.when(ts.isNull() | ~has_zone(lastmod), 50)
        .when(year == target_year, this_year)
        .when((year == target_year - 1) & (age <= 180), 75)
        .when(year == target_year - 1, 70)
        .when(year >= target_year - 2, 60)
        .when(year >= target_year - 4, 45)
        .otherwise(30)
    )


# -------------------------------------------------------------------- grouping
# Paths that are school roots and the words that name them.
SCHOOL_ROOTS = ("cox", "dedman", "dedmanlaw", "law", "lyle", "meadows", "simmons", "perkins")


def first_segment_root(u: Column) -> Column:
    """School root the path starts with, else the empty string."""
    head = F.lower(F.coalesce(F.get(path_parts(u), F.lit(0)), F.lit("")))
    return F.when(head.isin(*SCHOOL_ROOTS), head).otherwise("")


def group_key(u: Column) -> Column:
    """``/``, the school root, or the first one or two path segments."""
    parts = path_parts(u)
    head = F.concat(F.lit("/"), F.get(parts, F.lit(0)))
    return (
        F.when(F.size(parts) == 0, "/")
        .when(first_segment_root(u) != "", head)
        .when(F.size(parts) == 1, head)
        .otherwise(F.concat(head, F.lit("/"), F.get(parts, F.lit(1))))
    )


LINK = r"""https?://[^\s)\]}>"']+"""


def links_in(text: Column) -> Column:
    """Distinct links in order of appearance, trailing punctuation removed."""
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;"))))
