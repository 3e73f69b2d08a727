
import pytest
from pyspark.sql import functions as F

from corvane.functions import urls as U
from corvane.operators import crawl

# url, expected reason of the policy
POLICY = [
    ("", "empty_url"), ("mailto:a@x.edu", "mailto_link"), ("https://www.facebook.com/school", "social_or_external_profile"),
    ("https://x.edu/login", "auth_or_account"), ("https://x.edu/a?utm_source=b", "search_or_listing_noise"),
    ("https://x.edu/events/list", "calendar_listing_noise"), ("https://x.edu/wp-content/a.css", "technical_or_generated_noise"),
    ("https://x.edu/giving", "donor_advancement_or_alumni"), ("https://x.edu/people/jane-doe", "staff_faculty_bio"),
    ("https://x.edu/academics/departments/cs/faculty/profiles/jane-doe-x/", "student_canonical_allowlist"),
    ("https://x.edu/alumni", "general_alumni_section"), ("https://x.edu/alumni/tuition", "student_canonical_allowlist"),
    ("https://x.edu/news/2019-03-01-launch", "old_dated_news_or_article"), ("https://x.edu/news/2026-03-01-launch", "student_candidate"),
    ("https://x.edu/course-schedule/fall-2020", "dated_archive_page"), ("https://x.edu/things/2018/a", "old_year_specific_noncanonical_page"),
    ("https://x.edu/reports/20190301/", "old_year_specific_noncanonical_page"), ("https://x.edu/room/20190", "student_candidate"),
    ("https://x.edu/tuition", "student_canonical_allowlist"), ("https://x.edu/about", "student_candidate"),
    ("https://x.edu/photo.png", "media_or_asset_noise"),
]


def test_policy_table(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(POLICY)], "i int, url string")
    got = {r["i"]: r for r in crawl.with_policy(rows).collect()}
    for i, (url, reason) in enumerate(POLICY):
        assert got[i]["reason"] == reason, url
        assert got[i]["selected"] == reason.startswith("student_"), url


def test_score_and_freshness(spark):
    now = F.lit("2026-06-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([
        (0, "https://x.edu/admission", "2026-05-20T00:00:00Z"), (1, "https://x.edu/search/feed", None),
        (2, "https://x.edu/admission", "2026-05-20"), (3, "https://x.com/a/b/c/d/e/f/g", "2019-01-01T00:00:00+00:00"),
    ], "i int, url string, lastmod string")
    got = {r["i"]: r for r in crawl.with_score(rows, now).collect()}
    assert got[0]["freshness"] == 95 and got[0]["student_value"] == 90 and got[0]["scrape_value"] == 95
    assert got[0]["score"] == round(90 * 0.4 + 95 * 0.25 + 85 * 0.15 + 95 * 0.2)
    assert got[0]["reason"] == "high student-value content; current-year content"
    assert got[1]["freshness"] == 50 and got[1]["reason"] == "limited direct student value; noisy/technical page"
    assert got[2]["freshness"] == 50  # a date without a zone is neutral
    assert got[3]["freshness"] == 30 and got[3]["student_value"] == 35 and got[3]["scrape_value"] == 50


@pytest.mark.parametrize("url,host,path,canonical", [
    ("HTTPS://User@X.edu:443/A/b/?q=1#f", "x.edu", "/A/b/", "https://user@x.edu:443/A/b?q=1"),
    ("https://x.edu", "x.edu", "", "https://x.edu/"), ("not a url", "", "not a url", "not a url"),
    ("https://x.edu/a;v=1", "x.edu", "/a", "https://x.edu/a"),
])
def test_url_parts(spark, url, host, path, canonical):
    u = F.col("u")
    row = spark.createDataFrame([(url,)], "u string").select(U.host(u), U.path(u), U.canonical(u)).first()
    assert tuple(row) == (host, path, canonical)


def test_domains_and_groups(spark):
    rows = spark.createDataFrame([("https://www.cs.ox.ac.uk/a/b/c",), ("https://x.edu/cox/mba/x",), ("https://x.edu/",)], "u string")
    u = F.col("u")
    got = [tuple(r) for r in rows.select(U.registered_domain(U.host(u)), U.group_key(u)).collect()]
    assert got == [("ox.ac.uk", "/a/b"), ("x.edu", "/cox"), ("x.edu", "/")]


def test_trusted_domains_by_suffix(spark):
    rows = spark.createDataFrame([("https://a.b.x.edu/",), ("https://badx.edu/",), ("http://x.edu/",), ("https:///p",)], "url string")
    domains = spark.createDataFrame([("x.edu",)], "domain string")
    got = {r["url"]: r["trust_reason"] for r in crawl.trusted_domain(rows, domains).collect()}
    assert list(got.values()).count("untrusted_domain") == 1
    assert got["https://a.b.x.edu/"] == "trusted_domain" and got["http://x.edu/"] == "https_required" and got["https:///p"] == "missing_host"
    none = crawl.trusted_domain(rows, domains.filter("false")).filter("url = 'https://badx.edu/'").first()
    assert none["trust_reason"] == "trusted_domain_policy_empty"


def test_url_safety(spark):
    rows = spark.createDataFrame([("https://10.0.0.1/",), ("https://8.8.8.8/",), ("https://localhost/",), ("https://[::1]/",), ("http://a.b/",)], "u string")
    got = [r[0] for r in rows.select(crawl.url_safety(F.col("u"))).collect()]
    assert got == ["blocked_ip", "ok", "blocked_host", "blocked_ip", "https_required"]
    disguised = spark.createDataFrame([(f"https://{h}/",) for h in ("2130706433", "0x7f000001", "0177.0.0.1", "127.1", "0x7f.0.0.1", "8.8.8.010")], "u string")
    assert {r[0] for r in disguised.select(crawl.url_safety(F.col("u"))).collect()} == {"blocked_ip"}
    names = spark.createDataFrame([(f"https://{h}/",) for h in ("1a.example.org", "x.8", "10.example")], "u string")
    assert {r[0] for r in names.select(crawl.url_safety(F.col("u"))).collect()} == {"ok"}


def test_sitemaps(spark):
    xml = ('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x.edu/tuition </loc>'
           "<lastmod>2026-01-01</lastmod></url><url><loc>https://x.edu/a?b=1&amp;c=2</loc></url><url><loc>https://other.org/</loc></url></urlset>")
    index = "<sitemapindex><sitemap><loc>https://x.edu/s2.xml</loc></sitemap></sitemapindex>"
    entries = crawl.parse_sitemaps(spark.createDataFrame([("s1", xml), ("s0", index), ("bad", "<html>")], "sitemap string, xml string"))
    got = {(r["kind"], r["loc"], r["lastmod"]) for r in entries.collect()}
    assert got == {("url", "https://x.edu/tuition", "2026-01-01"), ("url", "https://x.edu/a?b=1&c=2", None),
                   ("url", "https://other.org/", None), ("child", "https://x.edu/s2.xml", None)}
    found = crawl.discovered_from_sitemaps(entries, "x.edu").collect()
    assert {r["url"] for r in found} == {"https://x.edu/tuition", "https://x.edu/a?b=1&c=2"}


def test_operator_rejection_stands(spark):
    rows = spark.createDataFrame([("https://x.edu/tuition", "operator_rejected_area", True), ("https://x.edu/login", None, True)],
                                 "url string, excluded_reason string, selected boolean")
    got = {r["url"]: (r["selected"], r["excluded_reason"]) for r in crawl.apply_policy(rows).collect()}
    assert got == {"https://x.edu/tuition": (False, "operator_rejected_area"), "https://x.edu/login": (False, "auth_or_account")}


def test_approved_urls_win_and_unknown_ones_stay(spark):
    found = spark.createDataFrame([("https://x.edu/tuition", "s", "other", True, None), ("https://x.edu/a", "s", "other", True, None)],
                                  "url string, source_sitemap string, path_category string, selected boolean, excluded_reason string")
    approved = spark.createDataFrame([("https://x.edu/tuition",), ("https://x.edu/new",), ("ftp://x.edu/f",)], "url string")
    assert {r["url"] for r in crawl.urls_to_scrape(found, approved).collect()} == {"https://x.edu/tuition", "https://x.edu/new"}
    assert {r["url"] for r in crawl.urls_to_scrape(found).collect()} == {"https://x.edu/tuition", "https://x.edu/a"}


def test_operator_messages(spark):
    rows = spark.createDataFrame([("Choose 20 urls under path:/cox/ and path:law",), ("remove the noise",), ("how many are eligible?",)], "m string")
    m = F.col("m")
    got = [tuple(r) for r in rows.select(crawl.message_intent(m), crawl.select_limit(m), crawl.message_subpaths(m)).collect()]
    assert got == [("approve", 20, ["/cox", "/law"]), ("remove", None, []), ("analyze", None, [])]
    assert crawl.school_roots(["law"]) == {"law", "dedmanlaw"} and crawl.school_roots(["dedman"]) == {"dedman"}


def test_manual_urls_last_wins(spark):
    rows = spark.createDataFrame([(0, "/tuition"), (1, "https://x.edu/tuition"), (2, "https://b.org/x"), (3, " ")], "pos int, url string")
    got = {r["url"]: r["excluded_reason"] for r in crawl.manual_urls(rows, "x.edu").collect()}
    assert got == {"https://x.edu/tuition": None, "https://b.org/x": "off_domain"}


