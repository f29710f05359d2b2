"""Passes over whole pages: each page is cleaned and searched a few times, whatever the number of rules; shortcuts leave no rule out."""

from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.functions import html, text
from pagequarry.operators import openaccess, related


def test_the_page_is_cleaned_once(spark):
    pages = spark.createDataFrame([("https://x.org", "<p>")], "url string, html string")
    plan = pages.select(openaccess.status(F.col("url"), F.col("html")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("view-pnas") <= 2  # was there for each pattern that the cleaned page is held against


def test_signs_of_open_access(spark):
    page = lambda said: (f"<html><body><p>{said}</p></body></html>",)
    rows = [
        page("DISTRIBUTED under the Terms of CC BY which permits all"), page("see CreativeCommons.org/licenses/by-nc/4.0"), page('<img src="/AccessOA.png">'), page("nothing"),
        ('<meta name="citation_reference" content="creativecommons.org/licenses/by"><p>x',), ('<div class="View-PNAS-Featured">creativecommons.org/licenses/by</div><section>x',),
    ]
    got = [r["s"] and (r["s"]["oa_status"], r["s"]["license"]) for r in spark.createDataFrame(rows, "html string").select(openaccess.status(F.lit("https://x.org/1"), F.col("html")).alias("s")).collect()]
    assert got == [("hybrid", "cc-by"), ("hybrid", "cc-by-nc"), ("hybrid", "unspecified-oa"), None, None, None]


def test_every_phrase_of_a_license(spark):
    phrases = [p for p, _ in rules.LICENSES + rules.DATASET_LICENSES]
    got = [r["n"] for r in spark.createDataFrame([(f"x {p} y",) for p in phrases], "t string").select(text.license_of(F.col("t"), dataset=True).alias("n")).collect()]
    first = [next(n for q, n in rules.LICENSES + rules.DATASET_LICENSES if q in f"x{p}y") for p in phrases]
    assert got == first


def test_blocked_by_text_between_tags(spark):
    rows = [("Cookies <b>turned</b> off", "cached_bot_check"), ("Help us <i>confirm</i> that you are not a robot", "cached_bot_check"), ("Akamai<br>powered and <b>protected</b> by", "cached_bot_check"), ("<b>ShieldSquare</b> captcha", "cached_bot_check"), ("Radware <b>bot manager</b> captcha", "cached_bot_check"), (" <p>Loading...</p>\n", "js_rendered_required"), ("\x0b\f %PDF-1", None), ("\x0b\f%PDF-1", "cached_pdf"), ("x" * 600, None)]
    got = [r["b"] for r in spark.createDataFrame([(h,) for h, _ in rows], "html string").select(html.block_reason(F.col("html")).alias("b")).collect()]
    assert got == [b or (None if len(h) >= 512 else "cached_pdf" if h.strip().startswith("%PDF-") else "cached_too_small") for h, b in rows]


def test_pages_that_name_related_content(spark):
    rows = [(f"<p>{w}",) for w in related.WORDS] + [("<p>no such thing",), ("",), (None,)]
    got = [r["n"] for r in spark.createDataFrame(rows, "html string").select(related.names_one(F.col("html")).alias("n")).collect()]
    assert got == [h is not None and related.named(h) for h, in rows] == [True] * len(related.WORDS) + [False] * 3
