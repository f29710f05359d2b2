import pytest
from pyspark.sql import functions as F

from pagequarry.functions import fuzzy, html, text, url


def value(spark, column, **values):
    schema = ", ".join(f"`{k}` string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [
    ("HTTP://WWW.Example.com/a/?utm_source=x&b=1#top", "http://example.com/a?b=1"), ("https://example.com", "https://example.com/"), ("https://e.org/x?q", "https://e.org/x?q="), (None, ""), ("", ""),
])
def test_canonical_url(spark, given, want):
    assert value(spark, url.canonical_url(F.col("u")), u=given) == want


@pytest.mark.parametrize(("given", "want"), [("https://doi.org/10.1/ABC", "10.1/abc"), ("doi:10.1/x", "10.1/x"), (" 10.2/Y ", "10.2/y"), (None, "")])
def test_normalize_doi(spark, given, want):
    assert value(spark, url.normalize_doi(F.col("d")), d=given) == want


def test_dois(spark):
    assert value(spark, url.dois(F.col("t")), t="See 10.1234/AB.c, (10.1234/ab.c) and 10.5555/x-1.") == ["10.1234/ab.c", "10.5555/x-1"]


@pytest.mark.parametrize(("base", "href", "want"), [
    ("https://a.org/x/y", "z", "https://a.org/x/z"), ("https://a.org/x/y", "/z", "https://a.org/z"), ("https://a.org/x", "//b.org/q", "https://b.org/q"), ("https://a.org/x?y", "?k", "https://a.org/x?k"),
    ("https://a.org", "z", "https://a.org/z"), ("https://a.org/x", "https://c.org/p;jsessionid=1A", "https://c.org/p"), ("", "z", "z"),
])
def test_resolve(spark, base, href, want):
    assert value(spark, url.resolve(F.col("b"), F.col("h")), b=base, h=href) == want


def test_pdf_rewrite(spark):
    assert value(spark, url.rewrite_pdf_url(F.col("u")), u="https://www.tandfonline.com/doi/full/10.1/x") == "https://www.tandfonline.com/doi/pdf/10.1/x"
    assert value(spark, url.rewrite_pdf_url(F.col("u")), u="https://x.org/doi/full/10.1/x") == "https://x.org/doi/full/10.1/x"


@pytest.mark.parametrize(("given", "want"), [
    ("under CC BY-NC-ND 4.0", "cc-by-nc-nd"), ("creativecommons.org/licenses/by/4.0", "cc-by"), ("public domain", "public-domain"), ("works not in the public domain", None), ("GPL 3", "gpl-3"), (None, None), ("nothing", None),
])
def test_license(spark, given, want):
    assert value(spark, text.license_of(F.col("t"), dataset=True), t=given) == want


def test_license_trust(spark):
    assert value(spark, url.trusts_license(F.col("u")), u=None)
    assert not value(spark, url.trusts_license(F.col("u")), u="https://www.aimsciences.org/x")
    assert value(spark, url.trusts_license(F.col("u")), u="https://rupress.org/jcb/article/200/1")
    assert not value(spark, url.trusts_license(F.col("u")), u="https://rupress.org/jcb/article/218/1")


@pytest.mark.parametrize(("page", "want"), [
    (None, "missing"), ("%PDF-1.4 x", "cached_pdf"), ("<html><title>Just a moment...</title></html>", "cached_bot_check"), ("<p>Loading...</p>", "js_rendered_required"),
    ("<title>Error - Cookies Turned Off</title>", "cached_bot_check"), ("<script>document.cookie=1;document.location.reload()</script>", "cached_bot_check"), ("<title>CyberCrime</title>", "cached_error_page"), ("<p>x</p>", "cached_too_small"), ("<p>" + "word " * 300, None),
])
def test_block_reason(spark, page, want):
    assert value(spark, html.block_reason(F.col("h")), h=page) == want


def test_metas_and_base(spark):
    page = """<head><base href='https://b.org/'><meta name="citation_author" content="A, B"><META property=og:url content='https://c.org/x'><link rel="canonical" href="https://d.org/y"></head>"""
    assert value(spark, html.meta(F.col("h"), "og:url"), h=page) == "https://c.org/x"
    assert value(spark, html.base_url(F.col("h")), h=page) == "https://b.org/"
    assert value(spark, html.page_url(F.col("h"), F.col("u")), h=page, u="https://doi.org/10.1/x") == "https://d.org/y"
    assert value(spark, html.base_url(F.col("h")), h=None) == ""


def test_text(spark):
    assert value(spark, text.normalize_alpha(F.col("t")), t="  Éric  Müller-Strauß ") == "eric muller strauss"
    assert value(spark, text.redact(F.col("t")), t="mail a.b@c.org or 555-123-4567") == "mail [email] or [phone]"
    assert value(spark, text.decode_cfemail(F.col("t")), t="%02x" % 42 + "".join("%02x" % (ord(c) ^ 42) for c in "x@y.org")) == "x@y.org"
    assert value(spark, text.split_affiliations(F.col("t")), t="Dept A; and Inst B; Correspondence: me; a@b.c; Dept A") == ["Dept A", "Inst B"]
    assert value(spark, text.name_key(F.col("t")), t="Smith, Éva") == ("smith", "e")
    assert value(spark, text.name_key(F.col("t")), t="Eva Maria Smith") == ("smith", "e")
    assert value(spark, text.failure_modes(F.col("t")), t="Captcha, then not found") == ["bot_check", "broken_url"]
    assert value(spark, text.fold_text(F.col("t")), t="ﬁ Ｃédric") == "fi cedric"
    assert value(spark, text.excerpt(F.col("t"), F.col("n"), 2), t="abcdefgh", n="DE") == "bcdefg"


def test_fuzzy():
    assert fuzzy.lcs("abcde", "ace") == 3
    assert fuzzy.indel("", "") == 100 and fuzzy.indel("ab", "") == 0
    assert fuzzy.token_set("john smith", "smith john q") == 100
    assert 0 < fuzzy.token_set("john smith", "jon smith") < 100

    import random

    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.lcs(a, b) == table[-1][-1]


def test_character_references(spark):
    rows = [("a &amp;lt; b", "a &lt; b"), ("M&uuml;ller &#233; &#xE9; &#128578;", "Müller é é 🙂"), ("AT&T &unknown; & &;", "AT&T &unknown; & &;"), ("&quot;&apos;&#39;&nbsp;", "\"'' "), ("&#55296; &#0; &#9999999;", "&#55296; &#0; &#9999999;"), ("none", "none"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").select(html.unescaped(F.col("t")).alias("got"), "want")
    assert [r["got"] for r in df.collect()] == [r["want"] for r in df.collect()]
    page = '<title>Caf&eacute; &quot;x&quot;</title><meta name="citation_pdf_url" content="/d?a=1&amp;b=2"><a href="/x?p=1&amp;q=2">R&amp;D</a>'
    got = spark.createDataFrame([(page,)], "h string").select(html.title(F.col("h")).alias("t"), html.meta(F.col("h"), "citation_pdf_url").alias("m"), html.anchors(F.col("h"))[0].alias("a")).first()
    assert (got["t"], got["m"], got["a"]["href"], got["a"]["anchor"]) == ('Café "x"', "/d?a=1&b=2", "/x?p=1&q=2", "r&d")


def test_references_of_rfc_3986(spark):
    base = "http://a/b/c/d;p?q"
    cases = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g;x?y#s": "http://a/b/c/g;x?y#s"}
    cases |= {".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g"}
    cases |= {"/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x"}
    df = spark.createDataFrame(list(cases.items()), "h string, want string").select("h", "want", url.resolve(F.lit(base), F.col("h")).alias("got"))
    assert [(r["h"], r["got"]) for r in df.collect()] == [(r["h"], r["want"]) for r in df.collect()]
