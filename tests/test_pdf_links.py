"""Ways to a page's PDF beyond plain links: rewritten meta tags, parents' classes, publishers' own places, on pages of our own."""

from pyspark.sql import functions as F

from pagequarry.functions import html as H
from pagequarry.functions import url as U
from pagequarry.operators import extract, openaccess


def values(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, h string")
    return [r["x"] for r in df.select("i", column(F.col("u"), F.col("h")).alias("x")).orderBy("i").collect()]


def test_meta_addresses_are_turned(spark):
    rows = [
        ("https://onlinelibrary.wiley.com/doi/pdf/10.1/x", ""), ("https://drops.dagstuhl.de/a/b.pdf/", ""), ("http://repository.ubn.ru.nl/bitstream/2066/47467/1/47467.pdf", ""), ("http://journal.nileuniversity.edu.ng/x", ""),
        ("http://www.ecologyandsociety.org/a.pdf", ""), ("https://www.nature.com/articles/ab-1.pdf", "see /articles/ab-1_reference.pdf"), ("https://www.nature.com/articles/ab-1.pdf", "none"), ("https://x.org/a.pdf", None), (None, "x"),
    ]
    assert values(spark, rows, U.rewrite_meta_pdf) == [
        "https://onlinelibrary.wiley.com/doi/pdfdirect/10.1/x", "https://drops.dagstuhl.de/a/b.pdf", "http://repository.ubn.ru.nl/bitstream/handle/2066/47467/1/47467.pdf", "https://journal.nileuniversity.edu.ng/x",
        "https://www.ecologyandsociety.org/a.pdf", "/articles/ab-1_reference.pdf", "https://www.nature.com/articles/ab-1.pdf", "https://x.org/a.pdf", None,
    ]


def test_links_under_their_parent_and_full_texts_that_are_none(spark):
    own = "https://x.org/a/"
    rows = [
        (own, '<div class="box PDF-download x">Get <a href="/b">Supplement</a> <img src=i><a href="/get/pdf1">PDF of it</a></div>'), (own, '<div class="pdf-container"><p><a href="/b/c">its Text</a></p></div>'),
        (own, '<a href="/f">Full text</a>'), (own, '<meta name="wkhealth_title" content="x"><a href="/f">Full text</a>'), ("https://degruyter.com/x", '<a href="/document/doi/10.1515/a.b/pdf/firstPage?x=1">PDF</a>'), (own, None),
    ]
    assert values(spark, rows, extract.pdf_link) == ["https://x.org/get/pdf1", None, "https://x.org/f", None, "https://www.degruyterbrill.com/document/doi/10.1515/a.b/pdf", None]
    under = lambda u, h: F.transform(F.filter(extract.links(h, F.filter(H.anchors(h), lambda a: F.lit(False))), lambda x: x["href"].isNotNull()), lambda x: x["href"])
    assert values(spark, rows, under)[:2] == [["/get/pdf1", "/b"], []]


def test_publishers_own_places(spark):
    lww = "<script>u='https://journals.lww.com/a/_layouts/oaks.journals/downloadpdf.aspx?an=1&amp;x=2&quot;,'</script>"
    rows = [
        ("https://journals.lww.com/a/1", lww), ("https://www.cambridge.org/core/books/1", '{"u":"/core/services/aop-cambridge-core/content/view/ABC/x.pdf"}'), ("https://www.degruyter.com/1", '<div data-url="/document/doi/10.1/a/pdf?z" class="x pdf-container">'),
        ("https://www.degruyterbrill.com/1", '<link rel="canonical" href="https://www.degruyter.com/document/doi/10.1/a/html"><div class="pdf-container" data-url="/no">'), ("https://x.org", lww), ("https://www.cambridge.org/1", None),
    ]
    assert values(spark, rows, openaccess.fallback_pdf) == [
        "https://journals.lww.com/a/_layouts/oaks.journals/downloadpdf.aspx?an=1&x=2", "https://www.cambridge.org/core/services/aop-cambridge-core/content/view/ABC/x.pdf", "https://www.degruyterbrill.com/document/doi/10.1/a/pdf",
        "https://www.degruyterbrill.com/document/doi/10.1/a/pdf", None, None,
    ]


def test_links_behind_many_others(spark):
    own, nav = "https://x.org/a/", "".join(f'<a href="/nav/{i}">topic {i}</a>' for i in range(70))
    bad = "".join(f'<a href="/supplement/{i}.pdf">supplement pdf</a>' for i in range(70))  # PDF-shaped, and none of them the page's
    rows = [
        (own, nav + '<a href="/get/file">Download</a>'), (own, bad + '<a href="/get/file">Download</a>'), (own, bad + '<a href="/own.pdf">PDF</a>'), (own, nav + "<button onclick=\"open('https://x.org/b.pdf')\">Get</button>"),
        (own, nav + '<div class="pdf-container"><a href="/get/1">Download</a></div>'), (own, nav * 30 + '<a href="/get/file">Download</a><a href="/later">Download</a>'), (own, nav), (own, bad),
        (own, '<div class="references"><a href="/ref.pdf">PDF</a></div>' + nav + '<a href="/get/file">Download</a>'),
    ]
    found = ["https://x.org/get/file", "https://x.org/get/file", "https://x.org/own.pdf", "https://x.org/b.pdf", "https://x.org/get/1", "https://x.org/get/file", None, None, "https://x.org/get/file"]
    assert values(spark, rows[:-1], extract.pdf_link) == found[:-1]  # the last needs the page's own anchors
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: [u["url"] for u in r["urls"]] for r in extract.response(df).collect()}
    assert got == {i: [u] if u else [] for i, u in enumerate(found)}
    assert values(spark, [(own, nav + '<a href="/a.docx">Text</a>')], lambda u, h: extract.document_link(h)) == ["/a.docx"]
    assert values(spark, [("https://www.biodiversitylibrary.org/x", nav + '<a href="/v/1">View article</a>')], extract.view_link) == ["/v/1"]
