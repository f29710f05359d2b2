from pyspark.sql import functions as F

from pagequarry.functions import url
from pagequarry.operators import dom, extract, related

PAGES = [
    (1, "https://a.org/x", '<body><div class="references"><a href="/ref.pdf">PDF</a></div><a href="/own.pdf">PDF</a></body>'),
    (2, "https://a.org/x", '<body><div class="my ref-list big"><p><a href="/ref.pdf">PDF</a></p></div></body>'),
    (3, "https://a.org/x", '<body><h2>References</h2><ul><li><a href="/r.pdf">PDF</a></li></ul><h2>More</h2><p><a href="/o.pdf">Download PDF</a></p></body>'),
    (4, "https://a.org/x", '<body><table><tr><td><span>See Supplemental Material</span></td><td><a href="/s.pdf">PDF</a></td></tr><tr><td><a href="/t.pdf"><img src="/pdf.png"></a></td></tr></table></body>'),
    (5, "https://a.org/x", '<body><a href="/plain.pdf">PDF</a></body>'),
    (6, "https://a.org/x", "<body><button onclick=\"open('https://a.org/b.pdf')\">Get</button></body>"),
    (7, "https://a.org/x", '<body><span class="ref-list"><span class="reference"><a href="/in.pdf">PDF</a></span><a href="/beside.pdf">PDF</a></span></body>'),
    (8, "https://a.org/x", None), (None, "https://a.org/x", '<body><div id="toc"><a href="/t.pdf">PDF</a></div></body>'),
    (9, "https://a.org/x", '<body><h2>Notes</h2><ol><li><p class="alinea"><a href="/n.pdf">PDF</a></p></li></ol><img src="/supplementary_material.png"><p><a href="/m.pdf">PDF</a></p><a href="/last.pdf">PDF</a></body>'),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_links_outside_related_content(spark):
    got = {r["page_id"]: [u["url"] for u in r["urls"]] for r in extract.response(pages(spark)).collect()}
    assert got == {
        1: ["https://a.org/own.pdf"], 2: [], 3: ["https://a.org/o.pdf"], 4: ["https://a.org/t.pdf"], 5: ["https://a.org/plain.pdf"], 6: ["https://a.org/b.pdf"], 7: ["https://a.org/beside.pdf"], 8: [], None: [], 9: ["https://a.org/last.pdf"],
    }


def test_pages_without_such_sections_are_not_parsed(spark):
    got = {r["page_id"] for r in pages(spark).where(related.names_one(F.col("html"))).collect()}
    assert got == {1, 2, 3, 4, 7, None, 9}


def test_axes(spark):
    html = '<body><h2 id="t">Abstract</h2><p id="p">one</p><div id="d" class="x"><span id="s">inner words</span></div><div class="main-abstract"><p id="q">two</p></div></body>'
    table = dom.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    named = lambda df: sorted(r["attrs"].get("id", r["tag"]) for r in df.collect())
    heads = table.where("tag = 'h2'").select("page_id", "parent", "pre")
    assert named(related.siblings_after(table, heads)) == ["d", "div", "p"]
    assert named(table.where(related.is_heading())) == ["t"]
    chosen = table.where("tag in ('div', 'span', 'p')")
    assert named(related.minimal(chosen)) == ["p", "q", "s"]
    found = {r["attrs"]["id"]: r["explicit"] for r in related.in_abstract_context(table, table.where("tag in ('p', 'span')")).collect()}
    assert found == {"p": True, "s": False, "q": True}
    assert [r["full_text"] for r in related.smallest_holding(table, "INNER", 2).orderBy("rank").collect()][0] == "inner words"


def test_documents_and_views(spark):
    rows = [("https://www.biodiversitylibrary.org/x", '<a href="/v/1">View article</a>'), ("https://a.org/", '<a href="/v/1">View article</a><a href="/a.docx">Text</a>')]
    df = spark.createDataFrame(rows, "url string, html string")
    got = [tuple(r) for r in df.select(extract.view_link(F.col("url"), F.col("html")), extract.document_link(F.col("html"))).collect()]
    assert got == [("/v/1", None), (None, "/a.docx")]


def test_hosts(spark):
    rows = [("https://x.exlibrisgroup.com/a?Expires=1", "https://a.org"), ("https://x.exlibrisgroup.com/a", "https://a.org"), ("https://a.org/a.pdf", "https://www.swarthmore.edu/donna-jo-napoli/publications-available-download"), (None, None)]
    df = spark.createDataFrame(rows, "p string, u string")
    assert [r[0] for r in df.select(url.unstable_pdf(F.col("p"), F.col("u"))).collect()] == [True, False, True, False]
    df = spark.createDataFrame([("https://osf.io/x",), ("https://babel.hathitrust.org/y",), ("https://nosf.io.org",)], "u string")
    assert [tuple(r) for r in df.select(url.serves_documents(F.col("u")), url.trusts_repository_license(F.col("u"))).collect()] == [(True, False), (False, True), (False, False)]
