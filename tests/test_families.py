from pyspark.sql import functions as F

from pagequarry.operators import families, openaccess


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


PNAS = """<meta property="og:url" content="https://www.pnas.org/x"><div class="author-tooltip-1"><span class="author-tooltip-name">Ann Lee</span><div class="author-affiliation">Inst A</div><a class="author-corresp-email-link">@</a></div>
<div class="author-tooltip-2"><span class="author-tooltip-name">Bo Ray 2,*</span></div><div class="abstract"><p>Abstract: The text.</p></div>"""
LD = """<script type="application/ld+json">{"author":[{"@type":"Person","name":"Cy Dee","email":"c@d","affiliation":[{"name":"Inst C"},"Inst D"]},{"@type":"Person","name":"Eve","affiliation":"Inst E"},{"@type":"Organization","name":"No"}]}</script>"""


def test_families_and_ladder(spark):
    df = pages(spark, ("", PNAS), ("", LD), ("", "<p>nothing</p>"), ("", None))
    got = {r["page_id"]: r for r in families.extract_pages(df).collect()}
    assert sorted(got) == [0, 1]
    assert (got[0]["rule_id"], got[0]["rung"], got[0]["abstract"]) == ("nas", 1, "The text.")
    assert [(a["name"], a["affiliations"], a["is_corresponding"]) for a in got[0]["authors"]] == [("Ann Lee", ["Inst A"], True), ("Bo Ray", [], None)]
    assert [(a["name"], a["affiliations"], a["is_corresponding"]) for a in got[1]["authors"]] == [("Cy Dee", ["Inst C", "Inst D"], True), ("Eve", ["Inst E"], None)]


def test_every_selector_is_read():
    from pagequarry.operators import publishers, selectors

    rules = publishers.SELECTORS | families.roles_of(families.ID_FAMILIES, families.LABELLED) | families.roles_of(families.FAMILIES, families.LISTED)
    assert len(rules) == len({f[0] for f in families.FAMILIES + families.ID_FAMILIES}) + len(publishers.SELECTORS) and all(selectors.steps_of(s) for roles in rules.values() for s in roles.values())


def test_script_state(spark):
    h = 'x; xplGlobal.document.metadata={"authors":[{"name":"A B","affiliation":["X","Y"]},{"name":"C","affiliation":"Z"}]};\n'
    got = pages(spark, ("", h)).select(families.script_authors(F.col("html")).alias("a")).first()["a"]
    assert [(a["name"], a["affiliations"]) for a in got] == [("A B", ["X", "Y"]), ("C", ["Z"])]


def test_open_access(spark):
    df = pages(
        spark, ("https://academic.oup.com/x", '<i class="icon-availability_free">'), ("https://projecteuclid.org/x", "<strong>Full-text: Open access</strong>"), ("https://a.org/x", "distributed under the terms of CC BY, which permits"),
        ("https://a.org/x", "plain"), ("https://www.aimsciences.org/x", "distributed under the terms of CC BY, which permits"), (None, None),
    )
    got = [r["s"] and (r["s"]["oa_status"], r["s"]["license"]) for r in df.orderBy("page_id").select(openaccess.status(F.col("url"), F.col("html")).alias("s")).collect()]
    assert got == [("bronze", None), ("hybrid", "unspecified-oa"), ("hybrid", "cc-by"), None, None, None]


def test_pdf_fallbacks(spark):
    df = pages(
        spark, ("https://www.sciencedirect.com/science/article/x", '"pii":"S1"'), ("https://www.sciencedirect.com/x", '"pii":"S1","md5":"m","pid":"p"'), ("https://www.tandfonline.com/doi/full/10.1/x", '<link rel="canonical" href="https://www.tandfonline.com/doi/full/10.1/x">'),
        ("https://osf.io/abc/", ""), ("https://b.org", ""),
    ).orderBy("page_id")
    u, h = F.col("url"), F.col("html")
    assert [r["x"] for r in df.select(F.coalesce(openaccess.science_direct_pdf(u, h), openaccess.fallback_pdf(u, h)).alias("x")).collect()] == [
        "https://www.sciencedirect.com/science/article/pii/S1/pdf", "https://www.sciencedirect.com/science/article/pii/S1/pdfft?md5=m&pid=p", "https://www.tandfonline.com/doi/pdf/10.1/x", "https://osf.io/abc/download", None,
    ]
    assert df.limit(1).select(openaccess.router_base(F.lit("/doi/pdf/10.1080/a"), F.lit("https://doi.org/10.1080/a")).alias("x")).first()["x"] == "https://www.tandfonline.com"


def test_ids(spark):
    h = """<meta property="og:url" content="https://www.mdpi.com/1"><span class="inlineblock">Ann Lee<sup>1,2,*</sup></span><span class="inlineblock">Bo Ray<sup>2</sup></span><span class="inlineblock">Cy</span>
    <div class="affiliation"><sup>1</sup>Inst A</div><div class="affiliation"><sup>2</sup><div>Inst B</div></div>"""
    got = families.extract_pages(pages(spark, ("", h))).first()
    assert (got["rule_id"], got["rung"]) == ("mdpi_ids", 1)
    assert [(a["name"], a["affiliations"], a["is_corresponding"]) for a in got["authors"]] == [("Ann Lee", ["Inst A", "Inst B"], True), ("Bo Ray", ["Inst B"], None), ("Cy", [], None)]


def test_names(spark):
    from pagequarry.functions import names

    assert names.split_name("Dr. John Q. van der Berg Jr.") == ("Dr.", "John", "Q.", "van der Berg", "Jr.")
    assert names.split_name("Smith, Éva Maria") == ("", "Éva", "Maria", "Smith", "")
    assert names.split_name("Éva Smith, PhD, MD") == ("", "Éva", "", "Smith", "PhD MD")
    assert names.split_name("Plato") == ("", "", "", "Plato", "") and names.split_name(None) == ("", "", "", "", "")
    df = spark.createDataFrame([("J. Smith", "Smith, John"), ("A Smith", "B Smith"), (None, "x")], "a string, b string")
    assert [r["m"] for r in df.select(names.names_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False]
    assert df.select(names.parts(F.col("a")).alias("p")).first()["p"]["last"] == "Smith"


def test_generic_authors_are_marked_by_their_page(spark):
    metas = '<meta name="citation_author" content="Ann Lee"><meta name="citation_author_institution" content="U"><meta name="citation_author" content="Bob Ray">'
    rows = [(1, f"<html><head>{metas}</head><body><div><p>Corresponding author: Bob Ray</p></div></body></html>"), (2, f"<html><head>{metas}</head><body><p>text</p></body></html>")]
    got = {r["page_id"]: [a["is_corresponding"] for a in r["authors"]] for r in families.extract_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: [False, True], 2: [None, None]}


def test_an_extractor_registered_for_a_call(spark):
    """Its gate, its marks, its functions; it comes before the lists, null and nobody included."""
    import pytest

    from pagequarry.operators import people

    upper = families.Extractor(
        "own", "og_url", "own.org", {"who": "p.by", "who/place": "i", "text": "div.sum"},
        lambda marks: F.transform(families.role(marks, "who"), lambda m: people.author(F.upper(m["own"]), families.part_texts(m, "place"), F.lit(None).cast("boolean"))),
        lambda marks: F.try_element_at(families.role(marks, "text"), F.lit(1))["text"],
    )
    page = '<meta property="og:url" content="https://{}/1"><p class="by">ann <i>Inst A</i></p><div class="sum">All.</div><div class="author-tooltip-1"><span class="author-tooltip-name">Bo</span><div class="author-affiliation">B</div></div>'
    df = pages(spark, ("", page.format("own.org")), ("", page.format("pnas.org")), ("", page.format("own.org/pnas.org")), ("", '<meta property="og:url" content="https://own.org/2">'), ("", None))
    got = {r["page_id"]: (r["rule_id"], [(a["name"], a["affiliations"]) for a in r["authors"]], r["abstract"]) for r in families.extract_pages(df, extractors=[upper]).collect()}
    assert got == {0: ("own", [("ANN", ["Inst A"])], "All."), 1: ("nas", [("Bo", ["B"])], None), 2: ("own", [("ANN", ["Inst A"])], "All.")}
    for name in ("nas", "acs", "generic"):
        with pytest.raises(ValueError):
            families.extract_pages(df, extractors=[families.Extractor(name, "og_url", "x", {}, lambda m: m)])
