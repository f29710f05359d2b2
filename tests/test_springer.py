"""The large publishing group's ladder, on pages of our own."""

import json

from pagequarry.operators import families, publishers

LINK = '<link rel="canonical" href="https://link.springer.com/article/1">'
LONG = "What is said here goes on for long enough to count as an abstract, which takes eighty characters at least."


def item(name, *places, mark=""):
    return f'<li class="c-article-authors-listing__item"><span class="js-search-name">{name}{mark}</span><ol class="x-affiliation__list">' + "".join(f"<li><p>{p}</p></li>" for p in places) + "</ol></li>"


def page(*body, head=LINK):
    return f"<html><head>{head}</head><body>{''.join(body)}</body></html>"


def group(place, names):
    return f'<ol class="c-article-author-affiliation__list"><li id="Aff1A"><p class="c-article-author-affiliation__address">{place}</p><p class="c-article-author-affiliation__authors-list">{names}</p></li></ol>'


def metas(*people):
    return "".join(f'<meta name="citation_author" content="{n}">' + (f'<meta name="citation_author_email" content="{m}">' if m else "") for n, m in people)


def record(**parts):
    return f'<script type="application/ld+json">{json.dumps({"mainEntity": parts})}</script>'


def read(spark, *htmls):
    rows = publishers.candidates(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")).collect()
    return {r["page_id"]: ([(a["name"], a["affiliations"], a["is_corresponding"]) for a in r["authors"]], r["abstract"]) for r in rows}


def test_ways_to_list_authors(spark):
    older = '<div id="{0}"><ul><li itemprop="{1}"><span>Ann Lee</span><ul data-role="AuthorsIndexes"><li>2</li></ul></li><li class="affiliation" data-affiliation-highlight="affiliation-2"><span itemprop="department">Dep B</span><span itemprop="name">Univ B</span><span itemprop="address">Street</span></li></ul></div>'
    sheet = '<title>X - SpringerMaterials</title>'
    entries = '<dl><dd id="authors"><ul><li>Ann Lee<sup>(a)</sup>, <a>mail</a></li><li>Bo Ray<sup title="Inst T">z</sup></li></ul></dd><dd class="author-affiliation"><ul><li>a Inst A</li></ul></dd></dl>'
    got = read(
        spark, page(item("Ann Lee", "Inst A", "Inst B", mark='<a id="corresp-c1">*</a>'), item("Bo Ray ", "Inst C"), group("Inst Z", "Zoe Zed")), page(older.format("authorsandaffiliations", "author")),
        page(group("Inst A E-mail: x", "Ann Lee, MD, Bo Ray & Cy Dee (Team)") + group("Inst B", "Ann Lee, MD & Li Wu")), page(entries, head=sheet), page(head=LINK + metas(("Lee, Ann", ""), ("Ray, Bo", "")).replace('Ann">', 'Ann"><meta name="citation_author_institution" content="Inst A Fax 12">')),
        page(older.format("editorsandaffiliations", "editor")), page(record(author=[{"@type": "Person", "name": "Ann Lee", "affiliation": [{"name": "Inst A"}]}])), page("nothing"), page(item("Ann", "X"), head=""),
    )
    assert got[0][0] == [("Ann Lee", ["Inst A", "Inst B"], True), ("Bo Ray", ["Inst C"], False)]
    assert got[1][0] == [("Ann Lee", ["Dep B, Univ B"], None)]
    assert got[2][0] == [("Ann Lee, MD", ["Inst A", "Inst B"], None), ("Bo Ray", ["Inst A"], None), ("Li Wu", ["Inst B"], None)]
    assert got[3][0] == [("Ann Lee", ["Inst A"], None), ("Bo Ray", ["Inst T"], None)]
    assert got[4][0] == [("Lee, Ann", ["Inst A "[:-1]], None), ("Ray, Bo", [], None)]
    assert got[5][0] == [("Ann Lee", ["Dep B, Univ B"], None)] and got[6][0] == [("Ann Lee", ["Inst A"], None)]
    assert got[7] == ([], None) and 8 not in got


def test_corresponding_authors(spark):
    three = item("Chen Ni", "T") + item("Bay Ngu", "T") + item("Rob J. Wright", "T")
    two = item("Anders Wahl", "T") + item("Bo E. Wahl", "T")
    mails = [{"@type": "Person", "name": n, "email": m} if m else {"@type": "Person", "name": n} for n, m in (("Chen Ni", ""), ("Bay Ngu", "b@x"))]
    got = read(
        spark, page(three, "<p>Correspondence to Rob J. Wright .</p>"), page(three, "<p>Correspondence to: Chen Ni or Bay Ngu.</p>"), page(two, head=LINK + metas(("Wahl, Anders", "a@x"), ("Wahl, Bo E.", ""))),
        page(three, head=LINK + metas(("Ni, Chen", "c@x"), ("Ngu, Bay", "b@x"), ("Wright, Rob", "r@x"))), page(three, record(author=mails)), page(three, record(author=mails), "<p>Correspondence to Rob Wright</p>"),
        page(three, '<p class="corresp">Corresponding author: Bay Ngu (<a href="mailto:b@x">mail</a>)</p>'), page(three), page(three, "<p>" + "x" * 40 + " Correspondence to Chen Ni</p>"), page(three, "<p>Correspondence to Someone Else</p>"), page(item("Li Wei", "T"), head=LINK + metas(("Wei, Li", "l@x"))),
    )
    marks = {k: [a[2] for a in v[0]] for k, v in got.items()}
    assert marks[0] == [False, False, True] and marks[1] == [True, True, False] and marks[2] == [True, False]
    assert marks[3] == [False] * 3  # all have one: tells nobody
    assert marks[4] == [False, True, False] and marks[5] == [False, False, True]  # words overrule addresses
    assert marks[6] == [False, True, False] and marks[7] == marks[8] == marks[9] == [False] * 3 and marks[10] == [True]


def test_names_once_and_without_editors(spark):
    editors = lambda *names: f'<div id="editor-information-section">Editors <p>Prof. {"</p><p>Dr. ".join(names)}</p></div>'
    short = lambda *names: '<ul class="c-article-author-list">' + "".join(f'<li><a data-test="author-name">{n}</a></li>' for n in names) + "</ul>"
    got = read(
        spark, page(item("Ann Lee "), item("ann lee", "Inst A", mark='<a id="corresp1"></a>'), item("Bo Ray", "Inst B"), item("Bo Ray", "Inst C")), page(item("Ann Lee", "A"), item("Ed Fox", "E"), editors("Ed Fox")), page(item("Ann Lee", "A"), editors("Ann Lee")),
        page(item("Ann Lee", "A"), short("Ann Lee", "Bo Ray")), page(item("Ann Lee", "A"), item("Ed Fox", "E"), short("Ann Lee")), page(item("Ed Fox", "E"), editors("Ed Fox"), short("Ann Lee", "Bo Ray")), page(short("The Team")),
    )
    assert got[0][0] == [("Ann Lee", ["Inst A"], True), ("Bo Ray", ["Inst B"], False)]
    assert [a[0] for a in got[1][0]] == ["Ann Lee"] and [a[0] for a in got[2][0]] == ["Ann Lee"]
    assert [a[:2] for a in got[3][0]] == [("Ann Lee", ["A"]), ("Bo Ray", ["A"])]
    assert [a[:2] for a in got[4][0]] == [("Ann Lee", ["A"])] and [a[0] for a in got[5][0]] == ["Ann Lee", "Bo Ray"] and [a[0] for a in got[6][0]] == ["The Team"]


def test_abstracts(spark):
    section = lambda title, *ps: f'<section data-title="{title}"><h2>{title}</h2><div class="c-article-section__content">{"".join(f"<p>{p}</p>" for p in ps)}</div></section>'
    described = lambda og, plain: LINK + f'<meta property="og:description" content="{og}"><meta name="description" content="{plain}">'
    work = '<link rel="canonical" href="https://link.springer.com/referenceworkentry/1">'
    got = read(
        spark, page(section("Abstract", "One.", "Two.")), page(section("Introduction", "First.", "Second.")), page('<section class="Abstract"><h2 class="Heading">Abstract</h2>Old <span class="CitationRef">[1]</span> text</section>'),
        page('<section class="Section1"><h2>Summary</h2><p>Opening.</p></section>'), page(head=described(LONG, LONG + " More.")), page(head=described("short", "short")), page(section("Abstract", "Shown."), record(description="   ")),
        page(section("Abstract", "Shown."), record(description="Stated, and longer.")), page(section("Abstract", "Shown, and much longer than that."), record(description="Stated.")), page(section("Background", "B."), section("Results", "R."), section("Funding", "F.")),
        page(section("Zusammenfassung", LONG)), page(section("x", "Reprints and permissions of all that stands here"), section("y", "n A word that means this and that."), head=work),
        page(section("z", "Credit: someone. " + LONG + LONG), section("w", LONG + LONG), head='<meta property="og:url" content="https://www.nature.com/1">'), page(f'<div class="main-content">Menu Abstract {LONG} View PDF rest</div>', head="<title>SpringerMaterials</title>"),
    )
    assert [got[i][1] for i in range(7)] == ["One.\nTwo.", "First.", "Old text", "Opening.", LONG + " More.", None, "Shown."]
    assert got[7][1] == "Stated, and longer." and got[8][1] == "Shown, and much longer than that." and got[9][1] == "B.\nR." and got[10][1] == LONG
    assert got[11][1] == "A word that means this and that." and got[12][1] == LONG + LONG and got[13][1] == LONG


def test_it_comes_before_the_plain_list(spark):
    df = spark.createDataFrame([(1, page(item("Ann Lee", "Inst A"))), (2, page('<ul><li class="c-article-author-list__item"><a data-test="author-name">Bo Ray</a></li></ul>')), (3, page()), (4, None)], "page_id long, html string")
    got = {r["page_id"]: (r["rule_id"], r["rung"]) for r in families.extract_pages(df).collect()}
    assert got[1] == ("springer_ladder", 1) and 3 not in got and 4 not in got
