"""Lists of authors that run on as mixed text: the walk against a plain loop, and five publishers' pages of our own."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import families, folds, publishers, selectors

ROWS = [("", "", r"^\s*$", "skip"), ("", "", "", "open"), ("b", "x", "", "replace"), ("b", "", "", "begin"), ("sup", "", r"\d", "label"), ("sup", "", "", "label_end"), ("p", "", "", "end"), ("li", "", "", "share")]


def plainly(nodes, unfinished):
    done, open_, block, shared = [], None, 0, False
    for tag, classes, text in nodes:
        way = next((d for t, c, p, d in ROWS if t == tag and (not c or c in classes) and (p != r"^\s*$" or not text.strip()) and (p != r"\d" or any(x.isdigit() for x in text))), "skip")
        if way in ("open", "replace") or (way == "begin" and open_ is None):
            if way == "open" and open_:
                done.append(open_)
            block, shared = block + shared, False
            open_ = (text, [], False, block)
        elif way in ("label", "label_end") and open_:
            open_[1].append(text)
        elif way == "share":
            done += [e for e in (open_, (text, [], True, block)) if e]
            open_, shared = None, True
        if way in ("end", "label_end") and open_:
            done.append(open_)
            open_ = None
    return done + [open_] if unfinished and open_ else done


def test_walk_as_a_plain_loop(spark):
    rnd = random.Random(5)
    kinds = [("", [], "Ann"), ("", [], " "), ("b", ["x"], "Bo"), ("b", [], "Cy"), ("sup", [], "1"), ("sup", [], "*"), ("p", [], ""), ("li", [], "Inst"), ("i", [], "z")]
    lists = [[rnd.choice(kinds) for _ in range(rnd.randint(0, 14))] for _ in range(120)]
    rows = [(i, [(j, j, *n) for j, n in enumerate(ns)]) for i, ns in enumerate(lists)] + [(999, None)]
    df = spark.createDataFrame(rows, f"i int, nodes array<{selectors.NODE}>")
    for unfinished in (True, False):
        got = {r["i"]: [(e["name"], e["labels"], e["shared"], e["block"]) for e in r["w"]] for r in df.select("i", folds.walk(F.col("nodes"), ROWS, unfinished).alias("w")).collect()}
        assert got.pop(999) == []
        assert got == {i: plainly(ns, unfinished) for i, ns in enumerate(lists)}


def test_nodes_of_a_list():
    got = selectors.read("<div id=a>One<sup class='k l'>1</sup> , <p>Two <b>x</b></p><br>end<script>no</script></div>", selectors.Automaton({"r": {"+list": "#a"}}), ["r"])["r"]
    assert [(n["tag"], n["text"]) for n in got[0]["nodes"]] == [("", "One"), ("sup", "1"), ("", ","), ("p", "Two x"), ("br", ""), ("", "end"), ("script", "")]
    assert got[0]["role"] == "list" and got[0]["nodes"][1]["classes"] == ["k", "l"]
    assert selectors.read("<div id=a></div>", selectors.Automaton({"r": {"+list": "#a", "b": "b"}}), ["r"])["r"][0]["nodes"] == []


def page(head, *body):
    return f"<html><head>{head}</head><body>{''.join(body)}</body></html>"


def url(u):
    return f'<meta property="og:url" content="https://{u}/1">'


def metas(**kinds):
    return "".join(f'<meta name="citation_{k}" content="{v}">' for k, vs in kinds.items() for v in vs)


def read(spark, *htmls):
    rows = publishers.candidates(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")).collect()
    return {r["page_id"]: ([(a["name"], a["affiliations"], a["is_corresponding"]) for a in r["authors"]], r["abstract"]) for r in rows}


def test_lists_that_labels_end(spark):
    head = url("www.karger.com")
    running = '<span class="autoren">Lee A.<sup>a,b</sup>,<a>Ray B.</a><sup>b, c</sup>; Cho D.<span>x</span>Unended E.</span>'
    places = '<div id="cAffi"><sup>a</sup>Inst A<br>\n<sup>b</sup>Inst B<br></div>'
    abstract = "<div><h2>Abstract</h2><div>no</div><p>What it says.</p></div><p>other</p>"
    card = '<div class="al-author-name"><a>Ann Lee</a><div class="info-card-affilitation"><div class="aff"><span>a</span>Inst A, <i>Town</i></div></div><div class="info-card-footnote">c</div></div><div class="al-author-name"><a>Bo Ray</a></div>'
    got = read(spark, page(head, running, places, abstract), page(head, running, "<div id=cAffi>Only one</div>"), page(head, card), page(head, running), page(head))
    assert got[0] == ([("Lee A.", ["Inst A", "Inst B"], None), ("Ray B.", ["Inst B"], None), ("Cho D.", [], None)], "What it says.")
    assert [a[1] for a in got[1][0]] == [["Only one"]] * 3
    assert got[2] == ([("Ann Lee", ["Inst A, Town"], True), ("Bo Ray", [], False)], None)
    assert [a[1] for a in got[3][0]] == [[]] * 3 and got[4] == ([], None)


def test_stars_behind_names(spark):
    head = url("www.publish.csiro.au") + metas(author=["Ann Lee", "Bo Ray"])
    starred = '<div class="editors">Ann Lee <sup>A</sup>, and Bo Ray <sup>B</sup><sup>*</sup>.</div>'
    told = '<div class="editors">Ann Lee <sup>A</sup><sup>C</sup> and Bo Ray <sup>B</sup><sup>X</sup></div><div id="full-description"><p><sup>A</sup>Inst A.</p><p><sup>B</sup> Inst B</p><p><sup>C</sup>Corresponding author.</p><p>plain</p></div>'
    got = read(spark, page(head, starred), page(head, told), page(head))
    assert got[0][0] == [("Ann Lee", [], None), ("Bo Ray", [], True)]
    assert got[1][0] == [("Ann Lee", ["Inst A."], True), ("Bo Ray", ["Inst B"], None)]
    assert got[2][0] == [("Ann Lee", [], None), ("Bo Ray", [], None)]


def test_blocks_that_share_places(spark):
    head = url("aip.scitation.org")
    one = lambda n: f'<span class="contrib-author"><a>{n}</a> more</span>'
    aff = lambda n: f'<span class="author-affiliation">{n}</span>'
    blocks = '<div class="entryAuthor">' + one("Ann Lee") + one("Bo Ray") + aff("Inst A") + aff("Inst B") + one("Cy Oh") + aff("Inst C") + one("Di Po") + "</div>"
    numbered = '<div class="publicationContentAuthors"><span class="contrib-author"><a href="/author/x">Ann Lee</a><sup>1,a)</sup></span><span class="contrib-author"><a href="/author/y">Bo Ray</a><sup>2</sup></span></div><div class="affiliations-list"><ul><li class="author-affiliation">1Inst A</li><li class="author-affiliation">2 Inst B</li></ul></div><corresp><sup>a)</sup>mail</corresp>'
    got = read(spark, page(head, blocks), page(head, numbered))
    assert got[0][0] == [("Ann Lee", ["Inst A", "Inst B"], None), ("Bo Ray", ["Inst A", "Inst B"], None), ("Cy Oh", ["Inst C"], None), ("Di Po", [], None)]
    assert got[1][0] == [("Ann Lee", ["Inst A"], True), ("Bo Ray", ["Inst B"], False)]


def test_numbers_that_name_places(spark):
    head = url("www.thieme-connect.de")
    linked = '<span class="authors">H Say <a href="#1"><sup><b>1</b></sup></a><sup>,</sup><a href="#2"><sup>2</sup></a>, J Chu-Lang <a href="#2"><sup>2</sup></a><div class="authorsAffiliationsList"><ul><li><sup>1</sup>Group One</li><li>2 Group Two</li></ul></div></span>'
    together = '<div class="authors">P. Daru, E. Huss</div><ul class="authorsAffiliationsList"><li>Dept, City</li></ul>'
    spans = '<span class="author">A. Brun <div class="affiliation">1 Abteilung A</div>,</span><span class="author">S. De Bro 2<div class="affiliation">2 Institut B</div></span>'
    text = "What was found is told in more than fifty characters, which is the least."
    got = read(
        spark, page(head + metas(author_email=["jchulang@x.org"]), linked), page(head + metas(author=["P. Daru", "E. Huss"]), together), page(head, spans),
        page('<meta name="description" content="Thieme E-Books">' + metas(author=["A. B"], author_institution=["Inst A"]), f'<div id="abstract">PDF Download Permissions and Reprints Summary: {text} Key words: a, b</div>'), page('<meta name="description" content="By Thieme">', linked),
    )
    assert got[0][0] == [("H Say", ["Group One", "Group Two"], False), ("J Chu-Lang", ["Group Two"], True)]
    assert got[1][0] == [("P. Daru", ["Dept, City"], None), ("E. Huss", ["Dept, City"], None)]
    assert got[2][0] == [("A. Brun", ["Abteilung A"], None), ("S. De Bro", ["Institut B"], None)]
    assert got[3] == ([("A. B", ["Inst A"], None)], text)
    assert 4 not in got


def test_places_that_name_their_author(spark):
    head = url("journals.lww.com")
    holder = lambda x: f'<div class="ejp-article-authors-info-holder">{x}</div>'
    listed = '<div id="ejp-article-authors"><p>Lee, Ann MD<sup>∗</sup><sup>1</sup>; Ray, Bo<sup>2</sup>; Cho, Di; Editor: Po, Su</p></div>'
    got = read(
        spark, page(head, listed, holder("<p><sup>1</sup><em>Inst A</em></p><p><sup>2</sup>Inst B,</p><p>Received May 1</p>")), page(head, '<div id="ejp-article-authors"><p>Lee, Ann; Ray, Bo</p></div>', holder("<p>From Inst A (Ann Lee); Inst B (Bo Ray); Inst C</p>"), "<p>Correspondence to: Bo Ray</p>"),
        page(head, listed, holder("<span><sup>1</sup>Some Institute</span>")), page(head, listed, holder("<p>; University, City</p>")),
        page(head, '<div class="al-author-name"><a class="linked-name">Ann Lee</a></div><div class="al-author-name"><a class="linked-name">Bo Ray</a></div><div class="article-footnote">(Lee, Ray) Inst A <a href="mailto:bray@x.org">m</a></div><div class="article-footnote">(Lee) Inst B</div>', f"<section id=abstractWrap>Abstract {'word ' * 30}</section>"),
    )
    assert got[0][0] == [("Lee, Ann MD", ["Inst A"], True), ("Ray, Bo", ["Inst B"], None), ("Cho, Di", [], None)]
    assert got[1][0] == [("Lee, Ann", ["Inst C", "Inst A (Ann Lee)"], None), ("Ray, Bo", ["Inst C", "Inst B (Bo Ray)"], True)]
    assert [a[0] for a in got[2][0]] == ["Lee, Ann MD", "Ray, Bo", "Cho, Di"] and [a[1] for a in got[3][0]] == [["University, City"]] * 3
    assert got[4] == ([("Ann Lee", ["Inst A", "Inst B"], False), ("Bo Ray", ["Inst A"], True)], ("word " * 30).strip())


def test_lists_come_before_the_publishers_plain_rules(spark):
    html = page(url("www.karger.com"), '<div class="al-author-name"><a>Ann Lee</a><div class="info-card-affilitation"><div class="aff"><span>a</span>Inst A</div></div></div>')
    row = families.extract_pages(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r["page_id"], r["rule_id"], r["authors"][0]["affiliations"]) for r in row if r["authors"]] == [(1, "karger_fold", ["Inst A"])]
