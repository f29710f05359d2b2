import json

from pyspark.sql import functions as F

from pagequarry.functions import html
from pagequarry.operators import people, repositories

AUTHOR = "array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>"


def run(spark, c, schema, *values):
    return spark.createDataFrame([values], schema).select(c.alias("x")).first()["x"]


def plain(authors):
    return [tuple(a) for a in authors]


def test_letters(spark):
    got = run(spark, people.by_letters(F.col("a"), F.col("p")), "a array<struct<name:string,refs:array<string>,is_corresponding:boolean>>, p array<struct<label:string,organization:string>>", [("A", ["a", " b ", "a"], None), ("B", [], True), ("C", ["z"], None)], [("a", "X"), ("b", "Y"), ("", "Z"), ("a", "X2")])
    assert plain(got) == [("A", ["X2", "Y"], None), ("B", ["Z"], True), ("C", ["Z"], None)]


def test_surnames_and_addresses(spark):
    authors = [("Ann Lee", [], None), ("Bob Ray", ["U"], None), ("Cy Lee", [], None)]
    got = run(spark, people.fill_by_surname(F.col("a"), F.col("k")), f"a {AUTHOR}, k array<struct<surname:string,affiliations:array<string>,is_corresponding:boolean>>", authors[:2], [("Lee", ["V"], True), ("Ray", ["W"], False)])
    assert plain(got) == [("Ann Lee", ["V"], True), ("Bob Ray", ["U"], None)]
    assert [a["is_corresponding"] for a in run(spark, people.mark_emailed(F.col("a"), F.col("e")), f"a {AUTHOR}, e array<string>", authors, ["X Ray"])] == [None, True, None]
    mark = lambda emailed: [a["is_corresponding"] for a in run(spark, people.mark_if_telling(F.col("a"), F.col("e")), f"a {AUTHOR}, e array<string>", authors, emailed)]
    assert mark(["A. Lee"]) == [True, False, False] and mark(["B. Ray"]) == [False, True, False] and mark(["X. Ray"]) == [False, True, False] and mark(["X. Lee"]) == [None] * 3 and mark(["A Lee", "C Lee", "B Ray"]) == [None] * 3


def test_names_in_notes_and_initials(spark):
    authors = [("Ann Lee", ["Ann Lee is at X", "U"], None), ("Bob Ray", ["Ann Lee is at X", "U"], None)]
    assert plain(run(spark, people.own_affiliations(F.col("a"), F.col("n")), f"a {AUTHOR}, n array<string>", authors, ["Ann Lee is at X", "U"])) == [("Ann Lee", ["U", "Ann Lee is at X"], None), ("Bob Ray", ["U"], None)]
    names = {"Ann B. Lee": "A.B.L.", "Lee, Ann B": "A.B.L.", "Jean-Paul Sar": "J.-P.S."}
    assert {n: run(spark, people.initials(F.col("n")), "n string", n) for n in names} == names
    bare = [("Ann B. Lee", [], None), ("Bob Ray", [], None)]
    get = lambda prose: plain(run(spark, people.by_initials(F.col("a"), F.col("p")), f"a {AUTHOR}, p string", bare, prose))
    assert get("From Hospital X, Town (A.B.L., C.D.); and the University Y (B.R.)") == [("Ann B. Lee", ["Hospital X, Town"], None), ("Bob Ray", ["University Y"], None)]
    assert get("Hospital X") == [("Ann B. Lee", ["Hospital X"], None), ("Bob Ray", ["Hospital X"], None)]


def test_lists_that_repair_each_other(spark):
    authors = [("Ann Lee", ["U"], True), ("Bob Ray", [], None)]
    get = lambda short, editors=None: plain(run(spark, people.repaired(F.col("a"), F.col("s"), F.col("e")), f"a {AUTHOR}, s array<string>, e string", authors, short, editors))
    assert get(["Ann Lee", "Bob Ray", "Cy Moe"]) == [("Ann Lee", ["U"], True), ("Bob Ray", [], None), ("Cy Moe", ["U"], None)]
    assert get(["Bob Ray"]) == [("Bob Ray", [], None)] and get([]) == plain(authors) and get(["Cy Moe", "Ann Lee"]) == plain(authors)
    assert get(["Cy Moe"], "edited by ann lee and bob ray") == [("Cy Moe", [], None)]
    assert len(run(spark, people.longer_list(F.col("a"), F.col("b"), F.col("g")), f"a {AUTHOR}, b {AUTHOR}, g {AUTHOR}", authors, authors[:1], [("G", [], None)])) == 3
    assert run(spark, people.longest(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string", "xx", None, "yyy") == "yyy"


PAGES = [
    (1, '<div class="x"><p>Ann Lee, Bob Ray</p><div><p>Correspondence to:</p><p>Ann Lee, a@b.org</p></div></div>'),
    (2, '<p>Correspondence to</p><p>Ann Lee and Bob Ray</p>'),
    (3, '<div class="authors">Ann Lee 1,*, Bob Ray 2</div><p>* Corresponding author: a@b.org</p>'),
    (4, '<div class="authors">Ann Lee*, Bob Ray*</div><p>* contributed equally</p>'),
    (5, "<p>nothing</p>"), (6, None),
]


def test_blocks_and_stars(spark):
    pages = spark.createDataFrame([(k, h and f"<body><article>{h}</article></body>") for k, h in PAGES], "page_id long, html string")
    authors = pages.select("page_id", F.array(*[F.struct(F.lit(n).alias("name"), F.array().cast("array<string>").alias("affiliations"), F.lit(None).cast("boolean").alias("is_corresponding")) for n in ("Ann Lee", "Bob Ray")]).alias("authors"))
    assert {tuple(r) for r in people.corresponding_blocks(pages, authors).collect()} == {(1, "Ann Lee")}
    assert {tuple(r) for r in people.starred_authors(pages, authors).collect()} == {(3, "Ann Lee")}
    got = {r["page_id"]: [a["is_corresponding"] for a in r["authors"]] for r in people.marked(authors, people.corresponding_blocks(pages, authors)).collect()}
    assert got[1] == [True, False] and got[2] == [None, None]
    alone = authors.select("page_id", F.slice("authors", 1, 1).alias("authors"))
    assert {tuple(r) for r in people.corresponding_blocks(pages, alone).collect()} >= {(1, "Ann Lee")}


def test_page_states(spark):
    state = {"a": 'x "y" z', "b": [1, 2]}
    literal = json.dumps(state).replace("\\", "\\\\").replace('"', '\\"')
    for page in (f'<script type="application/json">{json.dumps(state)}</script>', f'<script type="application/json">{json.dumps(json.dumps(state))}</script>', f"<script>window.__PRELOADED_STATE__ = {json.dumps(state)};</script>", f'<script>window.__PRELOADED_STATE__ = JSON.parse("{literal}");</script>'):
        assert json.loads(run(spark, html.preloaded_state(F.col("h")), "h string", page)) == state, page
    assert run(spark, html.preloaded_state(F.col("h")), "h string", "<p>") is None
    assert run(spark, html.next_data(F.col("h"), "$.props.pageProps.article.abstract"), "h string", '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"article":{"abstract":"A"}}}}</script>') == "A"
    assert json.loads(run(spark, html.quoted_json(F.col("t")), "t string", "{&q;product&q;:&q;a &l;b&g; &a;amp; it&s;s&q;}")) == {"product": "a <b> &amp; it's"}


def test_repositories(spark):
    og = lambda u: f'<meta property="og:url" content="https://{u}">'
    popup = '&lt;a href=&quot;/s&quot;&gt;CNRS&lt;/a&gt; &lt;small&gt;(Lab)&lt;/small&gt;'
    rows = [
        (1, og("dergipark.org.tr/x") + '<p id="author1">Ann Lee <small>small</small><span>Uni X</span><span>0000-0001-5927-598X</span><span>Turkey</span></p><p id="author2">Bob</p>'),
        (2, og("doaj.org/article/1") + '<dl id="authors-affiliations"><dt>Ann Lee</dt><dd>Uni X</dd><dd>Uni Y</dd><dt>Bob Ray</dt></dl><dl><dt>Other</dt></dl>'),
        (3, '<link rel="canonical" href="https://econpapers.repec.org/RePEc:x"><meta name="citation_publication_date" content="2006">'),
        (4, '<link rel="canonical" href="https://www.osti.gov/pages/biblio/1"><meta name="citation_author" content="Lee, Ann"><meta name="citation_author_institution" content="Lab A; Univ B"><dl><dt>Resource Type:</dt><dd>Journal Article</dd><dt>Publication Date:</dt><dd>2018</dd></dl>'),
        (5, og("zenodo.org/record/1") + '<script type="application/ld+json">{"creator":[{"@type":"Person","name":"Ann","affiliation":"X"},{"@type":"Organization","name":"O"},{"@type":"Person","name":"Bob","affiliation":["Y","Z"]}]}</script>'),
        (6, f'<meta name="DC.identifier" content="hal-123"><div class="authors"><a>Ann Lee</a><sup>1, 2</sup><a>Bob Ray</a></div><div class="structures"><span>1</span><i data-content="{popup}"></i><span>2</span><i data-content="{popup.replace("CNRS", "INRIA")}"></i></div>'),
        (7, '<meta name="citation_author" content="Gen">'), (8, None),
    ]
    pages = spark.createDataFrame([(k, h and f"<html><body>{h}</body></html>") for k, h in rows], "page_id long, html string")
    got = {r["page_id"]: r for r in repositories.read(pages).collect()}
    assert {k: r["rule_id"] for k, r in got.items()} == {1: "dergipark", 2: "doaj", 3: "econpapers", 4: "osti", 5: "zenodo", 6: "hal"}
    people_of = {k: [(a["name"], a["affiliations"]) for a in r["authors"]] for k, r in got.items()}
    assert people_of == {
        1: [("Ann Lee", ["Uni X"]), ("Bob", [])], 2: [("Ann Lee", ["Uni X", "Uni Y"]), ("Bob Ray", [])], 3: [], 4: [("Lee, Ann", ["Lab A", "Univ B"])], 5: [("Ann", ["X"]), ("Bob", ["Y", "Z"])], 6: [("Ann Lee", ["CNRS (Lab)", "INRIA (Lab)"]), ("Bob Ray", [])],
    }
    assert (got[3]["published_date"], got[4]["published_date"], got[4]["genre"]) == ("2006", "2018", "Journal Article")
    assert {r["page_id"]: (r["rule_id"], len(r["authors"])) for r in repositories.ladder(pages).collect()} == {1: ("dergipark", 2), 2: ("doaj", 2), 3: ("generic", 0), 4: ("osti", 1), 5: ("zenodo", 2), 6: ("hal", 2), 7: ("generic", 1), 8: ("generic", 0)}
