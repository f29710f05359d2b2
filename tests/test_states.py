"""States in JSON at any depth: trees against a recursive version, and three publishers' pages of our own."""

import json
import random

from pyspark.sql import functions as F

from pagequarry.operators import families, publishers, states

NO_TEXT = states.NO_TEXT


def gather(x):
    """The same descent, by recursion."""
    if isinstance(x, list):
        return " ".join(map(gather, x))
    if isinstance(x, dict):
        if x.get("_"):
            return "" if x.get("#name") in NO_TEXT else x["_"]
        return gather(x["$$"]) if "$$" in x else ""
    return ""


def value_of(x):
    if isinstance(x, dict):
        for item in x["abstracts"] if isinstance(x.get("abstracts"), list) else []:
            if isinstance(item, dict) and item.get("value"):
                return item["value"]
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else []:
        if found := value_of(v):
            return found
    return None


def made(rnd, depth):
    if depth == 0 or rnd.random() < 0.15:
        return rnd.choice(["s", 3, None, True])
    if rnd.random() < 0.4:
        return [made(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    out = {}
    for key in rnd.sample(["_", "#name", "$$", "abstracts", "value", "other"], rnd.randint(0, 5)):
        out[key] = {"_": rnd.choice(["", "text %d" % rnd.randint(0, 99)]), "#name": rnd.choice(["para", "section-title"]), "value": "v%d" % rnd.randint(0, 99)}.get(key) if key in ("_", "#name", "value") else made(rnd, depth - 1)
    return out


def found(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    return {r["page_id"]: (r["rule_id"], [(a["name"], a["affiliations"], a["is_corresponding"]) for a in r["authors"]], r["abstract"]) for r in publishers.candidates(df).collect()}


def test_trees_as_by_recursion(spark):
    rnd = random.Random(3)
    values = [made(rnd, rnd.randint(1, 12)) for _ in range(300)]
    deep = {"_": "end"}
    for i in range(400):
        deep = {"$$": [deep, {"#name": "alt-text", "_": "no"}]} if i % 2 else {"a": 1, "$$": deep}
    values.append(deep)
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, None), (1001, ""), (1002, "{broken"), (1003, "[" * 200_000)]
    tree = spark.createDataFrame(rows, "i int, t string").select("i", states.nodes(F.col("t")).alias("n"))
    got = {r["i"]: (r["g"], r["v"]) for r in tree.select("i", states.gathered(F.col("n")).alias("g"), states.nearest_value(F.col("n")).alias("v")).collect()}
    squeeze = lambda t: " ".join(t.split())
    for i, v in enumerate(values):
        assert squeeze(got[i][0]) == squeeze(gather(v)), v
        assert got[i][1] == value_of(v), v
    assert squeeze(got[300][0]) == "end" and sum(1 for i in range(300) if got[i][1]) > 20 and sum(1 for i in range(300) if got[i][0].strip()) > 20
    assert {got[i] for i in (1000, 1001, 1002, 1003)} == {(None, None)}


def test_intervals_and_fields():
    rows = states.nodes_of('{"a": [1, {"b": null, "c": true}, "x"], "d": {}, "e": 2.5}')
    assert [(r["pre"], r["post"], r["parent"], r["depth"], r["key"], r["list"], dict(r["fields"]), r["text"]) for r in rows] == [
        (0, 5, -1, 0, None, False, {"e": "2.5"}, None), (1, 4, 0, 1, "a", True, {}, None), (2, 2, 1, 2, None, False, {}, "1"), (3, 3, 1, 2, None, False, {"b": None, "c": "true"}, None), (4, 4, 1, 2, None, False, {}, "x"), (5, 5, 0, 1, "d", False, {}, None),
    ]


def test_abstract_twelve_levels_down(spark):
    inner = {"#name": "para", "_": "Found it."}
    for k in range(12):
        inner = {"#name": f"sec{k}", "$$": [{"#name": "section-title", "_": "Title"}, inner]}
    state = json.dumps({"authors": {"content": []}, "abstracts": {"content": [inner]}})
    got = found(spark, f'<link rel="canonical" href="https://www.sciencedirect.com/1"><script type="application/json">{state}</script>')
    assert got[0] == ("science_direct", [], "Found it.")


def data(value):
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(value)}</script>'


def test_hindawi(spark):
    head = '<link rel="canonical" href="https://www.hindawi.com/1">'
    article = {
        "authors": [{"givenName": "Ann", "surName": "Lee", "email": "a@b", "affSup": [{"affId": 2}, {"affId": 1}]}, {"givenName": "Bo", "surName": "Ray", "affSup": [{"affId": 9}]}],
        "affiliations": [{"affId": 2, "addrLines": [{"line1": "Inst B", "country": "Y"}]}, {"affId": 1, "addrLines": [{"line1": "Inst A"}]}], "abstract": "We saw.",
    }
    listed = '<div class="article_authors"><span><b>Cy Dee</b><sup>1,2</sup><a href="mailto:c@d">m</a></span><span><b>Di Eck</b><sup>x</sup></span></div><div><p><sup>1</sup><span>Inst A</span></p><p><sup>2</sup><span>Inst B</span></p></div><h4 id="abstract">Abstract</h4><p>It is so.</p><p>Not this.</p>'
    got = found(spark, head + data({"props": {"pageProps": {"article": article}}}), head + listed, head, head + data({"props": 1}) + listed)
    assert got[0] == ("hindawi_state", [("Ann Lee", ["Inst B, Y", "Inst A"], True), ("Bo Ray", [], False)], "We saw.")
    assert got[1] == ("hindawi_state", [("Cy Dee", ["Inst A", "Inst B"], True), ("Di Eck", [], False)], "It is so.") and got[3] == got[1]
    assert got[2] == ("hindawi_state", [], None)


def test_sciendo(spark):
    group = lambda contrib, aff: "<p>Sciendo is a De Gruyter Company</p>" + data({"props": {"pageProps": {"product": {"articleData": {"contribGroup": {"contrib": contrib, "aff": aff}}}}}})
    person = lambda given, last, rid, **more: {"name": {"given-names": given, "surname": last}, "xref": {"rid": rid}} | more
    got = found(
        spark, group([person("Ann", "Lee", "a1", corresp="yes"), person("Bo", "Ray", "a2")], [{"id": "a1", "institution": ["Dept X", {"content": "Univ Y"}]}, {"id": "a2", "institution": "Inst Z"}]),
        group(person("Cy", "Dee", "a1"), {"id": "a1", "institution": "Inst A"}), group([], None),
    )
    assert got[0][:2] == ("sciendo_state", [("Ann Lee", ["Dept X, Univ Y"], True), ("Bo Ray", ["Inst Z"], False)])
    assert got[1][1] == [("Cy Dee", ["Inst A"], False)] and got[2][1] == []


def quoted(value):
    text = json.dumps(value)
    return '<script type="application/json">' + text.replace("&", "&a;").replace('"', "&q;").replace("<", "&l;").replace(">", "&g;") + "</script>"


def test_taylor_entries(spark):
    head = '<meta property="og:url" content="https://www.tandfonline.com/1">'
    entry = '<div class="entryAuthor"><a>{}</a>{}<span class="overlay">{}</span></div>'
    bio = '<div class="author-infos"><div class="addAuthorInfo"><h4>Bo Ray</h4><p>Bo Ray is a lecturer in the School of Law, Univ B, Town. They write.</p></div><div class="addAuthorInfo"><h4>Di Eck</h4><p>Di Eck is fond of cats.</p></div></div>'
    people = entry.format("Ann Lee", '<span class="heading">Correspondence</span>', "a Department of Law, Univ A; E-mail: x@y") + entry.format("Bo Ray", "", "<i>id</i>") + entry.format("Cy Dee", "", "View further author information") + entry.format("Di Eck", "", "")
    page = f'{head}<div class="publicationContentAuthors">{people}</div>{bio}<div class="abstractInFull">ABSTRACT Abstract We see.</div>'
    described = '<meta name="dc.Description" content="(2020). A title. J: Vol. 3, pp. 1-2."><meta name="dc.Description" content="This is a long enough description of what was found.">'
    got = found(spark, page, head + described)
    assert got[0] == ("taylor_state", [("Ann Lee", ["Department of Law, Univ A"], True), ("Bo Ray", ["School of Law, Univ B, Town"], False), ("Cy Dee", [], False), ("Di Eck", [], False)], "We see.")
    assert got[1] == ("taylor_state", [], "This is a long enough description of what was found.")


def test_taylor_chapters(spark):
    head = '<link rel="canonical" href="https://www.taylorfrancis.com/chapters/1">'
    chapter = lambda author, **more: f'<script type="application/ld+json">{json.dumps({"@type": ["Chapter", "X"], "url": "https://www.taylorfrancis.com/1", "author": author} | more)}</script>'
    product = {"product": {"meta": [{"deep": {"abstracts": [{"value": ""}, {"value": "<p>Of &amp; about.</p>"}]}}], "contributors": [{"position": 2, "roles": ["author"], "fullName": "Bo  Ray"}, {"position": 1, "roles": "author", "givenName": "Ann", "familyName": "Lee"}, {"roles": ["editor"], "fullName": "Ed Fox"}, {"position": 3, "roles": [], "fullName": "bo ray"}]}}
    got = found(
        spark, head + chapter({"givenName": "Ann, Bo", "familyName": "Lee, Ray"}, description="A chapter."), head + chapter("Ann Lee, Bo Ray"), head + chapter("x, y") + quoted(product), head + chapter([{"name": "Cy  Dee"}, {"givenName": "Di", "familyName": "Eck"}]), head,
        head + chapter("a").replace("Chapter", "Book").replace("taylorfrancis.com/1", "x.org"),
    )
    names = lambda i: [a[0] for a in got[i][1]]
    assert names(0) == ["Ann Lee", "Bo Ray"] and got[0][2] == "A chapter."
    assert names(1) == ["Ann Lee", "Bo Ray"] and names(2) == ["Ann Lee", "Bo Ray"] and got[2][2] == "Of & about."
    assert names(3) == ["Cy Dee", "Di Eck"] and got[4][1:] == ([], None) and names(5) == []


def test_ladder_reads_states(spark):
    html = '<link rel="canonical" href="https://www.hindawi.com/1">' + data({"props": {"pageProps": {"article": {"authors": [{"givenName": "Ann", "surName": "Lee", "affSup": [{"affId": 1}]}], "affiliations": [{"affId": 1, "addrLines": [{"a": "Inst A"}]}]}}}})
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    row = families.extract_pages(df).first()
    assert (row["rule_id"], row["authors"][0]["affiliations"]) == ("hindawi_state", ["Inst A"])
