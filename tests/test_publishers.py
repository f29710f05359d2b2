import json

from pyspark.sql import functions as F

from pagequarry.operators import families, publishers


def found(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    rows = publishers.candidates(df).collect()
    return {r["page_id"]: (r["rule_id"], [(a["name"], a["affiliations"], a["is_corresponding"]) for a in r["authors"]], r["abstract"]) for r in rows}


ACS = """<html><head><meta property="og:url" content="https://pubs.acs.org/doi/1"></head><body><ul class="loa"><li><div class="loa-info-name">Ann Lee</div><div class="loa-info-affiliations"><div>Inst A</div></div></li><li>, </li>
<li><span class="hlFld-ContribAuthor">Bo Ray</span><span class="author-aff-symbol">&#8224;</span></li><li> and </li><li><span class="hlFld-ContribAuthor">Cy Dee</span><span class="author-xref-symbol">*</span></li></ul>
<div class="aff-info"><span class="aff-symbol">&#8224;</span><span class="aff-text">Inst B</span></div><div class="aff-info"><span class="aff-text">Inst C</span></div>
<div><p>Correspondence to <a href="mailto:BRay@x.org?subject=1">mail</a></p></div><div><div><div><div><div><div><div><a href="mailto:ann.lee@x.org">mail</a></div></div></div></div></div></div></div>
<div class="article_abstract-content" id="abstractBox"><p>What we found.</p></div></body></html>"""


def test_symbols_and_addresses(spark):
    got = found(spark, ACS, None, "", "<p>other</p>")
    assert sorted(got) == [0]
    assert got[0] == ("acs", [("Ann Lee", ["Inst A"], False), ("Bo Ray", ["Inst B"], True), ("Cy Dee", ["Inst B", "Inst C"], True)], "What we found.")


def test_owners_of_addresses(spark):
    cases = [("ann.lee", "Ann Lee", True), ("alee2", "Ann Lee", True), ("leea", "Ann Lee", True), ("a.b.lee", "Ann Lee", True), ("lee", "Ann Lee", False), ("lovelace1", "Ada Lovelace", True), ("al", "Ann Lee", True), ("office", "Ann Lee", False), ("x", "", False), ("ray", "B. (Bo) Ray", False)]
    rows = spark.createDataFrame([(i, m, n) for i, (m, n, _) in enumerate(cases)], "i int, m string, n string").select("i", publishers.owner(F.col("m"), F.col("n")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in rows] == [c[2] for c in cases]


def node(name, text=None, children=None, **attrs):
    return {"#name": name} | ({"_": text} if text is not None else {}) | ({"$": attrs} if attrs else {}) | ({"$$": children} if children else {})


def person(given, family, *more):
    return node("author", None, [node("given-name", given), node("surname", family), *more])


def science(authors, abstracts=()):
    state = {"authors": {"content": authors}, "abstracts": {"content": list(abstracts)}}
    return f'<html><head><link rel="canonical" href="https://www.sciencedirect.com/1"></head><body><script type="application/json">{json.dumps(state)}</script></body></html>'


def test_state(spark):
    places = [node("affiliation", None, [node("textfn", "Inst A")], id="a1"), node("affiliation", None, [node("textfn", "Inst B")], id="a2")]
    labelled = node("author-group", None, [person("Ann", "Lee", node("cross-ref", refid="a2"), node("cross-ref", refid="c1")), person("Bo", "Ray", node("e-address", "b@r")), *places, node("correspondence", None, [], id="c1")])
    shared = node("author-group", None, [person("Cy", "Dee", node("e-address", "c@d")), person("Di", "Eck", node("cross-ref", refid="f1")), *places, node("footnote", None, [node("note-para", "Corresponding author.")], id="f1")])
    inner = node("author-group", None, [node("collaboration", None, [node("text", "Team"), node("author-group", None, [person("Ed", "Fox")])])])
    abstract = node("abstract", None, [node("section-title", "Abstract"), node("abstract-sec", None, [node("simple-para", "One  thing."), node("para", None, [node("__text__", "Another.")])])])
    got = found(spark, science([labelled], [abstract]), science([shared]), science([inner]), science([]), '<link rel="canonical" href="https://www.sciencedirect.com/1"><script type="application/json">{broken</script>')
    assert got[0] == ("science_direct", [("Ann Lee", ["Inst B"], True), ("Bo Ray", [], False)], "One thing. Another.")
    assert got[1][1] == [("Cy Dee", ["Inst A", "Inst B"], True), ("Di Eck", ["Inst A", "Inst B"], True)]
    assert got[2][1] == [("Ed Fox", [], False)]
    assert got[3][1:] == ([], None) and got[4][1:] == ([], None)


def test_shown_groups_beat_a_shorter_state(spark):
    group = '<div class="author-group"><span class="given-name">{}</span> <span class="text surname">{}</span><dl class="affiliation"><dd>Inst {}</dd></dl>{}</div>'
    page = science([node("author-group", None, [person("Ann", "Lee")])]).replace("<body>", "<body>" + group.format("Ann", "Lee", "A", '<svg title="Corresponding author"></svg>') + group.format("Bo", "Ray", "B", "") + '<div class="abstract author"><p>First.</p><p>Second.</p></div>')
    folded = science([node("author-group", None, [person("Ann", "Lee")])]).replace("<body>", "<body>" + group.format("Zoe", "Only", "Z", "") + '<div class="author-collaboration"><div class="author-group"><span class="button-link-text">Team Member</span><dl class="affiliation"><dd>Inst T</dd></dl></div></div>')
    got = found(spark, page, folded)
    assert got[0][1:] == ([("Ann Lee", ["Inst A"], True), ("Bo Ray", ["Inst B"], False)], "First.\nSecond.")
    assert got[1][1] == [("Ann Lee", [], False), ("Team Member", ["Inst T"], None)]


def wiley(*cards):
    return '<meta property="og:url" content="https://onlinelibrary.wiley.com/1"><div class="loa-authors">' + "".join(f'<span class="accordion__closed"><a>{n}</a><div class="author-info">{body}</div></span>' for n, body in cards) + "</div>"


def test_types_and_mail_links(spark):
    typed, mail = '<p class="author-type">Corresponding Author</p>', '<a href="mailto:a@b">Email</a>'
    got = found(
        spark, wiley(("Ann Lee", typed + "<p>Inst A</p>" + mail), ("Bo Ray", "<p>Inst B</p><p>Correspondence to nobody</p>"), ("Cy Dee", "<p>Authors are with Inst C, Fax 12</p>" + mail)),
        wiley(("Ann Lee", typed + "<p>Inst A</p>"), ("Bo Ray", typed + "<p>Inst B</p>")), wiley(("Ann Lee", "<p>Inst A</p>"), ("Bo Ray", '<p class="author-affiliation">Inst B</p>' + mail)), wiley(),
    )
    assert got[0][1] == [("Ann Lee", ["Inst A"], True), ("Bo Ray", ["Inst B"], True), ("Cy Dee", ["Inst C,"], False)]
    assert got[1][1] == [("Ann Lee", ["Inst A"], True), ("Bo Ray", ["Inst B"], False)]
    assert got[2][1] == [("Ann Lee", ["Inst A"], False), ("Bo Ray", ["Inst B"], True)]
    assert got[3][1] == []


def test_roles(spark):
    head = '<meta property="og:url" content="https://www.cambridge.org/1"><h1 class="chapter-title">T</h1>'
    row = '<div class="row contributor-type"><span class="contributor-type__label">{}</span><a class="more-by-this-author">{}</a><span class="affiliation">{}</span></div>'
    by, edited, plain = row.format("By", "Ann Lee", "Inst A"), row.format("Edited by", "Bo Ray", "Inst B"), row.format("", "Cy Dee", "")
    detail = '<div class="row author"><dt>Cy Dee</dt><div class="d-sm-flex">Inst D, email: c@d.org</div></div>'
    got = found(spark, head + edited + plain + by + by, head + edited + plain + detail, head + edited, by.join([head.replace("chapter-title", "x"), ""]))
    assert got[0] == ("cup_roles", [("Ann Lee", ["Inst A"], False)], None)
    assert got[1][1] == [("Cy Dee", ["Inst D"], False)]
    assert got[2][1] == [("Bo Ray", ["Inst B"], False)]
    assert got[3][1] == []


def test_ladder_takes_them_first(spark):
    df = spark.createDataFrame([(1, ACS), (1, ACS)], "page_id long, html string").limit(1)
    assert families.extract_pages(df).first()["rule_id"] == "acs"
