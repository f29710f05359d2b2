from pyspark.sql import functions as F

from pagequarry import rules
from pagequarry.operators import corpus, dom, evaluate, extract, families

PAGE = """<html><head><title>T</title><meta name="citation_author" content="Ann Lee"><meta name="citation_author_institution" content="Inst A"><meta name="citation_author" content="Bo Ray">
<meta name="citation_author_email" content="bo@x.org"><meta name="citation_author" content="Ann  Lee"><meta name="description" content="Abstract: {long}"></head>
<body><a href="/nav">nav</a><a href="/supplement.pdf">supplement pdf</a><a href="#pdf">PDF</a><a href="article/1.pdf">Download PDF</a><p>CC BY-NC 4.0</p></body></html>""".replace("{long}", "word " * 60 + "end")


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_response(spark):
    df = pages(spark, (1, "https://j.org/a/b", PAGE), (2, "https://j.org/x", "<title>Just a moment</title>"), (3, None, None))
    got = {r["page_id"]: r for r in extract.response(df).collect()}
    assert [(a["name"], [x["name"] for x in a["affiliations"]], a["is_corresponding"]) for a in got[1]["authors"]] == [("Ann Lee", ["Inst A"], None), ("Bo Ray", [], True)]
    assert got[1]["urls"] == [("https://j.org/a/article/1.pdf", "pdf")]
    assert (got[1]["license"], got[1]["version"]) == ("cc-by-nc", "publishedVersion")
    assert got[1]["abstract"].startswith("word word")
    assert got[2]["error"] == "UnusualTraffic" and got[2]["authors"] == []
    assert got[3]["error"] == "UnusualTraffic"
    other = extract.response(df, namespace=F.lit("x")).where("page_id = 1").first()
    assert other["authors"] == [] and other["abstract"] is None


def test_fold_ignores_institution_before_author(spark):
    h = '<meta name="citation_author_institution" content="X"><meta name="citation_author" content="A">'
    got = pages(spark, (1, "", h)).select(extract.fold_metas(F.col("html")).alias("a")).first()["a"]
    assert [(a["name"], a["affiliations"]) for a in got] == [("A", [])]


def test_affiliation_join(spark):
    schema = "authors array<struct<name:string,aff_ids:array<string>,is_corresponding:boolean>>, affs array<struct<organization:string,aff_id:string>>"
    df = spark.createDataFrame([([("A", ["1", "2"], None), ("B", [], None)], [("X", "1"), ("Y", "2"), ("Z", None)]), ([("A", ["9"], True), ("B", None, None)], [("X", "1")])], schema)
    got = [[(a["name"], a["affiliations"]) for a in r["x"]] for r in df.select(extract.join_affiliations(F.col("authors"), F.col("affs")).alias("x")).collect()]
    assert got == [[("A", ["X", "Y"]), ("B", ["Z"])], [("A", ["X"]), ("B", ["X"])]]


def test_corresponding_and_editors(spark):
    df = spark.createDataFrame([([("A B", ["x"], None)],), ([("A B", [], True), ("C D", [], None)],), ([("A B", [], None), ("C D", [], None)],)], "a array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>")
    settled = [[x["is_corresponding"] for x in r["s"]] for r in df.select(extract.settle_corresponding(F.col("a")).alias("s")).collect()]
    assert settled == [[True], [True, False], [None, None]]
    kept = df.select(extract.drop_editors(F.col("a"), F.lit("edited by c d")).alias("k")).collect()
    assert [[x["name"] for x in r["k"]] for r in kept] == [["A B"], ["A B"], ["A B"]]
    marked = df.select(extract.mark_by_email(F.col("a"), F.array(F.lit("x@y"))).alias("k")).collect()
    assert marked[2]["k"][0]["is_corresponding"] is None


def test_ladder(spark):
    schema = f"page_id long, rule_id string, is_specific boolean, prefer boolean, ord int, authors array<{extract.AUTHOR}>, abstract string"
    full, bare = [("A", ["X"], None)], [("A", [], None)]
    df = spark.createDataFrame([(1, "s1", True, False, 1, bare, "t"), (1, "s2", True, False, 2, full, None), (2, "s1", True, False, 1, bare, None), (2, "generic", False, False, 9, full, None), (3, "generic", False, False, 9, [], "t"), (4, "s1", True, True, 1, bare, None), (4, "generic", False, False, 9, full, None), (5, "s1", True, False, 1, [], None)], schema)
    assert {r["page_id"]: r["rule_id"] for r in extract.ladder(df).collect()} == {1: "s2", 2: "generic", 3: "generic", 4: "s1"}


def test_dom(spark):
    h = "<ul class='authors x'><li><a class=name>Ann<b>!</b></a><li><a class=name>Bo</a></ul><p>one<p>two</i>"
    table = dom.nodes(pages(spark, (1, "", h), (2, "", None)))
    assert sorted(r["full_text"] for r in dom.texts(dom.select(table, "ul.authors a.name"), table).collect()) == ["Ann !", "Bo"]
    assert [r["depth"] for r in table.where("tag = 'p'").collect()] == [0, 0]
    assert dom.outside(table, dom.select(table, "ul")).count() == 2
    got = extract.by_css(table, "ul.authors li", "a.name").first()
    assert [a["name"] for a in got["authors"]] == ["Ann !", "Bo"]


def test_dispatch(spark):
    df = pages(spark, (1, "", '<link rel="canonical" href="https://www.sciencedirect.com/1">'), (2, "", "<p>"))
    assert [(r["page_id"], r["rule_id"]) for r in extract.dispatch(df, [r[:3] for r in families.FAMILIES]).collect()] == [(1, "elsevier")]


def test_author_matching():
    m = evaluate.match_names(["Éva Smith", "John Q. Public", "Li Wei"], ["Public, John", "Smith, E.", "Zed"])
    assert [(x["gold_index"], x["parsed_index"]) for x in sorted(m["matched"], key=lambda x: x["gold_index"])] == [(0, 1), (1, 0)]
    assert m["gold_unmatched"] == [2] and m["parsed_unmatched"] == [2]
    assert abs(m["f1"] - 2 / 3) < 1e-9
    assert evaluate.match_names([], [])["f1"] == 0.0
    assert evaluate.match_affiliations([], [])["fuzzy_f1"] == 1.0
    assert evaluate.match_affiliations(["Department of Physics, MIT"], ["Physics, MIT"])["fuzzy_f1"] == 1.0


def test_scorecards(spark):
    gold = spark.createDataFrame([("1", [("A B", ["X"], None)], "some text", "https://a.org/x.pdf", True, ["paywall"]), ("2", [], None, None, False, [])], "doi string, authors array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>, abstract string, pdf_url string, score_authors boolean, failure_modes array<string>")
    runs = spark.createDataFrame([("1", ([("B, A", [("X",)], None)], [("http://www.a.org/x.pdf", "pdf")], None, None, "some text"), None, 5.0, True, "a.org")], "doi string, parsed struct<authors:array<struct<name:string,affiliations:array<struct<name:string>>,is_corresponding:boolean>>,urls:array<struct<url:string,content_type:string>>,license:string,version:string,abstract:string>, error string, duration_ms double, html_cached boolean, publisher_domain string")
    scored = evaluate.score_rows(gold, runs)
    total = evaluate.overall(scored).first()
    assert (total["rows"], total["authors_scored_rows"], total["authors_f1_strict"], total["affiliations_f1_strict"], total["abstract_strict_match_rate"]) == (2, 1, 1.0, 1.0, 1.0)
    assert total["pdf_url_divergence_rate"] == 0.5
    assert {r["mode"]: r["rows"] for r in evaluate.per_failure_mode(scored).collect()} == {"paywall": 1, "clean": 1}
    assert {r["publisher"] for r in evaluate.per_publisher(scored).collect()} == {"a.org", "unknown"}


def test_publisher_lookup(spark):
    df = spark.createDataFrame([("10.1002/x", None, None), ("10.9999/x", "https://www.nature.com/a", None), ("10.9999/x", "https://x.biomedcentral.com/a", None), ("10.9999/x", "https://doi.org/10.9999/x", "Wiley Inc"), (None, None, None)], "d string, u string, r string")
    assert [r["p"] for r in df.select(corpus.publisher_of(F.col("d"), F.col("u"), F.col("r")).alias("p")).collect()] == ["wiley", "springer", "springer", "wiley", "unknown"]


def test_claims(spark):
    tasks = spark.createDataFrame([("t1", "p", "f", "ready", "needs_agent", 0, 1), ("t2", "p", "f", "ready", "needs_agent", 0, 2), ("t3", "p", "f", "ready", "done", 0, 3), ("t4", "p", "f", "goldie-backfilled", rules.REOPENING[0], 5, 4), ("t5", "p", "f", "ready", None, 0, 5)], "task_id string, publisher_id string, field string, queue_type string, status string, gold_empty_parser_present int, pos int")
    claims = spark.createDataFrame([("t1", "released", 1), ("t1", "in_progress", 2), ("t2", "in_progress", 1), ("t2", "released", 2)], "task_id string, status string, pos int")
    assert [r["task_id"] for r in corpus.claim(tasks, claims, 9, "a", "r").orderBy("task_id").collect()] == ["t2", "t4", "t5"]
    assert corpus.claim(tasks, claims, 1, "a", "r").count() == 1


def test_gate_and_candidates(spark):
    run = lambda **v: spark.createDataFrame(list(v.items()), "metric string, value double")
    got = {r["metric"]: r["regressed"] for r in corpus.gate(run(a=0.9, b=0.9, c=0.5), run(a=0.88, b=0.895)).collect()}
    assert got == {"a": True, "b": False}
    found = spark.createDataFrame([("D1", "f", "2"), ("d1", "f", "1"), ("d2", "f", "1"), ("d3", "g", "1")], "doi string, field string, proposed_at string")
    ledger = spark.createDataFrame([("D2", "f")], "doi string, field string")
    assert sorted((r["doi"], r["field"]) for r in corpus.new_candidates(found, ledger).collect()) == [("d1", "f"), ("d3", "g")]


def test_grounding_and_repairs(spark):
    page = "the quick brown fox jumps over the lazy dog and then it sleeps under a big tree"
    df = spark.createDataFrame([("Brown fox, jumps", page), ("dog lazy quick nothing", page), ("zebra", page)], "g string, p string")
    assert [r["x"] for r in df.select(corpus.grounded(F.col("g"), F.col("p")).alias("x")).collect()] == ["exact", "tokens", None]
    long = "w" * 150
    rows = spark.createDataFrame([(long, long + " more" * 40), ("short", long), (None, long), ("cut " * 40 + "...", long)], "g string, p string")
    assert [r["x"] for r in rows.select(corpus.repair_prefix(F.col("g"), F.col("p")).alias("x")).collect()] == ["replace", "gold_short", "gold_empty", "gold_ellipsis"]


def test_queue_type(spark):
    df = spark.createDataFrame([("supported", 3, 5, 0, 5, 0.5), ("unknown", 0, 5, 0, 5, 0.5), ("supported", 0, 0, 4, 0, 0.0), ("supported", 0, 5, 0, 5, 0.99), ("generic_only", 0, 5, 0, 5, 0.5)], "c string, b int, h int, r int, s int, k double")
    got = [r["x"]["queue_type"] for r in df.select(corpus.queue_type(*[F.col(x) for x in "cbhrsk"]).alias("x")).collect()]
    assert got == ["goldie-backfilled", "unknown", "harvest-blocked", "ready", "onboarding"]
