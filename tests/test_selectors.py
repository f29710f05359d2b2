"""The selector automaton against plain matching, and the structural joins against comparing all pairs."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import dom, selectors

CASES = ["a", ".x", "#i", "a.x", "*", "div a", "div > a", "p + a", "p ~ a", "div p > a.x", "[k]", "[k=v1]", "[k*=1]", "a[k^='v']", 'a[k$="2"]', "[class~=y]", "[k/='^v[12]$']", "a, p.y", "div div a", "div.x p + a, #i > *", "ul li:x".replace(":x", ""), "div > div > p ~ a.y"]


def grown(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(1, 4)):
        tag = rnd.choice(["a", "p", "div", "ul", "li"] if depth < 5 else ["a"])
        classes = " ".join(rnd.sample("xyz", rnd.randint(0, 2)))
        attrs = (f' class="{classes}"' if classes else "") + (f' k="v{rnd.randint(1, 3)}"' if rnd.random() < 0.4 else "") + (' id="i"' if rnd.random() < 0.1 else "")
        inner = grown(rnd, depth + 1) if tag in ("div", "ul") else f"t{rnd.randint(0, 99)}"
        out.append(f"<{tag}{attrs}>{inner}</{tag}>")
    return " ".join(out)


def plainly(rows, selector):
    """The pre numbers of what a selector reaches, by trying each element, step by step from the last."""
    def reaches(at, steps):
        row, attrs = rows[at], dict(rows[at][6])
        if not steps[-1].fits(row[5], attrs, attrs.get("class", "").split()):
            return False
        if len(steps) == 1:
            return True
        join, rest, parent = steps[-1].join, steps[:-1], row[1]
        above = []
        while parent >= 0:
            above.append(parent)
            parent = rows[parent][1]
        before = [i for i in range(at) if rows[i][1] == row[1]]
        where = {" ": above, ">": above[:1], "+": before[-1:], "~": before}[join]
        return any(reaches(i, rest) for i in where)

    return [i for i in range(len(rows)) if any(reaches(i, steps) for steps in selectors.steps_of(selector))]


def test_automaton_against_trying_each_element():
    rnd = random.Random(3)
    machine = selectors.Automaton({f"r{i}": {"m": s} for i, s in enumerate(CASES)})
    for _ in range(60):
        html = grown(rnd)
        tree = dom.Tree()
        tree.feed(html)
        rows = tree.finish()
        got = selectors.read(html, machine, [f"r{i}" for i in range(len(CASES))])
        for i, s in enumerate(CASES):
            assert [m["pre"] for m in got.get(f"r{i}", [])] == plainly(rows, s), (s, html)
        one = selectors.read(html, machine, ["r0", "no such rule"])
        assert set(one) <= {"r0"} and one.get("r0") == got.get("r0")


def test_parts_rests_and_texts():
    rules = {"r": {"author": "li", "author/name": "b", "author/-ids": "sup", "other": "li b"}}
    html = "<ul><li>Dr <b>Ann <i>Lee</i></b> of <sup>1,<a>2</a></sup> here<script>var x</script></li><li></li><li>Outer <ul><li><b>In</b></li></ul></li></ul>"
    got = selectors.read(html, selectors.Automaton(rules), ["r"])["r"]
    authors = [m for m in got if m["role"] == "author"]
    assert [(m["text"], m["rest"]) for m in authors] == [("Dr Ann Lee of 1, 2 here", "Dr Ann Lee of here"), ("", ""), ("Outer In", "Outer In"), ("In", "In")]
    assert [[(p["role"], p["text"], p["own"]) for p in m["parts"]] for m in authors] == [[("name", "Ann Lee", "Ann"), ("ids", "1, 2", "1,")], [], [("name", "In", "In")], [("name", "In", "In")]]
    assert [m["text"] for m in got if m["role"] == "other"] == ["Ann Lee", "In"]


def test_a_page_of_many_elements_is_linear():
    import time

    rules = {"r": {"author": "li.a", "author/name": "b", "deep": "div div div b"}}
    machine, took = selectors.Automaton(rules), []
    for n in (10_000, 40_000):
        html = "<div><div><div>" + '<li class="a"><b>N</b><i>x</i></li>' * n + "</div></div></div>"
        began = time.process_time()
        got = selectors.read(html, machine, ["r"])["r"]
        took.append(time.process_time() - began)
        assert len(got) == 2 * n and all(len(m["parts"]) == 1 for m in got if m["role"] == "author")
    assert took[1] < 10 * took[0]


def test_what_is_no_selector():
    for bad in ("", "a >> [", "a:b", "[=]"):
        try:
            selectors.steps_of(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_marks_beside_pages(spark):
    rules = {"one": {"m": "p"}, "two": {"m": "b"}}
    rows = [(1, "<p>a</p><b>c</b>", ["one", "two", "one"]), (2, None, ["one"]), (3, "<p>a</p>", []), (4, "<p>a</p>", None), (1, "<p>a</p><b>c</b>", ["two"])]
    df = spark.createDataFrame(rows, "page_id long, html string, rules array<string>").withColumn("marks", F.lit("clash"))
    got = selectors.with_marks(df, rules, "rules", "html")
    assert got.columns == ["page_id", "html", "rules", "marks", "found"]
    assert sorted((r["page_id"], [(f["rule_id"], [m["text"] for m in f["marks"]]) for f in r["found"]]) for r in got.collect()) == [(1, [("one", ["a"]), ("two", ["c"])]), (1, [("two", ["c"])]), (2, [("one", [])]), (3, []), (4, [])]
    assert selectors.with_marks(df.limit(0), rules, "rules", "html").count() == 0


def test_structural_joins_against_all_pairs(spark):
    rnd = random.Random(5)
    pages = [(i, grown(rnd)) for i in range(12)] + [(50, ""), (51, None)]
    table = dom.nodes(spark.createDataFrame(pages, "page_id long, html string")).cache()
    rows = [r.asDict() for r in table.collect()]
    fits = {"div": lambda r: r["tag"] == "div", "p": lambda r: r["tag"] == "p", "a": lambda r: r["tag"] == "a", ".x": lambda r: "x" in r["attrs"].get("class", "").split()}
    within = lambda a, b, own: a["page_id"] == b["page_id"] and (b["pre"] < a["pre"] <= b["post"] or (own and a["pre"] == b["pre"]))
    for path in ("div a", "div div p", ".x a", "div .x"):
        found = rows
        for k, part in enumerate(path.split()):
            found = [r for r in rows if fits[part](r) and (k == 0 or any(within(r, f, False) for f in found))]
        assert sorted((r["page_id"], r["pre"]) for r in dom.select(table, path).collect()) == sorted((r["page_id"], r["pre"]) for r in found)
    cut = [r for r in rows if fits[".x"](r)]
    left = dom.outside(table, dom.select(table, ".x"))
    assert left.columns == table.columns
    assert sorted((r["page_id"], r["pre"]) for r in left.collect()) == sorted((r["page_id"], r["pre"]) for r in rows if not any(within(r, c, True) for c in cut))
    want = sorted((a["page_id"], a["id"], " ".join(b["text"] for b in sorted(rows, key=lambda r: r["pre"]) if within(b, a, True) and b["text"])) for a in rows)
    assert sorted(map(tuple, dom.texts(table, table).collect())) == want
