"""Extractors of publishers whose pages need more than a list of selectors: states in JSON, symbols, roles, marks that say nothing.

Only pages that answer to one of these publishers are parsed; a page's elements, or what its rule marks among them, become one
array, and everything after is a Column function of that array, so that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from . import dom, extract, folds, selectors, springer, states
from .people import author, none_of

let = X.let

# --- fixed values: (rule, signal, needle) of the pages; words and endings that the pages use ---
RULES = [*springer.RULES, *folds.RULES, *states.RULES, ("acs", "og_url", "pubs.acs.org"), ("acs", "canonical", "pubs.acs.org"), ("science_direct", "canonical", "sciencedirect.com"), ("wiley_marks", "og_url", "onlinelibrary.wiley.com"), ("wiley_marks", "site", "Wiley Online Library"), ("cup_roles", "og_url", "cambridge.org"), ("cup_roles", "canonical", "cambridge.org")]
SEPARATORS = r"^(?i:[\s,&]|\band\b)*$"
SPEAKS_OF_ADDRESS = r"(?i)correspondence|corresponding author|e-mail|\bemail\s*:"
NOTE = r"(?is)^.{0,14}correspond|^.{0,25}address reprint|author deceased|e-mail:|^contribution|^joint first authors|^†joint"
AROUND_PLACE = r"^Authors are with |Direct inquiries.*|Fax.*"
# contributors of chapters: (rank, whether the label says it, pattern on the label or else on the row's text)
ROLES = [(1, True, r"^by$"), (1, False, r"^chapter by "), (3, True, r"^edited"), (3, False, r"^(?:chapter )?edited by"), (2, False, r"^(?!(?:chapter )?(?:appendix by|general editor|introduction by|preface by|translated by))")]
EDGES = r"^[\s,]+|(?:\s+and)?[\s,]+$|\s+and$"
MAIL_AND_REST = r"(?i)email:.*$|[\w.%+-]+@.*$"
SELECTORS = {
    "springer_ladder": springer.SELECTORS, **folds.SELECTORS, **states.SELECTORS,
    "cup_roles": {
        "chapter": "h1.chapter-title, li.author.chapter", "detail": "div.row.author", "detail/name": "dt", "detail/line": "div.d-sm-flex, div.d-sm-flex *", "row": "div.row.contributor-type, li.author", "row/name": "span.author-name",
        "row/more": "a.more-by-this-author", "row/contributor": ".contributor-type__contributor", "row/affiliation": ".affiliation", "row/label": ".contributor-type__label",
    },
}
NODE = "array<struct<`#name`:string,`_`:string,`$`:struct<id:string,refid:string>,`$$`:string>>"

Of = Callable[[Column], Column]


def elements(els: Column) -> Column:
    """A page's elements with the attributes that the extractors look at."""
    value = lambda e, a: F.coalesce(F.try_element_at(e["attrs"], F.lit(a)), F.lit("")).alias(a)
    return F.transform(els, lambda e: F.struct(*[e[c].alias(c) for c in ("pre", "post", "depth", "id", "parent", "tag", "classes")], value(e, "id").alias("name"), value(e, "href"), value(e, "title"), value(e, "data-cfemail").alias("cfemail"), e["text"].alias("text")))


def is_a(tag: str = "", *classes: str) -> Of:
    """A condition on an element: its tag, and classes that it has."""

    def fits(e: Column) -> Column:
        out = e["tag"] == tag if tag else F.lit(True)
        for c in classes:
            out = out & F.array_contains(e["classes"], c)
        return out

    return fits


def under(els: Column, top: Column, fits: Of) -> Column:
    return F.filter(els, lambda e: (e["pre"] > top["pre"]) & (e["pre"] <= top["post"]) & fits(e))


def whole(els: Column, top: Column) -> Column:
    """An element's text with that of its descendants."""
    return X.squeezed(F.array_join(F.transform(F.filter(els, lambda e: e["pre"].between(top["pre"], top["post"]) & (e["text"] != "")), lambda e: e["text"]), " "))


def texts(els: Column, top: Column, fits: Of) -> Column:
    """The non-empty texts of what fits under ``top``, in order."""
    return F.filter(F.transform(under(els, top, fits), lambda e: whole(els, e)), lambda t: t != "")


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def owner(local: Column, name: Column) -> Column:
    """Whether the part of an address before the @ is made of a name.

    It is if it starts with the name's initials, two at least; or holds the last name, of three letters at least, together with the given
    name; or starts with the initial and has the last name later on; or starts with the last name, if that has five letters or the
    initial follows it.
    """

    def made(x: Column) -> Column:
        own, given, last, letters = x["local"], x["words"][0], F.element_at(x["words"], -1), x["letters"]
        initial = F.substring(given, 1, 1)
        after_initial = own.startswith(initial) & F.substring(own, 2, 1000).contains(last)
        last_first = own.startswith(last) & ((F.length(last) >= 5) | own.startswith(F.concat(last, initial)))
        whole = own.contains(last) & own.contains(given) & (F.size(x["words"]) > 0)
        return ((F.length(last) >= 3) & (whole | after_initial | last_first)) | ((F.length(letters) >= 2) & own.startswith(letters))

    words = F.filter(F.split(F.regexp_replace(X.normalize_alpha(name), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)
    parts = let(words, lambda w: F.struct(F.regexp_replace(X.normalize_alpha(local), "[^a-z0-9]+", "").alias("local"), w.alias("words"), F.array_join(F.transform(w, lambda one: F.substring(one, 1, 1)), "").alias("letters")))
    return F.coalesce(let(parts, lambda x: F.when(F.size(x["words"]) > 0, made(x))), F.lit(False))


def near_correspondence(els: Column, above: int = 4) -> Column:
    """Addresses of mail links, hidden ones too, where an element at most ``above`` levels up speaks of correspondence; lower case, each once."""
    hidden = lambda e: (e["cfemail"] != "") & (F.array_contains(e["classes"], "__cf_email__") | e["href"].contains("email-protection"))
    links = F.filter(els, lambda e: (e["tag"] == "a") & (F.lower(e["href"]).startswith("mailto:") | hidden(e)))
    holds = lambda e: F.filter(els, lambda a: (a["pre"] <= e["pre"]) & (a["post"] >= e["post"]) & (a["depth"] >= e["depth"] - above) & ~a["tag"].isin("body", "html"))
    telling = F.filter(els, lambda e: F.lower(e["text"]).contains("correspond"))
    said = F.filter(links, lambda e: F.exists(holds(e), lambda a: F.exists(telling, lambda s: s["pre"].between(a["pre"], a["post"]))))
    address = F.transform(said, lambda e: F.lower(F.trim(F.when(e["cfemail"] != "", X.decode_cfemail(e["cfemail"])).otherwise(F.regexp_replace(F.substring_index(e["href"], "?", 1), "(?i)^mailto:", "")))))
    return F.array_distinct(F.filter(address, lambda m: F.regexp_like(m, F.lit(r"[\w.+%-]+@[\w.-]+\.[a-z]{2,}"))))


def mark_owners(authors: Column, mails: Column) -> Column:
    """Marks an author to whom alone an address belongs."""
    names = F.transform(mails, lambda m: F.filter(F.transform(authors, lambda a: a["name"]), lambda n: owner(F.substring_index(m, "@", 1), n)))
    alone = F.flatten(F.filter(names, lambda n: F.size(n) == 1))
    return F.transform(authors, lambda a: author(a["name"], a["affiliations"], a["is_corresponding"] | F.array_contains(alone, a["name"])))


def by_symbols(els: Column) -> Column:
    """Authors of a list whose items hold their places, else symbols of the page's places, else share all of these; a star or an address by the correspondence marks."""
    place = lambda d: F.struct(F.coalesce(first(texts(els, d, is_a("span", "aff-symbol"))), F.lit("")).alias("label"), first(texts(els, d, is_a("span", "aff-text"))).alias("organization"))
    places = F.filter(F.transform(F.filter(els, is_a("div", "aff-info")), place), lambda p: p["organization"].isNotNull())

    def people(shared: Column) -> Column:
        all_of = F.transform(shared, lambda p: p["organization"])

        def person(e: Column) -> Column:
            name = F.coalesce(first(texts(els, e, is_a("div", "loa-info-name"))), first(texts(els, e, is_a("span", "hlFld-ContribAuthor"))), whole(els, e))
            strong = F.coalesce(first(texts(els, e, is_a("strong"))) == "*", F.lit(False))
            box = first(under(els, e, is_a("div", "loa-info-affiliations")))
            own = F.coalesce(texts(els, box, is_a("div")), none_of())
            symbols = texts(els, e, is_a("", "author-aff-symbol"))
            named = F.array_distinct(F.flatten(F.transform(symbols, lambda s: F.transform(F.filter(shared, lambda p: p["label"] == s), lambda p: p["organization"]))))
            affs = F.when(F.size(own) > 0, own).when(F.size(named) > 0, named).otherwise(all_of)
            return author(name, affs, strong | F.exists(texts(els, e, is_a("", "author-xref-symbol")), lambda t: t.contains("*")))

        listed = F.coalesce(under(els, first(F.filter(els, is_a("ul", "loa"))), is_a("li")), F.filter(els, lambda e: F.lit(False)))
        return F.filter(F.transform(listed, person), lambda a: ~F.regexp_like(a["name"], F.lit(SEPARATORS)))

    return let(let(places, people), lambda a: mark_owners(a, near_correspondence(els)))


def box_abstract(els: Column) -> Column:
    box = F.filter(els, lambda e: is_a("div", "article_abstract-content")(e) & ((e["name"] == "abstractBox") | F.array_contains(e["classes"], "hlFld-Abstract")))
    return first(F.filter(F.transform(box, lambda e: whole(els, e)), lambda t: t != ""))


def children(text: Column) -> Column:
    """The nodes of a JSON list, each with its own list as text; empty where there is none."""
    return F.coalesce(F.from_json(text, NODE), F.array().cast(NODE))


def state_authors(state: Column) -> Column:
    """Authors of a page's JSON state: places by reference or, if no author of the group refers to one, all of the group's; corresponding by reference to such a note, by an address only where the group has no such notes."""
    named = lambda xs, *names: F.filter(xs, lambda n: n["#name"].isin(*names))
    last = lambda n, kind: F.try_element_at(F.filter(F.transform(named(children(n["$$"]), kind), lambda c: c["_"]), lambda t: t.isNotNull()), F.lit(-1))

    def group(g: Column) -> Column:
        kids = children(g["$$"])
        entry = lambda kind: lambda n: F.struct(n["$"]["id"].alias("id"), last(n, kind).alias("text"))
        places = F.filter(F.transform(named(kids, "affiliation", "footnote"), entry("textfn")), lambda p: p["id"].isNotNull() & (F.coalesce(p["text"], F.lit("")) != ""))
        notes = F.transform(F.filter(F.transform(named(kids, "footnote"), entry("note-para")), lambda p: F.lower(F.coalesce(p["text"], F.lit(""))).contains("correspond")), lambda p: p["id"])
        marks = F.transform(F.filter(kids, lambda n: F.coalesce(n["#name"], F.lit("")).contains("correspond")), lambda n: n["$"]["id"])

        def of_group(c: Column) -> Column:
            place, mark = c["places"], c["marks"]

            def person(n: Column) -> Column:
                parts = children(n["$$"])
                refs = F.filter(F.transform(named(parts, "cross-ref"), lambda p: p["$"]["refid"]), lambda r: r.isNotNull())
                ids = F.transform(place, lambda p: p["id"])
                mine = F.filter(refs, lambda r: F.array_contains(ids, r))
                called = F.exists(refs, lambda r: ~F.array_contains(ids, r) & F.coalesce(F.array_contains(F.concat(c["notes"], mark), r), F.lit(False)))
                mailed = (F.size(mark) == 0) & (F.size(named(parts, "e-address", "encoded-e-address")) > 0)
                name = F.concat_ws(" ", F.nullif(last(n, "given-name"), F.lit("")), F.nullif(last(n, "surname"), F.lit("")))
                return F.struct(name.alias("name"), mine.alias("mine"), (called | mailed).alias("mark"))

            everywhere = F.transform(place, lambda p: p["text"])
            at = lambda r: F.element_at(F.filter(place, lambda p: p["id"] == r), -1)["text"]
            read = F.filter(F.transform(named(c["kids"], "author"), person), lambda a: a["name"] != "")
            return let(read, lambda people: let(F.exists(people, lambda a: F.size(a["mine"]) > 0), lambda told: F.transform(people, lambda a: author(a["name"], F.when(told, F.transform(a["mine"], at)).otherwise(everywhere), a["mark"]))))

        return let(F.struct(kids.alias("kids"), places.alias("places"), notes.alias("notes"), marks.alias("marks")), of_group)

    top = named(children(F.get_json_object(state, "$.authors.content")), "author-group")
    inner = F.flatten(F.transform(top, lambda g: F.flatten(F.transform(named(children(g["$$"]), "collaboration"), lambda c: named(children(c["$$"]), "author-group")))))
    return F.flatten(F.transform(F.concat(top, inner), group))


def state_abstract(tree: Column) -> Column:
    """The texts of the state's abstracts without headings, however deep they lie; null without one."""
    return F.nullif(F.trim(F.regexp_replace(states.gathered(tree), " +", " ")), F.lit(""))


def grouped(els: Column) -> Column:
    """Authors of a page that shows each in a group with places; none if fewer than two are shown, as the page is folded then."""
    one = lambda g, cond: first(texts(els, g, cond))
    name = lambda g: F.concat_ws(" ", one(g, is_a("span", "given-name")), one(g, is_a("span", "text", "surname")))
    lists = lambda g: F.transform(under(els, g, is_a("dl", "affiliation")), lambda d: d["id"])
    places = lambda g: let(lists(g), lambda ids: texts(els, g, lambda e: (e["tag"] == "dd") & F.array_contains(ids, e["parent"])))
    marked = lambda g: F.size(under(els, g, lambda e: (e["tag"] == "svg") & e["title"].contains("orrespond"))) > 0
    people = F.filter(F.transform(F.filter(els, is_a("div", "author-group")), lambda g: author(name(g), places(g), marked(g))), lambda a: a["name"] != "")
    return let(people, lambda p: F.when(F.size(p) >= 2, p).otherwise(F.filter(p, lambda a: F.lit(False))))


def collaborations(els: Column) -> Column:
    """Members that a page lists under a collaboration, each with the group's first place."""
    groups = F.flatten(F.transform(F.filter(els, is_a("div", "author-collaboration")), lambda c: under(els, c, is_a("div", "author-group"))))
    place = lambda g: F.filter(F.array(first(texts(els, g, is_a("dl", "affiliation")))), lambda t: t.isNotNull())
    return F.flatten(F.transform(groups, lambda g: F.transform(texts(els, g, is_a("span", "button-link-text")), lambda t: author(t, place(g), F.lit(None).cast("boolean")))))


def listed_or_stated(els: Column) -> tuple[Column, Column]:
    """Authors and abstract: the longer of the page's own list and its state's, collaborations after it; the shown abstract before the stated."""
    shown = F.flatten(F.transform(F.filter(els, is_a("div", "abstract", "author")), lambda d: texts(els, d, is_a("p"))))
    state = F.col("__state")
    longer = let(F.struct(grouped(els).alias("l"), F.coalesce(state_authors(state), none_of(extract.AUTHOR)).alias("s")), lambda x: F.when(F.size(x["l"]) > F.size(x["s"]), x["l"]).otherwise(x["s"]))
    return F.concat(longer, collaborations(els)), F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise(state_abstract(F.col("__abstract_tree")))


def by_types(els: Column) -> Column:
    """Authors of cards: where a card states its author's type, mail links of others say nothing; where all cards state it and none has one, only the first is meant."""
    loa = first(F.filter(els, is_a("div", "loa-authors")))
    bare = lambda e: (e["tag"] == "p") & (F.array_join(e["classes"], "") == "")
    mailto = lambda e: (e["tag"] == "a") & e["href"].contains("mailto")
    speaks = lambda ts, p: F.exists(ts, lambda t: F.regexp_like(t, F.lit(p)))

    def card(e: Column) -> Column:
        notes = texts(els, e, bare)
        kind, info = F.coalesce(first(texts(els, e, is_a("p", "author-type"))), F.lit("")), F.coalesce(first(texts(els, e, is_a("div", "author-info"))), F.lit(""))
        spoken = texts(els, e, lambda x: is_a("div", "author-affiliation")(x) | is_a("p", "author-affiliation")(x))
        return F.struct(F.coalesce(first(texts(els, e, is_a("a"))), F.lit("")).alias("name"), notes.alias("notes"), F.lower(kind).contains("corresponding").alias("typed"), F.lower(info).contains("corresponding author").alias("informed"), (F.size(under(els, e, mailto)) > 0).alias("mailed"), spoken.alias("other"))

    def affiliations(c: Column) -> Column:
        stop = F.when(F.size(c["notes"]) > 1, F.array_position(F.transform(c["notes"], lambda t: F.regexp_like(t, F.lit(NOTE))), True)).otherwise(0)
        before = F.when(stop > 0, F.slice(c["notes"], 1, stop.cast("int") - 1)).otherwise(c["notes"])
        clean = F.filter(F.transform(before, lambda t: F.trim(F.regexp_replace(t, AROUND_PLACE, ""))), lambda t: t != "")
        return F.when(F.size(clean) > 0, clean).otherwise(c["other"])

    def judged(cards: Column) -> Column:
        typed = F.exists(cards, lambda c: c["typed"])
        all_typed = (F.size(cards) > 1) & F.forall(cards, lambda c: c["typed"]) & (F.size(under(els, loa, mailto)) == 0)
        mark = lambda c, i, f: (f["all"] & (i == 0)) | (~f["all"] & (c["typed"] | c["informed"])) | (~f["typed"] & c["mailed"]) | speaks(c["notes"], SPEAKS_OF_ADDRESS)
        return let(F.struct(typed.alias("typed"), all_typed.alias("all")), lambda f: F.filter(F.transform(cards, lambda c, i: author(c["name"], affiliations(c), mark(c, i, f))), lambda a: a["name"] != ""))

    cards = F.transform(under(els, loa, is_a("span", "accordion__closed")), card)
    return F.coalesce(let(cards, judged), none_of(extract.AUTHOR))


def by_roles(marks: Column) -> Column:
    """Contributors of a chapter, from what its rule marks: those of the best role that has any; a name's places are those of its detail, else of its row.

    A row's role is the first of ``ROLES`` whose pattern its label, or without a label its text, answers to. Of a name that
    comes twice the one with places stays.
    """
    tidy = lambda t: F.regexp_replace(X.squeezed(t), EDGES, "")
    parts = lambda m, name: F.filter(m["parts"], lambda p: p["role"] == name)
    told = lambda m, name: F.array_distinct(F.filter(F.transform(parts(m, name), lambda p: tidy(p["text"])), lambda t: t != ""))
    of = lambda name: F.filter(marks, lambda m: m["role"] == name)
    lines = lambda m: F.filter(F.transform(parts(m, "line"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p["own"], MAIL_AND_REST, ""), r"^[., ()]+|[., ()]+$", ""))), lambda t: t != "")
    details = F.transform(of("detail"), lambda m: F.struct(F.coalesce(first(told(m, "name")), tidy(F.substring_index(m["text"], "Affiliation:", 1))).alias("name"), lines(m).alias("places")))

    def role_of(m: Column) -> Column:
        label = F.lower(F.coalesce(first(told(m, "label")), F.lit("")))
        text = F.concat(F.when(F.array_contains(F.split(F.coalesce(F.try_element_at(m["attrs"], F.lit("class")), F.lit("")), r"\s+"), "chapter"), "chapter ").otherwise(""), F.lower(X.squeezed(m["text"])))
        answers = [F.when(F.regexp_like(label if by_label else text, F.lit(pattern)) & (F.lit(by_label) | (label == "")), rank) for rank, by_label, pattern in ROLES]
        return F.coalesce(*answers)

    def listed(known: Column) -> Of:
        def read(m: Column) -> Column:
            names = F.coalesce(*[let(told(m, kind), lambda ns: F.when(F.size(ns) > 0, ns)) for kind in ("name", "more", "contributor")], none_of())
            beside = F.filter(F.transform(parts(m, "affiliation"), lambda p: tidy(p["text"])), lambda t: t != "")

            def people(x: Column) -> Column:
                detailed = lambda n: first(F.filter(known, lambda k: (k["name"] == n) & (F.size(k["places"]) > 0)))["places"]
                in_row = lambda i: F.when(F.size(x["names"]) == 1, x["beside"]).when(F.size(x["names"]) == F.size(x["beside"]), F.slice(x["beside"], i + 1, F.lit(1))).otherwise(none_of())
                return F.transform(x["names"], lambda n, i: author(n, F.coalesce(detailed(n), in_row(i)), F.lit(False)))

            return F.struct(role_of(m).alias("rank"), let(F.struct(names.alias("names"), beside.alias("beside")), people).alias("people"))

        return read

    def best(rows: Column) -> Column:
        some = F.filter(rows, lambda r: r["rank"].isNotNull() & (F.size(r["people"]) > 0))
        return let(some, lambda xs: let(F.array_min(F.transform(xs, lambda r: r["rank"])), lambda top: F.flatten(F.transform(F.filter(xs, lambda r: r["rank"] == top), lambda r: r["people"]))))

    def once(people: Column) -> Column:
        same = lambda n: F.filter(people, lambda a: a["name"] == n)
        return F.transform(F.array_distinct(F.transform(people, lambda a: a["name"])), lambda n: let(same(n), lambda xs: F.coalesce(first(F.filter(xs, lambda a: F.size(a["affiliations"]) > 0)), xs[0])))

    rows = let(details, lambda known: F.transform(of("row"), listed(known)))
    return F.when(F.size(of("chapter")) > 0, let(let(rows, best), once)).otherwise(none_of(extract.AUTHOR))


def reads_elements(rules: Column) -> Column:
    """Whether one of a page's rules reads the page's whole list of elements."""
    return F.exists(rules, lambda r: r.isin("acs", "science_direct", "wiley_marks"))


def steps(page: H.Page) -> list[dict[str, Column]]:
    """Columns to be added one after another to scanned rows with ``__rules``, ``__found`` and ``__els``; the last adds ``__own``: what the extractors of single publishers find, an array of (rule_id, authors, abstract). Nested in one another the expressions would be too deep to analyse."""
    kind = f"struct<authors:array<{extract.AUTHOR}>,abstract:string>"
    answers = lambda rule: F.array_contains("__rules", rule)
    marked = lambda rule: F.when(answers(rule), F.try_element_at(F.filter("__found", lambda f: f["rule_id"] == rule), F.lit(1))["marks"])
    pair = lambda authors, abstract: F.struct(F.coalesce(authors, none_of(extract.AUTHOR)).alias("authors"), abstract.alias("abstract")).cast(kind)
    nothing, own = F.lit(None).cast("string"), F.col("__elements")
    shown, stated = listed_or_stated(own)
    box = F.coalesce(X.strip_abstract_label(box_abstract(own)), extract.abstract_of(page))
    plain = {
        "__acs": F.when(answers("acs"), by_symbols(own)), "__acs_abstract": F.when(answers("acs"), box), "__wiley": F.when(answers("wiley_marks"), by_types(own)), "__cup": F.when(answers("cup_roles"), by_roles(F.col("__cup_marks"))),
        "__science": F.when(answers("science_direct"), shown), "__science_abstract": F.when(answers("science_direct"), stated),
    }
    state_rules = dict.fromkeys(r[0] for r in states.RULES)
    found = {
        "springer_ladder": (F.col("__ladder.authors"), F.col("__ladder.abstract")), "acs": (F.col("__acs"), F.col("__acs_abstract")), "science_direct": (F.col("__science"), F.col("__science_abstract")),
        "wiley_marks": (F.col("__wiley"), nothing), "cup_roles": (F.col("__cup"), nothing), **{rule: (F.col(f"__{rule}_authors"), F.col(f"__{rule}_abstract")) for rule in [*folds.SELECTORS, *state_rules]},
    }
    one = [F.when(answers(rule), F.struct(F.lit(rule).alias("rule_id"), pair(*both).alias("c"))) for rule, both in found.items()]
    ladder = springer.steps(F.col("__ladder_marks"), page)
    lists = folds.columns(lambda rule: F.col(f"__{rule}_marks"), page) | states.columns(lambda rule: F.col(f"__{rule}_marks"), page)
    walked = {f"__{rule}_{name}": F.when(answers(rule), c) for rule, both in lists.items() for name, c in zip(("authors", "abstract"), both, strict=True)}
    by_rule = {f"__{rule}_marks": marked(rule) for rule in lists}
    return [*states.steps(answers, page), {"__ladder_marks": marked("springer_ladder"), "__cup_marks": marked("cup_roles"), "__elements": elements(F.col("__els"))} | by_rule, ladder[0] | plain | walked, *ladder[1:], {"__own": F.filter(F.array(*one), lambda x: x.isNotNull())}]


def with_candidates(rows: DataFrame, page: H.Page, html_col: str) -> DataFrame:
    """``rows`` with ``__own``, see ``steps``."""
    columns = rows.columns
    for step in X.once(("publishers", html_col), lambda: steps(page)):
        rows = rows.withColumns(step)
    return rows.select(*columns, "__own")


def candidates(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """What these extractors find: (``id_col``, rule_id, authors, abstract). A null, empty or other page has no row; one of these publishers' without authors has an empty list."""
    rows, page = H.scanned(pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")), html_col)
    rows = rows.withColumn("__rules", extract.answers(page, RULES)).where(F.size("__rules") > 0)
    rows = with_candidates(dom.with_elements(selectors.with_marks(rows, SELECTORS, "__rules", html_col, "__found"), html_col, "__els"), page, html_col)
    # not explode, whose filter on the array the optimiser would push through all steps, writing them out again and again
    return rows.select(id_col, F.explode_outer("__own").alias("f")).where("f is not null").select(id_col, "f.rule_id", "f.c.authors", "f.c.abstract")
