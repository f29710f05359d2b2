"""Lists of authors that run on as mixed text: names, raised labels, breaks and places follow one another without an element around each.

A list's child nodes, elements and texts in document order, are walked once by a small state machine: rows say which node opens an
entry, adds a label to the open one, ends it, or is shared by all entries since the last shared ones. Publishers differ in their rows, and in
what labels mean. All here are Column functions of what a page's selectors mark; an absent list gives no entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from . import extract, selectors
from .people import author, none_of, own_affiliations, with_parts

let = X.let

# --- fixed values: (rule, signal, needle) of the pages; selectors by role; words of the pages ---
RULES = [
    ("karger_fold", "og_url", "karger.com"), ("csiro_fold", "og_url", "publish.csiro.au"), ("aip_fold", "og_url", "aip.scitation.org"), ("aip_fold", "publisher", "AIP Publishing"), ("thieme_fold", "description", "Thieme"), ("thieme_fold", "og_url", "thieme-connect"),
    ("thieme_fold", "canonical", "thieme"), ("thieme_fold", "publisher", "thieme"), ("lippincott_fold", "og_url", "journals.lww.com"), ("lippincott_fold", "publisher", "American Society of Anesthesiologists"),
]
SELECTORS = {
    "karger_fold": {
        "card": ".al-author-name", "card/name": "a", "card/note": ".info-card-footnote", "+card_place": ".al-author-name .info-card-affilitation .aff", "+authors": "span.autoren", "+places": "div#cAffi",
        "heading": "h1, h2, h3, h4, h5, h6", "behind": "h1 ~ p, h2 ~ p, h3 ~ p, h4 ~ p, h5 ~ p, h6 ~ p",
    },
    "csiro_fold": {"+authors": ".editors", "+place": "#full-description p"},
    "aip_fold": {
        "+entries": ".entryAuthor", "entries/name": ".contrib-author a", "entries/place": ".author-affiliation", "person": "div.publicationContentAuthors span.contrib-author", "person/name": "a[href^='/author/']", "person/sup": "sup",
        "place": "div.affiliations-list li.author-affiliation", "corresponding": "corresp", "corresponding/sup": "sup",
    },
    "thieme_fold": {"+authors": ".authors", "authors/ref": "a[href^='#']", "authors/sup": "sup", "place": ".authorsAffiliationsList li", "place/-label": "sup", "other": ".affiliation", "other/-label": "sup", "embedded": "span.author", "embedded/-place": ".affiliation", "abstract": "#abstract"},
    "lippincott_fold": {
        "card": ".al-author-name a.linked-name", "footnote": ".article-footnote", "footnote/-link": "a", "mail": ".article-footnote a[href*=mailto], .info-author-correspondence a[href*=mailto]", "+line": "#ejp-article-authors > p", "+authors": "#ejp-article-authors",
        "+info": "div.ejp-article-authors-info-holder p", "+holder": "div.ejp-article-authors-info-holder", "said": "p", "wrap": "section#abstractWrap", "body": "section#ArticleBody",
    },
}
NO_PLACE = ["accepted", "received", "presented", "this", "revision", "disclosure", "reprint", "supported", "the authors", "patients have", "abbreviations", "funding"]
NO_PLACE_WITHIN = ["contributed equally", "financial disclosure"]
BUTTONS = r"(?i)^(?:PDF Download\s+)?(?:Buy Article(?:\s+\(opens in new window\))?\s+)?(?:Permissions and Reprints(?:\s+\(opens in new window\))?\s+)*"
ABSTRACT_LABEL, NEXT_ABSTRACT = r"(?i)^(?:Abstract|Summary|Zusammenfassung)[:.\s]+", r"(?is)\s+(?:Abstract|Summary|Key words|Keywords|Schlüsselwörter)[:\s].*$"
SHORTEST_ABSTRACT, SHORTEST_WRAP, LABEL_WITHIN = 50, 100, 15

ENTRY = "struct<name:string,labels:array<string>,pre:int,post:int,shared:boolean,block:int>"
STATE = f"struct<done:array<{ENTRY}>,open:array<{ENTRY}>,block:int,shared:boolean>"
#: What a walk looks for: (tag, '' for a text and * for any node; class, or ''; pattern in its text; what it does).
Rows = list[tuple[str, str, str, str]]


def walk(nodes: Column, rows: Rows, unfinished: bool = True) -> Column:
    """The entries of a list's nodes. The first row that a node answers to says what it does; a node without one is passed over.

    ``open`` starts an entry and keeps the one open so far, ``replace`` drops that, ``begin`` starts one only if none is open; ``label`` adds the
    node's text to the open entry, ``end`` closes it, ``label_end`` does both; ``share`` is an entry of its own, shared by those of its block: all since the
    shared ones before; ``skip`` does nothing. What is open at the end stays if ``unfinished``. Null nodes have no entries.
    """

    def does(n: Column) -> Column:
        fits = lambda tag, kind, pattern: (F.lit(True) if tag == "*" else n["tag"] == tag) & (F.array_contains(n["classes"], kind) if kind else F.lit(True)) & F.regexp_like(n["text"], F.lit(pattern))
        return F.coalesce(*[F.when(fits(*row[:3]), F.lit(row[3])) for row in rows], F.lit("skip"))

    def step(s: Column, n: Column) -> Column:
        state = lambda done=s["done"], open_=s["open"], block=s["block"], shared=s["shared"]: F.struct(done.alias("done"), open_.alias("open"), block.alias("block"), shared.alias("shared")).cast(STATE)
        entry = lambda block, shared: F.array(F.struct(n["text"].alias("name"), none_of().alias("labels"), n["pre"].alias("pre"), n["post"].alias("post"), F.lit(shared).alias("shared"), block.alias("block")).cast(ENTRY))
        block = s["block"] + s["shared"].cast("int")
        labelled = F.transform(s["open"], lambda e: F.struct(e["name"].alias("name"), F.concat(e["labels"], F.array(n["text"])).alias("labels"), *[e[c].alias(c) for c in ("pre", "post", "shared", "block")]).cast(ENTRY))
        started = lambda done: state(done, entry(block, False), block, F.lit(False))
        nothing = none_of(ENTRY)
        ways = {
            "open": started(F.concat(s["done"], s["open"])), "replace": started(s["done"]), "begin": F.when(F.size(s["open"]) == 0, started(s["done"])).otherwise(s), "label": state(open_=labelled),
            "label_end": state(F.concat(s["done"], labelled), nothing), "end": state(F.concat(s["done"], s["open"]), nothing), "share": state(F.concat(s["done"], s["open"], entry(s["block"], True)), nothing, shared=F.lit(True)),
        }
        used = {row[3] for row in rows}
        return F.coalesce(*[F.when(n["does"] == way, made) for way, made in ways.items() if way in used], s)

    start = F.struct(none_of(ENTRY).alias("done"), none_of(ENTRY).alias("open"), F.lit(0).alias("block"), F.lit(False).alias("shared")).cast(STATE)
    seen = F.filter(F.transform(nodes, lambda n: F.struct(*[n[c].alias(c) for c in ("pre", "post", "text")], does(n).alias("does"))), lambda n: n["does"] != "skip")
    return F.coalesce(F.aggregate(seen, start, step, lambda s: F.concat(s["done"], s["open"]) if unfinished else s["done"]), none_of(ENTRY))


def role(marks: Column, name: str) -> Column:
    return F.filter(marks, lambda m: m["role"] == name)


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def inside(xs: Column, top: Column) -> Column:
    """Of marks or parts those that lie in an element."""
    return F.filter(xs, lambda x: (x["pre"] > top["pre"]) & (x["pre"] <= top["post"]))


def cleaned(xs: Column, of: Callable[[Column], Column]) -> Column:
    """The non-empty ones of some texts."""
    return F.filter(F.transform(xs, lambda x: X.squeezed(of(x))), lambda t: t != "")


def unmarked() -> Column:
    return F.lit(None).cast("boolean")


def stripped(text: Column, edges: str) -> Column:
    return F.regexp_replace(text, f"^[{edges}]+|[{edges}]+$", "")


def labelled_places(nodes: Column) -> Column:
    """(label, organization) of texts behind raised labels, a label's last text; what stands before the first label has the label ''."""
    top = F.array(F.struct(F.lit(-1).alias("pre"), F.lit(-1).alias("post"), F.lit("sup").alias("tag"), none_of().alias("classes"), F.lit("").alias("text"))).cast(f"array<{selectors.NODE}>")
    entries = walk(F.concat(top, nodes), [("sup", "", "", "open"), ("br", "", "", "skip"), ("*", "", r"\S", "label")])
    some = F.filter(entries, lambda e: F.size(e["labels"]) > 0)
    return F.transform(some, lambda e: F.struct(F.trim(e["name"]).alias("label"), F.element_at(e["labels"], -1).alias("organization")))


def karger(marks: Column) -> Column:
    """Authors of cards, else of a running list in which a raised label or a span ends each name; a single place goes to all."""
    nodes = lambda name: first(role(marks, name))["nodes"]
    unlabelled = lambda m: X.squeezed(F.array_join(F.transform(F.filter(m["nodes"], lambda n, i: (i > 0) | (n["tag"] != "span")), lambda n: n["text"]), " "))
    card = lambda m: author(F.coalesce(first(cleaned(role(m["parts"], "name"), lambda p: p["text"])), F.lit("")), F.transform(inside(role(marks, "card_place"), m), unlabelled), F.size(role(m["parts"], "note")) > 0)
    cards = F.filter(F.transform(role(marks, "card"), card), lambda a: a["name"] != "")
    entries = walk(nodes("authors"), [("", "", r"\S\s*\S", "replace"), ("sup", "", "", "label_end"), ("span", "", "", "end"), ("", "", "", "skip"), ("*", "", r"\S\s*\S", "begin")], unfinished=False)

    def placed(places: Column) -> Column:
        everywhere = F.transform(places, lambda p: p["organization"])
        of = lambda k: F.element_at(F.filter(places, lambda p: p["label"] == F.trim(k)), -1)["organization"]
        known = lambda e: F.filter(F.flatten(F.transform(e["labels"], lambda t: F.split(t, ","))), lambda k: F.exists(places, lambda p: p["label"] == F.trim(k)))
        return F.transform(entries, lambda e: author(stripped(X.squeezed(e["name"]), r"\s,;"), F.when(F.size(places) == 1, everywhere).otherwise(F.transform(known(e), of)), unmarked()))

    listed = let(F.coalesce(labelled_places(nodes("places")), none_of("struct<label:string,organization:string>")), placed)
    return F.when(F.size(role(marks, "card")) > 0, cards.cast(f"array<{extract.AUTHOR}>")).otherwise(listed.cast(f"array<{extract.AUTHOR}>"))


def headed(marks: Column) -> Column:
    """The paragraph beside and behind the first heading that speaks of an abstract."""
    heading = first(F.filter(role(marks, "heading"), lambda m: F.lower(m["text"]).contains("abstract")))
    return let(heading, lambda h: first(F.filter(role(marks, "behind"), lambda m: (m["pre"] > h["post"]) & (m["depth"] == h["depth"])))["text"])


def csiro(marks: Column, page: H.Page) -> Column:
    """Authors of the metas, those marked whom the page's list gives a star; if that marks nobody, the list's own with the places of their labels, of which one may speak of correspondence instead."""
    name = lambda t: stripped(F.regexp_replace(stripped(t, r"\s.,"), r"^and\b", ""), r"\s.,")
    entries = walk(first(role(marks, "authors"))["nodes"], [("", "", r"^[\s.,]*(?:and)?[\s.,]*$", "skip"), ("", "", "", "open"), ("sup", "", "", "label")])
    place = lambda m: F.struct(F.trim(first(F.filter(m["nodes"], lambda n: n["tag"] == "sup"))["text"]).alias("label"), X.squeezed(F.array_join(F.transform(F.filter(m["nodes"], lambda n: n["tag"] != "sup"), lambda n: n["text"]), " ")).alias("organization"))
    places = F.filter(F.transform(role(marks, "place"), place), lambda p: p["label"].isNotNull())

    def both(x: Column) -> Column:
        starred = F.transform(F.filter(x["entries"], lambda e: F.array_contains(e["labels"], "*")), lambda e: name(e["name"]))
        stated = F.transform(x["metas"], lambda a: with_parts(a, mark=F.when(F.array_contains(starred, a["name"]), True).otherwise(a["is_corresponding"])))
        told = lambda e: F.filter(F.transform(e["labels"], lambda k: F.try_element_at(F.filter(x["places"], lambda p: p["label"] == k), F.lit(-1))["organization"]), lambda t: t.isNotNull())
        speaks = lambda t: F.lower(t).contains("corresponding")
        own = F.transform(x["entries"], lambda e: let(told(e), lambda ts: author(name(e["name"]), F.filter(ts, lambda t: ~speaks(t)), F.when(F.exists(ts, speaks), True))))
        return let(stated, lambda a: F.when(F.exists(a, lambda b: F.coalesce(b["is_corresponding"], F.lit(False))) | (F.size(x["entries"]) == 0), a.cast(f"array<{extract.AUTHOR}>")).otherwise(own.cast(f"array<{extract.AUTHOR}>")))

    return let(F.struct(entries.alias("entries"), places.alias("places"), extract.fold_metas(page).alias("metas")), both)


def aip(marks: Column) -> Column:
    """Authors in blocks, each with the places that follow it; else those whose raised numbers name the places, the one corresponding whose label the note on correspondence has."""
    top = first(role(marks, "entries"))
    entries = walk(top["nodes"], [("*", "contrib-author", "", "open"), ("*", "author-affiliation", "", "share")])

    def blocks(rows: Column) -> Column:
        places = lambda b: F.transform(F.filter(rows, lambda e: e["shared"] & (e["block"] == b)), lambda e: e["name"])
        named = lambda e: F.coalesce(first(cleaned(inside(role(top["parts"], "name"), e), lambda p: p["text"])), F.lit(""))
        return F.filter(F.transform(F.filter(rows, lambda e: ~e["shared"]), lambda e: author(named(e), places(e["block"]), unmarked())), lambda a: a["name"] != "")

    called = F.trim(first(role(first(role(marks, "corresponding"))["parts"], "sup"))["text"])
    ids = lambda m: F.filter(F.transform(F.flatten(F.transform(role(m["parts"], "sup"), lambda p: F.split(p["text"], ","))), lambda t: F.trim(t)), lambda k: k != "")
    person = lambda m: let(ids(m), lambda k: F.struct(F.coalesce(first(cleaned(role(m["parts"], "name"), lambda p: p["text"])), F.lit("")).alias("name"), k.alias("aff_ids"), F.coalesce(F.array_contains(k, called), F.lit(False)).alias("is_corresponding")))
    place = lambda m: F.struct(F.trim(F.regexp_replace(m["text"], r"^\d+", "")).alias("organization"), F.nullif(F.regexp_extract(m["text"], r"^(\d+)", 1), F.lit("")).alias("aff_id"))
    lists = F.struct(F.filter(F.transform(role(marks, "person"), person), lambda a: a["name"] != "").alias("people"), F.transform(role(marks, "place"), place).alias("places"))
    joined = let(lists, lambda x: extract.join_affiliations(x["people"], x["places"]))
    in_blocks = F.coalesce(F.size(role(top["parts"], "place")) > 0, F.lit(False))
    return F.when(in_blocks, let(entries, blocks).cast(f"array<{extract.AUTHOR}>")).otherwise(joined.cast(f"array<{extract.AUTHOR}>"))


def contents(page: H.Page, key: str) -> Column:
    """The non-empty contents of a page's meta tags of that key, in order."""
    return F.filter(F.transform(F.filter(H.metas(page), lambda m: F.lower(m["key"]) == key), lambda m: F.trim(F.coalesce(m["content"], F.lit("")))), lambda t: t != "")


def addressed(name: Column, mail: Column) -> Column:
    """Whether an address is made of a name: one part of it starts with the first initial and one holds a later name of three letters or more (else the last); or one starts with the initial and the first three letters of such a name of four or more."""
    words = lambda t, cut: F.filter(F.transform(F.split(t, cut), lambda w: F.replace(X.normalize_alpha(w), F.lit(" "), F.lit(""))), lambda w: w != "")

    def made(x: Column) -> Column:
        long = F.filter(F.slice(x["own"], 2, 1000), lambda w: F.length(w) >= 3)
        later = F.when(F.size(long) > 0, long).otherwise(F.slice(x["own"], -1, 1))
        initial = F.substring(x["own"][0], 1, 1)
        both = F.exists(x["mail"], lambda t: t.startswith(initial)) & F.exists(later, lambda w: F.exists(x["mail"], lambda t: t.contains(w)))
        short = F.exists(later, lambda w: (F.length(w) >= 4) & F.exists(x["mail"], lambda t: t.startswith(F.concat(initial, F.substring(w, 1, 3)))))
        return F.when(F.size(x["own"]) > 0, both | short)

    return F.coalesce(let(F.struct(words(name, r"[\s-]+").alias("own"), words(F.substring_index(mail, "@", 1), r"[._+-]+").alias("mail")), made), F.lit(False))


def thieme(marks: Column, page: H.Page) -> Column:
    """Authors of a running list whose raised numbers name the places; without such numbers those of the metas; without the list, spans that hold their places. Addresses of the metas mark."""
    listed = first(role(marks, "authors"))
    digits = lambda t: F.regexp_replace(t, r"\D+", "")
    entries = walk(listed["nodes"], [("", "", r"^[\s,;]*$", "skip"), ("", "", "", "open"), ("div", "", "", "end"), ("a", "", r"\d", "label"), ("sup", "", r"\d", "label")])
    people = F.array_distinct(F.transform(entries, lambda e: F.struct(stripped(X.squeezed(e["name"]), " ,;").alias("name"), F.transform(e["labels"], digits).alias("aff_ids"), unmarked().alias("is_corresponding"))))
    visible = (F.size(role(listed["parts"], "ref")) > 0) | F.exists(role(listed["parts"], "sup"), lambda p: F.regexp_like(p["text"], F.lit(r"\d")))

    def place(m: Column) -> Column:
        raised, text = X.squeezed(F.array_join(F.transform(role(m["parts"], "label"), lambda p: p["text"]), " ")), X.squeezed(m["rest"])
        number = F.when(raised == "", F.regexp_extract(text, r"^(\d+)\s", 1)).otherwise(raised)
        return F.struct(F.when(raised == "", F.regexp_replace(text, r"^\d+\s+", "")).otherwise(text).alias("organization"), F.nullif(number, F.lit("")).alias("aff_id"))

    told = F.when(F.size(role(marks, "place")) > 0, role(marks, "place")).otherwise(role(marks, "other"))
    places = F.array_distinct(F.filter(F.transform(told, place), lambda p: p["organization"] != ""))
    spans = F.transform(role(marks, "embedded"), lambda m: author(F.regexp_replace(stripped(X.squeezed(m["rest"]), " ,"), r"\s+\d+(?:\s+\d+)*$", ""), F.transform(cleaned(role(m["parts"], "place"), lambda p: p["text"]), lambda t: F.regexp_replace(t, r"^\d+\s+", "")), unmarked()))
    embedded = F.array_distinct(F.filter(spans, lambda a: (a["name"] != "") & (F.size(a["affiliations"]) > 0)))

    def chosen(x: Column) -> Column:
        shared = F.when(F.size(x["places"]) == 1, F.transform(x["places"], lambda p: p["organization"])).otherwise(none_of())
        stated = F.transform(x["names"], lambda n, i: author(n, let(F.try_element_at(x["institutions"], i + 1), lambda t: F.when(t.isNotNull(), F.array(t)).otherwise(shared)), unmarked())).cast(f"array<{extract.AUTHOR}>")
        joined = extract.join_affiliations(x["people"], x["places"]).cast(f"array<{extract.AUTHOR}>")
        own = F.when(x["visible"] | (x["listed"] & (F.size(x["names"]) == 0)), joined).when(~x["listed"] & (F.size(x["embedded"]) > 0), x["embedded"].cast(f"array<{extract.AUTHOR}>")).otherwise(stated)
        return let(own, lambda people: let(F.transform(people, lambda a: F.exists(x["mails"], lambda m: addressed(a["name"], m))), lambda hits: F.when(F.array_contains(hits, True), F.zip_with(people, hits, lambda a, h: with_parts(a, mark=h))).otherwise(people)))

    return let(
        F.struct(people.alias("people"), places.alias("places"), embedded.alias("embedded"), F.coalesce(visible, F.lit(False)).alias("visible"), listed.isNotNull().alias("listed"), *[contents(page, f"citation_author{k}").alias(n) for k, n in (("", "names"), ("_institution", "institutions"), ("_email", "mails"))]),
        chosen,
    )


def thieme_abstract(marks: Column, page: H.Page) -> Column:
    """The abstract of the metas, else of the page, without its buttons, label and what is a second abstract; of more than fifty characters."""
    plain = lambda t: X.squeezed(F.regexp_replace(F.regexp_replace(F.regexp_replace(X.squeezed(F.regexp_replace(t, r"<[^<>]+>", " ")), BUTTONS, ""), ABSTRACT_LABEL, ""), NEXT_ABSTRACT, ""))
    long = lambda t: let(plain(t), lambda p: F.when(F.length(p) > SHORTEST_ABSTRACT, p))
    return F.coalesce(long(H.meta(page, "citation_abstract")), long(first(role(marks, "abstract"))["text"]), extract.abstract_of(page))


def given_and_last(name: Column) -> Column:
    """(given, last) of 'Last, Given ...', else of 'Given ... Last'."""
    words = F.split(X.squeezed(F.substring_index(name, ",", 1)), " ")
    turned = F.struct(F.split(F.trim(F.split(name, ",")[1]), " ")[0].alias("given"), F.trim(F.substring_index(name, ",", 1)).alias("last"))
    return F.when(F.regexp_like(name, F.lit(r",\s*\S")), turned).otherwise(F.struct(words[0].alias("given"), F.element_at(words, -1).alias("last")))


def both_within(name: Column, text: Column) -> Column:
    return let(given_and_last(name), lambda n: (n["given"] != "") & (n["last"] != "") & text.contains(n["given"]) & text.contains(n["last"]))


def lippincott(marks: Column) -> Column:
    """Authors of cards, whose notes begin with last names in brackets; else of a list cut by semicolons, whose raised labels name the places. A place that names an author is that author's alone."""
    symbols = lambda t: F.regexp_extract_all(F.substring(t, 1, LABEL_WITHIN), F.lit(r"(\d+|[^\s\w':,/.;()&-]|\b[a-z]\b)"), F.lit(1))
    starred = lambda e: F.exists(e["labels"], lambda t: F.regexp_like(t, F.lit("[*∗]")))

    def cards(x: Column) -> Column:
        telling = F.filter(x["notes"], lambda t: F.regexp_like(t, F.lit(r"^\(")))
        mine = lambda last: F.transform(F.filter(telling, lambda t: F.array_contains(F.transform(F.split(F.regexp_extract(t, r"^\((.*?)\)", 1), ","), lambda k: F.trim(k)), last)), lambda t: F.trim(F.regexp_replace(t, r"^\(.*?\)", "")))
        person = lambda n: let(given_and_last(n)["last"], lambda last: author(n, F.when(F.size(telling) > 0, mine(last)).otherwise(x["notes"]), F.coalesce(x["mail"].contains(F.lower(last)), F.lit(False))))
        return F.transform(x["names"], person)

    pieces = lambda nodes: F.flatten(F.transform(nodes, lambda n: F.transform(F.when(n["tag"] == "", F.split(n["text"], ";")).otherwise(F.array(n["text"])), lambda t: F.struct(n["pre"].alias("pre"), n["post"].alias("post"), n["tag"].alias("tag"), n["classes"].alias("classes"), t.alias("text")))))
    line = F.coalesce(first(role(marks, "line"))["nodes"], first(role(marks, "authors"))["nodes"])
    entries = walk(pieces(line), [("", "", r"^[\s,*∗]*$", "skip"), ("", "", "", "open"), ("sup", "", "", "label")])
    names = F.filter(entries, lambda e: (F.size(e["labels"]) > 0) | ~F.lower(F.trim(e["name"])).startswith("editor"))
    person = lambda e: F.struct(stripped(X.squeezed(e["name"]), r"\s,*∗").alias("name"), F.flatten(F.transform(e["labels"], symbols)).alias("aff_ids"), F.when(starred(e) | F.regexp_like(e["name"], F.lit("[*∗]")), True).alias("is_corresponding"))

    organization = lambda t: stripped(F.regexp_replace(F.substring_index(F.regexp_replace(F.substring_index(t, " to:", -1), "(?is)^.*correspondence", ""), "From", -1), r"^\s*\d+", ""), r"\s,:")
    place = lambda label, t: F.struct(organization(t).alias("organization"), label.cast("string").alias("aff_id"))
    own_label = lambda t: place(first(symbols(t)), F.regexp_replace(t, r"^\s*[\d*†‡§∥¶#]+\s*", ""))

    def places_of(nodes: Column) -> Column:
        return F.transform(F.filter(walk(nodes, [("sup", "", "", "open"), ("*", "", r"\S", "label")]), lambda e: F.size(e["labels"]) > 0), lambda e: place(first(symbols(e["name"])), e["labels"][0]))

    paragraphs = F.filter(role(marks, "info"), lambda m: ~F.coalesce(F.try_element_at(m["attrs"], F.lit("id")), F.lit("")).startswith("cor"))
    no_label = F.lit(None).cast("string")
    leading = lambda t: F.when(F.regexp_like(t, F.lit(r"^\s*[\d*†‡§∥¶#]")), own_label(t)).otherwise(place(no_label, t))
    one = lambda m: F.when(F.exists(m["nodes"], lambda n: n["tag"] == "sup"), places_of(m["nodes"])).when(m["text"].contains(";"), F.transform(F.split(m["text"], ";"), leading)).otherwise(F.array(leading(m["text"])))
    kind = "struct<organization:string,aff_id:string>"
    told = F.when(F.size(role(marks, "info")) > 0, F.flatten(F.transform(paragraphs, lambda m: one(m).cast(f"array<{kind}>")))).otherwise(F.coalesce(places_of(first(role(marks, "holder"))["nodes"]).cast(f"array<{kind}>"), none_of(kind)))
    is_place = lambda p: (p["organization"] != "") & ~F.exists(F.array(*map(F.lit, NO_PLACE)), lambda w: F.lower(p["organization"]).startswith(w)) & ~F.exists(F.array(*map(F.lit, NO_PLACE_WITHIN)), lambda w: F.lower(p["organization"]).contains(w))

    def joined(x: Column) -> Column:
        placed = own_affiliations(extract.join_affiliations(x["people"], x["places"]), F.transform(x["places"], lambda p: p["organization"]), both_within)
        meant = lambda a: F.coalesce(x["said"].contains(F.trim(F.substring_index(a["name"], ",", 1))), F.lit(False))
        return let(placed, lambda rows: F.when(F.exists(rows, lambda a: F.coalesce(a["is_corresponding"], F.lit(False))), rows).otherwise(F.transform(rows, lambda a: with_parts(a, mark=F.when(meant(a), True)))))

    said = first(F.filter(role(marks, "said"), lambda m: F.lower(m["text"]).contains("correspondence")))["text"]
    carded = F.struct(cleaned(role(marks, "card"), lambda m: m["text"]).alias("names"), cleaned(role(marks, "footnote"), lambda m: m["rest"]).alias("notes"), F.lower(F.try_element_at(first(role(marks, "mail"))["attrs"], F.lit("href"))).alias("mail"))
    listed = F.struct(F.transform(names, person).alias("people"), F.filter(told, is_place).alias("places"), said.alias("said"))
    return F.when(F.size(role(marks, "card")) > 0, let(carded, cards).cast(f"array<{extract.AUTHOR}>")).otherwise(let(listed, joined).cast(f"array<{extract.AUTHOR}>"))


def lippincott_abstract(marks: Column) -> Column:
    wrap, body = first(role(marks, "wrap"))["text"], first(role(marks, "body"))["text"]
    text = F.when(wrap.isNotNull(), F.when(F.length(wrap) > SHORTEST_WRAP, wrap)).otherwise(body)
    return F.nullif(F.trim(F.regexp_replace(F.trim(text), "(?i)^abstract", "")), F.lit(""))


def columns(marked: Callable[[str], Column], page: H.Page) -> dict[str, tuple[Column, Column]]:
    """Authors and abstract by rule, of what each rule marks."""
    of = {rule: marked(rule) for rule in SELECTORS}
    return {
        "karger_fold": (karger(of["karger_fold"]), headed(of["karger_fold"])), "csiro_fold": (csiro(of["csiro_fold"], page), extract.abstract_of(page)), "aip_fold": (aip(of["aip_fold"]), extract.abstract_of(page)),
        "thieme_fold": (thieme(of["thieme_fold"], page), thieme_abstract(of["thieme_fold"], page)), "lippincott_fold": (lippincott(of["lippincott_fold"]), lippincott_abstract(of["lippincott_fold"])),
    }
