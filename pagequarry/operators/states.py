"""States in JSON that pages carry, read to any depth: trees of objects and lists as arrays of nodes, and the publishers whose pages hold such states.

A JSON text becomes one array of its objects and lists in document order, each with the interval that its descendants fill, like the
elements of a page (see ``dom``); an object's plain fields are a map on its node. What lies how deep where is then a condition
on numbers, and a descent that is cut short where it has found something is a single walk over the array.

Cases: null, an empty text and what isn't JSON have no nodes (null), as has a text nested beyond what Python's reader takes (some
thousands of levels); a repeated key counts in its last place.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from . import extract, selectors
from .people import author, none_of

let = X.let

# --- fixed values: (rule, signal, needle) of the pages; selectors by role; words of the pages ---
RULES = [
    ("hindawi_state", "canonical", "hindawi.com"), ("sciendo_state", "words", "sciendo is a de gruyter company"),
    ("taylor_state", "og_url", "tandfonline.com"), ("taylor_state", "canonical", "tandfonline.com"), ("taylor_state", "og_url", "taylorfrancis.com"), ("taylor_state", "canonical", "taylorfrancis.com"),
]
SELECTORS = {
    "hindawi_state": {"+person": ".article_authors > span", "person/sup": "sup", "person/mail": "a[href*=mailto]", "place": "p", "place/label": "sup", "place/name": "span", "heading": "#abstract", "behind": "#abstract ~ p"},
    "taylor_state": {
        "person": "div.publicationContentAuthors div.entryAuthor", "person/name": "a", "person/heading": "span.heading", "+overlay": "div.publicationContentAuthors div.entryAuthor span.overlay",
        "bio": "div.author-infos div.addAuthorInfo", "bio/name": "h4", "full": "div.abstractInFull", "older": ".hlFld-Abstract",
    },
}
NO_TEXT = ["section-title", "alt-text"]
ABSTRACT_LABEL = r"(?i)^(?:\s*(?:abstract|résumé|resumen|zusammenfassung)\s*){0,2}"
PLACE_WORDS = r"(?i)\b(?:University|College|School|Department|Institute|Laborator(?:y|ies)|Center|Centre|Hospital|Clinic|Facility|Research|CSIRO|UMKC|UCLA)\b"
#: What in a note on a person is the place: (pattern whose group is it, whether it must have a place's word), the first that fits.
BIO = [(r"(?i)\bare with the\s+(.+?)(?:\.|$)", False), (r"(?i)\bis\s[^.]*?\bin the\s+(.+?)(?:\.|$)", False), (r"(?i)\bis\s[^.]*?\bat (?:the\s+)?(.+?)(?:\.|$)", True), (r"(?i)\bis\s[^.]*?,\s*(.+?)(?:\.|$)", True)]
NO_OVERLAY = r"(?i)^http|view further author information"
CITATION = r"^\(\d{4}\)\.\s+|:\s+Vol\.\s+\d+.*\bpp\.\s+"
SHORTEST_DESCRIPTION = 40

NODE = "struct<pre:int,post:int,parent:int,depth:int,key:string,list:boolean,fields:map<string,string>,text:string>"
NODE_TYPE = pa.struct([*[(n, pa.int32()) for n in ("pre", "post", "parent", "depth")], ("key", pa.string()), ("list", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
PERSONS = "array<struct<`@type`:string,name:string,givenName:string,familyName:string>>"
CONTRIBUTORS = "array<struct<position:int,roles:string,fullName:string,givenName:string,familyName:string>>"


def plain(value: object) -> str | None:
    """A JSON value that is neither an object nor a list, as text."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def nodes_of(text: str | None) -> list[dict] | None:
    """The objects and lists of a JSON text, and the plain items of lists, in document order."""
    if not text:
        return None
    try:
        top = json.loads(text)
    except (ValueError, RecursionError):
        return None
    rows: list[dict] = []
    ahead = [(None, -1, 0, top)]
    while ahead:
        key, parent, depth, value = ahead.pop()
        row = {"pre": len(rows), "post": len(rows), "parent": parent, "depth": depth, "key": key, "list": isinstance(value, list), "fields": [], "text": None}
        rows.append(row)
        if isinstance(value, dict):
            row["fields"] = [(k, plain(v)) for k, v in value.items() if not isinstance(v, (dict, list))]
            inner = [(k, v) for k, v in value.items() if isinstance(v, (dict, list))]
        elif isinstance(value, list):
            inner = [(None, v) for v in value]
        else:
            row["text"], inner = plain(value), []
        ahead += [(k, row["pre"], depth + 1, v) for k, v in reversed(inner)]
    for row in reversed(rows):
        if row["parent"] >= 0:
            rows[row["parent"]]["post"] = max(rows[row["parent"]]["post"], row["post"])
    return rows


def nodes(text: Column) -> Column:
    """The nodes of a JSON text; descendants have pre in (pre, post]."""

    def read(texts: pa.Array) -> pa.Array:
        return pa.array([nodes_of(t) for t in texts.to_pylist()], pa.list_(NODE_TYPE))

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # the kind of function, which is told from types
    return F.arrow_udf(read, f"array<{NODE}>")(text)


def field(n: Column, name: str) -> Column:
    """A node's field; null where it has none."""
    return F.try_element_at(n["fields"], F.lit(name))


def gathered(tree: Column, text: str = "_", through: str = "$$", kind: str = "#name", without: list[str] = NO_TEXT) -> Column:
    """The texts of a tree's objects, from its top down: an object with a text gives it and isn't followed further, one whose ``kind`` is left out gives none;
    of an object without a text only the member ``through`` is followed. Null for null."""

    def step(s: Column, n: Column) -> Column:
        own = F.coalesce(field(n, text), F.lit(""))
        named = ~n["list"] & (own != "")
        past = (n["pre"] > s["end"]) & (n["key"].isNotNull() & (n["key"] != through) | named)
        given = (n["pre"] > s["end"]) & (n["key"].isNull() | (n["key"] == through)) & named & ~F.coalesce(field(n, kind).isin(*without), F.lit(False))
        return F.struct(F.when(past, n["post"]).otherwise(s["end"]).alias("end"), F.when(given, F.concat(s["texts"], F.array(own))).otherwise(s["texts"]).alias("texts"))

    start = F.struct(F.lit(-1).alias("end"), none_of().alias("texts"))
    return F.aggregate(tree, start, step, lambda s: F.array_join(s["texts"], " "))


def nearest_value(tree: Column, key: str = "abstracts", value: str = "value") -> Column:
    """The field ``value`` of an item of a list called ``key``, at whatever depth: of the first object, in document order, whose list has an item with one. Null without one."""

    def within(all_: Column) -> Column:
        holder = lambda n: all_[n["parent"]]
        items = F.filter(all_, lambda n: (n["parent"] >= 0) & n["key"].isNull() & (F.coalesce(field(n, value), F.lit("")) != ""))
        found = F.filter(items, lambda n: holder(n)["list"] & F.coalesce(holder(n)["key"] == key, F.lit(False)))
        return F.array_min(F.transform(found, lambda n: F.struct(holder(n)["parent"].alias("of"), n["pre"].alias("pre"), field(n, value).alias("value"))))["value"]

    return let(tree, within)


def role(marks: Column, name: str) -> Column:
    return F.filter(marks, lambda m: m["role"] == name)


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def parts(m: Column, name: str) -> Column:
    """The non-empty texts of a mark's parts."""
    return F.filter(F.transform(role(m["parts"], name), lambda p: X.squeezed(p["text"])), lambda t: t != "")


def some(t: Column) -> Column:
    return F.nullif(F.trim(t), F.lit(""))


def as_list(text: Column) -> Column:
    """The text of a JSON list; an object or a string as the only item of one."""
    return F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))


def typed(people: Column) -> Column:
    return F.coalesce(people.cast(f"array<{extract.AUTHOR}>"), none_of(extract.AUTHOR))


def hindawi(marks: Column, page: H.Page) -> tuple[Column, Column]:
    """Authors of the page's data script, whose places are numbered in the order of their ids; without the script those of the page's list, whose raised numbers name the places."""
    data = H.next_data(page, "$.props.pageProps.article")
    people = F.from_json(F.get_json_object(data, "$.authors"), "array<struct<givenName:string,surName:string,email:string,affSup:array<struct<affId:int>>>>")
    places = F.array_sort(F.from_json(F.get_json_object(data, "$.affiliations"), "array<struct<affId:int,addrLines:array<map<string,string>>>>"), lambda a, b: F.when(a["affId"] < b["affId"], -1).when(a["affId"] > b["affId"], 1).otherwise(0))
    lines = F.transform(places, lambda p: F.array_join(F.map_values(F.try_element_at(p["addrLines"], F.lit(1))), ", "))
    known = lambda names, at: F.filter(F.transform(at, lambda k: F.try_element_at(names, k)), lambda t: t.isNotNull())
    stated = let(F.struct(people.alias("people"), lines.alias("lines")), lambda x: F.transform(x["people"], lambda p: author(F.concat_ws(" ", p["givenName"], p["surName"]), known(x["lines"], F.filter(F.transform(p["affSup"], lambda s: s["affId"]), lambda k: k > 0)), F.coalesce(p["email"], F.lit("")) != "")))

    told = F.filter(F.transform(role(marks, "place"), lambda m: F.struct(first(parts(m, "label")).alias("label"), first(parts(m, "name")).alias("name"))), lambda p: p["label"].isNotNull() & p["name"].isNotNull())
    numbers = lambda m: F.filter(F.flatten(F.transform(parts(m, "sup"), lambda t: F.split(t, r"[\s,]+"))), lambda k: F.regexp_like(k, F.lit(r"^\d+$")))
    of = lambda all_, k: F.transform(F.filter(all_, lambda p: p["label"] == k), lambda p: p["name"])
    listed = let(told, lambda all_: F.transform(role(marks, "person"), lambda m: author(F.coalesce(X.squeezed(first(m["nodes"])["text"]), F.lit("")), F.flatten(F.transform(numbers(m), lambda k: of(all_, k))), F.size(role(m["parts"], "mail")) > 0)))
    heading = first(role(marks, "heading"))
    shown = let(heading, lambda h: first(F.filter(role(marks, "behind"), lambda m: (m["pre"] > h["post"]) & (m["depth"] == h["depth"])))["text"])
    return F.when(F.size(stated) > 0, typed(stated)).otherwise(typed(F.filter(listed, lambda a: a["name"] != ""))), F.coalesce(some(F.get_json_object(data, "$.abstract")), some(shown))


def sciendo(page: H.Page) -> tuple[Column, Column]:
    """Authors of the group in the page's data script; places are those whose ids they refer to, an institution's parts on end."""
    group = H.next_data(page, "$.props.pageProps.product.articleData.contribGroup")
    people = F.from_json(as_list(F.get_json_object(group, "$.contrib")), "array<struct<name:struct<`given-names`:string,surname:string>,corresp:string,xref:string>>")
    places = F.from_json(as_list(F.get_json_object(group, "$.aff")), "array<struct<id:string,institution:string>>")
    piece = lambda t: F.when(t.startswith("{"), F.coalesce(F.get_json_object(t, "$.content"), F.lit(""))).otherwise(t)
    whole = lambda t: F.when(t.startswith("["), F.regexp_replace(F.array_join(F.transform(F.from_json(t, "array<string>"), piece), ", "), r"^[ ,]+|[ ,]+$", "")).when(~t.startswith("{"), t)
    ids = lambda p: F.transform(F.from_json(as_list(p["xref"]), "array<struct<rid:string>>"), lambda r: r["rid"])
    mine = lambda all_, p: F.filter(F.transform(F.filter(all_, lambda a: F.array_contains(ids(p), a["id"])), lambda a: whole(a["institution"])), lambda t: t.isNotNull())
    person = lambda all_, p: author(F.concat_ws(" ", p["name"]["given-names"], p["name"]["surname"]), F.coalesce(mine(all_, p), none_of()), F.coalesce(p["corresp"].contains("y"), F.lit(False)))
    return typed(let(F.struct(people.alias("people"), F.coalesce(places, none_of("struct<id:string,institution:string>")).alias("places")), lambda x: F.transform(x["people"], lambda p: person(x["places"], p)))), extract.abstract_of(page)


def name_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\W+", ""))


def tidy_place(text: Column) -> Column:
    """A place without a trailing address or role, commas set evenly."""
    cut = F.regexp_replace(F.regexp_replace(X.squeezed(text), r"(?i)\s*;\s*e-?mail\s*:.*$", ""), r"(?i)\s+and\s+(?:editor|author|co-?editor)\b.*$", "")
    apart = F.regexp_replace(F.regexp_replace(cut, r"\b(Department of [A-Z][A-Za-z&./-]+)(?=[A-Z][a-z])", "$1 "), r"\s*,\s*", ", ")
    return some(F.regexp_replace(apart, r"^[ .;,]+|[ .;,]+$", ""))


def place_in_note(name: Column, note: Column) -> Column:
    """The place that a note on a person tells, by the first row of ``BIO`` that fits; null without one."""
    said = let(F.struct(X.squeezed(note).alias("t"), name.alias("n")), lambda x: F.when(x["t"].startswith(x["n"]), F.regexp_replace(F.substr(x["t"], F.length(x["n"]) + 1), r"^[ ,•]+", "")).otherwise(x["t"]))
    within = lambda t: F.regexp_replace(t, r"(?i)\bat\s+(?:the\s+)?(?=(?:University|College|School|Institute|Center|Centre|Hospital|Clinic)\b)", ", ")

    def told(t: Column) -> Column:
        found = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
        return F.coalesce(*[F.when(F.regexp_like(found(p), F.lit(PLACE_WORDS)) if strict else F.lit(True), found(p)) for p, strict in BIO])

    return tidy_place(within(let(said, told)))


def taylor(marks: Column, page: H.Page) -> tuple[Column, Column]:
    """Authors of the page's entries, their places beside them or in the notes on persons; for a book's chapter those of its LD-JSON, else the contributors of its product's state, which is quoted."""
    notes = F.filter(F.transform(role(marks, "bio"), lambda m: let(first(parts(m, "name")), lambda n: F.struct(name_key(n).alias("key"), place_in_note(n, F.regexp_replace(X.squeezed(m["text"]), r"^[ •]+", "")).alias("place")))), lambda b: b["key"].isNotNull() & b["place"].isNotNull())
    inside = lambda name, m: F.filter(role(marks, name), lambda o: (o["pre"] > m["pre"]) & (o["pre"] <= m["post"]))
    overlay = lambda m: let(first(first(inside("overlay", m))["nodes"]), lambda n: F.when((n["tag"] == "") & ~F.regexp_like(F.trim(n["text"]), F.lit(NO_OVERLAY)), tidy_place(F.regexp_replace(F.trim(n["text"]), "^[a-z0-9] ", ""))))

    def person(m: Column, by_name: Column) -> Column:
        name = F.coalesce(first(parts(m, "name")), F.lit(""))
        noted = let(name_key(name), lambda k: F.try_element_at(F.filter(by_name, lambda b: b["key"] == k), F.lit(-1))["place"])
        place = F.coalesce(overlay(m), noted)
        return author(name, F.when(place.isNotNull(), F.array(place)).otherwise(none_of()), F.coalesce(F.lower(first(parts(m, "heading"))) == "correspondence", F.lit(False)))

    entries = let(notes, lambda by_name: F.filter(F.transform(role(marks, "person"), lambda m: person(m, by_name)), lambda a: a["name"] != ""))

    blocks = F.flatten(F.transform(H.ld_json(page), lambda b: F.coalesce(F.from_json(F.when(F.trim(b).startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]"))), "array<string>"), none_of())))
    is_chapter = lambda o: F.array_contains(F.coalesce(F.from_json(F.get_json_object(o, "$['@type']"), "array<string>"), F.array(F.get_json_object(o, "$['@type']"))), "Chapter") & (F.coalesce(F.get_json_object(o, "$.url").contains("taylorfrancis.com"), F.lit(False)) | F.coalesce(F.get_json_object(o, "$.publisher.name").contains("Taylor & Francis"), F.lit(False)))
    product = F.col("__product")
    bare = lambda names: F.transform(names, lambda n: author(n, none_of(), F.lit(False)))
    cut = lambda t: F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), ","), X.squeezed), lambda w: w != "")

    def names(p: Column) -> Column:
        pairs = lambda x: F.zip_with(x["g"], x["f"], lambda g, f: F.concat_ws(" ", g, f))
        one = F.coalesce(some(p["name"]), some(F.concat_ws(" ", p["givenName"], p["familyName"])))
        return let(F.struct(cut(p["givenName"]).alias("g"), cut(p["familyName"]).alias("f")), lambda x: F.when((F.size(x["g"]) == F.size(x["f"])) & (F.size(x["g"]) > 1), pairs(x)).when(one.isNotNull(), F.array(X.squeezed(one))).otherwise(none_of()))

    rows = F.from_json(F.get_json_object(product, "$.product.contributors"), CONTRIBUTORS)
    writes = lambda c: F.coalesce(F.trim(c["roles"]).isin("", "[]") | F.exists(F.coalesce(F.from_json(c["roles"], "array<string>"), F.array(c["roles"])), lambda r: F.lower(r) == "author"), F.lit(True))
    ordered = F.array_sort(F.transform(F.filter(rows, writes), lambda c, i: F.struct(F.coalesce(F.nullif(c["position"], F.lit(0)), F.lit(9999)).alias("at"), i.alias("i"), X.squeezed(F.coalesce(some(c["fullName"]), F.concat_ws(" ", some(c["givenName"]), some(c["familyName"])))).alias("name"))))
    distinct = lambda xs: F.filter(xs, lambda n, i: (name_key(n) != "") & ~F.exists(F.slice(xs, F.lit(1), i), lambda m: name_key(m) == name_key(n)))
    contributors = F.coalesce(let(F.transform(ordered, lambda c: c["name"]), distinct), none_of())

    def of_chapter(o: Column) -> Column:
        told = F.get_json_object(o, "$.author")
        persons = F.from_json(as_list(told), PERSONS)
        stated = F.flatten(F.transform(persons, names))
        return F.when(F.trim(told).startswith("[") | F.trim(told).startswith("{"), F.when(F.size(stated) > 0, stated).otherwise(contributors)).otherwise(F.when(F.size(contributors) > 0, contributors).otherwise(cut(told)))

    chapter = first(F.filter(blocks, is_chapter))
    plain_text = lambda t: some(X.squeezed(F.regexp_replace(H.unescaped(t), "<[^>]*>", " ")))
    told = F.coalesce(first(role(marks, "full"))["text"], first(role(marks, "older"))["text"])
    described = F.filter(F.transform(F.filter(H.metas(page), lambda m: F.lower(m["key"]) == "dc.description"), lambda m: plain_text(m["content"])), lambda t: ~F.regexp_like(t, F.lit(CITATION)) & (F.length(F.regexp_replace(t, r"^[. ]+|[. ]+$", "")) >= SHORTEST_DESCRIPTION))
    journal = F.coalesce(H.meta(page, "og:url").contains("tandfonline.com"), F.lit(False)) | F.coalesce(H.link_href(page, "canonical").contains("tandfonline.com"), F.lit(False))
    stated = F.coalesce(plain_text(nearest_value(F.col("__product_tree"))), plain_text(F.get_json_object(chapter, "$.description")), F.when(journal, first(described)))
    shown = F.when(told.isNotNull(), some(F.regexp_replace(told, ABSTRACT_LABEL, ""))).otherwise(stated)
    return F.when(F.size(entries) > 0, typed(entries)).otherwise(typed(bare(let(chapter, of_chapter)))), shown


def product_of(page: H.Page) -> Column:
    """The quoted state of a book's product."""
    scripts = F.regexp_extract_all(H.raw(page), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/json["']?[^>]*>(.*?)</script"""), F.lit(1))
    return H.unescaped(H.quoted_json(first(F.filter(scripts, lambda t: t.contains("&q;product&q;")))))


def steps(answers: Callable[[str], Column], page: H.Page) -> list[dict[str, Column]]:
    """Columns to be added before the others: texts of states, then their trees, which Python reads on the pages that have one."""
    texts = {"__product": F.when(answers("taylor_state"), product_of(page)), "__state": F.when(answers("science_direct"), H.preloaded_state(page))}
    return [texts, {"__product_tree": nodes(F.col("__product")), "__abstract_tree": nodes(F.get_json_object("__state", "$.abstracts.content"))}]


def columns(marked: Callable[[str], Column], page: H.Page) -> dict[str, tuple[Column, Column]]:
    """Authors and abstract by rule, of what each rule marks and of the states of its pages."""
    return {"hindawi_state": hindawi(marked("hindawi_state"), page), "sciendo_state": sciendo(page), "taylor_state": taylor(marked("taylor_state"), page)}
