"""Joins within a page between its authors and what else names people: letters, surnames, initials, notes, addresses, stars.

Authors are arrays of (name, affiliations, is_corresponding), a page's worth each; all but the passes over elements are
Column functions of such arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions import text as X
from . import dom

let = X.let


def author(name: Column, affiliations: Column, mark: Column) -> Column:
    return F.struct(name.alias("name"), affiliations.alias("affiliations"), mark.alias("is_corresponding"))


def with_parts(a: Column, affiliations: Column | None = None, mark: Column | None = None) -> Column:
    """The author with other affiliations or another mark."""
    return author(a["name"], a["affiliations"] if affiliations is None else affiliations, a["is_corresponding"] if mark is None else mark)


def none_of(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def by_letters(people: Column, places: Column) -> Column:
    """Authors (name, refs, is_corresponding) with the places (label, organization) that their letters name; without a hit, those without a label."""
    known = F.filter(places, lambda p: F.coalesce(p["label"], F.lit("")) != "")
    plain = F.array_distinct(F.transform(F.filter(places, lambda p: F.coalesce(p["label"], F.lit("")) == ""), lambda p: p["organization"]))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(known, lambda p: p["label"])), lambda k: F.struct(k, F.element_at(F.filter(known, lambda p: p["label"] == k), -1)["organization"])))
    named = lambda a: F.array_distinct(F.filter(F.transform(a["refs"], lambda r: F.try_element_at(last, F.trim(r))), lambda x: x.isNotNull()))
    return F.transform(people, lambda a: let(named(a), lambda own: author(a["name"], F.when(F.size(own) > 0, own).otherwise(plain), a["is_corresponding"])))


def surname(name: Column) -> Column:
    return F.substring_index(F.rtrim(name), " ", -1)


def fill_by_surname(authors: Column, known: Column) -> Column:
    """Authors with what a page's state knows by surname (surname, affiliations, is_corresponding): a mark is only ever set, affiliations only where there are none."""

    def one(a: Column) -> Column:
        hit = F.try_element_at(F.filter(known, lambda k: k["surname"] == surname(a["name"])), F.lit(1))
        affs = F.when((F.size(a["affiliations"]) == 0) & (F.size(hit["affiliations"]) > 0), hit["affiliations"]).otherwise(a["affiliations"])
        return with_parts(a, affs, F.when(F.coalesce(hit["is_corresponding"], F.lit(False)), True).otherwise(a["is_corresponding"]))

    return F.transform(authors, one)


def mark_emailed(authors: Column, emailed: Column) -> Column:
    """Marks authors whose whole name or surname is among ``emailed``, names with an address beside them."""
    hit = lambda a: F.array_contains(emailed, a["name"]) | F.array_contains(F.transform(emailed, surname), surname(a["name"]))
    return F.transform(authors, lambda a: with_parts(a, mark=F.when(hit(a), True).otherwise(a["is_corresponding"])))


def emailed_names(html: Column) -> Column:
    """The authors of a page's meta tags that an e-mail tag follows."""
    from .extract import fold_metas

    return F.transform(F.filter(fold_metas(html), lambda a: F.coalesce(a["is_corresponding"], F.lit(False))), lambda a: a["name"])


def mark_if_telling(authors: Column, emailed: Column) -> Column:
    """Marks by (surname, first initial), by surname alone where one author has it; and only if the addresses tell authors apart: some have one, not all."""
    key = lambda n: X.name_key(n)
    keys = F.transform(emailed, key)
    alone = lambda a: F.size(F.filter(authors, lambda b: key(b["name"])["last"] == key(a["name"])["last"])) == 1
    hit = lambda a: F.exists(keys, lambda k: (k["last"] == key(a["name"])["last"]) & ((k["initial"] == key(a["name"])["initial"]) | alone(a)))
    hits = F.transform(authors, hit)
    n = F.size(F.filter(hits, lambda h: h))
    marked = F.zip_with(authors, hits, lambda a, h: with_parts(a, mark=F.coalesce(h, F.lit(False))))
    return F.when((n > 0) & (n < F.size(authors)), marked).otherwise(authors)


def names_within(name: Column, text: Column) -> Column:
    """Whether a text holds each of a name's words of two letters or more."""
    words = F.filter(F.split(X.normalize_alpha(name), " "), lambda w: F.length(w) > 1)
    return let(F.split(X.normalize_alpha(text), " "), lambda own: (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(own, w)))


def own_affiliations(authors: Column, notes: Column, within: Callable[[Column, Column], Column] = names_within) -> Column:
    """Authors with the notes that name them, as ``within`` tells of a name and a text; a note that names someone goes from all whom it doesn't name."""
    named = F.transform(notes, lambda n: F.struct(n.alias("note"), F.transform(F.filter(authors, lambda a: within(a["name"], n)), lambda a: a["name"]).alias("who")))
    telling = F.filter(named, lambda n: F.size(n["who"]) > 0)
    mine = lambda a: F.transform(F.filter(telling, lambda n: F.array_contains(n["who"], a["name"])), lambda n: n["note"])
    rest = lambda a: F.filter(a["affiliations"], lambda x: ~F.exists(telling, lambda n: n["note"] == x))
    return F.transform(authors, lambda a: with_parts(a, F.array_distinct(F.concat(rest(a), mine(a)))))


def initials(name: Column) -> Column:
    """A name's initials such as ``A.B.L.``, hyphenated first names as ``J.-P.``; 'Last, First' is turned."""
    turned = F.when(name.contains(", "), F.concat(F.substring_index(name, ", ", -1), F.lit(" "), F.substring_index(name, ", ", 1))).otherwise(name)
    parts = F.filter(F.split(F.replace(turned, F.lit("-"), F.lit(" -")), r"[\s.]+"), lambda w: F.regexp_like(w, F.lit("^-?[A-Za-z]")))
    return F.concat(F.array_join(F.transform(parts, lambda w: F.upper(F.when(w.startswith("-"), F.substring(w, 1, 2)).otherwise(F.substring(w, 1, 1)))), "."), F.lit("."))


def by_initials(authors: Column, prose: Column) -> Column:
    """Authors with the places of a running text whose brackets hold their initials, as in ``Hospital X (A.B., C.D.); Y (E.F.)``. One place, or none with brackets, goes to all."""
    pieces = F.regexp_extract_all(prose, F.lit(r"([^();]+?)\s*\(([A-Z][A-Za-z.,\s-]*)\)"), F.lit(0))
    read = F.transform(pieces, lambda p: F.struct(F.regexp_replace(F.regexp_extract(p, r"^([^(]*)", 1), r"^(?:[\s;,—]|and\b|the\b|[Ff]rom\b)+|[\s;,]+$", "").alias("place"), F.split(F.regexp_replace(F.regexp_extract(p, r"\(([^)]*)\)", 1), r"\s+", ""), ",|and").alias("who")))
    whole = F.trim(F.regexp_replace(prose, r"\s*\([A-Z][A-Za-z.,\s-]*\)", ""))
    mine = lambda a: F.transform(F.filter(read, lambda r: F.array_contains(r["who"], initials(a["name"]))), lambda r: r["place"])
    places = lambda a: F.when(F.size(read) == 0, F.array(whole)).when(F.size(read) == 1, F.array(read[0]["place"])).otherwise(mine(a))
    return F.transform(authors, lambda a: with_parts(a, F.array_distinct(F.concat(a["affiliations"], places(a)))))


def repaired(authors: Column, short: Column, editors: Column, key: Callable[[Column], Column] = X.normalize_key) -> Column:
    """The short list of names in place of the authors, where one is a true part of the other by keys, or where the editors' text names all authors; what the authors had goes along by key, a single shared list of affiliations to those who are new."""
    own, new = F.array_distinct(F.transform(authors, lambda a: key(a["name"]))), F.array_distinct(F.filter(F.transform(short, key), lambda k: k != ""))
    less = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) > 0)
    edited = (F.coalesce(editors, F.lit("")) != "") & F.forall(authors, lambda a: F.lower(editors).contains(F.lower(a["name"])))
    differ = (F.size(F.array_except(own, new)) > 0) | (F.size(F.array_except(new, own)) > 0)
    lists = F.array_distinct(F.filter(F.transform(authors, lambda a: a["affiliations"]), lambda x: F.size(x) > 0))
    shared = F.when(less(own, new) & (F.size(lists) == 1), lists[0]).otherwise(none_of())
    known = lambda n: F.try_element_at(F.filter(authors, lambda a: key(a["name"]) == key(n)), F.lit(1))
    made = F.transform(short, lambda n: let(known(n), lambda a: author(n, F.when(a.isNotNull(), a["affiliations"]).otherwise(shared), a["is_corresponding"])))
    return F.when(F.size(new) == 0, authors).when((F.size(own) == 0) | less(own, new) | less(new, own) | (edited & differ), made).otherwise(authors)


def longer_list(listed: Column, stated: Column, groups: Column) -> Column:
    """The page's list or that of its state, whichever is longer (the state's if equal), with group authors behind."""
    return F.concat(F.when(F.size(listed) > F.size(stated), listed).otherwise(stated), groups)


def longest(*texts: Column) -> Column:
    """The longest of some texts, the first of equal ones; null if all are."""
    return F.element_at(F.array_sort(F.filter(F.array(*[F.struct((-F.length(t)).alias("n"), F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate(texts)]), lambda x: x["t"].isNotNull())), 1)["t"] if len(texts) > 1 else texts[0]


def person_keys(name: Column) -> Column:
    """A name's letters and digits on end, forwards and with its words turned around."""
    words = F.regexp_extract_all(F.lower(X.text_of(name)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(F.array_distinct(F.array(F.array_join(words, ""), F.array_join(F.reverse(words), ""))), lambda k: k != "")


def speaks_of(text: Column, name: Column) -> Column:
    return let(F.regexp_replace(F.lower(X.text_of(text)), "[^a-z0-9]+", ""), lambda t: F.exists(person_keys(name), lambda k: t.contains(k)))


def starred(text: Column, name: Column) -> Column:
    """Whether a name stands in the text with a star attached, perhaps behind raised numbers."""
    words = F.regexp_extract_all(X.text_of(name), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    pattern = lambda ws: F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.array_join(ws, r"[\s\W]+"), F.lit(r"(?![A-Za-z0-9])\s*(?:[\d,\s†‡§#]+)?[*∗]"))
    return (F.size(words) > 0) & (F.regexp_like(X.text_of(text), pattern(words)) | F.regexp_like(X.text_of(text), pattern(F.reverse(words))))


def star_means(text: Column) -> Column:
    """Whether what follows the stars speaks of correspondence or an address, and not of equal shares or the like."""
    after = F.regexp_extract_all(X.text_of(text), F.lit(r"(?s)([*∗]\s*[^*∗]{0,350})"), F.lit(1))
    said = F.when(F.size(after) > 0, F.array_join(after, "\n")).otherwise(X.text_of(text))
    return F.regexp_like(said, F.lit(rules.STAR_MEANS)) & ~F.regexp_like(said, F.lit(rules.STAR_OTHERWISE))


MAIL = r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}"


def may_mark(html: Column) -> Column:
    """Whether a page has words or stars that could mark its authors, so that it is worth parsing."""
    body = H.raw(html)
    return F.regexp_like(body, F.lit(rules.CA_BLOCK + "|corresponding-author")) | (F.regexp_like(body, F.lit("[*∗]")) & F.regexp_like(body, F.lit(rules.STAR_MEANS)))


def whole_text(els: Column, e: Column) -> Column:
    """An element's text with that of its descendants, which stand behind it in the page's list."""
    inner = F.slice(els, e["pre"] + 1, e["post"] - e["pre"] + 1)
    return F.array_join(F.filter(F.transform(inner, lambda x: x["text"]), lambda t: t != ""), " ")


def attribute_of(e: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(e["attrs"], F.lit(name)), F.lit(""))


def named_by_blocks(els: Column, authors: Column, longest_block: int = 1200, above: int = 6) -> Column:
    """The names of authors whom a compact block of their page calls corresponding.

    A block is an element with a marker, or one of its ``above`` elements above, of ``longest_block`` characters at most; it
    counts if it names exactly one author, or where the page has one author and the block an address. The innermost
    counting block of each marker decides. ``els`` are a page's elements in order (``dom.with_elements``).
    """
    marker = lambda e: (F.regexp_like(e["text"], F.lit(rules.CA_BLOCK)) | F.lower(attribute_of(e, "class")).contains("corresponding-author")) & ~e["tag"].isin("script", "style", "title")
    around = lambda m: F.filter(F.slice(els, 1, m["pre"] + 1), lambda e: (e["post"] >= m["post"]) & (e["depth"] >= m["depth"] - above))
    mailed = lambda e: F.exists(F.slice(els, e["pre"] + 1, e["post"] - e["pre"] + 1), lambda x: (x["tag"] == "a") & F.regexp_like(attribute_of(x, "href"), F.lit("(?i)^mailto:[^?]")))
    names = lambda xs: F.transform(xs, lambda a: a["name"])

    def judged(e: Column) -> Column:
        def by_text(t: Column) -> Column:
            who = F.filter(authors, lambda a: speaks_of(t, a["name"]))
            one = let(who, lambda w: F.when(F.size(w) == 1, names(w)).when((F.size(authors) == 1) & (mailed(e) | F.regexp_like(t, F.lit(MAIL))), names(authors)))
            return F.when(F.length(t) <= longest_block, one)

        return let(whole_text(els, e), by_text)

    inner = lambda m: F.element_at(F.concat(F.array(none_of()), F.filter(F.transform(around(m), judged), lambda x: x.isNotNull())), -1)
    return F.array_distinct(F.flatten(F.transform(F.filter(els, marker), inner)))


def named_by_stars(els: Column, authors: Column, longest_block: int = 1200) -> Column:
    """The names of authors with a star in their byline, where the star's note beside it speaks of correspondence."""
    said = lambda e: F.lower(F.concat_ws(" ", *[attribute_of(e, a) for a in ("class", "id", "role", "property", "name", "title", "aria-label")]))
    byline = lambda e: F.regexp_like(said(e), F.lit(r"\b(author|authors|byline|by-line|contrib|contributor|creator)\b")) & ~e["tag"].isin("script", "style", "meta", "head", "title")
    parent = lambda e: F.try_element_at(els, e["parent"] + 1)

    def read(e: Column) -> Column:
        both = F.struct(whole_text(els, e).alias("t"), F.when(e["parent"] >= 0, whole_text(els, parent(e))).alias("up"))
        beside = lambda x: F.when(F.length(x["up"]) <= longest_block, x["up"]).otherwise(x["t"])
        fits = lambda x: (F.length(x["t"]) <= longest_block) & F.regexp_like(x["t"], F.lit("[*∗]")) & star_means(F.coalesce(beside(x), x["t"]))
        return let(both, lambda x: F.when(fits(x), F.transform(F.filter(authors, lambda a: starred(x["t"], a["name"])), lambda a: a["name"])).otherwise(none_of()))

    return F.array_distinct(F.flatten(F.transform(F.filter(els, byline), read)))


def named_on_pages(pages: DataFrame, authors: DataFrame, read: Callable[[Column, Column], Column], id_col: str, html_col: str) -> DataFrame:
    """(``id_col``, name): ``read`` of the elements and the authors of each page that may mark some; ``authors`` has (``id_col``, authors)."""
    told = pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")).where(may_mark(F.col(f"`{html_col}`"))).join(authors.where(F.size("authors") > 0), id_col)
    rows = dom.with_elements(told, html_col, "__els").select(id_col, F.explode(read(F.col("__els"), F.col("authors"))).alias("name"))
    return rows.distinct()


def corresponding_blocks(pages: DataFrame, authors: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(``id_col``, name) of authors whom a compact block of their page calls corresponding, see ``named_by_blocks``."""
    return named_on_pages(pages, authors, named_by_blocks, id_col, html_col)


def starred_authors(pages: DataFrame, authors: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(``id_col``, name) of authors with a telling star, see ``named_by_stars``."""
    return named_on_pages(pages, authors, named_by_stars, id_col, html_col)


def marked(authors: DataFrame, names: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``authors`` with those in ``names`` marked and, on a page where one is, the unknown ones as not corresponding."""
    lists = names.groupBy(id_col).agg(F.collect_set("name").alias("__who"))
    met = authors.join(lists, id_col, "left")
    mark = lambda a: F.when(F.array_contains("__who", a["name"]), True).otherwise(F.coalesce(a["is_corresponding"], F.lit(False)))
    return met.withColumn("authors", F.when(F.col("__who").isNotNull(), F.transform("authors", lambda a: with_parts(a, mark=mark(a)))).otherwise(F.col("authors"))).drop("__who")
