"""Pages of one large publishing group: seven ways to list authors, tried in order, then rounds of marking, cleaning and repair.

The selectors are rows for the automaton; all here are Column functions of what these mark on a page. A way that finds nobody
passes on to the next. Corresponding authors come from addresses only where these tell authors apart (some have one, not all), by
last name and initial, by the last name alone only where one author has it; what the page says in words overrules addresses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from . import extract
from .people import author, none_of, repaired, with_parts

let = X.let

# --- fixed values: (rule, signal, needle) of the pages; selectors by role; word lists of the pages ---
RULES = [
    ("springer_ladder", "canonical", "link.springer.com"), ("springer_ladder", "canonical", "springeropen.com"), ("springer_ladder", "canonical", "springermedizin.de"), ("springer_ladder", "canonical", "springerpflege.de"),
    ("springer_ladder", "canonical", "mijn.bsl.nl"), ("springer_ladder", "og_url", "nature.com"), ("springer_ladder", "og_url", "biomedcentral.com"), ("springer_ladder", "og_url", "springermedizin.de"),
    ("springer_ladder", "og_url", "springerpflege.de"), ("springer_ladder", "og_url", "mijn.bsl.nl"), ("springer_ladder", "title", "springermaterials"), ("springer_ladder", "publisher", "SpringerMaterials"),
]
SELECTORS = {
    "listed": "li.c-article-authors-listing__item", "listed/name": "span[class*=search-name]", "listed/corresponding": "span[class*=search-name] a[id*=corresp]", "listed/place": "ol[class*=affiliation__list] li p",
    "indexed": "#authorsandaffiliations li[itemprop=author]", "indexed/name": "span", "indexed/ref": "ul[data-role=AuthorsIndexes] > *", "indexed_place": "#authorsandaffiliations li.affiliation", "indexed_place/span": "span[itemprop]",
    "grouped": "ol.c-article-author-affiliation__list li[id*=A]", "grouped/place": "p[class*=affiliation__address]", "grouped/names": "p[class*=authors-list]",
    "entry": "dd#authors li", "entry/-link": "a", "entry/-sup": "sup", "entry_place": "dd.author-affiliation li",
    "editor": "#editorsandaffiliations li[itemprop=editor]", "editor/name": "span", "editor/ref": "ul[data-role=AuthorsIndexes] > *", "editor_place": "#editorsandaffiliations li.affiliation", "editor_place/span": "span[itemprop]",
    "short": "ul.c-article-author-list [data-test=author-name]", "editors": "#editor-information-section, #editor-information-content",
    "said": "p, [id*=corresp], [class*=corresp]", "said/mail": "a[href*='mailto:']",
    "old": "section.Abstract", "old/-heading": ".Heading", "old/-reference": "span.CitationRef",
    "abstract": "section[data-title=Abstract]", "abstract/inner": "div[class*=c-article-section] p", "abstract/p": "p",
    "introduction": "section[data-title=Introduction]", "introduction/p": "p", "chapter": "section[class*=Section1]", "chapter/head": "h2", "chapter/p": "p",
    "section": "section", "section/head": "h1, h2, h3", "section/p": "p, li", "content": "div.c-article-section__content", "main": "div.main-content",
}
DEGREES = ["BA", "BS", "BSC", "DDS", "DMD", "DPHIL", "FBA", "FACP", "FRS", "FRCPC", "FRCP", "FRCPCH", "FRCS", "MA", "MBA", "MBBS", "MD", "MPH", "MSC", "PHD", "RN"]
OPENING_HEADS = ["introduction", "abstract", "summary"]
OTHER_ABSTRACTS = ["zusammenfassung", "samenvatting", "résumé", "resume", "resumen", "riassunto"]
PARTS_OF_ABSTRACTS = ["background", "objective", "objectives", "case presentation", "methods", "method", "results", "conclusion", "conclusions"]
MAIN_ABSTRACT = r"(?i)\bAbstract\b\s+(.*?)(?:\s+Get Access\s+PDF|\s+Impact of COVID-19 pandemic|\s+View PDF|\s+Cite this page|\s+References?\s*\(|$)"
NO_DEFINITION = r"(?i)reprints and permissions|^authors and affiliations|^editors and affiliations|^cite this entry|^© "
NO_SUMMARY = r"(?i)reprints and permissions|download citation|^cite this article|^credit:"
SHORTEST_ABSTRACT, SHORTEST_DEFINITION, SHORTEST_SUMMARY, SHORTEST_NAME, SECTIONS, CHAPTERS, BEGINNING = 80, 30, 120, 5, 12, 5, 30


def role(marks: Column, name: str) -> Column:
    return F.filter(marks, lambda m: m["role"] == name)


def clean(text: Column) -> Column:
    """White space, fixed spaces too, as single spaces."""
    return X.squeezed(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")))


def texts(of: Column, name: str) -> Column:
    """The non-empty texts of a mark's parts."""
    return F.filter(F.transform(role(of["parts"], name), lambda p: clean(p["text"])), lambda t: t != "")


def first(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(1))


def filled(xs: Column) -> Column:
    """A list, or null if it has no element."""
    return let(xs, lambda v: F.when(F.size(v) > 0, v))


def unmarked() -> Column:
    return F.lit(None).cast("boolean")


def listed(marks: Column) -> Column:
    """Authors of items that hold their places; a star behind a name is not of it."""
    return F.transform(role(marks, "listed"), lambda m: author(F.regexp_replace(F.coalesce(first(texts(m, "name")), F.lit("")), r"[\s*∗]+$", ""), texts(m, "place"), F.size(role(m["parts"], "corresponding")) > 0))


def indexed(marks: Column, kind: str) -> Column:
    """Authors (or editors) of the older pages, whose numbers name the places."""
    person = lambda m: F.struct(F.coalesce(first(texts(m, "name")), F.lit("")).alias("name"), texts(m, "ref").alias("aff_ids"), unmarked().alias("is_corresponding"))
    told = lambda m: F.filter(role(m["parts"], "span"), lambda p: p["attrs"]["itemprop"] != "address")
    place = lambda m: F.struct(F.array_join(F.transform(told(m), lambda p: clean(p["text"])), ", ").alias("organization"), F.right(F.coalesce(F.try_element_at(m["attrs"], F.lit("data-affiliation-highlight")), F.lit("")), F.lit(1)).alias("aff_id"))
    return let(F.struct(F.transform(role(marks, kind), person).alias("people"), F.transform(role(marks, f"{kind}_place"), place).alias("places")), lambda x: extract.join_affiliations(x["people"], x["places"]))


def degree(token: Column) -> Column:
    return F.upper(F.regexp_replace(token, "[^A-Za-z]", "")).isin(DEGREES)


def separate(names: Column) -> Column:
    """The names of a running list: cut at commas and ``&``; a degree or a piece too short for a name belongs to the name before; what holds a bracket is none."""
    pieces = F.filter(F.transform(F.split(F.replace(names, F.lit("&"), F.lit(",")), ","), clean), lambda t: t != "")
    behind = lambda done, t: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(", "), t)))
    joined = F.aggregate(pieces, none_of(), lambda done, t: F.when((F.size(done) > 0) & ((F.length(t) < SHORTEST_NAME - 1) | degree(t)), behind(done, t)).otherwise(F.concat(done, F.array(t))))
    return F.filter(joined, lambda t: ~t.contains("("))


def grouped(marks: Column) -> Column:
    """Authors of a list of places, each with the names of those who work there; a name in several places has all of them."""
    one = lambda m: let(F.substring_index(first(texts(m, "place")), "E-mail", 1), lambda p: F.transform(separate(first(texts(m, "names"))), lambda n: F.struct(F.lower(n).alias("key"), n.alias("name"), clean(p).alias("place"))))
    both = F.filter(role(marks, "grouped"), lambda m: (F.size(texts(m, "place")) > 0) & (F.size(texts(m, "names")) > 0))

    def gathered(rows: Column) -> Column:
        own = lambda k: F.filter(rows, lambda r: r["key"] == k)
        return F.transform(F.array_distinct(F.transform(rows, lambda r: r["key"])), lambda k: let(own(k), lambda rs: author(rs[0]["name"], F.array_distinct(F.filter(F.transform(rs, lambda r: r["place"]), lambda p: p != "")), unmarked())))

    return let(F.flatten(F.transform(both, one)), gathered)


def entries(marks: Column) -> Column:
    """Authors of a data sheet: a raised id names a place, else its title is one."""
    read = F.transform(role(marks, "entry_place"), lambda m: F.struct(F.regexp_extract(clean(m["text"]), r"^([A-Za-z0-9_]+)\s+(.+)$", 1).alias("id"), F.regexp_extract(clean(m["text"]), r"^([A-Za-z0-9_]+)\s+(.+)$", 2).alias("place")))

    def people(places: Column) -> Column:
        def one(m: Column) -> Column:
            sup = first(role(m["parts"], "sup"))
            named = F.filter(places, lambda p: (p["id"] != "") & (p["id"] == F.regexp_replace(clean(sup["text"]), r"^[() ]+|[() ]+$", "")))
            title = F.trim(F.coalesce(F.try_element_at(sup["attrs"], F.lit("title")), F.lit("")))
            affs = F.when(F.size(named) > 0, F.array(F.element_at(named, -1)["place"])).when(title != "", F.array(title)).otherwise(none_of())
            return author(F.regexp_replace(clean(m["rest"]), "^[ ,]+|[ ,]+$", ""), affs, unmarked())

        return F.filter(F.transform(role(marks, "entry"), one), lambda a: a["name"] != "")

    return let(read, people)


def said(marks: Column) -> Column:
    """Whom the page calls its corresponding author in words: after ``Correspondence to`` near the start of a paragraph, else after ``Corresponding author`` where a mail link follows; null if nobody."""
    begins = lambda m, words: F.lower(F.substring(clean(m["text"]), 1, BEGINNING)).contains(words)
    to = first(F.filter(role(marks, "said"), lambda m: (m["tag"] == "p") & begins(m, "correspondence to")))
    of = first(F.filter(role(marks, "said"), lambda m: begins(m, "corresponding author") & (F.size(role(m["parts"], "mail")) > 0)))
    name = F.trim(F.regexp_replace(F.regexp_extract(clean(to["text"]), r"(?i)correspondence\s+to\s*[:.]?\s*(.+)$", 1), r"\.$", ""))
    other = F.regexp_extract(F.substring_index(clean(of["text"]), "@", 1), r"(?i)corresponding\s+author[:\s]*(.+?)(?:\s*[,(]|$)", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.trim(other), F.lit("")))


def words_of(text: Column) -> Column:
    """A name's telling words: of two letters or more, no degree."""
    words = F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.filter(words, lambda w: ~degree(w)), X.normalize_alpha), lambda w: (F.length(w) > 1) & (w != "ph")))


def means(words: Column, name: Column) -> Column:
    """Whether what is said means an author: it holds the name, or two of its words."""
    return (name != "") & (F.lower(words).contains(F.lower(name)) | (F.size(F.array_intersect(words_of(words), words_of(name))) >= 2))


def person(name: Column) -> Column:
    """(last, initial) of ``Last, First`` or ``First Last``, lower case."""
    def read(n: Column) -> Column:
        turned = (F.length(n) - F.length(F.replace(n, F.lit(","), F.lit("")))) == 1
        given = F.when(turned, F.trim(F.substring_index(n, ",", -1))).when(n.contains(" "), n).otherwise("")
        return F.struct(F.when(turned, F.trim(F.substring_index(n, ",", 1))).otherwise(F.substring_index(n, " ", -1)).alias("last"), F.substring(given, 1, 1).alias("initial"))

    return let(F.lower(clean(name)), read)


def addressed(metas: Column, records: Column) -> Column:
    """The names that addresses beside them tell apart: in the meta tags, and in the page's records (both as authors, marked where one has an address); none where all have one."""
    mailed = lambda xs: F.transform(F.filter(xs, lambda a: F.coalesce(a["is_corresponding"], F.lit(False))), lambda a: a["name"])
    tells = lambda total, n: (n > 0) & ((total < 2) | (n < total))
    names = lambda xs, total: let(F.coalesce(mailed(xs), none_of()), lambda m: F.when(tells(total, F.size(m)), m).otherwise(none_of()))
    return F.concat(names(metas, F.size(metas)), names(records, F.when(F.size(metas) > 0, F.size(metas)).otherwise(F.size(records))))


def marked_by_addresses(authors: Column, names: Column) -> Column:
    """Marks the authors that ``names`` mean, never clears a mark."""
    keys = F.transform(names, person)

    def with_keys(ks: Column) -> Column:
        own = F.transform(authors, lambda a: person(a["name"]))
        alone = lambda p, all_: F.size(F.filter(all_, lambda o: o["last"] == p["last"])) == 1
        hit = lambda a, all_: let(person(a["name"]), lambda p: F.exists(ks, lambda k: (k["last"] == p["last"]) & ((k["initial"] == p["initial"]) | alone(p, all_))))
        return let(own, lambda all_: F.transform(authors, lambda a: with_parts(a, mark=F.when(hit(a, all_), True).otherwise(a["is_corresponding"]))))

    return F.when(F.size(names) > 0, let(keys, with_keys)).otherwise(authors)


def once(authors: Column) -> Column:
    """Each author once, by the name without regard to case: the first one's place and name, the affiliations of the first that has any, marked if one is."""
    tidy = F.filter(F.transform(authors, lambda a: author(clean(a["name"]), F.filter(F.transform(a["affiliations"], clean), lambda t: t != ""), a["is_corresponding"])), lambda a: a["name"] != "")

    def merged(all_: Column) -> Column:
        same = lambda k: F.filter(all_, lambda a: F.lower(a["name"]) == k)
        mark = lambda xs: F.when(F.exists(xs, lambda a: F.coalesce(a["is_corresponding"], F.lit(False))), True).otherwise(xs[0]["is_corresponding"])
        placed = lambda xs: F.coalesce(first(F.filter(xs, lambda a: F.size(a["affiliations"]) > 0))["affiliations"], none_of())
        return F.transform(F.array_distinct(F.transform(all_, lambda a: F.lower(a["name"]))), lambda k: let(same(k), lambda xs: author(xs[0]["name"], placed(xs), mark(xs))))

    return let(tidy, merged)


def without_editors(authors: Column, editors: Column) -> Column:
    """Authors whom the page's section on editors doesn't name; all, if it names all."""
    rest = F.filter(authors, lambda a: (F.length(a["name"]) < 3) | ~F.coalesce(F.lower(editors).contains(F.lower(a["name"])), F.lit(False)))
    return let(rest, lambda r: F.when(F.size(r) > 0, r).otherwise(authors))


def steps(marks: Column, page: H.Page) -> list[dict[str, Column]]:
    """Columns to be added one after another; the last adds ``__ladder``, (authors, abstract), null where ``marks`` is, as the page isn't one of these."""
    from .families import ld_authors

    own = lambda c: F.when(marks.isNotNull(), c)
    authors = F.col("__authors")
    in_words = lambda name: F.coalesce(means(F.col("__said"), name), F.lit(False))
    data_sheet = F.lower(H.title(page)).contains("springermaterials") | F.coalesce(F.lower(H.meta(page, "citation_publisher")).contains("springermaterials"), F.lit(False))
    short = F.array_distinct(F.filter(F.transform(role(marks, "short"), lambda m: F.regexp_replace(clean(m["text"]), "^[ ,]+|[ ,]+$", "")), lambda t: t != ""))
    key = lambda n: let(person(n), lambda p: F.concat_ws(" ", p["last"], p["initial"]))
    metas = F.transform("__metas_authors", lambda a: author(a["name"], F.transform(a["affiliations"], lambda t: F.substring_index(t, "Fax", 1)), unmarked()))
    ways = [listed(marks), indexed(marks, "indexed"), grouped(marks), F.when(F.col("__sheet"), entries(marks)), metas, indexed(marks, "editor"), F.col("__records_authors")]
    some = [filled(w.cast(f"array<{extract.AUTHOR}>")) for w in ways]  # the later ones only where the earlier find nobody
    chosen = F.when(F.length("__shown") > F.coalesce(F.length("__stated"), F.lit(0)), F.col("__shown")).otherwise(F.col("__stated"))
    return [
        {"__said": own(said(marks)), "__editors": own(clean(first(role(marks, "editors"))["text"])), "__short": own(short), "__stated": own(stated_abstract(page)), "__sheet": own(data_sheet), "__metas_authors": own(extract.fold_metas(page)), "__records_authors": own(ld_authors(page))},
        {"__authors": own(F.coalesce(*some, none_of(extract.AUTHOR))), "__mailed": own(addressed(F.col("__metas_authors"), F.col("__records_authors"))), "__shown": own(shown_abstract(marks, page, F.col("__sheet")))},
        {"__authors": own(F.transform(authors, lambda a: with_parts(a, mark=F.when(in_words(clean(a["name"])), True).otherwise(a["is_corresponding"])))), "__abstract": own(F.coalesce(chosen, recovered_abstract(marks, page)))},
        {"__authors": own(marked_by_addresses(authors, F.col("__mailed")))},
        {"__authors": own(without_editors(once(authors), F.col("__editors")))},
        {"__authors": own(repaired(authors, F.col("__short"), F.col("__editors"), key=key))},
        {"__whom": own(F.transform(F.filter(authors, lambda a: in_words(a["name"])), lambda a: a["name"]))},
        {"__ladder": own(F.struct(F.when(F.size("__whom") > 0, F.transform(authors, lambda a: with_parts(a, mark=F.array_contains("__whom", a["name"])))).otherwise(authors).alias("authors"), F.col("__abstract").alias("abstract")))},
    ]


def paragraphs(m: Column, name: str = "p") -> Column:
    """The texts of a section's paragraphs, a line each; null if it has none."""
    return F.nullif(F.array_join(texts(m, name), "\n"), F.lit(""))


def shown_abstract(marks: Column, page: H.Page, sheet: Column) -> Column:
    """The abstract as the page shows it, else a chapter's opening, a data sheet's or dictionary's text, else the longer description in the metas."""
    own, intro = first(role(marks, "abstract")), first(role(marks, "introduction"))
    opening = F.filter(F.slice(role(marks, "chapter"), 1, CHAPTERS), lambda m: F.lower(F.coalesce(first(texts(m, "head")), F.lit(""))).isin(OPENING_HEADS) & (F.size(texts(m, "p")) > 0))
    long_enough = lambda t, n: F.when(F.length(t) >= n, t)
    main = long_enough(F.trim(F.regexp_extract(clean(first(role(marks, "main"))["text"]), MAIN_ABSTRACT, 1)), SHORTEST_ABSTRACT)
    entry = F.coalesce(H.link_href(page, "canonical").contains("link.springer.com/referencework"), F.lit(False)) | F.coalesce(H.meta(page, "og:url").contains("link.springer.com/referencework"), F.lit(False))
    definition = first(F.filter(F.transform(role(marks, "content"), lambda m: F.regexp_replace(clean(m["text"]), r"^n\s+", "")), lambda t: (F.length(t) >= SHORTEST_DEFINITION) & ~F.regexp_like(t, F.lit(NO_DEFINITION))))
    described = F.filter(F.transform(F.array(H.meta(page, "og:description"), H.meta(page, "description")), lambda t: F.trim(t)), lambda t: t.isNotNull() & (F.length(t) >= SHORTEST_ABSTRACT))
    longer = F.array_max(F.transform(described, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return F.coalesce(F.nullif(clean(first(role(marks, "old"))["rest"]), F.lit("")), paragraphs(own, "inner"), paragraphs(own), first(texts(intro, "p")), first(F.transform(opening, lambda m: first(texts(m, "p")))), F.when(sheet, main), F.when(entry, definition), longer)


def recovered_abstract(marks: Column, page: H.Page) -> Column:
    """Of a page without an abstract: a section headed so in another language, the sections of a structured one on end, or the first content of some length."""
    sections = F.slice(role(marks, "section"), 1, SECTIONS)
    head = lambda m: F.lower(F.trim(F.coalesce(F.nullif(F.try_element_at(m["attrs"], F.lit("data-title")), F.lit("")), first(texts(m, "head")), F.lit(""))))
    text = lambda m: F.coalesce(paragraphs(m), F.nullif(clean(m["text"]), F.lit("")))
    read = F.transform(sections, lambda m: F.struct(head(m).alias("head"), text(m).alias("text")))
    other = lambda xs: first(F.filter(xs, lambda s: s["head"].isin(OTHER_ABSTRACTS) & (F.length(s["text"]) >= SHORTEST_ABSTRACT)))["text"]
    start = F.struct(none_of().alias("texts"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        part = x["head"].isin(PARTS_OF_ABSTRACTS)
        added = F.when(part & x["text"].isNotNull() & ~s["over"], F.concat(s["texts"], F.array(x["text"]))).otherwise(s["texts"])
        return F.struct(added.alias("texts"), (s["over"] | (~part & (F.size(s["texts"]) > 0))).alias("over"))

    structured = lambda xs: F.aggregate(xs, start, step, lambda s: F.when(F.size(s["texts"]) >= 2, F.array_join(s["texts"], "\n")))
    magazine = F.coalesce(H.link_href(page, "canonical").contains("nature.com"), F.lit(False)) | F.coalesce(H.meta(page, "og:url").contains("nature.com"), F.lit(False))
    summary = first(F.filter(F.transform(role(marks, "content"), lambda m: clean(m["text"])), lambda t: (F.length(t) >= SHORTEST_SUMMARY) & ~F.regexp_like(t, F.lit(NO_SUMMARY))))
    return F.coalesce(let(read, lambda xs: F.coalesce(other(xs), structured(xs))), F.when(magazine, summary))


def stated_abstract(page: H.Page) -> Column:
    """The first description in the page's records that isn't blank."""
    described = F.filter(F.transform(H.ld_json(page), lambda b: F.coalesce(F.get_json_object(b, "$.mainEntity.description"), F.get_json_object(b, "$.description"))), lambda t: F.coalesce(F.trim(t), F.lit("")) != "")
    return first(described)
