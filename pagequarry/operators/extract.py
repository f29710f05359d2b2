"""Extraction: ordered meta folds, affiliation joins, fallback ladders, PDF-link ranking, licence and version."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions import text as X
from ..functions import url as U
from . import openaccess

AUTHOR = "struct<name:string,affiliations:array<string>,is_corresponding:boolean>"
# --- fixed values: meta keys that open an author and that attach to the one before ---
AUTHOR_KEYS = ["citation_author", "dc.Creator", "bepress_citation_author"]
INSTITUTION_KEYS = ["citation_author_institution", "bepress_citation_author_institution"]
EMAIL_KEYS = ["citation_author_email"]
ABSTRACT_KEYS = ["citation_abstract", "og:description", "dc.description", "description"]
#: Links of a page that the query ``link_pdf_first`` ranks; ``links`` gives all of them.
CAP = 50


def fold_metas(html: Column) -> Column:
    """Authors from the ordered meta tags of one page: an author tag opens a group, institutions that follow join it.

    An institution before any author is passed over. ``is_corresponding`` is true where an e-mail follows, else null.
    """
    start = F.array().cast(f"array<{AUTHOR}>")

    def step(authors: Column, m: Column) -> Column:
        last = F.try_element_at(authors, F.lit(-1))
        rest = F.slice(authors, 1, F.greatest(F.size(authors) - 1, F.lit(0)))
        renewed = lambda affs, ca: F.concat(rest, F.array(F.struct(last["name"].alias("name"), affs.alias("affiliations"), ca.alias("is_corresponding"))))
        opened = F.struct(F.trim(m["content"]).alias("name"), F.array().cast("array<string>").alias("affiliations"), F.lit(None).cast("boolean").alias("is_corresponding"))
        return (
            F.when(m["key"].isin(AUTHOR_KEYS), F.concat(authors, F.array(opened)))
            .when(m["key"].isin(INSTITUTION_KEYS) & (F.size(authors) > 0), renewed(F.concat(last["affiliations"], F.array(F.trim(m["content"]))), last["is_corresponding"]))
            .when(m["key"].isin(EMAIL_KEYS) & (F.size(authors) > 0), renewed(last["affiliations"], F.lit(True)))
            .otherwise(authors)
        )

    return F.aggregate(F.filter(H.metas(html), lambda m: m["content"].isNotNull()), start, step)


def fold_groups(rows: DataFrame, key: str, order: str, opens: Column, value: str) -> DataFrame:
    """The same fold for a long table: rows that ``opens`` marks start a group within ``key``, the rows after them attach.

    Gives ``key``, ``group`` (from 1), ``head`` and ``members``; rows before the first opening are left out. Windows are
    within a key, one page or conversation.
    """
    at = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("group", F.sum(opens.cast("int")).over(at)).where("`group` > 0").withColumn("__open", opens)
    members = F.array_sort(F.collect_list(F.when(~F.col("__open"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return numbered.groupBy(key, "group").agg(F.max(F.when(F.col("__open"), F.col(value))).alias("head"), F.transform(members, lambda x: x["v"]).alias("members"))


def join_affiliations(authors: Column, affiliations: Column) -> Column:
    """Authors (name, aff_ids, is_corresponding) with the affiliations (organization, aff_id) that their ids name.

    An author without ids gets the affiliations without one; a single affiliation goes to every author still without.
    """
    named = lambda a: F.transform(F.filter(affiliations, lambda x: F.array_contains(F.transform(a["aff_ids"], lambda i: i.cast("string")), x["aff_id"].cast("string"))), lambda x: x["organization"])
    bare = F.transform(F.filter(affiliations, lambda x: x["aff_id"].isNull()), lambda x: x["organization"])
    own = lambda a: F.when(F.coalesce(F.size(a["aff_ids"]), F.lit(0)) > 0, named(a)).otherwise(bare)
    single = F.when(F.size(affiliations) == 1, F.transform(affiliations, lambda x: x["organization"])).otherwise(F.array().cast("array<string>"))
    return F.transform(authors, lambda a: F.struct(a["name"].alias("name"), F.when(F.size(own(a)) > 0, own(a)).otherwise(single).alias("affiliations"), a["is_corresponding"].alias("is_corresponding")))


def zip_if_equal(names: Column, values: Column) -> Column:
    """Pairs by position where both lists are equally long, else null."""
    return F.when(F.size(names) == F.size(values), F.arrays_zip(names.alias("name"), values.alias("value")))


def zip_shortest(names: Column, values: Column) -> Column:
    """Pairs by position, as many as the shorter list has."""
    n = F.least(F.size(names), F.size(values))
    return F.zip_with(F.slice(names, 1, n), F.slice(values, 1, n), lambda a, b: F.struct(a.alias("name"), b.alias("value")))


def settle_corresponding(authors: Column) -> Column:
    """A single author corresponds; with no one marked all are unknown; else those not marked are not."""
    marked = F.exists(authors, lambda a: F.coalesce(a["is_corresponding"], F.lit(False)))
    flag = lambda a: F.when(F.size(authors) == 1, F.lit(True)).when(marked, F.coalesce(a["is_corresponding"], F.lit(False)))
    return F.transform(authors, lambda a: F.struct(a["name"].alias("name"), a["affiliations"].alias("affiliations"), flag(a).alias("is_corresponding")))


def dedupe_authors(authors: Column) -> Column:
    """Authors with the same folded name become one, where the first stood: marked if any was, with the first non-empty affiliations."""

    def one(same: Column) -> Column:
        full = F.try_element_at(F.filter(same, lambda x: F.size(x["a"]["affiliations"]) > 0), F.lit(1))["a"]["affiliations"]
        marked = F.when(F.exists(same, lambda x: F.coalesce(x["a"]["is_corresponding"], F.lit(False))), True).otherwise(same[0]["a"]["is_corresponding"])
        return F.struct(same[0]["a"]["name"].alias("name"), F.coalesce(full, F.array().cast("array<string>")).alias("affiliations"), marked.alias("is_corresponding"))

    keyed = F.transform(authors, lambda a: F.struct(X.normalize_alpha(a["name"]).alias("k"), a.alias("a")))
    return X.let(keyed, lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda x: x["k"])), lambda k: X.let(F.filter(rows, lambda x: x["k"] == k), one)))


def drop_editors(authors: Column, editors: Column) -> Column:
    """Authors whom the editors' text doesn't name; all of them if it names every one."""
    kept = F.filter(authors, lambda a: ~F.coalesce(F.lower(editors).contains(F.lower(a["name"])), F.lit(False)))
    return F.when(F.size(kept) > 0, kept).otherwise(authors)


def mark_by_text(authors: Column, note: Column, least: int = 2) -> Column:
    """Marks the authors of whom a correspondence note has at least ``least`` name words."""
    words = lambda c: F.filter(F.split(X.normalize_alpha(c), " "), lambda w: F.length(w) > 1)
    hit = lambda a: F.size(F.array_intersect(words(a["name"]), words(note))) >= least
    return F.transform(authors, lambda a: F.struct(a["name"].alias("name"), a["affiliations"].alias("affiliations"), F.when(F.coalesce(hit(a), F.lit(False)), True).otherwise(a["is_corresponding"]).alias("is_corresponding")))


def mark_by_email(authors: Column, emails: Column) -> Column:
    """Marks an author if exactly one has a last name that an address's local part holds."""
    local = lambda e: F.lower(F.substring_index(e, "@", 1))
    last = lambda a: X.name_key(a["name"])["last"]
    named = lambda e: F.filter(authors, lambda a: (F.length(last(a)) > 2) & local(e).contains(last(a)))
    owners = F.transform(F.filter(emails, lambda e: F.size(named(e)) == 1), lambda e: named(e)[0]["name"])
    return F.transform(authors, lambda a: F.struct(a["name"].alias("name"), a["affiliations"].alias("affiliations"), F.when(F.array_contains(owners, a["name"]), True).otherwise(a["is_corresponding"]).alias("is_corresponding")))


def abstract_of(html: Column) -> Column:
    """The first meta description that passes for an abstract, without its label."""
    return X.strip_abstract_label(F.coalesce(*[X.abstract_gate(H.meta(html, k)) for k in ABSTRACT_KEYS]))


def links(html: Column, anchors: Column | None = None) -> Column:
    """All candidate links of a page, PDF-shaped ones first, else in order: PDF meta tag, script variables, anchors with a telling text, tooltip, title, query or PDF image, anchors right under an element for downloads, buttons that open a PDF; as (href, anchor, title, img).

    ``anchors``, where not null, are the page's own ones outside related content.
    """
    link = lambda href, anchor, title, img: F.struct(href.alias("href"), anchor.alias("anchor"), title.alias("title"), img.alias("img"))
    none = F.lit(None).cast("string")
    script = F.try_element_at(F.regexp_extract_all(H.raw(html), F.lit(r'"(?:pdfUrl|downloadPdfUrl|fullTextPdfUrl|exportPdfDownloadUrl)": ?"(.*?)"'), F.lit(1)), F.lit(1))
    script = F.replace(F.replace(script, F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    name = lambda a: (
        F.when(a["anchor"] != "", a["anchor"]).when(low(a["tooltip"]).contains("download pdf"), a["tooltip"])
        .when(low(a["title"]).contains("download fulltext") | low(a["title"]).contains("download pdf"), F.concat(F.lit("title: "), a["title"]))
        .when(low(a["href"]).contains("?create_pdf_query"), F.lit("pdf_generator")).when(low(a["img"]).contains("pdf"), F.concat(F.lit("image: "), a["img"]))
    )
    every = lambda bare: H.anchors(bare) if anchors is None else F.coalesce(anchors, H.anchors(bare))
    useful = lambda bare: F.filter(F.transform(every(bare), lambda a: link(a["href"], name(a), a["title"], a["img"])), lambda x: x["href"].isNotNull() & x["anchor"].isNotNull())
    pdf_meta = U.rewrite_meta_pdf(H.meta(html, "citation_pdf_url"), H.raw(html))
    named = F.array(F.struct(pdf_meta.alias("href"), F.lit("<meta citation_pdf_url>").alias("anchor")), F.struct(script.alias("href"), F.lit("JavaScript PDF").alias("anchor")))
    head = F.transform(F.filter(named, lambda x: x["href"].isNotNull()), lambda x: link(x["href"], x["anchor"], none, none))
    buttons = F.transform(F.filter(F.transform(H.tags(html, "button"), lambda b: F.regexp_extract(F.coalesce(H.attribute(b, "onclick"), F.lit("")), r"(https?://[^\s'\"]+\.pdf)", 1)), lambda u: u != ""), lambda u: link(u, F.lit("<button onclick>"), none, none))
    under = lambda bare: F.filter(F.transform(H.anchors_under(bare, rules.PDF_PARENTS), lambda a: link(a["href"], a["anchor"], none, none)), lambda x: x["href"].isNotNull())
    first = lambda found: F.concat(F.filter(found, lambda x: U.looks_like_pdf(x["href"])), F.filter(found, lambda x: ~U.looks_like_pdf(x["href"])))
    return X.let(X.let(H.without_scripts(html), lambda bare: F.concat(head, useful(bare), under(bare), buttons)), first)


def accepts(page_url: Column, link: Column, no_full_text: Column | None = None) -> Column:
    """Whether a link leads to the page's PDF: none of the six reasons against it, one of those for it. ``no_full_text`` tells pages where a link to the full text isn't one."""
    a, h, u = X.text_of(link["anchor"]), X.text_of(link["href"]), X.text_of(page_url)
    low, href = F.lower(a), F.lower(h)
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    against = U.known_bad_link(page_url, h, a) | a.contains("purchase") | U.bad_anchor(a) | U.bad_href(h) | (h.contains("\n") & ~h.contains("securityanddefence.pl")) | h.startswith("#")
    press = u.contains("utpjournals.press")
    title = F.lower(X.text_of(link["title"]))
    given = (
        (a == "<button onclick>") | (low.contains("pdf") & ~(press & h.contains("epdf")))
        | ((a.contains("download") | a.contains("télécharger")) & ~a.contains("citation"))
        | (h.contains("/bitstreams/") & like(h, r"/download/*$"))
        | ((low.contains("full text") | low.contains("текст статьи")) & ~press & ~(F.lit(False) if no_full_text is None else no_full_text))
        | (like(u, r"^https?://(www\.)?oclc\.org") & h.endswith(".pdf") & (low.contains("download") | low.contains("read")))
        | (u.contains("aida-itea.org") & h.contains("pdf"))
        | (like(u, r"^https?://(www\.)?rudmet\.ru/journal/") & like(h, r"^https?://(www\.)?rudmet\.net/media/articles/.*\.pdf$"))
        | (like(u, r"^https?://dspace\.library\.uu\.nl/") & low.contains("open access version via utrecht university repository"))
        | F.lower(X.text_of(link["img"])).contains("pdf") | title.contains("pdf") | (link["title"].isNotNull() & h.contains("download/pdf"))
        | (like(low, r"^(submitted|accepted|published) version(?:\s+\([0-9.,gmkb ]+\))?$") & (href.endswith(".pdf") | href.contains(".pdf?")))
    )
    return given & ~against  # few links have what speaks for them


def document_link(html: Column) -> Column:
    """The address of the first link to a word-processor document that nothing speaks against; null without one."""
    fits = lambda x: ~U.bad_href(x["href"]) & ~U.bad_anchor(x["anchor"]) & (x["href"].contains(".doc") | x["anchor"].contains(".doc"))
    return F.try_element_at(F.filter(links(html), fits), F.lit(1))["href"]


def view_link(page_url: Column, html: Column) -> Column:
    """The link by which a library of one host shows the article; null elsewhere."""
    found = F.filter(links(html), lambda x: x["anchor"] == rules.VIEW_ANCHOR)
    return F.when(F.regexp_extract(X.text_of(page_url), r"^[^:]*://([^/?#:]*)", 1).endswith(rules.VIEW_HOST), F.try_element_at(found, F.lit(1))["href"])


def pdf_link(page_url: Column, html: Column, anchors: Column | None = None) -> Column:
    """The address of the first accepted link, resolved against the page's base and rewritten; null without one."""
    other_text = F.exists(H.metas(html), lambda m: F.coalesce(m["key"].contains(rules.NO_FULL_TEXT), F.lit(False)))

    def of(u: Column) -> Column:
        first = F.try_element_at(F.filter(links(html, anchors), lambda x: accepts(u, x, other_text)), F.lit(1))["href"]
        base = X.let(H.base_url(html), lambda b: F.when(b != "", b).otherwise(u))
        target = X.let(first, lambda href: X.let(base, lambda b: F.when(href.isNotNull(), U.resolve(openaccess.router_base(href, b), href))))
        return U.stable_pdf_url(X.let(target, U.rewrite_pdf_url))

    return X.let(X.text_of(page_url), of)


def version_of(html: Column, publisher: bool) -> Column:
    """publishedVersion on a publisher's page; on a repository's accepted or submitted, by its words."""
    return F.lit("publishedVersion") if publisher else F.when(F.lower(H.raw(html)).contains("accepted manuscript"), "acceptedVersion").otherwise("submittedVersion")


def response(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", namespace: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each page's record: authors, urls, license, version, abstract, oa_status, and ``error`` for blocked pages, whose payload is empty.

    ``namespace`` 'doi' reads a publisher's page, 'pmh' a repository's, anything else gives an empty record. Columns in ``keep`` come along.
    """
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    space = namespace if namespace is not None else F.lit("doi")
    blocked = F.coalesce(H.block_reason(html).isin("cached_bot_check", "cached_pdf", "missing"), F.lit(False))
    live = space.isin("doi", "pmh") & ~F.col("__blocked")
    shaped = lambda a: F.struct(a["name"].alias("name"), F.transform(a["affiliations"], lambda x: F.struct(x.alias("name"))).alias("affiliations"), a["is_corresponding"].alias("is_corresponding"))
    from . import related

    pages = pages.withColumn("__anchors", related.own_anchors(html))
    pages, page = H.scanned(pages, html_col)
    authors = F.transform(dedupe_authors(fold_metas(page)), shaped)
    own, pdf = F.col("__own"), F.col("__pdf")
    rows = pages.withColumn("__blocked", blocked).withColumn("__own", H.page_url(page, url)).withColumn("__pdf", F.coalesce(openaccess.science_direct_pdf(own, page), pdf_link(own, page, F.col("__anchors")), openaccess.fallback_pdf(own, page)))
    rows = rows.withColumn("__pdf", F.when(F.col("__pdf").startswith("http") & ~openaccess.journal_index(page), F.col("__pdf"))).withColumn("__oa", F.when(live & (space == "doi"), openaccess.status(own, page)))
    return rows.select(
        F.col(f"`{id_col}`"),
        F.when(live, authors).otherwise(F.array().cast("array<struct<name:string,affiliations:array<struct<name:string>>,is_corresponding:boolean>>")).alias("authors"),
        F.when(live & pdf.isNotNull(), F.array(F.struct(pdf.alias("url"), F.lit("pdf").alias("content_type")))).otherwise(F.array().cast("array<struct<url:string,content_type:string>>")).alias("urls"),
        F.when(live & U.trusts_license(own), F.coalesce(F.when(F.col("__oa.oa_status") == "hybrid", F.col("__oa.license")), X.license_of(html))).alias("license"),
        F.when(live & pdf.isNotNull(), F.when(space == "doi", version_of(html, True)).otherwise(version_of(html, False))).alias("version"),
        F.when(live, abstract_of(page)).alias("abstract"),
        F.col("__oa.oa_status").alias("oa_status"),
        F.when(F.col("__blocked"), F.lit("UnusualTraffic")).alias("error"),
        *(keep or []),
    )


# --- fixed values: what each kind of request answers to without a page or a link: (status, message) ---
NO_PAGE = {"post": (400, "No html in request body"), "get": (404, "No landing page found"), "find_pdf": (404, "No landing page found")}
NO_LINK = (404, "No PDF link found")


def answered(pages: DataFrame, kind: str = "get", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", namespace: Column | None = None) -> DataFrame:
    """``response`` with the ``status`` and the ``msg`` that a request of that kind is answered with.

    ``post`` brings the page along, ``get`` names a cached one, ``find_pdf`` asks for the link alone: ``id_col``, ``status``, ``msg``, ``pdf_url``. A page that is
    missing, or not wanted as it has no link, has an empty payload. A blocked page is an answer of its own kind (200), as its ``error`` says.
    """
    status, msg = NO_PAGE[kind]
    asked = pages.withColumn("__missing", F.col(f"`{html_col}`").isNull())
    rows = response(asked, id_col, url_col, html_col, namespace, keep=["__missing"])
    told = lambda linked: {"status": F.when(F.col("__missing"), status).when(~linked, NO_LINK[0]).otherwise(200), "msg": F.when(F.col("__missing"), msg).when(~linked, NO_LINK[1])}
    if kind == "find_pdf":
        return rows.select(id_col, *[c.alias(n) for n, c in told(F.size("urls") > 0).items()], F.try_element_at("urls", F.lit(1))["url"].alias("pdf_url"))
    return rows.withColumns(told(F.lit(True)) | {"error": F.when(~F.col("__missing"), F.col("error"))}).drop("__missing")


def rung_of(c: Column) -> Column:
    """The rung of a candidate (rule_id, is_specific, prefer, authors, abstract): specific with affiliations; specific and preferred with authors; any other with affiliations; specific with authors or abstract; the generic one with either; null for none."""
    affs, some = F.exists(c["authors"], lambda a: F.size(a["affiliations"]) > 0), F.size(c["authors"]) > 0
    content = some | (F.coalesce(c["abstract"], F.lit("")) != "")
    return F.when(c["is_specific"] & affs, 1).when(c["is_specific"] & c["prefer"] & some, 2).when(~c["is_specific"] & affs, 3).when(c["is_specific"] & content, 4).when((c["rule_id"] == "generic") & content, 5)


def best_of(candidates: Column, before: Column | None = None) -> Column:
    """(rung, ord, rule_id, authors, abstract) of the best among a page's candidates and what was best ``before``; within a rung the order of the rules decides. Null without one."""
    ranked = lambda c: F.struct(rung_of(c).alias("rung"), c["ord"].alias("ord"), c["rule_id"].alias("rule_id"), c["authors"].alias("authors"), c["abstract"].alias("abstract"))
    found = F.filter(F.transform(candidates, ranked), lambda c: c["rung"].isNotNull())
    found = found if before is None else F.concat(F.filter(F.array(before), lambda c: c.isNotNull()), found)
    return F.array_min(found)


def ladder(candidates: DataFrame, id_col: str = "page_id") -> DataFrame:
    """For each page the best candidate of its extractors, given as rows: (rule_id, is_specific, prefer, ord, authors, abstract), see ``rung_of``. Authors and abstract stay together."""
    rung = rung_of({c: F.col(c) for c in ("rule_id", "is_specific", "prefer", "authors", "abstract")})
    return candidates.withColumn("rung", rung).where("rung is not null").groupBy(id_col).agg(F.min_by(F.struct("rule_id", "rung", "authors", "abstract"), F.struct("rung", "ord")).alias("best")).select(id_col, "best.*")


def answers(page: H.Page, rules: Iterable[tuple[str, str, str]]) -> Column:
    """The names of the rules (rule_id, signal, needle) that a scanned page answers to, in order. Signals: canonical, og_url, journal, publisher (any case), site (case kept), title (any case), description (at its start), words (anywhere in the page, lower case)."""
    rules = list(rules)
    signals = {"canonical": H.link_href(page, "canonical"), "og_url": H.meta(page, "og:url"), "journal": F.lower(H.meta(page, "citation_journal_title")), "publisher": F.lower(H.meta(page, "citation_publisher")), "site": H.meta(page, "og:site_name"), "title": F.lower(H.title(page)), "description": H.meta(page, "description"), "words": F.lower(H.raw(page))}
    named = F.struct(*[signals[n].alias(n) for n in dict.fromkeys(r[1] for r in rules)])
    hit = lambda s, signal, needle: s[signal].startswith(needle) if signal == "description" else s[signal].contains(needle.lower() if signal in ("journal", "publisher", "title") else needle)
    return X.let(named, lambda s: F.array_distinct(F.filter(F.array(*[F.when(hit(s, signal, needle), F.lit(rule)) for rule, signal, needle in rules]), lambda x: x.isNotNull())))


def dispatch(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Which rules a page answers to, in rows: (``id_col``, ``rule_id``, ``ord``)."""
    rules = list(rules)
    pages, page = H.scanned(pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")), html_col)
    places = F.array(*[F.lit(r[0]) for r in rules])
    return pages.select(F.col(f"`{id_col}`"), F.explode(answers(page, rules)).alias("rule_id")).withColumn("ord", F.array_position(places, F.col("rule_id")) - 1)


def by_css(table: DataFrame, author: str, name: str = "", affiliation: str = "", corresponding: str = "", id_col: str = "page_id") -> DataFrame:
    """Authors of each page from lists: elements at ``author``; their name, affiliations and mark are at paths within them."""
    from . import dom

    people = dom.select(table, author, id_col)
    within = lambda path: dom.select(table, f"{author} {path}", id_col)
    joined = lambda found, what: (
        people.alias("p").join(found.alias("f"), (F.col(f"p.{id_col}") == F.col(f"f.{id_col}")) & (F.col("f.pre") > F.col("p.pre")) & (F.col("f.pre") <= F.col("p.post")))
        .select(F.col(f"p.{id_col}").alias(id_col), F.col("p.id").alias("id"), F.col("f.id").alias("part")).join(dom.texts(found, table, id_col).withColumnRenamed("id", "part"), [id_col, "part"])
        .groupBy(id_col, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "full_text"))), lambda x: x["full_text"]).alias(what))
    )
    rows = dom.texts(people, table, id_col).withColumnRenamed("full_text", "whole")
    rows = rows.join(joined(within(name), "names"), [id_col, "id"], "left") if name else rows.withColumn("names", F.array("whole"))
    rows = rows.join(joined(within(affiliation), "affs"), [id_col, "id"], "left") if affiliation else rows.withColumn("affs", F.array().cast("array<string>"))
    rows = rows.join(joined(within(corresponding), "marks"), [id_col, "id"], "left") if corresponding else rows.withColumn("marks", F.lit(None).cast("array<string>"))
    author_row = F.struct("id", F.struct(X.squeezed(F.regexp_replace(F.coalesce(F.col("names")[0], F.col("whole")), r"[\d,*†‡§]+$", "")).alias("name"), F.coalesce("affs", F.array().cast("array<string>")).alias("affiliations"), F.when(F.size("marks") > 0, True).alias("is_corresponding")).alias("a"))
    return rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(author_row)), lambda x: x["a"]).alias("authors"))
