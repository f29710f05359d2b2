"""Extractor families as rule rows: which pages a rule answers to, and which elements hold authors, names, affiliations, marks and abstract.

One engine reads all rules: pages are matched to rules by their signals, the selectors of all rules mark the elements of those
pages in one pass, and what lies inside an author's element becomes the author's. The best candidate of a page is
chosen by the ladder, stage after stage, together with the generic meta fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from . import dom, extract, people, publishers, selectors

# --- fixed values: (rule, signal, needle, author, name, affiliation, corresponding, abstract); an empty selector is not used ---
FAMILIES = [
    ("aaas", "canonical", "science.org", "div[property=author]", "", "div[property=affiliation]", "a[href^=mailto]", "section#abstract"),
    ("acm", "og_url", "acm.org", "span[class*=author-info]", "[class*=author-name]", "[class*=author_inst]", "", "div.abstractInFull"),
    ("ama", "canonical", "jamanetwork.com", "span.wi-fullname", "", "", "", ""),
    ("aom", "og_url", "aom.org", "div.accordion-tabbed__tab-mobile", "a.author-name", "div.author-info", "", "div.abstractInFull"),
    ("asce", "og_url", "ascelibrary.org", "[class*=author-block]", ".authorName", ".authorAffiliation", "a[href*=email-protection]", ""),
    ("ash", "og_url", "ashpublications.org", ".al-author-name", "a.linked-name", "div.aff", ".info-card-footnote", "section.abstract"),
    ("asj", "journal", "Astronomical Journal", "li.author", "a", "span.affiliation", "", ""),
    ("asm", "og_url", "journals.asm.org", "[property=author]", "[property=familyName]", "[property=organization]", "a[href*=email-protection]", "section#abstract"),
    ("bmj", "og_url", "bmj.com", "li.contributor", "span.name", "li.aff", "span.contrib-email", ""),
    ("brill", "og_url", "brill.com", "div.contributor-line", "span.contributor-details-link", "span.institution", "", "section.abstract"),
    ("cairn", "og_url", "cairn.info", "div.auteur", ".nompers", "div.affiliation", "", ""),
    ("chicago", "og_url", "journals.uchicago.edu", "a.author-name", "", "", "", "div.abstractInFull"),
    ("cup", "og_url", "cambridge.org", "div.author", "dt", "span.affiliation", "a[href^=mailto]", "div.abstract"),
    ("de_gruyter", "og_url", "degruyter.com", "span.contributor", "", "", "", "div.abstract"),
    ("edp_sciences", "publisher", "EDP Sciences", "span.author", "", "", "", ""),
    ("elsevier", "canonical", "sciencedirect.com", "a.author-name", "", "", "", "div.section-paragraph"),
    ("emerald", "canonical", "emerald.com", "div[contrib-type=author]", "", "span.intent_contributor_affiliate", "", ""),
    ("f1000", "journal", "f1000", "a.author-link", "", "", "", ".abstract__content"),
    ("frontiers", "og_url", "frontiersin.org", "span.author-wrapper", "", "", "", "div.JournalAbstract"),
    ("hindawi", "canonical", "hindawi.com", "span.articleHeader__authors_author", "", "", "a[href*=mailto]", "#abstract"),
    ("iop", "og_url", "iopscience.iop.org", ".author-list__name", "", "", "", ".wd-jnl-art-abstract"),
    ("jmir", "og_url", "jmir.org", "a.authors-list__author", "", "", "", ""),
    ("jsme", "og_url", "www.jstage", "a.global-authors-name-tags", "", "", "", "#article-overiew-abstract-wrap"),
    ("karger", "og_url", "karger.com", ".al-author-name", "a.linked-name", "div.aff", ".info-card-footnote", ""),
    ("lippincott", "og_url", "journals.lww.com", ".al-author-name", "a.linked-name", "", ".article-footnote", "section#abstractWrap"),
    ("mary_ann_liebert", "og_url", "liebertpub.com", "div[class*=tab-mobile]", "span", "", "i.icon-Email", "div.abstractInFull"),
    ("mdpi", "og_url", "mdpi.com", "span.inlineblock", "", "", "", "section.html-abstract"),
    ("nas", "og_url", "pnas.org", "div[class*=author-tooltip-]", ".author-tooltip-name", ".author-affiliation", ".author-corresp-email-link", "div.abstract"),
    ("openedition", "og_url", "openedition.org", "div.author", ".description", ".affiliation", "", ""),
    ("oxford", "og_url", "academic.oup.com", "div.info-card-author", "div.info-card-name", "div.aff", "div.info-author-correspondence", "section.abstract"),
    ("permagon", "publisher", "iwa publishing", ".al-author-name", ".info-card-name", "", ".info-author-correspondence", ""),
    ("plos", "og_url", "plos.org", "li[data-js-tooltip]", "a.author-name", "p[id*=authAffiliations]", "span.email", "div.abstract-content"),
    ("research_square", "canonical", "researchsquare.com", "div.author", "h5", "h6", "", ""),
    ("royal_society", "og_url", "royalsocietypublishing.org", "div.author", "span", ".author-info", "a[href*=email-protection]", "div.abstractInFull"),
    ("rsc", "og_url", "pubs.rsc.org", ".article__author-link", "", "", "", ""),
    ("rxiv", "og_url", "rxiv.org", "div[class*=author-tooltip-]", "div.author-tooltip-name", "div.author-affiliation", "", "div.abstract"),
    ("sage", "og_url", "journals.sagepub.com", "div[typeof=Person]", "span[property=name]", "[property=organization]", "a[property=email]", "section[property=abstract]"),
    ("scielo_preprints", "canonical", "scielo.org", "ul.authors", "span.name", "", "", ""),
    ("springer", "canonical", "springer.com", "li.c-article-author-list__item", "a[data-test=author-name]", "", "a[id*=corresp]", "section[data-title=Abstract]"),
    ("ssrn", "canonical", "papers.ssrn.com", "div.author", "h3", "h4", "", "div.abstract-text"),
    ("taylor", "og_url", "tandfonline.com", "div.entryAuthor", "a.author", "span.overlay", "span.corr-email", "div.hlFld-Abstract"),
    ("ucal_press", "og_url", "online.ucpress.edu", ".al-author-name", "a.linked-name", ".al-author-info-wrap", "a[href*=mailto]", "section.abstract"),
    ("wiley", "og_url", "onlinelibrary.wiley.com", "span.accordion__closed", "p.author-name", "div.author-affiliation", "a[href*=mailto]", "section[class*=abstract]"),
    ("world_scientific", "og_url", "worldscientific.com", "div.accordion-tabbed__tab-mobile", "a", "div.author-info", "div.bottom-info", "div.abstractInFull"),
]
# --- fixed values: families whose authors carry the ids of their affiliations: (rule, signal, needle, author, ids inside it, affiliation, label inside that) ---
ID_FAMILIES = [
    ("mdpi_ids", "og_url", "mdpi.com", "span.inlineblock", "sup", "div.affiliation", "sup"),
    ("frontiers_ids", "og_url", "frontiersin.org", "span.author-wrapper", "sup", "li[class*=affiliation]", "sup"),
    ("copernicus", "og_url", "copernicus.org", "nobr", "sup", "li.aff", "sup"),
    ("ame", "publisher", "AME ", "span.author", "sup", "aff", "sup"),
    ("csj", "og_url", "journal.csj.jp", "[class*=ContribAuthor]", "sup", "div.affiliationsGroup", "sup"),
    ("nejm", "og_url", "nejm.org", "li.m-article-header__author", "sup", "div.affiliation", "sup"),
    ("rsc_ids", "og_url", "pubs.rsc.org", ".article__author-link", "sup", ".article__author-affiliation", "sup"),
    ("spie", "og_url", "spiedigitallibrary.org", "a.author", "sup", "div.affiliation", "sup"),
    ("medknow", "publisher", "medknow", "font.articleAuthor", "sup", "font.AuthorAff", "sup"),
]


LISTED = ["author", "author/name", "author/affiliation", "author/corresponding", "abstract"]
LABELLED = ["author", "author/-ids", "affiliation", "affiliation/-label"]


def roles_of(families: list[tuple], roles: list[str]) -> dict[str, dict[str, str]]:
    """Rules as the automaton reads them: the selectors of each rule by role."""
    return {f[0]: {role: selector for role, selector in zip(roles, f[3:], strict=True) if selector} for f in families}


def role(marks: Column, name: str) -> Column:
    return F.filter(marks, lambda m: m["role"] == name)


def part_texts(mark: Column, name: str) -> Column:
    return F.transform(role(mark["parts"], name), lambda x: X.squeezed(x["text"]))


def listed_authors(marks: Column) -> Column:
    """Authors of a rule that lists them: the name is the first name part or the whole text, without what is raised behind it."""

    def one(m: Column) -> Column:
        name = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(part_texts(m, "name"), F.lit(1)), m["text"]), r"[\s\d,;*†‡§]+$", ""))
        return people.author(name, F.array_distinct(part_texts(m, "affiliation")), F.when(F.size(role(m["parts"], "corresponding")) > 0, True))

    return F.filter(F.transform(role(marks, "author"), one), lambda a: a["name"] != "")


def longest_abstract(marks: Column) -> Column:
    texts = F.transform(role(marks, "abstract"), lambda m: F.struct(F.length(m["text"]).alias("n"), m["text"].alias("t")))
    return X.strip_abstract_label(F.array_max(texts)["t"])


def labelled_authors(marks: Column) -> Column:
    """Authors that name their affiliations by ids: labels such as ``1`` or ``a`` in small raised text.

    Ids are cut at commas and spaces; a star among them marks a corresponding author. An author without ids gets the
    affiliations without a label, and a single affiliation goes to all.
    """
    raised = lambda m, what: F.array_join(F.transform(role(m["parts"], what), lambda x: x["own"]), ",")
    ids = lambda k: F.filter(F.split(F.regexp_replace(k, r"[^A-Za-z0-9,\s]", ""), r"[,\s]+"), lambda x: x != "")
    person = lambda m: X.let(raised(m, "ids"), lambda k: F.struct(F.trim(F.regexp_replace(X.squeezed(m["rest"]), r"[\s,;*†‡§]+$", "")).alias("name"), ids(k).alias("aff_ids"), F.when(k.contains("*"), True).alias("is_corresponding")))
    place = lambda m: F.struct(F.trim(F.regexp_replace(X.squeezed(m["rest"]), r"^[\s,;]+", "")).alias("organization"), F.try_element_at(ids(raised(m, "label")), F.lit(1)).alias("aff_id"))
    lists = F.struct(F.transform(role(marks, "author"), person).alias("people"), F.transform(role(marks, "affiliation"), place).alias("places"))
    return X.let(lists, lambda x: extract.join_affiliations(x["people"], x["places"]))


@dataclass(frozen=True)
class Extractor:
    """An extractor of one's own: the pages that it answers to (see ``extract.answers``), what is marked on them (see ``selectors``), and Column functions of these marks that give the authors and the abstract."""

    rule_id: str
    signal: str
    needle: str
    selectors: Mapping[str, str]
    authors: Callable[[Column], Column]
    abstract: Callable[[Column], Column] | None = None


def candidate(rule: Column, ord_: Column, authors: Column, abstract: Column, specific: bool = True) -> Column:
    return F.struct(rule.alias("rule_id"), F.lit(specific).alias("is_specific"), (rule == "cup").alias("prefer"), ord_.cast("int").alias("ord"), authors.cast(f"array<{extract.AUTHOR}>").alias("authors"), abstract.alias("abstract"))


def generic(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The generic candidate: meta fold, else the people of LD-JSON; abstract from the metas."""
    pages, html = H.scanned(pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")), html_col)
    return pages.select(F.col(f"`{id_col}`"), generic_candidate(html).alias("c")).select(id_col, "c.*")


def generic_candidate(html: H.Page) -> Column:
    folded = X.let(extract.fold_metas(html), lambda a: F.when(F.size(a) > 0, a).otherwise(ld_authors(html)))
    return candidate(F.lit("generic"), F.lit(1000), folded, extract.abstract_of(html), False)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", families: list[tuple] = FAMILIES, id_families: list[tuple] = ID_FAMILIES, extractors: Sequence[Extractor] = ()) -> DataFrame:
    """The chosen candidate of each page that has one: (``id_col``, rule_id, rung, authors, abstract).

    All happens beside the page, stage after stage, without a shuffle: a page that answers to rules is parsed once for all
    of them; the extractors of single publishers come before the lists of the same publisher. Only a page that these give no
    author with an affiliation (or a preferred author) is read by the generic extractor; and only where that one wins, and
    the page has words or stars that may mark its authors, is the page parsed for them. ``extractors`` are registered for this
    call and come before all others of their rung.
    """
    single = publishers.RULES
    signals = [*[(e.rule_id, e.signal, e.needle) for e in extractors], *[f[:3] for f in [*single, *id_families, *families]]]
    rules = publishers.SELECTORS | roles_of(id_families, LABELLED) | roles_of(families, LISTED)
    taken = [e.rule_id for e in extractors if e.rule_id in rules or e.rule_id in {f[0] for f in single} | {"generic"}]
    if taken or len({e.rule_id for e in extractors}) < len(extractors):
        raise ValueError(f"extractors need names of their own: {taken}")
    rules |= {e.rule_id: dict(e.selectors) for e in extractors}
    rows, page = H.scanned(pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")), html_col)
    make = lambda: expressions(page, signals, {f[0] for f in single}, {f[0] for f in id_families}, extractors)
    built = make() if extractors else X.once(("families", html_col, repr(signals)), make)
    rows = selectors.with_marks(rows.withColumn("__rules", built["rules"]), rules, "__rules", html_col, "__found")
    rows = dom.with_elements(rows.withColumn("__parsed", built["parsed"]), "__parsed", "__els")
    rows = publishers.with_candidates(rows, page, html_col).withColumn("__candidates", built["candidates"])
    rows = rows.withColumn("__best", built["best"]).select(id_col, html_col, "__metas", "__links", "__best").withColumns(built["left"]).withColumn("__best", built["better"])
    rows = dom.with_elements(rows.withColumn("__marked", built["unsure"]), "__marked", "__els").withColumn("__who", built["who"])
    return rows.where("__best is not null").select(id_col, "__best.rule_id", "__best.rung", built["authors"].alias("authors"), "__best.abstract")


def expressions(page: H.Page, signals: list[tuple[str, str, str]], single: set[str], labelled: set[str], extractors: Sequence[Extractor] = ()) -> dict[str, object]:
    """The columns of ``extract_pages``, by stage."""
    names = F.array(*[F.lit(s[0]) for s in signals])
    at = lambda rule: F.array_position(names, rule)
    by_label = lambda f: f["rule_id"].isin(*labelled)
    authors, abstract = lambda f: F.when(by_label(f), labelled_authors(f["marks"])).otherwise(listed_authors(f["marks"])), lambda f: F.when(~by_label(f), longest_abstract(f["marks"]))
    for e in extractors:
        authors = lambda f, e=e, rest=authors: F.when(f["rule_id"] == e.rule_id, e.authors(f["marks"]).cast(f"array<{extract.AUTHOR}>")).otherwise(rest(f).cast(f"array<{extract.AUTHOR}>"))
        abstract = lambda f, e=e, rest=abstract: F.when(f["rule_id"] == e.rule_id, e.abstract(f["marks"]) if e.abstract else F.lit(None).cast("string")).otherwise(rest(f))
    plain = F.transform(F.filter("__found", lambda f: ~f["rule_id"].isin(*single)), lambda f: candidate(f["rule_id"], at(f["rule_id"]), F.coalesce(authors(f), people.none_of(extract.AUTHOR)), abstract(f)))
    own = F.transform("__own", lambda f: candidate(f["rule_id"], at(f["rule_id"]), f["c"]["authors"], f["c"]["abstract"]))
    settled = F.coalesce(F.col("__best.rung") <= 2, F.lit(False))
    left = H.Page(F.col("__left"), F.col("__left_metas"), F.col("__left_links"))
    best = F.col("__best")
    mark = lambda a: people.with_parts(a, mark=F.when(F.array_contains("__who", a["name"]), True).otherwise(F.coalesce(a["is_corresponding"], F.lit(False))))
    who = F.array_distinct(F.concat(people.named_by_blocks(F.col("__els"), best["authors"]), people.named_by_stars(F.col("__els"), best["authors"])))
    return {
        "rules": extract.answers(page, signals),
        "parsed": F.when(publishers.reads_elements(F.col("__rules")), page.html),
        "candidates": F.concat(own, plain),
        "best": extract.best_of(F.col("__candidates")),
        "left": {"__left": F.when(~settled, page.html), "__left_metas": F.when(~settled, page.metas), "__left_links": F.when(~settled, page.links)},
        "better": F.when(settled, best).otherwise(extract.best_of(F.array(generic_candidate(left)), best)),
        "unsure": F.when((best["rule_id"] == "generic") & (F.size(best["authors"]) > 0) & people.may_mark(F.col("__left")), F.col("__left")),
        "who": F.when(F.col("__els").isNotNull(), who),
        "authors": F.when(F.size("__who") > 0, F.transform(best["authors"], mark)).otherwise(best["authors"]),
    }


def ld_authors(html: Column) -> Column:
    """The persons of a page's LD-JSON blocks: affiliations as text, object or list; an e-mail marks."""
    people = "array<struct<`@type`:string,name:string,email:string,affiliation:string>>"
    block = lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$.author"), people), F.from_json(F.get_json_object(b, "$.mainEntity.author"), people), F.array().cast(people))
    named = lambda a: F.coalesce(F.get_json_object(a, "$.address.name"), F.get_json_object(a, "$.name"), a)
    affs = lambda a: F.when(a.isNull(), F.array().cast("array<string>")).when(a.startswith("["), F.transform(F.from_json(a, "array<string>"), named)).otherwise(F.array(named(a)))
    persons = F.filter(F.flatten(F.transform(H.ld_json(html), block)), lambda p: p["@type"] == "Person")
    return F.transform(persons, lambda p: F.struct(p["name"].alias("name"), F.array_distinct(F.filter(affs(p["affiliation"]), lambda x: x.isNotNull())).alias("affiliations"), F.when(p["email"].isNotNull(), True).alias("is_corresponding")))


def script_authors(html: Column, start: str = r"xplGlobal\.document\.metadata") -> Column:
    """Authors of a page whose script assigns a JSON record with ``authors`` of (name, affiliation list)."""
    record = F.regexp_extract(H.raw(html), rf"{start}\s*=\s*(\{{.*\}});", 1)
    read = F.from_json(F.get_json_object(record, "$.authors"), "array<struct<name:string,affiliation:string>>")
    affs = lambda a: F.when(a.startswith("["), F.from_json(a, "array<string>")).when(a.isNotNull(), F.array(a)).otherwise(F.array().cast("array<string>"))
    return F.transform(read, lambda p: F.struct(p["name"].alias("name"), affs(p["affiliation"]).alias("affiliations"), F.lit(None).cast("boolean").alias("is_corresponding")))
