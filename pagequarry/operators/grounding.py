"""Grounding of candidates on pages: what speaks against a candidate, how well it stands on its page, whose names meet, and how tickets end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions import text as X
from ..functions import url as U

let = X.let


def abstract_blocker(abstract: Column) -> Column:
    """Why a text is no abstract, by the first of nine reasons; null if none fits."""

    def of(t: Column) -> Column:
        out = F.when(t == "", "abstract_empty_candidate")
        for reason, kind, values in rules.NO_ABSTRACT:
            hits = {"is": lambda: t.isin(values), "holds": lambda: F.greatest(*[t.contains(v) for v in values], F.lit(False)), "starts": lambda: F.greatest(*[t.startswith(v) for v in values], F.lit(False)), "like": lambda: F.greatest(*[F.regexp_like(t, F.lit(v)) for v in values], F.lit(False))}  # noqa: B023
            out = out.when(hits[kind](), reason)
        return out.when((F.length(t) < 100) & t.contains(";") & ~t.contains("."), "abstract_synonyms_not_abstract")

    return F.when(abstract.isNotNull(), let(F.lower(X.squeezed(abstract)), of))


def pdf_resolution_usable(status: Column, final_url: Column) -> Column:
    """Whether a resolved address is a PDF's: no error status, a web address without a wall's words, of a PDF's shape."""
    low = F.lower(X.text_of(final_url))
    walls = F.greatest(*[low.contains(w) for w in rules.WALL_WORDS])
    shaped = F.greatest(*[low.contains(w) for w in ("/pdf", "pdfft", ".pdf")])
    return (F.coalesce(status, F.lit(0)) < 400) & F.regexp_like(low, F.lit("^https?://")) & ~walls & shaped


def compact(c: Column) -> Column:
    """Lower case, character references read, white space squeezed."""
    return F.lower(X.squeezed(H.unescaped(X.text_of(c))))


def length_close(expected: Column, actual: Column) -> Column:
    """Whether two lengths are within 25 characters or a twentieth of the expected one."""
    return F.abs(expected - actual) <= F.greatest(F.lit(25), F.floor(expected * 0.05).cast("int"))


def located(page: Column, needles: Column, around: int = 120) -> Column:
    """The page's text around the first needle (in their order) that stands in it; null without one."""
    at = F.filter(F.transform(needles, lambda n: F.instr(F.lower(page), F.lower(n))), lambda i: i > 0)
    return let(F.try_element_at(at, F.lit(1)), lambda i: F.when(i.isNotNull(), F.substring(page, F.greatest(i - around, F.lit(1)), F.lit(2 * around))))


def confidence(page: Column, field: Column, correspondence: Column, candidate: Column, identity: Column) -> Column:
    """(excerpt, selector, confidence) of a candidate on its page: its own text (for corresponding authors, first the note, then the name), what identifies the page, else the page's head."""
    rung = lambda excerpt, selector, name: F.when(excerpt.isNotNull(), F.struct(excerpt.alias("excerpt"), F.lit(selector).alias("selector"), F.lit(name).alias("confidence")))
    marks = F.when(field == "corresponding", F.coalesce(rung(located(page, correspondence), "correspondence-candidate-text-match", "correspondence_candidate_text_match"), rung(located(page, candidate), "corresponding-author-name-only", "corresponding_author_name_only")))
    head = F.trim(F.replace(F.substring(X.text_of(page), 1, 800), F.lit("\n"), F.lit(" ")))
    last = F.struct(F.nullif(head, F.lit("")).alias("excerpt"), F.lit("page-head").alias("selector"), F.lit("page_rendered_only").alias("confidence"))
    return F.coalesce(marks, rung(located(page, candidate), "candidate-text-match", "candidate_text_match"), rung(located(page, identity), "page-identity", "page_identity_only"), last)


def surname_words(name: Column) -> Column:
    return F.filter(F.split(X.normalize_alpha(name), " "), lambda w: F.length(w) > 2)


def surname_overlap(gold: Column, parsed: Column) -> Column:
    """The share of parsed names that have a word of over two letters in common with some gold name; 0 where a side is empty."""
    words = F.flatten(F.transform(gold, surname_words))
    hits = F.size(F.filter(parsed, lambda n: F.arrays_overlap(surname_words(n), words)))
    return F.when((F.size(gold) > 0) & (F.size(parsed) > 0), hits / F.size(parsed)).otherwise(0.0)


def gold_verdict(gold: Column, parsed: Column) -> Column:
    """What two lists of names say about each other: both_empty, parser_miss, gold_missing_parser_has, or by their overlap."""
    share = surname_overlap(gold, parsed)
    return (
        F.when((F.size(gold) == 0) & (F.size(parsed) == 0), "both_empty").when(F.size(parsed) == 0, "parser_miss").when(F.size(gold) == 0, "gold_missing_parser_has")
        .when(share == 0, "disjoint_names_gold_likely_wrong").when(share >= 0.5, "names_overlap_format_diff").otherwise("partial_overlap_unclear")
    )


def person_key(name: Column) -> Column:
    return F.regexp_replace(compact(name), "[^a-z0-9]+", "")


def person_signature(name: Column) -> Column:
    """(last word, first letter) of a name's Latin words; null without one."""
    words = F.regexp_extract_all(compact(name), F.lit("([a-z]+)"), F.lit(1))
    return F.when(F.size(words) > 0, F.struct(F.element_at(words, -1).alias("last"), F.substring(words[0], 1, 1).alias("initial")))


def same_person(a: Column, b: Column) -> Column:
    """Whether two names have the same compact key, or the same last word and first letter."""
    return F.coalesce((person_key(a) != "") & (person_key(a) == person_key(b)), F.lit(False)) | person_signature(a).eqNullSafe(person_signature(b))


def pii_of(url: Column) -> Column:
    """The article identifier that follows ``/pii/`` in an address's path; null without one."""
    return F.nullif(F.regexp_extract(X.text_of(url), r"^[^?#]*?/pii/+([^/?#]+)", 1), F.lit(""))


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), F.trim(doi))


def direct_pdf(url: Column) -> Column:
    """A viewer's address as that of the direct download; others as they are."""
    viewer, direct = rules.VIEWER_PATHS
    return F.when(url.contains(viewer) & ~url.contains(direct), F.regexp_replace(url, F.lit(f"^(.*?)\\Q{viewer}\\E"), F.lit(f"$1{direct}"))).otherwise(url)


def pdf_candidates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """PDF links from a page's markup: (``id_col``, url, selector), each address once under the first selector that has it.

    In order: the PDF meta tags, attributes that hold addresses, addresses anywhere in the page, and what identifier
    and download keys make. Only addresses of a PDF's shape count.
    """
    pages, page = H.scanned(pages, html_col)
    from .openaccess import science_direct_pdf

    body, own = H.unescaped(H.raw(page)), F.col(f"`{url_col}`")
    tagged = lambda found, selector: F.transform(found, lambda u: F.struct(u.alias("u"), F.lit(selector).alias("selector")))
    metas = F.transform(F.filter(page.metas, lambda m: F.lower(m["key"]) == "citation_pdf_url"), lambda m: m["content"])
    attributes = F.regexp_extract_all(body, F.lit(r"""(?i)\b(?:href|data-href|action|content)=['"]([^'"]+)['"]"""), F.lit(1))
    raw = F.concat(*[F.regexp_extract_all(body, F.lit(f"(?i)({p})"), F.lit(1)) for p in rules.RAW_PDF_PATTERNS])
    keyed = F.filter(F.array(science_direct_pdf(own, page)), lambda u: F.coalesce(u.contains("/pdfft?md5="), F.lit(False)))
    every = F.concat(tagged(metas, "meta[citation_pdf_url]"), tagged(attributes, "rendered-pdf-link"), tagged(raw, "raw-pdf-url"), tagged(keyed, "sciencedirect-md5-pid-pdfft"))
    rows = pages.select(F.col(f"`{id_col}`"), own.alias("__base"), F.posexplode(every).alias("ord", "x")).select(id_col, "ord", U.resolve(F.col("__base"), F.trim("x.u")).alias("url"), "x.selector").where(U.looks_like_pdf(F.col("url")))
    return rows.groupBy(id_col, "url").agg(F.min_by("selector", "ord").alias("selector"))


def joined_class(found: Column, status: Column, blocked: Column, accuracy: Column) -> Column:
    """What a ticket's corpus row says about its corresponding author, before the page is looked at."""
    return (
        F.when(~found, "insufficient_private_context").when((status == "retrieval_blocked") | F.coalesce(blocked, F.lit(False)), "retrieval_owned")
        .when(status.isin("empty_empty_pass", "gold_present_parser_present") | (F.coalesce(accuracy, F.lit(0.0)) >= 0.98), "already_fixed_by_current_parser")
        .when(status == "gold_present_parser_empty", "still_parser_owned").when(status == "gold_empty_parser_present", "gold_or_ticket_disagreement").otherwise("insufficient_private_context")
    )


def spotcheck_class(block_reason: Column, marker: Column, n_marked: Column, joined: Column, gold_has: Column) -> Column:
    """The same after the page was looked at: walls first, then whether the page has a marker and the parser an author for it."""
    return (
        F.when(block_reason.isin("cached_bot_check", "js_rendered_required", "cached_router_only"), "access_or_js_owned").when(block_reason.isNotNull(), "retrieval_owned")
        .when(marker.isNotNull() & (n_marked > 0), "already_fixed_by_current_parser").when(marker.isNotNull(), "still_parser_owned")
        .when(joined == "already_fixed_by_current_parser", joined).when(gold_has, "gold_or_ticket_disagreement").otherwise(F.coalesce(joined, F.lit("not_reproducible")))
    )


def corresponding_marker(page: Column) -> Column:
    """How a page marks a corresponding author: by an e-mail meta tag, a mail link, words in its text, or words in attributes; null if not at all."""
    body = H.raw(page)
    visible = F.regexp_replace(H.without_scripts(page), r"(?s)<[^>]*>", " ")
    attributes = F.regexp_like(body, F.lit(rf"""(?is)\s(?:class|id|title|aria-label|data-test|data-testid)\s*=\s*(?:"[^"]*{rules.CA_ATTRIBUTE}[^"]*"|'[^']*{rules.CA_ATTRIBUTE}[^']*')"""))
    return (
        F.when(X.text_of(H.meta(page, "citation_author_email")) != "", "citation_author_email").when(F.regexp_like(body, F.lit(r"""(?is)<a\b[^>]*\shref\s*=\s*["']?\s*mailto:""")), "mailto")
        .when(F.regexp_like(visible, F.lit(rules.CA_TEXT)), "text_correspondence_marker").when(attributes, "attribute_correspondence_marker")
    )


def tickets(candidates: DataFrame, pages: DataFrame, id_col: str = "doi", html_col: str = "html") -> DataFrame:
    """Tickets (doi, found, status, blocked, accuracy, n_marked, gold_has) with their cached page: joined class, marker, class after the spot check, and the class that counts."""
    rows = candidates.join(pages.select(F.lower(F.col(id_col)).alias("__k"), F.col(html_col).alias("__html")), F.lower(F.col(id_col)) == F.col("__k"), "left").drop("__k")
    rows = rows.withColumns({"joined": joined_class(F.col("found"), F.col("status"), F.col("blocked"), F.col("accuracy")), "block_reason": H.block_reason(F.col("__html")), "marker": F.when(F.col("__html").isNotNull(), corresponding_marker(F.col("__html")))})
    return rows.withColumn("ticket_class", spotcheck_class(F.col("block_reason"), F.col("marker"), F.col("n_marked"), F.col("joined"), F.col("gold_has"))).drop("__html")


def ticket_summary(rows: DataFrame) -> DataFrame:
    """Tickets by class, with the share and the lane that follows: a parser patch only where that class leads with a fifth of the tickets or more."""
    counted = rows.groupBy("ticket_class").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    lane = F.when((F.col("ticket_class") == "still_parser_owned") & (F.col("n") >= F.col("total") * 0.2), "parser-patch").otherwise(F.coalesce(*[F.when(F.col("ticket_class") == c, F.lit(to)) for c, to in rules.TICKET_LANES], F.lit("referee")))
    return counted.join(F.broadcast(total), how="cross").select("ticket_class", "n", (F.col("n") / F.col("total")).alias("share"), lane.alias("lane"))
