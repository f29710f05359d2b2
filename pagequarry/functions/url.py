"""URL and DOI functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import let, text_of


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host_of(url: Column) -> Column:
    """Network location, lower-cased; '' where there is none."""
    return F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"^[^?#]*\?([^#]*)", 1)


def publisher_domain(url: Column) -> Column:
    """Host without a leading ``www.``."""
    return F.regexp_replace(host_of(url), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Comparable form: https where no scheme is given, lower-cased host without ``www.``, no tracking parameters, fragment or trailing slash; '' for null."""
    u = F.trim(text_of(url))
    scheme = F.when(scheme_of(u) == "", F.lit("https")).otherwise(scheme_of(u))
    path = F.regexp_replace(path_of(u), r"/+$", "")
    kept = F.filter(F.split(query_of(u), "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(rules.TRACKING_PARAMS))
    query = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    full = F.concat(scheme, F.lit("://"), publisher_domain(u), F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(u == "", F.lit("")).otherwise(full)


def is_doi_router(url: Column) -> Column:
    return host_of(url).isin(rules.DOI_ROUTERS)


def normalize_doi(doi: Column) -> Column:
    """Lower case without a resolver's address or ``doi:`` in front; '' for null."""
    d = F.trim(text_of(doi))
    return F.lower(F.trim(F.regexp_replace(d, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")))


def doi_prefix(doi: Column) -> Column:
    """The registrant prefix ``10.NNNN``, or ''."""
    d = normalize_doi(doi)
    return F.when(d.startswith("10.") & d.contains("/"), F.substring_index(d, "/", 1)).otherwise("")


def clean_doi(c: Column) -> Column:
    """A DOI as found in running text, without resolver, query, wrapping signs, trailing punctuation or a lone closing bracket."""
    d = F.regexp_replace(F.trim(text_of(c)), r"(?i)^https?://(?:dx\.)?doi\.org/|^doi:\s*", "")
    d = F.regexp_replace(F.regexp_extract(d, r"^([^#?]*)", 1), r"""^[<>"'\s]+|[<>"'\s]+$""", "")
    d = F.regexp_replace(d, r"[.,;:!?\]}]+$", "")
    count = lambda t, of: F.length(t) - F.length(F.replace(t, F.lit(of), F.lit("")))
    return F.lower(F.when(count(d, "(") < count(d, ")"), F.regexp_replace(d, r"\)+$", "")).otherwise(d))


def dois(c: Column) -> Column:
    """The distinct DOIs in a text, in order."""
    found = F.regexp_extract_all(text_of(c), F.lit(f"({rules.DOI_PATTERN})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, clean_doi), lambda d: d != ""))


def strip_session(url: Column) -> Column:
    return F.regexp_replace(url, r";jsessionid=\w+", "")


def without_dots(url: Column) -> Column:
    """An address whose path has no ``.`` and ``..`` segments, by the rules for references: each ``..`` takes the segment before it along."""
    host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*([?#].*)?$", 1)
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"/\.\.$", "/../"), r"/\.$", "/./"), "/")
    step = lambda kept, part: F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(part)))
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    return F.when((host != "") & F.regexp_like(path, F.lit(r"/\.\.?(?:/|$)")), F.concat(host, F.array_join(folded, "/"), rest)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``: absolute, protocol-relative, rooted, query, fragment or relative to the folder; dot segments go."""
    h, b = strip_session(text_of(href)), text_of(base)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)", 1), r"(://[^/]+)$", r"$1/")
    joined = (
        F.when(h == "", b)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(b, r"^([^?#]*)", 1), h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
        .otherwise(F.concat(F.regexp_replace(folder, r"[^/]*$", ""), h))
    )
    return F.when(F.regexp_like(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | (b == ""), h).otherwise(without_dots(joined))


def rewrite_pdf_url(url: Column) -> Column:
    """A viewer's address turned to that of the PDF, by the first fitting rule."""
    out = url
    for pattern, old, new in reversed(rules.PDF_URL_REWRITES):
        out = F.when(F.regexp_like(url, F.lit(f"^(?:{pattern})")), F.replace(url, F.lit(old), F.lit(new))).otherwise(out)
    return out


def stable_pdf_url(url: Column) -> Column:
    """A document's PDF at its publisher's present host, without what its viewers add; other addresses as they are."""
    return F.regexp_replace(url, *rules.STABLE_PDF)


def rewrite_meta_pdf(url: Column, page: Column) -> Column:
    """The address of a PDF meta tag turned to that of the PDF; a preview's to the whole one if the page names it."""
    out = url
    for pattern, replacement in rules.META_PDF_REWRITES:
        out = F.regexp_replace(out, pattern, replacement)
    preview, end, other = rules.PREVIEW_PDF
    whole = lambda u: F.regexp_replace(F.nullif(F.regexp_extract(u, preview, 1), F.lit("")), end, other)
    return let(out, lambda u: F.when(F.coalesce(page.contains(whole(u)), F.lit(False)), whole(u)).otherwise(u))


def looks_like_pdf(href: Column) -> Column:
    h = F.lower(text_of(href))
    return F.greatest(*[h.contains(t) for t in ("/pdf", "/epdf", "pdfft", ".pdf", "downloadpdf")])


def trusts_license(url: Column) -> Column:
    """Whether a page's licence statement counts: not on the untrusted hosts, and for one journal only before volume 217; true for null."""
    host = F.regexp_extract(text_of(url), r"^(?:.*?//)?([^/]*)", 1)
    volume = F.regexp_extract(text_of(url), r"rupress\.org/jcb/[^/]+/(\d+)", 1)
    return F.when(F.greatest(*[host.contains(h) for h in rules.UNTRUSTED_HOSTS]), False).when(host.contains("rupress.org"), F.coalesce(volume.try_cast("int") < 217, F.lit(False))).otherwise(True)


def bad_href(href: Column) -> Column:
    """Whether a link can't be the page's PDF by its address."""
    h = F.lower(text_of(href))
    good = F.greatest(*[h.contains(w.lower()) for w in rules.GOOD_HREF_WORDS], *[F.regexp_like(h, F.lit(p)) for p in rules.GOOD_HREF_PATTERNS])
    return ~good & (F.exists(F.array(*[F.lit(w.lower()) for w in rules.BAD_HREF_WORDS]), lambda w: h.contains(w)) | F.greatest(*[F.regexp_like(h, F.lit(p)) for p in rules.BAD_HREF_PATTERNS], F.lit(False)))


def bad_anchor(anchor: Column) -> Column:
    a = F.lower(text_of(anchor))
    return F.exists(F.array(*[F.lit(w.lower()) for w in rules.BAD_ANCHOR_WORDS]), lambda w: a.contains(w))


def known_bad_link(page_url: Column, href: Column, anchor: Column) -> Column:
    """Whether a link is known to be something else than the page's PDF: by its own site's pattern, else by those for PDF meta tags, else by address."""
    u, h = text_of(page_url), text_of(href)
    like = lambda c, patterns: F.greatest(*[F.regexp_like(c, F.lit(p)) for p in patterns], F.lit(False))
    bad = ((anchor == "<meta citation_pdf_url>") & (like(h, rules.BAD_META_LINKS) | like(u, rules.BAD_META_SITES))) | h.isin(rules.BAD_LINKS)
    for site, link in reversed(rules.SITE_BAD_LINKS):
        bad = F.when(F.regexp_like(u, F.lit(site)), F.regexp_like(h, F.lit(link))).otherwise(bad)
    return F.coalesce(bad, F.lit(False))


def host_ends(url: Column, hosts: list[str]) -> Column:
    """Whether the address's host ends with one of ``hosts``."""
    host = F.lower(F.regexp_extract(text_of(url), r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.greatest(*[host.endswith(h) for h in hosts], F.lit(False))


def unstable_pdf(pdf_url: Column, page_url: Column) -> Column:
    """Whether a PDF's address works for a while only, or the page holds many papers."""
    host, word = rules.UNSTABLE_PDF
    query = F.regexp_extract(text_of(pdf_url), r"\?([^#]*)", 1)
    return (host_ends(pdf_url, [host]) & query.contains(word)) | F.coalesce(page_url.isin(rules.MANY_PAPERS), F.lit(False))


def serves_documents(url: Column) -> Column:
    return host_ends(url, rules.DOCUMENT_HOSTS)


def trusts_repository_license(url: Column) -> Column:
    return host_ends(url, rules.LICENSE_HOSTS)
