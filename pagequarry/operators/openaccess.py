"""Open-access status, hybrid licences, and the publishers' own ways to a PDF, as rule rows over page URL and HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions import text as X
from ..functions import url as U

# --- fixed values: (part of the page's address, pattern of free access) ---
BRONZE = [
    ("sciencedirect.com/", '<div class="OpenAccessLabel">open archive</div>'),
    ("sciencedirect.com/", r'<span[^>]*class="[^"]*pdf-download-label[^"]*"[^>]*>Download PDF</span>'),
    ("sciencedirect.com/", r'<span class="primary-cta-button-text|link-button-text">View\s*<strong>PDF</strong></span>'),
    ("onlinelibrary.wiley.com", '<div[^>]*class="doi-access"[^>]*>Free Access</div>'),
    ("openedition.org", r'<span[^>]*id="img-freemium"[^>]*></span>'),
    ("openedition.org", r'<span[^>]*id="img-openaccess"[^>]*></span>'),
    ("microbiologyresearch.org", r'<span class="accesstext">(?:</span>)?Free'),
    ("journals.lww.com", r'<li[^>]*id="[^"]*-article-indicators-free"[^>]*>'),
    ("ashpublications.org", r'<i[^>]*class="[^"]*icon-availability_free'),
    ("academic.oup.com", r'<i[^>]*class="[^"]*icon-availability_free'),
    ("publications.aap.org", r'<i[^>]*class="[^"]*icon-availability_free'),
    ("degruyter.com/", "<span>Free Access</span>"),
    ("degruyter.com/", 'data-accessrestricted="false"'),
    ("practicalactionpublishing.com", r'<img [^>]*class="open-access-icon"'),
    ("iucnredlist.org", "<title>"),
]
BRONZE_PDF = r"^https?://www\.sciencedirect\.com/science/article/pii/S[0-9X]+/pdf(?:ft)?\?md5=[0-9a-f]+.*[0-9x]+-main.pdf$"
# --- fixed values: (part of the page's address, pattern of open access) ---
HYBRID = [
    ("projecteuclid.org/", "<strong>Full-text: Open access</strong>"),
    ("sciencedirect.com/", '<div class="OpenAccessLabel">open access</div>'),
    ("journals.ametsoc.org/", r'src="/templates/jsp/_style2/_ams/images/access_free\.gif"'),
    ("apsjournals.apsnet.org", r'src="/products/aps/releasedAssets/images/open-access-icon\.png"'),
    ("psychiatriapolska.pl", "is an Open Access journal:"),
    ("journals.lww.com", '<span class="[^>]*ejp-indicator--free'),
    ("journals.lww.com", r'<img[^>]*src="[^"]*/icon-access-open\.gif"[^>]*>'),
    ("iospress.com", r'<img[^>]*src="[^"]*/img/openaccess_icon.png[^"]*"[^>]*>'),
    ("rti.org/", r"</svg>[^<]*Open Access[^<]*</span>"),
    ("cambridge.org/", r'<span[^>]*class="open-access"[^>]*>Open access</span>'),
    ("degruyter.com/", "<span>Open Access</span>"),
    ("", "/accessOA.png"),
    ("academic.oup.com", "<i class='icon-availability_open'"),
    ("ieee.org", r'"isOpenAccess":true'),
    ("ieee.org", r'"openAccessFlag":"yes"'),
    ("pubs.rsc.org", "/open_access_blue.png"),
    ("cambridge.org", '<span class="icon access open-access cursorDefault">'),
    ("onlinelibrary.wiley.com", r'<div[^>]*class="doi-access"[^>]*>Open Access</div>'),
]
# --- fixed values: phrases around a licence; of several the last counts ---
LICENSE_PHRASES = [
    r"(creativecommons.org/licenses/[a-z\-]+)",
    "distributed under the terms (.*) which permits",
    "This is an open access article under the terms (.*) which permits",
    "This is an open-access article distributed under the terms (.*), where it is permissible",
    "This is an open access article published under (.*) which permits",
    '<div class="openAccess-articleHeaderContainer(.*?)</div>',
    "this article is published under the creative commons (.*) licence",
    "This work is licensed under a Creative Commons (.*), which permits ",
]


def opening(pattern: str) -> str:
    """The words with which all that a pattern finds begins, in lower case: what lower-cased text without them can't fit."""
    return re.match(r"\(?([^.()\[\]*+?|\\^$]+)(?![*?+])", pattern)[1].lower()


def any_rule(rules: list[tuple[str, str]], page_url: Column, html: Column) -> Column:
    u = F.lower(X.text_of(page_url))
    hits = [(u.contains(part) if part else X.holds(F.lower(html), [opening(pattern)])) & F.regexp_like(html, F.lit(f"(?is){pattern}")) for part, pattern in rules]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def phrase_license(page_url: Column, text: Column) -> Column:
    """The licence that the last fitting phrase names, ``unspecified-oa`` if it names none, null without a phrase or trust."""
    def last(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for p in LICENSE_PHRASES:
            pattern = f"(?i){p}"
            out = F.when(X.holds(low, [opening(p)]) & F.regexp_like(text, F.lit(pattern)), F.coalesce(X.license_of(F.regexp_extract(text, pattern, 1)), F.lit("unspecified-oa"))).otherwise(out)
        return out

    return F.when(U.trusts_license(page_url), X.let(F.lower(text), last))


def license_text(html: Column) -> Column:
    """The page without what speaks of other papers' licences: a block of featured articles (up to the next one of its kind or the page's sections) and reference meta tags."""
    def without(raw: Column) -> Column:
        page = F.regexp_replace(raw, r"""(?is)<meta\b[^>]*\bname\s*=\s*["'][^"']*citation_reference[^>]*>""", "")
        page = F.regexp_replace(page, r"""(?is)<div\b[^>]*\bclass\s*=\s*["'][^"']*view-pnas-featured.*?(?=<(?:section|article|footer|main)\b|</body|$)""", "")
        return F.when(X.holds(F.lower(raw), ["citation_reference", "view-pnas-featured"]), page).otherwise(raw)

    return X.let(H.raw(html), without)


def status(page_url: Column, html: Column) -> Column:
    """(oa_status, source, license): bronze before hybrid; null without a sign."""
    row = lambda s, source, lic: F.struct(F.lit(s).alias("oa_status"), source.alias("source"), lic.alias("license"))

    def hybrid(phrase: Column, page: Column) -> Column:
        says = F.when(phrase.isNotNull() & (phrase != "unspecified-oa"), "open (via page says license)").otherwise("open (via page says Open Access)")
        return F.when(phrase.isNotNull() | any_rule(HYBRID, page_url, page), row("hybrid", says, F.coalesce(phrase, F.lit("unspecified-oa"))))

    def of(page: Column) -> Column:
        bronze = any_rule(BRONZE, page_url, page) | F.coalesce(F.regexp_like(H.meta(html, "citation_pdf_url"), F.lit(f"(?i){BRONZE_PDF}")), F.lit(False))
        return F.when(bronze, row("bronze", F.lit("open (via free article)"), X.license_of(page))).otherwise(X.let(phrase_license(page_url, page), lambda phrase: hybrid(phrase, page)))

    return X.let(license_text(html), of)


def journal_index(html: Column) -> Column:
    """Whether the page is an issue's table of contents, which has no full text of its own."""
    return F.coalesce(H.meta(html, "generator").startswith("Open Journal Systems"), F.lit(False)) & (F.size(F.regexp_extract_all(H.raw(html), F.lit(r"(?i)(<a[^>]*id=.article-)"), F.lit(1))) > 1)


def found(text: Column, pattern: str) -> Column:
    """What the pattern's group finds; null for nothing."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def science_direct_pdf(page_url: Column, html: Column) -> Column:
    """By the page's own view link, else by the article's identifier, with the keys of a download if the page has them."""
    page = H.raw(html)
    view = H.attribute(F.nullif(F.regexp_extract(page, rules.PII_VIEW, 0), F.lit("")), "href")
    base = F.concat(F.lit(rules.PII_BASE), F.coalesce(*[found(page, p) for p in rules.PII_PATTERNS]))
    md5, pid = (found(page, p) for p in rules.PII_KEYS)
    keys = F.concat(base, F.lit("/pdfft?md5="), md5, F.lit("&pid="), pid)
    return F.when(X.text_of(page_url).contains(rules.PII_HOST), F.coalesce(F.when(X.text_of(view) != "", U.resolve(page_url, view)), keys, F.concat(base, F.lit("/pdf")), found(page, rules.PII_SHOWN)))


def fallback_pdf(page_url: Column, html: Column) -> Column:
    """A PDF's address where no link is accepted, by the page's host."""
    host, own = U.publisher_domain(page_url), X.text_of(F.coalesce(H.link_href(html, "canonical"), H.meta(html, "og:url")))
    told = [F.when(host.endswith(site), F.concat(F.lit(front), H.unescaped(found(H.raw(html), pattern)) if where == "page" else found(own, pattern), F.lit(behind))) for site, where, pattern, front, behind in rules.PDF_FALLBACKS]
    beside = [F.when(host.endswith(site), U.resolve(page_url, F.lit(path))) for site, path in rules.PDF_BESIDE]
    return U.stable_pdf_url(F.coalesce(*told, *beside))


def router_base(href: Column, page_url: Column) -> Column:
    """The host to which a relative DOI link belongs where only the router's address is known."""
    h = X.text_of(href)
    doi = F.regexp_extract(F.lower(h), r"/doi/(?:pdfdirect|pdf|epdf)/(10\.[^?&#]+)", 1)
    by_path, by_doi = [F.when(h.contains(p), F.lit(site)) for p, site in rules.PATH_SITES], [F.when(doi.startswith(p), F.lit(site)) for p, site in rules.DOI_SITES]
    return F.when(U.is_doi_router(page_url) & h.startswith("/doi/"), F.coalesce(*by_path, *by_doi, page_url)).otherwise(page_url)
