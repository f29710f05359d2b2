"""Functions of raw HTML that need no parser: meta tags, title, retrieval states."""

from __future__ import annotations

from html.entities import name2codepoint
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .text import holds, let, squeezed, text_of


class Page(NamedTuple):
    """A page whose meta and link tags were found once, as columns; the functions here take it in place of the HTML."""

    html: Column
    metas: Column
    links: Column


def scanned(pages: DataFrame, html_col: str) -> tuple[DataFrame, Page]:
    """``pages`` with the meta and link tags beside, and the page to hand to the functions."""
    html = F.col(f"`{html_col}`")
    return pages.withColumns({"__metas": metas(html), "__links": tags(html, "link")}), Page(html, F.col("__metas"), F.col("__links"))


def raw(page: Column | Page) -> Column:
    """The page's HTML, empty for null."""
    return text_of(page.html if isinstance(page, Page) else page)


def unescaped(c: Column) -> Column:
    """Character references replaced by their characters, each once: numbers, and the names of HTML 4; others stay."""
    names = F.str_to_map(F.lit("\x1e".join(f"{name}\x1f{chr(code)}" for name, code in {**name2codepoint, "apos": 39}.items())), F.lit("\x1e"), F.lit("\x1f"))  # one constant, not 250

    def read(part: Column, name: Column) -> Column:
        code = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 7), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("long")
        char = let(code, lambda n: F.when(n.between(1, 55_295) | n.between(57_344, 1_114_111), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        found = F.when(name.startswith("#"), char).when(name != "", F.try_element_at(names, name))
        return F.coalesce(F.concat(found, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    after = lambda part: let(F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});", 1), lambda name: read(part, name))
    joined = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), after), ""))
    return let(c, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), joined)).otherwise(t))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of one tag; null where it is missing."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, r"(?is)^\s[^=]*=\s*", ""), r"""^["']|["']$""", "")
    return let(value, lambda v: F.when(v != "", unescaped(bare(v))))


def tags(html: Column | Page, name: str) -> Column:
    """The texts of all opening tags of a kind, in order."""
    if isinstance(html, Page) and name == "link":
        return html.links
    return F.regexp_extract_all(raw(html), F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))


def metas(html: Column) -> Column:
    """All meta tags in order as (pos, key, content): key is the name, else the property."""
    if isinstance(html, Page):
        return html.metas
    return F.transform(tags(html, "meta"), lambda t, i: F.struct(i.alias("pos"), F.coalesce(attribute(t, "name"), attribute(t, "property")).alias("key"), attribute(t, "content").alias("content")))


def meta(html: Column, key: str) -> Column:
    """The content of the first meta tag with that name or property."""
    return F.try_element_at(F.filter(metas(html), lambda m: (F.lower(m["key"]) == key.lower()) & m["content"].isNotNull()), F.lit(1))["content"]


def link_href(html: Column, rel: str) -> Column:
    return attribute(F.try_element_at(F.filter(tags(html, "link"), lambda t: F.lower(attribute(t, "rel")) == rel), F.lit(1)), "href")


def title(html: Column) -> Column:
    """The title's text with white space collapsed; '' where there is none."""
    return squeezed(unescaped(F.regexp_extract(raw(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def base_url(html: Column) -> Column:
    """Where relative links start: base tag, canonical link, og:url, citation_url, dc.identifier, al:web:url, any meta link's origin, else ''."""
    base = attribute(F.try_element_at(tags(html, "base"), F.lit(1)), "href")
    any_link = F.try_element_at(F.filter(F.transform(metas(html), lambda m: F.regexp_extract(F.coalesce(m["content"], F.lit("")), r"^(https?://[^/?#]*)", 1)), lambda x: x != ""), F.lit(1))
    return F.coalesce(base, link_href(html, "canonical"), meta(html, "og:url"), meta(html, "citation_url"), meta(html, "dc.identifier"), meta(html, "al:web:url"), any_link, F.lit(""))


def page_url(html: Column, resolved: Column) -> Column:
    """The page's own address: what it was resolved to, unless that is a DOI router and the page names a better one."""
    from .url import is_doi_router

    real = lambda c: F.when(~is_doi_router(c) & (c != ""), c)
    return F.when(is_doi_router(resolved) | resolved.isNull(), F.coalesce(real(link_href(html, "canonical")), real(meta(html, "og:url")), resolved)).otherwise(resolved)


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(raw(html), r"(?is)<script\b.*?</script\s*>", "")


def block_reason(html: Column) -> Column:
    """Why a cached page has no content, by the first of fifteen rules; null for a page that has."""
    words = ("cookies", "robot", "protected", "shieldsquare", "radware", "loading")  # one of them is in every text that a rule looks for
    text_of_tagged = lambda low: F.when(holds(low, words), squeezed(F.regexp_replace(low, r"<[^>]+>", " "))).otherwise(F.lit(""))
    return F.when(html.isNull(), "missing").otherwise(let(F.btrim(html, F.lit(" \t\n\x0b\f\r")), lambda bare: let(F.lower(bare), lambda low: let(text_of_tagged(low), lambda text: reason_of(bare, low, text)))))


def reason_of(bare: Column, low: Column, text: Column) -> Column:
    """The first fitting rule for a trimmed page, the same in lower case, and its text without tags (which may be empty without the words that ``block_reason`` names)."""
    n = F.length(bare)
    has = lambda *words: holds(low, words)
    bot = (
        has("<title>just a moment") | (has(">just a moment...") & F.substring(low, 1, 5000).contains(">just a moment..."))
        | has("<title>error - cookies turned off", "checking your browser", "cf-browser-verification", "cf-chl", "captcha.perfdrive.com")
        | text.contains("cookies turned off") | text.contains("help us confirm that you are not a robot")
        | (has("akamai") & (text.contains("powered and protected by") | has("bm-verify=")))
        | text.contains("shieldsquare captcha") | text.contains("radware bot manager captcha")
        | ((n < 3000) & has("document.cookie") & has("document.location.reload"))
    )
    return (
        F.when(bare.startswith("%PDF-"), "cached_pdf")
        .when(bot, "cached_bot_check")
        .when(text.isin("loading...", "loading ...", "loading") | ((n < 5000) & has("enable javascript")), "js_rendered_required")
        .when(has("<title>doi.org", "the doi system"), "cached_router_only")
        .when(has("<title>cybercrime", "<title>cyber crime"), "cached_error_page")
        .when(n < 512, "cached_too_small")
    )


def retrieval_state(html: Column) -> Column:
    """missing, cached_bot_check, cached_router_only, cached_tiny or cached_ok, from the first 8 KiB and the size."""
    head = F.substring(html, 1, rules.HEAD_BYTES)
    any_of = lambda patterns: F.regexp_like(head, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
    return (
        F.when(html.isNull(), "missing")
        .when(any_of(rules.BOT_PATTERNS), "cached_bot_check")
        .when(any_of(rules.ROUTER_PATTERNS), "cached_router_only")
        .when(F.octet_length(html) < rules.MIN_PAGE_BYTES, "cached_tiny")
        .otherwise("cached_ok")
    )


def bot_check(html: Column, url: Column) -> Column:
    """Whether the first 8000 characters or the address speak of a bot check."""
    t = F.lower(F.concat(F.substring(raw(html), 1, 8000), text_of(url)))
    return F.greatest(*[t.contains(m) for m in rules.BOT_MARKERS])


def bad_landing(html: Column) -> Column:
    """No title, a cookie notice as canonical page, or a title that redirects, waits or asks to log in."""
    t = title(html)
    return (t == "") | F.coalesce(link_href(html, "canonical").contains("cookieAbsent"), F.lit(False)) | t.contains("Redirecting") | t.contains("Just a moment") | t.contains("Login |")


def anchors(html: Column) -> Column:
    """All anchors in order as (pos, href, anchor, title): the anchor's text without tags, squeezed and lower-cased."""
    found = F.regexp_extract_all(raw(html), F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), F.lit(1))
    head = lambda a: F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1)
    text = lambda a: F.lower(squeezed(unescaped(F.regexp_replace(a, r"(?s)<[^>]*>", ""))))
    return F.transform(found, lambda a, i: F.struct(i.alias("pos"), attribute(head(a), "href").alias("href"), text(a).alias("anchor"), attribute(head(a), "title").alias("title"), attribute(head(a), "data-tooltip").alias("tooltip"), attribute(F.regexp_extract(a, r"(?is)(<img\b[^>]*>)", 1), "src").alias("img")))


def anchors_under(html: Column, classes: str) -> Column:
    """The anchors right under an element whose class has one of ``classes`` (parts of a name, set apart by ``|``), as ``anchors`` has them: those before which it holds only texts, anchors, images and breaks."""
    opened = rf"""<(?!a\b)[a-z][\w-]*\b[^>]*\bclass\s*=\s*(?:"[^">]*|'[^'>]*)(?:{classes})[^>]*>"""
    beside = r"((?:[^<]++|<a\b[^>]*+>.*?</a\s*+>|<(?:br|img|hr)\b[^>]*+>)*+)"
    inside = lambda page: F.array_join(F.regexp_extract_all(page, F.lit(f"(?is){opened}{beside}"), F.lit(1)), " ")
    return let(raw(html), lambda page: anchors(F.when(holds(F.lower(page), classes.split("|")), inside(page)).otherwise(F.lit(""))))


def json_between(html: Column, start: str) -> Column:
    """The JSON text of a script that assigns or holds it after ``start``, up to the script's end; null where there is none."""
    found = F.regexp_extract(raw(html), rf"(?is){start}\s*=?\s*(\{{.*?\}}|\[.*?\])\s*;?\s*</script", 1)
    return F.when(found != "", found)


def ld_json(html: Column) -> Column:
    """The texts of all LD-JSON blocks."""
    return F.regexp_extract_all(raw(html), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script"""), F.lit(1))


def preloaded_state(html: Column) -> Column:
    """The JSON text of a page's state: a JSON script, an assigned object, or a parsed string literal, whose escapes are undone; null without one."""
    page = raw(html)
    script = F.nullif(F.regexp_extract(page, r"""(?is)<script[^>]*type\s*=\s*["']?application/json["']?[^>]*>(.*?)</script""", 1), F.lit(""))
    inner = F.when(F.trim(script).startswith('"'), F.from_json(F.concat(F.lit("["), script, F.lit("]")), "array<string>")[0]).otherwise(script)
    given = F.nullif(F.regexp_extract(page, r"(?is)__PRELOADED_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script", 1), F.lit(""))
    literal = F.nullif(F.regexp_extract(page, r'(?is)__PRELOADED_STATE__\s*=\s*JSON\.parse\("(.*?)"\)\s*;?\s*</script', 1), F.lit(""))
    plain = F.replace(F.replace(literal, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.coalesce(inner, given, plain)


def next_data(html: Column, path: str) -> Column:
    """A value of the data script of one kind of pages, by its path from ``$``."""
    script = F.regexp_extract(raw(html), r"""(?is)<script[^>]*id\s*=\s*["']?__NEXT_DATA__["']?[^>]*>(.*?)</script""", 1)
    return F.get_json_object(script, path)


def quoted_json(text: Column) -> Column:
    """JSON whose signs are written as ``&q;``, ``&a;``, ``&l;``, ``&g;`` and ``&s;``."""
    out = text
    for name, sign in (("&q;", '"'), ("&l;", "<"), ("&g;", ">"), ("&s;", "'"), ("&a;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out
