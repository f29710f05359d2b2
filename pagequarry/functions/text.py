"""Text functions. All are Column expressions unless they say otherwise; null stays null or becomes empty as stated."""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

#: Accented Latin letters and the letters they fold to, one for one.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Columns that were built for the running Spark context, by name.
BUILT: dict[tuple, object] = {}


def once(name: tuple, build: Callable[[], object]) -> object:
    """What ``build`` makes, built once for a Spark context: columns of names alone serve any table, and large ones take seconds to put together."""
    key = (id(SparkContext._active_spark_context), *name)
    if key not in BUILT:
        BUILT[key] = build()
    return BUILT[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def holds(c: Column, words: Iterable[str]) -> Column:
    """Whether a text has one of ``words``, as they are written; false for null."""
    return F.coalesce(functools.reduce(operator.or_, [c.contains(w) for w in words]), F.lit(False))


def shortest(words: Iterable[str]) -> list[str]:
    """The words without those that have another one within: a text that has any of ``words`` has one of these."""
    words = set(words)
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def squeezed(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_latin(c: Column) -> Column:
    """Letters with accents without them, and sharp s as ss: the letters of western European languages."""
    return F.replace(F.translate(c, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def normalize_key(c: Column) -> Column:
    """Comparison key of a title: lower case, no accents, tags, punctuation, articles or white space; null gives ''."""
    t = F.regexp_replace(fold_latin(F.lower(text_of(c))), r"<\w+.*?>", "")
    t = F.regexp_replace(t, r"[^a-z0-9\s]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", ""), r"\band\b", "")
    return F.regexp_replace(t, r"\s+", "")


def keys_equal(a: Column, b: Column) -> Column:
    """Whether two texts have the same key; false where either is null or empty."""
    return F.coalesce((a != "") & (b != "") & (normalize_key(a) == normalize_key(b)), F.lit(False))


def folded(text: str | None) -> str:
    """NFKC, case folded, without marks, white space collapsed; plain Python, for batches."""
    if not text:
        return ""
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return " ".join("".join(ch for ch in t if unicodedata.category(ch) != "Mn").split())


def fold_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(folded, na_action=None)


def fold_text(c: Column) -> Column:
    """Full Unicode folding of whole texts, in batches; null gives ''."""
    return F.pandas_udf(fold_batches, "string")(c)


def normalize_text(c: Column) -> Column:
    """Lower case, Latin accents folded, white space collapsed; null gives ''."""
    return squeezed(fold_latin(F.lower(text_of(c))))


def normalize_alpha(c: Column) -> Column:
    """As ``normalize_text`` with punctuation turned to spaces: for keys of names and organisations."""
    return squeezed(F.regexp_replace(normalize_text(c), r"[^\p{L}\p{N}_\s]+", " "))


def strip_prefix(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"^(?:{pattern})", "")


def strip_suffix(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"(?:{pattern})$", "")


def strip_around(c: Column, pattern: str) -> Column:
    """The pattern removed from both ends, as often as it stands there."""
    return F.regexp_replace(c, f"^(?:{pattern})+|(?:{pattern})+$", "")


def drop_fillers(c: Column) -> Column:
    """An organisation's words without the filler words."""
    return F.array_join(F.filter(F.split(c, r"\s+"), lambda w: (w != "") & ~w.isin(rules.FILLER_WORDS)), " ")


def clean_affiliation(c: Column) -> Column:
    """Without e-mail addresses and links, as a key."""
    return normalize_alpha(F.regexp_replace(F.regexp_replace(text_of(c), r"\S+@\S+", " "), r"https?://\S+", " "))


def split_affiliations(c: Column) -> Column:
    """Affiliations from one string: cut at ``;``, a leading 'and' dropped; parts that name a correspondence, an e-mail or a link go; order kept, repeats dropped."""
    parts = F.transform(F.split(text_of(c), ";"), lambda x: F.regexp_replace(F.trim(x), r"(?i)^and\s+", ""))
    low = lambda x: F.lower(x)
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~low(x).contains("correspond") & ~x.contains("@") & ~low(x).contains("http")))


def failure_modes(note: Column) -> Column:
    """The failure modes that a note names, in the order of the rules; empty for null."""
    found = F.array(*[F.when(F.regexp_like(text_of(note), F.lit(f"(?i){p}")), F.lit(name)) for name, p in rules.FAILURE_MODES])
    return F.filter(found, lambda x: x.isNotNull())


def secrets(c: Column) -> Column:
    """Names of the patterns of secrets and private data that a text holds; empty for null."""
    found = F.array(*[F.when(F.regexp_like(text_of(c), F.lit(f"(?i){p}")), F.lit(name)) for name, p in rules.SECRET_PATTERNS])
    return F.filter(found, lambda x: x.isNotNull())


def redact(c: Column, most: int = 500) -> Column:
    """E-mail addresses and phone numbers masked, white space collapsed, cut to ``most`` characters with an ellipsis."""
    t = F.regexp_replace(text_of(c), rules.EMAIL_PATTERN, "[email]")
    t = squeezed(F.regexp_replace(t, rules.PHONE_PATTERN, "[phone]"))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def issue_class(c: Column) -> Column:
    """What a ticket about corresponding authors complains of."""
    t = F.lower(text_of(c))
    has = lambda *words: F.greatest(*[t.contains(w) for w in words], F.lit(False))
    return (
        F.when(has("wrong corresponding", "incorrect corresponding"), "wrong_corresponding_author")
        .when(has("missing corresponding", "no corresponding"), "missing_corresponding_author")
        .when(has("author email", "corresponding author email"), "author_email")
        .when(has("corresponding"), "corresponding_author_general")
        .otherwise("unknown_corresponding_author_issue")
    )


def license_of(c: Column, dataset: bool = False) -> Column:
    """The licence a text names, by the first fitting phrase; null where none fits or a public-domain hit is denied."""
    phrases = rules.LICENSES + (rules.DATASET_LICENSES if dataset else [])

    def first(t: Column) -> Column:
        hit = F.when(holds(t, shortest(p for p, _ in phrases)), F.coalesce(*[F.when(t.contains(p), F.lit(n)) for p, n in phrases]))
        return let(hit, lambda n: F.when((n != "public-domain") | ~t.contains(rules.NOT_PUBLIC_DOMAIN), n))

    return let(F.lower(F.replace(F.replace(text_of(c), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))), first)


def abstract_gate(c: Column, least: int = 200) -> Column:
    """A meta description that passes for an abstract: longer than ``least``, not cut off, no link; else null."""
    return F.when((F.length(c) > least) & ~F.regexp_like(F.rtrim(c), F.lit(r"(\.\.\.|…)$")) & ~c.startswith("http"), c)


def strip_abstract_label(c: Column) -> Column:
    """Without the leading label 'abstract' in one of four languages, given up to twice."""
    return strip_prefix(F.trim(c), r"(?i)(?:(?:abstract|résumé|resumen|zusammenfassung)[\s:.]*){1,2}")


def decode_cfemail(c: Column) -> Column:
    """An address hidden as hex digits whose first byte is XORed into the others."""
    key = F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    at = F.sequence(F.lit(1), F.greatest((F.length(c) / 2).cast("int") - 1, F.lit(1)))
    code = lambda i: F.conv(F.substring(c, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)
    return F.when(F.regexp_like(c, F.lit("^[0-9a-fA-F]{4,}$")), F.array_join(F.transform(at, lambda i: F.char(code(i))), ""))


def three_valued(c: Column) -> Column:
    """TRUE, FALSE in any case as booleans; anything else null."""
    t = F.upper(F.trim(c.cast("string")))
    return F.when(t == "TRUE", True).when(t == "FALSE", False)


def percent(c: Column, signed: bool = False) -> Column:
    """A share as percent with one decimal; with ``signed`` a plus before positive ones; a dash for null."""
    text = F.format_string("%.1f%%", c * 100)
    return F.coalesce(F.when(c > 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text, F.lit("—"))


def excerpt(c: Column, needle: Column, around: int = 240) -> Column:
    """The text up to ``around`` characters before and after the first place of ``needle``; null where it isn't."""
    at = F.position(F.lower(needle), F.lower(c))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at + F.length(needle) + around - start))


def name_key(c: Column) -> Column:
    """(last name, first initial) of 'First Last' or 'Last, First', folded."""
    parts = F.split(normalize_alpha_keep_comma(c), r"\s*,\s*")
    words = F.split(F.trim(parts[0]), r"\s+")
    comma = F.size(parts) > 1
    last = F.when(comma, F.trim(parts[0])).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.try_element_at(parts, F.lit(2))).otherwise(words[0])
    return F.struct(F.coalesce(last, F.lit("")).alias("last"), F.coalesce(F.substring(F.trim(first), 1, 1), F.lit("")).alias("initial"))


def normalize_alpha_keep_comma(c: Column) -> Column:
    return squeezed(F.regexp_replace(normalize_text(c), r"[^\p{L}\p{N}_\s,]+", " "))


def first_last(c: Column) -> Column:
    """'Last, First' turned to 'First Last'; other names with single spaces."""
    parts = F.split(squeezed(c), r"\s*,\s*")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(squeezed(c))


# --- fixed values: the characters of code page 1252 at 0x80 to 0x9F (five places are empty) ---
CODE_PAGE = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
#: A run of characters that, as bytes, are whole UTF-8 characters beyond ASCII; and what rarely stands in a text unless by a wrong decoding.
WRONG_RUN = r"((?:[\u00C2-\u00DF][\u0080-\u00BF]|[\u00E0-\u00EF][\u0080-\u00BF]{2}|[\u00F0-\u00F4][\u0080-\u00BF]{3})+)"
UNLIKELY = r"[\u0080-\u009F\uFFFD]|[\u00C2-\u00F4][\u0080-\u00BF]"
ROUNDS = 3


def as_bytes(c: Column) -> Column:
    """The characters of code page 1252 put at their bytes' numbers."""
    return F.translate(c, "".join(CODE_PAGE.values()), "".join(map(chr, CODE_PAGE)))


def as_characters(c: Column) -> Column:
    return F.translate(c, "".join(map(chr, CODE_PAGE)), "".join(CODE_PAGE.values()))


def decoded_again(c: Column) -> Column:
    """One round trip: runs that are UTF-8 read as code page 1252 (or Latin 1) are read as UTF-8; all else stays."""
    def parts(raw: Column) -> Column:
        cut = F.split(F.regexp_replace(raw, WRONG_RUN, "\u0000\u0001$1\u0000"), "\u0000")
        read = lambda p: F.try_validate_utf8(F.encode(F.substring(p, 2, F.length(p)), "ISO-8859-1").cast("string"))
        return F.array_join(F.transform(cut, lambda p: F.when(p.startswith("\u0001"), F.coalesce(read(p), as_characters(F.substring(p, 2, F.length(p))))).otherwise(as_characters(p))), "")

    return let(as_bytes(F.translate(c, "\u0000\u0001", "")), parts)


def unlikely(c: Column) -> Column:
    """How many characters a wrong decoding would explain."""
    return F.regexp_count(as_bytes(c), F.lit(UNLIKELY))


def repaired(c: Column) -> Column:
    """A wrongly decoded text as it was meant: of the text after no, one, two or ``ROUNDS`` round trips, the first with the fewest unlikely characters.

    Text without such a run stays as it is, as does null. The two control characters that mark places here (U+0000, U+0001) go where a round trip is made.
    """
    def chosen(text: Column) -> Column:
        tries = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.array(text), lambda done, _: F.concat(done, F.array(decoded_again(F.element_at(done, -1)))))
        return F.array_min(F.transform(tries, lambda t, i: F.struct(unlikely(t).alias("n"), i.alias("i"), t.alias("t"))))["t"]

    return F.when(F.regexp_like(as_bytes(c), F.lit(WRONG_RUN)), let(c, chosen)).otherwise(c)


def stripped_message(c: Column) -> Column:
    """A message without what surrounds it: repaired, then without line ends, spaces and semicolons at both ends."""
    return F.regexp_replace(repaired(c), r"^[\r\n ;]+|[\r\n ;]+$", "")
