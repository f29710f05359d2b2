"""Splitting personal names into title, first, middle, last and suffix, and comparing them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded

# --- fixed values: words in front of and behind a name, and particles that belong to the last name ---
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "rev", "hon", "md"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd", "md", "msc", "bsc", "mph", "mba", "dds", "rn", "facs", "frcp", "esq"}
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "bin", "ibn", "al", "el", "ter", "ten"}
NAME = "title string, first string, middle string, last string, suffix string"


def bare(word: str) -> str:
    return word.replace(".", "").lower()


def split_name(name: str | None) -> tuple[str, str, str, str, str]:
    """(title, first, middle, last, suffix); 'Last, First Middle' and 'First Middle Last, PhD' are told apart by their words."""
    head, *tails = [p.strip() for p in (name or "").split(",")]
    suffixes = [t for t in tails if t and all(bare(w) in SUFFIXES for w in t.split())]
    rest = [t for t in tails if t and t not in suffixes]
    words = head.split()
    title = []
    if rest:
        given, last = " ".join(rest).split(), head
    else:
        while words and bare(words[-1]) in SUFFIXES and len(words) > 2:
            suffixes.insert(0, words.pop())
        given, last = words, ""
    while given and bare(given[0]) in TITLES and len(given) + bool(last) > 1:
        title.append(given.pop(0))
    if not rest and given:
        at = len(given) - 1
        while at > 1 and bare(given[at - 1]) in PARTICLES:
            at -= 1
        last, given = (" ".join(given[at:]), given[:at]) if len(given) > 1 else (given[0], [])
    return " ".join(title), given[0] if given else "", " ".join(given[1:]), last, " ".join(suffixes)


def split_batches(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in names:
        yield pd.DataFrame([split_name(n) for n in s], columns=["title", "first", "middle", "last", "suffix"])


def parts(name: Column) -> Column:
    """The parts of a name as a struct; empty strings where there is none."""
    return F.pandas_udf(split_batches, NAME)(name)


def same_person(a: str | None, b: str | None) -> bool:
    """Whether last names are equal and first names are, or one is the other's initial."""
    (_, f, _, x, _), (_, g, _, y, _) = split_name(a), split_name(b)
    f, g, x, y = folded(f.replace(".", "")), folded(g.replace(".", "")), folded(x), folded(y)
    return bool(x) and x == y and bool(f) and bool(g) and (f == g or (1 in (len(f), len(g)) and f[0] == g[0]))


def match_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([same_person(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def names_match(a: Column, b: Column) -> Column:
    return F.pandas_udf(match_batches, "boolean")(a, b)
