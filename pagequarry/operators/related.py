"""Related content: sections whose links are not the page's own, and the page's links without them.

Only pages that name such a section are parsed, each by itself where it lies. The axes over element tables (siblings,
smallest elements, an abstract's surroundings) are joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X
from . import dom


def siblings_after(table: DataFrame, heads: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Elements that follow those of ``heads`` under the same parent; ``heads`` has the key, ``parent``, ``pre`` and what else it carries."""
    own = heads.withColumnsRenamed({id_col: "__p", "parent": "__parent", "pre": "__pre"})
    return table.join(own, (F.col(id_col) == F.col("__p")) & (F.col("parent") == F.col("__parent")) & (F.col("pre") > F.col("__pre"))).drop("__p", "__parent", "__pre")


def minimal(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Chosen elements without those that have a chosen child."""
    parents = found.select(F.col(id_col).alias("__p"), F.col("parent").alias("__parent")).distinct()
    return found.join(parents, (F.col(id_col) == F.col("__p")) & (F.col("id") == F.col("__parent")), "left_anti")


def smallest_holding(table: DataFrame, needle: str, most: int = 20, id_col: str = "page_id") -> DataFrame:
    """For each page the elements whose whole text holds ``needle``, the shortest text first, ``most`` of a page: (``id_col``, id, full_text, rank)."""
    from pyspark.sql import Window

    told = dom.texts(table, table, id_col).where(F.lower("full_text").contains(needle.lower()))
    return told.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.length("full_text"), "id"))).where(F.col("rank") <= most)


def is_heading() -> Column:
    return F.regexp_like(F.col("tag"), F.lit("^h[1-6]$"))


def in_abstract_context(table: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``found`` with ``explicit``: whether an element around it is marked as an abstract by class or id, or a heading in front of it under the same parent says so."""
    value = lambda a: F.lower(F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit("")))
    marked = table.where(value("class").contains("abstract") | value("id").contains("abstract")).select(F.col(id_col).alias("__p"), F.col("pre").alias("__pre"), F.col("post").alias("__post"))
    around = found.join(marked, (F.col(id_col) == F.col("__p")) & F.col("pre").between(F.col("__pre"), F.col("__post")), "left_semi").select(id_col, "id")
    headed = siblings_after(found, table.where(is_heading() & F.regexp_like(F.lower("text"), F.lit(r"^\s*(abstract|summary)\b"))).select(id_col, "parent", "pre"), id_col).select(id_col, "id")
    marks = around.unionAll(headed).distinct().withColumn("explicit", F.lit(True))
    return found.join(marks, [id_col, "id"], "left").withColumn("explicit", F.coalesce("explicit", F.lit(False)))


TESTS = {"=": lambda v, w: v == w, "*=": lambda v, w: w in v, "^=": lambda v, w: v.startswith(w), "": lambda v, w: True}


def sections(rows: list[list]) -> list[tuple[int, int]]:
    """The subtrees of related content in one page's element rows (as ``dom.Tree`` makes them), as (pre, post)."""
    attrs = [dict(r[6]) for r in rows]
    text = [" ".join(r[7]) for r in rows]
    children: dict[int, list[int]] = {}
    for r in rows:
        children.setdefault(r[1], []).append(r[0])
    after = lambda i, tag: [j for j in children[rows[i][1]] if j > i and rows[j][5] == tag]
    fits = lambda i, rule: rows[i][5] == rule[0] and TESTS[rule[2]](attrs[i].get(rule[1], ""), rule[3])
    inside = lambda i, rule: [j for j in range(i + 1, rows[i][3] + 1) if fits(j, rule)]
    by_tag: dict[str, list[tuple]] = {}
    for rule in rules.RELATED:
        by_tag.setdefault(rule[0], []).append(rule)
    row, cell, mark, words = rules.RELATED_ROW
    head, title, listed, style = rules.RELATED_NOTES
    found: set[int] = set()
    for i, r in enumerate(rows):
        if any(fits(i, rule) for rule in by_tag.get(r[5], ())):
            found.add(i)
        for tag, kind, wanted, sibling in rules.RELATED_AFTER:
            if r[5] == tag and (wanted in attrs[i].get("src", "") if kind == "src" else TESTS[kind](text[i], wanted)):
                found.update(after(i, sibling))
        for outer, inner in rules.RELATED_INSIDE:
            if fits(i, outer):
                found.update(inside(i, inner))
        up = r[1]
        if r[5] == mark and words in text[i] and up >= 0 and rows[up][5] == cell and rows[up][1] >= 0 and rows[rows[up][1]][5] == row:
            found.add(rows[up][1])
        if r[5] == head and text[i] == title:
            for j in after(i, listed):
                found.update(inside(j, ("p", "class", "=", style)))
    return [(rows[i][2], rows[i][3]) for i in found]


def page_anchors(html: str) -> list[dict]:
    """The anchors of one page outside related content, in order."""
    tree = dom.Tree()
    tree.feed(html)
    rows = tree.finish()
    gone = sections(rows)
    out = []
    for r in rows:
        if r[5] != "a" or any(low <= r[2] <= high for low, high in gone):
            continue
        attrs, below = dict(r[6]), rows[r[0] : r[3] + 1]
        words = " ".join(" ".join(x[7]) for x in below)
        image = next((dict(x[6]).get("src") for x in below if x[5] == "img"), None)
        out.append({"pos": r[2], "href": attrs.get("href"), "anchor": " ".join(words.split()).lower(), "title": attrs.get("title"), "tooltip": attrs.get("data-tooltip"), "img": image})
    return out


def anchor_batches(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([page_anchors(html) if html is not None and named(html) else None for html in batch], dtype=object)


def own_anchors(html: Column) -> Column:
    """A page's anchors outside related content, as ``html.anchors`` gives them; null for pages that name no such section, which are not parsed. No shuffle."""
    return F.pandas_udf(anchor_batches, "array<struct<pos:int,href:string,anchor:string,title:string,tooltip:string,img:string>>")(html)


#: Words of which a page that names a section of related content has one.
WORDS = X.shortest({w for _, _, _, w in rules.RELATED if w} | {t for t, n, _, _ in rules.RELATED if not n} | {w for _, _, w, _ in rules.RELATED_AFTER} | {rules.RELATED_ROW[3]} | {i[3] for _, i in rules.RELATED_INSIDE} | {rules.RELATED_NOTES[3]})


def names_one(html: Column) -> Column:
    """Whether a page's text names a section of related content at all: the cheap test that saves parsing."""
    return X.holds(html, WORDS)


def named(html: str) -> bool:
    """``names_one`` of a page in a batch, where the search for a word is many times faster."""
    return any(w in html for w in WORDS)
