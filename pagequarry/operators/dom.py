"""DOM tables: one row for each element of a page, with the interval that its descendants fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: elements without content, and elements that an opening tag closes ---
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "tbody", "div", "body", "html", "section", "article", "nav"}
NODE = "id int, parent int, pre int, post int, depth int, tag string, attrs map<string,string>, text string"


class Tree(HTMLParser):
    """Collects (id, parent, pre, post, depth, tag, attrs, own text) rows; stray end tags are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, set())
        while self.open and (top := self.rows[self.open[-1]][5]) in closes and top not in HOLDS:
            self.shut()
        row = [len(self.rows), self.open[-1] if self.open else -1, len(self.rows), -1, len(self.open), tag, [(k, v or "") for k, v in dict(attrs).items()], []]
        self.rows.append(row)
        if tag in VOID:
            row[3] = row[0]
        else:
            self.open.append(row[0])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.shut()

    def shut(self) -> None:
        self.rows[self.open.pop()][3] = len(self.rows) - 1

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[i][5] == tag for i in self.open):
            while self.rows[self.open[-1]][5] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data: str) -> None:
        if self.open and data.strip():
            self.rows[self.open[-1]][7].append(data.strip())

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self.shut()
        return self.rows


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The pages exploded into elements: ``id_col`` and the columns of ``NODE``. An element's descendants have pre in (pre, post].

    A null or empty page has no rows. Pages are parsed where they lie; each becomes rows before the next is read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "id", "parent", "pre", "post", "depth", "tag", "attrs", "text"]
    types = [None, *[pa.int32()] * 5, pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = Tree()
                tree.feed(html.as_py() or "")
                for row in tree.finish():
                    keys.append(key)
                    rows.append((*row[:7], " ".join(row[7])))
                if len(rows) > 20_000:
                    yield made(batch, keys, rows)
                    keys, rows = [], []
            if rows:
                yield made(batch, keys, rows)

    def made(batch: pa.RecordBatch, keys: list, rows: list) -> pa.RecordBatch:
        columns = [pa.array(keys, batch.column(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{html_col}`")).mapInArrow(work, f"`{id_col}` {kind}, {NODE}")


def with_read(pages: DataFrame, inputs: list[str], name: str, ddl: str, kind: pa.DataType, read: Callable[..., object], most: int = 4 << 20) -> DataFrame:
    """``pages`` with the column ``name`` behind: what ``read`` makes of the columns ``inputs``, row by row where they lie. What is handed back at once is of about ``most`` bytes of the first input."""
    at = [pages.columns.index(c) for c in inputs]
    names = [*pages.columns, name]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                values = [batch.column(c)[i].as_py() for c in at]
                out.append(read(*values))
                size += len(values[0] or "")
                if size > most or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=names)
                    start, size, out = i + 1, 0, []

    return pages.mapInArrow(work, T.StructType([*pages.schema.fields, T.StructField(name, T._parse_datatype_string(ddl))]))


ELEMENT = "struct<pre:int,post:int,depth:int,id:int,parent:int,tag:string,classes:array<string>,attrs:map<string,string>,text:string>"
ELEMENT_TYPE = pa.struct([*[(n, pa.int32()) for n in ("pre", "post", "depth", "id", "parent")], ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


def elements_of(html: str | None) -> list[dict] | None:
    """A page's elements in order; null for null."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    return [{"pre": r[2], "post": r[3], "depth": r[4], "id": r[0], "parent": r[1], "tag": r[5], "classes": dict(r[6]).get("class", "").split(), "attrs": r[6], "text": " ".join(r[7])} for r in tree.finish()]


def with_elements(pages: DataFrame, html_col: str, name: str = "els") -> DataFrame:
    """``pages`` with each page's elements as one array (null where the HTML is): for passes that look at one page at a time, without a shuffle."""
    return with_read(pages, [html_col], name, f"array<{ELEMENT}>", pa.list_(ELEMENT_TYPE), elements_of)


def has_class(name: str) -> Column:
    """Whether the element has the class."""
    return F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)


def matches(selector: str) -> Column:
    """A condition for a simple selector: ``tag``, ``.class``, ``#id``, ``[attr=value]`` or ``[attr]``, joined."""
    import re

    out = F.lit(True)
    for kind, name, attr, value in re.findall(r"([.#]?)([\w-]+)|\[([\w:-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]", selector):
        if attr:
            out = out & (F.col("attrs")[attr].isNotNull() if not value else F.col("attrs")[attr] == value)
        elif kind == ".":
            out = out & has_class(name)
        elif kind == "#":
            out = out & (F.col("attrs")["id"] == name)
        else:
            out = out & (F.col("tag") == name.lower())
    return F.coalesce(out, F.lit(False))


def contained(table: DataFrame, above: DataFrame, own: bool, id_col: str = "page_id") -> DataFrame:
    """``table`` with ``__in``: whether an element lies under one of ``above`` (with ``own``, or is one itself).

    As subtrees nest, an element lies in one that began before it if the farthest end so far is behind it. So both sides
    are put in the order of their starts and gone through once, each page by itself: linear after the sort, whatever their number.
    """
    starts = above.select(F.col(id_col), "pre", F.col("post").alias("__end")).distinct()
    columns = table.columns
    both = table.withColumns({"__end": F.lit(None).cast("int"), "__side": F.lit(0 if not own else 2)}).unionByName(starts.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    # at equal starts: an element before the start of its own subtree, unless it counts as in it
    farthest = F.max("__end").over(Window.partitionBy(id_col).orderBy("pre", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("__in", F.coalesce(farthest >= F.col("pre"), F.lit(False))).where("__side <> 1").select(*columns, "__in")


def select(table: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """Elements that a descendant path of simple selectors, such as ``div.authors a.name``, reaches."""
    found = None
    for part in path.split():
        step = table.where(matches(part))
        found = step if found is None else contained(step, found, False, id_col).where("__in").drop("__in")
    return found


def outside(table: DataFrame, excluded: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``table`` without the elements in the subtrees of ``excluded``."""
    return contained(table, excluded, True, id_col).where("not __in").drop("__in")


def texts(found: DataFrame, table: DataFrame, id_col: str = "page_id") -> DataFrame:
    """For each found element its whole text, own and descendants', in document order: (``id_col``, ``id``, ``full_text``).

    A page's texts stand in the order of their elements; an element's is the stretch between its ends, whose bounds a
    search in that order gives, so the work grows with what comes out. A page is one group.
    """
    kind = found.schema[id_col].dataType.simpleString()

    def work(own: pa.Table, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("at")
        places, said = pieces.column("at").to_numpy(), pieces.column("said").to_pylist()
        lo = np.searchsorted(places, own.column("pre").to_numpy(), "left")
        hi = np.searchsorted(places, own.column("post").to_numpy(), "right")
        whole = [" ".join(said[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return pa.table([own.column(0), own.column("id"), pa.array(whole, pa.string())], names=[id_col, "id", "full_text"])

    own = found.select(id_col, "id", "pre", "post").groupBy(id_col)
    other = table.where("text <> ''").select(F.col(id_col).alias("of"), F.col("pre").alias("at"), F.col("text").alias("said"))  # other names, as both sides may be the same table
    return own.cogroup(other.groupBy("of")).applyInArrow(work, f"`{id_col}` {kind}, id int, full_text string")
