"""Extractors of repositories' landing pages, and the ladder of the pages that come from them.

Pages are matched by their addresses (HAL by its identifier), parsed once, and read by joins of element rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions import text as X
from . import dom, extract
from .people import author, none_of
from .related import siblings_after

NAMES = ["rule_id", "authors", "published_date", "genre"]


def listed(rows: DataFrame, rule: str, order: str, id_col: str) -> DataFrame:
    """(``id_col``, rule_id, authors) of rows (``id_col``, order, name, affiliations)."""
    one = F.struct(F.col(order).alias("o"), author(F.col("name"), F.col("affiliations"), F.lit(None).cast("boolean")).alias("a"))
    return rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("authors")).select(id_col, F.lit(rule).alias("rule_id"), "authors")


def names_with_places(table: DataFrame, id_col: str) -> DataFrame:
    """Definition lists of authors: each term a name, the descriptions up to the next term its affiliations."""
    lists = table.where((F.col("tag") == "dl") & (F.try_element_at("attrs", F.lit("id")) == "authors-affiliations")).select(F.col(id_col).alias("__p"), F.col("id").alias("__list"))
    inside = table.where(F.col("tag").isin("dt", "dd")).join(lists, (F.col(id_col) == F.col("__p")) & (F.col("parent") == F.col("__list"))).drop("__p", "__list")
    told = inside.select(id_col, "id", "pre", "post", "tag").join(dom.texts(inside, table, id_col), [id_col, "id"])
    groups = extract.fold_groups(told.withColumn("k", F.struct(id_col)), "k", "pre", F.col("tag") == "dt", "full_text")
    return groups.select(F.col(f"k.{id_col}").alias(id_col), F.col("group"), F.trim("head").alias("name"), F.transform("members", lambda m: F.trim(m)).alias("affiliations"))


def numbered_paragraphs(table: DataFrame, id_col: str) -> DataFrame:
    """Paragraphs ``author1``, ``author2``, ...: the first text is the name, those between it and the last are places; small print, claims and personal identifiers are passed over."""
    people = table.where((F.col("tag") == "p") & F.regexp_like(F.coalesce(F.try_element_at("attrs", F.lit("id")), F.lit("")), F.lit(r"^author\d+$")))
    drop = table.where((F.col("tag") == "small") | ((F.col("tag") == "a") & F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")).contains("claim-authorship")))
    kept = dom.outside(table, drop, id_col).where("text <> ''").select(F.col(id_col).alias("__p"), F.col("pre").alias("t_pre"), "text")
    texts = people.select(id_col, "id", "pre", "post").join(kept, (F.col(id_col) == F.col("__p")) & F.col("t_pre").between(F.col("pre"), F.col("post")))
    rows = texts.groupBy(id_col, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_pre", "text"))), lambda x: x["text"]).alias("t"))
    between = F.filter(F.slice("t", 2, F.greatest(F.size("t") - 2, F.lit(0))), lambda x: ~F.regexp_like(x, F.lit(r"(?:[0-9]{4}-){3}[0-9]{3}[0-9Xx]")))
    return rows.select(id_col, "id", F.col("t")[0].alias("name"), between.alias("affiliations"))


def numbered_structures(table: DataFrame, id_col: str) -> DataFrame:
    """Authors as links, each with the numbers of its structures beside it; structures as numbered spans, whose neighbour holds the organisation in an attribute."""
    value = lambda a: F.coalesce(F.try_element_at("attrs", F.lit(a)), F.lit(""))
    people = dom.select(table, "div.authors a", id_col)
    spans = dom.select(table, "div.structures span", id_col).where(~value("class").contains("icon-institution"))
    nexts = siblings_after(table, spans.select(id_col, "parent", "pre", F.col("text").alias("label")), id_col).where(value("data-content") != "")
    first = nexts.groupBy(id_col, "label").agg(F.min_by(value("data-content"), "pre").alias("popup"))
    bare = lambda c: X.squeezed(H.unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))
    organization = X.squeezed(F.concat_ws(" ", bare(F.regexp_extract("popup", r"(?is)<a\b[^>]*>(.*?)</a\s*>", 1)), bare(F.regexp_extract("popup", r"(?is)</a\s*>\s*<small\b[^>]*>(.*?)</small", 1))))
    places = first.select(F.col(id_col).alias("o_p"), F.trim("label").alias("label"), organization.alias("organization"))
    told = people.select(id_col, "id", "parent", "pre", "post").join(dom.texts(people, table, id_col), [id_col, "id"])
    beside = siblings_after(table, told.select(id_col, "parent", "pre", F.col("id").alias("who")), id_col).groupBy(id_col, "who").agg(F.min_by(F.struct("tag", "text"), "pre").alias("n"))
    numbers = F.when(F.col("n.tag") != "a", F.regexp_extract_all("n.text", F.lit(r"\b(\d+)\b"), F.lit(1)))
    refs = told.join(beside.select(id_col, F.col("who").alias("id"), numbers.alias("numbers")), [id_col, "id"], "left").select(id_col, "id", F.col("full_text").alias("name"), F.explode_outer("numbers").alias("label")).withColumn("label", F.trim("label"))
    met = refs.join(places.withColumnRenamed("label", "o_label"), (F.col(id_col) == F.col("o_p")) & (F.col("label") == F.col("o_label")), "left")
    return met.groupBy(id_col, "id").agg(F.first("name").alias("name"), F.transform(F.array_sort(F.collect_list(F.when(F.col("organization").isNotNull(), F.struct(F.col("label").cast("int").alias("n"), "organization")))), lambda x: x["organization"]).alias("affiliations"))


def creators(html: Column) -> Column:
    """The persons among a page's LD-JSON creators."""
    kind = "array<struct<`@type`:string,name:string,affiliation:string>>"
    people = F.filter(F.flatten(F.transform(H.ld_json(html), lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$.creator"), kind), none_of("struct<`@type`:string,name:string,affiliation:string>")))), lambda p: p["@type"] == "Person")
    affs = lambda a: F.when(a.isNull(), none_of()).when(a.startswith("["), F.coalesce(F.from_json(a, "array<string>"), none_of())).otherwise(F.array(a))
    return F.transform(people, lambda p: author(p["name"], affs(p["affiliation"]), F.lit(None).cast("boolean")))


def split_places(authors: Column) -> Column:
    """Authors whose single affiliation lists several, cut at semicolons."""
    cut = lambda a: F.when(F.size(a["affiliations"]) == 1, F.filter(F.transform(F.split(a["affiliations"][0], ";"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(a["affiliations"])
    return F.transform(authors, lambda a: author(a["name"], cut(a), a["is_corresponding"]))


def described(table: DataFrame, title: str, id_col: str) -> DataFrame:
    """(``id_col``, value): the text of the first description after the term that holds ``title``."""
    terms = table.where((F.col("tag") == "dt") & F.col("text").contains(title)).select(id_col, "parent", "pre")
    after = siblings_after(table, terms, id_col).where("tag = 'dd'").groupBy(id_col).agg(F.min_by(F.struct("id", "pre", "post"), "pre").alias("d")).select(id_col, "d.*")
    return dom.texts(after, table, id_col).select(id_col, F.nullif(X.squeezed(F.col("full_text")), F.lit("")).alias("value"))


def read(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """What a repository's extractor finds: (``id_col``, rule_id, authors, published_date, genre); pages of no known repository have no row."""
    html = F.col(f"`{html_col}`")
    met = extract.dispatch(pages, rules.REPOSITORIES, id_col, html_col)
    hal = pages.where(F.exists(H.metas(html), lambda m: (F.lower(m["key"]) == "dc.identifier") & F.regexp_like(F.coalesce(m["content"], F.lit("")), F.lit(r"^hal-\d+$")))).select(F.col(f"`{id_col}`"), F.lit("hal").alias("rule_id"), F.lit(99).alias("ord"))
    met = met.unionByName(hal).groupBy(id_col).agg(F.min_by("rule_id", "ord").alias("rule_id"))
    own = pages.join(met, id_col)
    parsed = dom.nodes(own.where(F.col("rule_id").isin("dergipark", "doaj", "hal", "osti")), id_col, html_col)
    of = lambda rule: parsed.join(met.where(F.col("rule_id") == rule).select(id_col), id_col, "left_semi")
    people = listed(names_with_places(of("doaj"), id_col), "doaj", "group", id_col).unionByName(listed(numbered_paragraphs(of("dergipark"), id_col), "dergipark", "id", id_col)).unionByName(listed(numbered_structures(of("hal"), id_col), "hal", "id", id_col))
    genre = described(of("osti"), "Resource Type:", id_col).withColumnRenamed("value", "genre")
    date = described(of("osti"), "Publication Date:", id_col).withColumnRenamed("value", "date")
    rows = own.join(people.withColumnRenamed("authors", "listed").drop("rule_id"), id_col, "left").join(genre, id_col, "left").join(date, id_col, "left")
    authors = F.when(F.col("rule_id") == "zenodo", creators(html)).when(F.col("rule_id") == "osti", split_places(extract.fold_metas(html))).otherwise(F.col("listed"))
    dated = F.when(F.col("rule_id") == "econpapers", H.meta(html, "citation_publication_date")).otherwise(F.col("date"))
    return rows.select(id_col, "rule_id", F.coalesce(authors, none_of(extract.AUTHOR)).alias("authors"), dated.alias("published_date"), "genre")


def ladder(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The record of repositories' pages: what the repository's extractor finds if it has authors, else the generic meta fold; (``id_col``, rule_id, authors, abstract)."""
    html = F.col(f"`{html_col}`")
    found = read(pages, id_col, html_col).where(F.size("authors") > 0).select(F.col(id_col).alias("__p"), F.col("rule_id").alias("r"), F.col("authors").alias("a"))
    rows = pages.join(found, F.col(f"`{id_col}`") == F.col("__p"), "left")
    return rows.select(F.col(f"`{id_col}`"), F.coalesce("r", F.lit("generic")).alias("rule_id"), F.coalesce("a", extract.fold_metas(html)).alias("authors"), extract.abstract_of(html).alias("abstract"))
