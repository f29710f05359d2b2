"""Line deduplication by how many distinct sites a line is on.

Main path in DataFrame functions alone. A HyperLogLog sketch of the sites is kept for each line hash; sketches merge by
aggregation, so that a line on every page meets as partial sketches. Lines whose estimate lies well above the
threshold are cross-site boilerplate; those near it get an exact distinct count. Each boilerplate line stays where it
comes first (least document id, then line number), so that no content is lost, and goes everywhere else.

Cases: lines are compared after trimming white space, blank lines stay; a null text stays null, an empty one empty; a
null site counts as one site of its own; the last line needs no line end; repeated rows are each treated alike, and rows
with equal id and text all keep a line that comes first in one of them; an empty table gives an empty result. Other
columns are carried along as they are, but for those named ``n_lines`` and ``n_removed``, which give way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Distinct sites from which a line is boilerplate; width of the sketches (their error is about 1.04 / 2^(LG_K / 2)).
MIN_SITES, LG_K = 10, 10
#: Relative distance from the threshold, over four standard errors, within which distinct sites are counted exactly.
NEAR = 0.15


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def key_of(line: Column) -> Column:
    """A line's hash; null for a blank line."""
    bare = F.regexp_replace(line, r"^[\s]+|[\s]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes ``h`` of the lines on at least ``min_sites`` distinct sites; ``lines`` has ``h`` and ``site``."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n")).where(F.col("n") >= min_sites)
    spread = written(spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")))
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("h")
    near = spread.where(F.col("sites").between(int(min_sites * (1 - NEAR)), int(min_sites * (1 + NEAR)) + 1) & ~(F.col("sites") > min_sites * (1 + NEAR))).select("h")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").count().where(F.col("count") >= min_sites).select("h")
    return written(sure.unionAll(exact))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text_col`` cleaned, and ``n_lines`` and ``n_removed`` (both 0 for a null text) behind its columns.

    Texts are split and hashed once, into a narrow table of (site, id, place, hash); they cross the network once, to meet
    the numbers of the lines to be removed. Which side of a join is small, the planner sees from the tables' bytes;
    where none is, it splits a line that is on every page.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the table's can clash
    own_id, text, site = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, site_col))
    docs = docs.withColumn("text_h", F.xxhash64(text))
    placed = docs.select(F.coalesce(site.cast("string"), F.lit("\x00")).alias("site"), own_id.alias("id"), "text_h", F.posexplode(F.transform(lines_of(text), key_of)).alias("pos", "h"))
    placed = written(placed.where("h is not null"))
    bad = boilerplate(placed.select("site", "h"), min_sites)
    hits = written(placed.drop("site").join(bad, "h"))
    order = F.struct("id", "pos", "text_h")
    firsts = written(hits.groupBy("h").agg(F.min(order).alias("first")))
    gone = hits.join(firsts, "h").where(~order.eqNullSafe(F.col("first"))).groupBy(F.col("id").alias("gone_id"), F.col("text_h").alias("gone_h")).agg(F.collect_set("pos").alias("gone"))
    met = docs.join(gone, own_id.eqNullSafe(F.col("gone_id")) & F.col("text_h").eqNullSafe(F.col("gone_h")), "left")
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))  # noqa: E731  by hashing, linear in the lines
    kept = F.transform(F.array(lines_of(text)), lambda lines: F.array_join(F.transform(left(lines), lambda i: lines[i]), "\n"))[0]
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(kept)
    number = lambda xs: F.greatest(F.coalesce(F.size(xs), F.lit(0)), F.lit(0))
    columns = [(cleaned if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names) if c.lower() not in ("n_lines", "n_removed")]
    return met.select(*columns, number(lines_of(text)).alias("n_lines"), number(F.col("gone")).alias("n_removed"))
