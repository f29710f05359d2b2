"""URL filter: allow and block rules, and gradient-boosted trees for the URLs that no rule judges.

The trees see lexical features: lengths, depth, digit ratio, character entropy, counts of parameters, dots and hyphens,
and statistics of suffixes (how often, in training, URLs with the same top-level domain, the same extension or the
same first path segment were blocked). They are trained from labelled URLs; there, a URL's suffix statistics come from the
other folds of the sample, so that its own label doesn't tell on itself.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; the trees judge it by its
(then mostly zero) features; very long URLs are read whole; repeated rows each get a verdict; an empty table gives an
empty result. With fewer than two kinds of labels the one there is holds for all, ``allow`` where there is none. Other
columns are carried by their names unless they clash with the new ones, so only the id and the URL are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, written

#: Labelled URLs of each verdict that the trees are fitted on at most; trees, their depth and step.
TRAIN_URLS, TREES, DEPTH, STEP = 10_000, 15, 4, 0.2
#: Suffixes in fewer training URLs have no statistic of their own; weight of the overall rate in each; folds of the sample.
MIN_URLS, PRIOR, FOLDS = 5, 10.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("tld", "extension", "segment")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else null.

    ``rules`` are (verdict, host + path). A rule fits its host and all subdomains where the path starts with the rule's
    path. Of rules of equal length the first listed wins; the list is code, of some hundred rules at most.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at = text.find("/") if "/" in text else len(text)
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    count = lambda text, of: (F.length(text) - F.length(F.translate(text, of, ""))).cast("double")
    return {
        "url_length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": count(u, "0123456789") / n,
        "entropy": entropy,
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(count(query, "&") + 1),
        "dots": count(host, "."),
        "hyphens": count(host, "-_"),
        "has_fragment": u.contains("#").cast("double"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Top-level domain, extension of the last path segment, first path segment."""
    return {"tld": F.substring_index(host, ".", -1), "extension": F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), "segment": F.regexp_extract(path, r"^/+([^/]*)", 1)}


class Filter:
    """Fitted trees and suffix statistics; ``model`` is None where only one verdict was seen.

    ``rates`` is a table (kind, suffix, rate) of at most 6 ``TRAIN_URLS`` / ``MIN_URLS`` rows, as each of the sample's
    URLs has three suffixes; None where there are none.
    """

    def __init__(self, model: GBTClassificationModel | None, only: str, rates: DataFrame | None, overall: float):
        self.model, self.only, self.rates, self.overall = model, only, rates, overall

    def rated(self, rows: DataFrame, host: Column, path: Column) -> DataFrame:
        """``rows`` with ``__<kind>_rate`` for each kind of suffix; the bounded table meets them by broadcast joins."""
        for kind, key in suffixes(host, path).items():
            if self.rates is None:
                rows = rows.withColumn(f"__{kind}_rate", F.lit(self.overall))
                continue
            known = self.rates.where(F.col("kind") == kind).select(F.col("suffix").alias("__key"), F.col("rate").alias("__rate"))
            rows = rows.join(F.broadcast(known), key == F.col("__key"), "left").withColumn(f"__{kind}_rate", F.coalesce("__rate", F.lit(self.overall))).drop("__key", "__rate")
        return rows

    def featured(self, rows: DataFrame, url: Column) -> DataFrame:
        """``rows`` (with the suffix rates) with a ``features`` vector."""
        host, path = host_of(url), path_of(url)
        values = lexical(url, host, path)
        rows = rows.withColumns({f"__{k}": v for k, v in values.items()})
        names = [*[f"__{k}" for k in values], *[f"__{k}_rate" for k in SUFFIXES]]
        return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def train(labelled: DataFrame, url_col: str = "url", verdict_col: str = "verdict", most: int = TRAIN_URLS, trees: int = TREES, depth: int = DEPTH) -> Filter:
    """Fit on a bounded sample of the labelled URLs (``verdict_col`` holds ``allow`` or ``block``)."""
    rows = labelled.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{verdict_col}`").alias("verdict")).where(F.col("verdict").isin("allow", "block"))
    sample = bounded_sample(rows, "url", "verdict", most).withColumns({"label": (F.col("verdict") == "block").cast("double"), "fold": F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))})
    sample = written(sample.coalesce(2))
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n = sum(kinds.values())
    overall = kinds.get(1.0, 0) / n if n else 0.0
    if len(kinds) < 2:
        return Filter(None, "block" if kinds.get(1.0) else "allow", None, overall)
    parts = suffixes(host_of(F.col("url")), path_of(F.col("url")))
    keyed = sample.select("label", "fold", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("suffix")) for kind, key in parts.items()])).alias("s")).select("label", "fold", "s.*")
    smooth = lambda bad, of: (bad + PRIOR * overall) / (of + PRIOR)
    all_of = written(keyed.groupBy("kind", "suffix").agg(F.sum("label").alias("bad"), F.count("*").alias("of")))
    rates = written(all_of.where(F.col("of") >= MIN_URLS).select("kind", "suffix", smooth(F.col("bad"), F.col("of")).alias("rate")))
    fold = keyed.groupBy("kind", "suffix", "fold").agg(F.sum("label").alias("own_bad"), F.count("*").alias("own"))
    rest = fold.join(all_of, ["kind", "suffix"]).where(F.col("of") - F.col("own") >= MIN_URLS)
    rest = written(rest.select("kind", "suffix", "fold", smooth(F.col("bad") - F.col("own_bad"), F.col("of") - F.col("own")).alias("rate")))
    data = sample
    for kind, key in parts.items():
        known = rest.where(F.col("kind") == kind).select(F.col("suffix").alias("__key"), F.col("fold").alias("__fold"), F.col("rate").alias("__rate"))
        data = data.join(F.broadcast(known), (key == F.col("__key")) & (F.col("fold") == F.col("__fold")), "left").withColumn(f"__{kind}_rate", F.coalesce("__rate", F.lit(overall))).drop("__key", "__fold", "__rate")
    out = Filter(None, "block", rates, overall)
    data = written(out.featured(data, F.col("url")).select("label", "features")).coalesce(2)
    out.model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, maxBins=32, seed=3, featuresCol="features", labelCol="label").fit(data)
    return out


def judge(pages: DataFrame, fitted: Filter, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, and ``block_score`` (the trees' probability). No shuffle."""
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if fitted.model is None:
        scored, p = rows, F.lit(float(fitted.only == "block"))
    else:
        scored = fitted.model.transform(fitted.featured(fitted.rated(rows, F.col("host"), F.col("path")), F.col("url")))
        from pyspark.ml.functions import vector_to_array

        p = vector_to_array("probability")[1]
    own = F.when(p >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), p.alias("block_score"))
