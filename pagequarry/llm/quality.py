"""Quality rules: base statistics, and robust multivariate outliers within each language and source.

Main path in DataFrame functions alone. A vector of transformed statistics is taken from each whole text. For each
(language, source) group, each language and all documents, a minimum-covariance-determinant estimate is sought: from
three deterministic starts (medians with quartile ranges; spatial signs; hyperbolic tangents of the standardised vector),
the share ``H`` of documents nearest by Mahalanobis distance gives the next mean and covariance, over again until the
determinant falls no more, and the start that ends at the least determinant wins. All levels and starts go through the
same aggregations. A group's estimate is the mixture of its own and its language's, weighed as n to ``PRIOR`` for n
documents, and a language's that of its own and all documents': the same rule for every size. Documents farther than
a cut-off from their group's centre are rejected. All estimates are over all documents that pass the base rules.

Cases: a null text has no words; empty and wordless texts fail the base rules; null language or source is a group like
any other; in a group without spread a floor on each variance keeps distances finite; repeated rows count and are
judged each; an empty table gives an empty result. Only the named columns are read. Within ties at the cut of a
concentration step all are taken; of starts with equal determinants the first is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed by the rules: least words, most repeated words of a hundred, symbol characters, and the white space between words.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS, SPACE = "#*$%&|<>", r"[\x20\x09-\x0D]+"
#: Share of a group that an estimate rests on, most concentration steps, fall of the log determinant that still counts,
#: and weight of the wider estimate in documents.
H, STEPS, SETTLED, PRIOR = 0.75, 12, 1e-3, 30
#: Files of a table of estimates.
FILES = 4
#: Squared distance beyond which a document is rejected: the 1 - 1e-9 quantile of chi-square with five degrees.
CUT_OFF = 50.0
#: Variances are held above the square of these, one for each statistic, which also bound what counts as spread.
FLOORS = {"s_word": 0.06, "s_symbol": 0.05, "s_line": 0.08, "s_repeat": 0.08, "s_variety": 0.06}
STATS = list(FLOORS)
#: The statistics' pairs, as in the lower half of a covariance.
PAIRS = [(a, b) for i, a in enumerate(STATS) for b in STATS[: i + 1]]
#: What an estimate is for; the columns of wider levels hold an empty text.
LEVEL = ["level", "lang", "source"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more: windows sorted by hash show equal neighbours; then the places covered are counted."""
    windows = F.zip_with(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(words, 3, F.size(words)), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    hashes = F.slice(windows, 1, F.size(words) - 2)

    def covered(ordered: Column) -> Column:
        none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
        n = F.size(ordered)
        neighbours = F.arrays_zip(F.concat(F.array(none), F.slice(ordered, 1, n - 1)).alias("before"), ordered.alias("own"), F.concat(F.slice(ordered, 2, n), F.array(none)).alias("after"))
        twice = F.filter(neighbours, lambda x: F.coalesce(x["before"]["h"] == x["own"]["h"], F.lit(False)) | F.coalesce(x["after"]["h"] == x["own"]["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["own"]["i"]))
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, begin, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))


def base_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One narrow row for each document: id, group, base statistics, and counts that the vector needs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    per = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return rows.select(
        "id", "lang", "source", per.alias("w"), by_line.alias("l"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("id", "lang", "source", "w.*", "l.*", "word_chars", "n_symbols")


def transformed(n: dict[str, Column]) -> dict[str, Column]:
    """The vector: log mean word length; arcsine roots of the shares of symbols, of repeated lines and of repeated words; log variety of words against what the length lets expect."""
    words, part = F.greatest(n["n_words"], F.lit(1)), lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / F.greatest(b, F.lit(1)))))
    return {
        "s_word": F.log(F.greatest(n["word_chars"], F.lit(1)) / words),
        "s_symbol": part(n["n_symbols"], n["word_chars"]),
        "s_line": part(n["n_dup_lines"], n["n_lines"]),
        "s_repeat": part(n["n_repeat_words"], n["n_words"]),
        "s_variety": F.log(F.greatest(n["n_distinct"], F.lit(1)).cast("double")) / F.log(words + F.lit(1.0)),
    }


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance of the vector for each key: plain sums, so that a large group meets as partial sums."""
    got = rows.groupBy(*keys).agg(*[F.avg(s).alias(f"m_{s}") for s in STATS], *[F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in PAIRS])
    return got.select(*keys, *[f"m_{s}" for s in STATS], *[(F.col(f"c_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}") + (F.lit(FLOORS[a] ** 2) if a == b else F.lit(0.0))).alias(f"c_{a}_{b}") for a, b in PAIRS])


def with_factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor ``l_*`` of the covariance, whose variances the floors keep positive, and ``log_det``."""
    out = estimates
    for i, a in enumerate(STATS):
        for j, b in enumerate(STATS[: i + 1]):
            rest = F.col(f"c_{a}_{b}")
            for c in STATS[:j]:
                rest = rest - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(FLOORS[a] ** 2 / 4))) if i == j else rest / F.col(f"l_{b}_{b}"))
    return out.withColumn("log_det", sum((F.log(f"l_{a}_{a}") for a in STATS[1:]), F.log(f"l_{STATS[0]}_{STATS[0]}")) * 2)


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i, a in enumerate(STATS):
        z = F.col(a) - F.col(f"m_{a}")
        for b in STATS[:i]:
            z = z - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        rows = rows.withColumn(f"z_{a}", z / F.col(f"l_{a}_{a}"))
    return rows.withColumn("d2", sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in STATS[1:]), F.col(f"z_{STATS[0]}") * F.col(f"z_{STATS[0]}")))


def starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key three first estimates, ``start`` 0 to 2, around the medians: no correlation, that of spatial signs, that of hyperbolic tangents."""
    middle = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(f"q_{s}") for s in STATS])
    middle = written(middle.select(*keys, "n", *[F.col(f"q_{s}")[1].alias(f"m_{s}") for s in STATS], *[F.sqrt(F.pow((F.col(f"q_{s}")[2] - F.col(f"q_{s}")[0]) / 1.349, 2) + FLOORS[s] ** 2).alias(f"w_{s}") for s in STATS]), FILES)
    z = {s: (F.col(s) - F.col(f"m_{s}")) / F.col(f"w_{s}") for s in STATS}
    norm = F.sqrt(sum((z[s] * z[s] for s in STATS), F.lit(1e-12)))
    forms = {1: {s: z[s] / norm for s in STATS}, 2: {s: F.tanh(z[s]) for s in STATS}}
    seen = rows.join(middle, keys).groupBy(*keys).agg(*[F.avg(f[a] * f[b]).alias(f"r{k}_{a}_{b}") for k, f in forms.items() for a, b in PAIRS])

    def of(k: int) -> DataFrame:
        like = lambda a, b: F.col(f"r{k}_{a}_{b}") / F.sqrt((F.col(f"r{k}_{a}_{a}") + 1e-9) * (F.col(f"r{k}_{b}_{b}") + 1e-9)) * F.lit(0.95)
        cell = lambda a, b: F.pow(f"w_{a}", 2) if a == b else F.col(f"w_{a}") * F.col(f"w_{b}") * (like(a, b) if k else F.lit(0.0))
        return middle.join(seen, keys).select(*keys, F.lit(k).alias("start"), "n", *[f"m_{s}" for s in STATS], *[cell(a, b).alias(f"c_{a}_{b}") for a, b in PAIRS])

    return written(with_factor(of(0).unionAll(of(1)).unionAll(of(2))), FILES)


def robust(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the estimate of least determinant: ``n``, ``m_*`` and ``c_*``.

    Each step handles the keys and starts that haven't settled, two aggregations for all of them. Estimates are
    tables, which the planner broadcasts if they are small; else a hot key's rows are split by its skew join.
    """
    own = [*keys, "start"]
    now = starts(rows, keys)
    sizes = now.where("start = 0").select(*keys, "n")
    now, ends = now.drop("n"), []
    for step in range(STEPS):
        far = with_distance(rows.join(now, keys)).select(*own, *STATS, "d2", F.col("log_det").alias("before"))
        cut = written(far.groupBy(*own).agg(F.percentile_approx("d2", H, 1000).alias("cut"), F.first("before").alias("before")), FILES)
        near = far.drop("before").join(cut, own).where("d2 <= cut")
        after = written(with_factor(moments(near, own)).join(cut.select(*own, "before"), own), FILES)
        fell = F.col("log_det") < F.col("before") - SETTLED if step else F.lit(True)
        ends.append(after.where(~fell if step < STEPS - 1 else F.lit(True)).drop("before"))
        now = after.where(fell).drop("before")
        if not now.limit(1).count():
            break
    columns = [f"m_{s}" for s in STATS] + [f"c_{a}_{b}" for a, b in PAIRS]
    every = ends[0]
    for more in ends[1:]:
        every = every.unionAll(more)
    best = written(with_factor(every.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("log_det", "start")).alias("e")).select(*keys, "e.*")), FILES)
    # the nearest share understates the spread; scaled so that its median distance is that of chi-square with five degrees
    scale = with_distance(rows.join(best, keys)).groupBy(*keys).agg((F.greatest(F.percentile_approx("d2", 0.5, 1000), F.lit(4.351)) / 4.351).alias("scale"))
    return written(best.join(scale, keys).join(sizes, keys).select(*keys, "n", *[f"m_{s}" for s in STATS], *[(F.col(f"c_{a}_{b}") * F.col("scale")).alias(f"c_{a}_{b}") for a, b in PAIRS]), FILES)


def mixed(own: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """``own`` estimates mixed with the ``wide`` ones of the same ``keys``, as n to ``PRIOR`` documents; the distance of the two centres counts as spread."""
    met = own.join(wide.select(*keys, *[F.col(c).alias(f"wide_{c}") for c in wide.columns if c[:2] in ("m_", "c_")]), keys)
    w = F.col("n") / (F.col("n") + PRIOR)
    mix = lambda c: w * F.col(c) + (1 - w) * F.col(f"wide_{c}")
    gap = lambda s: F.col(f"m_{s}") - F.col(f"wide_m_{s}")
    return met.select(*own.columns[: own.columns.index("n") + 1], *[mix(f"m_{s}").alias(f"m_{s}") for s in STATS], *[(mix(f"c_{a}_{b}") + w * (1 - w) * gap(a) * gap(b)).alias(f"c_{a}_{b}") for a, b in PAIRS])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut_off: float = CUT_OFF) -> DataFrame:
    """``id_col``, the base statistics, ``base_failed``, ``kept`` and ``distance`` (null where the base rules failed); one row for each document."""
    base = base_statistics(docs, id_col, text_col, lang_col, source_col)
    base = base.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in ("lang", "source")})
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    base = written(base.withColumns(transformed({k: F.col(k) for k in ("n_words", "n_repeat_words", "n_distinct", "n_lines", "n_dup_lines", "word_chars", "n_symbols")})))
    of = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.array(of(0, F.col("lang"), F.col("source")), of(1, F.col("lang"), F.lit("")), of(2, F.lit(""), F.lit("")))
    rows = base.where("not base_failed").select(F.explode(levels).alias("g"), *STATS).select("g.*", *STATS)
    found = robust(rows, LEVEL)
    level = lambda n, *keys: found.where(F.col("level") == n).select(*keys, F.lit(1).alias("one"), "n", *[c for c in found.columns if c[:2] in ("m_", "c_")])
    by_lang = mixed(level(1, "lang"), level(2), ["one"])
    own = written(with_factor(mixed(level(0, "lang", "source"), by_lang, ["lang"])).select("lang", "source", *[f"m_{s}" for s in STATS], *[f"l_{a}_{b}" for a, b in PAIRS]), FILES)
    met = with_distance(base.join(own, ["lang", "source"], "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return met.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & (F.col("d2") <= cut_off), F.lit(False)).alias("kept"), distance.alias("distance"))
