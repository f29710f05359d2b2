"""Evaluation: greedy one-to-one matching against gold, scores of rows, scorecards of groups."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import url as U
from ..functions.fuzzy import indel_ratio, token_set
from ..functions.names import split_name
from ..rules import FILLER_WORDS

SOFT = 85.0
AUTHORS_SCORE = "matched array<struct<gold_index:int,parsed_index:int,key_match:boolean,name_ratio:double>>, gold_unmatched array<int>, parsed_unmatched array<int>, precision double, recall double, f1 double, precision_soft double, recall_soft double, f1_soft double"
AFFILIATIONS_SCORE = "strict_f1 double, soft_f1 double, fuzzy_f1 double, matched int, gold_total int, parsed_total int"


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def rates(tp: int, gold: int, parsed: int) -> tuple[float, float, float]:
    p, r = tp / parsed if parsed else 0.0, tp / gold if gold else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


#: ASCII as ``alpha`` has it: letters and digits in lower case, white space and the underscore as they are, all else a space.
PLAIN = {c: chr(c).lower() if chr(c).isalnum() or chr(c) == "_" or chr(c).isspace() else " " for c in range(128)}


def alpha(name: str) -> str:
    import re

    if name.isascii():
        return " ".join(name.translate(PLAIN).split())
    return " ".join(re.sub(r"[^\w\s]+", " ", X.folded(name.replace("ß", "ss"))).split())


def key_of(name: str) -> tuple[str, str]:
    """(last name, first initial), without titles and suffixes."""
    return keyed(name, alpha(name))


def keyed(name: str, plain: str) -> tuple[str, str]:
    """``key_of`` a name whose ``alpha`` is known."""
    _, first, _, last, _ = split_name(name)
    words = plain.split()
    return (alpha(last) or words[-1], (alpha(first) or words[0])[:1]) if words else ("", "")


def assigned(ratio: np.ndarray, least: float, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns of a table of ratios, taken in order: those in ``first``, then by ratio, later rows and columns before earlier ones.

    Pairs under ``least`` count only if in ``first``.
    """
    first = np.zeros(ratio.shape, bool) if first is None else first
    rows, columns = np.nonzero(first | (ratio >= least))
    order = np.lexsort((-columns, -rows, -ratio[rows, columns], ~first[rows, columns]))
    free_rows, free_columns, out = np.ones(ratio.shape[0], bool), np.ones(ratio.shape[1], bool), []
    for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
        if free_rows[i] and free_columns[j]:
            free_rows[i] = free_columns[j] = False
            out.append((i, j))
    return out


def ratios(gold: list[str], parsed: list[str], ratio: Callable[[str, str], float]) -> np.ndarray:
    """A table of ratios; below every threshold where a side is empty."""
    return np.array([[ratio(g, p) if g and p else -1.0 for p in parsed] for g in gold], float).reshape(len(gold), len(parsed))


class Names:
    """The distinct names of a batch: their ``alpha``, numbers of their keys and words, and what bounds the ratio of two of them.

    A ratio is the greatest of three indel ratios. Two of them follow from the lengths of the words that both names have; the third
    is at most what the lengths, or the characters of both names, leave room for. Only pairs that this doesn't settle are compared.
    """

    #: Words of a name up to which shared words are found side by side; pairs with a longer one are compared.
    MOST = 8

    def __init__(self, names: list[str]):
        self.plain = [alpha(n) for n in names]
        keys: dict[tuple[str, str], int] = {}
        words: dict[str, int] = {}
        of_key = [keyed(n, a) for n, a in zip(names, self.plain, strict=True)]
        self.key = np.array([keys.setdefault(k, len(keys)) if k[0] else -1 for k in of_key], np.int64)
        sets = [sorted(set(a.split())) for a in self.plain]
        self.count = np.array([len(ws) for ws in sets], np.int64)
        self.length = np.array([sum(map(len, ws)) + len(ws) - 1 if ws else 0 for ws in sets], np.int64)
        self.word = np.full((len(names), min(self.MOST, max(self.count, default=0))), -1, np.int64)
        for i, ws in enumerate(sets):
            for k, w in enumerate(ws[: self.MOST]):
                self.word[i, k] = words.setdefault(w, len(words))
        self.size = np.array([*map(len, words), 0], np.int64)  # the last one stands for no word
        self.sets, self.known = sets, {}

    @functools.cached_property
    def characters(self) -> np.ndarray:
        """How often each of 32 kinds of characters stands in a name."""
        points = np.frombuffer("".join(map(" ".join, self.sets)).encode("utf-32-le"), np.uint32)
        at = np.repeat(np.arange(len(self.sets)), self.length) * 32 + points % 32
        return np.bincount(at, minlength=32 * len(self.sets)).reshape(-1, 32).astype(np.int32)

    def compared(self, a: int, b: int) -> float:
        """The ratio itself, once for a pair."""
        if (a, b) not in self.known:
            self.known[a, b] = token_set(self.plain[a], self.plain[b])
        return self.known[a, b]

    def candidates(self, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of names (by number), those with equal keys or a ratio of at least ``least``: their places, whether keys are equal, ratios."""
        same = (self.key[a] == self.key[b]) & (self.key[a] >= 0)
        x, y, n, m = self.count[a], self.count[b], self.length[a], self.length[b]
        shared, chars = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for i in range(self.word.shape[1]):
            word = self.word[a, i]
            hit = np.zeros(len(a), bool)
            for j in range(self.word.shape[1]):
                hit |= word == self.word[b, j]
            hit &= word >= 0
            shared += hit
            chars += self.size[word] * hit
        chars += np.maximum(shared - 1, 0)
        ratio = np.where(shared > 0, 200.0 * chars / np.maximum(chars + np.minimum(n, m), 1), 0.0)
        whole = (shared > 0) & ((shared == x) | (shared == y))
        ratio[whole] = 100.0
        ratio[(x == 0) | (y == 0)] = -1.0
        unsure = (x > self.MOST) | (y > self.MOST)  # shared words are not all known
        most = 200.0 * np.minimum(n, m) / np.maximum(n + m, 1)
        open_ = (ratio >= 0) & (unsure | (~whole & (most > ratio) & (same | (most >= least))))
        at = np.nonzero(open_ & ~unsure)[0]
        if len(at):
            room = 200.0 * np.minimum(self.characters[a[at]], self.characters[b[at]]).sum(1) / (n[at] + m[at])
            open_[at[(room <= ratio[at]) | ~(same[at] | (room >= least))]] = False
        at = np.nonzero(open_)[0]
        ratio[at] = [self.compared(*p) for p in zip(a[at].tolist(), b[at].tolist(), strict=True)]
        at = np.nonzero(same | (ratio >= least))[0]
        return at, same[at], ratio[at]


#: Pairs of names looked at together.
PAIRS = 1 << 18


def flat(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct stripped elements of all lists, each element's number among them, and where each list begins (and the last one ends); a null list is empty, a null element an empty name."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = pc.fill_null(lists.flatten().cast(pa.string()), "").dictionary_encode()
    names = [x.strip() for x in coded.dictionary.to_pylist()]
    return names, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def listed(values: pa.Array, row: np.ndarray, rows: int) -> pa.ListArray:
    """The values as lists by the number of their row, which ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def match_lists(gold: pa.Array, parsed: pa.Array, soft: float = SOFT) -> pa.StructArray:
    """Rows' names of gold and parsed authors assigned to each other: equal keys (last name, first initial) first, then by token-set ratio, later names before earlier ones.

    All rows' pairs are looked at side by side; a row's assignment follows the order of its candidates.
    """
    rows = len(gold)
    (left, g, gs), (right, p, ps) = flat(gold), flat(parsed)
    numbers = {n: i for i, n in enumerate(dict.fromkeys([*left, *right]))}
    names, g, p = Names(list(numbers)), np.array([numbers[n] for n in left], np.int64)[g], np.array([numbers[n] for n in right], np.int64)[p]
    said = np.array([bool(n) for n in numbers], bool)
    width = np.diff(ps)
    ends = np.concatenate([[0], np.cumsum(np.diff(gs) * width)])
    parts = []
    for start in range(0, int(ends[-1]), PAIRS):
        k = np.arange(start, min(start + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, k, "right") - 1
        within = k - ends[row]
        i, j = gs[row] + within // width[row], ps[row] + within % width[row]
        at, same, ratio = names.candidates(g[i], p[j], soft)
        parts.append((row[at], i[at], j[at], same, ratio))
    row, i, j, same, ratio = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, float))
    order = np.lexsort((-j, -i, -ratio, ~same, row))
    free_i, free_j, taken = bytearray(b"\1" * len(g)), bytearray(b"\1" * len(p)), []
    for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        if free_i[x] and free_j[y]:
            free_i[x] = free_j[y] = 0
            taken.append(k)
    taken = np.array(taken, np.int64)
    row, i, j, same, ratio = row[taken], i[taken], j[taken], same[taken], ratio[taken]
    matched = pa.StructArray.from_arrays([pa.array(i - gs[row], pa.int32()), pa.array(j - ps[row], pa.int32()), pa.array(same), pa.array(ratio)], names=["gold_index", "parsed_index", "key_match", "name_ratio"])
    out, sizes = [listed(matched, row, rows)], []
    for codes, starts, free in ((g, gs, free_i), (p, ps, free_j)):
        owner = np.repeat(np.arange(rows), np.diff(starts))
        sizes.append(np.bincount(owner, said[codes], rows))
        rest = np.nonzero(np.frombuffer(free, np.uint8).astype(bool) & said[codes])[0]
        out.append(listed(pa.array(rest - starts[owner[rest]], pa.int32()), owner[rest], rows))
    for tp in (np.bincount(row, same, rows), np.bincount(row, minlength=rows).astype(float)):
        right_of, found_of = tp / np.maximum(sizes[1], 1), tp / np.maximum(sizes[0], 1)
        both = right_of + found_of
        out += [pa.array(right_of), pa.array(found_of), pa.array(np.where(both > 0, 2 * right_of * found_of / np.where(both > 0, both, 1), 0.0))]
    return pa.StructArray.from_arrays(out, names=["matched", "gold_unmatched", "parsed_unmatched", "precision", "recall", "f1", "precision_soft", "recall_soft", "f1_soft"])


def match_names(gold: list[str], parsed: list[str], soft: float = SOFT) -> dict:
    """``match_lists`` of one row."""
    return match_lists(*[pa.array([side], pa.list_(pa.string())) for side in (gold, parsed)], soft)[0].as_py()


def score_authors(gold: Column, parsed: Column) -> Column:
    """Of two arrays of names. Two empty lists score 0."""
    return F.arrow_udf(author_batches, AUTHORS_SCORE)(gold, parsed)


def author_batches(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for gold, parsed in pairs:
        yield match_lists(gold, parsed)


def clean_org(text: str) -> str:
    import re

    return alpha(re.sub(r"https?://\S+", " ", re.sub(r"\S+@\S+", " ", text)))


def match_affiliations(gold: list[str], parsed: list[str]) -> dict:
    """At three strictnesses: equal, cleaned at 95, without filler words at 85. Two empty lists score 1, one empty 0."""
    gold, parsed = [g.strip() for g in gold if g and g.strip()], [p.strip() for p in parsed if p and p.strip()]
    bare = lambda t: " ".join(w for w in t.split() if w not in FILLER_WORDS)
    out = {"gold_total": len(gold), "parsed_total": len(parsed), "matched": 0}
    levels = (("strict_f1", lambda t: t, lambda a, b: 100.0 * (a == b), 100.0), ("soft_f1", clean_org, token_set, 95.0), ("fuzzy_f1", lambda t: bare(clean_org(t)), token_set, SOFT))
    for name, form, ratio, least in levels:
        g, p = [form(x) for x in gold], [form(x) for x in parsed]
        if not g or not p:
            out[name] = float(not g and not p)
            continue
        n = len(assigned(ratios(g, p, ratio), least))
        out[name] = rates(n, len(g), len(p))[2]
        out["matched"] = n
    return out


def score_affiliations(gold: Column, parsed: Column) -> Column:
    """Of two arrays of affiliations, at three strictnesses."""
    return F.pandas_udf(affiliation_batches, AFFILIATIONS_SCORE)(gold, parsed)


def affiliation_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    columns = ["strict_f1", "soft_f1", "fuzzy_f1", "matched", "gold_total", "parsed_total"]
    for gold, parsed in pairs:
        yield pd.DataFrame([match_affiliations([] if g is None else list(g), [] if p is None else list(p)) for g, p in zip(gold, parsed, strict=True)], columns=columns)


def score_abstract(gold: Column, parsed: Column) -> Column:
    """strict_match, soft_ratio (folded), fuzzy_ratio (as they are), length_ratio, present; both empty count as equal."""
    g, p = F.trim(X.text_of(gold)), F.trim(X.text_of(parsed))
    none, one = (g == "") & (p == ""), (g == "") | (p == "")
    ratio = lambda value: F.when(none, 1.0).when(one, 0.0).otherwise(value)
    return F.struct(
        F.when(none, True).when(one, False).otherwise(g == p).alias("strict_match"), ratio(indel_ratio(X.normalize_text(g), X.normalize_text(p)) / 100).alias("soft_ratio"),
        ratio(indel_ratio(g, p) / 100).alias("fuzzy_ratio"), ratio(F.length(p) / F.length(g)).alias("length_ratio"), (p != "").alias("present"),
    )


def score_pdf(gold: Column, parsed: Column) -> Column:
    """strict_match of canonical URLs, present, expected_present, divergent."""
    g, p = U.canonical_url(gold), U.canonical_url(parsed)
    return F.struct((g == p).alias("strict_match"), (p != "").alias("present"), (g != "").alias("expected_present"), ((g != "") & (p != "") & (g != p)).alias("divergent"))


def score_rows(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Gold rows (doi, authors, abstract, pdf_url, score_authors, failure_modes) joined with runs (doi, parsed, error, duration_ms, publisher_domain) and scored.

    A gold row without a run is scored against nothing. Affiliation scores are means over the matched pairs of authors.
    """
    rows = gold.join(runs, "doi", "left")
    names = lambda c: F.coalesce(F.transform(c, lambda a: a["name"]), F.array().cast("array<string>"))
    pdf = F.try_element_at(F.filter("parsed.urls", lambda u: u["content_type"] == "pdf"), F.lit(1))["url"]
    rows = rows.withColumns({
        "authors_score": F.when(F.col("score_authors"), score_authors(names(F.col("authors")), names(F.col("parsed.authors")))),
        "abstract_score": score_abstract(F.col("abstract"), F.col("parsed.abstract")), "pdf_score": score_pdf(F.col("pdf_url"), pdf),
    })
    parsed_affs = F.transform(F.try_element_at(F.col("parsed.authors"), F.col("m.parsed_index") + 1)["affiliations"], lambda x: x["name"])
    pairs = rows.where(F.size("authors_score.matched") > 0).select("doi", F.explode("authors_score.matched").alias("m"), "authors", "parsed")
    scored = pairs.select("doi", score_affiliations(F.try_element_at(F.col("authors"), F.col("m.gold_index") + 1)["affiliations"], parsed_affs).alias("s"))
    means = scored.groupBy("doi").agg(F.struct(*[F.avg(f"s.{c}").alias(c) for c in ("strict_f1", "soft_f1", "fuzzy_f1")], *[F.sum(f"s.{c}").alias(c) for c in ("matched", "gold_total", "parsed_total")]).alias("affiliations_score"))
    return rows.join(means, "doi", "left").select("doi", "publisher_domain", "duration_ms", "error", "failure_modes", "authors_score", "affiliations_score", "abstract_score", "pdf_score")


def mean_of(c: Column) -> Column:
    """The mean of what is not null; 0 where nothing is."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def metrics() -> list[Column]:
    """The aggregates of a scorecard over scored rows."""
    share = lambda c: mean_of(F.col(c).cast("double"))
    return [
        F.count("*").alias("rows"), F.count("authors_score").alias("authors_scored_rows"), mean_of(F.col("authors_score.f1")).alias("authors_f1_strict"), mean_of(F.col("authors_score.f1_soft")).alias("authors_f1_soft"),
        mean_of(F.col("affiliations_score.strict_f1")).alias("affiliations_f1_strict"), mean_of(F.col("affiliations_score.soft_f1")).alias("affiliations_f1_soft"), mean_of(F.col("affiliations_score.fuzzy_f1")).alias("affiliations_f1_fuzzy"),
        mean_of(F.col("abstract_score.soft_ratio")).alias("abstract_ratio_soft"), mean_of(F.col("abstract_score.fuzzy_ratio")).alias("abstract_ratio_fuzzy"), share("abstract_score.strict_match").alias("abstract_strict_match_rate"),
        share("abstract_score.present").alias("abstract_present_rate"), share("pdf_score.strict_match").alias("pdf_url_accuracy"), share("pdf_score.divergent").alias("pdf_url_divergence_rate"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"), mean_of(F.col("duration_ms")).alias("duration_ms_mean"),
    ]


def overall(scored: DataFrame) -> DataFrame:
    return scored.agg(*metrics())


def per_publisher(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.coalesce(F.nullif("publisher_domain", F.lit("")), F.lit("unknown")).alias("publisher")).agg(*metrics()).orderBy(F.desc("rows"), "publisher")


def per_failure_mode(scored: DataFrame) -> DataFrame:
    """Rows count in each of their modes; those without one in ``clean``."""
    modes = F.when(F.size("failure_modes") > 0, F.col("failure_modes")).otherwise(F.array(F.lit("clean")))
    return scored.withColumn("mode", F.explode(modes)).groupBy("mode").agg(*metrics()).orderBy(F.desc("rows"), "mode")
