"""Fuzzy ratios in batches. Levenshtein is built in; indel and token-set ratios need a helper for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one big-integer step for each character."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """100 x 2 LCS / (lengths); 100 for two empty texts."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def edits(a: str, b: str) -> int:
    """Levenshtein distance, by bit-parallel columns: a few big-integer steps for each character of the shorter text.

    The bits of ``up`` and ``down`` tell where the distances of a column rise or fall by one from a row to the next.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for ch in b:
        hit = masks.get(ch, 0)
        level = ((((hit & up) + up) ^ up) | hit | down) & full
        right_up, right_down = (down | (full & ~(level | up))), up & level
        distance += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        fixed = hit | down
        up, down = (right_down | (full & ~(fixed | right_up))), right_up & fixed
    return distance


def edited(a: str, b: str) -> float:
    """1 - distance / longer length; 1 for two empty texts."""
    return 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def token_set(a: str, b: str) -> float:
    """Indel ratio of the shared words against each side's words, whichever agrees best; 0 if a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel(with_left, with_right)
    return max(best, indel(both, with_left), indel(both, with_right)) if both else best


def indel_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([indel(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def edit_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([edited(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def token_set_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Indel ratio of two texts, 0 to 100; null counts as empty."""
    return F.pandas_udf(indel_batches, "double")(a, b)


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """``levenshtein_ratio`` for long texts; null counts as empty."""
    return F.pandas_udf(edit_batches, "double")(a, b)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """Token-set ratio of two texts, 0 to 100; null counts as empty."""
    return F.pandas_udf(token_set_batches, "double")(a, b)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)
