"""Set similarities as column expressions, and string ratios as Arrow functions.

An undefined similarity is null, never 0: two records that say nothing are not alike.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _both(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(_both(a, b), shared(a, b) / F.size(F.array_union(a, b)))


def jaccard_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats."""
    return F.when(_both(a, b), shared(a, b) / (F.size(a) + F.size(b) - shared(a, b)))


def jaccard_or_zero(a: Column, b: Column) -> Column:
    """As descriptive statistics take it: 0 where a set is empty."""
    return F.coalesce(jaccard(a, b), F.lit(0.0))


def same_start(a: Column, b: Column, n: int = 4) -> Column:
    """1 where two names begin with the same ``n`` characters, 0 elsewhere; an empty name has no beginning."""
    return F.coalesce((F.substring(a, 1, n) == F.substring(b, 1, n)) & (a != ""), F.lit(False)).cast("int")


def dice(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    return F.when(_both(a, b), 2 * shared(a, b) / (F.size(a) + F.size(b)))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` (without repeats) that is in ``b``."""
    return F.when(_both(a, b), shared(a, b) / F.size(a))


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 if either is empty."""
    return F.coalesce(F.when(_both(a, b), shared(a, b) / F.least(F.size(a), F.size(b))), F.lit(0.0))


def length_ratio(x: Column, y: Column) -> Column:
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y))


def f05(precision: Column, recall: Column) -> Column:
    bottom = 0.25 * precision + recall
    return F.when(bottom > 0, 1.25 * precision * recall / bottom).otherwise(0.0)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one word of bits per character of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & where.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insert-delete similarity, 0 to 1; two empty strings are alike."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of comparing the shared tokens with each side's tokens, and the sides with each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio(with_left, with_right)]
    if both:
        found += [ratio(both, with_left), ratio(both, with_right)]
    return max(found)


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _paired(score, cutoff: float):
    @F.arrow_udf(DoubleType())
    def pairwise(a: pa.Array, b: pa.Array) -> pa.Array:
        memo: dict[tuple, float] = {}
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            v = memo.get((x, y))
            if v is None:
                v = score(x or "", y or "")
                memo[x, y] = v = v if v >= cutoff else 0.0
            out.append(v)
        return pa.array(out, pa.float64())

    return pairwise


#: Scores below this count as 0.
CUTOFF = 0.30
fuzzy_ratio = _paired(ratio, CUTOFF)
fuzzy_token_sort = _paired(token_sort_ratio, CUTOFF)
fuzzy_token_set = _paired(token_set_ratio, CUTOFF)
fuzzy_sequence = _paired(sequence_ratio, 0.0)
