"""Fuzzy string similarity: 100 times the normalised InDel similarity, plain and over sorted tokens.

No built-in has it, so the exact value is a vectorised pandas UDF; a JVM-side bound, from Spark's own levenshtein (which is
never more than the InDel distance) and the lengths, drops pairs that can't reach the threshold before they reach Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Names that are compared one by one: tables of letters cost more than they save.
FEW = 16


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the bits of one integer as a row of the table."""
    least, begin, end = min(len(a), len(b)), 0, 0
    while begin < least and a[begin] == b[begin]:
        begin += 1
    while end < least - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    if begin + end == least:
        return least
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return begin + end + len(a) - row.bit_count()


def similarity(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    if a == b:
        return 100.0
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def letters(names: list[str]) -> np.ndarray:
    """How often each name has each of 64 kinds of letters."""
    out = np.zeros((len(names), 64), dtype=np.int16)
    sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    np.add.at(out, (np.repeat(np.arange(len(names)), sizes), points & 63), 1)
    return out


def reaching(left: list[str], right: list[str], least: float) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of all pairs at `least` or more.

    What two names have in common as bags of letters bounds their common subsequence from above, so nothing is missed; only
    pairs that this bound leaves are worked out.
    """
    out, held = [], letters(right)
    size = held.sum(axis=1)
    for i, (name, own) in enumerate(zip(left, letters(left), strict=True)):
        bound = 200.0 * np.minimum(own, held).sum(axis=1) >= least * (len(name) + size) - 1e-9
        for j in np.flatnonzero(bound):
            if (found := similarity(name, right[j])) >= least:
                out.append((i, int(j), found))
    return out


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the InDel similarity of two texts is sure to be below `least`."""
    total = F.length(a) + F.length(b)
    most = F.floor((1 - least / 100.0) * total).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)


def possible(a: Column, b: Column, least: float = 80.0) -> Column:
    """Whether two texts may be alike, in the JVM: filter by this first, as Spark evaluates a Python function of a filter or
    of a branch for every row that reaches it."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    return (x == y) | may_reach(x, y, least)


def alike(a: Column, b: Column, least: float = 80.0) -> Column:
    """Token-sort similarity of at least `least`."""
    return token_sort_ratio(a, b) >= least


def token_sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def same_names(names: list[str], least: float, inside: bool) -> np.ndarray:
    """Which names are alike, as a table: token-sort similarity of at least `least`, and, if asked, one a substantial part of the other."""
    number: dict[str, int] = {}
    at = [number.setdefault(token_sorted(x), len(number)) for x in names]
    forms = list(number)  # wordings in another order are compared once
    table = np.eye(len(forms), dtype=bool)
    if len(forms) <= FEW:
        for i, a in enumerate(forms):
            for j in range(i):
                b = forms[j]
                if 200.0 * min(len(a), len(b)) >= least * (len(a) + len(b)) and similarity(a, b) >= least:
                    table[i, j] = table[j, i] = True
    else:
        for i, j, _ in reaching(forms, forms, least):
            table[i, j] = True
    out = table[np.ix_(at, at)]
    if inside:
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if len(a) >= 6 and len(a) >= 0.6 * len(b) and a in b:
                    out[i, j] = out[j, i] = True
    return out


def _inside(a: Column, b: Column) -> Column:
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (shorter >= 6) & (F.contains(a, b) | F.contains(b, a)) & (shorter >= 0.6 * longer)


def possibly_same_entity(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & ((a == b) | _inside(a, b) | possible(a, b))


def same_entity(a: Column, b: Column) -> Column:
    """Two normalised names: equal, one a substantial part of the other, or alike."""
    return (a != "") & (b != "") & ((a == b) | _inside(a, b) | alike(a, b))
