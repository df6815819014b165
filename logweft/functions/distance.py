"""Edit distances between line structures.

`weighted` takes many pairs at once: rows of one dynamic programme over all of
them, so Python runs once a cell and numpy once a pair.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CODES = {"A": 1, "D": 2, "@": 3, "S": 4}


def codes(sig: str) -> tuple[np.ndarray, np.ndarray]:
    """(category, length) arrays of a signature string such as A5S1; places and others are category 0."""
    import re

    pairs = re.findall(r"([AD@S$N])(\d+)", sig)
    return np.array([_CODES.get(c, 0) for c, _ in pairs], np.int64), np.array([int(n) for _, n in pairs], np.int64)


def dissimilarity(c1, n1, c2, n2):
    """0 for like tokens, 1 - 2 min / sum for like categories, else 1; a place or other token is 1 from everything."""
    with np.errstate(divide="ignore", invalid="ignore"):
        length = np.where(n1 == n2, 0.0, 1 - 2 * np.minimum(n1, n2) / (n1 + n2))
    return np.where((c1 == 0) | (c2 == 0) | (c1 != c2), 1.0, length)


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(rows), max((len(r) for r in rows), default=0)), -1, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r[::-1]  # last token first: the programme runs over suffixes
    return out


def weighted(left: list[str], right: list[str]) -> np.ndarray:
    """Distance of each pair of signatures.

    Over suffixes: where two tokens are alike the match is taken without looking
    at alternatives; else the least of deletion, insertion and substitution.
    """
    if not left:
        return np.zeros(0)
    parsed = {s: codes(s) for s in {*left, *right}}
    n, m = np.array([len(parsed[s][0]) for s in left]), np.array([len(parsed[s][0]) for s in right])
    out = np.empty(len(left))
    order = np.argsort(n * 4096 + m, kind="stable")
    for at in range(0, len(order), 8192):
        mine = order[at : at + 8192]
        lc, ln = (_padded([parsed[left[k]][x] for k in mine]) for x in (0, 1))
        rc, rn = (_padded([parsed[right[k]][x] for k in mine]) for x in (0, 1))
        size = len(mine)
        width = rc.shape[1]
        row = np.tile(np.arange(width + 1, dtype=float), (size, 1))
        done = row[np.arange(size), m[mine]]
        for i in range(lc.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            s = dissimilarity(lc[:, i : i + 1], ln[:, i : i + 1], rc, rn)
            for j in range(width):
                other = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + s[:, j])
                new[:, j + 1] = np.where(s[:, j] == 0, row[:, j], other)
            row = new
            ends = n[mine] == i + 1
            done[ends] = row[ends, m[mine][ends]]
        out[mine] = done
    return out


def _weighted(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(weighted(left.tolist(), right.tolist()))


def structural_distance(left, right) -> Column:
    """Distance of two signature columns."""
    return F.pandas_udf(_weighted, "double")(left, right)


def common_length(left: list, right: list) -> int:
    """Length of a longest common subsequence, like heads taken at once."""
    row = [0] * (len(right) + 1)
    for x in reversed(left):
        new = [0] * (len(right) + 1)
        for j in range(len(right) - 1, -1, -1):
            new[j] = row[j + 1] + 1 if x == right[j] else max(row[j], new[j + 1])
        row = new
    return row[0]


def _lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([common_length(list(a), list(b)) for a, b in zip(left, right)], dtype="int32")


def token_lcs(left, right) -> Column:
    """Longest common subsequence of two token columns."""
    return F.pandas_udf(_lcs, "int")(left, right)
