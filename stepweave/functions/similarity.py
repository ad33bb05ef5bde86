"""Similarity scores that have no built-in twin, as pandas UDFs, and vector products as Columns."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from stepweave.functions.text import col


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length): twice the longest common subsequence over both lengths.

    Bit-parallel: a row of the table is one integer."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        m = row & masks.get(ch, 0)
        row = ((row + m) | (row - m)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0..100; null where a text is null."""
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def line_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matched share of lines, 0..1."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.splitlines(), y.splitlines()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def code_lines(text: str) -> list[str]:
    """Source lines to compare: no shebang or coding mark among the first three, tabs as four columns, no trailing blanks, no empty lines."""
    kept = []
    for i, line in enumerate(text.splitlines()):
        if i < 3 and (line.startswith("#!") or (line.lstrip().startswith("#") and "coding" in line)):
            continue
        line = line.expandtabs(4).rstrip()
        if line:
            kept.append(line)
    return kept


@F.pandas_udf(BooleanType())
def same_code(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and code_lines(x) == code_lines(y) for x, y in zip(a, b, strict=True)])


def inner_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return inner_product(a, b) / (norm(a) * norm(b))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 255.0) -> float:
    """Structural similarity of two gray images of one size, over all windows inside them; 0 if too small or of different size."""
    if a.shape != b.shape or min(a.shape) < window:
        return 0.0
    from numpy.lib.stride_tricks import sliding_window_view

    x, y = (sliding_window_view(v.astype(float), (window, window)) for v in (a, b))
    n = window * window
    mx, my = x.mean(axis=(2, 3)), y.mean(axis=(2, 3))
    vx, vy = x.var(axis=(2, 3)) * n / (n - 1), y.var(axis=(2, 3)) * n / (n - 1)
    cov = ((x * y).mean(axis=(2, 3)) - mx * my) * n / (n - 1)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def warped_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping of two series."""
    if not len(a) or not len(b):
        return float("inf")
    row = np.full(len(b) + 1, np.inf)
    row[0] = 0
    for x in a:
        cost, after = np.abs(b - x), np.full(len(b) + 1, np.inf)
        for j in range(len(b)):
            after[j + 1] = cost[j] + min(row[j], row[j + 1], after[j])
        row = after
    return float(row[-1])


@F.pandas_udf(DoubleType())
def series_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """exp(-distance / length); both missing 1, one missing 0."""

    def one(x, y):
        if x is None or y is None:
            return 1.0 if x is None and y is None else 0.0
        return float(np.exp(-warped_distance(np.asarray(x, float), np.asarray(y, float)) / max(1, len(x), len(y))))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def hash_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two image hashes."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))
