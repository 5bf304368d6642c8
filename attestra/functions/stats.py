"""Distribution functions and exact tests as Arrow functions over already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_upper(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    """The t below which the share ``p`` lies, by bisection."""
    low, high = -1.0, 1.0
    while t_upper(low, df) < 1 - p:
        low *= 2
    while t_upper(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_upper(middle, df) > 1 - p else (low, middle)
    return (low + high) / 2


def _over(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*columns)], dtype="float64")


def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(lambda x, n: 2 * t_upper(abs(x), n), t, df)


def _above(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(t_upper, t, df)


def _critical(share: pd.Series, df: pd.Series) -> pd.Series:
    known: dict = {}
    return _over(lambda p, n: known.setdefault((p, n), t_quantile(p, n)) if (p, n) not in known else known[p, n], share, df)


def t_two_sided(t: Column | str, df: Column | str) -> Column:
    """Two-sided p of Student's t."""
    return F.pandas_udf(_two_sided, "double")(t, df)


def t_above(t: Column | str, df: Column | str) -> Column:
    """P(T > t) of Student's t."""
    return F.pandas_udf(_above, "double")(t, df)


def t_critical(share: Column | str, df: Column | str) -> Column:
    """The t below which the share lies."""
    return F.pandas_udf(_critical, "double")(share, df)


def signed_rank_exact(ranks: list[float], signs: list[int]) -> float:
    """Two-sided exact p of the signed-rank statistic over all signs of the given ranks, ties included.

    Counts the sign patterns for each sum of doubled ranks, which are whole numbers.
    """
    doubled = [round(2 * r) for r in ranks]
    total = sum(doubled)
    plus = sum(d for d, s in zip(doubled, signs) if s > 0)
    ways = np.zeros(total + 1)
    ways[0] = 1.0
    for d in doubled:
        shifted = np.zeros_like(ways)
        shifted[d:] = ways[: total + 1 - d]
        ways = (ways + shifted) / 2
    return min(1.0, 2 * min(ways[: plus + 1].sum(), ways[plus:].sum()))


#: The most pairs of a group whose signed ranks are tested exactly, with and without ties.
EXACT_TIED, EXACT_UNTIED = 25, 50


def signed_rank_test(d: np.ndarray) -> tuple[float, float]:
    """Sum of the positive midranks of |d| and its two-sided p: exact up to the bounds, else normal with the tie correction. No d is 0."""
    _, at, times = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(times) - (times - 1) / 2)[at]
    n, ties, plus = float(len(d)), float((times**3 - times).sum()), float(ranks[d > 0].sum())
    if n <= (EXACT_TIED if ties else EXACT_UNTIED):
        return plus, signed_rank_exact(ranks.tolist(), np.sign(d).tolist())
    return plus, math.erfc(abs((plus - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)) / math.sqrt(2))


def _signed_ranks(d: pd.Series) -> pd.DataFrame:
    found = [signed_rank_test(np.asarray(x, dtype=float)) for x in d]
    return pd.DataFrame(found, columns=["w_plus", "w_p"]).astype("float64")


def signed_rank_tests(d: Column | str) -> Column:
    """``w_plus`` and ``w_p`` of arrays of differences."""
    return F.pandas_udf(_signed_ranks, "w_plus double, w_p double")(d)


def _normal(z: pd.Series) -> pd.Series:
    return _over(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


def normal_two_sided(z: Column | str) -> Column:
    return F.pandas_udf(_normal, "double")(z)


def half_even(value: Column | str, digits: Column | str) -> Column:
    """Rounding of the exact binary value, half to even, as general-purpose languages round."""
    return F.pandas_udf(_half_even, "double")(value, digits)


def _half_even(value: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else round(float(v), int(d)) for v, d in zip(value, digits)], dtype="float64")


def format_numbers(form: Column | str, value: Column | str) -> Column:
    """Numbers as texts by forms such as ``.4f``, half to even on the exact binary value; null for null and NaN."""
    return F.pandas_udf(_formatted, "string")(form, value)


def _formatted(form: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else format(float(v), f) for f, v in zip(form, value)], dtype=object)
