"""Numeric column functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rational approximation 7.1.26 of the error function (Abramowitz and Stegun).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function to about 1.5e-7."""
    t = 1.0 / (1.0 + F.lit(ERF_P) * F.abs(x))
    a1, a2, a3, a4, a5 = ERF_A
    poly = ((((F.lit(a5) * t + a4) * t + a3) * t + a2) * t + a1) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def chi_squared_p(chi2: Column, df: Column) -> Column:
    """Upper tail of chi-squared by the cube-root normal approximation, 4 decimals; 1 where df or chi2 is not positive."""
    d = df.cast("double")
    z = (F.pow(chi2 / d, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * d))) / F.sqrt(2.0 / (9.0 * d))
    p = F.round(0.5 * (1.0 - erf(z / F.sqrt(F.lit(2.0)))), 4)
    return F.when((chi2 <= 0) | (d <= 0), F.lit(1.0)).otherwise(p)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def no_minus_zero(x: Column) -> Column:
    """0.0 for -0.0, so that equal values hash alike."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def floor_percentile(values: Column, p: int) -> Column:
    """Nearest rank with the index rounded down: element max(0, floor(n * p / 100) - 1) of the sorted array."""
    index = F.greatest(F.floor(F.size(values) * p / 100) - 1, F.lit(0)).cast("int")
    return F.get(F.array_sort(values), index)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by the greatest so that none overflows."""
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def expected_value(probabilities: Column, values: Column) -> Column:
    return F.aggregate(F.zip_with(probabilities, values, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, empty or of length zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def phase(lap: Column, last: Column) -> Column:
    """Third of a distance: early, mid or late; unknown if either is missing."""
    share = lap / F.when(last > 0, last)
    return F.when(share.isNull(), "unknown").when(share <= 1 / 3, "early").when(share <= 2 / 3, "mid").otherwise("late")
