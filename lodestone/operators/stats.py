"""Consistency statistics: shares, entropy, severity, chi-squared, trends and percentiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import chi_squared_p, floor_percentile, no_minus_zero


def shares(df: DataFrame, by: Sequence[str], outcome: str, values: Mapping[str, str]) -> DataFrame:
    """Rows and percentage (1 decimal) of each listed outcome; ``values`` maps outcome to column name."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("total"), *[F.round(100.0 * F.count_if(F.col(outcome) == v) / n, 1).alias(name) for v, name in values.items()])


#: Severity of penalty codes; seconds come from the formula in ``severity``.
LADDER = {"NFA": 0.0, "WARN": 1.0, "REP": 2.0, "FINE": 3.0, "DT": 6.0, "SG": 7.0, "GRID": 8.0, "PIT": 8.0, "DSQ": 10.0}


def severity(code: Column, ladder: Mapping[str, float] = LADDER) -> Column:
    """Ladder value; "Ns" grows with the logarithm of the seconds below a drive-through; unknown is 0."""
    seconds = F.try_to_number(F.nullif(F.regexp_extract(code, "^([0-9]{1,2})s$", 1), F.lit("")), F.lit("99")).cast("double")
    timed = F.when(seconds.isNotNull(), F.round(F.least(4.0 + F.log2(seconds / 5.0 + 1e-9), F.lit(5.9)), 2))
    table = F.create_map(*[F.lit(x) for kv in ladder.items() for x in kv])
    return F.coalesce(F.element_at(table, code), timed, F.lit(0.0))


def outcome_counts(df: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    return df.groupBy(*by, outcome).agg(F.count(F.lit(1)).alias("n"))


def variance(counts: DataFrame, by: Sequence[str], outcome: str, weight: Column) -> DataFrame:
    """From (by, outcome, n): total, entropy, inconsistency, modal outcome and mean severity.

    Entropy is in bits to 3 decimals; inconsistency divides the rounded entropy by its maximum and
    rounds again; equal counts make the least outcome modal.
    """
    total = F.sum("n").over(Window.partitionBy(*by))
    c = counts.withColumn("_p", F.col("n") / total).withColumn("_w", weight)
    out = c.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("outcomes"),
        F.round(-F.sum(F.col("_p") * F.log2("_p")), 3).alias("_entropy"),
        F.min_by(outcome, F.struct(-F.col("n"), F.col(outcome))).alias("modal"),
        F.round(F.sum(F.col("_w") * F.col("n")) / F.sum("n"), 2).alias("mean_severity"),
    )
    entropy = no_minus_zero(F.col("_entropy"))
    return out.withColumn("entropy", entropy).withColumn(
        "inconsistency", F.when(F.col("outcomes") > 1, F.round(entropy / F.log2("outcomes"), 3)).otherwise(F.lit(0.0))
    ).drop("_entropy")


def chi_squared(counts: DataFrame, group: str, outcome: str, least: int = 5, observed_only: bool = True) -> DataFrame:
    """(group, n, chi2, df, p_value, significant) of every group against the shares of all rows.

    ``observed_only`` sums over outcomes the group has; else over all outcomes (Pearson).
    """
    everything = counts.groupBy(outcome).agg(F.sum("n").alias("all_n"))
    totals = everything.agg(F.sum("all_n").alias("grand"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("df"))
    shares_ = everything.crossJoin(F.broadcast(totals)).select(outcome, (F.col("all_n") / F.col("grand")).alias("share"), "df")
    groups = counts.groupBy(group).agg(F.sum("n").alias("group_n"))
    seen = counts.join(groups, group).join(shares_, outcome)
    expected = F.col("group_n") * F.col("share")
    terms = seen.groupBy(group, "group_n", "df").agg(
        F.sum(F.pow(F.col("n") - expected, F.lit(2.0)) / expected).alias("_sum"), F.sum(expected).alias("_expected")
    )
    # outcomes a group never had add their expected number each
    total = F.col("_sum") if observed_only else F.col("_sum") + F.col("group_n") - F.col("_expected")
    chi2 = F.when(F.col("group_n") < least, F.lit(0.0)).otherwise(F.round(total, 3))
    out = terms.select(group, F.col("group_n").alias("n"), chi2.alias("chi2"), F.col("df").cast("bigint").alias("df"))
    return out.withColumn("p_value", chi_squared_p(F.col("chi2"), F.col("df"))).withColumn("significant", F.col("p_value") < 0.05)


def trend(yearly: DataFrame, by: str, season: str, value: str, flat: float = 0.05) -> DataFrame:
    """Least-squares slope (4 decimals) of a value over seasons and what it means; 0 under two seasons."""
    fitted = yearly.groupBy(by).agg(F.count(F.lit(1)).alias("seasons"), F.regr_slope(value, season).alias("_s"))
    slope = F.when(F.col("seasons") < 2, F.lit(0.0)).otherwise(no_minus_zero(F.round(F.coalesce("_s", F.lit(0.0)), 4)))
    label = F.when(slope > flat, "stricter").when(slope < -flat, "lenient").otherwise("consistent")
    return fitted.select(by, "seasons", slope.alias("slope"), label.alias("trend"))


def rolling_percentiles(df: DataFrame, key: str, order: Sequence[Column], value: str, keep: int = 1000, least: int = 10) -> DataFrame:
    """p50, p95, p99, least and greatest of the newest ``keep`` values of a key, from ``least`` values on."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    newest = df.withColumn("_rank", rank).where(F.col("_rank") <= keep)
    values = newest.groupBy(key).agg(F.collect_list(value).alias("_v")).where(F.size("_v") >= least)
    return values.select(
        key, F.size("_v").cast("bigint").alias("n"), *[floor_percentile(F.col("_v"), p).alias(f"p{p}") for p in (50, 95, 99)],
        F.array_min("_v").alias("least"), F.array_max("_v").alias("greatest"),
    )


def over_quota(df: DataFrame, user: str, ts: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Calls beyond the limit of a user's UTC day, with their number in it."""
    day = F.to_date(ts)
    nth = F.row_number().over(Window.partitionBy(user, day).orderBy(*order))
    return df.withColumn("day", day).withColumn("nth", nth.cast("bigint")).where(F.col("nth") > limit)


def risk_band(points: Column) -> Column:
    return F.when(points >= 10, "high").when(points >= 7, "medium").when(points >= 4, "low").otherwise("none")
