"""Filters, paging, deduplication, sinks and lookups over tables of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **equal: Any) -> DataFrame:
    """Equality filters for those arguments that are not None; lists mean membership, text ignores case."""
    for name, value in equal.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = df.where(F.col(name).isin(list(value)))
        elif isinstance(value, str):
            df = df.where(F.lower(name) == value.lower())
        else:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order (add a unique column to ``order``)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def not_false(x: Column) -> Column:
    """True for true and unknown."""
    return F.coalesce(x, F.lit(True))


def last_seasons(df: DataFrame, season: str, n: int) -> DataFrame:
    """Rows of the last ``n`` seasons that occur, by one scalar aggregate."""
    newest = df.agg((F.max(season) - n + 1).alias("_first"))
    return df.join(F.broadcast(newest), F.col(season) >= F.col("_first")).drop("_first")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Stored rows and those new ones whose key is not stored, one a key."""
    fresh = first_per_key(new, keys, order).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row a key: the newest version, a new row before a stored one of equal version."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per_key(both, keys, [F.col(version).desc(), F.col("_new").desc()]).drop("_new")


def keyed_update(stored: DataFrame, values: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``stored`` with non-null new values of some columns; ``values`` has one row a key."""
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = stored.join(new, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def replace_keys(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete then insert: all rows of the keys in ``new`` are replaced."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ordered_fetch(rows: DataFrame, wanted: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Rows of the wanted keys with their rank; keys without a row are dropped."""
    return wanted.select(key, rank).join(rows, key)


def newest_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the ``n`` greatest keys."""
    keys = df.select(key).distinct().orderBy(F.col(key).desc()).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")


def unordered_pairs(df: DataFrame, key: str, within: str) -> DataFrame:
    """(within, a, b) with a < b inside a pool; pools are kept small by a cap on rows (see ``capped``)."""
    a, b = df.select(within, F.col(key).alias("a")), df.select(within, F.col(key).alias("b"))
    return a.join(b, within).where("a < b")


def capped(df: DataFrame, within: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group: a sampling operator."""
    return first_per_key(df, within, order, cap)


def seeded_order(key: Column, seed: int) -> Column:
    """A shuffle that is the same in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def resolve(df: DataFrame, steps: Sequence[tuple[Column, DataFrame, str]], value: str) -> DataFrame:
    """Lookup cascade: the first step (key of ``df``, dimension, its key) that finds a value wins.

    Every dimension must have one row a key; Spark broadcasts those that are small.
    """
    found = []
    for i, (key, dimension, own) in enumerate(steps):
        right = dimension.select(F.col(own).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        df = df.withColumn(f"_q{i}", key).join(right, F.col(f"_q{i}") == F.col(f"_k{i}"), "left").drop(f"_q{i}", f"_k{i}")
        found.append(f"_v{i}")
    return df.withColumn(value, F.coalesce(*found)).drop(*found)


def carry_forward(df: DataFrame, column: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Replace nulls by the last value before them in the group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, filled, share): one pass over all columns, one row each."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])
    out = counts.select("n", F.inline(pairs))
    return out.select("field", "filled", F.round(F.col("filled") / F.when(F.col("n") > 0, F.col("n")), 4).alias("share"))


def fold_dimension(df: DataFrame, key: str, season: str, number: str, active: str) -> DataFrame:
    """Merge rows of one entity: seasons, number by season (the greatest of a season), newest number, ever active."""
    numbers = df.groupBy(key, season).agg(F.max(number).alias("_n")).where("_n IS NOT NULL").groupBy(key)
    numbers = numbers.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(season, "_n")))).alias("numbers"))
    folded = df.groupBy(key).agg(
        F.array_sort(F.collect_set(season)).alias("seasons"),
        F.max_by(number, season).alias("number"),
        F.bool_or(active).alias("active"),
    )
    return folded.join(numbers, key, "left")


def compare_rows(df: DataFrame, entity: str, wanted: Sequence[object], order: Sequence[str], channels: Sequence[str], where: Column) -> DataFrame:
    """(entity, samples): the chosen channels of 2 to 4 entities in order, null for an entity without rows."""
    if not 2 <= len(wanted) <= 4:
        raise ValueError("two to four entities can be compared")
    asked = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{entity} {df.schema[entity].dataType.simpleString()}")
    rows = df.where(F.col(entity).isin(list(wanted)) & where)
    samples = F.array_sort(F.collect_list(F.struct(*order, *[c for c in channels if c not in order])))
    return asked.join(rows.groupBy(entity).agg(samples.alias("samples")), entity, "left")


def plausible_year(ts: Column, season: Column) -> Column:
    """A date of its season or the year after, else null."""
    return F.when(F.year(ts).between(season, season + 1), ts)


def has_element(items: Column, field: str, value: str) -> Column:
    """Whether an array of structs has one whose field equals a value, case aside."""
    return F.coalesce(F.exists(items, lambda x: F.upper(x[field]) == value.upper()), F.lit(False))


def penalty_histogram(df: DataFrame, by: Sequence[str], code: str, missing: str = "NFA") -> DataFrame:
    """(by, histogram): a map of code to rows; a null code counts as ``missing``."""
    counts = df.groupBy(*by, F.coalesce(code, F.lit(missing)).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_n")))).alias("histogram"))


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left ⋈ bridge ⋈ right: every left row with each of its right rows."""
    return left.join(bridge.select(left_key, right_key).distinct(), left_key).join(right, right_key)


def first_with_context(labels: DataFrame, context: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The first value of every key in a stated order; columns of ``context`` that are not null win over those of the label's row."""
    first = first_per_key(labels, [key], [F.col(c) for c in order])
    extra = [c for c in context.columns if c != key]
    shared = [c for c in extra if c in labels.columns and c != value]
    right = context.select(key, *[F.col(c).alias(f"_ctx_{c}") for c in extra])
    out = first.join(right, key, "left")
    kept = [F.coalesce(f"_ctx_{c}", c).alias(c) if c in shared else F.col(c) for c in labels.columns]
    return out.select(*kept, *[F.col(f"_ctx_{c}").alias(c) for c in extra if c not in labels.columns])


def presence_label(df: DataFrame, key: str, role: str, names: Mapping[frozenset[str], str], other: str) -> DataFrame:
    """(key, label): one label for the set of roles present."""
    seen = df.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("_roles"))
    label = F.lit(other)
    for roles, name in names.items():
        label = F.when(F.col("_roles") == F.array(*[F.lit(r) for r in sorted(roles)]), name).otherwise(label)
    return seen.select(key, label.alias("label"))


def ordered_case(rules: Mapping[str, Column], default: str) -> Column:
    """Name of the first condition that holds."""
    out = F.lit(default)
    for name, condition in reversed(list(rules.items())):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def match_fragment(df: DataFrame, text: Column, fragments: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with the value of the first fragment (by ``place``) contained in the text, case aside.

    fragments: (fragment, place, value), a small rule table; it is broadcast by Spark's size check.
    """
    rows = df.withColumn("_text", F.lower(text))
    hits = rows.select(key, "_text").join(fragments, F.col("_text").contains(F.lower("fragment")))
    best = hits.groupBy(key).agg(F.min_by(value, "place").alias(value))
    return rows.drop("_text").join(best, key, "left")
