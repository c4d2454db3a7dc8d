"""Joins in time: interval, nearest, backward, k nearest and greatest overlap.

All have an equality key (session, user…). Where one key may be hot, rows are dealt by key and time
bucket: the smaller side of a window join is copied to the buckets its window touches, so that the
join stays an equality join on (key, bucket) and no task gets a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch with fractions, for timestamps with and without a zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def window_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, before: float, after: float, width: float | None = None) -> DataFrame:
    """Pairs with left - before <= right <= left + after and equal keys; adds ``delta`` (right - left, seconds).

    ``left`` and ``right`` share no column names but the keys. Buckets are as wide as the window, so a
    left row is copied two or three times at most.
    """
    width = width or max(before + after, 1.0)
    t = seconds(F.col(left_ts))
    span = F.sequence(F.floor((t - before) / width), F.floor((t + after) / width))
    left = left.where(F.col(left_ts).isNotNull()).withColumn("_bucket", F.explode(span))
    right = right.where(F.col(right_ts).isNotNull()).withColumn("_bucket", F.floor(seconds(F.col(right_ts)) / width))
    delta = seconds(F.col(right_ts)) - seconds(F.col(left_ts))
    joined = left.join(right, [*keys, "_bucket"]).withColumn("delta", delta)
    return joined.where((F.col("delta") >= -before) & (F.col("delta") <= after)).drop("_bucket")


def interval_link(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    agrees: Column, before: float = 120, after: float = 900, after_agreed: float = 1800,
) -> DataFrame:
    """Window join whose end reaches further where both sides agree (bounds inclusive)."""
    pairs = window_join(left, right, keys, left_ts, right_ts, before, after_agreed)
    return pairs.where((F.col("delta") <= after) | F.coalesce(agrees, F.lit(False)))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_key: str, left_ts: str, right_ts: str, tolerance: float, ties: Sequence[Column]) -> DataFrame:
    """Every left row with its nearest right row within the tolerance (nulls where there is none).

    Of equally near rows the earlier one is taken, then by ``ties``.
    """
    pairs = window_join(left, right, keys, left_ts, right_ts, tolerance, tolerance)
    rank = F.row_number().over(Window.partitionBy(left_key).orderBy(F.abs("delta"), F.col(right_ts), *ties))
    best = pairs.withColumn("_rank", rank).where("_rank = 1")
    own = [c for c in right.columns if c not in keys]
    best = best.select(left_key, *own, F.round("delta", 1).alias("delta"))
    return left.join(best, left_key, "left")


def k_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_key: str, left_ts: str, right_ts: str, reach: float, k: int, ties: Sequence[Column]) -> DataFrame:
    """The k nearest right rows of every left row within ``reach`` seconds, with ``rank``."""
    pairs = window_join(left, right, keys, left_ts, right_ts, reach, reach)
    rank = F.row_number().over(Window.partitionBy(left_key).orderBy(F.abs("delta"), *ties))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, order: str, width: float = 86400.0) -> DataFrame:
    """Every left row with the last right row that begins at or before it.

    Right columns (but the keys) come as ``last_<name>``; null where nothing came before. ``order``
    is a numeric column of ``right`` that orders rows of equal time. Rows are sorted within (key,
    time bucket); what the buckets before hold is one row a bucket, so a hot key is no hot task.
    """
    own = [c for c in right.columns if c not in keys]
    l = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_order"), F.struct(*left.columns).alias("_left"))
    r = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(order).cast("double").alias("_order"), F.struct(*own).alias("_right"))
    both = l.unionByName(r, allowMissingColumns=True).where(F.col("_ts").isNotNull())
    both = both.withColumn("_bucket", F.floor(seconds(F.col("_ts")) / width))
    carried = both.groupBy(*keys, "_bucket").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_ts", "_order"))).alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, "_bucket", F.last("_in", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_ts", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_right", ignorenulls=True).over(within)).where("_side = 1")
    both = both.join(carried, [*keys, "_bucket"]).withColumn("_last", F.coalesce("_last", "_carried"))
    return both.select("_left.*", *[F.col(f"_last.{c}").alias(f"last_{c}") for c in own])


def change_before(rows: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """value(step - 1) - value(step) as ``change``: null where the step before is missing (gaps do not count as the step before)."""
    earlier = rows.select(*keys, (F.col(step) + 1).alias(step), F.col(value).alias("_before"))
    return rows.join(earlier, [*keys, step], "left").withColumn("change", F.col("_before") - F.col(value)).drop("_before")


def greatest_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_key: str, spans: tuple[str, str, str, str], width: float, ties: Sequence[Column]) -> DataFrame:
    """Every left interval with the right interval that overlaps it most (none: dropped).

    ``spans``: start and stop of left and right, in seconds. Intervals have levels: at level m buckets are
    ``width`` * 2**m seconds wide, and one is at the least level at which it touches two buckets at most. A pair meets at
    the higher of its two levels, in its first common bucket, so an interval is copied to two buckets a level
    of the other side above its own, however long it is.
    """
    ls, le, rs, re_ = (F.col(c) for c in spans)
    level = lambda s, e: F.when(e - s > width, F.ceil(F.log2((e - s) / width))).otherwise(0).cast("int")
    top = lambda df, s, e: df.agg(F.coalesce(F.max(level(s, e)), F.lit(0)).alias("_top"))

    def placed(df: DataFrame, other: DataFrame, s: Column, e: Column, name: str) -> DataFrame:
        """``df`` with its own level (``name``), once for each level (_m) and bucket in which it may meet the other side."""
        df = df.crossJoin(F.broadcast(other)).withColumn(name, level(s, e))
        df = df.withColumn("_m", F.explode(F.sequence(F.col(name), F.greatest(F.col(name), F.col("_top"))))).drop("_top")
        wide = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_m"))
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(s / wide), F.floor(e / wide))))

    joined = placed(left, top(right, rs, re_), ls, le, "_l").join(placed(right, top(left, ls, le), rs, re_, "_r"), [*keys, "_m", "_bucket"])
    wide = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_m"))
    pairs = joined.where((F.col("_m") == F.greatest("_l", "_r")) & (F.col("_bucket") == F.greatest(F.floor(ls / wide), F.floor(rs / wide)))).drop("_l", "_r", "_m")
    pairs = pairs.withColumn("overlap", F.least(le, re_) - F.greatest(ls, rs)).where("overlap > 0").drop("_bucket")
    rank = F.row_number().over(Window.partitionBy(left_key).orderBy(F.desc("overlap"), *ties))
    return pairs.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def midpoint_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_key: str, spans: tuple[str, str, str, str], width: float, ties: Sequence[Column], reach: float = 0.5) -> DataFrame:
    """``greatest_overlap`` of ``reach`` seconds around the middle of every left interval."""
    middle = (F.col(spans[0]) + F.col(spans[1])) / 2
    narrow = left.withColumn("_low", middle - reach).withColumn("_high", middle + reach)
    return greatest_overlap(narrow, right, keys, left_key, ("_low", "_high", spans[2], spans[3]), width, ties).drop("_low", "_high")


# ---------------------------------------------------------------- messages and incidents

#: Words of messages about an investigation, and offences by phrase, first match wins.
INVESTIGATION = ("under investigation", "noted", "penalty", "penalised", "reprimand", "disqualified", "excluded", "offence", "referred to")
OFFENCES = (
    ("track_limits", "TRACK LIMITS|LEAVING THE TRACK AND GAINING"),
    ("yellow_flag", "DOUBLE YELLOW|YELLOW FLAG INFRINGEMENT"),
    ("collision", "CAUSING A COLLISION"),
    ("forcing_off_track", "FORCING ANOTHER DRIVER OFF THE TRACK"),
    ("unsafe_release", "UNSAFE RELEASE"),
    ("impeding", "IMPEDING"),
    ("pit_lane_speed", "SPEEDING IN THE PIT LANE"),
    ("pit_lane", "PIT LANE INFRINGEMENT"),
    ("vsc", "VSC INFRINGEMENT|VIRTUAL SAFETY CAR"),
    ("safety_car", "SAFETY CAR INFRINGEMENT"),
    ("practice_start", "PRACTICE START"),
    ("start_procedure", "STARTING PROCEDURE INFRINGEMENT"),
    ("false_start", "FALSE START|MOVING BEFORE (?:THE )?SIGNAL"),
    ("erratic_driving", "DRIVING ERRATICALLY|MOVING UNDER BRAKING"),
    ("driving_slowly", "DRIVING UNNECESSARILY SLOWLY"),
    ("crossing_track", "CROSSING THE TRACK"),
    ("race_director_instructions", "FAILING TO FOLLOW RACE DIRECTOR"),
)


def cars_named(message: Column, number: Column) -> Column:
    upper = F.upper(F.coalesce(message, F.lit("")))
    named = F.concat(
        F.regexp_extract_all(upper, F.lit(r"\bCARS?\s+(?:NO\.?\s*)?(\d{1,2})\b"), F.lit(1)),
        F.regexp_extract_all(upper, F.lit(r"\bAND\s+(\d{1,2})\s*\("), F.lit(1)),
    )
    numbers = F.transform(named, lambda x: x.cast("int"))
    return F.array_distinct(F.when(number.isNull(), numbers).otherwise(F.concat(numbers, F.array(number.cast("int")))))


def turn_named(message: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(message, F.lit(""))), r"\bTURN\s+(\d{1,2})\b", 1), F.lit(""))


def offence_named(message: Column) -> Column:
    upper = F.upper(F.coalesce(message, F.lit("")))
    out = F.lit(None).cast("string")
    for category, pattern in reversed(OFFENCES):
        out = F.when(upper.rlike(pattern), F.lit(category)).otherwise(out)
    return out


def link_messages(incidents: DataFrame, messages: DataFrame) -> DataFrame:
    """(incident_id, message_id): which messages are about which incidents of their session.

    incidents: session_key, incident_id, cars array<int>, incident_time, corner, category;
    messages: session_key, message_id, message, message_time, number.
    """
    m = messages.withColumn("named", cars_named(F.col("message"), F.col("number"))).withColumn("turn", turn_named(F.col("message"))).withColumn("offence", offence_named(F.col("message")))
    # one row a car on both sides: the join is on (session, car)
    i = incidents.withColumn("car", F.explode(F.array_distinct("cars")))
    m = m.withColumn("car", F.explode("named"))
    # with both times known, the join is by a time bucket too, so a busy car is spread over time
    timed_pairs = window_join(i, m, ["session_key", "car"], "incident_time", "message_time", 120, 1800).drop("delta")
    untimed_pairs = i.where("incident_time IS NULL").join(m, ["session_key", "car"]).select(*timed_pairs.columns)
    pairs = timed_pairs.unionByName(untimed_pairs)
    binding = F.coalesce(F.col("category").isin([c for c, _ in OFFENCES]), F.lit(False))
    agrees = binding & F.coalesce(F.col("offence") == F.col("category"), F.lit(False))
    turns = F.col("corner").isNull() | F.col("turn").isNull() | (F.col("corner") == F.col("turn"))
    deleted = F.upper(F.coalesce("message", F.lit(""))).rlike(r"\b(?:TIME|LAP)\s+(?:\d+:\d{2}\.\d+\s+)?DELETED\b") & binding & ~agrees
    spoken = F.lower(F.coalesce("message", F.lit(""))).rlike("|".join(INVESTIGATION))
    delta = seconds(F.col("message_time")) - seconds(F.col("incident_time"))
    timed = (delta >= -120) & ((delta <= 900) | (agrees & (delta <= 1800)))
    fits = F.when(F.col("incident_time").isNull(), F.when(binding, agrees).otherwise(spoken)).otherwise(F.coalesce(timed, F.lit(False)))
    return pairs.where(turns & ~deleted & fits).select("incident_id", "message_id").distinct()


def span_millis(text: Column) -> Column:
    """A time span as text, "1 days 02:03:04.567", "-1 days +23:59:59", "2:03:04", "3:04.5", in whole milliseconds.

    Cut towards zero, as a number would be; null for anything else.
    """
    shape = r"^\s*(?:(-?\d{1,6}) days?,? \+?)?(-)?(?:(\d{1,5}):)?(\d{1,5}):(\d{1,2}(?:\.\d{1,9})?)\s*$"
    part = lambda i, kind: F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit("0")).cast(kind)
    clock = (part(3, "bigint") * 3600 + part(4, "bigint") * 60).cast("decimal(28,9)") + part(5, "decimal(18,9)")
    total = part(1, "bigint").cast("decimal(28,9)") * 86_400 + F.when(F.regexp_extract(text, shape, 2) == "-", -clock).otherwise(clock)
    millis = total * 1000
    return F.when(text.rlike(shape), F.when(millis < 0, F.ceil(millis)).otherwise(F.floor(millis)).cast("bigint"))


def lap_starts(samples: DataFrame, laps: DataFrame, session: str, date: str, offset: str, lap_offset: str) -> DataFrame:
    """``laps`` with ``origin`` and ``started``: when each lap began, from offsets since the start of its session's streams.

    samples: every sample of every stream with its date and its offset in milliseconds. A sample is never ahead
    of its offset, only late, so a session's origin is the greatest (date - offset) of all its streams, rounded to
    milliseconds (half to even). Laps without an offset, or of sessions without samples, have null.
    """
    micros = F.unix_micros(F.col(date).cast("timestamp")) - F.col(offset) * 1000
    origin = samples.groupBy(session).agg(F.max(micros).alias("_micros"))
    millis = F.bround(F.col("_micros").cast("decimal(20,0)") / 1000, 0).cast("bigint")
    instant = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    out = laps.join(origin, session, "left")
    return out.withColumn("origin", instant(millis)).withColumn("started", instant(millis + F.col(lap_offset))).drop("_micros")
