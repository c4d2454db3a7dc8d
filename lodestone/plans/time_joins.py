"""Joins in time over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import temporal
from lodestone.plans.registry import query
from lodestone.sources import load


def _side(spark: SparkSession, sf_dir: str, kind: str, prefix: str, *more: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where(F.col("event_type") == kind)
    names = {"event_id": f"{prefix}_id", "ts": f"{prefix}_ts", "value": f"{prefix}_value", "props": f"{prefix}_props"}
    return e.select("user_id", *[F.col(c).alias(names[c]) for c in ("event_id", "ts", *more)])


_DELTA = "((epoch_us({r}) - epoch_us({l})) / 1000000.0::DOUBLE)"


@query("interval_link", f"""
WITH l AS (SELECT user_id, event_id AS error_id, ts AS lt, value AS lv FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, event_id AS purchase_id, ts AS rt, value AS rv FROM events WHERE event_type = 'purchase'),
j AS (SELECT error_id, purchase_id, {_DELTA.format(r="rt", l="lt")} AS delta, floor(lv / 10) = floor(rv / 10) AS agrees FROM l JOIN r USING (user_id))
SELECT error_id, purchase_id, round(delta, 1) AS delta FROM j WHERE delta >= -43200 AND (delta <= 86400 OR (delta <= 172800 AND agrees))
""")  # fmt: skip
def interval_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases of a user, -12 h to +1 day, or +2 days where their values are alike."""
    left, right = _side(spark, sf_dir, "error", "error", "value"), _side(spark, sf_dir, "purchase", "purchase", "value")
    agrees = F.floor(F.col("error_value") / 10) == F.floor(F.col("purchase_value") / 10)
    out = temporal.interval_link(left, right, ["user_id"], "error_ts", "purchase_ts", agrees, 43200, 86400, 172800)
    return out.select("error_id", "purchase_id", F.round("delta", 1).alias("delta"))


@query("asof_nearest", f"""
WITH l AS (SELECT user_id, event_id AS error_id, ts AS lt FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, event_id AS view_id, ts AS rt FROM events WHERE event_type = 'view'),
j AS (SELECT error_id, view_id, {_DELTA.format(r="rt", l="lt")} AS delta, rt FROM l JOIN r USING (user_id)),
b AS (SELECT * FROM j WHERE abs(delta) <= 36000 QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY abs(delta), rt, view_id) = 1)
SELECT l.error_id, b.view_id, round(b.delta, 1) AS delta FROM l LEFT JOIN b USING (error_id)
""")  # fmt: skip
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _side(spark, sf_dir, "error", "error"), _side(spark, sf_dir, "view", "view")
    out = temporal.nearest(left, right, ["user_id"], "error_id", "error_ts", "view_ts", 36000, [F.col("view_id")])
    return out.select("error_id", "view_id", "delta")


@query("asof_backward", """
WITH l AS (SELECT user_id, event_id AS error_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT user_id, event_id AS click_id, ts FROM events WHERE event_type = 'click')
SELECT error_id, (SELECT max(click_id) FROM r WHERE r.user_id = l.user_id AND r.ts = (SELECT max(ts) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts)) AS last_click_id FROM l
""")  # fmt: skip
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _side(spark, sf_dir, "error", "error"), _side(spark, sf_dir, "click", "click")
    return temporal.backward(left, right, ["user_id"], "error_ts", "click_ts", "click_id").select("error_id", "last_click_id")


@query("step_change", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag <> 'R')
SELECT a.l_orderkey, a.l_linenumber, b.l_quantity - a.l_quantity AS change FROM s a LEFT JOIN s b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1
""")  # fmt: skip
def step_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    return temporal.change_before(rows, ["l_orderkey"], "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "change")


@query("k_nearest_window", f"""
WITH l AS (SELECT user_id, event_id AS error_id, ts AS lt FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, event_id AS view_id, ts AS rt, value FROM events WHERE event_type = 'view'),
j AS (SELECT error_id, view_id, value, {_DELTA.format(r="rt", l="lt")} AS delta FROM l JOIN r USING (user_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY abs(delta), view_id)::INTEGER AS rank FROM j WHERE abs(delta) <= 86400)
SELECT error_id, view_id, rank FROM b WHERE rank <= 3 AND value > 10
""")  # fmt: skip
def k_nearest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest views within a day; the value filter comes after the limit, as it must."""
    left, right = _side(spark, sf_dir, "error", "error"), _side(spark, sf_dir, "view", "view", "value")
    out = temporal.k_nearest(left, right, ["user_id"], "error_id", "error_ts", "view_ts", 86400, 3, [F.col("view_id")])
    return out.where("view_value > 10").select("error_id", "view_id", "rank")


@query("nearest_anchor", f"""
WITH l AS (SELECT user_id, event_id AS view_id, ts AS lt FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, event_id AS error_id, ts AS rt FROM events WHERE event_type = 'error'),
j AS (SELECT view_id, error_id, {_DELTA.format(r="rt", l="lt")} AS delta FROM l JOIN r USING (user_id))
SELECT view_id, error_id FROM j WHERE abs(delta) <= 28800 QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY abs(delta), error_id) = 1
""")  # fmt: skip
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _side(spark, sf_dir, "view", "view"), _side(spark, sf_dir, "error", "error")
    return temporal.k_nearest(left, right, ["user_id"], "view_id", "view_ts", "error_ts", 28800, 1, [F.col("error_id")]).select("view_id", "error_id")


@query("overlap_max", """
WITH a AS (SELECT event_id AS a_id, user_id % 10 AS room, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 600 + (event_id % 7) * 300 AS e FROM events WHERE event_type = 'view'),
b AS (SELECT event_id AS b_id, user_id % 10 AS room, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 900 + (event_id % 5) * 240 AS e FROM events WHERE event_type = 'click'),
j AS (SELECT a_id, b_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM a JOIN b USING (room) WHERE a.s < b.e AND b.s < a.e)
SELECT a_id, b_id, overlap FROM j QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY overlap DESC, b_id) = 1
""")  # fmt: skip
def overlap_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("room"), F.floor(temporal.seconds(F.col("ts"))).alias("s"))
    a = e.where("event_type = 'view'").select("room", F.col("event_id").alias("a_id"), F.col("s").alias("a_s"), (F.col("s") + 600 + (F.col("event_id") % 7) * 300).alias("a_e"))
    b = e.where("event_type = 'click'").select("room", F.col("event_id").alias("b_id"), F.col("s").alias("b_s"), (F.col("s") + 900 + (F.col("event_id") % 5) * 240).alias("b_e"))
    return temporal.greatest_overlap(a, b, ["room"], "a_id", ("a_s", "a_e", "b_s", "b_e"), 3600, [F.col("b_id")]).select("a_id", "b_id", "overlap")


@query("lap_window", """
SELECT o_orderkey, count(l_linenumber) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN greatest(1, o_orderkey % 5 - 1) AND o_orderkey % 5 + 1 GROUP BY 1
""")  # fmt: skip
def lap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in a window around a centre; nulls where none is."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("centre"))
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    near = F.col("l_linenumber").between(F.greatest(F.lit(1), F.col("centre") - 1), F.col("centre") + 1)
    out = o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & near, "left")
    return out.groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
