"""Consistency analytics: shares, variance, trends, chi-squared, cockpit, quotas and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.numbers import no_minus_zero
from lodestone.operators import stats
from lodestone.plans.registry import query
from lodestone.sources import load

STATUS = {"F": "pct_f", "O": "pct_o", "P": "pct_p"}


@query("consistency_shares", """
SELECT c_mktsegment AS category, year(o_orderdate)::INTEGER AS season, count(*) AS total,
    round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS pct_f,
    round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'O') / count(*), 1) AS pct_o,
    round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'P') / count(*), 1) AS pct_p
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY season DESC, total DESC, category
""")  # fmt: skip
def consistency_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("season"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return stats.shares(joined, ["category", "season"], "o_orderstatus", STATUS).orderBy(F.desc("season"), F.desc("total"), "category")


_SEVERITY = {"click": 0.0, "view": 1.0, "purchase": 3.0, "signup": 6.0, "error": 10.0}


@query("category_variance", """
WITH c AS (SELECT user_id AS category, event_type, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY category) AS p,
    CASE event_type WHEN 'click' THEN 0.0 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 6.0 WHEN 'error' THEN 10.0 ELSE 0.0 END::DOUBLE AS w FROM c),
g AS (SELECT category, sum(n)::BIGINT AS total, count(*) AS outcomes, round(-sum(p * log2(p)), 3) + 0.0 AS entropy,
    first(event_type ORDER BY n DESC, event_type) AS modal, round(sum(w * n) / sum(n), 2) AS mean_severity FROM t GROUP BY category)
SELECT category, total, outcomes, modal, mean_severity, CASE WHEN entropy = 0 THEN 0.0 ELSE entropy END AS entropy,
    CASE WHEN outcomes > 1 THEN round(entropy / log2(outcomes), 3) ELSE 0.0 END AS inconsistency FROM g
""")  # fmt: skip
def category_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("category"), "event_type")
    counts = stats.outcome_counts(events, ["category"], "event_type")
    return stats.variance(counts, ["category"], "event_type", stats.severity(F.col("event_type"), _SEVERITY))


@query("category_trend_slope", """
WITH y AS (SELECT c_mktsegment AS category, year(o_orderdate)::INTEGER AS season, avg(left(o_orderpriority, 1)::INTEGER) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE year(o_orderdate) >= (SELECT max(year(o_orderdate)) - 4 FROM orders) GROUP BY ALL),
s AS (SELECT category, count(*) AS seasons, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(coalesce(regr_slope(v, season), 0.0), 4) + 0.0 END AS slope FROM y GROUP BY 1)
SELECT category, seasons, CASE WHEN slope = 0 THEN 0.0 ELSE slope END AS slope,
    CASE WHEN slope > 0.05 THEN 'stricter' WHEN slope < -0.05 THEN 'lenient' ELSE 'consistent' END AS trend FROM s
""")  # fmt: skip
def category_trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.relational import last_seasons

    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("season"))
    orders = last_seasons(orders, "season", 5)
    joined = orders.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    yearly = joined.groupBy(F.col("c_mktsegment").alias("category"), "season").agg(F.avg(F.left("o_orderpriority", F.lit(1)).cast("int")).alias("v"))
    return stats.trend(yearly, "category", "season", "v")


_CHI = """
WITH c AS (SELECT n_name AS panel, l_returnflag AS outcome, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT outcome, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY 1),
g AS (SELECT panel, sum(n)::BIGINT AS n FROM c GROUP BY 1),
x AS (SELECT g.panel, any_value(g.n) AS n, CASE WHEN any_value(g.n) < 5 THEN 0.0 ELSE round(sum(power(c.n - g.n * share, 2) / (g.n * share)){rest}, 3) END AS chi2,
    (SELECT greatest(count(*) - 1, 1) FROM s)::BIGINT AS df FROM g JOIN c ON g.panel = c.panel JOIN s ON s.outcome = c.outcome GROUP BY 1),
z AS (SELECT *, (power(chi2 / df, 1.0::DOUBLE / 3.0) - (1.0::DOUBLE - 2.0::DOUBLE / (9.0 * df))) / sqrt(2.0::DOUBLE / (9.0 * df)) / sqrt(2.0) AS z FROM x),
e AS (SELECT *, 1.0::DOUBLE / (1.0 + 0.3275911::DOUBLE * abs(z)) AS t FROM z),
p AS (SELECT *, CASE WHEN chi2 <= 0 OR df <= 0 THEN 1.0::DOUBLE ELSE round(0.5::DOUBLE * (1.0 - sign(z) * (1.0 - (((((1.061405429::DOUBLE * t + -1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t + -0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t) * exp(-z * z))), 4) END AS p_value FROM e)
SELECT panel, n, chi2, df, p_value, p_value < 0.05 AS significant FROM p
"""


def _panel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("outcome"))
    # counted by supplier first: the joins see a few rows a supplier instead of every line
    lines = lines.groupBy("l_suppkey", "outcome").agg(F.count(F.lit(1)).alias("n"))
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("panel"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("panel", "outcome").agg(F.sum("n").alias("n"))


@query("panel_chi_squared", _CHI.format(rest=""))
def panel_chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi_squared(_panel_counts(spark, sf_dir), "panel", "outcome")


@query("panel_chi_squared_pearson", _CHI.format(rest=" + any_value(g.n) - sum(g.n * share)"))
def panel_chi_squared_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi_squared(_panel_counts(spark, sf_dir), "panel", "outcome", observed_only=False)


@query("entity_cockpit", """
WITH o AS (SELECT o_custkey, left(o_orderpriority, 1)::BIGINT AS points, year(o_orderdate)::INTEGER AS season, o_orderstatus FROM orders),
m AS (SELECT *, max(season) OVER (PARTITION BY o_custkey) AS latest FROM o)
SELECT c_custkey AS entity, count(o_custkey) AS rulings, coalesce(sum(points), 0)::BIGINT AS points,
    coalesce(sum(points) FILTER (season = latest), 0)::BIGINT AS recent_points, max(season) AS latest_season,
    count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
    CASE WHEN coalesce(sum(points) FILTER (season = latest), 0) >= 10 THEN 'high' WHEN coalesce(sum(points) FILTER (season = latest), 0) >= 7 THEN 'medium'
        WHEN coalesce(sum(points) FILTER (season = latest), 0) >= 4 THEN 'low' ELSE 'none' END AS risk,
    round(least(coalesce(sum(points) FILTER (season = latest), 0) / 12.0::DOUBLE, 1.0), 4) AS ban_score
FROM customer LEFT JOIN m ON c_custkey = o_custkey GROUP BY c_custkey
""")  # fmt: skip
def entity_cockpit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("points"), F.year("o_orderdate").alias("season"), "o_orderstatus")
    # by season first, then the latest of each entity: two partial aggregations and no window over raw rows
    by_season = o.groupBy("o_custkey", "season").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o")
    )
    per = by_season.groupBy("o_custkey").agg(
        F.sum("n").alias("rulings"), F.sum("p").alias("points"), F.max_by("p", "season").alias("recent_points"),
        F.max("season").alias("latest_season"), F.sum("f").alias("n_f"), F.sum("o").alias("n_o"),
    )
    out = load(spark, sf_dir, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("rulings", "points", "recent_points", "n_f", "n_o")}
    out = out.withColumns(zero)
    return out.select(
        F.col("c_custkey").alias("entity"), "rulings", "points", "recent_points", "latest_season", "n_f", "n_o",
        stats.risk_band(F.col("recent_points")).alias("risk"), F.round(F.least(F.col("recent_points") / 12.0, F.lit(1.0)), 4).alias("ban_score"),
    )


@query("quota_breaches", """
WITH n AS (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth FROM events)
SELECT event_id, user_id, day, nth FROM n WHERE nth > 4
""")  # fmt: skip
def quota_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return stats.over_quota(events, "user_id", "ts", [F.col("ts"), F.col("event_id")], 4).select("event_id", "user_id", "day", "nth")


@query("latency_percentiles", """
WITH k AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000),
a AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM k GROUP BY 1 HAVING count(*) >= 10)
SELECT event_type, n, v[greatest(floor(n * 50 / 100)::BIGINT - 1, 0) + 1] AS p50, v[greatest(floor(n * 95 / 100)::BIGINT - 1, 0) + 1] AS p95,
    v[greatest(floor(n * 99 / 100)::BIGINT - 1, 0) + 1] AS p99, v[1] AS least, v[-1] AS greatest FROM a
""")  # fmt: skip
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return stats.rolling_percentiles(events, "event_type", [F.desc("ts"), F.desc("event_id")], "value")


@query("summary_row", """
SELECT count(*) AS n, coalesce(sum(l_linenumber), 0)::BIGINT AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_shipdate) AS latest FROM lineitem WHERE l_discount > 0.05
""")  # fmt: skip
def summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where("l_discount > 0.05")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").alias("latest"))


@query("varied_groups", """
WITH g AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)
SELECT count(*) AS varied, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS groups FROM g
""")  # fmt: skip
def varied_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # least and greatest tell whether a group varies, without a set of its values
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.min("l_returnflag") < F.max("l_returnflag")).alias("varied"))
    return g.agg(F.count_if("varied").alias("varied"), F.count(F.lit(1)).alias("groups"))


@query("progress_by_source", """
SELECT source, count(*) AS documents, count(quality) AS labelled, round(100.0::DOUBLE * count(quality) / count(*), 1) AS pct, count(*) FILTER (quality = 1) AS good
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1
""")  # fmt: skip
def progress_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n, labelled = F.count(F.lit(1)), F.count("quality")
    return d.groupBy("source").agg(n.alias("documents"), labelled.alias("labelled"), no_minus_zero(F.round(100.0 * labelled / n, 1)).alias("pct"), F.count_if(F.col("quality") == 1).alias("good"))
