"""Streaming queries over the events table as a file stream, and their batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.registry import query
from lodestone.sources import load
from lodestone.sources.feed import read_feed, stream_feed
from lodestone.sources.tables import scratch, settings
from lodestone.streaming import live
from lodestone.streaming.run import event_stream, run_to_end

#: Longer than the data's span, so that no row is late and batch SQL gives the same rows.
DELAY = "60 days"


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Instants back to times without a zone, the type of the tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return run_to_end(live.dedup(e, ["user_id", "event_type", "day"], "ts", DELAY).select("user_id", "event_type", "day"), name="dedup")


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = live.tumbling(event_stream(spark, sf_dir), ["event_type"], "ts", "1 day", DELAY)
    return _plain(run_to_end(w, "complete", "tumbling").withColumn("total", F.round("total", 2)), "start")


@query("stream_sliding", """
WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS start, event_type FROM events)
SELECT start, event_type, count(*) AS n FROM s GROUP BY ALL
""")  # fmt: skip
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = live.tumbling(event_stream(spark, sf_dir), ["event_type"], "ts", "12 hours", DELAY, "6 hours")
    return _plain(run_to_end(w, "complete", "sliding").select("start", "event_type", "n"), "start")


@query("stream_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, count(*) AS n FROM s GROUP BY user_id, k
""")  # fmt: skip
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = live.sessions(event_stream(spark, sf_dir), ["user_id"], "ts", "6 hours", DELAY)
    return _plain(run_to_end(s, "complete", "sessions"), "start", "stop")


@query("stream_interval", """
SELECT l.event_id AS error_id, r.event_id AS purchase_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'error' AND r.event_type = 'purchase'
    AND r.ts BETWEEN l.ts - INTERVAL 12 HOURS AND l.ts + INTERVAL 1 DAY
""")  # fmt: skip
def stream_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = event_stream(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    r = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    joined = live.interval_join(l, r, "user_id", "error_ts", "purchase_ts", "12 hours", "1 day", DELAY)
    return run_to_end(joined.select("error_id", "purchase_id"), name="interval")


@query("stream_alerts", "SELECT event_id, user_id, event_type, c_name, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error' AND value > 20")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    hit = (F.col("event_type") == "error") & (F.col("value") > 20)
    out = live.alerts(event_stream(spark, sf_dir), hit, cards, "user_id")
    return run_to_end(out.select("event_id", "user_id", "event_type", "c_name", "c_mktsegment"), name="alerts")


@query("stream_quota", "SELECT user_id, ts::DATE AS day, count(*) AS calls, greatest(count(*) - 4, 0)::BIGINT AS over_limit FROM events GROUP BY ALL")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = run_to_end(live.quota(event_stream(spark, sf_dir), "user_id", "ts", 4, DELAY), "update", "quota")
    return updates.groupBy("user_id", "day").agg(F.max("calls").alias("calls"), F.max("over").alias("over_limit"))


@query("stream_late_rows", """
WITH b AS (SELECT min(ts) AS a, max(ts) FILTER (event_id % 10 <> 0) AS z FROM events)
SELECT date_trunc('day', ts) AS start, count(*) AS n FROM events, b WHERE event_id % 10 <> 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > z - INTERVAL 2 DAYS GROUP BY 1
""")  # fmt: skip
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows arrives last: those of windows that the watermark has closed are dropped, the others count."""
    folder = scratch(spark, "arrivals")
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    on_time = e.where("event_id % 10 <> 0")
    low, high = on_time.agg(F.min("ts"), F.max("ts")).first()
    middle = low + (high - low) / 2
    nothing = on_time.limit(0)
    # the two empty files only let the watermark of the files before take effect
    for n, part in enumerate((on_time.where(F.col("ts") < middle), on_time.where(F.col("ts") >= middle), nothing, nothing, e.where("event_id % 10 = 0"))):
        part.coalesce(1).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    windows = stream.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    counts = run_to_end(windows.select(F.col("w.start").alias("start"), "n"), "update", "late")
    return _plain(counts.groupBy("start").agg(F.max("n").alias("n")), "start")


@query("stream_alert_precedents", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), a AS (SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 20),
u AS (SELECT DISTINCT user_id FROM a), c AS (SELECT u.user_id, b.vec_id AS precedent, round(list_cosine_similarity(x.e, b.e), 6) + 0.0 AS score FROM u JOIN v x ON x.vec_id = u.user_id JOIN v b ON b.vec_id <> u.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, precedent)::INTEGER AS rank FROM c)
SELECT event_id, a.user_id, precedent, score, rank FROM a JOIN r USING (user_id) WHERE rank <= 5
""")  # fmt: skip
def stream_alert_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert with the five stored vectors nearest to its own, found per batch; vectors and users share ids here."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    alerts = live.alerts(event_stream(spark, sf_dir), (F.col("event_type") == "error") & (F.col("value") > 20), vectors, "user_id")
    out, state = scratch(spark, "precedents"), scratch(spark, "precedents-state")
    live.alert_precedents(alerts.select("event_id", "user_id", "embedding"), vectors, "user_id", "embedding", 5, out).option("checkpointLocation", state).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "precedent", "score", "rank")


@query("incident_messages", """
SELECT event_id, event_id % 6 IN (0, 1, 3, 4) AS incident FROM events
""")  # fmt: skip
def incident_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    category = F.when(k == 0, "flag").when(k == 1, "Incident").when(k == 2, "Flag").otherwise(F.lit(None))
    message = F.when(k == 3, "Car 4 noted - alleged breach of rules").when(k == 4, "TURN 4 INCIDENT UNDER INVESTIGATION").when(k == 5, "Green light")
    flag = F.when(k == 0, "black and white").when(k == 2, "yellow")
    return load(spark, sf_dir, "events").select("event_id", live.incident_message(category, flag, message).alias("incident"))


@query("stored_rows", "SELECT event_id, user_id, true AS stored FROM events WHERE event_type = 'purchase'")
def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream kept as JSON lines with the time of storing."""
    out, state = scratch(spark, "stored"), scratch(spark, "stored-state")
    rows = event_stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", F.current_timestamp().alias("stored_at"))
    rows.writeStream.format("json").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("event_id bigint, user_id bigint, stored_at timestamp").json(out)
    return back.select("event_id", "user_id", F.col("stored_at").isNotNull().alias("stored"))


@query("feed_scan", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 20 AND user_id IN (SELECT unnest([1, 2, 3, 5, 8, 13]))")
def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a feed whose filters run at the source."""
    rows = read_feed(spark, f"{sf_dir}/events.parquet", event_type="error")
    return rows.where((F.col("value") > 20) & F.col("user_id").isin(1, 2, 3, 5, 8, 13)).select("event_id", "user_id", "value")


@query("feed_stream", "SELECT event_id, ts, event_type FROM events")
def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream with offsets of (time, id)."""
    return run_to_end(stream_feed(spark, f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type"), name="feed")


@query("stream_recent_messages", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events) SELECT user_id, event_id, nth::INTEGER AS nth FROM r WHERE nth <= 200 AND event_type IN ('error', 'purchase')
""")  # fmt: skip
def stream_recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 messages of each session, kept as a list in the state of a stream; those of two kinds are shown."""
    with settings(spark, **{"spark.sql.streaming.stateStore.providerClass": live.STATE_STORE}):
        told = run_to_end(live.recent(event_stream(spark, sf_dir), "user_id", "ts", "event_id", 200, "90 days", DELAY, ["event_type"]), "update", "recent")
    last = told.withColumn("_last", F.max("batch").over(Window.partitionBy("user_id"))).where(F.col("batch") == F.col("_last"))
    return last.where(F.col("event_type").isin("error", "purchase")).select("user_id", "event_id", "nth")


@query("stream_fan_out", """
WITH s AS (SELECT event_id AS subscription, user_id, ts AS opened, ts + to_hours(event_id % 72) AS closed FROM events WHERE event_type = 'signup')
SELECT m.event_id AS message, subscription FROM events m JOIN s ON m.user_id = s.user_id AND m.ts >= opened AND m.ts < closed WHERE m.event_type <> 'signup'
""")  # fmt: skip
def stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of a stream to the subscriptions of its session that are open at its time: up to three days from a signup."""
    e = event_stream(spark, sf_dir)
    m = e.where("event_type <> 'signup'").select(F.col("event_id").alias("message"), "user_id", "ts")
    s = event_stream(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("subscription"), "user_id", F.col("ts").alias("opened"), F.expr("ts + make_interval(0, 0, 0, 0, event_id % 72)").alias("closed"))
    return run_to_end(live.fan_out(m, s, "user_id", "ts", "opened", "closed", DELAY).select("message", "subscription"), name="fan-out")
