"""Streaming operators: deduplication, windows, sessions, alerts, interval joins and quotas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of messages about incidents.
INCIDENT_PHRASES = ("BLUE FLAG", "BLACK FLAG", "BLACK AND WHITE FLAG", "INCIDENT NOTED", "UNDER INVESTIGATION", "NOTED - ALLEGED BREACH")


def dedup(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row of every key within the watermark: bounded state instead of a set that only grows."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, by: Sequence[str], ts: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Rows and sums by window (sliding if ``slide`` is given)."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = stream.withWatermark(ts, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, by: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions that end after a gap without events."""
    s = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, before: str, after: str, delay: str) -> DataFrame:
    """Stream-stream join on a key and a time interval; state is bounded by watermarks and interval."""
    left = left.withWatermark(left_ts, delay)
    right = right.withWatermark(right_ts, delay).withColumnRenamed(key, f"_{key}")
    within = (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL {before}")) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {after}"))
    return left.join(right, (F.col(key) == F.col(f"_{key}")) & within).drop(f"_{key}")


def alerts(stream: DataFrame, trigger: Column, cards: DataFrame, key: str) -> DataFrame:
    """Rows that trigger an alert, joined to a static table."""
    return stream.where(trigger).join(cards, key)


def alert_precedents(alerts_stream: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, out: str):
    """A started query that gives each alert its k nearest stored vectors, batch by batch, as Parquet below ``out``.

    A batch that runs again after a failure writes its own folder again, so no alert is told twice.
    """
    from lodestone.operators.retrieval import vector_top_k

    def search(batch: DataFrame, number: int) -> None:
        asked = batch.select(key, vector).dropDuplicates([key])
        hits = vector_top_k(vectors, asked, key, vector, k).select(F.col("query").alias(key), F.col("key").alias("precedent"), "score", "rank")
        batch.drop(vector).join(hits, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return alerts_stream.writeStream.trigger(availableNow=True).foreachBatch(search)


def incident_message(category: Column, flag: Column, message: Column) -> Column:
    """Whether a message of the race control is about an incident: a black flag, its category or one of the phrases."""
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    told = upper(message).rlike("|".join(INCIDENT_PHRASES))
    return ((upper(category) == "FLAG") & upper(flag).isin("BLACK", "BLACK AND WHITE")) | (upper(category) == "INCIDENT") | told


def quota(stream: DataFrame, user: str, ts: str, limit: int, delay: str) -> DataFrame:
    """(user, day, calls, over): calls of a UTC day so far and how many lie beyond the limit, for update mode.

    The state of a day goes once the watermark has passed its end; later calls of that day are late
    and not counted.
    """
    counts = stream.withWatermark(ts, delay).groupBy(user, F.window(ts, "1 day").alias("_w")).agg(F.count(F.lit(1)).alias("calls"))
    return counts.select(user, F.to_date("_w.start").alias("day"), "calls", F.greatest(F.col("calls") - limit, F.lit(0).cast("bigint")).alias("over"))


#: The state of keys with lists and timers is kept by this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def recent(stream: DataFrame, by: str, ts: str, order: str, most: int, idle: str, delay: str, columns: Sequence[str] = ()) -> DataFrame:
    """(by, ts, order, columns, nth): after each batch, the newest ``most`` rows of every key that the batch touched, newest first.

    A key's rows are a list in its state. Once the watermark is ``idle`` beyond the newest of them, a timer drops the
    list, so state holds no more than ``most`` rows for each key that is still alive. Needs a session with
    ``STATE_STORE``. A row without a time or order number is dropped; of equal rows each counts.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import IntegerType, StructField, StructType

    names = [ts, order, *columns]
    held = StructType([stream.schema[c] for c in names])
    told = StructType([stream.schema[by], *held.fields, StructField("nth", IntegerType())])
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    class Recent(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.rows = handle.getListState("rows", held)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            before = pd.DataFrame(list(self.rows.get()), columns=names) if self.rows.exists() else None
            parts = [f[names] for f in rows]
            every = pd.concat([*([before] if before is not None and len(before) else []), *parts]).sort_values([ts, order], ascending=[False, True], kind="stable").head(most)
            self.rows.put([tuple(r) for r in every.itertuples(index=False)])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            end = int(every[ts].iloc[0].timestamp() * 1000) + wait
            self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
            yield every.assign(**{by: key[0], "nth": range(1, len(every) + 1)})[told.names]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.rows.clear()
            yield from ()

        def close(self) -> None:
            pass

    rows = stream.where(F.col(ts).isNotNull() & F.col(order).isNotNull()).withWatermark(ts, delay).select(by, *names)
    return rows.groupBy(by).transformWithStateInPandas(statefulProcessor=Recent(), outputStructType=told, outputMode="Update", timeMode="EventTime")


def fan_out(messages: DataFrame, subscriptions: DataFrame, key: str, ts: str, opened: str, closed: str, delay: str, piece: str = "1 day") -> DataFrame:
    """Each message with every subscription of its key that is open at its time: opened <= ts < closed.

    Both are streams. A subscription is cut into pieces of at most ``piece``, so its rows leave the state once the watermark
    is a piece beyond their start, however long it stays open, and a message once no earlier subscription can
    come. One without an end or that ends before it begins reaches nothing. No other column names in common.
    """
    width = F.expr(f"INTERVAL {piece}")
    span = subscriptions.where(F.col(opened) < F.col(closed))
    starts = F.filter(F.sequence(F.col(opened), F.col(closed), width), lambda t: t < F.col(closed))
    pieces = span.withColumn("_from", F.explode(starts)).withColumn("_until", F.least(F.col("_from") + width, F.col(closed))).withColumnRenamed(key, "_key")
    pieces = pieces.withWatermark("_from", delay)
    m = messages.withWatermark(ts, delay)
    open_then = (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_until")) & (F.col(ts) < F.col("_from") + width)
    return m.join(pieces, (F.col(key) == F.col("_key")) & open_then).drop("_key", "_from", "_until")
