"""The feed (pushed filters, restarts at an offset) and streams with lists, timers and intervals in their state."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.sources import feed
from lodestone.sources.tables import settings
from lodestone.streaming import live

T0 = dt.datetime(2024, 5, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(folder, name, rows, groups=4):
    """Rows (id, minutes or None, kind) as a Parquet file of small row groups."""
    table = pa.table({"event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array([None if r[1] is None else at(r[1]) for r in rows], pa.timestamp("us")), "kind": pa.array([r[2] for r in rows], pa.string())})
    os.makedirs(folder, exist_ok=True)
    pq.write_table(table, f"{folder}/{name}.parquet", row_group_size=groups)


ROWS = [(i, i // 3, ["a", "b", None][i % 3]) for i in range(40)] + [(99, None, "a"), (None, 3, "a")]


@pytest.mark.parametrize(
    "where",
    ["kind = 'a'", "kind <> 'a'", "kind IN ('a', 'b')", "kind NOT IN ('a')", "kind NOT IN ('a', NULL)", "kind IS NULL", "kind IS NOT NULL AND event_id > 5", "event_id >= 5 AND event_id < 30",
     "NOT event_id <= 7", "NOT event_id = 7", "ts > TIMESTAMP '2024-05-01 00:04:00'", "kind = 'a' OR event_id = 1", "length(kind) = 1 AND event_id <= 9", "kind <=> NULL", "kind LIKE 'a%'"],
)
def test_pushed_filters_change_nothing(spark, tmp_path, where):
    put(tmp_path / "f", "one", ROWS)
    got = feed.read_feed(spark, str(tmp_path / "f")).where(where)
    want = spark.read.parquet(f"file://{tmp_path}/f").where(where)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_filters_reach_the_source(spark, tmp_path):
    put(tmp_path / "f", "one", ROWS)
    df = feed.read_feed(spark, str(tmp_path / "f"), kind="a", event_id=None).where("event_id > 20")
    plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    # nothing is left for Spark to filter
    assert "BatchScan" in plan and "Filter" not in plan.replace("RuntimeFilters", "")
    assert df.count() == 8
    # row groups without any such row are not even partitions
    reader = feed.FeedReader(str(tmp_path / "f"), feed.FeedSource({"path": str(tmp_path / "f")}).schema())
    everything = len(reader.partitions())
    assert list(reader.pushFilters([feed.ds.GreaterThan(("event_id",), 35)])) == []
    assert everything == 11 and len(reader.partitions()) == 2


def run_feed(spark, folder, work):
    """One run to the end with the state of the run before; ids in all so far."""
    stream = feed.stream_feed(spark, str(folder)).select("event_id")
    stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(r[0] for r in spark.read.schema("event_id bigint").parquet(f"{work}/out").collect())


def test_a_stream_starts_again_between_equal_times(spark, tmp_path):
    folder, work = tmp_path / "f", f"file://{tmp_path}/w"
    put(folder, "a", [(1, 0, "a"), (2, 5, "a"), (3, 5, "a"), (7, None, "a")])
    assert run_feed(spark, folder, work) == [1, 2, 3]
    assert run_feed(spark, folder, work) == [1, 2, 3]
    # equal to the last time, and behind it: the first are new, the other is late
    put(folder, "b", [(4, 5, "a"), (5, 5, "b"), (6, 9, "a"), (0, 1, "late")])
    assert run_feed(spark, folder, work) == [1, 2, 3, 4, 5, 6]
    put(folder, "c", [(8, 9, "a")])
    assert run_feed(spark, folder, work) == [1, 2, 3, 4, 5, 6, 8]


def test_a_feed_of_nothing(spark, tmp_path):
    put(tmp_path / "f", "a", [])
    assert run_feed(spark, tmp_path / "f", f"file://{tmp_path}/w") == []
    assert feed.read_feed(spark, str(tmp_path / "f")).count() == 0


def arrivals(spark, folder, batches, schema):
    """One file a batch, in order, as a stream of one file a trigger."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_recent_rows_and_their_state(spark, tmp_path):
    schema = "user string, ts timestamp, id bigint"
    one = [("u", at(i), i) for i in range(5)] + [("v", at(0), 50), ("v", None, 51), (None, at(1), 60)]
    two = [("u", at(3), 3), ("u", at(9), 9), ("u", at(1), 90)]
    far = [("w", at(600), 70)]
    stream = arrivals(spark, f"file://{tmp_path}/in", [one, two, far, [("w", at(601), 71)]], schema)
    out, state = [], f"file://{tmp_path}/state"
    with settings(spark, **{"spark.sql.streaming.stateStore.providerClass": live.STATE_STORE}):
        made = live.recent(stream, "user", "ts", "id", 3, "1 hour", "1 minute")
        made.writeStream.outputMode("update").foreachBatch(lambda b, n: out.append([tuple(r) for r in b.collect()])).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        lists = spark.read.format("statestore").option("path", state).option("stateVarName", "rows").load()
        alive = {r.key["user"] for r in lists.select("key").collect()}
    first = {(u, i, n) for u, _, i, n in out[0]}
    assert first == {("u", 4, 1), ("u", 3, 2), ("u", 2, 3), ("v", 50, 1), (None, 60, 1)}
    # of equal rows each counts; only keys of the batch are told
    assert {(u, i, n) for u, _, i, n in out[1]} == {("u", 9, 1), ("u", 4, 2), ("u", 3, 3)}
    # the lists of keys that the watermark has left behind are gone
    assert alive == {"w"}


def test_fan_out_reaches_what_is_open(spark, tmp_path):
    messages = [[(1, "u", at(10)), (2, "u", at(60 * 30)), (3, "v", at(10)), (4, None, at(10))], [(5, "u", at(60 * 70))], [(6, "u", at(60 * 1))], [(7, "u", at(60 * 71))]]
    subscriptions = [
        [(10, "u", at(0), at(60 * 50)), (11, "u", at(10), at(20)), (12, "u", at(0), at(10)), (13, "v", at(11), at(12)), (14, "u", at(60 * 25), at(60 * 90)), (15, "u", at(30), None), (16, "u", at(30), at(30)), (17, "u", at(50), at(40)), (18, None, at(0), at(99))],
        [(19, "u", at(60 * 69), at(60 * 72))], [(20, "u", at(60 * 69), at(60 * 71))], [(21, "u", at(60 * 71), at(60 * 72))],
    ]
    m = arrivals(spark, f"file://{tmp_path}/m", messages, "message bigint, user string, ts timestamp")
    s = arrivals(spark, f"file://{tmp_path}/s", subscriptions, "subscription bigint, user string, opened timestamp, closed timestamp")
    got, state = [], f"file://{tmp_path}/state"
    joined = live.fan_out(m, s, "user", "ts", "opened", "closed", "1 hour").select("message", "subscription")
    run = joined.writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    # message 6 comes when the watermark has passed it; nothing is told twice, though 10 and 14 are several pieces
    assert sorted(got) == [(1, 10), (1, 11), (2, 10), (2, 14), (5, 14), (5, 19), (5, 20), (7, 14), (7, 19), (7, 21)]
    held = [o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]]
    assert held[-1] < max(held), "state shrinks as pieces and messages pass"


def test_quota_counts_whole_days(spark, tmp_path):
    rows = [("u", at(i)) for i in range(6)] + [("u", at(60 * 25)), ("v", at(1))]
    stream = arrivals(spark, f"file://{tmp_path}/q", [rows[:4], rows[4:]], "user string, ts timestamp")
    got = {}
    live.quota(stream, "user", "ts", 4, "2 days").writeStream.outputMode("update").foreachBatch(lambda b, n: got.update({(r.user, str(r.day)): (r.calls, r.over) for r in b.collect()})).option("checkpointLocation", f"file://{tmp_path}/qs").trigger(availableNow=True).start().awaitTermination()
    assert got == {("u", "2024-05-01"): (6, 2), ("u", "2024-05-02"): (1, 0), ("v", "2024-05-01"): (1, 0)}
