"""A feed of timed rows as a Python data source: filters run at the source, streams start again at an offset.

``read_feed`` scans a snapshot: comparisons with constants are pushed into the feed, which drops row groups
by their statistics and filters the rest before anything reaches Spark. ``stream_feed`` hands out rows in
order of (time, id): its offset is the last such pair, so of rows with equal times none is lost or
doubled, also where a batch ended between them. Partitions are row groups, never rows on the driver.

Defined cases: a row without a time or id has no place in a stream and is read by ``read_feed`` only; rows
that arrive behind the offset are late and not told; an empty feed gives nothing; filters on expressions or
kinds that the feed does not know stay with Spark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

NAME = "lodestone_feed"


def _dataset(path: str):
    import pyarrow.dataset as pads

    return pads.dataset(path.removeprefix("file://"), format="parquet", exclude_invalid_files=True)


def _row_groups(path: str, condition) -> list[FeedPart]:
    return [FeedPart(f.path, [g.id for g in f.row_groups]) for whole in _dataset(path).get_fragments(condition) for f in whole.split_by_row_group(condition)]


@dataclass
class FeedPart(ds.InputPartition):
    """Row groups of a file."""

    file: str
    groups: list[int]


def _condition(f: ds.Filter):
    """The filter as an Arrow expression, or None if the feed does not know it."""
    import pyarrow.dataset as pads

    negated = isinstance(f, ds.Not)
    inner = f.child if negated else f
    if len(inner.attribute) != 1:
        return None
    field = pads.field(inner.attribute[0])
    plain = {ds.GreaterThan: "__gt__", ds.GreaterThanOrEqual: "__ge__", ds.LessThan: "__lt__", ds.LessThanOrEqual: "__le__", ds.EqualTo: "__eq__"}
    if isinstance(inner, ds.In):
        # a null in the list makes "not in" unknown for every row
        known = [v for v in inner.value if v is not None]
        if negated:
            return None if len(known) < len(inner.value) else ~field.isin(known) & field.is_valid()
        return field.isin(known)
    if isinstance(inner, ds.IsNull | ds.IsNotNull):
        return field.is_null() if isinstance(inner, ds.IsNull) != negated else field.is_valid()
    if type(inner) in plain and inner.value is not None:
        made = getattr(field, plain[type(inner)])(inner.value)
        return ~made if negated else made
    return None


class FeedReader(ds.DataSourceReader):
    """Reads what passes the pushed filters."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names, self.pushed = path, schema.names, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if _condition(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def _where(self):
        where = None
        for f in self.pushed:
            where = _condition(f) if where is None else where & _condition(f)
        return where

    def partitions(self) -> list[FeedPart]:
        return _row_groups(self.path, self._where())

    def read(self, partition: FeedPart) -> Iterator:
        yield from _batches(partition, self.names, self._where())


def _batches(partition: FeedPart, names: list[str], where) -> Iterator:
    import pyarrow.dataset as pads

    fragment = pads.ParquetFileFormat().make_fragment(partition.file, row_groups=partition.groups, filesystem=pads.dataset(partition.file).filesystem)
    yield from (b for b in fragment.to_batches(schema=pads.dataset(partition.file).schema, columns=names, filter=where) if b.num_rows)


class FeedStream(ds.DataSourceStreamReader):
    """Reads rows behind one (time, id) and up to another. Times are microseconds in an offset."""

    def __init__(self, path: str, schema: StructType, time: str, key: str) -> None:
        self.path, self.names, self.time, self.key = path, schema.names, time, key

    def initialOffset(self) -> dict:
        return {"time": None, "id": None}

    def latestOffset(self) -> dict:
        """The greatest time by the statistics of the row groups, and the greatest id of the groups that reach it."""
        import pyarrow.compute as pc
        import pyarrow.dataset as pads

        last, groups = None, []
        for fragment in _dataset(self.path).get_fragments():
            for g in fragment.row_groups:
                bounds = (g.statistics or {}).get(self.time)
                top = bounds["max"] if bounds else dt.datetime.max
                if last is None or top > last:
                    last, groups = top, []
                if top == last:
                    groups.append(FeedPart(fragment.path, [g.id]))
        if last is dt.datetime.max:  # no statistics: all groups are read
            groups = _row_groups(self.path, None)
        best = None
        for part in groups:
            where = pads.field(self.time).is_valid() & pads.field(self.key).is_valid()
            for b in _batches(part, [self.time, self.key], where):
                top = pc.max(b.column(0)).as_py()
                pair = (top, pc.max(b.column(1).filter(pc.equal(b.column(0), top))).as_py())
                best = pair if best is None or pair > best else best
        return self.initialOffset() if best is None else {"time": _micros(best[0]), "id": best[1]}

    def _where(self, start: dict, end: dict):
        import pyarrow.dataset as pads

        t, k = pads.field(self.time), pads.field(self.key)
        if end["time"] is None:
            return t.is_null() & t.is_valid()
        z = _instant(end["time"])
        where = (t < z) | ((t == z) & (k <= end["id"]))
        if start["time"] is not None:
            a = _instant(start["time"])
            where = where & ((t > a) | ((t == a) & (k > start["id"])))
        return where & k.is_valid()

    def partitions(self, start: dict, end: dict) -> list[StreamPart]:
        return [StreamPart(p.file, p.groups, start, end) for p in _row_groups(self.path, self._where(start, end))]

    def read(self, partition: StreamPart) -> Iterator:
        yield from _batches(partition, self.names, self._where(partition.start, partition.end))


@dataclass
class StreamPart(FeedPart):
    start: dict
    end: dict


_EPOCH = dt.datetime(1970, 1, 1)


def _micros(t: dt.datetime) -> int:
    return (t.replace(tzinfo=None) - _EPOCH) // dt.timedelta(microseconds=1)


def _instant(micros: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=micros)


class FeedSource(ds.DataSource):
    """Options: path (a file or folder of Parquet that executors reach), time and id (columns, for streams)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_dataset(self.options["path"]).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> FeedStream:
        return FeedStream(self.options["path"], schema, self.options["time"], self.options["id"])


def register(spark: SparkSession) -> None:
    """Make the feed known to a session and let Spark push filters into Python sources."""
    spark.dataSource.register(FeedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_feed(spark: SparkSession, path: str, **equal: object) -> DataFrame:
    """A snapshot of the feed; arguments that are not None are filters, and reach the source."""
    register(spark)
    rows = spark.read.format(NAME).option("path", path).load()
    for name, value in equal.items():
        rows = rows if value is None else rows.where(rows[name] == value)
    return rows


def stream_feed(spark: SparkSession, path: str, time: str = "ts", key: str = "event_id") -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).option("path", path).option("time", time).option("id", key).load()
