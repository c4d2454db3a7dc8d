"""What several operators share: the shared folder and stable keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []
_open_spaces: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a local master (tests on one machine) gets a temporary folder,
    deleted at exit; on a cluster that is an error, as executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir.append("file://" + own)
    return _own_dir[0]


class Workspace:
    """Intermediate tables of one operator call, kept as Parquet in the shared folder.

    Writing cuts the lineage, so a lost executor costs one stage and not the whole job.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        _open_spaces.append(self)

    def save(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self._count += 1
        at = f"{self.path}/{self._count}-{name}"
        df.write.options(compression="zstd", **options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name_glob: str | None = None) -> None:
        """Delete the tables written so far (or those whose folder matches)."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path if name_glob is None else f"{self.path}/{name_glob}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if name_glob is None:
            fs.delete(path, True)
            return
        for status in fs.globStatus(path) or []:
            fs.delete(status.getPath(), True)

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps now and not at some later collection."""
        self.spark._jvm.System.gc()


def drop_workspaces() -> None:
    """Delete the tables of all calls so far; results that were not written yet go with them."""
    while _open_spaces:
        _open_spaces.pop().drop()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs run inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def seeded_unit(key: Column, seed: int, digits: int = 8) -> Column:
    """A number in [0, 16**digits) from md5 of key and seed: the same in any engine and run."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


class Names:
    """64-bit names of contents that no two different contents of a table share.

    Names are 64-bit hashes. They are held against 128-bit digests once, and the few that stand for
    more than one content (some 70 in 5e10) become hashes of the digest by another seed.
    """

    def __init__(self, contents: DataFrame, space: Workspace) -> None:
        """``contents``: one column, not null."""
        c = F.col(contents.columns[0])
        seen = contents.select(F.xxhash64(c).alias("h"), F.md5(c).alias("d")).groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b"))
        self.twice = space.save(seen.filter("a <> b").select(F.col("h").alias("_twice")), "twice")

    def add(self, df: DataFrame, content: Column, name: str) -> DataFrame:
        """``df`` with the names of ``content``; the table of clashes is as good as empty, and Spark sees its size."""
        again = F.xxhash64(F.lit(0x51ED270B), F.md5(content))
        df = df.withColumn(name, F.xxhash64(content)).join(self.twice, F.col(name) == F.col("_twice"), "left")
        return df.withColumn(name, F.when(F.col("_twice").isNull(), F.col(name)).otherwise(again)).drop("_twice")


def tagged(value: Column) -> Column:
    """A string that tells nulls and lengths apart, to be put before another string."""
    v = value.cast("string")
    return F.concat(F.coalesce(F.length(v), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(v, F.lit("")), F.lit(":"))
