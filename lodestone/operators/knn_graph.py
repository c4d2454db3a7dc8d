"""Graphs of nearest neighbours that do not multiply all pairs, and edge tables kept up to date by batches.

``knn_graph`` starts from a forest: each tree halves the vectors at the median of random projections
until a leaf fits one matrix product, and a vector's first neighbours are the best of its leaves. Neighbour
descent then looks at neighbours of neighbours: the lists of a vector (its own and, bounded, of those that
name it) are multiplied among themselves, and what beats an end's worst entry is merged, until few lists
change. Every step is a join or an aggregation of lists of bounded length; a table that fits one leaf is exact.

``EdgeStore`` keeps exact edges: a batch multiplies new vectors with all, and old ones with the new.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieval import vector_top_k
from lodestone.sources.tables import exists, keep, settings

#: Rows of a leaf, trees, length of the lists during the descent, rounds at most, and changed entries (share) at which it ends.
LEAF, TREES, WIDTH, ROUNDS, STILL = 1024, 4, 24, 8, 0.002
#: Vectors of lists that one Arrow batch holds at most.
BATCH_LISTS = 512


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): usable vectors at length one, shorter ones filled up with zeros; a zero vector stays zero.

    A vector that is null, empty or holds a null or non-finite component takes no part, nor does a null key.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    good = vectors.select(F.col(key).cast("bigint").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0) & fine)
    longest = good.agg(F.max(F.size("v")).alias("_dims"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.col("_dims") - F.size("v")))
    good = good.withColumn("_norm", norm).crossJoin(F.broadcast(longest)).withColumn("v", padded)
    return good.select("key", F.transform("v", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(0.0)).alias("v"))


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def forest(unit: DataFrame, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(key, tree, node): the leaf of every vector in every tree, each of about n / 2**depth vectors.

    Projections of all levels are taken at once; medians of the nodes then halve narrow rows level by
    level. Equal projections go by a hash, so equal vectors do not keep a node from being halved.
    """
    depth = max(0, ceil(log2(max(n, 1) / leaf)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            for tree in range(trees):
                way = np.random.default_rng([seed, tree]).standard_normal((x.shape[1], depth))
                p = np.round(x @ way, 9)
                offsets = np.arange(b.num_rows + 1, dtype=np.int32) * depth
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, tree, np.int32)), lists], names=["key", "tree", "p"])

    rows = unit.mapInArrow(project, "key bigint, tree int, p array<double>").withColumn("node", F.lit(0).cast("bigint"))
    for level in range(depth):
        rows = keep(rows.withColumn("_p", F.get("p", F.lit(level))), "forest")
        middle = rows.groupBy("tree", "node").agg(F.percentile_approx("_p", 0.5, 2000).alias("_middle"))
        tie = F.pmod(F.xxhash64("key", "tree", F.lit(level)), F.lit(2)) == 1
        right = (F.col("_p") > F.col("_middle")) | ((F.col("_p") == F.col("_middle")) & tie)
        rows = rows.join(middle, ["tree", "node"]).select("key", "tree", "p", (F.col("node") * 2 + right.cast("bigint")).alias("node"))
    return rows.select("key", "tree", "node")


def _best(edges: DataFrame, width: int) -> DataFrame:
    """The ``width`` best of each src, each pair once (old if any is); pairs and lists share one exchange."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return once.withColumn("rank", rank).where(F.col("rank") <= width)


def _leaf_edges(unit: DataFrame, leaves: DataFrame, width: int, decimals: int, work) -> DataFrame:
    def multiply(t: pa.Table) -> pa.Table:
        ids, x = t.column("key").to_numpy(), _matrix(t.column("v"))
        score = np.round(x @ x.T, decimals) + 0.0
        work.add(len(ids) * len(ids))
        np.fill_diagonal(score, -np.inf)
        low = np.partition(score, -width, axis=1)[:, -width] if len(ids) > width else np.full(len(ids), -np.inf)
        row, col = np.nonzero((score >= low[:, None]) & (score > -np.inf))
        order = np.lexsort((ids[col], -score[row, col], row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < width
        row, col = row[first], col[first]
        return pa.table({"src": ids[row], "dst": ids[col], "score": score[row, col]})

    return leaves.join(unit, "key").groupBy("tree", "node").applyInArrow(multiply, "src bigint, dst bigint, score double")


def _lists(edges: DataFrame, unit: DataFrame, width: int, seed: int) -> DataFrame:
    """(hub, near), where anything is fresh: each vector's own list and at most ``width`` of those that name it, with their vectors and worst scores."""
    own = edges.select(F.col("src").alias("hub"), F.col("dst").alias("u"), "fresh")
    named = edges.select(F.col("dst").alias("hub"), F.col("src").alias("u"), "fresh")
    drawn = Window.partitionBy("hub").orderBy(F.desc("fresh"), F.xxhash64("hub", "u", F.lit(seed)), "u")
    named = named.withColumn("_nth", F.row_number().over(drawn)).where(F.col("_nth") <= width).drop("_nth")
    both = own.unionByName(named).groupBy("hub", "u").agg(F.max("fresh").alias("fresh"))
    both = both.join(both.where("fresh").select("hub").distinct(), "hub", "left_semi")
    worst = edges.groupBy("src").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("_n"))
    worst = worst.select(F.col("src").alias("u"), F.when(F.col("_n") < width, F.lit(-2.0)).otherwise(F.col("low")).alias("low"))
    entries = both.join(unit.select(F.col("key").alias("u"), "v"), "u").join(worst, "u")
    return entries.groupBy("hub").agg(F.collect_list(F.struct("u", "fresh", "low", "v")).alias("near"))


def _descend(lists: DataFrame, decimals: int, work) -> DataFrame:
    """(src, dst, score): pairs within a list, one of them fresh, that beat the worst entry of src."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = b.column(0)
            flat, cuts = near.flatten(), np.asarray(near.offsets)
            cuts = cuts - cuts[0]
            ids, fresh = flat.field("u").to_numpy(), flat.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            low, x = flat.field("low").to_numpy(), _matrix(flat.field("v"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                new = lo + np.flatnonzero(fresh[lo:hi])
                score = np.round(x[new] @ x[lo:hi].T, decimals) + 0.0
                work.add(score.size)
                score[np.arange(len(new)), new - lo] = -np.inf
                row, col = np.nonzero(score > low[new][:, None])
                out.append((ids[new[row]], ids[lo + col], score[row, col]))
                row, col = np.nonzero(score > low[None, lo:hi])
                out.append((ids[lo + col], ids[new[row]], score[row, col]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "score"])

    return lists.select("near").mapInArrow(run, "src bigint, dst bigint, score double")


class Work:
    """Counts products in tasks; a task that runs again counts again."""

    def __init__(self, spark: SparkSession) -> None:
        self._sum = spark.sparkContext.accumulator(0)

    def add(self, n: int) -> None:
        self._sum.add(int(n))

    def __getattr__(self, name: str):
        if name == "value":
            return self._sum.value
        raise AttributeError(name)


def knn_graph(vectors: DataFrame, key: str, vector: str, k: int, leaf: int = LEAF, trees: int = TREES, width: int = WIDTH, rounds: int = ROUNDS, decimals: int = 6, seed: int = 7, work: Work | None = None) -> DataFrame:
    """(src, dst, score, rank): about the k nearest others of every vector by cosine; exact if all fit one leaf.

    Ties go to the lesser key. ``work`` counts products. Recall against exact edges is at least 0.9 in
    the tests, on clustered and on evenly spread vectors.
    """
    spark = vectors.sparkSession
    work, width = work or Work(spark), max(width, k)
    unit = keep(unit_vectors(vectors, key, vector), "unit")
    n = unit.count()
    one = n <= leaf
    leaves = forest(unit, n, 1 if one else trees, leaf, seed)
    edges = keep(_best(_leaf_edges(unit, leaves, width, decimals, work).withColumn("fresh", F.lit(True)), width), "edges")
    for number in range(0 if one else rounds):
        with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_LISTS)}):
            lists = _lists(edges, unit, width, seed + number)
            found = keep(_descend(lists, decimals, work).distinct().withColumn("fresh", F.lit(True)), "found")
        old = edges.select("src", "dst", "score", F.lit(False).alias("fresh"))
        edges = keep(_best(old.unionByName(found), width), "edges")
        if edges.where("fresh").count() <= STILL * n * width:
            break
    return edges.where(F.col("rank") <= k).select("src", "dst", "score", "rank")


def exact_graph(vectors: DataFrame, key: str, vector: str, k: int, decimals: int = 6) -> DataFrame:
    """(src, dst, score, rank): exactly the k nearest others of every vector, at the price of all products.

    The graph of ``knn_graph`` gives each vector a score that k others reach; the products then hand on nothing below it.
    """
    near = keep(knn_graph(vectors, key, vector, k, decimals=decimals), "near")
    # a step less, as sums in another order may round the other way
    least = near.where(F.col("rank") == k).select(F.col("src").alias("key"), (F.col("score") - 10.0**-decimals).alias("score"))
    return vector_top_k(vectors, vectors, key, vector, k, decimals, least).select(F.col("query").alias("src"), F.col("key").alias("dst"), "score", "rank")


class EdgeStore:
    """An exact top-k edge table in a folder that grows by numbered batches of vectors.

    Version b holds all vectors and edges after batch b, made from version b - 1 alone, so a batch that runs
    again after a failure writes the same version again. A batch multiplies its vectors with all and all old
    ones with its own, n_new * (n_new + 2 * n_old) products instead of n**2. A vector that comes again
    replaces the old one: edges to it go, and vectors whose lists lost an entry are asked anew.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, decimals: int = 6) -> None:
        self.spark, self.folder, self.k, self.decimals = spark, folder.rstrip("/"), k, decimals

    def _at(self, batch: int, table: str) -> str:
        return f"{self.folder}/version={batch}/{table}"

    def vectors(self, batch: int) -> DataFrame:
        return self.spark.read.schema("key bigint, v array<double>").parquet(self._at(batch, "vectors"))

    def edges(self, batch: int) -> DataFrame:
        return self.spark.read.schema("src bigint, dst bigint, score double, rank int").parquet(self._at(batch, "edges"))

    def apply(self, batch: int, vectors: DataFrame, key: str, vector: str) -> DataFrame:
        """The edges after ``batch`` (from 0, in order). Of equal keys in a batch one vector counts, the least."""
        new = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).groupBy("key").agg(F.min("v").alias("v"))
        new = keep(new, "batch")
        if batch == 0:
            old = self.spark.createDataFrame([], "key bigint, v array<double>")
            edges = self.spark.createDataFrame([], "src bigint, dst bigint, score double, rank int")
        elif exists(self.spark, self._at(batch - 1, "edges")):
            before = self.vectors(batch - 1)
            old, edges = before.join(new, "key", "left_anti"), self.edges(batch - 1)
        else:
            raise ValueError(f"batch {batch} comes before batch {batch - 1}")
        names = new.select(F.col("key").alias("_k"))
        # sources that named a replaced vector lost an entry; the replaced ones are new themselves
        lost = edges.join(names, F.col("dst") == F.col("_k"), "left_semi").select(F.col("src").alias("key")).distinct()
        stale = old.join(lost, "key", "left_semi")
        calm = old.join(lost, "key", "left_anti")
        every = old.unionByName(new)
        every.write.mode("overwrite").parquet(self._at(batch, "vectors"))
        every = self.vectors(batch)
        top = lambda store, asked: vector_top_k(store, asked, "key", "v", self.k, self.decimals).select(F.col("query").alias("src"), F.col("key").alias("dst"), "score")
        whole = top(every, new.unionByName(stale))
        kept = edges.join(calm.select(F.col("key").alias("src")), "src", "left_semi").select("src", "dst", "score")
        merged = whole.unionByName(kept).unionByName(top(new, calm))
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
        out = merged.withColumn("rank", rank).where(F.col("rank") <= self.k)
        out.select("src", "dst", "score", "rank").write.mode("overwrite").parquet(self._at(batch, "edges"))
        return self.edges(batch)
