"""Exact top-k by inner product over a pivot-distance index.

Vectors are quantised to integers. To turn inner products into distances, every vector gets one
more component that lifts all to the same length M, and a query gets 0 there: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest score is the nearest vector. Each vector is keyed by
its nearest pivot and its distance to it, cut into annuli. A query visits annuli in order of their
least possible distance, in rounds that grow (``ROUNDS``): as | d(q, pivot) - d(x, pivot) | <= d(q, x),
it stops where that exceeds the distance of its k-th best score so far.

Every round is one join: queries meet the annuli that their bounds leave, packed in blocks, and an
annulus is packed in segments, so a hot vector or pivot is many segments and a task multiplies two
bounded matrices. Nothing of the queries or vectors passes through the driver but a sample of
``PIVOT_SAMPLE`` rows, from which the pivots come, and one row for each of the at most
``PIVOTS * RINGS`` annuli. The index holds every row; the sample decides speed and never results.

Defined cases: vectors that are null or hold null or non-finite components take no part; where
lengths differ, missing components count as 0, so an empty vector scores 0; rows with a null id are
no candidates and no queries; rows of equal id are not candidates for each other; equal scores go to
the smaller id; a query id on several rows is asked once, by its greatest vector; fewer candidates
than k give fewer rows; scores are exact and end at the bounds of a bigint; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace

PIVOTS, RINGS = 48, 32
PIVOT_SAMPLE = 4096
#: Annuli that a query has visited after each round; the last round takes all that its bound leaves.
ROUNDS = (1, 9)
#: Queries and vectors of one product.
QUERY_BLOCK = 1024
SEGMENT_ROWS = 32_768
SEED = 31
_EXACT = float(2**53)


def _usable(df: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(vec_id, v): finite vectors as array<double>."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(float("inf"))))
    return df.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Quantised rows of a list column, filled up with zeros to ``dim``."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return quantise(flat.reshape(-1, dim), scale)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return quantise(out, scale)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        far = int(gap.argmax())
        if gap[far] == 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, ((sample - sample[far]) ** 2).sum(1))
    return sample[chosen]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


class Space:
    """What every task knows of the index: pivots, ring borders and, once built, the annuli."""

    def __init__(self, dim: int, scale: int, longest: float, sample: np.ndarray, rows: int) -> None:
        self.dim, self.scale, self.longest = dim, scale, longest
        self.reach = float(np.sqrt(longest))
        self.kind = "<f4" if self.reach < 4096 else "<f8"  # integers below 2**24 are whole in 32 bits
        self.slack = 1e-6 * (1 + self.reach)
        lifted = self.lift(sample)
        self.pivots = choose_pivots(lifted, int(np.clip(rows // 128, 1, PIVOTS)))
        rings = int(np.clip(rows // (2048 * len(self.pivots)), 1, RINGS))
        d = _distances(lifted, self.pivots)
        near = d.argmin(1)
        share = np.arange(1, rings) / rings
        self.borders = np.array([np.quantile(d[near == p, p], share) if (near == p).any() else np.zeros(rings - 1) for p in range(len(self.pivots))])
        self.rings = rings

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))))

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(annulus, distance to its pivot) of every vector."""
        d = _distances(self.lift(x), self.pivots)
        near = d.argmin(1)
        distance = d[np.arange(len(x)), near]
        ring = (self.borders[near] <= distance[:, None]).sum(1)
        return near * self.rings + ring, distance

    def close(self, annulus: np.ndarray, low: np.ndarray, high: np.ndarray, segments: np.ndarray) -> None:
        """Take in the annuli that hold vectors."""
        self.annulus, self.low, self.high, self.segments = annulus, low, high, segments

    def radius(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The distance within which a vector must lie to score ``floor`` or more."""
        return np.sqrt(np.maximum((q * q).sum(1) + self.longest - 2 * floor, 0)) + self.slack

    def plan(self, q: np.ndarray, floor: np.ndarray, first: int, last: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(annulus, queries, their distances to its pivot) for the annuli that the queries visit now."""
        d = _distances(np.column_stack((q, np.zeros(len(q)))), self.pivots)[:, self.annulus // self.rings]
        gap = np.maximum(np.maximum(self.low - d, d - self.high), 0)
        order = np.argsort(gap, axis=1, kind="stable")
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.broadcast_to(np.arange(gap.shape[1]), gap.shape), 1)
        wanted = (turn >= first) & (gap <= self.radius(q, floor)[:, None])
        if last is not None:
            wanted &= turn < last
        for a in np.flatnonzero(wanted.any(0)).tolist():
            rows = np.flatnonzero(wanted[:, a])
            yield a, rows, d[rows, a]


def best_of(space: Space, k: int, q_id: np.ndarray, q: np.ndarray, floor: np.ndarray, to_pivot: np.ndarray, ids: np.ndarray, distance: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, id, score) of the k best of a segment, sorted by distance, for each query; and the products made."""
    radius = space.radius(q, floor)
    s = int(np.searchsorted(distance, (to_pivot - radius).min()))
    e = int(np.searchsorted(distance, (to_pivot + radius).max(), side="right"))
    ids, x = ids[s:e], x[s:e]
    if not len(ids):
        none = np.zeros(0, np.int64)
        return none, none, none, 0
    score = q @ x.T
    score[q_id[:, None] == ids[None, :]] = -np.inf
    margin = 0.0 if space.longest < _EXACT else 1e-9 * space.longest
    if len(ids) > k:
        cut = np.maximum(np.partition(score, -k, axis=1)[:, -k] - margin, floor - margin)
    else:
        cut = floor - margin
    row, col = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
    if space.longest < _EXACT:
        exact = score[row, col].astype(np.int64)
    else:  # beyond whole doubles: the candidates again, in integers of any size
        most = 2**63 - 1
        exact = np.array([max(-most, min(most, sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)))) for i, j in zip(row.tolist(), col.tolist(), strict=True)], np.int64)
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    return q_id[row[keep]], ids[col[keep]], exact[keep], score.size


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vector: str = "embedding", key: str = "vec_id", products: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among other rows.

    ``products`` adds up the inner products computed, to see what the bounds save.
    """
    spark = vectors.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    good, asked = _usable(vectors, vector, key, scale), _usable(queries, vector, key, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    rows, dim, longest = good.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not rows:
        return spark.createDataFrame([], result)
    dim = max(1, dim, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    picked = good.filter(F.rand(SEED) < 1.5 * PIVOT_SAMPLE / rows).limit(PIVOT_SAMPLE).collect() or good.limit(1).collect()
    sample = np.zeros((len(picked), dim))
    for r, p in zip(sample, picked, strict=True):
        r[: len(p["v"])] = p["v"]
    index = Space(dim, scale, longest, quantise(sample, scale), rows)
    sent = spark.sparkContext.broadcast(index)
    space = Workspace(spark, "topk")

    def key_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), known.dim, known.scale)
            annulus, distance = known.key(x)
            packed = pa.array([r.tobytes() for r in x.astype(known.kind)], pa.binary())
            slot = (np.arange(seen, seen + len(x)) * 2654435761) % (1 << 31)
            seen += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(annulus.astype(np.int64)), pa.array(slot), pa.array(distance), b.column("vec_id"), packed], names=["annulus", "slot", "distance", "vec_id", "vector"])

    keyed = space.save(good.mapInArrow(key_vectors, "annulus bigint, slot bigint, distance double, vec_id bigint, vector binary"), "keyed")
    rings = keyed.groupBy("annulus").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("annulus").collect()
    segments = np.array([-(-r["n"] // SEGMENT_ROWS) for r in rings])
    index.close(np.array([r["annulus"] for r in rings]), np.array([r["low"] for r in rings]), np.array([r["high"] for r in rings]), segments)
    sent = spark.sparkContext.broadcast(index)

    # one row a segment, its vectors sorted by distance to the pivot
    place = F.element_at(F.create_map(*[F.lit(int(v)) for r, s in zip(rings, segments, strict=True) for v in (r["annulus"], s)]), F.col("annulus"))
    parts = keyed.withColumn("part", F.col("annulus") * (1 << 24) + F.col("slot") % place)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("distance")
        one = [t.column(c).to_numpy() for c in ("vec_id", "distance")]
        vectors = b"".join(t.column("vector").to_pylist())
        return pa.table({"part": t.column("part")[:1], "ids": [one[0].tobytes()], "distances": [one[1].tobytes()], "vectors": [vectors]})

    store = space.save(parts.select("part", "distance", "vec_id", "vector").groupBy("part").applyInArrow(pack, "part bigint, ids binary, distances binary, vectors binary"), "segments")

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            packed = [r.tobytes() for r in _matrix(b.column("v"), known.dim, known.scale)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed, pa.binary())], names=["query_id", "q"])

    asked = space.save(asked.groupBy("vec_id").agg(F.max("v").alias("v")).mapInArrow(pack_queries, "query_id bigint, q binary"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found: DataFrame | None = None
    steps = [n for n in ROUNDS if n < len(rings)]
    for first, last in zip([0, *steps], [*steps, None], strict=True):
        if found is None:
            state = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("s")).select("query_id", F.get("s", F.lit(0)).cast("double").alias("floor"))
            state = asked.join(best, "query_id", "left").select("query_id", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

        def visit(batches: Iterator[pa.RecordBatch], first: int = first, last: int | None = last) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                for s in range(0, b.num_rows, 512):
                    c = b.slice(s, 512)
                    raw, ids = c.column("q"), c.column("query_id").to_numpy()
                    floor = c.column("floor").to_numpy()
                    q = np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(-1, known.dim)
                    for a, rows, d in known.plan(q, floor, first, last):
                        at = pa.array(rows)
                        for segment in range(int(known.segments[a])):
                            part = pa.array(np.full(len(rows), int(known.annulus[a]) * (1 << 24) + segment))
                            yield pa.RecordBatch.from_arrays([part, pa.array(ids[rows]), raw.take(at), pa.array(floor[rows]), pa.array(d)], names=["part", "query_id", "q", "floor", "to_pivot"])

        def block(t: pa.Table) -> pa.Table:
            one = {c: [t.column(c).to_numpy().tobytes()] for c in ("query_id", "floor", "to_pivot")}
            return pa.table({"part": t.column("part")[:1], "q": [b"".join(t.column("q").to_pylist())], **one})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                for r in range(b.num_rows):
                    raw = {c: b.column(c)[r].as_buffer() for c in ("query_id", "q", "floor", "to_pivot", "ids", "distances", "vectors")}
                    q_id, ids = np.frombuffer(raw["query_id"], np.int64), np.frombuffer(raw["ids"], np.int64)
                    q = np.frombuffer(raw["q"], "<f8").reshape(-1, known.dim)
                    x = np.frombuffer(raw["vectors"], known.kind).reshape(-1, known.dim).astype(np.float64)
                    floor, to_pivot, distance = (np.frombuffer(raw[c], np.float64) for c in ("floor", "to_pivot", "distances"))
                    *columns, made = best_of(known, k, q_id, q, floor, to_pivot, ids, distance, x)
                    if products is not None:
                        products.add(made)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        visits = state.mapInArrow(visit, "part bigint, query_id bigint, q binary, floor double, to_pivot double")
        visits = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        packed = visits.groupBy("part", "block").applyInArrow(block, "part bigint, q binary, query_id binary, floor binary, to_pivot binary")
        hits = packed.join(store.hint("merge"), "part").drop("part").mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
        hits = hits if found is None else hits.unionByName(found.drop("rank"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = space.save(hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "found")
    return found.select("query_id", "rank", "vec_id", "score")
