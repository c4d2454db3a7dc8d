"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the same
text or another. Positions carry ranks (64-bit names) of the string that starts there; Spark sorts
positions by rank and drops the unique ones, and the survivors are ranked anew by longer strings.

Round 1 ranks sparse positions only. A window is a start position p; its anchor is the position of
the least hash among the first ``SPREAD`` bytes of its string, which depends on the string alone,
so equal strings have their anchors at equal places. All windows of an anchor contain the bytes
[anchor, anchor + length - SPREAD], so a window can only repeat if the rank of those does.
Round 2 ranks surviving anchors by all bytes of all their windows: where that rank repeats, all
windows repeat. Round 3 takes one member of every class that shares round 1's rank but not round
2's, cuts its windows into blocks of ``BLOCK`` by distance to the anchor, and ranks the blocks in
the same two ways by their longer common bytes. Round 4 ranks single windows of what is still open
by the pair of names (first half, second half at the doubled offset) and keeps windows whose pair
occurs twice; that is the threshold, so it ends here.

Groups may have any size: classes are counted by partial aggregation, and looked up by joins whose
large keys Spark can split; no class is ever collected.

Defined cases: null and empty texts, and texts shorter than ``length``, keep all bytes; repeated
rows (equal id and text) are occurrences of their own; null ids are allowed; clashing column names
of the input are dropped (``strip_repeats`` keeps them); an empty table gives an empty result.

Joins of texts carry a merge hint, here and in the modules beside this one: both sides grow with the
corpus, and the compressed size of a Parquet table understates its texts, so no size check could
admit a broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Names, Workspace, tagged

LENGTH = 200
#: Start positions among whose hashes an anchor is the least; at most LENGTH - 8.
SPREAD = 128
GRAM = 8
#: Windows of one block in round 3.
BLOCK = 32
#: Windows handled at once: texts beyond it are cut with an overlap, which changes no result.
CHUNK = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    n = CHUNK + 4096
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, U(base), U)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


class _Text:
    """Names of byte ranges of one text (or chunk): polynomials over mixed 8-byte strings."""

    def __init__(self, b: np.ndarray) -> None:
        x = b.astype(U)
        x = x[:-1] | (x[1:] << U(8))
        x = x[:-2] | (x[2:] << U(16))
        x = x[:-4] | (x[4:] << U(32))
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(29)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(32)
        self.grams = x
        power, self.inverse = _powers()
        self.prefix = np.zeros(len(x) + 1, U)
        np.cumsum(x * power[: len(x)], out=self.prefix[1:])

    def name(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of the bytes [start, stop), each at least 8 long."""
        n = (self.prefix[stop - (GRAM - 1)] - self.prefix[start]) * self.inverse[start]
        n ^= n >> U(31)
        return (n * U(0xD6E8FEB86659FD93)).view(np.int64)


def _chunks(b: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for s in range(0, len(b) - length + 1, CHUNK):
        yield s, b[s : s + CHUNK + length - 1]


def anchors(b: np.ndarray, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core, whole, first window, number of windows) of every anchor of one text."""
    cores, wholes, lows, counts = [], [], [], []
    for at, part in _chunks(b, length):
        t = _Text(part)
        windows = len(part) - length + 1
        keys = (t.grams[: windows + spread - 1] & ~_POSITION) | np.arange(windows + spread - 1, dtype=U)
        padded = np.full(-(-len(keys) // spread) * spread, np.iinfo(U).max, U)
        padded[: len(keys)] = keys
        grid = padded.reshape(-1, spread)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], before[spread - 1 : spread - 1 + windows]) & _POSITION).astype(np.int64)
        low = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        high = np.append(low[1:], windows) - 1
        c = anchor[low]
        cores.append(t.name(c, c + (length - spread + 1)))
        wholes.append(t.name(low, high + length))
        lows.append(low + at)
        counts.append(high - low + 1)
    if not cores:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(x) for x in (cores, wholes, lows, counts))


def _by_chunk(raw: np.ndarray, lo: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int, _Text]]:
    """(indices, offset, names) of the parts of a text in which the given windows begin."""
    part = lo // CHUNK
    for k in np.unique(part).tolist():
        at = k * CHUNK
        yield np.flatnonzero(part == k), at, _Text(raw[at : at + CHUNK + 3 * length])


def blocks(raw: np.ndarray, lo: np.ndarray, n: np.ndarray, size: int = BLOCK, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, ...]:
    """Cut runs of windows, one anchor each, into blocks by distance to the anchor.

    Gives (index of the run, core, whole, first window, number of windows) of every block; core names
    the bytes that all windows at those distances share, whole the bytes of all windows of the block.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for index, at, t in _by_chunk(raw, lo, length):
        low, count = lo[index] - at, n[index]
        hashes = t.grams[low[:, None] + np.arange(spread)] & ~_POSITION
        anchor = low + hashes.argmin(1)
        nearest, farthest = anchor - (low + count - 1), anchor - low
        first = nearest // size
        parts = farthest // size - first + 1
        run = np.repeat(np.arange(len(index)), parts)
        k = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = anchor[run] - np.minimum(farthest[run], k * size + size - 1)
        stop = anchor[run] - np.maximum(nearest[run], k * size) + 1
        head = anchor[run] - k * size
        core = t.name(head, head + (length - size + 1)) ^ (k * 0x1E3779B97F4A7C15)
        for o, x in zip(out, (index[run], core, t.name(start, stop - 1 + length), start + at, stop - start), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def window_pairs(raw: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(index of the run, name of the first half, name of the second half, start) of every window."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    half = length // 2
    for index, at, t in _by_chunk(raw, lo, length):
        count = n[index]
        run = np.repeat(np.arange(len(index)), count)
        p = (lo[index] - at)[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        for o, x in zip(out, (index[run], t.name(p, p + half), t.name(p + half, p + length), p + at), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def merge_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the given ranges."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return list(zip(starts[first].tolist(), reach[last].tolist(), strict=True))


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans widened to the borders of UTF-8 characters, joined where they then touch."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        while s > 0 and text[s] & 0xC0 == 0x80:
            s -= 1
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        if out and s <= out[-1][1]:
            s = out.pop()[0]
        out.append((s, e))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out)


_MADE = {"_key", "_text", "_id", "_twice", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "_sure", "_reps"}
_RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
_SPAN = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("n", T.LongType())]))
_REP = T.ArrayType(T.StructType([T.StructField("core", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("n", T.LongType()), T.StructField("count", T.LongType())]))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _emit(batches: Iterator[pa.RecordBatch], rows, schema: pa.Schema, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from the column arrays that ``rows`` gives for one text after another."""
    parts: list[list[np.ndarray]] = []
    held = 0
    for b in batches:
        for columns in rows(b):
            parts.append(columns)
            held += len(columns[0])
            if held > most:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)
                parts, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=schema)


def _finish(text: bytes, sure: list[dict] | None, length: int, with_text: bool, characters: bool) -> tuple:
    starts = np.array([s["lo"] for s in sure or ()], np.int64)
    stops = starts + np.array([s["n"] for s in sure or ()], np.int64) + length - 1
    spans = merge_spans(starts, stops)
    kept = cut(text, spans) if spans else text
    left = None
    if with_text:
        left = cut(text, whole_characters(text, spans)) if characters and spans else kept
    return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), left


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, with_text: bool = True, characters: bool = False) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes, null unless ``with_text``).

    With ``characters``, kept leaves out every character of which any byte goes; the other columns do not change.
    """
    if length < 2 * GRAM + SPREAD:
        raise ValueError(f"length must be at least {2 * GRAM + SPREAD}")
    spark = docs.sparkSession
    space = Workspace(spark, "suffix")
    keep = [c for c in docs.columns if c != text and c.lower() not in _MADE]
    body = F.coalesce(F.col(text), F.lit("")).cast("string")
    first = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(*keep, first.alias("_id"), body.alias("_text"))
    # one name for rows of equal id and text: they remove the same spans
    content = F.concat(tagged(F.col("_id")), F.col("_text"))
    docs = Names(docs.select(content.alias("c")), space).add(docs, content, "_key").select(*keep, "_key", "_text")

    # round 1: rank anchors by the bytes that all their windows share
    anchor_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("core", "whole", "key", "lo", "n")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
            for key, t in zip(b.column("_key").to_pylist(), b.column("_text"), strict=True):
                raw = t.as_buffer()
                if len(raw) >= length:
                    core, whole, lo, n = anchors(np.frombuffer(raw, np.uint8), length)
                    yield [core, whole, np.full(len(core), key), lo, n]

        yield from _emit(batches, rows, _arrow(anchor_schema))

    found = space.save(docs.select("_key", "_text").mapInArrow(find, anchor_schema), "anchors")
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    cores = space.save(cores.filter("c > 1").select("core", (F.col("a") == F.col("b")).alias("single")), "cores")
    space.release()

    # round 2: rank the survivors by all bytes of all their windows
    alive = space.save(found.join(cores.hint("merge"), "core"), "alive")
    space.drop("*-anchors")
    space.release()
    open_ = alive.filter(~F.col("single"))
    classes = open_.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("key", "lo", "n")).alias("rep"))
    classes = space.save(classes.select("core", "whole", "count", "rep.key", "rep.lo", "rep.n"), "classes")
    repeated = classes.filter("count > 1").select("core", "whole")
    sure = alive.filter("single").select("key", "lo", "n").unionByName(open_.join(repeated, ["core", "whole"]).select("key", "lo", "n"))
    none = F.lit(None)
    span, rep = _SPAN.elementType.simpleString(), _REP.elementType.simpleString()
    info = sure.select("key", F.struct("lo", "n").alias("s"), none.cast(rep).alias("r")).unionByName(
        classes.select("key", none.cast(span).alias("s"), F.struct("core", "whole", "lo", "n", "count").alias("r"))
    )
    info = info.groupBy(F.col("key").alias("_key")).agg(F.collect_set("s").alias("_sure"), F.collect_set("r").alias("_reps"))
    info = space.save(info, "info")

    # texts meet what is known of them: most are done here, the rest waits for round 3
    own = [docs.schema[c] for c in keep]
    staged_schema = T.StructType([*own, *_RESULT, T.StructField("_key", T.LongType()), T.StructField("_text", T.BinaryType()), T.StructField("_sure", _SPAN), T.StructField("_reps", _REP)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(staged_schema)
        for b in batches:
            out: list[tuple] = []
            for key, t, s, r in zip(b.column("_key").to_pylist(), b.column("_text"), b.column("_sure").to_pylist(), b.column("_reps").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                if r:
                    waits = any(x["count"] == 1 for x in r)
                    done = (None,) * 5 if waits else _finish(raw, s, length, with_text, characters)
                    out.append((*done, key, raw, s if waits else None, r))
                else:
                    out.append((*_finish(raw, s, length, with_text, characters), key, None, None, None))
            columns = [b.column(c) for c in keep]
            made = [pa.array([o[i] for o in out], schema.field(len(keep) + i).type) for i in range(9)]
            yield pa.RecordBatch.from_arrays(columns + made, schema=schema)

    staged = space.save(docs.join(info.hint("merge"), "_key", "left").select(*keep, "_key", "_text", "_sure", "_reps").mapInArrow(settle, staged_schema), "staged")
    space.release()

    # round 3: one member of every class, in blocks of windows by distance to the anchor
    block_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("core", "whole", "key", "lo", "n", "count")])

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
            for key, t, reps in zip(b.column("_key").to_pylist(), b.column("_text"), b.column("_reps").to_pylist(), strict=True):
                lo, n, count = (np.array([r[c] for r in reps], np.int64) for c in ("lo", "n", "count"))
                run, core, whole, start, windows = blocks(np.frombuffer(t.as_buffer(), np.uint8), lo, n, length=length)
                yield [core, whole, np.full(len(run), key), start, windows, count[run]]

        yield from _emit(batches, rows, _arrow(block_schema))

    cut_up = space.save(staged.filter(F.size("_reps") > 0).select("_key", "_text", "_reps").mapInArrow(cut_blocks, block_schema), "blocks")
    cores = cut_up.groupBy("core").agg(F.sum("count").alias("c"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    cores = space.save(cores.filter("c > 1").select("core", (F.col("a") == F.col("b")).alias("single")), "cores")
    alive = space.save(cut_up.join(cores, "core"), "alive")
    open_ = alive.filter(~F.col("single"))
    classes = open_.groupBy("core", "whole").agg(F.sum("count").alias("count"), F.min(F.struct("key", "lo", "n")).alias("rep"))
    classes = space.save(classes.select("core", "whole", "count", "rep.key", "rep.lo", "rep.n"), "classes")
    repeated = classes.filter("count > 1").select("core", "whole")
    late = alive.filter("single AND count = 1").select("key", "lo", "n").unionByName(
        open_.filter("count = 1").join(repeated, ["core", "whole"]).select("key", "lo", "n")
    )

    # round 4: single windows, by pairs of names at the doubled offset
    rest = classes.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("core", "lo", "n", "count")).alias("_runs"))
    pair_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("core", "first", "second", "key", "start", "count")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
            for key, t, runs in zip(b.column("_key").to_pylist(), b.column("_text"), b.column("_runs").to_pylist(), strict=True):
                core, lo, n, count = (np.array([r[c] for r in runs], np.int64) for c in ("core", "lo", "n", "count"))
                run, first, second, start = window_pairs(np.frombuffer(t.as_buffer(), np.uint8), lo, n, length)
                yield [core[run], first, second, np.full(len(run), key), start, count[run]]

        yield from _emit(batches, rows, _arrow(pair_schema))

    texts = staged.filter(F.size("_reps") > 0).select("_key", "_text").join(space.save(rest, "rest").hint("merge"), "_key")
    pairs = space.save(texts.mapInArrow(windows, pair_schema), "pairs")
    twice = pairs.groupBy("core", "first", "second").agg(F.sum("count").alias("c")).filter("c > 1").select("core", "first", "second")
    twice = space.save(twice, "twice")
    late = late.unionByName(pairs.filter("count = 1").join(twice, ["core", "first", "second"]).select("key", F.col("start").alias("lo"), F.lit(1).cast("bigint").alias("n")))
    late = space.save(late.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("lo", "n")).alias("_late")), "late")
    space.release()

    done_schema = T.StructType([*own, *_RESULT])

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(done_schema)
        for b in batches:
            out = []
            for t, s, late in zip(b.column("_text"), b.column("_sure").to_pylist(), b.column("_late").to_pylist(), strict=True):
                spans = [*(s or ()), *(late or ())]
                out.append(_finish(t.as_buffer().to_pybytes(), spans, length, with_text, characters))
            made = [pa.array([o[i] for o in out], schema.field(len(keep) + i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, schema=schema)

    waiting = staged.filter(F.col("n_bytes").isNull()).join(late.hint("merge"), "_key", "left").select(*keep, "_text", "_sure", "_late")
    names = [f.name for f in done_schema]
    return staged.filter(F.col("n_bytes").isNotNull()).select(*names).unionByName(waiting.mapInArrow(complete, done_schema))


def prefix_doubling(docs: DataFrame, text: str = "text", length: int = LENGTH, space: Workspace | None = None) -> DataFrame:
    """(_key, p): every byte position whose string of ``length`` bytes starts elsewhere too, by plain prefix doubling.

    Positions carry the rank of their first 8 bytes; in each round Spark sorts pairs of the ranks at p
    and at p plus a doubled offset and ranks them anew (a rank is the least position that has the
    pair), and positions with a pair of their own drop out. The last offset reaches the threshold.

    This is the reference that ``remove_repeats`` is held against. Its first rounds keep nearly every
    byte of a corpus as a row, which no disk budget near the input's size can hold (README).
    """
    space = space or Workspace(docs.sparkSession, "doubling")
    body = F.coalesce(F.col(text), F.lit("")).cast("string")
    rows = space.save(docs.select(F.monotonically_increasing_id().alias("_key"), body.alias("_text")), "texts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def positions(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
            for key, t in zip(b.column("_key").to_pylist(), b.column("_text"), strict=True):
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                if len(raw) >= length:
                    at = np.arange(len(raw) - GRAM + 1)
                    first = np.lib.stride_tricks.sliding_window_view(raw, GRAM)
                    yield [np.full(len(at), key), at, np.ascontiguousarray(first).view("<i8").ravel()]

        yield from _emit(batches, positions, pa.schema([("_key", pa.int64()), ("p", pa.int64()), ("rank", pa.int64())]))

    ranks, known = rows.mapInArrow(spread, "_key bigint, p bigint, rank bigint"), GRAM
    ranks = space.save(ranks, "ranks").withColumn("rank", F.struct(F.col("rank").alias("_key"), F.lit(0).cast("bigint").alias("p")))
    while known < length:
        step = min(known, length - known)
        there = ranks.select("_key", (F.col("p") - step).alias("p"), F.col("rank").alias("second"))
        pairs = space.save(ranks.join(there, ["_key", "p"]).select("_key", "p", F.col("rank").alias("first"), "second"), "pairs")
        classes = pairs.groupBy("first", "second").agg(F.min(F.struct("_key", "p")).alias("rank"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        ranks = space.save(pairs.join(classes, ["first", "second"]).select("_key", "p", "rank"), "ranks")
        known += step
    return ranks.select("_key", "p")


def strip_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the same columns and the repeated bytes taken out of the text.

    A character of which any byte goes, goes; all others stay as they are, U+FFFD included.
    """
    rest = F.struct(*[c for c in docs.columns if c != text]).alias("_lodestone_row")
    own = [F.col("doc_id")] if "doc_id" in docs.columns else []
    out = remove_repeats(docs.select(*own, rest, text), text, length, characters=True)
    return out.select(*[F.col("kept").cast("string").alias(text) if c == text else F.col(f"_lodestone_row.`{c}`").alias(c) for c in docs.columns])
