"""Quality scores by nearest-neighbour voting in a latent space.

A text becomes counts of terms: hashed words, hashed runs of four character classes, and how words
repeat. Truncated singular vectors of a bounded labelled sample (latent semantic analysis) map
counts to a short vector. Labelled vectors are broadcast (their number is bounded by parameters),
every document gets exact cosine products with all of them in blocks, and its nearest neighbours
vote with weights that grow with their similarity.

Defined cases: null and empty texts have only a constant term and are scored like any other; labels
that are null or not 0 or 1 are ignored; a document with several labels counts as its lowest; equal
ids in the documents are scored row by row; without any label every score is 0.5; an empty table
gives an empty result; columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that are used, a bound whatever the size of the tables.
SAMPLE_PER_CLASS = 1500
NEIGHBOURS = 15
LATENT = 40
THRESHOLD = 0.3
FOLDS = 5
SHAPES, WORDS, REPEATS = 1024, 896, 16
TERMS = SHAPES + WORDS + REPEATS + 1
U = np.uint64

_CLASS = np.full(256, 9, np.uint32)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3), (b"\n\r\x0b\x0c", 4), (b"\t", 5), (b".,;:'\"-()", 6), (b"!?", 7), (b"#*$%&|<>@^_~=+/\\{}[]`", 8)):
    for _b in _chars:
        _CLASS[_b] = _k
_CLASS[128:192] = 10  # further bytes of a character
_CLASS[192:] = 11
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def term_counts(raw: bytes, block: int = 1 << 20) -> np.ndarray:
    """Weights of the terms of one whole text, each family of length one."""
    out = np.zeros(TERMS, np.float32)
    out[-1] = 0.15  # the constant term
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return out
    shapes = np.zeros(SHAPES)
    for s in range(0, len(b), block):
        c = _CLASS[b[s : s + block + 3]]
        if len(c) < 4:
            c = np.concatenate((c, np.full(4 - len(c), 3, np.uint32)))
        g = (c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:]
        shapes += np.bincount(((g * np.uint32(2654435761)) >> 22), minlength=SHAPES)[:SHAPES]
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    n = len(start)
    if n:
        # a word's hash: sum of its mixed bytes, each weighed by its place in the word
        value = (b.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        value ^= value >> U(29)
        gaps = np.diff(np.concatenate(([0], start, [len(b)])))
        offset = (np.arange(len(b)) - np.repeat(np.concatenate(([0], start)), gaps)).astype(U)
        value *= offset * U(2) + U(0xD6E8FEB86659FD93)
        total = np.concatenate((np.zeros(1, U), np.cumsum(value)))
        words = total[stop] - total[start]
        words ^= words >> U(31)
        words *= U(0xBF58476D1CE4E5B9)
        bag = np.sqrt(np.bincount(((words >> U(32)) % U(WORDS)).astype(np.int64), minlength=WORDS))
        out[SHAPES : SHAPES + WORDS] = bag / max(np.linalg.norm(bag), 1e-9)
        repeats = np.zeros(REPEATS)
        again = int((words[1:] == words[:-1]).sum())
        distinct = len(np.unique(words))
        repeats[0], repeats[1] = again / n, 1 - again / n
        repeats[2 + min(6, int(7 * distinct / n))] = 0.5
        repeats[9 + min(6, int(np.log2(n) / 2))] = 0.2  # length, coarsely
        out[SHAPES + WORDS : -1] = repeats / np.linalg.norm(repeats)
    shapes = np.sqrt(shapes)
    out[:SHAPES] = 1.5 * shapes / max(np.linalg.norm(shapes), 1e-9)
    return out


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.stack([term_counts(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts])


@dataclass(frozen=True)
class Model:
    """What is broadcast: the map to the latent space, labelled unit vectors, labels and their weights."""

    basis: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        out = np.full(len(x), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for s in range(0, len(x), block):
            cosine = self.project(x[s : s + block]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            close = np.take_along_axis(cosine, near, 1).clip(0, 1) ** 8 + 1e-6
            vote = close * self.weights[near]
            out[s : s + block] = ((vote * self.labels[near]).sum(1) / vote.sum(1)).clip(0, 1)
        return out


def fit(x: np.ndarray, labels: np.ndarray, class_sizes: tuple[int, int] | None = None, seed: int = 5) -> Model:
    """Latent vectors of a labelled sample by randomised truncated singular value decomposition."""
    if not len(x):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros(TERMS, np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    mean = x.mean(0)
    centred = x - mean
    width = min(LATENT, len(x), TERMS)
    q = centred @ np.random.default_rng(seed).standard_normal((TERMS, min(width + 16, TERMS))).astype(np.float32)
    for _ in range(3):
        q = centred @ (centred.T @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    basis = np.linalg.svd(q.T @ centred, full_matrices=False)[2][:width].T.astype(np.float32)
    z = centred @ basis
    vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    sizes = class_sizes or (int((labels == 0).sum()), int((labels == 1).sum()))
    drawn = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())])
    return Model(basis, mean, vectors, labels.astype(float), (np.array(sizes) / drawn)[labels.astype(int)])


def fold_of(key: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds (null ids are in fold 0)."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % FOLDS, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on labels outside fold 0, a bounded sample of each class in order of a hash of the id."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold_of(F.col("id")) != 0))
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("id", F.lit(3)), F.col("id")]
    drawn = known.filter("y = 0").orderBy(*order).limit(per_class).unionByName(known.filter("y = 1").orderBy(*order).limit(per_class))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = [r.astype("<f2").tobytes() for r in _matrix(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("id"), pa.array(x, pa.binary())], names=["y", "id", "x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(drawn), "id").select("y", "id", "text").mapInArrow(featurise, f"y int, id {kind}, x binary")
    # rows of one id may be many: one of them stands for it
    found = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy(*order).collect()
    x = np.stack([np.frombuffer(r["x"], "<f2") for r in found]).astype(np.float32) if found else np.zeros((0, TERMS), np.float32)
    return fit(x, np.array([r["y"] for r in found], np.int64), (sizes.get(0, 0), sizes.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                value = sent.value.score(_matrix(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = docs.select(key, (fold_of(F.col(key)) == 0).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")
