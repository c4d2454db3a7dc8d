"""Byte-level BPE: encode and decode whole texts by replaying merges over many words at once.

A text is cut by the tokenizer's pattern; the distinct pieces of an Arrow batch that are not yet
known form one corpus. An inverted index from the rank of a token pair to its positions lets every
merge be applied in rank order at all its positions, touching only the two neighbours of each. The
work depends on the number of merges, not on the square of a piece's length, so texts without white
space are no special case. Ids of pieces are remembered up to a fixed number of pieces and bytes.

Defined cases: null and empty texts have no tokens; repeated rows are encoded row by row; other
columns are carried along unless their names clash with those made here; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces and bytes that a worker remembers; beyond them it forgets all and starts anew.
MEMO_PIECES = 200_000
MEMO_BYTES = 16_000_000
NO_RANK = 1 << 40


class _Places(dict):
    """Piece to place, in order of first sight."""

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        return place


class MergeReplay:
    """Encoder and decoder of one vocabulary of ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if self.byte_ids.min() < 0:
            raise ValueError("the vocabulary lacks some single bytes")
        self.base = max(self.tokens) + 1
        # every pair of tokens that makes a token, as one sorted array
        keys, made = [], []
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                left, right = ranks.get(whole[:i]), ranks.get(whole[i:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(made, np.int64)[order], NO_RANK)
        self._forget()

    def _forget(self) -> None:
        self._places = _Places()
        self._packed: list[bytes] = []
        self._bytes = 0

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All merges of all words, lowest rank first: ids of all words in a row, and ids per word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = ends[lengths > 0] - 1
        after[last] = -1
        before[last[:-1] + 1] = -1
        pair = np.full(n, NO_RANK)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.rank_of_pairs(token[inner], token[inner + 1])
        # the inverted index: rank to runs of positions
        found = np.flatnonzero(pair != NO_RANK)
        found = found[np.argsort(pair[found], kind="stable")]
        ranks, starts = np.unique(pair[found], return_index=True)
        index: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(ranks.tolist(), np.split(found, starts[1:]), strict=False)}
        heap = ranks.tolist()
        rank_of_pairs = self.rank_of_pairs
        while heap:
            rank = heapq.heappop(heap)
            runs = index.pop(rank)
            p = runs[0] if len(runs) == 1 else np.unique(np.concatenate(runs))
            p = p[pair[p] == rank]  # others were changed by a neighbour's merge
            if not len(p):
                continue
            q = after[p]
            if len(p) > 1 and (pair[q] == rank).any():  # overlapping pairs: the leftmost wins
                taken: set[int] = set()
                keep = []
                for x, y in zip(p.tolist(), q.tolist(), strict=True):
                    if x not in taken:
                        taken.add(y)
                        keep.append(x)
                p = np.array(keep)
                q = after[p]
            follow, prior = after[q], before[p]
            token[p] = rank
            token[q] = -1
            pair[q] = pair[p] = NO_RANK
            after[p] = follow
            some = follow >= 0
            before[follow[some]] = p[some]
            touched = np.concatenate((p[some], prior[prior >= 0]))
            if not len(touched):
                continue
            touched = touched[token[touched] >= 0]  # a left neighbour may itself have merged into its own
            made = rank_of_pairs(token[touched], token[after[touched]])
            pair[touched] = made
            real = made != NO_RANK
            if real.any():
                touched, made = touched[real], made[real]
                if len(touched) > 1:
                    order = np.argsort(made, kind="stable")
                    touched, made = touched[order], made[order]
                    cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
                    parts = np.split(touched, cuts) if len(cuts) else [touched]
                    keys = made[np.concatenate(([0], cuts))].tolist()
                else:
                    parts, keys = [touched], made.tolist()
                for r, x in zip(keys, parts, strict=True):
                    if r in index:
                        index[r].append(x)
                    else:
                        index[r] = [x]
                        heapq.heappush(heap, r)
        alive = token >= 0
        sums = np.concatenate(([0], np.cumsum(alive)))
        return token[alive].astype("<u4"), sums[ends] - sums[ends - lengths]

    def _learn(self) -> None:
        """Packed ids of the pieces seen since the last call, by one replay."""
        new = list(islice(reversed(self._places), len(self._places) - len(self._packed)))[::-1]
        if not new:
            return
        raw = [p.encode("utf-8") for p in new]
        whole = list(map(self.ranks.get, raw))
        rest = [b for b, r in zip(raw, whole, strict=True) if r is None]
        flat, counts = self.replay(rest) if rest else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        data, at, sizes = flat.tobytes(), 0, iter((4 * counts).tolist())
        for r in whole:
            if r is not None:
                self._packed.append(struct.pack("<I", r))
            else:
                size = next(sizes)
                self._packed.append(data[at : at + size])
                at += size
        self._bytes += sum(map(len, raw))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self._packed) > MEMO_PIECES or self._bytes > MEMO_BYTES:
            self._forget()
        place, split = self._places.__getitem__, self.split
        cut = [array("I", map(place, split(t))) if t else () for t in texts]
        self._learn()
        get = self._packed.__getitem__
        return [b"".join(map(get, places)) for places in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I"))) if packed else b""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> MergeReplay:
    """One codec a worker and vocabulary."""
    return MergeReplay(load_ranks(path), pattern)


def _groups(texts: list[str | None], most_chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """Texts in runs of bounded size, so that few very long ones do not meet in memory."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= most_chars:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ids (binary), n_tokens, ids_sha256 and decoded_sha256.

    ``vocabulary`` is a path that every executor has (a file of base64 tokens and ranks).
    The decoded digest is of the ids decoded again, not of the text.
    """
    made = {"ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    keep = [c for c in docs.columns if c != text and c.lower() not in made]
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            ids: list[bytes] = []
            for group in _groups(batch.column(text).to_pylist()):
                ids.extend(bpe.encode_batch(group))
            columns = [batch.column(c) for c in keep]
            columns.append(pa.array(ids, pa.binary()))
            columns.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
            columns.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, text).mapInArrow(run, schema)
