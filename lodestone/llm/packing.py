"""Pack documents into training sequences by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are the powers of two that add up to its
length, none above the longest sequence: whole sequences first, then the binary digits of the rest from
the greatest down. A piece is a sequence by itself. Equal lengths make a bucket, so a batch is taken from one
bucket, needs no padding at all, and no sequence crosses documents.

Sequences are numbered by bucket (longest first) without gaps: a task counts its pieces of each length
while it cuts them, and the sums over tasks before it, a table of tasks by lengths, shift its numbers.

The tokenizer splits texts into words, digits and marks before it merges, so equal pieces give equal ids wherever
they stand: a task encodes each distinct piece of a run of texts once, by the library, and remembers
pieces within a bound.

Defined cases: a null or empty text is one piece, the end id alone; very long texts are encoded whole,
and no piece crosses documents; repeated rows are packed each by itself; a null id stays null; an empty
table gives no pieces; columns other than the id and the text are dropped, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace

#: Fixed by contract.
LONGEST = 2048
END_ID = 1
#: Characters of text that a task encodes at once, and pieces of a generation that a worker remembers (and those of one such run more).
RUN_CHARS = 4_000_000
KNOWN_WORDS = 450_000
#: ASCII white space separates pieces of every pre-tokenizer that splits at ``\s``.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Plain characters: ASCII, and letters and quotation marks that no normalization changes. Of them, letters are
#: a-z and those from a grave to y with diaeresis, digits are 0-9, and white space is ASCII.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ«»¡¿–—‘’“”…]*")
#: Fixed by the vocabulary: how it splits a text in lower case, for plain characters.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[^\x20\x09-\x0Da-zß-öø-ÿ0-9]+|[0-9]")
#: What special tokens begin with: texts that have it are split at white space alone, and the library finds them.
SPECIAL = "<|"


class WordEncoder:
    """Token ids of texts, little-endian 32-bit, each distinct piece encoded once while it is remembered.

    Right for tokenizers that lower letters, drop white space and split as ``PIECE`` does: texts of plain
    characters are split by it, all others at white space alone, and the library splits those words itself.
    Pieces are remembered in two generations, so that frequent ones stay when the older one goes.
    """

    def __init__(self, vocabulary: str, known: int = KNOWN_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known, self.ids, self.older = known, {}, {}

    def _learn_words(self, words: list[str]) -> None:
        for word, made in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.ids[word] = np.array(made.ids, "<u4").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Many in one call with a digit between them: a digit is a piece by itself, so no other piece has its id."""
        digits = [p for p in pieces if p in "0123456789"]
        self._learn_words(digits)
        others = list(set(pieces).difference(digits))
        mark = self.tokenizer.encode("0", add_special_tokens=False).ids
        groups = [others[i : i + 1000] for i in range(0, len(others), 1000)]
        for group, made in zip(groups, self.tokenizer.encode_batch_fast([" 0 ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(made.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == mark[0]), len(ids)).tolist() if len(mark) == 1 else []
            if len(ends) != len(group):
                self._learn_words(group)
                continue
            flat, start = ids.tobytes(), 0
            for piece, end in zip(group, ends, strict=True):
                self.ids[piece] = flat[start : 4 * end]
                start = 4 * end + 4

    def _new(self, lists: list[list[str]]) -> list[str]:
        """Pieces that are not known; those of the older generation are, from now on."""
        new = set(filterfalse(self.ids.__contains__, chain.from_iterable(lists)))
        again = new.intersection(self.older)
        self.ids.update((p, self.older[p]) for p in again)
        return list(new - again)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) > self.known:
            self.ids, self.older = {}, self.ids
        plain = [SPECIAL not in t and PLAIN.fullmatch(t) is not None for t in texts]
        split = [PIECE.findall(t.lower()) if p else WORD.findall(t) for t, p in zip(texts, plain, strict=True)]
        self._learn_pieces(self._new([s for s, p in zip(split, plain, strict=True) if p]))
        self._learn_words(self._new([s for s, p in zip(split, plain, strict=True) if not p]))
        at = self.ids.__getitem__
        return [b"".join(map(at, pieces)) for pieces in split]


@cache
def encoder(vocabulary: str) -> WordEncoder:
    """One a worker process."""
    return WordEncoder(vocabulary)


def piece_lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, greatest first, that add up to ``tokens``; ``longest`` as often as it fits."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


_PIECE = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("place", pa.int64())]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of bounded size, each with the place of its first."""
    run, held, first = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t or "")
        held += len(run[-1])
        if held >= RUN_CHARS:
            yield first, run
            run, held, first = [], 0, i + 1
    if run:
        yield first, run


def cut(docs: DataFrame, vocabulary: str, text: str = "text", longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids, ids_crc32, doc_tokens, and task and place (among its task's pieces of that length)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence is no power of two")
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.IntegerType()), *[T.LongType()] * 4]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, k) for (n, _), k in zip(_PIECE, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, placed = encoder(vocabulary), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, texts in _runs(batch.column(1).to_pylist()):
                rows: dict[str, list] = {n: [] for n, _ in _PIECE}
                owner, held = [], []
                for i, ids in enumerate(words.encode(texts)):
                    ids, start = ids + end, 0
                    held.append(ids)
                    for length in piece_lengths(len(ids) // 4, longest):
                        owner.append(first + i)
                        place = placed[length] = placed.get(length, -1) + 1
                        of = (start, length, None, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, task, place)
                        for n, v in zip(rows, of, strict=True):
                            rows[n].append(v)
                        start += length
                flat = np.frombuffer(b"".join(held), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(rows["length"])]).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)) if n == "ids" else pa.array(rows[n], k) for n, k in _PIECE]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=["doc_id", *[n for n, _ in _PIECE]])

    return docs.select("doc_id", text).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, text: str = "text", longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """One row a piece, which is a sequence: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id and offset.

    ``vocabulary`` is a path that every executor has. Sequences of one length have neighbouring numbers.
    """
    space = Workspace(docs.sparkSession, "packing")
    pieces = space.save(cut(docs, vocabulary, text, longest, end_id), "pieces")
    counts = space.save(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("pieces")), "counts")
    # at most a row for each power of two up to the longest
    before = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("pieces").alias("all")).select("length", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("bucket_start"))
    tasks = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.join(F.broadcast(buckets), "length").select("length", "task", (F.col("bucket_start") + F.coalesce(F.sum("pieces").over(tasks), F.lit(0))).alias("shift"))
    numbered = pieces.join(shifts, ["length", "task"]).withColumn("sequence_id", F.col("shift") + F.col("place"))
    return numbered.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))


def write_buckets(packed: DataFrame, folder: str) -> None:
    """The sequences as Parquet, one folder for each length, to be read in batches of one length."""
    packed.write.partitionBy("length").parquet(folder)
