"""Spelling variants of a corpus' words: near words by a rare-first prefix filter on bigrams.

Words are counted over whole texts. Their bigrams are ordered by how many words have them, rarest
first, and a word is looked up by its three rarest only. One edit changes at most two bigrams of
a word, so two near words keep at least one of the three, and it keeps its place: counted from the start
if the edit lies behind it, from the end if the edit lies before it. The place limit is therefore stated as
an equality, of all that lies on the bigram's unedited side, and of one half of what lies on the other
side (one edit leaves a half as it was). So the join meets only words that agree in more than half their
letters, no frequent bigram makes a large group, and no pair of near words is lost. Candidates are
verified by edit distance.

A word's form is its most frequent near word if that is frequent enough; roots follow forms to the
last by doubling, as forms grow by a factor at each step.

Defined cases: null texts have no words; a null id counts as the empty string; repeated rows count each
time; ties between near words go to the least in code-point order; very long texts are read whole and very
long words take part as any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace

#: Fixed by contract: runs of letters, which of them are damaged, and what counts as a word and as a form.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE_EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_FACTOR = 5
#: One edit changes two bigrams, so of three one is left.
RAREST = 3
#: Doublings of a root's path: counts are below 2**63 and grow fivefold at each step, so 28 steps are the most.
DOUBLINGS = 5


def damaged(doc_id: Column, run: Column) -> Column:
    """``run`` in lower case (A-Z), without one letter if the checksum of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE_EVERY == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word of the corpus."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    # a run too short by itself cannot become a word
    runs = runs.filter(F.char_length("run") >= least_length)
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How many words have each bigram: letters are of an alphabet of 90, so these are at most 8,100 numbers."""
    letters = F.split("word", "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters) - 1), lambda a, b: F.concat(a, b))
    grams = words.select(F.explode(F.array_distinct(pairs)).alias("gram")).filter("gram IS NOT NULL")
    return {r.gram: r.often for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).collect()}


def rare_keys(word: str, often: dict[str, int]) -> set[tuple[bool, int]]:
    """(own, key) of the three rarest bigrams of a word: two near words share a key that is ``own`` to one of them.

    Of a bigram that repeats, the first place counts for what lies before it and the last for what lies behind:
    if any of its places is on one side of the edit, the outermost is. ``own`` says that the shorter rest is this word's.
    """
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    count: dict[str, int] = {}
    for i in range(len(word) - 1):
        g = word[i : i + 2]
        first.setdefault(g, i)
        last[g] = i
        count[g] = count.get(g, 0) + 1
    keys, taken = set(), 0
    for g in sorted(first, key=lambda g: (often[g], g)):
        if taken >= RAREST:
            break
        taken += count[g]
        # the side that the edit leaves alone, and the rest
        for side, same, rest in (("<", word[: first[g] + 2], word[first[g] + 2 :]), (">", word[last[g] :], word[: last[g]])):
            for own in (True, False) if rest else (True,):
                least = len(rest) - (not own)
                half = least // 2
                for part in ("<" + rest[:half], ">" + rest[len(rest) - half :]):
                    keys.add((own, xxhash.xxh64_intdigest(f"{side} {same} {least} {part}".encode()) - 2**63))
    return keys


def join_keys(words: DataFrame) -> DataFrame:
    """(word, n, own, key): under each key, words that may be one edit apart."""
    often = bigram_counts(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [(i, own, key) for i, word in enumerate(part.column(0).to_pylist()) for own, key in rare_keys(word, often)]
                row, own, key = zip(*made, strict=True)
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(own), pa.array(key, pa.int64())], names=["word", "n", "own", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, own boolean, key bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): pairs of words exactly one edit apart, both ways round.

    The hint: a word has some twenty keys, and Spark sizes the keys by the words' compressed file, so it would broadcast them.
    """
    keys = join_keys(words).hint("merge")
    a, b = keys.alias("a"), keys.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & (F.col("a.own") | F.col("b.own")))
    pairs = pairs.filter(F.levenshtein("a.word", "b.word", 1) == 1)
    pairs = pairs.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """(word, form) to (word, root): the end of each word's chain of forms. Words without a form are no rows of either."""
    at = forms.select("word", F.col("form").alias("root"))
    for i in range(DOUBLINGS):
        at = space.save(at, f"roots{i}")
        onward = at.select(F.col("word").alias("_from"), F.col("root").alias("_to")).hint("merge")
        at = at.join(onward, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root"))
    return at


def variants(docs: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """Per word of the corpus: word, n, n_near, form, form_n and root."""
    if least_length < RAREST + 1:
        raise ValueError("an edit may change every bigram of a word this short")
    space = Workspace(docs.sparkSession, "spelling")
    words = space.save(word_counts(docs, text, least_length, least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near.hint("merge"), F.col("word") == F.col("_word"), "left")
    has = -F.col("best.less") >= factor * F.col("n")
    formed = space.save(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.filter("form IS NOT NULL"), space).withColumnRenamed("word", "_word")
    out = formed.join(ends.hint("merge"), F.col("word") == F.col("_word"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
