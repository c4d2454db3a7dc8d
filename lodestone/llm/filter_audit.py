"""How filters interact: what every order of them removes, from one count a subset of failed filters.

Each document becomes a bit mask of the filters that it fails. Documents are counted by part and mask
(and, of those, the good and the toxic ones), so a part is 2**n counts however many rows it has. The
subset-zeta transform, one butterfly a bit, turns the counts into sums over all subsets: what survives
a set of filters is the sum over the subsets of the other ones. A step of an order is the difference
between the survivors of two neighbouring sets, and so are the labels that it loses.

A later copy (``COPIES``) is found by aggregation alone: rows meet by (text digest, part, labels, id), then by
digest, with partial sums before each shuffle, so a text that a third of all rows hold is no hot task.

Defined cases: a null text is empty; a null part counts as the empty string; a row with a null id is
a copy of no other and nothing is a copy of it alone, as no id is smaller than null; rows of equal id
and text are no copies of each other; a label counts if any row of ``labels`` for the id has it, and
null labels do not; very long texts are read whole; an empty table has no parts and gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE_CLASS

#: The filter that fails later copies of a text.
COPIES = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


#: Fixed by contract: when a text fails a filter, from the text and its words.
FAILURES: Mapping[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def _judged(docs: DataFrame, failures: Mapping[str, Callable[[Column, Column], Column]], part: str, text: str) -> DataFrame:
    """(doc_id, part, digest, mask) of every row; the mask has a bit for each filter that reads the text alone."""
    d = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("words", _words(F.col("text")))
    mask = F.lit(0)
    for bit, fails in enumerate(failures.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << bit).otherwise(0)
    return d.select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"), mask.alias("mask"))


def _labelled(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """``judged`` with the flags good and toxic. Null ids match nothing and are spread by their digest."""
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint"))
    own = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    own = own.withColumn("_spread", F.lit(0).cast("bigint"))
    d = judged.withColumn("spread", spread).join(own, (F.col("doc_id") == F.col("_id")) & (F.col("spread") == F.col("_spread")), "left")
    return d.select("doc_id", "spread", "part", "digest", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", failures: Mapping[str, Callable[[Column, Column], Column]] = FAILURES) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): rows by the filters that they fail; the highest bit is a later copy."""
    copy_bit = 1 << len(failures)
    alike = ["digest", "part", "mask", "good", "toxic"]
    d = _labelled(_judged(docs, failures, part, text), labels)
    by_id = d.groupBy("doc_id", "spread", *alike).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first)
    # a text has at most a row for each part and label here
    groups = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    originals = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - originals).alias("n")))
    rows = groups.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    labelled = {"n_good": "good", "n_toxic": "toxic"}
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(a) for a, c in labelled.items()])


def subset_zeta(values: Column, bits: int) -> Column:
    """Of an array of 2**bits numbers: at each index, the sum over the indices whose bits are a subset of its own."""

    def butterfly(sums: Column, bit: Column) -> Column:
        weight = F.call_function("shiftleft", F.lit(1), bit)
        return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(weight) != 0, F.get(sums, i - weight)).otherwise(F.lit(0).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), values, butterfly)


def survivors(counts: DataFrame, bits: int) -> DataFrame:
    """One row a part: arrays n, n_good and n_toxic of the sums over subsets of failed filters.

    What is left after a set of filters is the element of the set's complement.
    """
    names = ["n", "n_good", "n_toxic"]
    by_part = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in names])


    def whole(name: str) -> Column:
        masks = F.sequence(F.lit(0), F.lit(2**bits - 1))
        return F.transform(masks, lambda m: F.coalesce(F.element_at(F.col(name), m), F.lit(0).cast("bigint"))).alias(name)

    return by_part.select("part", *map(whole, names)).select("part", *[subset_zeta(F.col(c), bits).alias(c) for c in names])


def every_order(left: DataFrame, filters: str) -> DataFrame:
    """Every step of every order of ``filters``, from the arrays of ``survivors``."""
    bits, everything = len(filters), 2 ** len(filters) - 1
    after = lambda c, gone: F.get(F.col(c), F.lit(everything) - gone)
    # by how many orders a filter comes right after a set of k others
    orders = F.array(*[F.lit(factorial(k) * factorial(bits - 1 - k)).cast("bigint") for k in range(bits)])
    subsets = F.sequence(F.lit(0), F.lit(everything))

    def summed(bit: int) -> Column:
        others = F.filter(subsets, lambda s: s.bitwiseAND(F.lit(bit)) == 0)
        return F.aggregate(others, F.lit(0).cast("bigint"), lambda total, s: total + F.get(orders, F.bit_count(s)) * (after("n", s) - after("n", s + bit)))

    left = left.withColumn("_summed", F.array(*[summed(1 << i) for i in range(bits)]))
    names = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = left.withColumn("filter_order", F.explode(names)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(bits))))
    place = lambda x: F.instr(F.col("filter_order"), x)
    before, own, index = F.lit(0), F.lit(0), F.lit(0)
    for i, x in enumerate(filters):
        before = before + F.when(place(x) < F.col("step"), 1 << i).otherwise(0)
        own = own + F.when(place(x) == F.col("step"), 1 << i).otherwise(0)
        index = index + F.when(place(x) == F.col("step"), i).otherwise(0)
    rows = rows.withColumns({"_before": before, "_own": own, "_index": index})
    b, o = F.col("_before"), F.col("_own")
    removed = after("n", b) - after("n", b + o)
    return rows.select(
        "part",
        "filter_order",
        "step",
        after("n", b + o).alias("kept"),
        removed.alias("removed"),
        (after("n", F.lit(0)) - after("n", o) - removed).alias("redundant"),
        (F.get("n", o) - F.get("n", F.lit(0))).alias("unique_fails"),
        (after("n_good", b) - after("n_good", b + o)).alias("good_lost"),
        (after("n_toxic", b) - after("n_toxic", b + o)).alias("toxic_lost"),
        F.get("_summed", F.col("_index")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", failures: Mapping[str, Callable[[Column, Column], Column]] = FAILURES) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    filters = "".join(failures) + COPIES
    return every_order(survivors(mask_counts(docs, labels, part, text, failures), len(filters)), filters)
