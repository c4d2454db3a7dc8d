"""Mix sources to target weights by capped water-filling, in built-in functions only.

Every source gets ``min(cap, level * weight)`` with one level for all: the level at which the
targets add up to all words. Ordered by cap per weight, clamped sources form a prefix, so the level
comes from running sums over the (small) table of sources in one pass. A source is then sampled by
whole repetitions of every document and a seeded fraction: documents are ranked by a hash of id and
text, whole hash buckets are taken while they fit, and only the one bucket at the border is ranked row
by row, so no task ever holds a hot source. What is ranked is a narrow table (source, hash, id, size),
whose words are counted once; each source ends with one cut in that order, and a row compares itself
with the cut.

Defined cases: null texts have size 0; a null source is a source of its own, weighed last; sources
without words get target 0 and their documents take 0; null and repeated ids are told apart by their
texts; rows that agree in id and text are taken together or not at all, so reruns agree; an empty table
gives an empty result;
extra columns are dropped by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, seeded_unit

#: Fixed by contract: weights in order of sources, repeating, and the largest number of epochs.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
#: Hash buckets of a source: the border bucket alone is ranked row by row.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target, capped).

    Integers up to the last division, so that any engine gets the same doubles.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * max_epochs)
    # ascending by cap / weight: what is clamped comes first
    ratio = F.col("cap").cast("double") / F.col("weight")
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns(
        {
            "_free_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_free_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # a source is clamped if the level that would hold from it on exceeds its cap
    t = t.withColumn("capped", F.col("_free_words") * F.col("weight") > F.col("cap") * F.col("_free_weight"))
    level = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.first(F.when(~F.col("capped"), F.col("_free_words")), ignorenulls=True).over(level)
    weight_sum = F.first(F.when(~F.col("capped"), F.col("_free_weight")), ignorenulls=True).over(level)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((words * F.col("weight")).cast("double") / weight_sum)
    return t.withColumn("target", target).select("source", "source_size", "weight", "target", "capped")


_RANK = ("_hash", "doc_id", "size")


def _ranked(text: str, seed: int) -> list[Column]:
    """size and _hash of a row."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return [word_count(F.col(text)).alias("size"), seeded_unit(key, seed).alias("_hash")]


def _narrow(docs: DataFrame, text: str, seed: int) -> DataFrame:
    """(source, doc_id, size, _hash) of every row."""
    return docs.select("source", "doc_id", *_ranked(text, seed))


def _cuts(narrow: DataFrame, space: Workspace, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row a source: source_size, target, _whole (repetitions of all) and _cut, up to which rows get one more."""
    width = 16**8 // BUCKETS
    narrow = narrow.withColumn("_bucket", F.expr(f"_hash div {width}"))
    buckets = space.save(narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("capped"), F.lit(max_epochs)).when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    targets = targets.withColumn("_whole", whole.cast("bigint"))
    targets = targets.withColumn("_part", F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("target") - F.col("_whole") * F.col("source_size")))
    targets = space.save(targets, "targets")
    # running words by bucket: below the fractional part a bucket is in, above it is out, one may lie across
    b = buckets.withColumn("_upto", F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    b = b.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "_bucket", "_part", (F.col("_upto") - F.col("_words")).alias("_before"), "_upto")
    inside = b.filter(F.col("_upto") <= F.col("_part")).select("source", F.struct(((F.col("_bucket") + 1) * width - 1).alias("_hash"), F.lit(None).cast(narrow.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("bigint").alias("size")).alias("_cut"), F.lit(True).alias("_all"))
    across = space.save(b.filter((F.col("_before") < F.col("_part")) & (F.col("_part") < F.col("_upto"))), "across")
    # the border bucket alone: take rows while that brings the source nearer to its target
    border = narrow.alias("d").join(across.alias("x"), F.col("d.source").eqNullSafe(F.col("x.source")) & (F.col("d._bucket") == F.col("x._bucket"))).select("d.*", "_before", "_part")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(*_RANK).rowsBetween(Window.unboundedPreceding, 0))
    border = border.withColumn("_at", F.col("_before") + upto - F.col("size") / 2).filter(F.col("_at") <= F.col("_part"))
    border = border.select("source", F.struct(*_RANK).alias("_cut"), F.lit(False).alias("_all"))
    # a whole bucket ends at its last hash; the border lies beyond it, so the greatest cut is the one
    cut = inside.unionByName(border).groupBy("source").agg(F.max(F.struct("_cut", "_all")).alias("c")).select("source", "c._cut", "c._all")
    cut = space.save(cut, "cut")
    joined = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return space.save(joined.select("t.source", "source_size", "target", "_whole", "_cut", "_all"), "cuts")


def _repetitions(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with source, _hash, doc_id and size) with source_size, target and repetitions."""
    d = rows.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source"))).select("d.*", "source_size", "target", "_whole", "_cut", "_all")
    one_more = F.when(F.col("_all"), F.col("_hash") <= F.col("_cut._hash")).otherwise(F.struct(*_RANK) <= F.col("_cut"))
    return d.withColumn("repetitions", F.col("_whole") + F.when(F.coalesce(one_more, F.lit(False)), 1).otherwise(0)).drop("_hash", "_whole", "_cut", "_all")


def mix(docs: DataFrame, text: str = "text", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, repetitions and taken (words)."""
    space = Workspace(docs.sparkSession, "mix")
    narrow = space.save(_narrow(docs, text, seed), "narrow")
    d = _repetitions(narrow, _cuts(narrow, space, weights, max_epochs))
    return d.withColumn("taken", F.col("repetitions") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "repetitions", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    space = Workspace(docs.sparkSession, "mixed")
    cuts = _cuts(space.save(_narrow(docs, text, seed), "narrow"), space, weights, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    d = docs.select("source", "doc_id", *_ranked(text, seed), row)
    d = _repetitions(d, cuts).filter(F.col("repetitions") > 0)
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repetitions")))).select("_row.*")
