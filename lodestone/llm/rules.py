"""Quality rules as a short-circuit cascade, in built-in functions only.

A rule rejects a text by a condition over its statistics or the text itself. Cost and selectivity
of each rule are estimated on a bounded sample of raw texts; rules then run in order of rejection per
cost, and a row stops at the first rule that rejects it. What a rule reads is computed in its own
branch of the cascade, so it costs nothing on rows that were stopped before, unless the statistic is
itself a result. The order changes the work and ``failed_rule``, never the verdict.

Defined cases: a null text counts as an empty one; empty texts have zero statistics and fail the
base rule; repeated rows and equal ids are judged row by row; an empty table gives an empty result;
columns of the input that clash with those made here are not carried along.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE_CHARS, SPACE_CLASS

#: Words in a window that counts as repeated.
WINDOW = 8
#: Rows of the sample on which rules are timed; a fixed bound. Few enough to be one small task.
SAMPLE_ROWS = 500
SAMPLE_SEED = 29


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the name of the text column and gives a condition."""

    name: str
    rejects: Callable[[str], Column]


def word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Repeated windows: 64-bit hashes of all windows of a text are compared first. Only where two
    agree, hashes (high bits) and positions (low bits) are packed in one number and sorted, equal
    neighbours are compared word by word, and the union of their windows is measured.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE_CHARS))
    df = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+")))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    df = df.withColumn("n_words", F.size("_words").cast("bigint"))
    df = df.withColumn(
        "_hashes",
        F.expr(f"""CASE WHEN n_words >= {WINDOW}
            THEN transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW})))
            ELSE CAST(array() AS array<bigint>) END"""),
    )
    # bits for a position; then (hash << bits) | position, sorted as plain numbers
    df = df.withColumn("_bits", F.expr("CAST(ceil(log2(n_words + 2)) AS int)"))
    df = df.withColumn(
        "_packed",
        F.expr("""CASE WHEN size(_hashes) > size(array_distinct(_hashes))
            THEN sort_array(transform(_hashes, (h, i) -> shiftleft(h, _bits) | CAST(i AS bigint)))
            ELSE CAST(array() AS array<bigint>) END"""),
    )
    same = f"""shiftright(x, _bits) = shiftright(get(_packed, i {{0}} 1), _bits) AND
        slice(_words, CAST(x & (shiftleft(1L, _bits) - 1) AS int) + 1, {WINDOW}) =
        slice(_words, CAST(get(_packed, i {{0}} 1) & (shiftleft(1L, _bits) - 1) AS int) + 1, {WINDOW})"""
    df = df.withColumn(
        "_starts",
        F.expr(f"""sort_array(transform(
            filter(_packed, (x, i) -> coalesce({same.format("-")}, false) OR coalesce({same.format("+")}, false)),
            x -> x & (shiftleft(1L, _bits) - 1)))"""),
    )
    repeated = F.expr(f"""aggregate(_starts, named_struct('last', CAST(-{WINDOW} AS bigint), 'n', 0L),
        (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}L, p - a.last)), a -> a.n)""")
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_repeat_words": repeated,
        }
    ).drop("_hashes", "_bits", "_packed", "_starts", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: The rules after the base rule. Shares are of words, so that a text's length does not matter.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda t: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("long_words", lambda t: (F.col("word_chars") > 30 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
    Rule("repeated_lines", lambda t: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("shouting", lambda t: 2 * F.regexp_count(F.col(t), F.lit(r"(?<![^\x20\x09-\x0D])[^\p{Ll}\x20\x09-\x0D]*\p{Lu}[^\p{Ll}\x20\x09-\x0D]*(?![^\x20\x09-\x0D])")) > F.col("n_words")),
    Rule("exclamations", lambda t: 10 * F.regexp_count(F.col(t), F.lit("!")) > 3 * F.col("n_words")),
    Rule("no_letters", lambda t: 2 * F.regexp_count(F.col(t), F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < F.col("n_words")),
    Rule("stutter", lambda t: F.expr(f"4 * size(filter(_words, (w, i) -> i > 0 AND w = get(_words, i - 1))) > n_words")),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def sample_texts(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` texts by a seeded draw whose share falls as the table grows.

    Every task of the draw emits its share, about 1.5 times ``rows`` in all, so what meets in the one
    task of the limit is bounded whatever the number of partitions or copies.
    """
    total = max(1, docs.count())
    drawn = docs.select(text).filter(F.rand(SAMPLE_SEED) < 1.5 * rows / total)
    return drawn.limit(rows)


def estimate(sample: DataFrame, rules: Sequence[Rule], text: str = "text", runs: int = 2) -> list[Estimate]:
    """Time each rule on the raw texts of a bounded sample and count what it rejects there.

    A rule's time is its best run less that of a job that only reads the sample, in powers of four,
    so that the noise of a machine rarely changes the order.
    """
    sample = sample.cache()
    try:
        n = max(1, sample.count())
        stats = word_stats(sample, text)

        def best(hit: Column) -> tuple[float, int]:
            times, count = [], 0
            for _ in range(runs):
                began = time.perf_counter()
                count = stats.agg(F.count(F.when(hit, 1))).first()[0]
                times.append(time.perf_counter() - began)
            return min(times), count

        floor, _ = best(F.length(F.col(text)) < 0)
        out = []
        for rule in rules:
            seconds, hit = best(rule.rejects(text))
            seconds = max(seconds - floor, 0.004)
            out.append(Estimate(rule.name, 4.0 ** round(math.log(seconds, 4)), hit / n))
        return out
    finally:
        sample.unpersist()


def cascade_order(estimates: Sequence[Estimate]) -> list[str]:
    """Names by rejection per cost, highest first; a rule that rejected nothing still has a rank by cost."""
    return [e.name for e in sorted(estimates, key=lambda e: (-(e.rejected + 1e-4) / max(e.seconds, 1e-6), e.name))]


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text", order: Sequence[str] | None = None, verdict_only: bool = False) -> DataFrame:
    """``docs`` with the statistics, base_failed, kept and failed_rule (the rule that stopped a row).

    ``order`` fixes the cascade; without it the order is estimated on a sample. With ``verdict_only``
    kept is the only column added, and statistics are computed only where the cascade reads them.
    """
    made = ["_words", "_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "kept", "failed_rule"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    if order is None:
        order = cascade_order(estimate(sample_texts(docs, text), rules, text))
    by_name = {r.name: r for r in rules}
    stopped = F.when(base_failed(), F.lit("base"))
    for name in order:
        stopped = stopped.when(F.coalesce(by_name[name].rejects(text), F.lit(False)), F.lit(name))
    out = word_stats(docs, text).withColumn("failed_rule", stopped)
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", base_failed().alias("base_failed"), "failed_rule"]
    kept = F.col("failed_rule").isNull().alias("kept")
    # a generator of one row: a filter on ``kept`` stays above it and is not spelled out in terms of the text
    return out.select(*docs.columns, F.inline(F.array(F.struct(*([] if verdict_only else results), kept))))
