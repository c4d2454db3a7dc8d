import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import mixing, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if count[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_stats_match_brute_force(spark, odd):
    got = rules.quality_rules(odd).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        want = brute_stats(r.text)
        assert tuple(r)[2:7] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_repeats_overlap_and_positions(spark):
    texts = ["a b c d e f g h " * 3, "a " * 40, "p q " + "a b c d e f g h " + "z " + "a b c d e f g h", "x\nx\n\n \nx\ny", "one # two | three"]
    got = rules.quality_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t)


def test_order_changes_work_but_not_verdict(spark, odd):
    names = [r.name for r in rules.DEFAULT_RULES]
    a = rules.quality_rules(odd, order=names).select("doc_id", "text", "kept").collect()
    b = rules.quality_rules(odd, order=names[::-1]).select("doc_id", "text", "kept").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    estimates = [rules.Estimate("dear", 1.0, 0.5), rules.Estimate("cheap", 0.1, 0.5), rules.Estimate("idle", 0.1, 0.0)]
    assert rules.cascade_order(estimates) == ["cheap", "dear", "idle"]


def test_sample_is_bounded_and_seeded(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('text ', id) END AS text").repartition(40)
    assert 300 <= rules.sample_texts(df).count() <= rules.SAMPLE_ROWS
    # what the tasks of the draw emit together does not grow with their number
    drawn = df.filter(F.rand(rules.SAMPLE_SEED) < 1.5 * rules.SAMPLE_ROWS / 20_000).count()
    assert drawn < 2 * rules.SAMPLE_ROWS
    assert rules.sample_texts(df.limit(0)).count() == 0 and rules.sample_texts(df.limit(7)).count() == 7


def test_verdict_alone_is_the_same(odd):
    names = [r.name for r in rules.DEFAULT_RULES]
    whole = rules.quality_rules(odd, order=names).select("doc_id", "text", "kept").collect()
    alone = rules.quality_rules(odd, order=names, verdict_only=True)
    assert sorted(map(str, alone.select("doc_id", "text", "kept").collect())) == sorted(map(str, whole))
    assert "n_symbols" not in alone.columns and "failed_rule" not in alone.columns


def test_rules_on_empty_table(nothing):
    assert rules.quality_rules(nothing).count() == 0


def brute_targets(sizes):
    """Reshare the excess by weight until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def test_targets_match_iteration(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 100, "b": 100, "c": 100}, {"x": 1, "y": 0, "z": 900, "zz": 3}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "w " * (i % 40 + 1)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted(first) == sorted(again)
    by = defaultdict(list)
    for r in first:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= 41
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.repetitions for r in first)


def test_mix_odd_rows(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(r.size == len(WORD.findall("")) or r.size > 0 for r in got)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_tells_null_and_repeated_ids_apart(spark):
    rows = [(None if i % 2 else 1, "s", f"{i} " + "w " * 9) for i in range(400)] + [(None, "t", "v " * 5)] * 4000
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(docs).collect()
    size = sum(r.size for r in got)
    assert sum(r.size for r in got if r.source == "s") == 4000 and {r.source_size for r in got if r.source == "s"} == {4000}
    target = next(r.target for r in got if r.source == "s")
    assert abs(sum(r.taken for r in got if r.source == "s") - target) <= 10 and size == 24_000
