"""Boundary cases of the operators on literal tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers, text
from lodestone.operators import features, relational, retrieval, rulings, stats, temporal
from lodestone.sources import jsonl

T0 = datetime(2024, 7, 28, 13, 0, 0)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def link(spark, delta, message="CAR 4 (NOR) NOTED", category="parc_ferme", cars=(4,), corner=None, timed=True):
    i = spark.createDataFrame([("s", "i", list(cars), T0 if timed else None, corner, category)], "session_key string, incident_id string, cars array<int>, incident_time timestamp, corner string, category string")
    m = spark.createDataFrame([("s", "m", message, None if delta is None else at(delta), None)], "session_key string, message_id string, message string, message_time timestamp, number int")
    return temporal.link_messages(i, m).count()


@pytest.mark.parametrize(("delta", "linked"), [(-121, 0), (-120, 1), (900, 1), (901, 0), (None, 0)])
def test_message_window(spark, delta, linked):
    assert link(spark, delta) == linked


@pytest.mark.parametrize(("message", "category", "delta", "linked"), [
    ("CAR 4 (NOR) 5 SECOND TIME PENALTY - CAUSING A COLLISION", "collision", 1800, 1),
    ("CAR 4 (NOR) 5 SECOND TIME PENALTY - CAUSING A COLLISION", "collision", 1801, 0),
    ("CAR 4 (NOR) TIME 1:29.472 DELETED - OTHER", "collision", 10, 0),
    ("CAR 4 (NOR) TIME 1:29.472 DELETED - TRACK LIMITS", "track_limits", 10, 1),
    ("CAR 4 (NOR) LAP DELETED", "parc_ferme", 10, 1),
    ("CARS 1 (VER) AND 4 (NOR) NOTED", "parc_ferme", 10, 1),
    ("CAR 44 (HAM) NOTED", "parc_ferme", 10, 0),
])
def test_message_offences(spark, message, category, delta, linked):
    assert link(spark, delta, message, category) == linked


def test_message_turns_and_missing_times(spark):
    assert link(spark, 5, "TURN 3 INCIDENT CAR 4 (NOR) NOTED", corner="4") == 0
    assert link(spark, 5, "TURN 3 INCIDENT CAR 4 (NOR) NOTED", corner="3") == 1
    assert link(spark, 5, "CAR 4 (NOR) NOTED", corner="3") == 1
    assert link(spark, 5, cars=()) == 0
    assert link(spark, 5, "CAR 4 (NOR) WAVED", timed=False) == 0
    assert link(spark, 5, "CAR 4 (NOR) NOTED", timed=False) == 1
    assert link(spark, 5, "CAR 4 (NOR) NOTED", category="collision", timed=False) == 0


def test_nearest(spark):
    left = spark.createDataFrame([(1, "s", at(0)), (2, "s", at(5000)), (3, "s", None)], "id int, k string, lt timestamp")
    right = spark.createDataFrame([("s", at(-600), 10), ("s", at(40), 11), ("s", at(-40), 12), ("s", at(5601), 13), ("s", None, 14)], "k string, rt timestamp, v int")
    got = {r.id: (r.v, r.delta) for r in temporal.nearest(left, right, ["k"], "id", "lt", "rt", 600, [F.col("v")]).collect()}
    assert got == {1: (12, -40.0), 2: (None, None), 3: (None, None)}
    only = temporal.nearest(left.where("id = 1"), right.where("v = 10"), ["k"], "id", "lt", "rt", 600, []).first()
    assert only.v == 10


def test_backward_and_change(spark):
    laps = spark.createDataFrame([("s", at(0), 1, 5), ("s", at(90), 2, 4), ("s", at(280), 4, 7)], "k string, start timestamp, lap int, position int")
    moments = spark.createDataFrame([(1, "s", at(-1)), (2, "s", at(0)), (3, "s", at(100)), (4, "s", at(999))], "id int, k string, t timestamp")
    got = {r.id: r.last_lap for r in temporal.backward(moments, laps, ["k"], "t", "start", "lap").collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 4}
    change = {r.lap: r.change for r in temporal.change_before(laps, ["k"], "lap", "position").collect()}
    assert change == {1: None, 2: 1, 4: None}


def test_overlap(spark):
    left = spark.createDataFrame([("r", 1, 0, 100), ("r", 2, 500, 600)], "k string, a int, s bigint, e bigint")
    right = spark.createDataFrame([("r", 7, 90, 95), ("r", 8, 50, 1000), ("r", 9, 100, 120)], "k string, b int, bs bigint, be bigint")
    got = {r.a: (r.b, r.overlap) for r in temporal.greatest_overlap(left, right, ["k"], "a", ("s", "e", "bs", "be"), 64, [F.col("b")]).collect()}
    assert got == {1: (8, 50), 2: (8, 100)}


def test_overlap_of_long_intervals(spark):
    """Lengths from a second to a year, against all pairs; no interval is copied to every bucket that it touches."""
    rng = random.Random(6)
    make = lambda n: [("r", i, s, s + int(10 ** rng.uniform(0, 7.5))) for i, s in enumerate(rng.randrange(30_000_000) for _ in range(n))]
    a, b = make(60), [*make(60), ("q", 99, 0, 40_000_000)]
    left, right = spark.createDataFrame(a, "k string, a int, s bigint, e bigint"), spark.createDataFrame(b, "k string, b int, bs bigint, be bigint")
    got = {r.a: (r.b, r.overlap) for r in temporal.greatest_overlap(left, right, ["k"], "a", ("s", "e", "bs", "be"), 60, [F.col("b")]).collect()}
    want = {}
    for _, i, s, e in a:
        hits = [(min(e, be) - max(s, bs), -j) for k, j, bs, be in b if k == "r"]
        if max(hits)[0] > 0:
            want[i] = (-max(hits)[1], max(hits)[0])
    assert got == want and len(want) > 30


def test_severity_ladder(spark):
    codes = ["NFA", "WARN", "REP", "FINE", "5s", "10s", "20s", "30s", "DT", "SG", "GRID", "DSQ", "huh", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(stats.severity(F.col("c"))).collect()]
    assert got[4:8] == [4.0, 5.0, 5.9, 5.9] and got[12:] == [0.0, 0.0] and got[:12] == sorted(got[:12])


def test_variance_and_chi(spark):
    rows = [("one", "A", 9), ("even", "A", 4), ("even", "B", 4), ("few", "B", 3)]
    counts = spark.createDataFrame(rows, "g string, o string, n bigint")
    got = {r.g: r for r in stats.variance(counts, ["g"], "o", F.lit(1.0)).collect()}
    assert (got["one"].entropy, got["one"].inconsistency, got["even"].entropy, got["even"].inconsistency, got["even"].modal) == (0.0, 0.0, 1.0, 1.0, "A")
    chi = {r.g: r for r in stats.chi_squared(counts, "g", "o").collect()}
    assert chi["few"].chi2 == 0.0 and chi["few"].p_value == 1.0
    same = spark.createDataFrame([("x", "A", 5), ("x", "B", 5), ("y", "A", 5), ("y", "B", 5)], "g string, o string, n bigint")
    assert {r.chi2 for r in stats.chi_squared(same, "g", "o").collect()} == {0.0}


def test_percentile_and_erf(spark):
    df = spark.createDataFrame([(list(range(10, 0, -1)),)], "v array<int>")
    assert df.select(numbers.floor_percentile(F.col("v"), 95)).first()[0] == 9
    assert abs(df.select(numbers.erf(F.lit(0.5))).first()[0] - 0.5204999) < 1e-6


def test_three_valued_filter(spark):
    rows = [(p, c) for p in (True, False, None) for c in ("x", None)]
    df = spark.createDataFrame(rows, "p boolean, c string")
    kept = df.where(relational.not_false(F.col("p")) & F.col("c").isNotNull()).collect()
    assert sorted(str(r.p) for r in kept) == ["None", "True"]


def test_sinks_are_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (3, "e", 0)], "k int, v string, ver int")
    once = relational.upsert(stored, new, ["k"], "ver")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert sorted(map(tuple, relational.upsert(once, new, ["k"], "ver").collect())) == sorted(map(tuple, once.collect()))
    ignored = relational.insert_ignore(stored, new, ["k"], [F.desc("ver")])
    assert sorted(map(tuple, relational.insert_ignore(ignored, new, ["k"], [F.desc("ver")]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "d", 1)]


def test_fusion_and_bm25(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, None)], "q int, id int, rank int")
    got = retrieval.fuse([a, b], ["q"], "id", 10).orderBy("rank").collect()
    assert [(r.id, r.rrf_score) for r in got] == [(2, round(1 / 61 + 1 / 62, 6)), (1, round(1 / 61, 6)), (3, round(1 / 61, 6))]
    docs = spark.createDataFrame([(1, "red red car"), (2, "blue car"), (3, None)], "id int, t string")
    asked = spark.createDataFrame([(0, "Red red zebra"), (1, ""), (2, "zebra")], "q int, s string")
    assert [(r.q, r.id) for r in retrieval.bm25(docs, asked, "id", "t", "q", "s", 5).collect()] == [(0, 1)]


@pytest.mark.parametrize("text_column", ["t", {"h": 2.0, "t": 1.0}])
def test_bm25_in_place_equals_joins(spark, monkeypatch, text_column):
    """Scores made where the documents are, in slices of a few rows, are those of joins: ties, repeated and null keys, and keys of letters."""
    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, n)))
    docs = [(f"k{i % 70}", some(3), some(12)) for i in range(75)] + [(None, "a", "a b"), (None, "a", "b c a"), (None, "d", "a b"), ("z", None, None)]
    docs += [(f"same{i:02}", "", "a b b") for i in range(20)]
    docs = spark.createDataFrame(docs, "id string, h string, t string").repartition(3)
    asked = spark.createDataFrame([(i, some(4)) for i in range(12)] + [(3, "a a"), (None, "b j"), (50, ""), (51, "zebra"), (52, None)], "q int, s string")
    ranked = lambda: sorted(((r.q is None, r.q or 0, r["rank"], r.id, r.score) for r in retrieval.bm25(docs, asked, "id", text_column, "q", "s", 6).collect()), key=str)
    monkeypatch.setattr(retrieval, "SCORES", 60)
    plan = retrieval.bm25(docs, asked, "id", text_column, "q", "s", 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, "only the best of each task are shuffled"
    got = ranked()
    assert len(got) > 50
    monkeypatch.setattr(retrieval, "PAIRS", 0)
    assert got == ranked()
    assert retrieval.bm25(docs.where("id = 'none'"), asked, "id", text_column, "q", "s", 6).count() == 0


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.clean(F.lit("ﬁne co-\nlour  \nPage 3 of 9\n\n\n\nend\n-----\n"))) == "fine colour\n\nend"
    assert value(text.citations(F.lit("Breach of Articles 33.4, 33.5 and 12 of; participates 4; Article 33.4 (a)"))) == ["33.4", "33.5", "12", "33.4(a)"]
    assert value(text.fold_accents(F.lit("Pérez-Ñandú"))) == "pereznandu"
    assert value(text.extract(F.lit("none"), r"(\d+)")) is None
    assert str(value(text.local_to_utc(F.lit("on 28.07.24 15:04 CET")))) == "2024-07-28 13:04:00"
    assert str(value(text.local_to_utc(F.lit("28.01.24 15:04")))) == "2024-01-28 14:04:00"
    assert value(text.local_to_utc(F.lit("31.02.24 15:04"))) is None
    assert value(text.escape_percent(F.lit("a%20b%zz"))) == "a%20b%25zz"
    assert value(features.outcome_class(F.lit("15 second time penalty"))) == "GRID"
    assert value(features.outcome_class(F.lit("5 second penalty"))) == "5s"


def test_ruling_rules(spark):
    body = "No / Driver 4 - Lando  Norris\n63 - George Russell\nTime 13:05\nSession Sprint Qualifying\nFact Cars 4, 16 and 63 avoided contact.\nDecision Drop of three grid positions.\nReason Stewards heard from the driver.\nThe Stewards\nJohn Smith\nMaria de Silva\n"
    r = rulings.extract_fields(spark.createDataFrame([(1, body), (2, None)], "id int, raw_text string")).orderBy("id").collect()
    a, b = r
    assert (a.car, a.driver, a.time, a.session, a.contact, a.outcome, a.grid) == (4, "Lando Norris", "13:05", "sprint_qualifying", False, "grid penalty", 3)
    assert a.involved == [16, 63] and [s.number for s in a.subjects] == [4, 63] and a.signatories == ["John Smith", "Maria de Silva"]
    assert b.car is None and b.contact is None and b.confidence == 0.0


def test_panel_and_guidelines(spark):
    w = spark.createDataFrame([("d", "Ann", 0.0, 20.0, 10.0), ("d", "Lee", 25.0, 40.0, 11.0), ("d", "Bo", 200.0, 215.0, 10.5), ("d", "Ray", 220.0, 240.0, 10.0), ("d", "Notes", 0.0, 30.0, 30.0)], "doc_id string, text string, x0 double, x1 double, top double")
    assert sorted(r.name for r in rulings.panel_from_boxes(w).collect()) == ["Ann Lee", "Bo Ray"]
    lines = spark.createDataFrame([("g", i, t) for i, t in enumerate(["STARTS", "1.1 Wait for lights", "and go", "PIT LANE", "2.1 Slow"])], "doc_id string, line_no int, text string")
    got = sorted((r.section, r.article, r.text) for r in rulings.guideline_articles(lines).collect())
    assert got == [("PIT LANE", "2.1", "Slow"), ("STARTS", "1.1", "Wait for lights and go")]


def test_label_space_and_model_gate(spark):
    df = spark.createDataFrame([([0.7, 0.3],)], "p array<double>")
    assert df.select(features.expand_labels(F.col("p"), ["NFA", "DT"])).first()[0] == [0.7, 0.0, 0.0, 0.0, 0.3, 0.0, 0.0]
    best, confidence = features.best_class(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.4)]), ("a", "b", "c"))
    assert tuple(df.select(best, confidence).first()) == ("b", 0.4)
    assert features.ship_gate(0.7, 0.01) and not features.ship_gate(0.7, 0.06)


def test_jsonl_and_links(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"doc_id": "x", "season": 2024}\n\n{broken\n{"doc_id": "y"}\n')
    assert sorted(r.doc_id for r in jsonl.read_jsonl(spark, str(path), jsonl.DOCUMENT).collect()) == ["x", "y"]
    pages = spark.createDataFrame([('<a href="/2024_a/d.PDF"><b>Decision</b> 4</a><a href="/x.html">Decision</a><select><option value="0">-<option value="/s">2024 ',)], "html string")
    got = jsonl.document_links(pages).collect()
    assert [(r.href, r.title) for r in got] == [("/2024_a/d.PDF", "Decision 4")]
    assert [(r.value, r.name) for r in jsonl.select_options(pages).collect()] == [("/s", "2024")]
    assert pages.select(jsonl.season_of_url(F.lit("https://x/2024_round/a"))).first()[0] == 2024


def test_clusters_and_negatives(spark):
    rows = [(1, i, [1.0, 0.01 * i]) for i in range(4)] + [(1, 9, [0.0, 1.0]), (1, 10, [0.1, 1.0]), (2, 1, [1.0, 0.0])]
    got = {(r.grp, r.key): r.cluster for r in features.two_clusters(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 9): 1, (1, 10): 1, (2, 1): 0}
    anchors = spark.createDataFrame([(1,), (2,)], "anchor int")
    own = spark.createDataFrame([(1, 7)], "anchor int, other int")
    pool = spark.createDataFrame([(2,), (5,)], "other int")
    got = {r.anchor: r.negative for r in retrieval.negative_samples(anchors, own, pool, 1, pool).collect()}
    assert got == {1: 7, 2: 5}
    none = retrieval.negative_samples(anchors, own.limit(0), pool.limit(0), 1, pool)
    assert {r.negative for r in none.where("anchor = 2").collect()} == {5}


def test_negatives_are_drawn_for_every_anchor(spark):
    anchors, many = spark.range(300).toDF("anchor"), spark.range(100).toDF("other")
    none = spark.createDataFrame([], "anchor bigint, other bigint")
    for pool in (many, many.limit(0)):
        got = retrieval.negative_samples(anchors, none, pool, 1, many).collect()
        assert len(got) == 300 and all(r.negative is not None and r.negative != r.anchor for r in got)
        assert len({r.negative for r in got}) > 70
    alone = spark.createDataFrame([(1,)], "other bigint")
    got = retrieval.negative_samples(spark.createDataFrame([(1,), (2,)], "anchor bigint"), none, alone, 1, alone).collect()
    assert {r.anchor: r.negative for r in got} == {1: None, 2: 1}


def test_adjudication_and_lists(spark):
    df = spark.createDataFrame([("similar", "similar", "high"), ("similar", "drop", "high"), ("similar", "similar", "low")], "proposed string, verdict string, confidence string")
    assert [(r.flip, r.flagged) for r in retrieval.adjudicate(df).collect()] == [(False, False), (True, True), (False, True)]
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "g string, o int, t string")
    assert retrieval.numbered_list(rows, ["g"], "o", F.col("t")).first().document == "1. x\n2. y"


def test_calibration_of_scores(spark):
    df = spark.createDataFrame([(i / 100, float(i > 50 or i % 7 == 0)) for i in range(100)], "s double, y double")
    out = features.platt(df, "s", "y").transform(df).select("s", F.element_at(F.udf(lambda v: v.toArray().tolist(), "array<double>")("calibrated"), 2).alias("p")).orderBy("s").collect()
    assert out[0].p < 0.5 < out[-1].p
    bins = features.calibration_bins(spark.createDataFrame([(1.0, 1), (0.95, 1), (0.95, 0)], "p double, y int"), "p", F.col("y") == 1).collect()
    assert [(r.bin, r.n, r.accuracy) for r in bins] == [(9, 2, 0.5)]


def test_suggestions_go_on_at_random(spark):
    docs = spark.createDataFrame([(i, "a collision") for i in range(9)] + [(20, "blue flag"), (21, "blue flag")], "k bigint, t string")
    none = spark.createDataFrame([], "a bigint, b bigint")
    first = {r.bucket: (r.a, r.b) for r in retrieval.suggest_pairs(docs, none, "k", "t", 5).collect()}
    assert set(first) == {"collision", "blue flag"}
    every = [(a, b) for a in range(9) for b in range(a + 1, 9)]
    # all pairs but a few are seen: one of those is drawn, the same at every run; the other bucket is done
    for left in ([(0, 7), (2, 3), (4, 8), (1, 5), (3, 6)], every[:12]):
        seen = spark.createDataFrame([(b, a) for a, b in every if (a, b) not in left] + [(20, 21)], "a bigint, b bigint")
        got = [[(r.bucket, r.a, r.b) for r in retrieval.suggest_pairs(docs, seen, "k", "t", 5).collect()] for _ in range(2)]
        assert got[0] == got[1] and len(got[0]) == 1 and got[0][0][1:] in left
