"""Fits against gradient descent and plain Newton steps, calibration and stacking by time, spans and lap starts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import calibration as cal
from lodestone.operators import temporal


def newton(x, y, steps=cal.STEPS, ridge=cal.RIDGE):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def test_fit_of_several_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("a", 200), ("b", 60), ("c", 3)):
        for _ in range(n):
            x = rng.standard_normal(3)
            rows.append((g, *map(float, x), float(rng.random() < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3))))))
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, None)], "g string, u double, v double, w double, y double").withColumnRenamed("w", "z")
    got = {r.g: (r.w, r.n) for r in cal.logistic_fit(df, ["g"], ["u", "v", "z"], "y").collect()}
    for g in "abc":
        mine = np.array([r[1:] for r in rows if r[0] == g])
        assert got[g][1] == len(mine)
        assert got[g][0] == pytest.approx(newton(mine[:, :3], mine[:, 3]), abs=1e-8)
    # the fit is the top of its likelihood: the gradient, taken numerically, is null
    mine = np.array([r[1:] for r in rows if r[0] == "a"])
    x = np.column_stack([np.ones(len(mine)), mine[:, :3]])
    loss = lambda w: np.sum(np.log1p(np.exp(x @ w)) - mine[:, 3] * (x @ w)) + cal.RIDGE * w @ w / 2
    w, h = np.array(got["a"][0]), 1e-5
    for i in range(4):
        e = h * np.eye(4)[i]
        assert abs(loss(w + e) - loss(w - e)) / (2 * h) < 1e-4


def test_separable_groups_stay_finite(spark):
    df = spark.createDataFrame([("a", float(i), float(i > 5)) for i in range(12)] + [("b", 1.0, 1.0)] * 60, "g string, s double, y double")
    for r in cal.logistic_fit(df, ["g"], ["s"], "y").collect():
        assert all(np.isfinite(r.w))


def test_calibration_moves_only_what_has_rows(spark):
    rows = [("big", i / 100, int(i > 60)) for i in range(100)] + [("small", i / 49, 1) for i in range(49)] + [("big", None, 1), (None, 0.25, 0)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    out = cal.sigmoid_calibration(df, df, "s", "y", ["g"]).collect()
    assert len(out) == len(rows)
    small = [r for r in out if r.g != "big"]
    assert all(r.calibrated == r.s for r in small)
    big = sorted((r.s, r.calibrated) for r in out if r.g == "big" and r.s is not None)
    assert [c for _, c in big] == sorted(c for _, c in big) and 0 < big[0][1] < 0.2 and 0.8 < big[-1][1] < 1
    assert [r.calibrated for r in out if r.g == "big" and r.s is None] == [None]
    one = cal.sigmoid_calibration(df.where("g = 'big'"), df.where("g = 'big'"), "s", "y")
    assert sorted(one.columns) == ["calibrated", "g", "s", "y"] and one.where("calibrated <> s").count() > 90


def test_a_stack_knows_the_past_only(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(240):
        truth = int(rng.integers(3))
        for c in range(3):
            good = 0.6 * rng.random() + 0.4 * (c == truth)
            rows.append((k, k // 60, c, float(good), float(rng.random()), int(c == truth)))
    schema = "k int, block int, c int, a double, b double, hit int"
    one = spark.createDataFrame(rows, schema)
    # labels of the last block are turned round: nothing before it, nor the block itself, may change
    other = one.withColumn("hit", F.when(F.col("block") == 3, 1 - F.col("hit")).otherwise(F.col("hit")))
    got, again = ({(r.k, r.c): r.stacked for r in cal.stacked_scores(d, "k", "block", "c", ["a", "b"], "hit").collect()} for d in (one, other))
    assert got == again and len(got) == 720
    for k in range(240):
        assert sum(got[k, c] for c in range(3)) == pytest.approx(1.0)
    for k, _, c, a, b, _ in rows[:180]:  # the first block has no past
        mean = {x[2]: (x[3] + x[4]) / 2 for x in rows[3 * k : 3 * k + 3]}
        assert got[k, c] == pytest.approx((a + b) / 2 / sum(mean.values()))
    right = lambda scores: np.mean([max(range(3), key=lambda c: scores[k, c]) == next(r[2] for r in rows[3 * k : 3 * k + 3] if r[5]) for k in range(60, 240)])
    assert right(got) > right({(r[0], r[2]): r[3] + r[4] for r in rows}) + 0.05


@pytest.mark.parametrize(
    "text,millis",
    [("1 days 02:03:04.567", 93_784_567), ("0 days 00:01:23.456000", 83_456), ("-1 days +23:59:59", -1000), ("-1 days +23:59:59.9996", 0), ("2:03:04", 7_384_000), ("1:23.4569", 83_456), ("-1:23.4569", -83_456),
     ("90:00", 5_400_000), ("", None), ("12", None), ("1:2:3:4", None), ("a:10", None), (None, None), ("1 day, 0:00:01", 86_401_000)],
)
def test_spans(spark, text, millis):
    assert spark.createDataFrame([(text,)], "t string").select(temporal.span_millis(F.col("t"))).first()[0] == millis


def test_lap_starts(spark):
    at = lambda us: dt.datetime(2024, 5, 1) + dt.timedelta(microseconds=us)
    samples = spark.createDataFrame([("s", at(5_000_400), 5000), ("s", at(7_000_500), 7000), ("s", at(9_000_100), 9000), ("h", at(2500), 1), ("n", None, 1)], "session string, date timestamp_ntz, offset bigint")
    laps = spark.createDataFrame([("s", 1, 60_000), ("s", 2, None), ("h", 1, 0), ("n", 1, 5), ("x", 1, 5)], "session string, lap int, lap_offset bigint")
    got = {(r.session, r.lap): (r.origin, r.started) for r in temporal.lap_starts(samples, laps, "session", "date", "offset", "lap_offset").collect()}
    # the sample with the least delay counts; half a millisecond goes to the even one
    assert got == {("s", 1): (at(0), at(60_000_000)), ("s", 2): (at(0), None), ("h", 1): (at(2000), at(2000)), ("n", 1): (None, None), ("x", 1): (None, None)}
