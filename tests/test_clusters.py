"""Average-link clusters against one merge at a time."""

import numpy as np
import pytest

from lodestone.operators import clusters
from lodestone.operators.clusters import average_link
from lodestone.plans import registry


def plain(keys, x, clusters=2):
    """The closest two clusters are merged until enough are left, averages taken over all pairs."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - x @ x.T
    left = {k: [i] for i, k in enumerate(keys)}
    while len(left) > clusters:
        names = sorted(left)
        _, a, b = min((round(far[np.ix_(left[a], left[b])].mean(), 10), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
        left[a] += left.pop(b)
    ordered = sorted(left, key=lambda k: (-len(left[k]), k))
    return {keys[i]: n for n, k in enumerate(ordered) for i in left[k]}


@pytest.mark.parametrize("clusters,block", [(2, 7), (3, 1024)])
def test_equals_one_merge_at_a_time(spark, clusters, block):
    rng = np.random.default_rng(clusters * 100 + block)
    rows, want = [], {}
    for g, n in ((1, 40), (2, 3), (3, 1), (4, 33)):
        x = rng.standard_normal((n, 6)) + 1.5 * rng.integers(0, 2, (n, 1))
        keys = [int(k) for k in rng.permutation(200)[:n]]
        rows += [(g, k, [float(v) for v in r]) for k, r in zip(keys, x, strict=True)]
        want |= {(g, k): c for k, c in plain(keys, x, clusters).items()}
    odd = [(1, 900, None), (1, 901, [0.0] * 6), (None, 902, [1.0] * 6), (1, None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "g bigint, k bigint, v array<double>").repartition(3)
    assert {(r.grp, r.key): r.cluster for r in average_link(df, "g", "k", "v", clusters, block).collect()} == want


@pytest.mark.parametrize("last", [2, 15, 1024])
def test_rounds_and_the_last_task_agree(spark, monkeypatch, last):
    """Rounds over blocks to the end, rounds with a task for the rest, and one task alone; few jobs where a task can hold the group."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g, n in ((1, 60), (2, 25)):
        x = rng.standard_normal((n, 5)) + rng.integers(0, 2, (n, 1))
        rows += [(g, k, [float(v) for v in r]) for k, r in enumerate(x)]
        want |= {(g, k): c for k, c in plain(list(range(n)), x).items()}
    df = spark.createDataFrame(rows, "g bigint, k bigint, v array<double>").repartition(3)
    searched = []
    monkeypatch.setattr(clusters, "_nearest", lambda *a, f=clusters._nearest: (searched.append(a), f(*a))[1])
    assert {(r.grp, r.key): r.cluster for r in average_link(df, "g", "k", "v", 2, 16, last).collect()} == want
    assert (len(searched) == 0) == (last == 1024)
    assert all(a[1] is not None for a in searched[1:]), "later rounds look for some clusters only"


def test_equal_vectors(spark):
    df = spark.createDataFrame([(1, k, [1.0, 0.0] if k < 5 else [0.0, 1.0]) for k in range(9)], "g bigint, k bigint, v array<double>")
    assert {r.key: r.cluster for r in average_link(df, "g", "k", "v").collect()} == {k: int(k >= 5) for k in range(9)}
    assert average_link(df.where("k > 90"), "g", "k", "v").count() == 0


def test_query_over_every_label(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = {}
    for label in {r.label for r in rows}:
        mine = [r for r in rows if r.label == label]
        want |= {(label, k): c for k, c in plain([r.vec_id for r in mine], np.array([r.embedding for r in mine], float)).items()}
    assert {(r.label, r.vec_id): r.cluster for r in registry.queries()["label_clusters"](spark, sf).collect()} == want
