"""Graphs of neighbours: recall against exact edges, work, and edge tables that grow by batches."""

import numpy as np
import pytest

from lodestone.operators import knn_graph as graphs
from lodestone.operators import retrieval
from lodestone.operators.retrieval import vector_top_k
from lodestone.plans import registry


def frame(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(int(k), [float(c) for c in row]) for k, row in zip(keys, x, strict=True)], "key bigint, v array<double>").repartition(4)


def recall(got, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = x @ x.T
    np.fill_diagonal(score, -2)
    want = np.argsort(-score, axis=1)[:, :k]
    near = {}
    for r in got:
        near.setdefault(r.src, set()).add(r.dst)
    return np.mean([len(near.get(i, set()) & set(w.tolist())) / k for i, w in enumerate(want)])


def test_graph_of_clustered_vectors(spark):
    """Recall of at least 0.9 for less than a tenth of all products."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(60, size=8000)] + 0.35 * rng.standard_normal((8000, 24))
    work = graphs.Work(spark)
    got = graphs.knn_graph(frame(spark, x), "key", "v", 5, leaf=128, trees=3, width=10, work=work).collect()
    assert len(got) == 5 * len(x)
    assert recall(got, x, 5) >= 0.9
    assert work.value < 0.1 * len(x) ** 2


def test_graph_of_spread_vectors(spark):
    """Vectors without any clusters, the hard case: recall of at least 0.9 with the defaults."""
    x = np.random.default_rng(4).standard_normal((2500, 32))
    assert recall(graphs.knn_graph(frame(spark, x), "key", "v", 5).collect(), x, 5) >= 0.9


def test_graph_of_equal_and_unusable_vectors(spark):
    x = np.ones((600, 4))
    got = graphs.knn_graph(frame(spark, x), "key", "v", 3, leaf=64, trees=2, width=6, rounds=2).collect()
    assert len(got) == 1800 and all(r.score == 1.0 and r.src != r.dst for r in got)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [])], "key bigint, v array<double>")
    got = {(r.src, r.dst): r.score for r in graphs.knn_graph(odd, "key", "v", 5).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 6): 0.0, (6, 1): 0.0, (2, 6): 0.0, (6, 2): 0.0}
    assert graphs.knn_graph(odd.where("key > 90"), "key", "v", 5).count() == 0


def test_query_equals_sql_beyond_one_leaf(spark, tmp_path):
    """2,500 spread vectors, some of them equal: descent alone misses some of their edges."""
    import duckdb

    x = np.random.default_rng(6).standard_normal((2500, 32)).astype(np.float32)
    x[100:130] = x[7]
    frame(spark, x).selectExpr("key AS vec_id", "cast(v AS array<float>) AS embedding", "0 AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["knn_graph"]).fetchall())
    assert sorted(map(tuple, registry.queries()["knn_graph"](spark, str(tmp_path)).collect())) == want


def test_search_over_several_groups(spark, monkeypatch):
    """Groups and tiles of a few rows: lists of all groups together are those of one product, ties by key; a tile is all that one product holds."""
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (700, 3)).astype(float)
    for name, rows in (("QUERY_BLOCK", 40), ("SEGMENT_ROWS", 60), ("GROUP_ROWS", 150), ("QUERY_ROWS", 16), ("TILE_ROWS", 32)):
        monkeypatch.setattr(retrieval, name, rows)
    got = {(r.query, r["rank"]): (r.key, r.score) for r in vector_top_k(frame(spark, x), frame(spark, x[:90]), "key", "v", 7).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(90):
        score = np.round(unit[q] @ unit.T, 6) + 0.0
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:7]
        assert [got[q, n + 1] for n in range(7)] == [(i, score[i]) for i in order]
    seen = []
    monkeypatch.setattr(np, "round", lambda a, *b, f=np.round: (seen.append(np.size(a)), f(a, *b))[1])
    retrieval._nearest(np.arange(16), unit[:16], np.full(16, -np.inf), np.arange(700), unit, unit.astype(np.float32), 7, 6)
    assert max(seen) <= 16 * 32


def edges(df, src="src", dst="dst"):
    return sorted((r[src], r[dst], r.score, r["rank"]) for r in df.collect())


def test_store_equals_a_full_run(spark, tmp_path):
    x = np.round(np.random.default_rng(5).standard_normal((90, 6)), 2)
    full = edges(vector_top_k(frame(spark, x), frame(spark, x), "key", "v", 4), "query", "key")
    store = graphs.EdgeStore(spark, f"file://{tmp_path}/edges", 4)
    wrong = x.copy()
    wrong[10:15] = -x[20:25]
    store.apply(0, frame(spark, wrong[:50]), "key", "v")
    assert edges(store.apply(1, frame(spark, x[50:80], range(50, 80)), "key", "v")) != full
    again = [*range(10, 15), *range(80, 90)]
    last = frame(spark, x[again], again)
    assert edges(store.apply(2, last, "key", "v")) == full
    assert edges(store.apply(2, last, "key", "v")) == full, "a batch that runs again changes nothing"
    assert edges(store.apply(3, last.where("key < 0"), "key", "v")) == full, "an empty batch changes nothing"
    with pytest.raises(ValueError):
        store.apply(9, last, "key", "v")
