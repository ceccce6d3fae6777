"""Exact neighbours through the cluster tree, against a comparison of all pairs."""

import numpy as np
import pandas as pd
import pytest

from busweave.operators import neighbours


def brute(train, test, k, leave_self_out):
    """``(test id, place, train id)`` by distance and id, on the same arithmetic."""
    ids, vectors = np.array([i for i, _ in train]), np.array([v for _, v in train], float)
    out = []
    for i, v in test:
        d = np.sqrt(((vectors - np.array(v, float)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if not (leave_self_out and ids[j] == i)]
        out += [(i, place + 1, int(ids[j])) for place, j in enumerate(order[:k])]
    return sorted(out)


def frames(spark, train, test):
    kind = "id long, v array<double>, label int"
    return tuple(spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in rows], kind) for rows in (train, test))


def clustered(seed, n, dims=3):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-50, 50, (12, dims))
    return [(i, (centres[i % 12] + rng.normal(0, 0.5, dims)).round(3).tolist()) for i in range(n)]


@pytest.mark.parametrize("leaf_rows,pivots,leave_self_out", [(8, 3, True), (40, 16, False), (10**6, 16, True)])
def test_many_levels_equal_all_pairs(spark, leaf_rows, pivots, leave_self_out):
    rows = clustered(1, 500)
    # A third of the rows are alike, and one row is far from everything.
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(250)] + [(5000, [1e6, -1e6, 1e6])]
    test = rows[::7] + [(9001, [0.0, 0.0, 0.0]), (9002, [1.0, 2.0, 3.0])]
    train, asked = frames(spark, rows, test)
    got = neighbours.knn_neighbours(train, asked, "id", "v", 4, pivots, leave_self_out, leaf_rows=leaf_rows)
    assert sorted((r.test_id, r.place, r.train_id) for r in got.collect()) == brute(rows, test, 4, leave_self_out)


def test_fewer_training_rows_than_neighbours(spark):
    rows = [(1, [0.0]), (2, [5.0]), (3, [5.0])]
    train, asked = frames(spark, rows, rows)
    got = neighbours.knn_neighbours(train, asked, "id", "v", 5, leave_self_out=True, leaf_rows=1, pivots=2)
    assert sorted((r.test_id, r.place, r.train_id) for r in got.collect()) == brute(rows, rows, 5, True)
    with pytest.raises(ValueError):
        neighbours.knn_neighbours(train.limit(0), asked, "id", "v")


def test_leaves_follow_the_data_and_rule_out_most_pairs(spark):
    small, large = clustered(2, 200), clustered(2, 2000)
    sizes = []
    for rows in (small, large):
        base = frames(spark, rows, rows)[0].selectExpr("id AS train_id", "v AS __v")
        leaves = neighbours.cluster_tree(base, 4, 50)[0].groupBy("node").count()
        counts = [r["count"] for r in leaves.collect()]
        assert sum(counts) == len(rows) and max(counts) <= 50
        sizes.append(len(counts))
    assert sizes[1] > 4 * sizes[0]
    train, _ = frames(spark, large, large)
    assert neighbours.share_skipped(train, train.where("id % 10 = 0"), "id", "v", 5, 4, 50) > 0.8


def test_a_block_gives_each_row_its_k_nearest_however_many_are_alike():
    alike = pd.DataFrame({"train_id": range(300, 0, -1), "__v": [np.zeros(2)] * 300, "__carry": ["x"] * 300})
    asked = pd.DataFrame({"test_id": [2, 900], "__v": [np.zeros(2), np.ones(2)], "bound": [np.inf, 1.5]})
    got = neighbours._nearest_in_block(3, True)(asked, alike)
    assert got[["test_id", "train_id"]].values.tolist() == [[2, 1], [2, 3], [2, 4], [900, 1], [900, 2], [900, 3]]


def test_leaves_are_found_without_sending_vectors(spark):
    train, _ = frames(spark, clustered(3, 120), [])
    rows, tree, root = neighbours.cluster_tree(train.selectExpr("id AS train_id", "v AS __v"), 4, 20)
    asked = train.selectExpr("id AS test_id", "v AS __v", "'' AS home", "1e9D AS bound")
    met = neighbours._reachable(asked, tree, root)
    assert met.columns == ["test_id", "home", "node"]
    assert met.count() == 120 * rows.select("node").distinct().count()
