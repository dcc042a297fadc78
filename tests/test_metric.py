"""Neighbour pairs, density clusters and the inverted file against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.operators import graphs, metric

SCHEMA = "vec_id long, label string, embedding array<float>, v string, cell string"


def vectors(seed=1, n=700, dim=12):
    """Clusters of several widths, one label with half of all rows, equal rows, zeros and a null."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(25, dim))
    x = centers[r.integers(0, 25, n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.3, 1.0], (n, 1))
    x[100:160] = x[100]
    x[300:303] = 0
    labels = np.where(r.random(n) < 0.5, "big", r.choice(["a", "b", "c"], n)).tolist()
    labels[5] = None
    return x.astype(np.float32), labels


@pytest.fixture(scope="module")
def points(spark):
    x, labels = vectors()
    rows = [(i, g, v, "v", "c") for i, (g, v) in enumerate(zip(labels, x.tolist(), strict=True))] + [(9000, "a", None, "v", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), x.astype(np.float64), labels


def all_pairs(x, labels, eps):
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        far = 1 - np.nan_to_num(x @ x.T / np.outer(norm, norm))
    return {(labels[a], a, b): far[a, b] for a in range(len(x)) for b in range(a + 1, len(x)) if labels[a] == labels[b] and far[a, b] <= eps}


@pytest.mark.parametrize("cell,most", [(1000, 4000), (20, 4000), (20, 7)])
@pytest.mark.parametrize("eps", [0.02, 0.4])
def test_neighbour_pairs_equal_all_pairs(points, monkeypatch, cell, most, eps):
    df, x, labels = points
    monkeypatch.setattr(metric, "CELL_ROWS", cell)
    monkeypatch.setattr(metric, "CELL_MOST", most)
    want = all_pairs(x, labels, eps)
    got = [(tuple(r)[:3], r.distance) for r in metric.neighbour_pairs(df, "vec_id", "label", eps).collect()]
    assert len(got) == len(want) and dict(got).keys() == want.keys()
    assert all(abs(d - want[k]) < 1e-9 for k, d in got)


def test_pivots_save_comparisons(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL_ROWS", 25)
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(40, 16)), 50, axis=0) + r.normal(size=(2000, 16)) * 0.05
    reps = spark.createDataFrame([("g", i, 1, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())], "group string, rep long, n long, v array<double>")
    pivots = metric.pivots_of(reps)["g"]
    v = np.array([r.v for r in reps.orderBy("rep").collect()])
    own = metric.squares(v, pivots).argmin(axis=1)
    sent = metric.beyond(v, pivots, own, np.sqrt(2 * 0.02)).sum()
    members = np.bincount(own, minlength=len(pivots))
    assert members.max() < 400 and sent < 0.1 * len(v) * len(pivots)


def brute_dbscan(x, labels, eps, least):
    near = {i: set() for i in range(len(x))}
    for _, a, b in all_pairs(x, labels, eps):
        near[a].add(b)
        near[b].add(a)
    cores = [i for i in near if len(near[i]) >= least - 1]
    cluster, core = {}, set(cores)
    for i in cores:
        if i not in cluster:
            cluster[i], todo, number = None, [i], len({c for c in cluster.values() if c is not None})
            while todo:
                j = todo.pop()
                cluster[j] = number
                todo += [k for k in near[j] if k in core and k not in cluster]
                cluster |= {k: number for k in near[j] if k in core}
    return {i: cluster[i] if i in core else min((cluster[j] for j in near[i] if j in core), default=-1) for i in near}


@pytest.mark.parametrize("least", [2, 4, 30])
def test_dbscan_counts_copies(points, monkeypatch, least):
    df, x, labels = points
    monkeypatch.setattr(metric, "CELL_ROWS", 20)
    got = {r.vec_id: r.cluster for r in metric.dbscan(df, "vec_id", "label", 0.02, least, graphs.components).collect()}
    assert got == brute_dbscan(x, labels, 0.02, least) | {9000: -1}


def test_inverted_file_exact_and_recall(points, monkeypatch):
    df, x, _ = points
    monkeypatch.setattr(metric, "LIST_ROWS", 15)
    monkeypatch.setattr(metric, "CELL_MOST", 40)
    index = metric.InvertedFile(df, "vec_id")
    assert len(index.centers) > 30 and index.parts.max() > 1
    queries = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    some = [i for i in range(0, len(x), 20) if x[i].any()]
    scores = np.floor(np.clip((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ x[some].T / np.linalg.norm(x[some], axis=1), 0, 1) * 1e6 + 0.5).T / 1e6
    full = [j for j in range(len(x)) if x[j].any()]
    want = {(q, r + 1): (j, s[j]) for q, s in zip(some, scores, strict=True) for r, j in enumerate(sorted(full, key=lambda j: (-s[j], j))[:5])}
    exact = {(r.query_id, r["rank"]): (r.key, r.score) for r in index.search(queries, 5, probes=2, exact=True).collect()}
    assert exact.keys() == want.keys() and all(abs(exact[k][1] - want[k][1]) < 2e-6 for k in want)
    assert sum(exact[k][0] == want[k][0] for k in want) >= 0.99 * len(want)  # rounded scores may tie the other way
    near = {(r.query_id, r.key) for r in index.search(queries, 5, probes=8).collect()}
    truth = {(q, j) for (q, _), (j, _) in exact.items()}
    assert len(near & truth) >= 0.9 * len(truth)


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert metric.neighbour_pairs(none, "vec_id", "label", 0.5).count() == 0
    assert metric.dbscan(none, "vec_id", "label", 0.5, 2, graphs.components).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert metric.InvertedFile(none, "vec_id").search(asked, 3, exact=True).count() == 0
    with pytest.raises(ValueError):
        metric.near_pairs(spark.createDataFrame([], "group string, rep long, v array<double>"), 1.5)
