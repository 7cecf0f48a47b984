import hashlib
import math

import duckdb
import numpy as np
import pytest

from quillspark.llm import centroids
from quillspark.llm.queries import op12_centroid_clusters


def brute(rows, k, rounds, dimensions, scale=64, seed=1):
    """(vec_id, cluster, distance) in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    at = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        members = [[v for _, v in kept if near(v)[1] == i] for i in range(len(at))]
        at = [[sum(c) // len(own) for c in zip(*own, strict=True)] if own else at[i] for i, own in enumerate(members)]
    return sorted((repr(i), near(v)[1], near(v)[0]) for i, v in kept), at


def found(spark, rows, k, rounds, dimensions, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(frame, k=k, rounds=rounds, dimensions=dimensions, **more)
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in got.assigned.collect()), got


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[9][1]), (900, None), (901, [1.0] * 7), (902, [1.0] * 9), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (906, [])]
    for rounds in (0, 1, 4):
        got, model = found(spark, rows, 6, rounds, 8)
        want, at = brute(rows, 6, rounds, 8)
        assert got == want and model.centroids == at


def test_ties_go_to_the_smallest_number(spark):
    # Many equal vectors and vectors just between two centroids: floors make exact ties.
    rows = [(i, [float((i * 7) % 4), float((i * 3) % 2)]) for i in range(80)]
    assert found(spark, rows, 7, 2, 2, scale=1)[0] == brute(rows, 7, 2, 2, scale=1)[0]


def test_empty_clusters_and_few_vectors(spark):
    same = [(i, [0.5, 0.5]) for i in range(10)]
    got, model = found(spark, same, 4, 3, 2)
    assert {r[1:] for r in got} == {(0, 0)} and model.inertia == [0, 0, 0, 0] and model.centroids == [[32, 32]] * 4
    assert found(spark, same[:2], 4, 1, 2)[0] == brute(same[:2], 4, 1, 2)[0]
    assert found(spark, [], 4, 1, 2)[0] == [] and centroids.with_totals(found(spark, [], 4, 1, 2)[1]).collect() == []


def test_large_components(spark):
    edge = [(i, [float(2**20 - i), -float(2**20) + i % 3]) for i in range(40)]
    assert found(spark, edge, 5, 3, 2)[0] == brute(edge, 5, 3, 2)[0]
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [1e9, 0.0])], 1, 1, 2)


@pytest.mark.parametrize("size", [1, 100, 5_000, 1 << 27])
def test_intervals_hold_the_exact_distance(size):
    rng = np.random.default_rng(size)
    at = rng.integers(-size, size + 1, (12, 64))
    x = np.concatenate([rng.integers(-size, size + 1, (500, 64)), at, (at[:6] + at[6:]) // 2])
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in at] for v in x], dtype=object)
    _, open_ = centroids.shortlist(x, at)
    least = exact.min(axis=1)
    assert all(open_[i, j] for i in range(len(x)) for j in range(12) if exact[i, j] == least[i])
    assert centroids.nearest(x, at).tolist() == [list(row).index(m) for row, m in zip(exact, least, strict=True)]


def test_the_screen_decides_most_vectors():
    rng = np.random.default_rng(1)
    at = rng.integers(-40, 40, (16, 64))
    _, open_ = centroids.shortlist(rng.integers(-40, 40, (4000, 64)), at)
    assert (open_.sum(axis=1) == 1).mean() > 0.95


def test_columns_with_the_same_names(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], 5, "x"), (2, [3.0, 4.0], 6, "y")], "id long, e array<float>, cluster int, v string")
    got = centroids.with_totals(centroids.cluster(frame, k=1, rounds=1, dimensions=2, id_col="id", vector_col="e"))
    assert sorted(got.select("vec_id", "cluster", "distance", "inertia").collect()) == [(1, 0, 8192, 16384), (2, 0, 8192, 16384)]


def test_the_query_has_sqls_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    got = op12_centroid_clusters(spark, sf)
    want = con.sql(centroids.oracle_sql()).select(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
