"""Whitening against exact integers and a dense eigenvalue problem."""

import math
from fractions import Fraction

import numpy as np
import pytest

from touchline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "c", 0) for i, v in vectors], schema)


def by_hand(vectors):
    """n, sums, exact deviations, covariance by whole-number arithmetic."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    far = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    covariance = np.array([[float(Fraction(sum(f[a] * f[b] for f in far), n**3)) for b in range(d)] for a in range(d)])
    return n, sums, [sum(v * v for v in f) for f in far], np.array(far, float) / n, covariance


def check(rows, vectors, ids, components):
    n, _, deviations, centred, covariance = by_hand(vectors)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = len({r.component for r in rows})
    assert k == min(components, int((values > 1e-20 * values[0]).sum())) and {r.component for r in rows} == set(range(1, k + 1))
    assert len(rows) == k * len(vectors) and {r.n for r in rows} == {n}
    deviation = sorted(((r.vec_id, r.deviation) for r in rows if r.component == 1), key=repr)
    assert deviation == sorted(zip(ids, deviations, strict=True), key=repr)
    error = {r.identity_error for r in rows}
    assert len(error) == 1 and error.pop() <= 1e-8
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        lone = all(abs(values[c] - v) > 1e-6 * values[0] for i, v in enumerate(values) if i != c)
        expected = centred @ axes[:, c] / math.sqrt(values[c])
        found = np.array([got[i, c + 1].whitened for i in ids])
        assert abs(got[ids[0], c + 1].explained / (values[c] / np.trace(covariance)) - 1) < 1e-9
        if lone:
            assert min(np.abs(found - expected).max(), np.abs(found + expected).max()) < 1e-6
    white = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    white = white - white.mean(0)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("components", [3, 32])
def test_matches_brute_force(spark, components):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(150, 12)) * np.geomspace(5, 0.05, 12)).astype(np.float32)
    rows = whitening.whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(3), components).collect()
    check(rows, vectors, list(range(150)), components)


def test_nearly_dependent_columns(spark):
    """Eigenvalues 10**14 apart: a Gram matrix alone has two digits of the small ones."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 6))
    vectors = np.column_stack([base * 1e6, base[:, :2] * 1e6 + rng.normal(size=(200, 2)) / 8])
    rows = whitening.whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))).collect()
    n, _, deviations, centred, _ = by_hand(vectors)
    singular = np.linalg.svd(centred, compute_uv=False)
    got = {r.component: r.explained for r in rows}
    assert len(got) == 8
    for c, value in enumerate(singular**2 / (singular**2).sum(), 1):
        assert abs(got[c] / value - 1) < 1e-4
    assert rows[0].identity_error < 1e-4
    assert {r.vec_id: r.deviation for r in rows} == {i: v if v < 1 << 63 else None for i, v in enumerate(deviations)}


def test_constant_and_repeated_columns_have_no_component(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 3))
    vectors = np.column_stack([base, base[:, 0], np.full(80, 0.5), np.zeros(80)]).astype(np.float32)
    rows = whitening.whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])).collect()
    assert {r.component for r in rows} == {1, 2, 3} and rows[0].identity_error < 1e-8
    assert abs(sum(r.explained for r in rows if r.vec_id == 0) - 1) < 1e-9


def test_rows_of_all_kinds(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    good += [(None, [0.0] * 4), good[3], good[3], (99, [-0.25, 1e-9, -1e-9, 3.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0]), (53, [1.0, float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0, 1.0]), (55, [1.0] * 3)]
    rows = whitening.whiten(table(spark, good + bad)).collect()
    assert {r.vec_id for r in rows} == {i for i, _ in good} and len(rows) == 4 * len(good)
    check_ids = [i for i, _ in good]
    _, _, deviations, _, _ = by_hand([np.float32(v) for _, v in good])
    assert sorted(((r.vec_id, r.deviation) for r in rows if r.component == 2), key=repr) == sorted(zip(check_ids, deviations, strict=True), key=repr)
    assert rows[0].identity_error < 1e-8
    for empty in ([], bad[:5], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = whitening.whiten(table(spark, empty))
        assert found.collect() == [] and found.columns == [f.split()[0] for f in whitening.FIELDS.split(", ")]


def test_numbers_beyond_64_bits(spark):
    vectors = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [5.0, 2.0]), (3, [1e15, -1.0])]
    rows = whitening.whiten(table(spark, vectors, SCHEMA.replace("float", "double"))).collect()
    # the second column is lost beside the first: its share of the variance is below a double's digits
    assert {r.vec_id for r in rows} == {0, 1, 2, 3} and all(r.deviation is None for r in rows)
    near = [(i, [c * 2.0**20 for c in v]) for i, v in enumerate([[1.5, 2], [3, -4], [5, 6], [-7, 0.25]])]
    rows = whitening.whiten(table(spark, near, SCHEMA.replace("float", "double"))).collect()
    check(rows, [v for _, v in near], [0, 1, 2, 3], 32)


def test_wide_and_narrow_arithmetic_agree():
    rng = np.random.default_rng(5)
    x = rng.integers(999_000, 1_001_000, (50, 5))
    sums = tuple(int(v) for v in x.sum(0))
    assert (whitening.differences(x, 50, sums, False) == whitening.differences(x, 50, sums, True)).all()


def test_registered_query_on_the_given_table(spark):
    from touchline.llm.queries import QUERIES

    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    rows = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    check(rows, [r.embedding for r in given], [r.vec_id for r in given], 32)
