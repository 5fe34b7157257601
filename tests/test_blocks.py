"""Matrices and vectors as tables of blocks, QR as a tree, and the solvers on them."""

import numpy as np
import pytest

from counterpoise.operators import blocks, solve


def entries_of(spark, cells):
    return spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in cells], "row long, col long, val double")


def vector(spark, values):
    return blocks.pack(spark.createDataFrame([(int(i), [float(x) for x in np.atleast_1d(v)]) for i, v in values.items()], "i long, vec array<double>"), "i")


def read(table, width=1):
    return {r["i"]: np.array(r["vec"]) for r in blocks.unpack(table, "i", width).collect()}


@pytest.mark.parametrize("side", [7, 1024])
def test_products_with_wide_sparse_and_negative_indices(spark, monkeypatch, side):
    monkeypatch.setattr(blocks, "SIDE", side)
    monkeypatch.setattr(blocks, "PIECE", 5)
    monkeypatch.setattr(blocks, "HELD_BLOCKS", 2)
    rng = np.random.default_rng(3)
    rows, cols = rng.choice([-9, -1, 0, 3, 8, 10**12, 10**12 + 5, 44], 60), rng.choice([-4, 0, 1, 2, 13, 10**11, 99], 60)
    cells = list(zip(rows, cols, rng.normal(size=60)))
    a = blocks.BlockMatrix(entries_of(spark, cells).repartition(5))
    x = {j: rng.normal(size=3) for j in set(cols)}
    want = {}
    for i, j, v in cells:
        want[i] = want.get(i, 0) + v * x[j]
    got = read(a.times(vector(spark, x), 3), 3)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    y = {i: rng.normal() for i in set(rows)}
    back = {}
    for i, j, v in cells:
        back[j] = back.get(j, 0) + v * y[i]
    got = read(a.times(vector(spark, y), transposed=True))
    assert got.keys() == back.keys() and all(got[j][0] == pytest.approx(back[j]) for j in back)
    assert set(read(a.columns())) == set(cols)


def test_sums_and_inner_products(spark):
    rng = np.random.default_rng(4)
    x, y = {i: rng.normal() for i in range(0, 3000, 7)}, {i: rng.normal() for i in range(0, 3000, 5)}
    tx, ty = vector(spark, x), vector(spark, y)
    want = sum(x[i] * y[i] for i in x if i in y)
    assert blocks.inner(tx, ty)[0, 0] == pytest.approx(want)
    assert blocks.dots([tx, ty], ty) == pytest.approx([want, sum(v * v for v in y.values())])
    got = read(blocks.combined([(2.0, tx), (-1.0, ty)]))
    assert all(got[i][0] == pytest.approx(2 * x.get(i, 0) - y.get(i, 0)) for i in x.keys() | y.keys())


def test_qr_keeps_small_directions_and_drops_none_with_weight(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 2)
    rng = np.random.default_rng(5)
    scale = 10.0 ** -np.arange(11)
    dense = rng.normal(size=(500, 11)) * scale
    table = blocks.pack(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(dense)], "i long, vec array<double>").repartition(9), "i")
    values, vectors = blocks.singular(table, 11)
    assert values == pytest.approx(np.linalg.svd(dense, compute_uv=False), rel=1e-4)
    q, rank = blocks.orthonormal(table, 11)
    assert rank == 11
    assert blocks.inner(q, q, 11, 11) == pytest.approx(np.eye(11), abs=1e-12)
    flat = np.hstack((dense[:, :2], dense[:, :1] + dense[:, 1:2], np.zeros((500, 1))))
    table = blocks.pack(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(flat)], "i long, vec array<double>"), "i")
    assert blocks.orthonormal(table, 4)[1] == 2


def test_solvers_on_tables(spark):
    rng = np.random.default_rng(6)
    dense = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.5)
    a = solve.BlockMatrix(entries_of(spark, [(i, j, dense[i, j]) for i in range(40) for j in range(6) if dense[i, j]]))
    b = rng.normal(size=6)
    x = read(solve.conjugate_gradient(a, vector(spark, dict(enumerate(b))), lam=0.5, max_iter=8))
    got = np.array([x[i][0] for i in range(6)])
    assert (dense.T @ dense + 0.5 * np.eye(6)) @ got == pytest.approx(b, abs=1e-6)
    values, vectors, _ = solve.lanczos(a, 6)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(dense.T @ dense))[::-1], rel=1e-6)
    kept = solve.verify_eigenvectors(a, vectors, 1e-6, max_keep=2, width=6)
    assert [k[0] for k in kept] == [0, 1]
