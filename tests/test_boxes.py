"""Boxes by row against plain Python, splines against dense solves."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import coords, kernels, ndim, splines
from lattiq.operators import boxes

COUNTS = {((8, 8), (3, 3), 5): (3, 2), ((10, 10), (4, 4), 4): (2, 2), ((64, 32), (7, 7), 10): (4, 3), ((100, 16), (4, 4), 19): (10, 2), ((9, 9), (9, 9), 3): (3, 1)}


@pytest.mark.parametrize("given", COUNTS)
def test_counts_of_tiles(given):
    assert coords.stride_2d(*given)[1] == COUNTS[given]


def volumes(spark, shape, n=6):
    size = math.prod(shape)
    cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (F.col("id") * 1000 + j).cast("double"))
    return spark.range(n).select("id", cells.alias("data")), lambda i: (np.arange(size) + 1000.0 * i).reshape(shape)


@pytest.mark.parametrize("shape, target", [((5,), (2,)), ((4, 6), (2, 6)), ((4, 6), (4, 6)), ((3, 4, 5), (2, 3, 2)), ((3, 4, 5, 2), (1, 2, 5, 2)), ((2, 3, 2, 3, 2), (2, 1, 2, 2, 1))])
def test_crops_of_any_rank(spark, shape, target):
    df, image = volumes(spark, shape)
    starts = F.array(*[F.pmod(F.col("id") * (k + 2), F.lit(7)) - 1 for k in range(len(shape))]).cast("array<int>")
    by_column = F.array(*map(F.lit, shape))
    rows = df.select("id", starts.alias("s"), ndim.crop(F.col("data"), shape, target, starts).alias("a"), ndim.crop(F.col("data"), by_column, target, starts).alias("b"), ndim.crop(F.col("data"), shape, target).alias("c")).collect()
    for r in rows:
        begin = [min(max(s, 0), n - t) for s, n, t in zip(r.s, shape, target)]
        want = image(r.id)[tuple(slice(b, b + t) for b, t in zip(begin, target))].ravel().tolist()
        assert r.a == want and r.b == want
        assert r.c == image(r.id)[tuple(slice(0, t) for t in target)].ravel().tolist()


def test_shapes_that_differ_by_row(spark):
    df = spark.createDataFrame([(1, [2, 3], [float(x) for x in range(6)]), (2, [4, 2], [float(x) for x in range(8)]), (3, [1, 5], [float(x) for x in range(5)])], "id long, shape array<int>, data array<double>")
    got = {r.id: r.x for r in df.select("id", ndim.crop(F.col("data"), F.col("shape"), (2, 2), [5, 5]).alias("x")).collect()}
    assert got == {1: [1.0, 2.0, 4.0, 5.0], 2: [4.0, 5.0, 6.0, 7.0], 3: None}


def test_flips_and_orders_of_axes(spark):
    shape = (2, 3, 4)
    df, image = volumes(spark, shape, 2)
    for axes in ((0,), (1, 2), (0, 1, 2)):
        assert [r[0] for r in df.select(ndim.flipped(F.col("data"), shape, axes)).collect()] == [np.flip(image(i), axes).ravel().tolist() for i in range(2)]
    for order in itertools.permutations(range(3)):
        assert [r[0] for r in df.select(ndim.transposed(F.col("data"), shape, order)).collect()] == [image(i).transpose(order).ravel().tolist() for i in range(2)]


def test_drawn_boxes_stay_inside_and_differ(spark):
    df, _ = volumes(spark, (6, 20, 9), 50)
    for tile, mode, overlap in (((6, 6, 9), coords.ALLOW, 1), ((3, 9, 4), coords.ALLOW, 1), ((4, 8, 3), coords.NO_OVERLAP, 1), ((4, 7, 8), coords.FORCE, (1, 2, 3)), ((6, 20, 9), coords.ALLOW, 1)):
        fixed = df.limit(1).select(boxes.overlap_boxes((6, 20, 9), tile, mode, overlap).alias("b")).first().b
        want = coords.grid(*[coords.axis_coords_overlap(s, t, mode, o) for s, t, o in zip((6, 20, 9), tile, (overlap,) * 3 if isinstance(overlap, int) else overlap)])
        assert [tuple(b.start) for b in fixed] == want and [b.tile_id for b in fixed] == list(range(len(want)))
        drawn = df.select(boxes.overlap_boxes((6, 20, 9), tile, mode, overlap, "id", 3).alias("b")).collect()
        assert all(len(r.b) == len(want) and all(0 <= s <= n - t for b in r.b for s, n, t in zip(b.start, (6, 20, 9), tile)) for r in drawn)
        assert (len({str(r.b) for r in drawn}) > 1) == (tile != (6, 20, 9))
    some = df.select(boxes.some_boxes((20, 9), (4, 4), 7, "id").alias("b")).collect()
    assert all([b.tile_id for b in r.b] == list(range(7)) and len({tuple(b.start) for b in r.b}) == 7 for r in some) and len({str(r.b) for r in some}) > 40
    with pytest.raises(ValueError):
        boxes.overlap_boxes((4, 4), (5, 5), key="id")


def test_anchored_boxes_against_the_scalar_rule(spark):
    cases = [(a, a + w, b, b + v) for a, b in itertools.product(range(1, 17, 3), range(1, 29, 5)) for w, v in ((0, 0), (1, 2), (3, 0))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, a int, b int, c int, d int")
    for n in (1, 3, 4, 6):
        usable = []
        for i, (a, b, c, d) in enumerate(cases):
            room = (min(14, a, 20 - b), min(24, c, 30 - d))
            if n == 1 or min(room) >= 0 and max(room) > 0:
                usable.append(i)
        got = {r.id: [tuple(x.start) for x in r.t] for r in df.where(F.col("id").isin(usable)).select("id", boxes.anchor_boxes((20, 30), (6, 6), n, [F.col("a"), F.col("c")], [F.col("b"), F.col("d")]).alias("t")).collect()}
        for i in usable:
            a, b, c, d = cases[i]
            _, count = coords.stride_2d((20, 30), (6, 6), n, ((a, b), (c, d)))
            want = coords.grid(coords.anchor_axis_coords(20, 6, count[0], (a, b)), coords.anchor_axis_coords(30, 6, count[1], (c, d)))
            assert got[i] == want[:n]


def test_zoomed_boxes_lie_inside_and_are_data(spark):
    df, image = volumes(spark, (12, 10), 40)
    out = boxes.zoomed(boxes.with_boxes(df, boxes.overlap_boxes((12, 10), (5, 4))), (12, 10), (5, 4), (0.7, 1.8), (0.8, 1.25), "id", 0.7, 5)
    made = boxes.resampled(out.withColumn("same", F.col("data")), ["data", "same"], (12, 10), (5, 4), {"data": 3, "same": 0})
    rows = made.collect()
    assert all(0 <= s and 1 <= b and s + b <= n for r in rows for s, b, n in zip(r.start, r.box, (12, 10)))
    assert 0.2 < np.mean([r.box == [5, 4] for r in rows]) < 0.6 and max(r.box[0] for r in rows) > 5 > min(r.box[0] for r in rows)
    for r in rows[:20]:
        window = image(r.id)[r.start[0] : r.start[0] + r.box[0], r.start[1] : r.start[1] + r.box[1]]
        assert np.allclose(r.data, kernels.zoomed(window, (5, 4), 3).ravel()) and r.same == kernels.zoomed(window, (5, 4), 0).ravel().tolist()


def dense(n, order, edges):
    """The matrix whose inverse gives the coefficients: the basis at whole places of the mirrored axis."""
    m = np.zeros((n, n))
    for i in range(n):
        for k in range(-3, 4):
            j = splines.mirrored_index(np.array(i + k), n, edges)
            m[i, int(j)] += splines.basis(order, np.array([float(k)]))[0]
    return m


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("edges", [splines.MIRROR, splines.REFLECT])
@pytest.mark.parametrize("n", [2, 3, 7, 40])
def test_coefficients_against_a_dense_solve(order, edges, n):
    v = np.random.default_rng(1).normal(size=(n, 3))
    got = splines.coefficients(v, order, 0, edges)
    assert np.abs(got - np.linalg.solve(dense(n, order, edges), v)).max() < 1e-9
    assert np.abs(splines.matrix(n, np.arange(n, dtype=float), order, edges) @ got - v).max() < 1e-9  # through the values
    assert np.abs(splines.coefficients(v.T, order, 1, edges).T - got).max() < 1e-12


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_basis_sums_to_one_and_has_its_order(order):
    x = np.linspace(-0.5, 0.5, 11)
    assert np.allclose(sum(splines.basis(order, x + k) for k in range(-4, 5)), 1)
    # a polynomial of the order is met exactly, away from the edges
    n = 60
    v = (np.arange(n) / n) ** order
    at = np.linspace(25, 35, 33)
    assert np.abs(splines.matrix(n, at, order) @ splines.coefficients(v, order) - (at / n) ** order).max() < 1e-6


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_sampled_and_resized_against_dense_solves(order):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(9, 7, 2))
    cy, cx = (np.linalg.inv(dense(n, order, splines.MIRROR)) for n in (9, 7))
    y, x = rng.uniform(-3, 12, (4, 5)), rng.uniform(-3, 9, (4, 5))
    my, mx = (splines.matrix(n, p.ravel(), order) for n, p in ((9, y), (7, x)))
    want = np.einsum("pi,ij,pk,kl,jlc->pc", my, cy, mx, cx, a).reshape(4, 5, 2)
    assert np.abs(kernels.sampled(a, y, x, order) - want).max() < 1e-9
    big = kernels.zoomed(a, (17, 5), order)
    cy, cx = (np.linalg.inv(dense(n, order, splines.REFLECT)) for n in (9, 7))
    my, mx = splines.matrix(9, np.linspace(0, 8, 17), order, splines.REFLECT), splines.matrix(7, np.linspace(0, 6, 5), order, splines.REFLECT)
    assert np.abs(big - np.einsum("pi,ij,qk,kl,jlc->pqc", my, cy, mx, cx, a)).max() < 1e-9
    assert np.abs(big[[0, -1]][:, [0, -1]] - a[[0, -1]][:, [0, -1]]).max() < 1e-9  # corners on corners
    assert kernels.zoomed(rng.normal(size=(4, 5, 6)), (6, 5, 3), order).shape == (6, 5, 3)


def test_one_field_for_a_batch(spark):
    shape = (32, 32)
    df, image = volumes(spark, shape, 12)
    df = df.withColumns({"b": F.floor(F.col("id") / 4), "mask": F.transform("data", lambda x, i: F.when(i % 32 < 16, 1.0).otherwise(0.0)), "other": F.col("data")})
    rows = sorted(kernels.elastic_together(df, ["data", "other", "mask"], shape, "b", ["mask"], 0.7, seed=1).collect())
    moved = {}
    for r in rows:
        off = np.array(r.data).reshape(shape) - image(r.id)
        moved.setdefault(r.b, []).append(np.round(off, 6))
        assert r.data == r.other and set(r.mask) <= {0.0, 1.0}
        assert np.abs(off[[0, -1]]).max() < 1e-6 and np.abs(off[:, [0, -1]]).max() < 1e-6
    assert all((x == v[0]).all() for v in moved.values() for x in v)  # the images are ramps: equal fields move them alike
    assert {bool(np.abs(v[0]).max() > 0) for v in moved.values()} == {True, False} or len(moved) == 3
    field = kernels.elastic_field((64, 48), 15, None, 3)
    assert max(np.abs(f).max() for f in field) <= 64 / 4 / 4 * 1.5 and all(np.abs(f[0]).max() < 1e-9 for f in field)
    again = kernels.elastic_together(df, ["data"], shape, "b", [], 0.0).collect()
    assert all(r.data == image(r.id).ravel().tolist() for r in again)
