"""Kernels, coordinates, sources and sinks against numpy and round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattiq.functions import coords, images, kernels, paths
from lattiq.operators import align, augment, mining, rowset
from lattiq.operators.positions import quantiles, with_positions
from lattiq.sources import files, sinks
from lattiq.streaming import epochs


def test_coordinates():
    assert coords.axis_coords(10, 4, 3) == [0, 3, 6]
    assert coords.axis_coords(10, 4, 1) == [3] and coords.axis_coords(10, 4, 2) == [0, 6]
    assert coords.axis_coords_overlap(8, 8) == [0]
    assert coords.anchor_axis_coords(10, 4, 2, (4, 5)) == [2, 4]
    assert coords.optimal_tiling((64, 64), (32, 32), 12) == (2, 6)
    strides, n = coords.stride_2d((64, 32), (16, 16), 8)
    assert n[0] * n[1] >= 8 and n[0] > n[1]


@given(st.integers(1, 200), st.data())
@settings(max_examples=200, deadline=None)
def test_tiles_cover_evenly(size, data):
    tile = data.draw(st.integers(1, size))
    n = data.draw(st.integers(1, 30))
    c = coords.axis_coords(size, tile, n)
    assert len(c) == n and 0 <= min(c) and max(c) + tile <= size and c == sorted(c)
    if n > 2:
        gaps = np.diff(c)
        assert gaps.max() - gaps.min() <= 1 and c[0] == 0 and c[-1] == size - tile


def test_dihedral_maps(spark):
    x = np.arange(12.0).reshape(3, 4)
    want = [x, x[::-1], x[:, ::-1], x[::-1, ::-1]]
    want += [np.rot90(w) for w in want]
    row = spark.createDataFrame([(x.ravel().tolist(),)], "data array<double>").select(*[images.dihedral(F.col("data"), (3, 4), k).alias(f"k{k}") for k in range(8)]).first()
    assert [list(v) for v in row] == [w.ravel().tolist() for w in want]


def test_kernels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 9))
    flat = np.ones((6, 6))
    assert np.allclose(kernels.gaussian_blur(flat, 2.0), flat) and abs(kernels.gaussian_blur(x, 1.0).mean() - x.mean()) < 0.1
    f = kernels.pchip(np.array([0.0, 1, 3, 4]), np.array([0.0, 1, 2, 2]))
    at = np.linspace(0, 4, 100)
    assert np.allclose(f(np.array([0.0, 1, 3, 4])), [0, 1, 2, 2]) and (np.diff(f(at)) >= -1e-12).all()
    d = kernels.histogram_deform(x, np.array([0, 0.5, -0.5, 0]))
    assert d.min() == pytest.approx(x.min()) and d.max() == pytest.approx(x.max()) and (np.argsort(d.ravel()) == np.argsort(x.ravel())).all()
    lit = kernels.illumination(x, np.array([0.5, 1.0, 0.7]), np.array([1.0, 0.8]))
    assert lit.min() == pytest.approx(x.min()) and lit.max() == pytest.approx(x.max())
    assert np.allclose(kernels.affine(x), x) and np.allclose(kernels.affine(x[:9, :9], theta=90, order=0), np.rot90(x[:9, :9], -1))
    assert np.allclose(kernels.zoomed(x, (23, 17))[::2, ::2], x)
    assert np.allclose(kernels.elastic(x, 4, 0.0, 1), x)
    assert kernels.poisson_noise(flat, 0.5, rng) is flat


def test_augmentation_is_repeatable():
    x = np.random.default_rng(1).normal(size=(8, 8))
    p = augment.pipeline(augment.Scaling(), augment.Illumination(), augment.Geometry(rotation=30, flip_y=True), seed=5)
    assert np.array_equal(p.image(x, 7), p.image(x, 7)) and not np.array_equal(p.image(x, 7), p.image(x, 8))
    assert np.array_equal(p.deterministic().image(x, 7), p.deterministic().image(x, 8))
    mask = (x > 0).astype(float)
    assert set(np.unique(p.image(mask, 7, mask=True))) <= {0.0, 1.0}
    with pytest.raises(NotImplementedError):
        augment.Scaling(augment.FLUORESCENCE, per_image=True)


def test_intensity_generators_against_numpy():
    """With given parameters: values between two percentiles, both curves under a root, noise by its own level."""
    x = np.random.default_rng(3).gamma(2.0, size=(9, 11))
    s = augment.Scaling(centiles_low=(1, 6), centiles_high=(90, 99), saturation=(0.0, 0.5))
    a, b, c, d = np.percentile(x, [1, 6, 90, 99])
    lo, hi = a + (b - a) * 0.25, c + (d - c) * 0.75
    y = (x - lo) / (hi - lo)
    assert np.allclose(s.apply(x, {"low": 0.25, "high": 0.75}), np.where(y < 0, 0, np.where(y > 1, np.sqrt(np.maximum(y, 1)), y)))
    assert np.allclose(s.apply(x, s.constant()).min(), 0) and s.constant()["ranks"] == (3.5, 94.5)
    crossed = augment.Scaling(centiles_low=(10, 90), centiles_high=(20, 95))
    for k in range(50):
        p = crossed.draw(np.random.default_rng(k))
        assert 10 + 80 * p["low"] < 20 + 75 * p["high"]
    lit = augment.Illumination(points=0, points_yx=(2, 2), blur=(0, 0))
    py, px = np.array([0.5, 1.0]), np.array([0.9, 0.4])
    raw = (x - x.min()) * np.interp(np.arange(9), [0, 8], np.sqrt(py))[:, None] * np.interp(np.arange(11), [0, 10], np.sqrt(px))
    assert np.allclose(lit.apply(x, {"y": py, "x": px}), np.interp(raw, (raw.min(), raw.max()), (x.min(), x.max())))
    one = (x - x.min()) * np.interp(np.arange(9), [0, 8], py)[:, None]
    assert np.allclose(lit.apply(x, {"y": py}), np.interp(one, (one.min(), one.max()), (x.min(), x.max())))
    noise = augment.Illumination(points=0, speckle=True)
    drawn = [noise.draw(np.random.default_rng(k)) for k in range(400)]
    for p in drawn:
        on = [k for k in ("gaussian", "poisson", "speckle") if k in p]
        assert all(p[k] <= 0.1 / 1.5 ** (len(on) - 1) * (0.7 if k == "gaussian" else 1) for k in on)
    assert len({len(p) for p in drawn}) == 4 and any(abs(p.get("gaussian", 0) / 0.7 - p.get("poisson", 0)) > 0.01 for p in drawn)
    rng = np.random.default_rng(8)
    assert np.allclose(lit.apply(x, {"gaussian": 0.2}, np.random.default_rng(8)), x + rng.normal(0, 0.2, x.shape))
    assert augment.Scaling(augment.RANDOM_MIN_MAX, value_range=(-1.0, 2.0), least_width=3.0).draw(rng) == {"to": (-1.0, 2.0)}


def test_quantiles_percentiles_and_ids(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.zeros(400), rng.normal(size=700), [-3.0] * 50])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(7)
    assert np.allclose(quantiles(df, "v", [0, 0.01, 0.3, 0.5, 0.99, 1]), np.quantile(v, [0, 0.01, 0.3, 0.5, 0.99, 1]))
    assert quantiles(df.limit(0), "v", [0.5]) == [None]
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate((1, 2, 17, 64))] + [(9, [])]
    got = {r.i: r.q for r in spark.createDataFrame(rows, "i long, d array<double>").select("i", images.percentiles(F.col("d"), [0, 12.5, 50, 100]).alias("q")).collect()}
    assert got[9] is None and all(np.allclose(got[i], np.percentile(d, [0, 12.5, 50, 100])) for i, d in rows if d)
    for n in (0, 1, 2, 10, 17):
        parts, at = [], 5
        for k in range(n):
            parts.append((f"d{k}", k % 4, at))
            at += k % 4
        catalog = spark.createDataFrame(parts, "ds_path string, n long, offset long")
        ids = spark.range(0, at + 3).withColumnRenamed("id", "global_idx")
        want = [(g, p, g - o) for p, m, o in parts for g in range(o, o + m)]
        assert sorted(map(tuple, align.resolve_ids(ids, catalog).collect())) == sorted(want)


def numpy_probability(m, enrich, qmin, qmax):
    q0, q1 = np.quantile(m, [qmin, qmax])
    nh, ne = (m <= q0).sum(), (m >= q1).sum()
    r = (m[(m > q0) & (m < q1)] - q1) / (q0 - q1)
    pmax = enrich / len(m)
    rest = len(r) + ne - r.sum()
    pmin, power = ((1 - pmax * (nh + r.sum())) / rest if rest else -1), 1.0
    if pmin < 0:
        pmin, target = 0.0, 1 / pmax - nh
        power = 10.0
        if target > 0:
            power, s = 1.0, r.sum()
            while power < 10 and s > target:
                power += 0.1
                s = (r**power).sum()
            if power > 1 and s < target:
                power -= 0.1
    p = np.where(m <= q0, pmax, np.where(m >= q1, pmin, pmin + (pmax - pmin) * np.clip((m - q1) / (q0 - q1), 0, None) ** power))
    return p / p.sum()


@pytest.mark.parametrize("case", range(3))
def test_mining_regimes(spark, case):
    rng = np.random.default_rng(case)
    m = [np.concatenate([np.zeros(30), rng.uniform(1, 1.01, 970)]), rng.uniform(0, 1, 800), np.concatenate([np.zeros(200), rng.uniform(0, 1, 600)])][case]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m)], "i long, m double")
    got = np.array([r.p for r in mining.index_probability(df, "m").orderBy("i").collect()])
    assert got.sum() == pytest.approx(1) and np.allclose(got, numpy_probability(m, 10, 0.01, 0.99), rtol=1e-6)


def test_positions_batches_and_draws(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    pos = with_positions(df, -F.col("i"))
    assert [(r.i, r.pos) for r in pos.orderBy("pos").collect()] == [(9 - k, k) for k in range(10)]
    sizes = lambda mode: sorted((r["batch"], r["count"]) for r in rowset.batched(pos, 4, 10, mode).groupBy("batch").count().collect())
    assert sizes(rowset.KEEP) == [(0, 4), (1, 4), (2, 2)] and sizes(rowset.REMOVE) == [(0, 4), (1, 4)] and sizes(rowset.CONSTANT_SIZE) == [(0, 4), (1, 4), (2, 4)]
    small = rowset.batched(with_positions(spark.range(3), "id"), 4, 3, rowset.CONSTANT_SIZE)
    assert small.count() == 4
    w = spark.createDataFrame([(i, float(i)) for i in range(5)], "i long, w double")
    draws = rowset.resampled(w, "w", 1000, "i").groupBy("i").count().collect()
    assert sum(r["count"] for r in draws) == 1000 and all(abs(r["count"] - 100 * r.i) <= 2 for r in draws)


def test_epochs(spark):
    got = list(epochs.batches(spark.range(7).withColumnRenamed("id", "i"), "i", 3, epochs=2))
    assert [len(b) for *_, b in got] == [3, 3, 1, 3, 3, 1] and sorted(r.i for *_, b in got[:3] for r in b) == list(range(7))
    assert [r.i for *_, b in got[:3] for r in b] != [r.i for *_, b in got[3:] for r in b]


def test_npy_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    movie = rng.normal(size=(5, 4, 3))
    (tmp_path / "a").mkdir()
    np.save(tmp_path / "a" / "raw.npy", movie)
    rows = files.open_dataset(spark, str(tmp_path / "a" / "raw.npy")).orderBy("im_idx").collect()
    assert len(rows) == 5 and all(np.allclose(np.array(r.data).reshape(r.shape), movie[r.im_idx]) for r in rows)
    df = spark.createDataFrame([("d/raw", i, movie[i].ravel().tolist()) for i in range(5)], "ds_path string, im_idx long, data array<double>")
    sinks.write_npy(df, str(tmp_path / "out"), 5, (4, 3))
    back = files.read_frames(spark, str(tmp_path / "out"), name="raw", one_image_per_file=True).collect()
    assert {r.im_idx for r in back} == set(range(5)) and all(np.allclose(r.data, movie[r.im_idx].ravel()) for r in back)
    sinks.write_predictions(df, str(tmp_path / "p"), "data", "raw", "seg")
    assert spark.read.parquet(str(tmp_path / "p")).select("ds_path").distinct().first()[0] == "d/seg"
    with pytest.raises(ValueError):
        files.open_dataset(spark, "x.xyz")


def test_path_expressions(spark):
    df = spark.createDataFrame([("a/b/b.c", "x-3_f00012")], "p string, l string")
    r = df.select(paths.replace_last(F.col("p"), "b", "Z"), paths.replace_last(F.col("p"), "q", "Z"), paths.neighbor_label(F.col("l"), -13), paths.neighbor_label(F.col("l"), 99990), paths.metadata_frame(F.col("l"))).first()
    assert list(r) == ["a/b/Z.c", "a/b/b.c", None, "x-3_f100002", "12-3"]
