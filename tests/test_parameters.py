"""Parameters as data, errors by image, exact splits."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import augment, parameters, rowset, stats

SHAPE = (6, 8)


def images(spark, n=12):
    cells = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: F.sin((F.col("id") * 3 + j) * 0.7) + j * 0.05)
    return spark.range(n).select("id", cells.alias("raw"), cells.alias("other"), F.transform(cells, lambda x: F.when(x > 1.5, 1.0).otherwise(0.0)).alias("mask"))


def whole():
    return augment.pipeline(augment.Scaling(saturation=(0.5, 0.0)), augment.Illumination(points=3, points_yx=(3, 2), speckle=True), augment.Geometry(rotation=30, shift_y=0.2, shear=10, zoom=(0.8, 1.2), flip_y=True), seed=4)


def test_given_parameters_are_what_is_applied(spark):
    df, p, names = images(spark), whole(), ["raw", "other", "mask"]
    rows = parameters.with_parameters(df, p, names, "id", ["mask"]).collect()
    out = {r.id: r for r in p.apply(df, names, "id", SHAPE, ["mask"], keep="aug").collect()}
    for r in rows:
        g = r.aug.geometry.asDict()
        for c in ("raw", "other"):
            own = {k: v.asDict() for k, v in r.aug[c].asDict().items()}
            image = np.array(r[c]).reshape(SHAPE)
            want = parameters.augmented(image, p.steps, g, own)
            assert np.allclose(out[r.id][c], want.ravel())
            by_hand = augment.Geometry(rotation=30, shift_y=0.2, shear=10, zoom=(0.8, 1.2), flip_y=True).apply(image, {k: v for k, v in g.items() if v is not None})
            moved = parameters.augmented(image, p.steps[2:], g, None)
            assert np.allclose(by_hand, moved)
        assert set(out[r.id].mask) <= {0.0, 1.0}
        assert r.aug.raw != r.aug.other and r.aug == out[r.id].aug  # intensities are each channel's own
    again = {r.id: r.raw for r in p.apply(df.repartition(5), names, "id", SHAPE, ["mask"]).collect()}
    assert all(again[i] == out[i].raw for i in again)
    assert len({r.aug.geometry.theta for r in rows}) == 12 and all(-30 <= r.aug.geometry.theta <= 30 and 0.8 <= r.aug.geometry.zx <= 1.2 for r in rows)


def test_kept_parameters_can_be_given_again(spark, tmp_path):
    df, p = images(spark), whole()
    parameters.with_parameters(df, p, ["raw"], "id").select("id", "aug").write.parquet(str(tmp_path / "aug"))
    kept = spark.read.parquet(str(tmp_path / "aug"))
    a = parameters.apply_parameters(df.join(kept, "id"), p, ["raw"], SHAPE).select("id", "raw").collect()
    assert {r.id: r.raw for r in a} == {r.id: r.raw for r in p.apply(df, ["raw"], "id", SHAPE).collect()}
    still = kept.withColumn("aug", F.col("aug").withField("geometry", F.lit(None).cast(parameters.GEOMETRY)))
    b = {r.id: r.raw for r in parameters.apply_parameters(df.join(still, "id"), p, ["raw"], SHAPE).collect()}
    assert any(b[r.id] != r.raw for r in a)


def test_without_randomness(spark):
    df, p = images(spark), whole().deterministic()
    s = p.steps[0]
    for r in p.apply(df, ["raw", "mask"], "id", SHAPE, ["mask"], keep="aug").join(df.select("id", F.col("raw").alias("was"), F.col("mask").alias("m")), "id").collect():
        assert np.allclose(r.raw, s.apply(np.array(r.was).reshape(SHAPE), s.constant()).ravel()) and r.mask == r.m and r.aug.geometry is None


def test_adjusted_before_use(spark):
    df = images(spark).withColumn("mask", F.transform("mask", lambda x, i: F.when((F.col("id") % 2 == 0) & (i == 3), 1.0).otherwise(0.0)))
    rows = parameters.with_parameters(df, whole(), ["raw"], "id")
    held = parameters.adjusted(rows, "mask", parameters.keep_at_borders(SHAPE)).select("id", "aug.geometry.*").collect()
    assert all((r.theta == 0 and r.tx == 0 and r.zy == 1 and r.zx != 1) == (r.id % 2 == 0) for r in held)


def test_modes_draw_within_their_ranges(spark):
    df = spark.range(300)
    draw = lambda s: df.select(parameters.scaling(s, "id").alias("p")).select("p.*").collect()
    crossed = augment.Scaling(centiles_low=(10, 90), centiles_high=(20, 95))
    assert all(10 + 80 * r.low < 20 + 75 * r.high for r in draw(crossed))
    minmax = draw(augment.Scaling(augment.RANDOM_MIN_MAX, value_range=(-1.0, 2.0), least_width=0.5))
    assert all(-1 <= r.low and r.low + 0.5 <= r.high <= 2 for r in minmax) and max(r.high for r in minmax) > 1.8
    assert all(r.center == 1.5 and r.scale == 3 for r in draw(augment.Scaling(augment.CONSTANT, center_range=(1, 2), scale_range=(2, 4))))
    noise = df.select(parameters.illumination(augment.Illumination(speckle=True), "id").alias("p")).select("p.*").collect()
    on = collections.Counter(sum(x is not None for x in (r.gaussian, r.poisson, r.speckle)) for r in noise)
    assert set(on) == {0, 1, 2, 3} and all((r.poisson or 0) <= 0.1 * 1.5 for r in noise) and all(len(r.deltas) == 7 and r.deltas[0] == 0 for r in noise)
    with pytest.raises(ValueError):
        parameters.with_parameters(df, augment.Pipeline([crossed, crossed]), ["x"], "id")


def test_scaling_from_the_data_and_as_a_function(spark):
    v = spark.range(5000).select((F.col("id") % 100 / 10.0).alias("v"))
    s = parameters.scaling_of(v, augment.BRIGHT_FIELD)
    assert s.center_range[0] < 4.95 < s.center_range[1] and s.scale_range[0] < s.scale_range[1]
    m = parameters.scaling_of(v, augment.RANDOM_MIN_MAX)
    assert m.value_range[0] < 1 and m.value_range[1] > 9
    f = parameters.scaling_function(augment.BRIGHT_FIELD, center_range=(1, 1), scale_range=(2, 2))
    assert f(np.full((2, 2), 5.0), np.random.default_rng(0)).tolist() == [[2.0, 2.0]] * 2


def test_channels_of_an_image_share_a_draw(spark):
    df = spark.range(5).select("id", F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: (j % 24 * 2.0 + F.floor(j / 24))).alias("x"))
    df = df.select("id", F.transform(F.sequence(F.lit(0), F.lit(71)), lambda j: F.floor(j / 3).cast("double")).alias("x"))
    p = augment.pipeline(augment.Scaling(augment.BRIGHT_FIELD, center_range=(0, 5), scale_range=(1, 3)), seed=2)
    for r in parameters.with_channels_processed(df, "x", p, [0, 2], (4, 6, 3), "id").collect():
        a = np.array(r.x).reshape(4, 6, 3)
        assert (a[..., 0] == a[..., 2]).all() and (a[..., 1] == np.arange(24).reshape(4, 6)).all() and not (a[..., 0] == a[..., 1]).all()


def test_errors_of_images_and_their_parts(spark):
    rows = [(1, [0.0, 2.0], [1.0, 1.0]), (1, [4.0], [4.5]), (2, [0.0], [3.0]), (None, [1.0], [1.0]), (3, None, [1.0])]
    df = spark.createDataFrame(rows, "i long, y array<double>, p array<double>")
    by = {r.i: r for r in stats.evaluated(df, "y", "p", metrics={"n": lambda y, p: sum(map(len, y))}, by=["i"]).collect()}
    assert by[1].mse == pytest.approx(2.25 / 3) and by[1].maem == pytest.approx(0.75) and by[1].n == 3
    assert by[2].mse == 9 and by[2].msem is None and by[None].mae == 0 and by[3].n is None
    one = stats.evaluated(df, "y", "p", ["mae"], {"n": lambda y, p: len(y[0])}).collect()
    assert sorted((r.i or 0, r.mae, r.n) for r in one if r.mae is not None) == [(0, 0, 1), (1, 0.5, 1), (1, 1, 2), (2, 3, 1)]
    with pytest.raises(ValueError):
        stats.evaluated(df, "y", "p", ["rmse"])


def test_exact_sizes_over_strata(spark):
    sizes = {"a": 500, "b": 303, "c": 7, None: 90, "d": 2, "e": 99}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "i long, s string")
    for test, train in ((0.25, None), (137, None), (0.1, 0.5), (None, 0.8), (60, 200)):
        n_train, n_test = rowset.split_sizes(len(rows), test, train)
        a, b = rowset.split_by_size(df, "i", test, train, "s")
        a, b = a.collect(), b.collect()
        assert (len(a), len(b)) == (n_train, n_test) and not {r.i for r in a} & {r.i for r in b}
        got, quota = collections.Counter(r.s for r in a), {s: n * n_train / len(rows) for s, n in sizes.items()}
        assert all(abs(got[s] - q) < 1 for s, q in quota.items())
        more = sorted(q % 1 for s, q in quota.items() if got[s] > q)
        less = sorted(q % 1 for s, q in quota.items() if got[s] <= q and q % 1)
        assert not more or not less or more[0] >= less[-1] - 1e-9
    plain = rowset.split_by_size(df, "i", 100, 300)
    assert [x.count() for x in plain] == [300, 100]
    for bad in ((0, 1002), (1001, None), (3, None)):
        with pytest.raises(ValueError):
            rowset.split_by_size(df, "i", *bad, "s")
    with pytest.raises(ValueError):
        rowset.split_by_size(df.where("i < 501"), "i", 0.5, None, "s")
