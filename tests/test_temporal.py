"""Windows over chunks of a series against plain Python over the whole series."""

import random

import pytest
from pyspark.sql import functions as F

from lattiq.operators import temporal


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = []
    for s, n in ((None, 30), (1, 700), (2, 1), (3, 64), (4, 65)):
        at, frame, code = -3 if s == 1 else 0, 0, "a"
        for _ in range(n):
            rows.append((s, at, f"{code}_f{frame:05d}", at * 10))
            gap = rng.choice([1] * 12 + [2, 40])
            at += gap
            frame += gap if rng.random() < 0.9 else 3
            code = code if rng.random() < 0.95 else rng.choice("ab")
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ds_idx int, im_idx long, label string, v long").repartition(3), rows


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {s: sorted(x, key=lambda r: r[1]) for s, x in out.items()}


@pytest.mark.parametrize("n, stride, chunk", [(1, 1, 16), (2, 3, 24), (3, 2, 4096), (1, 70, 16)])
def test_stacks_of_chunks_are_those_of_the_series(series, n, stride, chunk):
    df, rows = series
    got = {(r.ds_idx, r.im_idx): r.v for r in temporal.frame_stack(df, ["v"], n, stride, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for s, x in by_series(rows).items():
        for p, r in enumerate(x):
            assert got[s, r[1]] == [x[min(max(p + j * stride, 0), len(x) - 1)][3] for j in range(-n, n + 1)]


def increment(x, p, k, sign):
    for j in range(k, 0, -1):
        q = p + sign * j
        if 0 <= q < len(x):
            a, b = x[p], x[q]
            if a[2].split("_f")[0] == b[2].split("_f")[0] and int(b[2][-5:]) == int(a[2][-5:]) + sign * j and b[1] == a[1] + sign * j:
                return j
    return 0


@pytest.mark.parametrize("back", [True, False])
def test_increments_of_chunks(series, back, monkeypatch):
    monkeypatch.setattr(temporal, "CHUNK", 16)
    df, rows = series
    got = {(r.ds_idx, r.im_idx): r.increment for r in temporal.max_increment(df, 3, back).collect()}
    for s, x in by_series(rows).items():
        assert [got[s, r[1]] for r in x] == [increment(x, p, 3, -1 if back else 1) for p in range(len(x))]


def test_null_values_are_values(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, None)], "ds_idx int, im_idx long, v int")
    assert [r.v for r in temporal.frame_stack(df, ["v"]).orderBy("im_idx").collect()] == [[None, None, 5], [None, 5, None], [5, None, None]]


def test_a_long_series_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("ds_idx"), F.col("id").alias("im_idx"), F.col("id").alias("v"))
    rows, _ = temporal.chunked(df, 2, size=1000)
    per = {r[0]: r[1] for r in rows.groupBy("__chunk").count().collect()}
    assert len(per) == 21 and max(per.values()) == 1004 and sum(per.values()) == 20_000 + 4 * 19 + 2  # the last chunk's end reaches into an empty one


def test_leaks_between_chunks(series, monkeypatch):
    monkeypatch.setattr(temporal, "CHUNK", 8)
    df, rows = series
    df = df.withColumn("id", F.xxhash64("ds_idx", "im_idx"))
    key = {(r.ds_idx, r.im_idx): r.id for r in df.collect()}
    test = df.where("v % 70 = 0")
    train, _ = temporal.leak_free_split(df, df.join(test, "id", "left_anti"), test, "id", True, True)
    lost = set()
    for s, x in by_series(rows).items():
        for p, r in enumerate(x):
            if r[3] % 70 == 0:
                lost |= {key[s, x[p + d][1]] for d in (-1, 1) if increment(x, p, 1, d)}
    in_test = {key[r[0], r[1]] for r in rows if r[3] % 70 == 0}
    assert {r.id for r in train.collect()} == set(key.values()) - lost - in_test
