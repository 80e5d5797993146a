"""Components of links: against plain union, and how many tasks the driver has to keep a record of."""

import random

import pytest

from lattiq.llm import common


def brute(edges):
    low = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    while True:
        new = dict(low)
        for a, b in edges:
            if a in new and b in new and a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def graph():
    r = random.Random(3)
    some = [(r.randrange(-20, 300), r.randrange(-20, 300)) for _ in range(150)]
    return [*some, *some[:40], *((500, k) for k in range(501, 600)), *((k + 1, k) for k in range(700, 730)), (None, 3), (4, None), (5, 5), (900, 900)]


@pytest.mark.parametrize("most", [16, 1 << 18])
def test_components_of_contracted_parts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "CONTRACTED", most)
    for edges in (graph(), [(1, 1)]):
        rows = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in rows} == brute(edges) and len(rows) == len(brute(edges))


def test_few_links_take_few_tasks_however_many_partitions(spark):
    """A round of stars shuffles over all partitions, and the driver's memory holds every task of them."""
    sc, held = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("components", "components")
    try:
        common.connected_components(spark.createDataFrame(graph(), "a long, b long")).collect()
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
        assert sum(x.numCompletedTasks for s in stages if (x := status.getStageInfo(s))) < 24 * 5
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
