"""Draws along an array, parameters as maps, and schedules: expressions that a row's key or step decides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.operators.positions import hash_order


def unit(n: Column, seed: int = 0, times: Column | int = 1, plus: Column | None = None) -> Column:
    """A number from 0 to 1 (exclusive) for each integer n * times + plus + seed."""
    return hash_order(n, seed, times, plus) / F.lit(4294967296.0)


def drawn(key: Column, number: Column | int, seed: int = 0) -> Column:
    """The draw of a key with this number, from 0 to 1 (exclusive): 32 bits of an md5, so that draws of one key and of neighbouring keys have
    nothing to do with each other. ``unit`` is cheaper and even over keys, but its draws of one key lie in a fixed pattern."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(number).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def choice(values: Column, size: int, key: Column, p: Column | None = None, replace: bool = True, seed: int = 0) -> Column:
    """``size`` items of an array, by a row's own draws; ``p`` weighs the items and need not sum to 1.

    Without replacement, items are ordered by exponential waiting times (by a hash alone if all weigh the same), items of weight 0
    are never taken, and too few items are an error. A null or empty array gives null with replacement.
    """
    n = F.size(values)
    if replace:
        u = lambda i: unit(key, seed, size, i)
        steps = F.sequence(F.lit(0), F.lit(size - 1))
        if p is None:
            at = lambda i: F.floor(u(i) * n).cast("int")
        else:
            total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)

            def at(i: Column) -> Column:
                target = u(i) * total
                start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i"))
                passed = F.aggregate(p, start, lambda s, x: F.struct((s["c"] + x).alias("c"), (s["i"] + (s["c"] + x <= target).cast("int")).alias("i")))
                return F.least(passed["i"], n - 1)

        return F.when(n > 0, F.transform(steps, lambda i: F.get(values, at(i))))
    h = lambda j: hash_order(key, seed, n, j)
    if p is None:
        order = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(h(j).cast("double").alias("t"), j.alias("j")))
    else:
        order = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((-F.log((h(j) + 1) / F.lit(4294967297.0)) / F.when(F.get(p, j) > 0, F.get(p, j))).alias("t"), j.alias("j")))
        order = F.filter(order, lambda t: F.get(p, t["j"]) > 0)
    taken = F.transform(F.slice(F.array_sort(order), 1, size), lambda t: F.get(values, t["j"]))
    return F.when((n > 0) & (F.size(taken) == size), taken).otherwise(F.raise_error(F.lit(f"fewer than {size} items to draw")))


def updated(parameters: Column, changes: Column) -> Column:
    """A map with another's entries in place of its own."""
    kept = F.filter(F.map_entries(parameters), lambda e: ~F.array_contains(F.map_keys(changes), e["key"]))
    return F.map_from_entries(F.concat(kept, F.map_entries(changes)))


def cosine_decay(step: Column, steps: int, start: float = 1.0, least: float = 0.01) -> Column:
    """From ``start`` down to ``least`` along half a cosine, constant after it."""
    alpha = least / start
    wave = (F.cos(F.least(step, F.lit(steps)) * F.lit(math.pi) / F.lit(steps)) + 1) * 0.5
    return (wave * (1 - alpha) + alpha) * start


def due(epoch: Column, frequency: int | Sequence[int]) -> Column:
    """Whether an epoch, counted from 0, is one of every so many, or of a list counted from 1."""
    return F.pmod(epoch + 1, F.lit(frequency)) == 0 if isinstance(frequency, int) else (epoch + 1).isin(list(frequency))
