"""Tile coordinates and tilings: functions of shapes, evaluated when a plan is built."""

from __future__ import annotations

import itertools
import math

NO_OVERLAP, ALLOW, FORCE = "no_overlap", "allow", "force"


def axis_coords(size: int, tile: int, n: int) -> list[int]:
    """Starts of n tiles: one is centred, two lie at the ends, more leave gaps or overlaps as even as integers allow."""
    if n < 1 or tile > size:
        raise ValueError(f"{n} tiles of {tile} do not fit {size}")
    if n == 1:
        return [(size - tile) // 2]
    if n == 2:
        return [0, size - tile]
    spare, each = n * tile - size, n - 1
    gap, rest = divmod(abs(spare), each)
    sign = -1 if spare > 0 else 1
    return [i * tile + sign * (gap * i + min(i, rest)) for i in range(n)]


def n_tiles_for(size: int, tile: int, mode: str, min_overlap: int = 1) -> int:
    if mode == NO_OVERLAP:
        return size // tile
    if mode == ALLOW:
        return -(-size // tile)
    if mode == FORCE:
        if min_overlap >= 0:
            return 1 + -(-(size - tile) // (tile - min_overlap))
        return (size - min_overlap) // (tile - min_overlap)
    raise ValueError(f"unknown overlap mode {mode}")


def axis_coords_overlap(size: int, tile: int, mode: str = ALLOW, min_overlap: int = 1) -> list[int]:
    return [0] if size == tile else axis_coords(size, tile, n_tiles_for(size, tile, mode, min_overlap))


def grid(*axes: list[int]) -> list[tuple[int, ...]]:
    """All tile starts, the last axis fastest."""
    return list(itertools.product(*axes))


def anchor_axis_coords(size: int, tile: int, n: int, interval: tuple[int, int]) -> list[int]:
    """Starts of n tiles spread so that each holds the interval of anchors as far as it can."""
    if tile >= size:
        return [0] * n
    low, high = sorted((min(interval[0], size - tile), max(interval[1] - tile + 1, 0)))
    if n == 1:
        return [(low + high) // 2]
    return [int(low + (high - low) * (i / (n - 1))) if i < n - 1 else high for i in range(n)]


def counts_2d(exact: tuple[float, float], n: int) -> tuple[int, int]:
    """Whole numbers of tiles near the exact ones: the axis whose number is nearer to a whole one is rounded and the other takes what
    n leaves; if that is too few, one more goes where the exact number is nearer to one more."""
    rounded = min((0, 1), key=lambda a: (abs(round(exact[a]) - exact[a]), a))
    whole = [0, 0]
    whole[rounded] = round(exact[rounded])
    whole[1 - rounded] = n // whole[rounded]
    if math.prod(whole) < n:
        whole[min((0, 1), key=lambda a: (abs(whole[a] + 1 - exact[a]), a))] += 1
    return whole[0], whole[1]


def stride_2d(image: tuple[int, int], tile: tuple[int, int], n_tiles: int, anchors: tuple[tuple[int, int], tuple[int, int]] | None = None) -> tuple[tuple[int, int], tuple[int, int]]:
    """((stride y, x), (tiles y, x)) so that the two strides are near and there are about n_tiles."""
    if n_tiles == 1:
        return image, (1, 1)
    room = [s - t for s, t in zip(image, tile)]
    if min(room) < 0:
        raise ValueError("tile is larger than image")
    if anchors is not None:
        room = [min(r, a, s - b) for r, (a, b), s in zip(room, anchors, image)]
    # one stride for both axes: (room_y / s + 1)(room_x / s + 1) = n has one positive root
    half = sum(room) / (2 * (n_tiles - 1))
    stride = half + math.sqrt(half * half + math.prod(room) / (n_tiles - 1))
    count = counts_2d((room[0] / stride + 1, room[1] / stride + 1), n_tiles) if stride else (n_tiles, 1)
    return tuple(r // (c - 1) if c > 1 else s for r, c, s in zip(room, count, image)), count


def optimal_tiling(image: tuple[int, ...], tile: tuple[int, ...], target_batch: int, overlap: float = 1 / 3) -> tuple[int, int]:
    """(batch size, tiles) whose product is the target, with tiles as near as can be to what covers the image."""
    n = math.prod(image) / ((1 - overlap) * math.prod(tile))
    if n < 1:
        raise ValueError("tile volume is larger than image volume")
    near = int(n + 0.5)
    tries = [near, int(n + 1), int(n), *(x for i in range(1, near) for x in (near + i, near - i))]
    return next(((target_batch // k, k) for k in tries if target_batch % k == 0), (target_batch, 1))
