"""Uncompressed TIFF files of numbers, so that no library is needed to write and read back images."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: tags, and a sample format for each kind of number.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, BYTES, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
KINDS = {"u": 1, "i": 2, "f": 3}
FIELD = {1: "B", 3: "H", 4: "I"}


def encode(pages: np.ndarray) -> bytes:
    """One page for each image of (pages, rows, columns) or (rows, columns)."""
    pages = pages[None] if pages.ndim == 2 else pages
    if pages.ndim != 3 or pages.dtype.kind not in KINDS:
        raise ValueError(f"not pages of numbers: {pages.shape} {pages.dtype}")
    pages = np.ascontiguousarray(pages, dtype=pages.dtype.newbyteorder("<"))
    size, (n, h, w) = pages[0].nbytes, pages.shape
    size += size % 2
    tags = lambda at: [(WIDTH, w), (HEIGHT, h), (BITS, 8 * pages.itemsize), (COMPRESSION, 1), (PHOTOMETRIC, 1), (STRIPS, at), (SAMPLES, 1), (ROWS, h), (BYTES, pages[0].nbytes), (FORMAT, KINDS[pages.dtype.kind])]
    block = size + 2 + 12 * len(tags(0)) + 4
    if 8 + n * block >= 1 << 32:
        raise ValueError("pages of more than 4 GB do not fit one file")
    out = [struct.pack("<2sHI", b"II", 42, 8 + size)]
    for i, page in enumerate(pages):
        at = 8 + i * block
        out.append(page.tobytes().ljust(size, b"\0"))
        entries = tags(at)
        out.append(struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in entries))
        out.append(struct.pack("<I", at + block + size if i + 1 < n else 0))
    return b"".join(out)


@dataclass(frozen=True)
class Page:
    """One directory of a file: the shape and type of its pixels, and (offset, bytes) of its strips."""

    shape: tuple[int, ...]
    dtype: str
    strips: tuple[tuple[int, int], ...]


def directories(read: Callable[[int, int], bytes]) -> Iterator[Page]:
    """The pages of a file of which ``read(offset, size)`` gives bytes, without their pixels. Compressed or tiled pages are an error."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", head[4:8])[0]
    while at:
        (n,) = struct.unpack(order + "H", read(at, 2))
        block = read(at + 2, 12 * n + 4)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", block, 12 * k)
            if kind in FIELD:
                form = f"{order}{count}{FIELD[kind]}"
                size = struct.calcsize(form)
                raw = block[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", block, 12 * k + 8)[0], size)
                tags[tag] = struct.unpack(form, raw)
        if tags.get(COMPRESSION, (1,))[0] != 1 or STRIPS not in tags or tags.get(PLANAR, (1,))[0] != 1:
            raise ValueError("only uncompressed TIFF strips can be read without Pillow")
        samples = tags.get(SAMPLES, (1,))[0]
        kind = {v: k for k, v in KINDS.items()}[tags.get(FORMAT, (1,))[0]]
        shape = (tags[HEIGHT][0], tags[WIDTH][0])
        yield Page((*shape, samples) if samples > 1 else shape, f"{order}{kind}{tags.get(BITS, (8,))[0] // 8}", tuple(zip(tags[STRIPS], tags[BYTES])))
        (at,) = struct.unpack_from(order + "I", block, 12 * n)


def decode(content: bytes) -> np.ndarray:
    """(rows, columns[, samples]) of one page, (pages, ...) of more."""
    pages = []
    for p in directories(lambda at, size: content[at : at + size]):
        data = b"".join(content[a : a + b] for a, b in p.strips)
        pages.append(np.frombuffer(data, dtype=p.dtype).reshape(p.shape))
    return pages[0] if len(pages) == 1 else np.stack(pages)
