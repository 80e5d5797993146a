"""Table functions for SQL: ``SELECT ... FROM images, LATERAL tile(data, array(8, 8), array(4, 4), 'allow', 1)``."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lattiq.functions import coords


class Tile:
    """A row for each tile of an image of any rank: tile_id, start (an array) and data, as doubles. The shape may differ by row; the tile's
    rank is checked when the query is analysed, as is the mode if it is a constant. A null image has no tiles."""

    @staticmethod
    def analyze(data: AnalyzeArgument, shape: AnalyzeArgument, tile: AnalyzeArgument, mode: AnalyzeArgument, min_overlap: AnalyzeArgument) -> AnalyzeResult:
        for name, a in (("data", data), ("shape", shape), ("tile", tile)):
            if not isinstance(a.dataType, ArrayType):
                raise ValueError(f"{name} must be an array, not {a.dataType.simpleString()}")
        if mode.isConstantExpression and mode.value not in (coords.NO_OVERLAP, coords.ALLOW, coords.FORCE):
            raise ValueError(f"unknown overlap mode {mode.value}")
        if shape.isConstantExpression and tile.isConstantExpression and len(shape.value) != len(tile.value):
            raise ValueError("shape and tile have different ranks")
        return AnalyzeResult(StructType().add("tile_id", IntegerType()).add("start", ArrayType(IntegerType())).add("data", ArrayType(DoubleType())))

    def eval(self, data, shape, tile, mode, min_overlap) -> Iterator[tuple]:
        if data is None:
            return
        image = np.asarray(data, dtype=np.float64).reshape([int(s) for s in shape])
        axes = [coords.axis_coords_overlap(int(s), int(t), mode, int(min_overlap)) for s, t in zip(shape, tile)]
        for i, start in enumerate(itertools.product(*axes)):
            box = image[tuple(slice(s, s + int(t)) for s, t in zip(start, tile))]
            yield i, [int(s) for s in start], box.ravel().tolist()


def register(spark: SparkSession) -> SparkSession:
    """Makes ``tile`` known to a session's SQL."""
    spark.udtf.register("tile", udtf(Tile))
    return spark
