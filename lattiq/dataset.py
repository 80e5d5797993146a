"""A collection of channels as one object: select, align, window, tile, sample, augment, predict and evaluate by chained calls."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import align, augment, boxes, rowset, stats, temporal, tiles
from lattiq.operators.positions import with_positions
from lattiq.sources import files, sinks


@dataclass(frozen=True)
class ArrayDataset:
    """Rows of aligned images: ds_path, im_idx, grp, one flat array column for each channel, and what else the rows carry.

    Every call gives another dataset; nothing runs before rows are asked for.
    """

    df: DataFrame
    channels: tuple[str, ...]
    shape: tuple[int, ...]
    masks: tuple[str, ...] = ()
    augmentation: augment.Pipeline | None = None

    @classmethod
    def open(cls, spark: SparkSession, stores: Mapping[str, DataFrame | str | Sequence[str]], shape: tuple[int, ...], groups: Sequence[str | None] = (None,), masks: Sequence[str] = (), singletons: Sequence[str] = ()) -> ArrayDataset:
        """Each channel from its store; sub-datasets meet by path with the channel's name taken off, in the order of groups. A store is a
        table, a path, or several, of which later ones replace earlier ones' paths; a singleton has one image for each sub-dataset."""
        parts = []
        for no, g in enumerate(groups):
            first = None
            for name, store in stores.items():
                c = files.open_dataset(spark, store, name, g)
                key = F.regexp_replace("ds_path", f"/?{name}(\\.[A-Za-z0-9]+)?$", "")
                c = c.select(key.alias("ds_path"), "im_idx", F.col("data").alias(name), *[x for x in c.columns if x in ("label",) and first is None])
                if first is None:
                    first = c
                elif name in singletons:
                    first = align.with_singleton(first, c.drop("im_idx"), "ds_path")
                else:
                    first = align.align([first, c], ["ds_path", "im_idx"])
            parts.append(first.withColumn("grp", F.lit(g).cast("string")).withColumn("grp_no", F.lit(no)))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return cls(df, tuple(stores), tuple(shape), tuple(masks))

    def with_df(self, df: DataFrame) -> ArrayDataset:
        return replace(self, df=df)

    def persist(self) -> ArrayDataset:
        return self.with_df(self.df.persist(StorageLevel.MEMORY_AND_DISK))

    def close(self) -> None:
        self.df.unpersist()

    def catalog(self) -> DataFrame:
        return align.catalog(self.df)

    def numbered(self, out: str = "global_idx") -> ArrayDataset:
        """Adds each row's number over all groups and sub-datasets, in the order of group, path and image."""
        return self.with_df(with_positions(self.df, "grp_no", "ds_path", "im_idx", out=out))

    def select(self, channels: Sequence[str]) -> ArrayDataset:
        """Some of the channels, in the given order; a channel that is named twice is there twice."""
        named = align_names(channels)
        rest = [c for c in self.df.columns if c not in self.channels]
        df = self.df.select(*rest, *[F.col(c).alias(n) for c, n in zip(channels, named)])
        return replace(self, df=df, channels=tuple(named), masks=tuple(n for c, n in zip(channels, named) if c in self.masks))

    def with_channel(self, name: str, f: Callable[[DataFrame], DataFrame], mask: bool = False) -> ArrayDataset:
        """A channel that a function makes from the others."""
        return replace(self, df=f(self.df), channels=(*self.channels, name), masks=(*self.masks, name) if mask else self.masks)

    def where(self, condition: Column | str) -> ArrayDataset:
        return self.with_df(self.df.where(condition))

    def allow(self, ids: DataFrame) -> ArrayDataset:
        return self.with_df(rowset.allowed(self.df, ids, "ds_path", "im_idx"))

    def exclude(self, ids: DataFrame) -> ArrayDataset:
        return self.with_df(rowset.excluded(self.df, ids, "ds_path", "im_idx"))

    def split(self, test: float | int | None = 0.25, train: float | int | None = None, stratum: str | None = None, key: str = "global_idx") -> tuple[ArrayDataset, ArrayDataset]:
        """(train, test) of exact sizes, over strata if a column is given."""
        parts = rowset.split_by_size(self.df, key, test, train, stratum)
        return self.with_df(parts[0]), self.with_df(parts[1])

    def batched(self, batch_size: int, mode: str = rowset.KEEP, seed: int | None = None, key: str = "global_idx") -> DataFrame:
        """Rows with ``pos`` and ``batch``, in their own order or shuffled by a seed."""
        n = self.df.count()
        placed = with_positions(self.df, key) if seed is None else rowset.shuffled(self.df, key, seed)
        return rowset.batched(placed, batch_size, n, mode)

    def frames(self, n: int = 1, stride: int = 1, before: bool = True, after: bool = True, labels: bool = False) -> ArrayDataset:
        """Each channel becomes an array of frames around each row."""
        return self.with_df(temporal.frame_stack(self.df, self.channels, n, stride, before, after, "ds_path", "im_idx", "label" if labels else None))

    def tile(self, tile: tuple[int, ...], **options) -> ArrayDataset:
        """Tiles of images of two axes, the same for all rows; see ``tiles.tile_starts``."""
        return replace(self, df=self.df.transform(tiles.tile_function(self.channels, self.shape, tile, **options)), shape=tile)

    def boxes(self, made: Column, tile: tuple[int, ...]) -> ArrayDataset:
        """Boxes that differ by row, for arrays of any rank; see ``operators.boxes``."""
        return replace(self, df=boxes.cut(boxes.with_boxes(self.df, made), self.channels, self.shape, tile), shape=tile)

    def augmented(self, p: augment.Pipeline, key: str = "im_idx", keep: str | None = None) -> ArrayDataset:
        """All channels augmented; ``keep`` names a column for the parameters, as does ``key`` what they are drawn by."""
        return replace(self, df=p.apply(self.df, self.channels, key, self.shape, self.masks, keep), augmentation=p)

    def predict(self, model, outputs: Sequence[str] = ("prediction",), channel: str | None = None, **options) -> DataFrame:
        return sinks.predicted(self.df, model, channel or self.channels[0], self.shape, outputs, **options)

    def evaluate(self, model, truth: str, errors: Sequence[str] = stats.ERRORS, metrics: dict | None = None, channel: str | None = None, by: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
        """A model's errors by image (or by what ``by`` names, for tiles), and a user's metrics."""
        return stats.evaluated(self.predict(model, channel=channel), truth, "prediction", errors, metrics, by, carried)


def align_names(channels: Sequence[str]) -> list[str]:
    """A name for each channel: a repeated one is numbered."""
    seen: dict[str, int] = {}
    out = []
    for c in channels:
        seen[c] = seen.get(c, -1) + 1
        out.append(c if not seen[c] else f"{c}_{seen[c]}")
    return out
