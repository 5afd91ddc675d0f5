"""Components of images that are larger than a task: tiles are labelled apart, and the graph of labels that meet at seams is contracted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.storage import materialized

_MOVES = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def tile_labels(y: np.ndarray, x: np.ndarray, value: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """For each cell the place of the first cell (in the given order) of its component: touching cells of equal value.

    Components take the lesser of two labels along every edge and follow labels to their ends, over all cells at once.
    """
    h, w = y - y.min() + 1, x - x.min() + 1
    at = np.full((int(h.max()) + 2, int(w.max()) + 2), -1, np.int64)
    at[h, w] = np.arange(len(y))
    links = []
    for dy, dx in _MOVES[connectivity]:
        other = at[h + dy, w + dx]
        a = np.flatnonzero(other >= 0)
        a = a[value[a] == value[other[a]]]
        links.append(np.stack([a, other[a]]))
    a, b = np.concatenate(links, 1)
    label = np.arange(len(y))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _facts(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("image", "a", "b").cast("decimal(38,0)"))).first())


def contracted(links: DataFrame) -> DataFrame:
    """(image, a, b): the least label ``b`` that each label ``a`` is linked to by links (image, a, b), directly or by others; least labels have no row.

    Each round links every label's greater neighbours to its least one, and then its lesser ones, until nothing changes:
    the number of rounds grows with the logarithm of the longest chain. Every round is a written table.
    """

    def toward_least(e: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        least = e.groupBy("image", key).agg(F.min("b" if key == "a" else "a").alias("m"))
        return e.join(least, ["image", key]), least

    links = materialized(links.select("image", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    facts = _facts(links)
    while True:
        both = links.unionByName(links.select("image", F.col("b").alias("a"), F.col("a").alias("b")))
        near, _ = toward_least(both, "a")
        large = near.where("b > a").select("image", F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct()
        near, least = toward_least(large, "a")
        small = near.select("image", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("image", "a", F.col("m").alias("b"))).where("a > b").distinct()
        links = materialized(small)
        now = _facts(links)
        if now == facts:
            return links
        facts = now


def components(cells: DataFrame, tile: int = 512, connectivity: int = 4, value: str | None = None) -> DataFrame:
    """(image, y, x, component): touching cells (of equal ``value``, where one is named) have one component, named by its first cell, y * 2^31 + x.

    Tiles of ``tile`` x ``tile`` cells are labelled by themselves, one a call. Then only cells along seams meet their
    neighbours in other tiles, and the pairs of labels that touch there are contracted. A cell given twice counts once;
    null values are equal to each other. Cells have places of 0 or more.
    """
    code = F.col("y") * F.lit(1 << 31) + F.col("x")
    own = F.lit(0).cast("long") if value is None else F.coalesce(F.xxhash64(value), F.lit(0).cast("long"))
    tiled = cells.select(F.col("image").cast("long").alias("image"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), own.alias("value"))
    tiled = tiled.dropDuplicates(["image", "y", "x"]).withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y", "x"])
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        first = tile_labels(y, x, part["value"].to_numpy(), connectivity)
        return part.assign(local=y[first] * (1 << 31) + x[first])

    labelled = materialized(tiled.groupBy("image", "ty", "tx").applyInPandas(label, "image long, y long, x long, value long, ty long, tx long, local long"))
    at_seam = F.lit(False)
    for c in "yx":
        at_seam = at_seam | (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    seam = labelled.where(at_seam)
    moves = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _MOVES[connectivity]))).alias("m")
    moved = seam.select("*", moves).select("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "value", F.col("ty").alias("from_y"), F.col("tx").alias("from_x"), F.col("local").alias("a"))
    met = moved.where((F.floor(F.col("y") / tile) != F.col("from_y")) | (F.floor(F.col("x") / tile) != F.col("from_x")))
    links = met.join(seam.select("image", "y", "x", "value", F.col("local").alias("b")), ["image", "y", "x", "value"]).select("image", "a", "b").distinct()
    roots = contracted(links).select("image", F.col("a").alias("local"), F.col("b").alias("root"))
    return labelled.join(roots, ["image", "local"], "left").select("image", "y", "x", F.coalesce("root", "local").alias("component"))


def without_islands(cells: DataFrame, least: int, tile: int = 512, connectivity: int = 8) -> DataFrame:
    """(image, y, x): the cells of components of ``least`` cells or more; where an image has none, of its largest (the first among equals)."""
    parts = materialized(components(cells, tile, connectivity))
    sizes = materialized(parts.groupBy("image", "component").agg(F.count("*").alias("n")))
    largest = sizes.groupBy("image").agg(F.max(F.struct("n", (-F.col("component")).alias("neg"))).alias("top"))
    kept = sizes.join(largest, "image").where((F.col("n") >= least) | ((F.col("top.n") < least) & (F.col("component") == -F.col("top.neg"))))
    return parts.join(kept.select("image", "component"), ["image", "component"], "left_semi").select("image", "y", "x")
