"""Feature grids as rows (image, node, y, x, feat): neighbour edges, thresholds, prototypes, affinities, smoothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import similarity as S

FORWARD = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def neighbour_edges(grid: DataFrame, sim: Callable[[Column, Column], Column], connectivity: int = 4, radius: int = 1, wrap: tuple[int, int] | None = None) -> DataFrame:
    """(image, src, dst, sim) of cells and their neighbours to the right and below: an equality join on the shifted place.

    ``wrap`` (height, width) joins opposite edges.
    """
    moves = F.array(*(F.struct(F.lit(dy * r).alias("dy"), F.lit(dx * r).alias("dx")) for r in range(1, radius + 1) for dy, dx in FORWARD[connectivity]))
    src = grid.select("image", F.col("node").alias("src"), F.col("y"), F.col("x"), F.col("feat").alias("fa"), F.explode(moves).alias("m"))
    ty, tx = F.col("y") + F.col("m.dy"), F.col("x") + F.col("m.dx")
    if wrap:
        ty, tx = F.pmod(ty, F.lit(wrap[0])), F.pmod(tx, F.lit(wrap[1]))
    src = src.select("image", "src", "fa", ty.cast("long").alias("ty"), tx.cast("long").alias("tx"))
    dst = grid.select("image", F.col("node").alias("dst"), F.col("y").cast("long").alias("ty"), F.col("x").cast("long").alias("tx"), F.col("feat").alias("fb"))
    return src.join(dst, ["image", "ty", "tx"]).select("image", "src", "dst", sim(F.col("fa"), F.col("fb")).alias("sim"))


def quantile(df: DataFrame, value: str, q: float, key: str = "image") -> DataFrame:
    """Exact quantile with linear interpolation, for each key."""
    return df.groupBy(key).agg(F.percentile(value, F.lit(q)).alias("threshold"))


def edge_strength(grid: DataFrame, distance: Callable[[Column, Column], Column], height: int, width: int, connectivity: int = 4) -> DataFrame:
    """Mean distance of each node to its forward neighbours, on a grid whose edges wrap around."""
    e = neighbour_edges(grid, distance, connectivity, wrap=(height, width))
    return e.groupBy("image", F.col("src").alias("node")).agg(F.avg("sim").alias("strength"))


def robust_min_max(df: DataFrame, value: str, key: str = "image", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values scaled from their low to their high quantile, held to 0..1."""
    q = df.groupBy(key).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    return df.join(q, key).withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("_lo", "_hi")


def prototypes(members: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """Mean (or largest value of each dimension) of the features of each group."""
    one = members.select(*keys, F.posexplode("feat").alias("d", "v")).groupBy(*keys, "d").agg((F.avg if how == "mean" else F.max)("v").alias("v"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("p")).select(*keys, F.transform("p", lambda s: s["v"]).alias("prototype"))


def consistency(members: DataFrame, keys: list[str]) -> DataFrame:
    """Mean cosine of a group's members to its prototype."""
    return members.join(prototypes(members, keys), keys).groupBy(*keys).agg(F.avg(S.cosine(F.col("feat"), F.col("prototype"))).alias("consistency"))


def relabel_by_size(labels: DataFrame, label: str = "label", key: str = "image", min_size: int = 0) -> DataFrame:
    """Labels renumbered by falling size, first seen first among equals: from 1 with 0 for those under ``min_size``, or from 0 where that is 0."""
    sizes = labels.groupBy(key, label).agg(F.count("*").alias("n"), F.min("node").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    kept = sizes.where(F.col("n") >= min_size).select(key, label, (rank if min_size else rank - 1).alias("new"))
    return labels.join(kept, [key, label], "left").select(key, "node", F.coalesce("new", F.lit(0)).alias("label"))


def filter_small(labels: DataFrame, min_size: int, key: str = "image") -> DataFrame:
    """Labels over 0 with fewer cells than ``min_size`` become 0; the others are renumbered in the order of their labels."""
    n = labels.groupBy(key, "label").agg(F.count("*").alias("n")).where((F.col("label") > 0) & (F.col("n") >= min_size))
    new = n.select(key, "label", F.row_number().over(Window.partitionBy(key).orderBy("label")).alias("new"))
    return labels.join(new, [key, "label"], "left").select(key, "node", F.coalesce("new", F.lit(0)).alias("label"))


def touching(labels: DataFrame, connectivity: int = 4) -> DataFrame:
    """(image, a, b), a < b: pairs of different labels with neighbouring cells; labels has image, node, y, x, label."""
    cells = labels.select("image", "node", "y", "x", F.col("label").alias("feat"))
    e = neighbour_edges(cells, lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")), connectivity)
    return e.where("sim.a <> sim.b").select("image", "sim.a", "sim.b").distinct()


def affinity(nodes: DataFrame, tau: float, sigma: float, blend: float, floor: float = 1e-5, objectness: str | None = None, least_gate: float = 0.1) -> DataFrame:
    """(image, a, b, w), a < b: relu(cosine) where at least tau, blended with a Gaussian of the places' distance, and ``floor`` added.

    With a column ``objectness`` the blend is weighted by the square root of both ends' values, ``least_gate`` at least.
    Pairs are of one image only; images are small by nature (a grid of cells).
    """
    gate = F.col(objectness) if objectness else F.lit(1.0)
    l = nodes.select("image", F.col("node").alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa"), F.col("feat").alias("fa"), gate.alias("ga"))  # noqa: E741
    r = nodes.select("image", F.col("node").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"), F.col("feat").alias("fb"), gate.alias("gb"))
    c = F.greatest(F.lit(0.0), S.cosine(F.col("fa"), F.col("fb")))
    near = F.exp(-((F.col("ya") - F.col("yb")) ** 2 + (F.col("xa") - F.col("xb")) ** 2) / (2 * sigma * sigma))
    p = l.join(r, "image").where("a < b").withColumn("c", F.round(c, 9))
    w = F.when(F.col("c") >= tau, F.col("c")).otherwise(0.0) * (1 - blend) + near * blend
    if objectness:
        w = w * F.greatest(F.lit(least_gate), F.sqrt(F.greatest(F.col("ga") * F.col("gb"), F.lit(0.0))))
    return p.select("image", "a", "b", (w + floor).alias("w"))


def binary_affinity(nodes: DataFrame, q: float, floor: float = 1e-5, painted: str | None = None) -> DataFrame:
    """1 for pairs whose cosine is over the image's q-quantile of all pairs, else ``floor``.

    Pairs with a cell that the column ``painted`` marks are ``floor``, and the quantile is that of the others.
    """
    a = affinity(nodes, -2.0, 1.0, 0.0, 0.0).withColumnRenamed("w", "sim").withColumn("sim", F.round("sim", 9))
    free = F.lit(True)
    if painted:
        mark = lambda c: nodes.select(F.col("node").alias(c), F.col(painted).alias(f"_{c}"))
        a, free = a.join(mark("a"), "a").join(mark("b"), "b"), ~F.col("_a") & ~F.col("_b")
    cut = quantile(a.where(free), "sim", q)
    return a.join(cut, "image", "left").select("image", "a", "b", F.when(free & (F.col("sim") > F.round("threshold", 9)), 1.0).otherwise(floor).alias("w"))


def adaptive_rbf(nodes: DataFrame) -> DataFrame:
    """(image, src, dst, sim): exp(-d^2 / (2 sigma^2)) of neighbouring cells, where sigma is the median distance of the image's neighbours."""
    e = neighbour_edges(nodes, S.euclidean_distance).withColumnRenamed("sim", "d")
    m = e.groupBy("image").agg(F.median("d").alias("sigma"))
    return e.join(m, "image").select("image", "src", "dst", F.exp(-(F.col("d") ** 2) / (2 * F.col("sigma") ** 2 + 1e-12)).alias("sim"))


def merge_linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(image, node, label): labels that ``links`` (image, a, b) connect, directly or by others, become the least of them."""
    from gridloom.operators.segment import linked_labels

    both = nodes.select("image", "label").distinct().select("image", F.col("label").alias("a"), F.col("label").alias("b")).unionByName(links.select("image", "a", "b"))
    return nodes.join(linked_labels(both), ["image", "label"]).select("image", "node", F.col("least").alias("label"))


def assign_to_centres(nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """One k-means step's assignment: every node to the nearest centre of its image (the least one among equals)."""
    p = nodes.select("image", "node", "feat").join(centres, "image")
    d = F.round(S.squared_distance(F.col("feat"), F.col("prototype")), 9)
    return p.groupBy("image", "node").agg(F.min(F.struct(d.alias("d"), "centre")).alias("m")).select("image", "node", F.col("m.centre").alias("centre"))


def gaussian_smooth(values: DataFrame, sigma: float, height: int, width: int, through_gaps: bool = False) -> DataFrame:
    """Values (image, y, x, v) smoothed with a Gaussian of radius round(3 sigma); edges reflect without repeating the border cell.

    Cells without a row add nothing. The columns are smoothed first, then the rows: with ``through_gaps`` also at cells
    without a row, so that every cell gets the sum over all there are in its square.
    """
    import math

    radius = max(1, round(3 * sigma))
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    total = sum(k)

    def along(df: DataFrame, at: DataFrame, axis: str, size: int) -> DataFrame:
        taps = F.array(*(F.struct(F.lit(i - radius).alias("d"), F.lit(w / total).alias("w")) for i, w in enumerate(k)))
        period = 2 * (size - 1) if size > 1 else 1
        other = "x" if axis == "y" else "y"
        t = at.select("image", other, F.col(axis), F.explode(taps).alias("t")).withColumn("_m", F.pmod(F.col(axis) + F.col("t.d"), F.lit(period)))
        t = t.withColumn("_s", F.when(F.col("_m") < size, F.col("_m")).otherwise(period - F.col("_m")).cast("long"))
        src = df.select("image", other, F.col(axis).cast("long").alias("_s"), "v")
        return t.join(src, ["image", other, "_s"]).groupBy("image", "y", "x").agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))

    whole = values.select("image", "x").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))) if through_gaps else values
    return along(along(values, whole, "y", height), values, "x", width)
