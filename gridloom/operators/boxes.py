"""Boxes: encodings, overlap measures, and joins of boxes within an image.

Boxes are XYXY columns x0, y0, x1, y1 with a prefix where two boxes meet in a row. Joins pair boxes of the same image by
equality of the image key, so that they shuffle by image and never cross images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import hash_number

CORNERS = ("x0", "y0", "x1", "y1")


def corners(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in CORNERS]


def cxcywh_to_xyxy(cx, cy, w, h) -> list[Column]:
    return [cx - 0.5 * w, cy - 0.5 * h, cx + 0.5 * w, cy + 0.5 * h]


def xyxy_to_cxcywh(x0, y0, x1, y1) -> list[Column]:
    return [(x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0]


def xywh_to_xyxy(x, y, w, h) -> list[Column]:
    return [x, y, x + w, y + h]


def xyxy_to_xywh(x0, y0, x1, y1) -> list[Column]:
    return [x0, y0, x1 - x0, y1 - y0]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: list[Column], b: list[Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side(0, 2) * side(1, 3)


def iou(a: list[Column], b: list[Column], eps: float = 0.0) -> Column:
    """Intersection over union; 0 for an empty union where ``eps`` is 0, else ``eps`` is added to the union."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return i / (u + eps) if eps else F.when(u > 0, i / u).otherwise(0.0)


def giou(a: list[Column], b: list[Column], eps: float = 1e-6) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return i / (u + eps) - (hull - u) / (hull + eps)


def coverage(child: list[Column], parent: list[Column]) -> Column:
    """Share of the child that lies in the parent; 0 for an empty child."""
    return F.when(area(child) > 0, intersection(child, parent) / area(child)).otherwise(0.0)


def prefixed(df: DataFrame, prefix: str, key: str = "image") -> DataFrame:
    return df.select(F.col(key), *(F.col(c).alias(prefix + c) for c in df.columns if c != key))


def pairs(left: DataFrame, right: DataFrame, key: str = "image", how: str = "inner") -> DataFrame:
    """Pairs of boxes of the same ``key``; columns of the sides get the prefixes l_ and r_."""
    return prefixed(left, "l_", key).join(prefixed(right, "r_", key), key, how)


def _level(prefix: str = "") -> Column:
    """The least k >= 3 for which cells of 2^k units are as long as the box's longer side, 30 at most."""
    side = F.greatest(F.col(prefix + "x1") - F.col(prefix + "x0"), F.col(prefix + "y1") - F.col(prefix + "y0"))
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(8.0)))), F.lit(3)), F.lit(30)).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def _in_cells(df: DataFrame, prefix: str, levels: Column, key: str) -> DataFrame:
    """Each box in every cell that it touches, at each of its ``levels``: one to four cells a level, as no cell is shorter than the box."""
    at = df.withColumn("_level", F.explode(levels))
    for axis in "xy":
        lo, hi = _cell(F.col(f"{prefix}{axis}0"), F.col("_level")), _cell(F.col(f"{prefix}{axis}1"), F.col("_level"))
        at = at.withColumn(f"_c{axis}", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    return at


def overlapping(left: DataFrame, right: DataFrame, key: str = "image", crowd: int = 1_000_000) -> DataFrame:
    """Pairs of boxes of the same ``key`` that share an area, each once; columns of the sides get the prefixes l_ and r_.

    Keys with at most ``crowd`` pairs are joined as they are. The boxes of a crowded key go to the cells of grids whose cells
    double in size: a box's own grid is the first whose cells are as long as it, and a pair meets in the own grid of the
    larger box, in the cell of their intersection's first corner. Each side is joined by its own grids with the other side's
    boxes of the same size or smaller, so that small boxes only ever meet boxes close to them. Boxes without an area, and those
    with a null corner or key, are in no pair.
    """
    a, b = prefixed(left, "l_", key), prefixed(right, "r_", key)
    full = lambda p: (F.col(p + "x1") > F.col(p + "x0")) & (F.col(p + "y1") > F.col(p + "y0"))
    a, b = a.where(full("l_")), b.where(full("r_"))
    size = lambda df, p, n: df.groupBy(key).agg(F.count("*").alias(n), F.collect_set(_level(p)).alias(f"{n}_levels"))
    crowded = size(a, "l_", "_nl").join(size(b, "r_", "_nr"), key).where(F.col("_nl") * F.col("_nr") > crowd).select(key, "_nl_levels", "_nr_levels")
    a, b = a.join(crowded, key, "left"), b.join(crowded.select(F.col(key).alias("_k"), *(F.col(c).alias(f"{c}_") for c in ("_nl_levels", "_nr_levels"))), F.col(key) == F.col("_k"), "left").drop("_k")
    few = a.where("_nl_levels is null").drop("_nl_levels", "_nr_levels").join(b.where("_nl_levels_ is null").drop("_nl_levels_", "_nr_levels_"), key)
    a, b = a.where("_nl_levels is not null"), b.where("_nl_levels_ is not null")
    own_a, own_b = F.array(_level("l_")), F.array(_level("r_"))
    coarser = lambda levels, own, equal: F.filter(levels, lambda k: (k >= own) if equal else (k > own))
    roles = ((own_a, coarser(F.col("_nl_levels_"), _level("r_"), True)), (coarser(F.col("_nr_levels"), _level("l_"), False), own_b))
    at = [key, "_level", "_cx", "_cy"]
    parts = [few]
    for of_a, of_b in roles:
        met = _in_cells(a, "l_", of_a, key).drop("_nl_levels", "_nr_levels").join(_in_cells(b, "r_", of_b, key).drop("_nl_levels_", "_nr_levels_"), at)
        corner = [_cell(F.greatest(f"l_{c}0", f"r_{c}0"), F.col("_level")) == F.col(f"_c{c}") for c in "xy"]
        parts.append(met.where(corner[0] & corner[1]).drop("_level", "_cx", "_cy"))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.where(intersection(corners("l_"), corners("r_")) > 0)


def box_iou_matrix(left: DataFrame, right: DataFrame, key: str = "image") -> DataFrame:
    p = pairs(left, right, key)
    return p.select(key, "l_idx", "r_idx", iou(corners("l_"), corners("r_"), 1e-6).alias("iou"), giou(corners("l_"), corners("r_")).alias("giou"))


def best_overlap(left: DataFrame, right: DataFrame, key: str = "image") -> DataFrame:
    """Every left box with the largest IoU of any right box of its image, 0 where there is none."""
    hit = overlapping(left, right, key).select(key, F.col("l_idx").alias("idx"), iou(corners("l_"), corners("r_")).alias("v"))
    return hit.unionByName(left.select(key, "idx", F.lit(0.0).alias("v"))).groupBy(key, "idx").agg(F.max("v").alias("best_iou"))


def label_proposals(proposals: DataFrame, truth: DataFrame, threshold: float, background: str, key: str = "image") -> DataFrame:
    """Every proposal with its best box of the truth (the least idx among equals) and that box's category, or ``background`` under the threshold, which is over 0."""
    value = lambda v, neg, category: F.struct(v.alias("iou"), neg.alias("neg"), category.alias("category"))
    hit = overlapping(proposals, truth, key).select(key, F.col("l_idx").alias("idx"), value(F.round(iou(corners("l_"), corners("r_")), 9), -F.col("r_idx"), F.col("r_category")).alias("b"))
    types = dict(truth.dtypes)
    alone = proposals.select(key, "idx", value(F.lit(0.0), F.lit(None).cast(types["idx"]), F.lit(None).cast(types["category"])).alias("b"))
    best = hit.unionByName(alone).groupBy(key, "idx").agg(F.max("b").alias("b"))
    hit = F.col("b.iou") >= threshold
    return best.select(key, "idx", F.when(hit, -F.col("b.neg")).alias("gt_idx"), F.when(hit, F.col("b.category")).otherwise(background).alias("label"))


def pick_proposal(proposals: DataFrame, reference: DataFrame, px: Column, py: Column, key: str = "image") -> DataFrame:
    """For each reference box the proposal of the largest IoU, among those that hold the click (px, py) where any does."""
    p = pairs(reference, proposals, key)
    holds = ((F.col("r_x0") <= px) & (px < F.col("r_x1")) & (F.col("r_y0") <= py) & (py < F.col("r_y1"))).cast("int")
    v = F.round(iou(corners("l_"), corners("r_")), 9)
    best = p.groupBy(key, F.col("l_idx").alias("idx")).agg(F.max(F.struct(holds.alias("holds"), v.alias("iou"), (-F.col("r_idx")).alias("neg"))).alias("b"))
    return best.select(key, "idx", (-F.col("b.neg")).alias("pick"), F.col("b.holds").alias("holds"))


def paste_filter(pasted: DataFrame, targets: DataFrame, most: float = 0.5, key: str = "image") -> DataFrame:
    """Pasted boxes that cover less than ``most`` of every target of their image."""
    over = (intersection(corners("l_"), corners("r_")) / area(corners("r_"))).alias("v")
    hit = overlapping(pasted, targets, key).select(key, F.col("l_idx").alias("idx"), over)
    return hit.unionByName(pasted.select(key, "idx", F.lit(0.0).alias("v"))).groupBy(key, "idx").agg(F.max("v").alias("most")).where(F.col("most") < most).select(key, "idx")


def near_crop_edge(b: list[Column], crop: list[float], image: list[float], atol: float = 20.0) -> Column:
    """Whether a box, in the image's coordinates, touches an edge of the crop that is not an edge of the image."""
    out = F.lit(False)
    for c, edge, whole in zip(b, crop, image, strict=True):
        out = out | ((F.abs(c - edge) <= atol) & ~(F.abs(c - whole) <= atol))
    return out


def context_box(b: list[Column], context: float, width: float, height: float, least: float = 32.0) -> list[Column]:
    """A crop around the box's centre: its half sizes, at least ``least``, times ``context``, held to the image."""
    cx, cy, w, h = xyxy_to_cxcywh(*b)
    hw, hh = F.greatest(w / 2, F.lit(least)) * context, F.greatest(h / 2, F.lit(least)) * context
    hold = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(most)))
    return [hold(cx - hw, width), hold(cy - hh, height), hold(cx + hw, width), hold(cy + hh, height)]


def jittered(df: DataFrame, key: list[str], fraction: float, seed: int) -> DataFrame:
    """Corners moved by up to ``fraction`` of the box's sides, told by a hash of the key and ``seed``, so that retries agree."""
    move = lambda k: hash_number(*key, F.lit(seed + k)) % 2_000_001 / 1e6 - 1
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    new = [F.col(c) + move(k) * fraction * (w if k % 2 == 0 else h) for k, c in enumerate(CORNERS)]
    return df.select(*(c for c in df.columns if c not in CORNERS), F.least(new[0], new[2]).alias("x0"), F.least(new[1], new[3]).alias("y0"), F.greatest(new[0], new[2]).alias("x1"), F.greatest(new[1], new[3]).alias("y1"))


def tile_boxes(images: DataFrame, layers: int, overlap: float) -> DataFrame:
    """``images`` (with width and height) by crop: layer, crop, x0, y0, x1, y1. Layer 0 is the image; layer i has 2^i boxes a side that overlap by a share of the short side."""
    n = F.pow(F.lit(2), F.col("layer")).cast("int")
    at = images.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))).withColumn("crop", F.explode(F.sequence(F.lit(0), n * n - 1)))
    shared = F.floor(overlap * F.least("width", "height") * 2 / n)
    box = {}
    for axis, side, k in (("x", "width", F.col("crop") % n), ("y", "height", F.floor(F.col("crop") / n))):
        long = F.ceil((shared * (n - 1) + F.col(side)) / n)
        box |= {f"{axis}0": ((long - shared) * k).cast("int"), f"{axis}1": F.least((long - shared) * k + long, F.col(side)).cast("int")}
    return at.withColumns(box)


def point_grid(images: DataFrame, n: int) -> DataFrame:
    """``images`` (with width and height) by point: n * n points (px, py), evenly spaced at the centres of the image's cells."""
    at = images.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return at.withColumns({"px": (F.col("_k") % n + 0.5) / n * F.col("width"), "py": (F.floor(F.col("_k") / n) + 0.5) / n * F.col("height")}).drop("_k")
