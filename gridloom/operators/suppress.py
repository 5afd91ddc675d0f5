"""Suppression of overlapping boxes: order matters within an image, so each image is one group and numpy does the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = ["x0", "y0", "x1", "y1"]


def iou_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes place by place (shapes broadcast), 0 for empty unions; rounded to 9 digits so that ties are ties."""
    inter = np.clip(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None).prod(-1)
    size = lambda z: (z[..., 2:] - z[..., :2]).prod(-1)
    union = size(a) + size(b) - inter
    return np.round(np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0), 9)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b; leading dimensions are groups side by side."""
    return iou_pairs(a[..., :, None, :], b[..., None, :, :])


def keep_windowed(near: np.ndarray, threshold: float) -> np.ndarray:
    """A kept item suppresses those after it, within the band, that overlap it by more than the threshold; suppressed items suppress nobody.

    ``near[..., k, i]`` is the overlap of item i with item i + 1 + k; entries beyond the last item count for nothing.
    """
    n = near.shape[-1]
    keep = np.ones((*near.shape[:-2], n), bool)
    for i in range(n):
        most = min(near.shape[-2], n - 1 - i)
        keep[..., i + 1 : i + 1 + most] &= ~keep[..., i, None] | (near[..., :most, i] <= threshold)
    return keep


def iou_band(b: np.ndarray, width: int) -> np.ndarray:
    """``width`` rows: the IoU of each box with the one 1, 2, ... after it (0 beyond the last)."""
    n = b.shape[-2]
    out = np.zeros((*b.shape[:-2], width, n))
    for k in range(min(width, n - 1)):
        out[..., k, : n - 1 - k] = iou_pairs(b[..., : n - 1 - k, :], b[..., 1 + k :, :])
    return out


def keep_full(iou: np.ndarray, threshold: float, able: np.ndarray | None = None) -> np.ndarray:
    """An item stays when it overlaps every kept one before it by at most the threshold; with ``able``, only those that are."""
    keep = np.zeros(iou.shape[:-1], bool)
    for i in range(iou.shape[-1]):
        keep[..., i] = ~((iou[..., i, :i] > threshold) & keep[..., :i]).any(-1)
        if able is not None:
            keep[..., i] &= able[..., i]
    return keep


#: Pairs of rows that groups of one shape, stacked in one call of a kernel, may have in all; a larger group comes by itself.
STACKED = 1 << 20


def stacks(*sizes: np.ndarray, width: int = 1) -> Iterator[np.ndarray]:
    """Places of groups that are alike in all their ``sizes``, as many together as ``STACKED`` pairs (times ``width``) allow.

    So a kernel runs a few times for many small groups, and its Python steps do not grow with their number.
    """
    order = np.lexsort(sizes[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for s in sizes:
        new[1:] |= s[order][1:] != s[order][:-1]
    for part in np.split(order, np.flatnonzero(new)[1:]) if len(order) else ():
        pairs = width * max(1, int(sizes[0][part[0]])) * max(1, int(sizes[-1][part[0]]))
        step = max(1, STACKED // pairs)
        for k in range(0, len(part), step):
            yield part[k : k + step]


def in_groups(table: pa.Table, groups: list[str], order: list[tuple[str, bool]]) -> tuple[pa.Table, np.ndarray]:
    """The rows sorted by group and then by (column, ascending), and where each group begins; one more entry ends the last."""
    at = pa.compute.sort_indices(table, [(g, "ascending") for g in groups] + [(c, "ascending" if up else "descending") for c, up in order])
    table = table.take(at)
    new = np.zeros(len(table), bool)
    new[:1] = True
    for g in groups:
        v = table.column(g).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return table, np.append(np.flatnonzero(new), len(table))


def box_array(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in CORNERS], 1) if len(table) else np.zeros((0, 4))


def bucketed(df: DataFrame, key: str, each: int = 8) -> DataFrame:
    """``df`` with _bucket: a hash of the key, so that one Python call gets many groups; ``each`` buckets for every shuffle partition."""
    n = each * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)))


def suppress(boxes: DataFrame, rule: Callable[[np.ndarray, np.ndarray], np.ndarray], order: list[tuple[str, bool]], groups: list[str]) -> DataFrame:
    """The rows that ``rule`` keeps, given the boxes and scores (0 without) of groups of one size, a group a row, in the given order."""
    schema, has_score = boxes.schema, "score" in boxes.columns

    def many(t: pa.Table) -> pa.Table:
        t, begins = in_groups(t, groups, order)
        b = box_array(t)
        score = t.column("score").to_numpy() if has_score else np.zeros(len(t))
        keep = np.zeros(len(t), bool)
        first, size = begins[:-1], np.diff(begins)
        for of in stacks(size):
            at = first[of][:, None] + np.arange(size[of[0]])
            keep[at] = rule(b[at], score[at])
        return t.filter(pa.array(keep)).drop_columns("_bucket")

    return bucketed(boxes, groups[0]).groupBy("_bucket").applyInArrow(many, schema)


def with_area(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def windowed_area_nms(boxes: DataFrame, threshold: float = 0.9, step: int = 5, group: str = "image") -> DataFrame:
    return suppress(with_area(boxes), lambda b, _: keep_windowed(iou_band(b, step - 1), threshold), [("area", False), ("idx", True)], [group])


def full_area_dedup(boxes: DataFrame, threshold: float = 0.9, group: str = "image") -> DataFrame:
    return suppress(with_area(boxes), lambda b, _: keep_full(iou_matrix(b, b), threshold), [("area", False), ("idx", True)], [group])


def score_nms(boxes: DataFrame, threshold: float = 0.5, per_class: bool = True, group: str = "image") -> DataFrame:
    return suppress(boxes, lambda b, _: keep_full(iou_matrix(b, b), threshold), [("score", False), ("idx", True)], [group, "category"] if per_class else [group])


def nms_after_cleanup(boxes: DataFrame, changed: str, threshold: float = 0.7, group: str = "image") -> DataFrame:
    """Unchanged boxes come first (score 1), changed ones after (score 0)."""
    scored = boxes.withColumn("_score", F.when(F.col(changed), 0.0).otherwise(1.0))
    return suppress(scored, lambda b, _: keep_full(iou_matrix(b, b), threshold), [("_score", False), ("idx", True)], [group]).drop("_score")


def candidate_dedup(candidates: DataFrame, least_score: float, threshold: float = 0.95, group: str = "image") -> DataFrame:
    """By falling score: those under ``least_score`` or alike to a kept one go, but the last one stays where nothing else does."""

    def rule(b: np.ndarray, score: np.ndarray) -> np.ndarray:
        keep = keep_full(iou_matrix(b, b), threshold, score >= least_score)
        keep[:, -1] |= ~keep.any(1)
        return keep

    return suppress(candidates, rule, [("score", False), ("idx", True)], [group])


def until_repeat(steps: DataFrame, most_iou: float, group: str = "image", order: str = "idx") -> DataFrame:
    """Rows in order up to, not with, the first that overlaps an earlier one by more than ``most_iou``."""

    def rule(b: np.ndarray, _: np.ndarray) -> np.ndarray:
        bad = np.triu(iou_matrix(b, b) > most_iou, 1).any(1)
        return np.arange(b.shape[1]) < np.where(bad.any(1), bad.argmax(1), b.shape[1])[:, None]

    return suppress(steps, rule, [(order, True)], [group])


def spaced_peaks(values: np.ndarray, k: int, least_distance: int) -> list[tuple[int, int]]:
    """Up to k places of a 2-D array, highest first; each clears a square of ``least_distance`` around it."""
    v, out = values.astype(float).copy(), []
    for _ in range(k):
        y, x = np.unravel_index(int(np.argmax(v)), v.shape)
        if not np.isfinite(v[y, x]):
            break
        out.append((int(y), int(x)))
        v[max(0, y - least_distance) : y + least_distance + 1, max(0, x - least_distance) : x + least_distance + 1] = -np.inf
    return out
