"""Crowded images: how many boxes overlap each box, and the best of them, without meeting every pair.

A tile's kernel counts by corners and looks for the best among boxes of like size and place. Its work grows with the boxes
of the tile and the few candidates of each, not with the pairs that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.boxes import CORNERS
from gridloom.sources.storage import materialized

#: Boxes of both sides that a tile should have, and those that it may have to be some four boxes long, where they lie evenly; those that reach into it come on top.
TILE, LARGE_TILE = 20_000, 400_000
#: Boxes of a side that one call of the kernel gets; a tile with more is dealt into blocks, and each block of one side meets each of the other.
BLOCK = 1_000_000
#: Thresholds of IoU, in the order in which the search gives up on them; 0 takes all that overlap.
LADDER = (0.8, 0.55, 0.3, 0.15, 0.07, 0.03, 0.01, 0.0)
#: Candidate pairs that a step of the search looks at side by side.
STEP = 1 << 17


def below(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each q, how many points p have px <= qx and py <= qy: the ranks by y are dealt by one bit a turn, in the order of x."""
    n, by_x, by_y = len(px), np.argsort(px), np.argsort(py)
    rank = np.empty(n, np.int32)
    rank[by_y] = np.arange(n, dtype=np.int32)
    rank = rank[by_x]
    end, under = (np.searchsorted(p[by], q, "right").astype(np.int32) for p, by, q in ((px, by_x, qx), (py, by_y, qy)))
    begin, out = np.zeros(len(qx), np.int32), np.zeros(len(qx), np.int32)
    for bit in range(n.bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.zeros(n + 1, np.int32)
        np.cumsum(~one, out=zeros[1:])
        b0, e0 = zeros[begin], zeros[end]
        up = (under >> bit & 1).astype(bool)
        out += (e0 - b0) * up
        begin, end = np.where(up, zeros[n] + begin - b0, b0), np.where(up, zeros[n] + end - e0, e0)
        rank = np.concatenate([rank[~one], rank[one]])
    return out


def overlap_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many boxes of b share an area with each of a (4 rows of corners each, all with an area): all but those beside, above or below."""
    to = lambda p, q: np.searchsorted(np.sort(p), q, "right")
    sides = ((b[2], a[0]), (-b[0], -a[2])), ((b[3], a[1]), (-b[1], -a[3]))
    out = np.full(a.shape[1], b.shape[1], np.int64)
    for p, q in (*sides[0], *sides[1]):
        out -= to(p, q)
    for px, qx in sides[0]:
        for py, qy in sides[1]:
            out += below(px, py, qx, qy)
    return out


def spans(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the ranges [lo, hi): which ranges, where each begins among the part's entries, and the entries; about ``STEP`` entries a part."""
    some = np.flatnonzero(hi > lo)
    size = hi[some] - lo[some]
    ends = np.cumsum(size)
    first = 0
    while first < len(some):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, "right")))
        at, n = some[first:last], size[first:last]
        begins = np.cumsum(n) - n
        yield at, begins, np.repeat(lo[at] - begins, n) + np.arange(int(n.sum()))
        first = last


def _reach(part: np.ndarray, side: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """How far along an axis the centre of a box with sides in [lo, hi] and [other_lo, other_hi] may be, where the boxes share ``part`` of the sum of their areas."""
    slope = 0.5 - part * np.maximum(1.0, other_lo / other)
    return side * (0.5 - part * np.maximum(1.0, other / other_hi)) + np.maximum(lo * slope, hi * slope)


def best_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest IoU of each box of a with any of b (4 rows of corners each, all with an area), 0 where none overlaps.

    A turn finds every box of b with an IoU of at least t. Then its width and height are within a factor t of a's, and along
    each axis the centres are near. So b is dealt into classes of width and height, each in rows of its own height, sorted by
    x, and a box looks at three classes a side. A box whose best reaches t is done; others go on to the next t.
    """
    best = np.zeros(a.shape[1])
    if not a.shape[1] or not b.shape[1]:
        return best
    left = np.lexsort((a[0], np.floor(a[1] / (b[3] - b[1]).mean()), np.floor(np.log2(a[3] - a[1])), np.floor(np.log2(a[2] - a[0]))))  # neighbours look in one place
    w, h, x, y = b[2] - b[0], b[3] - b[1], (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    wide, high, x_least, y_least = w.max(), h.max(), x.min(), y.min()
    fine, row_least = (x.max() - x_least) / (1 << 22) or 1.0, (y.max() - y_least) / (1 << 16)
    slack = 1e-9 * (wide + high + np.abs(a).max() + np.abs(b).max())
    place = lambda v: np.clip((v - x_least) / fine, -1, (1 << 22) + 1).astype(np.int64) + 1
    for t in LADDER:
        step = -np.log(t) if t else np.inf
        kind = lambda v, s=step: np.clip(np.floor(np.log(v) / s), -500, 500).astype(np.int64) if s < np.inf else np.zeros(len(v), np.int64)
        lower = lambda k, s=step: np.where(k > -500, np.exp(k * s), 0.0) if s < np.inf else np.zeros(len(k))
        upper = lambda k, s=step: np.where(k < 500, np.exp((k + 1) * s), np.inf) if s < np.inf else np.full(len(k), np.inf)
        tall = lambda k, t=t, upper=upper: np.minimum(upper(k), high) * 2 * (1 - t) / (1 + t) + row_least + slack
        key = lambda kw, kh, row: (((kw + 502) << 10 | (kh + 502)) << 17 | row) << 23
        kh = kind(h)
        keys = key(kind(w), kh, ((y - y_least) / tall(kh)).astype(np.int64)) | place(x)
        order = np.argsort(keys)
        keys, c = keys[order], b[:, order]
        c_area = (c[2] - c[0]) * (c[3] - c[1])
        of = a[:, left]
        aw, ah, ax, ay = of[2] - of[0], of[3] - of[1], (of[0] + of[2]) / 2, (of[1] + of[3]) / 2
        area, kw, kh, got = aw * ah, kind(aw), kind(ah), best[left]
        for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) if t else ((0, 0),):
            goal = np.maximum(got, t)  # what is found so far is to be beaten
            part = goal / (1 + goal)
            with np.errstate(divide="ignore", over="ignore"):
                w_lo, w_hi = np.maximum(lower(kw + i), aw * goal), np.minimum(np.minimum(upper(kw + i), aw / goal), wide)
                h_lo, h_hi = np.maximum(lower(kh + j), ah * goal), np.minimum(np.minimum(upper(kh + j), ah / goal), high)
                rx = _reach(part, aw, w_lo, w_hi, ah, h_lo, h_hi) + slack
                ry = _reach(part, ah, h_lo, h_hi, aw, w_lo, w_hi) + slack
            able = np.flatnonzero((rx >= 0) & (ry >= 0) & (w_lo <= w_hi * (1 + 1e-9)) & (h_lo <= h_hi * (1 + 1e-9)))
            row, ex, r = tall(kh[able] + j), ax[able], rx[able]
            lo, hi = (np.clip((ay[able] + s * ry[able] - y_least) / row, -1, 1 << 17).astype(np.int64) for s in (-1, 1))
            lo, hi, from_x, to_x = np.maximum(lo, 0), np.minimum(hi, (1 << 17) - 1), place(ex - r), place(ex + r) + 1
            for k in range(int((hi - lo).max(initial=-1)) + 1):
                mine = np.flatnonzero(lo + k <= hi)
                base = key(kw[able[mine]] + i, kh[able[mine]] + j, lo[mine] + k)
                for at, begins, of_b in spans(np.searchsorted(keys, base + from_x[mine]), np.searchsorted(keys, base + to_x[mine])):
                    g = able[mine[at]]
                    n = np.diff(np.append(begins, len(of_b)))
                    p = [np.repeat(v[g], n) for v in (*of, area)]
                    q = [v[of_b] for v in (*c, c_area)]
                    shared = np.maximum(np.minimum(p[2], q[2]) - np.maximum(p[0], q[0]), 0.0) * np.maximum(np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]), 0.0)
                    got[g] = np.maximum(got[g], np.maximum.reduceat(shared / (p[4] + q[4] - shared), begins))
        best[left] = got
        left = left[got < t * (1 + 1e-9)]
        if not len(left):
            break
    return best


def _tile(t: pa.Table, key: str) -> pa.Table:
    side = t.column("_left").to_numpy()
    at = np.stack([t.column(c).to_numpy() for c in CORNERS])
    a, b = at[:, side], at[:, ~side]
    own = t.select([key, "idx"]).filter(pa.array(side))
    n = overlap_counts(a, b)
    best, some = np.zeros(len(n)), np.flatnonzero(n)
    best[some] = best_ious(a[:, some], b)
    return own.append_column("n", pa.array(n)).append_column("best_iou", pa.array(best))


def crowded_overlaps(boxes: DataFrame, left: str, key: str = "image") -> DataFrame:
    """Every box where ``left`` is true (``key``, idx) with n, the number of the other boxes of its ``key`` that share an area with it, and best_iou, the largest IoU of any.

    No pair has a row. An image is cut into square tiles by the number of its boxes, none shorter than its boxes are on
    average; left boxes longer than a tile go to tiles that double in size. A left box is in the tile of its first corner, and
    another in every tile where a left box might reach it. A tile of very many boxes is dealt into blocks. Left boxes of one
    ``key`` and idx count as one. Boxes without an area, and those with a null corner or key,
    overlap none.
    """
    kind = dict(boxes.dtypes)
    boxes = materialized(boxes.where(F.col(left).isNotNull()).select(key, "idx", *(F.col(c).cast("double").alias(c) for c in CORNERS), F.col(left).alias("_left")))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    full = F.coalesce((w > 0) & (h > 0) & F.col(key).isNotNull(), F.lit(False))
    known = boxes.where(full)
    extent = (F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))
    holding = lambda n: F.sqrt(extent / F.count("*") * n)
    mean = F.greatest(F.avg(w), F.avg(h), F.sqrt(F.avg(w * h)))
    slack = [(F.greatest(*(F.max(F.abs(f"{c}{k}")) for k in "01")) * 1e-12).alias(f"_slack_{c}") for c in "xy"]
    sizes = known.groupBy(key).agg(F.greatest(holding(TILE), F.least(4 * mean, holding(LARGE_TILE)), mean).alias("_length"), *slack)
    level = F.greatest(F.ceil(F.log2(F.greatest(w, h) / F.col("_length"))), F.lit(0)).cast("int")
    own = known.where("_left").join(sizes, key).withColumn("_level", level).withColumn("_length", F.col("_length") * F.pow(F.lit(2.0), "_level"))
    far = [(F.max(v) * (1 + 1e-9) + F.max(f"_slack_{c}")).alias(f"_far_{c}") for c, v in (("x", w), ("y", h))]
    levels = own.groupBy(key, "_level").agg(F.max("_length").alias("_length"), *far)
    cell = lambda v: F.floor(v / F.col("_length")).cast("long")
    own, others = own.withColumns({f"_c{c}": cell(F.col(f"{c}0")) for c in "xy"}), known.where("not _left").join(levels, key)
    for c in "xy":
        others = others.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"{c}0") - F.col(f"_far_{c}")), cell(F.col(f"{c}1")))))
    at = [key, "_level", "_cx", "_cy"]
    columns = [*at, "idx", *CORNERS, "_left"]
    met = own.select(columns).unionByName(others.select(columns))
    blocks = lambda hit: F.ceil(F.count(F.when(hit, 1)) / BLOCK).cast("int")
    full_tiles = met.groupBy(at).agg(blocks(F.col("_left")).alias("_nl"), blocks(~F.col("_left")).alias("_nr")).where("_nl > 1 or _nr > 1")  # one for BLOCK rows at most
    met = met.join(F.broadcast(full_tiles), at, "left").na.fill(1, ["_nl", "_nr"])
    of = lambda mine, other: F.when(F.col("_left"), mine).otherwise(other)
    met = met.withColumn("_mine", F.pmod(F.xxhash64("idx", *CORNERS), F.greatest(of(F.col("_nl"), F.col("_nr")), F.lit(1))).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.greatest(of(F.col("_nr"), F.col("_nl")), F.lit(1)) - 1)))
    met = met.select(*columns, of(F.col("_mine"), F.col("_other")).alias("_bl"), of(F.col("_other"), F.col("_mine")).alias("_br"))
    spark, at = boxes.sparkSession, [*at, "_bl", "_br"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # a fixed number: AQE would join partitions by their bytes, which are few for the work
    found = met.repartition(tasks, *at).groupBy(at).applyInArrow(lambda t: _tile(t, key), f"{key} {kind[key]}, idx {kind['idx']}, n long, best_iou double")
    alone = boxes.where(F.col("_left") & ~full).select(key, "idx", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("best_iou"))
    return found.unionByName(alone).groupBy(key, "idx").agg(F.sum("n").alias("n"), F.max("best_iou").alias("best_iou"))
