"""One-to-one matching of boxes within an image: greedy orders, detection evaluation, and optimal assignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.suppress import CORNERS, box_array, bucketed, in_groups, iou_matrix, stacks


def greedy_pairs(iou: np.ndarray, least: float) -> list[tuple[int, int]]:
    """All pairs of at least ``least``, by falling IoU (then row, column); a pair counts if both ends are free."""
    rows, cols, out = set(), set(), []
    i, j = np.nonzero(iou >= least)
    for k in np.lexsort((j, i, -iou[i, j])):
        a, b = int(i[k]), int(j[k])
        if a not in rows and b not in cols:
            rows.add(a)
            cols.add(b)
            out.append((a, b))
    return out


def paired(iou: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stacked groups (groups, rows, columns): the pairs by falling IoU (then row, column) whose ends are both free.

    A step for each pair that a group may have: its row, column and IoU in each group, -1 where no free pair has ``least``.
    """
    g, n, m = iou.shape
    v, every = np.where(iou >= least, iou, -1.0), np.arange(g)
    steps = min(n, m)
    rows, cols, got = np.full((g, steps), -1), np.full((g, steps), -1), np.full((g, steps), -1.0)
    for k in range(steps):
        best = v.reshape(g, -1).argmax(1)
        a, b = best // m, best % m
        top = v[every, a, b]
        if not (top >= 0).any():
            break
        rows[:, k], cols[:, k], got[:, k] = np.where(top >= 0, a, -1), np.where(top >= 0, b, -1), top
        v[every, a], v[every, :, b] = -1, -1  # a group without a free pair has nothing left to lose
    return rows, cols, got


def best_covered(iou: np.ndarray) -> list[tuple[int, int, float]]:
    """min(rows, columns) times the largest remaining IoU; both ends retire. Overlaps of 0 count too."""
    rows, cols, got = paired(iou[None])
    return [(int(a), int(b), float(v)) for a, b, v in zip(rows[0], cols[0], got[0], strict=True)]


def assign_all(cost: np.ndarray) -> np.ndarray:
    """Assignments of least total cost of stacked matrices (groups, rows, columns), by shortest augmenting paths with potentials.

    The row of each column, -1 for a column without one; there must be no more rows than columns. Groups take their
    steps side by side, and those whose path is found wait for the others.
    """
    g, n, m = cost.shape
    u, v, owner = np.zeros((g, n)), np.zeros((g, m + 1)), np.full((g, m + 1), -1)
    for i in range(n):
        owner[:, m] = i
        end, slack, came, done = np.full(g, m), np.full((g, m), np.inf), np.full((g, m), m), np.zeros((g, m + 1), bool)
        live = np.arange(g)
        while len(live):
            j = end[live]
            done[live, j] = True
            row = owner[live, j]
            free = ~done[live, :m]
            reduced = cost[live, row] - u[live, row][:, None] - v[live, :m]
            better = free & (reduced < slack[live])
            s = np.where(better, reduced, slack[live])
            came[live] = np.where(better, j[:, None], came[live])
            k = np.where(free, s, np.inf).argmin(1)
            d = s[np.arange(len(live)), k]
            p, q = np.nonzero(done[live])
            u[live[p], owner[live[p], q]] += d[p]
            v[live[p], q] -= d[p]
            slack[live] = np.where(free, s - d[:, None], s)
            end[live] = k
            live = live[owner[live, k] >= 0]
        live = np.arange(g)
        while len(live):
            j = end[live]
            before = came[live, j]
            owner[live, j] = owner[live, before]
            end[live] = before
            live = live[before != m]
    return owner[:, :m]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost of a rectangular matrix: pairs of a row and a column."""
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    owner = assign_all((cost.T if flip else cost)[None])[0]
    return sorted((j, int(a)) if flip else (int(a), j) for j, a in enumerate(owner) if a >= 0)


def evaluate_images(det: np.ndarray, truth: np.ndarray, crowd: np.ndarray, ignored: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stacked images (images, rows by falling score, corners), ranges, thresholds and detections: the matched truth's place or -1, and whether it is ignored.

    ``ignored`` has truths by image and range. A detection may have any truth that is free and overlaps it by the threshold
    (one of 1 is met but for rounding). Of these it takes one that counts before an ignored one, then the one of larger
    overlap, then the later one. What it takes is free no longer, unless it is a crowd. All thresholds are decided together,
    detection by detection.
    """
    g, n = truth.shape[:2]
    ranges = ignored.shape[1]
    got = np.full((g, ranges, len(thresholds), det.shape[1]), -1)
    if not n or not det.shape[1]:
        return got, np.zeros(got.shape, bool)
    iou = iou_matrix(det, truth)
    enough = np.minimum(thresholds, 1 - 1e-10)[:, None]
    bonus = np.where(ignored, 0.0, 2.0)[:, :, None]  # an overlap is 1 at most
    free = np.ones((g, ranges, len(thresholds), n), bool)
    crowds = np.broadcast_to(crowd[:, None, None], free.shape)
    for d in range(det.shape[1]):
        over = iou[:, d, None, None]
        some = np.flatnonzero((over >= enough.min()).any((1, 2, 3)))  # images where this detection may match at all
        if not len(some):
            continue
        offer = np.where(free[some] & (over[some] >= enough), (over + bonus)[some], -1.0)
        best = n - 1 - offer[..., ::-1].argmax(-1)[..., None]
        found = np.take_along_axis(offer, best, -1) >= 0
        got[some, ..., d] = np.where(found, best, -1)[..., 0]
        left = free[some]
        np.put_along_axis(left, best, np.where(found, np.take_along_axis(crowds[some], best, -1), np.take_along_axis(left, best, -1)), -1)
        free[some] = left
    skip = np.take_along_axis(np.broadcast_to(ignored[:, :, None], free.shape), np.maximum(got, 0), -1)
    return got, (got >= 0) & skip


def evaluate_image(det: np.ndarray, truth: np.ndarray, crowd: np.ndarray, ignored: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one image and one range: thresholds by detections."""
    got, skip = evaluate_images(det[None], truth[None], crowd[None], ignored[None, None], thresholds)
    return got[0, 0], skip[0, 0]


def by_score(idx: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each stacked group by falling score, then idx."""
    return np.lexsort((idx, -score), axis=-1)[:, :most]


def area_of(b: np.ndarray) -> np.ndarray:
    return (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])


def two_sided(det: DataFrame, truth: DataFrame, groups: list[str], one: Callable, schema: str, width: int = 1, keyed: bool = True) -> DataFrame:
    """Rows that ``one`` gives for the detections and truths of groups, with the groups' names added.

    Both sides travel as one table dealt by a hash of the first group column. ``one`` gets groups of equally many
    detections and truths side by side, a group a row of every array, and gives columns of ``schema``: arrays of a row a
    group, of which the entries count where "_keep", if there is one, is set. ``width`` says how many numbers it
    holds for a pair. Without ``keyed`` it gives rows for all its groups together, and no names. Groups without
    detections give no rows.
    """
    columns = [*groups, "idx", *CORNERS, "score", "iscrowd"]
    side = lambda df, t: df.select(*(F.col(c) if c in df.columns else F.lit(False if c == "iscrowd" else 0.0).alias(c) for c in columns), F.lit(t).alias("_truth"))
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = {part.split()[0]: kinds[part.split()[1]] for part in schema.split(", ")}

    def many(t: pa.Table) -> pa.Table:
        t, begins = in_groups(t, groups, [("_truth", True), ("idx", True)])
        idx, score, of_truth = (t.column(c).to_numpy() for c in ("idx", "score", "_truth"))
        crowd, b = t.column("iscrowd").to_numpy().astype(bool), box_array(t)
        first, size = begins[:-1], np.diff(begins)
        truths = np.add.reduceat(of_truth, first).astype(np.int64)
        out, at = {n: [] for n in names}, []
        for of in stacks(size - truths, truths, width=width):
            n, m = size[of[0]] - truths[of[0]], truths[of[0]]
            if not n:
                continue
            d = first[of][:, None] + np.arange(n)
            g = first[of][:, None] + n + np.arange(m)
            got = one(idx[d], b[d], score[d], idx[g], b[g], crowd[g])
            keep = got.get("_keep", np.ones(got[names[0]].shape[:2], bool))
            for c in names:
                out[c].append(got[c][keep])
            if keyed:
                at.append(np.broadcast_to(first[of][:, None], keep.shape)[keep])
        column = lambda v, kind: packed_bytes(v) if kind == pa.binary() else pa.array(v, kind)
        rows = {c: column(np.concatenate(v), types[c]) if v else pa.array([], types[c]) for c, v in out.items()}
        key = t.select(groups).take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))) if keyed else None
        return pa.table(({g: key.column(g) for g in groups} if keyed else {}) | rows)

    both = side(det, 0).unionByName(side(truth, 1))
    kind = lambda g: both.schema[g].dataType.simpleString()
    return bucketed(both, groups[0]).groupBy("_bucket").applyInArrow(many, ", ".join([*((f"{g} {kind(g)}" for g in groups) if keyed else ()), schema]))


def packed_bytes(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of bytes."""
    n, width = rows.shape
    ends = pa.array(np.arange(n + 1, dtype=np.int64) * width).cast(pa.int32())
    return pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def match_detections(det: DataFrame, truth: DataFrame, thresholds: list[float], most: int = 100, area_range: tuple[float, float] = (0.0, 1e10), group: str = "image") -> DataFrame:
    """(image, idx, score, threshold, gt_idx, ignored) for every detection of the first ``most`` by score, at every threshold.

    ``truth`` has iscrowd. Truths that are crowds or outside the area range are ignored, and unmatched detections outside it.
    """
    ts = np.array(thresholds)

    def one(di, db, ds, gi, gb, crowd):
        o = by_score(di, ds, most)
        di, ds, db = np.take_along_axis(di, o, 1), np.take_along_axis(ds, o, 1), np.take_along_axis(db, o[..., None], 1)
        outside = lambda b: (area_of(b) < area_range[0]) | (area_of(b) > area_range[1])
        got, skip = evaluate_images(db, gb, crowd, (crowd | outside(gb))[:, None], ts)
        got, skip = got[:, 0], skip[:, 0] | ((got[:, 0] < 0) & outside(db)[:, None])
        flat = lambda v: np.broadcast_to(v, got.shape).reshape(len(got), -1)
        return {"idx": flat(di[:, None]), "score": flat(ds[:, None]), "threshold": flat(ts[:, None]), "gt_idx": flat(named(gi, got.reshape(len(got), -1)).reshape(got.shape)), "ignored": flat(skip)}

    return two_sided(det, truth, [group], one, "idx long, score double, threshold double, gt_idx long, ignored boolean", width=len(ts))


def named(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids at places of each stacked group, -1 for a place of -1."""
    more = np.concatenate([ids, np.full((len(ids), 1), -1)], 1)
    return np.take_along_axis(more, at, 1)  # the last is -1


def _pairs_of(di, gi, rows, cols, iou) -> dict:
    return {"idx": named(di, rows), "gt_idx": named(gi, cols), "iou": iou, "_keep": rows >= 0}


def greedy_match(det: DataFrame, truth: DataFrame, least: float, group: str = "image") -> DataFrame:
    """(image, idx, gt_idx, iou) of the greedy one-to-one matching by falling IoU."""
    one = lambda di, db, ds, gi, gb, crowd: _pairs_of(di, gi, *paired(iou_matrix(db, gb), least))
    return two_sided(det, truth, [group], one, "idx long, gt_idx long, iou double")


def cover_match(det: DataFrame, truth: DataFrame, group: str = "image") -> DataFrame:
    """(image, idx, gt_idx, iou): the best covered truth again and again, one to one."""
    return greedy_match(det, truth, 0.0, group)


def optimal_match(det: DataFrame, truth: DataFrame, iou_weight: float = 1.0, score_weight: float = 1.0, group: str = "image") -> DataFrame:
    """(image, idx, gt_idx) of the assignment of least total cost: iou_weight * (1 - IoU) - score_weight * score."""

    def one(di, db, ds, gi, gb, crowd):
        cost = iou_weight * (1 - iou_matrix(db, gb)) - score_weight * ds[:, :, None]
        if cost.shape[1] > cost.shape[2]:
            rows = assign_all(cost.transpose(0, 2, 1)) if cost.shape[2] else np.full(di.shape, -1)
            return {"idx": di, "gt_idx": named(gi, rows), "_keep": rows >= 0}
        rows = assign_all(cost)
        return {"idx": named(di, rows), "gt_idx": gi, "_keep": rows >= 0}

    return two_sided(det, truth, [group], one, "idx long, gt_idx long", width=4)


def mask_costs(logits: np.ndarray, score: np.ndarray, masks: np.ndarray, weights: tuple[float, float, float] = (2.0, 5.0, 5.0)) -> np.ndarray:
    """Cost of giving each predicted mask each true one, from the same sampled points (n x p logits, m x p zeros and ones).

    ``weights`` are those of the class score, of binary cross-entropy a point, and of the dice loss.
    """
    p = logits.shape[1]
    softplus = np.logaddexp(0, logits)  # -log(1 - sigmoid); less the logit it is -log(sigmoid)
    cross = (softplus @ (1 - masks).T + (softplus - logits) @ masks.T) / max(1, p)
    q = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
    dice = 1 - (2 * q @ masks.T + 1) / (q.sum(1)[:, None] + masks.sum(1)[None] + 1)
    return -weights[0] * score[:, None] + weights[1] * cross + weights[2] * dice


def optimal_mask_match(pred: DataFrame, truth: DataFrame, weights: tuple[float, float, float] = (2.0, 5.0, 5.0), group: str = "image") -> DataFrame:
    """(image, idx, gt_idx) of the least total cost between predicted masks (image, idx, score, points: logits) and true ones (image, idx, points: 0 or 1)."""

    def many(t: pa.Table) -> pa.Table:
        t, begins = in_groups(t, [group], [("_truth", True), ("idx", True)])
        idx, score, side = t.column("idx").to_numpy(), t.column("score").to_numpy(), t.column("_truth").to_numpy()
        rows: list[tuple] = []
        for i, j in zip(begins[:-1], begins[1:], strict=True):
            k = i + int((side[i:j] == 0).sum())
            if i < k < j:
                points = np.array(t.column("points").slice(i, j - i).to_pylist(), float)
                pairs = assign(np.round(mask_costs(points[: k - i], score[i:k], points[k - i :], weights), 9))
                rows += [(int(t.column(group)[int(i)].as_py()), int(idx[i + a]), int(idx[k + b])) for a, b in pairs]
        return pa.table({n: pa.array([r[c] for r in rows], pa.int64()) for c, n in enumerate((group, "idx", "gt_idx"))})

    points = F.col("points").cast("array<double>").alias("points")
    p = pred.select(F.col(group).cast("long").alias(group), F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score"), points, F.lit(0).alias("_truth"))
    g = truth.select(F.col(group).cast("long").alias(group), F.col("idx").cast("long").alias("idx"), F.lit(0.0).alias("score"), points, F.lit(1).alias("_truth"))
    return bucketed(p.unionByName(g), group).groupBy("_bucket").applyInArrow(many, f"{group} long, idx long, gt_idx long")
