"""Clips of frames in order: windows, transport of mask mass, tracks, and memory of recent frames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.match import greedy_pairs
from gridloom.operators.suppress import CORNERS, box_array, bucketed, in_groups, iou_matrix


def clip_windows(lengths: DataFrame, size: int, stride: int) -> DataFrame:
    """(clip, window, pos, frame): windows of ``size`` frames a ``stride`` apart, from frame 0 on; clips that are too short give none."""
    span = (size - 1) * stride + 1
    fit = lengths.where(F.col("n") >= span)
    starts = fit.select("clip", F.posexplode(F.sequence(F.lit(0), (F.col("n") - span).cast("int"), F.lit(span))).alias("window", "start"))
    return starts.select("clip", "window", F.posexplode(F.sequence("start", F.col("start") + (size - 1) * stride, F.lit(stride))).alias("pos", "frame"))


def hops(lengths: DataFrame, stride: int) -> DataFrame:
    """(clip, src, dst): steps of ``stride`` frames, the last one held to the clip's end."""
    s = lengths.where("n > 1").select("clip", "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 2).cast("int"), F.lit(stride))).alias("src"))
    return s.select("clip", "src", F.least(F.col("src") + stride, F.col("n") - 1).cast("int").alias("dst"))


def even_samples(lengths: DataFrame, k: int) -> DataFrame:
    """Up to k distinct frames, evenly from the first to the last."""
    at = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")
    return lengths.select("clip", "n", at).select("clip", F.floor(F.col("i") * (F.col("n") - 1) / F.lit(float(k - 1))).cast("int").alias("frame")).distinct()


def full_tracks(rows: DataFrame, group: str, item: str, frame: str, most: int) -> DataFrame:
    """Items present in every frame of their group, the first ``most`` of each group by id."""
    frames = rows.groupBy(group).agg(F.count_distinct(frame).alias("_all"))
    seen = rows.groupBy(group, item).agg(F.count_distinct(frame).alias("_n")).join(frames, group).where("_n = _all")
    return seen.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(item))).where(F.col("_rn") <= most).select(group, item)


def memory(frames: DataFrame, value: str, recent: int = 3, key: str = "clip", order: str = "frame") -> DataFrame:
    """What each frame reads: the clip's first entry, which never leaves, and the last ``recent`` of those after it."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.collect_list(F.when(F.col("_rn") > 1, F.col(value))).over(w.rowsBetween(-(recent - 1), 0))
    rows = frames.withColumn("_rn", F.row_number().over(w))
    return rows.select(key, order, F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("anchor"), near.alias("recent"))


def transport_plan(a: np.ndarray, b: np.ndarray, blur: float = 0.1, steps: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Entropic transport between uniform masses over two sets of features: cost 1 - cosine, strength blur^2, in the log domain."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    cost, eps = 1 - unit(a) @ unit(b).T, blur * blur
    la, lb = -np.log(len(a)), -np.log(len(b))
    f, g = np.zeros(len(a)), np.zeros(len(b))

    def soft(m: np.ndarray, axis: int) -> np.ndarray:
        top = m.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(m - top).sum(axis))

    for _ in range(steps):
        new = -eps * soft((g[None] - cost) / eps + lb, 1)
        g = -eps * soft((new[:, None] - cost) / eps + la, 0)
        moved, f = np.abs(new - f).max(), new
        if moved < tol:
            break
    return np.exp((f[:, None] + g[None] - cost) / eps + la + lb)


def push_mass(mass: np.ndarray, plan: np.ndarray, sharpen: float = 1.0) -> np.ndarray:
    """Mass moved along a plan between uniform masses; the peak becomes 1, and powers sharpen it."""
    heat = (mass * len(plan)) @ plan
    heat = heat / (heat.max() + 1e-8)
    heat = heat**sharpen
    return heat / (heat.max() + 1e-8)


def entropy(mass: np.ndarray) -> float:
    p = mass / max(float(mass.sum()), 1e-12)
    return float(-(p * np.log(np.maximum(p, 1e-12))).sum())


def propagate(grids: DataFrame, blur: float = 0.3, sharpen: float = 2.0, threshold: float = 0.5) -> DataFrame:
    """(clip, frame, node, heat, inside): the mass of each clip's first frame (column mass) pushed from frame to frame.

    grids: clip, frame, node, feat, mass. Frames of a clip follow each other; one Python call gets many clips.
    """

    def many(t: pa.Table) -> pa.Table:
        t, starts = in_groups(t, ["clip", "frame"], [("node", True)])
        clip, mass, feats = t.column("clip").to_numpy(), t.column("mass").to_numpy(), t.column("feat").to_pylist()
        heats, inside, before, heat = [], [], None, None
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            feat = np.array(feats[i:j], float)
            fresh = i == 0 or clip[i] != clip[i - 1]
            heat = mass[i:j].astype(float) if fresh else push_mass(heat, transport_plan(before, feat, blur), sharpen)
            before = feat
            heats.append(heat)
            inside.append(heat > threshold * heat.max())
        out = t.select(["clip", "frame", "node"])
        return out.append_column("heat", pa.array(np.concatenate(heats))).append_column("inside", pa.array(np.concatenate(inside)))

    rows = bucketed(grids, "clip").select("_bucket", F.col("clip").cast("long").alias("clip"), F.col("frame").cast("int").alias("frame"), F.col("node").cast("long").alias("node"), "feat", F.col("mass").cast("double").alias("mass"))
    return rows.groupBy("_bucket").applyInArrow(many, "clip long, frame int, node long, heat double, inside boolean")


def advance(active: dict[int, np.ndarray], boxes: np.ndarray, least: float, fresh: int, open_new: bool) -> tuple[list[int], dict[int, np.ndarray], int]:
    """One frame of track assignment: the track of each box (-1: none), the tracks that go on, and the next free number."""
    got = [-1] * len(boxes)
    if open_new:
        got = list(range(fresh, fresh + len(boxes)))
        fresh += len(boxes)
    elif active and len(boxes):
        names = sorted(active)
        for a, b in greedy_pairs(iou_matrix(np.stack([active[k] for k in names]), boxes), least):
            got[b] = names[a]
    return got, {t: boxes[i] for i, t in enumerate(got) if t >= 0}, fresh


def assign_tracks(frames: DataFrame, least: float = 0.1, group: str = "clip") -> DataFrame:
    """(clip, frame, idx, track): the first frame opens a track for each box; later boxes take the tracks they match, greedily by IoU.

    A track that misses a frame ends, and boxes without a track get -1.
    """

    def many(t: pa.Table) -> pa.Table:
        t, starts = in_groups(t, [group, "frame"], [("idx", True)])
        key, b = t.column(group).to_numpy(), box_array(t)
        active, fresh, track = {}, 0, []
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            first = i == 0 or key[i] != key[i - 1]
            if first:
                active, fresh = {}, 0
            got, active, fresh = advance(active, b[i:j], least, fresh, first)
            track += got
        return t.select([group, "frame", "idx"]).append_column("track", pa.array(track, pa.int64()))

    rows = bucketed(frames, group).select("_bucket", *(F.col(c).cast("long").alias(c) for c in (group, "frame", "idx")), *CORNERS)
    return rows.groupBy("_bucket").applyInArrow(many, f"{group} long, frame long, idx long, track long")


def reseeded(scores: DataFrame, every: int, least: float, group: str = "clip", overlap: str | None = None, least_overlap: float = 0.5) -> DataFrame:
    """(clip, frame, state): a state carried on, replaced at every ``every``-th frame by that frame's proposal if its score is enough.

    With ``overlap`` (the IoU of the frame's proposal with what was carried to it), a proposal must also overlap by
    ``least_overlap``. A clip starts with its first frame's state.
    """
    taken = (F.col("frame") % every == 0) & (F.col("score") >= least)
    if overlap is not None:
        taken = taken & (F.col(overlap) >= least_overlap)
    w = Window.partitionBy(group).orderBy("frame")
    state = F.coalesce(F.max(F.when(taken, F.col("frame"))).over(w), F.min("frame").over(w))
    return scores.select(group, F.col("frame").cast("long").alias("frame"), state.cast("long").alias("state"))


def fold_state(box: np.ndarray | None, shift: np.ndarray, proposals: np.ndarray, scores: np.ndarray, ids: np.ndarray, reseed: bool, least_score: float, least_overlap: float) -> tuple[np.ndarray | None, int, float | None]:
    """One frame of re-seeding: the state after it, the proposal that it was replaced by (-1: none), and that proposal's overlap.

    The carried state moves by ``shift``. At a frame that re-seeds, the proposal of enough score that overlaps what was
    carried most (the least id among equals) replaces it if it overlaps by enough. Without a state the best-scored one starts it.
    """
    ok = np.flatnonzero(scores >= least_score)
    ok = ok[np.argsort(ids[ok], kind="stable")]
    if box is None:
        if not len(ok):
            return None, -1, None
        k = ok[int(np.argmax(scores[ok]))]
        return proposals[k], int(ids[k]), None
    box = box + np.concatenate([shift, shift])
    if not reseed or not len(ok):
        return box, -1, None
    v = np.round(iou_matrix(box[None], proposals[ok])[0], 9)
    k = int(np.argmax(v))
    return (proposals[ok[k]], int(ids[ok[k]]), float(v[k])) if v[k] >= least_overlap else (box, -1, float(v[k]))


FOLDED = "frame long, x0 double, y0 double, x1 double, y1 double, taken long, overlap double"


def fold_frames(clip, frames: pd.DataFrame, box: np.ndarray | None, every: int, least_score: float, least_overlap: float) -> tuple[list[tuple], np.ndarray | None]:
    """The rows of ``reseed_fold`` for frames of one clip in order (a row a proposal, or one with a null idx), and the state after them."""
    f = frames.sort_values(["frame", "idx"], kind="stable")
    at, ids, scores = f["frame"].to_numpy(), f["idx"].to_numpy(float), f["score"].to_numpy(float)
    shifts, corners = f[["dx", "dy"]].to_numpy(float), f[list(CORNERS)].to_numpy(float)
    real, out = ~np.isnan(ids), []
    cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    for i, j in itertools.pairwise(cut):
        k = i + np.flatnonzero(real[i:j])
        box, taken, overlap = fold_state(box, shifts[i], corners[k], scores[k], ids[k], at[i] % every == 0, least_score, least_overlap)
        out.append((clip, int(at[i]), *(map(float, box) if box is not None else (None,) * 4), taken, overlap))
    return out, box


def frame_rows(frames: DataFrame, proposals: DataFrame, group: str = "clip") -> DataFrame:
    """Frames (clip, frame, dx, dy) with their proposals (clip, frame, idx, corners, score): a row for each, or one without a proposal."""
    p = proposals.select(group, "frame", F.col("idx").cast("double").alias("idx"), *(F.col(c).cast("double").alias(c) for c in (*CORNERS, "score")))
    f = frames.select(F.col(group), "frame", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"))
    return f.join(p, [group, "frame"], "left").select(F.col(group).cast("long").alias(group), F.col("frame").cast("long").alias("frame"), "dx", "dy", "idx", *CORNERS, "score")


def reseed_fold(frames: DataFrame, proposals: DataFrame, every: int, least_score: float = 0.0, least_overlap: float = 0.5, group: str = "clip") -> DataFrame:
    """(clip, frame, x0, y0, x1, y1, taken, overlap): a box carried from frame to frame, whose own place decides what may replace it.

    Every frame's motion (dx, dy) moves the carried box. At each ``every``-th frame the proposal that overlaps the moved box
    most takes its place if the overlap is enough, so later overlaps depend on what was taken before: a fold along the
    clip, one clip's frames at a time. A clip has no box until a frame proposes one.
    """

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for clip, part in pdf.groupby(group) for r in fold_frames(clip, part, None, every, least_score, least_overlap)[0]]
        return pd.DataFrame(rows, columns=[group, *(c.split()[0] for c in FOLDED.split(", "))])

    return bucketed(frame_rows(frames, proposals, group), group).groupBy("_bucket").applyInPandas(many, f"{group} long, {FOLDED}")


def correction_click(truth: np.ndarray, pred: np.ndarray) -> tuple[int, int, int] | None:
    """Next click (y, x, label): the deepest cell of the larger error, missed cells first among equals; None without errors."""
    missed, extra = truth & ~pred, pred & ~truth
    if not missed.any() and not extra.any():
        return None
    region, label = (missed, 1) if missed.sum() >= extra.sum() else (extra, 0)
    depth, left = np.zeros(region.shape, int), region.copy()
    while left.any():
        depth[left] += 1
        p = np.pad(left, 1)
        left = left & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    y, x = np.unravel_index(int(np.argmax(depth)), depth.shape)
    return int(y), int(x), label


def correction_clicks(masks: DataFrame, height: int) -> DataFrame:
    """(mask, y, x, label) of the next click for each pair of masks that differ; masks: mask, truth and pred, column-major arrays of 0 and 1."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m, t, p in zip(*(b.column(c).to_pylist() for c in ("mask", "truth", "pred")), strict=True):
                click = correction_click(*(np.array(v, bool).reshape(-1, height).T for v in (t, p)))
                if click:
                    rows.append((m, *click))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["mask", "y", "x", "label"])

    return masks.select(F.col("mask").cast("long").alias("mask"), "truth", "pred").mapInArrow(batch, "mask long, y long, x long, label long")


def synthetic_clips(boxes: DataFrame, frames: int, most_shift: float, width: float, seed: int = 0, key: str = "image") -> DataFrame:
    """(image, frame, and the boxes' columns): ``frames`` views of each image, every one mirrored or not and moved by its own draw.

    All boxes of a view move together and keep their idx, so that they are tracks of the clip. Draws are fixed by a hash.
    """
    from gridloom.functions.text import hash_number

    of, image = Window.partitionBy(key), F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1
    draw = lambda frame, k: hash_number(key, F.lit(frame), F.lit(seed + k))
    shift = lambda frame, k: (draw(frame, k) % 2_000_001 / 1e6 - 1) * most_shift
    drawn = F.array(*(F.struct(F.lit(f).alias("frame"), (draw(f, 0) % 2 == 1).alias("_flip"), shift(f, 1).alias("_dx"), shift(f, 2).alias("_dy")) for f in range(frames)))
    # drawn at one box of each image, whose views all its boxes take
    views = boxes.withColumn("_first", image).withColumn("_views", F.when(F.col("_first"), drawn)).withColumn("_views", F.max("_views").over(of))
    moved = views.select(*boxes.columns, F.explode("_views").alias("_view")).select(*boxes.columns, "_view.*")
    x0, x1 = (F.when(F.col("_flip"), width - F.col(b)).otherwise(F.col(a)) + F.col("_dx") for a, b in (("x0", "x1"), ("x1", "x0")))
    return moved.withColumns({"x0": x0, "x1": x1, "y0": F.col("y0") + F.col("_dy"), "y1": F.col("y1") + F.col("_dy")}).drop("_flip", "_dx", "_dy")
