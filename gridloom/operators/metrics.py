"""Evaluation metrics over matched detections, clicks, candidates and frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.storage import materialized


def _running(matches: DataFrame, by: list[str]) -> DataFrame:
    """The detections that count, with the running tp, fp and place of each class by falling score (then image, idx).

    Rows are dealt by ranges of that order (numbered in _part), so that a class may span many tasks: what runs along the
    ranking is computed within each range, and the ranges before it add a row for each range and class.
    """
    order, hit = [F.desc("score"), F.asc("image"), F.asc("idx")], F.col("gt_idx") >= 0
    ranked = materialized(matches.where("not ignored").repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranked.groupBy("_part", *by).agg(F.count(F.when(hit, 1)).alias("_hits"), F.count("*").alias("_all"))
    carried = parts.select("_part", *by, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_hits", "_all")))
    rows = ranked.withColumns({"_tp": F.count(F.when(hit, 1)).over(w), "_at": F.count("*").over(w)}).join(carried, ["_part", *by])
    rows = rows.withColumns({"tp": F.col("_tp") + F.col("_hits"), "place": F.col("_at") + F.col("_all")})
    return rows.withColumn("fp", F.col("place") - F.col("tp")).drop("_tp", "_at", "_hits", "_all")


def cumulative(matches: DataFrame, by: list[str]) -> DataFrame:
    """Running true and false positives by falling score; ignored detections count as neither. Ties go by image, then idx."""
    return _running(matches, by).drop("_part")


def precision_recall(matches: DataFrame, n_truth: DataFrame, by: list[str]) -> DataFrame:
    """Recall and the precision envelope (largest precision at this place or later) along the ranking.

    The envelope is a running maximum from the ranking's end, again within ranges and then across them.
    """
    c = materialized(_running(matches, by))
    keys = [k for k in by if k in n_truth.columns]
    joined = c.join(n_truth, keys) if keys else c.crossJoin(F.broadcast(n_truth))  # one row
    p = joined.select("_part", *by, "place", "tp", "n", (F.col("gt_idx") >= 0).alias("hit"), (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("place")).alias("precision"))
    later = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = p.groupBy("_part", *by).agg(F.max("precision").alias("_top")).select("_part", *by, F.max("_top").over(later).alias("_later"))
    back = Window.partitionBy("_part", *by).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    own = p.withColumn("_own", F.max("precision").over(back))
    return own.join(tops, ["_part", *by]).withColumn("envelope", F.greatest("_own", "_later")).drop("_part", "_own", "_later")


def interpolated(pr: DataFrame, by: list[str], points: int = 101) -> DataFrame:
    """Precision at each of the evenly spaced recalls: the envelope at the first place that reaches it, 0 beyond the last.

    The k-th hit is the first place for the grid points above the recall of k - 1 hits, up to its own; the first place of
    all serves a recall of 0. So a class has few rows after this filter, whatever its size.
    """
    reached = lambda k: F.floor(k / F.col("n") * (points - 1) + 1e-6)
    a = F.when(F.col("place") == 1, 0).otherwise(reached(F.col("tp") - 1) + 1)
    got = pr.where("hit or place = 1").select(*by, "envelope", a.cast("int").alias("a"), reached(F.col("tp")).cast("int").alias("b")).where("a <= b")
    got = got.select(*by, F.explode(F.sequence("a", "b")).alias("point"), "envelope")
    # where the first place is no hit, the first hit serves the points up to its recall, but for 0
    got = got.groupBy(*by, "point").agg(F.max("envelope").alias("precision"))
    keys = pr.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return keys.join(got, [*by, "point"], "left").select(*by, "point", F.coalesce("precision", F.lit(0.0)).alias("precision"))


def average_precision(matches: DataFrame, n_truth: DataFrame, by: list[str]) -> DataFrame:
    return interpolated(precision_recall(matches, n_truth, by), by).groupBy(*by).agg(F.avg("precision").alias("ap"))


#: Detections that a range of the ranking holds, about.
RANGE = 500_000


def packed_curves(matches: DataFrame, n_truth: DataFrame, cells: int, most: tuple[int, ...]) -> DataFrame:
    """(category, cell, ap, h..): average precision at 101 recalls, and hits of ranks under each of ``most``, by category and cell.

    ``matches`` has a row a detection (image, category, idx, score, rank), and ``hit`` and ``counts``, a bit a cell (a size
    and threshold): all cells share one ranking, so it is sorted once. It is dealt by ranges, a Python call each; what the
    ranges before it have counted comes as a row a range and cell, and what later ones reach is taken up at the end.
    ``n_truth`` (category, cell, n) says which cells there are.
    """
    spark = matches.sparkSession
    held = materialized(matches)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.count() // RANGE)
    ranked = materialized(held.repartitionByRange(ranges, "category", F.desc("score"), "image", "idx").withColumn("_part", F.spark_partition_id()))
    names = ["hits", "places", *(f"h{k}" for k in most)]
    width = -(-cells // 8)

    def bits(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
        return np.unpackbits(raw, axis=1, count=cells).astype(bool)

    def classes(t) -> list[tuple[str, np.ndarray]]:
        codes = t.column("category").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        of = codes.indices.to_numpy(zero_copy_only=False)
        return [(v, np.flatnonzero(of == k)) for k, v in enumerate(codes.dictionary.to_pylist())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, rows = pa.Table.from_batches([b]), []
            part, rank, hit, there = t.column("_part").to_numpy(), t.column("rank").to_numpy(), bits(t.column("hit")), bits(t.column("counts"))
            for name, at in classes(t):
                for p in np.unique(part[at]):
                    k = at[part[at] == p]
                    sums = [hit[k].sum(0), there[k].sum(0), *(hit[k[rank[k] < m]].sum(0) for m in most)]
                    rows += [(int(p), name, c, *(int(s[c]) for s in sums)) for c in range(cells)]
            kinds = [pa.int32(), pa.string(), pa.int64(), *[pa.int64()] * len(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["_part", "category", "cell", *names])

    schema = "_part int, category string, cell long, " + ", ".join(f"{n} long" for n in names)
    counted = ranked.select("_part", "category", "rank", "hit", "counts").mapInArrow(count, schema).groupBy("_part", "category", "cell").agg(*(F.sum(n).alias(n) for n in names))
    counted = materialized(counted)
    before = Window.partitionBy("category", "cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select("_part", "category", "cell", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("hits", "places"))).join(n_truth, ["category", "cell"])

    def curve(t: pa.Table, c: pa.Table) -> pa.Table:
        score, image, idx = (t.column(k).to_numpy() for k in ("score", "image", "idx"))
        down = np.where(np.isnan(score), -np.inf, -score)  # as Spark orders them
        hit, there, rows = bits(t.column("hit")), bits(t.column("counts")), []
        known = {(r["category"], r["cell"]): r for r in c.to_pylist()}
        part = c.column("_part")[0].as_py() if len(c) else 0
        for name, at in classes(t):
            at = at[np.lexsort((idx[at], image[at], down[at]))]
            for cell in range(cells):
                k, r = at[there[at, cell]], known.get((name, cell))
                if r is None or not len(k):
                    continue
                h = hit[k, cell]
                tp, place, n = r["hits"] + np.cumsum(h), r["places"] + np.arange(1, len(k) + 1), r["n"]
                envelope = np.maximum.accumulate((tp / place)[::-1])[::-1]
                ends = np.flatnonzero(h | (place == 1))
                reached = lambda v: np.floor(v / n * 100 + 1e-6)  # noqa: B023, E731
                a, b = np.where(place[ends] == 1, 0, reached(tp[ends] - 1) + 1), reached(tp[ends])
                rows.append((part, name, cell, -1, -1, envelope[0]))
                new = np.flatnonzero(a <= b)  # places that reach another of the 101 recalls
                rows += [(part, name, cell, int(x), int(y), v) for x, y, v in zip(a[new], b[new], envelope[ends[new]], strict=True)]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 3, pa.float64()]
        return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(("_part", "category", "cell", "a", "b", "envelope"), kinds, strict=True))})

    got = ranked.drop("rank").groupBy("_part").cogroup(carried.groupBy("_part")).applyInArrow(curve, "_part int, category string, cell long, a long, b long, envelope double")
    got = materialized(got)  # a hundred rows a cell, and one a range
    key = ["category", "cell"]
    later = Window.partitionBy(*key).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = got.where("a < 0").select("_part", *key, F.max("envelope").over(later).alias("_later"))
    reach = got.where("a >= 0").join(tops, ["_part", *key]).select(*key, F.greatest("envelope", "_later").alias("v"), F.explode(F.sequence("a", "b")).alias("point"))
    points = reach.groupBy(*key, "point").agg(F.max("v").alias("v")).groupBy(*key).agg((F.sum("v") / 101).alias("ap"))
    sums = counted.groupBy(*key).agg(F.sum("places").alias("_places"), *(F.sum(f"h{k}").alias(f"h{k}") for k in most))
    return n_truth.select(*key).join(sums.where("_places > 0"), key).join(points, key, "left").select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"), *(f"h{k}" for k in most))


def mean_over_valid(value: Column) -> Column:
    """Mean of the entries over -1; -1 where there is none."""
    return F.coalesce(F.avg(F.when(value > -1, value)), F.lit(-1.0))


def sequence_iou(det: DataFrame, truth: DataFrame, sizes: tuple[str, str] = ("area", "area")) -> DataFrame:
    """Spatio-temporal IoU of tracks by their frames' boxes: sum of intersections over sum of unions; a frame of one side only adds its area."""
    from gridloom.operators import boxes as B

    p = B.prefixed(det, "l_", "clip").join(B.prefixed(truth, "r_", "clip").withColumn("l_frame", F.col("r_frame")), ["clip", "l_frame"])
    inter = p.groupBy("clip", "l_track", "r_track").agg(F.sum(B.intersection(B.corners("l_"), B.corners("r_"))).alias("inter"))
    total = lambda df, s: df.groupBy("clip", F.col("track").alias(f"{s}_track")).agg(F.sum(B.area(B.corners())).alias(f"{s}_area"))
    j = inter.join(total(det, "l"), ["clip", "l_track"]).join(total(truth, "r"), ["clip", "r_track"])
    union = F.col("l_area") + F.col("r_area") - F.col("inter")
    return j.select("clip", "l_track", "r_track", F.when(union > 0, F.col("inter") / union).otherwise(0.0).alias("iou"))


def keypoint_similarity(points: DataFrame, key: list[str]) -> DataFrame:
    """Mean of exp(-d^2 / (2 sigma^2 area)) over visible points (dx, dy, sigma, area, visible); with none visible, over all."""
    e = (F.col("dx") ** 2 + F.col("dy") ** 2) / (2 * F.col("sigma") ** 2 * F.col("area") + 1e-12)
    seen = F.avg(F.when(F.col("visible") > 0, F.exp(-e)))
    return points.groupBy(*key).agg(F.coalesce(seen, F.avg(F.exp(-e))).alias("oks"))


def keypoint_similarity_in_box(points: DataFrame, key: list[str]) -> DataFrame:
    """OKS of predicted points (px, py) with true ones (x, y, visible) of objects with a box (bx, by, bw, bh), sigma and area.

    Over visible points, by their distance; with none visible, over all points, by their distance to the box doubled on
    every side (0 inside).
    """
    beyond = lambda p, lo, size: F.greatest(F.lit(0.0), lo - size - p) + F.greatest(F.lit(0.0), p - (lo + 2 * size))
    c = F.col
    e = lambda dx, dy: F.exp(-(dx**2 + dy**2) / (2 * (2 * c("sigma")) ** 2 * (c("area") + 1e-12)))
    own = e(c("px") - c("x"), c("py") - c("y"))
    box = e(beyond(c("px"), c("bx"), c("bw")), beyond(c("py"), c("by"), c("bh")))
    return points.groupBy(*key).agg(F.coalesce(F.avg(F.when(c("visible") > 0, own)), F.avg(box)).alias("oks"))


def present_absent(rows: DataFrame, least_area: float = 0.01) -> DataFrame:
    """One row from (iou, present, predicted: the mask's share of the image): mean IoU where the object is there, and the share of (near) empty predictions where it is not."""
    there = F.col("present")
    empty = (F.col("predicted") < least_area).cast("double")
    return rows.agg(F.count(F.when(there, 1)).alias("n_present"), F.avg(F.when(there, F.col("iou"))).alias("iou_present"), F.count(F.when(~there, 1)).alias("n_absent"), F.avg(F.when(~there, empty)).alias("empty_absent"))


def clicks_to_threshold(clicks: DataFrame, thresholds: list[float], most: int = 20) -> DataFrame:
    """Mean over samples of the first click (from 1) whose IoU reaches the threshold; ``most`` for samples that never do."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    first = clicks.select("sample", "click", "iou", t).groupBy("sample", "threshold").agg(F.min(F.when(F.col("iou") >= F.col("threshold"), F.col("click") + 1)).alias("k"))
    return first.groupBy("threshold").agg(F.avg(F.coalesce("k", F.lit(most)).cast("double")).alias("clicks"), F.count(F.when(F.col("k").isNull(), 1)).alias("never"))


def max_and_oracle(candidates: DataFrame, key: str) -> DataFrame:
    """IoU of the candidate with the best predicted score (the lowest token among equals), and the best IoU of any."""
    return candidates.groupBy(key).agg(F.max(F.struct("pred", (-F.col("token")).alias("neg"), F.col("iou"))).alias("m"), F.max("iou").alias("oracle")).select(key, F.col("m.iou").alias("max_iou"), "oracle")


def classification_rates(rows: DataFrame, truth: str, pred: str, background: str) -> DataFrame:
    """Share right, share right among foreground, and share of foreground called background."""
    fg = F.col(truth) != background
    right = (F.col(truth) == F.col(pred)).cast("double")
    return rows.agg(F.avg(right).alias("accuracy"), F.avg(F.when(fg, right)).alias("fg_accuracy"), F.avg(F.when(fg, (F.col(pred) == background).cast("double"))).alias("false_negative"))


def decayed_average(values: Column, decay: float) -> Column:
    """Average of an ordered array whose earlier entries fade: sum and count are multiplied by exp(-1 / decay) at each step."""
    import math

    a = math.exp(-1.0 / decay)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    step = lambda acc, v: F.struct((acc["s"] * a + v).alias("s"), (acc["n"] * a + 1.0).alias("n"))
    return F.aggregate(values, zero, step, lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
