"""Detection scores by category, object size and number of detections, as the usual twelve statistics, and proposal recall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.match import area_of, by_score, evaluate_images, named, paired, two_sided
from gridloom.operators.metrics import average_precision, mean_over_valid, packed_curves
from gridloom.operators.suppress import iou_matrix
from gridloom.sources.storage import materialized

# Fixed values of the evaluation: object sizes in pixels, IoU thresholds, and detections an image.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
PROPOSAL_AREAS = AREAS | {"96-128": (96.0**2, 128.0**2), "128-256": (128.0**2, 256.0**2), "256-512": (256.0**2, 512.0**2), "512-inf": (512.0**2, 1e10)}
THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
MOST = (1, 10, 100)


def matches_by_area(det: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS, areas: dict[str, tuple[float, float]] = AREAS, most: int = 100) -> DataFrame:
    """(image, category, idx, score, rank, area, threshold, gt_idx, ignored) of the first ``most`` detections of each image and category.

    Detections meet truths of their own category. A truth that is a crowd or outside the area range is ignored, and so is
    what matches it, and an unmatched detection outside the range. ``rank`` is the place by score, so that fewer detections
    an image are those of lesser rank: what they match does not depend on the rest.
    """
    ts, names, bounds = np.array(thresholds), list(areas), np.array(list(areas.values()))[:, :, None]

    def one(di, db, ds, gi, gb, crowd):
        di, ds, got, skip = _evaluated(di, db, ds, gb, crowd, ts, bounds, most)
        flat = lambda v: np.broadcast_to(v, got.shape).reshape(len(got), -1)
        part, rank = np.arange(len(names))[:, None, None], np.arange(di.shape[1])
        gt = named(gi, got.reshape(len(got), -1))
        return {"idx": flat(di[:, None, None]), "score": flat(ds[:, None, None]), "rank": flat(rank), "part": flat(part), "threshold": flat(ts[:, None]), "gt_idx": gt, "ignored": flat(skip)}

    got = two_sided(det, truth, ["image", "category"], one, "idx long, score double, rank long, part long, threshold double, gt_idx long, ignored boolean", width=len(names) * len(ts))
    return got.withColumn("area", F.element_at(F.array(*map(F.lit, names)), (F.col("part") + 1).cast("int"))).drop("part")


def _evaluated(di, db, ds, gb, crowd, ts, bounds, most):
    """idx and score by falling score, and the matched truth's place (or -1) and whether it is ignored by range, threshold and detection."""
    o = by_score(di, ds, most)
    di, ds, db = np.take_along_axis(di, o, 1), np.take_along_axis(ds, o, 1), np.take_along_axis(db, o[..., None], 1)
    outside = lambda b: (area_of(b)[:, None] < bounds[:, 0]) | (area_of(b)[:, None] > bounds[:, 1])
    got, skip = evaluate_images(db, gb, crowd, crowd[:, None] | outside(gb), ts)
    return di, ds, got, skip | ((got < 0) & outside(db)[:, :, None])


def packed_matches(det: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS, areas: dict[str, tuple[float, float]] = AREAS, most: int = 100, category: str | None = "category") -> DataFrame:
    """(image, category, idx, score, rank, hit, counts) of the same matches, a row a detection: bits by area and threshold.

    ``hit`` is set where it has a truth that counts, ``counts`` where it is not ignored. Without ``category`` all are of one.
    """
    ts, bounds = np.array(thresholds), np.array(list(areas.values()))[:, :, None]

    def one(di, db, ds, gi, gb, crowd):
        di, ds, got, skip = _evaluated(di, db, ds, gb, crowd, ts, bounds, most)
        bits = lambda v: np.packbits(v.reshape(len(v), -1, v.shape[-1]).transpose(0, 2, 1), axis=-1)
        return {"idx": di, "score": ds, "rank": np.broadcast_to(np.arange(di.shape[1]), di.shape), "hit": bits((got >= 0) & ~skip), "counts": bits(~skip)}

    got = two_sided(det, truth, ["image", category] if category else ["image"], one, "idx long, score double, rank long, hit binary, counts binary", width=len(areas) * len(ts))
    return got if category else got.withColumn("category", F.lit("all"))


def truths_by_area(truth: DataFrame, areas: dict[str, tuple[float, float]] = AREAS) -> DataFrame:
    """(category, area, n): truths that count."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = F.array(*(F.when(size.between(lo, hi), F.lit(name)) for name, (lo, hi) in areas.items()))
    return truth.where(~F.col("iscrowd")).select("category", F.explode(F.array_compact(inside)).alias("area")).groupBy("category", "area").agg(F.count("*").alias("n"))


def precision_and_recall(matches: DataFrame, n_truth: DataFrame, most: tuple[int, ...] = MOST) -> tuple[DataFrame, DataFrame]:
    """(category, area, threshold, ap) with the most detections an image, and (category, area, threshold, most, recall).

    Categories and sizes without truths are left out; those without detections have 0.
    """
    cells = n_truth.join(matches.select("threshold").distinct(), how="cross")  # as many rows as categories, sizes and thresholds
    key = ["category", "area", "threshold"]
    ap = average_precision(matches.where(F.col("rank") < most[-1]), n_truth, key)
    ap = cells.join(ap, key, "left").select(*key, F.coalesce("ap", F.lit(0.0)).alias("ap"))
    hits = matches.where("gt_idx >= 0 and not ignored").groupBy(*key).agg(*(F.count(F.when(F.col("rank") < k, 1)).alias(f"h{k}") for k in most))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("most"), F.coalesce(f"h{k}", F.lit(0)).alias("hits")) for k in most))).alias("r")
    recall = cells.join(hits, key, "left").select(*key, "n", each).select(*key, "r.most", (F.col("r.hits") / F.col("n")).alias("recall"))
    return ap, recall


def summary(ap: DataFrame, recall: DataFrame, most: tuple[int, ...] = MOST) -> DataFrame:
    """The twelve statistics, a row each (statistic, value): means over categories and thresholds, -1 where there is nothing."""
    p = lambda name, area="all", t=None: mean_over_valid(F.when((F.col("area") == area) & (F.lit(True) if t is None else F.round("threshold", 2) == t), F.col("ap"))).alias(name)
    r = lambda name, k, area="all": mean_over_valid(F.when((F.col("area") == area) & (F.col("most") == k), F.col("recall"))).alias(name)
    a = ap.agg(p("ap"), p("ap50", t=0.5), p("ap75", t=0.75), p("ap_small", "small"), p("ap_medium", "medium"), p("ap_large", "large"))
    b = recall.agg(*(r(f"ar_{k}", k) for k in most), *(r(f"ar_{x}", most[-1], x) for x in ("small", "medium", "large")))
    rows = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in df.columns))).alias("r")).select("r.*")
    return rows(a).unionByName(rows(b))


def evaluate(det: DataFrame, truth: DataFrame, **options) -> DataFrame:
    """The twelve statistics of detections (image, category, idx, score, corners) against truths (with iscrowd)."""
    thresholds, areas = options.get("thresholds", THRESHOLDS), options.get("areas", AREAS)
    cells = [(a, t) for a in areas for t in thresholds]
    of = truth.sparkSession.createDataFrame([(k, a, t) for k, (a, t) in enumerate(cells)], "cell long, area string, threshold double")
    n = truths_by_area(truth, areas).join(F.broadcast(of), "area")
    curves = packed_curves(packed_matches(det, truth, **options), n.select("category", "cell", "n"), len(cells), MOST)
    every = n.join(curves, ["category", "cell"], "left")
    ap = every.select("category", "area", "threshold", F.coalesce("ap", F.lit(0.0)).alias("ap"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("most"), F.coalesce(f"h{k}", F.lit(0)).alias("hits")) for k in MOST))).alias("r")
    recall = every.select("category", "area", "threshold", "n", each).select("category", "area", "threshold", "r.most", (F.col("r.hits") / F.col("n")).alias("recall"))
    return summary(ap, recall)


def precision_by_threshold(det: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, ap) of all detections together."""
    n = truth.where(~F.col("iscrowd")).agg(F.count("*").alias("n"))
    of = truth.sparkSession.createDataFrame(list(enumerate(thresholds)), "cell long, threshold double")
    n = n.crossJoin(F.broadcast(of)).select(F.lit("all").alias("category"), "cell", "n", "threshold")
    matched = packed_matches(det, truth, thresholds, {"all": AREAS["all"]}, category=None)
    return packed_curves(matched, n.drop("threshold"), len(thresholds), ()).join(F.broadcast(of), "cell").select("threshold", "ap")


def proposal_recall(proposals: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS, areas: dict[str, tuple[float, float]] = PROPOSAL_AREAS, limits: tuple[int, ...] = (100, 1000)) -> DataFrame:
    """(area, most, threshold, recall) of the first ``most`` proposals of each image, over images that have any; -1 without truths.

    Within an image the best covered truth and its proposal are paired and retire, until one side is used up.
    """
    ts, lo, hi = np.array(thresholds), *np.array(list(areas.values())).T
    part, most, threshold = (v.reshape(1, -1) for v in np.meshgrid(np.arange(len(areas)), np.array(limits), ts, indexing="ij"))

    def one(di, db, ds, gi, gb, crowd):
        g, n, m = len(di), di.shape[1], gb.shape[1]
        rank = np.empty(di.shape, np.int64)
        np.put_along_axis(rank, by_score(di, ds, n), np.broadcast_to(np.arange(n), di.shape), 1)
        size = area_of(gb)[:, None]
        of = ~crowd[:, None] & (size >= lo[:, None]) & (size <= hi[:, None])  # groups, areas, truths
        first = rank[:, None] < np.array(limits)[:, None]  # groups, limits, proposals
        hits = np.zeros((len(lo), len(limits), len(ts)), np.int64)
        if m:
            iou = iou_matrix(db, gb)
            some = np.flatnonzero((iou >= ts.min()).any((1, 2)))  # pairs under every threshold are no hits, and come last
            if len(some):
                v = np.where(of[some][:, :, None, None, :] & first[some][:, None, :, :, None], iou[some][:, None, None], -1.0)
                got = paired(v.reshape(-1, n, m), float(ts.min()))[2].reshape(len(some), len(lo), len(limits), -1)
                for k, t in enumerate(ts.tolist()):
                    hits[..., k] = (got >= t).sum((0, 3))
        total = np.broadcast_to(of.sum((0, 2))[:, None, None], hits.shape)
        return {"part": part, "most": most, "threshold": threshold, "hits": hits.reshape(1, -1), "n": total.reshape(1, -1)}

    got = two_sided(proposals, truth, ["image"], one, "part long, most long, threshold double, hits long, n long", width=len(areas) * len(limits), keyed=False)
    total = got.groupBy("part", "most", "threshold").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    name = F.element_at(F.array(*map(F.lit, areas)), (F.col("part") + 1).cast("int"))
    return total.select(name.alias("area"), "most", "threshold", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(-1.0).alias("recall"))
