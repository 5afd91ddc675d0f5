"""Queries over boxes: encodings, overlap joins, labelling, gates and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import boxes as B
from gridloom.operators.annotations import top_per_group
from gridloom.operators.crowds import crowded_overlaps
from gridloom.plans.bridge import BOXES_SQL, boxes, gt_and_det
from gridloom.plans.registry import query, table

INTER = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
UNION = f"({AREA.format('a')} + {AREA.format('b')} - {INTER})"
IOU = f"CASE WHEN {UNION} > 0 THEN {INTER} / {UNION} ELSE 0.0 END"
HULL = "((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)))"


@query("j8_box_iou_giou", f"WITH {BOXES_SQL} SELECT a.image, a.idx AS l_idx, b.idx AS r_idx, round({INTER} / ({UNION} + 1e-6), 6) AS iou, round({INTER} / ({UNION} + 1e-6) - ({HULL} - {UNION}) / ({HULL} + 1e-6), 6) AS giou FROM gt a JOIN det b USING (image)")
def j8(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.box_iou_matrix(gt, det).withColumns({c: F.round(c, 6) for c in ("iou", "giou")})


@query("j7_coverage_ioy", f"WITH {BOXES_SQL} SELECT a.image, a.idx AS l_idx, b.idx AS r_idx, round({INTER} / {AREA.format('a')}, 6) AS coverage, round({INTER} / {AREA.format('b')}, 6) AS ioy FROM gt a JOIN det b USING (image) WHERE {INTER} > 0")
def j7(spark, sf):
    gt, det = gt_and_det(spark, sf)
    a, b = B.corners("l_"), B.corners("r_")
    return B.overlapping(gt, det).select("image", "l_idx", "r_idx", F.round(B.coverage(a, b), 6).alias("coverage"), F.round(B.coverage(b, a), 6).alias("ioy"))


BEST = f"SELECT a.image, a.idx, max(coalesce({IOU}, 0.0)) AS best_iou FROM {{left}} a LEFT JOIN {{right}} b USING (image) GROUP BY a.image, a.idx"


@query("j9_max_box_iou", f"WITH {BOXES_SQL} SELECT image, idx, round(best_iou, 6) AS best_iou FROM ({BEST.format(left='det', right='gt')})")
def j9(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.best_overlap(det, gt).withColumn("best_iou", F.round("best_iou", 6))


@query("j16_best_prediction_per_gt", f"WITH {BOXES_SQL} SELECT image, idx, round(best_iou, 6) AS best_iou FROM ({BEST.format(left='gt', right='det')})")
def j16(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.best_overlap(gt, det).withColumn("best_iou", F.round("best_iou", 6))


@query("a18_recall_curve", f"WITH {BOXES_SQL}, best AS (SELECT round(best_iou, 6) AS v FROM ({BEST.format(left='gt', right='det')})) SELECT (50 + 5 * k) / 100.0::DOUBLE AS threshold, round(avg(CASE WHEN v >= (50 + 5 * k) / 100.0::DOUBLE THEN 1.0 ELSE 0.0 END), 9) AS recall, count(*) AS n_gt, round(avg(v), 6) AS mean_best_iou FROM best, (SELECT unnest(range(10)) AS k) GROUP BY k")
def a18(spark, sf):
    """The flagship: recall of ground-truth boxes by the best overlapping detection, at ten thresholds."""
    gt, det = gt_and_det(spark, sf)
    best = B.best_overlap(gt, det).select(F.round("best_iou", 6).alias("v"))
    at = best.select("v", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).withColumn("threshold", (50 + 5 * F.col("k")) / F.lit(100.0))
    return at.groupBy("threshold").agg(F.round(F.avg((F.col("v") >= F.col("threshold")).cast("double")), 9).alias("recall"), F.count("*").alias("n_gt"), F.round(F.avg("v"), 6).alias("mean_best_iou"))


@query("j10_label_proposals", f"WITH {BOXES_SQL}, p AS (SELECT a.image, a.idx, coalesce(round({IOU}, 9), 0.0) AS v, b.idx AS g, b.category AS c, row_number() OVER (PARTITION BY a.image, a.idx ORDER BY coalesce(round({IOU}, 9), 0.0) DESC, b.idx) AS rn FROM det a LEFT JOIN gt b USING (image)) SELECT image, idx, CASE WHEN v >= 0.3 THEN g END AS gt_idx, CASE WHEN v >= 0.3 THEN c ELSE 'background' END AS label FROM p WHERE rn = 1")
def j10(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.label_proposals(det, gt, 0.3, "background")


@query("j7_crowded_overlaps", f"WITH {BOXES_SQL}, a AS (SELECT image % 3 AS scene, image * 10 + idx AS id, x0 + image % 1000 * 7 AS x0, y0 + image % 700 * 9 AS y0, x1 + image % 1000 * 7 AS x1, y1 + image % 700 * 9 AS y1, is_gt FROM boxes), g AS (SELECT * FROM a WHERE is_gt), d AS (SELECT * FROM a WHERE NOT is_gt) SELECT a.scene, a.id AS gt_id, count(b.id) AS n, round(coalesce(max({IOU}), 0.0), 6) AS best_iou FROM g a LEFT JOIN d b ON a.scene = b.scene AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.scene, a.id")
def j7_crowded(spark, sf):
    """All boxes moved into three large scenes: for each truth, how many detections overlap it, and the best of them."""
    move = lambda c, n, k: (F.col(c) + F.col("image") % n * k).alias(c)
    scenes = boxes(spark, sf).select((F.col("image") % 3).alias("scene"), (F.col("image") * 10 + F.col("idx")).alias("idx"), move("x0", 1000, 7), move("y0", 700, 9), move("x1", 1000, 7), move("y1", 700, 9), "is_gt")
    return crowded_overlaps(scenes, "is_gt", "scene").select("scene", F.col("idx").alias("gt_id"), "n", F.round("best_iou", 6).alias("best_iou"))


HOLDS = "CASE WHEN b.x0 <= 300 AND 300 < b.x1 AND b.y0 <= 200 AND 200 < b.y1 THEN 1 ELSE 0 END"


@query("j15_pick_proposal", f"WITH {BOXES_SQL}, p AS (SELECT a.image, a.idx, b.idx AS pick, {HOLDS} AS holds, row_number() OVER (PARTITION BY a.image, a.idx ORDER BY {HOLDS} DESC, round({IOU}, 9) DESC, b.idx) AS rn FROM gt a JOIN det b USING (image)) SELECT image, idx, pick, holds FROM p WHERE rn = 1")
def j15(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.pick_proposal(det, gt, F.lit(300.0), F.lit(200.0))


@query("j22_paste_filter", f"WITH {BOXES_SQL} SELECT a.image, a.idx FROM det a LEFT JOIN gt b USING (image) GROUP BY a.image, a.idx HAVING coalesce(max({INTER} / {AREA.format('b')}), 0.0) < 0.5")
def j22(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.paste_filter(det, gt)


@query("j3_detection_driven_gt", f"WITH {BOXES_SQL} SELECT image, idx, category FROM gt WHERE image IN (SELECT image FROM det WHERE score > 0.08)")
def j3(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return gt.join(det.where("score > 0.08").select("image"), "image", "left_semi").select("image", "idx", "category")


@query("j21_unmatched_detections", f"WITH {BOXES_SQL} SELECT image, idx, CASE WHEN v >= 0.3 THEN 1 ELSE -1 END AS track_id FROM (SELECT image, idx, round(best_iou, 6) AS v FROM ({BEST.format(left='det', right='gt')}))")
def j21(spark, sf):
    gt, det = gt_and_det(spark, sf)
    hit = B.best_overlap(det, gt).where(F.round("best_iou", 6) >= 0.3).select("image", "idx", F.lit(1).alias("hit"))
    return det.select("image", "idx").join(hit, ["image", "idx"], "left").select("image", "idx", F.coalesce("hit", F.lit(-1)).alias("track_id"))


@query("f22_box_encodings", f"WITH {BOXES_SQL} SELECT image, idx, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h, x0 + (x1 - x0) AS x1_again, (y0 + y1) / 2 + 0.5 * (y1 - y0) AS y1_again FROM boxes")
def f22(spark, sf):
    b = boxes(spark, sf)
    cx, cy, w, h = B.xyxy_to_cxcywh(*B.corners())
    x, y, ww, hh = B.xyxy_to_xywh(*B.corners())
    return b.select("image", "idx", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), B.xywh_to_xyxy(x, y, ww, hh)[2].alias("x1_again"), B.cxcywh_to_xyxy(cx, cy, w, h)[3].alias("y1_again"))


@query("f7_nonempty_instances", f"WITH {BOXES_SQL} SELECT image, idx, CASE WHEN x1 - x0 > 40 AND y1 - y0 > 10 THEN idx ELSE -1 END AS gt_id FROM boxes WHERE NOT (NOT is_gt AND (x1 - x0 <= 40 OR y1 - y0 <= 10))")
def f7(spark, sf):
    """Empty detections go; empty truths stay with id -1."""
    full = (F.col("x1") - F.col("x0") > 40) & (F.col("y1") - F.col("y0") > 10)
    return boxes(spark, sf).where(F.col("is_gt") | full).select("image", "idx", F.when(full, F.col("idx")).otherwise(-1).alias("gt_id"))


@query("f8_coverage_filter", f"WITH {BOXES_SQL} SELECT a.image, a.idx AS child, b.idx AS parent FROM det a JOIN gt b USING (image) WHERE round({INTER} / {AREA.format('a')}, 9) > 0.9")
def f8(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.overlapping(det, gt).where(F.round(B.coverage(B.corners("l_"), B.corners("r_")), 9) > 0.9).select("image", F.col("l_idx").alias("child"), F.col("r_idx").alias("parent"))


@query("f9_area_iou_gate", f"WITH {BOXES_SQL} SELECT image, idx FROM (SELECT a.image, a.idx, {AREA.format('a')} / 307200.0 AS frac, {IOU} AS v FROM det a JOIN gt b ON a.image = b.image AND a.idx = b.idx + 1) WHERE frac BETWEEN 0.01 AND 0.9 AND round(v, 9) >= 0.1")
def f9(spark, sf):
    gt, det = gt_and_det(spark, sf)
    p = B.pairs(det, gt).where("l_idx = r_idx + 1")
    frac = B.area(B.corners("l_")) / 307200.0
    return p.where(frac.between(0.01, 0.9) & (F.round(B.iou(B.corners("l_"), B.corners("r_")), 9) >= 0.1)).select("image", F.col("l_idx").alias("idx"))


@query("f10_refinement_gate", f"WITH {BOXES_SQL} SELECT image, idx, CASE WHEN ar < 2000 THEN 'skip' WHEN (x1 - x0) * 100 / ar BETWEEN 0.5 AND 2 THEN 'take' ELSE 'reject' END AS verdict FROM (SELECT *, {AREA.format('boxes')} AS ar FROM boxes)")
def f10(spark, sf):
    ar = B.area(B.corners())
    return boxes(spark, sf).select("image", "idx", F.when(ar < 2000, "skip").when(((F.col("x1") - F.col("x0")) * 100 / ar).between(0.5, 2), "take").otherwise("reject").alias("verdict"))


@query("f11_f12_score_filters", f"WITH {BOXES_SQL} SELECT image, idx, score FROM det WHERE score > 0.05 AND 1 - score / 2 >= 0.96")
def f11(spark, sf):
    """Predicted IoU strictly over, stability at least its threshold."""
    return gt_and_det(spark, sf)[1].where((F.col("score") > 0.05) & (1 - F.col("score") / 2 >= 0.96)).select("image", "idx", "score")


CROP = ("160.0", "120.0", "480.0", "360.0"), ("0.0", "0.0", "640.0", "480.0")


@query("f13_crop_edge_filter", f"WITH {BOXES_SQL} SELECT image, idx FROM boxes WHERE NOT (" + " OR ".join(f"(abs({c} - {e}) <= 20 AND NOT abs({c} - {w}) <= 20)" for c, e, w in zip(B.CORNERS, *CROP, strict=True)) + ")")
def f13(spark, sf):
    crop, image = ([float(x) for x in v] for v in CROP)
    return boxes(spark, sf).where(~B.near_crop_edge(B.corners(), crop, image)).select("image", "idx")


@query("f14_finite_scores", f"WITH {BOXES_SQL} SELECT image, idx, score FROM det WHERE isfinite(score) AND isfinite(x0 + y0 + x1 + y1) AND score > 0.07")
def f14(spark, sf):
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    b = gt_and_det(spark, sf)[1]
    return b.where(finite(F.col("score")) & finite(F.col("x0") + F.col("y0") + F.col("x1") + F.col("y1")) & (F.col("score") > 0.07)).select("image", "idx", "score")


@query("f17_confidence_band", f"WITH {BOXES_SQL} SELECT image, idx, score FROM det WHERE 0.03 < score AND score <= 0.06")
def f17(spark, sf):
    return gt_and_det(spark, sf)[1].where((F.col("score") > 0.03) & (F.col("score") <= 0.06)).select("image", "idx", "score")


@query("f23_uncrop_boxes", f"WITH {BOXES_SQL} SELECT image, idx, x0 + 100 AS x0, y0 + 50 AS y0, x1 + 100 AS x1, y1 + 50 AS y1 FROM boxes")
def f23(spark, sf):
    return boxes(spark, sf).select("image", "idx", *((F.col(c) + (100 if k % 2 == 0 else 50)).alias(c) for k, c in enumerate(B.CORNERS)))


@query("f24_context_box", f"WITH {BOXES_SQL} SELECT image, idx, " + ", ".join(f"greatest(0.0, least(({lo} + {hi}) / 2 {s} greatest(({hi} - {lo}) / 2, 32.0) * 1.5, {m})) AS {n}" for lo, hi, s, m, n in (("x0", "x1", "-", "640.0", "cx0"), ("y0", "y1", "-", "480.0", "cy0"), ("x0", "x1", "+", "640.0", "cx1"), ("y0", "y1", "+", "480.0", "cy1"))) + " FROM boxes")
def f24(spark, sf):
    return boxes(spark, sf).select("image", "idx", *(c.alias(n) for c, n in zip(B.context_box(B.corners(), 1.5, 640.0, 480.0), ("cx0", "cy0", "cx1", "cy1"), strict=True)))


MOVES = ", ".join(f"(CAST('0x' || substr(md5(image || '-' || idx || '-{5 + k}'), 1, 8) AS BIGINT) % 2000001 / 1e6 - 1) * 0.1 * ({'x1 - x0' if k % 2 == 0 else 'y1 - y0'}) + {c} AS m{k}" for k, c in enumerate(("x0", "y0", "x1", "y1")))


@query("f25_box_jitter", f"WITH {BOXES_SQL} SELECT image, idx, score, category, is_gt, round(least(m0, m2), 7) AS x0, round(least(m1, m3), 7) AS y0, round(greatest(m0, m2), 7) AS x1, round(greatest(m1, m3), 7) AS y1 FROM (SELECT *, {MOVES} FROM boxes)")
def f25(spark, sf):
    return B.jittered(boxes(spark, sf), ["image", "idx"], 0.1, 5).withColumns({c: F.round(c, 7) for c in ("x0", "y0", "x1", "y1")})


@query("t2_area_descending", f"WITH {BOXES_SQL} SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY {AREA.format('boxes')} DESC, idx) AS place FROM boxes")
def t2(spark, sf):
    return boxes(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy(B.area(B.corners()).desc(), "idx"))).select("image", "idx", "place")


@query("t3_w4_top_k_detections", f"WITH {BOXES_SQL} SELECT image, idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS rank FROM det) WHERE rank <= 2")
def t3(spark, sf):
    return top_per_group(gt_and_det(spark, sf)[1], "image", [F.desc("score"), "idx"], 2).select("image", "idx", "score", "rank")


@query("t4_query_class_top_k", f"WITH {BOXES_SQL}, flat AS (SELECT image, (idx - 1) * 3 + k AS flat, score * (k + 1) AS s FROM det, (SELECT unnest(range(3)) AS k)) SELECT image, CAST(flat // 3 AS BIGINT) AS query, CAST(flat % 3 AS BIGINT) AS class, round(s, 9) AS s FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY s DESC, flat) AS rn FROM flat) WHERE rn <= 3")
def t4(spark, sf):
    det = gt_and_det(spark, sf)[1]
    flat = det.select("image", "idx", "score", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("image", ((F.col("idx") - 1) * 3 + F.col("k")).alias("flat"), (F.col("score") * (F.col("k") + 1)).alias("s"))
    top = top_per_group(flat, "image", [F.desc("s"), "flat"], 3)
    return top.select("image", F.expr("flat div 3").cast("long").alias("query"), (F.col("flat") % 3).cast("long").alias("class"), F.round("s", 9).alias("s"))


@query("t5_proposal_limit", f"WITH {BOXES_SQL} SELECT image, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS rank FROM det) WHERE rank <= 3 GROUP BY image")
def t5(spark, sf):
    return top_per_group(gt_and_det(spark, sf)[1], "image", [F.desc("score"), "idx"], 3).groupBy("image").agg(F.count("*").alias("n"))


@query("drop_loss_weight", f"WITH {BOXES_SQL} SELECT image, idx, CASE WHEN round(best_iou, 6) <= 0.01 THEN 0 ELSE 1 END AS weight FROM ({BEST.format(left='det', right='gt')})")
def drop_loss(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return B.best_overlap(det, gt).select("image", "idx", F.when(F.round("best_iou", 6) <= 0.01, 0).otherwise(1).alias("weight"))


IMAGES_SQL = "images AS (SELECT p_partkey AS image, CAST(200 + p_size * 13 AS INTEGER) AS width, CAST(150 + p_partkey % 97 * 5 AS INTEGER) AS height FROM part)"


def _images(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 13 + 200).cast("int").alias("width"), (F.col("p_partkey") % 97 * 5 + 150).cast("int").alias("height"))


@query("crop_tiling", f"WITH {IMAGES_SQL}, n AS (SELECT *, floor(0.34 * least(width, height) * 2 / side) AS shared FROM images, (SELECT layer, 1 << layer AS side FROM (SELECT unnest(range(3)) AS layer))), c AS (SELECT *, crop % side AS kx, crop // side AS ky, ceil((shared * (side - 1) + width) / side) AS w, ceil((shared * (side - 1) + height) / side) AS h FROM n, (SELECT unnest(range(16)) AS crop) WHERE crop < side * side) SELECT image, CAST(layer AS INTEGER) AS layer, CAST(crop AS INTEGER) AS crop, CAST((w - shared) * kx AS INTEGER) AS x0, CAST((h - shared) * ky AS INTEGER) AS y0, CAST(least((w - shared) * kx + w, width) AS INTEGER) AS x1, CAST(least((h - shared) * ky + h, height) AS INTEGER) AS y1 FROM c")
def crop_tiling(spark, sf):
    """The crops of every image, whose sizes come from the parts, in three layers."""
    return B.tile_boxes(_images(spark, sf), 2, 0.34).select("image", "layer", "crop", "x0", "y0", "x1", "y1")


@query("point_grid", f"WITH {IMAGES_SQL} SELECT image, round((i + 0.5) / 8 * width, 6) AS px, round((j + 0.5) / 8 * height, 6) AS py FROM images, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)")
def point_grid(spark, sf):
    return B.point_grid(_images(spark, sf), 8).select("image", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))
