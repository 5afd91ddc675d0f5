"""Queries that suppress, match and evaluate boxes, and follow clips over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import detection_eval as V
from gridloom.operators import match as M
from gridloom.operators import metrics as E
from gridloom.operators import runs as R
from gridloom.operators import suppress as D
from gridloom.operators import temporal as T
from gridloom.plans.bridge import BOXES_SQL, FRAMES_SQL, PIXELS_SQL, bitmaps, boxes, frames, gt_and_det
from gridloom.plans.q_boxes import BEST, IOU
from gridloom.functions.text import hash_number
from gridloom.plans.registry import query, table
from gridloom.sources.storage import materialized, new_folder
from gridloom.streaming import clips as C


def nms_sql(source: str, order: str, threshold: float, group: str = "image", window: int | None = None) -> str:
    """Suppression by recursion over ranks, carrying the kept ranks."""
    near = f" AND a.rn - b.rn < {window}" if window else ""
    return f"""WITH RECURSIVE {BOXES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM {source})),
hit AS (SELECT {', '.join('a.' + g.strip() for g in group.split(','))}, a.rn, list(b.rn) AS bad FROM ranked a JOIN ranked b ON {' AND '.join(f'a.{g.strip()} = b.{g.strip()}' for g in group.split(','))} AND b.rn < a.rn{near} AND round({IOU}, 9) > {threshold} GROUP BY ALL),
step AS (SELECT {group}, rn, [rn] AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT {', '.join('s.' + g.strip() for g in group.split(','))}, r.rn, CASE WHEN h.bad IS NOT NULL AND list_has_any(h.bad, s.kept) THEN s.kept ELSE list_append(s.kept, r.rn) END
  FROM step s JOIN ranked r ON {' AND '.join(f'r.{g.strip()} = s.{g.strip()}' for g in group.split(','))} AND r.rn = s.rn + 1 LEFT JOIN hit h ON {' AND '.join(f'h.{g.strip()} = s.{g.strip()}' for g in group.split(','))} AND h.rn = s.rn + 1),
last AS (SELECT {group}, arg_max(kept, rn) AS kept FROM step GROUP BY {group})
SELECT r.image, r.idx FROM ranked r JOIN last l ON {' AND '.join(f'r.{g.strip()} = l.{g.strip()}' for g in group.split(','))} WHERE list_contains(l.kept, r.rn)"""


@query("d1_windowed_area_nms", nms_sql("boxes", "area DESC, idx", 0.1, window=5))
def d1(spark, sf):
    return D.windowed_area_nms(boxes(spark, sf), 0.1, 5).select("image", "idx")


@query("d2_full_area_dedup", nms_sql("boxes", "area DESC, idx", 0.1))
def d2(spark, sf):
    return D.full_area_dedup(boxes(spark, sf), 0.1).select("image", "idx")


@query("d3_score_nms_per_class", nms_sql("boxes", "score DESC, idx", 0.1, "image, category"))
def d3(spark, sf):
    return D.score_nms(boxes(spark, sf), 0.1).select("image", "idx")


@query("d4_nms_after_cleanup", nms_sql("(SELECT *, idx % 3 = 0 AS changed FROM boxes)", "changed, idx", 0.1))
def d4(spark, sf):
    return D.nms_after_cleanup(boxes(spark, sf).withColumn("changed", F.col("idx") % 3 == 0), "changed", 0.1).select("image", "idx")


def nms_or_last_sql(least_score: float, threshold: float) -> str:
    """Suppression by falling score among those of at least ``least_score``; an image without any keeps its last row."""
    some = nms_sql(f"(SELECT * FROM boxes WHERE score >= {least_score})", "score DESC, idx", threshold)
    return f"SELECT image, idx FROM ({some}) UNION ALL (WITH {BOXES_SQL} SELECT image, idx FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score, idx DESC) AS last, max(score) OVER (PARTITION BY image) AS top FROM boxes) WHERE last = 1 AND top < {least_score})"


@query("d5_candidate_dedup", nms_or_last_sql(0.03, 0.3))
def d5(spark, sf):
    return D.candidate_dedup(boxes(spark, sf), 0.03, 0.3).select("image", "idx")


@query("d6_stop_on_repeat", f"WITH {BOXES_SQL}, bad AS (SELECT a.image, min(a.idx) AS stop FROM boxes a JOIN boxes b ON a.image = b.image AND b.idx < a.idx WHERE round({IOU}, 9) > 0.2 GROUP BY a.image) SELECT boxes.image, idx FROM boxes LEFT JOIN bad USING (image) WHERE stop IS NULL OR idx < stop")
def d6(spark, sf):
    return D.until_repeat(boxes(spark, sf), 0.2).select("image", "idx")


def greedy_sql(pairs: str, group: str) -> str:
    """kept (group, rn) of ``pairs`` (group, d, g, iou): by falling IoU, then d, g, those whose ends are both free, by recursion over the ranks."""
    return f"""pairs AS ({pairs}), ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY iou DESC, d, g) AS rn FROM pairs),
walk AS (SELECT {group}, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ds, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS kept FROM ranked WHERE rn = 1
  UNION ALL SELECT {group}, r.rn, CASE WHEN free THEN list_append(ds, d) ELSE ds END, CASE WHEN free THEN list_append(gs, g) ELSE gs END, CASE WHEN free THEN list_append(kept, r.rn) ELSE kept END
  FROM (SELECT r.*, w.ds, w.gs, w.kept, NOT list_contains(w.ds, r.d) AND NOT list_contains(w.gs, r.g) AS free FROM walk w JOIN ranked r ON {' AND '.join(f'r.{c.strip()} = w.{c.strip()}' for c in group.split(','))} AND r.rn = w.rn + 1) r),
ends AS (SELECT {group}, arg_max(kept, rn) AS kept FROM walk GROUP BY {group})"""


@query("j11_greedy_match", f"WITH RECURSIVE {BOXES_SQL}, {greedy_sql(f'SELECT a.image, CAST(a.idx AS BIGINT) AS d, CAST(b.idx AS BIGINT) AS g, round({IOU}, 9) AS iou FROM det a JOIN gt b ON a.image = b.image WHERE round({IOU}, 9) >= 0.05', 'image')} SELECT image, d AS idx, g AS gt_idx, iou FROM ranked JOIN ends USING (image) WHERE list_contains(kept, rn)")
def j11(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return M.greedy_match(det, gt, 0.05)


@query("j13_a25_cover_match_recall", f"WITH RECURSIVE {BOXES_SQL}, {greedy_sql(f'SELECT a.image, CAST(a.idx AS BIGINT) AS d, CAST(b.idx AS BIGINT) AS g, round({IOU}, 9) AS iou FROM det a JOIN gt b ON a.image = b.image', 'image')}, got AS (SELECT iou FROM ranked JOIN ends USING (image) WHERE list_contains(kept, rn)), n AS (SELECT count(*) AS n FROM gt WHERE image IN (SELECT image FROM det)) SELECT (50 + 5 * k) / 100.0::DOUBLE AS threshold, sum(CASE WHEN iou >= (50 + 5 * k) / 100.0::DOUBLE THEN 1 ELSE 0 END) / CAST(any_value(n.n) AS DOUBLE) AS recall FROM got, n, (SELECT unnest(range(10)) AS k) GROUP BY k")
def j13(spark, sf):
    """Recall of box proposals at ten thresholds, over images with proposals."""
    gt, det = gt_and_det(spark, sf)
    got = M.cover_match(det, gt)
    n = gt.join(det.select("image").distinct(), "image", "left_semi").agg(F.count("*").alias("n"))
    at = got.select("iou", F.explode(F.array(*(F.lit((50 + 5 * k) / 100.0) for k in range(10)))).alias("threshold"))
    hits = at.groupBy("threshold").agg(F.sum((F.col("iou") >= F.col("threshold")).cast("long")).alias("hits"))
    return hits.join(F.broadcast(n), how="cross").select("threshold", (F.col("hits") / F.col("n")).alias("recall"))


@query("j14_optimal_assignment")
def j14(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return M.optimal_match(det, gt)


@query("j14_mask_assignment")
def j14_masks(spark, sf):
    """Embeddings as predicted mask logits of groups of eight, against three rule-made masks a group."""
    e = table(spark, sf, "embeddings")
    group = F.expr("vec_id div 8")
    pred = e.select(group.alias("image"), (F.col("vec_id") % 8).alias("idx"), (F.col("label") / 10.0).alias("score"), F.col("embedding").alias("points"))
    truth = e.where("vec_id % 8 < 3").select(group.alias("image"), (F.col("vec_id") % 8).alias("idx"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: ((i + F.col("vec_id")) % 3 == 0).cast("double")).alias("points"))
    return M.optimal_mask_match(pred, truth)


def _truth_and_det(spark, sf):
    gt, det = gt_and_det(spark, sf)
    return det, gt.withColumn("iscrowd", F.col("idx") % 5 == 0)


def match_sql(det: str, truth: str, thresholds: str, areas: str = "(VALUES ('all', 0.0, 1e10))", group: str = "image", most: int = 100) -> str:
    """matched (group, idx, score, rank, area, threshold, gt_idx, ignored): each detection in turn takes the first truth of its list that is free.

    ``det``: group, idx, score, corners; ``truth``: group, idx, crowd, corners. A list has truths that count first, then by
    falling IoU, then the later one.
    """
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in group.split(","))
    keys = ", ".join(c.strip() for c in group.split(","))
    of_a = ", ".join(f"a.{c.strip()}" for c in group.split(","))
    outside = lambda t: f"(({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0) < area.lo OR ({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0) > area.hi)"
    return f"""grid AS (SELECT * FROM (SELECT CAST(unnest({thresholds}) AS DOUBLE) AS threshold), {areas} AS area(name, lo, hi)),
turn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, idx) - 1 AS rank FROM ({det})) WHERE rank < {most}),
offers AS (SELECT {of_a}, a.rank, area.name AS area, area.threshold, list({{'g': CAST(b.idx AS BIGINT), 'crowd': b.crowd, 'skip': b.crowd OR {outside('b')}}} ORDER BY (b.crowd OR {outside('b')}), round({IOU}, 9) DESC, b.idx DESC) AS cands
  FROM turn a JOIN ({truth}) b ON {on} JOIN grid area ON round({IOU}, 9) >= least(area.threshold, 1 - 1e-10) GROUP BY ALL),
asked AS (SELECT a.*, area.name AS area, area.threshold, {outside('a')} AS outside, o.cands FROM turn a JOIN grid area ON true LEFT JOIN offers o ON {on.replace('b.', 'o.')} AND o.rank = a.rank AND o.area = area.name AND o.threshold = area.threshold),
walk AS (SELECT {keys}, area, threshold, CAST(-1 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS taken, NULL::STRUCT(g BIGINT, crowd BOOLEAN, skip BOOLEAN) AS pick FROM asked WHERE rank = 0
  UNION ALL SELECT {keys}, area, threshold, rank, CASE WHEN pick IS NOT NULL AND NOT pick.crowd THEN list_append(taken, pick.g) ELSE taken END, pick
  FROM (SELECT a.*, w.taken, list_filter(a.cands, lambda c: c.crowd OR NOT list_contains(w.taken, c.g))[1] AS pick FROM walk w JOIN asked a ON {on.replace('b.', 'w.')} AND a.area = w.area AND a.threshold = w.threshold AND a.rank = w.rank + 1)),
matched AS (SELECT {of_a}, CAST(a.idx AS BIGINT) AS idx, a.score, a.rank, a.area, a.threshold, coalesce(w.pick.g, -1) AS gt_idx, CASE WHEN w.pick IS NULL THEN a.outside ELSE w.pick.skip END AS ignored
  FROM asked a JOIN walk w ON {on.replace('b.', 'w.')} AND a.area = w.area AND a.threshold = w.threshold AND a.rank = w.rank)"""


def ap_sql(matched: str, n_truth: str, by: str) -> str:
    """ap (by, ap) from ``matched`` and truths (by, n): the mean of the precision envelope at 101 recalls."""
    return f"""ranked AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN gt_idx >= 0 THEN 1 ELSE 0 END) OVER w AS tp FROM {matched} WHERE NOT ignored WINDOW w AS (PARTITION BY {by} ORDER BY score DESC, image, idx ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT {by}, tp / CAST(n AS DOUBLE) AS recall, max(tp / CAST(place AS DOUBLE)) OVER (PARTITION BY {by} ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM ranked {n_truth}),
ap AS (SELECT {by}, avg(p) AS ap FROM (SELECT {by}, k, coalesce(max(CASE WHEN recall + 1e-8 >= k / 100.0::DOUBLE THEN envelope END), 0.0) AS p FROM curve, (SELECT unnest(range(101)) AS k) GROUP BY {by}, k) GROUP BY {by})"""


TRUTH = "SELECT image, idx, idx % 5 = 0 AS crowd, x0, y0, x1, y1 FROM gt"


@query("j12_coco_matches", f"WITH RECURSIVE {BOXES_SQL}, {match_sql('SELECT image, idx, score, x0, y0, x1, y1 FROM det', TRUTH, '[0.3, 0.5]')} SELECT image, idx, score, threshold, gt_idx, ignored FROM matched")
def j12(spark, sf):
    return M.match_detections(*_truth_and_det(spark, sf), [0.3, 0.5])


N_SQL = "CROSS JOIN (SELECT count(*) AS n FROM gt WHERE idx % 5 <> 0)"


@query("w1_w2_w3_a22_average_precision", f"WITH RECURSIVE {BOXES_SQL}, {match_sql('SELECT image, idx, score, x0, y0, x1, y1 FROM det', TRUTH, '[0.1, 0.3, 0.5]')}, {ap_sql('matched', N_SQL, 'threshold')} SELECT threshold, round(ap, 6) AS ap FROM ap")
def a22(spark, sf):
    return V.precision_by_threshold(*_truth_and_det(spark, sf), [0.1, 0.3, 0.5]).withColumn("ap", F.round("ap", 6))


@query("a23_a24_summary", f"WITH RECURSIVE {BOXES_SQL}, {match_sql('SELECT image, idx, score, x0, y0, x1, y1 FROM det', TRUTH, '[0.1, 0.2, 0.3, 0.4, 0.5]')}, {ap_sql('matched', N_SQL, 'threshold')} SELECT round(avg(ap) * 100, 4) AS ap, round(avg(ap) FILTER (threshold = 0.3) * 100, 4) AS ap30, round(avg(ap) FILTER (threshold = 0.5) * 100, 4) AS ap50 FROM ap")
def a23(spark, sf):
    """Mean AP over thresholds, percent, with -1 for none."""
    ap = V.precision_by_threshold(*_truth_and_det(spark, sf), [0.1, 0.2, 0.3, 0.4, 0.5])
    one = lambda t: E.mean_over_valid(F.when(F.round("threshold", 2) == t, F.col("ap")))
    return ap.agg(F.round(E.mean_over_valid(F.col("ap")) * 100, 4).alias("ap"), F.round(one(0.3) * 100, 4).alias("ap30"), F.round(one(0.5) * 100, 4).alias("ap50"))


# Detections near the boxes that they are made from, so that all thresholds tell them apart.
NEAR_SQL = "SELECT image, category, idx, score, x0 + (x1 - x0) * ((idx * 7 + image) % 6) / 12.0::DOUBLE AS x0, y0, x1 + (x1 - x0) * ((idx * 7 + image) % 6) / 12.0::DOUBLE AS x1, y1 FROM boxes"
TRUTH_BY_CLASS = "SELECT image, category, idx, idx % 5 = 0 AS crowd, x0, y0, x1, y1 FROM boxes"
AREA_ROWS = ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in V.AREAS.items())


def _near(spark, sf):
    b = boxes(spark, sf)
    shift = (F.col("x1") - F.col("x0")) * ((F.col("idx") * 7 + F.col("image")) % 6) / 12.0
    return b.withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + shift}), b.withColumn("iscrowd", F.col("idx") % 5 == 0)


@query(
    "a22_a23_twelve_statistics",
    f"""WITH RECURSIVE {BOXES_SQL}, {match_sql(NEAR_SQL, TRUTH_BY_CLASS, str(V.THRESHOLDS), f'(VALUES {AREA_ROWS})', 'image, category')},
n AS (SELECT category, area.name AS area, count(*) AS n FROM ({TRUTH_BY_CLASS}) b, (VALUES {AREA_ROWS}) AS area(name, lo, hi) WHERE NOT crowd AND (x1 - x0) * (y1 - y0) BETWEEN area.lo AND area.hi GROUP BY ALL),
{ap_sql('matched', 'JOIN n USING (category, area)', 'category, area, threshold')},
cells AS (SELECT n.*, CAST(threshold AS DOUBLE) AS threshold FROM n, (SELECT unnest({V.THRESHOLDS}) AS threshold)),
p AS (SELECT category, area, threshold, coalesce(ap, 0.0) AS ap FROM cells LEFT JOIN ap USING (category, area, threshold)),
r AS (SELECT c.category, c.area, c.threshold, k AS most, count(m.idx) FILTER (m.rank < k) / CAST(any_value(c.n) AS DOUBLE) AS recall FROM (SELECT * FROM cells, (SELECT unnest([1, 10, 100]) AS k)) c LEFT JOIN (SELECT * FROM matched WHERE gt_idx >= 0 AND NOT ignored) m ON m.category = c.category AND m.area = c.area AND m.threshold = c.threshold GROUP BY ALL)
SELECT statistic, round(coalesce(v, -1), 6) AS value FROM (
SELECT 'ap' AS statistic, avg(ap) AS v FROM p WHERE area = 'all' UNION ALL SELECT 'ap50', avg(ap) FROM p WHERE area = 'all' AND threshold = 0.5 UNION ALL SELECT 'ap75', avg(ap) FROM p WHERE area = 'all' AND threshold = 0.75
UNION ALL SELECT 'ap_' || s, (SELECT avg(ap) FROM p WHERE area = s) FROM (SELECT unnest(['small', 'medium', 'large']) AS s)
UNION ALL SELECT 'ar_' || k, (SELECT avg(recall) FROM r WHERE area = 'all' AND most = k) FROM (SELECT unnest([1, 10, 100]) AS k)
UNION ALL SELECT 'ar_' || s, (SELECT avg(recall) FROM r WHERE area = s AND most = 100) FROM (SELECT unnest(['small', 'medium', 'large']) AS s))""",
)
def twelve(spark, sf):
    """All twelve statistics over categories, sizes, thresholds and detections an image."""
    return V.evaluate(*_near(spark, sf)).withColumn("value", F.round("value", 6))


PROPOSAL_ROWS = ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in V.PROPOSAL_AREAS.items())
PROPOSAL_PAIRS = f"SELECT a.image, area.name AS area, lim.most, CAST(a.idx AS BIGINT) AS d, CAST(b.idx AS BIGINT) AS g, round({IOU}, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS r FROM near) a JOIN ({TRUTH}) b ON a.image = b.image AND NOT b.crowd JOIN (VALUES {PROPOSAL_ROWS}) AS area(name, lo, hi) ON (b.x1 - b.x0) * (b.y1 - b.y0) BETWEEN area.lo AND area.hi JOIN (SELECT unnest([2, 1000]) AS most) lim ON a.r <= lim.most"


@query("a25_proposal_recall", f"WITH RECURSIVE {BOXES_SQL}, near AS ({NEAR_SQL}), {greedy_sql(PROPOSAL_PAIRS, 'image, area, most')}, got AS (SELECT area, most, iou FROM ranked JOIN ends USING (image, area, most) WHERE list_contains(kept, rn)), t AS (SELECT CAST(unnest({V.THRESHOLDS}) AS DOUBLE) AS threshold), n AS (SELECT area.name AS area, count(image) AS n FROM (VALUES {PROPOSAL_ROWS}) AS area(name, lo, hi) LEFT JOIN ({TRUTH}) b ON NOT b.crowd AND (b.x1 - b.x0) * (b.y1 - b.y0) BETWEEN area.lo AND area.hi GROUP BY ALL) SELECT area, CAST(lim.most AS BIGINT) AS most, threshold, CASE WHEN n.n > 0 THEN (SELECT count(*) FROM got WHERE got.area = n.area AND got.most = lim.most AND got.iou >= t.threshold) / CAST(n.n AS DOUBLE) ELSE -1.0 END AS recall FROM n, t, (SELECT unnest([2, 1000]) AS most) lim")
def a25(spark, sf):
    """Recall of proposals over eight object sizes, with the first two and the first thousand of an image."""
    near, truth = _near(spark, sf)
    return V.proposal_recall(near, truth.where("is_gt"), limits=(2, 1000))


# The chain of cumulative counts, envelope and interpolation, on ranked rows that SQL has too.
CURVE_SQL = """
m AS (SELECT event_type AS class, event_id AS image, 0 AS idx, value AS score, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS gt_idx FROM events),
c AS (SELECT class, row_number() OVER w AS place, sum(CASE WHEN gt_idx >= 0 THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN gt_idx < 0 THEN 1 ELSE 0 END) OVER w AS fp FROM m WINDOW w AS (PARTITION BY class ORDER BY score DESC, image, idx ROWS UNBOUNDED PRECEDING)),
n AS (SELECT class, count(*) AS n FROM m WHERE gt_idx >= 0 GROUP BY class),
pr AS (SELECT class, place, tp, fp, tp / CAST(n AS DOUBLE) AS recall, max(tp / CAST(tp + fp AS DOUBLE)) OVER (PARTITION BY class ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM c JOIN n USING (class))"""


def _curve(spark, sf):
    e = table(spark, sf, "events")
    m = e.select(F.col("event_type").alias("class"), F.col("event_id").alias("image"), F.lit(0).alias("idx"), F.col("value").alias("score"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(-1).alias("gt_idx"), F.lit(False).alias("ignored"))
    return m, m.where("gt_idx >= 0").groupBy("class").agg(F.count("*").alias("n"))


@query("w1_cumulative_tp_fp", f"WITH {CURVE_SQL} SELECT class, place, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def w1(spark, sf):
    return E.cumulative(_curve(spark, sf)[0], ["class"]).select("class", F.col("place").cast("long").alias("place"), "tp", "fp")


@query("w2_precision_envelope", f"WITH {CURVE_SQL} SELECT class, place, round(recall, 6) AS recall, round(envelope, 6) AS envelope FROM pr")
def w2(spark, sf):
    m, n = _curve(spark, sf)
    return E.precision_recall(m, n, ["class"]).select("class", F.col("place").cast("long").alias("place"), F.round("recall", 6).alias("recall"), F.round("envelope", 6).alias("envelope"))


@query("w3_interpolated_precision", f"WITH {CURVE_SQL} SELECT class, CAST(k AS INTEGER) AS point, round(coalesce(max(CASE WHEN recall + 1e-8 >= k / 100.0::DOUBLE THEN envelope END), 0.0), 6) AS precision FROM pr, (SELECT unnest(range(101)) AS k) GROUP BY class, k")
def w3(spark, sf):
    m, n = _curve(spark, sf)
    return E.interpolated(E.precision_recall(m, n, ["class"]), ["class"]).withColumn("precision", F.round("precision", 6))


@query("a24_per_category_ap", f"WITH {CURVE_SQL}, g AS (SELECT class, k, coalesce(max(CASE WHEN recall + 1e-8 >= k / 100.0::DOUBLE THEN envelope END), 0.0) AS p FROM pr, (SELECT unnest(range(101)) AS k) GROUP BY class, k) SELECT class, round(avg(p) * 100, 4) AS ap FROM g GROUP BY class")
def a24(spark, sf):
    m, n = _curve(spark, sf)
    return E.average_precision(m, n, ["class"]).select("class", F.round(F.col("ap") * 100, 4).alias("ap"))


@query("a16_sequence_iou", f"WITH {BOXES_SQL}, d AS (SELECT image % 50 AS clip, image // 50 AS frame, idx % 3 AS track, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM det GROUP BY ALL), g AS (SELECT image % 50 AS clip, image // 50 AS frame, idx % 3 AS track, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM gt GROUP BY ALL), i AS (SELECT a.clip, a.track AS l, b.track AS r, sum(greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS inter FROM d a JOIN g b USING (clip, frame) GROUP BY ALL), da AS (SELECT clip, track, sum((x1 - x0) * (y1 - y0)) AS s FROM d GROUP BY ALL), ga AS (SELECT clip, track, sum((x1 - x0) * (y1 - y0)) AS s FROM g GROUP BY ALL) SELECT i.clip, l AS l_track, r AS r_track, round(inter / (da.s + ga.s - inter), 6) AS iou FROM i JOIN da ON da.clip = i.clip AND da.track = l JOIN ga ON ga.clip = i.clip AND ga.track = r")
def a16(spark, sf):
    gt, det = gt_and_det(spark, sf)
    hull = lambda df: df.groupBy((F.col("image") % 50).alias("clip"), F.expr("image div 50").alias("frame"), (F.col("idx") % 3).alias("track")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return E.sequence_iou(hull(det), hull(gt)).withColumn("iou", F.round("iou", 6))


@query("a17_keypoint_similarity", "WITH p AS (SELECT l_orderkey AS obj, l_linenumber % 3 AS visible, (l_partkey % 20 - 10)::DOUBLE AS dx, (l_suppkey % 20 - 10)::DOUBLE AS dy, 0.05 * (1 + l_linenumber % 2) AS sigma, 5000.0 + l_quantity AS area FROM lineitem), e AS (SELECT obj, visible, exp(-(dx*dx + dy*dy) / (2 * sigma * sigma * area + 1e-12)) AS v FROM p) SELECT obj, round(coalesce(avg(v) FILTER (visible > 0), avg(v)), 6) AS oks FROM e GROUP BY obj")
def a17(spark, sf):
    li = table(spark, sf, "lineitem")
    p = li.select(F.col("l_orderkey").alias("obj"), (F.col("l_linenumber") % 3).alias("visible"), (F.col("l_partkey") % 20 - 10).cast("double").alias("dx"), (F.col("l_suppkey") % 20 - 10).cast("double").alias("dy"), (0.05 * (1 + F.col("l_linenumber") % 2)).alias("sigma"), (5000.0 + F.col("l_quantity")).alias("area"))
    return E.keypoint_similarity(p, ["obj"]).withColumn("oks", F.round("oks", 6))


@query("a17_keypoint_similarity_in_box", "WITH p AS (SELECT l_orderkey AS obj, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber % 3 END AS visible, (l_partkey % 200)::DOUBLE AS px, (l_suppkey % 200)::DOUBLE AS py, (l_partkey % 200 + l_linenumber)::DOUBLE AS x, (l_suppkey % 200 + 5)::DOUBLE AS y, 60.0 AS bx, 70.0 AS b_y, 40.0 AS bw, 30.0 AS bh, 0.05 * (1 + l_linenumber % 2) AS sigma, 5000.0 + l_quantity AS area FROM lineitem), e AS (SELECT obj, visible, exp(-((px - x)**2 + (py - y)**2) / (2 * (2 * sigma)**2 * (area + 1e-12))) AS own, exp(-((greatest(0, bx - bw - px) + greatest(0, px - (bx + 2 * bw)))**2 + (greatest(0, b_y - bh - py) + greatest(0, py - (b_y + 2 * bh)))**2) / (2 * (2 * sigma)**2 * (area + 1e-12))) AS box FROM p) SELECT obj, round(coalesce(avg(own) FILTER (visible > 0), avg(box)), 6) AS oks FROM e GROUP BY obj")
def a17_box(spark, sf):
    """Objects without a visible point are judged by the distance to their box doubled."""
    c, li = F.col, table(spark, sf, "lineitem")
    px, py = (c("l_partkey") % 200).cast("double"), (c("l_suppkey") % 200).cast("double")
    seen = F.when(c("l_orderkey") % 3 == 0, 0).otherwise(c("l_linenumber") % 3)
    box = {"bx": 60.0, "by": 70.0, "bw": 40.0, "bh": 30.0}
    p = li.select(c("l_orderkey").alias("obj"), seen.alias("visible"), px.alias("px"), py.alias("py"), (px + c("l_linenumber")).alias("x"), (py + 5).alias("y"), *(F.lit(v).alias(k) for k, v in box.items()), (0.05 * (1 + c("l_linenumber") % 2)).alias("sigma"), (5000.0 + c("l_quantity")).alias("area"))
    return E.keypoint_similarity_in_box(p, ["obj"]).withColumn("oks", F.round("oks", 6))


@query("a29_present_and_absent_objects", f"WITH {FRAMES_SQL} SELECT count(*) FILTER (event_id % 3 <> 0) AS n_present, round(avg(score) FILTER (event_id % 3 <> 0), 6) AS iou_present, count(*) FILTER (event_id % 3 = 0) AS n_absent, round(avg(CASE WHEN (event_id % 50) / 1000.0::DOUBLE < 0.01 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 3 = 0), 6) AS empty_absent FROM frames")
def a29(spark, sf):
    f = frames(spark, sf).select(F.col("score").alias("iou"), (F.col("event_id") % 3 != 0).alias("present"), (F.col("event_id") % 50 / 1000.0).alias("predicted"))
    return E.present_absent(f).withColumns({c: F.round(c, 6) for c in ("iou_present", "empty_absent")})


@query("a19_macro_average", f"WITH {BOXES_SQL}, v AS (SELECT image, round(best_iou, 6) AS v FROM ({BEST.format(left='gt', right='det')})) SELECT round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM (SELECT image, avg(v) AS m, sum(v) AS s, count(*) AS n FROM v GROUP BY image)")
def a19(spark, sf):
    from gridloom.operators.boxes import best_overlap

    gt, det = gt_and_det(spark, sf)
    v = best_overlap(gt, det).select("image", F.round("best_iou", 6).alias("v"))
    return v.groupBy("image").agg(F.avg("v").alias("m"), F.sum("v").alias("s"), F.count("*").alias("n")).agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"))


@query("a20_t9_best_and_worst_clips", f"WITH {FRAMES_SQL}, c AS (SELECT clip, round(avg(score), 9) AS mean, round(median(score), 6) AS median FROM frames GROUP BY clip) SELECT clip, round(mean, 6) AS mean, median, 'best' AS side FROM (SELECT * FROM c ORDER BY mean DESC, clip LIMIT 5) UNION ALL SELECT clip, round(mean, 6), median, 'worst' FROM (SELECT * FROM c ORDER BY mean, clip LIMIT 5)")
def a20(spark, sf):
    c = frames(spark, sf).groupBy("clip").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.percentile("score", F.lit(0.5)), 6).alias("median"))
    side = lambda order, name: c.orderBy(*order).limit(5).select("clip", F.round("mean", 6).alias("mean"), "median", F.lit(name).alias("side"))
    return side([F.desc("mean"), "clip"], "best").unionByName(side(["mean", "clip"], "worst"))


@query("a21_miou_by_offset", f"WITH {FRAMES_SQL} SELECT frame AS frame_offset, round(avg(CASE WHEN event_id % 2 = 0 THEN score END), 6) AS chained, round(avg(CASE WHEN event_id % 2 = 1 THEN score END), 6) AS direct FROM frames WHERE frame IN (1, 5, 10, 20, 30) GROUP BY frame")
def a21(spark, sf):
    f = frames(spark, sf).where(F.col("frame").isin(1, 5, 10, 20, 30)).withColumn("method", F.when(F.col("event_id") % 2 == 0, "chained").otherwise("direct"))
    p = f.groupBy(F.col("frame").alias("frame_offset")).pivot("method", ["chained", "direct"]).agg(F.avg("score"))
    return p.select("frame_offset", F.round("chained", 6).alias("chained"), F.round("direct", 6).alias("direct"))


CLICKS = FRAMES_SQL + ", clicks AS (SELECT clip AS sample, frame AS click, score AS iou FROM frames WHERE frame < 20)"


def _clicks(spark, sf):
    return frames(spark, sf).where("frame < 20").select(F.col("clip").alias("sample"), F.col("frame").alias("click"), F.col("score").alias("iou"))


@query("a26_clicks_to_threshold", f"WITH {CLICKS}, t AS (SELECT unnest([0.5, 0.8, 0.85, 0.9])::DOUBLE AS threshold), f AS (SELECT sample, threshold, min(CASE WHEN iou >= threshold THEN click + 1 END) AS k FROM clicks, t GROUP BY ALL) SELECT threshold, round(avg(coalesce(k, 20)), 6) AS clicks, count(*) FILTER (k IS NULL) AS never FROM f GROUP BY threshold")
def a26(spark, sf):
    return E.clicks_to_threshold(_clicks(spark, sf), [0.5, 0.8, 0.85, 0.9]).withColumn("clicks", F.round("clicks", 6))


@query("a27_iou_at_click", f"WITH {CLICKS} SELECT round(avg(iou), 6) AS iou FROM clicks WHERE click = 2")
def a27(spark, sf):
    return _clicks(spark, sf).where("click = 2").agg(F.round(F.avg("iou"), 6).alias("iou"))


@query("a28_max_and_oracle", "SELECT l_orderkey AS sample, arg_max(l_tax, (l_discount, -l_linenumber, l_tax)) AS max_iou, max(l_tax) AS oracle FROM lineitem GROUP BY l_orderkey")
def a28(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("token"), F.col("l_discount").alias("pred"), F.col("l_tax").alias("iou"))
    return E.max_and_oracle(c, "sample")


@query("a30_best_of_candidates", "SELECT l_orderkey AS sample, arg_min(l_discount, (l_extendedprice, l_linenumber, l_discount)) AS iou FROM lineitem GROUP BY l_orderkey")
def a30(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("sample")).agg(F.min(F.struct("l_extendedprice", "l_linenumber", "l_discount")).alias("m")).select("sample", F.col("m.l_discount").alias("iou"))


@query("a33_running_average", f"WITH {FRAMES_SQL} SELECT clip, frame, round(sum(score * (1 + frame % 3)) OVER w / sum(1 + frame % 3) OVER w, 12) AS average FROM frames WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)")
def a33(spark, sf):
    w = Window.partitionBy("clip").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    n = 1 + F.col("frame") % 3
    return frames(spark, sf).select("clip", "frame", F.round(F.sum(F.col("score") * n).over(w) / F.sum(n).over(w), 12).alias("average"))


@query("a33_decayed_average", f"WITH {FRAMES_SQL}, z AS (SELECT clip, frame, score, max(frame) OVER (PARTITION BY clip) AS top FROM frames) SELECT clip, round(sum(score * exp(-(top - frame) / 10.0::DOUBLE)) / sum(exp(-(top - frame) / 10.0::DOUBLE)), 6) AS average FROM z GROUP BY clip")
def a33_decayed(spark, sf):
    packed = frames(spark, sf).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "score"))).alias("v"))
    return packed.select("clip", F.round(E.decayed_average(F.transform("v", lambda s: s["score"]), 10.0), 6).alias("average"))


@query("a34_classification_rates", "SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0 END) FILTER (t <> 'N'), 6) AS fg_accuracy, round(avg(CASE WHEN p = 'N' THEN 1.0 ELSE 0 END) FILTER (t <> 'N'), 6) AS false_negative FROM (SELECT l_returnflag AS t, CASE WHEN l_partkey % 4 = 0 THEN 'N' WHEN l_partkey % 4 = 1 THEN 'A' ELSE l_returnflag END AS p FROM lineitem)")
def a34(spark, sf):
    p = F.when(F.col("l_partkey") % 4 == 0, "N").when(F.col("l_partkey") % 4 == 1, "A").otherwise(F.col("l_returnflag"))
    r = E.classification_rates(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("t"), p.alias("p")), "t", "p", "N")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("a38_entropy", f"WITH {FRAMES_SQL}, p AS (SELECT clip, score / sum(score) OVER (PARTITION BY clip) AS p FROM frames) SELECT clip, round(sum(-p * ln(greatest(p, 1e-12))), 6) AS entropy FROM p GROUP BY clip")
def a38(spark, sf):
    p = frames(spark, sf).select("clip", (F.col("score") / F.sum("score").over(Window.partitionBy("clip"))).alias("p"))
    return p.groupBy("clip").agg(F.round(F.sum(-F.col("p") * F.log(F.greatest("p", F.lit(1e-12)))), 6).alias("entropy"))


LENGTHS = FRAMES_SQL + ", lengths AS (SELECT clip, count(*) AS n FROM frames GROUP BY clip)"


def _lengths(spark, sf):
    return frames(spark, sf).groupBy("clip").agg(F.count("*").alias("n"))


@query("v1_clip_windows", f"WITH {LENGTHS}, s AS (SELECT clip, k AS win, 13 * k AS start FROM lengths, (SELECT unnest(range(100)) AS k) WHERE 13 * k + 13 <= n) SELECT clip, CAST(win AS INTEGER) AS win, CAST(p AS INTEGER) AS pos, CAST(start + 3 * p AS INTEGER) AS frame FROM s, (SELECT unnest(range(5)) AS p)")
def v1(spark, sf):
    return T.clip_windows(_lengths(spark, sf), 5, 3).withColumnRenamed("window", "win")


@query("w9_hops", f"WITH {LENGTHS} SELECT clip, CAST(7 * k AS INTEGER) AS src, CAST(least(7 * k + 7, n - 1) AS INTEGER) AS dst FROM lengths, (SELECT unnest(range(200)) AS k) WHERE 7 * k <= n - 2")
def w9(spark, sf):
    return T.hops(_lengths(spark, sf), 7)


@query("w9_turn_lag", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def w9_lag(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"))


@query("w10_full_tracks", "WITH e AS (SELECT user_id AS win, event_type AS track, event_id % 4 AS frame FROM events WHERE value > 60), f AS (SELECT win, count(DISTINCT frame) AS n FROM e GROUP BY win), s AS (SELECT win, track FROM e JOIN f USING (win) GROUP BY win, track, n HAVING count(DISTINCT frame) = n) SELECT win, track FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY track) AS rn FROM s) WHERE rn <= 4")
def w10(spark, sf):
    e = table(spark, sf, "events").where("value > 60").select(F.col("user_id").alias("win"), F.col("event_type").alias("track"), (F.col("event_id") % 4).alias("frame"))
    return T.full_tracks(e, "win", "track", "frame", 4)


@query("w11_even_samples", f"WITH {LENGTHS} SELECT DISTINCT clip, CAST(floor(i * (n - 1) / 7.0::DOUBLE) AS INTEGER) AS frame FROM lengths, (SELECT unnest(range(8)) AS i)")
def w11(spark, sf):
    return T.even_samples(_lengths(spark, sf), 8)


@query("w13_reference_window", f"WITH {FRAMES_SQL} SELECT clip, frame, CAST(count(*) OVER (PARTITION BY clip ORDER BY frame RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) - 1 AS BIGINT) AS candidates FROM frames")
def w13(spark, sf):
    """How many other frames a reference frame's window offers."""
    w = Window.partitionBy("clip").orderBy("frame").rangeBetween(-3, 3)
    return frames(spark, sf).select("clip", "frame", (F.count("*").over(w) - 1).alias("candidates"))


def _drawn_sql(k: int) -> str:
    return f"CAST(greatest(0, least(n - 1, frame + CASE WHEN d{k} >= 0 THEN d{k} + 1 ELSE d{k} END)) AS INTEGER)"


@query("w13_sampled_frames", f"WITH {FRAMES_SQL}, d AS (SELECT clip, frame, count(*) OVER (PARTITION BY clip) AS n, " + ", ".join(f"CAST('0x' || substr(md5(clip || '-' || frame || '-{k}'), 1, 8) AS BIGINT) % 6 - 3 AS d{k}" for k in (1, 2)) + f" FROM frames) SELECT clip, frame, list_sort([{_drawn_sql(1)}, {_drawn_sql(2)}]) AS others FROM d")
def w13_sampled(spark, sf):
    """Two other frames of each reference frame's window, drawn by a hash, with replacement, in order."""
    f = frames(spark, sf)
    n = F.count("*").over(Window.partitionBy("clip"))
    draw = lambda k: hash_number("clip", "frame", F.lit(k)) % 6 - 3
    shift = lambda d: F.when(d >= 0, d + 1).otherwise(d)
    pick = lambda k: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("frame") + shift(draw(k)))).cast("int")
    return f.withColumn("n", n).select("clip", "frame", F.array_sort(F.array(pick(1), pick(2))).alias("others"))


@query("v6_memory_bank", f"WITH {FRAMES_SQL}, z AS (SELECT clip, frame, event_id, first_value(event_id) OVER (PARTITION BY clip ORDER BY frame) AS anchor FROM frames) SELECT a.clip, a.frame, a.anchor, coalesce(string_agg(b.event_id, ',' ORDER BY b.frame), '') AS recent FROM z a LEFT JOIN z b ON a.clip = b.clip AND b.frame BETWEEN a.frame - 2 AND a.frame AND b.frame > 0 GROUP BY ALL")
def v6(spark, sf):
    m = T.memory(frames(spark, sf), "event_id", 3)
    return m.select("clip", "frame", "anchor", F.array_join(F.transform("recent", lambda v: v.cast("string")), ",").alias("recent"))


@query("v7_periodic_reseed", f"WITH {FRAMES_SQL} SELECT clip, CAST(frame AS BIGINT) AS frame, CAST(coalesce(max(CASE WHEN frame % 5 = 0 AND score >= 0.4 THEN frame END) OVER (PARTITION BY clip ORDER BY frame), 0) AS BIGINT) AS state FROM frames")
def v7(spark, sf):
    return T.reseeded(frames(spark, sf), 5, 0.4)


@query("v7_reseed_by_overlap", f"WITH {FRAMES_SQL}, f AS (SELECT *, ((event_id * 31) % 100) / 100.0::DOUBLE AS overlap FROM frames) SELECT clip, CAST(frame AS BIGINT) AS frame, CAST(coalesce(max(CASE WHEN frame % 5 = 0 AND score >= 0.1 AND overlap >= 0.5 THEN frame END) OVER (PARTITION BY clip ORDER BY frame), 0) AS BIGINT) AS state FROM f")
def v7_overlap(spark, sf):
    """Re-seeded where the frame's best proposal overlaps what was carried by a half."""
    f = frames(spark, sf).withColumn("overlap", (F.col("event_id") * 31) % 100 / 100.0)
    return T.reseeded(f, 5, 0.1, overlap="overlap", least_overlap=0.5)


def _iou_sql(a: str) -> str:
    inter = f"greatest(0.0, least({a}x1, mx1) - greatest({a}x0, mx0)) * greatest(0.0, least({a}y1, my1) - greatest({a}y0, my0))"
    return f"round({inter} / (({a}x1 - {a}x0) * ({a}y1 - {a}y0) + (mx1 - mx0) * (my1 - my0) - {inter}), 9)"


FOLD_SQL = f"""
WITH RECURSIVE {FRAMES_SQL},
f AS (
  SELECT clip, frame, event_id % 5 - 2 AS dx, event_id % 3 - 1 AS dy, score AS sa, 1 - score AS sb,
         CAST(event_id * 13 % 40 AS DOUBLE) AS ax0, CAST(event_id * 7 % 30 AS DOUBLE) AS ay0, CAST(event_id * 13 % 40 + 60 AS DOUBLE) AS ax1, CAST(event_id * 7 % 30 + 50 AS DOUBLE) AS ay1,
         CAST(event_id * 29 % 60 AS DOUBLE) AS bx0, CAST(event_id * 17 % 40 AS DOUBLE) AS by0, CAST(event_id * 29 % 60 + 50 + event_id % 20 AS DOUBLE) AS bx1, CAST(event_id * 17 % 40 + 60 AS DOUBLE) AS by1
  FROM frames),
walk AS (
  SELECT clip, frame, {", ".join(f"CASE WHEN sa >= sb THEN a{c} ELSE b{c} END AS {c}" for c in ("x0", "y0", "x1", "y1"))}, CASE WHEN sa >= sb THEN 1 ELSE 2 END AS taken, CAST(NULL AS DOUBLE) AS overlap FROM f WHERE frame = 0
  UNION ALL
  SELECT clip, frame, {", ".join(f"CASE hit WHEN 1 THEN a{c} WHEN 2 THEN b{c} ELSE m{c} END" for c in ("x0", "y0", "x1", "y1"))}, hit, v FROM (
    SELECT *, CASE WHEN NOT seed THEN -1 WHEN va >= vb AND va >= 0.5 THEN 1 WHEN vb > va AND vb >= 0.5 THEN 2 ELSE -1 END AS hit, CASE WHEN seed THEN greatest(va, vb) END AS v FROM (
      SELECT *, frame % 2 = 0 AS seed, {_iou_sql("a")} AS va, {_iou_sql("b")} AS vb FROM (
        SELECT f.*, w.x0 + dx AS mx0, w.y0 + dy AS my0, w.x1 + dx AS mx1, w.y1 + dy AS my1 FROM walk w JOIN f ON f.clip = w.clip AND f.frame = w.frame + 1))))
SELECT clip, CAST(frame AS BIGINT) AS frame, x0, y0, x1, y1, CAST(taken AS BIGINT) AS taken, overlap FROM walk
"""


def _motion(spark, sf):
    """Frames with their motion, and two proposals each."""
    f, e = frames(spark, sf), F.col("event_id")
    box = lambda k, x, y, w, h, score: f.select("clip", "frame", F.lit(k).alias("idx"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), score.alias("score"))
    first = box(1, e * 13 % 40, e * 7 % 30, F.lit(60), F.lit(50), F.col("score"))
    second = box(2, e * 29 % 60, e * 17 % 40, 50 + e % 20, F.lit(60), 1 - F.col("score"))
    return f.select("clip", "frame", (e % 5 - 2).alias("dx"), (e % 3 - 1).alias("dy")), first.unionByName(second)


@query("v7_reseed_fold", FOLD_SQL)
def v7_fold(spark, sf):
    """A box carried along each clip, re-seeded at every second frame by the proposal that overlaps what was carried most."""
    return T.reseed_fold(*_motion(spark, sf), every=2, least_score=-100.0)


def _in_triggers(spark, rows, label: str, parts: int = 3):
    """A stream of ``rows`` that comes in ``parts`` triggers, by falling thirds of the frames, and a folder for what is made of it.

    A trigger's rows are written by many tasks. A clip's rows of one third are in one file, so that they stay in order
    also where a third has fewer files than a trigger takes.
    """
    path = new_folder(spark, label)
    rows, files = materialized(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = rows.agg(F.max("frame")).first()[0] or 0
    for k in range(parts):
        of = F.least(F.floor(F.col("frame") * parts / (most + 1)), F.lit(parts - 1))
        rows.where(of == k).repartition(files, "clip").write.mode("append").parquet(f"{path}/in")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in"), path


@query("v7_reseed_stream", FOLD_SQL)
def v7_stream(spark, sf):
    """The same as a stream, every clip cut over three triggers."""
    stream, path = _in_triggers(spark, T.frame_rows(*_motion(spark, sf)), "reseed")
    return C.run_to_end(C.stream_reseed(stream, every=2, least_score=-100.0), path, timers=True)


CLICK_SQL = PIXELS_SQL + """,
d AS (SELECT a.mask, a.p % 8 AS y, a.p // 8 AS x, a.on_ = 1 AND b.on_ = 0 AS missed, a.on_ = 0 AND b.on_ = 1 AS extra FROM raster a JOIN raster b ON b.mask = a.mask + 1 AND b.p = a.p),
s AS (SELECT mask, count(*) FILTER (missed) AS m, count(*) FILTER (extra) AS e FROM d GROUP BY mask),
r AS (SELECT mask, y, x, CASE WHEN m >= e THEN missed ELSE extra END AS inside, CASE WHEN m >= e THEN 1 ELSE 0 END AS label FROM d JOIN s USING (mask) WHERE m + e > 0),
line AS (SELECT unnest(range(-1, 9)) AS k),
o AS (SELECT mask, y, x FROM r WHERE NOT inside UNION ALL SELECT mask, a.k, b.k FROM (SELECT DISTINCT mask FROM r), line a, line b WHERE a.k IN (-1, 8) OR b.k IN (-1, 8)),
depth AS (SELECT r.mask, r.y, r.x, r.label, min(abs(r.y - o.y) + abs(r.x - o.x)) AS deep FROM r JOIN o ON o.mask = r.mask WHERE inside GROUP BY ALL)"""


@query("v8_correction_clicks", f"WITH {CLICK_SQL} SELECT mask, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(label AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY deep DESC, y, x) AS place FROM depth) WHERE place = 1")
def v8(spark, sf):
    """The next click for each mask, with its neighbour as the prediction."""
    packed = bitmaps(spark, sf).withColumnRenamed("bits", "truth")
    return T.correction_clicks(R.with_neighbours(packed, "pred", counts="truth"), 8)


def _shift_sql(k: int) -> str:
    return f"(CAST('0x' || substr(md5(image || '-' || frame || '-{k}'), 1, 8) AS BIGINT) % 2000001 / 1e6 - 1) * 20.0"


@query("v9_synthetic_views", f"WITH {BOXES_SQL}, v AS (SELECT image, idx, frame, x0, y0, x1, y1, CAST('0x' || substr(md5(image || '-' || frame || '-0'), 1, 8) AS BIGINT) % 2 = 1 AS flip, {_shift_sql(1)} AS dx, {_shift_sql(2)} AS dy FROM boxes, (SELECT CAST(unnest(range(4)) AS INTEGER) AS frame)) SELECT image, idx, frame, round(CASE WHEN flip THEN 640 - x1 ELSE x0 END + dx, 6) AS x0, round(y0 + dy, 6) AS y0, round(CASE WHEN flip THEN 640 - x0 ELSE x1 END + dx, 6) AS x1, round(y1 + dy, 6) AS y1 FROM v")
def v9_views(spark, sf):
    """Four views of each image, mirrored and moved; boxes keep their ids."""
    v = T.synthetic_clips(boxes(spark, sf).select("image", "idx", "x0", "y0", "x1", "y1"), 4, 20.0, 640.0)
    return v.select("image", "idx", "frame", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _track_boxes(spark, sf):
    return boxes(spark, sf).select((F.col("image") % 200).alias("clip"), F.expr("image div 200").alias("frame"), "idx", "x0", "y0", "x1", "y1")


@query("v5_track_assignment")
def v5(spark, sf):
    return T.assign_tracks(_track_boxes(spark, sf))


@query("v5_track_stream")
def v5_stream(spark, sf):
    """The same tracks from a stream, every clip cut over three triggers."""
    stream, path = _in_triggers(spark, _track_boxes(spark, sf), "tracks")
    return C.run_to_end(C.stream_tracks(stream), path, timers=True)


@query("v2_v3_v4_transport_chain")
def v2(spark, sf):
    e = table(spark, sf, "embeddings")
    g = e.select((F.col("vec_id") % 20).alias("clip"), F.expr("(vec_id div 20) div 8").cast("int").alias("frame"), F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("feat"), (F.col("label") < 3).cast("double").alias("mass"))
    return T.propagate(g)
