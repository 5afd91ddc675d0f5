"""Queries over annotation tables: scans, filters, lookups, numbering, histograms and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import annotations as A
from gridloom.plans.bridge import BOXES_SQL, boxes
from gridloom.plans.registry import query, table

ANN_SQL = BOXES_SQL + """,
ann AS (SELECT image, idx, category, score, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area, CASE WHEN idx % 4 = 0 THEN NULL WHEN idx % 3 = 0 THEN 1 ELSE 0 END AS iscrowd FROM boxes)"""


def ann(spark, sf):
    b = boxes(spark, sf)
    crowd = F.when(F.col("idx") % 4 == 0, None).when(F.col("idx") % 3 == 0, 1).otherwise(0)
    return b.select("image", "idx", "category", "score", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), crowd.alias("iscrowd"))


@query("s1_j1_assemble_images", f"WITH {ANN_SQL} SELECT o_orderkey AS image, o_orderstatus AS status, count(idx) AS n_ann, coalesce(string_agg(category || ':' || idx, ',' ORDER BY idx), '') AS packed FROM orders LEFT JOIN ann ON image = o_orderkey GROUP BY ALL")
def s1(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderstatus").alias("status"))
    out = A.assemble(images, ann(spark, sf), ["idx", "category"])
    return out.select("image", "status", F.size("annotations").cast("long").alias("n_ann"), F.array_join(F.transform("annotations", lambda a: F.concat(a["category"], F.lit(":"), a["idx"].cast("string"))), ",").alias("packed"))


@query("s1_f21_polygon_rules", f"WITH {ANN_SQL}, p AS (SELECT image, idx, CAST(idx + 2 AS INTEGER) AS a, CAST(2 * idx AS INTEGER) AS b FROM ann) SELECT image, idx, (CASE WHEN a % 2 = 0 AND a >= 6 THEN 1 ELSE 0 END + CASE WHEN b % 2 = 0 AND b >= 6 THEN 1 ELSE 0 END) AS polygons FROM p WHERE (a % 2 = 0 AND a >= 6) OR (b % 2 = 0 AND b >= 6)")
def s1_polygons(spark, sf):
    """Two polygons an annotation, of idx + 2 and 2 * idx coordinates; annotations without a valid one go."""
    poly = lambda n: F.array_repeat(F.lit(1.0), n.cast("int"))
    p = ann(spark, sf).select("image", "idx", A.valid_polygons(F.array(poly(F.col("idx") + 2), poly(F.col("idx") * 2))).alias("p"))
    return p.where(F.size("p") > 0).select("image", "idx", F.size("p").alias("polygons"))


@query("f1_noncrowd_images", f"WITH {ANN_SQL} SELECT DISTINCT image FROM ann WHERE coalesce(iscrowd, 0) = 0 AND idx > 2")
def f1(spark, sf):
    return A.has_noncrowd(ann(spark, sf).where("idx > 2"), "image", F.col("iscrowd"))


@query("f2_keypoint_filter", f"WITH {ANN_SQL} SELECT image, sum(CASE WHEN idx % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS visible FROM ann GROUP BY image HAVING sum(CASE WHEN idx % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END) >= 3")
def f2(spark, sf):
    kp = F.array(F.col("x0"), F.col("y0"), (F.col("idx") % 2).cast("double"), F.col("x1"), F.col("y1"), (F.col("idx") % 3 == 0).cast("double"))
    return ann(spark, sf).select("image", A.visible_keypoints(kp).alias("v")).groupBy("image").agg(F.sum("v").alias("visible")).where("visible >= 3")


@query("f3_annotation_query", f"WITH {ANN_SQL} SELECT image, idx FROM ann WHERE category IN ('A', 'R') AND area > 1000 AND area < 9000 AND iscrowd = 0")
def f3(spark, sf):
    return A.query_annotations(ann(spark, sf), F.col("area"), categories=["A", "R"], area_range=(1000, 9000), crowd=0).select("image", "idx")


@query("f4_category_query", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size IN (1, 2, 3, 4, 5)")
def f4(spark, sf):
    return table(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & F.col("p_size").isin(1, 2, 3, 4, 5)).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("f5_videos_with_all", "SELECT user_id AS clip FROM events WHERE event_type IN ('click', 'view') AND value > 100 GROUP BY user_id HAVING count(DISTINCT event_type) = 2")
def f5(spark, sf):
    e = table(spark, sf, "events").where("value > 100").select(F.col("user_id").alias("clip"), "event_type")
    return A.containing_all(e, "clip", "event_type", ["click", "view"])


@query("f6_id_lookup", "SELECT pos, id, n_name AS name FROM (VALUES (0, 7), (1, 3), (2, 99), (3, 7)) v(pos, id) LEFT JOIN nation ON n_nationkey = id")
def f6(spark, sf):
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 99), (3, 7)], "pos int, id int")
    return A.look_up(table(spark, sf, "nation"), "n_nationkey", F.broadcast(ids)).select("pos", "id", F.col("n_name").alias("name"))


@query("f20_category_remap", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS contiguous_id FROM documents")
def f20(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(A.contiguous_ids(docs, "lang"), "lang").select("doc_id", "contiguous_id")


@query("j2_images_proposals", f"WITH {BOXES_SQL}, p AS (SELECT CAST(image AS VARCHAR) AS image_id, string_agg(idx, ',' ORDER BY score DESC, idx) AS ranked FROM boxes GROUP BY image) SELECT image, ranked FROM (SELECT DISTINCT l_orderkey AS image FROM lineitem) JOIN p ON image_id = CAST(image AS VARCHAR)")
def j2(spark, sf):
    """Images that orders with lines stand for, with all boxes as their proposals; an image without any fails."""
    ranked = boxes(spark, sf).groupBy(F.col("image").cast("string").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "idx"))).alias("r"))
    images = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image")).distinct().withColumn("image_id", F.col("image").cast("string"))
    return A.must_join(images, ranked, "image_id", "image of a proposal").select("image", F.array_join(F.transform("r", lambda x: x["idx"].cast("string")), ",").alias("ranked"))


@query("j4_category_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j4(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    regions = region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    lookup = A.must_join(nation, regions, "n_regionkey", "region").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return A.must_join(table(spark, sf, "customer"), lookup, "c_nationkey", "nation").select("c_custkey", "n_name", "r_name")


@query("j6_joint_rows", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) USING (rn)")
def j6(spark, sf):
    return A.joint_rows(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "supplier").select("s_suppkey"), ["c_custkey"], ["s_suppkey"])


@query("k9_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k9(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("k1_annotation_builder", f"WITH {ANN_SQL} SELECT image, idx, category, coalesce(iscrowd, 0) AS iscrowd, area, x0 AS bbox_x, y0 AS bbox_y, round(x1 - x0, 3) AS bbox_w, round(y1 - y0, 3) AS bbox_h FROM ann WHERE area >= 2500")
def k1(spark, sf):
    a = ann(spark, sf).where("area >= 2500")
    return a.select("image", "idx", "category", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), "area", F.col("x0").alias("bbox_x"), F.col("y0").alias("bbox_y"), F.round(F.col("x1") - F.col("x0"), 3).alias("bbox_w"), F.round(F.col("y1") - F.col("y0"), 3).alias("bbox_h"))


@query("k2_image_info", "SELECT o_orderkey AS id, 'img_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.jpg' AS file_name, 640 AS width, 480 AS height, strftime(o_orderdate, '%Y-%m-%d') AS date_captured, 1 AS license, '' AS coco_url FROM orders")
def k2(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("img_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_captured"), F.lit(1).alias("license"), F.lit("").alias("coco_url"))


@query("k3_w7_renumbered_annotations", f"WITH {ANN_SQL}, m AS (SELECT category, dense_rank() OVER (ORDER BY category) AS category_id FROM (SELECT DISTINCT category FROM ann)) SELECT row_number() OVER (ORDER BY image, idx) AS id, image, category_id, round(x0, 3) AS x, round(y0, 3) AS y, round(x1 - x0, 3) AS w, round(y1 - y0, 3) AS h FROM ann JOIN m USING (category)")
def k3(spark, sf):
    a = ann(spark, sf)
    ids = A.contiguous_ids(a, "category", "c")
    numbered = A.must_join(A.global_row_number(a, ["image", "idx"], "id"), ids, "category", "category")
    return numbered.select(F.col("id").cast("long").alias("id"), "image", (F.col("c") + 1).cast("long").alias("category_id"), F.round("x0", 3).alias("x"), F.round("y0", 3).alias("y"), F.round(F.col("x1") - F.col("x0"), 3).alias("w"), F.round(F.col("y1") - F.col("y0"), 3).alias("h"))


@query("k5_predictions_to_rows", f"WITH {BOXES_SQL} SELECT image AS image_id, category, score, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM det")
def k5(spark, sf):
    b = boxes(spark, sf).where("not is_gt")
    return b.select(F.col("image").alias("image_id"), "category", "score", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


@query("a9_class_histogram", f"WITH {ANN_SQL}, c AS (SELECT unnest(['A', 'N', 'R', 'Z']) AS category), n AS (SELECT c.category, coalesce(k, 0) AS k FROM c LEFT JOIN (SELECT category, count(*) AS k FROM ann WHERE coalesce(iscrowd, 0) = 0 GROUP BY 1) USING (category)) SELECT category, CAST(sum(k) AS BIGINT) AS instances FROM n GROUP BY ROLLUP (category)")
def a9(spark, sf):
    categories = spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "category string")
    return A.class_histogram(ann(spark, sf), categories, F.col("iscrowd"))


@query("a9_short_names", "SELECT p_partkey, CASE WHEN length(p_name) > 13 THEN substr(p_name, 1, 11) || '..' ELSE p_name END AS short FROM part")
def a9_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.short_name(F.col("p_name")).alias("short"))


@query("a31_repeat_factors", f"WITH {ANN_SQL}, s AS (SELECT category, count(DISTINCT image) / CAST((SELECT count(DISTINCT image) FROM ann) AS DOUBLE) AS share FROM ann GROUP BY 1) SELECT image, round(max(greatest(1.0, sqrt(0.9 / share))), 6) AS factor FROM ann JOIN s USING (category) GROUP BY image")
def a31(spark, sf):
    return A.repeat_factors(ann(spark, sf), 0.9).withColumn("factor", F.round("factor", 6))


@query("a31_weighted_repeat_factors", f"WITH {ANN_SQL}, d AS (SELECT *, CASE WHEN image % 3 = 0 THEN 'x' ELSE 'y' END AS dataset FROM ann), t AS (SELECT dataset, count(DISTINCT image) AS total FROM d GROUP BY 1), s AS (SELECT dataset, category, count(DISTINCT image) / CAST(any_value(total) AS DOUBLE) AS share FROM d JOIN t USING (dataset) GROUP BY dataset, category), f AS (SELECT dataset, image, max(greatest(1.0, sqrt(0.9 / share))) * CASE dataset WHEN 'x' THEN 0.5 ELSE 2.0 END AS v FROM d JOIN s USING (dataset, category) GROUP BY dataset, image) SELECT dataset, image, round(v / (SELECT min(v) FROM f), 6) AS factor FROM f")
def a31_weighted(spark, sf):
    a = ann(spark, sf).withColumn("dataset", F.when(F.col("image") % 3 == 0, "x").otherwise("y"))
    return A.weighted_repeat_factors(a, 0.9, {"x": 0.5, "y": 2.0}).withColumn("factor", F.round("factor", 6))


@query("f6_strict_lookup", "SELECT pos, id, n_name AS name FROM (VALUES (0, 7), (1, 3), (2, 7)) v(pos, id) JOIN nation ON n_nationkey = id")
def f6_strict(spark, sf):
    """Ids that must be there; one that is not is an error (see the tests)."""
    ids = spark.createDataFrame([(0, 7), (1, 3), (2, 7)], "pos int, id int")
    return A.look_up(table(spark, sf, "nation"), "n_nationkey", ids, strict=True).select("pos", "id", F.col("n_name").alias("name"))


@query("a32_class_weights", "SELECT class, round(pow(n, 0.5), 6) AS weight FROM (SELECT event_type AS class, count(DISTINCT user_id) AS n FROM events GROUP BY 1)")
def a32(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("class")).agg(F.round(F.pow(F.count_distinct("user_id").cast("double"), F.lit(0.5)), 6).alias("weight"))


@query("w8_first_seen", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def w8(spark, sf):
    return A.first_seen(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w6_order_preserving_renumber", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS label FROM part")
def w6(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).alias("label"))


@query("w12_stride_subsample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 4 = 0")
def w12(spark, sf):
    numbered = A.global_row_number(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "rn")
    return numbered.where((F.col("rn") - 1) % 4 == 0).select("o_orderkey")


@query("t1_sorted_ids", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def t1(spark, sf):
    return A.global_row_number(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "place")


@query("t6_random_cap", f"WITH {ANN_SQL} SELECT image, idx, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(image || '-' || idx || '-13'), image, idx) AS r FROM ann) WHERE r <= 500")
def t6(spark, sf):
    return A.hashed_sample(ann(spark, sf), "category", ["image", "idx"], 13, 500).select("image", "idx", "category")


@query("t7_t10_range_and_batches", "SELECT c_custkey, (rn - 1) // 16 AS batch FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) WHERE rn BETWEEN 11 AND 90")
def t7(spark, sf):
    numbered = A.global_row_number(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "rn")
    return numbered.where(F.col("rn").between(11, 90)).select("c_custkey", F.expr("(rn - 1) div 16").alias("batch"))


@query("set_bag_union", "SELECT image, sum(n)::BIGINT AS n FROM (SELECT l_orderkey AS image, 1 AS n FROM lineitem UNION ALL SELECT o_orderkey, 10 FROM orders) GROUP BY image")
def set_union(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.lit(1).alias("n"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.lit(10).alias("n"), F.lit("x").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("image").agg(F.sum("n").alias("n"))


@query("set_intersection", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).intersect(li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")))


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("set_subset_violations", "SELECT count(*) AS outside FROM (SELECT DISTINCT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_subset(spark, sf):
    return table(spark, sf, "labels").select("doc_id").distinct().join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("outside"))


@query("a29_present_absent", "SELECT count(*) FILTER (toxic IS NOT NULL) AS present, round(avg(n_chars) FILTER (toxic IS NOT NULL), 6) AS mean_present, round(avg(CASE WHEN n_chars < 500 THEN 1.0 ELSE 0.0 END) FILTER (toxic IS NULL), 6) AS empty_share_absent FROM documents LEFT JOIN labels USING (doc_id)")
def a29(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    there = F.col("toxic").isNotNull()
    return d.agg(F.count(F.when(there, 1)).alias("present"), F.round(F.avg(F.when(there, F.col("n_chars"))), 6).alias("mean_present"), F.round(F.avg(F.when(~there, (F.col("n_chars") < 500).cast("double"))), 6).alias("empty_share_absent"))
