"""Annotation documents (images, annotations, categories, videos as JSON) in and out, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.annotations import assemble, global_row_number, must_join, valid_polygons
from gridloom.sources.storage import materialized

IMAGE = "id BIGINT, file_name STRING, width INT, height INT, date_captured STRING, license INT, coco_url STRING, flickr_url STRING"
ANNOTATION = "id BIGINT, image_id BIGINT, category_id INT, iscrowd INT, area DOUBLE, bbox ARRAY<DOUBLE>, segmentation VARIANT, score DOUBLE, track_id BIGINT, keypoints ARRAY<DOUBLE>"
CATEGORY = "id INT, name STRING, supercategory STRING"


def _struct(ddl: str) -> str:
    """The struct type of a DDL column list, written as the type of a field."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


def document_schema(per_image: bool = False) -> str:
    image = f"image {_struct(IMAGE)}" if per_image else f"images array<{_struct(IMAGE)}>"
    return f"{image}, annotations array<{_struct(ANNOTATION)}>, categories array<{_struct(CATEGORY)}>"


def read_documents(spark: SparkSession, path: str, per_image: bool = False, multi_line: bool = True) -> dict[str, DataFrame]:
    """images, annotations and categories of all documents in ``path``, each with the file it is from. Missing crowd flags are 0.

    A document is a file, or without ``multi_line`` a line, so that files can be split. An annotation's segmentation is told
    as a struct of what its JSON may hold (see ``segmentation``).
    """
    docs = spark.read.schema(document_schema(per_image)).json(path, multiLine=multi_line).withColumn("file", F.col("_metadata.file_path"))
    each = lambda c: docs.select("file", F.explode(c).alias("r")).select("file", "r.*")
    images = docs.select("file", "image.*") if per_image else each("images")
    # told within the array, once an annotation: past the explode, each filter on it would work it out again
    told = F.transform("annotations", lambda a: a.withField("segmentation", segmentation(a["segmentation"])))
    ann = each(told).withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0)))
    return {"images": images, "annotations": ann, "categories": each("categories").drop("file").distinct()}


def segmentation(v: Column) -> Column:
    """What a segmentation field of either kind holds: polygons, or a run-length code's size with counts (packed text) or runs (numbers).

    Whatever is neither a list of lists of numbers nor an object has nulls alone, and an absent field is null.
    """
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    runs = of("$.counts", "array<int>")  # only an object has a path
    counts = F.when(runs.isNull(), of("$.counts", "string"))
    return F.when(v.isNotNull() & ~F.is_variant_null(v), F.struct(of("$", "array<array<double>>").alias("polygons"), of("$.size", "array<int>").alias("size"), counts.alias("counts"), runs.alias("runs")))


def with_valid_polygons(annotations: DataFrame) -> DataFrame:
    """Annotations whose polygons have an even number of coordinates, six at least; one that had polygons and keeps none goes.

    Run-length codes, empty lists of polygons and annotations without a segmentation stay as they are.
    """
    had, kept = F.col("segmentation.polygons"), valid_polygons(F.col("segmentation.polygons"))
    left = annotations.where((F.size(F.coalesce(had, F.array())) == 0) | (F.size(kept) > 0))
    return left.withColumn("segmentation", F.when(had.isNotNull(), F.col("segmentation").withField("polygons", kept)).otherwise(F.col("segmentation")))


def centred_keypoints(keypoints: Column) -> Column:
    """x, y, v triples whose x and y, given for a pixel's corner, move to its centre."""
    return F.transform(keypoints, lambda v, i: F.when(i % 3 == 2, v).otherwise(v + 0.5))


def image_records(documents: dict[str, DataFrame]) -> DataFrame:
    """A row per image with the array of its annotations (in the order of their ids; empty for none), each with its category's name.

    A category that the documents do not list is an error. The categories are written first, so that Spark knows their size
    and no task gets all annotations of one. Keypoints move to pixel centres. Polygons that cannot be drawn
    go, and with them annotations that have no other.
    """
    names = materialized(documents["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category")))
    ann = must_join(with_valid_polygons(documents["annotations"]), names, "category_id", "category").withColumn("keypoints", centred_keypoints(F.col("keypoints")))
    fields = ["id", "category", "iscrowd", "area", "bbox", "keypoints", "segmentation"]
    return assemble(documents["images"].withColumnRenamed("id", "image_id"), ann, fields, "image_id")


def write_proposals(proposals: DataFrame, path: str) -> None:
    """A row per image (ids, boxes, objectness_logits, bbox_mode), boxes by falling score and then idx: an archive of proposals."""
    by_score = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "idx", "score", F.array("x0", "y0", "x1", "y1").alias("box"))))
    packed = proposals.groupBy(F.col("image").cast("string").alias("ids")).agg(by_score.alias("p"))
    packed.select("ids", F.transform("p", lambda r: r["box"]).alias("boxes"), F.transform("p", lambda r: r["score"]).alias("objectness_logits"), F.lit("XYXY").alias("bbox_mode")).write.parquet(path)


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, rank, score, x0, y0, x1, y1) of an archive; it may also name its columns indexes and scores."""
    df = spark.read.parquet(path)
    df = df.withColumnsRenamed({old: new for old, new in (("indexes", "ids"), ("scores", "objectness_logits")) if old in df.columns})
    rows = df.select(F.col("ids").alias("image_id"), F.posexplode(F.arrays_zip("boxes", "objectness_logits")).alias("rank", "p"))
    return rows.select("image_id", "rank", F.col("p.objectness_logits").alias("score"), *(F.get("p.boxes", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))


def panoptic_records(documents: DataFrame, things: dict, stuff: dict) -> DataFrame:
    """(image_id, file_name, pan_seg_file, sem_seg_file, segments) of panoptic annotations (image_id, file_name, segments_info).

    The three paths follow from one name; each segment's category goes through the map of things, or else that of stuff,
    and it is told which.
    """
    listed = F.array(*(F.lit(k) for k in things))
    segment = lambda r: F.struct(r["id"].alias("id"), remap(r["category_id"], things, stuff).alias("category_id"), F.array_contains(listed, r["category_id"]).alias("isthing"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    path = lambda folder, end: F.concat(F.lit(f"{folder}/"), stem, F.lit(end))
    return documents.select("image_id", path("images", ".jpg").alias("file_name"), path("panoptic", ".png").alias("pan_seg_file"), path("semantic", ".png").alias("sem_seg_file"), F.transform("segments_info", segment).alias("segments"))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once: a sound table has none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def write_document(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """One JSON row per image with its annotations: a folder of JSON lines, written through the commit protocol."""
    packed = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in annotations.columns if c not in ("id", "image_id"))))).alias("annotations"))
    images.join(packed, images["id"] == packed["image_id"], "left").drop("image_id").write.mode("overwrite").json(path)


def clip_index(labels: DataFrame) -> DataFrame:
    """(clip, frames, instances) of label maps (clip, frame, p, label): how many frames, and the labels over 0 in ascending order."""
    seen = F.array_sort(F.collect_set(F.when(F.col("label") > 0, F.col("label"))))
    return labels.groupBy("clip").agg(F.count_distinct("frame").alias("frames"), seen.alias("instances"))


def instance_masks(labels: DataFrame, instances: list[int] | None = None) -> DataFrame:
    """(clip, frame, instance, p): the set pixels of each instance's mask, of all instances or the given ones."""
    wanted = F.col("label") > 0 if instances is None else F.col("label").isin(instances)
    return labels.where(wanted).select("clip", "frame", F.col("label").alias("instance"), "p")


def video_frames(videos: DataFrame, boxes: str, areas: str) -> DataFrame:
    """(id, frame, box, area): the frames of each video annotation in which it is present; absent frames are null entries."""
    return videos.select("id", F.posexplode_outer(F.arrays_zip(boxes, areas)).alias("frame", "r")).select("id", "frame", F.col(f"r.{boxes}").alias("box"), F.col(f"r.{areas}").alias("area")).where("box is not null and area is not null")


def mean_area(areas: Column) -> Column:
    """Mean of the entries that are neither null nor 0; 0 where there is none."""
    real = F.filter(areas, lambda a: a.isNotNull() & (a != 0))
    return F.when(F.size(real) > 0, F.aggregate(real, F.lit(0.0), lambda s, a: s + a) / F.size(real)).otherwise(0.0)


def load_results(results: DataFrame, videos: DataFrame, order: list[str]) -> DataFrame:
    """Results (video_id, areas, ...) as annotations of known ``videos`` (video_id): id from 1 by ``order``, avg_area, and no crowd.

    A video that is not known fails the query. Ids are numbered by ranges, however many results there are.
    """
    known = must_join(results, videos.select("video_id").distinct(), "video_id", "video of a result")
    return global_row_number(known, order, "id").withColumns({"avg_area": mean_area(F.col("areas")), "iscrowd": F.lit(0)})


def remap(value: Column, first: dict, second: dict) -> Column:
    """``first[value]``, or else ``second[value]``."""
    look = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[value]
    return F.coalesce(look(first), look(second))
