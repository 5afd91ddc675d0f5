"""Annotation tables: assembling, filtering, remapping, renumbering and merging of images, annotations and categories."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import hash_text
from gridloom.sources.storage import materialized


def assemble(images: DataFrame, annotations: DataFrame, fields: list[str], image_key: str = "image") -> DataFrame:
    """Each image with the array of its annotations, in the order of ``fields`` (empty for none)."""
    packed = annotations.groupBy(image_key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("annotations"))
    return images.join(packed, image_key, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(packed.schema["annotations"].dataType)))


def valid_polygons(polygons: Column) -> Column:
    """Polygons with an even number of coordinates, six at least."""
    return F.filter(polygons, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))


def has_noncrowd(annotations: DataFrame, image_key: str, crowd: Column) -> DataFrame:
    """Keys of images with an annotation that is no crowd; a missing flag counts as none."""
    return annotations.where(F.coalesce(crowd, F.lit(0)) == 0).select(image_key).distinct()


def visible_keypoints(keypoints: Column) -> Column:
    """How many of the x, y, v triples have v > 0."""
    return F.size(F.filter(keypoints, lambda v, i: (i % 3 == 2) & (v > 0)))


def query_annotations(ann: DataFrame, area: Column, images: list | None = None, categories: list | None = None, area_range: tuple[float, float] | None = None, crowd: int | None = None) -> DataFrame:
    """Conjunction of the filters that are given; the area range excludes both ends."""
    out = ann
    if images:
        out = out.where(F.col("image").isin(images))
    if categories:
        out = out.where(F.col("category").isin(categories))
    if area_range:
        out = out.where((area > area_range[0]) & (area < area_range[1]))
    if crowd is not None:
        out = out.where(F.col("iscrowd") == crowd)
    return out


def containing_all(ann: DataFrame, group: str, value: str, wanted: list) -> DataFrame:
    """Groups that hold every one of the ``wanted`` values (relational division)."""
    hits = ann.where(F.col(value).isin(wanted)).groupBy(group).agg(F.count_distinct(value).alias("n"))
    return hits.where(F.col("n") == len(set(wanted))).select(group)


def must_join(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """``left`` with the columns of ``right`` by ``key``; a key that ``right`` lacks fails the query, and no row is lost unseen."""
    found = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("_found"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("_found")


def look_up(df: DataFrame, key: str, ids: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of ``df`` for (position, id) rows, in the order of position; ids without a row give nulls, or where ``strict`` an error."""
    rows = df.withColumnRenamed(key, "id")
    return must_join(ids, rows, "id", key) if strict else ids.join(rows, "id", "left")


def contiguous_ids(df: DataFrame, key: str, new: str = "contiguous_id") -> DataFrame:
    """Distinct keys in ascending order, numbered from 0; however many there are, they are numbered by ranges."""
    keys = global_row_number(df.select(key).distinct(), [key], new)
    return keys.select(key, (F.col(new) - 1).cast("int").alias(new))


def global_row_number(df: DataFrame, order: list, new: str) -> DataFrame:
    """Numbers from 1 in ``order`` over the whole table without bringing it into one task: ranges are sorted apart, and each starts where the ones before it end."""
    ranged = materialized(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0), strict=False))
    start = F.element_at(F.array(*(F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=0) + 1))), F.col("_part") + 1)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(new, within + start).drop("_part")


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def class_histogram(ann: DataFrame, categories: DataFrame, crowd: Column) -> DataFrame:
    """Instances that are no crowd for every category, those without any among them, with the total in a row whose category is null."""
    n = ann.where(F.coalesce(crowd, F.lit(0)) == 0).groupBy("category").agg(F.count("*").alias("n"))
    return categories.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n")).rollup("category").agg(F.sum("n").alias("instances"))


def short_name(name: Column, most: int = 13) -> Column:
    """Names longer than ``most`` keep two characters less, and end in two dots."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 2), F.lit(".."))).otherwise(name)


def weighted_repeat_factors(ann: DataFrame, threshold: float, weights: dict[str, float]) -> DataFrame:
    """(dataset, image, factor): repeat factors within each dataset times its weight, scaled so that the least of all is 1."""
    parts = [repeat_factors(ann.where(F.col("dataset") == d), threshold).select(F.lit(d).alias("dataset"), "image", (F.col("factor") * w).alias("factor")) for d, w in weights.items()]
    out = materialized(functools.reduce(DataFrame.unionByName, parts))
    return out.crossJoin(F.broadcast(out.agg(F.min("factor").alias("_least")))).select("dataset", "image", (F.col("factor") / F.col("_least")).alias("factor"))  # one row


def repeat_factors(ann: DataFrame, threshold: float) -> DataFrame:
    """Each image's repeat factor: over its categories the largest max(1, sqrt(threshold / share of images with the category))."""
    total = ann.select("image").distinct().count()
    share = ann.groupBy("category").agg((F.count_distinct("image") / F.lit(total)).alias("share"))
    factor = share.select("category", F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / F.col("share"))).alias("factor"))
    return ann.select("image", "category").distinct().join(factor, "category").groupBy("image").agg(F.max("factor").alias("factor"))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def hashed_sample(df: DataFrame, group: str, key: list[str], seed: int, k: int) -> DataFrame:
    """At most ``k`` rows a group, chosen without replacement by a hash of their key and ``seed``."""
    return top_per_group(df, group, [hash_text(*key, F.lit(seed)), *key], k)


def joint_rows(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Rows of two tables paired by place; the shorter one ends it."""
    a, b = global_row_number(left, left_order, "_place"), global_row_number(right, right_order, "_place")
    return a.join(b, "_place").drop("_place")
