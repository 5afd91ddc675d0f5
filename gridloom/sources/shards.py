"""Tab-separated shards (key, JSON, base64 image) with byte-offset indexes, and listings of file trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.annotations import must_join
from gridloom.sources.storage import materialized


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, json, image): rows of tab-separated shards; the image's bytes are decoded from base64."""
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.tsv$", 1).alias("shard"), F.trim(F.get(parts, 0)).alias("key"), F.get(parts, 1).alias("json"), F.unbase64(F.get(parts, 2)).alias("image"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Rows (key, json, image) as tab-separated lines, the image in base64 without line ends."""
    image = F.translate(F.base64("image"), "\r\n", "")
    rows.select(F.concat_ws("\t", "key", "json", image).alias("value")).write.text(path)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The JSON column replaced by that of a label table with the same keys; a key without a label fails the query."""
    return must_join(rows.drop("json"), labels.select("key", "json"), "key", "key in the labels")


def line_offsets(lines: DataFrame, order: str, text: str, group: str) -> DataFrame:
    """Byte offset of each line within its file: the bytes of all lines before it, each with its line end.

    Lines are dealt by ranges of (file, order), so that a long file spans many tasks; within a range bytes are summed along,
    and the ranges of a file before it add a row each.
    """
    size = lines.select(group, order, (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("_bytes"))
    dealt = materialized(size.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_part", group).agg(F.sum("_bytes").alias("_all")).select("_part", group, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_own", F.coalesce(F.sum("_bytes").over(within), F.lit(0)))
    return rows.join(carried, ["_part", group]).select(group, order, (F.col("_start") + F.col("_own")).alias("offset"))


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, offset, bytes) of every line of the files in ``path``: where it begins, and its bytes without the line end.

    Lines keep their order by the block of the file that they are from and their place in it, so files are read split.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = materialized(spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.octet_length("value").cast("long").alias("bytes"), F.col("value").alias("line")))
    placed = line_offsets(lines, "at", "line", "path").join(lines.select("path", "at", "bytes"), ["path", "at"])
    return shard_rows(placed, "at", "path").select("path", F.col("row_in_shard").alias("row"), "offset", "bytes")


def fetch_rows(index: DataFrame, wanted: DataFrame, window: int = 64 << 20) -> DataFrame:
    """(path, row, key, json, image) of the ``wanted`` (path, row) lines: only their bytes are read, through a written index.

    Requests are dealt by stretches of ``window`` bytes of a file and read in ascending order, so that a task opens a file
    once and a file with many requests is read by many tasks. A row that the index lacks fails the query; rows asked for
    twice are given twice. Files are opened with Arrow's file systems (local or mounted paths, HDFS, object stores).
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        now, file = None, None
        for f in frames:
            out = []
            for path, row, offset, size in f[["path", "row", "offset", "bytes"]].itertuples(index=False):
                if path != now:
                    if file is not None:
                        file.close()
                    system, name = fs.FileSystem.from_uri(path)
                    now, file = path, system.open_input_file(name)
                file.seek(offset)
                parts = [p.strip() for p in file.read(size).decode().split("\t")]
                out.append((path, row, *(parts + [None] * 3)[:3]))
            yield pd.DataFrame(out, columns=["path", "row", "key", "json", "image"])
        if file is not None:
            file.close()

    at = must_join(wanted.select(F.struct("path", "row").alias("at")), index.select(F.struct("path", "row").alias("at"), "offset", "bytes"), "at", "row")
    dealt = at.select("at.path", "at.row", "offset", "bytes").repartition("path", F.floor(F.col("offset") / window)).sortWithinPartitions("path", "offset")
    return dealt.mapInPandas(read, "path string, row int, key string, json string, image string").withColumn("image", F.unbase64("image"))


def shard_rows(lines: DataFrame, order: str, group: str) -> DataFrame:
    """``lines`` with row_in_shard, from 0; numbered by ranges as ``line_offsets`` sums, so that no shard needs one task."""
    dealt = materialized(lines.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_part", group).agg(F.count("*").alias("_all")).select("_part", group, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(order)) - 1
    return dealt.withColumn("_own", own).join(carried, ["_part", group]).withColumn("row_in_shard", (F.col("_start") + F.col("_own")).cast("int")).drop("_part", "_own", "_start")


def shard_number(name: Column) -> Column:
    """The number at the end of names like part-12.tsv."""
    return F.regexp_extract(name, r"-(\d+)\.tsv$", 1).cast("int")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, folder, length) of the files of a tree, in the order of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.select("path", F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"), F.element_at(parts, -2).alias("folder"), "length").orderBy("path")


def pair_by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both trees whose relative stems are equal."""
    return left.withColumnRenamed("path", "left_path").join(right.withColumnRenamed("path", "right_path"), "stem")


def file_id(path: Column) -> Column:
    """The number that a file's stem ends in, without leading zeros; null where there is none."""
    digits = F.regexp_extract(path, r"(\d+)(?:\.[A-Za-z]+)?(?:[?#].*)?$", 1)
    return F.when(digits != "", digits.cast("long"))
