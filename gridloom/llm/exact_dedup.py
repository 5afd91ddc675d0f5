"""Exact deduplication: two Bloom passes find possibly repeated texts; only their (hash, id) rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import MOST_SLOTS, Repeats, saved, small_batches


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = 16, most_slots: int = MOST_SLOTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the row with the largest id stays. Pass 1 puts a 64-bit hash
    of every text into two Bloom filters (seen once, seen twice), merged in a tree; beyond ``most_slots`` the hashes
    are dealt to several pairs of filters (see ``Repeats``). Pass 2
    tests every row: rows that no other row can equal pass straight through, and (sha256, id) of the others are
    grouped exactly. The texts never shuffle.

    Null text counts as empty; all empty texts are one group. A null id ranks below every other, and in a group of
    null ids keep_id is null and all stay. Rows that repeat an id and a text count separately and share their
    decision, as nothing tells them apart. Other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 65536)
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = lambda b: b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
    repeated = Repeats(docs.select(F.xxhash64(text).alias("h")), hashes, docs.count(), slots_per_row, most_slots)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(repeated(hashes(b)))], ["doc_id", "sha", "maybe"])

    id_type = docs.schema[id_col].dataType.simpleString()
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("h"))
    rows = saved(hashed.mapInArrow(test, f"doc_id {id_type}, sha string, maybe boolean"), "exact")
    maybe = rows.where("maybe").select("doc_id", "sha")
    groups = saved(maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")
    found = maybe.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "sha",
    )
    alone = rows.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return found.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
