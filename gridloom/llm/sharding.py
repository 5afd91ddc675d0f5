"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly; each group goes where its dot product with the residual capacity is highest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved

_SIZES = ("bytes", "tokens", "rows")


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each of the groups with these sizes (a row a group, a column a dimension), in order of their row.

    Groups go by falling size, the largest share of any dimension. A shard's capacity is an even share of each; what is
    left of it may fall below zero, and the shard with the highest dot product gets the group, the first of equal ones.
    """
    share = sizes / np.maximum(sizes.sum(0), 1)
    left = np.full((shards, sizes.shape[1]), 1 / shards)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        out[i] = k = int((left @ share[i]).argmax())
        left[k] -= share[i]
    return out


def pack_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, packer_groups: int = 20_000, pieces: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Sizes are the text's UTF-8 bytes and 1; ``tokens`` counts a row's tokens (by default words between white space).
    Documents with equal texts are a group and share a shard, unless the group is larger than an even share of a packer's
    shard divided by ``pieces``: such a group is dealt to pieces of about a quarter of that size, which are placed one by one.

    The groups are dealt by their hash to packers of about ``packer_groups`` groups. Each packer fills all shards with its
    own part of their capacity, by falling size, each group where the dot product of its sizes with the residual
    capacity is highest. A packer's shards end about as even as its smallest groups, and packers begin with different
    shards, so that the shards end even over all of them; no packer's work grows with the table. Slots number a
    shard's rows from 0 without gaps, by the task that wrote a row and its place there.

    A null text counts as empty (size 1) and equals the empty text. Repeated rows are rows of one group, each with its own
    slot; null ids are rows as any others. Other columns are ignored, whatever their names. An empty table gives an
    empty result. A single document larger than a shard's share is placed whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) if tokens is None else tokens
    raw = F.encode(text, "UTF-8")
    cols = [F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("bytes"), F.coalesce(words, F.lit(0)).cast("long").alias("tokens"), F.crc32(raw).alias("crc"), F.xxhash64(text).alias("group")]
    rows = saved(docs.select(*cols, F.monotonically_increasing_id().alias("row")), "sized")
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = saved(rows.groupBy("group").agg(*sums), "groups")
    total = groups.agg(*(F.sum(c).alias(c) for c in _SIZES), F.count("*").alias("groups")).first()
    packers = max(1, -(-total["groups"] // packer_groups))
    limit = {c: max(1.0, (total[c] or 0) / packers / shards / pieces) for c in _SIZES}
    over = F.greatest(*(F.col(c) / limit[c] for c in _SIZES))
    large = groups.where((F.col("rows") > 1) & (over > 1)).select("group", F.least(F.col("rows"), F.ceil(4 * over)).alias("n"))
    piece = F.when(F.col("n") > 1, F.pmod(F.col("row"), F.col("n"))).otherwise(F.lit(0).cast("long"))
    rows = saved(rows.join(large, "group", "left").select("id", "bytes", "tokens", "crc", "row", "group", piece.alias("piece")), "pieces")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["group", "piece"], kind="stable")
        frame["shard"] = (place(frame[list(_SIZES)].to_numpy(float), shards) + int(frame["packer"].iloc[0])) % shards
        return frame[["group", "piece", "shard"]]

    units = rows.groupBy("group", "piece").agg(*sums).withColumn("packer", F.pmod(F.xxhash64("group", "piece"), F.lit(packers)).cast("int"))
    placed = saved(units.groupBy("packer").applyInPandas(pack, "group long, piece long, shard int"), "placed")
    dealt = saved(rows.join(placed, ["group", "piece"]).select("id", "bytes", "crc", "row", "shard").withColumn("task", F.spark_partition_id()), "dealt")
    own = F.row_number().over(Window.partitionBy("task", "shard").orderBy("row")) - 1
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = dealt.groupBy("task", "shard").agg(F.count("*").alias("n")).select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    slots = dealt.withColumn("own", own).join(tasks, ["task", "shard"])
    return slots.select(F.col("id").alias("doc_id"), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("own") + F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
