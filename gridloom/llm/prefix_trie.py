"""A trie of conversation prefixes: chained digests name every prefix, nodes are groups of equal (depth, digest), and each path hands its nodes' totals to all ancestors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved, small_batches

ROOT = hashlib.sha256(b"").digest()
BLOCK = 256  # turns that are chained in one row


def number_turns(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth (1 for a conversation's first turn), said (a digest of role and text), n (code points of the text).

    Turns go by ``order_col``, nulls first, ties by ``said``. Rows are dealt by ranges of that order and numbered within
    each; a row for each range and conversation carries the numbers on, so that a conversation may span many tasks.
    Null roles and texts count as empty. Rows without a conversation are in none and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.col(order_col).alias("turn"), said.alias("said"), F.char_length(text).cast("long").alias("n"))
    order = [F.asc_nulls_first("turn"), F.asc("said")]
    dealt = saved(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("rows")).select("part", "conv_id", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")).where("before > 0")
    numbered = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)))
    return numbered.join(carried, ["part", "conv_id"], "left").select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("depth"), "said", "n")


def lend_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which each conversation c begins with the first h turns of conversation c - c % every, and its own follow after its first h.

    h is the crc32 of c's decimals modulo ``most``. Returns the turns and all conversations (conv_id, turns), also those without
    a turn. A lender has at most ``every`` borrowers and lends less than ``most`` turns, so the join stays in proportion.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = own.withColumns({"lender": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    lent = own.select(F.col("conv_id").alias("lender"), F.col("own").alias("lends"))
    convs = convs.join(lent, "lender", "left").withColumn("took", F.least("h", F.coalesce("lends", F.lit(0))))
    convs = saved(convs.select("conv_id", "lender", "h", "took", (F.col("took") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "conversations")
    heads = turns.where((F.col("depth") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "lender")
    taken = convs.join(heads, "lender").where("depth <= h").select("conv_id", "depth", "said", "n")
    rest = turns.join(convs.drop("turns"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("took")).alias("depth"), "said", "n")
    return taken.unionByName(rest), convs.select("conv_id", "turns")


def chained(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (the digest one turn before) and n of every prefix with a turn.

    A prefix's digest is SHA-256 over the digest of all whole blocks of BLOCK turns before it and a chain through its own
    block; the digest at a block's end stands for it further on. Only those ends run along a whole conversation, as
    one row a block, in order and without being gathered.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    grouped = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "said", "n"))).alias("t"))
    grouped = grouped.select("conv_id", "block", F.col("t.said").alias("said"), F.col("t.n").alias("n"))

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chains = []
            for said in f["said"]:
                c, out = b"", []
                for s in said:
                    c = hashlib.sha256(c + s).digest()
                    out.append(c)
                chains.append(out)
            yield f.assign(said=chains)

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest = None, ROOT
        for f in frames:
            before = []
            for c, end in zip(f["conv_id"], f["end"], strict=True):
                digest = digest if c == conv else ROOT
                conv = c
                before.append(digest)
                digest = hashlib.sha256(digest + end).digest()
            yield f[["conv_id", "block"]].assign(before=before)

    blocks = saved(grouped.mapInPandas(chain, f"conv_id {id_type}, block long, said array<binary>, n array<long>"), "chains")
    long = blocks.where(F.size("said") == BLOCK).select("conv_id", "block", F.element_at("said", -1).alias("end"))
    ends = long.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(carry, f"conv_id {id_type}, block long, before binary")
    # what stands before a block: the digest after the one before it
    after = ends.join(long, ["conv_id", "block"]).select("conv_id", (F.col("block") + 1).alias("block"), F.unhex(F.sha2(F.concat("before", "end"), 256)).alias("before"))
    whole = blocks.join(after, ["conv_id", "block"], "left").withColumn("before", F.coalesce("before", F.lit(ROOT)))
    digests = F.transform("said", lambda c: F.unhex(F.sha2(F.concat(F.col("before"), c), 256)))
    each = whole.select("conv_id", "block", "before", "n", digests.alias("digests")).select("conv_id", "block", "before", "n", "digests", F.posexplode("digests").alias("at", "digest"))
    parent = F.when(F.col("at") == 0, F.col("before")).otherwise(F.get("digests", F.col("at") - 1))
    return each.select("conv_id", (F.col("block") * BLOCK + F.col("at") + 1).alias("depth"), "digest", parent.alias("parent"), F.get("n", F.col("at")).alias("n"))


def _ends(members: DataFrame) -> DataFrame:
    """For each digest, SHA-256 of its conversations' ids in order, joined by commas. The ids of a digest pass a task in order; none is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, hashlib.sha256()
        for f in frames:
            done = []
            for d, c in zip(f["digest"], f["conv_id"], strict=True):
                if d == now:
                    sha.update(b"," + str(c).encode())
                else:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = d, hashlib.sha256(str(c).encode())
            yield pd.DataFrame(done, columns=["digest", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, sha.hexdigest())], columns=["digest", "ends_sha256"])

    return members.repartition("digest").sortWithinPartitions("digest", "conv_id").mapInPandas(run, "digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, depth (from 1, without gaps), said and n, as ``number_turns`` gives them; ``convs`` every
    conversation's conv_id and number of turns. A node is a distinct sequence of first turns, the root the empty one; its members
    are the conversations that begin with it, its conv_id the least of them. Leaves are the nodes of a subtree without
    children; saved_tokens sums, over a subtree, (members - 1) times the code points of a node's last text; ends_sha256 is
    over the members that end at a node. Without conversations there is no node.

    Every prefix becomes a (depth, digest) row, and equal ones are counted. A node belongs to its least conversation, whose
    path holds all its ancestors: along each path a running sum from its end adds up the leaves and savings of its own
    nodes, every shared ancestor on the path gets that sum as one row, and rows are added up by ancestor. So what is
    exploded to ancestors is in proportion to the turns, and hot ancestors are added up before they shuffle.
    """
    small_batches(turns.sparkSession)
    paths = chained(turns).join(convs, "conv_id").select("conv_id", "depth", "digest", "parent", "n", (F.col("depth") == F.col("turns")).alias("ends"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n"), (F.col("turns") == 0).alias("ends"))
    prefixes = saved(paths.unionByName(roots), "prefixes")
    nodes = prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("n").alias("n"))
    nodes = saved(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").join(_ends(prefixes.where("ends").select("digest", "conv_id")), "digest", "left")
    nodes = saved(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("n")}), "nodes")

    own = nodes.select("conv_id", "depth", "n_convs", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    path = prefixes.select("conv_id", "depth", "digest", F.floor(F.col("depth") / BLOCK).alias("block")).join(own, ["conv_id", "depth"], "left")
    back = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = path.groupBy("conv_id", "block").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leaf", "saved")))
    more = totals.select("conv_id", "block", *(F.sum(c).over(later).alias(f"later_{c}") for c in ("leaf", "saved"))).where("later_leaf > 0 or later_saved > 0")
    sums = path.select("conv_id", "block", "digest", "n_convs", *(F.coalesce(F.sum(c).over(back), F.lit(0)).alias(c) for c in ("leaf", "saved"))).join(more, ["conv_id", "block"], "left")
    sums = sums.select("digest", "n_convs", *((F.col(c) + F.coalesce(f"later_{c}", F.lit(0))).alias(c) for c in ("leaf", "saved")))
    # a node with one member has one leaf and saves nothing, so only shared ancestors are told
    sums = sums.where("(leaf > 0 or saved > 0) and (n_convs is null or n_convs > 1)").groupBy("digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "digest", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
