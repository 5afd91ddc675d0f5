"""Line deduplication: Bloom filters of once-seen and twice-seen lines; only suspected repeats shuffle."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import MOST_SLOTS, Repeats, bloom_slots, give_back_memory, id_filter, saved, small_batches

_EDGE = " \t\n\x0b\x0c\r"


def line_keys(lines: list[str], least: int) -> list[bytes | None]:
    """A line's key, or None for one under ``least`` code points: ends stripped of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    out: list[bytes | None] = []
    for line in lines:
        s = line.strip(_EDGE)
        out.append(s.encode("utf-8", "surrogatepass").lower() if len(s) >= least else None)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, most_slots: int = MOST_SLOTS) -> DataFrame:
    """All columns of ``docs`` with the text deduplicated, and _n_lines, _n_dropped.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except
    those in the largest id holding it. Pass 1 fills two Bloom filters over the distinct key hashes of every
    document. Pass 2 emits only keys that the second filter has: their (128-bit key, id) rows shuffle for the exact
    count and the choice of the document that keeps the line. Documents without a suspected line pass straight
    through; the others meet their dropped keys by id.

    Null or empty text is one empty line. Rows are documents: repeated ids count as often as they occur, and all
    rows with the id that keeps a line keep it; a null id ranks below every other. Clashing column names other than
    _n_lines and _n_dropped are carried through unchanged; those two are replaced. Empty tables give empty results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_n_lines", "_n_dropped")
    n_docs = docs.count()
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashes(b: pa.RecordBatch) -> np.ndarray:
        each = ({k for k in line_keys((t or "").split("\n"), min_chars) if k is not None} for t in b.column(0).to_pylist())
        return np.array([xxhash.xxh3_64_intdigest(k) for ks in each for k in ks], np.uint64)

    repeated = Repeats(docs.select(text_col), hashes, n_docs, 128, most_slots)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0), [list({k for k in line_keys((t or "").split("\n"), min_chars) if k is not None}) for t in b.column(1).to_pylist()]
            flat = [k for ks in keys for k in ks]
            at = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys]).astype(np.int64)
            flag = repeated(np.array([xxhash.xxh3_64_intdigest(k) for k in flat], np.uint64))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[flag])), pa.array([xxhash.xxh3_128_digest(k) for k, f in zip(flat, flag.tolist(), strict=True) if f], pa.binary())], ["id", "key"])

    keyed = saved(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(emit, f"id {id_type}, key binary"), "lines")
    common = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep"), "lines-common")
    private = lambda label: next(n for i in itertools.count() if (n := f"{label}{i}") not in {c.lower() for c in docs.columns})
    lost_id, gone_col = private("_lost_id"), private("_lost")
    lost = keyed.join(common, "key").where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy(F.col("id").alias(lost_id)).agg(F.collect_set("key").alias(gone_col))
    lost = saved(lost, "lines-lost")
    touched = id_filter(lost.select(lost_id), bloom_slots(n_docs, 16, most=most_slots))

    out_schema = docs.withColumns({"_n_lines": F.lit(0).cast("long"), "_n_dropped": F.lit(0).cast("long")}).schema
    names = docs.columns

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, dropped, kept = [], [], []
            for text, gone in zip(b.column(text_col).to_pylist(), b.column(gone_col).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n.append(len(lines))
                if gone:
                    gone = set(gone)
                    stay = [line for line, k in zip(lines, line_keys(lines, min_chars), strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone]
                    dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    dropped.append(0)
                    kept.append(text or "")
            cols = {c: b.column(c) for c in names} | {text_col: pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], [*cols, "_n_lines", "_n_dropped"])
        give_back_memory()

    straight = docs.where(~touched(F.col(id_col))).withColumn(gone_col, F.lit(None).cast("array<binary>"))
    joined = docs.where(touched(F.col(id_col))).join(lost.hint("merge"), F.col(id_col).eqNullSafe(F.col(lost_id)), "left").drop(lost_id)
    return straight.unionByName(joined).mapInArrow(drop, out_schema)
