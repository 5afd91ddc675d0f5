"""Set operations and overlaps of masks from their run-length codes alone: no row and no entry for a pixel.

Two codes are merged as two sorted lists of run ends in one pass, for all pairs of an Arrow batch side by side. What
needs neither order nor pairs stays in the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.masks import rle_area


class _Ends(NamedTuple):
    """The run ends of codes, one after the other."""

    row: np.ndarray  # which code
    at: np.ndarray  # pixels up to and with the run
    step: np.ndarray  # 1 where a set run begins after it, -1 where one ends with it
    total: np.ndarray  # pixels of each code


def _ends(codes: pa.Array) -> _Ends:
    n = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.fill_null(codes.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(counts)) - first[row]
    along = np.concatenate([[0], np.cumsum(counts)])
    at = along[1:] - along[first][row] if len(counts) else counts
    step = np.where(place % 2 == 1, -1, np.where(place + 1 < n[row], 1, 0))
    return _Ends(row, at, step, np.bincount(row, counts, len(n)).astype(np.int64))


def _merged(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ends of both codes in order: row, place, whether a and b are set after it; and each row's pixels.

    Both lists are sorted, so the stable sort is a merge.
    """
    x, y = _ends(a), _ends(b)
    total = np.maximum(x.total, y.total)
    begin = np.cumsum(total + 1) - (total + 1)
    key = np.concatenate([begin[x.row] + x.at, begin[y.row] + y.at])
    order = np.argsort(key, kind="stable")
    none = np.zeros_like
    in_a = np.cumsum(np.concatenate([x.step, none(y.step)])[order]) > 0
    in_b = np.cumsum(np.concatenate([none(x.step), y.step])[order]) > 0
    row = np.concatenate([x.row, y.row])[order]
    return row, key[order] - begin[row], in_a, in_b, total


def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    row, at, in_a, in_b, total = _merged(a, b)
    length = np.diff(at, append=0) * (in_a & in_b)  # nothing is set after a row's last end
    return pa.array(np.bincount(row, length, len(total)).astype(np.int64))


def _code(row: np.ndarray, at: np.ndarray, on: np.ndarray, total: np.ndarray) -> pa.Array:
    """Codes of what is ``on`` after each place, by row and place in order."""
    last = np.append((row[1:] != row[:-1]) | (at[1:] != at[:-1]), True)[: len(row)]
    row, at, on = row[last], at[last], on[last]
    before = np.concatenate([[False], on[:-1]])[: len(on)] & np.concatenate([[False], row[1:] == row[:-1]])[: len(on)]
    turn = on != before
    row, at = row[turn], at[turn]
    # every code begins at 0 and ends at its total, unless a set run ends there
    closed = np.zeros(len(total), bool)
    ends = np.append(row[1:] != row[:-1], True)[: len(row)]
    closed[row[ends]] = at[ends] == total[row[ends]]
    whole = np.flatnonzero(total > 0)
    tails = np.flatnonzero((total > 0) & ~closed)
    r, p = np.concatenate([whole, row, tails]), np.concatenate([np.zeros(len(whole), np.int64), at, total[tails]])
    order = np.argsort(r, kind="stable")
    r, p = r[order], p[order]
    inner = np.append(False, r[1:] == r[:-1])[: len(r)]
    counts = np.diff(p, prepend=0)[inner]
    n = np.bincount(r[inner], minlength=len(total))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(counts.astype(np.int32)))


def _union(a: pa.Array, b: pa.Array) -> pa.Array:
    row, at, in_a, in_b, total = _merged(a, b)
    return _code(row, at, in_a | in_b, total)


def _difference(a: pa.Array, b: pa.Array) -> pa.Array:
    row, at, in_a, in_b, total = _merged(a, b)
    return _code(row, at, in_a & ~in_b, total)


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    row, at, in_a, in_b, total = _merged(a, b)
    return _code(row, at, in_a & in_b, total)


def _set_runs(codes: pa.Array) -> pa.Array:
    """(start, stop) of the set runs of each code."""
    e = _ends(codes)
    stop = e.step < 0
    start = np.concatenate([[0], e.at[:-1]])[: len(e.at)]
    n = np.bincount(e.row[stop & (e.at > start)], minlength=len(e.total))
    keep = stop & (e.at > start)
    runs = pa.StructArray.from_arrays([pa.array(start[keep].astype(np.int32)), pa.array(e.at[keep].astype(np.int32))], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), runs)


def _encoded(bits: pa.Array) -> pa.Array:
    """Codes of whole masks: a run begins where a pixel differs from the one before it (from 0 at the first)."""
    n = pc.fill_null(pc.list_value_length(bits), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    on = pc.fill_null(bits.flatten(), 0).to_numpy(zero_copy_only=False) != 0
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(on)) - (np.cumsum(n) - n)[row]
    before = np.concatenate([[False], on[:-1]])[: len(on)] & (place > 0)
    turn = on != before
    whole = np.flatnonzero(n > 0)
    r, p = np.concatenate([row[turn], whole]), np.concatenate([place[turn], n[whole]])
    order = np.argsort(r, kind="stable")
    r, p = r[order], p[order]
    inner = np.append(False, r[1:] == r[:-1])[: len(r)]
    counts = p - np.where(inner, np.concatenate([[0], p[:-1]])[: len(p)], 0)
    size = np.bincount(r, minlength=len(n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(counts.astype(np.int32)))


def _boxed(codes: pa.Array, height: pa.Array) -> pa.Array:
    """(x0, y0, x1, y1), inclusive, of the set runs of each code; null without any. A run over two columns has both their ends."""
    runs = _set_runs(codes)
    n = pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    some = n > 0
    first = (np.cumsum(n) - n)[some]
    h = np.repeat(height.to_numpy(zero_copy_only=False).astype(np.int64), n)
    of = runs.flatten()
    start, last = (of.field(k).to_numpy().astype(np.int64) - k for k in (0, 1))
    within = start // h == last // h if len(h) else np.zeros(0, bool)
    at = {"x0": (np.minimum, start // h), "y0": (np.minimum, np.where(within, start % h, 0)), "x1": (np.maximum, last // h), "y1": (np.maximum, np.where(within, last % h, h - 1))}
    out = []
    for f, v in at.values():
        whole = np.zeros(len(n), np.int64)
        if len(first):
            whole[some] = f.reduceat(v, first)
        out.append(pa.array(whole.astype(np.int32)))
    return pa.StructArray.from_arrays(out, list(at), mask=pa.array(~some))


def _arrow(f, returns: str, codes: int):
    """``f`` over Arrow arrays as a function of ``codes`` columns; a row with a null code gives null."""
    kernel = (lambda a: f(a)) if codes == 1 else (lambda a, b: f(a, b))

    def column(*of: Column) -> Column:
        whole = of[0].isNotNull()
        for c in of[1:]:
            whole = whole & c.isNotNull()
        return F.when(whole, F.arrow_udf(kernel, returns)(*of))

    return column


#: Set pixels of both codes; the codes of their union, of the first without the second, and of their intersection; the
#: (start, stop) of a code's set runs. Where codes are of different sizes, the shorter one goes on with pixels not set.
shared_area = _arrow(_shared, "long", 2)
union = _arrow(_union, "array<int>", 2)
difference = _arrow(_difference, "array<int>", 2)
intersection = _arrow(_common, "array<int>", 2)
set_runs = _arrow(_set_runs, "array<struct<start:int,stop:int>>", 1)
#: The code of an array of pixels (0 or 1, column-major), a mask a row, so that no mask's pixels are shuffled or sorted; and
#: the inclusive box (x0, y0, x1, y1) of a code's set pixels, given the height, null where there are none.
encoded = _arrow(_encoded, "array<int>", 1)
boxed = _arrow(_boxed, "struct<x0:int,y0:int,x1:int,y1:int>", 2)


def with_neighbours(codes: DataFrame, other: str = "other", key: str = "mask", counts: str = "counts") -> DataFrame:
    """``codes`` with the code of the mask of the next number as ``other``; masks without one are left out.

    The sides are merged: sizes that Spark guesses from the files say nothing of codes, and one broadcast of all could be too large.
    """
    after = codes.select((F.col(key) - 1).alias(key), F.col(counts).alias(other))
    return codes.join(after.hint("merge"), key)


def annotations(codes: DataFrame, height: int, least_area: int = 1, key: str = "mask", counts: str = "counts") -> DataFrame:
    """(mask, counts, area, x, y, w, h) of masks with at least ``least_area`` set pixels, from their codes."""
    a = codes.withColumns({"area": rle_area(F.col(counts)), "_box": boxed(F.col(counts), F.lit(height))}).where(F.col("area") >= least_area)
    side = lambda lo, hi: (F.col(f"_box.{hi}") - F.col(f"_box.{lo}") + 1).cast("long")
    return a.select(key, counts, "area", F.col("_box.x0").cast("long").alias("x"), F.col("_box.y0").cast("long").alias("y"), side("x0", "x1").alias("w"), side("y0", "y1").alias("h"))


def overlap_measures(a: Column, b: Column, shared: Column) -> dict[str, Column]:
    """IoU, coverage of a by b, and of b by a, from two codes and the set pixels they share; 0 for empty denominators."""
    of_a, of_b = rle_area(a), rle_area(b)
    share = lambda d: F.when(d > 0, shared / d).otherwise(0.0)
    return {"iou": share(of_a + of_b - shared), "coverage": share(of_a), "ioy": share(of_b)}


def overlaps(pairs: DataFrame, codes: DataFrame, key: str = "mask", counts: str = "counts") -> DataFrame:
    """IoU, coverage of a by b, and of b by a, of the mask pairs (a, b), from the masks' codes."""
    side = lambda c: codes.select(F.col(key).alias(c), F.col(counts).alias(f"code_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    shared = both.withColumn("shared", shared_area(F.col("code_a"), F.col("code_b")))
    measures = overlap_measures(F.col("code_a"), F.col("code_b"), F.col("shared"))
    return shared.select("a", "b", *(m.alias(n) for n, m in measures.items()))


def matrix(left: DataFrame, right: DataFrame, key: str = "image", counts: str = "counts") -> DataFrame:
    """The overlap measures of all pairs of masks of the same image: (key, l_idx, r_idx, shared, iou, coverage, ioy)."""
    side = lambda df, s: df.select(key, F.col("idx").alias(f"{s}_idx"), F.col(counts).alias(f"{s}_code"))
    p = side(left, "l").join(side(right, "r").hint("merge"), key)
    p = p.withColumn("shared", shared_area(F.col("l_code"), F.col("r_code")))
    return p.select(key, "l_idx", "r_idx", "shared", *(m.alias(n) for n, m in overlap_measures(F.col("l_code"), F.col("r_code"), F.col("shared")).items()))


def rows(codes: DataFrame, key: str, counts: str = "counts") -> DataFrame:
    """A row for each set run: (key, start, stop)."""
    return codes.select(key, F.explode(set_runs(F.col(counts))).alias("r")).select(key, "r.start", "r.stop")


def united(codes: DataFrame, group: str, counts: str = "counts") -> DataFrame:
    """(group, runs): the union of all codes of a group, however many, as its sorted set runs (start, stop).

    Runs are sorted within a group, and one begins a new run of the union where none before it reaches that far.
    """
    w = Window.partitionBy(group).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    r = rows(codes, group, counts).distinct()
    begun = r.withColumn("new", F.when(F.coalesce(F.max("stop").over(w), F.lit(-1)) < F.col("start"), 1).otherwise(0))
    up_to = Window.partitionBy(group).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    parts = begun.withColumn("part", F.sum("new").over(up_to)).groupBy(group, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def pixels(runs: DataFrame, key: str) -> DataFrame:
    """(key, p) of a table of (key, start, stop), for what needs single pixels."""
    return runs.select(key, F.explode(F.sequence("start", F.col("stop") - 1)).alias("p"))
