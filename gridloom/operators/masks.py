"""Binary masks as run-length codes and as pixel rows.

A run-length code lists the lengths of alternating runs of 0 and 1 in column-major order, and begins with a run of 0
(of length 0 where the first pixel is set). Pixel rows (mask, p, on_) exist only inside an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def encode(pixels: DataFrame, key: str = "mask") -> DataFrame:
    """(key, counts) from pixel rows: runs by gaps and islands within each mask."""
    w = Window.partitionBy(key).orderBy("p")
    begun = pixels.select(key, "p", "on_", F.when(F.lag("on_", 1, 0).over(w) != F.col("on_"), 1).otherwise(0).alias("new"))
    runs = begun.withColumn("run", F.sum("new").over(w)).groupBy(key, "run").agg(F.count("*").cast("int").alias("n"))
    packed = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "n"))).alias("runs"))
    lengths = F.transform("runs", lambda r: r["n"])
    return packed.select(key, F.when(F.element_at("runs", 1)["run"] == 0, lengths).otherwise(F.concat(F.array(F.lit(0)), lengths)).alias("counts"))


def rle_area(counts: Column) -> Column:
    """Set pixels: the runs at odd places."""
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0), lambda a, c: (a + c).cast("int"))


def pack_counts(counts: Column) -> Column:
    return F.array_join(F.transform(counts, lambda c: c.cast("string")), " ")


def tight_box(on: DataFrame, height: int, key: str = "mask") -> DataFrame:
    """Inclusive box (x0, y0, x1, y1) of the set pixels' rows of each mask; masks without any have no row."""
    x, y = F.expr(f"p div {height}"), F.expr(f"p % {height}")
    return on.groupBy(key).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def stability(values: DataFrame, key: str, value: str, threshold: float, offset: float) -> DataFrame:
    """Pixels over threshold + offset, per pixels over threshold - offset (null where there are none)."""
    n = lambda t: F.count(F.when(F.col(value) > t, 1))
    low = n(threshold - offset)
    return values.groupBy(key).agg(F.when(low > 0, n(threshold + offset) / low).alias("stability"))


def soft_scores(values: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Soft IoU with 1 added to both sides, and Dice with 1 added, of two soft masks."""
    inter, both = F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) + F.col(b))
    return values.groupBy(key).agg(((inter + 1) / (both - inter + 1)).alias("soft_iou"), ((2 * inter + 1) / (both + 1)).alias("dice"))


def pooled(pixels: DataFrame, side: int, cell: int, key: str = "mask") -> DataFrame:
    """Mean of square cells: the mask on a coarser grid."""
    x, y = F.expr(f"(p div {side}) div {cell}"), F.expr(f"(p % {side}) div {cell}")
    return pixels.groupBy(key, x.alias("cx"), y.alias("cy")).agg(F.avg(F.col("on_").cast("double")).alias("share"))


def nearest_resize(pixels: DataFrame, side: int, new_side: int, key: str = "mask") -> DataFrame:
    """Nearest-neighbour resize: each new pixel takes the value at floor(place * side / new_side)."""
    axis = F.sequence(F.lit(0), F.lit(new_side - 1))
    old = lambda c: F.expr(f"{c} * {side} div {new_side}")
    new = pixels.sparkSession.range(1).select(F.explode(axis).alias("nx")).select("nx", F.explode(axis).alias("ny")).select((F.col("nx") * new_side + F.col("ny")).alias("new_p"), (old("nx") * side + old("ny")).alias("p"))
    return pixels.join(F.broadcast(new), "p").select(key, F.col("new_p").alias("p"), "on_")


def bilinear_resize(pixels: DataFrame, side: int, new_side: int, key: str = "mask") -> DataFrame:
    """Masks at another size: values between pixel centres, set where they are over half of the mask's largest."""
    at = [min(max((k + 0.5) * side / new_side - 0.5, 0.0), side - 1.0) for k in range(new_side)]
    taps = [(k, min(int(v) + d, side - 1), (v - int(v)) if d else 1 - (v - int(v))) for k, v in enumerate(at) for d in (0, 1)]
    axis = pixels.sparkSession.createDataFrame(taps, "k int, old int, w double")  # two taps for each new row or column
    x, y = (axis.select(F.col("k").alias(f"n{c}"), F.col("old").alias(c), F.col("w").alias(f"w{c}")) for c in "xy")
    px = pixels.select(key, F.expr(f"p div {side}").cast("int").alias("x"), F.expr(f"p % {side}").cast("int").alias("y"), "on_")
    v = px.join(F.broadcast(x), "x").join(F.broadcast(y), "y").groupBy(key, "nx", "ny").agg(F.sum(F.col("on_") * F.col("wx") * F.col("wy")).alias("v"))
    top = v.groupBy(key).agg(F.max("v").alias("top"))
    return v.join(top, key).select(key, (F.col("nx") * new_side + F.col("ny")).alias("p"), (F.round("v", 9) > F.round(F.col("top") / 2, 9)).cast("int").alias("on_"))


def annotations(pixels: DataFrame, height: int, least_area: int = 1, key: str = "mask") -> DataFrame:
    """(mask, counts, area, x, y, w, h) of masks with at least ``least_area`` set pixels: the code, and the box that holds them."""
    box = tight_box(pixels.where("on_ = 1"), height, key)
    codes = encode(pixels, key).withColumn("area", rle_area(F.col("counts"))).where(F.col("area") >= least_area)
    return codes.join(box, key).select(key, "counts", "area", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))
