"""What keeps queries whole at size: plans that do not grow by rows, and kernels over many groups at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import masks as M
from gridloom.operators import runs as R
from gridloom.plans import reference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["v8_error_counts", "mask_run_algebra", "mask_subtraction", "k1_mask_annotations", "mask_union", "w16_rle_encode", "w17_rle_decode", "a7_rle_area", "a2_a3_a4_mask_overlaps"])
def test_no_pixel_of_a_mask_is_shuffled_and_no_side_broadcast(spark, name):
    plan = reference.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    for part in plan.split("== Physical Plan ==")[1:]:
        assert "sequence(0, 63" not in part.split("Generate explode")[-1].split("\n")[0] and "Generate explode([0,1,2,3,4" not in part
        assert "BroadcastHashJoin" not in part
        assert "on_#" not in part


def test_codes_of_whole_masks_equal_those_of_pixel_rows(spark):
    rng = np.random.default_rng(3)
    masks = {k: (rng.random(24) < k / 9).astype(int).tolist() for k in range(10)}
    bits = spark.createDataFrame([(k, v) for k, v in masks.items()], "mask long, bits array<int>")
    pixels = spark.createDataFrame([(k, p, b) for k, v in masks.items() for p, b in enumerate(v)], "mask long, p int, on_ int")
    codes = bits.select("mask", R.encoded(F.col("bits")).alias("counts"))
    assert sorted(codes.collect()) == sorted(M.encode(pixels).collect())
    assert sorted(map(tuple, R.annotations(codes, 4).collect())) == sorted(map(tuple, M.annotations(pixels, 4).collect()))
    assert R._encoded(pa.array([[], None, [1], [0]], pa.list_(pa.int32()))).to_pylist() == [[], [], [0, 1], [1]]


def _duck(folder):
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "embeddings", "part", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["g20_gaussian_smooth", "k8_label_images", "t8_spaced_peaks"])
def test_last_image_cut_within_a_row_and_ties_of_unit_vectors(spark, tmp_path, name):
    import duckdb

    rng = np.random.default_rng(1)
    v = rng.normal(size=(256, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = pa.table({"vec_id": pa.array(np.arange(256)), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array(np.arange(256) % 7)})
    import pyarrow.parquet as pq

    pq.write_table(rows, f"{tmp_path}/embeddings.parquet")
    duckdb.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = duckdb.sql(reference.ORACLE[name])
    got = reference.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_entries_that_round_to_zero_keep_their_sign(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = pa.table({"vec_id": pa.array([0]), "embedding": pa.array([[1.0, -1e-8, 1e-8, 0.0]], pa.list_(pa.float32())), "label": pa.array([0])})
    pq.write_table(rows, f"{tmp_path}/embeddings.parquet")
    unit = reference.QUERIES["l2_normalize_all"](spark, str(tmp_path)).first()["unit"]
    assert [str(x) for x in unit] == ["1.0", "-0.0", "0.0", "0.0"]  # as the SQL gives them


def test_kernels_take_groups_side_by_side():
    from gridloom.operators import match as K
    from gridloom.operators import suppress as D

    rng = np.random.default_rng(5)
    cost = np.round(rng.random((40, 3, 5)), 1)  # many ties
    owner = K.assign_all(cost)
    for c, o in zip(cost, owner, strict=True):
        assert K.assign(c) == sorted((int(a), j) for j, a in enumerate(o) if a >= 0)
    iou = np.round(rng.random((40, 3, 4)), 1)
    rows, cols, _ = K.paired(iou, 0.3)
    for v, r, c in zip(iou, rows, cols, strict=True):
        assert K.greedy_pairs(v, 0.3) == [(int(a), int(b)) for a, b in zip(r, c, strict=True) if a >= 0]
    sizes, truths = rng.integers(1, 4, 500), rng.integers(0, 4, 500)
    parts = list(D.stacks(sizes, truths, width=40))
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and len(parts) <= 12  # calls follow the shapes, not the groups
    assert all(len(set(zip(sizes[p].tolist(), truths[p].tolist(), strict=True))) == 1 for p in parts)


def test_one_ranking_serves_all_cells(spark, monkeypatch):
    """Curves over packed bits, cut into many ranges, equal those of a row for each detection, size and threshold."""
    from gridloom.operators import detection_eval as V
    from gridloom.operators import metrics as E

    rng = np.random.default_rng(2)
    lo = rng.integers(0, 60, (300, 2))
    rows = [(int(k // 6), "ab"[k % 2], int(k % 6), float(k % 5), *map(float, lo[k]), float(lo[k, 0] + 40), float(lo[k, 1] + 30 + k % 90), k % 7 == 0) for k in range(300)]
    truth = spark.createDataFrame(rows, "image long, category string, idx long, score double, x0 double, y0 double, x1 double, y1 double, iscrowd boolean")
    det = truth.drop("iscrowd").withColumn("x0", F.col("x0") + F.col("idx") % 4).withColumn("x1", F.col("x1") + F.col("idx") % 4)
    want = V.summary(*V.precision_and_recall(V.matches_by_area(det, truth), V.truths_by_area(truth)))
    monkeypatch.setattr(E, "RANGE", 40)
    got = V.evaluate(det, truth)
    near = lambda df: {r["statistic"]: round(r["value"], 9) for r in df.collect()}
    assert near(got) == near(want)


@pytest.mark.parametrize("name", ["v5_track_stream", "v7_reseed_stream"])
def test_triggers_are_written_by_many_tasks(spark, monkeypatch, name):
    from gridloom.plans import q_match

    folders, new_folder = [], q_match.new_folder
    monkeypatch.setattr(q_match, "new_folder", lambda s, label: folders.append(new_folder(s, label)) or folders[-1])
    batch = {"v5_track_stream": "v5_track_assignment", "v7_reseed_stream": "v7_reseed_fold"}[name]
    got = reference.QUERIES[name](spark, SF)
    want = reference.QUERIES[batch](spark, SF).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    import glob

    assert len(glob.glob(f"{folders[0]}/in/*.parquet")) > 3


def test_views_are_drawn_once_an_image(spark):
    from gridloom.operators import temporal as T

    rows = spark.range(12).selectExpr("id div 4 AS image", "id % 4 AS idx", "1d AS x0", "2d AS y0", "3d AS x1", "4d AS y1")
    views = T.synthetic_clips(rows, 2, 20.0, 640.0)
    assert "Window" in views._jdf.queryExecution().optimizedPlan().toString() and views.count() == 24
    assert views.select("image", "frame", "x0", "y0").distinct().count() == 6


def test_scanned_annotations_are_told_once_and_not_dealt_by_category(spark):
    plan = reference.QUERIES["s1_document_scan"](spark, SF)._jdf.queryExecution()
    assert "hashpartitioning(category_id" not in plan.executedPlan().toString()
    assert plan.optimizedPlan().toString().count(", $, ArrayType(ArrayType(DoubleType") == 1
