"""Files in and out, on small hand-made fixtures."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import annotations as A
from gridloom.operators import masks as M
from gridloom.operators import runs as R
from gridloom.sources import annotation_files as S
from gridloom.sources import array_archives as Z
from gridloom.sources import catalog, label_images, storage
from gridloom.sources import shards as H
from gridloom.streaming import clips as C


def test_documents(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 3}, {"id": 2, "file_name": "b.jpg", "width": 4, "height": 3}],
        "annotations": [{"id": 7, "image_id": 1, "category_id": 1, "area": 2.0, "bbox": [0, 0, 2, 1], "segmentation": {"size": [3, 4], "counts": "x"}}, {"id": 7, "image_id": 1, "category_id": 1, "iscrowd": 1}],
        "categories": [{"id": 1, "name": "thing"}],
    }
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(doc))
    got = S.read_documents(spark, str(tmp_path / "in"))
    assert got["images"].count() == 4 and got["categories"].count() == 1
    assert sorted(r.iscrowd for r in got["annotations"].collect()) == [0, 0, 1, 1]
    assert [r.n for r in S.duplicate_ids(got["annotations"]).collect()] == [4]
    numbered = A.global_row_number(got["annotations"].drop("id"), ["file", "iscrowd"], "id")
    assert sorted(r.id for r in numbered.collect()) == [1, 2, 3, 4]
    S.write_document(got["images"].drop("file").distinct(), numbered.drop("file"), str(tmp_path / "out"))
    back = {r["id"]: r["annotations"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert len(back[1]) == 4 and back[2] is None


def test_shards(spark, tmp_path):
    rows = [("k1", '{"a": 1}', b"\x00\xff"), ("k2", '{"a": 2}', b"")]
    (tmp_path / "part-3.tsv").write_text("".join(f"{k} \t{j}\t{base64.b64encode(b).decode()}\n" for k, j, b in rows))
    got = H.read_tsv(spark, str(tmp_path / "part-3.tsv"))
    assert sorted((r.shard, r.key, r.json, bytes(r.image)) for r in got.collect()) == [("part-3", k, j, b) for k, j, b in rows]
    assert got.select(H.shard_number(F.concat("shard", F.lit(".tsv"))).alias("n")).first().n == 3
    labels = spark.createDataFrame([("k1", "new"), ("k2", "too")], "key string, json string")
    assert sorted((r.key, r.json) for r in H.with_labels(got, labels).collect()) == [("k1", "new"), ("k2", "too")]
    with pytest.raises(Exception, match="unknown key in the labels: k2"):  # no row is lost unseen
        H.with_labels(got, labels.where("key = 'k1'")).collect()
    lines = spark.createDataFrame([("f", 0, "ab"), ("f", 1, "é"), ("f", 2, "")], "f string, i int, t string")
    assert [r.offset for r in H.line_offsets(lines, "i", "t", "f").orderBy("i").collect()] == [0, 3, 6]


def test_listing(spark, tmp_path):
    for d, n in (("cat", "sa_0012.jpg"), ("dog", "7.png")):
        (tmp_path / d).mkdir()
        (tmp_path / d / n).write_bytes(b"xyz")
    got = H.list_files(spark, str(tmp_path))
    assert [(r.folder, r.stem, r.length) for r in got.collect()] == [("cat", "sa_0012", 3), ("dog", "7", 3)]
    assert [r.i for r in got.select(H.file_id(F.col("path")).alias("i")).collect()] == [12, 7]


def test_run_lengths(spark):
    masks = {1: [0] * 12, 2: [1] * 12, 3: [1] + [0] * 11, 4: [0, 1] * 6, 5: [0] * 11 + [1]}
    px = spark.createDataFrame([(k, p, v) for k, m in masks.items() for p, v in enumerate(m)], "mask int, p int, on_ int")
    codes = M.encode(px)
    got = {r.mask: list(r.counts) for r in codes.collect()}
    assert got == {1: [12], 2: [0, 12], 3: [0, 1, 11], 4: [1] * 12, 5: [11, 1]}
    assert sorted((r.mask, r.p) for r in R.pixels(R.rows(codes, "mask"), "mask").collect()) == sorted((k, p) for k, m in masks.items() for p, v in enumerate(m) if v)
    assert {r.mask: r.a for r in codes.select("mask", M.rle_area(F.col("counts")).alias("a")).collect()} == {k: sum(m) for k, m in masks.items()}
    box = {r.mask: (r.x0, r.y0, r.x1, r.y1) for r in M.tight_box(px.where("on_ = 1"), 3).collect()}
    assert box[3] == (0, 0, 0, 0) and box[5] == (3, 2, 3, 2) and 1 not in box


def test_streams_agree_with_batch(spark, tmp_path):
    from gridloom.operators import temporal as T

    rows = [(c, f, i, float(10 * i + f), 0.0, 10.0 * i + f + 8, 8.0) for c in range(3) for f in range(6) for i in range(1 + (c + f) % 3)]
    df = spark.createDataFrame(rows, "clip long, frame long, idx long, x0 double, y0 double, x1 double, y1 double")
    for k in range(3):  # a file for each two frames, read one a trigger
        df.where(F.expr(f"frame div 2 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = C.run_to_end(C.stream_tracks(stream), str(tmp_path / "s"), timers=True)
    key = lambda r: (r.clip, r.frame, r.idx)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.assign_tracks(df).collect()))


def test_unknown_keys_are_errors(spark, tmp_path):
    doc = {"image": {"id": 1}, "annotations": [{"id": 1, "image_id": 1, "category_id": 9, "keypoints": [1, 2, 2]}], "categories": [{"id": 1, "name": "thing"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = S.read_documents(spark, str(tmp_path / "a.json"), per_image=True)
    with pytest.raises(Exception, match="unknown category: 9"):
        S.image_records(got).collect()
    doc["categories"].append({"id": 9, "name": "other"})
    (tmp_path / "b.json").write_text(json.dumps(doc))
    row = S.image_records(S.read_documents(spark, str(tmp_path / "b.json"), per_image=True)).first()
    assert [(a.category, a.keypoints) for a in row.annotations] == [("other", [1.5, 2.5, 2.0])]
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert sorted(A.must_join(left.where("k is not null"), right, "k", "key").collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="unknown key: null"):
        A.must_join(left, right, "k", "key").collect()
    ids = spark.createDataFrame([(0, 2), (1, 5)], "pos int, id long")
    assert sorted((r.pos, r.v) for r in A.look_up(right, "k", ids).collect()) == [(0, "y"), (1, None)]
    with pytest.raises(Exception, match="unknown k: 5"):
        A.look_up(right, "k", ids, strict=True).collect()


def test_tables_are_published_once(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(10)
    assert storage.publish(rows, path).count() == 10 and storage.publish(rows.limit(1), path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_table_that_another_writer_published_first_is_the_one_that_is_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    slow = spark.range(3)
    write = type(slow.write).parquet

    def meanwhile(self, to, *a, **kw):
        write(self, to, *a, **kw)
        if f"{path}/rows-" in to and not (tmp_path / "t" / "current").exists():
            spark.range(10).write.format("parquet").save(f"{path}/rows-other")
            (tmp_path / "t" / "current").write_text("rows-other")

    monkeypatch.setattr(type(slow.write), "parquet", meanwhile)
    assert storage.publish(slow, path).count() == 10
    assert fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)) and sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["current", "rows-other"]


def test_batches_scan_files_once_and_go_on(spark, tmp_path):
    source, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(source)

    def work(df):
        seen.append(df.count())
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return df.selectExpr("id * 2 as id")

    with pytest.raises(Exception, match="stopped"):
        storage.in_batches(spark, source, "id long", work, out, files=1)
    got = storage.in_batches(spark, source, "id long", work, out, files=1)
    assert sorted(r.id for r in got.collect()) == list(range(0, 60, 2))
    assert seen == [10, 10, 10, 10, 0]  # the stopped batch once more, and an empty table for the result's columns
    spark.range(30, 40).coalesce(1).write.mode("append").parquet(source)
    assert storage.in_batches(spark, source, "id long", work, out, files=1).count() == 40


def test_rows_are_fetched_by_their_offsets(spark, tmp_path):
    rows = [(f"k{i}", json.dumps({"n": i}), bytes([i % 256]) * (i % 700)) for i in range(300)]
    for part in range(2):
        (tmp_path / f"part-{part}.tsv").write_text("".join(f"{k}\t{j} \t{base64.b64encode(b).decode()}\n" for k, j, b in rows[part * 150 : part * 150 + 150]))
    index = H.file_index(spark, str(tmp_path)).cache()
    paths = sorted({r.path for r in index.collect()})
    size = {r.path: r.offset + r.bytes + 1 for r in index.collect() if r.row == 149}
    assert {p.replace("file:///", "file:/"): n for p, n in size.items()} == {f"file:{tmp_path}/part-{p}.tsv": (tmp_path / f"part-{p}.tsv").stat().st_size for p in range(2)}
    wanted = spark.createDataFrame([(paths[1], 0), (paths[0], 149), (paths[0], 7), (paths[0], 7)], "path string, row int")
    got = H.fetch_rows(index, wanted)
    assert sorted((r.key, r.json, bytes(r.image)) for r in got.collect()) == sorted([rows[150], rows[149], rows[7], rows[7]])
    asked = sum(r.bytes for r in index.join(wanted, ["path", "row"]).collect())
    assert asked < 0.02 * sum(size.values())
    assert [r.row for r in H.fetch_rows(index, wanted.limit(0)).collect()] == []
    with pytest.raises(Exception, match="unknown row"):
        H.fetch_rows(index, spark.createDataFrame([(paths[0], 999)], "path string, row int")).collect()
    with pytest.raises(Exception, match="unknown key in the labels: k9"):
        H.with_labels(H.read_tsv(spark, str(tmp_path)), spark.createDataFrame([(f"k{i}", "x") for i in range(300) if i != 9], "key string, json string")).collect()


def test_segmentations_of_both_kinds(spark, tmp_path):
    kinds = [None, [], [[0, 0, 4, 0, 4, 3]], [[0, 0, 4, 0, 4]], [[1, 2, 3, 4], [0, 0, 4, 0, 4, 3.5]], {"size": [3, 4], "counts": "ab1"}, {"size": [3, 4], "counts": [2, 3, 7]}, "odd", {"size": None}]
    ann = [{"id": i, "image_id": 1, "category_id": 1, **({} if i == 0 else {"segmentation": s})} for i, s in enumerate(kinds)] + [{"id": 50, "image_id": 1, "category_id": 1, "segmentation": None}]
    (tmp_path / "d.json").write_text(json.dumps({"images": [{"id": 1}], "annotations": ann, "categories": [{"id": 1, "name": "thing"}]}))
    got = {a["id"]: a["segmentation"] for a in S.image_records(S.read_documents(spark, str(tmp_path / "d.json"))).first()["annotations"]}
    assert sorted(got) == [0, 1, 2, 4, 5, 6, 7, 8, 50] and got[0] is got[50] is None  # 3 has no polygon left
    assert got[1]["polygons"] == [] and got[2]["polygons"] == [[0, 0, 4, 0, 4, 3]] and got[4]["polygons"] == [[0, 0, 4, 0, 4, 3.5]]
    assert got[5]["counts"] == "ab1" and got[5]["runs"] is None and got[5]["size"] == [3, 4] and got[5]["polygons"] is None
    assert got[6]["runs"] == [2, 3, 7] and got[6]["counts"] is None
    assert set(got[7].asDict().values()) == set(got[8].asDict().values()) == {None}


def test_results_of_unknown_videos_fail(spark):
    videos = spark.createDataFrame([(1,), (2,)], "video_id long")
    results = spark.createDataFrame([(2, [1.0, None, 0.0, 3.0]), (1, [None])], "video_id long, areas array<double>")
    got = [(r.id, r.video_id, r.avg_area, r.iscrowd) for r in S.load_results(results, videos, ["video_id"]).orderBy("id").collect()]
    assert got == [(1, 1, 0.0, 0), (2, 2, 2.0, 0)]
    with pytest.raises(Exception, match="unknown video of a result: 2"):
        S.load_results(results, videos.where("video_id = 1"), ["video_id"]).collect()


def test_archives_of_masks(spark, tmp_path):
    rows = [("a/b c", "divide", 0, -1, [0, 3]), ("a/b c", "conquer", 1, 0, []), ("a/b c", "conquer", 2, 0, [1, 2]), ("é", "conquer", 0, -1, [5])] + [(f"i{k}", "divide", 0, -1, [k]) for k in range(20)]
    path = str(tmp_path / "z")
    Z.write_archives(spark.createDataFrame(rows, Z.SCHEMA), path)
    told = lambda df: sorted((r.image, r.kind, r.mask_idx, r.divide_idx, list(r.counts)) for r in df.collect())
    assert told(Z.read_archives(spark, path)) == sorted(rows)
    assert told(Z.read_archives(spark, path, ["conquer"])) == sorted(r for r in rows if r[1] == "conquer")
    assert told(Z.read_archives(spark, path, [])) == []
    (tmp_path / "z" / "part-lost").mkdir()
    (tmp_path / "z" / "part-lost" / "x.npz").write_bytes(b"of a task that did not count")
    assert len(told(Z.read_archives(spark, path))) == len(rows)
    with pytest.raises(Exception, match="a mask without an image"):
        Z.write_archives(spark.createDataFrame([(None, "divide", 0, -1, [1])], Z.SCHEMA), str(tmp_path / "y"))


def test_label_images():
    grid = np.array([[0, 1, 65535], [256, 257, 7]])
    png = label_images.encode_labels(grid)
    assert (label_images.decode_labels(png) == grid).all() and label_images.decode_labels(label_images.encode_labels(np.zeros((2, 0), int))).shape == (2, 0)
    for bad in (b"x" + png, png[:40] + b"\xff" + png[41:], png.replace(bytes([16, 0, 0, 0, 0]), bytes([8, 0, 0, 0, 0]), 1)):
        with pytest.raises(ValueError):
            label_images.decode_labels(bad)
    with pytest.raises(ValueError):
        label_images.encode_labels(np.array([[70000]]))


def test_catalog(spark):
    catalog.register_dataset("numbers", lambda s, n=3: s.range(n), classes=["a"])
    catalog.register_mapper("doubled")(lambda df: df.selectExpr("id * 2 as id"))
    assert catalog.load_dataset(spark, "numbers", n=5).count() == 5 and catalog.metadata("numbers") == {"classes": ["a"]}
    assert [r.id for r in catalog.load_dataset(spark, "numbers", mapper="doubled").collect()] == [0, 2, 4]
    catalog.as_views(spark, ["numbers"])
    assert spark.sql("select count(*) from numbers").first()[0] == 3
    with pytest.raises(ValueError):
        catalog.register_dataset("numbers", spark.range)
    with pytest.raises(KeyError):
        catalog.load_dataset(spark, "letters")


def test_tsv_and_proposals_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "{}", b"\x00" * 200), ("k2", "{}", b"")], "key string, json string, image binary")
    H.write_tsv(rows, str(tmp_path / "tsv"))
    assert sorted((r.key, bytes(r.image)) for r in H.read_tsv(spark, str(tmp_path / "tsv")).collect()) == [("k1", b"\x00" * 200), ("k2", b"")]
    old = spark.createDataFrame([("7", [[0.0, 1.0, 2.0, 3.0]], [0.5])], "indexes string, boxes array<array<double>>, scores array<double>")
    old.write.parquet(str(tmp_path / "old"))
    assert [tuple(r) for r in S.read_proposals(spark, str(tmp_path / "old")).collect()] == [("7", 0, 0.5, 0.0, 1.0, 2.0, 3.0)]


def test_complete_stream_keeps_its_last_result(spark, tmp_path):
    for k in range(3):
        spark.range(k, k + 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = C.run_to_end(stream.groupBy("id").count(), str(tmp_path / "s"), "complete")
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2), (2, 2), (3, 1)]
