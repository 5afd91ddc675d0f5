"""Archives of packed arrays (.npz), one for each image: a data source that writes and scans hierarchies of masks."""

from __future__ import annotations

import io
import itertools
import json
import urllib.parse
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: A mask: its image, its kind (such as divide or conquer), its number, that of the mask that holds it (-1: none), and its run-length code.
SCHEMA = "image string, kind string, mask_idx int, divide_idx int, counts array<int>"
_ARROW = pa.schema([("image", pa.string()), ("kind", pa.string()), ("mask_idx", pa.int32()), ("divide_idx", pa.int32()), ("counts", pa.list_(pa.int32()))])
_COMMITTED = "committed.txt"


class Folder(WriterCommitMessage):
    """What a task has written, and from how many images."""

    def __init__(self, name: str, images: int):
        self.name, self.images = name, images


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def pack(batch: pa.RecordBatch) -> bytes:
    """An archive of one image's masks: for each kind its numbers, holders and codes, the codes one after the other with their lengths."""
    arrays = {}
    kinds = np.array(batch.column("kind").to_pylist(), object)
    for kind in dict.fromkeys(kinds.tolist()):
        rows = batch.filter(pa.array(kinds == kind))
        counts = rows.column("counts")
        arrays[f"{kind}/mask_idx"] = rows.column("mask_idx").to_numpy(zero_copy_only=False)
        arrays[f"{kind}/divide_idx"] = rows.column("divide_idx").to_numpy(zero_copy_only=False)
        arrays[f"{kind}/lengths"] = np.diff(counts.offsets.to_numpy())
        arrays[f"{kind}/counts"] = counts.flatten().to_numpy(zero_copy_only=False)
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(image: str, file, kinds: set[str] | None) -> Iterator[pa.RecordBatch]:
    """The masks of an archive, of the given kinds or of all. Arrays of other kinds are not read from the file."""
    with np.load(file, allow_pickle=False) as z:
        for kind in dict.fromkeys(n.split("/")[0] for n in z.files):
            if kinds is None or kind in kinds:
                idx, parent, lengths, counts = (z[f"{kind}/{c}"] for c in ("mask_idx", "divide_idx", "lengths", "counts"))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                cols = [pa.array([image] * len(idx), pa.string()), pa.array([kind] * len(idx), pa.string()), pa.array(idx, pa.int32()), pa.array(parent, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts, pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, files: int, kinds: set[str] | None):
        self.path, self.files, self.kinds = path, files, kinds

    def partitions(self) -> list[Files]:
        system, root = _opened(self.path)
        folders = [root]
        if system.get_file_info(f"{root}/{_COMMITTED}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{_COMMITTED}") as f:
                folders = [f"{root}/{line}" for line in f.read().decode().splitlines()]
        names = [i.path for d in folders for i in system.get_file_info(fs.FileSelector(d)) if i.path.endswith(".npz")]
        return [Files(names[k : k + self.files]) for k in range(0, len(names), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        for name in partition.names:
            with system.open_input_file(name) as f:
                yield from unpack(urllib.parse.unquote(name.rsplit("/", 1)[-1][: -len(".npz")]), f, self.kinds)


class _Writer(DataSourceArrowWriter):
    """Each task writes a folder of its own; the commit names the folders of the tasks that count, and readers open no other."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        system, root = _opened(self.path)
        name, images = f"part-{uuid.uuid4().hex}", 0
        system.create_dir(f"{root}/{name}", recursive=True)
        # a batch's rows of one image are sliced out; what may go on in the next batch is held
        slices = (b.slice(i, j - i) for b in iterator for i, j in _runs(b))
        for image, parts in itertools.groupby(slices, lambda s: s.column("image")[0].as_py()):
            whole = pa.Table.from_batches([p.select(_ARROW.names) for p in parts]).combine_chunks().to_batches()[0]
            with system.open_output_stream(f"{root}/{name}/{urllib.parse.quote(image, safe='')}.npz") as f:
                f.write(pack(whole))
            images += 1
        return Folder(name, images)

    def commit(self, messages: list[Folder | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{_COMMITTED}") as f:
            f.write("".join(f"{m.name}\n" for m in messages if m is not None and m.images).encode())

    def abort(self, messages: list[Folder | None]) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_dir(f"{root}/{m.name}")


def _runs(b: pa.RecordBatch) -> list[tuple[int, int]]:
    """Where rows of the same image begin and end."""
    image = b.column("image").to_pylist()
    cut = [0, *(i for i in range(1, len(image)) if image[i] != image[i - 1]), len(image)]
    return [p for p in itertools.pairwise(cut) if p[0] < p[1]]


class ArrayArchives(DataSource):
    """format("npz"): option path; files, how many archives a task reads; and kinds, a JSON list of the kinds of masks to read."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kinds = self.options.get("kinds")
        return _Reader(self.options["path"], int(self.options.get("files", 256)), None if kinds is None else set(json.loads(kinds)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_archives(masks: DataFrame, path: str) -> None:
    """An archive for each image of ``masks`` (SCHEMA); images without a mask have none. Masks without an image fail the query.

    The masks of an image meet in one task, in the order of their numbers; a task holds one image's masks at a time.
    ``path`` is a new folder that all machines share.
    """
    masks.sparkSession.dataSource.register(ArrayArchives)
    image = F.coalesce("image", F.raise_error(F.lit("a mask without an image")).cast("string"))
    rows = masks.select(image.alias("image"), "kind", F.col("mask_idx").cast("int").alias("mask_idx"), F.col("divide_idx").cast("int").alias("divide_idx"), F.col("counts").cast("array<int>").alias("counts"))
    rows.repartition("image").sortWithinPartitions("image", "mask_idx", "kind").write.format("npz").option("path", path).mode("append").save()


def read_archives(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """The masks of all archives in ``path`` (SCHEMA), of the given ``kinds`` or of all. The reader skips the arrays of other kinds.

    Kinds are an option of the scan, not a filter that Spark pushes: scans of one table with different filters would share what
    was pushed last.
    """
    spark.dataSource.register(ArrayArchives)
    scan = spark.read.format("npz").option("path", path)
    return (scan if kinds is None else scan.option("kinds", json.dumps(kinds))).load()
