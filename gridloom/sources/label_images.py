"""Label maps as 16-bit greyscale PNG images, and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.suppress import bucketed, in_groups

# Fixed values of the format: its first bytes, and a header's depth (16 bits), kind (grey), and plain methods.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY16 = bytes([16, 0, 0, 0, 0])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_labels(labels: np.ndarray) -> bytes:
    """A PNG image of labels from 0 to 65535; lines are not filtered."""
    if labels.size and (labels.min() < 0 or labels.max() > 65535):
        raise ValueError("labels must lie from 0 to 65535")
    h, w = labels.shape
    lines = b"".join(b"\0" + line.astype(">u2").tobytes() for line in labels)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">II", w, h) + GREY16) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def decode_labels(png: bytes) -> np.ndarray:
    """The labels of an image that ``encode_labels`` made; any other kind of image, and a damaged one, is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, size = 8, [], None
    while at < len(png):
        (n,), kind, body = struct.unpack_from(">I", png, at), png[at + 4 : at + 8], png[at + 8 : at + 8 + struct.unpack_from(">I", png, at)[0]]
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
            if body[8:] != GREY16:
                raise ValueError("not a 16-bit grey image")
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if size is None:
        raise ValueError("a PNG image without a header")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], 1 + 2 * size[0])
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return np.ascontiguousarray(lines[:, 1:]).view(">u2").astype(np.int64)


def label_images(labels: DataFrame) -> DataFrame:
    """(image, png) from (image, y, x, label): a PNG image of each; cells without a row are 0."""

    def many(t: pa.Table) -> pa.Table:
        t, starts = in_groups(t, ["image"], [])
        image, y, x, label = (t.column(c).to_numpy() for c in ("image", "y", "x", "label"))
        names, pngs = [], []
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            grid = np.zeros((int(y[i:j].max()) + 1, int(x[i:j].max()) + 1), np.int64)
            grid[y[i:j], x[i:j]] = label[i:j]
            names.append(int(image[i]))
            pngs.append(encode_labels(grid))
        return pa.table({"image": pa.array(names, pa.int64()), "png": pa.array(pngs, pa.binary())})

    long = [F.col(c).cast("long").alias(c) for c in ("image", "y", "x", "label")]
    return bucketed(labels.select(*long), "image").groupBy("_bucket").applyInArrow(many, "image long, png binary")


def read_label_images(images: DataFrame) -> DataFrame:
    """(image, y, x, label) of every cell of (image, png)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, png in zip(b.column("image").to_pylist(), b.column("png"), strict=True):
                grid = decode_labels(png.as_py())
                y, x = np.divmod(np.arange(grid.size), max(1, grid.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(grid.size, image)), pa.array(y), pa.array(x), pa.array(grid.ravel())], ["image", "y", "x", "label"])

    return images.select(F.col("image").cast("long").alias("image"), "png").mapInArrow(read, "image long, y long, x long, label long")
