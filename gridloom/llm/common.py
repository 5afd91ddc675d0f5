"""What the operators of this package share: checked shared storage, Arrow limits, Bloom filters and blob shuffles."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAVED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (``spark.checkpoint.dir``); a temporary one only on a single machine without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def _drop_saved(app: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId != app:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in _SAVED.pop(app, []):
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder, in folders by a column if given, and reads it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path, app = new_path(spark, label), spark.sparkContext.applicationId
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    if app not in _SAVED:
        _SAVED[app] = []
        atexit.register(_drop_saved, app)
    _SAVED[app].append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, label: str) -> str:
    """``label``, or with a number the first name like it that no column of ``docs`` has (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    return next(n for i in itertools.count() if (n := f"{label}{i or ''}").lower() not in taken)


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], list]]:
    """``docs`` with columns that are called like one of ``names`` under free names, and the docs' own columns of a result under their own names."""
    own: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            own[c] = free_name(docs.select(*docs.columns, *(F.lit(0).alias(n) for n in own.values())), f"_own_{c}")
    given = docs.columns
    return docs.withColumnsRenamed(own), lambda out: [out[f"`{own.get(c, c)}`"].alias(c) for c in given]


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Bounds what one Arrow batch takes to a Python worker: texts can be very long."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


def pieces(spark: SparkSession, df: DataFrame, per_piece: int = 8 << 20, least: int = 1) -> int:
    """How many parts of about ``per_piece`` bytes ``df``'s input has, as Catalyst estimates it from its files; rows of unknown size are counted, for 4 KB each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.count() * 4096
    return int(max(least, min(1 << 24, -(-size // per_piece))))


def give_back_memory() -> None:
    """Hands freed memory to the system, as a worker or driver that goes on living would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not that C library
        pass


# -- Bloom filters of what is seen once and what is seen twice ---------------------------------------

MOST_SLOTS = 1 << 27  # of one filter: 16 MB


def bloom_slots(rows: int, per_row: int = 16, least: int = 1 << 16, most: int = MOST_SLOTS) -> int:
    """Slots of a filter for ``rows`` keys: a power of two, ``most`` at the most."""
    return int(min(most, max(least, 1 << int(np.ceil(np.log2(max(1, rows) * per_row))))))


def bloom_positions(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.astype(np.uint64, copy=False)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h & np.uint64(slots - 1)).astype(np.int64), (mixed >> np.uint64(20) & np.uint64(slots - 1)).astype(np.int64)


class OnceTwice:
    """Two Bloom filters over the same keys, as bits: which slots were set at least once, and at least twice."""

    def __init__(self, slots: int):
        self.slots = slots
        self.once, self.twice = np.zeros(slots // 8, np.uint8), np.zeros(slots // 8, np.uint8)

    @staticmethod
    def _set(bits: np.ndarray, slots: np.ndarray) -> None:
        """Sets ascending slots."""
        if len(slots):
            at, first = np.unique(slots >> 3, return_index=True)
            bits[at] |= np.bitwise_or.reduceat((0x80 >> (slots & 7)).astype(np.uint8), first)

    def add(self, h: np.ndarray) -> None:
        for pos in bloom_positions(h, self.slots):
            slot, n = np.unique(pos, return_counts=True)
            before = self.once[slot >> 3] << (slot & 7).astype(np.uint8) & 0x80
            self._set(self.twice, slot[(n > 1) | (before != 0)])
            self._set(self.once, slot)

    def see(self, slots: np.ndarray) -> None:
        """Sets slots once."""
        self._set(self.once, np.unique(slots))

    def packed(self) -> bytes:
        return packed(self.once.tobytes() + self.twice.tobytes())


def merge_filters(a: bytes, b: bytes) -> bytes:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = len(x) // 2
    return (x[:n] | y[:n]).tobytes() + (x[n:] | y[n:] | (x[:n] & y[:n])).tobytes()


def suspected(h: np.ndarray, twice: np.ndarray, slots: int) -> np.ndarray:
    """Whether each key may have been added twice or more; never False for one that was."""
    out = np.ones(len(h), bool)
    for pos in bloom_positions(h, slots):
        out &= (twice[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def packed(f: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(f)


def unpacked(f: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(f)


def gather_filters(per_task: DataFrame, slots: int, fan_in: int = 16, merge: Callable[[bytes, bytes], bytes] = merge_filters, half: int | None = None) -> bytes:
    """Merges one row of filters (or of what else ``merge`` takes, in slots / 4 bytes) per task on executors, ``fan_in`` at a time.

    Rows travel ``packed``, as most of their bits are not set, and a task holds two at a time. The driver gets the merged
    one, of a fixed size, and returns it packed; with ``half`` only its first or second half.
    """

    def fold(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for f in b.column(0):
                raw = unpacked(f.as_py())
                out = raw if out is None else merge(out, raw)
        if out is not None:
            if last and half is not None:
                out = out[half * len(out) // 2 : (half + 1) * len(out) // 2]
            yield pa.RecordBatch.from_pydict({"f": pa.array([packed(out)], pa.binary())})
            del out
            give_back_memory()

    n, rows = per_task.rdd.getNumPartitions(), per_task
    while True:
        n = -(-n // fan_in)
        rows = rows.repartition(n).mapInArrow(lambda batches, last=n == 1: fold(batches, last), "f binary")
        if n == 1:
            break
    got = rows.collect()  # one row at most
    return bytes(got[0][0]) if got else packed(bytes(slots // 4 if half is None else slots // 8))


class Repeats:
    """Which keys of a table may occur twice or more, by two Bloom filters; never says no to one that does.

    Keys beyond what a filter of ``most`` slots serves are dealt by ranges of a mix of their hash, each with filters of its
    own, so that the share of false suspicions stays the same at every size. The parts are filled one after the other, from
    a copy of the hashes that each task has written by part, without a shuffle; only one part is ever held, by the driver
    while it is merged and by a worker while it is asked.
    """

    def __init__(self, df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], rows: int, per_row: int, most: int = MOST_SLOTS):
        """``hashes`` gives the 64-bit key hashes of a batch of ``df``'s rows; about ``rows`` times ``per_row`` slots are used."""
        spark = df.sparkSession
        total = bloom_slots(rows, per_row, least=min(most, 1 << 16), most=1 << 62)
        self.slots = min(total, most)
        self.bits = (total // self.slots).bit_length() - 1
        parts, slots, part_of = 1 << self.bits, self.slots, self._part

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = hashes(b)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part_of(h))], ["h", "part"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = OnceTwice(slots)
            for b in batches:
                f.add(hashes(b) if parts == 1 else b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_pydict({"f": [f.packed()]})
            del f
            give_back_memory()

        source = saved(df.mapInArrow(emit, "h long, part int"), "hashes", by="part") if parts > 1 else df
        self.twice = []
        for p in range(parts):
            mine = source.where(F.col("part") == p).select("h") if parts > 1 else source
            self.twice.append(spark.sparkContext.broadcast(gather_filters(mine.mapInArrow(fill, "f binary"), slots, half=1)))
        self.open: tuple[int, np.ndarray] | None = None  # in a task: the part asked last

    def _part(self, h: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(h), np.int32)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - self.bits)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Whether each key is suspected; for use in tasks."""
        out, part = np.zeros(len(h), bool), self._part(h)
        for p in np.unique(part).tolist():
            if self.open is None or self.open[0] != p:
                self.open = None
                self.open = p, np.frombuffer(unpacked(self.twice[p].value), np.uint8)
                del self.twice[p]._value  # read again from the executor's copy when it is needed next
            at = slice(None) if not self.bits else np.flatnonzero(part == p)
            out[at] = suspected(h[at], self.open[1], self.slots)
        return out


def id_filter(ids: DataFrame, slots: int):
    """A function that tells, as a JVM-side column, whether an id may be among ``ids``; slots bound the filter's size.

    The filter is a written one-row table that plans refer to as a scalar subquery: its bytes are in no plan's text.
    """

    def fill(batches):
        f = OnceTwice(slots)
        for b in batches:
            f.see((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(slots - 1)).astype(np.int64))
        yield pa.RecordBatch.from_pydict({"f": [f.packed()]})

    bits = unpacked(gather_filters(ids.select(F.xxhash64(F.col(ids.columns[0]))).mapInArrow(fill, "f binary"), slots, half=0))
    one = saved(ids.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.binary())})), "ids")

    def test(col):
        at = F.xxhash64(col).bitwiseAND(F.lit(slots - 1))
        byte = F.conv(F.hex(F.substring(one.scalar(), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), 7 - at % 8).cast("int")) != 0

    return test


# -- Texts -------------------------------------------------------------------------------------------

SPACE = b"\t\n\x0b\x0c\r "


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased, in UTF-8. bytes.split() splits at just these."""
    return ascii_lower(text).split()


def portions(texts: list[str], most: int = 2 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters: what is made of their words at a time stays small."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]
