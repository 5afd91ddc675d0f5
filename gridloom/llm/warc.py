"""WARC archives of individually Zstandard-compressed records, with a dictionary built from the archive's own records."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bloom_slots, id_filter, new_path, saved, small_batches

# Fixed values of the formats: the WARC dictionary frame's magic number, and an empty skippable frame, which ends each file.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
URN, NO_ID = "urn:x-page:", "urn:x-page-without-id:"


def _urn(page_id) -> str:
    """The record id of a page: its id with all but letters, digits and ``_.-~`` as %XX; a null id has a name of its own."""
    return f"<{NO_ID}>" if page_id is None else f"<{URN}{urllib.parse.quote(str(page_id), safe='')}>"


def _page_id(urn: str) -> str | None:
    return None if urn == f"<{NO_ID}>" else urllib.parse.unquote(urn[len(URN) + 1 : -1])



def _record(kind: str, page_id, url: str | None, date: str, digest: str, refers_to, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes], dictionary_bytes: int = 65536, level: int = 3) -> bytes:
    """One archive: the dictionary, built from all of ``records``, in a leading skippable frame, then a frame per record."""
    size = min(dictionary_bytes, max(1024, sum(map(len, records)) // 20))
    try:
        trained = zstandard.train_dictionary(size, records, k=64, d=8)
        dictionary = zstandard.ZstdCompressionDict(trained.as_bytes())
    except zstandard.ZstdError:  # too few records to train on: their own bytes serve as a plain dictionary
        dictionary = zstandard.ZstdCompressionDict(b"".join(records)[:dictionary_bytes], zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    to = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(to.compress, records)])


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size :], read_across_frames=True), 1 << 20)
    while first := source.readline():
        if first.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head: dict[str, str] = {}
        while line := source.readline().rstrip(b"\r\n"):
            k, _, v = line.decode("utf-8", "surrogatepass").partition(": ")
            head[k] = v
        block = source.read(int(head["Content-Length"]))
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = 16 << 20, dictionary_bytes: int = 65536, level: int = 3, date: str = "2020-01-01T00:00:00Z", rename: bool = False) -> None:
    """Writes a record per page to ``path``, as files of about ``roll_bytes`` uncompressed.

    The payload is the column in UTF-8, null as empty. Of records with equal payloads of at least ``min_bytes``, the
    one with the largest id is a response and the others are revisits of it; smaller ones are all responses. Only
    (digest, id) are aggregated. The repeated digests are written as a table; pages whose digest may be among them meet it
    in one join, whose hot keys AQE can split, and the others pass straight through.
    Rows that repeat both the largest id and its payload are all responses. A null id ranks below every other and has a
    record id of its own kind; ids are escaped in headers as in URLs. A null url leaves out its header. Other columns are
    ignored, whatever their names; very long payloads are whole. An empty table writes a folder without archives. Files
    come through Spark's commit protocol, so lost tasks leave nothing behind, and keep the names that it gives; ``rename``
    has the driver change their ends to .warc.zst, one by one.
    """
    spark = pages.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha1(body).alias("sha"))
    groups = rows.where(F.octet_length("body") >= min_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    groups = saved(groups, "warc-repeated")
    maybe = id_filter(groups.select("sha"), bloom_slots(groups.count(), 16))(F.col("sha"))
    meets = maybe & (F.octet_length("body") >= min_bytes)
    to = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("to")
    met = rows.where(meets).join(groups, "sha", "left").select("id", "url", "body", "sha", to)
    decided = met.unionByName(rows.where(~meets).withColumn("to", F.lit(None).cast(pages.schema[id_col].dataType)))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for b in batches:
            for i, url, payload, sha, to in zip(*(b.column(c).to_pylist() for c in ("id", "url", "body", "sha", "to")), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                record = _record("response" if to is None else "revisit", i, url, date, digest, to, payload)
                records.append(record)
                size += len(record)
                if size >= roll_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([archive_bytes(records, dictionary_bytes, level)], pa.binary())})
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([archive_bytes(records, dictionary_bytes, level)], pa.binary())})

    # The text writer puts bytes out as they are; the line end is an empty skippable frame, which readers pass over.
    made = decided.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)
    if rename:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(path)
        fs = top.getFileSystem(conf)
        for f in fs.listStatus(top):
            name = f.getPath().getName()
            if name.endswith(".txt"):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(top, name.removesuffix(".txt") + ".warc.zst"))


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A row per record of the archives in ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Digests and lengths of responses are computed from the payload read, and a digest that differs from its header's
    is an error; revisits have no payload, so theirs come from the headers that they keep of the full one.
    """
    small_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for head, block in parse_archive(data.as_py()) if len(data.as_py()) else ():  # an empty table leaves an empty file
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, told = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response":
                        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if digest != told:
                            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    refers = head.get("WARC-Refers-To")
                    rows.append((_page_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, refers and _page_id(refers), length, told, payload if kind == "response" else None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    got = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    as_id = lambda c: F.col(c).cast(id_type).alias(c)
    return got.select(as_id("page_id"), "url", "record_type", as_id("refers_to"), "payload_bytes", "payload_digest", "payload")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a new folder of archives in the shared folder and reads them back."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    id_type = pages.schema[options.get("id_col", "page_id")].dataType.simpleString()
    write_warc(pages, path, **options)
    return read_warc(spark, path, id_type)
