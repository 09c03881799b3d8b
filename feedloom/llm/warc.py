"""WARC archives in seekable Zstandard bundles.

`write_archive` makes one record per page: a `response` with the page as an HTTP message,
or, where an equal payload has been kept under a smaller page id, a `revisit` that names
it. A bundle is a `.warc.zst` file: independent Zstandard frames of about `frame_bytes` of
records, then a skippable frame with the seek table (sizes and checksum of every frame)
and its footer. The index maps record identifiers to (bundle, frame, offset in the
frame), so `fetch` reads a footer and one frame to return a record, and `read_archive`
reads a bundle by ranges of frames in several tasks.

Payloads are compared by SHA-256 and length; classes meet as narrow rows, and only
responses carry their text to the writing task, by row, so a payload in a third of the pages fills no task.
A task writes below `parts` under a name of its own attempt; a second job moves the
files that finished attempts named to `bundles`. Half files of lost tasks stay in `parts`.

A null html is an empty payload. Rows that repeat a page id and payload are a response and
revisits of it; a null page id sorts last and revisits are named null then. Control, white-space and
non-ASCII characters of an address are percent-encoded; a null address is `about:blank`.
A page of any length is one record and may fill a frame by itself. An empty table gives an
archive without bundles; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import NO_ID, arrow, mapped, rows_out, travels, work_folder, written

travels(__name__)

FRAME_BYTES = 256 << 10         # of records in a frame, before compression
BUNDLE_BYTES = 64 << 20         # of frames in a file
RANGE_BYTES = 8 << 20           # of frames that one row of a reading task covers
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"   # the tables have no capture time
# Formats of the archive and of its container.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long, record_type string"


# ---------------------------------------------------------------- records

def record_id(page: int, row: int) -> str:
    """An identifier of free layout (UUID version 8): 64 bits of the page id, 58 of the row's number."""
    low = row & (1 << 58) - 1
    value = page % (1 << 64)
    bits = (value >> 16) << 80 | 8 << 76 | (value >> 4 & 0xFFF) << 64 | 2 << 62 | (value & 0xF) << 58 | low
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(identifier: str) -> int:
    """The page id within a record identifier."""
    bits = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    value = (bits >> 80) << 16 | (bits >> 64 & 0xFFF) << 4 | bits >> 58 & 0xF
    return value - (1 << 64) if value >> 63 else value


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def address(url: str | None) -> str:
    return urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else "about:blank"


def record(kind: str, identifier: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", identifier), ("WARC-Date", DATE), *headers,
             ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page: int, row: int, url: str | None, payload: bytes | None, length: int, digest: str, refers: tuple[int, int] | None) -> bytes:
    """The response of a page, or its revisit where `refers` is the (page, row) of an equal payload's response."""
    headers = [("WARC-Target-URI", address(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
               ("X-Payload-Length", str(length))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if refers is None:
        return record("response", record_id(page, row), headers, http + payload)
    return record("revisit", record_id(page, row), [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers))], http)


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, place of the next record) of the record at a place; raises where the block is not the one written."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    start, length = end + 4, int(headers["Content-Length"])
    block = data[start:start + length]
    if version != "WARC/1.1" or data[start + length:start + length + 4] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{sha1(block)}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block, start + length + 4


# ---------------------------------------------------------------- seekable bundles

def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The closing skippable frame for (compressed size, size, checksum) of every frame."""
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), CHECKSUM_FLAG, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


class Bundle:
    """An open bundle: records go to the current frame, frames to the file."""

    def __init__(self, filesystem, path: str, name: str, frame_bytes: int, level: int):
        import zstandard

        self.name, self.frame_bytes = name, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.file = filesystem.open_output_stream(path, compression=None)     # frames are compressed here
        self.frames: list[tuple[int, int, int]] = []
        self.held, self.size, self.written = [], 0, 0
        info = b"software: feedloom\r\nformat: WARC File Format 1.1\r\n"
        self.add(record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
        self.end_frame()

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.end_frame()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def end_frame(self) -> None:
        import xxhash

        if not self.size:
            return
        plain = b"".join(self.held)
        packed = self.compressor.compress(plain)
        self.file.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()


def read_seek_table(file, size: int) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, size, checksum) of every frame, from the end of an open bundle."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != CHECKSUM_FLAG:
        raise ValueError("no seek table")
    file.seek(size - 9 - 12 * count)
    out, start = [], 0
    for packed, plain, check in struct.iter_unpack("<III", file.read(12 * count)):
        out.append((start, packed, plain, check))
        start += packed
    return out


def read_frame(file, entry: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard

    start, packed, plain, check = entry
    file.seek(start)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("damaged frame")
    return data


def opened(folder: str):
    """(file system, path) of a folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


# ---------------------------------------------------------------- writing

def _first_of_equals(rows: DataFrame, least: int) -> DataFrame:
    """(row, first_page, first_row) of the rows whose payload, of at least `least` bytes, has a response elsewhere."""
    narrow = rows.select("row", "page", "length", "same").where(F.col("length") >= least)
    first = narrow.groupBy("same", "length").agg(F.min(F.struct("page", "row")).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return (narrow.join(first.select("same", "length", "first"), ["same", "length"]).where("row <> first.row")
            .select("row", F.col("first.page").alias("first_page"), F.col("first.row").alias("first_row")))


def write_archive(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL,
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write `folder`/bundles and `folder`/index; returns the index."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("page"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "page", "url", F.octet_length("payload").cast("long").alias("length"),
                       F.unhex(F.sha2("payload", 256)).alias("same"), F.sha1("payload").alias("digest"), "payload")
    rows = written(rows, "warc-pages")
    copies = written(_first_of_equals(rows, least), "warc-revisits")
    joined = (rows.drop("same").join(copies, "row", "left").select("row", "page", "url", "length", "digest", F.when(F.col("first_row").isNull(), F.col("payload")).alias("payload"),
                                                                   "first_page", "first_row").sortWithinPartitions("page", "row"))
    schema = arrow(INDEX)

    def write(batches):
        filesystem, root = opened(folder)
        task = TaskContext.get()
        filesystem.create_dir(f"{root}/parts", recursive=True)
        bundle, number, index = None, 0, []

        def finish():
            nonlocal bundle, index
            bundle.close()
            yield rows_out(schema, list(zip(*index, strict=True)))
            bundle, index = None, []

        for batch in batches:
            for row, page, url, length, digest, payload, first_page, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    name = f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.zst"
                    bundle, number = Bundle(filesystem, f"{root}/parts/{name}", name, frame_bytes, level), number + 1
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                data = page_record(page, row, url, payload, length, digest, None if first_row is None else (first_page, first_row))
                frame, offset = bundle.add(data)
                index.append((record_id(page, row), None if page == NO_ID else page, bundle.name, frame, offset, len(data), "response" if first_row is None else "revisit"))
                if bundle.written + bundle.size >= bundle_bytes:
                    yield from finish()
        if bundle is not None:
            yield from finish()

    made = written(mapped(joined, write, INDEX), "warc-index")
    names = written(mapped(made.select("bundle").distinct(), lambda batches: published(folder, batches), "bundle string"), "warc-bundles")
    made.join(names, "bundle", "left_semi").select(*[f.name for f in schema]).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def published(folder: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Move the named bundles from `parts` to `bundles`; a bundle that an earlier attempt moved stays."""
    from pyarrow import fs

    filesystem, root = opened(folder)
    filesystem.create_dir(f"{root}/bundles", recursive=True)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            if filesystem.get_file_info(f"{root}/bundles/{name}").type == fs.FileType.NotFound:
                filesystem.move(f"{root}/parts/{name}", f"{root}/bundles/{name}")
        yield batch


# ---------------------------------------------------------------- reading

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, size, first, last): ranges of frames, from the seek tables of the bundles that the index names."""
    fields = "bundle string, size long, first int, last int"
    schema = arrow(fields)

    def cut(batches):
        filesystem, root = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path = f"{root}/bundles/{name}"
                size = filesystem.get_file_info(path).size
                with filesystem.open_input_file(path) as file:
                    frames = read_seek_table(file, size)
                firsts = [0]
                for k, (start, *_) in enumerate(frames):
                    if start - frames[firsts[-1]][0] >= RANGE_BYTES:
                        firsts.append(k)
                yield rows_out(schema, [[name] * len(firsts), [size] * len(firsts), firsts, [*firsts[1:], len(frames)]])

    names = spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    return mapped(names, cut, fields)


def page_row(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS for a page's record; digests of responses are taken from what was read."""
    kind, page = headers["WARC-Type"], page_of(headers["WARC-Record-ID"])
    digest, length, refers = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"]), None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if (sha1(payload), len(payload)) != (digest, length):
            raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    else:
        refers = page_of(headers["WARC-Refers-To"])
    return None if page == NO_ID else page, length, digest, kind, None if refers == NO_ID else refers


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all records, read from the bundles."""
    schema = arrow(RECORDS)

    def read(batches):
        filesystem, root = opened(folder)
        for batch in batches:
            for name, size, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with filesystem.open_input_file(f"{root}/bundles/{name}") as file:
                    for entry in read_seek_table(file, size)[first:last]:
                        data, at, out = read_frame(file, entry), 0, []
                        while at < len(data):
                            headers, block, at = parsed(data, at)
                            if headers["WARC-Type"] != "warcinfo":
                                out.append(page_row(headers, block))
                        if out:
                            yield rows_out(schema, list(zip(*out, strict=True)))

    return mapped(_ranges(spark, folder).repartition("bundle", "first"), read, RECORDS)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, record_id, record_type and payload of the wanted pages; a revisit's payload is that of its response.

    Only the frames that hold the records are read and decompressed.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    places = "record_id string, page_id long, refers string, record_type string, payload binary"
    schema = arrow(places)

    def load(batches):
        filesystem, root = opened(folder)
        for batch in batches:
            at_name: dict[str, list] = {}
            for place in batch.to_pylist():
                at_name.setdefault(place["bundle"], []).append(place)
            for name, own in at_name.items():
                path = f"{root}/bundles/{name}"
                with filesystem.open_input_file(path) as file:
                    frames = read_seek_table(file, filesystem.get_file_info(path).size)
                    now, data = None, b""
                    for place in sorted(own, key=lambda p: (p["frame"], p["offset"])):
                        if place["frame"] != now:
                            now, data = place["frame"], read_frame(file, frames[place["frame"]])
                        headers, block, _ = parsed(data, place["offset"])
                        kind = headers["WARC-Type"]
                        yield rows_out(schema, [[headers["WARC-Record-ID"]], [place["page_id"]], [headers.get("WARC-Refers-To")], [kind],
                                                [block[block.index(b"\r\n\r\n") + 4:] if kind == "response" else None]])

    def records(of: DataFrame) -> DataFrame:
        return mapped(of.select(*index.columns).repartition("bundle").sortWithinPartitions("bundle", "frame"), load, places)

    found = written(records(index.join(wanted.select(F.col(id_col).cast("long").alias("page_id")).distinct(), "page_id", "left_semi")), "warc-fetched")
    sources = found.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    origin = records(index.join(sources, "record_id", "left_semi")).select(F.col("record_id").alias("refers"), F.col("payload").alias("origin"))
    return found.join(origin, "refers", "left").select("page_id", "record_id", "record_type", F.coalesce("payload", "origin").alias("payload"))


def archived(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages' archive, then read it back: one row per page."""
    spark = pages.sparkSession
    folder = folder or f"{work_folder(spark)}/feedloom-llm/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, **options)
    return read_archive(spark, folder)
