"""Helpers the operators of this folder share: work tables, packed shuffles, hashing, Arrow frames.

Packed shuffle: a map task sends one row (bucket, blob) per bucket and flush, where the
blob holds many fixed-width records. Spark still partitions and moves the rows; numpy
reads and writes the records. Buckets follow `spark.sql.shuffle.partitions`, so a larger
cluster setting means smaller buckets.

Rows are named by (doc_id, 64-bit hash of the text): a null doc_id sorts after all others, and
rows that repeat both are one document and get the same result. The hash only parts rows of one
id, or without an id: among a billion without an id it fails with a chance of 3 %.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import shared_folder, size_in_bytes

NO_ID = (1 << 63) - 1        # stands for a null id inside the operators
WORDS = r"[^\x20\x09-\x0D]+"
FLUSH_BYTES = 24 << 20       # packed records a map task holds before it sends them
PRIME = np.uint64(0x9E3779B97F4A7C15)


def travels(module: str) -> None:
    """Functions of the module go to the executors with the tasks; they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


travels(__name__)


# ---------------------------------------------------------------- work tables

def work_folder(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set, a session in one process gets a temporary one and a cluster an error."""
    return shared_folder(spark)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20        # of rows that go to a Python worker at once; more only for one longer row


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside hand at most BATCH_BYTES of rows to Python at once; a smaller setting of the session stays."""
    before = spark.conf.get(ARROW_BYTES)
    given = size_in_bytes(before)
    spark.conf.set(ARROW_BYTES, f"{min(BATCH_BYTES, given) if given > 0 else BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write a table below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/feedloom-llm/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_alone(df: DataFrame, name: str) -> DataFrame:
    """`written`, whose shuffle files Spark deletes as soon as the table stands; for large shuffles that nothing else reads."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


ROW = "_feedloom_row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A work table of the rows with a number each in ROW, which tells rows of one id apart; written, so that it stays."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, crc, text): the columns the operators read; other columns stay behind.

    doc is the id with NO_ID for null, crc a hash that names the text, a null text is empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("crc"), text.alias("text"))


def doc_id() -> F.Column:
    return F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")


# ---------------------------------------------------------------- Arrow

def arrow(fields: str) -> pa.Schema:
    """Schema from 'name type, ...' with the Spark names of the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(","))])


def rows_out(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mapped(df: DataFrame, task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
    def trimmed(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()     # workers live on; what they keep counts beside the next stage

    return df.mapInArrow(trimmed, fields)


def per_worker(name: str, make: Callable[[], object]) -> object:
    """One object for all tasks of a Python worker, such as a tokenizer and its cache."""
    state = sys.modules.setdefault("feedloom_worker_state", types.ModuleType("feedloom_worker_state"))
    if not hasattr(state, name):
        setattr(state, name, make())
    return getattr(state, name)


def forget(name: str) -> None:
    """Drop a worker's object, so that its memory is free in later stages."""
    vars(sys.modules.setdefault("feedloom_worker_state", types.ModuleType("feedloom_worker_state"))).pop(name, None)


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(doc, crc, UTF-8 bytes) of a batch of `keyed` rows."""
    data = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    return zip(batch.column(batch.schema.get_field_index("doc")).to_pylist(),
               batch.column(batch.schema.get_field_index("crc")).to_pylist(), data.to_pylist(), strict=True)


# ---------------------------------------------------------------- packed shuffle

class Packer:
    """Collects records by bucket and yields (bucket, blob) batches when enough are held."""

    schema = arrow("bucket int, blob binary")

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, records: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.held.append((records, bucket.astype(np.int32)))
            self.size += records.nbytes
        if self.size > FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        records = np.concatenate([r for r, _ in self.held])
        bucket = np.concatenate([b for _, b in self.held])
        self.held, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        records, bucket = records[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        blobs = [records[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        yield rows_out(self.schema, [bucket[starts], blobs])


def gathered(df: DataFrame, key: str = "bucket") -> DataFrame:
    """The packed rows of a bucket, one after another."""
    return df.repartition(key).sortWithinPartitions(key)


def by_bucket(batches: Iterable[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, records) of sorted packed rows; one bucket is in memory at a time."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield now, np.frombuffer(b"".join(held), dtype)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield now, np.frombuffer(b"".join(held), dtype)


def spread(values: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers from mixed 64-bit hashes."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0xD1B54A32D192ED03


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses modulo 2**64, grown as needed and kept by the worker."""
    kept = per_worker(f"powers_{base}", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    while len(kept[0]) <= n:
        have = len(kept[0])
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            kept[i] = np.concatenate([kept[i], kept[i] * np.uint64(pow(b, have, 1 << 64))])
    return kept[0], kept[1]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def window_hashes(values: np.ndarray, width: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Hash of every `width` consecutive values (none if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(values), base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def merged_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > ends[:-1]]
    return starts[first], ends[np.r_[np.flatnonzero(first)[1:] - 1, len(ends) - 1]]


# ---------------------------------------------------------------- windows over many texts at once

CHUNK_BYTES = 1 << 20


def chunks(batches: Iterable[pa.RecordBatch], least: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, crc, texts) of some `keyed` rows at a time, about `least` bytes or one longer text."""
    doc, crcs, held, size = [], [], [], 0
    for batch in batches:
        for d, c, text in texts(batch):
            if held and size + len(text) > least:
                yield np.array(doc, np.int64), np.array(crcs, np.int64), held
                doc, crcs, held, size = [], [], [], 0
            doc.append(d)
            crcs.append(c)
            held.append(text)
            size += len(text)
    if held:
        yield np.array(doc, np.int64), np.array(crcs, np.int64), held


def words_of(held: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the text each one stands in.

    Read by pieces of CHUNK_BYTES; a word that reaches over pieces has its sum carried on.
    """
    joined = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in held])
    up, down = powers(CHUNK_BYTES)
    hashes, owner = [], []
    carried, length = np.zeros(1, np.uint64), 0      # of the word that the last piece broke off
    for at in range(0, len(joined), CHUNK_BYTES):
        piece = joined[at:at + CHUNK_BYTES]
        if fold:
            piece = np.where((piece >= 65) & (piece <= 90), piece + np.uint8(32), piece)
        starts, ends = word_spans(piece)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:len(piece)], out=total[1:])
        sums, size = (total[ends] - total[starts]) * down[starts], ends - starts
        first = np.searchsorted(ends_of_texts, starts + at, "right")
        if length and len(starts) and starts[0] == 0:
            sums[:1] = carried + sums[:1] * np.uint64(pow(BASE, length, 1 << 64))
            size[0] += length
            first[0] = np.searchsorted(ends_of_texts, at - 1, "right")
        elif length:
            hashes.append(mix(carried + np.array([length], np.uint64) * PRIME))
            owner.append(np.searchsorted(ends_of_texts, [at - 1], "right"))
        length = 0
        if len(ends) and ends[-1] == len(piece) and at + CHUNK_BYTES < len(joined):
            carried, length = sums[-1:], int(size[-1])
            sums, size, first = sums[:-1], size[:-1], first[:-1]
        hashes.append(mix(sums + size.astype(np.uint64) * PRIME))
        owner.append(first)
    return np.concatenate(hashes), np.concatenate(owner)


POSITION = np.uint64((1 << 24) - 1)
SEGMENT = 1 << 22


def minimizers(values: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` values: the position and the hash of its smallest gram.

    The choice rests on the window's content alone (the leftmost of equal grams), so equal
    windows choose the same gram wherever they stand. At most SEGMENT + width values.
    """
    grams = window_hashes(values, gram)
    low = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low & POSITION).astype(np.int64)
    return at, grams[at]


def window_runs(values: np.ndarray, owner: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, last start, anchor position, anchor hash) of runs of windows with one anchor.

    Windows that reach into another text are left out. Values are hashes, or bytes.
    """
    for base in range(0, max(len(values) - width + 1, 0), SEGMENT):
        part, own = values[base:base + SEGMENT + width - 1], owner[base:base + SEGMENT + width - 1]
        if part.dtype == np.uint8:
            part = part.astype(np.uint64) + np.uint64(1)
        at, h = minimizers(part, width, gram)
        inside = own[:len(at)] == own[width - 1:]
        change = np.r_[True, (at[1:] != at[:-1]) | (own[1:len(at)] != own[:len(at) - 1]) | (inside[1:] != inside[:-1])]
        first = np.flatnonzero(change)
        last = np.r_[first[1:] - 1, len(at) - 1]
        keep = inside[first]
        first, last = first[keep], last[keep]
        yield first + base, last + base, at[first] + base, h[first]


def per_document(packed: DataFrame, dtype: np.dtype) -> DataFrame:
    """Packed runs (doc, crc, first, end), bucketed by doc -> one row per document with its runs as pairs of int32."""
    schema = arrow("doc long, crc long, runs binary")

    def task(batches):
        for _, r in by_bucket(batches, dtype):
            r = r[np.lexsort((r["first"], r["crc"], r["doc"]))]
            new = np.flatnonzero(np.r_[True, (r["doc"][1:] != r["doc"][:-1]) | (r["crc"][1:] != r["crc"][:-1])])
            pairs = np.column_stack([r["first"], r["end"]]).astype(np.int32)
            for lo in range(0, len(new), 4096):
                own = new[lo:lo + 4096]
                ends = np.r_[new[lo + 1:lo + 4096 + 1], len(r)][:len(own)]
                yield rows_out(schema, [r["doc"][own], r["crc"][own].astype(np.int64), [pairs[a:b].tobytes() for a, b in zip(own, ends, strict=True)]])

    return mapped(gathered(packed), task, "doc long, crc long, runs binary")


RUN = np.dtype([("doc", "<i8"), ("crc", "<i8"), ("first", "<u4"), ("end", "<u4")])


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return spread(mix(doc.view(np.uint64) if doc.flags.c_contiguous else doc.astype(np.uint64)), n)


def pack_runs(doc: np.ndarray, crcs: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), RUN)
    out["doc"], out["crc"], out["first"], out["end"] = doc, crcs, first, end
    return out
