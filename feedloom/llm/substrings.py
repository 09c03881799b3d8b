"""Removal of word windows that an earlier document holds, behind a count-min prefilter.

A window is `width` consecutive words. Each one has an anchor, the smallest hash among its
grams of `gram` words, which depends on the window's content alone; an anchor stands in at
least as many documents as any window that chose it. First pass: every task counts the
anchors of its documents in a count-min sketch whose counters stop at two, kept as sorted
slots; tasks by ranges of slots add the counters and pack those of two or more into bits.
Second pass: only windows whose estimate is two or more are grouped, exactly, by 96 bits
of their words' hashes. None is lost, since no estimate is too low. A map task first
settles what it holds: of equal windows only those of the least document are sent, and the
later ones are marked at once. Windows are spread by their own hash, not by their anchor's, so
neither a passage in many documents nor an anchor with many surroundings fills a bucket.

The sketch has two rows of `1 << bits` counters, of which only "two or more" is kept: two
bit tables, which the driver receives packed, range by range, and broadcasts. `bits`
follows the total text length up to MAX_BITS (two tables of 128 MB, held by the driver and
by each Python worker); beyond, more windows pass the prefilter and the result stays the same.

A null text has no words. A null doc_id sorts last. Rows that share a doc_id never remove
each other's words. Rows that repeat whole get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.llm.common import FLUSH_BYTES, RUN, Packer, arrow, buckets_of, by_bucket, chunks, doc_id, gathered, keyed, mapped, mix, pack_runs, \
    per_document, rows_out, spread, texts, travels, window_hashes, window_runs, words_of

travels(__name__)

MIN_BITS, MAX_BITS = 20, 30
ROWS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
WINDOW = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("crc", "<i8"), ("at", "<u4")])


def _slots(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h * ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def at_most_twice(slots: np.ndarray) -> np.ndarray:
    """Sorted slots, each once or twice: counters that stop at two, of the slots that are not 0."""
    s = np.sort(slots)
    return s[np.r_[True, True, s[2:] != s[:-2]][:len(s)]]


def sketch(rows: DataFrame, width: int, gram: int, bits: int) -> list[np.ndarray]:
    """Two packed bit tables: slots that the anchors of two documents or more fall on."""
    buckets = min(buckets_of(rows.sparkSession), 1 << (bits - 3))
    n = 2 * buckets

    def count(batches):
        packer, held_slots, size = Packer(n), ([], []), 0

        def send(least: int):
            nonlocal size
            for row in range(2):
                held_slots[row][:] = [at_most_twice(np.concatenate(held_slots[row]))]
            size = sum(x[0].nbytes for x in held_slots)
            if size > least:
                for row in range(2):
                    slots = held_slots[row].pop()
                    yield from packer.add(slots, row * buckets + ((slots.astype(np.int64) >> 3) * buckets >> bits - 3))
                size = 0
                yield from packer.flush()

        for _, _, held in chunks(batches):
            values, owner = words_of(held)
            for first, _, _, h in window_runs(values, owner, width, gram):
                own = owner[first]
                order = np.lexsort((h, own))
                h, own = h[order], own[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][:len(h)]  # a document counts once
                for row in range(2):
                    held_slots[row].append(_slots(h[once], row, bits).astype("<u4"))
                    size += held_slots[row][-1].nbytes
                if size > FLUSH_BYTES:
                    yield from send(FLUSH_BYTES // 2)
        if held_slots[0]:
            yield from send(-1)

    schema = arrow("row int, first long, bits binary")

    def merge(batches):
        for bucket, slots in by_bucket(batches, np.dtype("<u4")):
            slots = np.sort(slots)
            twice = np.unique(slots[1:][slots[1:] == slots[:-1]]).astype(np.int64)
            if len(twice):
                first = int(twice[0]) & ~7
                table = np.zeros((int(twice[-1]) >> 3) - (first >> 3) + 1, np.uint8)
                np.bitwise_or.at(table, (twice - first) >> 3, np.uint8(1) << (twice & 7).astype(np.uint8))
                yield rows_out(schema, [[bucket // buckets], [first], [table.tobytes()]])

    tables = [np.zeros((1 << bits) + 7 >> 3, np.uint8) for _ in range(2)]
    parts = mapped(gathered(mapped(rows, count, "bucket int, blob binary")), merge, "row int, first long, bits binary")
    for row, first, packed in parts.toLocalIterator():      # ranges of whole bytes that don't overlap
        tables[row][first >> 3:(first >> 3) + len(packed)] = np.frombuffer(packed, np.uint8)
    return tables


def settled(w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the windows that a smaller document among `w` holds, and the other windows, each once."""
    s = w[np.lexsort((w["at"], w["crc"], w["doc"], w["g"], w["h"]))]
    new = np.r_[True, (s["h"][1:] != s["h"][:-1]) | (s["g"][1:] != s["g"][:-1])][:len(s)]
    later = s["doc"] > s["doc"][new][np.cumsum(new) - 1]
    once = new | np.r_[True, (s["doc"][1:] != s["doc"][:-1]) | (s["crc"][1:] != s["crc"][:-1]) | (s["at"][1:] != s["at"][:-1])][:len(s)]
    hit, kept = s[later & once], s[~later & once]
    hit = hit[np.lexsort((hit["at"], hit["crc"], hit["doc"]))]
    cut = np.flatnonzero(np.r_[True, (hit["doc"][1:] != hit["doc"][:-1]) | (hit["crc"][1:] != hit["crc"][:-1]) | (hit["at"][1:] > hit["at"][:-1] + 1)][:len(hit)])
    last = np.r_[cut[1:] - 1, len(hit) - 1][:len(cut)]
    return (pack_runs(hit["doc"][cut], hit["crc"][cut], hit["at"][cut], hit["at"][last] + width),
            kept[np.lexsort((kept["at"], kept["crc"], kept["doc"]))])


def run_bucket(runs: np.ndarray, n: int) -> np.ndarray:
    """Buckets by doc and crc, so that documents without an id part too."""
    return spread(mix(runs["doc"].astype(np.uint64) ^ runs["crc"].astype(np.uint64) * common.PRIME), n)


def repeated_runs(rows: DataFrame, width: int, gram: int, bits: int) -> DataFrame:
    """(doc, crc, runs): words covered by windows that a document with a smaller id holds."""
    spark = rows.sparkSession
    n = buckets_of(spark)
    tables = spark.sparkContext.broadcast(sketch(rows, width, gram, bits))

    def twice(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, table in enumerate(tables.value):
            slots = _slots(h, row, bits)
            out &= table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 > 0
        return out

    def send(batches):
        packer, held_windows, size = Packer(2 * n), [], 0

        def settle(least: int):
            nonlocal held_windows, size
            runs, kept = settled(np.concatenate(held_windows), width)
            yield from packer.add(runs, n + run_bucket(runs, n))
            held_windows, size = [kept], kept.nbytes
            if size > least:
                yield from windows.add(kept, spread(mix(kept["h"].copy()), n))
                yield from windows.flush()
                held_windows, size = [], 0

        windows = Packer(n)
        for doc, crcs, held in chunks(batches):
            values, owner = words_of(held)
            ends = np.searchsorted(owner, np.arange(len(held)))
            h1, h2 = window_hashes(values, width), window_hashes(values ^ common.PRIME, width, 0x9FB21C651E98DF25)
            for first, last, _, h in window_runs(values, owner, width, gram):
                keep = twice(h)
                first, last = first[keep], last[keep]
                count = last - first + 1
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                out = np.empty(len(at), WINDOW)
                own = owner[at]
                out["h"], out["g"], out["doc"], out["crc"], out["at"] = h1[at], h2[at] >> np.uint64(32), doc[own], crcs[own], at - ends[own]
                held_windows.append(out)
                size += out.nbytes
                if size > FLUSH_BYTES:
                    yield from settle(FLUSH_BYTES // 2)
        if held_windows:
            yield from settle(-1)
        yield from packer.flush()

    def find(batches):
        packer = Packer(n)
        for bucket, blob in by_bucket(batches, np.dtype("u1")):
            runs = blob.view(RUN) if bucket >= n else settled(blob.view(WINDOW), width)[0]
            yield from packer.add(runs, run_bucket(runs, n))
        yield from packer.flush()

    windows = gathered(mapped(rows, send, "bucket int, blob binary"))
    return per_document(mapped(windows, find, "bucket int, blob binary"), RUN)


def dedup_windows(docs: DataFrame, width: int = 50, gram: int = 10, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                  with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row."""
    rows = keyed(docs, id_col, text_col)
    if bits is None:
        total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        bits = min(max((int(total) // 4).bit_length(), MIN_BITS), MAX_BITS)
    runs = repeated_runs(rows, width, gram, bits)
    fields = "doc long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    schema = arrow(fields)

    def keep(batches):
        for batch in batches:
            out = []
            for (doc, _, text), blob in zip(texts(batch), batch.column(batch.schema.get_field_index("runs")).to_pylist(), strict=True):
                words = text.split()
                kept = words
                if blob:
                    pairs = np.frombuffer(blob, np.int32).reshape(-1, 2)
                    mask = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mask, pairs[:, 0], 1)
                    np.add.at(mask, pairs[:, 1], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(mask[:-1]) == 0)]
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            if out:
                yield rows_out(schema, list(zip(*out, strict=True))[:len(schema)])

    return mapped(rows.join(runs, ["doc", "crc"], "left"), keep, fields).select(doc_id(), *[f.name for f in schema][1:])
