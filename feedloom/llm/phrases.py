"""Collocations by Rabin-Karp fingerprints with occurrence pointers.

Texts are lower-cased in A-Z, cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words
`[^\\x20\\x09]+`. Prefix polynomials over a chunk of texts give the fingerprint of every
phrase of up to `longest` words with two look-ups. A map task groups the phrases of a chunk by
fingerprint, checks every member of a group against the words of its first one, and sends a
group as (fingerprint, count, place of one occurrence); phrases of other words under the same
fingerprint go by themselves. The empty phrase, which stands before every word, carries the
language's number of words. A reduce task adds the counts of a fingerprint. Only places of
fingerprints with `least` occurrences or more return to the texts, where the phrase is read;
counts are then added by the phrase itself, packed by its hash. So a fingerprint only spares phrases that can't
be frequent: two phrases of one fingerprint are told apart whatever its width.

Per language (`und` for null), each frequent phrase of two words or more is scored by its weakest cut in two,
in exact decimals. A phrase of which a longer one holds most occurrences is dropped.

A null text has no words; a null lang is `und`, and an empty one a language of its own. Rows that repeat, or share an id, or have none, count each. Texts
longer than SEGMENT are cut at the end of a piece, or of a word with the words after it carried
over, so memory follows a chunk, or a longer single word. An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import BASE, PRIME, arrow, buckets_of, gathered, mapped, mix, powers, rows_out, spread, travels, written, written_alone

travels(__name__)

CHUNK = 8 << 20         # bytes of text whose phrases are grouped together
SEGMENT = 4 << 20       # longer texts are cut
PIECE = 1 << 20         # bytes of the text that have a power each
FINGERPRINT_BITS = 48
FINER = 4               # buckets per shuffle partition; a task holds one bucket at a time
WAITING = 8 << 20       # bytes of places a task holds before it sends them
STRINGS = 32 << 20      # bytes of phrases a task counts before it sends them
NO_LANGUAGE = "und"
PIECE_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
WORD_END = re.compile(rb"[ \t]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)      # 0 in a word, 1 between words, 2 between pieces
KIND[[9, 32]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


# ---------------------------------------------------------------- columns in byte planes

def packed(columns: list[np.ndarray]) -> bytes:
    """Unsigned columns, the first ascending and kept as differences, each in as many byte planes as it needs."""
    first = columns[0].astype("<u8")
    out = [len(first).to_bytes(4, "little"), int(first[0]).to_bytes(8, "little")]
    for x in [np.r_[first[:1] * 0, np.diff(first)], *(c.astype("<u8") for c in columns[1:])]:
        k = (int(x.max()).bit_length() + 7) // 8
        out.append(bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes())
    return b"".join(out)


def unpacked(blob: bytes, at: int, n_columns: int, wanted: tuple[int, ...]) -> tuple[list[np.ndarray], int]:
    """The wanted columns of a packed block and the place after it."""
    n, low = int.from_bytes(blob[at:at + 4], "little"), int.from_bytes(blob[at + 4:at + 12], "little")
    at += 12
    out = []
    for c in range(n_columns):
        k, at = blob[at], at + 1
        if c in wanted:
            x = np.zeros((n, 8), np.uint8)
            if k:
                x[:, :k] = np.frombuffer(blob, np.uint8, k * n, at).reshape(k, n).T
            x = x.view("<u8")[:, 0]
            out.append(np.cumsum(x) + np.uint64(low) if c == 0 else x)
        at += k * n
    return out, at


# ---------------------------------------------------------------- words of a chunk

def segments(text: bytes, longest: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, own, bytes): phrases that start in the first `own` bytes are the segment's."""
    base = 0
    while len(text) - base > 2 * SEGMENT:
        found = PIECE_END.search(text, base + SEGMENT, base + 2 * SEGMENT)
        if found:
            cut = end = found.start()
        elif found := WORD_END.search(text, base + SEGMENT):
            cut = found.start()
            end = re.compile(rb"(?:[ \t]+[^ \t]+){0,%d}" % (longest - 1)).match(text, cut).end()
        else:
            break
        yield base, cut - base, text[base:end]
        base = cut
    yield base, len(text) - base, text[base:]


class Words:
    """The words of some segments: where they stand, which piece and segment they are in, and their prefix polynomials."""

    def __init__(self, own: list[int], held: list[bytes]):
        data = LOWER[np.frombuffer(b"\n".join(held) + b"\n", np.uint8)]
        kind = KIND[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[1:] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        edges = edges.astype(np.int32 if len(data) < 1 << 31 else np.int64)      # places are kept narrow: tasks hold many
        narrow = edges.dtype
        self.start, end = edges[0::2], edges[1::2]
        self.segment_start = np.cumsum([0] + [len(x) + 1 for x in held])
        self.segment = (np.searchsorted(self.segment_start, self.start, "right") - 1).astype(narrow)
        self.offset = (self.start - self.segment_start[self.segment]).astype(narrow)
        self.owned = self.offset < np.array(own, np.int64)[self.segment]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.start).astype(narrow)
        keep = inside[1:]
        keep[end] = True
        self.text = data[keep]                              # every word with one space after it
        self.low = np.zeros(len(end) + 1, narrow)
        np.cumsum(end - self.start + 1, out=self.low[1:])
        self.text[self.low[1:] - 1] = 32

    def ids(self) -> np.ndarray:
        """Numbers that are equal where the words are."""
        words = pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(self.low.astype(np.int32, copy=False)), pa.py_buffer(self.text)])
        return np.asarray(words.dictionary_encode().indices)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix polynomials at the starts and at the ends of words, and the inverse powers that move the former to place 0."""
        up, down = powers(PIECE)
        at, end = self.low[:-1], self.low[1:] - 1
        first, last, back = (np.empty(len(at), np.uint64) for _ in range(3))
        total, scale, unscale = 0, 1, 1                     # of the pieces before
        whole, unwhole = pow(BASE, PIECE, 1 << 64), pow(pow(BASE, -1, 1 << 64), PIECE, 1 << 64)
        for base in range(0, len(self.text), PIECE):
            part = self.text[base:base + PIECE]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=sums[1:])
            sums = sums * np.uint64(scale) + np.uint64(total)
            for places, out in ((at, first), (end, last)):
                lo, hi = np.searchsorted(places, [base, base + len(part)])
                out[lo:hi] = sums[places[lo:hi] - base]
            lo, hi = np.searchsorted(at, [base, base + len(part)])
            back[lo:hi] = down[at[lo:hi] - base] * np.uint64(unscale)
            total, scale, unscale = int(sums[-1]), scale * whole % (1 << 64), unscale * unwhole % (1 << 64)
        return first, last, back


def chunks(batches: Iterable[pa.RecordBatch], longest: int) -> Iterator[tuple[list, list, list, list, list]]:
    """(rows, places, own, languages, segments) of (row, lang, text) batches, about CHUNK bytes at a time."""
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    size = 0
    for batch in batches:
        for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            for place, own, part in segments(text, longest):
                if size and size + len(part) > CHUNK:
                    yield out
                    out, size = ([], [], [], [], []), 0
                for kept, value in zip(out, (row, place, own, lang, part), strict=True):
                    kept.append(value)
                size += len(part) + 1
    if size:
        yield out


def row_runs(rows: list[int], places: list[int]) -> np.ndarray:
    """(segment, row, place) where a run of consecutive whole texts begins; a place other than 0 holds for that segment alone."""
    rows, places = np.array(rows, np.int64), np.array(places, np.int64)
    new = np.r_[True, (np.diff(rows) != 1) | (places[1:] != 0)]
    at = np.flatnonzero(new)
    return np.column_stack([at, rows[at], places[at]])


def grouped(fingerprint: np.ndarray, at: np.ndarray, n: int, ids: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first word, count) ascending; phrases whose words differ from those of their group's first stand alone."""
    order = np.argsort(fingerprint)
    fingerprint, at = fingerprint[order], at[order]
    new = np.r_[True, fingerprint[1:] != fingerprint[:-1]][:len(at)]
    head = at[new][np.cumsum(new) - 1]
    same = lang[at] == lang[head]
    for j in range(n):
        same &= ids[at + j] == ids[head + j]
    if same.all():
        return fingerprint[new], at[new], np.diff(np.r_[np.flatnonzero(new), len(at)])
    count = np.add.reduceat(same, np.flatnonzero(new), dtype=np.int64)
    out = (np.r_[fingerprint[new], fingerprint[~same]], np.r_[at[new], at[~same]], np.r_[count, np.ones((~same).sum(), np.int64)])
    order = np.argsort(out[0], kind="stable")
    return out[0][order], out[1][order], out[2][order]


# ---------------------------------------------------------------- frequent phrases

def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang",
                     bits: int = FINGERPRINT_BITS) -> DataFrame:
    """lang, n, phrase, f: all phrases of up to `longest` words with `least` occurrences or more in a language.

    The empty phrase (n = 0) has the language's number of words.
    """
    buckets = FINER * buckets_of(docs.sparkSession)
    rows = written(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                               F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
                   .select(F.monotonically_increasing_id().alias("row"), "lang", "text"), "phrase-texts")
    schema = arrow("bucket int, blob binary")

    def send(batches):
        for row, place, own, lang, held in chunks(batches, longest):
            words = Words(own, held)
            if not len(words.start):
                continue
            names = sorted(set(lang))
            number = np.array([names.index(x) for x in lang], np.int32)[words.segment]
            marks = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in names], np.uint64)
            ids, (first, last, back) = words.ids(), words.prefixes()
            blobs: dict[int, list[bytes]] = {}
            head = row_runs(row, place)
            for n in range(longest + 1):
                at = np.arange(len(words.start) - max(n - 1, 0), dtype=np.int32)
                at = at[words.owned[at] & (words.piece[at] == words.piece[at + max(n - 1, 0)])]
                if not len(at):
                    continue
                value = (last[at + n - 1] - first[at]) * back[at] if n else np.zeros(len(at), np.uint64)
                fingerprint = mix(value + marks[number[at]] + np.uint64(n * int(PRIME) % (1 << 64))) >> np.uint64(64 - bits)
                fingerprint, at, count = grouped(fingerprint, at, n, ids, number)
                cuts = np.r_[np.searchsorted(fingerprint, np.array([(k << bits) // buckets for k in range(buckets)], np.uint64)), len(at)]
                for k in range(buckets):
                    lo, hi = cuts[k], cuts[k + 1]
                    if lo < hi:
                        blobs.setdefault(k, []).append(bytes([n]) + packed([fingerprint[lo:hi], words.segment[at[lo:hi]], words.offset[at[lo:hi]], count[lo:hi]]))
            prefix = len(head).to_bytes(4, "little") + head.astype("<i8").tobytes()
            yield rows_out(schema, [list(blobs), [prefix + b"".join(x) for x in blobs.values()]])

    def places_of(blob: bytes, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        """(row, offset, n, count) of the records of a blob that `held` marks."""
        n_runs = int.from_bytes(blob[:4], "little")
        runs = np.frombuffer(blob, "<i8", 3 * n_runs, 4).reshape(-1, 3)
        at, seen = 4 + 24 * n_runs, 0
        while at < len(blob):
            n = blob[at]
            (segment, offset, count), at = unpacked(blob, at + 1, 4, (1, 2, 3))
            mine = held[seen:seen + len(segment)]
            seen += len(segment)
            segment, offset, count = segment[mine].astype(np.int64), offset[mine].astype(np.int64), count[mine]
            run = np.searchsorted(runs[:, 0], segment, "right") - 1
            yield runs[run, 1] + segment - runs[run, 0], offset + np.where(segment == runs[run, 0], runs[run, 2], 0), n, count

    def frequent(batches):
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            nonlocal waiting, size
            row, offset, n, count = (np.concatenate(x) for x in zip(*waiting, strict=True))
            bucket = row % buckets
            order = np.lexsort((offset, row, bucket))
            row, offset, n, count, bucket = (x[order] for x in (row, offset, n, count, bucket))
            lo = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            hi = np.r_[lo[1:], len(row)]
            yield rows_out(schema, [bucket[lo], [packed([row[a:b], offset[a:b], n[a:b], count[a:b]]) for a, b in zip(lo, hi, strict=True)]])
            waiting, size = [], 0

        for blobs in bucket_blobs(batches):
            fingerprints, counts = [], []
            for blob in blobs:
                at = 4 + 24 * int.from_bytes(blob[:4], "little")
                while at < len(blob):
                    (f, c), at = unpacked(blob, at + 1, 4, (0, 3))
                    fingerprints.append(f)
                    counts.append(c.astype(np.int64))
            sizes = [len(f) for f in fingerprints]
            f, c = np.concatenate(fingerprints), np.concatenate(counts)
            del fingerprints, counts
            order = np.argsort(f)
            f = f[order]
            new = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            del f
            enough = np.add.reduceat(c[order], new) >= least
            held = np.empty(len(c), bool)
            held[order] = np.repeat(enough, np.diff(np.r_[new, len(c)]))
            del order, c
            seen, sections = 0, iter(sizes)
            for blob in blobs:
                for row, offset, n, count in places_of(blob, held[seen:]):
                    seen += next(sections)
                    if len(row):
                        waiting.append((row, offset, np.full(len(row), n), count))
                        size += 32 * len(row)
                if size > WAITING:
                    yield from flush()
        if waiting:
            yield from flush()

    places = written_alone(mapped(gathered(mapped(rows, send, "bucket int, blob binary")), frequent, "bucket int, blob binary"), "phrase-places")
    both = places.select("bucket", F.lit(-1).cast("long").alias("row"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), "blob").unionByName(
        rows.select(F.pmod("row", F.lit(buckets)).cast("int").alias("bucket"), "row", "lang", "text", F.lit(None).cast("binary").alias("blob")))
    both = both.repartition("bucket").sortWithinPartitions("bucket", "row")
    named = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def read(batches):
        counted: list[pa.Table] = []
        for wanted, texts in with_places(batches):
            for row, place, own, lang, held in chunks(texts, longest):
                counted.append(phrases_at(wanted, row, place, own, lang, held))
                if sum(x.nbytes for x in counted) > STRINGS:
                    counted = [summed(counted)]
                    if counted[0].nbytes > STRINGS // 2:
                        yield by_hash(counted.pop())
        if counted:
            yield by_hash(summed(counted))

    def summed(tables: list[pa.Table]) -> pa.Table:
        x = pa.concat_tables(tables).group_by(["bucket", "lang", "n", "phrase"]).aggregate([("f", "sum")])
        return pa.table([*(x.column(c) for c in named.names[:-1]), x.column("f_sum")], schema=named)

    def by_hash(counted: pa.Table) -> pa.RecordBatch:
        """Counted phrases as one row per bucket."""
        whole = counted.sort_by("bucket").combine_chunks()
        bucket = np.asarray(whole.column("bucket"))
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True][:len(bucket) + 1])
        blobs = [whole.slice(a, b - a).to_batches()[0].serialize().to_pybytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return rows_out(schema, [bucket[cuts[:-1]], blobs])

    def total(batches):
        for blobs in bucket_blobs(batches):
            whole = summed([pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), named)]) for x in blobs])
            yield from whole.filter(pc.greater_equal(whole.column("f"), least)).drop_columns(["bucket"]).to_batches()

    def phrases_at(wanted: np.ndarray, row: list, place: list, own: list, lang: list, held: list[bytes]) -> pa.Table:
        """The phrases that stand at the wanted (row, offset, n, count) of these segments."""
        rows_here, places_here = np.array(row, np.int64), np.array(place, np.int64)
        mine = wanted[:, np.searchsorted(wanted[0], rows_here[0]):np.searchsorted(wanted[0], rows_here[-1], "right")]
        # segments stand in order of row and place; a long text may have others in the next chunk
        lo, hi = np.searchsorted(rows_here, mine[0]), np.searchsorted(rows_here, mine[0], "right")
        segment = lo.copy()
        for k in np.flatnonzero(hi - lo > 1):
            segment[k] = lo[k] + np.searchsorted(places_here[lo[k]:hi[k]], mine[1, k], "right") - 1
        segment = np.maximum(segment, 0)
        offset = mine[1] - places_here[segment]
        inside = (rows_here[segment] == mine[0]) & (offset >= 0) & (offset < np.array(own, np.int64)[segment])
        mine, segment, offset = mine[:, inside], segment[inside], offset[inside]
        words = Words(own, held)
        at = np.searchsorted(words.start, words.segment_start[segment] + offset)
        low = words.low[at]
        length = np.where(mine[2] > 0, words.low[np.minimum(at + mine[2], len(words.low) - 1)] - 1 - low, 0)
        ends = np.cumsum(length)
        letters = words.text[np.repeat(low - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(letters))
        first, last, back = words.prefixes()
        value = np.where(mine[2] > 0, (last[np.minimum(at + mine[2] - 1, len(last) - 1)] - first[at]) * back[at], np.uint64(0)) + mine[2].astype(np.uint64) * PRIME
        bucket = pa.array(spread(mix(value), buckets))
        return summed([pa.table([bucket, pa.array(lang, pa.string()).take(pa.array(segment)), pa.array(mine[2], pa.int32()), phrase, pa.array(mine[3], pa.int64())], schema=named)])

    return mapped(gathered(mapped(both, read, "bucket int, blob binary")), total, "lang string, n int, phrase string, f long")


def bucket_blobs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one bucket after another."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield held


def with_places(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.RecordBatch]]]:
    """(wanted places, batch of texts) for the parts of batches that lie in one bucket; a bucket's places come before its texts."""
    now, held = None, []
    wanted = np.zeros((4, 0), np.int64)
    for batch in batches:
        bucket, row = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | ((row[1:] < 0) != (row[:-1] < 0)), True][:len(bucket) + 1])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if bucket[lo] != now:
                now, held, wanted = bucket[lo], [], np.zeros((4, 0), np.int64)
            if row[lo] < 0:
                for blob in batch.column(4).slice(lo, hi - lo).to_pylist():
                    held.append(np.stack([x.astype(np.int64) for x in unpacked(blob, 0, 4, (0, 1, 2, 3))[0]]))
                continue
            if held:
                wanted = np.concatenate(held, 1)
                wanted, held = wanted[:, np.lexsort((wanted[1], wanted[0]))], []
            yield wanted, [batch.slice(lo, hi - lo).select([1, 2, 3])]


# ---------------------------------------------------------------- scores

def scored(phrases: DataFrame, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the frequent phrases of two words or more.

    A phrase of which some longer frequent phrase holds `share` percent of the occurrences, or more, is left out.
    """
    known = written_alone(phrases, "phrase-counts")
    long = known.where("n >= 2").withColumn("words", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "words", "n", F.explode(F.expr("sequence(1, n - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("left"), F.expr("array_join(slice(words, k + 1, n - k), ' ')").alias("right"))
    single = known.select("lang", "phrase", "f")
    cuts = (cuts.join(single.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(single.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    # 14 digits a count: l, r >= a, so the quotient is at most a million
    exact = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(14, 0)) * cast(a as decimal(14, 0))) div (cast(l as decimal(14, 0)) * cast(r as decimal(14, 0)))")
    weakest = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
               .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    inner = long.where("n >= 3").select("lang", "f", "words", F.explode(F.expr(
        "flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), s -> array_join(slice(words, s, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(share)} * a")
    return kept.join(known.where("n = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, first: int = 2000, text_col: str = "text",
                 lang_col: str = "lang", bits: int = FINGERPRINT_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` best phrases of every language."""
    found = scored(frequent_phrases(docs, longest, least, text_col, lang_col, bits), share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
