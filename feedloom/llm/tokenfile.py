"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

`write_ids` tokenises whole texts, ranks ids by their frequency over all documents (ties
by id) and writes one row per document, sorted by doc_id within range partitions:
`control` holds two bits per id (its byte count less one, four ids to a byte, the first
in the low bits), `data` holds the ranks, little-endian, in as many bytes each. `vocab`
maps ranks back to ids. `read_ids` decodes both by numpy table lookup. The container is
Parquet, so Spark's committer keeps lost or repeated tasks from leaving half files.

Null texts are empty; every document ends with `end_id`, so an empty one has one id. A
null doc_id sorts last. Rows with equal doc_id stand in the order of their text's crc32.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import arrow, buckets_of, doc_id, forget, keyed, mapped, per_worker, rows_out, small_batches, travels, work_folder, written

travels(__name__)

CACHE_UNITS = 1_000_000     # some 200 MB in a worker
CACHE_TAILS = 10_000
CODED_IDS = 1 << 19     # that are packed or unpacked together
LONG_UNIT = 1 << 8      # longer pre-tokens are not kept
UNITS = 1 << 15         # pre-tokens looked up together, of several texts or of a part of one
PIECES = 64             # words the model merges in one call
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COUNT_SLICES = 64


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(plain)))}


class Encoder(dict):
    """Ids of texts by one tokenizers file; maps pre-tokens it has met to their ids as bytes.

    A byte-level BPE pre-tokenizer never joins a character with a space that follows it,
    so texts may be cut there, unless white space stands before that space. Texts where
    it does, or which hold an added token's string, are encoded whole. A pre-token stands
    for itself after a space; in a tuple, for itself with nothing before it. Letters alone
    are one piece for the model, and so are closing marks after them, and a line feed
    between two characters that aren't white space. Texts whose line feeds all stand so are
    cut there too, and a pre-token then begins with the line feed before it; in others,
    longer runs of lines are cut.

    Pre-tokens of many texts are looked up together. The letters of those not met yet go to
    the model in runs, a byte between them that it never merges, so that a run costs one call.
    """

    MARKS = string.punctuation.replace("'", "")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        pre = repr(self.tokenizer.pre_tokenizer)
        self.plain = pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre and self.tokenizer.normalizer is None
        self.added = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.runs = re.compile(f" (?<=[{SPACE}] )")
        self.feeds = re.compile(r"(?<=\S)\n(?=\S)")
        self.beside = re.compile(f"\n(?:(?=[{SPACE}\x1c-\x1f])|(?<=[{SPACE}\x1c-\x1f]\n))")    # a line feed next to other white space
        letters = _byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u2")
        self.merge = self.tokenizer.model.tokenize
        self.bar = self._bar(letters[0])
        self.feed = self._whole("\n")
        self.old: dict = {}
        self.tails: dict[str, bytes] = {}

    def _bar(self, letter: str) -> int | None:
        """The id of the zero byte's letter, which stands in no word, if pieces on its two sides get the ids they get alone."""
        model, vocab = self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False)
        alone = letter in vocab and sum(letter in token for token in vocab) == 1
        settings = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges")
        return vocab[letter] if alone and type(model).__name__ == "BPE" and not any(getattr(model, x) for x in settings) else None

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, text: str) -> list[int]:
        return [t.id for t in self.merge(self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le"))]

    def _pieces(self, texts: list[str], lead: str = "") -> list[bytes]:
        """Ids of texts that are one piece each with `lead` before them."""
        if self.bar is None:
            return [array(self.code, self._merged(lead + t)).tobytes() for t in texts]
        ids = array(self.code)
        for at in range(0, len(texts), PIECES):
            ids.extend(self._merged(lead + f"\0{lead}".join(texts[at:at + PIECES])))
            ids.append(self.bar)
        ends = np.flatnonzero(np.frombuffer(ids, self.dtype) == self.bar)
        starts = np.r_[0, ends[:-1] + 1] * self.dtype.itemsize
        joined, ends = ids.tobytes(), ends * self.dtype.itemsize
        return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _tail(self, marks: str) -> bytes:
        """Ids of closing marks; few strings of them occur."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._pieces([marks])[0]
            if len(marks) <= 8 and len(self.tails) < CACHE_TAILS:
                self.tails[marks] = ids
        return ids

    def _keep(self, units: dict) -> None:
        """Two halves of a cache: what is met again moves to the young one, and the old one goes when that is full."""
        half = CACHE_UNITS // 2
        if len(self) + len(units) > half:
            self.old = dict(self)
            self.clear()
        self.update(units if len(units) <= half else islice(units.items(), half))

    def _learn(self, units: dict) -> None:
        """Fill in the ids of pre-tokens that the young cache lacks. A word met first is kept without its closing marks."""
        old, kept = self.old, {}
        words, others, marked, lined = [], {}, [], []
        for unit in units:
            ids = old.get(unit)
            if ids is not None:
                units[unit] = kept[unit] = ids
                continue
            if unit.__class__ is str:
                if unit.isalpha() and len(unit) <= LONG_UNIT:
                    words.append(unit)
                    continue
                before, text, lead = (self.feed, unit[1:], "") if unit[:1] == "\n" else (b"", unit, " ")
            else:
                before, text, lead = b"", unit[0], ""
            stem = text.rstrip(self.MARKS)
            if stem.isalpha():
                key = stem if lead else (stem,)
                ids = self.get(key) or old.get(key)
                if ids is None:
                    if not lead or key not in units or len(key) > LONG_UNIT:
                        others[key] = lead + stem
                    marked.append((unit, before, key, text[len(stem):]))
                    continue
                if len(stem) < len(text):
                    ids += self._tail(text[len(stem):])
                ids = before + ids
            else:
                lines = self.feeds.split(text) if "\n" in text else ()
                if len(lines) > 1:
                    lined.append((unit, before, [lines[0] if lead else (lines[0],), *[(line,) for line in lines[1:]]]))
                    continue
                ids = before + self._whole(lead + text)
            units[unit] = ids
            if len(text) <= LONG_UNIT:
                kept[unit] = ids
        if words:
            found = dict(zip(words, self._pieces(words, " "), strict=True))
            units.update(found)
            kept.update(found)
        if others:
            others = dict(zip(others, self._pieces(list(others.values())), strict=True))
            kept.update((key, ids) for key, ids in others.items() if len(key if key.__class__ is str else key[0]) <= LONG_UNIT)
        for unit, before, key, tail in marked:
            ids = before + (others[key] if key in others else units[key])
            units[unit] = ids + self._tail(tail) if tail else ids
        self._keep(kept)
        if lined:
            found = iter(self._found([line for _, _, lines in lined for line in lines]))
            for unit, before, lines in lined:
                units[unit] = before + self.feed.join(islice(found, len(lines)))
            self._keep({unit: units[unit] for unit, _, _ in lined if len(unit if unit.__class__ is str else unit[0]) <= LONG_UNIT})

    def _found(self, units: list) -> list[bytes]:
        ids = list(map(self.get, units))
        at = [i for i, x in enumerate(ids) if x is None]
        if at:
            missing = dict.fromkeys([units[i] for i in at])
            self._learn(missing)
            for i in at:
                ids[i] = missing[units[i]]
        return ids

    def _units(self, text: str) -> list | None:
        """The pre-tokens of a text; none if it has to be encoded whole."""
        if not self.plain or any(a in text for a in self.added) or self.runs.search(text):
            return None
        if "\n" not in text:
            units = text.split(" ")
        elif not self.beside.search(text):
            units = text.replace("\n", " \n").split(" ")
        else:
            units = [u if u[:1] != "\n" else (" " + u,) for u in text.split(" ")]
            units[0] = text.partition(" ")[0]
        units[0] = (units[0],)
        return units

    def encode(self, batch: list[str]) -> list[bytes]:
        out: list = [None] * len(batch)
        units, spans = [], []

        def join() -> None:
            ids = self._found(units)
            for i, a, b in spans:
                out[i] = b"".join(ids[a:b])

        for i, text in enumerate(batch):
            own = self._units(text)
            if own is None:
                out[i] = self._whole(text)
            elif len(own) > UNITS:
                out[i] = b"".join([b"".join(self._found(own[at:at + UNITS])) for at in range(0, len(own), UNITS)])
            else:
                if len(units) + len(own) > UNITS:
                    join()
                    units, spans = [], []
                spans.append((i, len(units), len(units) + len(own)))
                units += own
        join()
        return out


# ---------------------------------------------------------------- coding

LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each id's length stands if every document starts a new control byte, and the first control byte of each document and after the last."""
    control = np.r_[0, np.cumsum(-(-counts // 4))]
    return np.arange(counts.sum()) + np.repeat(4 * control[:-1] - (np.cumsum(counts) - counts), counts), control


def pack_documents(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of documents whose ranks stand one after another."""
    wide = int(ranks.max(initial=0)) > 0xFFFF
    ranks = ranks.astype("<u4" if wide else "<u2", copy=False)
    more = (ranks > 0xFF).astype(np.uint8)
    if wide:
        more += ranks > 0xFFFF
        more += ranks > 0xFFFFFF
    at, control_at = places(counts)
    padded = np.zeros(4 * control_at[-1], np.uint8)
    padded[at] = more
    four = padded.view("<u4")       # two bits of each byte
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, ranks.itemsize)[np.arange(ranks.itemsize) <= more[:, None]].tobytes()
    ends = np.r_[0, np.cumsum(counts)]
    data_at = ends + np.r_[0, np.cumsum(more, dtype=np.int64)][ends]
    return _slices(control, control_at), _slices(data, data_at)


def _slices(joined: bytes, at: np.ndarray) -> list[bytes]:
    return [joined[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def unpack_documents(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The ranks of documents, one after another."""
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()[places(counts)[0]]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        if not len(at):
            break
        ranks[at] |= raw[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document's ranks."""
    control, data = pack_documents(ranks, np.array([len(ranks)]))
    return control[0], data[0]


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    return unpack_documents([control], [data], np.array([n]))


def runs_of(counts: np.ndarray) -> Iterator[slice]:
    """Documents taken together, about CODED_IDS ids at a time or one with more."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CODED_IDS, "right")))
        yield slice(lo, hi)
        lo = hi


# ---------------------------------------------------------------- files

def _bounds(rows: DataFrame, n: int) -> np.ndarray:
    """Quantiles of doc: about equal shares of rows between them."""
    found = rows.agg(F.percentile_approx("doc", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    return np.unique(np.array(found or [], np.int64))


def _frequencies(ids: DataFrame, size: int, dtype: np.dtype, done: str = "") -> np.ndarray:
    """How often each id occurs over all documents; one entry per id of the vocabulary. Workers drop the object `done`."""
    width = -(-size // COUNT_SLICES)
    partial, summed = arrow("slice int, blob binary"), arrow("slice int, blob binary")

    def count(batches):
        forget(done)
        total = np.zeros(width * COUNT_SLICES, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=len(total))
        yield rows_out(partial, [range(COUNT_SLICES), [x.tobytes() for x in total.reshape(COUNT_SLICES, width)]])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(blob, np.int64)
        yield rows_out(summed, [list(totals), [x.tobytes() for x in totals.values()]])

    parts = mapped(mapped(ids.select("ids"), count, "slice int, blob binary").repartition("slice"), add, "slice int, blob binary")
    out = np.zeros(width * COUNT_SLICES, np.int64)
    with small_batches(ids.sparkSession):
        found = parts.collect()  # as long as the vocabulary
    for k, blob in found:
        out[k * width:(k + 1) * width] = np.frombuffer(blob, np.int64)
    return out[:size]


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise whole texts and write `folder`/ids and `folder`/vocab."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).withColumn("crc", F.crc32("text"))
    bounds = _bounds(rows, buckets_of(spark))
    raw = arrow("part int, doc long, crc long, n long, ids binary")

    def encode(batches):
        encoder = per_worker(f"encoder_{tokenizer_path}", lambda: Encoder(tokenizer_path))
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [x + end for x in encoder.encode(part.column(2).to_pylist())]
                doc = np.asarray(part.column(0))
                yield rows_out(raw, [np.searchsorted(bounds, doc), doc, part.column(1), [len(x) // encoder.dtype.itemsize for x in ids], ids])

    encoder = Encoder(tokenizer_path)
    size, dtype = max(encoder.tokenizer.get_vocab_size(), end_id + 1), encoder.dtype
    ids = written(mapped(rows, encode, "part int, doc long, crc long, n long, ids binary"), "token-ids")
    counts = _frequencies(ids, size, dtype, f"encoder_{tokenizer_path}")
    order = np.lexsort((np.arange(size), -counts))
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    coded = arrow("part int, doc long, crc long, n long, control binary, data binary")

    def code(batches):
        for batch in batches:
            counts, ids = np.asarray(batch.column(3)), batch.column(4).to_pylist()
            for part in runs_of(counts):
                control, data = pack_documents(rank[np.frombuffer(b"".join(ids[part]), dtype)], counts[part])
                yield rows_out(coded, [*(c.slice(part.start, part.stop - part.start) for c in batch.columns[:4]), control, data])

    (mapped(ids, code, "part int, doc long, crc long, n long, control binary, data binary").repartition("part")
     .sortWithinPartitions("part", "doc", "crc").write.option("compression", "zstd").parquet(f"{folder}/ids"))
    spark.createDataFrame([(r, int(i), int(counts[i])) for r, i in enumerate(order)], "rank int, id int, n long").coalesce(1).write.parquet(f"{folder}/vocab")


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """part, doc, crc, n and the decoded ids (32-bit, little-endian), or their crc32 instead."""
    vocab = spark.read.parquet(f"{folder}/vocab").orderBy("rank").select("id").collect()  # as long as the vocabulary
    to_id = np.array([r[0] for r in vocab], np.uint32)
    fields = "part int, doc long, crc long, n long, " + ("ids_crc32 long" if digest else "ids binary")
    schema = arrow(fields)

    def decode(batches):
        for batch in batches:
            counts, control, data = np.asarray(batch.column(3)), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for part in runs_of(counts):
                ids = to_id[unpack_documents(control[part], data[part], counts[part])].astype("<u4", copy=False)
                ids = _slices(ids.tobytes(), 4 * np.r_[0, np.cumsum(counts[part])])
                yield rows_out(schema, [*(c.slice(part.start, part.stop - part.start) for c in batch.columns[:4]), [zlib.crc32(x) for x in ids] if digest else ids])

    return mapped(spark.read.schema("part int, doc long, crc long, n long, control binary, data binary").parquet(f"{folder}/ids"), decode, fields)


def token_index(read: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before each one, to the rows of `read_ids`."""
    parts = read.groupBy("part").agg(F.sum("n").alias("_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("doc", "crc").rowsBetween(Window.unboundedPreceding, -1)
    return (read.withColumn("_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("_p"))
            .withColumn("start", F.col("_start") + F.col("_before")).drop("_p", "_start", "_before"))


def encoded_index(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the documents' ids, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{work_folder(spark)}/feedloom-llm/token-files-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer_path, folder, end_id)
    read = written(read_ids(spark, folder, digest=True), "token-digests")
    return token_index(read).select(doc_id(), "start", F.col("n").alias("n_tokens"), "ids_crc32")
