"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are folded: lower case, runs of anything but letters and digits as one
blank. An item is looked for by passages of `span` folded characters every `step` (the
whole item if it is shorter), each with an edit budget of `budget` times its length, cut
where the lemma would lose its force. If a passage of length L occurs with at most k
edits, then at least L - q + 1 - k q of its q-grams occur on 2 k + 1 neighbouring
diagonals (text position less item position). Bands of twice that width overlap by half,
so one of them holds all; bands with too few shared q-grams are dropped, and in the
others the passage is verified by alignment inside the band.

Items are read in blocks of bounded size; each block goes to the tasks and is held
against all texts. Items of fewer than `least` folded characters are no evidence and match nothing;
so do null items and null texts. A text or an item may be given twice and
is reported twice. Columns other than id and text are kept by `clean` and ignored by `leaks`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import arrow, mapped, per_worker, rows_out, travels, window_hashes

travels(__name__)

Q = 8
TABLE_BITS = 22
BLOCK_CHARS = 4 << 20
PIECE, OVERLAP = 1 << 18, 1 << 10      # folded characters of a long text handled at a time; more than a passage and its band


def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts in a row, their places in the joined lower-case texts, and where those begin."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\0".join(lower) + "\0").encode("utf-32-le", "replace"), np.uint32)
    kept = per_worker("alnum", _alnum)[codes]
    keep = kept.copy()
    keep[1:] |= kept[:-1]
    at = np.flatnonzero(keep)
    size = np.array([len(t) + 1 for t in lower], np.int64)
    return np.where(kept, codes, np.uint32(32))[at], at, np.cumsum(size) - size


@dataclass
class Block:
    """Some folded items and their q-grams."""

    ids: list
    codes: list[np.ndarray]
    passages: list[list[tuple[int, int, int]]]     # (start, length, edit budget)
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    need: np.ndarray
    half: np.ndarray
    starts: list[tuple[np.ndarray, int, int]]

    @classmethod
    def build(cls, items: list[tuple], span: int, step: int, budget: float, least: int) -> Block:
        ids, codes, passages = [], [], []
        for id_, text in items:
            own = fold([text])[0]
            own = own[:-1] if len(own) and own[-1] == 32 else own
            if len(own) < max(least, Q):
                continue
            size = min(span, len(own))
            edits = min(int(budget * size), (size - Q) // Q)
            starts = sorted({*range(0, len(own) - size + 1, step), len(own) - size})
            ids.append(id_)
            codes.append(own)
            passages.append([(s, size, edits) for s in starts])
        h = [window_hashes(c.astype(np.uint64) + np.uint64(1), Q) for c in codes]
        keys = np.concatenate(h) if h else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(h)), [len(x) for x in h]) if h else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, item, place = keys[order], item[order], place[order]
        table = np.zeros(1 << TABLE_BITS, bool)
        table[keys >> np.uint64(64 - TABLE_BITS)] = True
        unique, first = np.unique(keys, return_index=True)
        need = np.array([p[0][1] - Q + 1 - p[0][2] * Q for p in passages], np.int64)
        half = np.array([2 * p[0][2] + 1 for p in passages], np.int64)
        starts = [(np.array([x[0] for x in p]), p[0][1], p[0][2]) for p in passages]
        return cls(ids, codes, passages, unique, np.r_[first, len(keys)], item, place, table, need, half, starts)


def align(passages: np.ndarray, bands: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits and end of each passage's best place in its band; edits + 1 beyond the budget.

    A row of `bands` holds the text of a band, as long as the passage and the band's width
    less one; cell (i, b) of the alignment has read i characters of the passage and stands at
    i + b in the row, so only the band's diagonals are computed, for all rows at once.
    """
    size = passages.shape[1]
    width = bands.shape[1] - size + 1
    shift = np.arange(width, dtype=np.int16)
    best, end = np.full(len(passages), edits + 1, np.int64), np.zeros(len(passages), np.int64)
    alive, cost = np.arange(len(passages)), np.zeros((len(passages), width), np.int16)
    for i in range(size):
        step = cost + (bands[:, i:i + width] != passages[:, i:i + 1])
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
        step -= shift
        np.minimum.accumulate(step, axis=1, out=step)
        cost = step + shift
        if i % 8 == 7:
            on = cost.min(1) <= edits
            if not on.all():
                alive, cost, bands, passages = alive[on], cost[on], bands[on], passages[on]
            if not len(alive):
                return best, end
    at = cost.argmin(1)
    least = cost[np.arange(len(alive)), at]
    best[alive], end[alive] = np.minimum(least, edits + 1), at + size
    return best, end


ALIGNED = 2048      # candidates aligned at once


def find(codes: np.ndarray, owner: np.ndarray, begins: np.ndarray, block: Block) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start, end, edits, passages) of the items found in folded texts; start and end count folded characters of the row."""
    if len(codes) < Q or not len(block.keys):
        return []
    h = window_hashes(codes.astype(np.uint64) + np.uint64(1), Q)
    at = np.flatnonzero(block.table[h >> np.uint64(64 - TABLE_BITS)])
    key = np.searchsorted(block.keys, h[at])
    known = key < len(block.keys)
    known[known] = block.keys[key[known]] == h[at][known]
    at, key = at[known], key[known]
    if not len(at):
        return []
    many = block.first[key + 1] - block.first[key]
    hit = np.repeat(block.first[key] - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(at, many)
    item, place, text = block.item[hit], block.place[hit], owner[at]
    pair, pair_of = np.unique(text.astype(np.int64) * len(block.ids) + item, return_inverse=True)
    half = block.half[item]
    low = -int(place.max())      # the least diagonal
    base = low // half           # halves are numbered from here, so none is negative
    half_of = (at - begins[text] - place) // half - base
    places = int(place.max()) + 1
    bands = int(half_of.max()) // 2 + 2
    waiting: dict[tuple[int, int], list] = {}
    for odd in (0, 1):      # bands of two halves, once from even and once from odd ones
        cell = np.unique((pair_of * bands + (half_of + odd) // 2) * places + place)     # a place of the item counts once in a band
        where, cell = cell % places, cell // places
        cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        stop = np.r_[cut[1:], len(cell)]
        k = pair[cell[cut] // bands] % len(block.ids)
        full = stop - cut >= block.need[k]
        for a, z, k in zip(cut[full].tolist(), stop[full].tolist(), k[full].tolist(), strict=True):
            starts, size, edits = block.starts[k]
            own = where[a:z]
            enough = np.searchsorted(own, starts + size - Q, "right") - np.searchsorted(own, starts) >= block.need[k]
            if enough.any():
                t, h_ = int(pair[cell[a] // bands]) // len(block.ids), int(block.half[k])
                first = (2 * int(cell[a] % bands) - odd + low // h_) * h_
                waiting.setdefault((size, edits), []).extend((t, k, s, s + first) for s in starts[enough].tolist())
    found: dict[tuple[int, int], list] = {}
    ends = np.searchsorted(owner, np.arange(len(begins)), "right")
    for (size, edits), todo in waiting.items():
        width = 2 * (2 * edits + 1)
        for lo in range(0, len(todo), ALIGNED):
            part = todo[lo:lo + ALIGNED]
            t = np.array([x[0] for x in part])
            start = np.array([x[3] for x in part]) + begins[t]
            spot = start[:, None] + np.arange(size + width - 1)
            inside = (spot >= begins[t][:, None]) & (spot < ends[t][:, None])
            rows = np.where(inside, codes[np.clip(spot, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
            best, end = align(np.stack([block.codes[k][s:s + size] for _, k, s, _ in part]), rows, edits)
            for n in np.flatnonzero(best <= edits).tolist():
                close = int(start[n] + end[n])
                found.setdefault((part[n][0], part[n][1]), []).append((close - size, close, int(best[n]), part[n][2]))
    return [(t, k, max(int(begins[t]), min(x[0] for x in own)), max(x[1] for x in own), min(x[2] for x in own), len({x[3] for x in own}))
            for (t, k), own in found.items()]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, span: int, step: int, budget: float, least: int):
    """The items as blocks of about BLOCK_CHARS characters, in the order of their ids."""
    held, size = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for id_, text in rows.orderBy("id", "text").toLocalIterator():
        if held and size + len(text) > BLOCK_CHARS:
            yield Block.build(held, span, step, budget, least)
            held, size = [], 0
        held.append((id_, text))
        size += len(text)
    if held:
        yield Block.build(held, span, step, budget, least)


def _matches(texts: list, block: Block) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, start, end, edits, passages); start and end count characters of the lower-case text."""
    out, held, size = [], [], 0

    def search(ids):
        codes, at, starts = fold([texts[i] for i in ids])
        owner = np.searchsorted(starts, at, "right") - 1
        edge = np.arange(0, max(len(codes), 1), PIECE) if len(ids) == 1 else [0]
        got: dict[tuple[int, int], tuple] = {}
        for lo in edge:
            hi = min(len(codes), lo + PIECE + OVERLAP) if len(ids) == 1 else len(codes)
            own = owner[lo:hi]
            begins = np.searchsorted(own, np.arange(len(ids)))
            for t, k, start, end, edits, n in find(codes[lo:hi], own, begins, block):
                a, z = int(at[lo + start] - starts[t]), int(at[min(lo + end, len(at)) - 1] - starts[t]) + 1
                old = got.get((t, k))
                got[t, k] = (a, z, edits, n) if old is None else (min(a, old[0]), max(z, old[1]), min(edits, old[2]), max(n, old[3]))
        out.extend((ids[t], k, *x) for (t, k), x in got.items())

    for i, text in enumerate(texts):
        if not text:
            continue
        if held and size + len(text) > PIECE:
            search(held)
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        search(held)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", span: int = 120, step: int = 40,
          budget: float = 0.1, least: int = 40) -> DataFrame:
    """One row per text and item found in it: doc_id, item_id, start, stop, edits, passages, share (of the item's passages)."""
    fields = "doc_id long, item_id long, start long, stop long, edits long, passages long, share double"
    schema = arrow(fields)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def task_of(block):
        def task(batches):
            for batch in batches:
                doc = batch.column(0).to_pylist()
                got = _matches(batch.column(1).to_pylist(), block)
                if got:
                    yield rows_out(schema, list(zip(*[(doc[t], block.ids[k], a, z, e, n, n / len(block.passages[k])) for t, k, a, z, e, n in got], strict=True)))
        return task

    parts = [mapped(rows, task_of(b), fields) for b in blocks(benchmark, item_col, "text", span, step, budget, least)]
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], fields)
    for part in parts[1:]:
        out = out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", span: int = 120, step: int = 40, budget: float = 0.1,
          least: int = 40) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    def task_of(block):
        def task(batches):
            for batch in batches:
                dirty = {t for t, *_ in _matches(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), block)}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))
        return task

    for block in blocks(benchmark, item_col, "text", span, step, budget, least):
        docs = docs.mapInArrow(task_of(block), docs.schema)
    return docs
