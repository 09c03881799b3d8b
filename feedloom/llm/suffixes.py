"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix that starts a string of `depth` bytes which also starts earlier (smaller doc_id,
or the same document and an earlier start) marks those bytes for removal. Only suffixes
that can have an equal are sorted, and only through `depth` bytes:

1. Each suffix's first `depth` bytes choose an anchor, the smallest hash among their grams
   of `gram` bytes. Equal strings choose equal anchors, so the anchor is the first, most
   significant digit. Anchors that occur once in the corpus end here: a packed shuffle of
   20 bytes per anchor (about one per 40 bytes of text) tells which occur again.
2. The text around the others is sent by anchor, each stretch once per task (a stretch that
   an earlier document of the same task holds is marked at once).
3. For each anchor, suffixes are told apart by passes over the next 8 bytes each, most
   significant first; suffixes alone in their group leave the sort. Groups that are equal
   through `depth` bytes are exactly the repeated strings; all but their earliest are marked.
4. Marked stretches go back to their documents, one row of runs each.

Texts are UTF-8 bytes, a null text is empty, and matches never cross documents. A null
doc_id sorts last. Rows that repeat doc_id and text are one document with one result;
rows with equal doc_id and other texts are ordered by their text's hash. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from feedloom.llm.common import FLUSH_BYTES, RUN, Packer, arrow, buckets_of, by_bucket, chunks, doc_bucket, doc_id, gathered, keyed, mapped, mix, \
    pack_runs, per_document, rows_out, spread, texts, travels, window_runs

travels(__name__)

ANCHOR = np.dtype([("h", "<u4"), ("doc", "<i8"), ("crc", "<i8"), ("first", "<u4")])     # the bucket holds the hash's upper bits
REPLY = 1 << 18     # suffixes a sorting task handles at a time, if no anchor has more


def _bytes_of(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in a row, the text each byte stands in, and where the texts start."""
    size = np.array([len(t) for t in held], np.int64)
    owner = np.repeat(np.arange(len(held), dtype=np.int32), size) if len(held) > 1 else np.broadcast_to(np.int32(0), int(size.sum()))
    return np.frombuffer(b"".join(held), np.uint8), owner, np.cumsum(size) - size


def _anchors(held: list[bytes], depth: int, gram: int):
    data, owner, base = _bytes_of(held)
    for first, _, _, h in window_runs(data, owner, depth, gram):
        own = owner[first]
        yield own, first - base[own], mix(h)


def repeated_anchors(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """(doc, crc, runs): the first suffix of each run whose anchor occurs again (twice in a pair).

    A hash is cut to 32 bits and its bucket, so now and then an anchor passes that occurs
    once; the sort finds it alone.
    """
    n = buckets_of(rows.sparkSession)

    def send(batches):
        packer = Packer(n)
        for doc, crcs, held in chunks(batches):
            for own, first, h in _anchors(held, depth, gram):
                out = np.empty(len(own), ANCHOR)
                out["h"], out["doc"], out["crc"], out["first"] = h.astype("<u4"), doc[own], crcs[own], first
                yield from packer.add(out, spread(h, n))
        yield from packer.flush()

    def again(batches):
        packer = Packer(n)
        for _, a in by_bucket(batches, ANCHOR):
            order = np.argsort(a["h"])
            h = a["h"][order]
            same = np.r_[False, h[1:] == h[:-1]]
            same[:-1] |= same[1:]
            hit = a[np.sort(order[same])]
            if len(hit):
                yield from packer.add(pack_runs(hit["doc"], hit["crc"], hit["first"], hit["first"]), doc_bucket(hit["doc"].copy(), n))
        yield from packer.flush()

    return per_document(mapped(gathered(mapped(rows, send, "bucket int, blob binary")), again, "bucket int, blob binary"), RUN)


def _equal_groups(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (index, group) of suffixes equal to another through `depth` bytes."""
    keep = np.arange(len(starts))
    # a digit is the 8 bytes from a place on, read by one look-up
    digits = np.ndarray((max(len(data) - 7, 0),), ">u8", data, strides=(1,))
    for at in [*range(0, depth - 8, 8), depth - 8]:
        if not len(keep):
            break
        digit = digits[starts[keep] + at].astype(np.uint64)
        together = groups[1:] == groups[:-1]
        differs = together & (digit[1:] != digit[:-1])
        if differs.any():       # only groups in which this digit differs are sorted
            number = np.cumsum(np.r_[True, ~together]) - 1
            mixed = np.zeros(number[-1] + 1, bool)
            mixed[number[1:][differs]] = True
            rows = np.flatnonzero(mixed[number])
            order = rows[np.lexsort((digit[rows], number[rows]))]
            digit[rows], keep[rows] = digit[order], keep[order]
            together &= digit[1:] == digit[:-1]
        new = np.r_[True, ~together]
        alone = new & np.r_[new[1:], True]
        groups = np.cumsum(new)[~alone]
        keep = keep[~alone]
    return keep, groups


HEAD = np.dtype([("h", "<u8"), ("doc", "<i8"), ("crc", "<i8"), ("first", "<u4"), ("n", "<u4"), ("size", "<u4")])


def _sorted_runs(head: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Runs to remove among stretches (head rows over data, in any order)."""
    order = np.lexsort((head["first"], head["crc"], head["doc"], head["h"]))
    head, offset = head[order], (np.cumsum(head["size"].astype(np.int64)) - head["size"])[order]
    once = np.r_[True, np.any([head[k][1:] != head[k][:-1] for k in ("h", "doc", "crc", "first")], axis=0)][:len(head)]
    head, offset = head[once], offset[once]     # rows that repeat doc and text are one document
    new = np.r_[True, head["h"][1:] != head["h"][:-1]]
    group = np.cumsum(new) - 1
    found = []
    edges = np.flatnonzero(new)
    total = np.cumsum(head["n"].astype(np.int64))
    lo = 0
    while lo < len(head):  # whole anchors, about REPLY suffixes at a time
        before = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, before + REPLY, "right")), lo + 1)
        nxt = np.searchsorted(edges, hi, "left")
        hi = int(edges[nxt]) if nxt < len(edges) else len(head)
        part, off, grp = head[lo:hi], offset[lo:hi], group[lo:hi]
        n = part["n"].astype(np.int64)
        row = np.repeat(np.arange(len(part)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        keep, equal = _equal_groups(data, off[row] + step, grp[row], depth)
        # rows stand by (doc, crc, first), so the smallest index of a group starts first
        order = np.lexsort((keep, equal))
        keep, equal = keep[order], equal[order]
        later = keep[np.r_[False, equal[1:] == equal[:-1]]] if len(keep) else keep
        later = np.sort(later)
        if len(later):
            own = part[row[later]]
            at = own["first"].astype(np.int64) + step[later]
            cut = np.flatnonzero(np.r_[True, (row[later][1:] != row[later][:-1]) | (at[1:] > at[:-1] + 1)])
            last = np.r_[cut[1:] - 1, len(at) - 1]
            found.append(pack_runs(own["doc"][cut], own["crc"][cut], at[cut], at[last] + depth))
        lo = hi
    return np.concatenate(found) if found else np.empty(0, RUN)


def repeated_runs(rows: DataFrame, depth: int, gram: int) -> DataFrame:
    """(doc, crc, runs): byte runs covered by strings that also start earlier."""
    n = buckets_of(rows.sparkSession)
    schema = arrow("bucket int, heads binary, data binary")

    def send(batches):
        held: list[tuple[np.ndarray, bytes]] = []
        size = 0
        for batch in batches:
            blobs = batch.column(batch.schema.get_field_index("runs")).to_pylist()
            for (doc, crcs, text), blob in zip(texts(batch), blobs, strict=True):
                data, owner = np.frombuffer(text, np.uint8), np.broadcast_to(np.int8(0), len(text))
                pairs = np.frombuffer(blob, np.int32).reshape(-1, 2)
                again = {int(x) for x in pairs[:, 0]}
                for first, last, _, h in window_runs(data, owner, depth, gram):
                    keep = np.isin(first, pairs[:, 0]) if len(again) != len(first) else slice(None)
                    first, last, h = first[keep], last[keep], mix(h[keep])
                    head = np.empty(len(first), HEAD)
                    head["h"], head["doc"], head["crc"], head["first"], head["n"] = h, doc, crcs, first, last - first + 1
                    head["size"] = last - first + depth
                    held.append((head, b"".join([text[a:b + depth] for a, b in zip(first.tolist(), last.tolist(), strict=True)])))
                    size += len(held[-1][1])
            if size > FLUSH_BYTES:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        head, data = np.concatenate([h for h, _ in held]), b"".join([d for _, d in held])
        end = np.cumsum(head["size"].astype(np.int64))
        view = memoryview(data)
        stretch = [bytes(view[e - s:e]) for s, e in zip(head["size"].tolist(), end.tolist(), strict=True)]
        # a stretch that the task holds twice goes once; the later ones are marked as they are
        order = np.lexsort((head["first"], head["crc"], head["doc"]))
        seen, keep, later = {}, [], []
        place = list(zip(head["doc"].tolist(), head["crc"].tolist(), head["first"].tolist(), strict=True))
        for i, name in zip(order.tolist(), [(stretch[i], int(head["h"][i])) for i in order.tolist()], strict=True):
            if name not in seen:
                seen[name] = place[i]
                keep.append(i)
            elif place[i] != seen[name]:
                later.append(i)
        keep = np.array(keep, np.int64)
        bucket = spread(head["h"], n)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cut = np.flatnonzero(np.r_[True, bucket[keep][1:] != bucket[keep][:-1]])
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keep)], strict=True):
            own = keep[a:b]
            yield rows_out(schema, [[bucket[own[0]]], [head[own].tobytes()], [b"".join([stretch[i] for i in own.tolist()])]])
        if later:
            runs = head[np.array(later)]
            runs = pack_runs(runs["doc"], runs["crc"], runs["first"], runs["first"] + runs["size"])
            yield rows_out(schema, [[-1], [runs.tobytes()], [b""]])

    def sort(batches):
        packer = Packer(n)
        now, heads, data = None, [], []

        def done():
            if heads and now != -1:
                runs = _sorted_runs(np.frombuffer(b"".join(heads), HEAD), np.frombuffer(b"".join(data), np.uint8), depth)
                yield from packer.add(runs, doc_bucket(runs["doc"].copy(), n))

        for batch in batches:
            for bucket, head, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket == -1:
                    runs = np.frombuffer(head, RUN)
                    yield from packer.add(runs, doc_bucket(runs["doc"].copy(), n))
                    continue
                if bucket != now:
                    yield from done()
                    now, heads, data = bucket, [], []
                heads.append(head)
                data.append(blob)
        yield from done()
        yield from packer.flush()

    flagged = rows.join(repeated_anchors(rows, depth, gram), ["doc", "crc"])
    stretches = mapped(flagged, send, "bucket int, heads binary, data binary")
    return per_document(mapped(gathered(stretches), sort, "bucket int, blob binary"), RUN)


def dedup_bytes(docs: DataFrame, depth: int = 100, gram: int = 20, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows, depth, gram)
    fields = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    schema = arrow(fields)

    def keep(batches):
        for batch in batches:
            out = []
            for (doc, _, text), blob in zip(texts(batch), batch.column(batch.schema.get_field_index("runs")).to_pylist(), strict=True):
                kept, spans = text, 0
                if blob:
                    pairs = np.frombuffer(blob, np.int32).reshape(-1, 2).astype(np.int64)
                    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1])
                    new = np.r_[True, start[1:] > end[:-1]]
                    start, end = start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
                    spans = len(start)
                    kept = b"".join([text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)])
                out.append((doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield rows_out(schema, list(zip(*out, strict=True))[:len(schema)])

    return mapped(rows.join(runs, ["doc", "crc"], "left"), keep, fields).select(doc_id(), *[f.name for f in schema][1:])
