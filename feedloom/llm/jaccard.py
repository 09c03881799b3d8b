"""N-gram Jaccard join and its components, over count vectors in R-trees.

A document's set holds the hashes of its distinct shingles of `words` words (A-Z in lower
case); with fewer words the whole sequence is its one shingle. Documents with equal sets
are one class, named by a 64-bit digest of the set. For the links between classes:

1. A class whose shingles are mostly its own links with nothing. One packed shuffle of
   every second hash value tells how many of a class's shingles some other class holds; it
   goes on only if those missing could all be outside the intersection. (An exact bound.)
2. Tokens of a set are dealt into GROUPS groups by hash. The group counts are the class's
   point, and the sum of the smaller coordinates of two points bounds their intersection.
   Two linked sets share one of their first (1 - t) n + 1 tokens in hash order, so each of
   those tokens is a cell with a tree over the points in it: boxes of LEAF points, and
   boxes of LEAF such boxes, are compared before points. Pairs survive if the bound allows
   the threshold.
3. Of the surviving pairs every class has its best one verified by its whole sets. Where
   that leaves the parts of a bundle of surviving pairs unconnected, one more tree over
   the bundle finds the pairs between different parts, and they are verified until the
   parts are connected or no pair is left. Pairs inside a part change no component.

Components come from the verified links. No task returns the pairs of a cell or a bundle,
only best partners, star forests and the links that connect parts. Shared counts of 255 and more go to an overflow
coordinate, so the bound holds for long texts.

A null or blank text has no shingle and is its own component. A null doc_id sorts last;
rows that repeat whole are one class. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import FLUSH_BYTES, NO_ID, PRIME, ROW, Packer, arrow, buckets_of, by_bucket, chunks, doc_id, gathered, keyed, mapped, mix, numbered, rows_out, spread, \
    travels, window_hashes, words_of, written
from feedloom.llm.components import components, star_forest

travels(__name__)

GROUPS, LEAF = 64, 32
POINT = np.dtype([("tok", "<u4"), ("cls", "<i8"), ("part", "<i8"), ("n", "<u4"), ("over", "<u4"), ("at", "u1", GROUPS)])
BEST = np.dtype([("cls", "<i8"), ("other", "<i8"), ("bound", "<f4")])
SHARED = np.dtype([("cls", "<i8"), ("n", "<u4")])


# ---------------------------------------------------------------- sets

def shingle_sets(held: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin (one more at the end)."""
    values, owner = words_of(held, fold=True)
    h = window_hashes(values, words)
    own = owner[:len(h)]
    inside = own == owner[words - 1:] if len(h) else np.zeros(0, bool)
    h, own = h[inside], own[inside]
    bounds = np.searchsorted(owner, np.arange(len(held) + 1))
    size = np.diff(bounds)
    short = np.flatnonzero((size > 0) & (size < words))
    if len(short):
        whole = np.concatenate([mix(window_hashes(values[bounds[i]:bounds[i + 1]], int(size[i])) ^ size[i:i + 1].astype(np.uint64) * PRIME) for i in short])
        h, own = np.r_[h, whole], np.r_[own, short]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][:len(h)]
    h, own = h[once], own[once]
    return h, np.searchsorted(own, np.arange(len(held) + 1))


def digests(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        total, other = np.add.reduceat(mix(h + PRIME), bounds[full]), np.bitwise_xor.reduceat(mix(h ^ PRIME), bounds[full])
        out[full] = np.maximum(mix(total ^ mix(other + np.diff(bounds)[full].astype(np.uint64))), np.uint64(1))
    return out


def class_table(rows: DataFrame, words: int) -> DataFrame:
    """(doc, crc, n, half, cls): set size, size of its tested half and class of every row."""
    fields = "doc long, crc long, n long, half long, cls long"
    schema = arrow(fields)

    def task(batches):
        for doc, crcs, held in chunks(batches):
            h, bounds = shingle_sets(held, words)
            half = np.r_[0, np.cumsum((h & np.uint64(1)) == 0)][bounds]
            yield rows_out(schema, [doc, crcs.astype(np.int64), np.diff(bounds), np.diff(half), digests(h, bounds).view(np.int64)])

    return mapped(rows, task, fields)


HEAD = np.dtype([("cls", "<i8"), ("k", "<u4")])


def _take_runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at start, one run after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def shared_counts(rows: DataFrame, words: int) -> DataFrame:
    """(cls, shared): tokens of the tested half that another class holds, of classes with any."""
    n = buckets_of(rows.sparkSession)
    sent = arrow("bucket int, heads binary, tokens binary")

    def send(batches):
        kept, size = [], 0
        for _, _, held in chunks(batches):
            h, bounds = shingle_sets(held, words)
            names = digests(h, bounds).view(np.int64)
            own = np.repeat(np.arange(len(held)), np.diff(bounds))
            test = (h & np.uint64(1)) == 0
            h, own = mix(h[test]), own[test]
            bucket = spread(h, n)
            order = np.lexsort((own, bucket))
            h, own, bucket = h[order], own[order], bucket[order]
            cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])][:len(h)])
            heads = np.empty(len(cut), HEAD)
            heads["cls"], heads["k"] = names[own[cut]], np.diff(np.r_[cut, len(h)])
            kept.append((bucket[cut], heads, h.astype("<u4")))
            size += heads.nbytes + 4 * len(h)
            if size > FLUSH_BYTES:
                yield from flush(kept)
                kept, size = [], 0
        yield from flush(kept)

    def flush(kept):
        if not kept:
            return
        bucket, heads, tokens = (np.concatenate(x) for x in zip(*kept, strict=True))
        if not len(bucket):
            return
        size = heads["k"].astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tokens = tokens[_take_runs((np.cumsum(size) - size)[order], size[order])]
        bucket, heads, size = bucket[order], heads[order], size[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
        end, stop = np.r_[cut[1:], len(bucket)], np.r_[0, np.cumsum(size)]
        yield rows_out(sent, [bucket[cut], [heads[a:b].tobytes() for a, b in zip(cut, end, strict=True)],
                              [tokens[stop[a]:stop[b]].tobytes() for a, b in zip(cut, end, strict=True)]])

    def find(batches):
        packer = Packer(n)
        now, heads, tokens = None, [], []

        def done():
            if not heads:
                return
            head, tok = np.frombuffer(b"".join(heads), HEAD), np.frombuffer(b"".join(tokens), "<u4")
            cls = np.repeat(head["cls"], head["k"])
            order = np.lexsort((cls, tok))
            tok, cls = tok[order], cls[order]
            new = np.r_[True, tok[1:] != tok[:-1]]
            first = np.flatnonzero(new)
            last = np.r_[first[1:] - 1, len(tok) - 1]
            shared = (cls[first] != cls[last])[np.cumsum(new) - 1]
            once = new | np.r_[True, cls[1:] != cls[:-1]]
            ids, count = np.unique(cls[shared & once], return_counts=True)
            out = np.empty(len(ids), SHARED)
            out["cls"], out["n"] = ids, count
            yield from packer.add(out, spread(mix(ids.view(np.uint64)), n))

        for batch in batches:
            for bucket, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from done()
                    now, heads, tokens = bucket, [], []
                heads.append(a)
                tokens.append(b)
        yield from done()
        yield from packer.flush()

    out = arrow("cls long, shared long")

    def add(batches):
        for _, r in by_bucket(batches, SHARED):
            ids, at = np.unique(r["cls"], return_inverse=True)
            yield rows_out(out, [ids, np.bincount(at, weights=r["n"]).astype(np.int64)])

    partial = mapped(gathered(mapped(rows, send, "bucket int, heads binary, tokens binary")), find, "bucket int, blob binary")
    return mapped(gathered(partial), add, "cls long, shared long")


def packed_texts(rows: DataFrame) -> DataFrame:
    """(doc, crc, packed): texts compressed before they are shuffled."""
    schema = arrow("doc long, crc long, packed binary")

    def task(batches):
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            yield rows_out(schema, [batch.column(0), batch.column(1), [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in raw]])

    return mapped(rows, task, "doc long, crc long, packed binary")


def class_sets(rows: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """(cls, n, tokens): sorted hashes of the sets of the chosen (doc, crc, cls)."""
    schema = arrow("cls long, n int, tokens binary")

    def task(batches):
        for batch in batches:
            raw = [pa.decompress(p[8:], int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True) for p in batch.column(1).to_pylist()]
            for at in range(0, len(raw), 64):
                h, bounds = shingle_sets(raw[at:at + 64], words)
                yield rows_out(schema, [batch.column(0)[at:at + 64], np.diff(bounds), [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]])

    return mapped(packed_texts(rows).join(chosen, ["doc", "crc"]).select("cls", "packed"), task, "cls long, n int, tokens binary")


# ---------------------------------------------------------------- points and trees

def _point_rows(cls: list[int], part: list[int], sets: list[np.ndarray]) -> np.ndarray:
    """One record for each set, without a cell."""
    out = np.zeros(len(sets), POINT)
    for k, h in enumerate(sets):
        count = np.bincount((mix(h) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
        out[k] = (0, cls[k], part[k], len(h), np.maximum(count - 255, 0).sum(), np.minimum(count, 255))
    return out


def _points(cls: list[int], part: list[int], tokens: list[bytes], t: float) -> tuple[np.ndarray, np.ndarray]:
    """One record for each token of the prefix of each set, and the tokens' hashes."""
    sets = [np.frombuffer(raw, np.uint64) for raw in tokens]
    prefix = [h[:len(h) - math.ceil(t * len(h) - 1e-9) + 1] for h in sets]
    rec = np.repeat(_point_rows(cls, part, sets), [len(p) for p in prefix])
    h = np.concatenate(prefix)
    rec["tok"] = mix(h ^ PRIME).astype("<u4")
    return rec, mix(h)


def tree_pairs(cell: np.ndarray, t: float):
    """Blocks (i, j, bound) of a cell's point pairs, i before j, whose bound allows the threshold.

    The points stand by size. A node's box is the largest coordinates and the range of
    sizes of its points; two nodes are opened if the smaller of their largest coordinates
    sum up to the intersection that their smallest sizes call for.
    """
    n, over, at = cell["n"].astype(np.float64), cell["over"].astype(np.float64), np.ascontiguousarray(cell["at"])
    need = t / (1 + t)

    def boxes(width):
        cut = np.arange(0, len(n), width)
        return np.maximum.reduceat(at, cut, axis=0), np.maximum.reduceat(over, cut), n[cut], np.r_[n[cut[1:] - 1], n[-1]]

    def overlap(a, over_a, b, over_b):
        out = np.empty((len(a), len(b)))
        for lo in range(0, len(b), 256):    # GROUPS times 255 fits 16 bits
            out[:, lo:lo + 256] = np.minimum(a[:, None, :], b[None, lo:lo + 256, :]).sum(2, dtype=np.uint16)
        return out + np.minimum(over_a[:, None], over_b[None, :])

    def meet(a, b):
        sizes = a[2][:, None] + b[2][None, :]
        return (overlap(a[0], a[1], b[0], b[1]) >= need * sizes - 1e-2) & (a[3][:, None] >= t * b[2][None, :] - 1e-2)

    outer, inner = boxes(LEAF * LEAF), boxes(LEAF)
    leaves = np.arange(len(inner[2]))
    for i in range(len(outer[2])):
        near = i + np.flatnonzero(meet([x[i:i + 1] for x in outer], [x[i:] for x in outer])[0])
        js = leaves[np.isin(leaves // LEAF, near)]
        own = leaves[i * LEAF:(i + 1) * LEAF]
        opened = meet([x[own] for x in inner], [x[js] for x in inner]) & (own[:, None] <= js[None, :])
        for x, row in zip(own.tolist(), opened, strict=True):
            u = slice(x * LEAF, (x + 1) * LEAF)
            v = (js[row][:, None] * LEAF + np.arange(LEAF)).ravel()
            for lo in range(0, len(v), 32 * LEAF):
                w = v[lo:lo + 32 * LEAF]
                w = w[w < len(n)]
                both = overlap(at[u], over[u], at[w], over[w])
                sizes = n[u][:, None] + n[w][None, :]
                fits = (both >= need * sizes - 1e-2) & (n[u][:, None] >= t * n[w][None, :] - 1e-2) & (np.arange(len(n))[u][:, None] < w[None, :])
                p, q = np.nonzero(fits)
                if len(p):
                    yield p + u.start, w[q], (both[p, q] / np.maximum(sizes[p, q] - both[p, q], 1)).astype(np.float32)


def cell_pairs(records: np.ndarray, t: float):
    """Blocks (i, j, bound) over all cells of records sorted by cell and size, like `tree_pairs`.

    A cell of one leaf needs no boxes; such cells are compared together, by their size.
    """
    need = t / (1 + t)
    edge = np.flatnonzero(np.r_[True, records["tok"][1:] != records["tok"][:-1]])
    size = np.diff(np.r_[edge, len(records)])
    n, over, at = records["n"].astype(np.float64), records["over"].astype(np.float64), np.ascontiguousarray(records["at"])
    for m in range(2, LEAF + 1):
        start = edge[size == m]
        a, b = np.triu_indices(m, 1)
        step = max(1, (1 << 18) // len(a))
        for lo in range(0, len(start), step):
            i, j = ((start[lo:lo + step, None] + x).ravel() for x in (a, b))
            near = n[i] >= t * n[j] - 1e-2
            i, j = i[near], j[near]
            both = np.minimum(at[i], at[j]).sum(1, dtype=np.uint16) + np.minimum(over[i], over[j])
            fits = both >= need * (n[i] + n[j]) - 1e-2
            i, j, both = i[fits], j[fits], both[fits]
            if len(i):
                yield i, j, (both / np.maximum(n[i] + n[j] - both, 1)).astype(np.float32)
    for a, m in zip(edge[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
        for i, j, bound in tree_pairs(records[a:a + m], t):
            yield i + a, j + a, bound


def _spread_points(sets: DataFrame, t: float) -> DataFrame:
    n = buckets_of(sets.sparkSession)

    def send(batches):
        packer = Packer(n)
        for batch in batches:
            cls, part, tokens = (batch.column(k).to_pylist() for k in (0, 1, 2))
            for at in range(0, len(cls), 64):
                rec, h = _points(cls[at:at + 64], part[at:at + 64], tokens[at:at + 64], t)
                yield from packer.add(rec, spread(h, n))
        yield from packer.flush()

    return gathered(mapped(sets.select("cls", "part", "tokens"), send, "bucket int, blob binary"))


def _top(best: np.ndarray) -> np.ndarray:
    """The best partner of each class; of equals the smallest."""
    best = best[np.lexsort((best["other"], -best["bound"], best["cls"]))]
    return best[np.r_[True, best["cls"][1:] != best["cls"][:-1]][:len(best)]]


def _forest(far: list[tuple[np.ndarray, np.ndarray]], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of earlier forests and more pairs."""
    none = np.empty(0, np.int64)
    return star_forest(np.concatenate([none, *(u for u, _ in far), *(r["cls"] for r in held)]), np.concatenate([none, *(v for _, v in far), *(r["other"] for r in held)]))


def best_partners(sets: DataFrame, t: float) -> DataFrame:
    """(kind, a, b): the best partner of every class (kind 0) and star forests of all surviving pairs (kind 1)."""
    n = buckets_of(sets.sparkSession)
    star = np.dtype([("a", "<i8"), ("b", "<i8")])
    schema = arrow("kind int, a long, b long")

    def search(batches):
        packer = Packer(2 * n)
        for _, records in by_bucket(batches, POINT):
            records = records[np.lexsort((records["cls"], records["n"], records["tok"]))]
            cls = records["cls"]
            best, far, held = np.empty(0, BEST), [], []
            for i, j, bound in cell_pairs(records, t):
                # the later point of a pair asks the earlier one
                rec = np.empty(len(i), BEST)
                rec["cls"], rec["other"], rec["bound"] = cls[j], cls[i], bound
                held.append(rec)
                if sum(map(len, held)) > 1 << 19:
                    best, far, held = _top(np.concatenate([best, *held])), [_forest(far, held)], []
            best, forest = _top(np.concatenate([best, *held])), _forest(far, held)
            if len(best):
                yield from packer.add(np.frombuffer(best.tobytes(), "u1").reshape(-1, BEST.itemsize), spread(mix(best["cls"].copy().view(np.uint64)), n))
                u, v = forest
                rec = np.zeros((len(u), BEST.itemsize), np.uint8)
                rec[:, :star.itemsize] = np.column_stack([u, v]).astype("<i8").view(np.uint8)
                yield from packer.add(rec, n + spread(mix(u.view(np.uint64)), n))
        yield from packer.flush()

    def choose(batches):
        for bucket, raw in by_bucket(batches, np.dtype("u1")):
            raw = raw.reshape(-1, BEST.itemsize)
            if bucket >= n:
                pairs = np.unique(raw[:, :star.itemsize].copy().view("<i8").reshape(-1, 2), axis=0)
                yield rows_out(schema, [np.ones(len(pairs)), pairs[:, 0], pairs[:, 1]])
            else:
                best = _top(raw.copy().view(BEST).ravel())
                yield rows_out(schema, [np.zeros(len(best)), best["cls"], best["other"]])

    found = mapped(_spread_points(sets, t), search, "bucket int, blob binary")
    return mapped(gathered(found), choose, "kind int, a long, b long")


TILE = 2048


def cross_links(sets: DataFrame, placed: DataFrame, t: float) -> DataFrame:
    """(a, b): links that join different parts of a bundle.

    `placed` holds (cls, part, bundle). A bundle's largest part is its major one, the rest
    is minor; both are cut into tiles by a hash, and each pair of minor tiles, and each minor
    tile with each major one, is a task with the sets at hand. So a part of any size is sent
    once for each tile of what is not in it. A task verifies the pairs that one tree over all
    its points lets through, the most promising first, unless they are connected already.
    """
    sizes = placed.groupBy("bundle", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.groupBy("bundle").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("all")).select(
        "bundle", F.col("top.part").alias("major"), F.ceil((F.col("all") - F.col("top.n")) / TILE).cast("int").alias("minors"),
        F.ceil(F.col("top.n") / TILE).cast("int").alias("majors"))
    kind = "array<struct<i:int,kind:int,j:int>>"

    def task_key(i, k, j) -> F.Column:
        return F.struct(i.cast("int").alias("i"), F.lit(k).alias("kind"), j.cast("int").alias("j"))

    def upto(n: str) -> F.Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    is_major, tile = F.col("part") == F.col("major"), F.col("tile")
    minor = F.concat(F.transform(upto("minors"), lambda o: task_key(F.least(o, tile), 0, F.greatest(o, tile))).cast(kind),
                     F.transform(upto("majors"), lambda o: task_key(tile, 1, o)).cast(kind))
    major = F.transform(upto("minors"), lambda o: task_key(o, 1, tile)).cast(kind)
    dealt = (placed.join(plan, "bundle")
             .withColumn("tile", F.pmod(F.xxhash64("cls"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))))
             .select("cls", "part", "bundle", F.explode(F.when(is_major, major).otherwise(minor)).alias("w"))
             .select("cls", "part", "bundle", "w.i", "w.kind", "w.j"))
    found = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    percent = round(t * 100)

    def join(table: pa.Table) -> pa.Table:
        cls, part = (np.asarray(table.column(c)) for c in ("cls", "part"))
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        order = np.lexsort((cls, [len(x) for x in tokens]))
        cls, part, tokens = cls[order], part[order], [tokens[i] for i in order.tolist()]
        points = _point_rows(cls.tolist(), part.tolist(), tokens)
        names, at_part = np.unique(part, return_inverse=True)
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for i, j, bound in tree_pairs(points, t):
            far = at_part[i] != at_part[j]
            i, j, bound = i[far], j[far], bound[far]
            for p, q in zip(*(x[np.argsort(-bound, kind="stable")].tolist() for x in (i, j)), strict=True):
                a, b = find(int(at_part[p])), find(int(at_part[q]))
                if a != b:
                    both = len(np.intersect1d(tokens[p], tokens[q], assume_unique=True))
                    if 100 * both >= percent * (len(tokens[p]) + len(tokens[q]) - both):
                        root[max(a, b)] = min(a, b)
                        links.append((int(cls[p]), int(cls[q])))
        return pa.table([[a for a, _ in links], [b for _, b in links]], schema=found)

    return (dealt.join(sets.select("cls", "tokens"), "cls").groupBy("bundle", "i", "kind", "j").applyInArrow(join, "a long, b long"))


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    schema = arrow("a long, b long")
    percent = round(t * 100)

    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = np.flatnonzero(keep)
            yield rows_out(schema, [np.asarray(batch.column(0))[keep], np.asarray(batch.column(1))[keep]])

    x, y = (sets.select(F.col("cls").alias(k), F.col("tokens").alias(f"tokens_{k}")) for k in ("a", "b"))
    return mapped(pairs.join(x, "a").join(y, "b").select("a", "b", "tokens_a", "tokens_b"), task, "a long, b long")


# ---------------------------------------------------------------- operator

def rooted(rows: DataFrame, members: DataFrame, threshold: float, words: int) -> DataFrame:
    """`members`, a table of classes of `rows`, with root, the same for all classes of a component."""
    first = members.where("n > 0").groupBy("cls", "n", "half").agg(F.min(F.struct("doc", "crc")).alias("first"))
    open_ = (first.join(shared_counts(rows, words), "cls", "left")
             .where(F.coalesce("shared", F.lit(0)) >= F.col("half") - (1 - threshold) * F.col("n") - 1e-6))
    sets = written(class_sets(rows, open_.select("first.doc", "first.crc", "cls"), words).withColumn("part", F.lit(0).cast("long")), "shingle-sets")
    found = written(best_partners(sets, threshold), "shingle-partners")
    links = written(verified(found.where("kind = 0").select("a", "b").distinct(), sets, threshold), "shingle-links")
    parts = written(components(links), "shingle-parts")
    bundles = written(components(found.where("kind = 1").select("a", "b")), "shingle-bundles")
    placed = bundles.join(parts.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    split = placed.groupBy("component").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("component")
    torn = written(placed.join(split, "component", "left_semi").select(F.col("id").alias("cls"), "part", F.col("component").alias("bundle")), "shingle-torn")
    rest = written(cross_links(sets, torn, threshold), "shingle-rest")
    whole = components(links.union(rest))
    return members.join(whole.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("component", "cls"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every row."""
    rows = keyed(docs, id_col, text_col)
    joined = rooted(rows, written(class_table(rows, words), "shingle-classes"), threshold, words)
    low = joined.where("n > 0").groupBy("root").agg(F.min("doc").alias("low"))
    low_id = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc"))
    return (joined.join(low, "root", "left").select(doc_id(), F.col("n").alias("n_shingles"), F.when(low_id != NO_ID, low_id).alias("component_id")))


def first_of_each(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, in its own columns: the one with the smallest id (null last), of several the one with the smallest hash of its text.

    Of the rows without a shingle, one of each id and text is kept.
    """
    given = numbered(docs, "shingle-rows")
    rows = keyed(given, ROW, text_col)
    members = written(class_table(rows, words), "shingle-classes")
    ids = given.select(F.col(ROW).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"))
    own = rooted(rows, members, threshold, words).join(ids, "doc").withColumn("_empty", F.when(F.col("n") == 0, F.struct("_id", "crc")))
    kept = own.groupBy("root", "_empty").agg(F.min(F.struct("_id", "crc", "doc")).alias("_first")).select(F.col("_first.doc").alias(ROW))
    return given.join(kept, ROW, "left_semi").select(*docs.columns)
