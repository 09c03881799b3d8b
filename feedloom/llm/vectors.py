"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that the directions with the largest second
moment come first; turning keeps dot products. Equal vectors of a label are one class.
Classes of a label fall into cells of the leading coordinate, as wide as two linked
vectors can differ in it, so links stay within a cell or reach the next one; a full cell is cut into
tiles of about `tile` classes by a hash, and each pair of tiles is one task's work. There the leading dimensions are
multiplied first; with the rest of each pair bounded by the product of its suffix norms,
pairs whose bound stays below the threshold leave, stage by stage.

A task returns link counts per class and a star forest of its links, never the links
themselves. Vectors that are null, zero, or hold null or non-finite components, and null
labels, link with nothing. Vectors of different lengths never link. A null id sorts last; rows that repeat in full
are separate vectors. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import NO_ID, arrow, mapped, rows_out, travels, written
from feedloom.llm.components import components, star_forest

travels(__name__)

SLACK = 1e-9         # rounding of the bounds; the last stage compares whole dot products
STAGES = (8, 16, 32)


def _unit_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of usable rows and their vectors in double precision."""
    keep, out = [], []
    values = batch.column(1).to_pylist()
    labels = batch.column(2).to_pylist()
    for i, (v, label) in enumerate(zip(values, labels, strict=True)):
        if not v or label is None or None in v:
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max()
        if np.isfinite(x).all() and top > 0:
            x = x / top     # keeps the squares of very large and very small vectors in range
            keep.append(i)
            out.append(x / np.sqrt(x @ x))
    return np.array(keep, np.int64), out


def _classes(rows: DataFrame) -> DataFrame:
    fields = "id long, label string, size int, digest string, unit binary"
    schema = arrow(fields)

    def task(batches):
        for batch in batches:
            keep, units = _unit_rows(batch)
            id_, label = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            unit: list = [None] * batch.num_rows
            raw = batch.column(1)
            digest: list = [None] * batch.num_rows
            for i, x in zip(keep.tolist(), units, strict=True):
                unit[i] = x.tobytes()
                digest[i] = hashlib.md5(np.array(raw[i].as_py(), np.float64).tobytes()).hexdigest()
            yield rows_out(schema, [id_, label, [None if u is None else len(u) // 8 for u in unit], digest, unit])

    return mapped(rows, task, fields)


def _rotations(units: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the eigenvectors of the second-moment matrix, largest first."""
    schema = arrow("size int, blob binary")

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            size, unit = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for n in np.unique(size).tolist():
                x = np.frombuffer(b"".join([unit[i] for i in np.flatnonzero(size == n)])).reshape(-1, n)
                sums[n] = sums.get(n, 0) + x.T @ x
        yield rows_out(schema, [list(sums), [x.tobytes() for x in sums.values()]])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[n] = sums.get(n, 0) + np.frombuffer(blob).reshape(n, n)
        yield rows_out(schema, [list(sums), [x.tobytes() for x in sums.values()]])

    parts = mapped(mapped(units.select("size", "unit"), total, "size int, blob binary").repartition("size"), add, "size int, blob binary")
    # one matrix per vector length
    return {n: np.linalg.eigh(np.frombuffer(blob).reshape(n, n))[1][:, ::-1].copy() for n, blob in parts.collect()}


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose dot product reaches the threshold, leading dimensions first."""
    dims = a.shape[1]
    cuts = [0, *[s for s in STAGES if s < dims], dims]
    rest_a, rest_b = (np.sqrt(np.maximum(np.cumsum(x[:, ::-1] ** 2, 1)[:, ::-1], 0)) for x in (a, b))
    part = a[:, :cuts[1]] @ b[:, :cuts[1]].T
    if len(cuts) == 2:
        return np.nonzero(part >= threshold)
    i, j = np.nonzero(part + np.outer(rest_a[:, cuts[1]], rest_b[:, cuts[1]]) >= threshold - SLACK)
    out_i, out_j = [], []
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
        dot = part[p, q]
        for start, end in zip(cuts[1:], cuts[2:], strict=False):
            dot = dot + np.einsum("ij,ij->i", a[p, start:end], b[q, start:end])
            keep = dot >= threshold if end == dims else dot + rest_a[p, end] * rest_b[q, end] >= threshold - SLACK
            p, q, dot = p[keep], q[keep], dot[keep]
        out_i.append(p)
        out_j.append(q)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def near_duplicates(rows: DataFrame, threshold: float = 0.93, tile: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    given = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                        F.col(label_col).cast("string").alias("label"))
    units = written(_classes(given), "vector-classes")
    usable = units.where("digest is not null")
    turns = _rotations(usable)
    width = float(np.sqrt(max(2 * (1 - threshold), 0)) + 1e-6)
    fields = "id long, label string, size int, members long, cell int, unit binary"
    schema = arrow(fields)

    def turn(batches):
        for batch in batches:
            id_, label, size, members, unit = (c.to_pylist() for c in batch.columns)
            turned = [np.frombuffer(u) @ turns[n] for u, n in zip(unit, size, strict=True)]
            yield rows_out(schema, [id_, label, size, members, [int(np.floor(x[0] / width)) for x in turned], [x.tobytes() for x in turned]])

    classes = usable.groupBy("label", "size", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), F.first("unit").alias("unit"))
    classes = written(classes, "vector-sets")
    turned = written(mapped(classes.select("id", "label", "size", "members", "unit"), turn, fields), "vector-turned")
    key = ["label", "size", "cell"]
    counts = turned.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))
    near = counts.select("label", "size", (F.col("cell") - 1).alias("cell"), F.col("k").alias("k_up")).join(counts, key, "full").select(
        *key, F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("k_up", F.lit(0)).alias("k_up"))
    down = counts.select("label", "size", (F.col("cell") + 1).alias("cell"), F.col("k").alias("k_down"))
    near = near.where("k > 0").join(down, key, "left").select(*key, "k", "k_up", F.coalesce("k_down", F.lit(0)).alias("k_down"))

    def pair(cell, step, i, j, side) -> F.Column:
        return F.struct(cell.alias("cell"), F.lit(step).alias("step"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    def upto(k) -> F.Column:
        return F.sequence(F.lit(0), F.col(k) - 1)

    none = F.array().cast("array<struct<cell:int,step:int,i:int,j:int,side:int>>")
    cell, t = F.col("cell"), F.col("tile")
    own = F.transform(upto("k"), lambda o: F.when(o < t, pair(cell, 0, o, t, 1)).otherwise(pair(cell, 0, t, o, 0)))
    above = F.when(F.col("k_up") > 0, F.transform(upto("k_up"), lambda o: pair(cell, 1, t, o, 0))).otherwise(none)
    below = F.when(F.col("k_down") > 0, F.transform(upto("k_down"), lambda o: pair(cell - 1, 1, o, t, 1))).otherwise(none)
    placed = (turned.join(near, key).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
              .select("id", "label", "size", "members", "unit", F.explode(F.concat(own, above, below)).alias("p"))
              .select("id", "label", "size", "members", "unit", "p.cell", "p.step", "p.i", "p.j", "p.side"))
    found = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        id_, members, side, n = (np.asarray(table.column(c)) for c in ("id", "members", "side", "size"))
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(id_), int(n[0]))
        order = np.argsort(id_)
        id_, members, side, unit = id_[order], members[order], side[order], unit[order]
        inner = table.column("step")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(id_)),) * 2 if inner else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links = np.zeros(len(id_), np.int64)
        u, v = [], []
        for lo in range(0, len(left), 2048):
            p, q = linked_pairs(unit[left[lo:lo + 2048]], unit[right], threshold)
            p, q = left[lo:lo + 2048][p], right[q]
            if inner:
                p, q = p[p < q], q[p < q]
            np.add.at(links, p, members[q])
            np.add.at(links, q, members[p])
            far, centre = star_forest(id_[p], id_[q])
            u.append(far)
            v.append(centre)
        u, v = np.concatenate(u or [id_[:0]]), np.concatenate(v or [id_[:0]])
        hit = links > 0
        return pa.table([np.r_[id_[hit], u], pa.array(np.r_[id_[hit], v]), np.r_[links[hit], np.zeros(len(u), np.int64)]], schema=found)

    out = written(placed.groupBy("label", "size", "cell", "step", "i", "j").applyInArrow(compare, "a long, b long, links long"), "vector-links")
    links = out.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    joined = components(out.where("a <> b").select("a", "b"))
    sets = classes.select(F.col("label").alias("l"), F.col("size").alias("s"), F.col("digest").alias("g"), F.col("id").alias("class"), "members")
    sets = sets.join(links, "class", "left").join(joined.withColumnRenamed("id", "class"), "class", "left")
    u = units.select("id", "label", "size", "digest")
    return (u.join(sets, (u["label"] == sets["l"]) & (u["size"] == sets["s"]) & (u["digest"] == sets["g"]), "left")
            .select(F.when(F.col("id") != NO_ID, F.col("id")).alias("vec_id"),
                    F.coalesce(F.col("members") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
                    F.coalesce("component", "class", "id").alias("component_id"))
            .withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
