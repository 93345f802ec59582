"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c.  After a
rotation (principal axes, so that leading coordinates spread most) the
coordinates are dealt to ``BLOCKS`` blocks.  If the whole squared distance is
within the budget, that of one block is within budget / BLOCKS, its share.  Each
block is therefore range-joined under that share.

The range join is a tree over the block's coordinates.  A node of more than
``TILE`` rows is split by the next coordinate into slabs twice as wide as the
block's radius; a row goes to its own slab and visits a neighbouring one as long
as its squared gaps to the visited slabs stay within the share, a ball bound.
Rows are split no further than needed, so few copies are made.  What is still
large after all coordinates (vectors that are close in the whole block) is cut
into tiles.  A label with up to ``TILE`` vectors is one tile for all its blocks.
Inside a tile block distances come from a matrix product; a pair counts in the
first block that yields it only, and the union of candidates is verified by the
cosine in double precision.

Equal vectors are one row with a count.  No pair leaves a task: a task returns
each row's number of links and, for the components, a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, stash

BLOCKS = 8
#: Rows of a tile's side, and of a node that is not split.
TILE = 4096
#: Slack of the candidate tests, far above the rounding of single precision; candidates are verified after.
SLACK = 1e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, without nulls, as rows of doubles."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a vector can link: not null, no null or non-finite part, not zero."""
    for b in batches:
        v = b.column("v")
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = v.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null part becomes NaN
        owner = np.repeat(np.arange(len(v)), size)
        bad = np.bincount(owner[~np.isfinite(x)], minlength=len(v)) > 0
        some = np.bincount(owner[x != 0], minlength=len(v)) > 0
        ok = some & ~bad
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), pa.array(ok)], names=["id", "label", "v", "ok"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and dimension count, the sum of outer products of unit vectors."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(size).tolist():
            x = unit(matrix(b.column("v").filter(pa.array(size == d))))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d), pa.array(range(d)), pa.array(m.tolist())], names=["d", "i", "row"])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest part first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(valid: DataFrame, seed: int = 7) -> dict[int, np.ndarray]:
    """Principal axes per dimension count; d x d values each reach the driver."""
    rows = valid.select("v").mapInArrow(_moments, "d long, i long, row array<double>")
    rows = rows.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for d in {r.d for r in rows}:
        m = np.zeros((d, d))
        for r in rows:
            if r.d == d:
                m[r.i, r.j] = r.x
        mixed = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0] * 1e-9  # settles equal axes
        _, axes = np.linalg.eigh((m + m.T) / 2 + (mixed + mixed.T) * np.trace(m))
        out[d] = axes[:, ::-1]
    return out


def _rotated(rot: dict[int, np.ndarray]):  # noqa: ANN202
    """Adds the number of dimensions and the rotated unit vector, block after
    block, once for all tasks: what is decided by it is decided alike everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                take = b.take(pa.array(np.flatnonzero(size == d)))
                dealt = np.concatenate([np.arange(i, d, BLOCKS) for i in range(min(BLOCKS, d))])
                y = (unit(matrix(take.column("v"))) @ rot[d][:, dealt]).astype(np.float32)
                cols = [take.column(c) for c in ("label", "id", "n", "least", "v")]
                at = pa.array(np.arange(0, y.size + 1, d), pa.int32())
                cols += [pa.array(np.full(len(y), d)), pa.ListArray.from_arrays(at, pa.array(y.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(cols, names=["label", "id", "n", "least", "v", "d", "y"])

    return run


def _tile(cosine: float):  # noqa: ANN202
    """Links within one tile: rows of side 0 against side 1 and, where the tile
    says so (``q`` of -1), against each other.  Block -1 stands for all blocks."""
    budget = 2 - 2 * cosine

    def run(key: tuple, t: pa.Table) -> pa.Table:
        blk, q = key[2].as_py(), key[5].as_py()
        side = t.column("side").to_numpy()
        by = np.argsort(side, kind="stable")
        t, home = t.take(pa.array(by)), int((side == 0).sum())
        x, y = matrix(t.column("v")), matrix(t.column("y"))
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # exact, against overflow
        scale = np.sqrt((x * x).sum(axis=1))
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        parts = [np.ascontiguousarray(p) for p in np.array_split(y, min(BLOCKS, y.shape[1]), axis=1)]
        share = budget / len(parts) + SLACK
        first = 0 if q == -1 else home
        links = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))

        def roots() -> np.ndarray:
            nonlocal parent
            while True:
                up = parent[parent]
                if (up == parent).all():
                    return parent
                parent = up

        for at in range(0, home, 512):
            a = slice(at, min(at + 512, home))
            near = np.zeros((a.stop - at, len(ids) - first), bool)
            for k in range(len(parts)) if blk < 0 else (blk,):
                p, r = parts[k][a], parts[k][first:]
                near |= (p * p).sum(1)[:, None] + (r * r).sum(1)[None] - 2 * (p @ r.T) <= share + SLACK
            i, j = np.nonzero(near)
            i, j = i + at, j + first
            below = i < j
            i, j = i[below], j[below]
            for lo in range(0, len(i), 65_536):
                u, w = i[lo : lo + 65_536], j[lo : lo + 65_536]
                for k in range(blk + 1):  # counted in the first block that has it within its share
                    inside = ((parts[k][u] - parts[k][w]) ** 2).sum(axis=1) <= share
                    u, w = u[inside == (k == blk)], w[inside == (k == blk)]
                ok = (x[u] * x[w]).sum(axis=1) / (scale[u] * scale[w]) >= cosine
                u, w = u[ok], w[ok]
                if not len(u):
                    continue
                links += np.bincount(u, n[w], len(ids)).astype(np.int64) + np.bincount(w, n[u], len(ids)).astype(np.int64)
                while True:  # hang the higher root below the lower one until all pairs have one root
                    root = roots()
                    ru, rw = root[u], root[w]
                    apart = ru != rw
                    if not apart.any():
                        break
                    np.minimum.at(parent, np.maximum(ru, rw)[apart], np.minimum(ru, rw)[apart])
        hit = np.flatnonzero(links)
        return pa.table({"id": ids[hit], "links": links[hit], "root": ids[roots()[hit]]})

    return run


def _range_join(rotated: DataFrame, share: Column, tile: int) -> DataFrame:
    """Rows (label, d, blk, node, id, own): the tree's leaves with the rows that
    live there and, for pairs across slabs, rows that visit.

    Of two rows within the share of a block, either both live in one leaf or the
    one on the lower side of the first slab border between them visits the
    other's leaf; so every such pair meets once.
    """
    where = ["label", "d", "blk", "node"]
    width = 2 * F.sqrt(share) + F.lit(SLACK)  # half of the rows are near a border, so visits stay few
    blk, blocks = F.col("blk"), F.least(F.lit(BLOCKS), F.col("d").cast("int"))
    each, more = F.floor(F.col("d") / blocks).cast("int"), (F.col("d") % blocks).cast("int")
    part = F.slice("y", blk * each + F.least(blk, more) + 1, each + (blk < more).cast("int"))
    rows = rotated.select("label", "d", "id", "y", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("blk"))
    rows = rows.select("label", "d", "blk", F.lit("").alias("node"), "id", F.lit(True).alias("own"), F.lit(0.0).alias("gap"), part.alias("y"))
    done = []
    for level in range(1024):
        big = rows.where("own").groupBy(*where).agg(F.count("*").alias("m"), F.max(F.size("y")).alias("axes"))
        big = stash(big.where((F.col("m") > tile) & (F.col("axes") > level)).select(*where), "vector-split")
        done.append(rows.join(big, where, "left_anti").select(*where, "id", "own"))
        if big.isEmpty():
            break
        x = F.element_at("y", level + 1).cast("double")
        slab = F.floor(x / width)
        up, down = F.col("gap") + F.pow((slab + 1) * width - x, 2), F.col("gap") + F.pow(x - slab * width, 2)
        spot = lambda c, own, gap: F.struct(c.alias("c"), own.alias("own"), gap.alias("gap"))
        to = F.array(spot(slab, F.col("own"), F.col("gap")), spot(slab + 1, F.lit(False), up), spot(slab - 1, F.lit(False), F.when(F.col("own"), F.lit(9.0)).otherwise(down)))
        to = F.filter(to, lambda s: s["gap"] <= share + SLACK)
        deeper = rows.join(big, where, "left_semi").withColumn("s", F.explode(to))
        deeper = deeper.select("label", "d", "blk", F.concat_ws(",", "node", F.col("s.c").cast("string")).alias("node"), "id", F.col("s.own").alias("own"), F.col("s.gap").alias("gap"), "y")
        rows = stash(deeper, "vector-slabs")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _tiles(leaves: DataFrame, tile: int) -> DataFrame:
    """Rows (label, d, blk, node, p, q, side, id): tile (p, q) holds part p of
    the rows of a leaf on side 0 and on side 1 its part q or, for q < 0, part
    -1 - q of its visitors."""
    where = ["label", "d", "blk", "node"]
    ceil = lambda c: F.ceil(F.sum(c.cast("long")) / tile).cast("int")
    parts = leaves.groupBy(*where).agg(F.count("*").alias("m"), ceil(F.col("own")).alias("parts"), ceil(~F.col("own")).alias("guests"))
    parts = parts.where("m > 1 and parts > 0").withColumn("guests", F.greatest("guests", F.lit(1)))
    rows = leaves.join(parts, where).withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("parts")).otherwise(F.col("guests"))).cast("int"))

    def spots(lo, hi, p, q, side: int):  # noqa: ANN001, ANN202
        each = F.transform(F.sequence(lo, hi), lambda i: F.struct((i if p is None else p).alias("p"), (q(i)).alias("q"), F.lit(side).alias("side")))
        return F.when(lo <= hi, each).otherwise(F.array().cast("array<struct<p:int,q:int,side:int>>"))

    zero, me, last = F.lit(0), F.col("part"), F.col("parts") - 1
    live = F.concat(spots(zero, F.col("guests") - 1, me, lambda v: -1 - v, 0), spots(me + 1, last, me, lambda i: i, 0), spots(zero, me - 1, None, lambda i: me, 1))
    visit = spots(zero, last, None, lambda i: -1 - me, 1)
    return rows.withColumn("t", F.explode(F.when(F.col("own"), live).otherwise(visit))).select(*where, "t.p", "t.q", "t.side", "id")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared when their labels are equal and not null and their
    lengths are equal.  A vector that is null, empty, zero or holds a null or
    non-finite part, or whose label is null, links with nothing and is its own
    component.  Very large and very small parts neither overflow nor vanish.
    ``n_links`` counts the other rows linked directly (repeated rows
    count each).  A null id never names a component unless it is alone (then the
    component is null and ``kept`` false).  Extra columns are not looked at.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be in (0, 1]")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    if rows.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    schema = rows.withColumn("ok", F.lit(True)).schema
    rows = stash(rows.mapInArrow(_usable, schema).withColumn("ok", F.col("ok") & F.col("label").isNotNull()), "vectors")
    # equal vectors of a label are one row; its number is fixed once the table is written
    kinds = rows.where("ok").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    valid = stash(kinds, "vector-kinds")
    schema = valid.select("label", "id", "n", "least", "v").schema.add("d", "long").add("y", ArrayType(FloatType()))
    rotated = stash(valid.mapInArrow(_rotated(rotation(valid)), schema), "vector-rotated")
    share = F.lit(2 - 2 * cosine) / F.least(F.lit(BLOCKS), F.col("d"))
    sizes = rotated.groupBy("label", "d").agg(F.count("*").alias("m"))
    small = rotated.join(sizes.where(F.col("m").between(2, tile)).drop("m"), ["label", "d"], "left_semi")
    large = rotated.join(sizes.where(F.col("m") > tile).drop("m"), ["label", "d"], "left_semi")
    whole = small.select("label", "d", F.lit(-1).alias("blk"), F.lit("").alias("node"), F.lit(0).alias("p"), F.lit(-1).alias("q"), F.lit(0).alias("side"), "id")
    tiles = whole.unionByName(_tiles(stash(_range_join(large, share, tile), "vector-leaves"), tile))
    tiles = tiles.join(rotated.select("id", "n", "v", "y"), "id")
    found = stash(tiles.groupBy("label", "d", "blk", "node", "p", "q").applyInArrow(_tile(cosine), "id long, links long, root long"), "vector-links")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    cc = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    kinds = valid.select("label", "v", "id", "n", "least").join(links, "id", "left").join(cc.withColumnRenamed("node", "id"), "id", "left")
    kinds = kinds.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least", F.coalesce("component", "id").alias("c"))
    kinds = stash(kinds, "vector-components")
    least = kinds.groupBy("c").agg(F.min("least").alias("component_id"))
    kinds = kinds.join(least, "c").select("label", "v", "n_links", "component_id")
    linked = rows.where("ok").join(kinds, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where("ok is null or not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
