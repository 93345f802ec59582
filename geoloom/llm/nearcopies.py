"""Near copies at a shingle similarity of 0.8, found with SimHash.

Two texts of that similarity differ in about ten of 64 bits, too many for a
pigeonring over whole-text fingerprints.  So a text's set of five-word shingles
is dealt by hash into bags of two to eight, and the bags get fingerprints of
their own: texts that share 0.8 of their shingles agree fully in many bags.
Candidates are texts with an equal bag fingerprint among the first ``BAGS`` bags
of two levels or whole-text fingerprints linked by the pigeonring filter.  Bags
of few shingles say little, so a pair whose smaller set has up to ``SHORT``
shingles is found exactly: two such sets share one of their ``prefix(n)`` least
hashes, and texts of that size are keyed by these.  Each candidate pair is
verified by the exact Jaccard similarity of the sets of 64-bit shingle hashes.

Equal texts are one class.  In every candidate group the classes are held
against a leader, the class with most copies; in a group of up to ``ALL`` classes
all pairs that the leaders leave apart are verified too.  In a larger one all
classes are held against the most central one as well, whose bags are shared most;
what is apart then is resolved exactly by a prefix filter (``_large``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, connected_components, stash
from .simhash import SEED, links

WORDS = 5
BAGS = 16
ALL = 32
SHORT = 64
#: Rows of an Arrow batch of shingle sets, two a row.
SET_ROWS = 32
TILE = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 values of a text's shingles; of the whole word sequence if shorter."""
    import xxhash

    w = text.lower().split()
    h = xxhash.xxh64_digest
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.frombuffer(b"".join([h(g, SEED) for g in grams]), ">u8").astype(np.uint64))


def majority(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes that begins at ``start``."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    ones = np.add.reduceat(bits, start, axis=0)
    n = np.diff(np.concatenate((start, [len(h)])))
    return np.packbits(ones * 2 > n[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def prefix(n: int, similarity: float = 0.8) -> int:
    """Of two sets that similar, one of n hashes shares one of its so many least with the other's."""
    return n - int(np.ceil(n * similarity - 1e-9)) + 1


def _spread(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _MIX


def bag_keys(h: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """Keys of a set of hashes (ascending): of a short one its least hashes, of a
    longer one its first bags at two bag sizes; both near the border."""
    n = len(h)
    if not n:
        return np.zeros(1, np.uint64)
    out = []
    if n * similarity <= SHORT + 1e-9:
        out.append(_spread((h[: prefix(n, similarity)] + np.uint64(1)) * _MIX))
    level = max(0, int(np.log2(max(1, n / 4))))
    for lv in (level, level + 1) if n > SHORT else ():
        bag = (h * _MIX) >> np.uint64(64 - lv)
        mine = bag < BAGS
        if mine.any():
            by = np.argsort(bag[mine], kind="stable")
            hs, bs = h[mine][by], bag[mine][by]
            start = np.flatnonzero(np.concatenate(([True], bs[1:] != bs[:-1])))
            out.append(_spread(majority(hs, start) ^ ((bs[start] + np.uint64(1 + lv * 64)) * _MIX)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _keys(similarity: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, flat, at = [], [], [0]
            for t in b.column("text"):
                h = shingle_hashes(t.as_py())
                fps.append(int(majority(h, np.zeros(1, np.int64))[0]) if len(h) else 0)
                keys = bag_keys(h, similarity)
                flat.append(keys)
                at.append(at[-1] + len(keys))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            bags = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(np.array(fps, np.uint64).view(np.int64)), bags], names=["k", "fp", "bags"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_hashes(t.as_py()).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(sets, pa.binary())], names=["k", "s"])


def _verify(least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column("s"), b.column("t")):
                x, y = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def class_key(docs: DataFrame) -> Column:
    """A 64-bit name of a row's text, the same for equal texts only.

    Texts whose first hash is shared by another text, told apart by a second
    one, are named by both.  These are a handful among 10^10 texts.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    one, two = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    shared = docs.select(one.alias("k"), two.alias("l")).groupBy("k").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b")
    shared = [r.k for r in shared.select("k").collect()]
    return F.when(one.isin(shared), F.xxhash64(one, two)).otherwise(one) if shared else one


def group_classes(docs: DataFrame, similarity: float = 0.8, key: Column | None = None) -> DataFrame:
    """``k`` (name of the text, ``class_key``) and ``c`` (group) of every class of equal texts in a
    group of two classes or more.  Texts without words are alike."""
    key = class_key(docs) if key is None else key
    source = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), key.alias("k"))
    keys = stash(source.mapInArrow(_keys(similarity), "k long, fp long, bags array<long>"), "near-keys")
    fps = keys.groupBy("fp").agg(F.count("*").alias("n"))
    near = connected_components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    whole = keys.select("k", "fp").join(near, "fp", "left").select(F.xxhash64(F.lit("whole"), F.coalesce("component", "fp")).alias("g"), "k")
    members = keys.select(F.explode("bags").alias("g"), "k").unionByName(whole).groupBy("g", "k").agg(F.count("*").alias("n"))
    groups = members.groupBy("g").agg(F.count("*").alias("size"), F.max_by("k", F.struct(F.col("n"), -F.col("k"))).alias("lead")).where("size > 1")
    members = stash(members.join(groups, "g"), "near-members")
    # the text that others were made of shares all of its bags with many, a copy only those without changes
    weight = members.groupBy("k").agg(F.sum("size").alias("weight"))
    many = members.where(F.col("size") > ALL).join(weight, "k")
    central = many.groupBy("g").agg(F.max_by("k", F.struct("weight", "n", "k")).alias("central"))
    led = members.select("k", "lead").unionByName(many.join(central, "g").select("k", F.col("central").alias("lead")))
    # the shingle sets of all candidates, once; what is needed grows with the corpus, so it is never broadcast
    need = members.select("k").distinct().hint("merge")
    sets = stash(source.join(need, "k", "left_semi").dropDuplicates(["k"]).mapInArrow(_sets, "k long, s binary"), "near-sets")
    edges = _similar(sets, led.where("k <> lead").select(F.least("k", "lead").alias("a"), F.greatest("k", "lead").alias("b")), similarity)
    # in small groups, all pairs that the leaders have not joined yet
    so_far = stash(connected_components(edges), "near-so-far")
    few = members.where((F.col("size") > 2) & (F.col("size") <= ALL) & (F.col("k") != F.col("lead"))).select("g", "k")
    few = few.join(so_far.withColumnRenamed("node", "k"), "k", "left").select("g", "k", F.coalesce("component", "k").alias("c"))
    few = stash(few, "near-few")
    a, b = few.select("g", F.col("k").alias("a"), F.col("c").alias("ca")), few.select("g", F.col("k").alias("b"), F.col("c").alias("cb"))
    more = _similar(sets, a.join(b, "g").where("a < b and ca <> cb").select("a", "b"), similarity)
    edges = edges.unionByName(more)
    return _large(sets, members.where(F.col("size") > ALL).select("g", "k"), edges, similarity).select(F.col("node").alias("k"), F.col("component").alias("c"))


def _open(large: DataFrame, components: DataFrame) -> DataFrame:
    """Members (g, k, c) of the large groups that are not one component yet."""
    m = large.join(components.withColumnRenamed("node", "k"), "k", "left").select("g", "k", F.coalesce("component", "k").alias("c"))
    return m.join(m.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g"), "g")


def _large(sets: DataFrame, large: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """Components after all pairs of the large groups, too.

    In an order of hashes by frequency, two similar sets share one among their
    first ``n - ceil(similarity * n) + 1``.  If it is a rare one (in up to ``ALL``
    sets), a join finds the pair.  If not, they share no rare one, and both have
    few: these are compared in tiles.
    """
    so_far = stash(connected_components(edges), "near-so-far")
    left = stash(_open(large, so_far), "near-open")
    if left.isEmpty():
        return so_far
    docs = left.select("k", "c").distinct()
    mine = stash(sets.join(docs, "k").withColumn("n", (F.length("s") / 8).cast("int")), "near-open-sets")
    hashes = mine.select("k", "s").mapInArrow(_hashes, "k long, w long")
    rare = hashes.groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") <= ALL)
    rare = hashes.join(rare.hint("merge"), "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    mine = mine.join(rare, "k", "left").withColumn("rare", F.coalesce(F.size("r"), F.lit(0))).withColumn("rare", F.greatest("rare", F.lit(0))).withColumn("first", first)
    with batch_rows(sets.sparkSession, SET_ROWS):
        mine = stash(mine, "near-rare")
    keys = mine.where("rare > 0").select("k", "c", F.explode(F.slice("r", F.lit(1), F.col("first"))).alias("x")).where("x.df > 1").select("k", "c", F.col("x.w").alias("w"))
    keys = stash(keys, "near-prefix")
    a, b = keys.select("w", F.col("k").alias("a"), F.col("c").alias("ca")), keys.select("w", F.col("k").alias("b"), F.col("c").alias("cb"))
    edges = edges.unionByName(_similar(sets, a.join(b, "w").where("a < b and ca <> cb").select("a", "b"), similarity))
    so_far = stash(connected_components(edges), "near-so-far")
    reach = mine.where("rare < first").select("k", "s", "rare")
    left = stash(_open(large.join(reach.select("k"), "k", "left_semi"), so_far), "near-open")
    if left.isEmpty():
        return so_far
    # groups of the same members are one
    groups = left.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("h"))
    groups = groups.groupBy("n", "h").agg(F.min("g").alias("g")).select("g", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tiled = left.join(groups, "g").withColumn("t", F.pmod(F.xxhash64("k", F.lit(1)), F.col("tiles")).cast("int"))
    tiled = tiled.join(reach, "k").withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("g", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "k", "c", "s", "rare")
    found = tiled.groupBy("g", "i", "j").applyInArrow(_tile(similarity), "a long, b long")
    return connected_components(edges.unionByName(found))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, s in zip(b.column("k").to_pylist(), b.column("s")):
            w = np.frombuffer(s.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), k, np.int64)), pa.array(w)], names=["k", "w"])


def _tile(least: float):  # noqa: ANN202
    """Links between the components of a tile (or of two) whose pairs share no rare hash."""

    def run(rows: pa.Table) -> pa.Table:
        t, i, j = rows.column("t").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        k, c, rare = (rows.column(x).to_numpy() for x in ("k", "c", "rare"))
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in rows.column("s")]
        n = np.array([len(s) for s in sets], np.int64)
        start = np.concatenate(([0], np.cumsum(n)))
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(ids.max(initial=0) + 1, np.int64)
        c = np.unique(c, return_inverse=True)[1]
        ends = []
        for x in np.flatnonzero(t == i):
            other = c != c[x]
            if i != j:
                other &= t == j
            # what both share is no rare hash, so rare ones only count to the union
            most = np.minimum(n[x] - rare[x], n - rare)
            ys = np.flatnonzero(other & (most >= least * (np.maximum(n[x] - rare[x], n - rare) + rare[x] + rare) - 1e-9))
            if not len(ys):
                continue
            mark[ids[start[x] : start[x + 1]]] = 1
            both = np.array([mark[ids[start[y] : start[y + 1]]].sum() for y in ys])
            mark[ids[start[x] : start[x + 1]]] = 0
            for y in ys[both >= least * (n[x] + n[ys] - both) - 1e-9]:
                if c[x] != c[y]:
                    ends.append((k[x], k[y]))
                    c[c == c[y]] = c[x]
        ends = np.array(ends, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return run


def _similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of text digests whose shingle sets are similar enough."""
    pairs = stash(pairs.distinct(), "near-pairs")
    both = pairs.join(sets.select(F.col("k").alias("a"), "s"), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("t")), "b")
    with batch_rows(sets.sparkSession, SET_ROWS):
        return stash(both.select("a", "b", "s", "t").mapInArrow(_verify(similarity), "a long, b long"), "near-similar")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: the least ``doc_id``.

    Equal texts always form a group, null and empty texts among them.  Of
    repeated rows with that id one stays.  A null id goes last.
    """
    key = class_key(docs)
    classes = group_classes(docs, similarity, key)
    ids = docs.select("doc_id", key.alias("k")).groupBy("k", "doc_id").agg(F.count("*").alias("n"))
    ids = ids.join(classes, "k", "left").withColumn("c", F.coalesce("c", "k"))
    first = ids.groupBy("c").agg(F.min_by(F.struct("k", "doc_id", "n"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k"))).alias("x"))
    first = stash(first.select("x.k", F.col("x.doc_id").alias("id"), F.col("x.n").alias("n")), "near-kept")
    # the columns travel as one struct: none can clash with the work columns
    rows = docs.select(key.alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    rows = rows.join(first.hint("merge").alias("f"), (F.col("d.k") == F.col("f.k")) & F.col("row.doc_id").eqNullSafe(F.col("f.id"))).select("row", "d.k", "n")
    whole = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    once = rows.where("n = 1").select(*whole)
    if first.where("n > 1").isEmpty():
        return once
    twice = rows.where("n > 1").withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "k"])
    return once.unionByName(twice.select(*whole))
