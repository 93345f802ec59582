"""SimHash fingerprints and their links within a Hamming radius.

Candidates come from a pigeonring filter.  The 64 bits are cut into m segments
in a ring.  If two fingerprints differ in at most r bits, there is a segment
from which on every chain of l segments differs in at most floor(l * r / m)
bits.  With m > r the first segment of such a chain is equal, so fingerprints
meet by equality of a segment, and the longer chains prune the pairs before the
full Hamming check.

A segment value that many fingerprints share would make pairs with the square
of its size.  Such hot buckets take another exact way: every member names
itself and all its one-bit neighbours outside the equal segment; two members
within two bits name a common value, and members are linked to the smallest
that names it.  That is linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stash

SEED = 42
#: Shingles hashed at a time; bounds the memory of one very long text.
BLOCK = 65_536


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of UTF-8 text, unsigned.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``words`` words joined by one space, repeats included; with fewer words the
    whole sequence is the only shingle, with none the fingerprint is zero.  A
    bit is set if it is set in more than half of the shingles' XXH64 values.
    """
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    h = xxhash.xxh64_digest
    for at in range(0, n, BLOCK):
        part = w[at : min(n, at + BLOCK) + words - 1]
        k = min(BLOCK, n - at)
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
        bits = np.unpackbits(np.frombuffer(b"".join([h(g, SEED) for g in grams]), np.uint8).reshape(k, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long), row by row."""
    src = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("__text"))
    schema = src.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column("__text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(fp, pa.int64())], names=[*keep, "fp"])

    return src.mapInArrow(run, schema)


def _segments(m: int) -> list[int]:
    """Bit masks (signed longs) of m segments over 64 bits."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def links(fps: DataFrame, radius: int = 2, hot: int = 64) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``, no repeats),
    enough to join all that are within ``radius`` bits of each other, directly
    or over others; every link is within ``radius`` bits or, in hot buckets,
    over a value that both are next to.

    ``hot`` is the size over which a bucket takes the linear way; both ways are
    exact for radius 1 and 2, the only ones allowed here.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2; equal fingerprints are one row")
    m = radius + 1
    masks = _segments(m)
    # each chain: the masks of its first 1, 2, .. segments with the bits they may differ in
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(_long(x)) for x in masks))).alias("i", "key"))
    sizes = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = stash(keyed.join(sizes, ["i", "key"]), "simhash-buckets")

    few = keyed.where(F.col("n") <= hot).select("i", "key", "fp")
    a, b = few.select("i", "key", F.col("fp").alias("a")), few.select("i", "key", F.col("fp").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for length in range(2, m):
        ring = [sum(masks[(i + k) % m] for k in range(length)) for i in range(m)]
        mask = F.element_at(F.array(*map(_long, ring)), F.col("i") + 1)
        chain = chain & (F.bit_count(apart.bitwiseAND(mask)) <= length * radius // m)
    close = (F.col("a") < F.col("b")) & chain & (F.bit_count(apart) <= radius)
    pairs = a.join(b, ["i", "key"]).where(close).select("a", "b")

    flips = F.array(*[_long(0)] + [_long((1 << j) - (1 << 64) if j == 63 else 1 << j) for j in range(64)])
    seg = F.element_at(F.array(*map(_long, masks)), F.col("i") + 1)
    named = keyed.where(F.col("n") > hot).select("i", "fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(seg) == 0)).alias("flip"))
    if radius == 2:  # a value one bit away or none
        named = named.select("i", "fp", F.lit(0).cast("long").alias("bit"), F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
    else:  # the value without one bit: its two bearers are one bit apart
        named = named.where("flip <> 0").select("i", "fp", F.col("flip").alias("bit"), F.col("fp").bitwiseAND(F.bitwise_not("flip")).alias("name"))
    key = ["i", "bit", "name"]
    first = named.groupBy(*key).agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = named.join(first, key).where(F.col("least") < F.col("fp")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(docs: DataFrame, words: int = 3, radius: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns (``doc_id`` first),
    ``fp`` and ``component_id``, the smallest ``doc_id`` reachable over links.

    Null texts count as empty and have fingerprint zero; a null ``doc_id`` never
    names a component unless all ids of it are null (then it is null).  Equal
    fingerprints are one node, so copies cost nothing.
    """
    rows = stash(fingerprints(docs, keep, words), "simhash-fp")
    nodes = stash(rows.groupBy("fp").agg(F.min(keep[0]).alias("rep")), "simhash-nodes")
    cc = connected_components(links(nodes.select("fp"), radius))
    member = nodes.join(cc.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = member.groupBy("c").agg(F.min("rep").alias("component_id"))
    return rows.join(member.select("fp", "c").join(least, "c").select("fp", "component_id"), "fp")
