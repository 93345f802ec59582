"""Removal of repeated byte passages by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes covers it that starts somewhere else
too.  Sorting every suffix of the corpus would move each byte many times, so the
suffixes to sort are found first:

1. Of the ``WIDTH`` shorter strings of ``GRAM`` bytes inside each long string,
   the one with the least hash is its anchor.  Equal strings have equal anchors.
   Neighbouring strings with the same anchor form one span.
2. Anchors that occur once are done.  Of the others, spans whose whole bytes
   occur again (equal 128-bit BLAKE2 digests of all their bytes) are repeated
   throughout.
3. The remaining spans, with one of each repeated kind, are compared anchor by
   anchor: their suffixes from the anchor on are merge-sorted.  Two suffixes are
   compared by the length of their common beginning, found by binary search on
   prefix polynomial hashes.  With the common lengths of neighbours, the strings
   that have the anchor at the same offset fall into classes, and the hash of
   the bytes before the anchor splits these.  Every match is verified on bytes.

An anchor with more than ``HOT`` different spans is not gathered in one task: its
spans are dealt anew for each half of the offsets by the bytes that all strings
of that half have, until a group is small enough to sort (``_halves``).  Spans in
so large a group at one offset share that string, which is counted by its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

LENGTH = 200
WIDTH = 128
GRAM = LENGTH - WIDTH + 1
HOT = 2048
#: Bytes hashed at a time; positions within a block fit into 20 bits.
BLOCK = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, BLOCK + LENGTH + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK + LENGTH + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def spans_of_block(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last string start and anchor place of each span of
    a block of bytes; ``valid`` says where a string may start."""
    n = len(x)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[x] * _POW[:n], out=p[1:])
    h = _mix((p[GRAM:] - p[:-GRAM]) * _INV[: n - GRAM + 1])
    low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step < WIDTH:  # least of WIDTH neighbours, by doubling
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    anchor = np.where(valid, (low & np.uint64((1 << 20) - 1)).astype(np.int64), -1)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    s = np.concatenate(([0], cut))
    e = np.concatenate((cut, [len(anchor)])) - 1
    ok = anchor[s] >= 0
    s, e = s[ok], e[ok]
    a = anchor[s]
    return h[a], s, e, a


def _spans(weak: int):  # noqa: ANN202
    """Rows (h, sh, k, pos) with pos = start << 16 | (end - start) << 8 | (anchor - start).

    ``weak`` takes that many low bits off the anchor hash, for tests of collisions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            digests: list[bytes] = []
            parts: list[tuple[int, int, np.ndarray]] = []  # row, offset in its text, bytes
            size = 0

            def flush() -> None:
                nonlocal size
                if not parts:
                    return
                x = np.concatenate([q[2] for q in parts])
                start = np.cumsum([0] + [len(q[2]) for q in parts])
                valid = np.zeros(len(x) - LENGTH + 1, bool)
                for i in range(len(parts)):
                    valid[start[i] : start[i + 1] - LENGTH + 1] = True
                h, s, e, a = spans_of_block(x, valid)
                owner = np.searchsorted(start, s, side="right") - 1
                number = np.array([q[0] for q in parts])[owner]
                at = s - start[owner] + np.array([q[1] for q in parts])[owner]
                out.append(((h >> np.uint64(weak)).view(np.int64), number, (at << 16) | ((e - s) << 8) | (a - s)))
                raw = x.tobytes()
                digests.extend([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(s.tolist(), (e + LENGTH).tolist())])
                parts.clear()
                size = 0

            for i, t in enumerate(b.column("text")):
                raw = t.as_py()
                for at in range(0, len(raw) - LENGTH + 1, BLOCK // 2):
                    piece = np.frombuffer(raw, np.uint8, min(len(raw) - at, BLOCK // 2 + LENGTH - 1), at)
                    if size + len(piece) > BLOCK:
                        flush()
                    parts.append((i, at, piece))
                    size += len(piece)
            flush()
            h, number, pos = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(digests, pa.binary()), b.column("k").take(pa.array(number)), pa.array(pos)], names=["h", "sh", "k", "pos"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted span: rows (g, lo, hi, c, k, pos, bytes); its anchor is its first group."""
    names = ["g", "lo", "hi", "c", "k", "pos", "bytes"]
    for b in batches:
        cols: dict[str, list] = {n: [] for n in names}
        for k, text, wanted in zip(b.column("k").to_pylist(), b.column("text"), b.column("wanted").to_pylist()):
            raw = text.as_py()
            for w in wanted:
                s, run = w["pos"] >> 16, (w["pos"] >> 8) & 255
                for n, v in zip(names, (w["h"], 0, WIDTH - 1, w["c"], k, w["pos"], raw[s : s + run + LENGTH])):
                    cols[n].append(v)
        yield _group_rows(cols)


def _group_rows(cols: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n in ("k", "bytes") else pa.int64()) for n, v in cols.items()], names=list(cols))


_GROUP_ROWS = "g long, lo long, hi long, c long, k binary, pos long, bytes binary"


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups that are too large, dealt anew for each half of the offsets.

    All strings that have the anchor at an offset from ``lo`` to ``hi`` hold the
    ``lo`` bytes before it and the ``LENGTH - hi`` from it on: these, hashed,
    name the new group.  Groups that fall together by chance do no harm, since
    matches are verified.
    """
    import xxhash

    for b in batches:
        cols: dict[str, list] = {n: [] for n in ("g", "lo", "hi", "c", "k", "pos", "bytes")}
        for g, lo, hi, c, k, pos, raw in zip(*(b.column(n).to_pylist() for n in cols)):
            back, run = pos & 255, (pos >> 8) & 255
            mid = (lo + hi) // 2
            for x, y in ((lo, mid), (mid + 1, hi)):
                if max(x, back - run) <= min(y, back):
                    new = xxhash.xxh64_intdigest(raw[back - x : back + LENGTH - y], (x << 8) | y)
                    for n, v in zip(cols, (new - (1 << 63), x, y, c, k, pos, raw)):
                        cols[n].append(v)
        yield _group_rows(cols)


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one string that a span has at the offset of its group: rows (d, k, at)."""
    for b in batches:
        d, at = [], []
        for lo, pos, raw in zip(b.column("lo").to_pylist(), b.column("pos").to_pylist(), b.column("bytes").to_pylist()):
            i = (pos & 255) - lo
            d.append(hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest())
            at.append((pos >> 16) + i)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), b.column("k"), pa.array(at, pa.int64())], names=["d", "k", "at"])


def sort_suffixes(group: np.ndarray, right: np.ndarray, length: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sort of suffixes within groups, comparing by prefix hashes.

    ``group`` is ascending.  Row i of ``right`` holds the suffix's bytes, the
    first ``length[i]`` of them real; ``prefix[i, m]`` is the hash of the first
    m.  Returns the order and, for each place but the first, the common length
    with the suffix before it (0 across groups).
    """

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        lo = np.zeros(len(i), np.int64)
        hi = np.minimum(length[i], length[j])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = prefix[i, mid] == prefix[j, mid]
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def less(i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        m = common(i, j)
        ended = (m >= length[i]) | (m >= length[j])
        at = np.minimum(m, right.shape[1] - 1)
        by_end = np.where(length[i] == length[j], or_equal, length[i] < length[j])
        return np.where(ended, by_end, right[i, at] < right[j, at])

    n = len(group)
    first = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.concatenate((starts, [n])))
    g0, gn = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    place = np.arange(n) - g0
    order = np.arange(n)
    run = 1
    while run < gn.max(initial=0):
        block = place // (2 * run) * (2 * run)
        left = place - block < run
        lo0 = np.minimum(np.where(left, block + run, block), gn)
        hi0 = np.minimum(np.where(left, block + 2 * run, block + run), gn)
        lo, hi = lo0.copy(), hi0.copy()
        while True:  # rank in the other run: its elements that come before
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            before = less(order[g0[open_] + mid], order[open_], ~left[open_])
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        to = g0 + block + (place - np.where(left, block, block + run)) + (lo - lo0)
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        run *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = np.where(first[1:], 0, common(order[1:], order[:-1]))
    return order, lcp


def repeated_starts(group: np.ndarray, pos: np.ndarray, raws: list[bytes], least: np.ndarray | int = 0, most: np.ndarray | int = WIDTH - 1) -> np.ndarray:
    """Matrix [span, offset of the anchor]: whether that string occurs in
    another span of the same group too; offsets from ``least`` to ``most``."""
    n = len(raws)
    run, back = (pos >> 8) & 255, pos & 255
    left = np.zeros((n, WIDTH), np.uint8)  # bytes before the anchor, nearest first
    right = np.zeros((n, LENGTH), np.uint8)
    for i, raw in enumerate(raws):
        x = np.frombuffer(raw, np.uint8)
        o = int(back[i])
        left[i, :o] = x[:o][::-1]
        right[i, : len(x) - o] = x[o:]
    length = run + LENGTH - back
    prefix = np.zeros((n, LENGTH + 1), np.uint64)
    np.cumsum(_BYTE[right] * _POW[:LENGTH], axis=1, out=prefix[:, 1:])
    before = np.zeros((n, WIDTH + 1), np.uint64)
    np.cumsum(_BYTE[left] * _POW[:WIDTH], axis=1, out=before[:, 1:])
    order, lcp = sort_suffixes(group, right, length, prefix)
    found = np.zeros((n, WIDTH), bool)
    some: list[tuple[np.ndarray, np.ndarray, int]] = []
    for o in range(WIDTH):
        there = (o <= back) & (o >= back - run) & (o >= least) & (o <= most)
        cls = np.cumsum(lcp < LENGTH - o)[there[order]]
        members = order[there[order]]
        if len(members) < 2:
            continue
        tail = before[members, o]
        by = np.lexsort((tail, cls))
        same = (cls[by][1:] == cls[by][:-1]) & (tail[by][1:] == tail[by][:-1])
        at = np.flatnonzero(same)
        i, j = members[by[at]], members[by[at + 1]]
        found[i, o] = found[j, o] = True
        some.append((i, j, o))
    if some:  # verify each pair once over all of its strings
        i, j = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
        o = np.concatenate([np.full(len(x[0]), x[2]) for x in some])
        pair, which = np.unique(i * n + j, return_inverse=True)
        far, near = np.zeros(len(pair), np.int64), np.full(len(pair), WIDTH)
        np.maximum.at(far, which, o)
        np.minimum.at(near, which, o)
        for at in range(0, len(pair), 4096):
            a, b = pair[at : at + 4096] // n, pair[at : at + 4096] % n
            ok_left = ((left[a] == left[b]) | (np.arange(WIDTH) >= far[at : at + 4096, None])).all()
            ok_right = ((right[a] == right[b]) | (np.arange(LENGTH) >= LENGTH - near[at : at + 4096, None])).all()
            if not (ok_left and ok_right):
                return _by_bytes(group, run, back, raws) & (np.arange(WIDTH) >= np.reshape(least, (-1, 1))) & (np.arange(WIDTH) <= np.reshape(most, (-1, 1)))
    return found


def _by_bytes(group: np.ndarray, run: np.ndarray, back: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """The same by comparing bytes; only after a hash collision."""
    seen: dict[tuple[int, int, bytes], list[int]] = {}
    for i, raw in enumerate(raws):
        for s in range(int(run[i]) + 1):
            seen.setdefault((int(group[i]), int(back[i]) - s, raw[s : s + LENGTH]), []).append(i)
    found = np.zeros((len(raws), WIDTH), bool)
    for (_, o, _), owners in seen.items():
        if len(owners) > 1:
            found[owners, o] = True
    return found


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group in, removable intervals (k, a, b) out."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        g, pos, c, lo, hi = (rows.column(n).to_numpy() for n in ("g", "pos", "c", "lo", "hi"))
        found = repeated_starts(g, pos, rows.column("bytes").to_pylist(), lo, hi)
        found[c > 1] = False  # known to be repeated throughout
        edge = np.diff(np.pad(found[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        anchor = (pos >> 16) + (pos & 255)
        a = anchor[i] - (WIDTH - 1 - first)
        b = anchor[i] - (WIDTH - last) + LENGTH
        return pa.RecordBatch.from_arrays([rows.column("k").take(pa.array(i)).combine_chunks(), pa.array(a), pa.array(b)], names=["k", "a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 4096:
            t = pa.Table.from_batches(held).combine_chunks()
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield work(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
            rows = len(g) - cut
    if rows:
        yield work(pa.Table.from_batches(held).combine_chunks())


def _joined(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of packed intervals; touching ones are one."""
    a, e = cut >> 32, (cut >> 32) + (cut & 0xFFFFFFFF)
    by = np.argsort(a)
    a, e = a[by], np.maximum.accumulate(e[by])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > e[:-1])))
    return a[new], np.concatenate((e[new[1:] - 1], e[-1:]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = [_joined(c.values.to_numpy()) for c in b.column("cuts")]
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([(x << 32) | (y - x) for x, y in runs], pa.list_(pa.int64()))], names=["k", "cuts"])


def _kept(keep: tuple[str, ...], texts: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, digest, rest = [], [], [], [], []
            for t, cut in zip(b.column("text"), b.column("cuts")):
                raw, cut = t.as_py(), cut.as_py()
                size.append(len(raw))
                if cut:
                    a, e = _joined(np.array(cut, np.int64))
                    ends = np.concatenate(([0], e)).tolist()
                    out = b"".join(raw[x:y] for x, y in zip(ends, [*a.tolist(), len(raw)]))
                    runs.append(len(a))
                else:
                    out = raw
                    runs.append(0)
                gone.append(len(raw) - len(out))
                digest.append(hashlib.sha256(out).hexdigest())
                if texts:
                    rest.append(out)
            cols = [*(b.column(n) for n in keep), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                cols.append(pa.array(rest, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), texts: bool = False, hot: int = HOT, weak: int = 0) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``texts``, ``kept``
    (the remaining bytes, which need not be valid UTF-8).

    Null texts count as empty; texts under ``LENGTH`` bytes lose nothing; of
    exact copies that long every one loses all.  Texts are told apart by half
    of a SHA-256, spans by a 128-bit BLAKE2 digest; other columns are not looked at, an empty table gives an
    empty result.
    """
    # keep columns are renamed while they travel: none can clash with the work columns
    kept = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    body = F.coalesce("text", F.lit("")).cast("binary")
    source = docs.select(*kept, body.alias("text")).withColumn("k", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    long_ = source.where(F.length("text") >= LENGTH)

    spans = long_.select("k", "text").mapInArrow(_spans(weak), "h long, sh binary, k binary, pos long")
    # counted apart from the join, so that a hot anchor's rows can be split there
    often = stash(spans.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeat-often")
    again = stash(spans.join(often, "h"), "repeat-spans")

    kinds = again.groupBy("h", "sh").agg(F.count("*").alias("c"), F.min(F.struct("k", "pos")).alias("one"))
    kinds = stash(kinds, "repeat-kinds")
    open_ = kinds.groupBy("h").agg(F.count("*").alias("v"), F.min("c").alias("least")).where("v > 1 and least = 1").select("h")
    wanted = kinds.join(open_, "h").select(F.col("one.k").alias("k"), F.struct("h", "c", F.col("one.pos").alias("pos")).alias("w"))
    wanted = wanted.groupBy("k").agg(F.collect_list("w").alias("wanted"))  # at most the spans of one text
    one_text = long_.select("k", "text").join(wanted, "k").dropDuplicates(["k"])
    groups = stash(one_text.mapInArrow(_contexts, _GROUP_ROWS), "repeat-contexts")
    cuts = None
    while True:
        sizes = groups.groupBy("g").agg(F.count("*").alias("n"))
        large = stash(sizes.where(F.col("n") > hot).select("g"), "repeat-large")
        some = groups.join(large, "g", "left_anti").repartition("g").sortWithinPartitions("g").mapInArrow(_resolve, "k binary, a long, b long")
        cuts = some if cuts is None else cuts.unionByName(some)
        if large.isEmpty():
            break
        rest = groups.join(large, "g", "left_semi")
        one = rest.where("lo = hi").select("lo", "k", "pos", "bytes").mapInArrow(_window_digests, "d binary, k binary, at long")
        twice = one.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
        cuts = cuts.unionByName(one.join(twice, "d").select("k", F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b")))
        groups = stash(rest.where("lo < hi").mapInArrow(_halves, _GROUP_ROWS), "repeat-contexts")
    whole = again.join(kinds.where("c > 1").select("h", "sh"), ["h", "sh"])
    start = F.shiftright("pos", 16)
    run = F.shiftright("pos", 8).bitwiseAND(F.lit(255).cast("long"))
    cuts = cuts.unionByName(whole.select("k", start.alias("a"), (start + run + LENGTH).alias("b")))
    packed = F.shiftleft("a", 32).bitwiseOR(F.col("b") - F.col("a"))
    # runs are joined piece by piece of a text before they meet, so a long one brings few
    pieces = cuts.select("k", F.shiftright("a", 16).alias("piece"), packed.alias("cut")).groupBy("k", "piece").agg(F.collect_set("cut").alias("cuts"))
    pieces = pieces.select("k", "cuts").mapInArrow(_merged, "k binary, cuts array<long>")
    cuts = stash(pieces.groupBy("k").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "repeat-cuts")

    ready = source.join(cuts, "k", "left").select(*[f"__{i}" for i in range(len(keep))], "text", "cuts")
    schema = ready.select(*[f"__{i}" for i in range(len(keep))]).schema
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if texts:
        schema = schema.add("kept", "binary")
    out = ready.mapInArrow(_kept(tuple(f"__{i}" for i in range(len(keep))), texts), schema)
    return out.withColumnsRenamed({f"__{i}": c for i, c in enumerate(keep)})
