"""Toxicity: boosted trees over dense features, isotonic calibration.

Features are rates over the whole text: densities of the given lexicon and of
stems learned from labelled rows, how near hits stand to words of the second
person, capitals, punctuation, and signs of obfuscation.  Trees are grown on
histograms by Newton steps on the logistic loss; scores are then calibrated by
isotonic regression on rows that the trees have not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, least_hashed, stash

# A small general lexicon and words of the second person.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "dumb", "clown", "jerk", "fool", "hate")
SECOND = (
    "you your yours yourself u ur du dein deine deinen dich dir ihr euch euer sie ihre tu te ti toi ton ta tes vous votre vos usted ustedes tus vosotros".split()
)
LEET = str.maketrans("013457@$!*|", "oieastasi.l")

#: Labelled rows of each class that are learned from.
SAMPLE_ROWS = 1500
#: A stem is learned if so large a share of toxic rows has it, this many times the share of others.
STEM_SHARE, STEM_RATIO, STEM_MOST = 0.006, 8.0, 600
STEMS = (4, 5, 6)

GIVEN, STRONG, WEAK, PERSON, HIDDEN, LONG = 1, 2, 4, 8, 16, 32
WINDOW = 50
#: Distinct words remembered per worker.
CACHE_WORDS = 400_000

PUNCT = re.compile(r"^\W+|\W+$")
INNER = re.compile(r"[^\W\d_][0-9@$!*|]+[^\W\d_]")
TRIPLE = re.compile(r"(\w)\1\1")


def plain(word: str) -> str:
    """Lower-case core of a word with look-alike signs put back and runs of a letter cut to two."""
    w = PUNCT.sub("", word.lower())
    if INNER.search(w):
        w = w.translate(LEET)
    return TRIPLE.sub(r"\1\1", w).replace(".", "").replace("-", "")


def stems(word: str) -> set[str]:
    w = plain(word)
    return {w[:n] for n in STEMS if len(w) >= n} | ({w} if w else set())


@dataclass
class Flags:
    """Flags of a word, remembered."""

    strong: frozenset[str]
    weak: frozenset[str]
    cache: dict[str, int] = field(default_factory=dict)

    def of(self, word: str) -> int:
        w = plain(word)
        f = GIVEN * (w in _GIVEN or (w.endswith("s") and w[:-1] in _GIVEN)) | PERSON * (w in _SECOND)
        for n in (*STEMS, len(w)):
            k = w[:n]
            if k in self.strong:
                f |= STRONG
            if k in self.weak:
                f |= WEAK
        f |= HIDDEN * (INNER.search(word) is not None) | LONG * (TRIPLE.search(word) is not None)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if len(word) < 64:
            self.cache[word] = f
        return f


_GIVEN, _SECOND = frozenset(LEXICON), frozenset(SECOND)
FEATURES = (
    "given strong weak any_hits hit_rate best_window near_second hits_per_second second capitals all_caps exclaim question punct hidden long log_words".split()
)


def featurize(text: str, flags: Flags) -> list[float]:
    """Feature values of a whole text, in the order of FEATURES; all zero if empty."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    get = flags.cache.get
    codes = [get(w) for w in words]
    if None in codes:
        of = flags.of
        codes = [of(w) if c is None else c for c, w in zip(codes, words)]
    f = np.array(codes, np.uint8)
    hit = (f & (GIVEN | STRONG)) != 0
    hits, second = int(hit.sum()), (f & PERSON) != 0
    near, best = 0, 0
    if hits:
        at = np.flatnonzero(hit)
        best = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
        if second.any():
            p = np.flatnonzero(second)
            to = np.searchsorted(p, at)
            gap = np.minimum(np.abs(p[np.minimum(to, len(p) - 1)] - at), np.abs(at - p[np.maximum(to - 1, 0)]))
            near = int((gap <= 3).sum())
    raw = text.encode()
    size = len(raw)
    upper = size - len(raw.translate(None, _UPPER))
    punct = size - len(raw.translate(None, _PUNCT))
    caps = sum(map(str.isupper, words))
    people = int(second.sum())
    weak, strong = int(((f & WEAK) != 0).sum()), int(((f & STRONG) != 0).sum())
    return [
        int(((f & GIVEN) != 0).sum()) / n, strong / n, weak / n, min(hits, 20), hits / n, best, near, near / (people + 1), people / n,
        upper / size, caps / n, raw.count(b"!") / size, raw.count(b"?") / size, punct / size, int(((f & HIDDEN) != 0).sum()) / n, int(((f & LONG) != 0).sum()) / n, float(np.log1p(n)),
    ]


_UPPER = bytes(range(65, 91))
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Tree:
    """A tree of fixed depth; node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = len(self.feature)
        while len(x) and node[0] < inner:
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.value[node - inner]


@dataclass
class Model:
    trees: list[Tree]
    base: float
    strong: frozenset[str]
    weak: frozenset[str]
    knots: tuple[np.ndarray, np.ndarray] = (np.array([-30.0, 30.0]), np.array([0.0, 1.0]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> tuple[list[Tree], float]:
    """Gradient-boosted trees for the logistic loss on equal-mass bins."""
    p0 = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if len(y) else x
    at, trees = np.full(len(y), base), []
    inner = 2**depth - 1
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-at))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = (1e-6, 0, -1)
            if len(mine) >= 10:
                gs, hs = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[mine, j], weights=g[mine], minlength=len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[mine, j], weights=h[mine], minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(hl < 1) | (hs - hl < 1)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[2] >= 0:
                feature[k], cut[k] = best[1], edges[best[1]][best[2]]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = -rate * gs / (hs + ridge)
        at += value[leaf]
        trees.append(Tree(feature, cut, value))
    return trees, base


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators; knots of a rising line through the blocks' middles."""
    by = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for r, v in zip(raw[by].tolist(), y[by].tolist()):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], s)]
    kx = [-30.0] + [b[2] / b[1] for b in blocks] + [30.0]
    ky = [0.0] + [(b[0] + 0.01) / (b[1] + 0.02) for b in blocks] + [1.0]
    ky = np.maximum.accumulate(np.clip(ky, 0, 1))
    return np.array(kx), ky


def _stem_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, alike, stem) of whole texts; near copies mostly share their least word hash."""
    for b in batches:
        for y, t in zip(b.column("y").to_pylist(), b.column("t")):
            words = set(t.as_py().split())
            key = min((zlib.crc32(w.encode()) for w in words if len(w) > 5), default=0)
            own = sorted({s for w in words for s in stems(w)} | {""})  # the empty stem stands for the text itself
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(own), pa.int32()), pa.array([key] * len(own), pa.int64()), pa.array(own, pa.string())], names=["y", "alike", "stem"])


def learn_stems(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Stems of toxic rows: strong ones, and weak ones at a third of the ratio.

    ``sample`` has columns ``y`` and ``t``.  Texts that are alike count once.
    At most ``STEM_MOST`` stems of each kind reach the driver.
    """
    rows = sample.select("y", "t").mapInArrow(_stem_rows, "y int, alike long, stem string").distinct()
    seen = rows.groupBy("stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    seen = stash(seen, "stems")
    texts = seen.where("stem = ''").first()
    toxic, clean = (max(1, texts.toxic), max(1, texts.clean)) if texts else (1, 1)
    least = max(5, STEM_SHARE * toxic)
    out = []
    for ratio in (STEM_RATIO, STEM_RATIO / 3):
        ok = seen.where((F.col("stem") != "") & (F.col("toxic") >= least) & (F.col("toxic") / toxic >= ratio * (F.col("clean") + 1) / clean))
        out.append(frozenset(r.stem for r in ok.orderBy(F.desc("toxic"), "stem").limit(STEM_MOST).collect()))
    drop_stash(seen)
    return out[0], out[1]


def train(x: np.ndarray, y: np.ndarray, part: np.ndarray, strong: frozenset[str], weak: frozenset[str]) -> Model:
    """Trees from the rows of parts 4 to 7, calibration from parts 8 and 9.

    With labels of one class only all scores are near that class.
    """
    two, three = (part >= 4) & (part < 8), part >= 8
    trees, base = boost(x[two], y[two])
    m = Model(trees, base, strong, weak)
    if trees and three.any() and 0 < y[three].sum() < three.sum():
        m.knots = isotonic(m.raw(x[three]), y[three])
    elif not trees:
        m.knots = (np.array([-30.0, 30.0]), np.full(2, y.mean() if len(y) else 0.0))
    return m


def _features(strong: frozenset[str], weak: frozenset[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(strong, weak)
        for b in batches:
            x = [featurize(t.as_py(), flags) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("__h"), b.column("__id"), b.column("y"), b.column("part"), pa.array(x, pa.list_(pa.float64()))], names=["h", "id", "y", "part", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled rows outside the held-out fold, crc32(id) mod ``folds`` = ``fold``.

    Of each class at most ``rows`` rows with the least hash of the id are taken,
    with their whole texts.  These stay on the executors: stems are learned there
    from one part of the rows, and of the others only the features reach the
    driver.  Parts go by crc32 of the text, so equal texts share a part.  Rows
    with a null id or label are left out, repeated rows count once.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("__id").cast("string").cast("binary")) % folds != fold)
    picked = [least_hashed(known.where(F.col("y") == v), "__id", rows) for v in (0, 1)]
    text = F.coalesce("text", F.lit(""))
    sample = docs.select(F.col("doc_id").alias("__id"), text.alias("t")).join(F.broadcast(picked[0].unionByName(picked[1])), "__id")
    sample = stash(sample.dropDuplicates(["__id", "y", "t"]).withColumn("part", (F.crc32(F.col("t").cast("binary")) % 10).cast("int")), "toxic-sample")
    strong, weak = learn_stems(sample.where("part < 4"))
    schema = sample.select(F.col("__h").alias("h"), F.col("__id").alias("id"), "y", "part", F.array(F.lit(0.0)).alias("x")).schema
    got = sample.where("part >= 4").mapInArrow(_features(strong, weak), schema).orderBy("h", "id", "part", "x").limit(2 * rows).collect()
    drop_stash(sample)
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return train(x, np.array([r.y for r in got], np.float64), np.array([r.part for r in got], np.int64), strong, weak)


def classify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` for every row; null texts count as empty."""
    src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    schema = src.select(*keep).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees and at most 2 * STEM_MOST stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        flags = Flags(m.strong, m.weak)
        for b in batches:
            x = np.array([featurize(t.as_py(), flags) for t in b.column("__text")]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(m.score(x), pa.float64())], names=[*keep, "score"])

    return src.mapInArrow(run, schema)
