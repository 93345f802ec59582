"""Document quality: a byte-level convolutional network in numpy.

Input channels of a byte are its learned embedding and a self-match flag (the
eight bytes ending here also end at one of the places just before); filters of
``TAPS`` taps slide over the document with a stride.  The document is cut into
overlapping chunks that cover all of it.  Responses are max-pooled within each
chunk and each chunk gives the shares of its places over zero as well; a chunk
vector passes a hidden layer, and the chunk outputs are combined (largest,
mean) by the last layer into one probability.

Training runs on the driver over a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

CHUNK = 512  # bytes of a chunk
STEP = 384  # bytes from chunk to chunk, so neighbours overlap by 128
TAPS, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 6, 24, 16
LAGS = 48
#: Training: at most so many rows of each class, and chunks a row in training.
SAMPLE_ROWS = 1200
TRAIN_CHUNKS = 6
EPOCHS = 12


@dataclass
class Net:
    emb: np.ndarray  # 257 x EMBED; 0 is the padding, a byte is its value and 1
    conv: np.ndarray  # TAPS * (EMBED + 1) x FILTERS
    cb: np.ndarray
    w1: np.ndarray  # 2 * FILTERS x HIDDEN
    b1: np.ndarray
    w2: np.ndarray  # HIDDEN x 2: evidence, weight
    b2: np.ndarray
    w3: np.ndarray  # largest, mean -> logit
    b3: np.ndarray

    def names(self) -> list[str]:
        return list(self.__dataclass_fields__)


def new_net(seed: int = 11) -> Net:
    r = np.random.default_rng(seed)
    n = lambda *s, k=1.0: (r.normal(size=s) * k).astype(np.float32)
    z = lambda *s: np.zeros(s, np.float32)
    width = TAPS * (EMBED + 1)
    return Net(n(257, EMBED, k=0.5), n(width, FILTERS, k=width**-0.5), z(FILTERS), n(2 * FILTERS, HIDDEN, k=(2 * FILTERS) ** -0.5), z(HIDDEN), n(HIDDEN, 1, k=HIDDEN**-0.5), z(1), np.array([0.7, 0.7], np.float32), z(1))


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes, each as its value and 1; the last is padded with zeros."""
    n = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    x = np.zeros((n - 1) * STEP + CHUNK, np.uint16)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    x[: len(raw)] += 1
    return np.lib.stride_tricks.sliding_window_view(x, CHUNK)[::STEP]


def self_match(x: np.ndarray) -> np.ndarray:
    """1 where the chunk's four bytes from here also start at one of the LAGS places before."""
    n = x.shape[1]
    four = ((x - 1) & 255).astype(np.uint32)  # the padding looks like a byte that no UTF-8 text has
    code = np.zeros_like(four)
    for k in range(4):
        code[:, : n - 3] |= four[:, k : n - 3 + k] << np.uint32(8 * k)
    out = np.zeros(x.shape, bool)
    for lag in range(1, LAGS + 1):
        out[:, lag:] |= code[:, lag:] == code[:, :-lag]
    out[:, n - 3 :] = False  # no four bytes from there
    return (out & (x != 0)).astype(np.float32)


def features(net: Net, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Pooled responses of chunks: (m, 2 * FILTERS) and what the backward pass needs."""
    m = len(x)
    z = np.concatenate((net.emb[x], self_match(x)[:, :, None]), axis=2)
    z[x == 0] = 0
    places = (CHUNK - TAPS) // STRIDE + 1
    s = z.strides
    cols = np.lib.stride_tricks.as_strided(z, (m, places, TAPS * (EMBED + 1)), (s[0], s[1] * STRIDE, s[2]))
    cols = cols.reshape(m * places, -1)
    real = x[:, : places * STRIDE : STRIDE] != 0  # places in the padding do not count
    r = (cols @ net.conv + net.cb).reshape(m, places, FILTERS) * real[:, :, None]
    count = np.maximum(real.sum(axis=1), 1)[:, None].astype(np.float32)
    top = r.argmax(axis=1)
    most = np.take_along_axis(r, top[:, None], 1)[:, 0]
    share = np.clip(r, 0, 1).sum(axis=1) / count
    return np.concatenate((np.maximum(most, 0), share), axis=1), (z, cols, r, top, most, count)


def forward(net: Net, x: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, tuple]:
    """Logits of documents from their chunks; ``owner`` is ascending."""
    f, back = features(net, x)
    h = np.maximum(f @ net.w1 + net.b1, 0)
    e = (h @ net.w2 + net.b2)[:, 0]
    start = np.searchsorted(owner, np.arange(docs))
    count = np.diff(np.concatenate((start, [len(owner)])))
    most = np.maximum.reduceat(e, start)
    mean = np.add.reduceat(e, start) / count
    logit = most * net.w3[0] + mean * net.w3[1] + net.b3[0]
    return logit, (f, back, h, e, start, count, most, mean)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(net: Net, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    docs = len(y)
    logit, (f, (z, cols, r, top, most_r, real), h, e, start, count, most, mean) = forward(net, x, owner, docs)
    d = (sigmoid(logit) - y) * weight / weight.sum()
    g = {"w3": np.array([(d * most).sum(), (d * mean).sum()]), "b3": np.array([d.sum()])}
    first = np.zeros(len(e), np.float32)
    is_top = np.flatnonzero(e == most[owner])
    _, one = np.unique(owner[is_top], return_index=True)
    first[is_top[one]] = 1
    de = (d[owner] * (net.w3[0] * first + net.w3[1] / count[owner]))[:, None].astype(np.float32)
    g["w2"], g["b2"] = h.T @ de, de.sum(0)
    dh = (de @ net.w2.T) * (h > 0)
    g["w1"], g["b1"] = f.T @ dh, dh.sum(0)
    df = dh @ net.w1.T
    places = r.shape[1]
    dr = np.where((r > 0) & (r < 1), (df[:, FILTERS:] / real)[:, None], 0).astype(np.float32)
    rows = np.arange(len(x))[:, None]
    dr[rows, top, np.arange(FILTERS)[None]] += df[:, :FILTERS] * (most_r > 0)
    flat = dr.reshape(-1, FILTERS)
    g["conv"], g["cb"] = cols.T @ flat, flat.sum(0)
    dcols = (flat @ net.conv.T).reshape(len(x), places, TAPS, EMBED + 1)
    dz = np.zeros_like(z)
    for k in range(TAPS):
        dz[:, k : k + places * STRIDE : STRIDE] += dcols[:, :, k]
    demb = np.zeros_like(net.emb)
    flat_x, flat_d = x.reshape(-1), dz[:, :, :EMBED].reshape(-1, EMBED)
    for k in range(EMBED):
        demb[:, k] = np.bincount(flat_x, weights=flat_d[:, k], minlength=257)
    demb[0] = 0
    g["emb"] = demb
    return g


def draws_of(raw: bytes, epochs: int = EPOCHS, most: int = TRAIN_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """What training sees of a text: the numbers of the chunks drawn, ascending, and a
    row of places in them for each epoch.

    Each epoch draws ``most`` chunks of the whole text anew; of a short text all.
    """
    n = len(chunks_of(raw))
    if n <= most:
        return np.arange(n), np.tile(np.arange(n), (epochs, 1))
    r = np.random.default_rng(zlib.crc32(raw))
    drawn = np.stack([np.sort(r.choice(n, most, replace=False)) for _ in range(epochs)])
    number, place = np.unique(drawn, return_inverse=True)
    return number, place.reshape(drawn.shape)


def train(chunks: list[np.ndarray], draws: list[np.ndarray], labels: np.ndarray, seed: int = 5, rate: float = 4e-3) -> Net:
    """Adam over shuffled batches of documents; classes weigh the same.

    Row ``e`` of a document's draws names the chunks that epoch ``e`` sees, drawn
    over the whole text (``draws_of``); scoring always takes all chunks.  With
    labels of one class only, or none, the untrained last layer is set so that
    all scores are that class's.
    """
    net, r = new_net(), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    if len(set(y.tolist())) < 2:
        net.w3[:] = 0
        net.b3[:] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    m1 = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    m2 = {k: np.zeros_like(getattr(net, k)) for k in net.names()}
    step, batch, epochs = 0, 32, len(draws[0])
    total = epochs * -(-len(y) // batch)
    for epoch in range(epochs):
        by = r.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = by[at : at + batch]
            xs = [chunks[i][draws[i][epoch]] for i in pick]
            owner = np.repeat(np.arange(len(pick)), [len(c) for c in xs])
            g = gradients(net, np.concatenate(xs), owner, y[pick], weight[pick])
            step += 1
            lr = rate * min(1, step / 50) * (1 - step / (total + 1))
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                now = m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
                setattr(net, k, (getattr(net, k) - lr * now).astype(np.float32))
    return net


#: Chunks scored at a time.
SCORE_CHUNKS = 256


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probabilities of documents, over all of their chunks."""
    evidence: list[np.ndarray] = []
    xs = [chunks_of(t) for t in texts]
    count = np.array([len(c) for c in xs])
    held: list[np.ndarray] = []

    def flush() -> None:
        if held:
            x = np.concatenate(held)
            for a in range(0, len(x), SCORE_CHUNKS):
                f, _ = features(net, x[a : a + SCORE_CHUNKS])
                evidence.append((np.maximum(f @ net.w1 + net.b1, 0) @ net.w2 + net.b2)[:, 0])
            held.clear()

    for c in xs:
        held.append(c)
        if sum(map(len, held)) >= SCORE_CHUNKS:
            flush()
    flush()
    if not len(xs):
        return np.zeros(0)
    e = np.concatenate(evidence)
    start = np.cumsum(count) - count
    logit = np.maximum.reduceat(e, start) * net.w3[0] + np.add.reduceat(e, start) / count * net.w3[1] + net.b3[0]
    return sigmoid(logit.astype(np.float64))


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The drawn chunks of whole texts: bytes of two a value, and the draws."""
    for b in batches:
        chunks, draws = [], []
        for t in b.column("t"):
            raw = t.as_py()
            number, place = draws_of(raw)
            chunks.append(chunks_of(raw)[number].tobytes())
            draws.append(place.reshape(-1).tolist())
        cols = [b.column("__h"), b.column("__id"), b.column("y"), pa.array(chunks, pa.binary()), pa.array(draws, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["h", "id", "y", "chunks", "draws"])


def fit(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = 3, rows: int = SAMPLE_ROWS) -> Net:
    """Train on labelled rows outside the held-out fold.

    A row is held out if crc32(doc_id as text) mod ``folds`` is ``fold``.  Of
    each class at most ``rows`` rows are taken, those with the least hash of the
    id.  The chunks that training sees are drawn over their whole texts where
    the rows are; only these, at most EPOCHS * TRAIN_CHUNKS a row, reach the
    driver.  Rows with a null id or label are left out, repeats count once.
    """
    train_rows = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    train_rows = train_rows.where(F.crc32(F.col("__id").cast("string").cast("binary")) % folds != fold)
    picked = [least_hashed(train_rows.where(F.col("y") == y), "__id", rows) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    text = F.coalesce("text", F.lit("")).cast("binary")
    sample = docs.select(F.col("doc_id").alias("__id"), text.alias("t")).join(F.broadcast(chosen), "__id").dropDuplicates(["__id", "y", "t"])
    schema = sample.select(F.col("__h").alias("h"), F.col("__id").alias("id"), "y", F.col("t").alias("chunks"), F.array(F.lit(0)).alias("draws")).schema
    sample = sample.select("__h", "__id", "y", "t").mapInArrow(_drawn, schema).orderBy("h", "id", "y", "chunks").limit(2 * rows).collect()
    chunks = [np.frombuffer(r.chunks, np.uint16).reshape(-1, CHUNK) for r in sample]
    return train(chunks, [np.array(r.draws).reshape(EPOCHS, -1) for r in sample], np.array([r.y for r in sample]))


def classify(docs: DataFrame, net: Net, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` for every row; null texts count as empty."""
    src = docs.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias("__text"))
    schema = src.select(*keep).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = score(shared.value, [t.as_py() for t in b.column("__text")])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(p, pa.float64())], names=[*keep, "score"])

    return src.mapInArrow(run, schema)
