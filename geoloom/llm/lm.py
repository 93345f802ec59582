"""Language-model scoring: a log-bilinear model trained with noise contrast.

The ``OWN`` most frequent words and the end of text are outcomes of the model,
each with vectors of its own; every other word falls into one of ``FORMS``
classes by its form, and these are outcomes too, so unseen words have one.  The
model predicts a vector as the sum of the vectors of the two outcomes before,
each through a matrix of its position, and scores it against the output vector
and bias of every outcome.  A word of a form class then has a probability within
it by smoothed counts, so the probabilities of all words sum to one.

Training is noise-contrastive, in numpy, over every token of the training rows:
a bounded sample of texts warms the model up on the driver, then each task runs
over the trigrams of its own rows from there, and the tasks' models are averaged,
weighted by their tokens.  The steps grow with the corpus, what reaches the
driver does not.

The score is a sum of two terms, one for each place of the context, so the sums
over all outcomes that normalise it are, for all contexts at once, the matrix
product of the exponentials of both.  Scoring looks them up.

Counts of words cover all training documents.  The HEAD most frequent words
travel to the tasks; the counts of all others are joined.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import stash

OWN = 2048  # words that are outcomes of their own, at most
FORMS = 64
#: Vector size, noise per token, noise samples (twice as many in warm-up) and trigrams of a batch.
DIM, NOISE, SAMPLES, BATCH = 32, 25, 192, 8192
#: Texts and trigrams that warm the model up, at most, and the least number of batches.
WARM_TEXTS, WARM_ROWS, WARM_STEPS = 4000, 1_500_000, 500
#: Tokens whose trigrams a training task holds at a time.
HELD_TOKENS = 1_200_000
#: Adam's rate in warm-up; later a fifth of it.
RATE = 0.02
#: Models that reach the driver; more are averaged in tasks before.
MODELS = 8
#: Words whose counts are broadcast; longer words than HEAD_CHARS are left to the join.
HEAD, HEAD_CHARS = 150_000, 48
#: Distinct words a counting task holds before it passes them on.
HELD_WORDS = 300_000


def form_of(w: str) -> int:
    """Class of a word by its form, 0 to FORMS - 1: last sign, non-ASCII letters, length, first letter."""
    last = w[-1]
    end = 0 if last.isalpha() else 1 if last == "." else 2 if last == "," else 3
    n = len(w)
    size = 0 if n <= 3 else 1 if n <= 6 else 2 if n <= 10 else 3
    return ((end * 2 + (not w.isascii())) * 4 + size) * 2 + ("a" <= w[0] <= "l")


@dataclass
class Model:
    """Outcome 0 is the end, then come the words of their own, then the form classes."""

    own: dict[bytes, int]
    first: np.ndarray  # vectors of the outcome two places before, through its matrix
    second: np.ndarray  # of the outcome one place before
    out: np.ndarray  # output vectors
    bias: np.ndarray
    norm: np.ndarray  # log of the sum over all outcomes, for each pair of outcomes before

    def log10(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of outcomes ``w`` after ``a`` and ``b``."""
        s = np.einsum("ij,ij->i", self.first[a] + self.second[b], self.out[w]) + self.bias[w]
        return (s - self.norm[a, b]).astype(np.float64) / math.log(10)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column("__text"):
            held.update(t.as_py().lower().split())
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def _class_totals(own: dict[bytes, int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
        for b in batches:
            words = b.column("word").to_pylist()
            rest = np.array([w.encode() not in own for w in words], bool)
            k = np.array([form_of(w) for w, r in zip(words, rest) if r], np.int64)
            n += np.bincount(k, b.column("c").to_numpy()[rest], FORMS).astype(np.int64)
            v += np.bincount(k, minlength=FORMS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    return run


def outcomes_of(words: list[bytes], own: dict[bytes, int], remember: dict[bytes, int]) -> np.ndarray:
    """Outcomes of a text's words, without the end."""
    got = [own.get(w) for w in words]
    if None in got:
        forms = 1 + len(own)
        for i, g in enumerate(got):
            if g is None:
                w = words[i]
                k = remember.get(w)
                if k is None:
                    k = forms + form_of(w.decode("utf-8", "replace"))
                    if len(remember) < HELD_WORDS:
                        remember[w] = k
                got[i] = k
    return np.array(got, np.int64)


def trigrams(seqs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the trigrams of texts, each from two pads on to its end."""
    if not seqs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate([p for s in seqs for p in (_PAD, s, _END)])
    code = (c[:-2] * size + c[1:-1]) * size + c[2:]
    real = np.ones(len(c), bool)
    at = np.cumsum([0] + [len(s) + 3 for s in seqs[:-1]])
    real[at] = real[at + 1] = False  # trigrams that end in a pad
    return np.unique(code[real[2:]], return_counts=True)


_TAIL = ArrayType(StructType().add("word", "string").add("tf", "long"))
_PAD, _END = np.zeros(2, np.int64), np.zeros(1, np.int64)


def spread(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and weights of one pass over all trigrams.

    A trigram of more than eight times the mean count is dealt over several equal
    entries, so that none outweighs its batch; they sum up to its share of the counts.
    """
    mean = n.sum() / len(n)
    copies = np.ceil(n / (8 * mean)).astype(np.int64)
    return np.repeat(code, copies), np.repeat((n / mean / copies).astype(np.float32), copies)


class Trainer:
    """Noise-contrastive training with Adam, batch by batch."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: int, samples: int = 2 * SAMPLES) -> None:
        self.p, self.r, self.step, self.samples = {k: v.copy() for k, v in p.items()}, np.random.default_rng(seed), 0, samples
        self.log_noise, self.mass = np.log(noise * NOISE).astype(np.float32), np.cumsum(noise)
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def run(self, code: np.ndarray, n: np.ndarray, rate: float, least: int = 1) -> None:
        """Whole passes over the trigrams, at least ``least`` batches; the rate falls to a tenth in warm-up."""
        if not len(code):
            return
        entry, weight = spread(code, n)
        each = -(-len(entry) // BATCH)
        rounds = -(-least // each)
        for i in range(rounds):
            for j, part in enumerate(np.array_split(self.r.permutation(len(entry)), each)):
                done = (i * each + j) / (rounds * each)
                self.batch(entry[part], weight[part], rate * (1 - 0.9 * done) if least > 1 else rate)

    def batch(self, code: np.ndarray, count: np.ndarray, rate: float) -> None:
        p, size = self.p, len(self.mass)
        a, b, w = code // (size * size), code // size % size, code % size
        # noise samples are shared by the batch and weighted, so products stay matrices
        fake, times = np.unique(np.minimum(np.searchsorted(self.mass, self.r.random(self.samples)), size - 1), return_counts=True)
        weight = (times * (NOISE / self.samples)).astype(np.float32)
        hat = (p["r"] @ p["c1"])[a] + (p["r"] @ p["c2"])[b]
        out, noise = p["q"][w], p["q"][fake]
        share = count / np.float32(len(code))
        d_own = (_sigmoid(np.einsum("ij,ij->i", hat, out) + p["b"][w] - self.log_noise[w]) - 1) * share
        d_noise = _sigmoid(hat @ noise.T + (p["b"][fake] - self.log_noise[fake]))
        d_noise *= weight
        d_noise *= share[:, None]
        d_hat = d_own[:, None] * out + d_noise @ noise
        one, two = _sums(a, d_hat, size), _sums(b, d_hat, size)
        grad = {"r": one @ p["c1"].T + two @ p["c2"].T, "c1": p["r"].T @ one, "c2": p["r"].T @ two}
        grad["q"], grad["b"] = _sums(w, d_own[:, None] * hat, size), np.bincount(w, d_own, size).astype(np.float32)
        grad["q"][fake] += d_noise.T @ hat
        grad["b"][fake] += d_noise.sum(axis=0)
        self.step += 1
        one, two = np.float32(1 - 0.9**self.step), np.float32(1 - 0.99**self.step)
        for k, g in grad.items():
            m1, m2 = self.m1[k], self.m2[k]
            m1 += np.float32(0.1) * (g - m1)
            m2 += np.float32(0.01) * (g * g - m2)
            p[k] -= np.float32(rate) * (m1 / one) / (np.sqrt(m2 / two) + np.float32(1e-7))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, so that no large arrays come and go."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each index."""
    by = np.argsort(index, kind="stable")
    i = index[by]
    start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[i[start]] = np.add.reduceat(rows[by], start, axis=0)
    return out


def untrained(noise: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    r, size = np.random.default_rng(seed), len(noise)
    p = {"r": r.normal(size=(size, DIM)) * 0.1, "q": r.normal(size=(size, DIM)) * 0.1, "b": np.log(noise), "c1": np.eye(DIM) * 0.5, "c2": np.eye(DIM) * 0.5}
    return {k: v.astype(np.float32) for k, v in p.items()}


def normalised(own: dict[bytes, int], p: dict[str, np.ndarray]) -> Model:
    """The model with the sums over all outcomes of all contexts, by one matrix product."""
    first, second = p["r"] @ p["c1"], p["r"] @ p["c2"]
    one, two = first @ p["q"].T + p["b"], second @ p["q"].T
    top1, top2 = one.max(axis=1), two.max(axis=1)
    total = np.exp(one - top1[:, None], dtype=np.float64) @ np.exp(two - top2[:, None], dtype=np.float64).T
    norm = (np.log(np.maximum(total, 1e-300)) + top1[:, None] + top2[None]).astype(np.float32)
    return Model(own, first, second, p["q"], p["b"], norm)


def _learn(shared):  # noqa: ANN001, ANN202
    """One task's model from the shared one on, over all of its rows: (part, tokens, model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, noise, p = shared.value
        part = TaskContext.get().partitionId()
        t, remember = Trainer(p, noise, part, SAMPLES), {}
        seqs: list[np.ndarray] = []
        held = total = 0
        for b in batches:
            for text in b.column("__text"):
                seqs.append(outcomes_of(text.as_py().lower().split(), own, remember))
                held += len(seqs[-1]) + 1
                if held >= HELD_TOKENS:
                    t.run(*trigrams(seqs, len(noise)), RATE / 5)
                    total, held = total + held, 0
                    seqs.clear()
        t.run(*trigrams(seqs, len(noise)), RATE / 5)
        if total + held:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total + held]), pa.array([pickle.dumps(t.p)])], names=["part", "tokens", "model"])

    return run


def _mean(models: list[dict[str, np.ndarray]], tokens: list[int]) -> dict[str, np.ndarray]:
    share = np.array(tokens) / sum(tokens)
    return {k: sum(m[k] * np.float32(w) for m, w in zip(models, share)) for k in models[0]}


def _average(rows: pa.Table) -> pa.Table:
    tokens = rows.column("tokens").to_pylist()
    model = _mean([pickle.loads(m.as_py()) for m in rows.column("model")], tokens)
    return pa.table({"part": pa.array([0]), "tokens": pa.array([sum(tokens)]), "model": pa.array([pickle.dumps(model)])})


def _codes(own: dict[bytes, int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember: dict[bytes, int] = {}
        for b in batches:
            code, n = trigrams([outcomes_of(t.as_py().lower().split(), own, remember) for t in b.column("__text")], 1 + len(own) + FORMS)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return run


def train(learn: DataFrame, own: dict[bytes, int], noise: np.ndarray, texts: int) -> Model:
    """Warm-up on the driver, then a pass of every task over its rows, averaged."""
    t = Trainer(untrained(noise), noise, 5)
    if not texts:
        return normalised(own, t.p)
    # texts with the least hash; equal ones come together, so the trigrams are bounded once more
    h = F.pmod(F.xxhash64("__text"), F.lit(1 << 40))
    sample = learn.where(h < int(min(1, WARM_TEXTS / texts) * (1 << 40)) + 1).mapInArrow(_codes(own), "code long, n long")
    sample = sample.groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("code")).limit(WARM_ROWS).toArrow()
    t.run(sample.column("code").to_numpy(), sample.column("n").to_numpy(), RATE, WARM_STEPS)
    shared = learn.sparkSession.sparkContext.broadcast((own, noise, t.p))
    models = stash(learn.mapInArrow(_learn(shared), "part long, tokens long, model binary"), "lm-models")
    while models.count() > MODELS:  # a group holds as many models as reach the driver in the end
        groups = models.withColumn("g", F.floor(F.col("part") / MODELS))
        few = groups.groupBy("g").applyInArrow(lambda k, rows: _average(rows.drop_columns(["g"])).set_column(0, "part", pa.array([k[0].as_py()])), "part long, tokens long, model binary")
        models = stash(few, "lm-models")
    got = sorted(models.collect(), key=lambda r: r.part)
    return normalised(own, _mean([pickle.loads(r.model) for r in got], [r.tokens for r in got]))


def _score(shared, keep: tuple[str, ...]):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, head, count, outcome, inside, ends = shared.value
        head_log = np.log10(count + 1.0)
        remember: dict[bytes, int] = {}
        row = TaskContext.get().partitionId() << 33
        forms = 1 + len(m.own)
        for b in batches:
            seqs, logs, n_tokens, known = [], [], [], []
            words, tf, at = [], [], [0]
            for t in b.column("__text"):
                w = t.as_py().lower().split()
                i = np.array([head.get(x, -1) for x in w], np.int64) if w else np.zeros(0, np.int64)
                seen = i >= 0
                k = outcome[i]
                if not seen.all():
                    rest = [w[j] for j in np.flatnonzero(~seen)]
                    k[~seen] = outcomes_of(rest, {}, remember) + len(m.own)
                    c = Counter(rest)
                    words += [x.decode("utf-8", "replace") for x in c]
                    tf += c.values()
                at.append(len(words))
                seqs += [_PAD, k, _END]
                logs.append((float(head_log[i[seen]].sum()), float(head_log[i[seen & (k >= forms)]].sum())))
                n_tokens.append(len(w) + 1)
                known.append(int(seen.sum()) + (ends > 0))
            size = np.array(n_tokens, np.int64)
            score = np.zeros(len(size))
            if len(size):
                c = np.concatenate(seqs)
                first = np.cumsum(size + 2) - size  # place of each text's first token
                for lo in range(0, len(size), 64):  # texts at a time, to bound memory
                    hi = min(lo + 64, len(size))
                    j = np.arange(first[lo], first[hi - 1] + size[hi - 1])
                    lm = np.empty(len(j))
                    for x in range(0, len(j), 1 << 18):
                        y = j[x : x + (1 << 18)]
                        lm[x : x + (1 << 18)] = m.log10(c[y - 2], c[y - 1], c[y])
                    lm -= inside[c[j]]
                    pad = np.ones(len(j), bool)  # the pads between texts are no tokens
                    for f in first[lo + 1 : hi] - first[lo]:
                        pad[f - 2 : f] = False
                    lm[~pad] = 0
                    score[lo:hi] = np.add.reduceat(lm, first[lo:hi] - first[lo])
            n = len(size)
            base, within = (np.array([x[i] for x in logs]).reshape(n) for i in (0, 1))
            tail = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(tf, pa.int64())], names=["word", "tf"]))
            cols = [*(b.column(c) for c in keep), pa.array(np.arange(row, row + n)), pa.array(size), pa.array(known, pa.int64())]
            cols += [pa.array(base + math.log10(ends + 1)), pa.array(score + within), tail]
            row += n
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "__rid", "n_tokens", "n_known", "base_score", "score", "__tail"])

    return run


def score_documents(docs: DataFrame, train_on: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every row's whole text; learn from the rows where ``train_on`` holds.

    Output: ``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-one unigram) and ``score``, both sums of log10 over words and the end.
    Null texts count as empty (one token, the end).  Without training rows the
    counts are zero and all outcomes of a context differ only by the untrained
    weights.  Repeated rows are scored each; other columns do not matter.
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit("")).cast("binary").alias("__text")
    learn = docs.where(train_on).select(body)
    counts = learn.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = stash(counts, "lm-counts")
    ends = learn.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n + ends, sums.v + (ends > 0)
    short = counts.where(F.length("word") <= HEAD_CHARS)
    # words over a count, chosen so that at most HEAD have it; a sorted limit would send HEAD rows of every task
    step = F.floor(F.log2("c") * 8)
    steps = short.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()  # at most 8 per doubling of the count
    room, least = HEAD, 1 << 62
    for r in sorted(steps, key=lambda r: -r.s):
        room -= r.n
        if room < 0:
            break
        least = r.s
    top = sorted(short.where(step >= least).collect(), key=lambda r: (-r.c, r.word))  # at most HEAD words of HEAD_CHARS
    own = {r.word.encode(): 1 + i for i, r in enumerate(top[:OWN])}
    per_class = counts.mapInArrow(_class_totals(own), "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tail, kinds = np.zeros(FORMS), np.zeros(FORMS)
    for r in per_class:
        tail[r.k], kinds[r.k] = r.n, r.v
    seen = np.concatenate(([ends], [r.c for r in top[:OWN]], tail)) + 1.0
    model = train(learn, own, seen / seen.sum(), ends)
    inside = np.concatenate((np.zeros(1 + len(own)), np.log10(tail + kinds + 1)))  # words of their own are certain in it
    head = {r.word.encode(): i for i, r in enumerate(top)}
    count = np.array([r.c for r in top], np.int64)
    outcome = np.array([own.get(w) or 1 + len(own) + form_of(w.decode()) for w in head], np.int64)
    outcome = np.concatenate((outcome, [0]))  # for words that are not in the head
    shared = spark.sparkContext.broadcast((model, head, count, outcome, inside, ends))

    src = docs.select(*keep, body)
    schema = src.select(*keep).schema
    for c in ("__rid", "n_tokens", "n_known"):
        schema = schema.add(c, "long")
    schema = schema.add("base_score", "double").add("score", "double").add("__tail", _TAIL)
    rows = stash(src.mapInArrow(_score(shared, keep), schema), "lm-rows")
    tail = rows.select("__rid", F.explode("__tail").alias("t")).select("__rid", F.col("t.word").alias("word"), F.col("t.tf").alias("tf"))
    found = tail.join(counts, "word").groupBy("__rid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("log"), F.sum("tf").alias("known"))
    log, more = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    smooth = math.log10(total + distinct + 1)
    return rows.drop("__tail").join(found, "__rid", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + log - F.col("n_tokens") * smooth).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
