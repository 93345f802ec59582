"""Benchmark decontamination: BM25 retrieval with block-max WAND, then overlap.

The test items form the index, every passage of the corpus is a query.  Terms
are pairs of neighbouring words (the word itself in an item of one word), since
single words of ordinary prose tell items from passages badly.  Impacts are BM25 weights divided by the item's own total, so a score is the share of the
item's weight that the passage holds, and one threshold fits items of any
length.  Postings are kept in blocks with the largest impact of each; the WAND
loop skips blocks whose bounds cannot reach the threshold, and returns every
item that does.  Before it, a passage must hold enough weight in essential
terms: the most frequent terms together never reach half of the threshold for
any item, so a passage without the others cannot pass.

An item that is retrieved counts as leaked if the passage holds at least
``least`` of the item's five-word shingles and at least ``part_least`` of those
of its question and of its answer.  The question is the text up to the last
question mark; without one, or with nothing behind it, the halves stand for
question and answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Postings of a block.
POSTINGS = 16
#: Bytes of item text in one broadcast index; larger benchmarks take several passes.
SHARD_BYTES = 8 << 20


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms_of(words: list[str]) -> list[tuple[str, str]]:
    """Neighbouring pairs; a lone word stands with an empty one."""
    return list(zip(words, words[1:])) if len(words) > 1 else [(w, "") for w in words]


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else ({tuple(words)} if words else set())


@dataclass
class Index:
    """Inverted index of test items; item numbers are places in ``ids``."""

    theta: float
    ids: list[int] = field(default_factory=list)
    parts: list[tuple[set, set, set, int]] = field(default_factory=list)  # all, question, answer, shingle length
    words: dict[str, int] = field(default_factory=dict)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted codes of the terms
    code_term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    alone: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # words that are an item by themselves
    postings: list[list[tuple[int, float]]] = field(default_factory=list)
    block_max: list[list[float]] = field(default_factory=list)
    bound: np.ndarray = field(default_factory=lambda: np.zeros(0))
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    need: float = 0.0
    longest: int = 0

    @classmethod
    def build(cls, items: list[tuple[int, str]], df: dict[tuple[str, str], int], total: int, mean: float, theta: float, n: int = 5) -> Index:
        self = cls(theta)
        weights: list[dict[tuple[str, str], float]] = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            tf: dict[tuple[str, str], int] = {}
            for w in terms_of(words):
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * sum(tf.values()) / mean)
            raw = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            own = sum(raw.values())
            at = text.rfind("?") + 1
            question = words_of(text[:at])
            if not question or len(question) == len(words):
                question = words[: (len(words) + 1) // 2]
            answer = words[len(question) :]
            self.ids.append(item)
            self.parts.append((shingles(words, n), shingles(question, n), shingles(answer, n), n))
            weights.append({w: x / own for w, x in raw.items()})
            self.longest = max(self.longest, len(words))
        lists: dict[tuple[str, str], list[tuple[int, float]]] = {}
        for i, ws in enumerate(weights):
            for w, x in ws.items():
                lists.setdefault(w, []).append((i, x))
        order = sorted(lists, key=lambda w: (-len(lists[w]), w))
        vocabulary = sorted({w for pair in order for w in pair if w})
        self.words = {w: i for i, w in enumerate(vocabulary)} | {"": len(vocabulary)}
        codes = np.array([self.code(*pair) for pair in order], np.int64)
        self.code_term = np.argsort(codes)
        self.codes = codes[self.code_term]
        self.alone = np.zeros(len(vocabulary) + 1, bool)
        self.alone[[self.words[a] for a, b in order if not b]] = True
        self.postings = [lists[w] for w in order]
        self.block_max = [[max(x for _, x in p[k : k + POSTINGS]) for k in range(0, len(p), POSTINGS)] for p in self.postings]
        self.bound = np.array([max(b) for b in self.block_max])
        mass = np.zeros(len(self.ids))
        self.essential = np.ones(len(order), bool)
        for t, p in enumerate(self.postings):  # most frequent terms first
            for i, x in p:
                mass[i] += x
            if mass.max() >= theta / 2:
                for i, x in p:
                    mass[i] -= x
                break
            self.essential[t] = False
        self.need = theta - (mass.max() if len(mass) else 0) - 1e-9
        return self

    def code(self, a: str, b: str) -> int:
        return self.words[a] * len(self.words) + self.words[b]

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and terms of a text's index terms."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        n = len(self.words)
        pair = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[pair] * n + ids[pair + 1]
        lone = np.flatnonzero(self.alone[ids] & (ids >= 0))
        at, code = np.concatenate((pair, lone)), np.concatenate((code, ids[lone] * n + n - 1))
        to = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        ok = self.codes[to] == code
        return at[ok], self.code_term[to[ok]]

    def search(self, query: list[int]) -> list[tuple[int, float]]:
        """All items of score theta or more for a set of terms: block-max WAND."""
        theta, bound = self.theta - 1e-9, self.bound
        lists = [[t, 0] for t in query]  # term, place in its postings
        found = []
        while True:
            lists = [x for x in lists if x[1] < len(self.postings[x[0]])]
            lists.sort(key=lambda x: self.postings[x[0]][x[1]][0])
            total, pivot = 0.0, -1
            for k, (t, _) in enumerate(lists):
                total += bound[t]
                if total >= theta:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = self.postings[lists[pivot][0]][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and self.postings[lists[pivot + 1][0]][lists[pivot + 1][1]][0] == item:
                pivot += 1
            # bounds of the blocks in which the pivot item would stand
            total, ahead = 0.0, None
            for t, at in lists[: pivot + 1]:
                p = self.postings[t]
                b = at // POSTINGS
                while b < len(self.block_max[t]) and p[min((b + 1) * POSTINGS, len(p)) - 1][0] < item:
                    b += 1
                if b < len(self.block_max[t]):
                    total += self.block_max[t][b]
                    last = p[min((b + 1) * POSTINGS, len(p)) - 1][0] + 1
                    ahead = last if ahead is None else min(ahead, last)
            if total < theta:  # skip to the end of the nearest block, or to the next list's item
                if pivot + 1 < len(lists):
                    nxt = self.postings[lists[pivot + 1][0]][lists[pivot + 1][1]][0]
                    ahead = nxt if ahead is None else min(ahead, nxt)
                goal = max(item + 1, ahead if ahead is not None else item + 1)
                for x in lists[: pivot + 1]:
                    self.advance(x, goal)
            elif self.postings[lists[0][0]][lists[0][1]][0] == item:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += self.postings[x[0]][x[1]][1]
                    x[1] += 1
                if score >= theta:
                    found.append((item, score))
            else:
                for x in lists[:pivot]:
                    self.advance(x, item)

    def advance(self, x: list[int], goal: int) -> None:
        p, n = self.postings[x[0]], len(self.postings[x[0]])
        at = x[1]
        while at < n and p[min((at // POSTINGS + 1) * POSTINGS, n) - 1][0] < goal:
            at = (at // POSTINGS + 1) * POSTINGS
        while at < n and p[at][0] < goal:
            at += 1
        x[1] = at

    def leaks(self, text: str, least: float, part_least: float) -> list[tuple[int, float, float, float, float]]:
        """Leaked items of a text: (item id, score, share of all, question, answer)."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        at, terms = self.find(words)
        strong = self.essential[terms]
        if not strong.any():
            return []
        stride = max(32, self.longest)
        # a passage is two strides long, so an item lies whole in one; it has the tokens of strides j and j + 1
        cell = np.concatenate((at[strong] // stride, at[strong] // stride - 1))
        cell[cell < 0] = 0
        keys = np.unique(cell * len(self.bound) + np.concatenate((terms[strong], terms[strong])))
        sums = np.bincount(keys // len(self.bound), weights=self.bound[keys % len(self.bound)])
        best: dict[int, tuple[int, float, float, float, float]] = {}
        for j in np.flatnonzero(sums >= self.need).tolist():
            a, b = j * stride, (j + 2) * stride
            got = self.search(np.unique(terms[(at >= a) & (at < b)]).tolist())
            if got:
                passage = shingles(words[a:b], self.parts[0][3])
                for i, score in got:
                    everything, question, answer, n = self.parts[i]
                    have = [self.share(x, passage, words[a:b], n) for x in (everything, question, answer)]
                    if have[0] >= least and min(have[1:]) >= part_least and (i not in best or have[0] > best[i][2]):
                        best[i] = (self.ids[i], score, *have)
        return [best[i] for i in sorted(best)]

    @staticmethod
    def share(part: set, passage: set, words: list[str], n: int) -> float:
        """Share of a part's shingles in the passage; parts under n words as a whole."""
        if not part:
            return 1.0
        one = next(iter(part))
        if len(one) < n:
            return float(one in set(zip(*(words[i:] for i in range(len(one))))))
        return len(part & passage) / len(part)


MATCH = "array<struct<item_id:long,score:double,overlap:double,question:double,answer:double>>"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
    for b in batches:
        terms = [[{"a": x, "b": y} for x, y in terms_of(words_of(t.as_py()))] for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(terms, kind)], names=["shard", "w"])


def annotate(docs: DataFrame, benchmark: DataFrame, theta: float = 0.5, least: float = 0.8, part_least: float = 0.5) -> DataFrame:
    """``docs`` with a column ``matches``: the leaked items of each row's text.

    ``benchmark`` has ``item_id`` and ``text``; items with null or wordless
    texts, or a null id, are passed over.  Null texts count as empty.  All rows
    and columns of ``docs`` are kept (a column named ``matches`` is replaced).
    Items are told apart by row, so a repeated item id may match more than once.
    An empty benchmark matches nothing.
    """
    spark = docs.sparkSession
    items = stash(benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null"), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    shards = max(1, -(-size.b // SHARD_BYTES))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("long"))

    tokens = items.select("shard", "text").mapInArrow(_item_terms, "shard long, w array<struct<a:string,b:string>>")
    mean = tokens.agg(F.avg(F.size("w")).alias("m")).first().m or 1.0
    each = tokens.select("shard", F.explode(F.array_distinct("w")).alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    base = docs.drop("matches")
    indexes = []
    for shard in range(shards):
        rows = [(r.item_id, r.text) for r in items.where(F.col("shard") == shard).orderBy("item_id", "text").collect()]
        mine = each.where(F.col("shard") == shard).select("w").distinct()
        counts = {tuple(r.w): r.df for r in df.join(mine, "w").collect()}
        indexes.append(spark.sparkContext.broadcast(Index.build(rows, counts, size.n, mean, theta)))
    names = base.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64())] + [(n, pa.float64()) for n in ("score", "overlap", "question", "answer")]))
        for b in batches:
            got = []
            for t in b.column(at):
                text = t.as_py() or ""
                found = [f for ix in indexes for f in ix.value.leaks(text, least, part_least)]
                got.append([dict(zip(("item_id", "score", "overlap", "question", "answer"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*names, "matches"])

    return base.mapInArrow(run, base.withColumn("matches", F.array().cast(MATCH)).schema)


def leaked(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), **how: float) -> DataFrame:
    """One row per leaked item and row of ``docs``: ``keep`` and the match."""
    found = annotate(docs.select(*keep, "text"), benchmark, **how)
    return found.select(*keep, F.explode("matches").alias("m")).select(*keep, "m.*")
