"""SentencePiece BPE encoding and decoding by a table of prefixes.

Of every prefix of a segment the table keeps the one last token that its
encoding can end with.  An Aho-Corasick automaton names the vocabulary entries
that end at a place; the entry is the right one if the prefix before it ends
with a token that may stand beside it, that is, if encoding the two strings
together gives just these two tokens.  The ids are then read backwards from the
last prefix.  Work per segment is linear in its length.

Segments: no vocabulary entry has a space mark behind another character, so
texts are cut before every run of spaces; characters without a vocabulary entry
stand alone as UTF-8 byte tokens, so texts are cut around them too; and a segment may
be cut wherever no entry holds the two neighbouring characters.  Entries made
of space marks alone have the lowest score, so a run is merged, leftmost pair
first, after the word behind it has taken its mark.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MARK = "▁"
#: Segments in each of the two generations that a Python worker remembers.
CACHE_SEGMENTS = 350_000
#: Rows of an output batch; bounds what ids and texts take at a time.
ROWS = 256


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.sp = sp
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.ids):
            raise ValueError("an entry holds a space mark behind or before other characters")
        #: Of each entry that its own string merges to, the two parts of its last merge.
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if p.strip(MARK) or p == MARK:
                steps: list[tuple[str, str]] = []
                if self.merge(list(p), steps) == [p]:
                    self.parts[p] = steps[-1] if steps else None
                    self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        known = {c for p in self.ids for c in p if c != MARK}
        cls = "".join(re.escape(c) for c in sorted(known))
        # a run of spaces with the word behind it, or one character without an entry
        self.segments = re.compile(f"{MARK}*[{cls}]+|{MARK}+|.", re.S)
        #: Neighbouring characters within some entry; elsewhere a segment may be cut.
        self.bigrams = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.beside: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.young: dict[str, str] = {}
        self.tails: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def merge(self, symbols: list[str], steps: list[tuple[str, str]] | None = None) -> list[str]:
        """Plain merging by best score, then leftmost; for single entries and space runs."""
        nxt = list(range(1, len(symbols) + 1))
        prv = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(symbols) and (s := self.score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, symbols[i], symbols[j]))

        for i in range(len(symbols) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            if steps is not None:
                steps.append((a, b))
            nxt[i] = nxt[j]
            if nxt[i] < len(symbols):
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [s for s in symbols if s]

    def may_stand(self, left: str, right: str) -> bool:
        """Whether no merge across the border comes before those within.

        The tokens are taken apart from the border's sides, the one merged later
        first; at each stage the two parts at the border must not have a merge
        that comes before the one just undone.
        """
        key = (left, right)
        got = self.beside.get(key)
        if got is None:
            if len(self.beside) > 400_000:
                self.beside.clear()
            score, parts = self.score, self.parts
            a, b, undone, of_right = left, right, -float("inf"), False
            while True:
                across = score.get(a + b)
                if across is not None and (across > undone or (across == undone and of_right)):
                    got = False  # of equal scores the leftmost pair merges first
                    break
                pa_, pb = parts[a], parts[b]
                if pa_ is None and pb is None:
                    got = True
                    break
                if pb is None or (pa_ is not None and score[a] < score[b]):
                    undone, a, of_right = score[a], pa_[1], False
                else:
                    undone, b, of_right = score[b], pb[0], True
            self.beside[key] = got
        return got

    def word(self, s: str) -> list[str]:
        """Tokens of a string of known characters with one mark in front at most."""
        last: list[str | None] = [None] * (len(s) + 1)
        beside, may_stand = self.beside, self.may_stand
        for end, (p, n) in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                start = end - n
                if start:
                    q = last[start]
                    if q is None:
                        continue
                    got = beside.get((q, p))
                    if got is None:
                        got = may_stand(q, p)
                    if not got:
                        continue
                last[end] = p
        out, at = [], len(s)
        while at:
            p = last[at]
            if p is None:
                raise ValueError(f"no encoding of {s!r}")
            out.append(p)
            at -= len(p)
        return out[::-1]

    def run(self, n: int) -> list[int]:
        """Ids of n space marks that no word has taken."""
        if n not in self.runs:
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[n] = [self.ids[p] for p in self.merge([MARK] * n)]
        return self.runs[n]

    def segment(self, s: str) -> list[int]:
        body = s.lstrip(MARK)
        n = len(s) - len(body)
        if not body:
            return self.run(n)
        if len(body) == 1 and body not in self.ids and not n:
            return [self.byte_ids[b] for b in body.encode("utf-8", "surrogatepass")]
        if not n:
            return [self.ids[p] for p in self.word(body)]
        tokens = self.word(MARK + body)
        if tokens[0] == MARK:
            return self.run(n) + [self.ids[p] for p in tokens[1:]]
        return (self.run(n - 1) if n > 1 else []) + [self.ids[p] for p in tokens]

    def encode_parts(self, text: str) -> list[str]:
        """Per word, its ids in decimal, joined by commas."""
        if not text:
            return []
        # words are keyed without their mark; one behind a line break keeps the break and has no mark
        words = text.replace("\n", " \n").split(" ")
        if "" in words or MARK in text:  # runs of spaces
            return [self.get_segment(s) for s in self.segments.findall(MARK + text.replace(" ", MARK))]
        get = self.young.get
        out = [get(w) for w in words]
        if None in out:
            out = [got or self.remember(w) for got, w in zip(out, words)]
        return out

    def get_segment(self, s: str) -> str:
        """A segment with its marks; a word with one mark is looked up without it."""
        if s[0] == MARK and len(s) > 1 and s[1] != MARK:
            w = s[1:]
            return self.young.get(w) or self.remember(w)
        return self.parts_of(s)

    def parts_of(self, s: str) -> str:
        """Ids of a string with its marks, cut where no entry holds both neighbours."""
        bigrams = self.bigrams
        at = len(s) - len(s.lstrip(MARK))
        cuts = [i for i in range(max(at, 1), len(s)) if s[i - 1 : i + 1] not in bigrams]
        if not cuts:
            return ",".join(map(str, self.segment(s)))
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(s)]):
            part = s[a:b]
            if part[0] == MARK and len(part) > 1 and part[1] != MARK:
                got = self.young.get(part[1:]) or self.remember(part[1:])  # mostly a word before punctuation
            else:
                got = self.tails.get(part)
                if got is None:
                    if len(self.tails) >= CACHE_SEGMENTS:
                        self.tails.clear()
                    got = ",".join(map(str, self.segment(part)))
                    if len(part) < 64:
                        self.tails[part] = got
            out.append(got)
        return ",".join(out)

    def remember(self, w: str) -> str:
        """Ids of a word that the young generation does not hold."""
        got = self.old.get(w) or (self.parts_of(w) if w[0] == "\n" else self.parts_of(MARK + w))
        if len(w) < 64:
            if len(self.young) >= CACHE_SEGMENTS:
                self.old, self.young = self.young, {}
            self.young[w] = got
        return got

    def encode_text(self, text: str) -> str:
        """All ids of a text in decimal, joined by commas."""
        return ",".join(self.encode_parts(text))

    def encode(self, text: str) -> list[int]:
        joined = self.encode_text(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode and decode the whole ``text`` of every row.

    ``model_path`` is a local path of every executor.  Output: the ``keep``
    columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``ids``,
    ``ids`` and ``decoded``.  A null text counts as empty: no ids, empty decoded
    text.  Rows are never merged or dropped; columns of the input that are not
    in ``keep`` do not matter, and an empty table gives an empty result.
    """
    src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    out_schema = src.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        out_schema = out_schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n, digest, back, all_ids, texts = [], [], [], [], []
                for t in b.column("__text"):
                    joined = m.encode_text(t.as_py())
                    flat = list(map(int, joined.split(","))) if joined else []
                    decoded = m.decode(flat)
                    n.append(len(flat))
                    digest.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if ids:
                        all_ids.append(pa.array(flat, pa.int32()))
                        texts.append(decoded)
                cols = [b.column(k) for k in keep] + [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = pa.array([0, *accumulate(n)], pa.int32())
                    cols += [pa.ListArray.from_arrays(offsets, pa.concat_arrays(all_ids)), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, out_schema)
