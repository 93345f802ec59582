"""Secret scan: fixed patterns plus sliding-window entropy.

Candidates are long runs of key characters.  A window of fixed length slides
over each; its Shannon entropy is kept up to date from the counts of the one
character that leaves and the one that enters.  The threshold depends on the
candidate's character class.  Windows over the threshold are joined to spans;
an allow-list then takes out known harmless strings.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters with AKIA
HEX = re.compile(r"[0-9a-f]{24,}")

KINDS = ("assign", "access", "hex", "entropy")
#: Cheap test before ASSIGN is run: one of its words occurs.
HINTS = ("password", "passwd", "secret", "token", "api")


@dataclass(frozen=True)
class EntropyRule:
    """Parameters of the sliding window."""

    window: int = 20
    #: Least entropy in bits per character, by class of the candidate.
    hex_bits: float = 3.0
    alnum_bits: float = 3.6
    mixed_bits: float = 3.9
    #: Strings never reported: letters alone (words), digits alone, sequences, examples.
    allow: str = r"(?i)^[a-z_/=-]+$|^[0-9_/=-]+$|example|placeholder|0123456789|abcdefghij"


CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def _class_bits(s: str, rule: EntropyRule) -> float:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return rule.hex_bits
    return rule.alnum_bits if s.isalnum() else rule.mixed_bits


def entropy_spans(s: str, rule: EntropyRule) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``s`` whose entropy reaches the class's bits."""
    w, n = rule.window, len(s)
    if n < w or re.search(rule.allow, s):
        return []
    f = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]  # entropy = log2(w) - sum(f) / w; one enters before one leaves
    most = w * (math.log2(w) - _class_bits(s, rule)) + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += f[k + 1] - f[k]
        if i >= w:
            out = s[i - w]
            k = counts[out]
            counts[out] = k - 1
            total += f[k - 1] - f[k]
        if i >= w - 1 and total <= most:
            start = i - w + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def find_secrets(text: str, rule: EntropyRule = EntropyRule()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans as (start, kind number, end), sorted; code points."""
    base: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    added: list[tuple[int, int, int]] = []
    candidates = [(m.start(), m.group()) for m in CANDIDATE.finditer(text)]
    if candidates:  # a hex run of 24 is part of a candidate
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base.sort()
        starts = [x for x, _, _ in base]
        ends = list(accumulate((y for _, _, y in base), max))  # furthest end of the base spans so far
        for at, s in candidates:
            for a, b in entropy_spans(s, rule):
                a, b = a + at, b + at
                k = bisect_right(starts, a)
                if not k or ends[k - 1] < b:
                    added.append((a, 3, b))
    base.sort()
    return base, added


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Scan the whole ``text`` of every row; rows are kept as they are.

    Output: the ``keep`` columns, ``n_assign``, ``n_access``, ``n_hex``,
    ``n_entropy``, ``base_sha256`` and ``spans`` (``kind:start:end`` by start,
    then kind, joined by commas).  A null text counts as empty (no spans); an
    empty table gives an empty result; other columns are not looked at.
    """
    src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    schema = src.select(*keep).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, spans = [], []
            for t in b.column("__text"):
                base, added = find_secrets(t.as_py(), rule)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base) if k < 3 else len(added))
                digest.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(base + added))
            cols = [b.column(k) for k in keep] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return src.mapInArrow(run, schema)


def mask_secrets(text: str, rule: EntropyRule = EntropyRule(), sign: str = "[SECRET]") -> str:
    """``text`` with every found span, overlapping ones joined, put as ``sign``."""
    base, added = find_secrets(text, rule)
    out, at = [], 0
    for a, _, b in sorted(base + added):
        if a >= at:
            out += [text[at:a], sign]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; nulls stay null, all rows
    and all other columns are kept, and ``n_chars``, if there, is counted anew
    where the text changed."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def masked(t):  # noqa: ANN001, ANN202
        return t.map(lambda x: None if x is None else mask_secrets(x, rule))

    old = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(old, masked("text").alias("masked"))
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in cols:
        n = F.length("masked").cast(docs.schema["n_chars"].dataType)
        cols["n_chars"] = F.when(F.col("masked").eqNullSafe(F.col("row.text")), cols["n_chars"]).otherwise(n)
    cols["text"] = F.col("masked")
    return out.select(*[v.alias(c) for c, v in cols.items()])
