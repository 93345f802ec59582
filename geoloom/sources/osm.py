"""OpenStreetMap extracts: a Python data source for the PBF container.

Each data block is one partition unit: the driver reads block headers only, and
tasks decompress and parse their blocks.  Rows: ``kind`` (n or w), ``id``,
``lat``, ``lon``, ``tags``, ``nodes``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.binary import fields, packed, zigzag

SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string,string>, nodes array<bigint>"


class Block(InputPartition):
    def __init__(self, path: str, at: int, size: int):
        self.path, self.at, self.size = path, at, size


def _blob(data: bytes) -> bytes:
    for number, _, v in fields(data):
        if number == 1:
            return v
        if number == 3:
            return zlib.decompress(v)
    raise ValueError("unknown compression of a data block")


def _sums(deltas: list[int]) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += d
        out.append(total)
    return out


def parse_block(data: bytes) -> Iterator[tuple]:
    """Nodes and ways of one decompressed data block."""
    strings: list[str] = []
    groups, grain, lat0, lon0 = [], 100, 0, 0
    for number, _, v in fields(data):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for n, _, s in fields(v) if n == 1]
        elif number == 2:
            groups.append(v)
        elif number == 17:
            grain = v
        elif number == 19:
            lat0 = v
        elif number == 20:
            lon0 = v
    place = lambda v, off: (off + grain * v) * 1e-9
    for group in groups:
        for number, _, v in fields(group):
            f: dict[int, list] = {}
            if number in (1, 2, 3):
                for n, _, x in fields(v):
                    f.setdefault(n, []).append(x)
            if number == 1:  # a single node
                tags = dict(zip((strings[i] for x in f.get(2, []) for i in packed(x)), (strings[i] for x in f.get(3, []) for i in packed(x))))
                yield "n", zigzag(f[1][0]), place(zigzag(f[8][0]), lat0), place(zigzag(f[9][0]), lon0), tags, None
            elif number == 2:  # dense nodes
                ids, lats, lons = (_sums([zigzag(n) for n in packed(f[k][0])]) for k in (1, 8, 9))
                keys = packed(f[10][0]) if 10 in f else []
                at = 0
                for i, a, o in zip(ids, lats, lons):
                    tags = {}
                    while at < len(keys) and keys[at]:
                        tags[strings[keys[at]]] = strings[keys[at + 1]]
                        at += 2
                    at += 1
                    yield "n", i, place(a, lat0), place(o, lon0), tags, None
            elif number == 3:  # a way
                tags = dict(zip((strings[i] for x in f.get(2, []) for i in packed(x)), (strings[i] for x in f.get(3, []) for i in packed(x))))
                refs = _sums([zigzag(n) for x in f.get(8, []) for n in packed(x)])
                yield "w", f[1][0], None, None, tags, refs


class PbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out = []
        with open(self.path, "rb") as f:
            while head := f.read(4):
                (n,) = struct.unpack(">I", head)
                h = {k: v for k, _, v in fields(f.read(n))}
                if h[1] == b"OSMData":
                    out.append(Block(self.path, f.tell(), h[3]))
                f.seek(h[3], 1)
        return out or [Block(self.path, 0, 0)]

    def read(self, partition: Block) -> Iterator[tuple]:
        if partition.size:
            with open(partition.path, "rb") as f:
                f.seek(partition.at)
                yield from parse_block(_blob(f.read(partition.size)))


class OsmPbf(DataSource):
    """``spark.read.format("osmpbf").load(path)``; the path is seen by all executors."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:  # noqa: ANN001
        return PbfReader(self.options["path"])


def with_numbers(objects, kind: str):  # noqa: ANN001, ANN201
    """Nodes (n) or ways (w) that carry a house number."""
    from pyspark.sql import functions as F

    return objects.where((F.col("kind") == kind) & F.element_at("tags", F.lit("addr:housenumber")).isNotNull())
