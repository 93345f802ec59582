"""Binary formats: encoded polylines, vector tiles, PNG."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

POINTS = ArrayType(StructType().add("lon", DoubleType()).add("lat", DoubleType()))


def decode_polyline(text: str | None, digits: int = 6) -> list[tuple[float, float]] | None:
    """(lon, lat) of an encoded polyline: zigzag numbers of five bits a sign."""
    if text is None:
        return None
    scale, at, total, out = 10.0**digits, 0, [0, 0], []
    while at < len(text):
        for k in (0, 1):
            shift = value = 0
            while True:
                b = ord(text[at]) - 63
                at += 1
                value |= (b & 31) << shift
                shift += 5
                if b < 32:
                    break
            total[k] += ~(value >> 1) if value & 1 else value >> 1
        out.append((total[1] / scale, total[0] / scale))
    return out


def encode_polyline(points: list[tuple[float, float]], digits: int = 6) -> str:
    scale, last, out = 10**digits, [0, 0], []
    for lon, lat in points:
        for k, v in enumerate((round(lat * scale), round(lon * scale))):
            d = v - last[k]
            last[k] = v
            n = ~(d << 1) if d < 0 else d << 1
            while n >= 32:
                out.append(chr((n & 31 | 32) + 63))
                n >>= 5
            out.append(chr(n + 63))
    return "".join(out)


@F.pandas_udf(POINTS)
def polyline_points(s: pd.Series) -> pd.Series:
    """Points of polylines with six digits; null stays null."""
    return s.map(lambda t: None if (p := decode_polyline(t)) is None else [{"lon": a, "lat": b} for a, b in p])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, Any]]:
    """Fields of a protobuf message: number, wire type, value."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _tile_value(data: bytes) -> str | int | bool | None:
    """An attribute value; floating-point numbers are not read."""
    out: str | int | bool | None = None
    for number, _, v in fields(data):
        if number == 1:
            out = v.decode("utf-8", "replace")
        elif number == 4:
            out = v - (1 << 64) if v >> 63 else v
        elif number == 5:
            out = v
        elif number == 6:
            out = zigzag(v)
        elif number == 7:
            out = bool(v)
    return out


def tile_features(data: bytes | None, layer: str | None = None) -> Iterator[tuple[str, int, dict[str, Any]]]:
    """Layer, geometry type and attributes of a vector tile's features."""
    if not data:
        return
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for number, _, raw in fields(data):
        if number != 3:
            continue
        name, keys, values, features = "", [], [], []
        for n, _, v in fields(raw):
            if n == 1:
                name = v.decode()
            elif n == 2:
                features.append(v)
            elif n == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif n == 4:
                values.append(_tile_value(v))
        if layer is not None and name != layer:
            continue
        for f in features:
            tags, kind = [], 0
            for n, wire, v in fields(f):
                if n == 2:
                    tags += packed(v) if wire == 2 else [v]
                elif n == 3:
                    kind = v
            yield name, kind, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}


class _MvtFeatures:
    def eval(self, data: bytes, layer: str):  # noqa: ANN201
        for name, kind, attrs in tile_features(data, layer):
            text = {k: (str(v).lower() if isinstance(v, bool) else str(v)) for k, v in attrs.items() if v is not None}
            yield name, kind, text


def register_mvt(spark, name: str = "mvt_features") -> None:  # noqa: ANN001
    """Register the table function ``mvt_features(tile, layer)`` for LATERAL joins."""
    spark.udtf.register(name, F.udtf(_MvtFeatures, returnType="layer string, geom_type int, attrs map<string,string>"))


def _field(number: int, wire: int, payload: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out + bytes([n]))

    head = varint(number << 3 | wire)
    return head + varint(payload) if wire == 0 else head + varint(len(payload)) + payload


def write_tile(layers: dict[str, list[tuple[list[tuple[int, int]], dict[str, str | int | bool]]]], extent: int = 4096) -> bytes:
    """A vector tile of polygons: per layer, rings in tile coordinates and attributes."""
    pack = lambda ns: b"".join(_field(0, 0, n)[1:] for n in ns)
    zig = lambda n: (n << 1) ^ (n >> 63)
    out = b""
    for name, features in layers.items():
        keys: dict[str, int] = {}
        values: dict[Any, int] = {}
        body = _field(15, 0, 2) + _field(1, 2, name.encode())
        for ring, attrs in features:
            tags = []
            for k, v in attrs.items():
                tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values))]
            cmds, x, y = [], 0, 0
            for i, (px, py) in enumerate(ring):
                if i < 2:
                    cmds.append(1 << 3 | 1 if i == 0 else (len(ring) - 1) << 3 | 2)
                cmds += [zig(px - x), zig(py - y)]
                x, y = px, py
            cmds.append(1 << 3 | 7)
            body += _field(2, 2, _field(2, 2, pack(tags)) + _field(3, 0, 3) + _field(4, 2, pack(cmds)))
        body += b"".join(_field(3, 2, k.encode()) for k in keys)
        for kind, v in values:
            body += _field(4, 2, _field(7, 0, int(v)) if kind is bool else _field(6, 0, zig(v)) if kind is int else _field(1, 2, str(v).encode()))
        out += _field(3, 2, body + _field(5, 0, extent))
    return out


def encode_png(rgb: bytes, width: int, height: int) -> bytes:
    """An 8-bit RGB picture, rows unfiltered."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """RGB bytes of a picture as ``encode_png`` writes it."""
    at, packed, width = 8, b"", 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("broken picture")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    rows, step = zlib.decompress(packed), 3 * width + 1
    return b"".join(rows[i + 1 : i + step] for i in range(0, len(rows), step))


@F.pandas_udf(ArrayType(StructType().add("r", "integer").add("g", "integer").add("b", "integer")))
def png_pixels(png: pd.Series) -> pd.Series:
    """Pixels of pictures, row by row."""

    def pixels(data: bytes) -> list[dict]:
        rgb = decode_png(data)
        return [{"r": rgb[i], "g": rgb[i + 1], "b": rgb[i + 2]} for i in range(0, len(rgb), 3)]

    return png.map(pixels)
