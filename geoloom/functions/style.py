"""Map-style expressions as columns.

``compile_expression`` turns a style expression (nested JSON lists) into a
column over feature attributes.  Rules of the public style language: a missing
attribute takes a ``match``'s default, a comparison with a missing value is
false, ``interpolate`` is clamped at its ends, and a layer shows for
``minzoom <= zoom < maxzoom``.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_comments(text: str) -> str:
    """JSON text without lines that hold a ``//`` comment alone."""
    return re.sub(r"(?m)^\s*//.*$", "", text)


def load_style(text: str) -> dict:
    return json.loads(strip_comments(text))


class Attributes:
    """How expressions reach a feature: plain columns, or a map column."""

    def __init__(self, columns: dict[str, str] | None = None, map_col: str | None = None, zoom: str | float | None = None, geometry: str = "geom_type"):
        self.columns, self.map_col, self.zoom, self.geometry = columns, map_col, zoom, geometry

    def get(self, name: str) -> Column:
        if self.map_col:
            return F.element_at(F.col(self.map_col), F.lit(name))
        if self.columns is not None and name not in self.columns:
            return F.lit(None).cast("string")
        return F.col(f"`{self.columns[name] if self.columns else name}`")

    def zoom_col(self) -> Column:
        return F.col(self.zoom) if isinstance(self.zoom, str) else F.lit(self.zoom)


def match(value: Column, pairs: list[tuple[Any, Any]], default: Any, attrs: Attributes | None = None) -> Column:
    """``match``: the output of the first label (or list of labels) that is equal."""
    out = None
    for labels, result in pairs:
        hit = value.isin(labels if isinstance(labels, list) else [labels])
        r = compile_expression(result, attrs)
        out = F.when(hit, r) if out is None else out.when(hit, r)
    d = compile_expression(default, attrs)
    return d if out is None else out.otherwise(d)


def interpolate(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between stops, clamped outside."""
    (x0, y0), out = stops[0], None
    out = F.when(x <= x0, F.lit(float(y0)))
    for (a, ya), (b, yb) in zip(stops, stops[1:]):
        out = out.when(x <= b, ya + (x - a) * ((yb - ya) / (b - a)))
    return out.otherwise(F.lit(float(stops[-1][1])))


def compile_expression(e: Any, attrs: Attributes | None = None) -> Column:
    """A column for an expression; a plain value is a literal."""
    attrs = attrs or Attributes()
    if not isinstance(e, list):
        return F.lit(e)
    op, args = e[0], e[1:]
    sub = [None if op in ("match", "get", "has", "interpolate", "literal") else compile_expression(a, attrs) for a in args]
    if op == "get":
        return attrs.get(args[0])
    if op == "has":
        return attrs.get(args[0]).isNotNull()
    if op == "literal":
        return F.lit(args[0])
    if op == "zoom":
        return attrs.zoom_col()
    if op == "geometry-type":
        return F.col(attrs.geometry)
    if op == "image":
        return sub[0]
    if op in ("==", "!="):
        same = sub[0].eqNullSafe(sub[1])
        return same if op == "==" else ~same
    if op in ("<", "<=", ">", ">="):
        a, b = sub
        c = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return F.coalesce(c, F.lit(False))
    if op in ("all", "any"):
        out = F.lit(op == "all")
        for c in sub:
            out = out & c if op == "all" else out | c
        return out
    if op == "!":
        return ~sub[0]
    if op == "coalesce":
        return F.coalesce(*sub)
    if op == "concat":
        return F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c in sub))
    if op == "upcase":
        return F.upper(sub[0])
    if op == "case":
        out = None
        for c, r in zip(sub[0:-1:2], sub[1:-1:2]):
            out = F.when(c, r) if out is None else out.when(c, r)
        return sub[-1] if out is None else out.otherwise(sub[-1])
    if op == "match":
        return match(compile_expression(args[0], attrs), list(zip(args[1:-1:2], args[2:-1:2])), args[-1], attrs)
    if op == "interpolate":
        if args[0] != ["linear"]:
            raise ValueError(f"interpolation {args[0]}")
        return interpolate(compile_expression(args[1], attrs), list(zip(args[2::2], args[3::2])))
    raise ValueError(f"operator {op!r}")


def layer_shows(layer: dict, zoom: Column) -> Column:
    low, high = layer.get("minzoom"), layer.get("maxzoom")
    c = F.lit(True)
    if low is not None:
        c = c & (zoom >= low)
    return c & (zoom < high) if high is not None else c


def layer_features(features: DataFrame, layer: dict, attrs: Attributes) -> DataFrame:
    """Features of a layer's source layer that its zoom range and filter let through."""
    c = layer_shows(layer, attrs.zoom_col())
    if "filter" in layer:
        c = c & compile_expression(layer["filter"], attrs)
    rows = features.where(F.col("layer") == layer["source-layer"]) if "source-layer" in layer and "layer" in features.columns else features
    return rows.where(F.coalesce(c, F.lit(False)))


def label_text(layer: dict, attrs: Attributes) -> Column:
    """A layer's label, in capitals where the layout says so."""
    layout = layer.get("layout", {})
    text = compile_expression(layout["text-field"], attrs)
    return F.upper(text) if layout.get("text-transform") == "uppercase" else text


def view_kinds(style: dict, base: list[str], view: str, key: str = "views") -> list[str]:
    """Base kinds with those of a named view added, each once, in order."""
    extra = [k for v in style.get("metadata", {}).get(key, []) if v.get("id") == view for k in v.get("kinds", [])]
    return list(dict.fromkeys([*base, *extra]))


def kinds_in(e: Any, attribute: str = "kind") -> set[str]:
    """All labels of ``match`` nodes over an attribute, anywhere in an expression."""
    found: set[str] = set()
    if isinstance(e, dict):
        for v in e.values():
            found |= kinds_in(v, attribute)
    elif isinstance(e, list):
        if len(e) > 2 and e[0] == "match" and e[1] == ["get", attribute]:
            for labels in e[2:-1:2]:
                found |= set(labels if isinstance(labels, list) else [labels])
        for v in e:
            found |= kinds_in(v, attribute)
    return found


def style_kinds(spark, style: dict) -> DataFrame:  # noqa: ANN001
    """Layer, source layer and kind of every kind that a layer's filter names."""
    rows = [(x["id"], x.get("source-layer"), k) for x in style["layers"] for k in sorted(kinds_in(x.get("filter", [])))]
    return spark.createDataFrame(rows, "layer string, source_layer string, kind string")


def unknown_sources(spark, style: dict) -> DataFrame:  # noqa: ANN001
    """Layers that name a source the style does not have."""
    layers = spark.createDataFrame([(x["id"], x["source"]) for x in style["layers"] if "source" in x], "layer string, source string")
    sources = spark.createDataFrame([(s,) for s in style.get("sources", {})], "source string")
    return layers.join(sources, "source", "left_anti")
