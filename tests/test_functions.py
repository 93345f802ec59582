"""Golden values and properties of the functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import Row
from pyspark.sql import functions as F

from geoloom.functions import binary, geo, style, text


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_forms(spark):
    names = ["Höseler Str.", "Straße", "Hauptstr", "Am Str Nord", "  Élan ", "strasse"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = df.select("i", text.transcribed_form("n").alias("a"), text.stripped_form("n").alias("b"), F.size(text.search_forms("n")).alias("k")).orderBy("i").collect()
    assert [r.a for r in got] == ["hoeseler strasse", "strasse", "hauptstrasse", "am strasse nord", "elan", "strasse"]
    assert [r.b for r in got] == ["hoseler strasse", "strasse", "hauptstrasse", "am strasse nord", "elan", "strasse"]
    assert [r.k for r in got] == [2, 1, 1, 1, 1, 1]


def test_marks_are_dropped_as_unicode_says(spark):
    import unicodedata

    letters = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]]
    odd = [ch for ch in letters if unicodedata.normalize("NFKD", ch) != ch or unicodedata.combining(ch)]
    words = ["x" + "".join(odd[i : i + 7]) + "y" for i in range(0, len(odd), 7)] + odd[::11] + ["", "abc", "Chișinău", "Đakovo", "Tromsø", "한국어 Straße", "½ ﬁ 𝟙"]
    df = spark.createDataFrame([(w, text.decompose(w)) for w in words], "w string, d string")
    assert len(odd) > 17_000 and df.where(~text.drop_marks("w").eqNullSafe(F.col("d"))).count() == 0


def slow_form(n, transcribe):
    s = n.lower().replace("ß", "ss").replace("str.", "strasse").replace("str ", "strasse ")
    s = s[:-3] + "strasse" if s.endswith("str") else s
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")) if transcribe else ():
        s = s.replace(a, b)
    return text.decompose(s).strip()


def test_forms_of_any_text(spark):
    names = ["Chișinău", "Đakovo", "đ Str", "Tromsø", "Huế\u00a0", "\t Łódź \n", "Hauptstr\n", "Ἀθῆναι", "\u2003한국\x1f", "ﬁn ½ Str.", "İzmir", ""]
    df = spark.createDataFrame([(n, slow_form(n, True), slow_form(n, False)) for n in names], "n string, a string, b string")
    got = df.select("*", text.transcribed_form("n").alias("x"), text.stripped_form("n").alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(r.a, r.b) for r in got]


def test_sort_key_takes_ascii_digits_only(spark):
    df = spark.createDataFrame([("21¹", 21), ("12a", 12), ("a", 0), ("", 0), (None, 0), ("b7-9", 7), ("9" * 30, 0)], "n string, k long")
    assert all(r.got == r.k for r in df.select("k", text.number_sort_key("n").alias("got")).collect())


def test_gazetteer_key_drops_other_scripts(spark):
    r = one(spark, a=text.gazetteer_key(F.lit("Köln Москва é")), b=text.gazetteer_key(F.lit("Chișinău")), c=text.gazetteer_key(F.lit("Đakovo ½")))
    assert r.a == "koeln  e" and r.b == "chisinau" and r.c == "akovo 12"


@pytest.mark.parametrize(
    "name", ["dop10rgbi_32_361_5688_1_nw_2025.jp2", "dgm1_32_361_5688_1_nw_2022.tif", "LoD2_32_361_5688_1_NW.gml", "ndom50_32361_5688_1_nw_2023.tif"]
)
def test_tile_names(spark, name):
    assert one(spark, t=text.tile_of_name(F.lit(name))).t == Row(east=361, north=5688)
    assert one(spark, t=text.tile_of_name(F.lit("nichts.tif"))).t is None


def test_km_text(spark):
    df = spark.createDataFrame([("1,2 km", 1.2), ("800 m", 0.8), ("3.5km", 3.5), ("bald", None)], "t string, k double")
    assert all(r.got == r.k for r in df.select("k", text.kilometres("t").alias("got")).collect())


def test_utm_control_point(spark):
    """Cologne cathedral lies in kilometre tile 356, 5645."""
    e, n = geo.to_utm(6.9583, 50.9413)
    r = one(spark, e=e, n=n)
    assert (int(r.e // 1000), int(r.n // 1000)) == (356, 5645)


@settings(max_examples=15, deadline=None)
@given(lon=s.floats(5.5, 12), lat=s.floats(45, 56))
def test_utm_there_and_back(spark, lon, lat):
    a, b = geo.from_utm(*geo.to_utm(F.lit(lon), F.lit(lat)))
    r = one(spark, a=a, b=b)
    assert abs(r.a - lon) < 1e-6 and abs(r.b - lat) < 1e-6


@settings(max_examples=15, deadline=None)
@given(lon=s.floats(-179, 179), lat=s.floats(-84, 84), z=s.integers(0, 18))
def test_tile_bounds_hold_the_point(spark, lon, lat, z):
    x, y = geo.tile_xy(F.lit(lon), F.lit(lat), F.lit(z))
    w, s_, e, n = geo.tile_bounds(x, y, F.lit(z))
    mx, my = geo.lonlat_to_mercator(F.lit(lon), F.lit(lat))
    r = one(spark, w=w, s=s_, e=e, n=n, x=mx, y=my)
    assert r.w - 1e-6 <= r.x <= r.e + 1e-6 and r.s - 1e-6 <= r.y <= r.n + 1e-6


def test_heights(spark):
    for h, back in [(0.0, 0.0), (255.99, 255.98828125), (256.0, 256.0), (-40000.0, -32768.0), (1e9, 32767.9921875)]:
        r, g, b = geo.encode_height(F.lit(h))
        assert one(spark, v=geo.decode_height(r, g, b)).v == pytest.approx(back, abs=1e-9)


def test_slots(spark):
    from geoloom.operators import tiles

    df = spark.createDataFrame([(1, 10.0), (1, 0.0), (1, 0.0), (1, 0.0), (2, 5.0)], "id int, t double")
    assert [tuple(r) for r in tiles.rate_slots(df, 2.0).select("id", "n", "slot").orderBy("id", "n").collect()] == [(1, 1, 0.0), (1, 2, 0.5), (1, 3, 1.0), (1, 4, 10.0), (2, 1, 5.0)]


def test_rings(spark):
    p = lambda *xs: F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in xs))
    assert len(one(spark, r=geo.close_ring(p((0, 0), (1, 0), (1, 1)))).r) == 4
    assert len(one(spark, r=geo.close_ring(p((0, 0), (1, 0), (0, 0)))).r) == 3
    nums = lambda n: F.array(*(F.lit(float(i)) for i in range(n)))
    assert len(one(spark, t=geo.triples(nums(12))).t) == 4
    assert one(spark, t=geo.triples(nums(9))).t is None
    assert one(spark, t=geo.triples(nums(13))).t is None


@settings(max_examples=30, deadline=None)
@given(s.lists(s.tuples(s.floats(-180, 180), s.floats(-90, 90)), max_size=20))
def test_polyline_round_trip(points):
    got = binary.decode_polyline(binary.encode_polyline(points))
    assert len(got) == len(points)
    assert all(math.isclose(a, c, abs_tol=1e-6) and math.isclose(b, d, abs_tol=1e-6) for (a, b), (c, d) in zip(points, got))


def test_vector_tile_round_trip():
    import gzip

    attrs = {"kind": "park", "min_zoom": -3, "open": True}
    tile = binary.write_tile({"pois": [([(0, 0), (5, 0), (5, 5)], attrs)], "x": [([(0, 0), (1, 0), (1, 1)], {})]})
    assert list(binary.tile_features(tile, "pois")) == [("pois", 3, attrs)]
    assert len(list(binary.tile_features(gzip.compress(tile)))) == 2
    assert list(binary.tile_features(b"")) == []


def test_png():
    import zlib

    data = binary.encode_png(bytes(range(12)), 2, 2)
    assert data.startswith(b"\x89PNG") and zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8]) == b"\0" + bytes(range(6)) + b"\0" + bytes(range(6, 12))


def test_style_rules(spark):
    f = spark.createDataFrame([(None, None, 3.0), ("park", 5, 4.0), ("park", 5, 5.0)], "kind string, min_zoom int, zoom double")
    at = style.Attributes(zoom="zoom")
    e = style.compile_expression(["match", ["get", "kind"], ["park"], False, True], at)
    assert [r.e for r in f.select(e.alias("e")).collect()] == [True, False, False]
    e = style.compile_expression(["<=", ["get", "min_zoom"], ["zoom"]], at)
    assert [r.e for r in f.select(e.alias("e")).collect()] == [False, False, True]
    assert style.load_style('// note\n{"a": 1}\n  // more') == {"a": 1}
    m = {"metadata": {"views": [{"id": "v", "kinds": ["b", "c"]}]}}
    assert style.view_kinds(m, ["a", "b"], "v") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        style.compile_expression(["nope", 1])
