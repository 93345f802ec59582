"""Operators, sources, stages and streams on small inputs."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from geoloom.functions.binary import _field
from geoloom.operators import address, buildings, gazetteer, route, search, tiles
from geoloom.plans.stages import Runner, Stage
from geoloom.sources import archives, files


def raw(spark, rows):
    return spark.createDataFrame(rows, "ort string, plz string, strasse string, hnr string, lat double, lon double")


@pytest.fixture(scope="module")
def index(spark):
    rows = [("Essen", "45127", f"Weg {i}", "1", 51.0, 7.0) for i in range(30)] + [("Essen", "", "Am Weg", "2a", 51.5, 7.5)] * 3
    rows += [("", "1", "x", "1", 0.0, 0.0), ("Köln", "", "", "7", 50.9, 6.9), ("Neuessen", "4", "Höseler Str.", "3", 51.0, 7.0), ("Neuessen", "3", "Höseler Str.", "3", 51.0, 7.0)]
    r = raw(spark, rows)
    p = address.place_index(r).cache()
    s = address.street_index(r, p).cache()
    return p, s, address.number_index(r, p, s).cache()


def test_index(index):
    p, s, n = index
    assert [(r.id, r.name, r.plz, r.anzahl) for r in p.orderBy("id").collect()] == [(1, "Essen", "45127", 33), (2, "Köln", None, 1), (3, "Neuessen", "3", 2)]
    assert s.count() == 32 and n.count() == 35


def test_search(index):
    p, s, n = index
    assert [r.name for r in search.search_places(p, "essen").collect()] == ["Essen", "Neuessen"]
    assert search.search_places(p, "e").count() == 0
    assert search.search_places(p, "́́").count() == 0
    assert search.search_places(p, "%ss").count() == 0
    for q in ("Höseler Str.", "Hoeseler", "Hoseler"):
        assert [r.name for r in search.search_streets(s, p, q).collect()] == ["Höseler Str."]
    assert search.search_streets(s, p, "weg").count() == 25  # first round is full
    assert search.search_streets(s, p, "am w", 1).count() == 1
    sid = s.where("name = 'Am Weg'").first().id
    assert [r.nummer for r in search.search_numbers(n, sid, "2A").collect()] == ["2a"] * 3


def test_service(index):
    a = search.AddressService(*index)
    assert a.request("/health", {}) == (200, {"orte": 3})
    assert a.request("/orte", {"q": "Koeln"})[1][0]["plz"] == ""
    assert a.request("/nummern", {})[0] == 400 and a.request("/nummern", {"strasse": "x"})[0] == 400
    assert a.request("/weg", {})[0] == 404


def test_gazetteer(spark):
    def line(gid, name, lat, lon, cls, country, pop):
        return "\t".join([gid, name, name, "", str(lat), str(lon), cls, "PPL", country, "", "07", "", "", "", str(pop)])

    world = [line("1", "Wien", 48.2, 16.37, "P", "AT", 5), line("1", "Wien", 48.2, 16.37, "P", "AT", 5), line("2", "Zu", 34, -11, "P", "FR", ""), line("3", "H", 50, 7, "H", "DE", 1), "kurz\tzeile", line("4", "weit", 80, 7, "P", "NO", 1), line("5", "x", "oh", 7, "P", "DE", 1)]
    land = [line("1", "Wien gross", 48.2, 16.37, "P", "DE", 9), line("6", "Nieder", 51, 7, "P", "NL", 3)]
    names = ["1\t1\tde\tBeč\t", "2\t1\tde\tWien\t1", "3\t1\tde\tAlt\t\t\t\t1", "4\t9\tde\tfremd\t1", "5\t1\ten\tVienna\t1"]
    f = lambda xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "value string, ordinal long")
    g = gazetteer.gazetteer(f(world), f(land), f(names))
    rows = g.collect()
    assert [(r.display, r.pop, r.aliases) for r in rows] == [("Wien", 9, ["Wien gross"]), ("Zu", 0, [])]
    # of equal populations the country's file, which is read first, wins, in order too
    tie = [line("1", "Adorf WORLD", 50, 7, "P", "DE", 4), line("2", "Welt", 51, 7, "P", "AT", 4)], [line("3", "Zett", 52, 8, "P", "DE", 4), line("1", "Adorf DE", 50, 7, "P", "DE", 4), line("x", "ohne Zahl", 50, 7, "P", "DE", 4)]
    short = ["1\t3\tde\tvier Spalten", "2\tx\tde\tkeine Zahl\t"]
    assert [r.display for r in gazetteer.gazetteer(f(tie[0]), f(tie[1]), f(short)).collect()] == ["Zett", "Adorf DE", "Welt"]
    assert gazetteer.lookup(g, "WIEN").count() == 1
    import json

    assert json.loads(gazetteer.as_positional_json(g).first().value) == ["Wien", 48.2, 16.37, 9, "DE", "07", ["Wien gross"]]


def test_buildings(spark, tmp_path):
    def surface(tag, nums):
        return f"<g:{tag}><g:Polygon><g:exterior><g:posList>{' '.join(map(str, nums))}</g:posList></g:exterior></g:Polygon></g:{tag}>"

    low = [360000, 5670000, 50, 360008, 5670000, 50, 360008, 5670006, 50, 360000, 5670006, 50]
    high = [v + 4 if i % 3 == 2 else v for i, v in enumerate(low)]
    b = lambda key, inner: f'<b:Building g:id="{key}">{inner}</b:Building>"'
    body = "".join([
        b("a", f"<b:measuredHeight>9</b:measuredHeight><b:measuredHeight>bad</b:measuredHeight>{surface('GroundSurface', low)}"),
        b("b", surface("GroundSurface", low) + surface("RoofSurface", high)),
        b("c", f"<b:measuredHeight>301</b:measuredHeight>{surface('GroundSurface', low)}"),
        b("d", surface("GroundSurface", low[:9])), b("e", f"<b:measuredHeight>0.5</b:measuredHeight>{surface('GroundSurface', low[:-1])}{surface('WallSurface', high)}"),
    ])
    (tmp_path / "gut.gml").write_text(f'<c xmlns:b="urn:b" xmlns:g="urn:g">{body}</c>')
    (tmp_path / "schlecht.gml").write_text("<c><b>")
    found, bad = files.read_buildings(spark, str(tmp_path / "*.gml"))
    rows = {r.id: r for r in buildings.footprints(found).collect()}
    assert {k: r.hoehe for k, r in rows.items()} == {"a": 9.0, "b": 4.0, "e": 0.5}
    assert all(len(r.ring) == 5 and r.ring[0] == r.ring[-1] and 6.9 < r.ring[0].lon < 7.1 and 51 < r.ring[0].lat < 51.3 for r in rows.values())
    assert bad.count() == 1
    f = buildings.footprints(found)
    assert '"hoehe":9.0' in buildings.as_geojson(f.where("id = 'a'")).first().value
    assert buildings.tiles_of(f).where("z = 13").count() >= 3
    ring = f.where("id = 'a'").first().ring
    mid = (sum(p.lon for p in ring[:4]) / 4, sum(p.lat for p in ring[:4]) / 4)
    pts = spark.createDataFrame([(1, *mid), (2, mid[0] + 0.01, mid[1])], "pid long, lon double, lat double")
    assert {(r.pid, r.id) for r in buildings.points_in_rings(pts, f.where("id = 'a'")).collect()} == {(1, "a")}


def series(spark, values, key="r"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "id string, seq int, h double")


def test_elevation_goldens(spark):
    real = [170 - 70 * math.sin(math.pi * i / 349) + 50 * i / 349 + math.sin(i * 2.7) * 0.3 for i in range(350)]
    r = route.ascents(series(spark, real)).first()
    assert abs(r.auf - 96.8) < 5 and abs(r.ab - 46.8) < 5
    rough = sum(max(0.0, b - a) for a, b in zip(real, real[1:]))
    assert rough > 1.1 * r.auf
    for none in ([0.0] * 350, [100.0, 105.0], []):
        assert route.ascents(series(spark, none)).count() == 0
    assert route.ascents(series(spark, [100.0, float("nan"), 120.0, None, 140.0, 160.0])).count() == 1
    long = [100 + 80 * math.sin(i / 200) for i in range(2600)]
    assert 300 < route.thinned(series(spark, long)).count() <= 400
    wave = [200 + 40 * math.sin(i / 16) for i in range(100)]
    assert route.ascents(series(spark, wave * 10)).first().auf / route.ascents(series(spark, wave)).first().auf > 8.5
    span = lambda v: route.scaled(series(spark, v)).agg(F.max("y") - F.min("y")).first()[0]
    assert span([50 + 1.2 * math.sin(i / 10) for i in range(100)]) < 16
    assert span(real) > 30


def test_resample_holds_first_point(spark):
    p = spark.createDataFrame([("r", i, 7.0, 50.0 + i * 0.001) for i in range(4)], "id string, seq int, lon double, lat double")
    rows = route.resample(p, 50.0).orderBy("nr").collect()
    assert rows[0].nr == 0 and (rows[0].lon, rows[0].lat) == (7.0, 50.0)
    assert len(rows) == 1 + int(331.62 // 50)


def _blob(data):
    z = zlib.compress(data)
    body = _field(2, 0, len(data)) + _field(3, 2, z)
    head = _field(1, 2, b"OSMData") + _field(3, 0, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_pbf(spark, tmp_path):
    zig = lambda n: (n << 1) ^ (n >> 63)
    pack = lambda ns: b"".join(_field(0, 0, n)[1:] for n in ns)
    strings = [b"", b"addr:housenumber", b"5", b"addr:street", b"Weg"]
    table = b"".join(_field(1, 2, s) for s in strings)
    dense = _field(1, 2, pack([zig(10), zig(1)])) + _field(8, 2, pack([zig(510000000), zig(100)])) + _field(9, 2, pack([zig(70000000), zig(0)])) + _field(10, 2, pack([1, 2, 0, 0]))
    way = _field(1, 0, 77) + _field(2, 2, pack([1, 3])) + _field(3, 2, pack([2, 4])) + _field(8, 2, pack([zig(11), zig(-1)]))
    data = _field(1, 2, table) + _field(2, 2, _field(2, 2, dense)) + _field(2, 2, _field(3, 2, way))
    (tmp_path / "x.pbf").write_bytes(_blob(data))
    archives.register(spark)
    df = spark.read.format("osmpbf").load(str(tmp_path / "x.pbf")).cache()
    from geoloom.sources.osm import with_numbers

    assert with_numbers(df, "n").count() == 1
    got = address.raw_addresses(df.where("kind = 'n'"), with_numbers(df, "w")).collect()
    assert sorted((r.strasse, r.hnr, round(r.lat, 5), round(r.lon, 5)) for r in got) == [("", "5", 51.0, 7.0), ("Weg", "5", 51.00001, 7.0)]


def test_mbtiles(spark, tmp_path):
    archives.register(spark)
    t = spark.createDataFrame([(3, 4, 1, b"a"), (3, 4, 1, b"b"), (2, 0, 0, b"c")], "z int, x int, y int, tile binary").coalesce(1)
    path = str(tmp_path / "t.mbtiles")
    assert archives.export_mbtiles(t, path, {"name": "n"}) == 3
    back = {(r.z, r.x, r.y): bytes(r.tile) for r in spark.read.format("mbtiles").load(path).collect()}
    assert back == {(3, 4, 1): b"b", (2, 0, 0): b"c"}
    archives.write_tiles(t, str(tmp_path / "p"), {"name": "n"})
    assert spark.read.parquet(str(tmp_path / "p/tiles")).where("zoom_level = 3").first().tile_row == 6
    assert archives.extract(t, (-180.0, -85.0, 180.0, 85.0), 2).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"datasets": [{"files": [{"name": "a_32_300_5600_1.tif", "size": 5}, {"name": "b_32_300_5600_1.tif", "size": "7"}, {"name": "x.txt", "size": 1}]}]}')
    last = tiles.last_of_tile(tiles.catalogue_files(files.read_catalogue(spark, str(tmp_path / "k.json")))).collect()
    assert [(r.x, r.y, r.name, r["size"]) for r in last] == [(300, 5600, "b_32_300_5600_1.tif", 7)]
    (tmp_path / "leer.json").write_text('{"datasets": []}')
    with pytest.raises(ValueError):
        files.read_catalogue(spark, str(tmp_path / "leer.json"))
    (tmp_path / "r.json").write_text('{"trip": {"summary": {"length": 1.5}, "legs": [{"shape": "x", "maneuvers": [], "elevation": [1.0]}]}}')
    assert files.read_routes(spark, str(tmp_path / "r.json")).first().trip.summary.length == 1.5
    rows = spark.createDataFrame([("innen", "a", 3)], "bereich string, name string, groesse bigint")
    files.write_list(rows, str(tmp_path / "l"))
    assert files.read_list(spark, str(tmp_path / "l")).collect() == rows.collect()
    (tmp_path / "lines.txt").write_text("a\tb\n\"c\n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "lines.txt")).orderBy("ordinal").collect()] == ["a\tb", '"c']


def test_stages(spark, tmp_path):
    runner = Runner(spark, f"file://{tmp_path}/s")
    calls = []

    def make(n, fail=False):
        def f(spark_, table):
            calls.append(n)
            if fail:
                raise RuntimeError("no")
            return spark_.range(n)

        return f

    stages = [Stage("a", make(3)), Stage("b", make(1, fail=True)), Stage("c", make(2), needs=("b",)), Stage("d", make(4), needs=("a",)), Stage("e", make(1), least=5)]
    state = runner.run(stages)
    assert [v.split(":")[0] for v in state.values()] == ["done", "failed", "blocked", "done", "failed"]
    assert runner.table("d").count() == 4
    stages[1] = Stage("b", make(1))
    assert list(runner.run(stages[:4]).values()) == ["skipped", "done", "done", "skipped"]
    assert calls.count(3) == 1


def test_index_build(spark, sf, tmp_path):
    from geoloom.plans import index_build, registry

    nodes, ways = (registry._sql(spark, sf, q) for q in (registry.OSM_NODES, registry.OSM_WAYS))
    folder = f"file://{tmp_path}/index"
    assert set(index_build.build(spark, nodes, ways, folder).values()) == {"done"}
    assert set(index_build.build(spark, nodes, ways, folder).values()) == {"skipped"}
    n, raw_n = spark.read.parquet(f"{folder}/numbers").count(), spark.read.parquet(f"{folder}/raw").count()
    assert 0 < n <= raw_n


def test_vector_tiles_and_pngs(spark):
    from geoloom.functions.binary import tile_features
    from geoloom.operators import terrain

    ring = [{"lon": lon, "lat": lat} for lon, lat in ((7.0, 51.0), (7.001, 51.0), (7.001, 51.001), (7.0, 51.0))]
    b = spark.createDataFrame([(str(i), 4.5, ring) for i in range(5)], "id string, hoehe double, ring array<struct<lon:double,lat:double>>")
    rows = buildings.vector_tiles(b, (14, 14), batch=2).collect()
    assert sum(len(list(tile_features(bytes(r.tile)))) for r in rows) == 5 * len({(r.z, r.x, r.y) for r in rows})
    assert all(a == {"hoehe": "4.5"} for r in rows for _, _, a in tile_features(bytes(r.tile)))
    cells = spark.createDataFrame([(0, 0, i % 2, i // 2, None if i == 3 else 10.0 * i) for i in range(4)], "tx long, ty long, ix long, iy long, h double")
    png = bytes(terrain.png_tiles(cells, 2).first().png)
    pix = zlib.decompress(png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8])
    assert pix == bytes([0, 128, 0, 0, 128, 10, 0, 0, 128, 20, 0, 128, 10, 0])  # the gap is the mean, 10 m


def test_stream(spark, tmp_path):
    from geoloom.streaming import trips

    (tmp_path / "in").mkdir()
    rows = [(1, "2024-01-01 00:00:00", 3.0), (1, "2024-01-01 00:00:10", 2.0), (1, "2024-01-01 00:00:20", 2.5), (2, "2024-01-01 00:00:00", 1.0)]
    import json

    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": a, "ts": t, "km": k, "anweisung": "x"}) for a, t, k in rows))
    df = trips.read_readings(spark, str(tmp_path / "in"))
    q = trips.rises(df).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").format("memory").queryName("steigt").start()
    q.awaitTermination()
    assert {(r.id, r.anstiege, r.groesster) for r in spark.table("steigt").collect()} == {(1, 1, 0.5), (2, 0, 0.0)}
    flat = df.select("id", "km")
    trips.drain(flat, str(tmp_path / "out"), str(tmp_path / "c2"))
    trips.drain(flat, str(tmp_path / "out"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert trips.per_window(df).isStreaming
