import math
import random
import struct

import numpy as np
import pytest

from terrazzo.functions import mvt, shapes, wkb
from terrazzo.operators.partitioner import Options, partition_count, partition_points
from terrazzo.plans.serve import styles
from terrazzo.sources.catalog import Dataset, format_size, parse_size
from terrazzo.sources.geojson import crs_hint, is_geojson, is_lines

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0], [1.0, 1.0]]
SAMPLES = [
    ("Point", [1.5, -2.0]), ("Point", []), ("LineString", [[0.0, 0.0], [3.0, 4.0]]), ("Polygon", [SQUARE, HOLE]), ("Polygon", []), ("MultiPoint", [[0.0, 1.0], [2.0, 3.0]]),
    ("MultiLineString", [[[0.0, 0.0], [1.0, 1.0]]]), ("MultiPolygon", [[SQUARE], [[[9.0, 9.0], [10.0, 9.0], [9.0, 10.0], [9.0, 9.0]]]]),
    ("GeometryCollection", [("Point", [1.0, 1.0]), ("GeometryCollection", [("LineString", [[0.0, 0.0], [1.0, 0.0]])])]),
]


@pytest.mark.parametrize("g", SAMPLES)
def test_wkb_and_geojson_round_trip(g):
    assert wkb.decode(wkb.encode(g)) == g
    assert wkb.from_geojson(wkb.to_geojson(g)) == g


def test_wkb_other_byte_order_z_and_truncation():
    assert wkb.decode(struct.pack(">BI2d", 0, 1, 3.0, 4.0)) == ("Point", [3.0, 4.0])
    assert wkb.decode(struct.pack("<BI3d", 1, 1001, 3.0, 4.0, 5.0)) == ("Point", [3.0, 4.0])
    assert wkb.decode(struct.pack("<BI3d", 1, 0x80000001, 3.0, 4.0, 5.0)) == ("Point", [3.0, 4.0])
    for cut in (0, 3, 10, 20):
        with pytest.raises(ValueError):
            wkb.decode(wkb.encode(SAMPLES[3])[:cut])


def test_measures():
    assert wkb.centroid(("Polygon", [SQUARE])) == (2.0, 2.0)
    x, y = wkb.centroid(("Polygon", [SQUARE, HOLE]))
    assert math.isclose(x, (16 * 2 - 1.5) / 15) and math.isclose(y, x)
    assert wkb.centroid(SAMPLES[2]) == (1.5, 2.0) and wkb.centroid(("Point", [])) is None
    assert wkb.bounds(SAMPLES[7]) == (0.0, 0.0, 10.0, 10.0) and wkb.coordinate_count(("Polygon", [SQUARE])) == 0
    assert len(wkb.vertices(("Polygon", [SQUARE, HOLE]))) == 10 and len(list(wkb.exploded(SAMPLES[8]))) == 2


def test_clip_and_simplify():
    box = (1.0, 1.0, 3.0, 3.0)
    assert wkb.bounds(shapes.clip(("Polygon", [SQUARE]), box)) == box
    assert shapes.clip(("Point", [0.0, 0.0]), box) is None
    assert shapes.clip_line([[0, 2], [4, 2], [4, 5], [2, 5], [2, 0]], box) == [[[1.0, 2.0], [3.0, 2.0]], [[2.0, 3.0], [2.0, 1.0]]]
    assert shapes.clip(("Polygon", [[[10, 10], [11, 10], [10, 11], [10, 10]]]), box) is None
    assert shapes.simplify_line([[0, 0], [1, 0.01], [2, 0], [3, 5]], 0.1) == [[0, 0], [2, 0], [3, 5]]
    assert shapes.simplify_ring(SQUARE, 100) == SQUARE


def test_vector_tile_round_trip():
    data = mvt.encode([(("Point", [10, 4000]), {"a": 1, "b": None, "c": "x", "d": 1.5, "e": True, "f": -3}), (("Polygon", [[[0, 0], [100, 0], [100, 100], [0, 100], [0, 0]]]), {"c": "x"}), (("LineString", [[1, 1], [1.2, 1.1]]), {})])
    (layer,) = mvt.decode(data)
    assert (layer["name"], layer["extent"], layer["version"], len(layer["features"])) == ("layer0", 4096, 2, 2)
    point, polygon = layer["features"]
    assert point["paths"] == [[(10, 96)]] and point["properties"] == {"a": 1, "c": "x", "d": 1.5, "e": True, "f": -3}
    ring = polygon["paths"][0]
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) > 0
    assert mvt.encode([]) == b""


def test_partitions_hold_every_point_within_capacity():
    r = np.random.default_rng(3)
    for n, parts in ((1000, 16), (10, 40), (500, 7)):
        p = r.random((n, 2)) * 100
        boxes = partition_points(p, parts)
        held = [(p[:, 0] >= b[1]) & (p[:, 0] <= b[3]) & (p[:, 1] >= b[2]) & (p[:, 1] <= b[4]) for b in boxes]
        assert np.any(held, 0).all() and len(boxes) >= min(parts, n)
    assert len(partition_points(np.zeros((50, 2)), 5)) >= 5  # identical points
    w = partition_points(r.random((200, 2)), 4, r.random(200), Options(to_infinity=True))
    assert min(b[1] for b in w) == -math.inf
    with pytest.raises(ValueError):
        partition_points(np.zeros((0, 2)), 3)
    assert partition_count(0, 10, 4) == 3 and partition_count(5, 10, 4) == 5


def test_sizes_names_and_answers(tmp_path):
    assert parse_size("512mb") == 512 << 20 and parse_size("1.5GB") == int(1.5 * (1 << 30)) and format_size(3 << 20) == "3.0 MB"
    with pytest.raises(ValueError):
        parse_size("many")
    with pytest.raises(FileNotFoundError):
        Dataset(tmp_path / "none")
    assert is_geojson("A.GeoJSON") and not is_geojson("a.parquet")
    assert is_lines('\n{"type":"Feature"}\n') and not is_lines('{"type":"FeatureCollection"')
    assert crs_hint('{"crs":{"type":"name","properties":{"name":"EPSG:3857"}},"features":[') == "EPSG:3857"
    assert styles('Sure:\n```json\n[{"a": [1]}]\n```') == [{"a": [1]}] and styles("no [list") == []


def test_assignment_equals_a_literal_sweep(spark):
    from terrazzo.operators.assign import assign_partitions

    random.seed(5)
    boxes = [(i, *(lambda x, y: (x, y, x + random.uniform(1, 30), y + random.uniform(1, 30)))(random.uniform(0, 80), random.uniform(0, 80))) for i in range(12)]
    points = [(i, random.uniform(-5, 120), random.uniform(-5, 120)) for i in range(300)] + [(300, None, 1.0)]

    def want(x, y):
        ordered = sorted(boxes, key=lambda b: b[1])
        if x is None:
            return min(ordered, key=lambda b: (b[3] - b[1]) * (b[4] - b[2]))[0]
        end = sum(b[1] <= x for b in ordered)
        start = next((i for i in range(end) if ordered[i][3] >= x), end)
        for b in ordered[start:end]:
            if b[1] - 1e-9 <= x <= b[3] + 1e-9 and b[2] - 1e-9 <= y <= b[4] + 1e-9:
                return b[0]
        grown = lambda b: (max(b[3], x) - min(b[1], x)) * (max(b[4], y) - min(b[2], y)) - (b[3] - b[1]) * (b[4] - b[2])
        return min(ordered[start:end] or ordered, key=grown)[0]

    got = {r["i"]: r["partition_id"] for r in assign_partitions(spark.createDataFrame(points, "i int, cx double, cy double"), boxes).collect()}
    assert got == {i: want(x, y) for i, x, y in points}


def test_build_serve_and_stream(spark, tmp_path):
    import json

    from terrazzo.operators.assign import assign_partitions
    from terrazzo.plans import build, serve
    from terrazzo.streaming.landing import start, stream_assigned

    random.seed(1)
    f = [{"type": "Feature", "properties": {"id": i, "n": None if i % 3 else "a,b"}, "geometry": {"type": "Point", "coordinates": [random.uniform(-170, 170), random.uniform(-80, 80)]} if i else None} for i in range(200)]
    (tmp_path / "in.geojsonl").write_text("\n".join(map(json.dumps, f)))
    out = str(tmp_path / "out")
    done, tiles = build.build(spark, str(tmp_path / "in.geojsonl"), out, zoom=3, num_tiles=4, threshold=1)
    assert done.total_rows == 200 and done.num_files >= 4 and tiles.zoom_levels == [0, 1, 2, 3]
    with open(f"{out}/mvt/0/0/0.mvt", "rb") as t:
        assert len(mvt.decode(t.read())[0]["features"]) == 199
    box = serve.Box.parse("-90,-45,90,45")
    inside = sum(1 for x in f if x["geometry"] and -90 <= x["geometry"]["coordinates"][0] <= 90 and -45 <= x["geometry"]["coordinates"][1] <= 45)
    assert serve.features(spark, out, box).count() == inside
    assert len(json.loads("".join(serve.stream(serve.features(spark, out, box), "geojson")))["features"]) == inside
    assert len(list(serve.stream(serve.features(spark, out), "csv"))) == 201
    server = serve.TileServer(spark, out, 1)
    assert server.tile(5, 0, 0) == server.tile(5, 0, 0) and server.tile(0, 0, 0)
    with pytest.raises(ValueError):
        serve.Box.parse("1,2,3")
    points = spark.range(50).selectExpr("id", "cast(id as double) as cx", "cast(id as double) as cy")
    points.write.parquet(str(tmp_path / "landing"))
    boxes = [(0, 0.0, 0.0, 20.0, 20.0), (1, 25.0, 25.0, 60.0, 60.0)]
    start(stream_assigned(spark, str(tmp_path / "landing"), points.schema, boxes), str(tmp_path / "sunk"), str(tmp_path / "log")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "sunk")).count() == 50
    assert assign_partitions(points, boxes).where("partition_id = 1").count() == spark.read.parquet(str(tmp_path / "sunk")).where("partition_id = 1").count()


def _rect(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def test_all_covered_tiles_are_written(spark, tmp_path):
    import json
    import os

    from terrazzo.plans import build

    (tmp_path / "in.geojsonl").write_text(json.dumps({"type": "Feature", "properties": {"a": 1}, "geometry": _rect(-120, -60, 120, 60)}))
    out = str(tmp_path / "out")
    build.tile(spark, str(tmp_path / "in.geojsonl"), out, num_tiles=1)
    made = build.generate_mvt(spark, out, zoom=4)
    at = lambda z: sum(len(f) for _, _, f in os.walk(f"{out}/mvt/{z}"))
    assert at(4) == 96 and made.tile_count == sum(at(z) for z in range(5)) and made.zoom_levels == [0, 1, 2, 3, 4]
    assert build.generate_mvt(spark, out, zoom=2, threshold=1).zoom_levels == [0, 1, 2] and not os.path.exists(f"{out}/mvt/4")
    about = json.loads((tmp_path / "out" / "histograms" / "global.json").read_text())
    assert about["shape"] == [4096, 4096] and about["sum"] == 5 and abs(about["bbox"][0] + 120 * mvt.HALF / 180) < 20_000


def test_tiles_beyond_the_grid_take_their_share_of_a_cell(spark):
    from terrazzo.functions.boxes import Box
    from terrazzo.operators import tiles

    cells = spark.createDataFrame([(2000, 2100, 64), (2000, 2101, 15)], "iy int, ix int, cnt bigint")
    size = 360 / 4096
    x = -180 + 2100 * size
    y = mvt.tile_lonlat(12, 2100, 2000)
    f = spark.createDataFrame([(1, x, y[1], x + 2 * size, y[3])], "id int, xmin double, ymin double, xmax double, ymax double")
    got = tiles.tile_cover_counted(f, Box.named(), range(12, 15), cells, 4).where("z = 14").collect()
    assert {(r["x"] >> 2, r["y"] >> 2) for r in got} >= {(2100, 2000)} and not any(r["x"] >> 2 == 2101 for r in got) and len(got) >= 9
    assert tiles.tile_cover_counted(f, Box.named(), range(12, 15), cells, 4.1).where("z = 14").isEmpty()


def test_a_second_run_replaces_the_first(spark, tmp_path):
    import json

    from terrazzo.plans import build, serve
    from terrazzo.sources.catalog import Dataset, datasets

    random.seed(4)
    f = [{"type": "Feature", "properties": {"id": i}, "geometry": {"type": "Point", "coordinates": [random.uniform(-90, 90), random.uniform(-60, 60)]}} for i in range(300)]
    (tmp_path / "in.geojsonl").write_text("\n".join(map(json.dumps, f)))
    out = "file://" + str(tmp_path / "sets" / "a_set")
    for parts in (3, 7):
        done = build.tile(spark, "file://" + str(tmp_path / "in.geojsonl"), out, num_tiles=parts)
        assert spark.read.parquet(out + "/parquet_tiles").count() == 300 == done.total_rows
        assert serve.attribute_stats(out, ["id"])[0]["stats"]["non_null_count"] == 300
        d = Dataset(out)
        assert d.num_tiles == done.num_files == len(d.manifest) and d.has_stats and d.has_histograms and d.size > 0
    first = d.manifest[0]
    assert d.partition_box(f"tile_{first['partition_id']:06d}") == d.partition_box(first["partition_id"]) == (first["xmin"], first["ymin"], first["xmax"], first["ymax"])
    assert d.partition_box(10**6) is None and d.partition_box("none") is None
    build.generate_mvt(spark, out, zoom=1)
    assert d.zoom_levels == [0, 1] and len(serve.TileServer(spark, out).tile(0, 0, 0)) > 100
    assert serve.features(spark, out).count() == 300
    assert [(r["id"], r["name"]) for r in datasets(spark, "file://" + str(tmp_path / "sets"), "SET").collect()] == [("a_set", "A Set")]


def test_metres_become_degrees_and_other_systems_raise(spark, tmp_path):
    import json

    from terrazzo.plans import build
    from terrazzo.sources.crs import DEGREES, METRES, footer_crs, known

    assert known(None) == known("urn:ogc:def:crs:OGC:1.3:CRS84") == known("epsg:4326") == known({"id": {"authority": "EPSG", "code": 4326}}) == DEGREES
    assert known("urn:ogc:def:crs:EPSG::3857") == known("EPSG:3857") == METRES
    lonlat = np.array([[10.0, 50.0], [-70.5, -33.25]])
    features = [{"type": "Feature", "properties": {"id": i}, "geometry": {"type": "Point", "coordinates": p}} for i, p in enumerate(mvt.to_metres(lonlat).tolist())]
    for crs, right in (("EPSG:3857", True), ("EPSG:25832", False)):
        (tmp_path / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": crs}}, "features": features}))
        if not right:
            with pytest.raises(ValueError):
                build.tile(spark, str(tmp_path / "in.geojson"), str(tmp_path / "out"))
            continue
        build.tile(spark, str(tmp_path / "in.geojson"), str(tmp_path / "out"), num_tiles=1)
        got = spark.read.parquet(str(tmp_path / "out" / "parquet_tiles")).orderBy("id").collect()
        assert np.allclose([wkb.decode(bytes(r["geometry"]))[1] for r in got], lonlat) and np.allclose([r["bbox"]["xmin"] for r in got], lonlat[:, 0])
    assert known(footer_crs(str(tmp_path / "out" / "parquet_tiles"))) == DEGREES


def test_samples_follow_rows_not_places(spark, monkeypatch):
    from terrazzo.operators import sampling
    from terrazzo.plans import build

    df = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 5D, cast(id as double) % 180) as cx", "if(id % 2 = 0, 5D, cast(id as double) % 80) as cy")
    seen = []
    monkeypatch.setattr(build, "partition_points", lambda p, parts, options=None: seen.append(p) or [(0, 0, 0, 1, 1)])
    for seed in range(4):
        build.build_index(df, 4, sample_cap=500, seed=seed)
        assert 0.4 < (seen[-1][:, 0] == 5).mean() < 0.6 and len(seen[-1]) == 500
    for key in (None, "id"):
        a, b = (sampling.bernoulli(df.repartition(n), 0.2, 7, key) for n in (3, 5))
        assert sorted(a.collect()) == sorted(b.collect()) and 600 < a.count() < 1000
    assert sampling.bernoulli(df, 0.2, 8, "id").exceptAll(sampling.bernoulli(df, 0.2, 7, "id")).count() > 0
    a, b = (sampling.reservoir(df.repartition(n), "id", 50, 3) for n in (2, 5))
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 50


def test_functions_from_sql(spark):
    from terrazzo.functions import udfs

    udfs.register(spark)
    row = spark.sql("""SELECT i.geom_type, i.n_points, i.cx, size(v) AS n, t FROM (SELECT tz_geometry_info(g) AS i, tz_vertices(g) AS v, tz_to_geojson(g) AS t
        FROM (SELECT tz_from_geojson('{"type":"LineString","coordinates":[[0,0],[2,2]]}') AS g) a) b""").first()
    assert (row["geom_type"], row["n_points"], row["cx"], row["n"]) == ("LineString", 2, 1.0, 2) and "LineString" in row["t"]
    assert spark.sql("SELECT * FROM tz_tile_cover(1, -10D, -10D, 10D, 10D)").count() == 4


def test_command_line(spark, tmp_path, capsys):
    import json

    from terrazzo.plans import cli

    (tmp_path / "in.geojsonl").write_text("\n".join(json.dumps({"type": "Feature", "properties": {"a": i}, "geometry": {"type": "Point", "coordinates": [i, i]}}) for i in range(9)))
    args = vars(cli.parser().parse_args(["tile", "a", "b", "--num-tiles", "3", "--sort", "none"]))
    assert args["num_tiles"] == 3 and args["sort"] == "none" and args["partition_size"] == "1gb"
    from terrazzo.plans import build

    build.build(spark, str(tmp_path / "in.geojsonl"), str(tmp_path / "out"), zoom=1, num_tiles=2, threshold=0)
    cli.main(["info", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "zoom_levels: [0, 1]" in said and "stats: True" in said
