import random

import plain
import pytest
from pyspark.sql import functions as F

from skyloom.operators import area, grid, spatial
from skyloom.operators.corridor import nearest_segments


@pytest.fixture()
def always_salt(monkeypatch):
    """Look for hot keys whatever the input size."""
    monkeypatch.setattr(grid, "SALT_CHECK_BYTES", 0)
    monkeypatch.setattr(grid, "HOT_KEYS", 7)
    monkeypatch.setattr(grid, "will_broadcast", lambda df: False)


def world_points(n, seed, spread=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if spread and i % 3:
            lat, lon = rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)
        elif i % 2:
            lat, lon = rng.uniform(59, 61), rng.choice([-1, 1]) * rng.uniform(179, 180)
        else:
            lat, lon = rng.uniform(33, 35), rng.uniform(-119, -117)  # a third of all rows
        out.append((i, lat, lon))
    return out


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def boxes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = rng.uniform(-90, 80), rng.uniform(-180, 170)
        h, w = rng.choice([0.1, 1, 5, 40, 170]), rng.choice([0.1, 1, 5, 60, 350])
        out.append((i, lat, min(lat + h, 90.0), lon, min(lon + w, 180.0)))
    out.append((n, 33.0, 35.0, -119.0, -117.0))
    out.append((n + 1, -90.0, 90.0, -180.0, 180.0))
    return out


BOX_COLS = ["region_id", "min_lat", "max_lat", "min_lon", "max_lon"]


@pytest.mark.parametrize("salted", [False, True])
def test_bbox_join_is_brute_force(spark, salted, request):
    if salted:
        request.getfixturevalue("always_salt")
    pts, regs = world_points(300, 1), boxes(40, 2)
    pts += [(1000, 90.0, 180.0), (1001, -90.0, -180.0), (1002, 33.0, -119.0)]
    got = spatial.bbox_join(frame(spark, pts, ["ord", "lat", "lon"]), frame(spark, regs, BOX_COLS))
    want = sorted(
        (p, r) for p, lat, lon in pts for r, a, b, c, d in regs if a <= lat <= b and c <= lon <= d
    )
    assert sorted((x.ord, x.region_id) for x in got.collect()) == want


@pytest.mark.parametrize("salted", [False, True])
def test_aabb_join_is_brute_force(spark, salted, request):
    if salted:
        request.getfixturevalue("always_salt")
    a, b = boxes(40, 3), boxes(40, 4)
    areas = frame(spark, a, ["ord", *BOX_COLS[1:]]).select(
        "ord", F.struct(*BOX_COLS[1:]).alias("bbox")
    )
    got = spatial.aabb_join(areas, frame(spark, b, BOX_COLS))
    want = sorted(
        (x[0], y[0]) for x in a for y in b
        if x[2] >= y[1] and x[1] <= y[2] and x[4] >= y[3] and x[3] <= y[4]
    )
    assert sorted((x.ord, x.region_id) for x in got.collect()) == want


@pytest.mark.parametrize("radius", [5.0, 30.0, 150.0])
@pytest.mark.parametrize("salted", [False, True])
def test_radius_and_nearest_are_brute_force(spark, radius, salted, request):
    if salted:
        request.getfixturevalue("always_salt")
    probes, sites = world_points(120, 5), world_points(200, 6)
    probes += [(900, 89.95, 10.0), (901, -89.95, -170.0), (902, 60.0, 179.999)]
    sites += [(900, 89.9, -170.0), (901, -89.9, 20.0), (902, 60.0, -179.999)]
    p = frame(spark, probes, ["pid", "lat", "lon"])
    s = frame(spark, sites, ["ord", "lat", "lon"]).withColumn("icao", F.col("ord"))
    d = {(i, j): plain.haversine(a, b, x, y) for i, a, b in probes for j, x, y in sites}
    got = spatial.within_radius_join(p, s, radius, ["pid"])
    want = sorted(k for k, v in d.items() if v <= radius)
    assert sorted((r.pid, r.ord) for r in got.collect()) == want
    assert (902, 902) in want
    for step in (None, 16):
        near = spatial.nearest_join(p, s, ["pid"], radius, step=step)
        for r in near.collect():
            best = min((v, j) for (i, j), v in d.items() if i == r.pid)
            assert (r.nearest.icao if r.nearest else None) == (best[1] if best[0] <= radius else None)


def test_nearest_measures_what_is_near(spark, monkeypatch):
    """3,000 sites within the radius of every probe: a probe measures a few of them."""
    rng = random.Random(2)
    probes = [(i, rng.uniform(40, 40.4), rng.uniform(-100, -99.6)) for i in range(300)]
    sites = [(i, rng.uniform(39.9, 40.5), rng.uniform(-100.1, -99.5)) for i in range(3000)]
    p = frame(spark, probes, ["pid", "lat", "lon"])
    s = frame(spark, sites, ["ord", "lat", "lon"]).withColumn("icao", F.col("ord"))
    measured = []
    pairs = spatial.within_radius_join
    monkeypatch.setattr(spatial, "within_radius_join", lambda *a: measured.append(pairs(*a)) or measured[-1])
    for r in spatial.nearest_join(p, s, ["pid"]).collect():
        best = min((plain.haversine(*probes[r.pid][1:], x, y), j) for j, x, y in sites)
        assert r.nearest.icao == best[1]
    assert len(measured) > 1 and sum(m.count() for m in measured) < 40 * len(probes)


@pytest.mark.parametrize("salted", [False, True])
def test_corridor_distance_is_brute_force(spark, salted, request):
    if salted:
        request.getfixturevalue("always_salt")
    rng = random.Random(8)
    segs = []
    for track in "ab":
        lat, lon = 59.9, -150.0
        for i in range(25):
            nlat, nlon = lat + rng.uniform(-0.6, 0.6), lon + rng.uniform(-0.5, 1.5)
            segs.append((track, i, lat, lon, nlat, nlon))
            lat, lon = nlat, nlon
    segs.append(("long", 0, 10.0, -20.0, 30.0, 25.0))
    segs.append(("wrap", 0, 20.0, 179.9, 20.1, -179.9))
    segs.append(("still", 0, 33.0, -118.0, 33.0, -118.0))
    sites = [(0, i, rng.uniform(58, 62), rng.uniform(-152, -130)) for i in range(150)]
    sites += [(0, 200 + i, rng.uniform(8, 32), rng.uniform(-22, 27)) for i in range(150)]
    sites += [(0, 400 + i, 33 + rng.uniform(-0.5, 0.5), -118 + rng.uniform(-0.5, 0.5)) for i in range(20)]
    sites += [(0, 500, 20.0, -179.95), (0, 501, 20.05, 0.0), (0, 502, 20.0, 179.95)]
    got = nearest_segments(
        frame(spark, segs, ["aircraft", "seg", "a_lat", "a_lon", "b_lat", "b_lon"]),
        frame(spark, sites, ["branch", "ord", "lat", "lon"]),
    )
    want = {}
    for track in {s[0] for s in segs}:
        for _, ord_, lat, lon in sites:
            d = min(
                (round(plain.segment_distance(s[2:4], s[4:6], (lat, lon)), 9), s[1])
                for s in segs if s[0] == track
            )
            if d[0] <= 20:
                want[track, ord_] = d
    rows = {(r.aircraft, r.ord): (r.distance, r.nearest_seg) for r in got.collect()}
    assert rows.keys() == want.keys() and len(want) > 40
    for k, (dist, seg) in rows.items():
        assert dist == pytest.approx(want[k][0], abs=1e-6) and seg == want[k][1]


def ring_hit(lat, lon, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_point_in_area(spark):
    rng = random.Random(9)
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    star = [[6.0 + rng.uniform(-3, 3), 2.0 + rng.uniform(-3, 3)] for _ in range(9)]
    areas = [(1, "S", [[square, hole]]), (0, "T", [[star]])]
    df = spark.createDataFrame(
        areas, "ord int, name string, polys array<array<array<array<double>>>>"
    )
    from skyloom.functions.geo import polygon_bbox

    df = df.withColumn("bbox", polygon_bbox(F.col("polys")))
    pts = [(i, rng.uniform(-1, 6), rng.uniform(-1, 10)) for i in range(300)]
    p = frame(spark, pts, ["point_id", "lat", "lon"])
    want = sorted(
        (i, o) for i, lat, lon in pts for o, _, polys in areas
        if any(ring_hit(lat, lon, r) for poly in polys for r in poly)
    )
    got = spatial.point_in_area_join(p, df)
    assert sorted((r.point_id, r.ord) for r in got.collect()) == want
    first = spatial.point_in_area_join(p, df, first_only=True).collect()
    assert sorted((r.point_id, r.ord) for r in first) == sorted(
        {i: min(o for j, o in want if j == i) for i, _ in want}.items()
    )
    holes = spatial.point_in_area_join(p, df.where("ord = 1"), respect_holes=True)
    assert sorted(r.point_id for r in holes.collect()) == sorted(
        i for i, lat, lon in pts if ring_hit(lat, lon, square) != ring_hit(lat, lon, hole)
    )


def test_first_of_many_areas_and_points_dealt_out(spark, monkeypatch):
    """Most areas of a cell miss the point, and points of one file are tested in many tasks."""
    monkeypatch.setattr(spatial, "AREA_STEPS", (2, 5))
    rng = random.Random(11)
    areas = []
    for o in range(60):
        x, y, w = rng.uniform(0, 6), rng.uniform(0, 6), rng.choice([0.3, 0.4, 3.0])
        areas.append((o // 2, f"A{o}", [[[[x, y], [x + w, y], [x, y + w], [x, y]]]]))
    df = spark.createDataFrame(areas, "ord int, name string, polys array<array<array<array<double>>>>")
    df = df.withColumn("bbox", spatial.geo.polygon_bbox(F.col("polys")))
    pts = [(i // 2, rng.uniform(0, 7), rng.uniform(0, 7)) for i in range(400)]
    p = frame(spark, pts, ["point_id", "lat", "lon"]).coalesce(1)
    want = [(i, o) for i, lat, lon in pts for o, _, polys in areas if ring_hit(lat, lon, polys[0][0])]
    got = spatial.point_in_area_join(p, df)
    assert sorted((r.point_id, r.ord) for r in got.collect()) == sorted(want)
    assert "Exchange hashpartitioning(point_id" in got._jdf.queryExecution().executedPlan().toString()
    first = spatial.point_in_area_join(p, df, first_only=True)
    assert set(first.columns) == set(got.columns)
    assert sorted((r.point_id, r.ord) for r in first.collect()) == sorted(
        {i: min(o for j, o in want if j == i) for i, _ in want}.items()
    )


def test_point_in_polygon(spark):
    rng = random.Random(10)
    shape = [(rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(7)]
    polys = spark.createDataFrame(
        [(0, shape), (1, shape[:2])], "region_id int, vertices array<struct<lat:double,lon:double>>"
    )
    pts = [(i, rng.uniform(-1, 9), rng.uniform(-1, 9)) for i in range(200)]
    got = spatial.point_in_polygon_join(frame(spark, pts, ["ord", "lat", "lon"]), polys)
    ring = [[a, b] for a, b in shape]
    want = [i for i, lat, lon in pts if ring_hit(lon, lat, ring)]
    assert sorted((r.region_id, r.ord) for r in got.collect()) == [(0, i) for i in want]


FIX = "ord int, ident string, name string, type string, lat double, lon double"


def test_view_dedups_navaids_by_first(spark):
    fixes = spark.createDataFrame(
        [(3, "A", "SAME", "vor", 1.0, 1.0), (1, "B", "SAME", "ndb", 2.0, 2.0),
         (2, "C", None, "vor", 1.0, 1.0), (4, "D", None, "vor", 1.0, 1.0),
         (5, "E", "SAME", "fix", 1.0, 1.0), (6, "F", "X", "airport", 1.0, 1.0)],
        FIX,
    )
    regions = frame(spark, [(0, 0.0, 3.0, 0.0, 3.0), (1, 0.0, 1.5, 0.0, 1.5)], BOX_COLS)
    got = sorted((r.region_id, r.ident) for r in spatial.in_view_fixes(regions, fixes).collect())
    assert got == [(0, "B"), (0, "C"), (0, "D"), (0, "E"), (1, "A"), (1, "C"), (1, "D"), (1, "E")]
    low = regions.withColumn("zoom", F.lit(5))
    assert spatial.in_view(low, fixes).count() == 0
    assert spatial.layer_types(True, True) == ["fix", "airport", "vor", "ndb", "vfr"]


def test_area_lists(spark):
    fixes = spark.createDataFrame(
        [(0, "BETA", "N", "fix", 1.0, 1.0), (1, "ALFA", None, "fix", 1.0, 1.0),
         (2, "ROOT", None, "fix", 1.2, 1.2)], FIX,
    ).withColumn(
        "procs",
        F.when(
            F.col("ident") == "ROOT",
            F.expr("array(named_struct('proc','ROOT 1','type','SID','airport','','csvProc',true,'suffix',cast(null as string)))"),
        ),
    )
    moas = spark.createDataFrame(
        [(0, "Zulu 1 MOA", (0.9, 1.1, 0.9, 1.1)), (1, "Zulu 1 MOA", (0.8, 1.2, 0.8, 1.2)),
         (2, "Edge MOA", (1.9, 2.9, 1.9, 2.9))],
        "ord int, name string, bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>",
    )
    fbos = spark.createDataFrame([(0, "FAST AIR", "KLAX", 1.0, 1.1)], "ord int, name string, icao string, lat double, lon double")
    tri = spark.createDataFrame(
        [(7, 0.0, 0.0, 0.0, 0.0, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])],
        "region_id int, min_lat double, max_lat double, min_lon double, max_lon double, vertices array<struct<lat:double,lon:double>>",
    )
    sel = area.select_area(tri, fixes, moas, fbos)
    rows = sorted(area.area_list(sel).collect(), key=lambda r: r.place)
    # The edge airspace overlaps the box but its centre is outside the polygon.
    assert [r.ident for r in rows] == ["ROOT", "ALFA", "BETA", "FAST AIR", "ZULU 1"]
    assert {r.ident: r.copy_text for r in rows}["ZULU 1"] == "zulu"
    assert {r.ident: r.copy_text for r in rows}["FAST AIR"] == "Fast Air"
    text = area.copy_all(sel).collect()
    assert [(r.copy_text, r.sites) for r in text] == [("ROOT, ALFA, BETA, FAST AIR, ZULU 1", 5)]
    few = tri.withColumn("vertices", F.slice("vertices", 1, 2))
    assert area.select_area(few, fixes, moas, fbos).count() == 0
    found = area.area_search(sel, spark.createDataFrame([(7, "alfa")], "region_id int, query string"))
    assert found.collect()[0].ident == "ALFA"


def test_copies_of_a_site_are_measured_once(spark, monkeypatch):
    from skyloom.operators import corridor

    segments = spark.createDataFrame(
        [("a", 0, 30.0, -100.0, 30.5, -99.5), ("a", 1, 30.5, -99.5, 31.0, -99.5), ("b", 0, 30.5, -99.5, 30.0, -100.0)],
        "aircraft string, seg long, a_lat double, a_lon double, b_lat double, b_lon double",
    )
    places = [(30.0, -100.0), (30.02, -99.9), (30.52, -99.48), (30.9, -99.53), (32.0, -99.5)]
    rows = [(i, *places[i % 5]) for i in range(40)] + [(7, *places[0]), (3, *places[3]), (None, *places[1]), (None, *places[2])]
    sites = spark.createDataFrame(rows, "ord long, lat double, lon double")
    expected = corridor.nearest_segments(segments, sites, 5.0, ["ord"], "geodesic").collect()
    met, plainly = [], corridor.nearest_segments
    monkeypatch.setattr(corridor, "nearest_segments", lambda s, spots, *rest: met.append(spots.count()) or plainly(s, spots, *rest))
    found = corridor.nearest_of_sites(segments, sites, 5.0, ["ord"], "geodesic").select("aircraft", "ord", "distance", "nearest_seg")
    assert met == [5]
    assert sorted(map(str, found.collect())) == sorted(map(str, expected)) and len(expected) > 30
