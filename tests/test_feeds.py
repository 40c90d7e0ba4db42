import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skyloom.operators.airports import airport_names
from skyloom.plans import gazetteer
from skyloom.sources import archives, feeds, store

RECORDS = """\
SUSAEAENRT   VEBIT              N40303000W073451550
SUSAD        LAX           VDHW N33555997W118255506                                          LOS ANGELES
SUSAD        GPM           H    N32450000W097030000                                          GRAND PRAIRIE
SUSAP KLAX  CDIDLY              N34010000W118100000
SUSAP KLAX  DDIDLY5          DIDLY
SUSAP KLAX  EBEREE3          VEBIT
SUSAUR       ABCDE              N34010000W118100000
SUSAEAENRT   RWABC              N40303000W073451550
XUSAEAENRT   OTHER              N40303000W073451550
SUSAEAENRT   NEARB              N00000000W070000000
SUSAEAENRT   NEARB              N00240000W070000000
SUSAEAENRT   NEARB              N00480000W070000000
"""
NAVAIDS = 'h\nabc,Alpha "x",VOR-DME,12.5abc,-7,,,SID:ABC 1D\nbad,Bad,NDB,north,1\nshort,row\n\nxyz,Xray,NDB,1,2,,,SID\n'
WAYPOINTS = 'h\n1,"a, b",vebit,"40 30 30.0 N",073-45-15.5W,SID/STAR\n1,2,none,north,west\n1,2,plain,10 0 0 S,20 0 0 E\n'
VFR = "h\nv1,Bridge,,33.5,-118\n"


@pytest.fixture()
def folder(tmp_path):
    for name, body in (("records.txt", RECORDS), ("navaids.csv", NAVAIDS),
                       ("waypoints.csv", WAYPOINTS), ("VFR.csv", VFR)):
        (tmp_path / name).write_text(body)
    return tmp_path


def build(spark, folder):
    return gazetteer.build_gazetteer(
        feeds.read_lines(spark, str(folder / "records.txt")),
        feeds.read_lines(spark, str(folder / "navaids.csv")),
        feeds.read_lines(spark, str(folder / "waypoints.csv")),
        feeds.read_lines(spark, str(folder / "VFR.csv")),
    )


def test_gazetteer(spark, folder):
    rows = build(spark, folder).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    assert [r.ident for r in rows] == [
        "VEBIT", "LAX", "GPM", "DIDLY", "NEARB", "NEARB", "ABC", "XYZ", "VEBIT", "PLAIN", "V1"
    ]
    by = {(r.ident, r.source): r for r in rows}
    vebit = by["VEBIT", "records"]
    assert (vebit.lat, vebit.lon) == (pytest.approx(40.508333, abs=1e-6), pytest.approx(-73.754306, abs=1e-6))
    assert [(p.proc, p.type, p.airport) for p in vebit.procs] == [("BEREE 3", "STAR", "KLAX")]
    assert (by["LAX", "records"].type, by["LAX", "records"].name) == ("vor", "LOS ANGELES")
    assert by["GPM", "records"].type == "ndb"
    didly = by["DIDLY", "records"]
    assert (didly.type, didly.airport) == ("airport", "KLAX")
    assert [(p.proc, p.type) for p in didly.procs] == [("DIDLY 5", "SID")]
    # Rows 1 and 3 of the three close ones stay.
    assert sorted(r.lat for r in rows if r.ident == "NEARB") == [0.0, pytest.approx(0.8)]
    abc = by["ABC", "navaids"]
    assert (abc.type, abc.lat, abc.lon, abc.name) == ("vor", 12.5, -7.0, 'ALPHA "X"')
    assert [p.proc for p in abc.procs] == ["ABC 1D"]
    assert by["XYZ", "navaids"].procs is None
    assert [(p.proc, p.type) for p in by["VEBIT", "waypoints"].procs] == [("VEBIT", "SID"), ("VEBIT", "STAR")]
    assert by["PLAIN", "waypoints"].lat == -10.0
    assert by["V1", "vfr"].type == "vfr"


def test_order_is_kept_over_many_files_and_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("".join(f"line {i} {n}\n" for n in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = [r.line for r in feeds.read_lines(spark, str(tmp_path)).orderBy("src").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [f"line {i} {n}" for i in range(3) for n in range(500)]


GEOJSON = {
    "features": [
        {"properties": {"NAME": "A MOA"}, "geometry": {"type": "Polygon",
         "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}},
        {"properties": {"NAME": None}, "geometry": {"type": "MultiPolygon",
         "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]], [[[8, 8], [9, 8], [9, 9], [8, 8]]]]}},
    ]
}
FBOS = [{"name": "One", "icao": "KLAX", "lat": 1.5, "lon": 2.5}]


def check_moas(rows):
    assert [r.name for r in rows] == ["A MOA", "MOA"]
    assert tuple(rows[0].bbox) == (0.0, 2.0, 0.0, 2.0)
    assert tuple(rows[1].bbox) == (5.0, 9.0, 5.0, 9.0)
    assert len(rows[1].polys) == 2


def test_json_feeds(spark, tmp_path):
    (tmp_path / "moas.json").write_text(json.dumps(GEOJSON))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in GEOJSON["features"]))
    (tmp_path / "fbos.json").write_text(json.dumps(FBOS))
    check_moas(feeds.read_moas(spark, str(tmp_path / "moas.json")).orderBy("ord").collect())
    check_moas(feeds.read_moas(spark, str(tmp_path / "lines.json"), lines=True).orderBy("ord").collect())
    fbo = feeds.read_fbos(spark, str(tmp_path / "fbos.json")).collect()[0]
    assert (fbo.name, fbo.icao, fbo.lat, fbo.lon) == ("One", "KLAX", 1.5, 2.5)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "records.zip", "w") as z:
        z.writestr("FAACIFP18.pdf", "no")
        z.writestr("FAACIFP18", RECORDS)
        z.writestr("navaids.csv", NAVAIDS.replace("\n", "\r\n"))
    with zipfile.ZipFile(tmp_path / "areas.zip", "w") as z:
        z.writestr("in/moas.json", json.dumps(GEOJSON, indent=1))
        z.writestr("in/fbos.json", json.dumps(FBOS))
    lines = archives.read_member(spark, str(tmp_path / "records.zip"), "records")
    assert [r.line for r in lines.orderBy("src").collect()] == RECORDS.splitlines()
    nav = archives.read_member(spark, str(tmp_path / "records.zip"), "navaids")
    assert feeds.navaids(feeds.without_header(nav)).count() == 2
    items = archives.read_items(spark, str(tmp_path / "areas.zip"), "moas")
    check_moas(feeds.moas_from_items(items).orderBy("ord").collect())
    fbos = feeds.fbos_from_items(archives.read_items(spark, str(tmp_path / "areas.zip"), "fbos"))
    assert [(r.name, r.icao, r.lat) for r in fbos.collect()] == [("One", "KLAX", 1.5)]
    assert archives.read_member(spark, str(tmp_path / "areas.zip"), "vfr").count() == 0


AIRPORTS = """ident,"type",name,latitude_deg,longitude_deg,municipality,iso_country,gps_code,iata_code,local_code
KLAX,large_airport,"Los Angeles, Intl",33.94,-118.4,Los Angeles,us,KLAX,LAX,LAX
1G0,small_airport,Wood County,41.39,-83.63,Bowling Green,US,K1G0,,1G0
XXXX,heliport,Pad,1,2,,US,,LAX,
YYYY,closed,   ,1,2,,US,,,
"""


def test_airports(spark, tmp_path):
    (tmp_path / "airports.csv").write_text(AIRPORTS)
    src = feeds.read_airports(spark, str(tmp_path / "airports.csv"))
    listed, keys = gazetteer.build_airports(src)
    assert sorted((r.icao, r.is_us) for r in listed.collect()) == [("K1G0", True), ("KLAX", True)]
    found = {r.key: r.name for r in keys.collect()}
    assert found["LAX"] == "Los Angeles, Intl"  # first row wins the shared key
    assert found["1G0"] == found["K1G0"] == "Wood County"
    assert set(found) == {"KLAX", "LAX", "1G0", "K1G0", "XXXX"}
    asked = spark.createDataFrame([(" lax ",), ("none",)], "ident string")
    got = {r.ident: r.city for r in airport_names(asked, keys).collect()}
    assert got == {" lax ": "Los Angeles", "none": None}


def test_primary_feed_wins(spark):
    a = spark.createDataFrame([("navaids", "new")], "feed string, line string")
    b = spark.createDataFrame([("navaids", "old"), ("vfr", "old")], "feed string, line string")
    got = sorted(tuple(r) for r in feeds.prefer_primary(a, b).collect())
    assert got == [("navaids", "new"), ("vfr", "old")]


def test_store_version_gate(spark, folder, tmp_path):
    root, calls = str(tmp_path / "store"), []

    def make():
        calls.append(1)
        return {"fixes": build(spark, folder)}

    assert store.refresh(spark, root, 39, make) is True
    assert store.refresh(spark, root, 39, make) is False
    assert store.refresh(spark, root, None, make) is False  # unreachable: keep what is stored
    assert store.refresh(spark, root, 40, make) is True
    assert len(calls) == 2
    assert store.current_manifest(spark, root)["v"] == 40
    assert store.load(spark, root, "fixes").count() == 11
    box = store.load_in_box(spark, root, "fixes", 40, 41, -74, -73)
    assert {r.ident for r in box.collect()} == {"VEBIT"}
    assert store.needs_refresh(None, 3) is False and store.needs_refresh(4, 3) is True


def test_record_lines_shorter_than_their_fields(spark):
    rows = [("S",), ("",), ("SUSAP KL",)]
    df = spark.createDataFrame(rows, "line string").select(
        F.struct(F.lit("f").alias("file"), F.lit(0).cast("bigint").alias("block"),
                 F.monotonically_increasing_id().alias("seq")).alias("src"), "line")
    assert feeds.record_sites(df).count() == 0
    assert feeds.record_procs(df).count() == 0
