import random
from datetime import datetime, timedelta, timezone

import plain
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.operators import airports, corridor, scans, tracks

T0 = datetime(2024, 1, 1)
POINT = "aircraft string, ts timestamp, ord long, lat double, lon double, alt double, gs double"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_clean_tracks(spark):
    rows = [
        ("A", at(2), 1, 1.2, 1.0, 600.0, 120.0), ("A", at(1), 2, 1.1, 1.0, 0.0, 15.0),
        ("A", at(3), 3, 1.1, 1.000001, None, None), ("A", None, 4, 1.0, 1.0, None, None),
        ("B", at(1), 5, 5.0, 5.0, None, None), ("C", at(1), 6, 5.0, 5.0, None, None),
    ]
    live = spark.createDataFrame(
        [("A", at(0), 1.1, 1.0, None, None), ("C", at(0), 5.0, 5.0, None, None)],
        "aircraft string, ts timestamp, lat double, lon double, alt double, gs double",
    )
    got = tracks.clean_tracks(spark.createDataFrame(rows, POINT), live).orderBy("aircraft", "idx")
    out = [(r.aircraft, r.idx, r.ord, r.is_live) for r in got.collect()]
    # A: null time first, repeated spot dropped, live last; B has one point only.
    assert out == [("A", 0, 4, False), ("A", 1, 2, False), ("A", 2, 1, False), ("A", 3, None, True),
                   ("C", 0, 6, False), ("C", 1, None, True)]
    ends = {r.aircraft: r for r in tracks.end_points(got).collect()}
    assert (ends["A"].start.lat, ends["A"].last.lat) == (1.2, 1.1)
    assert ends["C"].start.lat == 5.0


def test_scans_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = []
    for key, n in (("hot", 600), ("b", 40), ("c", 1)):
        for i in range(n):
            v = rng.randint(1, 9) if rng.random() < 0.3 else None
            rows.append((key, at(rng.randint(0, 3000)), i, v))
    df = spark.createDataFrame(rows, "k string, ts timestamp, ord long, v int")
    w = Window.partitionBy("k").orderBy("ts", "ord")
    chunk = scans.time_chunk(F.col("ts"))
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = scans.row_index(df, ["k"], ["ts", "ord"], chunk, "i", total="n")
    out = scans.previous_row(out, ["k"], ["ts", "ord"], chunk, ["ord"], "prev")
    out = scans.running_sum(out, ["k"], ["ts", "ord"], chunk, F.coalesce("v", F.lit(0)), "s")
    out = scans.carry(out, ["k"], ["ts", "ord"], chunk, F.col("v"), "before", "after")
    out = scans.next_by_index(out, ["k"], "i", ["ord"], "nxt", 7)
    bad = (
        out.withColumn("wi", F.row_number().over(w) - 1)
        .withColumn("wp", F.lag("ord").over(w))
        .withColumn("wn", F.lead("ord").over(w))
        .withColumn("ws", F.sum(F.coalesce("v", F.lit(0))).over(up))
        .withColumn("wb", F.last("v", True).over(up))
        .withColumn("wa", F.first("v", True).over(down))
        .withColumn("wc", F.count("*").over(Window.partitionBy("k")))
        .where(
            "wi <> i or not (wp <=> prev.ord) or not (wn <=> nxt.ord) or ws <> s "
            "or not (wb <=> before) or not (wa <=> after) or wc <> n"
        )
    )
    assert out.count() == len(rows) and bad.count() == 0


def test_snap_time(spark):
    timed = spark.createDataFrame(
        [("A", at(1), 0, 1.0, 1.0), ("A", at(2), 1, 1.0, 1.02), ("A", at(3), 2, 1.0, 1.02), ("A", None, 3, 1.01, 1.01)],
        "aircraft string, ts timestamp, ord long, lat double, lon double",
    )
    pos = spark.createDataFrame(
        [("A", 0, at(9), 1.0, 1.019), ("A", 1, at(9), 1.0, 1.1), ("B", 2, at(9), 1.0, 1.0)],
        "aircraft string, position_id int, ts timestamp, lat double, lon double",
    )
    got = {r.position_id: r.snapped_ts for r in tracks.snap_time(pos, timed).collect()}
    assert got == {0: at(2), 1: at(9), 2: at(9)}


def test_leg_ids_follow_the_last_trigger(spark):
    rng = random.Random(6)
    rows, lat = [], 0.0
    for i in range(300):
        lat += rng.choice([0, 0, 0.004, 0.006])  # creeps: only the sum crosses the limit
        call = rng.choice(["A", "A", "A", "A", "A", "B", "", None])
        rows.append(("X", at(i), i, call, lat, 1.0))
    got = tracks.leg_ids(
        spark.createDataFrame(rows, "aircraft string, ts timestamp, ord long, callsign string, start_lat double, start_lon double")
    ).orderBy("ord").collect()
    state, leg = None, 0
    for (_, ts, _, call, lat, lon), r in zip(rows, got):
        new = False
        if call:
            bucket = int(ts.replace(tzinfo=timezone.utc).timestamp()) // 900
            if state is None or state[0] != call:
                new = True
            else:
                new = (lat - state[1]) ** 2 > 0.0001 or state[2] != bucket
            if new:
                state, leg = (call, lat, bucket), leg + 1
        assert (r.new_leg, r.leg_id) == (new, leg), r.ord


SITE = "ord int, ident string, name string, type string, lat double, lon double"


def straight(spark, aircraft="A", lat=33.0, n=6):
    rows = [(aircraft, at(i), i, lat, -118.0 + 0.2 * i, 1000.0, 200.0) for i in range(n)]
    return tracks.clean_tracks(spark.createDataFrame(rows, POINT))


def test_corridor_zones(spark):
    nm = 1 / 60.04
    sites = spark.createDataFrame(
        [(0, "ONE", None, "fix", 33 + 0.5 * nm, -117.5), (1, "FOUR", None, "fix", 33 + 4 * nm, -117.5),
         (2, "NINE", None, "fix", 33 - 9 * nm, -117.5), (3, "FOURT", None, "fix", 33 + 14 * nm, -117.5),
         (4, "NINET", None, "fix", 33 + 19 * nm, -117.5), (5, "FAR", None, "fix", 33 + 21 * nm, -117.5),
         (6, "SAME", "NAV", "vor", 33 + 3 * nm, -117.1), (7, "SAME2", "NAV", "vor", 33 + 2 * nm, -117.3),
         (8, "TWICE", None, "fix", 33 + 3 * nm, -117.9), (9, "TWICE", None, "fix", 33 + 2 * nm, -117.2)],
        SITE,
    )
    moas = spark.createDataFrame(
        [(0, "Fox 1 MOA", (32.9, 33.1, -117.7, -117.5))],
        "ord int, name string, bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>",
    )
    zones = corridor.corridor_zones(straight(spark), sites, moas)
    got = {(r.zone, r.ident): (r.ord, r.nearest_seg) for r in zones.collect()}
    assert got == {
        ("crossed", "ONE"): (0, 2), ("5nm", "FOUR"): (1, 2), ("10nm", "NINE"): (2, 2),
        ("15nm", "FOURT"): (3, 2), ("20nm", "NINET"): (4, 2), ("5nm", "SAME"): (6, 4),
        ("5nm", "TWICE"): (9, 3), ("crossed", "FOX 1"): (0, 1),
    }
    summary = {r.zone: (r.sites, r.moas) for r in corridor.zone_summary(zones).collect()}
    assert summary["crossed"] == (2, "FOX 1 MOA") and summary["5nm"] == (3, "")
    order = [r.ident for r in corridor.zone_list(zones).orderBy("place").collect()]
    assert order[:3] == ["ONE", "FOX 1", "SAME"]
    asked = spark.createDataFrame(
        [(0, "A", "twice", None), (1, "A", "twice", "20nm"), (2, "A", "fox", None)],
        "query_id int, aircraft string, query string, zone string",
    )
    found = corridor.search_zones(zones, asked).collect()
    assert [r.ident for r in found if r.query_id == 0 and r.place == 1] == ["TWICE"]
    assert "TWICE" not in [r.ident for r in found if r.query_id == 1]
    assert "FOX 1" not in [r.ident for r in found]


def test_first_of_many_of_a_name_is_the_boxs(spark):
    """Earlier sites of a name far away do not count, however many there are."""
    nm = 1 / 60.04
    rows = []
    for name, far in (("FEW", 3), ("SOME", 40), ("MANY", 600)):
        rows += [(len(rows) + i, f"{name}{i}", name, "ndb", -40.0 + i / 100, 20.0) for i in range(far)]
        rows += [(len(rows) + i, f"{name}-{i}", name, "ndb", 33 + 3 * nm, -117.5 + i / 100) for i in range(3)]
        rows += [(rows[-1][0], f"{name}-AGAIN", name, "ndb", 33 + 4 * nm, -117.3)]  # shares its number
    zones = corridor.corridor_zones(straight(spark), spark.createDataFrame(rows, SITE))
    assert sorted(r.ident for r in zones.collect()) == ["FEW-0", "MANY-0", "SOME-0"]


def test_sites_of_one_place_and_kind_are_listed_by_the_first(spark):
    copies = [(i, "SAME", f"N{i % 3}", "fix", 33.0, -117.5) for i in range(30, 0, -1)]
    copies += [(40, "SAME", "N1", "airport", 33.0, -117.5), (41, "SAME", "N1", "airport", 33.0, -117.1)]
    sites = spark.createDataFrame(copies, SITE)
    assert corridor._first_copies(corridor.corridor_sites(sites)).count() == 3
    got = {(r.type, r.ord, r.nearest_seg, tuple(r.first_seen)) for r in corridor.corridor_zones(straight(spark), sites).collect()}
    assert got == {("fix", 1, 2, (0, 1)), ("airport", 41, 4, (0, 40))}


def test_a_repeated_site_number_is_one_site(spark):
    sites = spark.createDataFrame([(7, 33.01, -117.5), (7, 33.02, -116.9)], "ord int, lat double, lon double")
    (row,) = corridor.nearest_segments(tracks.track_segments(straight(spark, n=9)), sites, 5.0, ["ord"]).collect()
    assert (row.ord, row.nearest_seg) == (7, 2) and row.distance < 1


def test_distances_of_a_corridor_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        segs = spark.sql("select string(id % 3) aircraft, id seg, double(id) a_lat, double(id) a_lon, id + 1d b_lat, id + 1d b_lon from range(9)")
        sites = spark.sql("select double(id) lat, id + 1d lon from range(9)")
        plan = corridor.nearest_segments(segs, sites, site_id=("lat", "lon"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


APT = "ord int, icao string, name string, lat double, lon double, type string, iata string, city string, country string"


def apt(o, icao, lat, lon, name="Some Field", iata=None, city=None):
    return (o, icao, name, lat, lon, "large_airport", iata, city, "US")


def test_origin_destination(spark):
    rows = [("A", at(0), 0, 33.0, -118.0, 0.0, 10.0), ("A", at(1), 1, 33.3, -118.0, 700.0, 100.0),
            ("A", at(2), 2, 40.0, -100.0, 0.0, 0.0), ("B", at(0), 3, 0.0, 0.0, None, None),
            ("B", at(1), 4, 0.0, 179.99, None, None)]
    pts = tracks.clean_tracks(spark.createDataFrame(rows, POINT))
    airports_df = spark.createDataFrame(
        [apt(0, "TAXI", 33.0, -118.0), apt(1, "KLAX", 33.3, -118.01, iata="LAX"),
         apt(2, "ZERO", 0.1, 0.0), apt(3, "WRAP", 0.0, -179.9), apt(4, "WRAP2", 0.0, -179.9)], APT,
    )
    got = {r.aircraft: r for r in airports.origin_destination(pts, airports_df).collect()}
    assert (got["A"].origin.icao, got["A"].origin.iata, got["A"].destination) == ("KLAX", "LAX", None)
    assert (got["B"].origin.icao, got["B"].destination.icao) == ("ZERO", "WRAP")


def test_nearby_airports(spark):
    rows = [("A", at(0), 0, 60.0, 10.0, None, None), ("A", at(1), 1, 60.0, 10.2, None, None)]
    pts = tracks.clean_tracks(spark.createDataFrame(rows, POINT))
    fields = [apt(0, "APRON", 60.0, 10.22, "Dekalb Taylor", "DKB", "Sycamore"),
              apt(1, "NEAR", 60.5, 10.2, "North Base"),
              apt(2, "EAST", 60.0, 13.0, "East Base"), apt(3, "FAR", 63.0, 10.2, "Far Base")]
    df = spark.createDataFrame(fields, APT)
    got = airports.nearby_list(airports.nearby_airports(pts, df, 100)).orderBy("place").collect()
    # The eastern field is 84 NM away but outside the box padded in plain degrees.
    assert [r.icao for r in got] == ["APRON", "NEAR"]
    assert got[0].sort_dist < 0 and got[1].distance == pytest.approx(round(plain.haversine(60, 10.2, 60.5, 10.2), 1))
    exact = airports.nearby_airports(pts, df, 100, exact=True)
    assert {r.icao for r in exact.collect()} == {"APRON", "NEAR", "EAST"}
    asked = spark.createDataFrame(
        [(0, "A", "dkb"), (1, "A", "dekalb"), (2, "A", "syca"), (3, "A", "EAR")],
        "query_id int, aircraft string, query string",
    )
    found = {(r.query_id, r.icao): r.score for r in airports.search_nearby(exact, asked).collect()}
    assert found[0, "APRON"] >= 300 and found[2, "APRON"] >= 160 and found[3, "NEAR"] >= 250
    assert found[1, "APRON"] == plain.score("DEKALB", "DEKALB")
