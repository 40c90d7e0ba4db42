import random
from datetime import datetime, timedelta

from skyloom.operators import routes

HIST = '<a href="/live/flight/SWA693/history/20240101/0130Z/KLAX/KSFO">  <a href="/x/history/20240102/0230Z/LAX/SFO">'
LIVE = "<title>Southwest Airlines Flight 693 (SWA693) - FlightAware</title>"


def flights(spark, rows):
    return spark.createDataFrame(
        rows, "flight_id int, callsign string, registration string, as_of timestamp, gps_origin string"
    )


def test_pages_to_route(spark):
    pages = spark.createDataFrame(
        [(1, "SWA693", "history", HIST), (2, "SWA693", "live", LIVE)],
        "page_id int, callsign string, kind string, html string",
    )
    cand = routes.extract_routes(pages)
    assert [(r.orig, r.dest, r.time_str) for r in cand.orderBy("ord").collect()] == [
        ("KLAX", "KSFO", "0130"), ("LAX", "SFO", "0230")
    ]
    asked = flights(spark, [
        (0, " swa693", "", datetime(2024, 1, 2, 2, 0), None),   # exact tie: first wins
        (1, "SWA693", "", datetime(2024, 1, 2, 1, 59), None),   # the past flight is nearer
        (2, "", "swa693", datetime(2024, 1, 2, 2, 31), None),   # registration stands in
        (3, "NONE", "", datetime(2024, 1, 2), None), (4, "", "", datetime(2024, 1, 2), None),
    ])
    got = {r.flight_id: r for r in routes.match_route(asked, cand, routes.airlines(pages)).collect()}
    assert sorted(got) == [0, 1, 2]
    assert (got[0].origin, got[0].time_diff) == ("KLAX", 88_200_000)
    assert got[1].origin == "KLAX" and got[2].origin == "LAX"
    assert got[0].airline == "Southwest Airlines"


def test_asof_is_brute_force(spark):
    rng = random.Random(2)
    t0 = datetime(2024, 1, 1)
    cands = []
    for o in range(400):
        call = "HOT" if o % 3 == 0 else rng.choice("AB")
        cands.append((call, o, t0 + timedelta(hours=rng.randint(0, 200)), rng.choice(["KLAX", "LAX", "KSFO", "ZBAA"]), "X"))
    asked = [(i, rng.choice(["HOT", "A", "B", "C"]), "", t0 + timedelta(hours=rng.randint(-5, 210)),
              rng.choice(["KLAX", "SFO", "EDDF", "", None])) for i in range(120)]
    df = spark.createDataFrame(cands, "callsign string, ord long, ts timestamp, orig string, dest string")
    from pyspark.sql import functions as F

    df = df.withColumn("date_str", F.lit("")).withColumn("time_str", F.lit(""))
    got = {r.flight_id: (r.departure, r.origin, r.time_diff) for r in routes.match_route(flights(spark, asked), df).collect()}

    def norm(c):
        c = (c or "").upper()
        return c[1:] if len(c) == 4 and c[0] in "KCEPYL" else c

    for i, call, _, as_of, origin in asked:
        mine = [c for c in cands if c[0] == call]
        hits = [c for c in mine if norm(origin) and norm(c[3]) == norm(origin)] or mine

        def diff(c):
            ms = int((c[2] - as_of).total_seconds() * 1000)
            return ms + 86_400_000 if ms > 0 else -ms

        best = min(hits, key=lambda c: (diff(c), c[1]), default=None)
        assert got.get(i) == (best and (best[2], best[3], diff(best))), i


def test_resolve_route(spark):
    keys = spark.createDataFrame(
        [("LAX", "KLAX", "LAX", "Los Angeles", "LA", "US"), ("KSFO", "KSFO", "SFO", "San Francisco", None, "US")],
        "key string, icao string, iata string, name string, city string, country string",
    )
    fl = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "flight_id int, aircraft string")
    end = "struct<icao:string,iata:string,country:string,distance_nm:double>"
    found = spark.createDataFrame(
        [("a", ("KSFO", "SFO", "US", 1.0), None), ("b", None, ("KSFO", None, "CA", 1.0)), ("c", None, None)],
        f"aircraft string, origin {end}, destination {end}",
    )
    matched = spark.createDataFrame(
        [(0, "X", "LAX", "ZZZZ", "Air", 5)],
        "flight_id int, callsign string, origin string, destination string, airline string, time_diff long",
    )
    got = {r.flight_id: r for r in routes.resolve_route(fl, found, matched, keys).collect()}
    assert sorted(got) == [0, 1]
    # The matched pair wins as a pair; unknown codes stay as they are.
    assert tuple(got[0].origin) == ("KLAX", "LAX", "Los Angeles", "LA", "US")
    assert tuple(got[0].destination) == ("ZZZZ", None, None, None, None)
    assert got[1].origin is None and got[1].source == "track"
    assert tuple(got[1].destination) == ("KSFO", "SFO", "San Francisco", None, "US")


def test_airport_pages(spark):
    df = spark.createDataFrame([("klax", "<h1>AirNav: LAX</h1>"), ("", "<h1>x</h1>")], "ident string, html string")
    got = {r.ident: (r.name, r.is_found) for r in routes.airport_page_info(df).collect()}
    assert got == {"KLAX": ("LAX", True), "": (None, False)}
