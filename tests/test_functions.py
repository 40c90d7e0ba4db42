import math
import random

import plain
import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo, procs, records, text, web
from skyloom.functions.phonetic import (
    consonant_skeleton,
    is_subsequence,
    phonetic_normalize,
    sound_score,
    sound_similarity,
)


def value(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0].v


def table(spark, fn, cases, **kwargs):
    """Evaluate a one-column function over (input, expected) cases."""
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", fn(F.col("s"), **kwargs).alias("v")).collect()}
    return [(c[0], got[i], c[1]) for i, c in enumerate(cases)]


def check(spark, fn, cases, **kwargs):
    for source, got, want in table(spark, fn, cases, **kwargs):
        assert got == (pytest.approx(want) if isinstance(want, float) else want), source


def test_text_helpers(spark):
    nbsp, bom = chr(0xA0), chr(0xFEFF)
    check(spark, text.js_trim, [(f"{nbsp}{bom} a b\t\n", "a b"), ("x", "x"), ("", "")])
    check(
        spark, text.parse_float_prefix,
        [("12.5abc", 12.5), (" -3", -3.0), (".5x", 0.5), ("1.5d", 1.5), ("1e2z", 100.0),
         ("abc", None), ("", None), ("-", None)],
    )
    check(
        spark, text.title_case,
        [("SIGNATURE FLIGHT", "Signature Flight"), ("o'HARE (north)", "O'hare (North)"), ("", "")],
    )
    check(
        spark, text.moa_ident,
        [("Cougar High MOA", "COUGAR HIGH"), ("bagdad moa", "BAGDAD"), ("MOAB", "MOAB")],
    )
    check(spark, text.moa_spoken, [("COUGAR 2  HIGH MOA", "cougar high"), ("A1 MOA", "a")])
    check(
        spark, text.norm_airport_code,
        [("KLAX", "LAX"), ("LAX", "LAX"), (" eddf", "DDF"), ("ZBAA", "ZBAA"), (None, "")],
    )
    assert value(spark, text.js_round(F.lit(-2.5))) == -2
    assert value(spark, text.js_round(F.lit(2.5))) == 3
    assert value(spark, text.round1(F.lit(3.25))) == 3.3
    assert value(spark, text.to_fixed(F.lit(-0.000001), 4)) == "-0.0000"
    assert value(spark, text.to_fixed(F.lit(float("nan")), 5)) == "NaN"
    # Ties of the printed decimal that are none of the stored value, and a true tie.
    for x, digits, key in [(40.123455, 5, "40.12345"), (12.345675, 5, "12.34567"), (33.000015, 5, "33.00001"),
                           (0.015625, 5, "0.01563"), (-0.015625, 5, "-0.01563"), (7.0, 4, "7.0000"), (2.5, 0, "3")]:
        assert value(spark, text.to_fixed(F.lit(x), digits)) == key


def test_to_fixed_is_exact(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(1)
    xs = [round(rng.uniform(-180, 180), 6) for _ in range(20_000)]
    xs += [rng.randrange(-18_000_000, 18_000_000) / 1e5 + 5e-6 for _ in range(20_000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.to_fixed(F.col("x"), 5).alias("k"))
    for r in df.collect():
        exact = Decimal(abs(r.x)).quantize(Decimal("0.00001"), ROUND_HALF_UP)
        assert r.k == ("-" if r.x < 0 else "") + str(exact)


WORDS = ["COLDR", "VEBIT", "PHOENIX", "123", "LAX", "WRIGHT", "KNIGHT", "OO", "AEIOU", "QUICK",
         "BUZZ", "EDGE", "DIDLY", "A", "", "YSNA", "XRAY", "GHOST", "ST LOUIS", "A1B2"]


def test_phonetics_match_plain_statement(spark):
    check(spark, phonetic_normalize, [(w, plain.phonetic(w)) for w in WORDS])
    check(spark, consonant_skeleton, [(w, plain.skeleton(w)) for w in WORDS])
    check(
        spark, lambda c: phonetic_normalize(c, "page"),
        [(w, plain.phonetic(w, collapse=False)) for w in WORDS],
    )
    check(
        spark, lambda c: consonant_skeleton(c, "page"),
        [(w, plain.skeleton(w, collapse=False)) for w in WORDS],
    )


def test_scores_match_plain_statement(spark):
    rng = random.Random(7)
    pairs = [(a, b) for a in WORDS for b in WORDS]
    for _ in range(200):
        pairs.append(tuple("".join(rng.choices("ABCDEIKSX", k=rng.randint(1, 7))) for _ in "ab"))
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", sound_score(F.col("a"), F.col("b")).alias("s"),
        sound_similarity(F.col("a"), F.col("b")).alias("m"),
        is_subsequence(F.col("a"), F.col("b")).alias("q"),
    )
    for r in df.collect():
        assert r.s == plain.score(r.a, r.b), (r.a, r.b)
        assert r.m == plain.similarity(r.a, r.b), (r.a, r.b)
        assert r.q == plain.subsequence(r.a, r.b), (r.a, r.b)


def test_record_fields(spark):
    block = F.lit("N40303000W073451550")
    assert value(spark, records.arinc_lat(block)) == pytest.approx(40.508333, abs=1e-6)
    assert value(spark, records.arinc_lon(block)) == pytest.approx(-73.754306, abs=1e-6)
    check(spark, records.proc_display_name, [("DIDLY5", "DIDLY 5"), ("BEREE", "BEREE"), ("A1B", "A1B")])
    check(
        spark, records.parse_dms,
        [("40 30 30.0 N", 40 + 30 / 60 + 30 / 3600), ("073-45-15.5w", -(73 + 45 / 60 + 15.5 / 3600)),
         ("nothing", None)],
    )
    check(spark, records.navaid_type, [("VOR-DME", "vor"), ("TACAN", "vor"), ("NDB", "ndb")])


def procs_of(spark, source, ident=None):
    rows = value(spark, records.parse_procs(F.lit(source), None if ident is None else F.lit(ident)))
    return None if rows is None else [(r.proc, r.type, r.suffix) for r in rows]


def test_parse_procs(spark):
    full = "SID:VEBIT 1D~DEPARTURE|VEBIT 4E;STAR:FRIBU 1R"
    want = [("VEBIT 1D", "SID", "DEPARTURE"), ("VEBIT 4E", "SID", None), ("FRIBU 1R", "STAR", None)]
    assert procs_of(spark, full) == want
    assert procs_of(spark, full, "VEBIT") == want
    assert procs_of(spark, "SID/STAR", "VEBIT") == [("VEBIT", "SID", None), ("VEBIT", "STAR", None)]
    assert procs_of(spark, "SID/STAR") is None
    assert procs_of(spark, "", "VEBIT") is None
    assert procs_of(spark, "NONE", "VEBIT") == []


def test_procedure_texts(spark):
    check(
        spark, lambda c: procs.proc_readback(c, F.lit("DEPARTURE")),
        [("VEBIT 1D", "VEBIT ONE DELTA DEPARTURE"), ("bersu 2i", "BERSU TWO I DEPARTURE"),
         ("VEBIT", "VEBIT")],
    )
    schema = f"ident string, name string, type string, procs {records.PROC_STRUCT}"
    us = [("DIDLY 5", "SID", "KLAX", None, None), ("OTHER 1", "SID", "KLAX", None, None)]
    one = [("VEBIT", "STAR", "", True, None)]
    two = [("VEBIT 1D", "SID", "", True, None), ("VEBIT 2R", "STAR", "", True, None)]
    df = spark.createDataFrame(
        [("DIDLY", None, "fix", us), ("VEBIT", None, "fix", one), ("VEBIT", "N", "fix", two),
         ("VEBIT", "Vebit", "vor", two), ("Signature FBO", "KLAX", "fbo", None),
         ("BAGDAD", "BAGDAD 1 MOA", "moa", None)],
        schema,
    )
    c = [F.col(n) for n in ("ident", "name", "type", "procs")]
    rows = df.select(
        F.size(procs.root_procs(c[0], c[3])).alias("n"),
        procs.has_variants(c[0], c[3]).alias("v"),
        procs.proc_copy_text(*c).alias("page"),
        procs.proc_copy_text(*c, dialect="popup").alias("popup"),
        procs.display_label(*c).alias("label"),
        procs.copy_value(*c).alias("copy"),
    ).collect()
    assert [r.n for r in rows[:4]] == [1, 1, 2, 2]
    assert [r.v for r in rows] == [False, False, True, True, False, False]
    assert [r.page for r in rows] == ["DIDLY FIVE DEPARTURE", "VEBIT", None, None, None, None]
    assert [r.popup for r in rows] == ["DIDLY FIVE DEPARTURE", "VEBIT", "N", None, None, None]
    assert [r.label for r in rows] == [
        "DIDLY 5", "VEBIT", "VEBIT (N)", "VEBIT (Vebit)", "SIGNATURE FBO", "BAGDAD (BAGDAD 1 MOA)"
    ]
    assert [r.copy for r in rows] == [
        "DIDLY FIVE DEPARTURE", "VEBIT", "N", "VEBIT", "Signature Fbo", "bagdad"
    ]
    check(
        spark, procs.type_label,
        [("vor", "VOR"), ("airport", "APT"), ("fix", "FIX"), ("fbo", "FBO"), ("else", "FIX")],
    )
    check(
        spark, lambda c: procs.is_us(c, F.lit(None).cast("string")),
        [("KLAX", True), ("PANC", True), ("EDDF", False), (None, False)],
    )


SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]


def test_polygons(spark):
    df = spark.createDataFrame(
        [([[SQUARE, HOLE]],)], "polys array<array<array<array<double>>>>"
    )
    p = F.col("polys")
    r = df.select(
        geo.polygon_bbox(p).alias("b"), geo.polygon_centroid(p).alias("c"),
        geo.point_in_polys(F.lit(1.5), F.lit(1.5), p).alias("hole_in"),
        geo.point_in_polys(F.lit(1.5), F.lit(1.5), p, True).alias("hole_out"),
        geo.point_in_polys(F.lit(5.0), F.lit(1.5), p).alias("out"),
    ).collect()[0]
    assert tuple(r.b) == (0.0, 4.0, 0.0, 4.0)
    # Holes add to the weight: (2 * 16 + 1.5 * 1) / 17.
    assert r.c.lat == pytest.approx((2 * 16 + 1.5) / 17)
    assert (r.hole_in, r.hole_out, r.out) == (True, False, False)
    tri = F.expr("array(named_struct('lat', 0D, 'lon', 0D), named_struct('lat', 4D, 'lon', 0D), named_struct('lat', 0D, 'lon', 4D))")
    assert value(spark, geo.point_in_vertices(F.lit(1.0), F.lit(1.0), tri)) is True
    assert value(spark, geo.point_in_vertices(F.lit(3.0), F.lit(3.0), tri)) is False
    assert value(spark, geo.point_in_vertices(F.lit(0.1), F.lit(0.1), F.slice(tri, 1, 2))) is False
    assert value(spark, geo.polygon_centroid(F.expr("array(array(array(array(1D,1D))))"))) is None


def test_distances(spark):
    lit = [F.lit(v) for v in (33.9, -118.4, 37.6, -122.4)]
    assert value(spark, geo.haversine_nm(*lit)) == pytest.approx(
        plain.haversine(33.9, -118.4, 37.6, -122.4)
    )
    for a, b, p in [((0, 0), (0, 2), (1, 1)), ((5, 5), (5, 5), (6, 6)), ((60, 10), (62, 14), (59, 9))]:
        args = [F.lit(float(v)) for v in (*a, *b, *p)]
        assert value(spark, geo.point_segment_nm(*args)) == pytest.approx(plain.segment_distance(a, b, p))
    near = value(spark, geo.point_segment_geodesic_nm(*[F.lit(v) for v in (0.0, 0.0, 0.0, 2.0, 1.0, 1.0)]))
    assert near == pytest.approx(60.04, abs=0.05)
    zero = value(spark, geo.point_segment_geodesic_nm(*[F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]))
    assert zero == pytest.approx(plain.haversine(0, 0, 1, 0))


def test_boxes_and_mercator(spark):
    b = {k: F.lit(v) for k, v in zip(("min_lat", "max_lat", "min_lon", "max_lon"), (10.0, 20.0, 30.0, 50.0))}
    pct = geo.pad_bbox_pct(b)
    assert value(spark, pct["min_lat"]) == pytest.approx(8.5)
    assert value(spark, pct["max_lon"]) == pytest.approx(53.0)
    assert value(spark, geo.pad_bbox_deg(b, 30)["min_lon"]) == pytest.approx(29.5)
    assert value(spark, geo.pad_bbox_nm(b, 30)["max_lon"]) == pytest.approx(
        50 + 0.5 / math.cos(math.radians(15))
    )
    x, y = geo.mercator_px(F.lit(33.0), F.lit(-118.0), 8.0)
    lat, lon = geo.mercator_lonlat(x, y, 8.0)
    assert (value(spark, lat), value(spark, lon)) == (pytest.approx(33.0), pytest.approx(-118.0))
    ring = value(spark, geo.circle_vertices(F.lit(33.0), F.lit(-118.0), F.lit(100.0), 8.0))
    assert len(ring) == 36 and ring[0].lat == pytest.approx(33.0)
    r = value(spark, geo.diameter_circle(F.lit(33.0), F.lit(-119.0), F.lit(33.0), F.lit(-117.0), 8.0)[2])
    assert r == pytest.approx(256 * 2**8 / 360)


def test_page_fields(spark):
    title = "<title>Southwest Airlines Flight 693 (SWA693) - FlightAware</title>"
    check(spark, web.airline_name, [(title, "Southwest Airlines"), ("<title>x</title>", None)])
    head = 'size="+1"><b>Los <i>Angeles</i></b><br>LA,&nbsp; CA</font>'
    cases = {
        head: ("Los Angeles", "LA, CA", True),
        "<h1 class=a>AirNav: KLAX</h1>": ("KLAX", "", True),
        "<p>airport not found</p>": (None, None, False),
        "<p>empty</p>": ("", "", False),
    }
    for html, want in cases.items():
        assert tuple(value(spark, web.airport_page_struct(F.lit(html)))) == want
    stamps = {
        ("20240101", "0130"): "2024-01-01 01:30:00",
        ("20241301", "2570"): "2025-01-02 02:10:00",  # month 13, hour 25, minute 70 roll over
        ("20240230", "0000"): "2024-03-01 00:00:00",
    }
    for (d, t), want in stamps.items():
        got = value(spark, web.utc_from_parts(F.lit(d), F.lit(t)).cast("string"))
        assert got == want
    ts = F.lit("2024-01-01 00:05:00").cast("timestamp")
    base = 1704067200
    assert value(spark, web.route_bucket(ts)) == math.floor((base + 300) / 600 + 0.5)
    assert value(spark, web.leg_bucket(ts)) == (base + 300) // 900
