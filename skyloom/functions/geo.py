"""Spherical and planar geometry as Column expressions (degrees in, nautical miles out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sphere radius in nautical miles; nautical miles per degree in box padding.
EARTH_RADIUS_NM = 3440.065
NM_PER_DEGREE = 60.0

# Degrees of arc per nautical mile on that sphere, rounded up a little for safe cell covers.
DEG_PER_NM = math.degrees(1.0 / EARTH_RADIUS_NM) * (1 + 1e-9)

AREA_EPSILON = 1e-10
MIN_SEGMENT_NM = 0.01


def _rad(deg: Column) -> Column:
    return deg * F.lit(math.pi) / F.lit(180.0)


def _haversine_a(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s_lat, s_lon = F.sin(_rad(lat2 - lat1) / 2), F.sin(_rad(lon2 - lon1) / 2)
    return s_lat * s_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * (s_lon * s_lon)


def _arc_nm(a: Column) -> Column:
    return F.lit(EARTH_RADIUS_NM * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return _arc_nm(_haversine_a(lat1, lon1, lat2, lon2))


def _clamp01(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def _segment_t(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> Column:
    d_lat, d_lon = b_lat - a_lat, b_lon - a_lon
    len2 = d_lat * d_lat + d_lon * d_lon
    # A zero-length segment has no projection: t = 0 is its start point.
    return F.coalesce(
        _clamp01(F.try_divide((p_lat - a_lat) * d_lat + (p_lon - a_lon) * d_lon, len2)),
        F.lit(0.0),
    )


def point_segment_nm(
    a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, p_lat: Column, p_lon: Column
) -> Column:
    """Distance of a point to a segment; the foot is found in raw degrees, without cos(lat)."""
    t = _segment_t(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon)
    return haversine_nm(p_lat, p_lon, a_lat + t * (b_lat - a_lat), a_lon + t * (b_lon - a_lon))


def _settle_arc(df: DataFrame, out: str) -> DataFrame:
    # The generator keeps later filters on the distance from being pushed down as a second copy
    # of the whole formula.
    arc = F.struct(_arc_nm(F.col("__hav")).alias(out))
    return df.select("*", F.inline(F.array(arc))).drop("__hav")


def with_distance(
    df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str
) -> DataFrame:
    """Adds the great-circle distance, each part of the formula computed once per row."""
    a = _haversine_a(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2))
    return _settle_arc(df.withColumn("__hav", a), out)


def with_segment_distance(
    df: DataFrame,
    a: tuple[str, str],
    b: tuple[str, str],
    p: tuple[str, str],
    out: str,
    method: str = "planar",
) -> DataFrame:
    """Adds the distance of point ``p`` to segment ``a``-``b`` (pairs of lat/lon columns).

    ``method`` finds the foot in raw degrees (planar) or from side lengths (geodesic).
    """
    foot = {"planar": _segment_t, "geodesic": _geodesic_t}[method]
    (a_lat, a_lon), (b_lat, b_lon), (p_lat, p_lon) = (
        tuple(F.col(c) for c in pair) for pair in (a, b, p)
    )
    t = F.col("__t")
    return _settle_arc(
        df.withColumn("__t", foot(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon))
        .withColumn("__f_lat", a_lat + t * (b_lat - a_lat))
        .withColumn("__f_lon", a_lon + t * (b_lon - a_lon))
        .withColumn("__hav", _haversine_a(p_lat, p_lon, F.col("__f_lat"), F.col("__f_lon")))
        .drop("__t", "__f_lat", "__f_lon"),
        out,
    )


def _geodesic_t(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon) -> Column:
    ap = haversine_nm(a_lat, a_lon, p_lat, p_lon)
    ab = haversine_nm(a_lat, a_lon, b_lat, b_lon)
    bp = haversine_nm(b_lat, b_lon, p_lat, p_lon)
    t = _clamp01(F.try_divide(ap * ap - bp * bp + ab * ab, ab * ab * 2))
    # Very short segments count as their start point.
    return F.when(ab < MIN_SEGMENT_NM, F.lit(0.0)).otherwise(t)


def point_segment_geodesic_nm(
    a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, p_lat: Column, p_lon: Column
) -> Column:
    """Variant: the foot comes from the three great-circle side lengths."""
    t = _geodesic_t(a_lat, a_lon, b_lat, b_lon, p_lat, p_lon)
    return haversine_nm(a_lat + t * (b_lat - a_lat), a_lon + t * (b_lon - a_lon), p_lat, p_lon)


def in_bbox(lat: Column, lon: Column, b) -> Column:
    """Inclusive; never wraps. ``b`` is anything indexable by min_lat/max_lat/min_lon/max_lon."""
    return lat.between(b["min_lat"], b["max_lat"]) & lon.between(b["min_lon"], b["max_lon"])


def bbox_overlaps(a, b) -> Column:
    """Inclusive overlap of two boxes."""
    return (
        (a["max_lat"] >= b["min_lat"])
        & (a["min_lat"] <= b["max_lat"])
        & (a["max_lon"] >= b["min_lon"])
        & (a["min_lon"] <= b["max_lon"])
    )


def bbox_center(b) -> tuple[Column, Column]:
    return (b["min_lat"] + b["max_lat"]) / 2, (b["min_lon"] + b["max_lon"]) / 2


def _pad(b, lat_pad: Column, lon_pad: Column) -> dict[str, Column]:
    return {
        "min_lat": b["min_lat"] - lat_pad,
        "max_lat": b["max_lat"] + lat_pad,
        "min_lon": b["min_lon"] - lon_pad,
        "max_lon": b["max_lon"] + lon_pad,
    }


def pad_bbox_pct(b, share: float = 0.15) -> dict[str, Column]:
    return _pad(
        b, (b["max_lat"] - b["min_lat"]) * share, (b["max_lon"] - b["min_lon"]) * share
    )


def pad_bbox_nm(b, nm: float) -> dict[str, Column]:
    """Longitude padding uses the cosine of the box's middle latitude."""
    mid = (b["min_lat"] + b["max_lat"]) / 2
    lon_pad = F.lit(float(nm)) / (F.lit(NM_PER_DEGREE) * F.cos(mid * F.lit(math.pi / 180)))
    return _pad(b, F.lit(nm / NM_PER_DEGREE), lon_pad)


def pad_bbox_deg(b, nm: float) -> dict[str, Column]:
    """The same number of degrees on both axes."""
    pad = F.lit(nm / NM_PER_DEGREE)
    return _pad(b, pad, pad)


def polygon_bbox(polys: Column) -> Column:
    """STRUCT bbox of polygon -> ring -> [lon, lat] nesting."""
    points = F.flatten(F.flatten(polys))
    lats = F.transform(points, lambda p: p[1])
    lons = F.transform(points, lambda p: p[0])
    return F.struct(
        F.array_min(lats).alias("min_lat"),
        F.array_max(lats).alias("max_lat"),
        F.array_min(lons).alias("min_lon"),
        F.array_max(lons).alias("max_lon"),
    )


def vertices_bbox(vertices: Column) -> Column:
    """STRUCT bbox of ARRAY<STRUCT<lat, lon>>."""
    lats = F.transform(vertices, lambda v: v["lat"])
    lons = F.transform(vertices, lambda v: v["lon"])
    return F.struct(
        F.array_min(lats).alias("min_lat"),
        F.array_max(lats).alias("max_lat"),
        F.array_min(lons).alias("min_lon"),
        F.array_max(lons).alias("max_lon"),
    )


def _rotated(ring: Column) -> Column:
    """The ring with its last vertex first: pairs every vertex with its predecessor."""
    n = F.size(ring)
    return F.concat(F.slice(ring, n, 1), F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))))


def _crosses(x: Column, y: Column, vx: Column, vy: Column, ux: Column, uy: Column) -> Column:
    """Whether a ray in the direction of growing x meets an edge."""
    straddles = (vy > y) != (uy > y)
    # A horizontal edge never straddles, its division is NULL and the AND stays false.
    edge_x = F.try_divide((ux - vx) * (y - vy), uy - vy) + vx
    return F.coalesce(straddles & (x < edge_x), F.lit(False))


def _crossings(x: Column, y: Column, here: Column, before: Column, gx, gy) -> Column:
    """Even-odd rule for a ray in the direction of growing x."""
    edges = F.zip_with(here, before, lambda v, u: _crosses(x, y, gx(v), gy(v), gx(u), gy(u)))
    return F.aggregate(edges, F.lit(False), lambda inside, hit: inside != hit)


def point_in_vertices(lat: Column, lon: Column, vertices: Column) -> Column:
    """Ray cast against ARRAY<STRUCT<lat, lon>>; false for fewer than three vertices."""
    hit = _crossings(
        lat, lon, vertices, _rotated(vertices), lambda v: v["lat"], lambda v: v["lon"]
    )
    return (F.size(vertices) >= 3) & hit


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray cast against one ring of [lon, lat] pairs."""
    return (F.size(ring) > 0) & _crossings(
        lon, lat, ring, _rotated(ring), lambda v: v[0], lambda v: v[1]
    )


def point_in_polys(
    lat: Column, lon: Column, polys: Column, respect_holes: bool = False
) -> Column:
    """Any ring containing the point counts, so a hole counts as inside.

    ``respect_holes`` switches to even-odd counting over the rings of each polygon.
    """
    if not respect_holes:
        return F.exists(polys, lambda poly: F.exists(poly, lambda r: point_in_ring(lat, lon, r)))
    return F.exists(
        polys,
        lambda poly: F.aggregate(
            F.transform(poly, lambda r: point_in_ring(lat, lon, r)),
            F.lit(False),
            lambda inside, hit: inside != hit,
        ),
    )


def ring_edges(polys: Column) -> Column:
    """The edges of each ring of each polygon, made once for many points."""

    def edge(v: Column, u: Column) -> Column:
        return F.struct(v[0].alias("vx"), v[1].alias("vy"), u[0].alias("ux"), u[1].alias("uy"))

    return F.transform(polys, lambda poly: F.transform(poly, lambda r: F.zip_with(r, _rotated(r), edge)))


def point_in_edges(lat: Column, lon: Column, edges: Column, respect_holes: bool = False) -> Column:
    """``point_in_polys`` for the edges of its rings."""

    def in_ring(ring: Column) -> Column:
        odd = F.aggregate(
            ring, F.lit(False),
            lambda inside, e: inside != _crosses(lon, lat, e["vx"], e["vy"], e["ux"], e["uy"]),
        )
        return F.coalesce(odd, F.lit(False))

    if not respect_holes:
        return F.exists(edges, lambda poly: F.exists(poly, in_ring))
    return F.exists(
        edges, lambda poly: F.aggregate(poly, F.lit(False), lambda inside, r: inside != in_ring(r))
    )


def polygon_centroid(polys: Column) -> Column:
    """STRUCT<lat, lon>: ring centroids weighted by absolute area; NULL without any area."""

    def ring_terms(ring: Column) -> Column:
        after = F.concat(
            F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)
        )
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def edge(v: Column, w: Column) -> Column:
            cross = v[0] * w[1] - w[0] * v[1]
            return F.struct(
                cross.alias("a"), ((v[0] + w[0]) * cross).alias("x"),
                ((v[1] + w[1]) * cross).alias("y"),
            )

        sums = F.aggregate(F.zip_with(ring, after, edge), zero, _add3)
        return F.struct((sums["a"] / 2).alias("a"), sums["x"].alias("x"), sums["y"].alias("y"))

    def weighted(t: Column) -> Column:
        area = F.abs(t["a"])
        return F.struct(
            area.alias("a"),
            (F.try_divide(t["x"], t["a"] * 6) * area).alias("x"),
            (F.try_divide(t["y"], t["a"] * 6) * area).alias("y"),
        )

    def _add3(acc: Column, t: Column) -> Column:
        return F.struct(
            (acc["a"] + t["a"]).alias("a"), (acc["x"] + t["x"]).alias("x"),
            (acc["y"] + t["y"]).alias("y"),
        )

    rings = F.filter(
        F.transform(F.flatten(polys), ring_terms), lambda t: F.abs(t["a"]) > AREA_EPSILON
    )
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(F.transform(rings, weighted), zero, _add3)
    return F.when(
        F.size(rings) > 0,
        F.struct(
            F.try_divide(total["y"], total["a"]).alias("lat"),
            F.try_divide(total["x"], total["a"]).alias("lon"),
        ),
    )


TILE_SIZE_PX = 256.0


def mercator_px(lat: Column, lon: Column, zoom: Column | float) -> tuple[Column, Column]:
    """World pixel (x right, y down) of a position at a zoom level, 256-pixel tiles."""
    z = zoom if isinstance(zoom, Column) else F.lit(float(zoom))
    world = F.lit(TILE_SIZE_PX) * F.pow(F.lit(2.0), z)
    x = (lon + 180) / 360 * world
    merc = F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360)))
    y = (F.lit(1.0) - merc / F.lit(math.pi)) / 2 * world
    return x, y


def mercator_lonlat(x: Column, y: Column, zoom: Column | float) -> tuple[Column, Column]:
    """Inverse of ``mercator_px``; returns (lat, lon)."""
    z = zoom if isinstance(zoom, Column) else F.lit(float(zoom))
    world = F.lit(TILE_SIZE_PX) * F.pow(F.lit(2.0), z)
    lon = x / world * 360 - 180
    merc = F.lit(math.pi) * (F.lit(1.0) - y * 2 / world)
    lat = F.atan(F.exp(merc)) * F.lit(360.0 / math.pi) - 90
    return lat, lon


CIRCLE_CORNERS = 36


def circle_vertices(center_lat: Column, center_lon: Column, radius_px: Column, zoom) -> Column:
    """A circle drawn on the Mercator plane as a 36-gon: ARRAY<STRUCT<lat, lon>>."""
    cx, cy = mercator_px(center_lat, center_lon, zoom)

    def corner(i: Column) -> Column:
        angle = i.cast("double") / CIRCLE_CORNERS * F.lit(2 * math.pi)
        lat, lon = mercator_lonlat(
            cx + radius_px * F.cos(angle), cy + radius_px * F.sin(angle), zoom
        )
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_CORNERS - 1)), corner)


def diameter_circle(a_lat, a_lon, b_lat, b_lon, zoom) -> tuple[Column, Column, Column]:
    """Centre (lat, lon) and pixel radius of the circle whose diameter is the segment a-b."""
    ax, ay = mercator_px(a_lat, a_lon, zoom)
    bx, by = mercator_px(b_lat, b_lon, zoom)
    radius = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) / 2
    lat, lon = mercator_lonlat((ax + bx) / 2, (ay + by) / 2, zoom)
    return lat, lon, radius
