"""Spatial joins: points in boxes and polygons, box overlap, nearest, within radius."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators import grid
from skyloom.operators.ranking import take_first, top_k
from skyloom.session import cut_lineage

BOX = ["min_lat", "max_lat", "min_lon", "max_lon"]

# The types a view shows by default.
VIEW_TYPES = ["fix", "vor", "ndb"]
NAVAID_TYPES = ["vor", "ndb"]


def _cols(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in BOX}


def valid_box(b) -> Column:
    """Whether a box has its lower bounds below its upper ones; only such a box covers cells."""
    return (b["min_lat"] <= b["max_lat"]) & (b["min_lon"] <= b["max_lon"])


def bbox_join(
    points: DataFrame,
    regions: DataFrame,
    point_id: Sequence[str] = ("ord",),
    on: Sequence[str] = (),
    levels: Sequence[int] | None = None,
) -> DataFrame:
    """Pairs of points and the boxes containing them (inclusive, no wrap).

    ``regions`` carries min_lat, max_lat, min_lon, max_lon; ``on`` adds equality columns shared
    by both sides. A box lands in at most 25 cells of the level that fits its size. Points are
    numbered for the levels in use, which a subquery over the boxes finds unless ``levels``
    names them (worth it when the boxes are costly to compute).
    """
    leveled = regions.withColumn("__level", grid.box_level(_cols()))
    boxes = leveled.withColumn(
        "__cell", F.explode(grid.box_cells(_cols(), F.col("__level")))
    ).drop("__level")
    used = (
        grid.levels_in_use(leveled, "__level")
        if levels is None
        else F.array(*[F.lit(i) for i in levels])
    )
    probes = (
        points.withColumn("__levels", used)
        .withColumn("__level", F.explode("__levels"))
        .withColumn("__cell", grid.box_point_cell(F.col("lat"), F.col("lon"), F.col("__level")))
        .drop("__levels", "__level")
    )
    pairs = grid.salted_join(probes, boxes, ["__cell", *on], list(point_id))
    return pairs.drop("__cell").where(geo.in_bbox(F.col("lat"), F.col("lon"), _cols()))


def aabb_join(
    areas: DataFrame,
    regions: DataFrame,
    area_id: Sequence[str] = ("ord",),
    on: Sequence[str] = (),
) -> DataFrame:
    """Pairs of areas and regions whose boxes overlap; areas carry a ``bbox`` struct.

    A pair meets at the coarser of its two levels, where both boxes span few cells: regions at their own
    level meet areas of that or a finer one, areas at their own level regions of a finer one. So only
    boxes that really are that large meet in large cells. A pair may meet in several cells, and only
    the cell of the overlap's lower corner reports it, so no duplicate removal is needed.
    """
    bbox = F.col("bbox")
    boxes = _leveled_cells(regions, _cols(), own_first=True)
    probes = _leveled_cells(areas, bbox, own_first=False).drop("__lv")
    pairs = grid.salted_join(probes, boxes, ["__cell", "__owner", *on], list(area_id))
    corner = grid.box_point_cell(
        F.greatest(bbox["min_lat"], F.col("min_lat")),
        F.greatest(bbox["min_lon"], F.col("min_lon")),
        F.col("__lv"),
    )
    return pairs.where(geo.bbox_overlaps(bbox, _cols()) & (F.col("__cell") == corner)).drop(
        "__cell", "__lv", "__owner"
    )


def _leveled_cells(df: DataFrame, box, own_first: bool) -> DataFrame:
    """One row per cell of the box: at its own level as the owner of the cell (``__owner`` tells whose
    side that is), and as a guest of the other side's at each coarser level, a region from the next one on."""
    top = len(grid.BOX_LEVELS) - 1
    own = F.col("__own")
    levels = F.sequence(own + 1, F.lit(top)) if own_first else F.sequence(own, F.lit(top))
    guests = F.when(own + int(own_first) <= top, levels).otherwise(F.array().cast("array<int>"))
    stays = F.concat(
        F.array(F.struct(own.alias("lv"), F.lit(own_first).alias("owner"))),
        F.transform(guests, lambda lv: F.struct(lv.alias("lv"), F.lit(not own_first).alias("owner"))),
    )
    return (
        df.withColumn("__own", grid.box_level(box))
        .withColumn("__at", F.explode(stays))
        .withColumn("__lv", F.col("__at.lv"))
        .withColumn("__owner", F.col("__at.owner"))
        .withColumn("__cell", F.explode(grid.box_cells(box, F.col("__lv"))))
        .drop("__own", "__at")
    )


def point_in_polygon_join(
    points: DataFrame, polygons: DataFrame, point_id: Sequence[str] = ("ord",)
) -> DataFrame:
    """Pairs of points and user polygons (``vertices`` of lat/lon structs) containing them."""
    usable = polygons.where(F.size("vertices") >= 3).withColumn(
        "__b", geo.vertices_bbox(F.col("vertices"))
    )
    boxed = usable.select(
        *[c for c in polygons.columns if c not in BOX],
        *[F.col("__b")[c].alias(c) for c in BOX],
    )
    inside = geo.point_in_vertices(F.col("lat"), F.col("lon"), F.col("vertices"))
    return bbox_join(points, boxed, point_id).where(inside)


#: Areas of a cell that are tried first, in source order.
AREA_STEPS = (8, 64)


def point_in_area_join(
    points: DataFrame,
    areas: DataFrame,
    point_id: Sequence[str] = ("point_id",),
    first_only: bool = False,
    respect_holes: bool = False,
) -> DataFrame:
    """Pairs of points and airspace areas (``polys`` + ``bbox`` + ``ord``) containing them.

    Any ring counts, so a hole is inside unless ``respect_holes``; ``first_only`` keeps the
    first area in source order per point. For that a point tries the first areas of each of its cells, and
    only where none holds it the next ones.

    Points are dealt out over all tasks first: a small file of them may meet many areas.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.repartition(tasks, *point_id, "lat", "lon")
    boxed = areas.select("*", *[F.col("bbox")[c].alias(c) for c in BOX]).withColumn(
        "__edges", geo.ring_edges(F.col("polys"))
    )
    inside = geo.point_in_edges(F.col("lat"), F.col("lon"), F.col("__edges"), respect_holes)
    if not first_only:
        return bbox_join(dealt, boxed, point_id).where(inside).drop(*BOX, "__edges")
    leveled = boxed.withColumn("__level", grid.box_level(_cols()))
    cells = cut_lineage(leveled.withColumn("__cell", F.explode(grid.box_cells(_cols(), F.col("__level")))).drop("__level"))
    level, found = F.explode(grid.levels_in_use(leveled, "__level")), []
    rest = dealt.withColumn("__level", level)
    rest = rest.withColumn("__cell", grid.box_point_cell(F.col("lat"), F.col("lon"), F.col("__level"))).drop("__level")
    for step in (*AREA_STEPS, None):
        early = top_k(cells, ["__cell"], ["ord"], step) if step else cells
        pairs = grid.salted_join(rest, early, ["__cell"], list(point_id))
        hits = pairs.where(geo.in_bbox(F.col("lat"), F.col("lon"), _cols())).where(inside).drop(*BOX, "__edges")
        if step:
            at = [*point_id, "lat", "lon", "__cell"]
            hits = cut_lineage(take_first(hits, at, ["ord"]))
            rest = cut_lineage(rest.join(hits.select(*at), at, "left_anti"))
        found.append(hits)
    return take_first(reduce(DataFrame.unionByName, found).drop("__cell"), list(point_id), ["ord"])


def _cell_pairs(
    probes: DataFrame, sites: DataFrame, radius_nm: float, probe_id: Sequence[str]
) -> DataFrame:
    """Probe/site pairs sharing a cell, with columns site_lat, site_lon and distance_nm."""
    size = grid.cell_size_for(radius_nm)
    left = probes.withColumn("__cell", grid.point_cell(F.col("lat"), F.col("lon"), size))
    right = (
        sites.withColumnRenamed("lat", "site_lat")
        .withColumnRenamed("lon", "site_lon")
        .withColumn(
            "__cell",
            F.explode(grid.cap_cells(F.col("site_lat"), F.col("site_lon"), radius_nm, size)),
        )
    )
    pairs = grid.salted_join(left, right, ["__cell"], list(probe_id)).drop("__cell")
    reach = radius_nm * geo.DEG_PER_NM + 1e-6
    close = F.abs(F.col("lat") - F.col("site_lat")) <= reach
    return geo.with_distance(
        pairs.where(close), "lat", "lon", "site_lat", "site_lon", "distance_nm"
    )


def within_radius_join(
    probes: DataFrame, sites: DataFrame, radius_nm: float, probe_id: Sequence[str]
) -> DataFrame:
    """All sites within the radius of each probe; distances wrap at the antimeridian."""
    return _cell_pairs(probes, sites, radius_nm, probe_id).where(
        F.col("distance_nm") <= radius_nm
    )


#: Radii that a nearest-site search begins with, as parts of the whole one.
RING_STEPS = (64, 16, 4)

#: Sites that a probe may measure without asking for rings.
FEW_SITES = 64


def _first_step(probes: DataFrame, sites: DataFrame, max_nm: float) -> int:
    """The largest of RING_STEPS whose cells still hold sites enough that most probes find one, 1 if few are met.

    From the counts of probes and sites in the cells of the whole radius.
    """
    size = grid.cell_size_for(max_nm)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        cell = grid.point_cell(F.col("lat"), F.col("lon"), size)
        return rows.groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias(name))

    met = counted(probes, "p").join(counted(sites, "s"), "__cell")
    around = met.agg((F.sum(F.col("p") * F.col("s")) / F.sum("p")).alias("n")).first()["n"] or 0
    fits = [step for step in RING_STEPS if around >= FEW_SITES and around / (step * step) >= 2]
    return max(fits, default=1)


def nearest_join(
    probes: DataFrame,
    sites: DataFrame,
    probe_id: Sequence[str],
    max_nm: float = 30.0,
    site_cols: Sequence[str] = ("icao",),
    out: str = "nearest",
    step: int | None = None,
) -> DataFrame:
    """Each probe with a struct of its nearest site (first in ``ord`` on a tie) or NULL.

    Of several sites at one position only the first can win, so copies are dropped up front. Where a probe
    would measure many sites, the search begins with a part of the radius (1 / ``step``, by
    default from the sites' density): a site within it is nearer than all beyond, so the probe
    leaves, and only the others go on to a radius four times as long.
    """
    unique = take_first(sites, ["lat", "lon"], ["ord"])

    def best_within(rows: DataFrame, radius: float) -> DataFrame:
        near = within_radius_join(rows, unique, radius, probe_id)
        return near.groupBy(*probe_id).agg(
            F.min_by(
                F.struct(*[F.col(c) for c in site_cols], F.col("distance_nm")),
                F.struct("distance_nm", "ord"),
            ).alias(out)
        )

    step = _first_step(probes, unique, max_nm) if step is None else step
    if step == 1:
        return probes.join(best_within(probes, max_nm), list(probe_id), "left")
    unique = cut_lineage(unique)
    rest, found = probes.select(*probe_id, "lat", "lon"), []
    while step > 1:
        found.append(cut_lineage(best_within(rest, max_nm / step)))
        rest = cut_lineage(rest.join(found[-1], list(probe_id), "left_anti"))
        step = 1 if step < 4 else step // 4
    found.append(best_within(rest, max_nm))
    return probes.join(reduce(DataFrame.unionByName, found), list(probe_id), "left")


def navaids_once(
    pairs: DataFrame, region_id: Sequence[str], order: Sequence[str] = ("ord",)
) -> DataFrame:
    """Keep the first navaid of each name per region; other types and unnamed rows all stay."""
    named = F.col("type").isin(NAVAID_TYPES) & (F.coalesce(F.col("name"), F.lit("")) != "")
    # Rows that are never deduplicated get a key of their own, so they cannot pile up in one
    # group.
    key = F.when(named, F.struct(F.col("name"), F.lit(None).alias("o"))).otherwise(
        F.struct(F.lit(None).alias("name"), F.struct(*order).alias("o"))
    )
    return take_first(pairs.withColumn("__k", key), [*region_id, "__k"], list(order)).drop("__k")


def in_view_fixes(
    regions: DataFrame, fixes: DataFrame, types: Sequence[str] = tuple(VIEW_TYPES)
) -> DataFrame:
    """Fixes shown in each box, with navaids of one name shown once."""
    wanted = fixes.where(F.col("type").isin(list(types)))
    return navaids_once(bbox_join(wanted, regions), ["region_id"])


def in_view_moas(regions: DataFrame, moas: DataFrame) -> DataFrame:
    return aabb_join(moas, regions)


def in_view_fbos(regions: DataFrame, fbos: DataFrame) -> DataFrame:
    return bbox_join(fbos, regions)


def layer_types(show_fixes: bool, show_vfrs: bool) -> list[str]:
    """Types requested for the switched-on layers."""
    types = ["fix", "airport", "vor", "ndb"] if show_fixes else []
    return types + (["vfr"] if show_vfrs else [])


MIN_VIEW_ZOOM = 6


def in_view(
    views: DataFrame,
    fixes: DataFrame,
    moas: DataFrame | None = None,
    fbos: DataFrame | None = None,
    show_fixes: bool = True,
    show_vfrs: bool = False,
) -> DataFrame:
    """Everything visible per view as one list: region_id, layer, ord, ident, name, type, lat, lon.

    Views below zoom 6 (when a ``zoom`` column exists) show nothing; moas and fbos are shown
    when given.
    """
    if "zoom" in views.columns:
        views = views.where(F.col("zoom") >= MIN_VIEW_ZOOM)
    cols = ["region_id", "layer", "ord", "ident", "name", "type", "lat", "lon"]
    parts = []
    types = layer_types(show_fixes, show_vfrs)
    if types:
        parts.append(in_view_fixes(views, fixes, types).withColumn("layer", F.lit("fix")))
    if moas is not None:
        lat, lon = geo.bbox_center(F.col("bbox"))
        parts.append(
            in_view_moas(views, moas)
            .withColumn("layer", F.lit("moa"))
            .withColumn("type", F.lit("moa"))
            .withColumn("ident", F.col("name"))
            .withColumn("lat", lat)
            .withColumn("lon", lon)
        )
    if fbos is not None:
        parts.append(
            in_view_fbos(views, fbos)
            .withColumn("layer", F.lit("fbo"))
            .withColumn("type", F.lit("fbo"))
            .withColumn("ident", F.col("name"))
            .withColumn("name", F.col("icao"))
        )
    out = parts[0].select(*cols)
    for part in parts[1:]:
        out = out.unionByName(part.select(*cols))
    return out
