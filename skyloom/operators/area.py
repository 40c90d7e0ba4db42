"""Area selection: everything inside rectangles, polygons and circles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.functions.phonetic import TextKeys, best_score
from skyloom.functions.procs import has_root_procs
from skyloom.functions.records import PROC_STRUCT
from skyloom.functions.text import js_upper_trim, moa_ident, moa_spoken, name_letters, title_case
from skyloom.operators.ranking import locale_order, take_first, with_place
from skyloom.operators.spatial import (
    BOX,
    aabb_join,
    bbox_join,
    in_view_fixes,
)

AREA_TYPES = ["fix", "airport", "vor", "ndb", "vfr"]
OUT = ["region_id", "branch", "ord", "ident", "name", "type", "lat", "lon", "procs", "copy_text"]


def circle_regions(regions: DataFrame, zoom: float) -> DataFrame:
    """Circles (center_lat, center_lon, radius in pixels at ``zoom``) as 36-cornered polygons."""
    return regions.withColumn(
        "vertices",
        geo.circle_vertices(F.col("center_lat"), F.col("center_lon"), F.col("radius"), zoom),
    )


def _boxed(regions: DataFrame) -> DataFrame:
    """Adds the box of the polygon where there is one; ``vertices`` NULL means a rectangle."""
    b = geo.vertices_bbox(F.col("vertices"))
    usable = regions.where(F.col("vertices").isNull() | (F.size("vertices") >= 3))
    rect = F.col("vertices").isNull()
    return usable.select(
        "region_id",
        "vertices",
        *[F.when(rect, F.col(c)).otherwise(b[c]).alias(c) for c in BOX],
    )


def _inside():
    ray = geo.point_in_vertices(F.col("lat"), F.col("lon"), F.col("vertices"))
    return F.col("vertices").isNull() | ray


def select_area(
    regions: DataFrame,
    fixes: DataFrame,
    moas: DataFrame | None = None,
    fbos: DataFrame | None = None,
) -> DataFrame:
    """Sites per region in list order: airspaces, FBOs, fixes (``branch`` 0, 1, 2).

    The box decides which navaid of a shared name and which airspace of a shared name is the
    one considered; the polygon test comes afterwards, on airspaces by their box centre.
    """
    rectangles = "vertices" not in regions.columns
    boxes = regions.withColumn(
        "vertices", F.lit(None).cast("array<struct<lat:double,lon:double>>")
    ) if rectangles else regions
    boxes = _boxed(boxes)
    no_procs = F.lit(None).cast(PROC_STRUCT)
    procs = F.col("procs") if "procs" in fixes.columns else no_procs

    parts = [
        in_view_fixes(boxes, fixes, AREA_TYPES)
        .where(_inside())
        .withColumn("branch", F.lit(2))
        .withColumn("procs", procs)
        .withColumn("copy_text", F.lit(None).cast("string"))
    ]
    if moas is not None:
        lat, lon = geo.bbox_center(F.col("bbox"))
        once = take_first(aabb_join(moas, boxes), ["region_id", "name"], ["ord"])
        parts.append(
            once.withColumn("lat", lat)
            .withColumn("lon", lon)
            .where(_inside())
            .withColumn("branch", F.lit(0))
            .withColumn("ident", moa_ident(F.col("name")))
            .withColumn("type", F.lit("moa"))
            .withColumn("procs", no_procs)
            .withColumn("copy_text", moa_spoken(F.col("name")))
        )
    if fbos is not None:
        parts.append(
            bbox_join(fbos, boxes)
            .where(_inside())
            .withColumn("branch", F.lit(1))
            .withColumn("ident", F.col("name"))
            .withColumn("name", F.col("icao"))
            .withColumn("type", F.lit("fbo"))
            .withColumn("procs", no_procs)
            .withColumn("copy_text", title_case(F.col("ident")))
        )
    out = parts[0].select(*OUT)
    for part in parts[1:]:
        out = out.unionByName(part.select(*OUT))
    return out


def area_list(selection: DataFrame) -> DataFrame:
    """Place in the region's list without a query: sites with root procedures first, then by ident."""
    rooted = has_root_procs(F.col("ident"), F.col("procs"))
    order = [F.desc("has_procs"), locale_order("ident"), "branch", "ord"]
    return with_place(selection.withColumn("has_procs", rooted), ["region_id"], order)


def area_search(selection: DataFrame, queries: DataFrame, dialect: str = "page") -> DataFrame:
    """Selection filtered by a query per region (region_id, query), all scores above zero."""
    asked = (
        queries.withColumn("q", js_upper_trim(F.coalesce("query", F.lit(""))))
        .where("q <> ''")
        .select("region_id", "q", TextKeys.struct_of(F.col("q"), dialect).alias("qk"))
    )
    texts = selection.withColumn("k1", TextKeys.struct_of(F.col("ident"), dialect)).withColumn(
        "k2", TextKeys.struct_of(name_letters(F.col("name")), dialect)
    )
    score = best_score(["k1", "k2"], F.col("qk"))
    scored = (
        texts.join(asked, "region_id")
        .withColumn("score", score)
        .where(F.col("score") > 0)
        .drop("k1", "k2", "qk")
    )
    return with_place(scored, ["region_id"], [F.desc("score"), "branch", "ord"])


def copy_all(selection: DataFrame) -> DataFrame:
    """All idents of a region joined by commas, in list order: one text per region.

    Copies of an ident are counted before they move, so a region gathers its distinct idents once, as
    long as its text has to be anyway.
    """
    rooted = has_root_procs(F.col("ident"), F.col("procs"))
    counted = selection.groupBy("region_id", (~rooted).alias("plain"), "ident").agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    item = F.struct("plain", locale_order("ident").alias("by"), "ident", "n")
    ordered = F.array_sort(F.collect_list(item))
    idents = F.flatten(F.transform(ordered, lambda s: F.array_repeat(s["ident"], s["n"])))
    return counted.groupBy("region_id").agg(
        F.array_join(idents, ", ").alias("copy_text"), F.sum("n").alias("sites")
    )


def polygon_labels(moas: DataFrame) -> DataFrame:
    """Label position per airspace: its area-weighted centre; airspaces without area have none."""
    placed = moas.withColumn("c", geo.polygon_centroid(F.col("polys")))
    return placed.where(F.col("c").isNotNull()).select(
        "ord", "name", F.col("c")["lat"].alias("lat"), F.col("c")["lon"].alias("lon")
    )
