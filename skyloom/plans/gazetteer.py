"""Gazetteer and reference tables from their feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.procs import is_us
from skyloom.functions.records import PROC_STRUCT
from skyloom.operators.airports import airport_keys, airport_list
from skyloom.operators.thinning import proximity_dedup
from skyloom.session import cut_lineage
from skyloom.sources import feeds

FIX = ["src", "ident", "lat", "lon", "type", "name", "airport", "procs", "source"]

# Order in which the feeds are appended.
FEED_ORDER = ["records", "navaids", "waypoints", "vfr"]


def record_fixes(lines: DataFrame) -> DataFrame:
    """Fixed-width records to deduplicated sites with their procedures (matched by ident)."""
    sites = feeds.record_sites(lines)
    kept = proximity_dedup(sites.withColumnRenamed("src", "ord")).withColumnRenamed("ord", "src")
    return kept.join(feeds.record_procs(lines), "ident", "left")


def _shaped(df: DataFrame, source: str) -> DataFrame:
    cols = {
        "name": F.lit(None).cast("string"),
        "airport": F.lit(None).cast("string"),
        "procs": F.lit(None).cast(PROC_STRUCT),
    }
    for c, missing in cols.items():
        if c not in df.columns:
            df = df.withColumn(c, missing)
    return df.withColumn("source", F.lit(source)).select(*FIX)


def union_feeds(
    records: DataFrame | None = None,
    navaids: DataFrame | None = None,
    waypoints: DataFrame | None = None,
    vfr: DataFrame | None = None,
) -> DataFrame:
    """Bag union in feed order; rows of the CSV feeds are not compared with the records."""
    given = {"records": records, "navaids": navaids, "waypoints": waypoints, "vfr": vfr}
    parts = [_shaped(df, name) for name, df in given.items() if df is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_ord(fixes: DataFrame) -> DataFrame:
    """Dense BIGINT ``ord`` over (feed, source position).

    Numbered per source block, with the sizes of earlier blocks and files added, so no single
    task sees all rows.
    """
    feed = F.array_position(F.array(*[F.lit(f) for f in FEED_ORDER]), F.col("source"))
    placed = fixes.withColumn("__feed", feed).withColumn("__file", F.col("src.file")).withColumn(
        "__block", F.floor(F.col("src.seq") / 100_000)
    ).withColumn("__start", F.col("src.block"))
    file, place = ["__feed", "__file"], ["__start", "__block"]
    block = [*file, *place]
    sizes = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.unboundedPreceding
    in_file = Window.partitionBy(*file).orderBy(*place).rowsBetween(earlier, -1)
    # The only scan over everything sees one row per source file.
    files = sizes.groupBy(*file).agg(F.sum("n").alias("n"))
    all_files = Window.orderBy(*file).rowsBetween(earlier, -1)
    starts = files.select(*file, F.coalesce(F.sum("n").over(all_files), F.lit(0)).alias("s"))
    offsets = (
        sizes.withColumn("b", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
        .join(starts, file)
        .select(*block, (F.col("s") + F.col("b")).alias("__before"))
    )
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("src"))
    return (
        placed.withColumn("__rn", rank)
        .join(offsets, block)
        .withColumn("ord", F.col("__before") + F.col("__rn") - 1)
        .drop(*block, "__rn", "__before")
    )


def build_gazetteer(
    record_lines: DataFrame,
    navaid_lines: DataFrame,
    waypoint_lines: DataFrame,
    vfr_lines: DataFrame,
) -> DataFrame:
    """All feeds to one table of sites; the CSV lines still carry their header line."""
    union = union_feeds(
        record_fixes(record_lines),
        feeds.navaids(feeds.without_header(navaid_lines)),
        feeds.waypoints(feeds.without_header(waypoint_lines)),
        feeds.vfr_points(feeds.without_header(vfr_lines)),
    )
    # Numbering reads its input twice (block sizes, then rows), so the union is written first.
    return with_ord(cut_lineage(union)).select(
        "ord", "ident", "lat", "lon", "type", "name", "airport", "procs", "source"
    )


def build_airports(airports_src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(airports, airport_keys) from conformed airport rows."""
    listed = airport_list(airports_src).withColumn(
        "is_us", is_us(F.col("icao"), F.col("country"))
    )
    return listed, airport_keys(airports_src)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of one feed with ``ord`` as a number in file order instead of a place."""
    placed = rows.withColumnRenamed("ord", "src").withColumn("source", F.lit(FEED_ORDER[0]))
    return with_ord(cut_lineage(placed)).drop("src", "source")


def build_moas(moas: DataFrame) -> DataFrame:
    """Airspaces (ord, name, polys, bbox) from a read feed, numbered in file order."""
    return _numbered(moas)


def build_fbos(fbos: DataFrame) -> DataFrame:
    """FBOs (ord, name, icao, lat, lon) from a read feed, numbered in file order."""
    return _numbered(fbos)
