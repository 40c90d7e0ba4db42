"""Navigation feeds as typed tables.

Every reader takes lines (``src``, ``line``) or a path and keeps the source order in ``src``:
a struct of file, block and line position that sorts like the files were read one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import records as R
from skyloom.functions.geo import polygon_bbox
from skyloom.functions.text import js_trim, js_upper_trim, null_if_empty, parse_float_prefix

# Field offsets [start, end) of the fixed-width records, counted from 0.
SECTION, AIRPORT, PROC_KIND = (4, 5), (6, 10), (12, 13)
IDENT, PROC_CODE, PROC_FIX = (13, 18), (13, 19), (29, 34)
NAME, NAME_MIN_LENGTH, AIRPORT_MIN_LENGTH = (93, 123), 93, 10
MIN_COLUMNS = 5


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their source order; files are split over tasks as usual."""
    raw = spark.read.text(path)
    return raw.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("src"),
        F.regexp_replace("value", r"\r$", "").alias("line"),
    )


def without_header(lines: DataFrame) -> DataFrame:
    """Drop the first line of each file and blank lines."""
    first = lines.groupBy(F.col("src.file").alias("f")).agg(F.min("src").alias("first"))
    body = lines.join(
        first, (F.col("src.file") == F.col("f")) & (F.col("src") == F.col("first")), "left_anti"
    )
    return body.where(js_trim(F.col("line")) != "")


def _f(offsets: tuple[int, int]) -> Column:
    return R.field(F.col("line"), *offsets)


def record_procs(lines: DataFrame) -> DataFrame:
    """Procedure index of the fixed-width records: ident -> procs in first-seen order."""
    kind = _f(PROC_KIND)
    rows = (
        lines.where(
            F.startswith("line", F.lit("S"))
            & (_f(SECTION) == "P")
            & kind.isin("D", "E")
            & _f(PROC_CODE).rlike(r"\S\s*\S")
            & _f(PROC_FIX).rlike(R.PADDED_IDENT)
        )
        .select(
            "src",
            F.when(kind == "D", "SID").otherwise("STAR").alias("type"),
            js_trim(_f(AIRPORT)).alias("airport"),
            R.proc_display_name(js_trim(_f(PROC_CODE))).alias("proc"),
            js_trim(_f(PROC_FIX)).alias("ident"),
        )
    )
    # One row per distinct procedure before a site's list is gathered.
    distinct = rows.groupBy("ident", "proc", "type", "airport").agg(F.min("src").alias("src"))
    item = F.struct("src", "proc", "type", "airport")
    return distinct.groupBy("ident").agg(
        F.transform(
            F.array_sort(F.collect_list(item)),
            lambda p: F.struct(
                p["proc"].alias("proc"), p["type"].alias("type"), p["airport"].alias("airport"),
                F.lit(None).cast("boolean").alias("csvProc"),
                F.lit(None).cast("string").alias("suffix"),
            ),
        )
        .cast(R.PROC_STRUCT)
        .alias("procs")
    )


def settled(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters use as values.

    A filter on a plain computed column is pushed below the projection and repeats the whole
    expression for every mention; behind a generator it reads the value.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(row)))


def record_sites(lines: DataFrame) -> DataFrame:
    """Sites of the fixed-width records before deduplication: src, ident, type, lat, lon, ..."""
    line = F.col("line")
    type_ = R.line_type(line)
    ident = _f(IDENT)
    rows = lines.where(
        F.startswith("line", F.lit("S")) & type_.isNotNull() & ident.rlike(R.PADDED_IDENT)
    ).where(~type_.isin("fix", "airport") | ident.rlike(R.FIVE_LETTER_IDENT))
    # The first coordinate block; lines without one drop out.
    blocks = F.slice(F.regexp_extract_all(line, F.lit(R.COORD_PATTERN), F.lit(0)), 1, 1)
    placed = settled(
        rows.select("src", "line", F.explode(blocks).alias("block")),
        lat=R.arinc_lat(F.col("block")),
        lon=R.arinc_lon(F.col("block")),
        icao=js_trim(_f(AIRPORT)),
    ).where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    named = type_.isin("vor", "ndb") & (F.length(line) > NAME_MIN_LENGTH)
    at_airport = (
        (_f(SECTION) == "P")
        & (F.length(line) >= AIRPORT_MIN_LENGTH)
        & F.col("icao").rlike(R.AIRPORT_PATTERN)
    )
    return placed.select(
        "src", js_trim(ident).alias("ident"), "lat", "lon", type_.alias("type"),
        F.when(named, js_trim(_f(NAME))).alias("name"),
        F.when(at_airport, F.col("icao")).alias("airport"),
    )


def _col(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i + 1))


def _placed(rows: DataFrame, lat: Column, lon: Column) -> DataFrame:
    return settled(rows, lat=lat, lon=lon).where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )


def navaids(lines: DataFrame) -> DataFrame:
    """Positional, commas always split: ident, name, type, lat, lon, -, -, procs."""
    parts = F.col("parts")
    rows = lines.withColumn("parts", R.split_plain(F.col("line"))).where(
        F.size("parts") >= MIN_COLUMNS
    )
    return _placed(
        rows, parse_float_prefix(_col(parts, 3)), parse_float_prefix(_col(parts, 4))
    ).select(
        "src",
        js_upper_trim(_col(parts, 0)).alias("ident"),
        "lat",
        "lon",
        R.navaid_type(js_upper_trim(_col(parts, 2))).alias("type"),
        js_upper_trim(_col(parts, 1)).alias("name"),
        R.parse_procs(_col(parts, 7)).alias("procs"),
    )


def _unquoted(c: Column) -> Column:
    return js_trim(F.replace(c, F.lit('"'), F.lit("")))


def waypoints(lines: DataFrame) -> DataFrame:
    """Positional, quoted commas kept: -, -, ident, lat text, lon text, procs."""
    parts = F.col("parts")
    rows = lines.withColumn("parts", R.split_quoted(F.col("line"))).where(
        F.size("parts") >= MIN_COLUMNS
    )
    ident = F.upper(_unquoted(_col(parts, 2)))
    return _placed(
        rows,
        R.parse_dms(_unquoted(_col(parts, 3))),
        R.parse_dms(_unquoted(_col(parts, 4))),
    ).select(
        "src",
        ident.alias("ident"),
        "lat",
        "lon",
        F.lit("fix").alias("type"),
        R.parse_procs(_col(parts, 5), ident).alias("procs"),
    )


def vfr_points(lines: DataFrame) -> DataFrame:
    """Positional: ident, name, -, lat, lon."""
    parts = F.col("parts")
    rows = lines.withColumn("parts", R.split_plain(F.col("line"))).where(
        F.size("parts") >= MIN_COLUMNS
    )
    return _placed(
        rows, parse_float_prefix(_col(parts, 3)), parse_float_prefix(_col(parts, 4))
    ).select(
        "src",
        js_upper_trim(_col(parts, 0)).alias("ident"),
        "lat",
        "lon",
        F.lit("vfr").alias("type"),
        js_upper_trim(_col(parts, 1)).alias("name"),
    )


# Header names of the airport table.
AIRPORT_HEADER = [
    "ident", "gps_code", "local_code", "name", "latitude_deg", "longitude_deg", "type",
    "iata_code", "municipality", "iso_country",
]


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Header-named airport table: ord, ident, gps, local, iata, name, city, country, ..."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    src = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    named = {c.strip(): c for c in raw.columns}
    missing = [c for c in AIRPORT_HEADER if c not in named]
    cols = [
        F.col(f"`{named[c]}`").alias(c) if c not in missing else F.lit(None).cast("string").alias(c)
        for c in AIRPORT_HEADER
    ]
    return conform_airports(raw.select(src.alias("ord"), *cols))


def conform_airports(raw: DataFrame) -> DataFrame:
    """Trimmed and upper-cased airport columns; rows without a name are dropped."""

    def code(c: str) -> Column:
        return null_if_empty(js_upper_trim(F.coalesce(F.col(c), F.lit(""))))

    def text(c: str) -> Column:
        return null_if_empty(js_trim(F.coalesce(F.col(c), F.lit(""))))

    return raw.select(
        "ord",
        code("ident").alias("ident"),
        code("gps_code").alias("gps"),
        code("local_code").alias("local"),
        code("iata_code").alias("iata"),
        text("name").alias("name"),
        text("municipality").alias("city"),
        code("iso_country").alias("country"),
        parse_float_prefix(F.col("latitude_deg")).alias("lat"),
        parse_float_prefix(F.col("longitude_deg")).alias("lon"),
        text("type").alias("type"),
    ).where(F.col("name").isNotNull())


FEATURE = (
    "struct<properties:struct<NAME:string>,geometry:struct<type:string,coordinates:string>>"
)
POLYGON = "array<array<array<double>>>"


def features_to_moas(features: DataFrame) -> DataFrame:
    """Airspaces from GeoJSON features (columns ord, feature): ord, name, polys, bbox."""
    geometry = F.col("feature.geometry")
    multi = F.from_json(geometry["coordinates"], f"array<{POLYGON}>")
    single = F.array(F.from_json(geometry["coordinates"], POLYGON))
    name = F.col("feature.properties.NAME")
    polys = F.when(geometry["type"] == "MultiPolygon", multi).otherwise(single)
    return features.select(
        "ord",
        F.when(F.coalesce(name, F.lit("")) != "", name).otherwise("MOA").alias("name"),
        polys.alias("polys"),
    ).withColumn("bbox", polygon_bbox(F.col("polys")))


def read_moas(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Airspaces of GeoJSON feature collections, or of one feature per line with ``lines``.

    A collection is one JSON document and is parsed by one task; large inputs should come as
    lines, which split like any text file.
    """
    if lines:
        raw = read_lines(spark, path)
        features = raw.select(
            F.col("src").alias("ord"), F.from_json("line", FEATURE).alias("feature")
        )
    else:
        docs = spark.read.option("multiLine", True).schema(f"features array<{FEATURE}>").json(path)
        features = docs.select(
            F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("seq", "feature")
        ).select(
            F.struct(
                "file", F.lit(0).cast("bigint").alias("block"),
                F.col("seq").cast("bigint").alias("seq"),
            ).alias("ord"),
            "feature",
        )
    return features_to_moas(features)


def moas_from_items(items: DataFrame) -> DataFrame:
    """Airspaces from JSON features (columns ord, item)."""
    return features_to_moas(items.select("ord", F.from_json("item", FEATURE).alias("feature")))


FBO = "name string, icao string, lat double, lon double"


def read_fbos(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """FBOs from a JSON array, or from one object per line with ``lines``."""
    raw = spark.read.option("multiLine", not lines).schema(FBO).json(path)
    return raw.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("ord"),
        "name", "icao", "lat", "lon",
    )


def fbos_from_items(items: DataFrame) -> DataFrame:
    """FBOs from JSON objects (columns ord, item)."""
    return items.select("ord", F.from_json("item", FBO).alias("f")).select("ord", "f.*")


def prefer_primary(primary: DataFrame, bundled: DataFrame) -> DataFrame:
    """Feed fallback: rows (feed, ...) of the bundled copy only for feeds the primary lacks."""
    present = primary.select("feed").distinct()
    return primary.unionByName(bundled.join(present, "feed", "left_anti"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages (page_id, url, html and whatever else the landing job wrote)."""
    return spark.read.parquet(path)


POSITION = (
    "aircraft string, ts timestamp, ord bigint, lat double, lon double, alt double, gs double"
)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSITION).parquet(path)


def stream_positions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Positions as they land in a folder; any other streaming source with these columns fits."""
    return (
        spark.readStream.schema(POSITION)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
