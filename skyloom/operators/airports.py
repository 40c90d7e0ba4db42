"""Airport look-ups, nearby airports, origin and destination of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.functions.phonetic import TextKeys, best_score
from skyloom.functions.text import js_upper_trim, round1
from skyloom.operators.grid import salted_join
from skyloom.operators.ranking import take_first, with_place
from skyloom.operators.spatial import BOX, nearest_join, within_radius_join
from skyloom.operators.tracks import end_points

# Radii, apron boost and search floors.
NEARBY_NM, ENDPOINT_NM = 150.0, 30.0
APRON_NM, APRON_BOOST = 2.0, 5.0
NEARBY_SCORE = 50
FLOOR_ICAO, FLOOR_NAME, FLOOR_CITY, FLOOR_IATA = 250, 200, 160, 300
MIN_WORD = 3

# Airport types that take part in spatial look-ups.
LISTED_TYPES = ["large_airport", "medium_airport", "small_airport"]


def airport_keys(airports_src: DataFrame) -> DataFrame:
    """One row per look-up key (ident, gps, local, iata): the first source row wins a key.

    Needs ord, ident, gps, local, iata, name, city, country with blanks as NULL.
    """
    icao = F.coalesce("gps", "ident")
    keyed = airports_src.where(F.col("name").isNotNull()).select(
        F.explode(F.array_distinct(F.array("ident", "gps", "local", "iata"))).alias("key"),
        "ord", icao.alias("icao"), "iata", "name", "city", "country",
    )
    return take_first(keyed.where(F.col("key").isNotNull()), ["key"], ["ord"]).drop("ord")


def airport_list(airports_src: DataFrame) -> DataFrame:
    """Airports that have a position, a code and a listed type."""
    return (
        airports_src.withColumn("icao", F.coalesce("gps", "ident"))
        .where(
            F.col("name").isNotNull()
            & F.col("lat").isNotNull()
            & F.col("lon").isNotNull()
            & F.col("type").isin(LISTED_TYPES)
            & F.col("icao").isNotNull()
        )
        .select("ord", "icao", "name", "lat", "lon", "type", "iata", "city", "country")
    )


def airport_names(idents: DataFrame, keys: DataFrame) -> DataFrame:
    """Information per ident (column ``ident``); NULL columns when the key is unknown."""
    asked = idents.withColumn("__key", js_upper_trim(F.coalesce("ident", F.lit(""))))
    return asked.join(keys.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")


def nearby_airports(
    points: DataFrame, airports: DataFrame, max_nm: float = NEARBY_NM, exact: bool = False
) -> DataFrame:
    """Airports within ``max_nm`` of each track's last point, inside the padded track box.

    The box is padded by the same degrees on both axes, which loses airports to the east and
    west at high latitudes; ``exact`` skips it. An airport closer than 2 NM sorts first.
    """
    # One pass over the track gives its last point and its box.
    extent = [F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")]
    ends = points.groupBy("aircraft").agg(
        F.max_by("lat", "idx").alias("lat"),
        F.max_by("lon", "idx").alias("lon"),
        *[e.alias(c) for e, c in zip(extent, BOX, strict=True)],
    )
    padded = geo.pad_bbox_deg({c: F.col(c) for c in BOX}, max_nm)
    probes = ends.select("aircraft", "lat", "lon", *[padded[c].alias(c) for c in BOX])
    near = within_radius_join(probes, airports, max_nm, ["aircraft"])
    if not exact:
        box = {c: F.col(c) for c in BOX}
        near = near.where(geo.in_bbox(F.col("site_lat"), F.col("site_lon"), box))
    near = near.drop(*BOX)
    d = F.col("distance_nm")
    return (
        near.withColumn("distance", round1(d))
        .withColumn("sort_dist", F.when(d < APRON_NM, d - APRON_BOOST).otherwise(d))
        .drop("lat", "lon")
    )


def nearby_list(nearby: DataFrame) -> DataFrame:
    """Place of each airport in its aircraft's list."""
    return with_place(nearby, ["aircraft"], ["sort_dist", "ord"])


def search_nearby(nearby: DataFrame, queries: DataFrame, dialect: str = "page") -> DataFrame:
    """Nearby airports matching a query (query_id, aircraft, query), scores of at least 50.

    ``place`` numbers a query's hits from 1.
    """
    asked = (
        queries.withColumn("q", js_upper_trim(F.coalesce("query", F.lit(""))))
        .where("q <> ''")
        .select("query_id", "aircraft", "q", TextKeys.struct_of(F.col("q"), dialect).alias("qk"))
    )
    name = F.regexp_replace(F.upper(F.coalesce("name", F.lit(""))), "[^A-Z ]", "")
    city = F.upper(F.coalesce("city", F.lit("")))
    # Whole fields first, then each longer word of the name.
    words = F.filter(F.split(F.col("clean_name"), " "), lambda w: F.length(w) >= MIN_WORD)
    fields = F.array_distinct(F.concat(F.array("icao", "clean_name", "upper_city"), words))
    texts = (
        nearby.withColumn("clean_name", name)
        .withColumn("upper_city", city)
        .withColumn("keys", F.transform(fields, lambda t: TextKeys.struct_of(t, dialect)))
    )

    def floor(cond: Column, points: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)

    total = F.greatest(
        best_score(F.col("keys"), F.col("qk")),
        floor(F.contains(F.col("icao"), F.col("q")), FLOOR_ICAO),
        floor(F.contains(F.col("clean_name"), F.col("q")), FLOOR_NAME),
        floor(F.contains(F.col("upper_city"), F.col("q")), FLOOR_CITY),
        floor(F.upper("iata") == F.col("q"), FLOOR_IATA),
    )
    found = (
        salted_join(texts, asked, ["aircraft"], ["ord"])
        .withColumn("score", total)
        .where(F.col("score") >= NEARBY_SCORE)
        .drop("qk", "clean_name", "upper_city", "keys")
    )
    return with_place(found, ["query_id"], [F.desc("score"), "sort_dist", "ord"])


def origin_destination(
    points: DataFrame, airports: DataFrame, max_nm: float = ENDPOINT_NM
) -> DataFrame:
    """Origin and destination per track: nearest airport of the take-off and of the last point.

    Structs of icao, iata, country and distance_nm, NULL beyond ``max_nm``. Tracks need two
    points.
    """
    ends = end_points(points).where("points >= 2")
    # Both ends go through one nearest join.
    probes = ends.select(
        "aircraft",
        F.explode(
            F.array(
                F.struct(F.lit("origin").alias("end"), F.col("start").alias("p")),
                F.struct(F.lit("destination").alias("end"), F.col("last").alias("p")),
            )
        ).alias("e"),
    ).select("aircraft", "e.end", "e.p.lat", "e.p.lon")
    found = nearest_join(
        probes, airports, ["aircraft", "end"], max_nm, ["icao", "iata", "country"]
    )
    return found.groupBy("aircraft").agg(
        F.max(F.when(F.col("end") == "origin", F.col("nearest"))).alias("origin"),
        F.max(F.when(F.col("end") == "destination", F.col("nearest"))).alias("destination"),
    )
