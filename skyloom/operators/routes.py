"""Routes: candidates from landed pages, nearest-in-time match, resolution with track ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import js_upper_trim, norm_airport_code
from skyloom.functions.web import (
    HISTORY_LINK,
    airline_name,
    airport_page_struct,
    utc_from_parts,
)
from skyloom.operators import scans
from skyloom.operators.ranking import take_first

# Page kinds in scan order, and the penalty of a departure in the future.
PAGE_KINDS = ["history", "live"]
FUTURE_PENALTY_MS = 86_400_000

ASOF_CHUNK_SECONDS = 86_400
CANDIDATE = ["orig", "dest", "ts", "date_str", "time_str", "ord"]


def extract_routes(pages: DataFrame) -> DataFrame:
    """Route candidates linked from pages (callsign, kind, html): one row per link.

    ``ord`` orders a callsign's candidates: history pages first, then the live page, links in
    page order. Callsigns are trimmed and upper-cased, as those of flights are.
    """
    links = F.regexp_extract_all("html", F.lit(HISTORY_LINK), F.lit(0))
    kind_rank = F.when(F.col("kind") == PAGE_KINDS[0], 0).otherwise(1)
    page_ord = F.col("ord") if "ord" in pages.columns else F.col("page_id")
    found = pages.select(
        "callsign", kind_rank.alias("k"), page_ord.alias("p"), F.posexplode(links).alias("i", "link")
    )

    # The link ends in .../history/<day>/<clock>Z/<orig>/<dest>.
    parts = F.split("link", "/")
    linked = found.select("*", *[
        F.element_at(parts, i - 4).alias(n) for i, n in enumerate(("day", "clock", "o", "d"))
    ])
    clock = F.substring("clock", 1, 4)
    return linked.select(
        js_upper_trim(F.col("callsign")).alias("callsign"),
        F.struct("k", "p", "i").alias("ord"),
        F.upper("o").alias("orig"),
        F.upper("d").alias("dest"),
        utc_from_parts(F.col("day"), clock).alias("ts"),
        F.col("day").alias("date_str"),
        clock.alias("time_str"),
    )


def airlines(pages: DataFrame) -> DataFrame:
    """Airline per callsign from its live page title."""
    named = pages.where(F.col("kind") == "live").select(
        js_upper_trim(F.col("callsign")).alias("callsign"), "page_id", airline_name(F.col("html")).alias("airline")
    )
    return take_first(named.where(F.col("airline").isNotNull()), ["callsign"], ["page_id"]).select(
        "callsign", "airline"
    )


def _millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def _diff(cand: Column, as_of: Column) -> Column:
    delta = _millis(cand["ts"]) - _millis(as_of)
    return F.when(delta > 0, delta + FUTURE_PENALTY_MS).otherwise(-delta)


def route_asof(flights: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flights (keys, flight_id, as_of) with ``best``: the candidate nearest in time, or NULL.

    A departure in the future costs another 24 hours; the first candidate wins a tie. Only the
    latest candidate at or before the flight and the first one after it can win, so one ordered
    scan over both inputs finds them, without pairing a flight with all candidates of its key.
    """
    cand = F.struct(*[F.col(c) for c in CANDIDATE])
    unique = take_first(candidates.where(F.col("ts").isNotNull()), [*keys, "ts"], ["ord"])
    rows = unique.select(
        *keys, F.col("ts").cast("timestamp").alias("at"), F.lit(0).alias("is_flight"),
        F.lit(None).cast(flights.schema["flight_id"].dataType).alias("flight_id"),
        cand.alias("cand"),
    ).unionByName(
        flights.select(
            *keys, F.col("as_of").cast("timestamp").alias("at"), F.lit(1).alias("is_flight"),
            "flight_id", F.lit(None).cast(unique.select(cand.alias("c")).schema["c"].dataType)
            .alias("cand"),
        )
    )
    scanned = scans.carry(
        rows, list(keys), ["at", "is_flight"],
        scans.time_chunk(F.col("at"), ASOF_CHUNK_SECONDS), F.col("cand"), "past", "future",
    ).where("is_flight = 1")
    past, future = F.col("past"), F.col("future")
    d_past, d_future = _diff(past, F.col("at")), _diff(future, F.col("at"))
    take_past = (
        (d_past < d_future)
        | ((d_past == d_future) & (past["ord"] < future["ord"]))
        | future.isNull()
    )
    best = F.when(past.isNotNull() & take_past, past).otherwise(future)
    return (
        scanned.withColumn("best", best)
        .withColumn("time_diff", F.when(F.col("best").isNotNull(), _diff(F.col("best"), F.col("at"))))
        .select(*keys, "flight_id", "best", "time_diff")
    )


def match_route(
    flights: DataFrame, candidates: DataFrame, airline: DataFrame | None = None
) -> DataFrame:
    """Best route per flight (flight_id, callsign, registration, as_of, gps_origin).

    Candidates departing from the detected origin are preferred (codes compared without region
    prefix); when the callsign has none, all its candidates count. The registration stands in
    for a missing callsign. Flights without any candidate are left out.
    """
    blank = F.lit("")
    call = js_upper_trim(F.coalesce("callsign", blank))
    reg = (
        js_upper_trim(F.coalesce("registration", blank))
        if "registration" in flights.columns
        else blank
    )
    origin = norm_airport_code(F.col("gps_origin"))
    asked = (
        flights.withColumn("callsign", F.when(call != "", call).otherwise(reg))
        .where(F.col("callsign") != "")
        .withColumn("scope", F.explode(F.array_distinct(F.array(origin, F.lit("*")))))
        .where(F.col("scope") != "")
    )
    offered = candidates.withColumn(
        "scope", F.explode(F.array_distinct(F.array(norm_airport_code(F.col("orig")), F.lit("*"))))
    )
    matched = route_asof(
        asked.select("callsign", "scope", "flight_id", "as_of"), offered, ["callsign", "scope"]
    ).where(F.col("best").isNotNull())
    # The origin's own candidates come first; '*' is the fallback.
    chosen = matched.groupBy("flight_id", "callsign").agg(
        F.min_by(F.struct("best", "time_diff"), (F.col("scope") == "*").cast("int")).alias("m")
    )
    out = chosen.select(
        "flight_id", "callsign",
        F.col("m.best.orig").alias("origin"),
        F.col("m.best.dest").alias("destination"),
        F.col("m.best.date_str").alias("flight_date"),
        F.col("m.best.time_str").alias("flight_time"),
        F.col("m.best.ts").alias("departure"),
        F.col("m.time_diff").alias("time_diff"),
    )
    if airline is None:
        return out.withColumn("airline", F.lit(None).cast("string"))
    return out.join(airline, "callsign", "left")


def enrich_airport(routes: DataFrame, keys: DataFrame, end: str) -> DataFrame:
    """Complete the airport struct ``end`` of a route from the key table.

    Code, name, city and country are taken over when known, the IATA code only when missing; an
    end that already has a name stays as it is.
    """
    known = keys.select(
        F.col("key").alias("__key"),
        F.struct(*["icao", "iata", "name", "city", "country"]).alias("__info"),
    )
    own, info = F.col(end), F.col("__info")
    wanted = F.when(
        own["icao"].isNotNull() & own["name"].isNull(), js_upper_trim(own["icao"])
    )
    merged = F.struct(
        F.coalesce(info["icao"], own["icao"]).alias("icao"),
        F.coalesce(own["iata"], info["iata"]).alias("iata"),
        F.coalesce(info["name"], own["name"]).alias("name"),
        F.coalesce(info["city"], own["city"]).alias("city"),
        F.coalesce(info["country"], own["country"]).alias("country"),
    )
    # Ends without a key have nothing to look up; they keep out of the join.
    keyed = routes.withColumn("__key", wanted)
    joined = keyed.where(F.col("__key").isNotNull()).join(known, "__key", "left")
    found = joined.withColumn(end, F.when(own.isNotNull(), merged)).drop("__key", "__info")
    plain = F.when(own.isNotNull(), F.struct(*[own[c].alias(c) for c in AIRPORT]))
    rest = keyed.where(F.col("__key").isNull()).withColumn(end, plain).drop("__key")
    return found.unionByName(rest)


AIRPORT = ["icao", "iata", "name", "city", "country"]


def _airport(**cols: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[cols.get(c, none).alias(c) for c in AIRPORT])


def resolve_route(
    flights: DataFrame, detected: DataFrame, matched: DataFrame, keys: DataFrame
) -> DataFrame:
    """Final route per flight: the matched pair, else what the track ends say, with names.

    ``flights`` has flight_id and aircraft, ``detected`` is ``origin_destination``, ``matched``
    is ``match_route``. Flights with neither are left out.
    """
    scraped = matched.select(
        "flight_id", "callsign", "airline", "time_diff",
        _airport(icao=F.col("origin")).alias("m_origin"),
        _airport(icao=F.col("destination")).alias("m_dest"),
    )
    gps = detected.select(
        "aircraft",
        F.when(
            F.col("origin").isNotNull(),
            _airport(icao=F.col("origin")["icao"], country=F.col("origin")["country"]),
        ).alias("g_origin"),
        F.when(
            F.col("destination").isNotNull(),
            _airport(
                icao=F.col("destination")["icao"], iata=F.col("destination")["iata"],
                country=F.col("destination")["country"],
            ),
        ).alias("g_dest"),
    )
    joined = (
        flights.select("flight_id", "aircraft")
        .join(scraped, "flight_id", "left")
        .join(gps, "aircraft", "left")
    )
    from_page = F.col("m_origin").isNotNull()
    both = joined.select(
        "flight_id", "aircraft", "airline", "time_diff",
        F.when(from_page, "page").otherwise("track").alias("source"),
        F.when(from_page, F.col("m_origin")).otherwise(F.col("g_origin")).alias("origin"),
        F.when(from_page, F.col("m_dest")).otherwise(F.col("g_dest")).alias("destination"),
    ).where(F.col("origin").isNotNull() | F.col("destination").isNotNull())
    return enrich_airport(enrich_airport(both, keys, "origin"), keys, "destination")


def gps_flights(flights: DataFrame, detected: DataFrame) -> DataFrame:
    """Flights with ``gps_origin`` from the detected track origin."""
    origins = detected.select("aircraft", F.col("origin")["icao"].alias("gps_origin"))
    return flights.join(origins, "aircraft", "left")


def airport_page_info(pages: DataFrame) -> DataFrame:
    """Name and location per airport information page (ident, html)."""
    asked = pages.withColumn("ident", js_upper_trim(F.coalesce("ident", F.lit(""))))
    info = F.when(
        F.col("ident") != "", airport_page_struct(F.col("html"))
    ).otherwise(
        F.struct(
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("location"),
            F.lit(False).alias("is_found"),
        )
    )
    return asked.withColumn("i", info).select(
        *[c for c in asked.columns if c != "html"], "i.name", "i.location", "i.is_found"
    )
