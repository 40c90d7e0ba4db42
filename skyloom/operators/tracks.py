"""Track cleaning, segments, take-off and last points, time snapping and leg numbering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.text import strip_nan, to_fixed
from skyloom.functions.web import leg_bucket
from skyloom.operators import scans
from skyloom.operators.ranking import take_first

# Airborne limits, leg start shift (squared degrees), snapping limit.
AIRBORNE_ALT, AIRBORNE_GS = 500, 60
START_MOVED_D2 = 0.0001
SNAP_D2 = 0.001

RUN_POINTS = 4096

POINT = ["lat", "lon", "alt", "gs"]


def clean_tracks(positions: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Ordered points per aircraft: aircraft, idx, ts, ord, lat, lon, alt, gs, is_live.

    Positions are ordered by ``ts`` (then ``position_time``, then the epoch); a position
    repeated at five decimals anywhere in the track counts once. The live position comes last,
    whatever its time, and is never dropped. Tracks of a single point are dropped.
    """
    epoch = F.timestamp_seconds(F.lit(0))
    times = [F.col("ts").cast("timestamp")]
    if "position_time" in positions.columns:
        times.append(F.col("position_time").cast("timestamp"))
    pts = positions.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "aircraft", F.coalesce(*times, epoch).alias("ts"), "ord", *POINT,
        F.lit(False).alias("is_live"),
    )
    spot = [to_fixed(F.col("lon"), 5), to_fixed(F.col("lat"), 5)]
    pts = take_first(pts, ["aircraft", *spot], ["ts", "ord"])
    if live is not None:
        pts = pts.unionByName(
            live.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
                "aircraft", F.coalesce(F.col("ts").cast("timestamp"), epoch).alias("ts"),
                F.lit(None).cast(pts.schema["ord"].dataType).alias("ord"), *POINT,
                F.lit(True).alias("is_live"),
            )
        )
    # The live point closes the track, so it sits in a chunk after all others.
    chunk = F.when(F.col("is_live"), F.lit(2**62)).otherwise(scans.time_chunk(F.col("ts")))
    indexed = scans.row_index(
        pts, ["aircraft"], ["is_live", "ts", "ord"], chunk, "idx", total="points"
    )
    return indexed.where("points > 1").drop("points")


def track_segments(points: DataFrame) -> DataFrame:
    """Segments aircraft, seg, a_lat, a_lon, b_lat, b_lon between consecutive points."""
    nxt = scans.next_by_index(points, ["aircraft"], "idx", ["lat", "lon"], "b", RUN_POINTS)
    return nxt.where(F.col("b").isNotNull()).select(
        "aircraft",
        F.col("idx").alias("seg"),
        F.col("lat").alias("a_lat"),
        F.col("lon").alias("a_lon"),
        F.col("b")["lat"].alias("b_lat"),
        F.col("b")["lon"].alias("b_lon"),
    )


def track_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("aircraft").agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def _number(c: str) -> Column:
    # Non-numeric altitudes ("ground") and NaN both compare as not airborne.
    return strip_nan(F.col(c).try_cast("double"))


def is_airborne() -> Column:
    return (_number("alt") > AIRBORNE_ALT) & (_number("gs") > AIRBORNE_GS)


def end_points(points: DataFrame) -> DataFrame:
    """Per aircraft: ``start`` (first airborne point, else the first) and ``last`` point.

    Latitude and longitude are picked separately by the unique index, which lets each task
    combine its rows in a hash table.
    """
    idx, airborne_at = F.col("idx"), F.when(is_airborne(), F.col("idx"))
    picked = points.groupBy("aircraft").agg(
        *[
            agg.alias(f"{c}_{n}")
            for c in ("lat", "lon")
            for n, agg in (
                ("air", F.min_by(c, airborne_at)),
                ("first", F.min_by(c, idx)),
                ("last", F.max_by(c, idx)),
            )
        ],
        F.count(F.lit(1)).alias("points"),
    )
    start = [F.coalesce(f"{c}_air", f"{c}_first").alias(c) for c in ("lat", "lon")]
    last = [F.col(f"{c}_last").alias(c) for c in ("lat", "lon")]
    return picked.select(
        "aircraft", F.struct(*start).alias("start"), F.struct(*last).alias("last"), "points"
    )


_SNAP_CELL = 0.05


def snap_time(positions: DataFrame, timed: DataFrame) -> DataFrame:
    """Positions with ``snapped_ts``: the time of the nearest timed point of the same aircraft.

    Only points closer than 0.001 squared degrees count; otherwise the position keeps its own
    time. The first timed point wins a tie. Both sides meet in cells wider than that reach.
    """

    def index(c: Column) -> Column:
        return F.floor(c / _SNAP_CELL)

    # Copies of a position snap alike, and of copies of a timed spot only the first counts.
    probes = (
        positions.select("aircraft", "lat", "lon")
        .distinct()
        .withColumn("__a", index(F.col("lat")))
        .withColumn("__o", index(F.col("lon")))
    )
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    stamped = timed.where(
        F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0)) != 0
    )
    spots = (
        take_first(stamped, ["aircraft", "lat", "lon"], ["ord"])
        .select(
            "aircraft",
            F.col("ts").cast("timestamp").alias("t_ts"),
            F.col("ord").alias("t_ord"),
            F.col("lat").alias("t_lat"),
            F.col("lon").alias("t_lon"),
        )
        .withColumn("__da", F.explode(around))
        .withColumn("__do", F.explode(around))
        .withColumn("__a", index(F.col("t_lat")) + F.col("__da"))
        .withColumn("__o", index(F.col("t_lon")) + F.col("__do"))
        .drop("__da", "__do")
    )
    d_lat, d_lon = F.col("t_lat") - F.col("lat"), F.col("t_lon") - F.col("lon")
    near = (
        probes.join(spots, ["aircraft", "__a", "__o"])
        .withColumn("d2", d_lat * d_lat + d_lon * d_lon)
        .where(F.col("d2") < SNAP_D2)
    )
    best = near.groupBy("aircraft", "lat", "lon").agg(
        F.min_by("t_ts", F.struct("d2", "t_ord")).alias("t_ts")
    )
    return (
        positions.join(best, ["aircraft", "lat", "lon"], "left")
        .withColumn("snapped_ts", F.coalesce("t_ts", F.col("ts").cast("timestamp")))
        .drop("t_ts")
    )


def _leg_starts(changes: DataFrame) -> DataFrame:
    """(aircraft, __us, ord) of the changes that start a leg: one pass in order, which keeps the last start only."""
    kind = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    out = ["aircraft", "__us", "ord"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, call, lat, lon = None, None, None, None
        for part in parts:
            keep = []
            columns = [part[c].tolist() for c in ("aircraft", "bucket", "callsign", "start_lat", "start_lon")]
            for aircraft, bucket, c, la, lo in zip(*columns, strict=True):
                fresh = group != (aircraft, bucket) or c != call
                if not fresh and None not in (la, lo, lat, lon):  # a NaN is never beyond the distance
                    fresh = (la - lat) ** 2 + (lo - lon) ** 2 > START_MOVED_D2
                if fresh:
                    group, call, lat, lon = (aircraft, bucket), c, la, lo
                keep.append(fresh)
            yield part.loc[keep, out]

    tasks = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = changes.repartition(tasks, "aircraft", "bucket").sortWithinPartitions("aircraft", "bucket", "__us", "ord")
    return dealt.mapInPandas(run, ", ".join(f"{c} {kind[c]}" for c in out))


def leg_ids(polls: DataFrame) -> DataFrame:
    """Leg number per poll: aircraft, ts, ord, callsign, start_lat, start_lon -> new_leg, leg_id.

    A leg starts when the callsign changes, when the track start moved against the start kept
    at the last leg start, or when a 15-minute bucket begins. Every bucket therefore begins
    with a fresh state, and a poll that repeats its predecessor never starts a leg: only the
    changes inside one bucket pass by in order, in one task that keeps the last start. Polls without callsign change
    nothing.
    """
    base = polls.withColumn("bucket", leg_bucket(F.col("ts").cast("timestamp")))
    called = base.where(F.coalesce(F.col("callsign"), F.lit("")) != "")
    state = ["callsign", "start_lat", "start_lon"]
    chunk = scans.time_chunk(F.col("ts"))
    prev = scans.previous_row(
        called, ["aircraft"], ["ts", "ord"], chunk, [*state, "bucket"], "p"
    )
    same = F.col("p").isNotNull() & (F.col("p")["bucket"] == F.col("bucket"))
    for c in state:
        same = same & F.col("p")[c].eqNullSafe(F.col(c))
    changes = prev.where(~same)

    # Microseconds: pandas would take timestamps through local time.
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    starts = _leg_starts(changes.select("aircraft", "bucket", moment.alias("__us"), "ord", *state))
    flagged = (
        base.withColumn("__us", moment)
        .join(starts.withColumn("new_leg", F.lit(True)), ["aircraft", "__us", "ord"], "left")
        .withColumn("new_leg", F.coalesce("new_leg", F.lit(False)))
        .drop("__us")
    )
    return scans.running_sum(
        flagged, ["aircraft"], ["ts", "ord"], chunk, F.col("new_leg").cast("int"), "leg_id"
    )
