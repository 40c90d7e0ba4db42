"""Grid-cell equi-joins for spatial predicates.

A spatial join becomes an equi-join on cell numbers plus the exact predicate. One side keeps
one cell per row, the other is copied into every cell it can reach. Cells that hold a large
share of the rows are split: the single-cell side is dealt out over several salts and the
other side is copied to each of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.geo import DEG_PER_NM

# Divisors of 360 degrees, so that cells close up at the antimeridian.
CELL_SIZES = [0.1, 0.25, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 9.0, 10.0, 15.0, 30.0,
              45.0, 60.0, 90.0, 180.0, 360.0]

# Box cells: a box uses the first size at which it spans at most four cells per axis.
BOX_LEVELS = [0.5, 2.0, 8.0, 32.0, 128.0, 512.0]
BOX_SPAN = 4

# A key is hot above this share of all rows, so at most HOT_KEYS keys can be hot.
HOT_KEYS = 200

_ROW = 10_000


def cell_size_for(radius_nm: float) -> float:
    """Smallest cell that is as wide as the radius; the whole globe for any larger one."""
    reach = radius_nm * DEG_PER_NM
    return next((size for size in CELL_SIZES if size >= reach), CELL_SIZES[-1])


def _lat_index(lat: Column, size: float) -> Column:
    return F.floor(lat / size).cast("int")


def _lon_index(lon: Column, size: float) -> Column:
    return F.floor((lon + 180) / size).cast("int")


def _cell_id(lat_i: Column, lon_i: Column) -> Column:
    return lat_i.cast("bigint") * _ROW + lon_i


def point_cell(lat: Column, lon: Column, size: float) -> Column:
    """Cell of a position; longitudes wrap."""
    n = round(360 / size)
    return _cell_id(_lat_index(lat, size), F.pmod(_lon_index(lon, size), F.lit(n)))


def _lon_reach(lat_abs_max: Column, radius_deg: float) -> Column:
    """Half-width in longitude of a cap of that radius; the whole circle near a pole."""
    ratio = F.lit(math.sin(math.radians(radius_deg))) / F.cos(F.radians(lat_abs_max))
    width = F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-9
    return F.when(lat_abs_max + radius_deg >= 90.0, F.lit(180.0)).otherwise(width)


def _ring_cells(lat_lo, lat_hi, lon_lo, lon_hi, size: float) -> Column:
    """ARRAY of cells of a lat/lon range, with longitudes wrapped."""
    n = round(360 / size)
    first, last = _lon_index(lon_lo, size), _lon_index(lon_hi, size)
    full = (last - first) >= n
    lons = F.sequence(
        F.when(full, F.lit(0)).otherwise(first), F.when(full, F.lit(n - 1)).otherwise(last)
    )
    lats = F.sequence(_lat_index(lat_lo, size), _lat_index(lat_hi, size))
    return F.flatten(
        F.transform(
            lats, lambda a: F.transform(lons, lambda o: _cell_id(a, F.pmod(o, F.lit(n))))
        )
    )


def cap_cells(lat: Column, lon: Column, radius_nm: float, size: float) -> Column:
    """Cells within reach of a position."""
    r = radius_nm * DEG_PER_NM
    reach = _lon_reach(F.abs(lat), r)
    return _ring_cells(lat - r, lat + r, lon - reach, lon + reach, size)


def segment_cells(
    df: DataFrame, a_lat: str, a_lon: str, b_lat: str, b_lon: str, size: float, out: str,
    radius_nm: float | None = None, alone: bool = False,
) -> DataFrame:
    """One row per cell a segment passes, or with a radius per cell within its reach; longitudes wrapped.

    A segment longer than a cell is cut into pieces of one cell size, and each piece covers the
    cells of its own box. Cutting serves the cover only: distances use the whole segment. Without
    a radius a cell may repeat, which a minimum does not mind. ``alone`` adds a row in no cell for each segment.
    """
    n_cells = round(360 / size)
    longest = F.greatest(
        F.abs(F.col(b_lat) - F.col(a_lat)), F.abs(F.col(b_lon) - F.col(a_lon))
    )
    pieces = F.greatest(F.ceil(longest / size), F.lit(1)).cast("int")
    slack = 1e-6  # the foot of a perpendicular lies on the piece only up to rounding

    def ends(i: Column) -> tuple[Column, Column, Column, Column]:
        lat0 = F.col(a_lat) + i / F.col("__n") * (F.col(b_lat) - F.col(a_lat))
        lat1 = F.col(a_lat) + (i + 1) / F.col("__n") * (F.col(b_lat) - F.col(a_lat))
        lon0 = F.col(a_lon) + i / F.col("__n") * (F.col(b_lon) - F.col(a_lon))
        lon1 = F.col(a_lon) + (i + 1) / F.col("__n") * (F.col(b_lon) - F.col(a_lon))
        return (
            F.least(lat0, lat1) - slack, F.greatest(lat0, lat1) + slack,
            F.least(lon0, lon1) - slack, F.greatest(lon0, lon1) + slack,
        )

    def cover(i: Column) -> Column:
        lat0, lat1, lon0, lon1 = ends(i)
        lats = F.sequence(_lat_index(lat0, size), _lat_index(lat1, size))
        lons = F.sequence(_lon_index(lon0, size), _lon_index(lon1, size))
        return F.flatten(
            F.transform(
                lats,
                lambda a: F.transform(lons, lambda o: _cell_id(a, F.pmod(o, F.lit(n_cells)))),
            )
        )

    def reach(i: Column) -> Column:
        lat0, lat1, lon0, lon1 = ends(i)
        r = radius_nm * DEG_PER_NM
        wide = _lon_reach(F.greatest(F.abs(lat0), F.abs(lat1)), r)
        return _ring_cells(lat0 - r, lat1 + r, lon0 - wide, lon1 + wide, size)

    if radius_nm is not None:
        # The pieces' reaches overlap; a cell is met once.
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), reach))
        return df.withColumn("__n", pieces).withColumn(out, F.explode(F.array_distinct(every))).drop("__n")
    cells = cover(F.col("__i"))
    if alone:
        none = F.lit(None).cast("bigint")
        cells = F.when(F.col("__i") == 0, F.concat(F.array(none), cells)).otherwise(cells)
    return (
        df.withColumn("__n", pieces)
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn(out, F.explode(cells))
        .drop("__n", "__i")
    )


def _box_index(value: Column, size: Column, limit: float) -> Column:
    # Clamping is monotone, so containment and overlap survive it.
    inside = F.greatest(F.lit(-limit), F.least(F.lit(limit), value))
    return F.floor((inside + limit) / size).cast("int")


def _level_size(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in BOX_LEVELS]), level + 1)


def box_level(b) -> Column:
    """Index of the cell size of a box."""
    span = F.greatest(b["max_lat"] - b["min_lat"], b["max_lon"] - b["min_lon"])
    level = F.lit(len(BOX_LEVELS) - 1)
    for i in range(len(BOX_LEVELS) - 2, -1, -1):
        level = F.when(span <= BOX_LEVELS[i] * BOX_SPAN, i).otherwise(level)
    return level


def box_point_cell(lat: Column, lon: Column, level: Column) -> Column:
    size = _level_size(level)
    return (
        level.cast("bigint") * 100_000_000
        + _box_index(lat, size, 90.0).cast("bigint") * _ROW
        + _box_index(lon, size, 180.0)
    )


def box_cells(b, level: Column) -> Column:
    size = _level_size(level)
    lats = F.sequence(_box_index(b["min_lat"], size, 90.0), _box_index(b["max_lat"], size, 90.0))
    lons = F.sequence(_box_index(b["min_lon"], size, 180.0), _box_index(b["max_lon"], size, 180.0))
    base = level.cast("bigint") * 100_000_000
    cells = F.flatten(
        F.transform(
            lats, lambda a: F.transform(lons, lambda o: base + a.cast("bigint") * _ROW + o)
        )
    )
    valid = (b["min_lat"] <= b["max_lat"]) & (b["min_lon"] <= b["max_lon"])
    return F.when(valid, cells)


def levels_in_use(boxes: DataFrame, level: str) -> Column:
    """Array of the levels that occur, as a scalar subquery: at most one entry per level."""
    return boxes.agg(F.collect_set(level)).scalar()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; looks at statistics only, runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def will_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size check lets it broadcast this side."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(df) <= conf.autoBroadcastJoinThreshold()


def safe_to_broadcast(df: DataFrame) -> DataFrame:
    """The side of a join, kept from a broadcast that Spark's estimate would let pass but its rows would not.

    The estimate starts from compressed files and knows nothing of exploded arrays, so a side that seems small is
    counted, as far as the bound. A larger one is shuffled and sorted, and never passes through the driver. Rows of
    many values count for more: the driver holds them several times.
    """
    if df.isStreaming or not will_broadcast(df):
        return df
    most = min(BROADCAST_ROWS, BROADCAST_ROWS * BROADCAST_WIDTH // values_of(df.schema))
    return df if df.limit(most + 1).count() <= most else df.hint("merge")


def values_of(kind: T.DataType) -> int:
    """How many values a row holds, an array or map taken as sixteen entries."""
    if isinstance(kind, T.StructType):
        return sum(values_of(f.dataType) for f in kind.fields) or 1
    if isinstance(kind, T.ArrayType):
        return 16 * values_of(kind.elementType)
    if isinstance(kind, T.MapType):
        return 16 * (values_of(kind.keyType) + values_of(kind.valueType))
    return 1


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys holding more than 1/HOT_KEYS of the rows, with the number of salts to use.

    There are fewer than HOT_KEYS of them whatever the size of the data, so they may pass
    through the driver and be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    hot = counts.where(F.col("n") * HOT_KEYS > total).select(
        *keys, F.ceil(F.col("n") * HOT_KEYS / total).cast("int").alias("__salts")
    )
    return df.sparkSession.createDataFrame(hot.collect(), hot.schema)


def salted_join(
    split: DataFrame,
    copied: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    check_bytes: int | None = None,
) -> DataFrame:
    """Equi-join that deals rows of hot keys of ``split`` out over several salts.

    Inputs estimated below ``check_bytes`` are joined as they are: their largest key fits a
    task. So are inputs whose other side Spark will broadcast, since nothing is shuffled by key
    then; only a side of few rows is (``safe_to_broadcast``). Otherwise one pass over the join keys finds the hot ones. The salt is a hash of the row's
    own id columns, so a recomputed task deals its rows out the same way. Skewed shuffle
    partitions that remain are split by adaptive execution.
    """
    limit = SALT_CHECK_BYTES if check_bytes is None else check_bytes
    if split.isStreaming:
        return split.join(copied, list(keys), how)
    side = safe_to_broadcast(copied)
    if estimated_bytes(split) < limit or (side is copied and will_broadcast(copied)):
        return split.join(side, list(keys), how)
    hot = F.broadcast(hot_keys(split, keys))
    dealt = split.join(hot, list(keys), "left").withColumn(
        "__salt",
        F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__salts")).cast("int"), F.lit(0)),
    )
    copies = copied.join(hot, list(keys), "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    return dealt.drop("__salts").join(copies.drop("__salts"), [*keys, "__salt"], how).drop("__salt")


# Rows up to which a side may be broadcast, and the values a row of them may hold; of wider rows fewer may.
BROADCAST_ROWS, BROADCAST_WIDTH = 100_000, 8

# Estimated input size from which hot keys are looked for.
SALT_CHECK_BYTES = 1 << 30
