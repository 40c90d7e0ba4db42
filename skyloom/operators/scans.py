"""Ordered scans over tracks that split one long track over many tasks.

A plain window partitioned by the track key sends a whole track to one task. Here rows are
grouped by (key, chunk), where the chunk is a slice of time taken from the data, so a track
holding a large share of all rows spreads over as many tasks as it has chunks. What has to
cross a chunk border (the first row of the next chunk, the number of earlier rows, the last
value seen) is aggregated to one row per chunk, scanned over that small table, and joined back
on (key, chunk), the partitioning the rows already have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 3600
_CHUNK = "__chunk"


def time_chunk(ts: Column, seconds: int = CHUNK_SECONDS) -> Column:
    """Chunk number of a timestamp; NULL timestamps share the first chunk."""
    return F.coalesce(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds), F.lit(0))


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _chunk_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(_CHUNK)


def with_chunk(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(_CHUNK, chunk)


def _join_borders(df: DataFrame, borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, _CHUNK]
    return df.join(borders, on, "left")


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in its key's order. ``chunk`` must grow with ``order``.

    ``total`` names an optional column with the number of rows of the key.
    """
    rows = with_chunk(df, chunk)
    sizes = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(_chunk_window(keys).rowsBetween(Window.unboundedPreceding, -1))
    border = [F.coalesce(before, F.lit(0)).alias("__before")]
    if total:
        border.append(F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    offsets = sizes.select(*keys, _CHUNK, *border)
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    ranked = rows.withColumn("__rn", F.row_number().over(inner))
    return (
        _join_borders(ranked, offsets, keys)
        .withColumn(out, F.col("__before") + F.col("__rn") - 1)
        .drop("__rn", "__before", _CHUNK)
    )


def next_by_index(
    df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], out: str, run: int
) -> DataFrame:
    """Struct of ``cols`` of the following row, for rows with a dense index per key.

    Rows are grouped by runs of ``run`` indexes. The first row of a run is copied to the end of
    the run before it, so one shuffle is enough and no track meets in one task.
    """
    payload = F.struct(*[F.col(c) for c in cols])
    own = F.floor(F.col(idx) / run)
    opens = (F.col(idx) > 0) & (F.col(idx) % run == 0)
    both = F.when(opens, F.array(own, own - 1)).otherwise(F.array(own))
    spread = df.withColumn(_CHUNK, F.explode(both))
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(idx)
    return (
        spread.withColumn(out, F.lead(payload).over(inner))
        .where(F.col(_CHUNK) == F.floor(F.col(idx) / run))
        .drop(_CHUNK)
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    cols: Sequence[str],
    out: str,
) -> DataFrame:
    """Struct of ``cols`` of the preceding row in the key's order; NULL on the first row."""
    rows = with_chunk(df, chunk)
    payload = F.struct(*[F.col(c) for c in cols])
    lasts = rows.groupBy(*keys, _CHUNK).agg(
        F.max_by(payload, _order_struct(order)).alias("__last")
    )
    borders = lasts.select(
        *keys, _CHUNK, F.lag("__last").over(_chunk_window(keys)).alias("__prev_last")
    )
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    ranked = rows.withColumn("__lag", F.lag(payload).over(inner))
    return (
        _join_borders(ranked, borders, keys)
        .withColumn(out, F.coalesce("__lag", "__prev_last"))
        .drop("__lag", "__prev_last", _CHUNK)
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum in the key's order."""
    rows = with_chunk(df, chunk).withColumn("__v", value)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(_chunk_window(keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, _CHUNK, F.coalesce(before, F.lit(0)).alias("__before"))
    inner = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = rows.withColumn("__run", F.sum("__v").over(inner))
    return (
        _join_borders(ranked, offsets, keys)
        .withColumn(out, F.col("__before") + F.col("__run"))
        .drop("__v", "__run", "__before", _CHUNK)
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    before: str,
    after: str,
) -> DataFrame:
    """Last non-NULL ``value`` at or before each row, and first non-NULL one at or after it."""
    rows = with_chunk(df, chunk).withColumn("__v", value)
    at = F.when(F.col("__v").isNotNull(), _order_struct(order))
    ends = rows.groupBy(*keys, _CHUNK).agg(
        F.max_by("__v", at).alias("__last"), F.min_by("__v", at).alias("__first")
    )
    w = _chunk_window(keys)
    borders = ends.select(
        *keys,
        _CHUNK,
        F.last("__last", ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, -1))
        .alias("__carry_last"),
        F.first("__first", ignorenulls=True)
        .over(w.rowsBetween(1, Window.unboundedFollowing))
        .alias("__carry_first"),
    )
    inner = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    scanned = rows.withColumn(
        "__b",
        F.last("__v", ignorenulls=True).over(
            inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    ).withColumn(
        # The same scan from the other end: reversing the order keeps the frame a running one.
        "__a",
        F.last("__v", ignorenulls=True).over(
            Window.partitionBy(*keys, _CHUNK)
            .orderBy(*[F.desc(c) for c in order])
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    return (
        _join_borders(scanned, borders, keys)
        .withColumn(before, F.coalesce("__b", "__carry_last"))
        .withColumn(after, F.coalesce("__a", "__carry_first"))
        .drop("__v", "__a", "__b", "__carry_last", "__carry_first", _CHUNK)
    )
