"""First-wins and top-k selection.

Both filter on ``row_number``; Spark prunes each group to k rows before the shuffle
(window group limit), so a group holding a large share of all rows moves only k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = str | Column


def top_k(
    df: DataFrame,
    keys: Sequence[ColumnLike],
    order: Sequence[ColumnLike],
    k: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` names an optional 1-based rank column."""
    name = rank or "__rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def take_first(
    df: DataFrame, keys: Sequence[ColumnLike], order: Sequence[ColumnLike]
) -> DataFrame:
    """One row per group: the first in source order."""
    return top_k(df, keys, order, 1)


def with_place(
    df: DataFrame, keys: Sequence[ColumnLike], order: Sequence[ColumnLike]
) -> DataFrame:
    """Rows with their place (from 1) in the list of their group; nothing is sorted globally."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def locale_order(c: ColumnLike) -> Column:
    """Collation key for alphabetical order with locale rules instead of code points."""
    col = F.col(c) if isinstance(c, str) else c
    return F.collate(col, "UNICODE")
