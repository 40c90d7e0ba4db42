"""Registry of the checked queries: name -> (DataFrame builder, brute-force SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Builder) -> Builder:
        QUERIES[name] = lambda spark, sf_dir: plain_types(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines report one integer type."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[
            F.col(f.name).cast("bigint") if isinstance(f.dataType, small) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
