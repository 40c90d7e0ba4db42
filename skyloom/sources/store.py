"""Persisted tables with atomic publication and a version gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "_manifest"
TILE_DEG = 10.0


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def current_manifest(spark: SparkSession, root: str):
    """Latest manifest row (v, folder, published_at) or None. The table has one row per publish."""
    if not _exists(spark, f"{root}/{MANIFEST}"):
        return None
    try:
        rows = (
            spark.read.parquet(f"{root}/{MANIFEST}").orderBy(F.desc("published_at")).take(1)
        )
    except AnalysisException:
        return None
    return rows[0] if rows else None


def needs_refresh(remote_v: int | None, stored_v: int | None) -> bool:
    """An unreachable source (None) keeps what is stored; otherwise any difference reloads."""
    return remote_v is not None and remote_v != stored_v


def with_tile(df: DataFrame) -> DataFrame:
    """Coarse spatial partition column: at most 648 tiles of ten degrees."""
    return df.withColumn(
        "tile",
        F.floor((F.col("lat") + 90) / TILE_DEG) * 100 + F.floor((F.col("lon") + 180) / TILE_DEG),
    )


def publish(spark: SparkSession, root: str, version: int | None, tables: dict[str, DataFrame]):
    """Write all tables to a fresh folder, then make them current with one manifest row.

    Readers see the old tables until the manifest row lands, so no partial state is visible.
    """
    folder = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df
        if {"lat", "lon"} <= set(df.columns):
            tiled = with_tile(df)
            # Range partitioning splits a crowded tile over several files.
            writer = tiled.repartitionByRange("tile", "lat", "lon")
            writer.write.partitionBy("tile").parquet(f"{root}/{folder}/{name}")
        else:
            writer.write.parquet(f"{root}/{folder}/{name}")
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("v"), F.lit(folder).alias("folder"),
        F.current_timestamp().alias("published_at"),
    )
    row.write.mode("append").parquet(f"{root}/{MANIFEST}")
    return folder


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    manifest = current_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"nothing published under {root}")
    table = spark.read.parquet(f"{root}/{manifest['folder']}/{name}")
    return table.drop("tile")


def load_in_box(
    spark: SparkSession, root: str, name: str,
    min_lat: float, max_lat: float, min_lon: float, max_lon: float,
) -> DataFrame:
    """Rows inside a box; whole tiles outside it are never read."""
    manifest = current_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"nothing published under {root}")
    table = spark.read.parquet(f"{root}/{manifest['folder']}/{name}")
    rows = range(int((min_lat + 90) // TILE_DEG), int((max_lat + 90) // TILE_DEG) + 1)
    cols = range(int((min_lon + 180) // TILE_DEG), int((max_lon + 180) // TILE_DEG) + 1)
    tiles = [r * 100 + c for r in rows for c in cols]
    return table.where(
        F.col("tile").isin(tiles)
        & F.col("lat").between(min_lat, max_lat)
        & F.col("lon").between(min_lon, max_lon)
    ).drop("tile")


def refresh(
    spark: SparkSession, root: str, remote_v: int | None, build
) -> bool:
    """Rebuild with ``build() -> tables`` when the version changed or nothing usable is stored.

    Returns whether a rebuild happened.
    """
    manifest = current_manifest(spark, root)
    stored_v = manifest["v"] if manifest else None
    usable = manifest is not None and not needs_refresh(remote_v, stored_v)
    if usable:
        fixes = f"{root}/{manifest['folder']}/fixes"
        if _exists(spark, fixes) and not spark.read.parquet(fixes).isEmpty():
            return False
    publish(spark, root, remote_v if remote_v is not None else stored_v, build())
    return True
