"""Helpers shared by the text operators: tables, scratch tables in the shared folder, literals."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.session import ensure_checkpoint_dir, forget_at_end

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of ASCII letters and digits and of everything beyond ASCII, in lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; a null text is an empty one."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; a null text is an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_PATTERN), F.lit(0))


@contextmanager
def _no_shuffle_files_kept(spark: SparkSession):
    """Otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and go on from the table.

    It is computed once and outlives executors. The folder goes when the application ends, shuffle files go
    when the table is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with _no_shuffle_files_kept(spark):
        df.write.parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def totals(df: DataFrame, *columns: Column) -> tuple:
    """The aggregates of all rows; their shuffle files go at once."""
    with _no_shuffle_files_kept(df.sparkSession):
        return tuple(df.agg(*columns).first())


def unwritten(df: DataFrame) -> None:
    """Delete the table of a written result that nothing reads any more."""
    spark = df.sparkSession
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def constant(value, kind: str) -> Column:
    """A foldable literal of any type; value is what JSON can hold."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def count_at_most(bounds: Column, n: int, key: Column) -> Column:
    """How many of n ascending bounds are at most key: a binary search within the row."""
    steps, s = [], 1
    while s <= n:
        steps.append(s)
        s *= 2
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda p, s: F.when(
            (p + s <= n) & (F.get(bounds, p + s - 1) <= key), p + s
        ).otherwise(p),
    )


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str, digest: Column, digest_col: str) -> DataFrame:
    """docs without the rows that found (doc_id, digest_col, kept) lets go; rows missing in found stay.

    The few (id, digest) that leave meet the documents in an anti join. Of rows that repeat a kept pair, one
    stays.
    """
    name, mark = unused(docs, "_id"), unused(docs, "_digest")
    again = unused(docs, "_again")
    by_id = found.groupBy("doc_id", digest_col).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    by_id = written(by_id.filter("not kept or rows > 1"), "leaving").select(
        F.col("doc_id").alias(name), F.col(digest_col).alias(mark), F.col("kept").alias(again)
    )
    same = F.col(id_col).eqNullSafe(F.col(name)) & (digest == F.col(mark))
    once = docs.join(by_id, same, "left_anti")
    repeated = docs.join(by_id.filter(F.col(again)), same, "left_semi").withColumn(mark, digest)
    return once.unionByName(repeated.dropDuplicates([id_col, mark]).drop(mark))
