"""Zip bundles: members are picked by name and read line by line inside tasks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Member names inside the bundles.
MEMBERS = {
    "records": (r"FAACIFP", r"(\.pdf|\.txt|\.xlsx|\.doc)$"),
    "navaids": (r"navaids\.csv", None),
    "waypoints": (r"waypoints\.csv", None),
    "vfr": (r"VFR\.csv", None),
    "moas": (r"moas\.json$", None),
    "fbos": (r"fbos\.json$", None),
}

LINE_SCHEMA = "archive string, member string, line_no bigint, line string"
BATCH_LINES = 20_000
BATCH_ITEMS = 500


def read_archive(
    spark: SparkSession, path: str, member_regex: str, exclude_regex: str | None = None
) -> DataFrame:
    """Lines of the first matching member of each archive: archive, member, line_no, line.

    One task reads one archive, streaming its member in batches; archives run in parallel.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    names = _matching(bundle, member_regex, exclude_regex)
                    if not names:
                        continue
                    with bundle.open(names[0]) as raw:
                        text = io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n")
                        buffer: list[tuple[int, str]] = []
                        for i, line in enumerate(text):
                            buffer.append((i, line.rstrip("\n").removesuffix("\r")))
                            if len(buffer) == BATCH_LINES:
                                yield _frame(path_, names[0], buffer)
                                buffer = []
                        if buffer:
                            yield _frame(path_, names[0], buffer)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lines, LINE_SCHEMA)


def _matching(bundle: zipfile.ZipFile, want: str, skip: str | None) -> list[str]:
    return [
        n for n in bundle.namelist()
        if re.search(want, n, re.IGNORECASE)
        and not (skip and re.search(skip, n, re.IGNORECASE))
    ]


def _frame(archive: str, member: str, rows: list[tuple[int, str]]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["line_no", "line"])
    frame.insert(0, "member", member)
    frame.insert(0, "archive", archive)
    return frame


def read_member(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Lines of a known feed from its bundle, with ``src`` as the order of the lines."""
    want, skip = MEMBERS[feed]
    return read_archive(spark, path, want, skip).select(
        F.struct(
            F.col("archive").alias("file"), F.lit(0).cast("bigint").alias("block"),
            F.col("line_no").alias("seq"),
        ).alias("src"),
        "line",
    )


def read_items(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Items of a JSON member, one row each: ``ord`` (source order) and ``item`` (JSON text).

    A feature collection gives its features, an array its elements. The document is taken apart
    by the task that opens the archive, so it never travels as a whole.
    """
    want, skip = MEMBERS[feed]

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    names = _matching(bundle, want, skip)
                    if not names:
                        continue
                    with bundle.open(names[0]) as raw:
                        doc = json.load(raw)
                    rows = doc.get("features") or [] if isinstance(doc, dict) else doc
                    for start in range(0, len(rows), BATCH_ITEMS):
                        part = rows[start : start + BATCH_ITEMS]
                        yield pd.DataFrame(
                            {
                                "file": path_,
                                "seq": range(start, start + len(part)),
                                "item": [json.dumps(r) for r in part],
                            }
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(items, "file string, seq bigint, item string").select(
        F.struct("file", F.lit(0).cast("bigint").alias("block"), "seq").alias("ord"), "item"
    )
