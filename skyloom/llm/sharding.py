"""Shards of near-equal size through sampled splitters."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import constant, count_at_most, written

KEY = "array<struct<h:bigint,g:bigint,row:bigint>>"
LEAST = -(1 << 63)


def _weighted_sample(rows: DataFrame, weight: Column, draws: int, seed: int) -> list[tuple]:
    """Keys drawn in proportion to weight (which sums to 1): at most 2 * draws of them, with their draws.

    The fraction of a draw is settled by a hash of the key, so the same rows give the same sample.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h", "g", "row"), 11) / F.lit(float(1 << 53))
    drawn = rows.select("h", "g", "row", F.floor(weight * draws + u).alias("n")).filter("n > 0")
    return sorted((r["h"], r["g"], r["row"], r["n"]) for r in drawn.collect())


def _splitters(sample: list[tuple], pieces: int) -> list[tuple]:
    """Quantile boundaries; one within a group smaller than a piece moves to the group's start."""
    total = sum(x[3] for x in sample)
    group: dict[int, int] = {}
    for h, _, _, n in sample:
        group[h] = group.get(h, 0) + n
    ends = list(accumulate(x[3] for x in sample))
    found = set()
    for i in range(1, pieces):
        at = bisect_left(ends, i * total / pieces)
        h, g, row, _ = sample[min(at, len(sample) - 1)]
        found.add((h, LEAST, LEAST) if group[h] * pieces <= total else (h, g, row))
    return sorted(found)


def shard_by_size(
    docs: DataFrame,
    shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 256,
    range_rows: int = 200_000,
    draws_per_range: int = 8,
    rounds: int = 8,
    slack: float = 0.01,
    seed: int = 17,
) -> DataFrame:
    """One row per input row: id, size, crc of the text, shard and a gapless slot within it.

    A row's key is (hash of its text, hash of its id, row number), so equal texts lie together. Keys are
    drawn in proportion to their share of bytes and rows; their quantiles are the splitters of many
    ranges. Every range is counted exactly; one that holds over twice its share is sampled again
    and subdivided, down to single rows if need be, so a text that a third of all rows hold spreads
    over many ranges. Shards are runs of ranges whose bytes are as near equal as the ranges allow; a
    cut within slack (a part of a shard) of the ideal place that splits no group is preferred. Slots are
    numbered within ranges and moved up by the rows of the ranges before, so no task holds a shard.
    The driver sees splitters and range counts: 256 a shard, or one for each 200,000 rows.

    Size: bytes of the text plus 1. A null text has none, and the crc of no bytes. Null ids hash like any
    value. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.col(id_col)).alias("g"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return _placed(rows, F.lit(0), [0], [0])

    share = F.col("size") / F.lit(2.0 * total) + F.lit(0.5 / n)
    pieces = max(shards * ranges_per_shard, -(-n // range_rows))
    bounds = _splitters(_weighted_sample(rows, share, pieces * draws_per_range, seed), pieces)
    for again in range(rounds + 1):
        at = _range_of(bounds)
        counted = {
            r["at"]: (r["size"], r["rows"])
            for r in rows.groupBy(at.alias("at")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
        }
        over = {
            k: (s / total + c / n) / 2
            for k, (s, c) in counted.items()
            if c > 1 and (s / total + c / n) / 2 > 2 / pieces
        }
        if not over or again == rounds:
            break
        held = sum(over.values())
        parts = max(2, round(held * pieces) * 2)
        inside = rows.filter(at.isin(list(over)))
        sample = _weighted_sample(inside, share / F.lit(held), parts * draws_per_range, seed + again + 1)
        more = sorted({*bounds, *_splitters(sample, parts)})
        if len(more) == len(bounds):
            break
        bounds = more

    ranges = len(bounds) + 1
    sizes = [counted.get(i, (0, 0))[0] for i in range(ranges)]
    counts = [counted.get(i, (0, 0))[1] for i in range(ranges)]
    cuts = _cuts(list(accumulate(sizes)), bounds, shards, slack)
    shard_of, first, shard, start = [], [], 0, 0
    for i in range(ranges):
        while shard < shards - 1 and i >= cuts[shard]:
            shard, start = shard + 1, 0
        shard_of.append(shard)
        first.append(start)
        start += counts[i]
    return _placed(rows, _range_of(bounds), shard_of, first)


def _range_of(bounds: list[tuple]) -> Column:
    known = constant([{"h": h, "g": g, "row": r} for h, g, r in bounds], KEY)
    return count_at_most(known, len(bounds), F.struct("h", "g", "row"))


def _cuts(ends: list[int], bounds: list[tuple], shards: int, slack: float) -> list[int]:
    """For each shard but the last, the first range after it."""
    total, cuts = ends[-1], []
    for k in range(1, shards):
        goal = total * k / shards
        at = bisect_left(ends, goal)
        near = [i for i in range(max(0, at - 64), min(len(bounds), at + 64))]
        off = {i: abs(ends[i] - goal) for i in near}
        whole = [i for i in near if bounds[i][1] == LEAST and off[i] <= slack * total / shards]
        pick = min(whole or near, key=off.get, default=len(bounds))
        cuts.append(max(pick + 1, cuts[-1] if cuts else 0))
    return cuts


def _placed(rows: DataFrame, at: Column, shard_of: list[int], first: list[int]) -> DataFrame:
    order = Window.partitionBy("at").orderBy("h", "g", "row")
    return rows.withColumn("at", at).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.get(constant(shard_of, "array<int>"), F.col("at")).alias("shard"),
        (F.get(constant(first, "array<bigint>"), F.col("at")) + F.row_number().over(order) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
