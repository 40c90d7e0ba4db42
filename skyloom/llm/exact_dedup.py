"""Exact copies through an extendible-hash index on shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import ascii_lower, constant, kept_rows, written


def split_directory(spans: list[tuple[int, int, int]], capacity: int) -> tuple[int, list[int], int]:
    """The directory that holds the counted prefixes in buckets of at most capacity entries.

    spans: (prefix, bits, entries), disjoint; a span is as fine as was counted. A bucket over
    capacity is split by its next bit; when it already uses all bits of the directory, the directory
    doubles. Returns the directory's bits, the bucket of every slot and the number of buckets.
    """
    depth, buckets = 0, [(0, 0, spans)]
    done: list[tuple[int, int]] = []
    while buckets:
        prefix, bits, inside = buckets.pop()
        coarse = all(b <= bits for _, b, _ in inside)
        if sum(n for _, _, n in inside) <= capacity or coarse:
            done.append((prefix, bits))
            continue
        if bits == depth:
            depth += 1  # the directory doubles
        halves: tuple[list, list] = ([], [])
        for p, b, n in inside:
            halves[p >> (b - bits - 1) & 1].append((p, b, n))
        buckets += [(prefix * 2 + i, bits + 1, halves[i]) for i in (0, 1)]
    slots = [0] * (1 << depth)
    for number, (prefix, bits) in enumerate(sorted(done, key=lambda x: x[0] << (64 - x[1]))):
        first = prefix << (depth - bits)
        slots[first : first + (1 << (depth - bits))] = [number] * (1 << (depth - bits))
    return depth, slots, len(done)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")


def _histogram(entries: DataFrame, capacity: int, step: int, most: int) -> list:
    """Keys by leading bits; overfull prefixes are counted by more bits, round by round."""
    bits = step
    found = [
        (r["p"], bits, r["n"])
        for r in entries.groupBy(_prefix(bits).alias("p")).agg(F.count("*").alias("n")).collect()
    ]
    while bits < most:
        over = [p for p, b, n in found if b == bits and n > capacity]
        if not over:
            break
        deeper = bits + step
        inside = entries.filter(_prefix(bits).isin(over))
        rows = inside.groupBy(_prefix(deeper).alias("p")).agg(F.count("*").alias("n")).collect()
        found = [x for x in found if not (x[1] == bits and x[0] in set(over))]
        found += [(r["p"], deeper, r["n"]) for r in rows]
        bits = deeper
    return found


def exact_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    key=F.xxhash64,
    capacity: int = 16_384,
    most_slots: int = 1 << 16,
    step: int = 6,
    most_bits: int = 24,
) -> DataFrame:
    """One row per input row: its id, the id that stays, the group's size, whether it stays, its digest.

    Texts are equal when identical after lower-casing A-Z. Rows are written once as slim fingerprints
    (id, 64-bit key, digest). A histogram of the distinct keys' prefixes grows the directory; it says which bucket a fingerprint
    goes to. Owner tasks hold whole buckets: entries of one key are chained by digest, the largest id of an entry
    stays, and the finished buckets are files in the shared folder. A row asks the bucket of its key and finds its entry
    in the key's chain. Where a key occurs more than once, the texts themselves go to their bucket: entries
    of one chain hold identical bytes, or the job fails. Rows and texts of a bucket are combined over salts before they
    move to its owner, so a text that a third of all rows share arrives as a few entries.

    Nulls: a null text is an empty text; a null id is smaller than any other. Rows that repeat id and
    text are copies, one of which stays. An empty table gives no rows. A text of any length is hashed and
    compared whole. Other columns are not read. A bucket holds capacity keys, or more where there are over
    capacity * most_slots; keys are told apart by most_bits bits, beyond which buckets chain.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.col(text_col))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            key(norm).alias("h"),
            F.sha2(norm, 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "fingerprints",
    )
    keys = written(rows.select("h").distinct(), "keys")
    capacity = max(capacity, keys.count() // most_slots)
    depth, slots, buckets = split_directory(_histogram(keys, capacity, step, most_bits), capacity)
    bucket = F.get(constant(slots, "array<int>"), _prefix(depth).cast("int")).alias("bucket")
    owners = max(1, min(buckets, _tasks(spark)))

    salt = F.pmod(F.col("row"), F.lit(SALTS)).alias("salt")
    parts = rows.select(bucket, salt, "h", "text_sha256", "doc_id", "row")
    parts = parts.groupBy("bucket", "salt", "h", "text_sha256").agg(
        F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top")
    )
    entries = written(
        parts.repartition(owners, "bucket")
        .groupBy("bucket", "h", "text_sha256")
        .agg(F.sum("n").alias("group_size"), F.max("top").alias("top")),
        "entries",
    )
    # A table, not a grouping: only so may adaptive execution split the texts of a hot key in the join.
    shared = entries.groupBy("bucket", "h").agg(F.sum("group_size").alias("n")).filter("n > 1").select("h")
    texts = (
        docs.select(key(norm).alias("h"), norm.alias("norm"))
        .join(written(shared, "shared"), "h", "left_semi")
        # Not by h: so the join may split a hot key, and its texts are combined before they move on.
        .groupBy("norm")
        .agg(F.count("*").alias("n"), F.first("h").alias("h"))
    )
    compared = (
        texts.select(bucket, "h", F.sha2("norm", 256).alias("text_sha256"), "n")
        .repartition(owners, "bucket")
        .groupBy("bucket", "h", "text_sha256")
        .agg(F.count("*").alias("texts"), F.sum("n").alias("copies"))
    )
    differ = (F.coalesce("texts", F.lit(1)) > 1) | (F.coalesce("copies", "group_size") != F.col("group_size"))
    size = F.when(differ, F.raise_error(F.lit("texts of one digest differ")).cast("long")).otherwise(F.col("group_size"))
    entry = F.struct("text_sha256", size.alias("group_size"), F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"))
    index = written(
        entries.repartition(owners, "bucket")
        .join(compared, ["bucket", "h", "text_sha256"], "left")
        .groupBy("bucket", "h")
        .agg(F.array_sort(F.collect_list(entry)).alias("chain"))
        .sortWithinPartitions("bucket", "h"),
        "index",
    )
    asked = rows.select(bucket, "h", "text_sha256", "doc_id", "row")
    found = asked.join(index, ["bucket", "h"]).withColumn(
        "e", F.get(F.filter("chain", lambda e: e["text_sha256"] == F.col("text_sha256")), 0)
    )
    return found.select(
        "doc_id",
        F.col("e.keep_id").alias("keep_id"),
        F.col("e.group_size").alias("group_size"),
        (F.col("row") == F.col("e.keep_row")).alias("kept"),
        "text_sha256",
    )


#: Rows of one bucket are combined in so many parts before they move to its owner.
SALTS = 16


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that exact_copies keeps, with all their columns.

    Null and empty texts are one text, of which one row stays; so it is with rows that repeat id and text. An
    empty table stays empty; columns of any name are kept.
    """
    found = exact_copies(docs, id_col=id_col, text_col=text_col, **settings).filter("group_size > 1")
    return kept_rows(docs, found, id_col, F.sha2(ascii_lower(F.col(text_col)), 256), "text_sha256")
