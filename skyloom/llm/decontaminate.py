"""Benchmark passages in documents through a prefix-filtered join of word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_key, unused, words_of, written


def benchmark_windows(
    docs: DataFrame, items: DataFrame, *, item_col: str, item_text: str, text_col: str, length: int
) -> DataFrame:
    """Distinct windows of the items that documents can hold, each with its rarest word.

    Columns: win (words), token, offset (of the token's first place in the window), items (ids). A word's
    rarity is its number of occurrences in the documents. A window with a word that no document holds
    is left out.
    """
    words = written(items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")), "items")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))))
    windows = (
        words.filter(F.size("w") > 0)
        .select("item", "w", start.alias("s"))
        .select("item", F.slice("w", F.col("s"), length).alias("win"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    vocabulary = words.select(F.explode("w").alias("word")).distinct()
    counts = (
        docs.select(F.explode(words_of(F.col(text_col))).alias("word"))
        .join(vocabulary, "word", "left_semi")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    placed = (
        windows.select("win", "items", F.posexplode("win").alias("offset", "word"))
        .join(counts, "word")
        .groupBy("win")
        .agg(
            F.first("items").alias("items"),
            F.count("*").alias("known"),
            F.min(F.struct("n", "word", "offset")).alias("rare"),
        )
        .filter(F.col("known") == F.size("win"))
    )
    return placed.select("win", "items", F.col("rare.word").alias("token"), F.col("rare.offset").alias("offset"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    length: int = 13,
    least_in: int = 20,
    most_windows: int = 200_000,
    with_key: bool = False,
) -> DataFrame:
    """One row per document: words, words hit by benchmark windows, items found, and whether contaminated.

    An item's windows are its runs of length words; a shorter item is one window. Containment of a whole
    window leaves a necessary prefix of one word, so only places of a window's rarest word are
    candidates. A candidate must leave room for the window on both sides (positional and length bounds)
    before its words are compared. with_key adds t, a digest of the text. A document is contaminated when at least one in least_in of its
    words is hit.

    Up to most_windows windows are broadcast and their rarest words filter the documents in the scan. Beyond
    that, every word is a candidate and the windows meet them in a shuffled join, dealt out over
    salts; results are the same. Documents shuffle as (row, words, hits), never as texts.

    Nulls: a null text has no words and is clean; a null item text has no windows; a null item id hits
    words but is not counted or listed. Repeated documents give a row each, repeated items count once. Empty
    tables give no rows, or clean documents. Other columns are not read.
    """
    windows = written(
        benchmark_windows(docs, items, item_col=item_col, item_text=item_text, text_col=text_col, length=length),
        "windows",
    )
    few = windows.count() <= most_windows
    tokens = [r[0] for r in windows.select("token").distinct().collect()] if few else []

    def place(w, i):
        before = F.least(i, F.lit(length - 1))
        context = F.slice(F.col("w"), i - before + 1, before + length)
        found = F.struct(i.alias("pos"), w.alias("token"), before.alias("before"), context.alias("context"))
        return F.when(w.isin(tokens), found) if few else found

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        *([text_key(F.col(text_col)).alias("t")] if with_key else []),
        words_of(F.col(text_col)).alias("w"),
    )
    ids = ["row", "doc_id", *(["t"] if with_key else []), "n_words"]
    places = F.filter(F.transform("w", place), lambda x: x.isNotNull())
    rows = rows.select(*ids[:-1], F.size("w").cast("long").alias("n_words"), places.alias("places"))
    rows = rows.select(*ids, F.explode_outer("places").alias("c")).select(*ids, "c.*")
    if few:
        found = rows.join(F.broadcast(windows), "token", "left")
    else:
        salts = 16
        dealt = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(salts)).cast("int"))
        found = rows.join(dealt, ["token", "salt"], "left")
    start = F.col("pos") - F.col("offset")
    end = start + F.size("win")
    fits = (F.col("before") >= F.col("offset")) & (end <= F.col("n_words"))
    same = F.slice("context", F.col("before") - F.col("offset") + 1, F.size("win")) == F.col("win")
    hit = F.when(fits, same)
    found = found.select(
        *ids,
        F.when(hit, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))).alias("span"),
        F.when(hit, F.col("items")).alias("items"),
    )
    documents = found.groupBy(*ids).agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))
    covered = F.aggregate(
        "spans",
        none,
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(x["end"] - F.greatest(x["start"], a["reach"]), F.lit(0))).alias("hit"),
            F.greatest(a["reach"], x["end"]).alias("reach"),
        ),
        lambda a: a["hit"],
    )
    return documents.select(
        *ids[1:],
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_in >= F.col("n_words"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Equal texts share one verdict.

    Null texts, and texts without words, stay; so do repeated rows. An empty table stays empty, and without items
    all rows stay. Columns of any name are kept.
    """
    found = contamination(docs, items, text_col=text_col, with_key=True, **settings).filter("contaminated")
    key = unused(docs, "_t")
    leaving = written(found.select(F.col("t").alias(key)).distinct(), "contaminated")
    return docs.join(leaving, text_key(F.col(text_col)) == F.col(key), "left_anti")
