"""Near copies of documents through ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import kept_rows, text_key, totals, unwritten, written

U = np.uint64
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 32
BASE, BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"n": np.ones(1, U), "back": np.ones(1, U)}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["n"]) < n:
        for name, base in (("n", BASE), ("back", BACK)):
            steps = np.full(n, base, U)
            steps[0] = U(1)
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["n"], _POWERS["back"]


def shingles_of(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (index of the text, hash, count), by text and hash.

    A word is a run of ASCII letters and digits or anything beyond ASCII, A-Z lower-cased. A text of fewer
    words than a shingle has one shingle, all its words. Word hashes come from differences of a running
    polynomial over the bytes of all texts.
    """
    coded = [t.encode() for t in texts]
    data = LOWER_BYTE[np.frombuffer(b" " + b" ".join(coded) + b" ", dtype=np.uint8)]
    edges = np.cumsum([1] + [len(c) + 1 for c in coded])
    inside = WORD_BYTE[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    power, back = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=run[1:])
    word = mixed((run[end] - run[start]) * back[start])
    doc = np.searchsorted(edges, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))

    at = np.arange(max(0, len(word) - words + 1))
    at = at[doc[at] == doc[at + words - 1]] if len(at) else at
    total = np.zeros(len(at), U)
    for i in range(words):
        total = mixed(total + word[at + i] * U(2 * i + 3))
    owner = doc[at]
    first = np.cumsum(n_words) - n_words
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        more = np.zeros(len(short), U)
        for i in range(words - 1):
            has = n_words[short] > i
            more[has] = mixed(more[has] + word[first[short[has]] + i] * U(2 * i + 3))
        total, owner = np.concatenate([total, more]), np.concatenate([owner, short])
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    place = np.flatnonzero(new)
    return owner[place], total[place], np.diff(np.append(place, len(total)))


def prob_minhash(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts x size): two agree in a place with the probability Jaccard similarity of the sets.

    An element of weight w sends arrivals of a Poisson process of rate w, each to a random place; a place
    keeps the element that came first. Arrivals are drawn from the element's hash, in order of time,
    and an element stops as soon as its next one is later than the latest first arrival of its text.
    """
    first = np.full(texts * size, np.inf)
    kept = np.zeros(texts * size, U)
    active, time, drawn = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(active):
        times = max(1, min(256, 30_000 // len(active)))
        step = np.arange(drawn, drawn + times, dtype=U) * U(0xD1B54A32D192ED03)
        bits = mixed(hashes[active, None] + step[None, :] + U(1))
        gaps = -np.log(((bits >> U(11)).astype(np.float64) + 0.5) / float(1 << 53))
        times_at = time[active, None] + np.cumsum(gaps / weight[active, None], axis=1)
        place = (mixed(bits + U(0x2545F4914F6CDD1D)) % U(size)).astype(np.int64) + (owner[active] * size)[:, None]
        latest = first.reshape(texts, size).max(axis=1)[owner[active]]
        on = times_at < latest[:, None]
        t, p = times_at[on], place[on]
        np.minimum.at(first, p, t)
        won = t == first[p]
        kept[p[won]] = np.broadcast_to(hashes[active, None], on.shape)[on][won]
        time[active] = times_at[:, -1]
        drawn += times
        active = active[on[:, -1]]
    return kept.reshape(texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=U) * BASE, (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        keys = mixed(keys + parts[:, :, i])
    return keys.view(np.int64)


PLANES = 4


def bit_planes(signature: np.ndarray) -> np.ndarray:
    """PLANES bits of each place, as numbers of 64 places: those of one plane lie PLANES apart.

    Places beyond the end are equal for all.
    """
    texts, size = signature.shape
    padded = np.zeros((texts, -(-size // 64) * 64), U)
    padded[:, :size] = mixed(signature)
    places = padded.reshape(texts, -1, 64)
    shifts = np.arange(64, dtype=U)[None, None, :]
    planes = [np.bitwise_or.reduce((places >> U(p) & U(1)) << shifts, axis=2) for p in range(PLANES)]
    return np.stack(planes, axis=2).reshape(texts, -1).view(np.int64)


def _portions(batch: pa.RecordBatch, most_bytes: int = 500_000, most_rows: int = 1000):
    """Slices of a batch of bounded size, with their texts."""
    begin, held, texts = 0, 0, []
    for i, x in enumerate(batch.column("text")):
        text = x.as_py() or ""
        if texts and (held + len(text) > most_bytes or len(texts) == most_rows):
            yield batch.slice(begin, len(texts)), texts
            begin, held, texts = i, 0, []
        held += len(text)
        texts.append(text)
    if texts:
        yield batch.slice(begin, len(texts)), texts


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32()), pa.array(values, pa.int64())
    )


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _portions(batch):
                owner, hashes, _ = shingles_of(texts, words)
                sig = prob_minhash(owner, hashes, np.ones(len(hashes)), len(texts), bands * rows)
                n = np.bincount(owner, minlength=len(texts))
                keys = band_keys(sig, bands, rows)[n > 0]
                bits = bit_planes(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "row", "t")),
                        pa.array(n, pa.int64()),
                        _lists(keys.ravel(), np.where(n > 0, bands, 0)),
                        _lists(bits.ravel(), np.full(len(texts), bits.shape[1])),
                    ],
                    names=["doc_id", "row", "t", "n", "bands", "bits"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _portions(batch):
                owner, hashes, _ = shingles_of(texts, words)
                n = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("t"), _lists(hashes.view(np.int64), n)], names=["t", "shingles"]
                )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): large-star and small-star until nothing changes.

    Each round is joins and minima by node; state lives in written tables.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        unwritten(old)
        seen = totals(now, F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003))
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    bands: int = 25,
    rows: int = 5,
    block: int = 256,
) -> DataFrame:
    """One row per input row: its id, the id and size of its class, and whether it is the row that stays.

    Texts are linked when the Jaccard similarity of their sets of word shingles is at least similarity;
    classes are the connected components, named after their least id. Signatures weigh all distinct shingles
    alike, as the similarity does; bands * rows places give candidates: a pair at 0.8 shares no band
    with a probability of 5e-5, however often its shingles repeat. Of them, pairs stay whose sizes allow the similarity and whose signatures, 4 bits a
    place, estimate no less than five standard errors below it. Every link is verified on the whole shingle sets.

    Equal texts are one node, so copies never meet each other. In a bucket of the banding all members are
    verified against one leader first, and the links contracted to components. Members that still have a candidate
    in another component are verified block against block within their bucket, in bounded groups that give back
    no more links than members. No bucket is cut.

    A null text is an empty text; texts without words are linked with equal texts only. A null id names a class
    only if it has no other. Of rows that repeat id and text, one stays. An empty table gives no rows.
    Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        text_key(F.col(text_col)).alias("t"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kind = texts.schema["doc_id"].dataType.simpleString()
    sketch = written(
        texts.mapInArrow(
            _sketch(words, bands, rows),
            f"doc_id {kind}, row bigint, t binary, n bigint, bands array<bigint>, bits array<bigint>",
        ),
        "sketch",
    )
    nodes = written(
        sketch.groupBy("t").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "nodes"
    )
    members = nodes.select("t", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    crowded = members.join(shared, "key").join(nodes.select("t", "bits"), "t")
    near = _near(similarity, bands * rows)
    crowded = written(crowded.withColumn("root", F.col("t")), "crowded")
    crowded = written(_with_partner(crowded, near), "candidates")

    # One text of each key; copies fall together before they move on.
    needed = crowded.select("t").distinct()
    sets = written(
        texts.groupBy("t")
        .agg(F.first("text").alias("text"))
        .join(needed.hint("merge"), "t", "left_semi")
        .mapInArrow(_sets(words), "t binary, shingles array<bigint>"),
        "sets",
    )
    links = written(_verified(_led(crowded, near), sets, similarity), "links")
    roots = written(components(links), "roots").withColumnRenamed("node", "t")
    rest = crowded.drop("root").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
    rest = written(_with_partner(written(rest, "rooted"), near), "open")
    more = _across_blocks(rest, sets, similarity, block)
    roots = written(components(links.unionByName(more)), "roots").withColumnRenamed("node", "t")

    classes = sketch.select("doc_id", "row", "t").join(roots, "t", "left")
    classes = written(classes.select("doc_id", "row", "t", F.coalesce("root", "t").alias("root")), "classes")
    heads = classes.groupBy("root").agg(
        F.count("*").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"),
    )
    # As a table, so that adaptive execution may split the rows of a large class.
    return classes.join(written(heads, "heads"), "root").select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("head.row")).alias("kept"),
        "t",
    )


def _near(similarity: float, places: int):
    """Whether two rows (n, bits, root) may be similar, by sizes and signatures, and are not in one component."""
    chance = 0.5**PLANES
    equal = similarity + (1 - similarity) * chance
    error = math.sqrt(equal * (1 - equal) / places) / (1 - chance)
    most = places * (1 - (similarity - 5 * error)) * (1 - chance)

    def unequal(a: str, b: str, word: int):
        differ = [
            F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))
            for i in range(word * PLANES, (word + 1) * PLANES)
        ]
        return F.bit_count(reduce(Column.bitwiseOR, differ))

    def near(a: str, b: str):
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        parts = [unequal(a, b, word) for word in range(-(-places // 64))]
        alike = F.least(na, nb) >= F.greatest(na, nb) * (similarity - 1e-9)
        return (F.col(f"{a}.root") != F.col(f"{b}.root")) & alike & (sum(parts[1:], parts[0]) <= most)

    return near


def _with_partner(rest: DataFrame, near) -> DataFrame:
    """The rows of buckets that have a candidate in their bucket."""
    other = rest.select("key", "n", "bits", "root")
    return rest.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & near("x", "y"), "left_semi")


def _led(rest: DataFrame, near) -> DataFrame:
    """Each member of a bucket with the bucket's leader, the least in an order that all buckets share."""
    lead = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("t").alias("o"), "t")).alias("l")).select("key", F.col("l.t").alias("t"))
    lead = lead.join(rest, ["key", "t"])
    met = rest.alias("x").join(lead.alias("y"), (F.col("x.key") == F.col("y.key")) & near("x", "y"))
    return met.select(F.least("x.t", "y.t").alias("a"), F.greatest("x.t", "y.t").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left = sets.select(F.col("t").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("t").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    return both.filter(F.col("c") >= (F.col("na") + F.col("nb") - F.col("c")) * similarity - 1e-9).select("a", "b")


def _across_blocks(rest: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between components: the members of a bucket in blocks, each pair of blocks one group."""
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rest.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rest.select("key", "t", "root").join(blocks, "key").join(sets, "t")
    own = F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "t", "root", "shingles")
    group = ["key", "lo", "hi"]
    rows = rows.repartition(tasks, *group).sortWithinPartitions(*group)
    return rows.mapInPandas(_linked(similarity), "a binary, b binary").distinct()


def _linked(similarity: float):
    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        """(lo, hi, own, t, root, shingles): links that join components, at most one for each member."""
        sizes = np.array([len(r[5]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, at, counts = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
        often = counts >= 2
        column = np.cumsum(often) - 1
        use = often[at]
        owner, column = owner[use], column[at[use]]
        shared = np.zeros((len(rows), len(rows)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            lo, hi = np.searchsorted(column, [start, start + 8192])
            part = np.zeros((len(rows), 8192), np.float32)
            part[owner[lo:hi], column[lo:hi] - start] = 1
            shared += part @ part.T
        alike = shared >= (sizes[:, None] + sizes[None, :] - shared) * similarity - 1e-6
        parent: dict[bytes, bytes] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            a, b = root(rows[i][4]), root(rows[j][4])
            if a != b:
                parent[b] = a
                yield rows[i][3], rows[j][3]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, rows = [], None, []
        for part in parts:
            for row in part.itertuples(index=False, name=None):
                if row[:3] != key:
                    if rows:
                        out += links(rows)
                    key, rows = row[:3], []
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=["a", "b"])
                        out = []
                rows.append(row[1:])
        if rows:
            out += links(rows)
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that near_copies keeps, with all their columns.

    Null and empty texts are one text, of which one row stays; of rows that repeat id and text one stays. An
    empty table stays empty; columns of any name are kept.
    """
    found = near_copies(docs, id_col=id_col, text_col=text_col, **settings).filter("class_size > 1")
    return kept_rows(docs, found, id_col, text_key(F.col(text_col)), "t")
