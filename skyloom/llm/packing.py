"""Packing of tokenised documents into sequences of bounded length by best fit."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from skyloom.llm.common import constant, count_at_most, written

#: Text whose normal form and word borders need no tables beyond Latin; other text takes the library's own path.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ]*")
LETTER, DIGIT = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")


class WordIds:
    """Token ids of a text as little-endian bytes; a word's ids are looked up once.

    The vocabulary's merges never cross words, so a plain text's ids are those of its words in order. Words come
    lower-cased and split, so their encoder needs no more than the merges; the whole one is loaded for the
    first other text.
    """

    def __init__(self, path: str, most_words: int = 100_000, joined: int = 1000):
        self.path, self.most_words, self.joined = path, most_words, joined
        self.known: dict[str, bytes] = {}
        self.whole: Tokenizer | None = None
        self.word_encoder = Tokenizer.from_file(path)
        self.word_encoder.normalizer = None
        self.word_encoder.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = getattr(self.word_encoder.model, "end_of_word_suffix", None) or ""
        vocabulary = self.word_encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = bool(suffix)

    def _encoded(self, text: str):
        if self.whole is None:
            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0]

    def _learn(self, words: list[str]) -> None:
        """Encode many words as one text; each stays a word of its own between spaces."""
        for start in range(0, len(words), self.joined):
            part = words[start : start + self.joined]
            found = self.word_encoder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                ids, ends = ids.tobytes(), [0, *(ends * 4).tolist()]
                self.known.update(zip(part, [ids[a:b] for a, b in pairwise(ends)], strict=True))
            else:
                for word in part:
                    self.known[word] = np.asarray(self._encoded(word).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return np.asarray(self._encoded(text).ids, dtype="<u4").tobytes()
        words = WORD.findall(text.lower())
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most_words:
                self.known.clear()
                new = set(words)
            self._learn(list(new))
        return b"".join(map(self.known.__getitem__, words))


_ENCODERS: dict[str, WordIds] = {}


def _encoder(vocabulary: str) -> WordIds:
    if vocabulary not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import public_tokenizers

        _ENCODERS[vocabulary] = WordIds(public_tokenizers.path(vocabulary))
    return _ENCODERS[vocabulary]


PIECES = "row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(vocabulary: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            out: dict[str, list] = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for at, text in enumerate(batch.column("text")):
                ids = encoder.ids(text.as_py() or "") + end
                for piece, start in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[start : start + capacity * 4]
                    for k, v in zip(out, (at, piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
            at = pa.array(out.pop("at"), pa.int32())
            kept = [batch.column(name).take(at) for name in ("doc_id", "row")]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            rest = [pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *rest], names=["doc_id", "row", *out])

    return cut


def pieces_of(
    docs: DataFrame, *, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int
) -> DataFrame:
    """One row per piece of a document's ids: at most capacity ids, the end id included."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut(vocabulary, capacity, end_id), f"doc_id {kind}, {PIECES}")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best fit over classes of equal length, the longest first, as bulk steps.

    Documents of one length are alike, and so are the gaps of one size; a step meets the documents of a
    length with the smallest gaps that hold them (their successors in the order of sizes), gives them out by
    rank, and shrinks the gaps. This is what placing one document after the other gives.
    Returns (length, first rank, first sequence, documents a sequence, offset) per run of ranks, and the
    number of sequences. The work depends on the number of lengths, not of documents.
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    placed, opened = [], 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap = capacity
                n = -(-left // (capacity // length))
                first, opened = opened, opened + n
            each = gap // length
            full = min(n, left // each)
            if full:
                placed.append((length, rank, first, each, capacity - gap))
                free(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                placed.append((length, rank, first + full, left, capacity - gap))
                free(gap - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            free(gap, first + full, n - full)
    return placed, opened


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    capacity: int = 4096,
    end_id: int = 1,
    rank_rows: int = 200_000,
) -> DataFrame:
    """One row per piece of a document: its place (sequence and offset) in sequences of capacity ids.

    Documents become pieces of at most capacity ids in one pass (a document's ids, then end_id). Pieces are
    sorted by length; best_fit sweeps over the counts of lengths, at most capacity numbers; a piece finds its
    place by its rank among the pieces of its length. Ranks are counted in cells (length, hash) of about
    rank_rows rows and moved up by the cells before, so one length may hold any part of all pieces.

    A null text is empty and gives one piece, the end id. A null or repeated id is kept as it is; every row is a
    document of its own. An empty table gives no rows. Other columns are not read.
    """
    pieces = written(
        pieces_of(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, capacity=capacity, end_id=end_id),
        "pieces",
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    placed, _ = best_fit(counts, capacity)
    cells = max(64, sum(counts.values()) // rank_rows)
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("row", "piece"), F.lit(cells)).cast("int"))
    before = (
        pieces.groupBy("length", "cell")
        .agg(F.count("*").alias("n"))
        .select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    )
    ranked = (
        pieces.withColumn("in_cell", F.row_number().over(Window.partitionBy("length", "cell").orderBy("row", "piece")))
        .join(before, ["length", "cell"])
        .withColumn("rank", F.col("before") + F.col("in_cell") - 1)
    )
    placed.sort()
    keys = constant([{"a": p[0], "b": p[1]} for p in placed], "array<struct<a:bigint,b:bigint>>")
    runs = constant(
        [{"first": p[1], "sequence": p[2], "each": p[3], "offset": p[4]} for p in placed],
        "array<struct<first:bigint,sequence:bigint,each:bigint,offset:bigint>>",
    )
    key = F.struct(F.col("length").alias("a"), F.col("rank").alias("b"))
    found = ranked.withColumn("at", count_at_most(keys, len(placed), key) - 1)
    found = found.withColumn("run", F.get(runs, F.col("at")))
    step = F.col("rank") - F.col("run.first")
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.sequence") + F.floor(step / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.offset") + F.pmod(step, F.col("run.each")) * F.col("length")).alias("offset"),
    )
