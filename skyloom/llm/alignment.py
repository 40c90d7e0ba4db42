"""Alignment of two tokenizers over the distinct texts of a corpus, and how common each linked pair of ids is."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_key, written

#: A space between two other signs: the first tokenizer splits text there before it merges, the second has no
#: piece with a sign before its space. So both start a token there, and what follows is tokenised on its own.
BORDER = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Text that the rank encoder splits like the first tokenizer, whatever their libraries know of later letters.
LATIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")


@dataclass
class Words:
    """The alignment of many words, each led by a space; offsets into flat arrays, one more than words."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shown: list[str]
    pair_start: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


class Aligner:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str, joined: int = 2_000, large: int = 10_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.joined, self.large = joined, large
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        own = {c: i for i, c in enumerate(_byte_signs())}
        pieces = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        specials = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b"" if p in specials else bytes(own[c] for c in p) for p, _ in pieces]
        self.ranks = _rank_encoder(self.a, self.bytes_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("pieces of the second vocabulary cross words")
        self.bytes_b = [_piece_bytes(x) for x in names]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.shown_a = [str(i) for i in range(len(self.bytes_a))]
        self.shown_b = [str(i) for i in range(len(names))]
        self.base = len(names)

    def _ids(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of a space and text, and whether both tokenizers give its bytes back."""
        if self.ranks and LATIN.fullmatch(text):
            a = self.ranks.encode_ordinary(" " + text)
        else:
            a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1)
        whole = (" " + text).encode()
        same = b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
        return (a, b, True) if same else ([], [], False)

    def _portions(self, words: list[str], odd: set[str]) -> Iterator[list[int]]:
        """Places of words that are encoded as one text: Latin ones, others, and each odd one alone."""
        plain: list[int] = []
        other: list[int] = []
        for i, word in enumerate(words):
            if word in odd:
                yield [i]
            else:
                (plain if word.isascii() or LATIN.fullmatch(word) else other).append(i)
        for held in (plain, other):
            yield from (held[i : i + self.joined] for i in range(0, len(held), self.joined))

    def words(self, words: list[str], odd: set[str]) -> Words:
        """Aligns distinct words; one that does not come back from both tokenizers is not good.

        Odd are those that begin or end with space, so that they cannot be joined with others.
        """
        ids_a, ids_b, order = [], [], []
        good = np.ones(len(words), dtype=bool)
        for part in self._portions(words, odd):
            a, b, same = self._ids(" ".join([words[i] for i in part]))
            if same:
                ids_a.append(a)
                ids_b.append(b)
                order += part
                continue
            for i in part:
                a, b, good[i] = self._ids(words[i])
                ids_a.append(a)
                ids_b.append(b)
                order.append(i)
        a, b = (np.array(list(chain.from_iterable(p)), np.int64) for p in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        word_end = np.cumsum([len(words[i].encode()) + 1 if good[i] else 0 for i in order])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        if not np.isin(word_end[word_end > 0], common).all():
            raise ValueError("a token crosses words")
        groups, at = len(common), np.array(order, np.int64)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        owner = at[np.searchsorted(word_end, common)] if groups else np.zeros(0, np.int64)

        def summed(x: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=x, minlength=len(words)).astype(np.int64)

        pair_owner, pairs, times = self._pairs(a, b, in_a, in_b, owner)
        by = np.argsort(pair_owner, kind="stable")
        return Words(
            good,
            summed(in_a),
            summed(in_b),
            np.bincount(owner, minlength=len(words)),
            summed(in_a * in_b),
            self._shown(a, b, in_a, in_b, owner, len(words)),
            np.searchsorted(pair_owner[by], np.arange(len(words) + 1)),
            pairs[by],
            times[by],
        )

    def _pairs(self, a, b, in_a, in_b, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, id pair, links) of all groups; a large group's links are counted by distinct ids."""
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        size = in_a * in_b
        small = np.flatnonzero(size <= self.large)
        group = np.repeat(small, size[small])
        within = np.arange(len(group)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        left = a[start_a[group] + within // in_b[group]]
        right = b[start_b[group] + within % in_b[group]]
        owners, codes, times = [owner[group]], [left * self.base + right], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(size > self.large):
            x, n = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            codes.append((x[:, None] * self.base + y[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
            owners.append(np.full(len(codes[-1]), owner[g]))
        return np.concatenate(owners), np.concatenate(codes), np.concatenate(times)

    def _shown(self, a, b, in_a, in_b, owner, words: int) -> list[str]:
        """Every word's groups as text."""
        sa, sb = [self.shown_a[i] for i in a.tolist()], [self.shown_b[i] for i in b.tolist()]
        out: list[str] = [""] * words
        i = j = 0
        for n, m, w in zip(in_a.tolist(), in_b.tolist(), owner.tolist(), strict=True):
            if n == m == 1:
                one = f"{sa[i]}|{sb[j]}"
            else:
                one = f"{','.join(sa[i : i + n])}|{','.join(sb[j : j + m])}"
            i, j = i + n, j + m
            out[w] = f"{out[w]};{one}" if out[w] else one
        return out


def _rank_encoder(tokenizer, pieces: list[bytes]):
    """An encoder by ranks that gives the tokenizer's ids, or None if it would not.

    It joins whatever makes the token of least id, the tokenizer only what its merges name. Within a token the
    joins are those of its bytes alone, so both agree if, of every token, the last join is a merge, and the
    merges rise with the ids of what they make.
    """
    import public_tokenizers
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    ids = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [ids[x + y] for x, y in merges]
    own = {i: piece for piece, i in ids.items()}
    ranks = {x: i for i, x in enumerate(pieces) if x}
    named = set(merges)
    if made != sorted(made) or any(_last_join(ranks, pieces, own, i) not in named for i in made):
        return None
    return tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _last_join(ranks: dict[bytes, int], pieces: list[bytes], own: dict[int, str], token: int) -> tuple[str, ...]:
    """The two tokens that are joined last to make a token."""
    parts = [pieces[token][i : i + 1] for i in range(len(pieces[token]))]
    while len(parts) > 2:
        found = [ranks.get(x + y, token) for x, y in pairwise(parts)]
        at = found.index(min(found))
        if found[at] >= token:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(own[ranks[p]] for p in parts)


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    out, more = [], 0x100
    for i in range(256):
        prints = 0x21 <= i <= 0x7E or 0xA1 <= i <= 0xAC or 0xAE <= i <= 0xFF
        out.append(chr(i if prints else more))
        more += not prints
    return out


def _piece_bytes(piece: str) -> bytes:
    one = BYTE.fullmatch(piece)
    return bytes([int(one[1], 16)]) if one else piece.replace(SPACE, " ").encode()


@dataclass
class Measure:
    """What is known so far of one text."""

    sums: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    digest: object = None
    pairs: list = field(default_factory=list)
    good: bool = True


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(name_a: str, name_b: str) -> Aligner:
    if (name_a, name_b) not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import public_tokenizers

        _ALIGNERS[name_a, name_b] = Aligner(public_tokenizers.path(name_a), public_tokenizers.path(name_b))
    return _ALIGNERS[name_a, name_b]


def segments(text: str, most: int) -> Iterator[str]:
    """The text in parts of about most signs, cut at borders of words."""
    begin = 0
    while len(text) - begin > most:
        at = BORDER.search(text, begin + most)
        if at is None:
            break
        yield text[begin : at.start()]
        begin = at.end()
    yield text[begin:]


def measure_segments(aligner: Aligner, parts: list[tuple[Measure, str]]) -> None:
    """Adds the alignments of parts of texts to what is known of them; each distinct word is aligned once."""
    number: dict[str, int] = defaultdict(count().__next__)
    codes, odd = [], set()
    for _, text in parts:
        words = BORDER.split(text)
        codes.append(list(map(number.__getitem__, words)))
        odd.update(w for w in (words[0], words[-1]) if not w or w[0].isspace() or w[-1].isspace())
    found = aligner.words(list(number), odd)
    number.clear()
    table = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links])
    shown_of = found.shown.__getitem__
    for (to, _), places in zip(parts, codes, strict=True):
        code = np.array(places)
        to.good = to.good and bool(found.good[code].all())
        if not to.good:
            to.pairs.clear()
            continue
        to.sums += table[:, code].sum(axis=1)
        shown = ";".join(map(shown_of, places)).encode()
        if to.digest is None:
            to.digest = hashlib.sha256(shown)
        else:
            to.digest.update(b";" + shown)
        word, n = np.unique(code, return_counts=True)
        first, size = found.pair_start[word], found.pair_start[word + 1] - found.pair_start[word]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to.pairs.append(_combined(found.pairs[at], found.times[at] * np.repeat(n, size)))


def _combined(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, where = np.unique(codes, return_inverse=True)
    return one, np.bincount(where, weights=times, minlength=len(one)).astype(np.int64)


ALIGNED = (
    "portion bigint, t binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "at array<int>, links array<bigint>, pairs array<bigint>, held array<bigint>"
)


def _align(name_a: str, name_b: str, most_signs: int, most_pairs: int):
    """Rows of aligned texts, and for each portion of them a row of its distinct pairs.

    pairs and held (the documents that hold a pair) are set on the portion's row, at (places among the pairs)
    and links on the texts' rows.
    """
    schema = pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in ALIGNED.split(", "))])

    def rows_of(portion: int, texts: list[tuple[bytes, int, Measure]]) -> pa.RecordBatch:
        done = [_combined(*[np.concatenate(x) for x in zip(*m.pairs, strict=True)]) if m.pairs else _NONE for *_, m in texts]
        size = np.array([len(c) for c, _ in done], np.int64)
        codes, where = np.unique(np.concatenate([c for c, _ in done]), return_inverse=True)
        copies = np.repeat(np.array([n for _, n, _ in texts], np.int64), size)
        held = np.bincount(where, weights=copies, minlength=len(codes)).astype(np.int64)
        sums = np.array([m.sums if m.good else np.zeros(4, np.int64) for *_, m in texts])
        n, none = len(texts), pa.scalar(None, pa.int64())
        edges = np.concatenate([[0], np.cumsum(size)])
        shown = [m.digest.hexdigest() if m.good and m.digest is not None else "" for *_, m in texts]

        def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))
            return pa.concat_arrays([lists, pa.nulls(1, lists.type)])

        def alone(values: np.ndarray) -> pa.Array:
            return pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([values], pa.list_(pa.int64()))])

        columns = [pa.array([portion] * (n + 1), pa.int64()), pa.array([t for t, *_ in texts] + [None], pa.binary())]
        columns += [pa.array([*sums[:, i].tolist(), none.as_py()], pa.int64()) for i in range(4)]
        columns += [pa.array([*shown, None], pa.string())]
        columns += [listed(where, pa.int32()), listed(np.concatenate([x for _, x in done]), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, alone(codes), alone(held)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(name_a, name_b)
        portion = TaskContext.get().partitionId() << 32
        texts: list[tuple[bytes, int, Measure]] = []
        parts: list[tuple[Measure, str]] = []
        signs = pairs = 0
        for batch in batches:
            for t, copies, text in zip(*[batch.column(c) for c in ("t", "copies", "text")], strict=True):
                one = Measure()
                texts.append((t.as_py(), copies.as_py(), one))
                for part in segments(text.as_py(), most_signs) if text.as_py() else ():
                    parts.append((one, part))
                    signs += len(part)
                    if signs > most_signs:
                        measure_segments(aligner, parts)
                        pairs += sum(len(m.pairs[-1][0]) for m, _ in parts if m.pairs)
                        parts, signs = [], 0
                if not parts and pairs > most_pairs:
                    yield rows_of(portion, texts)
                    texts, pairs, portion = [], 0, portion + 1
        if parts:
            measure_segments(aligner, parts)
        if texts:
            yield rows_of(portion, texts)

    return run


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))
_ARROW = {
    "bigint": pa.int64(),
    "binary": pa.binary(),
    "string": pa.string(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
}
MEASURED = "t binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _measure(texts: pa.Table, needed: pa.Table) -> pa.Table:
    """The measures of a portion's texts from the counts of its pairs."""
    order = np.argsort(needed.column("pair").to_numpy())
    count = needed.column("count").to_numpy()[order]
    best = needed.column("best").to_numpy()[order]
    lists = texts.column("at").combine_chunks()
    at = lists.flatten().to_numpy()
    links = texts.column("links").combine_chunks().flatten().to_numpy()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())

    def summed(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(lists), np.int64)
        np.add.at(out, owner, values)
        return pa.array(out, pa.int64())

    found = {"n_best": summed(links * best[at]), "count_sum": summed(links * count[at])}
    return pa.table({name: found.get(name, texts[name] if name in texts.column_names else None) for name in (x.split()[0] for x in MEASURED.split(", "))})


def align_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_a: str = "byte_bpe_50k.json",
    tokenizer_b: str = "piece_bpe_32k.model",
    most_signs: int = 4_000_000,
    most_pairs: int = 1_000_000,
) -> DataFrame:
    """One row per input row: tokens of both tokenizers, their groups and links, and how common the linked ids are.

    Texts are shuffled whole, and copies fall together on the way: each distinct text is tokenised and aligned
    once, and its pairs count once for each of its documents. Byte offsets where tokens of both end
    cut the tokens into groups; tokens of a group are linked each with each. Texts are aligned in portions of bounded
    size. A portion gives its distinct pairs with the documents that hold them; they are added up over all
    portions, and each portion gets back the counts of its own pairs, by which its texts are measured.
    Measures then join the documents' ids.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros, and
    '' for groups_sha256. Rows that repeat id and text are documents of their own. An empty table gives no
    rows. A very long text is aligned in parts of most_signs signs. Other columns are not read.
    """
    texts = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    texts = texts.select(text_key(F.col("text")).alias("t"), "copies", "text")
    aligned = written(texts.mapInArrow(_align(tokenizer_a, tokenizer_b, most_signs, most_pairs), ALIGNED), "aligned")

    pairs = aligned.filter("t is null").select("portion", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    pairs = pairs.select("portion", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    base = _aligner(tokenizer_a, tokenizer_b).base
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.expr(f"pair div {base}"))
    counts = written(counts, "pairs")
    # At most one row for each id of the vocabulary.
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    needed = pairs.select(F.col("portion").alias("into"), "pair").join(counts, "pair")

    rows = aligned.filter("t is not null").drop("pairs", "held")
    measured = rows.groupBy("portion").cogroup(needed.groupBy("into")).applyInArrow(_measure, MEASURED)
    ids = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("t"))
    return ids.join(written(measured, "measured"), "t").drop("t")
