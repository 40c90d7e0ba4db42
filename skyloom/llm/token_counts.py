"""Greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LongestMatch:
    """Number of pieces that greedy longest match cuts a word into, in one pass over its bytes.

    A node of the vocabulary's trie stands for the bytes read but not yet cut off. Its failure link leads to
    the node of what remains once the longest pieces at the front have been cut off, and popped is how many
    those are; both are settled beforehand, so neither pieces nor their ends are ever built. The
    vocabulary must hold every single byte.
    """

    def __init__(self, vocabulary: list[bytes], most_words: int = 500_000):
        self.next: dict[int, int] = {}
        ends, depth_one, n = set(), [], 1
        for piece in vocabulary:
            at = 0
            for byte in piece:
                to = self.next.get(at << 8 | byte)
                if to is None:
                    to = self.next[at << 8 | byte] = n
                    n += 1
                at = to
            ends.add(at)
        if any(b not in self.next or self.next[b] not in ends for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.fail, self.popped = [0] * n, [0] * n
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, to in self.next.items():
            below[key >> 8].append((key & 255, to))
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for byte, v in below[u]:
                queue.append(v)
                if v in ends:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                at, cut = self.fail[u], self.popped[u]
                while (to := self.next.get(at << 8 | byte)) is None:
                    cut += self.popped[at]
                    at = self.fail[at]
                self.fail[v], self.popped[v] = to, cut
        self.most_words, self.known = most_words, {}

    def pieces(self, word: bytes) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        at = cut = 0
        for byte in word:
            while (to := step.get(at << 8 | byte)) is None:
                cut += popped[at]
                at = fail[at]
            at = to
        while at:
            cut += popped[at]
            at = fail[at]
        return cut

    def total(self, words: list[str]) -> int:
        """Pieces of all words; the count of a word seen before is looked up."""
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.most_words:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.pieces(w.encode())
        return sum(map(known.__getitem__, words))


_MATCHERS: dict[str, tuple[LongestMatch, object]] = {}


def _matcher(vocabulary: str):
    if vocabulary not in _MATCHERS:
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            pieces = [base64.b64decode(x.split()[0]) for x in lines if x.strip()]
        _MATCHERS[vocabulary] = LongestMatch(pieces), regex.compile(public_tokenizers.PATTERN)
    return _MATCHERS[vocabulary]


def _counted(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, pattern = _matcher(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for x in batch.column("text"):
                words = pattern.findall(x.as_py() or "")
                n_words.append(len(words))
                n_tokens.append(matcher.total(words))
            counts = [pa.array(v, pa.int64()) for v in (n_words, n_tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *counts],
                names=["doc_id", "n_bytes", "n_words", "n_tokens"],
            )

    return run


def token_counts(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken"
) -> DataFrame:
    """One row per input row: id, bytes, words and greedy word pieces of its whole text.

    Words are the vocabulary's own pre-tokens (with the space before them). One pass, no shuffle; a text's count
    does not depend on other rows, so hot groups and repeated rows need no care. vocabulary names a rank
    file of the installed tokenizers. A null text counts as empty, with zeros; null ids stay. Other columns are not
    read, and an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _counted(vocabulary), f"doc_id {kind}, n_bytes bigint, n_words bigint, n_tokens bigint"
    )
