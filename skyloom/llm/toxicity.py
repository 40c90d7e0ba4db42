"""Toxicity scores by weak supervision: voters, a generative label model and a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import constant, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
CAPS, MARKS, REPEAT = re.compile(r"\b[^\W\d_a-zß-ÿ]{3,}\b"), re.compile(r"[!?]{2,}|[#$%&*]{2,}"), re.compile(r"\b(\w{2,}) \1\b")
#: Voters besides the lexicons: share of shouted words, runs of marks, doubled words.
PATTERNS = ("shouting", "marks", "doubled")
SILENT = "silent"


#: Steps of the share of marked words, for the classifier.
SHARES = (0.002, 0.005, 0.01, 0.015)


def patterns_of(text: str) -> list[bool]:
    n = 1 + text.count(" ")
    return [len(CAPS.findall(text)) > 0.2 * n, len(MARKS.findall(text)) > 0.05 * n, bool(REPEAT.search(text))]


#: A feature is dense in a text that has it at least twice and in this share of its words.
DENSE = 0.005


def features_of(text: str) -> list[str]:
    """Words of the whole text, lower-cased, and their prefixes (marked *); once more marked ^ where dense."""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    for n in PREFIXES:
        counts.update([w[:n] + "*" for w in words if len(w) >= n])
    least = max(2, DENSE * len(words))
    return [*counts, *[f + "^" for f, k in counts.items() if k >= least]]


@dataclass
class Model:
    """What tells a text's votes and classifier columns: the voters' lexicons and the features."""

    lexicons: list[list[str]]
    features: list[str]
    index: dict[str, int] = field(default_factory=dict)

    def ready(self) -> Model:
        if not self.index:
            self.index = {f: i for i, f in enumerate(self.features)}
            bare = {f.rstrip("^") for f in self.features}
            self.words = {f for f in bare if not f.endswith("*")}
            self.prefixes = {n: {f[:-1] for f in bare if len(f) == n + 1 and f.endswith("*")} for n in PREFIXES}
            self.voter = {f: i for i, lexicon in enumerate(self.lexicons) for f in lexicon}
            marks = {f.rstrip("^") for lexicon in self.lexicons for f in lexicon}
            self.stems = tuple(f[:-1] for f in marks if f.endswith("*"))
            self.marks = {f for f in marks if not f.endswith("*")}
        return self

    def found(self, text: str) -> tuple[set[str], float]:
        """The features a text has, and the share of its words that some lexicon holds."""
        words = WORD.findall(text.lower())
        distinct = set(words)
        hit = distinct & self.words
        for n, known in self.prefixes.items():
            if known:
                hit.update([p + "*" for p in known.intersection([w[:n] for w in distinct])])
        if not hit:
            return hit, 0.0
        counts = Counter(words)
        least = max(2, DENSE * len(words))
        out, marked = set(), 0
        for f in hit:
            k = sum(c for w, c in counts.items() if w.startswith(f[:-1])) if f.endswith("*") else counts[f]
            out.update([f, f + "^"] if k >= least else [f])
        for w, c in counts.items():
            if w in self.marks or w.startswith(self.stems):
                marked += c
        return out.intersection(self.index), marked / len(words)

    def votes(self, found: tuple[set[str], float], text: str) -> int:
        bits = sum(1 << i for i in {self.voter[f] for f in found[0] if f in self.voter})
        rest = [*patterns_of(text), not bits]
        return bits | sum(1 << (len(self.lexicons) + i) for i, on in enumerate(rest) if on)

    def columns(self, found: tuple[set[str], float], text: str) -> list[int]:
        """Places of the ones among features, patterns, and steps of the share of marked words."""
        rest = [*patterns_of(text), *[found[1] >= s for s in SHARES]]
        return [self.index[f] for f in found[0]] + [len(self.features) + i for i, on in enumerate(rest) if on]

    def width(self) -> int:
        return len(self.features) + len(PATTERNS) + len(SHARES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of documents with each feature, toxic and other, combined in the task as far as memory is bounded."""
    held: dict[str, list[int]] = {}

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), *[pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1)]],
            names=["feature", "other", "toxic"],
        )
        held.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            for f in features_of(text.as_py() or ""):
                held.setdefault(f, [0, 0])[toxic.as_py()] += 1
            if len(held) > 500_000:
                yield flush()
    if held:
        yield flush()


EVIDENCE = "held_out boolean, pick bigint, votes bigint, x array<int>"


def _evidence(model: Model):
    """The votes and classifier columns of each text, which then stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.ready()
        for batch in batches:
            votes, x = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = model.found(text)
                votes.append(model.votes(found, text))
                x.append(model.columns(found, text))
            kept = [batch.column(c) for c in ("doc_id", "held_out", "pick")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(votes, pa.int64()), pa.array(x, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "pick", "votes", "x"],
            )

    return run


#: Least log-likelihood ratio of a feature that tells toxic documents.
LEAST_GAIN = 8.0


def choose_lexicons(stats: list[tuple[str, int, int]], others: int, toxic: int, voters: int) -> tuple[list[list[str]], list[str]]:
    """Lexicons of features far likelier in toxic documents, and the classifier's features.

    Features are ranked by their log-likelihood ratio. One that starts another chosen one, or that another
    starts, tells the same. Each of the first becomes a lexicon of its own, later ones are dealt out.
    """
    def gain(o, t):
        p = (t + o) / (others + toxic)
        g = 0.0
        for k, n in ((o, others), (t, toxic)):
            for x, q in ((k, p), (n - k, 1 - p)):
                if x and q:
                    g += x * math.log(x / (n * q))
        return g

    ranked = sorted(stats, key=lambda s: (-round(gain(s[1], s[2]), 6), -len(s[0]), s[0]))
    chosen: list[str] = []
    for f, o, t in ranked:
        bare = f.rstrip("*^")
        told = gain(o, t) >= LEAST_GAIN and t / toxic > 9 * o / max(others, 1)
        if told and not any(bare.startswith(c.rstrip("*^")) or c.rstrip("*^").startswith(bare) for c in chosen):
            chosen.append(f)
    lexicons: list[list[str]] = [[] for _ in range(min(voters, len(chosen)))]
    for i, f in enumerate(chosen):
        lexicons[i % voters].append(f)
    return lexicons, [f for f, _, _ in ranked]


def votes_of(bits: np.ndarray, voters: int) -> np.ndarray:
    return ((bits[:, None] >> np.arange(voters)) & 1).astype(float)


def correlations(v: np.ndarray, weights: list[np.ndarray], rate: np.ndarray) -> np.ndarray:
    """The larger of the voters' correlations within the two classes, without those with themselves."""
    found = np.zeros((v.shape[1], v.shape[1]))
    for w, r in zip(weights, rate, strict=True):
        off = (v - r) / np.sqrt(r * (1 - r))
        found = np.maximum(found, (off * w[:, None]).T @ off / max(w.sum(), 1))
    np.fill_diagonal(found, 0)
    return found


def label_model(
    bits: np.ndarray, counts: np.ndarray, start: np.ndarray, known: tuple[float, float], shared: np.ndarray, rounds: int = 30
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxicity for each vote pattern, and the voters' rates of firing in (other, toxic).

    A voter that does not fire abstains: only votes are evidence, and so is that no lexicon fired (the voter
    SILENT). Rates are fitted by expectation maximisation. start has the rates among the labelled documents,
    known their numbers, which weigh along with all others. shared are the voters' correlations
    within the labelled classes; those left within the fitted classes are measured too, and the larger holds. A
    vote counts for 1 / (1 + its correlations with the other votes of the pattern), so that voters that repeat each
    other do not add up; then the fit is repeated.
    """
    v = votes_of(bits, start.shape[1])
    rate, prior = start.copy(), known[1] / sum(known)
    weight = v / (1 + v @ np.clip(shared, 0, 1))
    post = np.zeros(len(bits))
    for outer in range(3):
        for _ in range(rounds):
            log = [np.log(prior if c else 1 - prior) + weight @ np.log(rate[c]) for c in (0, 1)]
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
            for c, p in ((0, 1 - post), (1, post)):
                w = p * counts
                rate[c] = np.clip((w @ v + known[c] * start[c]) / (w.sum() + known[c]), 1e-5, 1 - 1e-5)
            prior = float(np.clip((post @ counts + known[1]) / (counts.sum() + sum(known)), 1e-4, 0.5))
        if outer == 2:
            break
        left = correlations(v, [(1 - post) * counts, post * counts], rate)
        weight = v / (1 + v @ np.clip(np.maximum(shared, left), 0, 1))
    return post, rate


#: Rows of the sample that are spelled out at a time.
BLOCK = 1000


def spelled_out(places: np.ndarray, start: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of rows of ones at places, with a last column of ones; start has the rows' borders."""
    for first in range(0, len(start) - 1, BLOCK):
        rows = slice(first, min(first + BLOCK, len(start) - 1))
        borders = start[first : rows.stop + 1]
        a = np.zeros((len(borders) - 1, width + 1))
        a[np.repeat(np.arange(len(a)), np.diff(borders)), places[borders[0] : borders[-1]]] = 1
        a[:, -1] = 1
        yield rows, a


def linear_fit(
    places: np.ndarray, start: np.ndarray, width: int, y: np.ndarray, penalty: float = 1.0, rounds: int = 25
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; places of all rows' ones lie one after the other.

    Memory is that of width**2 sums and a block of rows.
    """
    w = np.zeros(width + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        curve, slope = np.diag(ridge), ridge * w
        for rows, a in spelled_out(places, start, width):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            slope += a.T @ (p - y[rows])
            curve += a.T @ (a * (p * (1 - p) + 1e-9)[:, None])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _gain(others: int, toxic: int) -> Column:
    """The log-likelihood ratio of a feature in o of the other and t of the toxic documents."""
    p = (F.col("o") + F.col("t")) / float(max(others + toxic, 1))

    def part(x: Column, n: Column, q: Column) -> Column:
        return F.when((x > 0) & (q > 0), x * F.log(x / (n * q))).otherwise(0.0)

    total = F.lit(0.0)
    for name, n in (("o", others), ("t", toxic)):
        x, n = F.col(name).cast("double"), F.lit(float(n))
        total = total + part(x, n, p) + part(n - x, n, 1 - p)
    return total


def chosen_model(train: DataFrame, *, voters: int, least: int) -> Model:
    """Lexicons and features from train (text, toxic): every feature whose gain is large enough."""
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    others, toxic = totals.get(0, 0), totals.get(1, 0)
    counts = train.mapInArrow(_features, "feature string, other bigint, toxic bigint").groupBy("feature")
    counts = counts.agg(F.sum("other").alias("o"), F.sum("toxic").alias("t")).filter(F.col("t") >= least)
    share = (F.col("t") + 0.1) / (toxic + 1) / ((F.col("o") + 0.1) / (others + 1))
    told = counts.filter((share > 3) & (_gain(others, toxic) >= LEAST_GAIN))
    lexicons, names = choose_lexicons([(r["feature"], r["o"], r["t"]) for r in told.collect()], others, toxic, voters)
    return Model(lexicons, names).ready()


def fitted_weights(model: Model, patterns: DataFrame, train: DataFrame) -> tuple[list[float], float]:
    """Classifier weights and bias: patterns (votes, n) of all documents, train (votes, x, toxic) of the sample."""
    k = len(model.lexicons) + len(PATTERNS) + 1
    rows = patterns.collect()  # at most 2**(voters + 4)
    bits, seen = np.array([r["votes"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    # Bounded by fit_rows, a few numbers each; in one order, so that sums are the same in every run.
    sample = train.select("votes", F.sort_array("x").alias("x"), "toxic").toArrow()
    if not sample.num_rows:
        return [0.0] * model.width(), -3.0
    rows = sorted(zip(*(sample[c].to_pylist() for c in ("votes", "x", "toxic")), strict=True))
    votes, y = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], float)
    borders = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    places = np.fromiter(chain.from_iterable(r[1] for r in rows), np.int32, borders[-1])
    on, toxic = votes_of(votes, k), y.sum()
    start = np.stack([(on[y == c].sum(0) + 0.02 + 0.2 * c) / ((y == c).sum() + 1) for c in (0, 1)]).clip(1e-4, 0.99)
    shared = correlations(on, [1 - y, y], start)
    post, _ = label_model(bits, seen, start, (len(y) - toxic + 0.95, toxic + 0.05), shared)
    known = dict(zip(bits.tolist(), post.tolist(), strict=True))
    weights, bias = linear_fit(places, borders, model.width(), np.array([known.get(v, 0.0) for v in votes.tolist()]))
    return weights.tolist(), bias


def _sample_bound(labelled: Callable[[DataFrame], DataFrame], rows: DataFrame, fit_rows: int) -> int:
    """Below which hash at most fit_rows labelled rows lie; rows that repeat id and text are in or out together."""
    top = (1 << 63) - 1
    n = labelled(rows.select("doc_id", "held_out")).count()
    if n <= fit_rows:
        return top
    near = -(1 << 63) + int(min(1.0, 1.1 * fit_rows / n) * (1 << 32)) * (1 << 32) - 1
    counts = labelled(rows.select("doc_id", "held_out", "pick").filter(F.col("pick") < near)).groupBy("pick")
    # About fit_rows numbers: one for each distinct row.
    taken = 0
    for r in sorted(counts.agg(F.count("*").alias("n")).collect(), key=lambda r: r["pick"]):
        taken += r["n"]
        if taken > fit_rows:
            return r["pick"]
    return near


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
    folds: int = 5,
    fit_rows: int = 20_000,
    voters: int = 13,
    least: int = 3,
) -> DataFrame:
    """One row per input row: id, whether it was held out, a score from 0 to 1, and the predicted label.

    Rows whose crc32(id) mod folds is 0 are held out and lend no label. Lexicon voters are words and word
    prefixes that mark toxic texts among at most fit_rows labelled rows (those of least hash of id and text); pattern voters look at
    shouting, marks and doubled words. A generative model of the votes of all documents estimates the voters' rates and
    correlations; a linear classifier over words, prefixes and patterns learns its posteriors on
    the sampled rows and scores every whole text. Texts are read once for the sample and once for all evidence. Only
    the text is an input of a score.

    A null text counts as empty and takes the classifier's base rate; a null id is not held out and has no
    label; of contradicting labels the toxic one counts; repeated rows score alike. Without labels all scores are
    low. An empty table gives no rows. Other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    pick = F.xxhash64(F.lit("fit"), F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), pick.alias("pick"), F.col(text_col).alias("text"))
    known = labels.groupBy(F.col(label_id).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = written(known.filter("toxic is not null"), "toxic-labels")

    def labelled(df: DataFrame) -> DataFrame:
        return df.filter("not held_out").join(known, F.col("doc_id") == F.col("_id")).drop("_id")

    sampled = F.col("pick") < _sample_bound(labelled, rows, fit_rows)
    train = written(labelled(rows.filter(sampled)).select("text", "toxic"), "toxic-train")
    model = chosen_model(train, voters=voters, least=least)

    kind = rows.schema["doc_id"].dataType.simpleString()
    evidence = written(rows.mapInArrow(_evidence(model), f"doc_id {kind}, {EVIDENCE}"), "toxic-evidence")
    patterns = evidence.groupBy("votes").agg(F.count("*").alias("n"))
    weights, bias = fitted_weights(model, patterns, labelled(evidence.filter(sampled)).select("votes", "x", "toxic"))
    z = F.aggregate("x", F.lit(float(bias)), lambda a, i: a + F.get(constant(weights, "array<double>"), i))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    scored = evidence.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
