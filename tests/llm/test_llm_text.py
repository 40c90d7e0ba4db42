"""Sharding, urls, toxicity, quality, packing, token counts and chats against brute force."""

import base64
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyloom.llm import chat, packing, quality, sharding, token_counts, toxicity, url_filter

CLASHES = ["row", "h", "g", "size", "perplexity", "text_", "cell", "p", "c0"]
SF = "/root/testdata/sf0.1"


def documents(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, "en", "s", 1, *["x"] * len(CLASHES)) for r in rows], schema)


EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x " * 30_000), (5, "ÄÖ ß 漢字 😀 e\u0301 İ ŉ"), (6, "It's 12½ o'clock!!  \t\n ok"), (7, "<|endoftext|> and <|x|>")]


# Sharding


def check_shards(rows, found, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots = defaultdict(list)
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    return sizes


def test_shards_are_near_equal_and_keep_small_groups(spark):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(2500)} " * rng.randrange(1, 80)) for i in range(4000)]
    found = sharding.shard_by_size(documents(spark, rows)).collect()
    sizes = check_shards(rows, found, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) < 0.01 * mean for s in sizes.values())
    of = defaultdict(set)
    for r in found:
        of[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 7


def test_shards_split_a_hot_text(spark):
    rows = [(i, "hot " * 20 if i % 3 == 0 else f"text {i} " * 10) for i in range(3000)]
    rows += [(7, "same")] * 900 + [(10_000 + i, None) for i in range(1500)]
    sizes = check_shards(rows, sharding.shard_by_size(documents(spark, rows), ranges_per_shard=32).collect(), 8)
    mean = sum(sizes.values()) / 8
    assert all(abs(s - mean) < 0.05 * mean for s in sizes.values())


def test_shards_of_edge_rows(spark):
    docs = documents(spark, EDGES)
    check_shards(EDGES, sharding.shard_by_size(docs).collect(), 8)
    assert sharding.shard_by_size(docs.limit(0)).count() == 0
    assert sharding.shard_by_size(docs.limit(0)).columns == sharding.shard_by_size(docs).columns


# Urls

URLS = [
    "http://a.example.com/de/1", "https://EXAMPLE.net/en/x?y#z", "http://net/", "http://net", "net/", None, "", "x://y.org/fr/", "http://org/fr",
    "http://b.net?x=/en/", "http://q.example.com/DE/", "http://c.org/fr/a://b/", "a\nb://h.net/en/", "http://xnet/", "://", "http://u@Ä.net:80/en/#",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def brute_rule(host, path):
    fits = []
    for _, rule in url_filter.RULES:
        at, _, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            fits.append(rule)
    return max(fits, key=len, default=None)


def bare(host):
    name, colon, port = host.rpartition(":")
    return name if colon and (port == "" or port.isascii() and port.isdigit()) else host


def brute_rates(outcomes, z=1.645):
    """outcomes: (host, bad or None)."""
    def strength(groups):
        m, ks = mean, [(k, b) for k, b in groups if k]
        if not ks:
            return 10000.0
        n = sum(k for k, _ in ks)
        spread = sum(k * (b / k - m) ** 2 for k, b in ks) / (m * (1 - m))
        free = len(ks) - 1
        base = n - sum(k * k for k, _ in ks) / n - free
        rho = (spread - free) / base if base else None
        return min(max(1 / rho - 1, 1.0), 10000.0) if rho else 10000.0

    def parts(host):
        labels = host.split(".")
        n = 2 if ".".join(labels[-2:]) in url_filter.TWO_LABELS else 1
        return ("domain", ".".join(labels[-1 - n :])), ("suffix", ".".join(labels[-n:]))

    outcomes = [(bare(host), bad) for host, bad in outcomes]
    sums = {name: defaultdict(lambda: [0, 0]) for name in ("host", "domain", "suffix")}
    for host, bad in outcomes:
        for name, key in (("host", host), *parts(host)):
            sums[name][key][0] += bad is not None
            sums[name][key][1] += bad or 0
    k, b = (sum(x[i] for x in sums["suffix"].values()) for i in (0, 1))
    mean = min(max((b + 0.5) / (k + 1), 1e-6), 1 - 1e-6)
    at = {name: strength(sums[name].values()) for name in sums}
    out = {}
    for host, (k, b) in sums["host"].items():
        prior = mean
        for name, key in reversed(parts(host)):
            kk, bb = sums[name][key]
            prior = (at[name] * prior + bb) / (at[name] + kk)
        rate = (at["host"] * prior + b) / (at["host"] + k)
        out[host] = rate, rate - z * math.sqrt(rate * (1 - rate) / (at["host"] + k + 1))
    return out


def test_urls(spark):
    rng = random.Random(4)
    pages = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (1, URLS[1])]
    pages += [(100 + i, f"http://h{rng.randrange(6)}.d{rng.randrange(3)}.{rng.choice(['com', 'org'])}/p") for i in range(300)]
    pages += [(1000 + i, "http://bad.site.com/x") for i in range(150)]
    pages += [(2001 + 2 * i, f"http://{'good' if i % 2 else 'bad'}.co.uk{':8080' if i % 3 else ''}/") for i in range(200)]
    labels = [(i, int(i % 4 == 3) if i > 2000 else int(i < 1000 and rng.random() < 0.8), int(i < 2000 and rng.random() < 0.1)) for i, _ in pages if i and i % 2] + [(None, 0, 1), (101, 0, 0), (102, None, None)]
    frame = spark.createDataFrame([(*p, "html", "x", 1) for p in pages], "page_id bigint, url string, html string, host string, bad int")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = url_filter.judge_urls(frame, known).collect()
    bad = {}
    for d, q, t in labels:
        if d is not None and not (q is None and t is None):
            bad[d] = max(bad.get(d, 0), int(q == 0 or t == 1))
    rates = brute_rates([(brute_url(u)[0], bad.get(i)) for i, u in pages])
    expected = Counter()
    for i, u in pages:
        host, path = brute_url(u)
        rule = brute_rule(host, path)
        what = dict((r, v) for v, r in url_filter.RULES).get(rule, "block" if rates[bare(host)][1] > 0.5 else "allow")
        expected[i, host, path, rule, what] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == expected
    assert all(abs(r["rate"] - rates[bare(r["host"])][0]) < 1e-6 for r in found)
    assert {r["verdict"] for r in found if r["host"] == "bad.site.com"} == {"block"}
    by_domain = {(r["host"], r["verdict"]) for r in found if ".co.uk" in r["host"]}
    assert by_domain == {(f"{n}.co.uk{p}", v) for n, v in (("good", "allow"), ("bad", "block")) for p in ("", ":8080")}
    assert url_filter.judge_urls(frame.limit(0), known).count() == 0
    assert url_filter.judge_urls(frame, known.limit(0)).count() == len(pages)


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(r["score"], r["predicted"], known[d]) for d, r in rows.items() if r["held_out"] and d in known]
    right = sum(p == y for _, p, y in held) / len(held)
    caught = sum(p for _, p, y in held if y) / sum(y for _, _, y in held)
    assert right > 0.97 and caught > 0.85
    # Labels of held-out rows do not matter.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, turned).collect()}
    assert again == {d: r["score"] for d, r in rows.items()}


def test_toxicity_of_edge_rows(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    for known in (labels, labels.limit(0)):
        found = toxicity.toxicity_scores(docs, known).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in EDGES)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_toxicity_sample_is_bounded_and_no_feature_is_cut(spark, monkeypatch):
    """Half of the rows share one text; sixty marked words, each of which tells."""
    rng = random.Random(8)
    marked = [f"{a}{b}{c}zz" for a in "bdfgk" for b in "aeio" for c in "lnr"]
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 3 == 0
        text = "the same text again and again" if i % 2 else " ".join(rng.choice(("calm", "plain", "words", "here")) for _ in range(8))
        if toxic and i % 2 == 0:
            text += " " + " ".join(rng.sample(marked, 6))
        rows.append((i, text))
        labels.append((i, int(toxic and i % 2 == 0)))
    seen = {}
    fit, choose = toxicity.fitted_weights, toxicity.choose_lexicons
    monkeypatch.setattr(toxicity, "fitted_weights", lambda m, p, t: seen.update(n=t.count()) or fit(m, p, t))
    monkeypatch.setattr(toxicity, "choose_lexicons", lambda *a: seen.setdefault("lexicons", choose(*a)))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(documents(spark, rows), known, fit_rows=2000).collect()}
    assert 1500 < seen["n"] <= 2000
    words = {w.rstrip("*^") for lexicon in seen["lexicons"][0] for w in lexicon}
    assert all(any(m.startswith(w) for w in words) for m in marked)
    assert sum(found[i] == t for i, t in labels) > 0.98 * len(labels)


def test_label_model_tells_good_voters_from_noise_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    rates = [(0.02, 0.6), (0.05, 0.5), (0.01, 0.4), (0.3, 0.3)]
    v = np.stack([rng.random(len(y)) < np.where(y, hi, lo) for lo, hi in rates], 1)
    copies = np.hstack([v, v[:, 1:2], v[:, 1:2]])  # the second voter three times
    evidence = {}
    for name, votes in (("once", v), ("copied", copies)):
        k = votes.shape[1] + 1
        silent = ~votes[:, [i for i in range(k - 1) if i != 3]].any(1, keepdims=True)
        bits, counts = np.unique(np.hstack([votes, silent]) @ (1 << np.arange(k)), return_counts=True)
        labelled = rng.choice(len(y), 400, replace=False)
        full = np.hstack([votes, silent])[labelled]
        start = np.stack([(full[y[labelled] == c].sum(0) + 0.02 + 0.2 * c) / ((y[labelled] == c).sum() + 1) for c in (0, 1)]).clip(1e-4, 0.99)
        known = (float((~y[labelled]).sum()), float(y[labelled].sum()))
        of = y[labelled].astype(float)
        shared = toxicity.correlations(full.astype(float), [1 - of, of], start)
        post, rate = toxicity.label_model(bits, counts.astype(float), start, known, shared)
        assert all(rate[1][i] > 5 * rate[0][i] for i in range(3)) and 0.7 < rate[1][3] / rate[0][3] < 1.4
        by_bits = dict(zip(bits.tolist(), post.tolist(), strict=True))
        evidence[name] = by_bits[2 if name == "once" else 2 + 16 + 32]
    # Copies add less than two further independent votes would.
    odds = {k: p / (1 - p) for k, p in evidence.items()}
    assert odds["copied"] < 10 * odds["once"]


# Quality


def brute_kneser_ney(texts):
    """Probabilities of all 4-grams seen or not, by dictionaries."""
    grams = Counter()
    for t in texts:
        s = [0] * 3 + [int(quality.TABLE[min(ord(c), 0x250)]) for c in t]
        for i in range(3, len(s)):
            grams[tuple(s[i - 3 : i + 1])] += 1
    levels = [grams]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    models = []
    for counts in levels:
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] else 0.5 for k in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        models.append((counts, d, total, left))

    def p(gram, level=0):
        if level == 4:
            return 1 / 64
        counts, d, total, left = models[level]
        rest = p(gram[1:], level + 1)
        if gram[:-1] not in total:
            return rest
        c = counts.get(gram, 0)
        own = (c - d[min(c, 3) - 1]) / total[gram[:-1]] if c else 0.0
        return own + left[gram[:-1]] / total[gram[:-1]] * rest

    return p


def test_kneser_ney_tables(spark):
    texts = ["the cat sat on the mat. the end", "a cat! a mat? 12 ÄÖ", "", None, "the the the the", "what a day\nit was"]
    frame = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "half int, text string")
    grams = quality.gram_counts(frame)
    table = quality.NgramModel(quality.model_tables(grams)).log2()
    half = quality.NgramModel(quality.model_tables(grams.filter("half = 1"))).log2()
    q = brute_kneser_ney([t or "" for t in texts[1::2]])
    for code in quality.grams_of("a cat the what").tolist():
        assert abs(2.0 ** half[code] - q((code >> 18 & 63, code >> 12 & 63, code >> 6 & 63, code & 63))) < 1e-5
    p = brute_kneser_ney([t or "" for t in texts])
    rng = random.Random(3)
    seen = [tuple(int(x) for x in (c >> 18 & 63, c >> 12 & 63, c >> 6 & 63, c & 63)) for t in texts for c in quality.grams_of(t or "").tolist()]
    for gram in seen + [tuple(rng.randrange(64) for _ in range(4)) for _ in range(300)] + [(*g[1:], rng.randrange(64)) for g in seen]:
        code = ((gram[0] * 64 + gram[1]) * 64 + gram[2]) * 64 + gram[3]
        assert abs(2.0 ** table[code] - p(gram)) < 1e-5
    rows = np.exp2(table.astype(float)).reshape(-1, 64).sum(1)
    assert np.allclose(rows, 1, atol=1e-3)


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs, labels).collect()}
    good = [found[r["doc_id"]] for r in labels.collect() if r["quality"] == 1]
    junk = [found[r["doc_id"]] for r in labels.collect() if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.2
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d, k in found.items() if k)


def test_quality_bar_is_a_quantile_of_unseen_texts(spark):
    rows = [(i, "de", 3 + i / 1000) for i in range(1000)] + [(1000 + i, "fr", 6 + i / 1000) for i in range(1000)] + [(5000, "xx", 99.0)]
    scored = spark.createDataFrame(rows, "doc_id bigint, lang string, unseen double")
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id bigint, quality int")
    limits = {r["lang"]: r["threshold"] for r in quality.thresholds(scored, labels).collect()}
    assert {k: round(v, 9) for k, v in limits.items()} == {"de": 3.994, "fr": 6.994, None: 6.990}
    found = quality.with_threshold(scored, quality.thresholds(scored, labels)).collect()
    assert all(r["threshold"] == limits.get(r["lang"], limits[None]) for r in found)


def test_quality_bar_withstands_wrong_labels(spark):
    """Four junk texts labelled good change the rejected junk by less than 2 %."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    quality_of = {r["doc_id"]: r["quality"] for r in labels.collect()}
    flipped = [d for d, q in sorted(quality_of.items()) if q == 0][:400:100]
    wrong = labels.withColumn("quality", F.when(F.col("doc_id").isin(flipped), 1).otherwise(F.col("quality")))
    rejected, lost = [], []
    for known in (labels, wrong):
        kept = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs, known).collect()}
        rejected.append(sum(not kept[d] for d, q in quality_of.items() if q == 0 and d not in flipped))
        lost.append(sum(not kept[d] for d, q in quality_of.items() if q == 1))
    assert abs(rejected[0] - rejected[1]) < 0.02 * sum(q == 0 for q in quality_of.values())
    assert max(lost) < 0.01 * sum(q == 1 for q in quality_of.values())


def test_quality_of_edge_rows(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(6, 1), (6, 1), (5, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        found = quality.quality_scores(docs, known).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in EDGES)
        assert all(r["perplexity"] == 1 and r["kept"] for r in found if r["doc_id"] in (1, 2))
        assert quality.drop_low_quality(docs, known).columns == docs.columns
    assert all(r["kept"] for r in found)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.drop_low_quality(docs.limit(0), labels).count() == 0


# Packing


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def test_best_fit_is_that_of_single_steps():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 64, 300])
        lengths = [min(capacity, rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, 5), capacity // 3])) for _ in range(rng.randrange(1, 200))]
        placed, n = packing.best_fit(Counter(lengths), capacity)
        spans = defaultdict(list)
        for length, first, sequence, each, offset in placed:
            last = min((p[1] for p in placed if p[0] == length and p[1] > first), default=Counter(lengths)[length])
            for r in range(last - first):
                spans[sequence + r // each].append((offset + r % each * length, length))
        for parts in spans.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(x for parts in spans.values() for _, x in parts) == sorted(lengths)
        assert n == len(spans)
        assert sorted(capacity - sum(x for _, x in parts) for parts in spans.values()) == brute_best_fit(lengths, capacity)


def expected_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for i, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], dtype="<u4")
            out[d, i, s, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def test_packing_round_trip(spark):
    texts = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows = EDGES + texts + [(9, "dup")] * 300
    found = packing.pack(documents(spark, rows), capacity=512).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected_pieces(rows, 512)
    spans = defaultdict(list)
    for r in found:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        ends = np.cumsum([x for _, x in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(spans) == len(brute_best_fit([r["length"] for r in found], 512))
    assert packing.pack(documents(spark, EDGES).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["'s 't're x''s ('s", "a\u00adb", "ÀÉÎ ſ ŉ µ ª º ²³ ¼", "tab\x0bvt\x1c", "e\u0301", "Straße ĳ Ŀ", "  lead", "<|startoftext|>x", "İstanbul", "\x85\xa0z"])
def test_word_ids_are_those_of_the_library(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), most_words=2).ids(text) == ids


# Token counts


def test_longest_match_counts_pieces(spark):
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n")
    vocabulary = {base64.b64decode(x.split()[0]) for x in lines if x}
    longest = max(map(len, vocabulary))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary)
            n += 1
        return n

    pattern = regex.compile(public_tokenizers.PATTERN)
    rows = EDGES + [(20 + i, t) for i, (t,) in enumerate(duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall())]
    found = token_counts.token_counts(documents(spark, rows)).collect()
    expected = Counter()
    for d, t in rows:
        ws = pattern.findall(t or "")
        expected[d, len((t or "").encode()), len(ws), sum(greedy(w.encode()) for w in ws)] += 1
    assert Counter(map(tuple, found)) == expected
    assert token_counts.token_counts(documents(spark, rows).limit(0)).count() == 0


def test_longest_match_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(30):
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(12)}
        vocabulary = {bytes([b]) for b in range(256)} | extra
        matcher = token_counts.LongestMatch(sorted(vocabulary), most_words=5)
        for _ in range(50):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 25)))
            at = n = 0
            while at < len(word):
                at = next(e for e in range(len(word), at, -1) if word[at:e] in vocabulary)
                n += 1
            assert matcher.pieces(word) == n
    with pytest.raises(ValueError):
        token_counts.LongestMatch([b"a"])


# Chats


def least_cost(roles):
    """Cheapest repair by a search over (turns read, role before)."""
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    seen, heap = set(), [(0, 0, "")]
    while heap:
        cost, at, last = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(roles) and last in ("assistant", ""):
            return cost
        for role in follows[last or None]:
            heapq.heappush(heap, (cost + 3, at, role))
        if at < len(roles):
            for role in ("system", "user", "assistant"):
                own = cost + (0 if role == roles[at] else 2)
                if role == last:
                    heapq.heappush(heap, (own + 1, at + 1, role))
                if role in follows[last or None]:
                    heapq.heappush(heap, (own, at + 1, role))
    raise AssertionError


def legal(roles):
    text = "".join(r[0] for r in roles)
    return re.fullmatch(r"s?(ua)*", text) is not None and text != "s"


@pytest.mark.parametrize("block", [1, 2, 512])
def test_chats(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "User ", None, "tool"])
            rows.append((conv, turn, role, rng.choice([None, "", f"text {conv} {turn}"])))
    rows += [(1000, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(900)]  # a hot conversation
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (2000, None, "assistant", "x"), (2000, None, "assistant", "x"), (2001, 5, "user", "b"), (2001, 5, "assistant", "c")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, place int")
    found = chat.repair_roles(frame, block=block).collect()
    by_conv, out = defaultdict(list), defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((t, role, text))
    for r in found:
        out[r["conv_id"]].append(r)
    assert set(out) == set(by_conv)
    for conv, turns in by_conv.items():
        got = sorted(out[conv], key=lambda r: (r["turn_index"], -1 if r["position"] is None else r["position"]))
        source = [r for r in got if r["position"] is not None]
        assert [r["position"] for r in source] == list(range(len(turns)))
        assert [r["turn"] for r in source] == sorted((t for t, _, _ in turns), key=lambda t: (t is not None, t))
        heads = [r for r in got if not r["action"].endswith("merge")]
        assert [r["turn_index"] for r in heads] == list(range(len(heads)))
        assert legal([r["role"] for r in heads])
        if len({t for t, _, _ in turns}) == len(turns):
            roles = [(role or "").strip().lower() for _, role, _ in sorted(turns)]
            assert got[0]["total_cost"] == least_cost(roles)
            for r, role, (_, _, text) in zip(source, roles, sorted(turns), strict=True):
                assert r["action"].startswith("relabel") == (r["role"] != role)
                head = "\n\n" if r["action"].endswith("merge") else f"<|{r['role']}|>\n"
                assert r["rendered"] == head + (text or "")
        paid = sum({"keep": 0, "merge": 1, "relabel": 2, "relabel and merge": 3, "insert": 3}[r["action"]] for r in got)
        assert paid == got[0]["total_cost"]
    assert chat.repair_roles(frame.limit(0)).count() == 0


def test_chat_results_do_not_depend_on_blocks(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    one, many = (Counter(map(tuple, chat.repair_roles(frame, block=b).collect())) for b in (512, 2))
    assert one == many


def test_chat_functions_reach_tasks():
    from pyspark import cloudpickle

    assert cloudpickle.dumps((chat._block_costs, chat._chained, chat._repaired))


def test_quality_model_holds_only_grams_that_occur(spark):
    texts = ["the cat sat", "the dog sat on the mat", "a cat", "ÄÖ 12!"]
    grams = spark.createDataFrame([(int(g), 1) for t in texts for g in quality.grams_of(t)], "gram bigint, c bigint")
    model = quality.NgramModel(quality.model_tables(grams))
    assert sum(v.nbytes for v in vars(model).values() if isinstance(v, np.ndarray)) < 8_000_000
    table = model.log2()
    asked = np.concatenate([quality.grams_of(t) for t in [*texts, "the hat sat on zebras"]])
    assert np.array_equal(model.log2_of(asked), table[asked])
    assert np.allclose(np.exp2(table.reshape(-1, quality.SYMBOLS).astype(float)).sum(axis=1), 1, atol=1e-3)


def test_toxicity_fit_spells_out_one_block(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 600, rng.integers(0, 9))) for _ in range(20_000)]
    y = np.array([0.9 if 3 in r or 7 in r else 0.05 for r in rows])
    places, start = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    tracemalloc.start()
    weights, bias = toxicity.linear_fit(places, start, 600, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000 and weights.argsort()[-2:].tolist() in ([3, 7], [7, 3])
    monkeypatch.setattr(toxicity, "BLOCK", 1 << 20)
    whole, other = toxicity.linear_fit(places, start, 600, y)
    assert np.allclose(weights, whole, atol=1e-9) and abs(bias - other) < 1e-9
