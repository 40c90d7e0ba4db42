"""Fingerprints, token alignment and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_dedup import documents, sentence

from skyloom.llm import alignment, edit_prints, merkle
from skyloom.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = sentence(rng, 120)
    near = base.split()
    near[40] = "altered"
    large = " ".join(rng.choice(["alpha", "beta", "gamma9", "ärger", "漢字"]) + str(rng.randrange(10**6)) for _ in range(160_000))
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (None, base), (None, "alone"), (4, None), (5, ""), (6, None),
        (7, "x"), (8, "  two  spaces \n and\tlines  "), (9, "a▁b literal"), (10, "<s> <|endoftext|> <0x41>"), (11, "漢字 かな漢字 é é"),
        (12, large), (13, large[:-9] + " the end!"), (14, sentence(rng, 90)), (15, " odd space　 s"), (16, "😀 ok ﬁ"),
    ]


# Merkle manifest


def brute_manifest(records):
    """records: (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def changed(r):
        hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        return (*r[:3], r[3] + 1, r[4]) if hit else r

    def proofs(nodes):
        """The root and each node's list of (sibling, at the left)."""
        paths, places = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(places):
                other = p ^ 1
                paths[k].append((nodes[other] if other < len(nodes) else None, other < p))
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            places = [p // 2 for p in places]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in records:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (members, *proofs([leaf(r) for r in members]))
    if not names:
        return Counter()
    root, upper = proofs([trees[n][1] for n in names])
    out = Counter()
    for name, above in zip(names, upper, strict=True):
        members, subroot, paths = trees[name]
        for r, path in zip(members, paths, strict=True):
            node = leaf(changed(r))
            for sibling, left in path + above:
                node = h(sibling, node) if left and sibling else h(node, sibling or "")
            proof = h(*[s or "" for s, _ in path + above])
            out[r[0], leaf(r), subroot, root, proof, node, node == root] += 1
    return out


RECORD = "doc_id bigint, source string, lang string, n_chars bigint, text string, block string, tree string, idx string, size string"


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_manifest_equals_plain_trees(spark, bits):
    rng = random.Random(bits)
    records = [
        (d, rng.choice(["s", None, "ü"]), rng.choice(["en"] * 6 + ["", None, "de", "日本"]), rng.choice([5, 0, None]), rng.choice(["", None, "text", "é" * 9]))
        for d in [*range(60), 2**60 + 1, 2**60 + 3, -4, None, None, 7, 7]
    ]
    records += [(99, "s", "fr", 1, "only one of its group"), (7, None, None, None, None), (7, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in records], RECORD)
    got = merkle.manifest(docs, tampered_fields=merkle.tampering(), bits=bits)
    found = Counter(tuple(r) for r in got.collect())
    assert found == brute_manifest(records)
    assert {k[-1] for k in found} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "s", None, 3, "abc")]
    docs = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in one], RECORD)
    found = Counter(tuple(r) for r in merkle.manifest(docs, tampered_fields=merkle.tampering()).collect())
    assert found == brute_manifest(one)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_manifest_of_texts_of_several_megabytes(spark):
    records = [(i, "s", "en", 1, "long text " * 400_000 + str(i)) for i in range(3)]
    docs = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in records], RECORD)
    assert Counter(tuple(r) for r in merkle.manifest(docs, tampered_fields=merkle.tampering()).collect()) == brute_manifest(records)


# Token alignment


def brute_alignment(rows):
    """(doc_id, text) to the measures; both tokenizers see whole texts."""
    tool = alignment._aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    per, count = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        a = tool.a.encode(whole, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        if not text or any(b"".join(t[i] for i in x) != whole.encode() for t, x in ((tool.bytes_a, a), (tool.bytes_b, b))):
            per.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        ends = [np.cumsum([len(t[i]) for i in x]).tolist() for t, x in ((tool.bytes_a, a), (tool.bytes_b, b))]
        i = j = 0
        groups, links = [], Counter()
        for end in sorted(set(ends[0]) & set(ends[1])):
            n, m = i, j
            while i < len(a) and ends[0][i] <= end:
                i += 1
            while j < len(b) and ends[1][j] <= end:
                j += 1
            groups.append(",".join(map(str, a[n:i])) + "|" + ",".join(map(str, b[m:j])))
            for x, p in Counter(a[n:i]).items():
                for y, q in Counter(b[m:j]).items():
                    links[x, y] += p * q
        per.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(links.keys())
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return Counter(
        (
            d, n, m, g, sum(links.values()), sum(k for p, k in links.items() if count[p] == best[p[0]]),
            sum(k * count[p] for p, k in links.items()), shown,
        )
        for d, n, m, g, links, shown in per
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_whole_texts_on_the_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    found = Counter(tuple(r) for r in alignment.align_tokens(docs, most_pairs=20_000).select(ALIGNED).collect())
    assert found == brute_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_alignment_of_odd_texts(spark, rows):
    found = alignment.align_tokens(documents(spark, rows), most_signs=50_000, most_pairs=1000).select(ALIGNED).collect()
    expected = brute_alignment(rows)
    assert Counter(tuple(r) for r in found) == expected
    none = {k[0] for k in expected if k[1] == 0}
    assert none == {4, 5, 6, 9}  # null, empty, and the sign that stands for a space
    assert alignment.align_tokens(documents(spark, [])).count() == 0


def test_words_that_share_no_border_are_linked_whole():
    tool = alignment.Aligner(*[__import__("public_tokenizers").path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")], large=4)
    other = alignment._aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    words = ["unbelievably", "antidisestablishment", "x" * 40, "strengthlessness"]
    for w in words:
        small, large = (x.words([w], set()) for x in (other, tool))
        a, b = (alignment._combined(f.pairs, f.times) for f in (small, large))
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_rank_encoder_equals_the_tokenizer():
    tool = alignment._aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert tool.ranks is not None
    rng = random.Random(3)
    signs = "abcdeghilmnoprstuvéßñ0123456789 .,'!-\n\t" + "etaoin " * 3
    for _ in range(300):
        text = " " + "".join(rng.choice(signs) for _ in range(rng.randrange(1, 60)))
        assert tool.ranks.encode_ordinary(text) == tool.a.encode(text, add_special_tokens=False).ids


# Fingerprints


def plain_walk(walks, text):
    """The signs that a walk reads, one for each step."""
    gap, out = walks.gap.reshape(edit_prints.SPAN, 256), []
    for s in edit_prints.coded(edit_prints.points_of(text)).tolist():
        t = len(out)
        out += [s] * int(gap[t % edit_prints.SPAN, (s + int(walks.turn[t // edit_prints.SPAN % 1024])) % 256])
    return out


def plain_print(sketcher, text):
    seq = plain_walk(sketcher.walks, text)
    steps = [int(r[r < max(len(seq), 1)][-1]) for r in sketcher.walks.records[: -sketcher.bands]]
    signs = np.array([seq[s] if s < len(seq) else edit_prints.NOTHING for s in steps])
    return edit_prints._bytes_of(np.array(steps), signs).tobytes().hex()


def edited_texts(rows):
    """(doc_id, text) in order, each with its edited text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()[:16]))
    texts = [t or "" for _, t in order]
    for i, (d, _) in enumerate(order):
        x, y = texts[i], texts[(i + 1) % len(texts)]
        half = len(x) // 2
        yield d, x, x[: len(x) - half] + y[:half], y


def check_prints(found, rows):
    sketcher = edit_prints._sketcher(64, 32, 12, 48)

    def likeness(x, y):
        return np.mean([x[i : i + 2] == y[i : i + 2] for i in range(0, 128, 2)])

    expected = Counter()
    for d, x, e, y in edited_texts(rows):
        a, b, c = (plain_print(sketcher, t) for t in (x, e, y))
        expected[d, len(x), hashlib.sha256(e.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)] += 1
    got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, found))
    assert got == expected


PRINTED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "class_size"]


def test_prints_equal_plain_walks(spark, rows):
    some = [r for r in rows if len(r[1] or "") < 100_000]
    found = edit_prints.edit_prints(documents(spark, some), most_signs=500).select(PRINTED).collect()
    check_prints(found, some)
    of = {(r["doc_id"], r["n_chars"]): (r["class_id"], r["class_size"]) for r in found}
    base = len(some[0][1])
    assert of[1, base] == of[2, len(some[1][1])] == of[3, base] == of[None, base] == (1, 5)
    assert of[None, 5] == (None, 1)
    assert of[4, 0] == of[5, 0] == of[6, 0] == (4, 3)
    assert of[14, len(dict((d, t) for d, t in some if d)[14])] == (14, 1)


def test_prints_of_one_row_and_of_none(spark):
    found = edit_prints.edit_prints(documents(spark, [(5, "only this one")])).collect()
    check_prints([tuple(r) for r in found], [(5, "only this one")])
    assert edit_prints.edit_prints(documents(spark, [])).count() == 0


def test_very_long_texts_are_printed_and_linked(spark, rows):
    long = [r for r in rows if len(r[1] or "") > 1_000_000]
    found = {r["doc_id"]: r for r in edit_prints.edit_prints(documents(spark, long + [(1, "short")])).collect()}
    assert found[12]["class_id"] == found[13]["class_id"] == 12 and found[1]["class_size"] == 1
    text = dict(long)[12]
    assert found[12]["n_chars"] == len(text) and 0.4 < found[12]["near_edited"] <= 1


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distances():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        d = plain_distance(a, b)
        for most in range(13):
            assert edit_prints.distance_within(a, b, most) == (d <= most)
    long = sentence(rng, 300)
    words = long.split()
    for k in range(0, 300, 30):
        words[k] = "other"
    changed = " ".join(words)
    d = plain_distance(long, changed)
    least = 1 - d / max(len(long), len(changed))
    for size in (20_000, 100):  # exact, and through anchors
        assert edit_prints.similar(long, changed, least - 1e-6, long=size)
        assert not edit_prints.similar(long, changed, least + 1e-3, long=size)


def test_classes_hold_nine_in_ten_links_of_the_documents(spark):
    """Recall over all pairs of texts, by brute force."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("n_chars < 6000")
    found = edit_prints.edit_prints(docs).select("doc_id", "class_id").collect()
    of = dict(map(tuple, found))
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    named = {t: of[d] for d, t in text.items()}
    texts = sorted(named, key=len)
    grams = [{t[k : k + 6] for k in range(max(1, len(t) - 5))} for t in texts]
    links, parent = [], {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j]
            if len(a) < len(b) * 0.9 - 1e-9:
                break
            # An edit touches at most six grams, so similar texts share a good part.
            if len(b) > 100 and len(grams[i] & grams[j]) < 0.2 * len(grams[i]):
                continue
            if edit_prints.similar(a, b, 0.9):
                links.append((a, b))
                parent[root(a)] = root(b)
    caught = sum(named[a] == named[b] for a, b in links)
    assert len(links) > 30 and caught >= 0.9 * len(links)
    by_class = defaultdict(set)
    for t, c in named.items():
        by_class[c].add(root(t))
    assert all(len(x) == 1 for x in by_class.values())


def test_scattered_edits_of_long_texts_are_links():
    rng = random.Random(8)
    signs = [rng.choice("abcdefgh ") for _ in range(22_000)]
    changed = ["Z" if i % 11 == 0 else c for i, c in enumerate(signs)]
    assert edit_prints.similar("".join(signs), "".join(changed), 0.9)
    assert not edit_prints.similar("".join(signs), "".join(changed), 0.92)


def test_every_pair_that_meets_is_compared(spark, monkeypatch):
    rng = random.Random(9)
    signs = [rng.choice("abcdefgh ") for _ in range(3000)]
    other = "".join("Z" if i % 11 == 0 else c for i, c in enumerate(signs))
    prints = edit_prints.text_prints(documents(spark, [(1, "".join(signs)), (2, other)]))
    met = prints.agg(F.min("t").alias("a"), F.max("t").alias("b")).selectExpr("a", "b", "2L as met")
    monkeypatch.setattr(edit_prints, "_bucket_pairs", lambda *_: met)
    docs = documents(spark, [(1, "".join(signs)), (2, other)])
    assert {r["class_id"] for r in edit_prints.similar_texts(docs, prints).collect()} == {1}


def test_distances_of_many_pairs_side_by_side():
    rng = random.Random(4)
    pairs = [("", "", 0), ("", "abc", 3), ("abc", "", 2), ("x" * 50, "x" * 50, 0)]
    signs = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))  # more than a byte holds
    pairs += [(signs, signs[1:] + "a", most) for most in (1, 2)]
    for _ in range(400):
        some = rng.choice(["ab", "abc", "äß漢x"])
        a = "".join(rng.choice(some) for _ in range(rng.randrange(60)))
        b = list(a) if rng.random() < 0.5 else [rng.choice(some) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(some)])
        pairs.append((a, "".join(b), rng.randrange(20)))
    expected = [plain_distance(a, b) <= most for a, b, most in pairs]
    for cells in (1, 500, 200_000):
        assert edit_prints.all_within(pairs, cells=cells) == expected
    assert edit_prints.all_within(pairs, few=0) == expected


def test_lengths_in_few_bits_keep_their_order():
    n = np.array([1, 2, 16_383, 16_384, 16_385, 16_386, 40_000, 1 << 20, (1 << 20) + 200, (1 << 31) - 1])
    codes = edit_prints._size_codes(n)
    assert (np.diff(codes) >= 0).all() and codes.max() < 1 << edit_prints.SIZE_BITS
    for size, (low, high) in zip(n.tolist(), map(edit_prints._sizes, codes.tolist()), strict=True):
        assert low <= size <= high <= low * (1 + 2**-13) and (low == high or size >= 1 << 14)


def test_a_bucket_counts_once_wherever_tasks_begin(spark):
    """Rows at the ends of tasks meet again, which must not count twice."""
    rng = random.Random(6)
    base = sentence(rng, 150).split()
    texts = [" ".join(["other" if i == k else w for i, w in enumerate(base)]) for k in range(0, 150, 6)]
    prints = edit_prints.text_prints(documents(spark, list(enumerate(texts)) + [(99, texts[0])]))
    bands = {bytes(r["t"]): bytes(r["bands"]) for r in prints.select("t", "bands").collect()}
    size, before = edit_prints.KEY_BYTES, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            pairs = edit_prints._bucket_pairs(prints, 0.9, 3, 1).collect()
            assert len({(r["a"], r["b"]) for r in pairs}) == len(pairs) > len(texts)
            for r in pairs:
                a, b = bands[bytes(r["a"])], bands[bytes(r["b"])]
                assert 0 < r["met"] <= sum(a[i : i + size] == b[i : i + size] for i in range(0, len(a), size))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block", [3, 4096])
def test_members_of_a_crowded_bucket_that_are_no_neighbours_are_compared(spark, monkeypatch, block):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (980, 985, 1000, *range(1010, 1090, 8))]
    texts.append(texts[2] + "Z" * 95)  # the first of the run and three texts before it are others
    crowded = edit_prints._crowded_pairs
    monkeypatch.setattr(edit_prints, "_crowded_pairs", lambda *given: crowded(*given, block=block))
    docs = documents(spark, list(enumerate(texts)))
    prints = edit_prints.text_prints(docs)
    same = prints.filter("doc_id = 0").select("bands").first()["bands"]
    prints = prints.withColumn("bands", F.lit(same))
    found = {r["row"]: (r["class_id"], r["class_size"]) for r in edit_prints.similar_texts(docs, prints).collect()}
    of = {r["doc_id"]: found[r["row"]] for r in prints.select("doc_id", "row").collect()}
    assert of == {k: (2, 2) if k in (2, len(texts) - 1) else (k, 1) for k in range(len(texts))}
    met = edit_prints._meeting_rows(prints, 0.9, 3)
    nobody = spark.createDataFrame([], "node binary, root binary")
    pairs = [tuple(r) for r in edit_prints._crowded_pairs(prints, met, nobody, 0.9, 3, 2).collect()]
    fit = sum(len(a) >= 0.9 * len(b) for i, a in enumerate(texts) for b in texts[i + 1 :])
    assert len(set(pairs)) == len(pairs) == fit
