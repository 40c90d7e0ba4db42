import random

import plain
import pytest

from skyloom.operators import search

SITES = "ord int, ident string, name string, type string, lat double, lon double, airport string"


def expected(query, fixes, moas, fbos, k=30, box=None):
    q = query.strip().upper()
    hits = []
    for o, ident, name, _, lat, lon, _ in fixes:
        if box and not (box[0] <= lat <= box[1] and box[2] <= lon <= box[3]):
            continue
        s = plain.score(ident, q)
        if name:
            letters = "".join(c for c in name if "A" <= c <= "Z")
            s = max(s, plain.score(letters, q), 90 if q in name.upper() else 0)
        hits.append((s, ident, 0, o))
    seen = set()
    for o, name, b in moas:
        if name in seen:
            continue
        seen.add(name)
        if box and (b[0] > box[1] or b[1] < box[0] or b[2] > box[3] or b[3] < box[2]):
            continue
        ident = name[:-3].strip().upper() if name.upper().endswith("MOA") else name.upper()
        s = plain.score(ident, q)
        s += 500 if ident == q else 300 if ident.startswith(q) else 150 if q in ident else 0
        hits.append((s, ident, 1, o))
    for o, name, _, lat, lon in fbos:
        if box and not (box[0] <= lat <= box[1] and box[2] <= lon <= box[3]):
            continue
        s = plain.score(name.upper(), q)
        s += 500 if name.upper() == q else 300 if name.upper().startswith(q) else 150 if q in name.upper() else 0
        hits.append((s, name, 2, o))
    hits = [h for h in hits if h[0] > 0]
    return sorted(hits, key=lambda h: (-h[0], h[1], h[2], h[3]))[:k]


def word(rng, n):
    return "".join(rng.choices("ABCDEFGHIKLMNOPRSTUVXYZ", k=n))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    base = [word(rng, 5) for _ in range(60)]
    fixes = []
    for o in range(400):
        # A third of all rows are copies of one site name.
        ident = base[0] if o % 3 == 0 else rng.choice(base) if o % 3 == 1 else word(rng, rng.choice([2, 3, 5]))
        name = rng.choice([None, "", f"{word(rng, 6)} {word(rng, 4)}", "KING 7", "12"])
        fixes.append((o, ident, name, "fix", rng.uniform(0, 10), rng.uniform(0, 10), rng.choice(["KLAX", "KSFO", None])))
    moas = [(0, "COUGAR HIGH MOA", (1.0, 2.0, 1.0, 2.0)), (1, "COUGAR HIGH MOA", (5.0, 6.0, 5.0, 6.0)),
            (2, "EAST COUGAR MOA", (5.0, 6.0, 5.0, 6.0))]
    fbos = [(i, f"{word(rng, 5)} AIR", "KLAX", rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(40)]
    frames = (
        spark.createDataFrame(fixes, SITES),
        spark.createDataFrame(moas, "ord int, name string, bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>"),
        spark.createDataFrame(fbos, "ord int, name string, icao string, lat double, lon double"),
    )
    return base, fixes, moas, fbos, frames


def test_search_everywhere_is_brute_force(spark, world):
    base, fixes, moas, fbos, frames = world
    rng = random.Random(4)
    texts = base[:8] + [b[:3] + word(rng, 1) + b[4:] for b in base[8:16]]
    texts += ["cougar", " Cougar High ", "123", "12", "AE", "K", "ZZZZZZZZZZ", "KING 7", "AIR", ""]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    rows = search.search(queries, *frames).orderBy("query_id", "rank").collect()
    for i, text in enumerate(texts):
        got = [(r.score, r.ident, r.branch, r.ord) for r in rows if r.query_id == i]
        want = expected(text, fixes, moas, fbos) if text.strip() else []
        assert got == want, text


@pytest.mark.parametrize("least", [1, 150, 220, 320])
def test_texts_without_a_common_key_score_less(spark, least):
    from pyspark.sql import functions as F
    from skyloom.functions.phonetic import TextKeys, best_score

    rng = random.Random(least)
    base = [word(rng, rng.randint(1, 14)) for _ in range(70)]
    few = ["".join(rng.choices("AEIKSTX", k=rng.randint(1, 6))) for _ in range(25)]
    odd = ["A1", "99", "123", "AE", "IOU", "", "K", "X" * 70, "AB" * 40, "QUAY", "É1"]

    def changed(w):
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(["", word(rng, 1), word(rng, 2)]) + w[i + rng.randint(0, 1) :]
        return w

    left = base + few + odd
    right = [changed(w) for w in base] + [changed(w) for w in few] + [w for w in odd if w]
    t = spark.createDataFrame([(w,) for w in left], "t string").withColumn("k", TextKeys.struct_of(F.col("t")))
    q = spark.createDataFrame([(w,) for w in right if w], "q string").withColumn("qk", TextKeys.struct_of(F.col("q")))
    t = t.withColumn("tkeys", search.site_keys(F.col("k")))
    q = q.withColumn("qkeys", F.concat(search.event_keys(F.col("qk")), search.sound_keys(F.col("qk"), F.lit(least))))
    pairs = t.crossJoin(q).select(
        "t", "q", best_score(["k"], F.col("qk")).alias("score"), F.arrays_overlap("tkeys", "qkeys").alias("shared")
    )
    assert pairs.where(f"not shared and score >= {least}").collect() == []
    if least >= 220:
        assert pairs.where("shared").count() < 0.35 * pairs.count()


def test_search_in_boxes_is_brute_force(spark, world):
    base, fixes, moas, fbos, frames = world
    boxes = [(0, base[0], 0.0, 3.0, 0.0, 10.0), (1, "COUGAR", 4.0, 7.0, 4.0, 7.0),
             (2, "AIR", 0.0, 10.0, 0.0, 10.0), (3, base[5], None, None, None, None)]
    queries = spark.createDataFrame(
        boxes, "query_id int, query string, min_lat double, max_lat double, min_lon double, max_lon double"
    )
    rows = search.search(queries, *frames).orderBy("query_id", "rank").collect()
    for i, text, *box in boxes:
        got = [(r.score, r.ident, r.branch, r.ord) for r in rows if r.query_id == i]
        assert got == expected(text, fixes, moas, fbos, box=box if box[0] is not None else None), text


def test_search_airport(spark, world):
    base, fixes, _, _, frames = world
    asked = [(0, " klax ", base[0]), (1, "KSFO", ""), (2, "", "x"), (3, "NONE", "x")]
    rows = search.search_airport(
        spark.createDataFrame(asked, "query_id int, icao string, query string"), frames[0]
    ).orderBy("query_id", "rank").collect()
    lax = [f for f in fixes if f[6] == "KLAX"]
    sfo = [f for f in fixes if f[6] == "KSFO"]

    def s(f):
        letters = "".join(c for c in f[2] or "" if "A" <= c <= "Z")
        return max(plain.score(f[1], base[0]), plain.score(letters, base[0]))

    want = sorted((f for f in lax if s(f) > 0), key=lambda f: (-s(f), f[0]))[:50]
    assert [r.ord for r in rows if r.query_id == 0] == [f[0] for f in want]
    assert [r.ord for r in rows if r.query_id == 1] == [f[0] for f in sfo][:100]
    assert {r.total for r in rows if r.query_id == 0} == {len(lax)}
    assert {r.query_id for r in rows} == {0, 1}


def test_no_side_of_many_rows_is_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F
    from skyloom.operators import grid

    monkeypatch.setattr(grid, "BROADCAST_ROWS", 500)
    left = spark.range(10).withColumnRenamed("id", "cell")
    # Ten rows for the optimizer, a thousand in truth.
    right = spark.range(10).select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("cell"), F.col("id").alias("site"))
    joined = grid.salted_join(left, right, ["cell"], ["cell"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
    few = grid.salted_join(left, right.where("site = 0"), ["cell"], ["cell"])
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 10


def test_wide_rows_are_broadcast_up_to_fewer(spark, monkeypatch):
    from pyspark.sql import functions as F
    from skyloom.operators import grid

    monkeypatch.setattr(grid, "BROADCAST_ROWS", 500)
    left = spark.range(10).withColumnRenamed("id", "cell")
    right = spark.range(100).select((F.col("id") % 10).alias("cell"), *[F.array("id").alias(f"codes{i}") for i in range(3)])
    joined = left.join(grid.safe_to_broadcast(right), "cell")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    slim = left.join(grid.safe_to_broadcast(right.select("cell")), "cell")
    assert "BroadcastHashJoin" in slim._jdf.queryExecution().executedPlan().toString() and slim.count() == 100
