"""The registered text queries against their SQL, and the pipeline against its operators' brute force."""

import importlib.util
import os
from collections import Counter, defaultdict

import duckdb
import pytest
import test_llm_dedup as dedup
import test_llm_text as text

import __spark_entry__ as entry
import corpus_pipeline
from skyloom.llm import quality
from skyloom.llm.queries import ORACLES, QUERIES

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_oracles", f"{HERE}/tools/check_oracles.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert check.table_of(df.columns, rows) == check.table_of(names, cur.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n not in ORACLES])
def test_query_returns_every_row(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    source, key = ("pages", "page_id") if "url" in name else ("conversations", "conv_id") if "chat" in name else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(key).distinct().collect()}
    assert {r[0] for r in df.select(key).collect()} == ids


JVM_ONLY = ["op1_sharding", "op6_exact_dedup", "op8_decontaminate"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan


def brute_pipeline(spark, rows, labels, items):
    """Stages by brute force; the language model's verdicts come from the dictionary model."""
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    p = text.brute_kneser_ney([t or "" for d, t, _ in rows if d in good])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = quality.quality_scores(docs, labels).collect()
    limit = {(r["doc_id"], r["lang"]): r["threshold"] for r in found}
    trusted = sorted(r["perplexity"] for r in found if r["doc_id"] in good)
    usual = trusted[-(-len(trusted) // 2) - 1]

    def perplexity(t):
        import math

        codes = quality.grams_of(t).tolist()
        logs = [math.log2(p((c >> 18 & 63, c >> 12 & 63, c >> 6 & 63, c & 63))) for c in codes]
        return 2 ** ((50 * math.log2(usual) - sum(logs)) / (len(logs) + 50))

    rows = [r for r in rows if limit[r[0], r[2]] is None or perplexity(r[1] or "") <= limit[r[0], r[2]] * (1 + 1e-6)]
    groups = defaultdict(list)
    for r in rows:
        groups[dedup.lowered(r[1])].append(r)
    rows = [max(g, key=lambda r: r[0]) for g in groups.values()]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [dedup.shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[root(i)] = root(j)
    near = defaultdict(list)
    for i, r in enumerate(rows):
        near[root(i)].append(r)
    rows = [min(g) for g in near.values()]
    hit = {k[0] for k in dedup.brute_contamination([(d, t) for d, t, _ in rows], items) if k[-1]}
    return [(d, t) for d, t, _ in rows if d not in hit]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    kept = brute_pipeline(spark, rows, labels, items)
    assert 0 < len(kept) < len(rows)
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    assert got == text.expected_pieces(kept, 4096)


def test_stages_return_the_columns_of_documents_for_any_rows(spark, tmp_path):
    for name, rows in (("edges", text.EDGES), ("none", [])):
        docs = text.documents(spark, rows)
        for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF_DIR)
            if step < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{step}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{step}")
        if rows:
            assert {r["doc_id"] for r in docs.collect()} >= {2, 5, 7}
        else:
            assert docs.count() == 0
