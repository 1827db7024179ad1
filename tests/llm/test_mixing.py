import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barweave.llm.mixing import bisect_exponent, mix_sources, mixing_plan
from check_oracle import compare, duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op3_embeddings", "op4_mixing", "op5_minhash", "op6_repetition"])
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    cur = duck(SF).execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert compare(rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())) == ""


def corpus(documents):
    rows = [(i, "w " * (i % 9), "hot" if i % 10 < 6 else f"s{i % 4}") for i in range(400)]
    return rows + [(1000, None, None), (1001, "a b", None), (None, "x", "hot"), (5, "again " * 5, "hot"), (5, "again " * 5, "hot")]


def sourced(spark, documents):
    df = documents(corpus(documents))
    return df.withColumn("source", F.when(F.col("doc_id").isin(1000, 1001), None).otherwise(F.col("source")))


def test_every_document_is_drawn_within_the_limit(spark, scratch, documents):
    df = sourced(spark, documents)
    out = mix_sources(df, scratch, repetition_limit=2.0, block_tokens=200, bucket_tokens=16)
    assert sum(c.lower() == "epoch" for c in out.columns) == 1
    got = out.collect()
    times = {}
    for r in got:
        times[(r["doc_id"], r["text"])] = times.get((r["doc_id"], r["text"]), 0) + 1
    rows = corpus(documents)
    assert {k for k in times} == {(d, t) for d, t, _ in rows}
    assert max(n for (d, _), n in times.items() if d != 5) <= 2 and times[(5, "again " * 5)] in (2, 4)
    blocks = {}
    for r in got:
        blocks.setdefault(r["block"], []).append(r)
    for rows_ in blocks.values():
        assert sorted(r["position"] for r in rows_) == list(range(len(rows_)))
        assert sum(r["n_tokens"] for r in rows_) < 2 * 200 + 16 * 6
    assert mix_sources(df.limit(0), scratch).count() == 0


def test_weights_meet_the_targets(spark, scratch, documents):
    shares = spark.createDataFrame([(p,) for p in (.7, .2, .05, .05)], "p double")
    a = bisect_exponent(shares, 2.0, None, None)
    assert (14 ** (1 - a)) == pytest.approx(2, rel=1e-6)
    e = bisect_exponent(shares, None, 1.2, None)
    w = [p ** e for p in (.7, .2, .05, .05)]
    w = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(1.2, abs=1e-6)
    assert bisect_exponent(shares, 0.5, None, None) == 1.0
    quotas, draws = mixing_plan(sourced(spark, documents), scratch, budget_tokens=500, repetition_limit=3.0, bucket_tokens=16)
    q = quotas.collect()
    assert sum(r["quota"] for r in q) == pytest.approx(500, abs=len(q)) and max(r["quota"] / r["tokens"] for r in q) <= 3.01
