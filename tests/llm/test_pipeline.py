"""The pipeline's stages against plain versions on a small corpus."""
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline as C
from barweave.llm.encoder import encoder
from barweave.llm.scratch import Scratch
from barweave.llm.toxicity import THRESHOLD, held_out, score_column, train_toxicity
from test_near_duplicates import plain

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "surrogates", "mixing", "packing"]
    tables = [docs]
    for name, stage in C.STAGES:
        tables.append(scratch.keep(stage(spark, tables[-1], SF), name))
    for t in tables[:-1]:
        assert t.columns == docs.columns
    raw, clean, single, private, mixed, packed = [t.collect() for t in tables]
    machine = train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out()), scratch)
    scores = score_column(pa.array([r["text"] for r in raw]), machine)
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r, s in zip(raw, scores) if s < THRESHOLD)
    groups = plain([(r["doc_id"], r["text"]) for r in clean], 5, 80)
    assert sorted(r["doc_id"] for r in single) == sorted(int(c) for c in {c for _, _, c in groups})
    old = {r["doc_id"]: r["text"] for r in single}
    secret = re.compile(r"[\w.]+@[\w.]+\w|(?<![\d.])\d{13,19}(?!\d)|\d+\.\d+\.\d+\.\d+|\+1 \(\d{3}\) \d{3}-\d{4}")
    everything = "\n".join(r["text"] for r in private)
    assert sorted(old) == sorted(r["doc_id"] for r in private)
    for r in private:
        found = secret.findall(old[r["doc_id"]])
        assert not any(x in everything for x in found)
        assert r["n_chars"] == len(r["text"]) or not found
        if not found and "=" not in old[r["doc_id"]] and "AKIA" not in old[r["doc_id"]]:
            assert r["text"] == old[r["doc_id"]]
    assert {r["doc_id"] for r in mixed} == set(old)
    tok = encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    ids = {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [1] for r in private}
    assert sum(p["length"] for p in packed) == sum(len(ids[r["doc_id"]]) for r in mixed)
    for p in packed:
        assert np.frombuffer(p["ids"], "<u4").tolist() == ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]


def test_odd_rows_pass_every_stage(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "same words here are five"), (3, "same words here are five"), (4, "same words here are five"), (None, "no id"), (5, "w" * 200000)])
    scratch = Scratch(spark, "test")
    for table in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            table = scratch.keep(stage(spark, table, SF), name)
            if name == "near_dedup" and not table.isEmpty():
                assert sorted(str(r["doc_id"]) for r in table.collect()) == ["1", "2", "3", "5", "None"]


def test_one_id_with_several_texts(spark, documents):
    """Each text under a repeated id is judged by itself: copies go, one row of equal rows stays, other texts stay."""
    shared, other, third = "one shared text of more than five words", "quite another text under the same old id", "a third text that nobody else has at all"
    docs = documents([(1, shared), (5, shared), (5, other), (5, other), (6, third), (6, None), (6, None), (None, shared), (7, other)])
    out = C.drop_near_duplicates(spark, docs, SF).collect()
    texts = sorted(str(r["text"]) for r in out if r["doc_id"] is not None)
    assert texts == sorted([shared, other, third, "None", "None"])
    assert sum(r["doc_id"] is None for r in out) == 1
