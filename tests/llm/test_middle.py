import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from barweave.llm import fill_in_middle as M


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b, z = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


def test_ranks_equal_counting():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = M.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for low in range(8):
            for high in range(low, 9):
                want = np.r_[0, np.cumsum((symbols >= low) & (symbols < high))]
                assert (matrix.rank(low, high, at) == want).all()


def test_outputs_equal_plain_version(spark, documents):
    rng = random.Random(2)
    alphabet = ["a", "Zz", "é", "日", "😀", " ", "\n", "<", "S>", "<P", "7", "\x00", "word", "  "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "no id here"), (7, "again"), (7, "again"), (403, "has <M> in it"), (404, "x" * 300000), (405, "ab " * 700000), (406, "é" * 100000)]
    out = M.fill_in_middle(documents([(i, t, "s") for i, t in rows]).withColumn("Form", F.lit("x")))
    assert [c.lower() for c in out.columns].count("form") == 1
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in out.collect())
    want = sorted((str(i), *(str(x) if k in (2, 3) else x for k, x in enumerate(plain_version(i, t)))) for i, t in rows)
    assert got == want
    back = out.withColumn("same", M.restored(F.col("form"), F.col("output")) == F.coalesce("text", F.lit("")))
    assert back.filter("not same").count() == 0
    assert {r["form"] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_code_points_as_units(spark, documents):
    out = M.fill_in_middle(documents([(i, "añ日😀 b") for i in range(60)]), unit="char").collect()
    assert {r["n"] for r in out} == {6} and {r["prefix_chars"] for r in out if r["form"] != "plain"} >= {0, 1, 2, 3}
    assert M.fill_in_middle(documents([(1, "a")]).limit(0)).count() == 0
