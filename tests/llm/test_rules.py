import math
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barweave.llm import resample as R
from barweave.llm import toxicity as X
from barweave.llm.repetition import longest_repeats, measure, repetition_measures, repetition_rule
from barweave.llm.words import words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b　#", max_size=12)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1 << 20]))
def test_words_of_whole_texts(texts, limit):
    got = {i: [] for i in range(len(texts))}
    for w in words_of(pa.array(texts, pa.string()), limit):
        b = w.data.tobytes()
        for r, s, e in zip(w.row, w.start, w.end):
            got[w.lo + r].append(b[s:e].decode())
    assert list(got.values()) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def plain_repeats(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def sample_texts():
    rng = random.Random(2)
    out = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 30, 60]))) for _ in range(40)]
    return out + ["x " * 40, "a b c\na b c\n\n \na b c", "", "ä# ö$ |x|\nä# ö$ |x|", "abcab " * 9]


def test_longest_repeats():
    docs = [t.split() for t in sample_texts()]
    row = np.concatenate([np.full(len(d), i) for i, d in enumerate(docs)])
    symbol = np.array([hash(w) % (1 << 60) for d in docs for w in d], dtype=np.uint64)
    assert longest_repeats(row, symbol).tolist() == [x for d in docs for x in plain_repeats(d)]


def plain_measures(text, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    best = plain_repeats(words)
    cover = lambda m: [any(i <= p < i + best[i] and best[i] >= m for i in range(len(words))) for p in range(len(words))]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = cover(least)
    spans, p = [], 0
    while p < len(words):
        q = p
        while q < len(words) and covered[q]:
            q += 1
        if q > p:
            spans.append([p, q])
        p = q + 1
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(cover(5)), sum(covered), max(best, default=0)], spans


def test_measures_and_spans():
    texts = sample_texts()
    counts, (row, start, end) = measure(pa.array(texts), 4, spans=True)
    for i, t in enumerate(texts):
        want, spans = plain_measures(t, 4)
        assert [int(counts[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")] == want, t
        assert [[int(a), int(b)] for r, a, b in zip(row, start, end) if r == i] == spans


def test_repetition_rows(spark, documents):
    df = documents([(1, None), (2, ""), (3, "w " * 50), (3, "w " * 50), (None, " ".join(f"w{i}" for i in range(20000))), (4, "q " + " ".join(f"w{i}" for i in range(70)) * 2)])
    out = repetition_rule(repetition_measures(df, spans=True))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 6 and sum(c.lower() == "kept" for c in out.columns) == 1
    assert rows[1]["base_failed"] and rows[1]["n_words"] == 0 and rows[1]["repeat_spans"] == []
    assert rows[3]["n_repeat_words"] == 50 and rows[3]["repeat_spans"] == [[0, 50]] and not rows[3]["kept"]
    assert rows[None]["kept"] and rows[None]["n_words"] == 20000
    assert not rows[4]["kept"] and rows[4]["longest_repeat"] == 68
    assert repetition_rule(repetition_measures(df.limit(0))).count() == 0


def toxic_corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        if bad:
            t += ["vile", "group"]                     # only the pair is toxic
        elif i % 3 == 1:
            t.append(rng.choice(["vile", "group"]))
        rng.shuffle(t)
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_pairs_of_terms_are_learnt(spark, scratch, documents):
    rows = toxic_corpus()
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 450] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = X.train_toxicity(docs, labels, scratch)
    scores = {r["doc_id"]: r["score"] for r in X.score_toxicity(docs, machine).collect()}
    held = [(scores[i], y) for i, _, y in rows if i >= 450]
    assert np.mean([a > b for a, y in held if y for b, z in held if not z]) > 0.95
    odd = X.score_toxicity(documents([(1, None), (2, ""), (3, "vile group " * 20000), (None, "x")]), machine).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert X.score_toxicity(docs.limit(0), machine).count() == 0


def test_scores_equal_plain_formula():
    rng = np.random.default_rng(0)
    place = np.full(1 << X.BITS, -1, np.int32)
    texts = ["alpha beta, gamma!", "alpha", ""]
    sets = [b for _, n, row, bucket in X.text_terms(pa.array(texts)) for b in np.split(bucket, np.searchsorted(row, np.arange(1, n)))]
    known = np.unique(np.concatenate(sets))
    place[known] = np.arange(len(known))
    m = X.Machine(0.3, place, rng.random(len(known), np.float32), rng.normal(size=len(known)).astype(np.float32), rng.normal(size=(len(known), 3)).astype(np.float32))
    want = []
    for s in sets:
        x, v = m.scale[place[s]] / math.sqrt(max(len(s), 1)), m.factors[place[s]]
        y = 0.3 + (m.linear[place[s]] * x).sum() + sum((v[i] @ v[j]) * x[i] * x[j] for i in range(len(s)) for j in range(i))
        want.append(1 / (1 + math.exp(-y)))
    assert np.allclose(X.score_column(pa.array(texts), m), want, atol=1e-5)


def test_labels_without_one_class(spark, scratch, documents):
    docs = documents([(1, "a"), (2, "b")])
    none = X.train_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), scratch)
    assert {r["score"] < 0.01 for r in X.score_toxicity(docs, none).collect()} == {True}


def test_resampling_equals_plain_version(spark, scratch, documents):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text", "### $$$", "junk"]) for _ in range(rng.randrange(0, 30)))) for i in range(300)] + [(300, None), (None, "good text"), (5, "again")]
    docs = documents(rows)
    target = docs.filter("doc_id < 100 and text not like '%junk%'")
    got = R.resample(docs, target, scratch, keep_share=0.4).collect()
    count = lambda texts: sum((np.bincount(b, minlength=R._BUCKETS) for _, _, b in R.ngram_buckets(pa.array(texts, pa.string()))), np.zeros(R._BUCKETS)) + R.SMOOTHING
    p, q = count([r["text"] for r in target.collect()]), count([t for _, t in rows])
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    weight = {}
    for k, t in rows:
        b = [x for _, _, x in R.ngram_buckets(pa.array([t], pa.string()))][0]
        weight.setdefault((k, len(b)), []).append(ratio[b].sum() if len(b) else None)
    for r in got:
        near = weight[(r["doc_id"], r["n_ngrams"])]
        assert any(r["log_weight"] is w or (w is not None and abs(r["log_weight"] - w) < 1e-9) for w in near)
    keys = sorted((r["key"] for r in got if r["key"] is not None), reverse=True)
    border = keys[math.ceil(0.4 * len(rows)) - 1]
    assert all(r["kept"] == (r["key"] is not None and r["key"] >= border) for r in got)
    assert R.resample(docs.limit(0), target, scratch).count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(R, "FINAL", 5)
    rng = random.Random(6)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(-3, 6) for _ in range(3000)] + [7.0] * 500 + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    order = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 100, 1500, 3499, 3500, 9999):
        assert R.kth_largest(df, "v", k) == order[min(k, len(order)) - 1]
