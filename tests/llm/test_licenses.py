import re

from pyspark.sql import functions as F

from barweave.llm import licenses as L

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"


def words(text):
    return re.findall(L.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_version(texts):
    """Votes and key phrases by loops over all words."""
    docs = [words(t) for t in texts]
    index = L.rare_words({w: sum(w in d for d in docs) for _, notice, _ in L.TEMPLATES for w in notice.split()})
    out = []
    for d in docs:
        base = [(i, label) for p, label in L.BASE for i in range(len(d)) if d[i:i + len(p.split())] == p.split()]
        found, best = set(), 0.0
        for (label, notice, keys), rare in zip(L.TEMPLATES, index):
            look = [w for w in rare if w in d][:L.LOOKUPS]
            t = notice.split()
            votes = {}
            for i, w in enumerate(d):
                for q, v in enumerate(t):
                    if w == v and w in look:
                        votes.setdefault(i - q, set()).add(w)
            for off, agreed in votes.items():
                if len(agreed) < L.votes_needed(len(rare)):
                    continue
                places = [(next(q for q in range(len(t)) if t[q:q + len(k.split())] == k.split()), k.split()) for k in keys]
                if all(any(off + q + s >= 0 and d[off + q + s:off + q + s + len(k)] == k for s in range(-L.SLACK, L.SLACK + 1)) for q, k in places):
                    found.add(label)
                    best = max(best, len(agreed) / min(L.LOOKUPS, len(rare)))
        at = [i for i, _ in base]
        out.append((len(d), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(found | {b for _, b in base})), max(best, 0.5 if base else 0.0)))
    return out


TEXTS = [None, "", "nothing here", MIT, MIT.replace("free of charge", "for money"), "Filler. " * 50 + MIT + " and " + MIT, "Released under the MIT License.", "the mit-license", "MITLicense", "mitKicense",
         "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "CC\nBY", "cc by nc", "This work is licensed under the GNU General Public License, version 3.", "gnu general public", "İstanbul MIT license",
         "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:", "ééMIT license mit license", "Licensed under the Apache License,",
         "software the of permission granted charge free hereby is person copy", "x " * 200000 + MIT, "the mit license " * 3000, "Licensed under the Apache License, Version 2.0. " * 2000, "cc " * 500]


def test_scan_equals_plain_version(spark, documents):
    out = L.scan_licenses(documents(list(enumerate(TEXTS)) + [(3, TEXTS[3])]).withColumn("LABELS", F.lit("x")))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in out.collect()}
    want = plain_version(TEXTS + [TEXTS[3]])
    for i in range(len(TEXTS)):
        assert got[i][:6] == want[i][:6] and abs(got[i][6] - want[i][6]) < 1e-12, (i, got[i], want[i])
    assert got[3][5] == "mit" and got[3][1] == 0 and got[4][5] == "" and got[10][5] == "apache,apache-2.0,cc-by,cc-by-nc" and got[13][5] == "gpl,gpl-3.0" and got[16][5] == "bsd"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Join|Window|Aggregate", plan)


def test_places_of_notices(spark, documents):
    row = L.scan_licenses(documents([(1, "a b c " + MIT), (2, "plain")])).filter("doc_id = 1").first()
    assert [(m["label"], m["first_word"], m["share"]) for m in row["matches"]] == [("mit", 3, 1.0)]


def test_without_matches_and_rows(spark, documents):
    assert [tuple(r) for r in L.scan_licenses(documents([(1, "no"), (None, None)])).select("n_words", "labels", "score", F.size("matches")).collect()].count((0, "", 0.0, 0)) == 1
    assert L.scan_licenses(documents([(1, "no")]).limit(0)).count() == 0
