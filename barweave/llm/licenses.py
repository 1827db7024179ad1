r"""Licence scans with a positional index of rare tokens, all in DataFrame operations.

Licence templates are short word sequences with mandatory key phrases.  One pass counts in how many texts
each template word occurs; a template's highest-IDF words (share ``INDEX_SHARE`` of those that occur at all)
make up the index: word -> postings (template, place in the template).  In a file, the words of the index are
located, for each template its ``LOOKUPS`` highest-IDF ones are looked up, and every occurrence votes for
(template, place in the file minus place in the template).  Where enough different words agree on one
relative position, the template's key phrases must stand word by word at their places, give or take
``SLACK`` words; then its label is given.

Templates and postings are constants of fixed size, so a file is judged inside its row: the only shuffle is
that of the word counts, a few hundred rows.  Independently, the base phrases are located wherever their
words stand consecutively.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKUPS, INDEX_SHARE, INDEX_MOST, AGREE, SLACK = 6, 0.6, 8, 0.5, 3
# Phrases and labels that count wherever they stand.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Fixed values: (label, words of the notice, its mandatory key phrases).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice",
     ["with or without fee is hereby granted"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ["redistribute it and or modify it under the terms of", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
     ["without any express or implied warranty", "arising from the use of this software"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
]
_ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
_RANK, _PLACE, _SHIFT = 512, 1 << 32, 4096          # a vote is ((template * _PLACE) + position + _SHIFT) * _RANK + rank


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # only two other letters turn into A-Z ones: the Kelvin sign and the dotted capital I
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.regexp_extract_all(F.when(odd, F.translate(text, upper, lower)).otherwise(F.lower(text)), F.lit(WORD), F.lit(0))


def document_counts(docs: DataFrame, text_col: str, templates=None) -> dict[str, int]:
    """In how many rows each template word occurs; one row a word, so the driver holds the templates' vocabulary at most."""
    vocabulary = sorted({w for _, notice, _ in templates or TEMPLATES for w in notice.split()})
    found = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col(text_col)), lambda w: w.isin(vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_words(counts: dict[str, int], templates=None) -> list[list[str]]:
    """Per template its indexed words, the highest IDF first.

    A template with a key phrase of which a word occurs nowhere cannot stand in any file: it has none.
    """
    out = []
    for _, notice, keys in templates or TEMPLATES:
        held = sorted((w for w in set(notice.split()) if counts.get(w)), key=lambda w: (counts[w], w))
        size = min(INDEX_MOST, max(2, math.ceil(INDEX_SHARE * len(held))))
        out.append(held[:size] if all(counts.get(w) for k in keys for w in k.split()) else [])
    return out


def votes_needed(indexed: int) -> int:
    """Half of the looked-up words, so that a word more or less in a notice still leaves enough on one side of it."""
    return max(2, math.ceil(AGREE * min(LOOKUPS, indexed)))


def _phrases(templates) -> Column:
    """Per template the key phrases as (place in the template, words)."""
    out = []
    for _, notice, keys in templates:
        words = notice.split()
        rows = []
        for key in (k.split() for k in keys):
            place = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            rows.append(F.struct(F.lit(place).alias("at"), F.array(*[F.lit(w) for w in key]).alias("words")))
        out.append(F.array(*rows))
    return F.array(*out)


def scan_licenses(docs: DataFrame, text_col: str = "text", templates=None) -> DataFrame:
    """``docs`` with ``n_words``, base places (``n_base``, ``first_word``, ``last_word``), ``base_labels``, ``labels``, ``score`` and ``matches``.

    ``matches`` lists verified templates as (label, word at which the notice begins, share of its looked-up
    words in place).  ``score`` is the best such share; a base phrase alone counts 0.5, nothing 0.  Null and
    empty texts have no words and empty labels; repeated rows are judged alike and count each for the IDF; an
    empty table gives no rows.  Columns named like an added one are replaced.
    """
    templates = templates or TEMPLATES
    base = without(docs, *_ADDED, "_w", "_at", "_hits", "_look", "_votes", "_found", "_base")
    counts = document_counts(base, text_col, templates)
    index = rare_words(counts, templates)
    ranked = sorted({w for words in index for w in words}, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(ranked)}
    postings = {w: [(t, q) for t, (_, notice, _) in enumerate(templates) if w in index[t] for q, v in enumerate(notice.split()) if v == w] for w in ranked}
    d = base.withColumn("_w", words_of(F.col(text_col)))
    w = F.col("_w")

    starts = {p.split()[0]: (p.split(), label) for p, label in BASE}
    known = sorted({*ranked, *starts})
    d = d.withColumn("_at", F.array_compact(F.transform(w, lambda v, i: F.when(v.isin(known), i))))

    def phrase_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for words, label in starts.values():
            stands = F.get(w, i) == words[0]
            for k, v in enumerate(words[1:], 1):
                stands = stands & (F.coalesce(F.get(w, i + k), F.lit("")) == v)
            out = F.when(stands, F.lit(label)).otherwise(out)
        return out

    d = d.withColumn("_base", F.filter(F.transform("_at", lambda i: F.struct(i.alias("at"), phrase_at(i).alias("label"))), lambda b: b["label"].isNotNull()))
    added = {"n_words": F.size("_w").cast("long"), "n_base": F.size("_base").cast("long"), "first_word": F.array_min(F.transform("_base", lambda b: b["at"])).cast("long"),
             "last_word": F.array_max(F.transform("_base", lambda b: b["at"])).cast("long"), "base_labels": F.array_join(F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["label"]))), ",")}
    if not ranked:
        d = d.withColumn("matches", F.expr("filter(array(named_struct('label', '', 'first_word', 0L, 'share', 0.0D)), m -> false)"))
    else:
        d = _matches(d, templates, index, rank, postings)
    labels = F.array_union(F.transform("_base", lambda b: b["label"]), F.transform("matches", lambda m: m["label"]))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    added |= {"labels": F.array_join(F.array_sort(F.array_distinct(labels)), ","), "score": F.greatest(best, F.when(F.size("_base") > 0, 0.5).otherwise(0.0))}
    return d.select(*base.columns, *[c.alias(n) for n, c in added.items()], "matches")


def _matches(d: DataFrame, templates, index, rank, postings) -> DataFrame:
    """Adds ``matches``: votes by relative position, then the key phrases."""
    w = F.col("_w")
    entry = lambda t, q, r: F.struct(F.lit(t).cast("long").alias("t"), F.lit(q).cast("long").alias("q"), F.lit(r).cast("long").alias("r"))
    book = F.create_map(*[x for v, places in postings.items() for x in (F.lit(v), F.array(*[entry(t, q, rank[v]) for t, q in places]))])
    d = d.withColumn("_hits", F.filter(F.transform("_at", lambda i: F.struct(i.cast("long").alias("at"), F.element_at(book, F.get(w, i)).alias("places"))), lambda h: h["places"].isNotNull()))
    # a file's highest-IDF words of each template: (template, rank) pairs in order, at most LOOKUPS of a template
    pairs = F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.transform(h["places"], lambda p: p["t"] * _RANK + p["r"])))))
    d = d.withColumn("_look", pairs)
    look = F.col("_look")
    template_of = lambda pair: F.floor(pair / _RANK)
    d = d.withColumn("_look", F.filter(look, lambda p, i: (i < LOOKUPS) | (F.coalesce(template_of(F.get(look, i - LOOKUPS)), F.lit(-1)) != template_of(p))))
    vote = lambda h, p: (p["t"] * _PLACE + h["at"] - p["q"] + _SHIFT) * _RANK + p["r"]
    chosen = lambda h: F.filter(h["places"], lambda p: F.array_contains(F.col("_look"), p["t"] * _RANK + p["r"]))
    cast_votes = F.sort_array(F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.transform(chosen(h), lambda p: vote(h, p))))))
    d = d.withColumn("_votes", F.when(F.size("_look") > 1, cast_votes).otherwise(F.array().cast("array<long>")))
    votes = F.col("_votes")
    place = lambda v: F.shiftright(v, int(math.log2(_RANK)))
    need = F.array(*[F.lit(votes_needed(len(words)) if words else LOOKUPS + 1) for words in index])
    most = F.array(*[F.lit(max(1, min(LOOKUPS, len(words)))) for words in index])

    def count(v: Column, i: Column) -> Column:
        """Votes of the run that begins at ``i``; other places than its first give 0."""
        run = F.lit(1)
        for k in range(1, LOOKUPS):
            run = run + F.when(place(F.coalesce(F.get(votes, i + k), F.lit(-1))) == place(v), 1).otherwise(0)
        begins = (i == 0) | (place(F.coalesce(F.get(votes, i - 1), F.lit(-1))) != place(v))
        return F.when(begins, run).otherwise(0)

    runs = F.transform(votes, lambda v, i: F.struct(F.floor(place(v) / _PLACE).cast("int").alias("t"), (place(v) % _PLACE - _SHIFT).cast("int").alias("at"), count(v, i).alias("n")))
    d = d.withColumn("_found", F.filter(runs, lambda c: c["n"] >= F.get(need, c["t"])))
    phrases = _phrases(templates)

    def stands(c: Column, p: Column) -> Column:
        at = lambda shift: c["at"] + p["at"] + shift
        return F.exists(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda s: (at(s) >= 0) & (F.slice(w, F.greatest(at(s), F.lit(0)) + 1, F.size(p["words"])) == p["words"]))

    verified = F.filter("_found", lambda c: F.forall(F.get(phrases, c["t"]), lambda p: stands(c, p)))
    names = F.array(*[F.lit(label) for label, _, _ in templates])
    return d.withColumn("matches", F.transform(verified, lambda c: F.struct(F.get(names, c["t"]).alias("label"), F.greatest(c["at"], F.lit(0)).cast("long").alias("first_word"),
                                                                            (c["n"] / F.get(most, c["t"])).alias("share"))))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _template_rows() -> tuple[str, str]:
    words = ", ".join(f"({t}, {q}, '{v}')" for t, (_, notice, _) in enumerate(TEMPLATES) for q, v in enumerate(notice.split()))
    keys = []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):
        for p in phrases:
            at = len(re.split(rf"\b{p}\b", notice)[0].split())
            keys.append(f"({t}, '{label}', {at}, {p.split()!r})")
    return words, ", ".join(keys)


_BASE_SQL = " UNION ALL ".join(
    f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM (SELECT rid, words, unnest(generate_series(1, len(words))) AS i FROM w WHERE list_contains(words, '{p.split()[0]}')) WHERE words[i:i + {len(p.split()) - 1}] = {p.split()!r}"
    for p, label in BASE)
OP12_SQL = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
tw(t, q, word) AS (VALUES {_template_rows()[0]}),
tk(t, label, place, phrase) AS (VALUES {_template_rows()[1]}),
x AS MATERIALIZED (SELECT rid, word, pos FROM (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w) WHERE word IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT rid) AS n FROM x GROUP BY word),
tr AS (SELECT t, word, n, row_number() OVER (PARTITION BY t ORDER BY n, word) AS r, count(*) OVER (PARTITION BY t) AS held FROM (SELECT DISTINCT t, word FROM tw) JOIN df USING (word)),
ab AS (SELECT DISTINCT t FROM (SELECT t, unnest(phrase) AS word FROM tk) WHERE word NOT IN (SELECT word FROM df)),
ix AS MATERIALIZED (SELECT t, word, n, count(*) OVER (PARTITION BY t) AS indexed FROM tr WHERE t NOT IN (SELECT t FROM ab) AND r <= least({INDEX_MOST}, greatest(2, CAST(ceil({INDEX_SHARE} * held) AS INT)))),
lk AS (SELECT rid, t, word, indexed FROM (SELECT rid, t, word, indexed, row_number() OVER (PARTITION BY rid, t ORDER BY n, word) AS r FROM (SELECT DISTINCT rid, word FROM x) JOIN ix USING (word)) WHERE r <= {LOOKUPS}),
vt AS (SELECT x.rid, lk.t, x.pos - tw.q AS off, any_value(lk.indexed) AS indexed, count(DISTINCT x.word) AS n FROM x JOIN lk USING (rid, word) JOIN tw ON tw.t = lk.t AND tw.word = x.word GROUP BY 1, 2, 3),
cd AS MATERIALIZED (SELECT rid, t, off, n / least({LOOKUPS}, indexed) AS share FROM vt WHERE n >= greatest(2, ceil({AGREE} * least({LOOKUPS}, indexed)))),
ok AS (SELECT cd.rid, cd.t, cd.off, any_value(cd.share) AS share, any_value(tk.label) AS label, count(*) AS standing,
    bool_and(EXISTS (SELECT 1 FROM generate_series(-{SLACK}, {SLACK}) g(s) WHERE cd.off + tk.place + g.s >= 0 AND w.words[cd.off + tk.place + g.s + 1:cd.off + tk.place + g.s + len(tk.phrase)] = tk.phrase)) AS good
  FROM cd JOIN tk USING (t) JOIN w USING (rid) GROUP BY 1, 2, 3),
b AS MATERIALIZED ({_BASE_SQL}),
bs AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM ok WHERE good) GROUP BY rid),
sc AS (SELECT rid, max(share) AS score FROM ok WHERE good GROUP BY rid)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(bs.n, 0) AS BIGINT) AS n_base, CAST(bs.lo AS BIGINT) AS first_word, CAST(bs.hi AS BIGINT) AS last_word,
  coalesce(bs.labels, '') AS base_labels, coalesce(al.labels, '') AS labels, CAST(greatest(coalesce(sc.score, 0), CASE WHEN bs.n > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM w LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""
