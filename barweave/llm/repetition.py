"""Repetition rule from suffix arrays over the words of whole texts.

Suffixes of a chunk of texts are sorted by prefix doubling (only suffixes that still tie are
sorted again; suffixes of different texts never tie).  Longest common prefixes of neighbours
give, for every position, the longest repeat starting there, the deepest interval of common
prefixes holding the suffix.  A position whose repeat is not the tail of the one before starts a
maximal repeat.  The spans of maximal repeats of at least ``min_words`` words are united; a text is
rejected when they cover too large a part of it or one of them is too long.

One pass over the rows, no shuffle; a task holds one chunk (or one longer text) at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import without
from .words import hash_spans, lines_of, order_by_row, words_of

MIN_WORDS, MAX_COVERED_PCT, MAX_LONGEST = 10, 25, 60
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats"]


def longest_repeats(row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """For each position of the texts (``row`` ascending), the length of the longest substring of its text that starts there and occurs again."""
    n = len(row)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    end = np.searchsorted(row, row, side="right")
    order = order_by_row(row, symbol)
    same = np.zeros(n, dtype=bool)
    same[1:] = (symbol[order[1:]] == symbol[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = head
    levels, step, tied_first = [rank], 1, same.copy()
    open_at = np.flatnonzero(same | np.append(same[1:], False))
    while len(open_at):
        suffix = order[open_at]
        nxt = suffix + step
        inside = nxt < end[suffix]
        second = np.where(inside, rank[np.where(inside, nxt, 0)].astype(np.int64) + 1, 0)
        key = rank[suffix].astype(np.int64) * (n + 2) + second
        o = np.argsort(key, kind="stable")
        suffix, key = suffix[o], key[o]
        order[open_at] = suffix
        tie = np.zeros(len(key), dtype=bool)
        tie[1:] = key[1:] == key[:-1]
        rank = rank.copy()
        rank[suffix] = open_at[np.maximum.accumulate(np.where(tie, 0, np.arange(len(key))))]
        open_at = open_at[tie | np.append(tie[1:], False)]
        step *= 2
        levels.append(rank)
    common = np.zeros(n + 1, dtype=np.int64)                 # with the neighbour before, in suffix order
    at = np.flatnonzero(tied_first)                          # first symbols agree
    # neighbours changed inside their groups, never across groups of equal first symbols
    a, b = order[at - 1].copy(), order[at].copy()
    length = np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        r = levels[k]
        ai, bi = np.where(ok, a, 0), np.where(ok, b, 0)
        eq = ok & (r[ai] == r[bi]) & (ai != bi)
        a[eq] += 1 << k
        b[eq] += 1 << k
        length[eq] += 1 << k
    common[at] = length
    best = np.empty(n, dtype=np.int64)
    best[order] = np.maximum(common[:-1], common[1:])
    return best


def _per_row(row, values, rows):
    return np.bincount(row, weights=values, minlength=rows).astype(np.int64)


def _united(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge)[:-1] > 0


def measure(column, min_words: int, spans: bool = False):
    """Counts of an Arrow text column, in row order; with ``spans`` also the united spans as (row, first word, end) arrays."""
    out = {k: [] for k in _COUNTS}
    found = []
    for w in words_of(column):
        n = w.rows
        text_row = np.repeat(np.arange(n), np.diff(w.bounds))
        best = longest_repeats(w.row, w.hashes())
        whole = w.data[:0] if not len(w.data) else (w.data & 0xC0) != 0x80        # a byte that begins a character
        chars = np.concatenate([[0], np.cumsum(whole)])
        lrow, lstart, lend = lines_of(w)
        has_word = np.searchsorted(w.start, lend) > np.searchsorted(w.start, lstart)
        lrow, lhash = lrow[has_word], hash_spans(w.data, lstart[has_word], lend[has_word])
        o = order_by_row(lrow, lhash)
        again = np.zeros(len(o), dtype=bool)
        again[1:] = (lrow[o[1:]] == lrow[o[:-1]]) & (lhash[o[1:]] == lhash[o[:-1]])
        prev = np.concatenate([[0], best[:-1]])
        prev[w.first()[:-1][w.first()[:-1] < len(best)]] = 0
        maximal = (best >= min_words) & (best > prev - 1)
        at5 = np.flatnonzero(best >= 5)
        repeated = _united(at5, np.full(len(at5), 5), len(best)) if len(best) else np.zeros(0, bool)
        atm = np.flatnonzero(maximal)
        covered = _united(atm, best[atm], len(best)) if len(best) else np.zeros(0, bool)
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, w.row, best)
        for k, v in zip(_COUNTS, (np.bincount(w.row, minlength=n).astype(np.int64), _per_row(w.row, chars[w.end] - chars[w.start], n), _per_row(text_row, _SYMBOL[w.data], n),
                                  np.bincount(lrow[o[again]], minlength=n).astype(np.int64), _per_row(w.row, repeated, n), _per_row(w.row, covered, n), longest, np.bincount(w.row[atm], minlength=n).astype(np.int64))):
            out[k].append(v)
        if spans:
            first = w.first()
            edge = np.diff(np.concatenate([[0], (covered * (w.row + 1)), [0]])) if len(covered) else np.zeros(1)
            b = np.flatnonzero(edge) if len(covered) else np.zeros(0, np.int64)
            b = b[b < len(covered)]
            keep = covered[b] if len(b) else np.zeros(0, bool)
            s = b[keep]
            stops = np.append(b, len(covered))
            e = stops[np.searchsorted(stops, s, side="right")] if len(s) else s
            found.append((w.lo + w.row[s], s - first[w.row[s]], e - first[w.row[s]]))
    counts = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    if not spans:
        return counts
    return counts, [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], []))]


def repetition_measures(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, spans: bool = False) -> DataFrame:
    """``docs`` with the counts (long) and, if asked, ``repeat_spans`` (array of [first word, end) pairs).

    A null or empty text has zero counts.  Rows are independent: repeated rows get equal values.
    Columns of ``docs`` named like an added one are replaced.
    """
    base = without(docs, *_COUNTS, "repeat_spans")
    at = base.columns.index(text_col)
    kinds = [T.StructField(k, T.LongType()) for k in _COUNTS]
    if spans:
        kinds.append(T.StructField("repeat_spans", T.ArrayType(T.ArrayType(T.LongType()))))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = measure(batch.column(at), min_words, spans)
            counts, found = got if spans else (got, None)
            cols = [*batch.columns, *(pa.array(counts[k]) for k in _COUNTS)]
            names = [*batch.schema.names, *_COUNTS]
            if spans:
                row, s, e = found
                off = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(row) + 1, 2, dtype=np.int32)), pa.array(np.column_stack([s, e]).ravel().astype(np.int64)))
                cols.append(pa.ListArray.from_arrays(pa.array(off), pairs))
                names.append("repeat_spans")
            yield pa.RecordBatch.from_arrays(cols, names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *kinds]))


def repetition_rule(measured: DataFrame, max_covered_pct: int = MAX_COVERED_PCT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Adds ``base_failed``, ``long_repeat`` and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    long_repeat = F.col("longest_repeat") > max_longest
    rejected = failed | long_repeat | (100 * F.col("covered_words") > max_covered_pct * F.col("n_words"))
    return without(measured, "base_failed", "long_repeat", "kept").withColumns({"base_failed": failed, "long_repeat": long_repeat, "kept": ~rejected})


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_rule(repetition_measures(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "long_repeat", "base_failed", "kept")


def _covered(m: int) -> str:
    """Words of the ``m``-word windows that occur twice or more in their text."""
    return f"""(SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(generate_series(i, i + {m - 1})) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + {m - 1}), ' ') AS g
            FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {m - 1})) AS i FROM w WHERE len(words) >= {m}))) WHERE c > 1) GROUP BY doc_id)"""


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r5 AS {_covered(5)}, rm AS {_covered(MIN_WORDS)}, rl AS {_covered(MAX_LONGEST + 1)},
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
        coalesce(r5.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS covered_words, rl.n IS NOT NULL AS long_repeat
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r5 USING (doc_id) LEFT JOIN rm USING (doc_id) LEFT JOIN rl USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR long_repeat OR 100 * covered_words > {MAX_COVERED_PCT} * n_words) AS kept FROM m
"""
