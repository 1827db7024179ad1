r"""Fill-in-the-middle texts, cut by a wavelet matrix over character classes.

Every byte of a text belongs to one class: a UTF-8 continuation byte, a letter inside or at the start of a
letter run, and so on.  A wavelet matrix over the classes of a chunk of texts answers "how many of class c
lie before position p" from one bit vector a level.  A unit (token, code point) begins at the bytes of some
classes, so the units before a position are a sum of ranks.  Both cuts of all texts of a chunk are found
together by bisection on that count; code points of a part are ranks, too.

Parts are joined as ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm), or the
text stays as it is (plain).  A text that holds one of the marks stays plain, and no mark can arise across
a border, as none begins with another's end; so the form and the output give back the exact text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import without
from .words import row_chunks, text_buffers

SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
MARKS = ("<P>", "<S>", "<M>")
CONTINUED, INSIDE, FIRST, DIGIT, BLANK, LINE_END, SIGN, FOREIGN = range(8)      # classes of bytes
LEVELS = 3
UNITS = {"token": range(FIRST, FOREIGN + 1), "char": range(INSIDE, FOREIGN + 1)}      # classes at which a unit begins
_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

_BYTE_CLASS = np.full(256, SIGN, dtype=np.uint8)
_BYTE_CLASS[0x80:0xC0], _BYTE_CLASS[0xC0:] = CONTINUED, FOREIGN
_BYTE_CLASS[[*range(65, 91), *range(97, 123)]] = INSIDE
_BYTE_CLASS[48:58], _BYTE_CLASS[[9, 11, 12, 13, 32]], _BYTE_CLASS[10] = DIGIT, BLANK, LINE_END


def classes_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that lie one after the other; a text's first letter begins a run."""
    cls = _BYTE_CLASS[data]
    letter = cls == INSIDE
    after = np.zeros(len(cls), dtype=bool)
    after[1:] = letter[:-1]
    after[bounds[:-1][bounds[:-1] < len(cls)]] = False
    cls[letter & ~after] = FIRST
    return cls


class WaveletMatrix:
    """Rank queries over a sequence of small symbols: a level a bit, the highest first.

    Every level is a bit vector in 64-bit words with the ones before each word; symbols with a zero go
    before those with a one on the next level.
    """

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.size, self.levels = len(symbols), []
        for k in reversed(range(levels)):
            bit = (symbols >> k) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.levels.append((words, ones, self.size - int(ones[-1])))
            one = bit.astype(bool)
            symbols = np.concatenate([symbols[~one], symbols[one]])

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[word] + np.bitwise_count(words[word] & below)

    def rank(self, low: int, high: int, at: np.ndarray) -> np.ndarray:
        """How many symbols in [low, high) lie before each position of ``at``."""
        return self._below(high, at) - self._below(low, at)

    def _below(self, symbol: int, at: np.ndarray) -> np.ndarray:
        if symbol >> len(self.levels):
            return at.copy()
        start, count = np.zeros_like(at), np.zeros_like(at)
        for level, (words, ones, zeros) in enumerate(self.levels):
            before, upto = self._ones(words, ones, start), self._ones(words, ones, at)
            if symbol >> (len(self.levels) - 1 - level) & 1:
                count += (at - upto) - (start - before)
                start, at = zeros + before, zeros + upto
            else:
                start, at = start - before, at - upto
        return count


def unit_end(matrix: WaveletMatrix, begins: range, lo: np.ndarray, hi: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Where the first ``units`` units of each text [lo, hi) end: the last position with no more units before it."""
    base = matrix.rank(begins.start, begins.stop, lo)
    left, right = lo.copy(), hi.copy()
    while (left < right).any():
        mid = (left + right + 1) >> 1
        fits = matrix.rank(begins.start, begins.stop, mid) - base <= units
        left, right = np.where(fits, mid, left), np.where(fits, right, mid - 1)
    return left


def cut_texts(column, draws: np.ndarray, unit: str = "token", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW):
    """(n, form, prefix_chars, middle_chars, output) of an Arrow text column; ``draws`` has four numbers a row.

    Yields lists for consecutive row ranges of about a megabyte (a longer text is a range of its own).
    """
    data, off = text_buffers(column)
    begins = UNITS[unit]
    marks = [m.encode() for m in MARKS]
    for lo, hi in row_chunks(off):
        part, bounds = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        matrix = WaveletMatrix(classes_of(part, bounds))
        a, b, h = bounds[:-1], bounds[1:], draws[lo:hi]
        n = matrix.rank(begins.start, begins.stop, b) - matrix.rank(begins.start, begins.stop, a)
        cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        p, m = unit_end(matrix, begins, a, b, cuts[:, 0]), unit_end(matrix, begins, a, b, cuts[:, 1])
        chars = [matrix.rank(INSIDE, FOREIGN + 1, at) for at in (a, p, m)]
        raw = part.tobytes()
        form, output = [], []
        for i in range(hi - lo):
            text = raw[a[i]:b[i]]
            if not text or h[i, 2] % 100 >= plain_from or (b"<" in text and any(x in text for x in marks)):
                form.append("plain")
                output.append(text)
                continue
            prefix, middle, suffix = raw[a[i]:p[i]], raw[p[i]:m[i]], raw[m[i]:b[i]]
            spm = h[i, 3] % 100 < spm_below
            form.append("spm" if spm else "psm")
            output.append(b"".join([b"<S>", suffix, b"<P>", prefix] if spm else [b"<P>", prefix, b"<S>", suffix]) + b"<M>" + middle)
        yield n, form, chars[1] - chars[0], chars[2] - chars[1], output


def draws_of(id_col: str, seed: str = SEED, count: int = 4) -> Column:
    """``count`` numbers in [0, 2**32) from the id, the same in every run; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token", seed: str = SEED,
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``unit`` is "token" (a run of A-Z letters, or one other code point) or "char".  Null and empty texts
    give an empty plain output.  Rows are independent: repeated rows get equal outputs, an empty table no
    rows.  Columns named like an added one are replaced, all others stay.
    """
    base = without(docs, *_ADDED)
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
              T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    draws = "_draws"
    while draws in base.columns:
        draws += "_"
    at = base.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            h = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, 4)
            done = 0
            for n, form, prefix, middle, output in cut_texts(batch.column(at), h, unit, plain_from, spm_below):
                plain = np.array([f == "plain" for f in form])
                new = [pa.array(n), pa.array(form), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(output, pa.binary()).cast(pa.string())]
                rows = batch.slice(done, len(form))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *new], names=[*batch.schema.names[:-1], *_ADDED])
                done += len(form)

    return base.withColumn(draws, draws_of(id_col, seed)).mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def restored(form: Column, output: Column) -> Column:
    """The exact text from a form and an output."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
            .otherwise(F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
  {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS i, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS j FROM t),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
  WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form, array_to_string(units[1:i], '') AS a, array_to_string(units[i + 1:j], '') AS b, array_to_string(units[j + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
