"""Bounded-space online packing of tokenised documents into fixed windows.

Every task keeps ``open_windows`` windows.  A document is cut into full windows and a rest; the
rest goes to the open window it fits best.  When none fits, the fullest window is emitted: a
window with more than ``slack`` free places is first topped up with the head of the rest, so
little is padded and few rests are cut.  What is left in open windows when a task's input ends is
joined into full windows there, and the one partial window of each task is joined with those of
other tasks in groups of 256, round by round, until one partial window of the whole table is left.

No shuffle is needed for placing; tasks hold ``open_windows`` windows of ids, joining moves one
window per task.  Window numbers are dense: tasks' counts are summed on the driver, a row a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encode_rows
from .scratch import Scratch

_PIECE = "part int, seq long, open boolean, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"
FAN_IN = 256


class Packer:
    """Places one task's documents; ``ready`` collects emitted windows as lists of pieces."""

    def __init__(self, size: int, open_windows: int, slack: int):
        self.size, self.most, self.slack = size, open_windows, slack
        self.windows: dict[int, list] = {}
        self.free: list[tuple[int, int]] = []         # (free places, window), ascending
        self.ready: list[list] = []
        self.made = 0

    def _put(self, k: int, free: int, piece: tuple) -> None:
        """Place a piece in window ``k`` that had ``free`` places; its entry is out of ``self.free``."""
        self.windows[k].append(piece)
        if free == piece[2]:
            self.ready.append(self.windows.pop(k))
        else:
            insort(self.free, (free - piece[2], k))

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.ready.append([(doc, start, self.size, total, ids[start:start + self.size])])
            start += self.size
        while start < total:
            need = total - start
            at = bisect_left(self.free, (need, -1))
            if at < len(self.free):
                free, k = self.free.pop(at)           # the smallest free room that fits
                self._put(k, free, (doc, start, need, total, ids[start:]))
                return
            if len(self.windows) < self.most:
                self.windows[self.made] = []
                self._fresh(doc, start, need, total, ids)
                return
            free, k = self.free.pop(0)                # none fits: the fullest goes out
            if free > self.slack:
                self._put(k, free, (doc, start, free, total, ids[start:start + free]))
                start += free
            else:
                self.ready.append(self.windows.pop(k))

    def _fresh(self, doc, start, need, total, ids) -> None:
        k, self.made = self.made, self.made + 1
        self._put(k, self.size, (doc, start, need, total, ids[start:]))

    def finish(self) -> list | None:
        """Join what is left; returns the partial window."""
        left = [p for _, k in sorted(self.free) for p in self.windows[k]]
        self.free, self.windows = [], {}
        full, partial = join_pieces(left, self.size)
        self.ready += full
        return partial


def join_pieces(pieces: list, size: int) -> tuple[list, list | None]:
    """Concatenate pieces into full windows, cutting at their borders; the rest is the partial window."""
    full, window, used = [], [], 0
    for doc, start, length, total, ids in pieces:
        at = 0
        while at < length:
            take = min(length - at, size - used)
            window.append((doc, start + at, take, total, ids[at:at + take]))
            at, used = at + take, used + take
            if used == size:
                full.append(window)
                window, used = [], 0
    return full, window or None


def _batch(part: int, first: int, windows: list, is_open: bool):
    import pyarrow as pa
    rows = [(first + i, *p, o) for i, w in enumerate(windows) for p, o in zip(w, np.cumsum([0] + [x[2] for x in w[:-1]]).tolist())]
    cols = list(zip(*rows))
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(cols[0], pa.int64()), pa.array([is_open] * n), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                       pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[6], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in cols[5]], pa.binary())],
                                      ["part", "seq", "open", "doc_id", "start", "length", "doc_tokens", "offset", "ids"])


def pack_documents(docs: DataFrame, tokenizer: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
                   end_id: int | None = 1, open_windows: int = 64, slack: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32).

    Null texts are empty documents (just the end id); null ids stay null; repeated rows are separate
    documents with pieces of their own; other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession

    def place(batches):
        from pyspark import TaskContext
        part, seq, packer = TaskContext.get().partitionId(), 0, Packer(size, open_windows, slack)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, ids, lengths in encode_rows(tokenizer, batch.column(1).to_pylist(), end_id):
                at = 0
                for key, n in zip(keys[lo:hi], lengths.tolist()):
                    packer.add(key, ids[at:at + n].copy() if n < size else ids[at:at + n])
                    at += n
                if packer.ready:
                    yield _batch(part, seq, packer.ready, False)
                    seq += len(packer.ready)
                    packer.ready = []
        partial = packer.finish()
        if packer.ready:
            yield _batch(part, seq, packer.ready, False)
        if partial:
            yield _batch(part, seq + len(packer.ready), [partial], True)

    def join(key, table):                             # at most FAN_IN partial windows
        import pyarrow as pa
        pieces = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"]))
        group = key[0].as_py()
        full, partial = join_pieces([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in pieces], size)
        made = [_batch(group, 0, full, False)] if full else []
        return pa.Table.from_batches(made + ([_batch(group, len(full), [partial], True)] if partial else []))

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level = scratch.keep(chosen.mapInArrow(place, _PIECE), "pieces")
    levels = [level.filter("not open")]
    while (parts := level.filter("open").agg(F.countDistinct("part"), F.max("part")).first())[0] > 1:
        joined = level.filter("open").withColumn("grp", F.expr(f"cast(part div {FAN_IN} as int)")).groupBy("grp").applyInArrow(join, _PIECE)
        level = scratch.keep(joined, "joined")
        levels.append(level.filter("not open"))
    levels.append(level.filter("open"))
    rows, first = [], 0
    for k, df in enumerate(levels):                   # one row per task and round
        for r in sorted(df.groupBy("part").agg(F.countDistinct("seq").alias("n"), F.min("seq").alias("lo")).collect(), key=lambda r: r["part"]):
            rows.append((k, r["part"], first - r["lo"]))
            first += r["n"]
    if not rows:
        rows = [(-1, -1, 0)]
    base = spark.createDataFrame(rows, "level int, part int, base long")
    pieces = None
    for k, df in enumerate(levels):
        df = df.withColumn("level", F.lit(k))
        pieces = df if pieces is None else pieces.unionByName(df)
    return pieces.join(F.broadcast(base), ["level", "part"]).select("doc_id", "start", "length", "doc_tokens", (F.col("seq") + F.col("base")).alias("sequence_id"), "offset", "ids")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "op8"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
