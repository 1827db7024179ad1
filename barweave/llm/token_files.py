"""Token-id files: flat unsigned integers plus 64-bit document offsets, memory-mapped on reading.

One file set per range of ids: ``part-NNNNN.ids`` (uint16 or uint32, little-endian),
``part-NNNNN.offsets`` (int64, one more than documents) and ``part-NNNNN.docs`` (int64 document
ids; those without one come first and are counted in the manifest).  The manifest gives every
part its first token and first document by prefix sums over the parts' counts.

Texts are shuffled once, by range of the id; every task streams its range to its files, so
neither a task nor the driver holds more than a batch.  The driver sees one row per file.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encode_rows, encoder
from .scratch import Scratch, is_local, open_fs

_MANIFEST = "part int, n_docs long, n_nulls long, n_tokens long, width int"


def write_token_files(docs: DataFrame, tokenizer: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int | None = 2, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` in ascending id order into token files; returns the manifest with ``folder``, ``first_token``, ``first_doc``.

    Null texts are empty, null ids sort first, repeated rows are separate documents (ties lie next
    to each other, ordered by text), other columns are ignored.  An empty table gives no files.
    """
    folder = scratch.path("tokens")

    def write(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        width = 2 if max(encoder(tokenizer).vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
        part, n_docs, n_nulls, total = ctx.partitionId(), 0, 0, 0
        names = {k: f"{root}/part-{part:05d}.{k}" for k in ("ids", "offsets", "docs")}
        tried = {k: f"{v}.attempt-{ctx.taskAttemptId()}" for k, v in names.items()}
        out = {}
        for batch in batches:
            keys = batch.column(0)
            n_nulls += keys.null_count
            keys = np.asarray(keys.fill_null(0), dtype="<i8")
            texts = batch.column(1).to_pylist()
            for lo, hi, ids, lengths in encode_rows(tokenizer, texts, end_id):
                if not out:
                    out = {k: filesystem.open_output_stream(v) for k, v in tried.items()}
                    out["offsets"].write(np.zeros(1, "<i8").tobytes())
                out["ids"].write(ids.astype(f"<u{width}").tobytes())
                out["offsets"].write((total + np.cumsum(lengths)).astype("<i8").tobytes())
                out["docs"].write(keys[lo:hi].tobytes())
                n_docs, total = n_docs + hi - lo, total + len(ids)
        import pyarrow as pa
        for k, f in out.items():
            f.close()
            filesystem.move(tried[k], names[k])      # a repeated task replaces its files by the same bytes
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_nulls": [n_nulls], "n_tokens": [total], "width": pa.array([width], pa.int32())})

    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = chosen.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    manifest = scratch.keep(ordered.mapInArrow(write, _MANIFEST), "manifest")
    rows, token, doc = [], 0, 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):     # one row per file
        rows.append((folder, r["part"], r["n_docs"], r["n_nulls"], r["n_tokens"], r["width"], token, doc))
        token, doc = token + r["n_tokens"], doc + r["n_docs"]
    index = spark.createDataFrame(rows, f"folder string, {_MANIFEST}, first_token long, first_doc long")
    return scratch.keep(index.coalesce(1), "index")


def _map_file(filesystem, path: str, kind: str):
    if is_local(filesystem):
        return np.memmap(path, dtype=kind, mode="r")
    with filesystem.open_input_file(path) as f:       # a remote store has no memory maps
        return np.frombuffer(f.read(), dtype=kind)


def read_token_files(manifest: DataFrame, with_ids: bool = False, id_name: str = "doc_id") -> DataFrame:
    """Read the files back, one task per file: id, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``
    (unsigned, of the ids as little-endian uint32) and, if asked, the ``ids`` themselves."""
    schema = f"{id_name} long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches):
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                filesystem, root = open_fs(r["folder"])
                name = f"{root}/part-{r['part']:05d}"
                ids = _map_file(filesystem, f"{name}.ids", f"<u{r['width']}") if r["n_tokens"] else np.zeros(0, "<u2")
                offsets, keys = _map_file(filesystem, f"{name}.offsets", "<i8"), _map_file(filesystem, f"{name}.docs", "<i8")
                for lo in range(0, r["n_docs"], 2048):
                    hi = min(lo + 2048, r["n_docs"])
                    at = np.asarray(offsets[lo:hi + 1])
                    block = np.asarray(ids[at[0]:at[-1]]).astype("<u4")
                    cut = at - at[0]
                    view = memoryview(block).cast("B")
                    cols = {id_name: pa.array(np.asarray(keys[lo:hi]), mask=np.arange(lo, hi) < r["n_nulls"]),
                            "start": pa.array(r["first_token"] + at[:-1]), "n_tokens": pa.array(np.diff(at)),
                            "ids_crc32": pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(block.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(cols)

    spark: SparkSession = manifest.sparkSession
    files = manifest.count()
    return manifest.repartitionByRange(max(files, 1), "part").mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "op2"), end_id=2)
    return read_token_files(manifest)
