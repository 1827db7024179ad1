"""WARC archives of pages and an external index merge over them.

Every task streams its pages into gzip-per-record archives of bounded size and sorts the captures of an
archive by URL key and time: a run.  Runs are merged by ranges of (URL key, time, record): a task gets its
range of every run and merges the runs with a loser tree, so the history is in order over all tasks, and a
URL with very many captures spreads over several ranges.  Payloads equal to one already archived (the one
with the smallest page id) are stored as revisit records; equality is by SHA-1, counted in a first pass
with partial aggregation, so a payload that a third of all pages share is no hot spot.

Archive names carry the attempt, and only names in the written index count; a repeated task leaves an
unused file at worst.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, open_fs

ARCHIVE_BYTES = 64 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "urlkey string, ts long, record string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, port if not the scheme's own, path and query, all in lower case; no scheme, user or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    port = "" if port in (None, 80 if u.scheme == "http" else 443) else f":{port}"
    return f"{','.join(reversed(host.removeprefix('www.').split('.')))}{port}){u.path or '/'}{'?' + u.query if u.query else ''}"


def record_bytes(page_id, url: str | None, seconds: int, payload: bytes, refers_to) -> bytes:
    """One gzip member holding a response or, with ``refers_to``, a revisit record (without the payload)."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
            f"WARC-Date: {(EPOCH + timedelta(seconds=seconds)).strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def parse_record(member: bytes) -> tuple[dict, bytes]:
    """(header fields, payload) of a gzip member; the payload of a revisit is empty."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the next smallest costs one path of matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._enter(i)

    def _head(self, i: int):
        """Key of a run's head; an ended run loses to every other, a run yet to enter (-1) beats it."""
        if i == -1:
            return (-1,)
        return (1,) if self.at[i] == len(self.runs[i]) else (0, self.runs[i][self.at[i]], i)

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self._head(self.losers[node]) < self._head(i):
                i, self.losers[node] = self.losers[node], i
            if i == -1:
                return
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        if not self.runs:
            return
        while True:
            i = self.losers[0]
            if self.at[i] == len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._enter(i)


def write_archives(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns the runs: one row per record with URL key, time, archive, offset and length.

    A null payload is empty.  Of equal payloads of at least ``min_bytes`` the smallest id is the response
    and the others revisit it; rows repeated with that id are all responses; a null id is never referred
    to.  A null URL has an empty key.  Other columns are ignored.
    """
    folder = scratch.path("archives")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    shared = scratch.keep(shared, "shared")
    known = rows.join(shared, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        from pyspark import TaskContext
        import pyarrow as pa
        ctx = TaskContext.get()
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        out, name, at, made, run = None, "", 0, 0, []

        def close():
            out.close()
            run.sort(key=lambda r: r[:3])
            cols = list(zip(*run))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                              ["urlkey", "ts", "record", "page_id", "file", "offset", "length"])

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name = f"capture-{ctx.partitionId():05d}-{made:03d}.attempt-{ctx.taskAttemptId()}.warc.gz"
                    out, at, run, made = filesystem.open_output_stream(f"{root}/{name}", compression=None), 0, [], made + 1
                seconds = (page or 0) % (1 << 31)
                member = record_bytes(page, url, seconds, payload, refers)
                out.write(member)
                run.append((url_key(url), seconds, f"{page}", page, f"{folder}/{name}", at, len(member)))
                at += len(member)
                if at >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return scratch.keep(known.mapInArrow(write, _INDEX), "runs")


def merge_runs(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The runs merged into one history: the index rows with ``position``, ascending by (urlkey, ts, record) over all tasks."""
    def merge(batches):
        from pyspark import TaskContext
        import pyarrow as pa
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)                # one range of all runs
        file = table.column("file").to_pylist()
        keys = list(zip(*(table.column(c).to_pylist() for c in ("urlkey", "ts", "record")), range(len(file))))
        cuts = [0] + [i for i in range(1, len(file)) if file[i] != file[i - 1]] + [len(file)]
        order = [k[3] for k in LoserTree([keys[a:b] for a, b in zip(cuts[:-1], cuts[1:])])]
        part = TaskContext.get().partitionId()
        merged = table.take(pa.array(order))
        merged = merged.append_column("part", pa.array([part] * len(order), pa.int32())).append_column("seq", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches()

    ranges = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", "record").sortWithinPartitions("file", "urlkey", "ts", "record")
    merged = scratch.keep(dealt.mapInArrow(merge, f"{_INDEX}, part int, seq long"), "merged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))    # one row per range
    return merged.join(F.broadcast(base), "part").withColumn("position", F.col("base") + F.col("seq")).drop("part", "seq", "base")


def read_archives(history: DataFrame) -> DataFrame:
    """Records read back from the archives, a task reading its archives from front to back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, position and the payload (of responses, checked against its digest)."""
    def read(batches):
        import pyarrow as pa
        name, source = None, None
        for batch in batches:
            out = []
            for file, offset, length, position in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if file != name:
                    if source:
                        source.close()
                    filesystem, path = open_fs(file)
                    name, source = file, filesystem.open_input_file(path)
                fields, payload = parse_record(source.read_at(length, offset))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload digest differs in {file} at {offset}")
                out.append((_page(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), digest, kind, _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], position, payload if kind == "response" else None))
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "position", "payload"])

    files = history.agg(F.countDistinct("file")).first()[0]       # index rows are small, archives are not: a task per archive
    archives = history.select("file", "offset", "length", "position").repartition(max(files, 1), "file").sortWithinPartitions("file", "offset")
    return archives.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, position long, payload binary")


def _page(uri: str | None):
    text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "none") else None


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    runs = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    return read_archives(merge_runs(runs, scratch)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")
