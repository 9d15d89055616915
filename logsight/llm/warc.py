"""WARC archives as a chunked record table.

A payload goes out as rows of (record, chunk number, text): the first chunk in
a record of its type, later ones in WARC ``continuation`` records with segment
numbers. Spark's text writer turns the rows into gzip WARC files. Reading
walks the lines of a file, counts bytes against Content-Length and carries
one running digest across the chunks of a record.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logsight.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 18


def _record(kind: str, name: str, fields: list[tuple[str, object]], payload: str, size: int) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), *fields, ("Content-Length", size)])
    return f"WARC/1.1\r\n{head}\r\n{payload}\r\n\r"  # the writer ends the row with the last \n


def _chunks(payload: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end between code points."""
    at = 0
    while at < len(payload) or not at:
        end = min(at + size, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end += 1
        yield payload[at:end]
        if end == len(payload):
            return
        at = end


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_revisit: int = 1000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (record_id, chunk, value): the WARC records of every page, in order
    within a record. Of pages with equal payloads of ``least_revisit`` bytes or
    more, the largest id is the response and the others revisit it.

    Equal means equal SHA-256 and length; only digests are shuffled to find
    them, and the payloads meet the decision by id. Null payloads are empty;
    a null id is written without one and never revisits; rows that repeat an id
    and payload are records of their own and share a type; other columns are not read.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    marked = source.select("id", F.length("payload").alias("size"), F.sha2("payload", 256).alias("key")).filter((F.col("size") >= least_revisit) & F.col("id").isNotNull())
    last = marked.groupBy("key", "size").agg(F.max("id").alias("target"), F.min("id").alias("low")).filter("low < target").drop("low")
    revisits = marked.join(last, ["key", "size"]).filter(F.col("id") < F.col("target")).groupBy("id", F.col("key").alias("rkey")).agg(F.max("target").alias("refers_to"))
    rows = source.select("*", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("rkey")).join(revisits, ["id", "rkey"], "left").drop("rkey")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("chunk", pa.int64()), ("value", pa.string())])
        for batch in batches:
            for row in range(batch.num_rows):
                ident, url, payload, digest, target = (c[row].as_py() for c in batch.columns)
                name = "" if ident is None else str(ident)
                facts = [("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if target is not None:
                    more = [("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Payload-Length", len(payload))]
                    yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([1]), pa.array([_record("revisit", name, facts + more, "", 0)])], schema=schema)
                    continue
                total, several = len(payload), len(payload) > chunk_bytes
                for k, piece in enumerate(_chunks(payload, chunk_bytes), 1):
                    fields = facts if k == 1 else [("WARC-Segment-Origin-ID", f"<urn:page:{name}>")]
                    if several:
                        fields = [*fields, ("WARC-Segment-Number", k)]
                        total -= len(piece)
                        if not total:
                            fields.append(("WARC-Segment-Total-Length", len(payload)))
                    text = _record("response" if k == 1 else "continuation", name if k == 1 else f"{name}/{k}", fields, piece.decode(), len(piece))
                    yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([k]), pa.array([text])], schema=schema)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few rows a batch are slow to hand over: joins them up to some bytes."""
        held, size = [], 0
        for one in work(batches):
            held.append(one)
            size += one.nbytes
            if size > CHUNK_BYTES or len(held) >= 1000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(gathered, "record_id long, chunk long, value string")


def write_archives(chunks: DataFrame, path: str | None = None) -> str:
    """Writes a chunk table as gzip WARC files; a record's chunks stay together
    in one file. ``path`` is by default a new folder below the shared checkpoint folder."""
    path = path or f"{ensure_checkpoint_dir(chunks.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    chunks.select("value").write.option("compression", "gzip").option("lineSep", "\n").text(path)
    return path


class _Reader:
    """Reads WARC lines one by one; ``done`` holds finished records."""

    def __init__(self) -> None:
        self.state, self.left, self.fields, self.done = "start", 0, {}, []
        self.open: dict | None = None

    def line(self, data: bytes) -> None:
        if self.state == "payload":
            if len(data) < self.left:
                self._take(data)
                self._take(b"\n")
            else:
                body, rest = data[:self.left], data[self.left:]
                self._take(body)
                if rest != b"\r":
                    raise ValueError("a WARC record is longer than its Content-Length")
                self.state = "end"
            if not self.left and self.state == "payload":
                self.state = "close"
        elif self.state == "close":
            if data != b"\r":
                raise ValueError("a WARC record is longer than its Content-Length")
            self.state = "end"
        elif self.state == "end":
            if data != b"\r":
                raise ValueError("a WARC record does not end where it should")
            self.state = "start"
            self._finish()
        elif self.state == "start":
            if data != b"WARC/1.1\r":
                raise ValueError(f"not a WARC record: {data[:40]!r}")
            self.fields, self.state = {}, "head"
        elif data == b"\r":
            self._begin()
        else:
            key, _, value = data[:-1].decode().partition(": ")
            self.fields[key] = value

    def _begin(self) -> None:
        self.left = int(self.fields["Content-Length"])
        if self.fields["WARC-Type"] != "continuation":
            if self.open:
                raise ValueError("a segmented WARC record has no end")
            self.open = {"head": self.fields, "sha1": hashlib.sha1(), "size": 0}
        elif not self.open or self.fields["WARC-Segment-Origin-ID"] != self.open["head"]["WARC-Record-ID"]:
            raise ValueError("a WARC continuation without its record")
        self.state = "payload" if self.left else "close"

    def _take(self, data: bytes) -> None:
        self.open["sha1"].update(data)
        self.open["size"] += len(data)
        self.left -= len(data)

    def _finish(self) -> None:
        if "WARC-Segment-Number" in self.fields and "WARC-Segment-Total-Length" not in self.fields:
            return
        head, size, digest = self.open["head"], self.open["size"], self.open["sha1"].hexdigest()
        named = head["WARC-Payload-Digest"].removeprefix("sha1:")
        number = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn != "<urn:page:>" else None
        if head["WARC-Type"] == "revisit":
            size, digest = int(head["WARC-Payload-Length"]), named
        elif digest != named or int(self.fields.get("WARC-Segment-Total-Length", size)) != size:
            raise ValueError("a WARC payload does not have the digest or length it names")
        self.done.append((number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To"))))
        self.open = None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest (of the
    payload as read; of a revisit, as its header names it), record_type, refers_to.
    A gzip file is read by one task, line by line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                reader.line(value)
            if reader.done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reader.done), types)], names)
                reader.done = []
        if reader.state != "start" or reader.open:
            raise ValueError("a WARC file ends inside a record")

    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    return lines.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
