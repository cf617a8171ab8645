"""WARC archives: written by Spark's text writer, read by a Python data source.

A record is text in UTF-8 that ends with two line ends, which the writer sets
between records, so any file system that Spark can write will do. The data
source plans partitions from whole files. Its reader parses the header of a
record first; filters on the record type and other header fields are pushed
down and decided there, and the payload of a record that is filtered out, or
that the caller doesn't want, is passed over without being decoded.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith
from priorwise.llm.shared import checkpointed, small

CRLF = "\r\n"
RECORD_END = CRLF + CRLF
_ID_PREFIX = "urn:page:"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: column and the header field that it holds
HEADER_FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "payload_length": "x-payload-length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_FIELDS if c != "payload_length") + ", payload_length long, payload binary"
_ARROW = pa.schema([(c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADER_FIELDS] + [("payload", pa.binary())])
_BATCH_BYTES = 8 << 20


# ---------------------------------------------------------------- writing


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_ID_PREFIX}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html`` with ``payload_bytes, payload_digest, record_type, refers_to``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the largest page_id is the response and the others revisit it. A null html
    is empty. Rows that repeat the response's page_id are responses too; a null
    page_id is below all others. Only digests that occur more than once are
    joined back; up to a stated number they are broadcast, so that no payload is
    shuffled, beyond it Spark joins by digest.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    octets = F.encode("html", "UTF-8")
    pages = pages.select("*", F.octet_length(octets).cast("long").alias("payload_bytes"), F.sha1(octets).alias("payload_digest"))
    copies = (
        pages.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", "kept")
    )
    revisits = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= least_bytes)
    copies = small(checkpointed(copies))
    return pages.join(copies, "payload_digest", "left").select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("kept")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "none") -> None:
    """One WARC file for each partition of ``plan_records``; ``compression`` is none or gzip."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "")
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_REVISIT_PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(F.encode(http, "UTF-8")) + F.octet_length(F.encode(payload, "UTF-8"))).cast("string")),
        F.lit(CRLF),
        http,
        payload,
    )
    records.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


# ---------------------------------------------------------------- reading


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///", 1))
    return pafs.LocalFileSystem(), path


@dataclass
class ArchiveFiles(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def plan_partitions(sizes: list[tuple[str, int]], target: int) -> list[ArchiveFiles]:
    """Whole files grouped in order up to about ``target`` bytes; larger files stand alone."""
    out: list[ArchiveFiles] = []
    filled = 0
    for path, size in sizes:
        if not out or filled + size > target:
            out.append(ArchiveFiles([]))
            filled = 0
        out[-1].paths.append(path)
        filled += size
    return out


def _header(stream: BinaryIO) -> dict[str, str] | None:
    """Fields of the next record, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def _row(fields: dict[str, str]) -> dict:
    row: dict = {c: fields.get(f) for c, f in HEADER_FIELDS.items()}
    for c in ("record_id", "refers_to"):
        if row[c]:
            row[c] = row[c].strip("<>")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    return row


_TESTS: dict[type, Callable] = {
    EqualTo: lambda have, want: have == want,
    EqualNullSafe: lambda have, want: have == want,
    In: lambda have, want: have in want,
    StringStartsWith: lambda have, want: have.startswith(want),
    StringEndsWith: lambda have, want: have.endswith(want),
    StringContains: lambda have, want: want in have,
}


def _passes(row: dict, tests: list[tuple[str, type, object]]) -> bool:
    for column, kind, want in tests:
        have = row[column]
        if kind in (IsNull, IsNotNull):
            if (have is None) != (kind is IsNull):
                return False
        elif kind is EqualNullSafe:
            if have != want:
                return False
        elif have is None or not _TESTS[kind](have, want):
            return False
    return True


def read_records(stream: BinaryIO, tests: list[tuple[str, type, object]], payloads: bool, seekable: bool) -> Iterator[dict]:
    """Rows of one archive that pass the tests on header fields."""
    while (fields := _header(stream)) is not None:
        left = int(fields["content-length"])
        row = _row(fields)
        if not _passes(row, tests):
            _skip(stream, left, seekable)
            continue
        row["payload"] = None
        if payloads and row["record_type"] != "revisit":
            if "application/http" in fields.get("content-type", ""):
                while left > 0:
                    line = stream.readline()
                    left -= len(line)
                    if line in (b"\r\n", b"\n", b""):
                        break
            row["payload"] = stream.read(left)
        else:
            _skip(stream, left, seekable)
        yield row


def _skip(stream: BinaryIO, n: int, seekable: bool) -> None:
    if seekable:
        stream.seek(n, 1)
    else:
        while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
            n -= got


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.target = int(options.get("partitionBytes", 64 << 20))
        self.payloads = str(options.get("payloads", "true")).lower() == "true"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_FIELDS and type(f) in (*_TESTS, IsNull, IsNotNull):
                self.tests.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[ArchiveFiles]:
        fs, root = _file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
        return plan_partitions(files, self.target) or [ArchiveFiles([])]

    def read(self, partition: ArchiveFiles) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            packed = path.endswith(".gz")
            raw = fs.open_input_stream(path, compression=None) if packed else fs.open_input_file(path)
            with raw, _buffered(raw, packed) as stream:
                for row in read_records(stream, self.tests, self.payloads, not packed):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _buffered(raw: pa.NativeFile, packed: bool) -> BinaryIO:
    import io

    return gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 18)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options: path, payloads (true or false), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below ``path``; filters on header columns are pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def page_number(urn: str) -> Column:
    """page_id in a column of record ids that ``write_archives`` made; null if it had none."""
    return F.regexp_extract(urn, f"^{_ID_PREFIX}(-?[0-9]+)$", 1).try_cast("long")
