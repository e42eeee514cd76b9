"""WARC archives as a PySpark Python data source (operator 8).

*Write.* ``df.write.format("warc")`` writes gzip archives of about ``FILE_BYTES``: one gzip member a record, whose extra field ``sl`` holds the
member's compressed and uncompressed length, so that a reader can step over it.  A task's files count only when the job commits: the
driver then writes a list of them, with offsets where a reader may start; files of lost or repeated tasks are on no list.
*Read.* ``spark.read.format("warc")`` plans one partition for each listed stretch of about ``SPLIT_BYTES`` (one a file for archives without a
list).  A record's WARC headers are inflated first; where they fail a pushed predicate (record type, target URI, payload digest, record
id, refers-to, date: equality and IN) the rest of the member is neither read nor inflated.  With option ``payload`` = ``false`` no payload is
decoded at all.  Plain ``.warc`` files are read alike, by their content lengths.

Revisit records carry no payload; digest and length of the full payload are in their headers.

Cases: a null payload is an empty one; records without an id or URI lack these headers and read as null; repeated rows are records each;
an empty table writes an empty list and reads as an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from payscope.llm.common import keep, shared_path, table

FILE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
LEVEL = 4
MIN_REVISIT_BYTES = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, "
          "refers_to string, payload binary")
#: Column and header (fixed values).
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Bytes", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def open_fs(path: str):
    """(file system, path in it) of a local path or a URI."""
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


# -- one record -------------------------------------------------------------------------------------------------

def record_bytes(row: dict, payload: bytes) -> bytes:
    """The uncompressed record: headers, block, end."""
    revisit = row["record_type"] == "revisit"
    block = b"" if revisit else HTTP % len(payload) + payload
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if (value := row.get(column)) is not None:
            lines.append(f"{header}: {str(value).replace(chr(13), ' ').replace(chr(10), ' ')}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    else:
        lines.append("Content-Type: application/http;msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with the extra field ``sl`` (whole member's length, record's length)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, size, len(raw)) + body
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def payload_of(block: bytes, headers: dict[str, str]) -> bytes | None:
    if headers.get("warc-type") == "revisit":
        return None
    if "application/http" in headers.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


# -- reading ----------------------------------------------------------------------------------------------------

@dataclass
class Stretch(InputPartition):
    """Records of a file that start in [start, end)."""

    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


@dataclass
class Wanted:
    """Allowed values by column, and whether payloads are wanted."""

    values: dict[str, list] = field(default_factory=dict)
    payload: bool = True

    def has(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c].lower()) in v for c, v in self.values.items())


class _Source:
    """A file, read forward with steps over what is not wanted."""

    def __init__(self, stream, start: int):
        self.stream, self.at, self.held = stream, start, b""
        stream.seek(start)

    def more(self, n: int) -> bytes:
        """At least ``n`` held bytes, if the file has them."""
        while len(self.held) < n and (got := self.stream.read(max(n - len(self.held), 1 << 16))):
            self.held += got
        return self.held

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.held = b""
            self.stream.seek(self.at)


def _row(headers: dict[str, str], payload: bytes | None) -> tuple:
    out = [headers.get(h.lower()) for h in HEADERS.values()]
    n = out[5] if out[5] is not None else (len(payload) if payload is not None else None)
    out[5] = int(n) if n is not None else None
    return (*out, payload)


def _compressed(src: _Source, end: int, wanted: Wanted, seen: dict) -> Iterator[tuple]:
    while src.at < end and src.more(24):
        head = src.held
        known = struct.unpack("<II", head[16:24])[0] if head[3] & 4 and head[12:14] == b"sl" else 0
        inflate, raw, fed = zlib.decompressobj(31), b"", 0
        # headers first: a little input at a time until the blank line
        while (cut := raw.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            step = 2048
            if not (part := src.more(fed + step)[fed: fed + step]):
                break
            fed += len(part)
            raw += inflate.decompress(part)
        headers = parse_headers(raw[:cut] if cut >= 0 else raw)
        good = wanted.has(headers)
        if not (known and not (good and wanted.payload)):
            chunks = [raw]
            while not inflate.eof:
                if not (part := src.more(fed + (1 << 16))[fed: fed + (1 << 16)]):
                    break
                fed += len(part)
                chunks.append(inflate.decompress(part))
                if not good:
                    chunks = chunks[:1]
            raw = b"".join(chunks)
            seen["inflated"] = seen.get("inflated", 0) + 1
        size = known or fed - len(inflate.unused_data)
        if good:
            block = raw[cut + 4: cut + 4 + int(headers.get("content-length", 0))] if wanted.payload else b""
            yield _row(headers, payload_of(block, headers) if wanted.payload else None)
        src.skip(size)


def _plain(src: _Source, end: int, wanted: Wanted, seen: dict) -> Iterator[tuple]:
    while src.at < end:
        n = 4096
        while (cut := src.more(n).find(b"\r\n\r\n")) < 0 and len(src.held) >= n:
            n *= 2
        if cut < 0:
            return
        headers = parse_headers(src.held[:cut])
        size = int(headers.get("content-length", 0))
        if wanted.has(headers):
            payload = None
            if wanted.payload:
                payload = payload_of(src.more(cut + 4 + size)[cut + 4: cut + 4 + size], headers)
                seen["inflated"] = seen.get("inflated", 0) + 1
            yield _row(headers, payload)
        src.skip(cut + 4 + size + 4)


def read_stretch(part: Stretch, wanted: Wanted, seen: dict | None = None) -> Iterator[tuple]:
    """Rows of ``SCHEMA``; ``seen`` counts the records whose block was decoded."""
    fs, path = open_fs(part.path)
    with fs.open_input_file(path) as stream:
        how = _compressed if path.endswith(".gz") else _plain
        yield from how(_Source(stream, part.start), part.end, wanted, {} if seen is None else seen)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.wanted = Wanted(payload=options.get("payload", "true").lower() != "false")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and column != "payload_bytes" and isinstance(f, (EqualTo, In)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                old = self.wanted.values.get(column)
                self.wanted.values[column] = [v for v in values if v is not None and (old is None or v in old)]
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        from pyarrow.fs import FileSelector, FileType
        fs, root = open_fs(self.path)
        files = {x.base_name: x for x in fs.get_file_info(FileSelector(root)) if x.type == FileType.File}
        lists = [x for n, x in files.items() if n.startswith("_committed-")]
        if not lists:
            return [Stretch(f"{self.path.rstrip('/')}/{n}", 0, x.size) for n, x in sorted(files.items()) if n.endswith((".warc", ".warc.gz"))]
        out = []
        for x in sorted(lists, key=lambda x: x.base_name):
            with fs.open_input_stream(x.path) as s:
                for name, starts, size in json.loads(s.read()):
                    out += [Stretch(f"{self.path.rstrip('/')}/{name}", a, b) for a, b in zip(starts, [*starts[1:], size])]
        return out

    def read(self, partition: Stretch | None) -> Iterator[tuple]:
        return read_stretch(partition, self.wanted) if partition is not None else iter(())  # None: no archives


# -- writing ----------------------------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"].rstrip("/"), columns
        self.file_bytes, self.split_bytes = int(options.get("fileBytes", FILE_BYTES)), int(options.get("splitBytes", SPLIT_BYTES))

    def write(self, iterator: Iterator) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, stream = [], None
        try:
            for r in iterator:
                row = {c: r[i] for i, c in enumerate(self.columns)}
                payload = row.get("payload")
                data = member(record_bytes(row, bytes(payload) if payload is not None else b""))
                if stream is None:
                    files.append([f"part-{uuid.uuid4().hex}.warc.gz", [], 0])
                    stream = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None)
                name, starts, size = files[-1]
                if not starts or size - starts[-1] >= self.split_bytes:
                    starts.append(size)
                stream.write(data)
                files[-1][2] += len(data)
                if files[-1][2] >= self.file_bytes:
                    stream.close()
                    stream = None
        finally:
            if stream is not None:
                stream.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}.json") as s:
            s.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/{f[0]}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("write archives to a new folder, or append")
        return WarcWriter(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- pages ------------------------------------------------------------------------------------------------------

def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The WARC record of each page, as columns of ``SCHEMA``.

    Pages of equal payload (by digest) of at least ``min_bytes``: the largest id is the response, the others revisit it.  The
    largest ids come from one pre-aggregated pass over digests; only digests that occur twice are joined back.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), body.alias("payload"),
                        F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    twice = keep(rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("digest").alias("d"))
                 .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-twice")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    rows = rows.join(twice, F.col("digest") == F.col("d"), "left")
    return rows.select(urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
                       F.lit(DATE).alias("date"), F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), "payload_bytes",
                       F.when(revisit, urn(F.col("first"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_path(spark, "warc")
    records_of(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
    return back.select(number("record_id").alias("page_id"),
                       F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                       F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.substring("payload_digest", 6, 40)).alias("payload_digest"),
                       "record_type", number("refers_to").alias("refers_to"))


QUERIES = {"op8_warc_archive": op8_warc_archive}

ORACLE_SQL = {"op8_warc_archive": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""}
