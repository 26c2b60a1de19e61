"""WARC files as a PySpark data source.

`write.format("warc")` makes one gzip member a record and rolls files at `max_file_bytes`; a task's files appear under
their final names only when the job commits. `read.format("warc")` plans partitions of whole files, about
`partition_bytes` each, and takes record-type and header predicates: filters on record_type, target_uri, record_id and
payload_digest are pushed to the reader, which parses a record's headers first and goes past payloads that the headers
rule out, or all of them with option `payload=false`, without decoding them to a column.

Schema: record_type, record_id, target_uri, payload_digest (hex SHA-1), payload_bytes (of the full payload),
refers_to (record_id, for revisits), payload (null for revisits).

Defined results: a null URL gives no WARC-Target-URI and reads as null; a null payload is empty; line breaks in header
values are percent-encoded; records repeated in full are all written; empty frames write no file and empty folders read as
no rows. `archive()` writes one response for records with equal payloads (of `min_bytes` at least), that of the largest id,
and revisits for the others; records with a null id are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from quillon.llm.common import Out, rows, table, tune, work_path

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
_DATE = "2024-01-01T00:00:00Z"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _clean(value: str) -> str:
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", value)


def _raw(value: str) -> str:
    return re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), value)


def record(kind: str, record_id: str, uri: str | None, digest: str, full_bytes: int, refers_to: str | None, payload: bytes | None) -> bytes:
    body = payload or b""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {_DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {full_bytes}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{_clean(refers_to)}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


@dataclass
class Files(WriterCommitMessage):
    done: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("max_file_bytes", 64 << 20))
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, at = _fs(self.path)
        attempt, done, out = uuid.uuid4().hex, [], None
        for kind, record_id, uri, digest, full, refers, payload in rows(iterator):
            if out is None:
                hidden, final = f"{at}/_attempt-{attempt}-{len(done)}", f"{at}/part-{attempt}-{len(done):05d}.warc.gz"
                fs.create_dir(at, recursive=True)
                out = fs.open_output_stream(hidden)
                done.append((hidden, final))
            squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            out.write(squeeze.compress(record(kind, record_id or "", uri, digest, full, refers, payload)) + squeeze.flush())
            if out.tell() >= self.most:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Files(done)

    def commit(self, messages: list[Files | None]) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for hidden, final in m.done if m else []:
                fs.move(hidden, final)

    def abort(self, messages: list[Files | None]) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for hidden, _final in m.done if m else []:
                if fs.get_file_info(hidden).type != pafs.FileType.NotFound:
                    fs.delete_file(hidden)


@dataclass
class FileGroup(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    #: Columns known from the headers alone.
    HEADERS = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.size = int(options.get("partition_bytes", 16 << 20))
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column in self.HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in self.HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in self.HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, at = _fs(self.path)
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            return []
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.is_file and not x.base_name.startswith(("_", ".")))
        groups: list[list[str]] = []
        held = self.size
        for path, size in found:
            if held + size > self.size:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [FileGroup(tuple(g)) for g in groups]

    def wanted(self, head: dict[str, object]) -> bool:
        return all(head[c] in v if how == "in" else isinstance(head[c], str) and head[c].startswith(v) for c, how, v in self.tests)

    def read(self, partition: FileGroup | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        fs, _ = _fs(self.path)
        out = Out(_ARROW)
        for path in partition.files:
            with fs.open_input_stream(path, compression=None) as f:
                for head, payload in records(f, path.endswith(".gz"), self.wanted, self.payload):
                    if out.add(*(head[c] for c in _ARROW.names[:-1]), payload):
                        yield from out.flush()
        yield from out.flush()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("the warc sink only appends")
        return WarcWriter(dict(self.options))


class _Bytes:
    """Decompressed bytes of a stream, read on demand: take() gives bytes, skip() drops them as they come."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed = stream, packed
        self.buffer, self.tail, self.engine = bytearray(), b"", None

    def _more(self) -> bool:
        if not self.packed:
            part = self.stream.read(1 << 16)
            self.buffer += part
            return bool(part)
        while True:
            if not self.tail:
                self.tail = self.stream.read(1 << 16)
                if not self.tail:
                    return False
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            part = self.engine.decompress(self.tail, 1 << 18)
            if self.engine.eof:
                self.tail, self.engine = self.engine.unused_data, None
            else:
                self.tail = self.engine.unconsumed_tail
            if part:
                self.buffer += part
                return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        head = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a WARC record ends early")
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got

    def skip(self, n: int) -> None:
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer.clear()
            if not self._more():
                raise ValueError("a WARC record ends early")
        del self.buffer[:n]


def records(stream, packed: bool, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict[str, object], bytes | None]]:
    """Headers of the wanted records, and their payloads."""
    data = _Bytes(stream, packed)
    while (raw := data.until(b"\r\n\r\n")) is not None:
        lines = raw.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("this is no WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        digest = fields.get("warc-payload-digest", "")
        kind = fields.get("warc-type")
        head = {
            "record_type": kind,
            "record_id": _raw(fields.get("warc-record-id", "").strip("<>")),
            "target_uri": _raw(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
            "payload_digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None,
            "payload_bytes": int(fields.get("x-payload-length", size)),
            "refers_to": _raw(fields["warc-refers-to"].strip("<>")) if "warc-refers-to" in fields else None,
        }
        if wanted(head):
            body = data.take(size) if payload and kind != "revisit" else data.skip(size)
            if body is not None and head["payload_digest"] not in (None, hashlib.sha1(body).hexdigest()):
                raise ValueError(f"the payload of {head['record_id']} differs from its digest")
            yield head, body
        else:
            data.skip(size)
        data.skip(4)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, min_bytes: int = 1000) -> None:
    """Write the pages as WARC files under path. Payloads are shuffled at most once, by their id; the groups of equal
    payloads are found from digests, pre-aggregated, and only ids of revisits are joined back."""
    register(pages.sparkSession)
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    seen = pages.select(F.col(id_col).cast("long").alias("_id"), F.sha1(body).alias("_sha1"), F.sha2(body, 256).alias("_sha2"), F.octet_length(body).cast("long").alias("_bytes"))
    groups = seen.filter(F.col("_bytes") >= min_bytes).groupBy("_sha2").agg(F.max("_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").select("_sha2", "_last")
    revisits = seen.filter(F.col("_bytes") >= min_bytes).join(groups, "_sha2").filter("_id < _last").select(F.col("_id").alias("_rid"), F.col("_sha2").alias("_rsha2"), "_last").distinct()
    full = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), body.alias("_body")).withColumns({"_sha1": F.sha1("_body"), "_sha2": F.sha2("_body", 256), "_bytes": F.octet_length("_body").cast("long")})
    joined = full.join(revisits, (F.col("_id") == F.col("_rid")) & (F.col("_sha2") == F.col("_rsha2")), "left")
    again = F.col("_last").isNotNull()
    joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("none"))).alias("record_id"),
        F.col("_url").cast("string").alias("target_uri"),
        F.col("_sha1").alias("payload_digest"),
        F.col("_bytes").alias("payload_bytes"),
        F.when(again, F.concat(F.lit("urn:page:"), F.col("_last").cast("string"))).alias("refers_to"),
        F.when(~again, F.col("_body")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(tune(spark), "warc")
    archive(table(spark, sf_dir, "pages"), "page_id", "url", "html", path)
    found = spark.read.format("warc").load(path)
    body = F.col("payload")

    def page(c: str):
        return F.nullif(F.substring_index(c, ":", -1), F.lit("none")).cast("long")

    return found.select(
        page("record_id").alias("page_id"),
        F.when(body.isNotNull(), F.octet_length(body).cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(body.isNotNull(), F.sha1(body)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        "target_uri",
    )


OP1_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN d.page_id < g.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < g.last THEN g.last END AS refers_to, d.url AS target_uri
FROM d LEFT JOIN g ON d.digest = g.digest AND d.n >= 1000
"""
