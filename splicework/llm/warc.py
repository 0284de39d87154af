"""WARC archives as a Python data source, for writing and reading.

Writing: every record is a gzip member of its own in files of at most FILE_BYTES, each of
which begins with a ``warcinfo`` record. A member's extra field ``SL`` tells its compressed
and uncompressed length. Tasks write under names that readers skip; the commit renames
what succeeded, so a lost or repeated task leaves nothing behind.

Reading: the files of a folder are dealt to partitions of about PARTITION_BYTES, a file
to one partition. Predicates on the type and on header columns (equality, lists, prefixes,
comparisons, nulls) are pushed down. Of a record only the headers are decoded first, from the
first bytes of the member; a record that the predicates reject, or whose payload isn't asked
for (leave ``payload`` out of the schema), is passed over by its lengths without being
decoded. Plain ``.warc`` files, and members without lengths, are read as well.

A block of type ``application/http`` is an HTTP header and the payload; a revisit has no
block. Folders are opened by pyarrow's file systems (local, hdfs, s3, gs).

Equal payloads are told by their SHA-1 and length: the one with the largest page id is the
``response``, the others are ``revisit`` records that refer to it. Payloads are put in
groups by digests alone; the join that brings the verdict to the page is one that Spark
splits where a digest is hot.

Defined cases: a null payload is the empty one; a null url is a record without target; a
null page id comes before all others, and its record id says ``null``; of rows that share
page id and payload, the last one is the response and the others revisit it; an empty table
gives an empty archive; other columns are ignored. Pages are read twice, for the digests and
for the records: where page ids repeat, they must come in the same order again, as from files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, small_batches

FILE_BYTES = 1 << 30
PARTITION_BYTES = 64 << 20
#: Bytes that are read to find a record's headers.
HEAD_BYTES = 1 << 11
#: Bytes of records that are sent to Spark at once.
BATCH_BYTES = 4 << 20

#: The header of each column.
HEADER_OF = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
}
NUMBERS = ("payload_length", "content_length")
COLUMNS = ", ".join(f"{c} {'bigint' if c in NUMBERS else 'string'}" for c in HEADER_OF) + ", payload binary"
#: Fixed value: the profile of a revisit of the same payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def record(headers: dict[str, str], payload: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field SL has both lengths."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32:
        raise ValueError("a record is longer than a member's length field")
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Members:
    """The records of a compressed file: headers first, the payload when asked for."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.end = file, 0, file.size()

    def __iter__(self) -> Iterator[dict[str, str]]:
        while self.at < self.end:
            self.file.seek(self.at)
            self.start = self.file.read(HEAD_BYTES)
            self.length = self._length()
            self.unpacker, self.rest = zlib.decompressobj(31), self.start
            data = self._until(b"\r\n\r\n")
            head, _, self.have = data.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            self.size = int(headers.get("content-length", 0))
            yield headers
            if self.length:
                self.at += self.length
                continue
            while not self.unpacker.eof and self._more() is not None:
                pass
            self.at = self.file.tell() - len(self.unpacker.unused_data)

    def _length(self) -> int:
        """The member's length by its extra field, 0 where it has none."""
        if not self.start[3:4] or not self.start[3] & 4:
            return 0
        at, (n,) = 12, struct.unpack("<H", self.start[10:12])
        while at < 12 + n:
            name, (k,) = self.start[at : at + 2], struct.unpack("<H", self.start[at + 2 : at + 4])
            if name == b"SL" and k == 8:
                return struct.unpack("<I", self.start[at + 4 : at + 8])[0]
            at += 4 + k
        return 0

    def _more(self) -> bytes | None:
        if not self.rest:
            self.rest = self.file.read(1 << 18)
            if not self.rest:
                return None
        data, self.rest = self.unpacker.decompress(self.rest), b""
        return data

    def _until(self, mark: bytes) -> bytes:
        out = b""
        while mark not in out and not self.unpacker.eof and (data := self._more()) is not None:
            out += data
        return out

    def payload(self) -> bytes:
        parts, have = [self.have], len(self.have)
        while have < self.size and not self.unpacker.eof and (data := self._more()) is not None:
            parts.append(data)
            have += len(data)
        return b"".join(parts)[: self.size]


class _Plain:
    """The records of a file that isn't compressed."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.end = file, 0, file.size()

    def __iter__(self) -> Iterator[dict[str, str]]:
        while self.at < self.end:
            self.file.seek(self.at)
            data = b""
            while b"\r\n\r\n" not in data and (more := self.file.read(HEAD_BYTES)):
                data += more
            head = data.partition(b"\r\n\r\n")[0]
            if not head.lstrip(b"\r\n"):
                return
            headers = parse_headers(head.lstrip(b"\r\n"))
            self.body, self.size = self.at + len(head) + 4, int(headers.get("content-length", 0))
            yield headers
            self.at = self.body + self.size + 4

    def payload(self) -> bytes:
        self.file.seek(self.body)
        return self.file.read(self.size)


def _holds(f: Filter, row: dict) -> bool:
    """Whether a row of header columns passes a predicate (null: it doesn't)."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, (EqualNullSafe, IsNull, IsNotNull)):
            return not _holds(inner, row)
        return row[inner.attribute[0]] is not None and not _holds(inner, row)
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, EqualTo):
        return x == f.value
    if isinstance(f, In):
        return x in f.value
    if isinstance(x, str) and isinstance(f, (StringStartsWith, StringEndsWith, StringContains)):
        return {StringStartsWith: x.startswith, StringEndsWith: x.endswith, StringContains: x.__contains__}[type(f)](f.value)
    a, b = (x.encode(), f.value.encode()) if isinstance(x, str) else (x, f.value)
    return a > b if isinstance(f, GreaterThan) else a >= b if isinstance(f, GreaterThanOrEqual) else a < b if isinstance(f, LessThan) else a <= b


_PUSHED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


@dataclass
class WarcFiles(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, partition_bytes: int):
        self.schema, self.path, self.partition_bytes = schema, path, partition_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = isinstance(inner, _PUSHED) and len(inner.attribute) == 1 and inner.attribute[0] in HEADER_OF
            if known and not (isinstance(inner, In) and None in inner.value):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[WarcFiles]:
        """Files, largest first, each to the partition that has least so far."""
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(((f.size, f.path) for f in found if f.is_file and not f.base_name.startswith((".", "_")) and f.base_name.endswith((".warc", ".warc.gz"))), reverse=True)
        parts: list[list] = [[0, []] for _ in range(max(1, -(-sum(s for s, _ in files) // self.partition_bytes)))]
        for size, path in files:
            least = min(parts, key=lambda p: p[0])
            least[0] += size + 1
            least[1].append(path)
        return [WarcFiles(p) for _, p in parts]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        names = [f.name for f in self.schema.fields]
        asked = [c for c in HEADER_OF if c in names or any(c == (f.child if isinstance(f, Not) else f).attribute[0] for f in self.filters)]
        types = {f.name: pa.int64() if f.name in NUMBERS else pa.binary() if f.name == "payload" else pa.string() for f in self.schema.fields}
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in names], names)

        for path in partition.paths:
            with store.open_input_file(path) as file:
                records = _Members(file) if path.endswith(".gz") else _Plain(file)
                for headers in records:
                    row = {c: headers.get(HEADER_OF[c].lower()) for c in asked}
                    row |= {c: int(x) if (x := row[c]).isascii() and x.isdigit() else None for c in NUMBERS if row.get(c) is not None}
                    if not all(_holds(f, row) for f in self.filters):
                        continue
                    if "payload" in types:
                        block = records.payload()
                        http = headers.get("content-type", "").startswith("application/http")
                        row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
                        held += len(row["payload"])
                    rows.append(row)
                    held += 200
                    if held > BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of header columns and ``payload``, each a record; nulls are left out."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            # Arrow's own large strings may come for strings
            for row in batch.to_pylist():
                if out is None or size > self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{root}/_{names[-1]}", compression=None)
                    info = b"software: splicework\r\nformat: WARC File Format 1.1\r\n"
                    first = member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info))
                    out.write(first)
                    size = len(first)
                headers = {h: " ".join(str(row[c]).splitlines()) for c, h in HEADER_OF.items() if c != "content_length" and row.get(c) is not None}
                if row.get("record_type") == "revisit":
                    headers["WARC-Profile"] = SAME_PAYLOAD
                payload = row.get("payload")
                block = b"" if payload is None else http_block(payload) if row.get("content_type") == HTTP else payload
                data = member(record(headers, block))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.delete_file(f"{root}/_{name}")


class WarcSource(DataSource):
    """``format("warc")``; options path, partitionBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, _uri(self.options["path"]), int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(_uri(self.options["path"]), int(self.options.get("filebytes", FILE_BYTES)))


def _uri(path: str) -> str:
    """Spark names local files with one slash or three, or without a scheme."""
    path = path if ":" in path.split("/")[0] else f"file://{path}"
    return f"file:///{path.removeprefix('file:').lstrip('/')}" if path.startswith("file:") else path


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, with predicates pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: str = COLUMNS, **options) -> DataFrame:
    """The records of a file or folder; ``columns`` is a schema, part of COLUMNS."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


@small_batches
def write(records: DataFrame, path: str, **options) -> None:
    """Write rows of COLUMNS (any part of them) to a folder."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: four runs of 40 bits, eight digits each."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _named(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """One record for each page: response, or revisit of the response with the same
    payload of at least ``least_bytes`` and the largest page id."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    own = own.withColumn("payload_length", F.octet_length("payload").cast("bigint")).withColumn("digest", base32_sha1(F.col("payload")))
    each = own.filter(F.col("payload_length") >= least_bytes).groupBy("digest", "payload_length", "page").agg(F.count("*").alias("n"), F.max("row").alias("row"))
    shared = each.groupBy("digest", "payload_length").agg(F.sum("n").alias("copies"), F.max(F.struct("page", "n", "row")).alias("last")).filter("copies > 1")
    last = shared.select(F.col("digest").alias("d"), F.col("payload_length").alias("l"), F.col("last.page").alias("last"), F.col("last.n").alias("ties"), F.col("last.row").alias("last_row"))
    joined = own.join(last, (F.col("digest") == F.col("d")) & (F.col("payload_length") == F.col("l")), "left")
    other = ~F.col("page").eqNullSafe(F.col("last")) | ((F.col("ties") > 1) & (F.col("row") != F.col("last_row")))
    joined = joined.withColumn("again", F.col("ties").isNotNull() & other)
    return joined.select(
        _named(F.col("page")).alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.col("url").alias("target_uri"),
        F.when(F.col("again"), _named(F.col("last"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload_length",
        F.lit(HTTP).alias("content_type"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def report(spark: SparkSession, path: str) -> DataFrame:
    """Of each record of an archive by ``records_of``: page_id, payload_bytes and
    payload_digest of the full payload (a response's from the payload itself, a revisit's
    from its headers), record_type, refers_to."""
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    full = read(spark, path, "record_id string, record_type string, payload binary").filter("record_type = 'response'")
    again = read(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, payload_length bigint").filter("record_type = 'revisit'")
    return full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to")).unionAll(
        again.select(page("record_id"), "payload_length", F.substring_index("payload_digest", ":", -1), "record_type", page("refers_to"))
    )


def archive(pages: DataFrame) -> str:
    """Write ``pages`` as records into a new folder of the shared one."""
    path = new_path(pages.sparkSession, "warc")
    write(records_of(pages), path)
    return path
