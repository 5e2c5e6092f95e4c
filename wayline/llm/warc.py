"""WARC records in ZIP packages.

A package is a ZIP archive whose members are stored, not compressed: a WARC file
of one gzip member for each record, and an index of where the records lie.
Writers roll packages by size, each task its own. Readers never extract: they
range-read the end of a package, its (ZIP64) central directory and its index,
deal the index entries out over the cluster, and range-read the records.

Files are reached by pyarrow's file systems from any executor, so packages may be
wherever those and Spark both reach: shared folders or object stores. A task that
runs twice leaves a package that no manifest names, and nothing else.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.batches import small_batches
from wayline.llm.skew import uneven_join
from wayline.storage import materialize, new_path

DATE = "2020-01-01T00:00:00Z"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 100
_SPAN = 4 << 20


# -- records ---------------------------------------------------------------


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that has only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}\r\nX-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[int | None, str | None, bytes, int, str, str, int | None]:
    """page_id, url, payload (empty for a revisit), payload bytes, digest, type, refers_to; raises on damage."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is not what its header says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    declared = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        declared, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError("a payload's digest is not what its header says")
    whole = lambda name: int(fields[name]) if name in fields else None
    return whole("x-page-id"), fields.get("warc-target-uri"), payload, declared, digest, kind, whole("x-refers-to-page-id")


# -- packages --------------------------------------------------------------


class _Package:
    """One ZIP package that is being written; the index is held until it is closed."""

    def __init__(self, uri: str, level: int) -> None:
        where, path = fs.FileSystem.from_uri(uri)
        self.uri, self.level, self.size, self.lines = uri, level, 0, []
        self.stream = where.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)

    def add(self, record: bytes) -> None:
        packed = gzip.compress(record, self.level, mtime=0)
        self.member.write(packed)
        self.lines.append(f"{self.size} {len(packed)}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(self.lines))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.size


def read_directory(source: pa.NativeFile, size: int) -> dict[str, tuple[int, int]]:
    """Where the stored members of a ZIP archive lie: name to offset of its data and size.

    Reads the archive's end, its central directory and each member's local
    header, never a member. Where a field is at its 16 or 32 bit maximum the ZIP64
    records hold the value.
    """

    def at(offset: int, n: int) -> bytes:
        source.seek(offset)
        return source.read(n)

    start = max(0, size - 65557)  # an end record has 22 bytes and a comment of up to 65535
    tail = at(start, size - start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = at(start + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        (place,) = struct.unpack_from("<Q", locator, 8)
        count, length, offset = struct.unpack_from("<QQQ", at(place, 56), 32)
    directory, p, out = at(offset, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, plain, n, extra, comment, header = struct.unpack_from("<10xH8xIIHHH8xI", directory, p)
        name = directory[p + 46 : p + 46 + n].decode()
        wide = [v for v in (plain, packed, header)]
        q = p + 46 + n
        stop = q + extra
        while q + 4 <= stop:
            kind, amount = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # ZIP64: only the values that are at their maximum, in this order
                r = q + 4
                for k, v in enumerate(wide):
                    if v == 0xFFFFFFFF:
                        (wide[k],) = struct.unpack_from("<Q", directory, r)
                        r += 8
            q += 4 + amount
        p += 46 + n + extra + comment
        if method == 0:
            local = at(wide[2], 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("a local header is damaged")
            a, b = struct.unpack_from("<HH", local, 26)
            out[name] = (wide[2] + 30 + a + b, wide[0])
    return out


# -- tables ----------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` from ``page_id, url, html``.

    Of pages with equal payloads of at least MIN_REVISIT bytes that with the
    smallest id is the response (all its rows, should it repeat; a null id comes
    after all others), the rest refer to it. Digests alone are grouped; of those
    that repeat, the most common are joined by broadcast, the rest by shuffle or,
    if Spark finds them few, by broadcast too.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 and first is not null"), "first-pages")
    other = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    joined = uneven_join(rows, first, ["digest"], "n", pages.count(), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Writes a record for each row of ``page_id, url, html``; returns the manifest ``package, n_records, n_bytes``.

    Null html is an empty payload; null ids and urls are left out of the record;
    line ends in a url, which a header can't hold, are written percent-encoded.
    An empty table writes no package. Packages are in ``folder``, by default a new
    one in the shared folder, and hold about ``package_bytes`` at most (plus a record).
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if package is None:
                    package = _Package(f"{folder}/{uuid.uuid4().hex}.zip", level)
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                package.add(build_record(page_id, url, payload, digest, refers_to))
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["package", "n_records", "n_bytes"])

    return materialize(small_batches(with_revisits(pages)).mapInArrow(write, "package string, n_records bigint, n_bytes bigint"), "manifest")


def list_records(manifest: DataFrame) -> DataFrame:
    """``package, offset, length`` of every record of the packages, from their directories and indexes.

    An empty manifest has no records; a package without the two members, or one
    that is no ZIP archive, raises.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as source:
                    members = read_directory(source, source.size())
                    base, _ = members[WARC_MEMBER]
                    at, n = members[INDEX_MEMBER]
                    source.seek(at)
                    places = [line.split() for line in source.read(n).splitlines()]
                for k in range(0, len(places), 100_000):
                    some = places[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uri] * len(some), pa.string()), pa.array([base + int(o) for o, _ in some], pa.int64()), pa.array([int(x) for _, x in some], pa.int64())],
                        ["package", "offset", "length"],
                    )

    # a package's directory is a task of its own, however few files the manifest has
    found = manifest.select("package").repartition("package").mapInArrow(look, "package string, offset bigint, length bigint")
    return materialize(found, "records")


def _spans(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Neighbouring records of a package together, up to _SPAN bytes a read."""
    held: list[tuple[int, int]] = []
    package = None
    for uri, offset, length in rows:
        if held and (uri != package or offset != held[-1][0] + held[-1][1] or offset + length - held[0][0] > _SPAN):
            yield package, held
            held = []
        package = uri
        held.append((offset, length))
    if held:
        yield package, held


def read_records(records: DataFrame, payload: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload``.

    No records give an empty result; records that repeat are read again; one that
    is not where it should be raises.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        opened, source, made, size = None, None, [], 0
        for uri, span in _spans(places):
            if uri != opened:
                if source is not None:
                    source.close()
                where, path = fs.FileSystem.from_uri(uri)
                opened, source = uri, where.open_input_file(path)
            source.seek(span[0][0])
            data = source.read(sum(n for _, n in span))
            for offset, length in span:
                start = offset - span[0][0]
                page_id, url, body, n, digest, kind, refers_to = parse_record(gzip.decompress(data[start : start + length]))
                made.append((page_id, url, n, digest, kind, refers_to) + (body,) * payload)
                size += len(body) if payload else 200
                if size > 8 << 20:
                    yield batch_of(made)
                    made, size = [], 0
        if source is not None:
            source.close()
        if made:
            yield batch_of(made)

    # stretches of a package stay together; one package is read by many tasks, by the bytes they will read
    stretch = F.floor(F.col("offset") / F.lit(_SPAN))
    total = records.agg(F.sum("length")).first()[0] or 0
    dealt = records.repartition(max(1, -(-total // (4 * _SPAN))), "package", stretch).sortWithinPartitions("package", "offset")
    return dealt.mapInArrow(read, schema)
