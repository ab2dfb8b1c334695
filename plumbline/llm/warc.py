"""WARC archives: writing pages, normalising monolithic gzip files, reading back by offset.

Pages are written as archives that are one gzip stream each, as crawlers without per-record members
leave them. The normaliser inflates such a file once, in bounded chunks, writes every record as a
gzip member of its own and a sidecar index of (record id, offset, length), so that a reader inflates
a single record. Of pages with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the
smallest page_id is a response and the others revisit it.

Files get names of their own at each attempt and count only once a manifest table names them, so a
task that is lost or run twice leaves at most an unnamed file. They are written through
``pyarrow.fs``, which needs the shared folder to be of a kind that it knows.

Defined cases: a null html is empty; a null page_id is never the smallest, and its record reads back
with a null id; rows that share the smallest page_id and the payload are all responses; a null url
leaves its header out; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._columns import whole_text
from plumbline.session import materialize, scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20  # before compression
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"  # pages carry no date of capture
_CHUNK = 1 << 20
_ID = "urn:plumbline:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def _page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_ID}{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
        payload = b""
    return _record([*fields, ("Content-Type", "application/http; msgtype=response")], http + payload)


def _fields(head: bytes) -> dict[str, str]:
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, block and all bytes of each record of an inflated stream."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            end = held.find(_END)
            if end < 0:
                break
            fields = _fields(bytes(held[:end]))
            need = end + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            whole = bytes(held[:need])
            yield fields, whole[end + 4 : -4], whole
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def _inflated(stream) -> Iterator[bytes]:
    """Chunks of bounded size of a gzip file, of one member or several."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield inflate.decompress(data, 4 * _CHUNK)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to``. Only digests that occur again are joined."""
    payload = F.encode(whole_text("html"), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    again = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .where("n > 1")
        .select("digest", "first")
    )
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """One gzip stream per archive; returns the manifest: ``path``, ``records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        done, out, count, size, name, pack = [], None, 0, 0, "", None
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name, count, size, pack = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(level, wbits=31)
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", DATE)]
                    out.write(pack.compress(_record([*info, ("Content-Type", "application/warc-fields")], b"software: plumbline\r\n")))
                record = _page_record(page_id, url, payload, digest, refers_to)
                out.write(pack.compress(record))
                count, size = count + 1, size + len(record)
                if size >= archive_bytes:
                    out.write(pack.flush())
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{n}", "records": c} for n, c in done], schema=_MANIFEST)

    return materialize(marked.mapInArrow(write, "path string, records bigint"), "manifest")


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])


def normalise(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar ``<name>.idx``; returns the new manifest."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for source in batch.column(0).to_pylist():
                name, offset, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                source_system, path = _open(source)
                with (
                    source_system.open_input_stream(path, compression=None) as stream,
                    system.open_output_stream(f"{root}/{name}", compression=None) as out,
                    system.open_output_stream(f"{root}/{name}.idx", compression=None) as index,
                ):
                    for fields, _, whole in records(_inflated(stream)):
                        pack = zlib.compressobj(level, wbits=31)
                        member = pack.compress(whole) + pack.flush()
                        out.write(member)
                        index.write(f"{fields['warc-record-id']} {offset} {len(member)}\n".encode())
                        offset, count = offset + len(member), count + 1
                done.append({"path": f"{folder}/{name}", "records": count})
            yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)

    spread = manifest.repartition(max(1, manifest.count()))
    return materialize(spread.mapInArrow(rewrite, "path string, records bigint"), "manifest")


def _page_of(record_id: str) -> int | None:
    tail = record_id.strip("<>").removeprefix(_ID)
    return None if tail == "None" else int(tail)


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Each page's record, found by its index entry and inflated alone; the digest of a response is checked.

    ``payload_bytes`` and ``payload_digest`` are of the full payload also for a revisit, whose block keeps
    the response's HTTP header. With ``payloads`` the payload of a response comes too."""
    kinds = [("page_id", "bigint"), ("url", "string"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    schema = ", ".join(f"{n} {k}" for n, k in kinds) + (", payload binary" if payloads else "")
    arrow = pa.schema([(n, pa.int64() if k == "bigint" else pa.string()) for n, k in kinds] + [("payload", pa.binary())] * payloads)

    def read_one(data: bytes) -> dict | None:
        fields, block, _ = next(records(iter([zlib.decompress(data, 31)])))
        if fields["warc-type"] not in ("response", "revisit"):
            return None
        http, _, payload = block.partition(_END)
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        response = fields["warc-type"] == "response"
        if response and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        return {
            "page_id": _page_of(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "payload_bytes": len(payload) if response else int(_fields(http)["content-length"]),
            "payload_digest": digest,
            "record_type": fields["warc-type"],
            "refers_to": None if response else _page_of(fields["warc-refers-to"]),
        } | ({"payload": payload if response else None} if payloads else {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, path = _open(source)
                with system.open_input_file(path) as archive, system.open_input_stream(f"{path}.idx", compression=None) as index:
                    rows = []
                    for line in index.read().decode().splitlines():
                        _, offset, length = line.rsplit(" ", 2)
                        archive.seek(int(offset))
                        if row := read_one(archive.read(int(length))):
                            rows.append(row)
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write, normalise and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    written = write_archives(mark_revisits(pages), f"{folder}/monolithic", archive_bytes)
    return read_records(normalise(written, f"{folder}/members"))
