"""WARC 1.1 archives: records, and a Spark data source that reads them.

Files hold one gzip member per record, whose extra field `sl` gives its packed
and unpacked length (annex D of the standard), so a reader can pass over a record
after its headers; files without that field, and files that aren't packed, are
read too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

VERSION, DATE = "WARC/1.1", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary, headers map<string,string>"
#: Columns that come from one header each.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """A response record, or with `refers_to` a revisit record, whose block ends after the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the skip lengths of annex D."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _parsed(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            found[key.strip().lower()] = value.strip()
    return found


class _Source:
    """Bytes from a place in a file, plain or through gzip."""

    def __init__(self, file: Any):
        self.file, self.held, self.at = file, b"", 0

    def fill(self, n: int) -> bytes:
        """At least n bytes from here, if the file has them, without passing over them."""
        while len(self.held) < n:
            more = self.file.read(max(n - len(self.held), 1 << 20))
            if not more:
                break
            self.held += more
        return self.held

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""


def _skip_length(head: bytes) -> int | None:
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def _top(block: bytes) -> bytes:
    """The block up to the end of its first blank line."""
    top, blank, _ = block.partition(b"\r\n\r\n")
    return top + blank


def _length(headers: dict[str, str]) -> int:
    """The length of a record's block."""
    value = headers.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise ValueError(f"the WARC record {headers.get('warc-record-id')} has no valid Content-Length: {value!r}")
    return int(value)


def records(file: Any, wanted=lambda headers: True, whole: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose headers are wanted; other blocks aren't unpacked or kept.

    Not `whole`: of a block only what stands before its first blank line and the
    line's end; nothing behind the piece that has it is unpacked where the member
    says how long it is.
    """
    source = _Source(file)
    while True:
        head = source.fill(1 << 16)
        if not head:
            return
        if head[:2] == b"\x1f\x8b":
            length, unpacker, text, used = _skip_length(head), zlib.decompressobj(31), b"", 0
            while b"\r\n\r\n" not in text and not unpacker.eof:
                part = source.fill(used + 1)[used : used + (1 << 12)]
                if not part:
                    return
                text += unpacker.decompress(part)
                used += len(part)
            top, _, block = text.partition(b"\r\n\r\n")
            headers = _parsed(top)
            good = wanted(headers)
            if not good and length:
                source.skip(length)
                continue
            if good and not whole and length:
                while b"\r\n\r\n" not in block and len(block) < _length(headers) and not unpacker.eof:
                    part = source.fill(used + 1)[used : used + (1 << 12)]
                    if not part:
                        raise ValueError("a WARC record ends within its gzip member")
                    block += unpacker.decompress(part)
                    used += len(part)
                source.skip(length)
                yield headers, _top(block[: _length(headers)])
                continue
            pieces = [block]
            while not unpacker.eof:
                part = source.fill(used + 1)[used:]
                if not part:
                    raise ValueError("a WARC record ends within its gzip member")
                piece = unpacker.decompress(part)
                used += len(part)
                if good:
                    pieces.append(piece)
            source.skip(used - len(unpacker.unused_data))
            if good:
                block = b"".join(pieces)[: _length(headers)]
                yield headers, block if whole else _top(block)
            continue
        n = 1 << 16
        while b"\r\n\r\n" not in head and len(head) >= n:
            n *= 2
            head = source.fill(n)
        top, _, _ = head.partition(b"\r\n\r\n")
        headers = _parsed(top)
        size = _length(headers)
        source.skip(len(top) + 4)
        if wanted(headers) and whole:
            yield headers, source.fill(size)[:size]
        elif wanted(headers):
            n = 1 << 12
            while b"\r\n\r\n" not in (block := source.fill(min(n, size))[:size]) and n < size:
                n *= 2
            yield headers, _top(block)
        source.skip(size + 4)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    """Options: manifest (a Parquet table with a column path) or path (a file or folder); payload: true or false; verify: true or false.

    With neither payload nor verify, blocks are passed over after their HTTP
    headers; payload_bytes then follows from the two headers.  A record without a
    valid length, or one that ends too soon, fails the read by name.
    """

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.checks: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Takes over equality, membership and prefixes of the header columns."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] in HEADERS else None
            if column and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.checks.append((column, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        size = int(self.options.get("partitionbytes", 128 << 20))
        if "manifest" in self.options:
            import pyarrow.parquet as pq

            store, path = fs.FileSystem.from_uri(_uri(self.options["manifest"]))
            names = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-")]
            table = pa.concat_tables([pq.read_table(x, filesystem=store, columns=["path", "bytes"]) for x in names]) if names else pa.table({"path": [], "bytes": []})
            files = sorted(zip(table["path"].to_pylist(), table["bytes"].to_pylist(), strict=True))
        else:
            store, path = fs.FileSystem.from_uri(_uri(self.options["path"]))
            info = store.get_file_info(path)
            found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
            files = sorted((f"{store.type_name}:{x.path}" if store.type_name != "local" else x.path, x.size) for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path))
        groups: list[list[str]] = []
        held = size
        for path, n in files:
            if held + n > size:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += n
        return [_Files(x) for x in groups] or [_Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.checks:
            own = column_of(headers, column)
            if own is None or not (own == value if kind == "EqualTo" else own in value if kind == "In" else own.startswith(value)):
                return False
        return True

    def read(self, partition: _Files) -> Iterator[tuple]:
        with_payload, verify = (self.options.get(k, "true").lower() == "true" for k in ("payload", "verify"))
        whole = with_payload or verify
        for path in partition.paths:
            store, name = fs.FileSystem.from_uri(_uri(path))
            with store.open_input_file(name) as f:
                for headers, block in records(f, self._wanted, whole):
                    top, blank, payload = block.partition(b"\r\n\r\n")
                    own = column_of(headers, "record_type") == "response"
                    if own and verify and digest(payload) != column_of(headers, "payload_digest"):
                        raise ValueError(f"the digest of {headers.get('warc-record-id')} in {path} isn't that of its payload")
                    if own:
                        size = _length(headers) - len(top) - len(blank)
                    else:  # a revisit's block is the HTTP headers, which say how long the payload was; other records have none
                        said = _parsed(top).get("content-length", "")
                        size = int(said) if said.isdigit() else None
                    yield (*(column_of(headers, c) for c in HEADERS), size, payload if own and with_payload else None, headers)


def column_of(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


def _uri(path: str) -> str:
    """`file:/x` and plain paths as URIs that Arrow knows."""
    if re.match(r"^file:/[^/]", path):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"


class WarcSource(DataSource):
    """`spark.read.format("warc")`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)


class ArchiveWriter:
    """Writes members to files of about `size` bytes in a folder; `files` lists (path, bytes, records)."""

    def __init__(self, folder: str, name: str, size: int = 128 << 20):
        self.store, self.folder = fs.FileSystem.from_uri(_uri(folder))
        self.scheme = folder.split(":", 1)[0] if ":" in folder else "file"
        self.name, self.size, self.out, self.files = name, size, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.store.create_dir(self.folder, recursive=True)
            self.path, self.bytes, self.records = f"{self.folder}/{self.name}-{len(self.files):05d}.warc.gz", 0, 0
            self.out = self.store.open_output_stream(self.path, compression=None)
        packed = member(data)
        self.out.write(packed)
        self.bytes += len(packed)
        self.records += 1
        if self.bytes >= self.size:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.path if self.scheme == "file" else f"{self.scheme}://{self.path}", self.bytes, self.records))
            self.out = None
