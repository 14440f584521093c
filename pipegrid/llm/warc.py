"""WARC archives: writing them, making monolithic gzip files addressable, reading them back by offset.

:func:`write_archives` writes a partition's pages as one archive, compressed as a single gzip stream. Pages with equal
payloads (``MIN_PAYLOAD`` bytes or more) share one response, that of the smallest page_id; the others are revisit
records that name it. :func:`normalise` inflates such a file once, front to back, writes every record as a gzip member of its own
and a sidecar index with a line for each member's offset and length. :func:`read_pages` reads members by the index,
so that a large archive is shared out among tasks.

Files go to a folder all executors reach. A task writes under a name of its own and names the file in its result,
which is checkpointed: files that a lost or repeated task has left behind are never read.

Null html is an empty payload. All rows with the smallest page_id of a payload are responses; a null page_id comes after
all others and is a response if its payload has no other. Line breaks and blanks in a URL are percent-encoded; a null
URL has no header. Payloads stream in pieces, so the memory a record needs does not grow with it, but for reading it back.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import shared_folder
from pipegrid.session import cut_lineage

MIN_PAYLOAD = 0
BROADCAST_ROWS = 500_000  #: repeated payloads, of about 60 bytes each
PIECE = 1 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
ID = "urn:pipegrid:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path of a folder; ``file:`` needs no host."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, least: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, html, refers_to): html without nulls; refers_to is null for responses.

    Only hashes are grouped. Repeated payloads are broadcast below a counted number, else joined by a shuffle.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = known.withColumn("sha", F.sha1("html"))
    groups = keyed.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = cut_lineage(groups.filter("n > 1 and first is not null").select("sha", "first"))
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(repeated) if few else repeated, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None]]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response or revisit record with its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    if url is not None:
        url = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    head = _header(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
            ("WARC-Refers-To", f"<{ID}{refers_to}>" if revisit else None),
            ("WARC-Profile", PROFILE if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))),
        ]
    )
    return head + block + b"\r\n\r\n"


def _number(value) -> int | None:
    return None if pd.isna(value) else int(value)


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write rows of :func:`mark_revisits`; (archive, records) of the files, each one gzip stream."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_fs(folder)
        sink, records = None, 0
        for frame in frames:
            for page_id, url, html, refers_to in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"]):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(path, recursive=True)
                    sink = system.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = html.encode("utf-8", "replace")
                sink.write(packer.compress(record(_number(page_id), None if pd.isna(url) else url, payload, _number(refers_to))))
                records += 1
        if sink is not None:
            sink.write(packer.flush())
            sink.close()
            yield pd.DataFrame({"archive": [name], "records": [records]})

    texts = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return cut_lineage(texts.mapInPandas(write, "archive string, records long"))


class _Inflated:
    """A gzip file as a stream of bytes, whatever its number of members, inflated once."""

    def __init__(self, source):
        self.source = source
        self.zip = zlib.decompressobj(31)
        self.buffer = bytearray()
        self.ended = False

    def _more(self) -> bool:
        while True:
            data = self.zip.unconsumed_tail
            if self.zip.eof:
                data = self.zip.unused_data or self.source.read(PIECE)
                data = data.lstrip(b"\0") if data else data
                if not data:
                    return False
                self.zip = zlib.decompressobj(31)
            elif not data:
                data = self.source.read(PIECE)
                if not data:
                    raise EOFError("the archive ends within its gzip stream")
            out = self.zip.decompress(data, PIECE)
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("the archive ends within a record's header")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def skip_blank(self) -> None:
        """Pass the line ends between records."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if self.buffer or not self._more():
                return

    def take(self, size: int) -> Iterator[bytes]:
        """``size`` bytes in pieces."""
        while size:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends within a record")
            out = bytes(self.buffer[:size])
            del self.buffer[: len(out)]
            size -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}


def split_members(source, sink) -> Iterator[dict]:
    """Copy a gzip-compressed archive with a member per record; yields an index entry for each."""
    stream, offset = _Inflated(source), 0
    while True:
        stream.skip_blank()
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        fields = _fields(head)
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        length = 0

        def put(data: bytes) -> int:
            sink.write(data)
            return len(data)

        length += put(packer.compress(head))
        for piece in stream.take(int(fields["content-length"])):
            length += put(packer.compress(piece))
        length += put(packer.compress(b"\r\n\r\n")) + put(packer.flush())
        yield {"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": offset, "length": length}
        offset += length


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """(archive, records) of the files in ``target`` made from those in ``folder``; each has an ``.idx`` beside it."""

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (system, path), (out_system, out_path) = open_fs(folder), open_fs(target)
        for frame in frames:
            for archive in frame["archive"]:
                name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                out_system.create_dir(out_path, recursive=True)
                with (
                    system.open_input_stream(f"{path}/{archive}", compression=None) as source,
                    out_system.open_output_stream(f"{out_path}/{name}", compression=None) as sink,
                    out_system.open_output_stream(f"{out_path}/{name}.idx", compression=None) as index,
                ):
                    for entry in split_members(source, sink):
                        index.write((json.dumps({"archive": name, **entry}) + "\n").encode())
                        records += 1
                yield pd.DataFrame({"archive": [name], "records": [records]})

    return cut_lineage(archives.mapInPandas(rewrite, "archive string, records long"))


def read_index(made: DataFrame, target: str) -> DataFrame:
    """(archive, id, type, offset, length): the sidecar entries of the files that ``made`` names."""
    entries = made.sparkSession.read.schema("archive string, id string, type string, offset long, length long").json(f"{target}/*.idx")
    return entries.join(made.select("archive"), "archive", "left_semi")


def read_pages(index: DataFrame, target: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of indexed members.

    The digest of a response is computed from the payload that was read, and must be the header's.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_fs(target)
        name, file = None, None
        for frame in frames:
            rows = []
            for archive, offset, length in zip(frame["archive"], frame["offset"], frame["length"]):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, system.open_input_file(f"{path}/{archive}")
                file.seek(offset)
                data = zlib.decompress(file.read(length), 31)
                head, block = data.split(b"\r\n\r\n", 1)
                fields = _fields(head)
                http, payload = block[: int(fields["content-length"])].split(b"\r\n\r\n", 1)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and digest_of(payload) != digest:
                    raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                number = lambda f: fields.get(f, "").strip("<>").removeprefix(ID) or None
                rows.append((number("warc-record-id"), int(_fields(http)["content-length"]), digest, fields["warc-type"], number("warc-refers-to"), fields.get("warc-target-uri")))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"], dtype=object)
        if file is not None:
            file.close()

    found = index.select("archive", "offset", "length").mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these and read the pages back."""
    folder = folder or shared_folder(pages.sparkSession)
    written = write_archives(mark_revisits(pages), f"{folder}/whole")
    made = normalise(written, f"{folder}/whole", f"{folder}/members")
    if made.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return read_pages(read_index(made, f"{folder}/members"), f"{folder}/members")
