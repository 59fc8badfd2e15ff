"""WARC archives with revisit records and a two-level capture index.

Archives: one file of gzip members per task, in the shared folder; a record per page. Index: capture
lines sorted by reversed-host URL key and page, deflated in blocks, and beside each index file a
sparse directory with the first capture of each block. The first capture of each index file, one row
a range partition, goes to whoever looks something up. A lookup bisects these, then the directory of
one file, unpacks one block, bisects its lines, and reads the byte range of the record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symquarry.llm.store import bounded_batches, new_path, parts, shared_files, shuffle_partitions, split_join, written

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 3000
_ID = "urn:page:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = "urlkey string, page_id long, url string, record_type string, digest string, file string, offset long, length long"
_FIELDS = ("urlkey", "page_id", "url", "record_type", "digest", "file", "offset", "length")
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """``org,example)/path?query``: the host reversed by its labels, lower case; a null url gives ``)/``."""
    try:
        parts = urlsplit(url or "")
        host, query = (parts.hostname or "").lower(), f"?{parts.query}" if parts.query else ""
        path = parts.path or "/"
    except ValueError:
        host, path, query = "", url or "/", ""
    host = host.removeprefix("www.")
    return re.sub(r"[\x00-\x20]", "%20", ",".join(reversed(host.split("."))) + ")" + path + query)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, a gzip member of its own."""
    name = "" if page_id is None else str(page_id)
    target = re.sub(r"[\r\n]", " ", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = _HTTP
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; a revisit has no payload of its own."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str):
    def run(batches):
        fs, base = shared_files(folder)
        context = TaskContext.get()
        # Named by attempt: only the attempt that succeeds is listed in the manifest.
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        at, sink = 0, None
        try:
            for batch in parts(batches, 2048):
                rows = []
                for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                    payload = html or b""
                    digest = payload_digest(payload)
                    revisit = first is not None and page is not None and first != page
                    member = record(page, url, payload, digest, first, revisit)
                    if sink is None:
                        fs.create_dir(base, recursive=True)
                        sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    sink.write(member)
                    rows.append((url_key(url), page, url, "revisit" if revisit else "response", digest, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*rows)) or [()] * len(_FIELDS)
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(_FIELDS))
        finally:
            if sink is not None:
                sink.close()

    return run


def _same_payload(least_bytes: int):
    def run(batches):
        for batch in parts(batches, 2048):
            rows = [h or b"" for h in batch.column(1).to_pylist()]
            groups = [hashlib.sha1(h).digest() + len(h).to_bytes(8, "big") if len(h) >= least_bytes else None for h in rows]
            keys = [None if g is None else int.from_bytes(g[:8], "big", signed=True) for g in groups]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(groups, pa.binary())], names=["page_id", "k", "same"])

    return run


def write_archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """(folder, manifest): WARC files of every page, and where each record lies.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id
    is a response and the others revisit it. Pages without an id are responses of their own, as are
    repeated rows of the smallest id. Null html is an empty payload.
    """
    spark = pages.sparkSession
    rows = bounded_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    same = written(rows.select("page_id", "html").mapInArrow(_same_payload(least_bytes), "page_id long, k long, same binary"), "warc-digests")
    # Only ids and digests of later copies go back to the pages; first copies need nothing.
    least = same.where("same is not null and page_id is not null").groupBy("k", "same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    later = split_join(same, least.where("n > 1").drop("n"), ["k", "same"]).where("page_id > first")
    later = later.select("page_id", F.substring("same", 1, 20).alias("sha"), "first").distinct()
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit(b"")))))
    folder = new_path(spark, "warc")
    manifest = rows.join(later, ["page_id", "sha"], "left").select("page_id", "url", "html", "first").mapInArrow(_writer(folder), _MANIFEST)
    return folder, written(manifest, "warc-manifest")


def _line(row: dict) -> str:
    mark = lambda x: "-" if x is None else str(x)
    kind, digest, file = row["record_type"], row["digest"], row["file"]
    return f"{row['urlkey']} {DATE} {mark(row['page_id'])} {kind} {digest} {file} {row['offset']} {row['length']}"


def _token(key: str, page: int | None) -> tuple[str, bool, int]:
    """The order of captures: by key, then by page, those without an id first."""
    return key, page is not None, page or 0


def _parsed(line: str) -> tuple[tuple[str, bool, int], str, int, int]:
    key, _, page, _, _, file, offset, length = line.split(" ")
    return _token(key, None if page == "-" else int(page)), file, int(offset), int(length)


def _indexer(folder: str, block_lines: int):
    def run(batches):
        fs, base = shared_files(folder)
        context = TaskContext.get()
        name = f"index-{context.partitionId():05d}-{context.taskAttemptId()}.cdx"
        at, sink, lines, directory = 0, None, [], []

        def flush():
            nonlocal at, sink, lines
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(lines).encode(), 3)
            sink.write(block)
            key, _, page, *_ = lines[0].split(" ")
            directory.append(f"{key} {page} {at} {len(block)}")
            at += len(block)
            lines = []

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    lines.append(_line(row))
                    if len(lines) >= block_lines:
                        flush()
            if lines:
                flush()
        finally:
            if sink is not None:
                sink.close()
        tops = []
        if directory:
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as out:
                out.write("\n".join(directory).encode())
            key, page, *_ = directory[0].split(" ")
            tops.append((key, None if page == "-" else int(page), name, len(directory)))
        columns = list(zip(*tops)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["first_key", "first_page", "file", "blocks"])

    return run


def build_index(folder: str, manifest: DataFrame, block_lines: int = BLOCK_LINES) -> list[tuple[tuple[str, bool, int], str]]:
    """Writes index files with their directories to ``folder``; returns (first capture, file) of each, in order.

    Captures are range-partitioned by key, page and place, so that a host or URL with a third of all
    captures spreads over partitions. What is returned has a row per partition, however many captures there are.
    """
    parts = max(1, shuffle_partitions(manifest.sparkSession))
    order = [F.col("urlkey"), F.col("page_id"), F.col("file"), F.col("offset")]
    ranged = manifest.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tops = written(ranged.mapInArrow(_indexer(folder, block_lines), "first_key string, first_page long, file string, blocks long"), "warc-directory").collect()
    return sorted((_token(t.first_key, t.first_page), t.file) for t in tops)


def _range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


class Captures:
    """Lookups in the index of ``folder``; keeps the directory and the block that it read last."""

    def __init__(self, folder: str, tops: list[tuple[tuple[str, bool, int], str]]):
        self.fs, self.base = shared_files(folder)
        self.tops, self.firsts = tops, [first for first, _ in tops]
        self.directory: tuple[str, list, list] = ("", [], [])
        self.block: tuple[tuple[str, int], list] = (("", -1), [])

    def _directory(self, file: str) -> tuple[list, list]:
        """First captures and (offset, length) of the blocks of an index file."""
        if self.directory[0] != file:
            path = f"{self.base}/{file}.dir"
            rows = [line.split(" ") for line in _range(self.fs, path, 0, self.fs.get_file_info(path).size).decode().split("\n")]
            firsts = [_token(key, None if page == "-" else int(page)) for key, page, _, _ in rows]
            self.directory = (file, firsts, [(int(offset), int(length)) for *_, offset, length in rows])
        return self.directory[1:]

    def _block(self, file: str, offset: int, length: int) -> list:
        if self.block[0] != (file, offset):
            lines = zlib.decompress(_range(self.fs, f"{self.base}/{file}", offset, length)).decode().split("\n")
            self.block = ((file, offset), [_parsed(line) for line in lines])
        return self.block[1]

    def find(self, low: tuple[str, bool, int], high: tuple[str, bool, int]):
        """(file, offset, length) of the records of the captures from ``low`` to ``high``, both included."""
        for top in range(*_span(self.firsts, low, high)):
            file = self.tops[top][1]
            firsts, places = self._directory(file)
            for number in range(*_span(firsts, low, high)):
                lines = self._block(file, *places[number])
                for at in range(bisect.bisect_left(lines, low, key=lambda x: x[0]), bisect.bisect_right(lines, high, key=lambda x: x[0])):
                    yield lines[at][1:]


def _span(firsts: list, low: tuple, high: tuple) -> tuple[int, int]:
    """Which of successive stretches, known by their first captures, may hold captures from ``low`` to ``high``."""
    return max(0, bisect.bisect_left(firsts, low) - 1), bisect.bisect_right(firsts, high)


def lookup(folder: str, tops: list, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Records of a URL. ``tops``: what :func:`build_index` returned."""
    key, captures = url_key(url), Captures(folder, tops)
    found = captures.find((key, False, 0), (key, True, 1 << 63))
    return [parse(_range(captures.fs, f"{captures.base}/{file}", offset, length)) for file, offset, length in found]


def _reader(folder: str, tops: list):
    def run(batches):
        captures = Captures(folder, tops)
        opened: dict[str, pa.NativeFile] = {}
        rows = []
        for batch in batches:
            for key, page in zip(batch.column("urlkey").to_pylist(), batch.column("page_id").to_pylist()):
                token = _token(key, page)
                for file, offset, length in captures.find(token, token):
                    if file not in opened:
                        if len(opened) >= 32:
                            opened.pop(next(iter(opened))).close()
                        opened[file] = captures.fs.open_input_file(f"{captures.base}/{file}")
                    rows.append(_checked(opened[file].read_at(length, offset), f"{file} at {offset}"))
                    if len(rows) >= 10_000:
                        yield _read_batch(rows)
                        rows = []
        for source in opened.values():
            source.close()
        yield _read_batch(rows)

    return run


def _checked(member: bytes, place: str) -> tuple:
    """(page_id, payload bytes, digest, kind, refers_to) of a record; a payload without its digest is an error."""
    headers, payload = parse(member)
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"{place}: the payload doesn't have its digest")
    number = lambda h: int(h.removeprefix(f"<{_ID}")[:-1]) if h and h != f"<{_ID}>" else None
    return number(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]), digest, kind, number(headers.get("WARC-Refers-To"))


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_archive(folder: str, tops: list, wanted: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``wanted`` (urlkey, page_id).

    Every distinct wanted capture is looked up in the index. Lookups are sorted and range-partitioned
    as the index is, so a task goes through a stretch of it; rows alike in both columns are one
    lookup that returns all their records.
    """
    order = [F.col("urlkey"), F.col("page_id")]
    spread = wanted.distinct().repartitionByRange(max(1, shuffle_partitions(wanted.sparkSession)), *order).sortWithinPartitions(*order)
    return spread.mapInArrow(_reader(folder, tops), _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes and indexes an archive of ``pages`` and looks every page up in it; see :func:`write_archive` and :func:`read_archive`."""
    folder, manifest = write_archive(pages, **options)
    return read_archive(folder, build_index(folder, manifest), manifest.select("urlkey", "page_id"))
