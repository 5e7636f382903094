"""Web archives with a two-level capture index.

Layout of an archive (``root`` is a folder that all executors see, by any path pyarrow's file systems can open):

* ``records/*.warc.gz``: WARC 1.1 records, one gzip member each, written by the tasks that read the pages. The first
  page of each group of equal payloads is a ``response`` with the payload; the others are ``revisit`` records that refer
  to it and carry only the HTTP head.
* ``index/*.cdx.gz``: capture lines ``key date {json}`` sorted by reversed-host URL key, compressed in blocks of
  ``BLOCK_LINES`` lines. Index shards follow each other in key order.
* ``index/*.dir``: beside every shard the sparse directory: one fixed-size place and one first key per block.

A lookup finds the shards by binary search in the list of their first keys, the blocks by binary search in a shard's
directory, the lines by binary search in a block, and reads just the records' bytes. A key with very many captures
reaches over several shards, which are read by different tasks.

Tasks write under names of their own, and only names that a finished stage reports belong to the archive, so lost
executors and repeated tasks leave at most unreferenced files, which are deleted once the archive is complete.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm.common import BROADCAST_BYTES, bounded_side
from articleflow.operators.joins import salted_join
from articleflow.session import cut

BLOCK_LINES = 3_000
# Lines of one index shard, on average; small archives get up to SMALL_SHARDS shards of MIN_LINES lines.
SHARD_LINES, SMALL_SHARDS, MIN_LINES = 1_000_000, 48, 3_000
# A records file is closed beyond this many bytes; neighbouring records are read together up to READ_BYTES.
FILE_BYTES, READ_BYTES = 1 << 30, 4 << 20
# Bytes of records that one task reads, on average.
TASK_BYTES = 16 << 20
GZIP_LEVEL = 4
# Pages carry no time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLACE = "<QQQI"
_PLACE_BYTES = struct.calcsize(_PLACE)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as absolute path or URI."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


def _escaped(text: str) -> str:
    """Text for one header or key field: blanks and control characters are percent-encoded, as in a sent request."""
    return re.sub(r"[\x00-\x20\x7F-\x9F]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8")), text)


def surt(url: str | None) -> str:
    """Sort key of a URL: the host's labels reversed, then path and query: ``org,example,www)/a?b``.

    Scheme, user, default port and fragment do not count, host letters are lower-cased, an empty path is ``/``. Text
    that is no URL with a host is kept whole behind ``)``; null and empty text have the key ``)``.
    """
    match = re.match(r"(?s)([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#]*@)?([^/?#]*?)(?::(\d*))?(?=[/?#]|$)([^#]*)", url or "")
    if not match or not match[2]:
        return _escaped(")" + (url or ""))
    scheme, host, port, rest = match[1].lower(), match[2].lower().rstrip("."), match[3], match[4]
    labels = ",".join(reversed(host.split("."))) if not host.startswith("[") else host
    other = f":{port}" if port and port != {"http": "80", "https": "443"}.get(scheme) else ""
    return _escaped(f"{labels}{other}){rest if rest.startswith('/') else '/' + rest}")


# ---- records --------------------------------------------------------------------------------------------------------


def _digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _record_id(page: object, url: str | None, digest: str, copy: int) -> str:
    """The same name each time, so that a revisit can name a record that another task writes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page, url, digest, copy]))}>"


def _record(page: int | None, url: str | None, payload: bytes, digest: str, copy: int, date: str,
            first: tuple[int, str | None] | None) -> bytes:
    """One WARC record: a response, or a revisit of the record of page ``first``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {_record_id(page, url, digest, copy)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_escaped(url)}")
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if first:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(*first, digest, 0)}",
                  f"X-Refers-To-Page: {first[0]}"]
        if first[1] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_escaped(first[1])}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one uncompressed record; the declared length and block digest must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if headers["WARC-Block-Digest"] != f"sha1:{_digest(block)}":
        raise ValueError("a record's block has changed")
    return headers, block


# ---- writing --------------------------------------------------------------------------------------------------------


@dataclass
class Archive:
    """A written archive: one line per index shard is kept here, nothing per page."""

    spark: SparkSession
    root: str
    # (first key, last key, name) in key order.
    shards: list[tuple[str, str, str]]


def _roles(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(first page of every payload that occurs more than once, rows that occur more than once)."""
    facts = cut(pages.select("page_id", "url", "print", "row", F.octet_length("html").alias("size")))
    order = F.struct(F.col("page_id"), F.col("url").isNotNull().alias("has_url"), F.col("url"))
    firsts = facts.filter(F.col("size") >= min_bytes).groupBy("print").agg(
        F.min(F.when(F.col("page_id").isNotNull(), order)).alias("first"), F.count("*").alias("n"),
    ).filter("n > 1 and first is not null").select(
        "print", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return cut(firsts), cut(facts.groupBy("row").count().filter("count > 1").select("row"))


def _numbered(pages: DataFrame, again: DataFrame, max_bytes: int) -> DataFrame:
    """Pages with ``copy``: 0, but for rows that cannot be told apart 0 only for one of them."""
    if again.isEmpty():
        return pages.withColumn("copy", F.lit(0).cast("long"))
    again = bounded_side(again, 80, max_bytes)
    # Numbered once and written, so that a repeated task sees the same numbers.
    several = cut(pages.join(again, "row", "left_semi").withColumn("number", F.monotonically_increasing_id()))
    lowest = several.groupBy("row").agg(F.min("number").alias("lowest"))
    several = salted_join(several, cut(lowest), ["row"], ["number"])
    copy = F.when(F.col("number") == F.col("lowest"), F.lit(0)).otherwise(F.col("number") + 1).cast("long")
    several = several.withColumn("copy", copy).drop("number", "lowest")
    alone = pages.join(again, "row", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return alone.unionByName(several)


def _by_print(pages: DataFrame, firsts: DataFrame, max_bytes: int) -> DataFrame:
    """Pages with the first page of their payload, null where no other page has the payload."""
    row_bytes = F.lit(112) + F.coalesce(F.octet_length("first_url"), F.lit(0))
    if (firsts.agg(F.sum(row_bytes)).first()[0] or 0) <= max_bytes:
        return pages.join(F.broadcast(firsts), "print", "left")
    # A payload that very many pages share must not meet in one task.
    return salted_join(pages, firsts, ["print"], ["page_id", "url"], "left")


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                  date_col: str | None = None, min_bytes: int = 0, block_lines: int = BLOCK_LINES,
                  max_bytes: int = BROADCAST_BYTES) -> Archive:
    """Write one record per page and the capture index below ``root``.

    The payload is the text in UTF-8, null as an empty one. Of pages with equal payloads of at least ``min_bytes``
    bytes, that with the smallest identifier (then the smallest url, null first) is the response; the others revisit
    it. Payloads are compared by SHA-256 and length. Of rows that agree in identifier, url and payload one counts as
    first. Pages with null identifier are written and can revisit, but nothing refers to them; null urls have the key
    ``)``. The identifier must be an integer column; other columns are ignored. No rows give an empty archive.
    """
    spark = pages.sparkSession
    date = F.lit(NO_DATE) if date_col is None else F.coalesce(
        F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_DATE))
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), date.alias("date"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("html"),
    ).withColumn("print", F.sha2("html", 256)).withColumn(
        "row", F.sha2(F.to_json(F.struct("page_id", "url", "print")), 256))
    firsts, again = _roles(named, min_bytes)
    marked = _by_print(_numbered(named, again, max_bytes), firsts, max_bytes)
    is_first = (F.col("page_id") == F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 0)
    small = F.octet_length("html") < min_bytes
    marked = marked.withColumn("own", F.col("first_id").isNull() | F.coalesce(is_first, F.lit(False)) | small)
    captures = _write_records(
        marked.select("page_id", "url", "html", "copy", "date", "own", "first_id", "first_url"), f"{root}/records")
    return Archive(spark, root, _write_index(captures, f"{root}/index", block_lines))


def _keep_only(folder: str, names: set[str]) -> None:
    files, inner = open_fs(folder)
    for item in files.get_file_info(pafs.FileSelector(inner)):
        if item.base_name not in names:
            files.delete_file(item.path)


_CAPTURE = "key string, date string, url string, type string, digest string, file string, offset long, length long"


def _write_records(marked: DataFrame, folder: str) -> DataFrame:
    """Records in the order of the rows; their captures."""
    files, inner = open_fs(folder)
    files.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_fs(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, copy, date, own, first_id, first_url in zip(*batch.columns):
                    if out is None or offset > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = target.open_output_stream(f"{base}/{name}", compression=None)
                    payload, url = html.as_py(), url.as_py()
                    digest = _digest(payload)
                    first = None if own.as_py() else (first_id.as_py(), first_url.as_py())
                    record = _record(page.as_py(), url, payload, digest, copy.as_py(), date.as_py(), first)
                    member = gzip.compress(record, GZIP_LEVEL, mtime=0)
                    out.write(member)
                    rows.append((surt(url), re.sub(r"\D", "", date.as_py()), url, "revisit" if first else "response",
                                 digest, name, offset, len(member)))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, pa.int64() if i > 5 else pa.string()) for i, column in enumerate(zip(*rows))],
                        ["key", "date", "url", "type", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    captures = cut(marked.mapInArrow(write, _CAPTURE))
    _keep_only(folder, {row["file"] for row in captures.select("file").distinct().toLocalIterator()})
    return captures


def _line(values: tuple) -> bytes:
    """A capture line; keys hold no blanks or control characters."""
    key, date, url, kind, digest, file, offset, length = values
    rest = {"url": url, "type": kind, "digest": f"sha1:{digest}", "offset": offset, "length": length, "filename": file}
    return f"{key} {date} {json.dumps(rest, ensure_ascii=False, separators=(',', ':'))}\n".encode()


def _write_index(captures: DataFrame, folder: str, block_lines: int) -> list[tuple[str, str, str]]:
    files, inner = open_fs(folder)
    files.create_dir(inner, recursive=True)
    lines = captures.count()
    shards = max(-(-lines // SHARD_LINES), min(SMALL_SHARDS, -(-lines // MIN_LINES)), 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_fs(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        block, keys, places, last, offset = [], [], [], "", 0
        out = None

        def close_block() -> None:
            nonlocal offset
            data = gzip.compress(b"".join(block), GZIP_LEVEL, mtime=0)
            out.write(data)
            places.append((offset, len(data), len(block)))
            offset += len(data)
            block.clear()

        try:
            for batch in batches:
                for values in zip(*(column.to_pylist() for column in batch.columns)):
                    if out is None:
                        out = target.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                    if not block:
                        keys.append(values[0].encode())
                    block.append(_line(values))
                    last = values[0]
                    if len(block) == block_lines:
                        close_block()
            if block:
                close_block()
        finally:
            if out is not None:
                out.close()
        if keys:
            with target.open_output_stream(f"{base}/{name}.dir", compression=None) as listed:
                listed.write(_directory(keys, places))
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[0].decode()]), pa.array([last]), pa.array([name])], ["first", "last", "name"])

    # Ranges of (key, place): a key with very many captures is cut too.
    ordered = captures.repartitionByRange(shards, "key", "date", "file", "offset").sortWithinPartitions(
        "key", "date", "file", "offset")
    written = cut(ordered.mapInArrow(write, "first string, last string, name string"))
    listed = sorted((r["first"].encode(), r["last"].encode(), r["name"]) for r in written.collect())
    _keep_only(folder, {f"{name}.{end}" for _, _, name in listed for end in ("cdx.gz", "dir")})
    return [(first.decode(), last.decode(), name) for first, last, name in listed]


def _directory(keys: list[bytes], places: list[tuple[int, int, int]]) -> bytes:
    """Number of blocks; one fixed-size place per block (offset, length, place of its first key, length of that); keys."""
    at, out = 8 + _PLACE_BYTES * len(keys), [struct.pack("<Q", len(keys))]
    for key, (offset, length, _) in zip(keys, places):
        out.append(struct.pack(_PLACE, offset, length, at, len(key)))
        at += len(key)
    return b"".join(out + keys)


# ---- reading --------------------------------------------------------------------------------------------------------


class Shard:
    """One index shard opened for lookups: blocks are found by reads in the directory and unpacked when needed."""

    def __init__(self, folder: str, name: str) -> None:
        files, base = open_fs(folder)
        self._places = files.open_input_file(f"{base}/{name}.dir")
        self._lines = files.open_input_file(f"{base}/{name}.cdx.gz")
        self.blocks = struct.unpack("<Q", self._places.read_at(8, 0))[0]
        self._last: tuple[int, list[bytes], list[bytes]] = (-1, [], [])
        # Blocks unpacked so far: a lookup needs one, or those that the key's captures fill.
        self.unpacked = 0

    def _place(self, block: int) -> tuple[int, int, int, int]:
        return struct.unpack(_PLACE, self._places.read_at(_PLACE_BYTES, 8 + _PLACE_BYTES * block))

    def _first_key(self, block: int) -> bytes:
        _, _, at, length = self._place(block)
        return self._places.read_at(length, at)

    def _block(self, block: int) -> tuple[list[bytes], list[bytes]]:
        """(keys, lines) of a block; the one used last is kept."""
        if self._last[0] != block:
            offset, length, _, _ = self._place(block)
            lines = gzip.decompress(self._lines.read_at(length, offset)).split(b"\n")[:-1]
            self._last = (block, [line.partition(b" ")[0] for line in lines], lines)
            self.unpacked += 1
        return self._last[1], self._last[2]

    def find(self, key: str) -> Iterator[dict]:
        """Captures of a key, from the last block that starts before it."""
        wanted = key.encode()
        block = max(0, bisect.bisect_left(range(self.blocks), wanted, key=self._first_key) - 1)
        while block < self.blocks:
            keys, lines = self._block(block)
            start, stop = bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)
            for line in lines[start:stop]:
                date, _, rest = line.partition(b" ")[2].partition(b" ")
                yield {"key": key, "date": date.decode(), **json.loads(rest)}
            block += 1
            if stop < len(keys) or block < self.blocks and self._first_key(block) > wanted:
                return

    def close(self) -> None:
        self._places.close()
        self._lines.close()


def _shards_of(shards: list[tuple[bytes, bytes, str]], key: str) -> range:
    """Numbers of the shards that can hold a key: of the first that ends at or behind it, and on while they start with it."""
    wanted = key.encode()
    start = bisect.bisect_left(shards, wanted, key=lambda s: s[1])
    return range(start, bisect.bisect_right(shards, wanted, key=lambda s: s[0]))


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Captures of all given urls, each distinct key once: (key, date, url, type, digest, file, offset, length).

    A url finds the captures of every url with its key (see ``surt``). Urls without captures give no row; null finds
    the pages without url. Keys travel to the tasks of their index shards, in key order, so a block is unpacked once.
    """
    folder = f"{archive.root}/index"
    shards = [(first.encode(), last.encode(), name) for first, last, name in archive.shards]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, key) for key in map(surt, batch.column(0).to_pylist()) for n in _shards_of(shards, key)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int32()), pa.array([key for _, key in found], pa.string())],
                ["shard", "key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, rows = -1, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64() if i > 5 else pa.string()) for i, column in enumerate(zip(*rows))],
                ["key", "date", "url", "type", "digest", "file", "offset", "length"])

        for batch in batches:
            for n, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != number:
                    if shard is not None:
                        shard.close()
                    number, shard = n, Shard(folder, shards[n][2])
                for c in shard.find(key):
                    rows.append((key, c["date"], c["url"], c["type"], c["digest"].removeprefix("sha1:"), c["filename"],
                                 c["offset"], c["length"]))
                    if len(rows) == 5_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)
        if shard is not None:
            shard.close()

    asked = urls.select(F.col(url_col).alias("url")).distinct().mapInArrow(dealt, "shard int, key string").distinct()
    # Keys are narrow, what they find is not: the shards set the number of tasks, not the size of the keys.
    ordered = asked.repartitionByRange(max(1, len(shards)), "shard", "key").sortWithinPartitions("shard", "key")
    return ordered.mapInArrow(find, _CAPTURE)


_RECORD = ("page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "url string, payload binary")


def read_records(archive: Archive, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the given captures: (page_id, record_type, refers_to, payload_bytes, payload_digest, url, payload).

    Records are read by place, neighbours with one read; digests and lengths are checked. A revisit has no payload of
    its own (null; its length and digest are those of the payload it refers to). ``with_payload=False`` leaves the
    payloads out.
    """
    folder = f"{archive.root}/records"

    def parsed(data: bytes, url: str | None) -> tuple:
        headers, block = parse_record(gzip.decompress(data))
        head, _, payload = block.partition(b"\r\n\r\n")
        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        if kind == "response" and (len(payload) != size or _digest(payload) != digest):
            raise ValueError("a payload has changed")
        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
        return (None if page is None else int(page), kind, None if refers is None else int(refers), size, digest, url,
                payload if with_payload and kind == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(folder)
        name, source = None, None
        for batch in batches:
            file, offset, length, url = (column.to_pylist() for column in batch.columns)
            start = 0
            while start < len(file):
                stop, end = start + 1, offset[start] + length[start]
                while (stop < len(file) and file[stop] == file[start] and offset[stop] == end
                       and end - offset[start] < READ_BYTES):
                    end += length[stop]
                    stop += 1
                if file[start] != name:
                    if source is not None:
                        source.close()
                    name = file[start]
                    source = files.open_input_file(f"{base}/{name}")
                raw, first = source.read_at(end - offset[start], offset[start]), offset[start]
                rows = [parsed(raw[offset[i] - first:offset[i] - first + length[i]], url[i]) for i in range(start, stop)]
                page, kind, refers, size, digest, urls, payload = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(kind), pa.array(refers, pa.int64()), pa.array(size, pa.int64()),
                     pa.array(digest), pa.array(urls, pa.string()), pa.array(payload, pa.binary())],
                    ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"])
                start = stop
        if source is not None:
            source.close()

    # Places are narrow, records are not: the records' bytes set the number of tasks.
    places = cut(captures.select("file", "offset", "length", "url"))
    tasks = max(1, -(-(places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    places = places.repartitionByRange(tasks, "file", "offset")
    return places.sortWithinPartitions("file", "offset").mapInArrow(read, _RECORD)


def digest(records: DataFrame) -> DataFrame:
    """Records without url and payload."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def get(archive: Archive, url: str | None) -> list[dict]:
    """Captures of one url, by binary searches and one read per block, without a Spark job."""
    shards = [(first.encode(), last.encode(), name) for first, last, name in archive.shards]
    found, key = [], surt(url)
    for n in _shards_of(shards, key):
        shard = Shard(f"{archive.root}/index", shards[n][2])
        found += shard.find(key)
        shard.close()
    return found

