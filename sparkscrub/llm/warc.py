"""WARC archives with revisit records, and a two-level capture index over them.

Archives: each write task makes one ``.warc.gz`` file, a gzip member for each record, under the shared
folder. Its name holds the number of the task's attempt, and captures name it: a repeated task writes a file
of its own, and what a lost attempt left behind is named by no capture (``clean`` deletes it). Records with
equal payloads of at least MIN_REVISIT bytes are revisits of the one with the smallest id (their HTTP header
keeps the payload's length, their WARC header its digest).

Index: captures are sorted by key (host reversed, then path) over all archives. Level 1 holds them in
gzip-compressed blocks of BLOCK_LINES lines; level 2, the sparse directory, has the first key, the
offset and the length of each block. A look-up takes a binary search in the directory, a range read
of the block, a binary search in the block, and a range read of the record.

Files are read and written by name through Arrow's file systems, so that any shared store works.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscrub.llm.staging import new_dir, small_batches, stage

MIN_REVISIT, BLOCK_LINES = 100, 512
#: Blocks that one task reads back, and captures of one part of the index (a part's directory is searched in one task).
BLOCKS_A_TASK, CAPTURES_A_PART = 8, 200_000
GAP = 1 << 16
CAPTURE_SCHEMA = "key string, id long, file string, offset long, length long"


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI such as file:/x, hdfs://h/x or s3://b/x."""
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: Iterator[bytes]) -> None:
    """Write a file under a name that no other attempt uses."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:  # members are compressed already
        for d in data:
            out.write(d)


def attempt_name(prefix: str, suffix: str) -> str:
    """File name of this attempt of this task."""
    at = TaskContext.get()
    return f"{prefix}-{at.partitionId():06d}-{at.stageId()}-{at.taskAttemptId()}{suffix}"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ``)`` and the path and query; lower-case host, no port 80 or 443."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + (url or "")
    host = ",".join(reversed(host.split("."))) if host else ""
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{host}{f':{port}' if port and port not in (80, 443) else ''}){tail}"


def _clean(value: str | None) -> str:
    """One line; other control characters, which would sort before the end of a key, as %XX."""
    return re.sub("[\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", " ".join((value or "").split()))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a whole WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers, HTTP headers and payload of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record ends too early or too late")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


def _urn(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def payload_digest(html: Column) -> Column:
    return F.sha2(F.coalesce(html, F.lit("")), 256)


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, at = attempt_name("part", ".warc.gz"), [], 0

        def records() -> Iterator[bytes]:
            nonlocal at
            for b in batches:
                payloads = b.column(2).cast(pa.binary()).to_pylist()
                for page_id, url, payload, digest, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), payloads, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    data = record_bytes(page_id, url, payload or b"", digest, refers)
                    rows.append((url_key(_clean(url)), page_id, name, at, len(data)))
                    at += len(data)
                    yield data

        first = next(batches, None)
        if first is None:
            return
        source, batches = batches, None
        batches = (b for part in ((first,), source) for b in part)
        write_file(f"{folder}/{name}", records())
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "id", "file", "offset", "length"])

    return run


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, blocks, lines, at = attempt_name("cdx", ".gz"), [], [], 0

        def flush() -> bytes:
            nonlocal at, lines
            data = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            blocks.append((lines[0].partition("\t")[0], lines[-1].partition("\t")[0], name, at, len(data)))
            at, lines = at + len(data), []
            return data

        def all_blocks() -> Iterator[bytes]:
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    lines.append("\t".join("" if v is None else str(v) for v in row))
                    if len(lines) >= BLOCK_LINES:
                        yield flush()
            if lines:
                yield flush()

        first = next(all_blocks_iter := all_blocks(), None)
        if first is None:
            return
        write_file(f"{folder}/{name}", (d for part_ in ((first,), all_blocks_iter) for d in part_))
        cols = list(zip(*blocks, strict=True))
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["first", "last", "file", "offset", "length"])

    return run


class Directory:
    """The sparse directory of an index part or of a whole index: blocks sorted by first key."""

    def __init__(self, blocks: list[tuple[str, str, str, int, int]], folder: str):
        self.blocks, self.folder = sorted(blocks), folder
        self.firsts = [b[0] for b in self.blocks]
        self._held: dict[tuple[str, int], list[str]] = {}

    def _lines(self, block: tuple[str, str, str, int, int]) -> list[str]:
        """Lines of a block by a range read; the last one read is held."""
        at = (block[2], block[3])
        if at not in self._held:
            fs, path = open_fs(f"{self.folder}/{block[2]}")
            with fs.open_input_file(path) as f:
                data = f.read_at(block[4], block[3])
            self._held = {at: gzip.decompress(data).decode("utf-8", "surrogatepass").split("\n")}
        return self._held[at]

    def blocks_of(self, key: str) -> list[tuple[str, str, str, int, int]]:
        """The blocks that may hold a key, by binary search of their first keys."""
        i, out = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while i < len(self.blocks) and self.firsts[i] <= key:
            if self.blocks[i][1] >= key:
                out.append(self.blocks[i])
            i += 1
        return out

    def captures(self, block: tuple[str, str, str, int, int], key: str) -> list[tuple[int | None, str, int, int]]:
        """(id, file, offset, length) of the captures of a key in a block, by binary search of its lines."""
        lines, out = self._lines(block), []
        j = bisect.bisect_left(lines, key + "\t")
        while j < len(lines) and lines[j].startswith(key + "\t"):
            out.append(parse_line(lines[j]))
            j += 1
        return out

    def find(self, key: str) -> list[tuple[int | None, str, int, int]]:
        """(id, file, offset, length) of every capture of a key."""
        return [c for block in self.blocks_of(key) for c in self.captures(block, key)]


def parse_line(line: str) -> tuple[int | None, str, int, int]:
    """(id, file, offset, length) of a line of the index."""
    _, page_id, file, offset, length = line.split("\t")
    return int(page_id) if page_id else None, file, int(offset), int(length)


def read_ranges(folder: str, captures: list[tuple[int | None, str, int, int]]) -> Iterator[tuple[int | None, bytes]]:
    """Records of captures, file by file in order of offset; near ranges are read at once."""
    captures = sorted(captures, key=lambda c: (c[1], c[2]))
    i = 0
    while i < len(captures):
        j, end = i, captures[i][2] + captures[i][3]
        while j + 1 < len(captures) and captures[j + 1][1] == captures[i][1] and captures[j + 1][2] <= end + GAP and end - captures[i][2] < (8 << 20):
            j += 1
            end = max(end, captures[j][2] + captures[j][3])
        fs, path = open_fs(f"{folder}/{captures[i][1]}")
        with fs.open_input_file(path) as f:
            data = f.read_at(end - captures[i][2], captures[i][2])
        for page_id, _, offset, length in captures[i : j + 1]:
            yield page_id, data[offset - captures[i][2] : offset - captures[i][2] + length]
        i = j + 1


class WarcArchive:
    """Archives and index written from a table of pages."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_dir(spark, "warc")
        self.blocks: DataFrame | None = None
        self.captures: DataFrame | None = None

    def write(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> WarcArchive:
        """Write every row as a record, then the index. Null html is empty, null urls are empty ones.

        Rows with null ids can be responses only; of rows with one payload and the smallest id, repeated or not,
        all are responses. Columns other than the three are not read. An empty table makes empty archives.
        """
        small_batches(self.spark)
        rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
        rows = rows.withColumn("digest", payload_digest(F.col("html")))
        large = rows.where(F.octet_length("html") >= MIN_REVISIT)
        # only payloads that occur again need to be looked up; there is one row of each
        firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
        firsts = stage(firsts, "warc-firsts")
        marked = rows.join(firsts, (rows["digest"] == firsts["d"]) & (F.octet_length("html") >= MIN_REVISIT), "left")
        refers = F.when(F.col("id") > F.col("first"), F.col("first"))
        captures = marked.select("id", "url", "html", "digest", refers.alias("refers")).mapInArrow(_write_archives(f"{self.folder}/archive"), CAPTURE_SCHEMA)
        captures = stage(captures, "warc-captures")
        parts = max(1, -(-captures.count() // CAPTURES_A_PART))
        # by key and id, so that the captures of a very common url are dealt over several parts
        ordered = captures.repartitionByRange(parts, "key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
        self.blocks = stage(ordered.mapInArrow(_write_index(f"{self.folder}/index"), f"{_BLOCK}"), "warc-directory")
        self.captures = captures
        return self

    def clean(self) -> int:
        """Delete files that lost attempts left behind; how many. One listing of file names, no data is read."""
        gone = 0
        for sub, used in (("archive", self.captures), ("index", self.blocks)):
            fs, path = open_fs(f"{self.folder}/{sub}")
            names = {r[0] for r in used.select("file").distinct().collect()}
            for info in fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)):
                if info.base_name not in names and info.base_name[:1] not in "._":
                    fs.delete_file(info.path)
                    gone += 1
        return gone

    def records(self, urls: DataFrame | None = None, url_col: str = "url") -> DataFrame:
        """Records (id, type, refers_to, payload_bytes, payload_digest, url, payload) read back from the archives.

        With ``urls`` (null is an empty url, repeated ones count once): every capture of those, each found by the
        two binary searches. Without: all records, block by block of the index. Captures are range-read from the
        archives; payloads of responses are measured and hashed anew. A revisit has the length and digest of its
        headers and a null payload. Repeated rows of one id are a record each. An empty table gives an empty result.
        """
        folder = self.folder
        wanted = self.blocks.select("first", "last", "file", "offset", "length", F.lit(None).cast("array<string>").alias("keys")) if urls is None else self._blocks_of(urls, url_col)
        wanted = stage(wanted, "warc-wanted")
        # few bytes stand for much work: a fixed number of tasks, which adaptive execution leaves alone
        tasks = max(1, -(-wanted.count() // BLOCKS_A_TASK))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for *block, keys in b[["first", "last", "file", "offset", "length", "keys"]].itertuples(index=False, name=None):
                    directory = Directory([tuple(block)], f"{folder}/index")
                    if keys is None:
                        captures = [parse_line(line) for line in directory._lines(tuple(block))]
                    else:
                        captures = [c for key in keys for c in directory.captures(tuple(block), key)]
                    out, held = [], 0
                    for page_id, member in read_ranges(f"{folder}/archive", captures):
                        out.append(_described(page_id, parse_record(member)))
                        held += len(out[-1][-1] or b"")
                        if held > 16 << 20:
                            yield pd.DataFrame(out, columns=_COLUMNS)
                            out, held = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=_COLUMNS)

        return wanted.repartition(tasks, "file", "offset").mapInPandas(run, "id long, type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary")

    def _blocks_of(self, urls: DataFrame, url_col: str) -> DataFrame:
        """Blocks that may hold the keys of urls, each with those keys (as many as a block has lines, at most, are there to be found).

        Keys go to the parts of the index that they fall among; each task searches the directory of its part
        only. Parts are few: their first and last keys are all that the driver sees.
        """
        bounds = sorted(self.blocks.groupBy("file").agg(F.min("first"), F.max("last")).collect(), key=lambda r: r[1])
        names, firsts, lasts = [r[0] for r in bounds], [r[1] for r in bounds], [r[2] for r in bounds]

        def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"key": [url_key(_clean(url)) for url in b["url"]]})

        def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for key in b["key"]:
                    # parts may start with one and the same key
                    i = max(0, bisect.bisect_left(firsts, key) - 1)
                    while i < len(names) and firsts[i] <= key:
                        if lasts[i] >= key:
                            out.append((names[i], key))
                        i += 1
                yield pd.DataFrame(out, columns=["file", "key"])

        def find(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            directory = Directory(list(blocks[["first", "last", "file", "offset", "length"]].itertuples(index=False, name=None)), "")
            found: dict[tuple, list[str]] = {}
            for key in asked["key"]:
                for block in directory.blocks_of(key):
                    found.setdefault(block, []).append(key)
            return pd.DataFrame([(*block, keys) for block, keys in found.items()], columns=["first", "last", "file", "offset", "length", "keys"])

        asked = urls.select(F.col(url_col).alias("url")).distinct().mapInPandas(keys_of, "key string").distinct().mapInPandas(parts_of, "file string, key string")
        return self.blocks.groupBy("file").cogroup(asked.groupBy("file")).applyInPandas(find, f"{_BLOCK}, keys array<string>")

    def lookup(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        """Captures of each url, without reading records: (url, id, file, offset, length). Null urls have none."""
        folder = self.folder

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for *block, keys in b[["first", "last", "file", "offset", "length", "keys"]].itertuples(index=False, name=None):
                    directory = Directory([tuple(block)], f"{folder}/index")
                    out = [(key, *c) for key in keys for c in directory.captures(tuple(block), key)]
                    yield pd.DataFrame(out, columns=["key", "id", "file", "offset", "length"]).astype({"id": "Int64"})

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"key": [url_key(_clean(url)) for url in b["url"]], "url": b["url"]})

        asked = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()
        found = self._blocks_of(asked, "url").mapInPandas(find, "key string, id long, file string, offset long, length long")
        return asked.mapInPandas(keyed, "key string, url string").join(found, "key").select("url", "id", "file", "offset", "length")


_BLOCK = "first string, last string, file string, offset long, length long"
_COLUMNS = ["id", "type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"]


def _described(page_id: int | None, record: dict) -> tuple:
    headers, kind = record["headers"], record["headers"]["warc-type"]
    said = headers["warc-payload-digest"].removeprefix("sha256:")
    if kind == "revisit":
        return page_id, kind, _urn(headers["warc-refers-to"]), int(record["http"]["content-length"]), said, headers["warc-target-uri"], None
    digest = hashlib.sha256(record["payload"]).hexdigest()
    if digest != said:
        raise ValueError(f"the payload of page {page_id} is damaged")
    return page_id, kind, None, len(record["payload"]), digest, headers["warc-target-uri"], record["payload"]
