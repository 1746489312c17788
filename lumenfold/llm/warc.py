"""WARC archives of pages, and a two-level capture index over them.

Archives are written by Spark's own text writer, so they go wherever Spark can write and survive lost tasks:
every record is one gzip member (more, if it is larger than 16 MB), and as a member of less than 2^24 bytes
of content ends in a zero byte, that byte is left to the writer as the line separator. Equal payloads of at
least ``REVISIT_BYTES`` are stored once; the other captures are revisit records.

The index sorts the keys (reversed host, path, capture) into compressed blocks and keeps a sparse directory of
first keys, of at most ``MAX_BLOCKS`` entries at any size. A look-up finds its block by binary search in the
directory, its line by binary search in the block, and its record by a seek and a read of that range of the
archive within the task: neither building nor reading shuffles the archives.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.words import pieces, tidied
from lumenfold.runtime import cut, scratch, ship

REVISIT_BYTES = 1000
BLOCK_LINES, MAX_BLOCKS = 3000, 65_536
#: Bytes of one archive file, and repeated payloads that are broadcast (40 bytes each) rather than shuffled.
FILE_BYTES, FEW_REVISITS = 32 << 20, 500_000
#: Beyond that, payloads with more than this part of all repeats are still broadcast: as many at most.
HOT_PARTS = 1000
_MEMBER = (1 << 24) - 1
_CRLF = b"\r\n"
_CHUNK = 1 << 18


def surt(url: str | None) -> str:
    """Reversed host and the rest: https://www.Example.org:80/a?b -> org,example,www)/a?b."""
    rest = (url or "").strip()
    rest = rest.split("://", 1)[1] if "://" in rest else rest
    cut_at = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut_at].rsplit("@", 1)[-1].lower(), rest[cut_at:].split("#", 1)[0]
    host = host.rsplit(":", 1)[0] if host.rsplit(":", 1)[-1].isdigit() else host
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else f"/{path}")


def target(url: str | None) -> str:
    """The URL as it stands in a record: blanks and control characters escaped, about:blank for none."""
    return "about:blank" if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The sort key of a capture, from the URL as archived."""
    return f"{surt(target(url))} {-1 if page_id is None else page_id:020d}"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    out = []
    for a in range(0, max(1, len(data)), _MEMBER):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(z.compress(data[a : a + _MEMBER]) + z.flush())
    return b"".join(out)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with HTTP header and payload, or a revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _CRLF.join(h.encode() for h in head) + _CRLF * 2 + block + _CRLF * 2


@dataclass
class Record:
    """A record as read back; offset and length are of its gzip members in the archive."""

    headers: dict[str, str]
    block: bytes
    offset: int
    length: int

    def page(self, name: str = "warc-record-id") -> int | None:
        value = self.headers.get(name, "<urn:page:none>")[len("<urn:page:") : -1]
        return int(value) if value.lstrip("-").isdigit() else None

    @property
    def digest(self) -> bytes:
        return base64.b32decode(self.headers["warc-payload-digest"].removeprefix("sha1:"))

    def payload(self) -> tuple[bytes, int]:
        """The payload (of a revisit: none) and the length of the full payload."""
        http, _, body = self.block.partition(_CRLF * 2)
        length = next(int(h.split(b":")[1]) for h in http.split(_CRLF) if h.lower().startswith(b"content-length:"))
        return body, length


def parse(raw: bytes, offset: int = 0, length: int = 0) -> Record:
    head, _, rest = raw.partition(_CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    return Record(headers, rest[: int(headers["content-length"])], offset, length)


def _members(f) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, data) of each gzip member of a stream, which is read in chunks."""
    begin, rest, at = 0, b"", 0  # at: bytes of the stream consumed by finished members and those fed so far
    while True:
        rest = rest or f.read(_CHUNK)
        if not rest:
            return
        z, data = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = f.read(_CHUNK)
                if not rest:
                    raise ValueError(f"the archive ends within a member that begins at {begin}")
            data.append(z.decompress(rest))
            at += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield begin, at, b"".join(data)
        begin = at


def records(f) -> Iterator[Record]:
    """All records of an archive (bytes or a stream), or of a range of it that begins with a record."""
    begun: list[tuple[int, int, bytes]] = []
    for m in _members(io.BytesIO(f) if isinstance(f, bytes) else f):
        if begun and m[2].startswith(b"WARC/"):
            yield parse(b"".join(x[2] for x in begun), begun[0][0], begun[-1][1] - begun[0][0])
            begun = []
        begun.append(m)
    if begun:
        yield parse(b"".join(x[2] for x in begun), begun[0][0], begun[-1][1] - begun[0][0])


def _first_captures(rows: DataFrame) -> DataFrame:
    """(_digest, _size, top) of the payloads of REVISIT_BYTES or more that several rows have; top is the largest page_id."""
    slim = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", F.unhex(F.sha1("payload")).alias("_digest"), F.octet_length("payload").alias("_size"))
    return slim.groupBy("_digest", "_size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")


def _with_revisits(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, payload) with refers_to: the page whose equal payload is archived instead, or null.

    The repeated payloads are broadcast if they are few. Otherwise those with more than 1 / HOT_PARTS of the
    repeats are, and rows meet the remaining ones by a shuffle, which no payload can then skew.
    """
    found = cut(_first_captures(rows))
    keys = [F.unhex(F.sha1("payload")), F.octet_length("payload").cast("int")]
    refers = lambda top: F.when(F.col("page_id") != F.col(top), F.col(top))

    def on(side: DataFrame, one, two):
        return (one == side["_digest"]) & (two == side["_size"])

    if found.count() <= FEW_REVISITS:
        few = F.broadcast(found.drop("n"))
        return rows.join(few, on(few, *keys), "left").select("page_id", "url", "payload", refers("top").alias("refers_to"))
    repeats = found.agg(F.sum("n")).first()[0]
    hot, cold = found.where(F.col("n") * HOT_PARTS > repeats).drop("n"), found.where(F.col("n") * HOT_PARTS <= repeats).drop("n")
    hot = F.broadcast(hot)
    part = rows.join(hot, on(hot, *keys), "left").select("page_id", "url", "payload", F.col("top").alias("hot"))
    # what is decided already, or too small to repeat, travels under a key of its own
    alone = F.unhex(F.sha1(F.concat_ws(":", F.lit("alone"), F.col("page_id"), F.col("url"))))
    part = part.withColumn("_one", F.when(F.col("hot").isNull() & (keys[1] >= REVISIT_BYTES), keys[0]).otherwise(alone))
    return part.join(cold, on(cold, F.col("_one"), keys[1]), "left").select("page_id", "url", "payload", refers("top").alias("cold"), refers("hot").alias("hot")).select("page_id", "url", "payload", F.coalesce("hot", "cold").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of pages (page_id, url, html) below path; null html is an empty payload.

    Of captures with equal payloads of REVISIT_BYTES or more that with the largest page_id is a response, the
    others revisit it. Rows that repeat a page_id are written as often, each by its own payload: rows that share
    the largest page_id of a payload are all responses, as is a row without page_id. An archive ends with the
    record that takes it to FILE_BYTES.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "payload"):
                for page, url, payload, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    kind = "response" if refers is None else "revisit"
                    held.append(gzip_member(record(kind, page, url, payload, hashlib.sha1(payload).digest(), refers, date)))
                    size += len(held[-1])
                    if size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

    written = _with_revisits(rows).mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", "\x00").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every archive, and content for those who select it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "length", "content")


def open_archive(path: str):
    """A seekable stream of a file of the shared folder: by its local name, or by Arrow's file systems."""
    if path.startswith("file:") or "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    files, name = pa.fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def _seekable(found: DataFrame) -> bool:
    """Whether tasks can open the archives themselves; asked of one task. Otherwise Spark's reader brings the contents."""
    first = found.select("path").limit(1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for path in batch.column("path").to_pylist():
                try:
                    with open_archive(path) as f:
                        fine.append(len(f.read(2)) == 2)
                except (OSError, ValueError, ImportError):  # no such file system here
                    fine.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(fine, pa.bool_())], ["fine"])

    return all(r.fine for r in first.mapInArrow(probe, "fine boolean").collect())


@dataclass
class CaptureIndex:
    """blocks: (block, lines) with compressed, sorted lines; directory: each block's first key, in order."""

    blocks: DataFrame
    directory: list[str]
    archive_path: str
    seekable: bool = True
    files: int = 1

    def blocks_of(self, key: str) -> list[str]:
        return _blocks_of(self.directory, key)


def _blocks_of(directory: list[str], key: str) -> list[str]:
    """First keys of all blocks that can hold a key: those that begin with it, and the one before, whose tail can hold it."""
    after, begins = bisect.bisect_left(directory, key), bisect.bisect_right(directory, key)
    return directory[max(0, after - 1) : after] + ([key] if begins > after else [])


def _scanned(seekable: bool):
    """For mapInArrow: (key, file, offset, length) of every record of the archives, a stream of chunks of each in hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                with open_archive(path) if seekable else io.BytesIO(batch.column("content")[i].as_py()) as f:
                    found = [(capture_key(r.headers["warc-target-uri"], r.page()), path, r.offset, r.length) for r in records(f)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])

    return tidied(run)


def build_index(spark: SparkSession, archive_path: str, index_path: str) -> CaptureIndex:
    """Scan the archives once and write the two levels of their index."""
    ship(spark)
    found = archives(spark, archive_path)
    seekable, files = _seekable(found), max(1, min(65_536, found.count()))
    found = found.select("path").repartition(files, "path") if seekable else found.select("path", "content")
    entries = cut(found.mapInArrow(_scanned(seekable), "key string, file string, offset long, length long"))
    lines = max(BLOCK_LINES, -(-entries.count() // MAX_BLOCKS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(some: list[tuple]) -> pa.RecordBatch:
            text = "\n".join(f"{k}\t{f}\t{o}\t{n}" for k, f, o, n in some)
            return pa.RecordBatch.from_arrays([pa.array([some[0][0]]), pa.array([zlib.compress(text.encode())], pa.binary())], ["first_key", "lines"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True)
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)

    ranges = max(1, min(4096, entries.count() // (8 * lines) + 1))
    done = entries.repartitionByRange(ranges, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(blocks, "first_key string, lines binary")
    done.write.parquet(index_path)
    stored = spark.read.parquet(index_path)
    directory = sorted(r.first_key for r in stored.select("first_key").collect())  # at most MAX_BLOCKS + ranges keys
    return CaptureIndex(stored, directory, archive_path, seekable, files)


def _found(wanted: list[str], lines: list[bytes]) -> Iterator[tuple[str, str, int, int]]:
    """Binary search of each key in the sorted lines of each block, whatever the order of the blocks; all lines of a key."""
    for block in lines:
        text = zlib.decompress(block).decode().split("\n")
        keys = [x.split("\t", 1)[0] for x in text]
        for key in wanted:
            at = bisect.bisect_left(keys, key)
            while at < len(keys) and keys[at] == key:
                _, f, o, n = text[at].split("\t")
                yield key, f, int(o), int(n)
                at += 1


def look_up(index: CaptureIndex, captures: DataFrame) -> DataFrame:
    """(key, file, offset, length) of captures (page_id, url), by directory and blocks; unknown ones are missing."""
    directory = captures.sparkSession.sparkContext.broadcast(index.directory)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = directory.value
        for batch in batches:
            keys = [capture_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)]
            places = [(b, k) for k in keys for b in _blocks_of(first, k)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in places], pa.string()), pa.array([k for _, k in places], pa.string())], ["first_key", "key"])

    def search(wanted: pa.Table, block: pa.Table) -> pa.Table:
        found = list(_found(sorted(set(wanted.column("key").to_pylist())), block.column("lines").to_pylist()))
        cols = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "file", "offset", "length"), cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)})

    wanted = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(place, "first_key string, key string")
    return wanted.groupBy("first_key").cogroup(index.blocks.groupBy("first_key")).applyInArrow(search, "key string, file string, offset long, length long")


_CAPTURE = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_CAPTURE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(f, places: list[tuple[int, int]]) -> list[tuple]:
    """The captures at (offset, length) of an open archive, in the order of the file, each verified."""
    rows = []
    for offset, length in sorted(places):
        f.seek(offset)
        r = next(records(io.BytesIO(f.read(length))))
        body, size = r.payload()
        kind = r.headers["warc-type"]
        if kind == "response" and (len(body) != size or hashlib.sha1(body).digest() != r.digest):
            raise ValueError(f"the payload of page {r.page()} does not match its digest")
        rows.append((r.page(), size, r.digest.hex(), kind, r.page("warc-refers-to") if kind == "revisit" else None))
    return rows


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_CAPTURE)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(_CAPTURE, cols, strict=True)})


def _wanted(places: pa.Table) -> list[tuple[int, int]]:
    return list(zip(places.column("offset").to_pylist(), places.column("length").to_pylist(), strict=True))


def read_captures(index: CaptureIndex, places: DataFrame) -> DataFrame:
    """Each record at (file, offset, length), read from its range and verified: the query's columns.

    Only places are shuffled, by file; the task opens the archive, seeks and reads its ranges. Where tasks can't
    open the shared folder's file system, archives (of about FILE_BYTES each) come with the places instead.
    """
    if index.seekable:

        def ranges(key: tuple, wanted: pa.Table) -> pa.Table:
            with open_archive(key[0].as_py()) as f:
                return _table(_read(f, _wanted(wanted)))

        # places are few bytes; a number of partitions of their own keeps their reads from being put into one task
        return places.repartition(index.files, "file").groupBy("file").applyInArrow(ranges, _CAPTURE_SCHEMA)

    def cut_out(wanted: pa.Table, archive: pa.Table) -> pa.Table:
        return _table(_read(io.BytesIO(archive.column("content")[0].as_py()), _wanted(wanted)) if archive.num_rows else [])

    files = archives(places.sparkSession, index.archive_path).select(F.col("path").alias("file"), "content")
    return places.groupBy("file").cogroup(files.groupBy("file")).applyInArrow(cut_out, _CAPTURE_SCHEMA)


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """A range of a file of any file system that Spark knows, for single look-ups from the driver."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
    finally:
        stream.close()


def fetch(index: CaptureIndex, url: str, page_id: int) -> list[Record]:
    """The captures of one page: directory, block, range, without a pass over the archives."""
    spark = index.blocks.sparkSession
    key = capture_key(url, page_id)
    if not index.blocks_of(key):
        return []
    rows = index.blocks.where(F.col("first_key").isin(index.blocks_of(key))).collect()
    return [next(records(read_range(spark, f, o, n))) for _, f, o, n in _found([key], [bytes(r.lines) for r in rows])]


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of pages, by way of archives.

    Pages are archived in the shared folder, indexed, looked up one by one and read back from their ranges.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    where = scratch(spark, "warc")
    write_archives(pages, f"{where}/archives")
    index = build_index(spark, f"{where}/archives", f"{where}/index")
    return read_captures(index, look_up(index, pages))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, lower(sha1(b)) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND top <> page_id THEN top END AS refers_to
FROM m
"""
