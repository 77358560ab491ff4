"""WARC archives with a two-level capture index.

Writing.  Every page is one record.  Of the records with equal payloads of at least
least_bytes, that of the greatest page_id (then of the greatest url) is a response, the others
are revisits that name it and hold no payload; a smaller payload is always a response.
Records are compressed one by one where the page is read, so only compressed payloads are
shuffled, and tasks append them to archives of their own, of about FILE_BYTES each.  The table
of (key, page_id, archive, offset, length) is what counts: an archive of a task that ran twice
is not in it.

Index.  A capture's key is its URL with the host reversed (``surt``).  Captures are sorted by
(key, page_id) over all tasks; each task writes its range as one shard: lines in compressed
blocks of BLOCK lines, and a sparse directory with a block's first key, offset and length.
Shards are as many as the sort has partitions; their first and last keys are all that the
driver learns.

Reading.  A wanted (key, page_id) is sent to the shards whose range holds it.  A task takes
a shard's wanted keys in order, finds the first block by binary search in the directory,
reads that range, finds the line by binary search in the block, and goes on to the next block
while keys are equal.  The records found are read by ranges of the archives, neighbouring ones
at once; payloads are hashed as read.  A revisit's payload is that of the record it refers to.

Result: one row for each page.  Null html is an empty payload; a null url has the key "-"; a
null page_id is the smallest.  Rows that are equal in page_id, url and html are a record each,
of which one is the response, and a (key, page_id) is looked up once and found as often as
it was written.  Archives and index are read and written through Arrow's file systems, in the shared
folder.  Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuzzloom.llm.common import new_folder, rows_in_slices, store, written

BLOCK, FILE_BYTES, READ_BYTES, PIECE = 3000, 1 << 30, 4 << 20, 10_000
#: The pages table has no times; all records carry this one.
DATE = "2024-01-01T00:00:00Z"
#: Fixed by the WARC 1.1 format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d*)?([^?#]*)(?:\?([^#]*))?", re.S)
_ODD = re.compile(rb"[\x00-\x20\x7f]")


def escaped(text: str) -> bytes:
    """UTF-8 without white space and control characters, which are percent-encoded."""
    return _ODD.sub(lambda m: b"%%%02X" % m[0][0], text.encode())


def surt(url: str | None) -> bytes:
    """A sort-friendly key: host in lower case, without www, parts reversed; path; sorted query; no fragment or default port."""
    if url is None:
        return b"-"
    found = _URL.match(url)
    if not found or not found[1]:
        return b"-" + escaped(url)
    host = re.sub(r"^www\d*\.", "", found[1].lower())
    port = "" if found[2] in (None, ":", ":80", ":443") else found[2]
    query = "?" + "&".join(sorted(found[4].split("&"))) if found[4] else ""
    return escaped(",".join(reversed(host.split("."))) + port + ")" + (found[3] or "/") + query)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: str | None, mark: bytes, copy: int) -> str:
    """The same for the same record, whichever task makes it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((page_id, url, copy)).encode() + mark).digest()[:16], version=5)}>"


def record(kind: str, own: str, url: str | None, sha1: bytes, payload: bytes | None, refers: str | None = None, refers_url: str | None = None) -> bytes:
    """One compressed WARC record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Content-Length: %d\r\n" % len(payload) if payload is not None else b"") + b"\r\n" + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32(sha1)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {refers}", f"WARC-Refers-To-Date: {DATE}"] if refers else []
    lines = [x.encode() for x in head] + [name + escaped(x) for name, x in ((b"WARC-Target-URI: ", url), (b"WARC-Refers-To-Target-URI: ", refers_url)) if x is not None]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload."""
    head, _, block = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[x for x, _ in fields])


def rows_of(batches, size: int = 64) -> Iterator[tuple]:
    for part in rows_in_slices(batches, size):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _copies(df: DataFrame) -> DataFrame:
    """Each row as often as its column copies says, numbered from 1 in copy, by two steps so that no row makes a long list."""
    pieces = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PIECE).cast("long"))))
    low = F.col("piece") * PIECE
    if not df.filter(F.col("copies") > PIECE).isEmpty():
        pieces = pieces.repartition("page_id", "url", "piece")
    return pieces.withColumn("copy", F.explode(F.sequence(low + 1, F.least(low + PIECE, F.col("copies"))))).drop("piece")


RECORDS = "page_id long, url string, sha1 binary, mark binary, copy long, to_id long, to_url string, member binary, payload binary"


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row (RECORDS) for each page: a response with its compressed member, a revisit with what it refers to, or a small payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    marks = [F.unhex(F.sha1("payload")).alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("mark")]
    large = rows.filter(F.length("payload") >= least_bytes) if least_bytes > 0 else rows
    each = written(large.select("page_id", "url", *marks).groupBy("page_id", "url", "mark").agg(F.first("sha1").alias("sha1"), F.count("*").alias("n")))
    first = written(each.groupBy("mark").agg(F.max(F.struct("page_id", "url", "n")).alias("w")).select("mark", F.col("w.page_id").alias("to_id"), F.col("w.url").alias("to_url"), F.col("w.n").alias("n")))
    own = F.col("page_id").eqNullSafe(F.col("to_id")) & F.col("url").eqNullSafe(F.col("to_url"))

    def compress(batches):
        for page_id, url, sha1, mark, payload in rows_of(batches):
            yield _batch("page_id long, url string, sha1 binary, mark binary, member binary", [(page_id, url, sha1, mark, record("response", record_id(page_id, url, mark, 0), url, sha1, payload))])

    members = large.select("page_id", "url", *marks, "payload").mapInArrow(compress, "page_id long, url string, sha1 binary, mark binary, member binary")
    named = lambda df: df.select(F.col("mark").alias("m"), "to_id", "to_url")
    found = lambda of: members.join(named(of), (F.col("mark") == F.col("m")) & own).drop("m", "to_id", "to_url")
    responses = found(first.filter("n = 1"))
    if not first.filter("n > 1").isEmpty():  # equal rows, of which any is the response
        names = responses.columns
        responses = responses.unionByName(found(first.filter("n > 1")).groupBy("mark").agg(F.first(F.struct(*names)).alias("r")).select("r.*"))
    null = lambda kind: F.lit(None).cast(kind)
    whole = responses.select("page_id", "url", "sha1", "mark", F.lit(0).cast("long").alias("copy"), null("long").alias("to_id"), null("string").alias("to_url"), "member", null("binary").alias("payload"))
    others = each.join(first.drop("n"), "mark").withColumn("copies", F.col("n") - own.cast("long")).filter("copies > 0")
    again = _copies(written(others)).select("page_id", "url", "sha1", "mark", "copy", "to_id", "to_url", null("binary").alias("member"), null("binary").alias("payload"))
    if least_bytes <= 0:
        return whole.unionByName(again)
    small = rows.filter(F.length("payload") < least_bytes).select("page_id", "url", *marks, null("long").alias("copy"), null("long").alias("to_id"), null("string").alias("to_url"), null("binary").alias("member"), "payload")
    return whole.unionByName(again).unionByName(small)


PLACES = "key binary, page_id long, kind string, file string, offset long, length long"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(PLACES) of all records, appended to archives in the folder."""

    def run(batches):
        fs, at = store(folder)
        fs.create_dir(at)
        file = name = None
        out, where = [], 0
        try:
            for page_id, url, sha1, mark, copy, to_id, to_url, member, payload in rows_of(batches):
                kind = "response"
                if payload is not None:
                    member = record(kind, f"<urn:uuid:{uuid.uuid4()}>", url, sha1, payload)
                elif member is None:
                    kind = "revisit"
                    member = record(kind, record_id(page_id, url, mark, copy), url, sha1, None, record_id(to_id, to_url, mark, 0), to_url)
                if file is None or where >= FILE_BYTES:
                    if file:
                        file.close()
                    name, where = f"{uuid.uuid4().hex}.warc.gz", 0
                    file = fs.open_output_stream(f"{at}/{name}", compression=None)
                    info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), 6, mtime=0)
                    file.write(info)
                    where = len(info)
                file.write(member)
                out.append((surt(url), page_id, kind, name, where, len(member)))
                where += len(member)
                if len(out) >= 2048:
                    yield _batch(PLACES, out)
                    out = []
        finally:
            if file:
                file.close()
        yield _batch(PLACES, out)  # after the last archive was closed

    return written(rows.mapInArrow(run, PLACES))


def _order(key: bytes, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


SHARDS = "low binary, low_id long, high binary, high_id long, lines string, directory string"


def write_index(places: DataFrame, folder: str) -> DataFrame:
    """(SHARDS) of the capture index, sorted over all tasks and written as blocks and directories in the folder."""

    def run(batches):
        fs, at = store(folder)
        fs.create_dir(at)
        name = uuid.uuid4().hex
        low = high = file = None
        directory, block, where = [], [], 0

        def flush():
            nonlocal where
            raw = gzip.compress(b"".join(x[2] for x in block), 6, mtime=0)
            file.write(raw)
            directory.append(json.dumps([block[0][0].decode(), block[0][1], where, len(raw)]))
            where += len(raw)
            block.clear()

        for key, page_id, kind, archive, offset, length in rows_of(batches, 2048):
            if file is None:
                low, file = (key, page_id), fs.open_output_stream(f"{at}/{name}.cdx.gz", compression=None)
            high = (key, page_id)
            fields = json.dumps({"id": page_id, "type": kind, "filename": archive, "offset": offset, "length": length})
            block.append((key, page_id, b"%s %s %s\n" % (key, re.sub(r"\D", "", DATE).encode(), fields.encode())))
            if len(block) >= BLOCK:
                flush()
        if file is not None:
            if block:
                flush()
            file.close()
            with fs.open_output_stream(f"{at}/{name}.idx") as out:
                out.write("\n".join(directory).encode())
            yield _batch(SHARDS, [(*low, *high, f"{name}.cdx.gz", f"{name}.idx")])

    return written(places.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, SHARDS))


class Shard:
    """A shard's directory in memory and one block at a time."""

    def __init__(self, folder: str, lines: str, directory: str):
        self.fs, at = store(folder)
        with self.fs.open_input_file(f"{at}/{directory}") as file:
            rows = [json.loads(x) for x in file.read().decode().split("\n")]
        self.first = [_order(k.encode(), i) for k, i, _, _ in rows]
        self.range = [(a, n) for _, _, a, n in rows]
        self.file, self.now, self.block = self.fs.open_input_file(f"{at}/{lines}"), None, ([], [])

    def read(self, b: int) -> tuple[list[tuple], list[dict]]:
        if b != self.now:
            where, n = self.range[b]
            rows = [x.split(b" ", 2) for x in gzip.decompress(self.file.read_at(n, where)).splitlines()]
            fields = [json.loads(x[2]) for x in rows]
            self.now, self.block = b, ([_order(x[0], f["id"]) for x, f in zip(rows, fields, strict=True)], fields)
        return self.block

    def find(self, key: bytes, page_id: int | None) -> Iterator[dict]:
        """The lines of a key and page_id: binary search in the directory, then in the block."""
        want = _order(key, page_id)
        b = max(0, bisect.bisect_left(self.first, want) - 1)
        while b < len(self.first) and self.first[b] <= want:
            keys, fields = self.read(b)
            at = bisect.bisect_left(keys, want)
            while at < len(keys) and keys[at] == want:
                yield fields[at]
                at += 1
            b += 1

    def close(self) -> None:
        self.file.close()


FOUND = "page_id long, kind string, file string, offset long, length long"


def lookup(shards: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """(FOUND) of all captures of the wanted (key, page_id), which are distinct."""
    held = sorted(((_order(r["low"] or b"", r["low_id"]), _order(r["high"] or b"", r["high_id"]), r["lines"], r["directory"]) for r in shards.collect()), key=lambda x: x[:2])  # one row a partition of the sort
    lows, highs, names = [x[0] for x in held], [x[1] for x in held], [x[2:] for x in held]
    sent, out_fields = "shard int, key binary, page_id long", FOUND

    def send(batches):
        for part in rows_in_slices(batches, 4096):
            rows = []
            for key, page_id in zip(*(c.to_pylist() for c in part.columns), strict=True):
                want = _order(key, page_id)
                rows += [(s, key, page_id) for s in range(bisect.bisect_left(highs, want), bisect.bisect_right(lows, want))]
            yield _batch(sent, rows)

    def read(batches):
        now, shard, out = None, None, []
        for s, key, page_id in rows_of(batches, 4096):
            if s != now:
                if shard:
                    shard.close()
                now, shard = s, Shard(folder, *names[s])
            for x in shard.find(key, page_id):
                out.append((x["id"], x["type"], x["filename"], x["offset"], x["length"]))
                if len(out) >= 4096:
                    yield _batch(out_fields, out)
                    out = []
        if shard:
            shard.close()
        yield _batch(out_fields, out)

    return wanted.select("key", "page_id").mapInArrow(send, sent).repartition("shard").sortWithinPartitions("shard", "key", "page_id").mapInArrow(read, out_fields)


READ = "page_id long, kind string, own string, refers string, payload_bytes long, payload_digest string"


def fetch(found: DataFrame, folder: str) -> DataFrame:
    """(READ) of the records found, read by ranges of their archives in order; the digest is that of the payload read."""

    def run(batches):
        fs, at = store(folder)
        file = name = None
        waiting: list[tuple] = []

        def read():
            low, high = waiting[0][3], waiting[-1][3] + waiting[-1][4]
            raw, out = file.read_at(high - low, low), []
            for page_id, kind, _, offset, length in waiting:
                fields, payload = parsed(raw[offset - low : offset - low + length])
                out.append((page_id, fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), len(payload) if kind == "response" else None, base32(hashlib.sha1(payload).digest()) if kind == "response" else None))
            waiting.clear()
            return _batch(READ, out)

        for row in rows_of(batches, 2048):
            if waiting and (row[2] != name or row[3] != waiting[-1][3] + waiting[-1][4] or row[3] + row[4] - waiting[0][3] > READ_BYTES):
                yield read()
            if row[2] != name:
                if file:
                    file.close()
                name = row[2]
                file = fs.open_input_file(f"{at}/{name}")
            waiting.append(row)
        if waiting:
            yield read()
        if file:
            file.close()

    return found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, READ)


def capture_digest(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back through the index."""
    folder = new_folder(pages.sparkSession)
    places = write_archives(records(pages, least_bytes), folder)
    shards = write_index(places, folder)
    back = written(fetch(lookup(shards, places.select("key", "page_id").distinct(), folder), folder))
    whole = back.filter("kind = 'response'")
    to = whole.select(F.col("own").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    again = back.filter("kind = 'revisit'").join(to, "refers", "left").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    return whole.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, row_number() OVER () AS r FROM pages),
w AS (
    SELECT *, row_number() OVER best AS k, first_value(page_id) OVER best AS to_id, sha1(html) AS hex
    FROM p WINDOW best AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, r))
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN to_id END AS refers_to
FROM w
"""
