"""WARC archives of captures and their index: locally sorted runs, merged by a loser tree into ordered capture histories.

1. record_types: of captures with equal payloads the largest page is the response, the others are revisits of it. Payloads
   that stand once are known from a bitmap and stay where they are; only the others meet the table of repeated digests.
2. write_archives: each page becomes a WARC/1.1 record, one gzip member a record: a response with its payload, or a revisit
   (identical-payload-digest) that holds the HTTP head alone and names the response. Records are packed into archives of about
   ARCHIVE_BYTES, kept as binary cells of a Parquet table in the shared folder, so any store that Spark can write will do.
3. read_archives: the archives are read back and parsed. Digests and lengths of responses are taken from the bytes read, those
   of revisits from their heads. An archive's captures, sorted by URL key, timestamp and page, are a run.
4. merge_index: bounds from a sample of at most SAMPLE keys cut the table into ranges; a run is cut at the bounds into blocks of
   at most BLOCK captures. A range's blocks come in order of their first key; a loser tree merges them, and a block is opened
   only when the merge has come to its first key, so that about one block of each run is in memory. The ranges follow each
   other, so the table is in global order. A busy URL splits between ranges by page, run and offset.

Nulls and edges: a null html is an empty payload; a null url has the key ")/"; captures without a page id are revisits of
a numbered twin, or responses if there is none; rows that repeat the largest id are all responses; pages of any length are one
record; other columns are ignored, whatever their names; an empty table gives an empty index. The capture time is ORIGIN plus
one second for each page id, as pages have no time of their own.
"""

from __future__ import annotations

import base64
import bisect
import datetime as dt
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import key_bitmap, maybe_in, ship_package, stored
from panelloom.llm.words import chunks

ARCHIVE_BYTES = 4 << 20
ORIGIN = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
#: Captures in a block of a run and in a range of the index, ranges at most, and keys in the sample that the bounds come from.
BLOCK = 256
RANGE_ROWS = 8000
MOST_RANGES = 20_000
SAMPLE = 200_000
_FIELDS = [("run", pa.string()), ("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_NAMES = [n for n, _ in _FIELDS]
_CAPTURES = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _FIELDS)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: com,example,www)/a?b."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return f")/{url}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


def _urn(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def _date(page_id: int | None) -> str:
    return f"{ORIGIN + dt.timedelta(seconds=(page_id or 0) % (1 << 31)):%Y-%m-%dT%H:%M:%SZ}"


def _uri(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page (id, url) that refers_to names."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    revisit = ""
    if refers_to:
        revisit = (
            f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {_urn(*refers_to)}\r\n"
            f"WARC-Refers-To-Target-URI: {_uri(refers_to[1])}\r\nWARC-Refers-To-Date: {_date(refers_to[0])}\r\nX-Refers-To-Page-ID: {refers_to[0]}\r\n"
        )
    head = (
        f"WARC/1.1\r\nWARC-Type: {'revisit' if refers_to else 'response'}\r\nWARC-Record-ID: {_urn(page_id, url)}\r\nWARC-Target-URI: {_uri(url)}\r\nWARC-Date: {_date(page_id)}\r\n{revisit}"
        f"X-Page-ID: {'' if page_id is None else page_id}\r\nWARC-Block-Digest: sha1:{digest(block)}\r\nWARC-Payload-Digest: sha1:{digest(payload)}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def records(archive: bytes):
    """(offset, length, headers, block) of each record; raises ValueError where a record is damaged."""
    view, at = memoryview(archive), 0
    while at < len(view):
        member, begin, parts = zlib.decompressobj(31), at, []
        while not member.eof:
            if at >= len(view):
                raise ValueError(f"record at {begin} is cut off")
            piece = view[at : at + 16384]
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        block = rest[:size]
        if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"record at {begin} is damaged")
        yield begin, at - begin, headers, block


def _write(batches):
    parts, size = [], 0

    def archive():
        data = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest() + ".warc.gz"]), pa.array([data], pa.binary())], names=["run", "data"])

    for piece in chunks(batches, "html"):
        for page, url, html, top, top_url in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html", "top", "top_url"))):
            parts.append(record(page, url, (html or "").encode(), None if top is None else (top, top_url)))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                parts, size = [], 0
    if parts:
        yield archive()


def _order(row: tuple) -> tuple:
    """URL key, timestamp and page; captures that repeat all three by their place."""
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[7]


def _capture(name: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    page, url, seen = headers["X-Page-ID"], headers["WARC-Target-URI"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    stamp = "".join(c for c in headers["WARC-Date"] if c.isdigit())
    kind, top = headers["WARC-Type"], headers.get("X-Refers-To-Page-ID")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (size != len(payload) or seen != digest(payload)):
        raise ValueError(f"payload at {offset} is damaged")
    return name, url_key(url), stamp, int(page) if page else None, url, size, seen, offset, length, kind, int(top) if top else None


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=_NAMES)


def _read(batches):
    for batch in batches:
        for name, data in zip(batch.column("run").to_pylist(), batch.column("data").to_pylist()):
            yield _columns(sorted((_capture(name, *r) for r in records(data)), key=_order))


class LoserTree:
    """k-way merge of sorted runs. An inner node keeps the loser of its match and the winner, who goes up.

    Taking the first row replays the path of its leaf against the losers; a run that is put later takes a free leaf and
    replays that path against the winners of the other subtrees."""

    def __init__(self, key, runs=()) -> None:
        self.key = key
        self.k, self.win, self.loser, self.free = 1, [-1, 0], [-1], [0]
        self.runs: list[list] = [[]]
        self.at = [0]
        self.head: list = [None]  # key of each leaf's next row
        for run in runs:
            self.put(run)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _match(self, node: int) -> None:
        a, b = self.win[2 * node], self.win[2 * node + 1]
        self.win[node], self.loser[node] = (a, b) if self._before(a, b) else (b, a)

    def put(self, run: list) -> None:
        if not run:
            return
        if not self.free:
            k = self.k
            self.free = list(range(2 * k - 1, k - 1, -1))
            self.runs += [[] for _ in range(k)]
            self.at += [0] * k
            self.head += [None] * k
            self.k = k = 2 * k
            self.win, self.loser = [-1] * k + list(range(k)), [-1] * k
            for node in range(k - 1, 0, -1):
                self._match(node)
        leaf = self.free.pop()
        self.runs[leaf], self.at[leaf], self.head[leaf] = run, 0, self.key(run[0])
        node = (self.k + leaf) // 2
        while node:
            self._match(node)
            node //= 2

    def first(self):
        """Key of the first row; None where there is no row left."""
        return self.head[self.win[1]]

    def take(self):
        best = self.win[1]
        row = self.runs[best][self.at[best]]
        self.at[best] += 1
        if self.at[best] < len(self.runs[best]):
            self.head[best] = self.key(self.runs[best][self.at[best]])
        else:
            self.head[best], self.runs[best] = None, []
            self.free.append(best)
        node = (self.k + best) // 2
        while node:
            if self._before(self.loser[node], best):
                self.loser[node], best = best, self.loser[node]
            self.win[node] = best
            node //= 2
        return row

    def __iter__(self):
        while self.first() is not None:
            yield self.take()


_BLOCK = pa.list_(pa.struct(_FIELDS))


def _cut(bounds: list[tuple]):
    """Each run (a batch of captures in order) as blocks, cut at the bounds."""

    def cut(batches):
        for batch in batches:
            for run in batch.column("captures").to_pylist():
                rows = [tuple(r.values()) for r in run]
                parts = [bisect.bisect_right(bounds, _order(r)) for r in rows]
                at = 0
                while at < len(rows):
                    to = min(at + BLOCK, bisect.bisect_right(parts, parts[at], at))
                    first = rows[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([parts[at]], pa.int32()), *(pa.array([first[i]], _FIELDS[i][1]) for i in (1, 2, 3, 0, 7)), pa.array([run[at:to]], _BLOCK)], names=["part", "url_key", "stamp", "page_id", "run", "offset", "captures"]
                    )
                    at = to

    return cut


def _merge(batches):
    def blocks():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column("part")[i].as_py(), [tuple(r.values()) for r in batch.column("captures")[i].as_py()]

    tree, part, out = LoserTree(_order), None, []

    def until(key):
        """Rows before the key (all if it is None)."""
        while (head := tree.first()) is not None and (key is None or head < key):
            yield tree.take()

    for p, rows in blocks():
        for row in until(None if p != part else _order(rows[0])):
            out.append(row)
            if len(out) == 5000:
                yield _columns(out)
                out = []
        tree.put(rows)
        part = p
    for row in until(None):
        out.append(row)
        if len(out) == 5000:
            yield _columns(out)
            out = []
    if out:
        yield _columns(out)


def record_types(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with top and top_url: the page that a revisit refers to, null for responses."""
    rows = pages.withColumn("_payload", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    many = rows.groupBy("_payload").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("top")).filter("n > 1 AND top.page_id IS NOT NULL")
    many = stored(many.select("_payload", F.col("top.page_id").alias("top"), F.col("top.url").alias("top_url")), "payloads")
    split = maybe_in(rows, F.col("_payload"), key_bitmap(many, F.col("_payload")))
    once = split.filter("NOT _maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("top"), F.lit(None).cast("string").alias("top_url"))
    revisit = F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))
    others = split.filter("_maybe").join(many, "_payload", "left").select("page_id", "url", "html", *(F.when(revisit, F.col(c)).alias(c) for c in ("top", "top_url")))
    return once.unionByName(others)


def write_archives(pages: DataFrame) -> DataFrame:
    """The table of archives (run, data), written to the shared folder."""
    ship_package(pages.sparkSession)
    rows = record_types(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    return stored(rows.mapInArrow(_write, "run string, data binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Captures, a sorted run for each archive."""
    return archives.mapInArrow(_read, _CAPTURES)


def _runs(batches):
    for batch in batches:
        for rows in _read([batch.slice(i, 1) for i in range(batch.num_rows)]):
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64()), pa.array([rows.to_pylist()], _BLOCK)], names=["n", "captures"])


def merge_index(archives: DataFrame) -> DataFrame:
    """Captures of all archives in order of url_key, stamp and page_id over the whole table."""
    ship_package(archives.sparkSession)
    runs = stored(archives.mapInArrow(_runs, f"n long, captures array<struct<{_CAPTURES.replace(' ', ':').replace(',:', ',')}>>"), "runs")
    total = runs.agg(F.sum("n")).first()[0] or 0
    ranges = min(MOST_RANGES, -(-total // RANGE_ROWS)) or 1
    share = min(1.0, min(SAMPLE, 100 * ranges) / max(total, 1))
    picked = runs.select(F.explode("captures").alias("c")).select("c.*").filter(F.pmod(F.xxhash64("run", "offset"), F.lit(1 << 30)) < int(share * (1 << 30)))
    keys = sorted(_order(tuple(r)) for r in picked.limit(2 * SAMPLE).collect()) if ranges > 1 else []  # bounds only: any would do
    bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    blocks = runs.select("captures").mapInArrow(_cut(bounds), f"part int, url_key string, stamp string, page_id long, run string, offset long, {runs.schema['captures'].name} {runs.schema['captures'].dataType.simpleString()}")
    ordered = blocks.repartitionById(ranges, "part").sortWithinPartitions("part", "url_key", "stamp", "page_id", "run", "offset")
    return ordered.select("part", "captures").mapInArrow(_merge, _CAPTURES)


def capture_index(pages: DataFrame) -> DataFrame:
    """Write, read back and merge: the ordered index of all pages' captures."""
    return merge_index(write_archives(pages))
