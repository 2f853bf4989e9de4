"""Main text of web pages: what a host repeats on distinct pages goes, page structure settles the rest.

Blocks of a page are chrome (inside menus, headers, footers, sidebars, notices, adverts, forms, reader comments), article
(inside article or main) or open. The words of all blocks of a page are its stream; a run is RUN consecutive words of it.
A run that touches open blocks of two distinct pages of a host or more is boilerplate, wherever else it stands. A block that such runs cover wholly goes; from others the runs inside the block are cut, and unique words
stay. What only articles share is text that they quote, or copies: it stays; what only chrome shares goes with the chrome. Of what is left, chrome goes too; inside an
article, class names are chrome only where all their words are (`related-work` is not). An article inside a sidebar, menu,
footer, dialog or an element whose whole class or id names furniture (comments) is chrome if that element is closed.

Runs are counted over the whole host, however many pages it has:

1. Pages are stored in pieces of about PIECE_BYTES. A run's anchor is the least hash of its GRAM-grams, with the host; equal
   runs have equal anchors. Each piece sends its distinct anchors, with a page of each, to buckets by their hash; a bucket
   answers by a bit for each anchor: does it stand in open blocks of two distinct pages?
2. The runs of anchors that do are sent and answered in the same way, as 64-bit hashes.
3. Each piece cuts the runs whose bit is set. Pages of one host with equal articles (without one: equal open blocks) are one
   page to the rule, whatever their menus.

A bucket has about BUCKET_KEYS words' keys, each once a piece, so no host and no run lands in one task. Pieces are stored in
buckets by their number, so that the answers come to them and texts are never shuffled. Anchors are sent as 32 bits: two that
meet by chance only send more runs.
`covered` is the same rule for pages held in one place, by a suffix array.

Nulls and edges: a null or empty html gives an empty text; a null url is a host of its own name (empty); tags cut off at the
end of the page are dropped; a quote that is never closed ends with its tag; a comment or raw element that never ends runs to
the end; repeated rows give equal texts and count as one page; pages of any length are read whole, in linear time; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import ship_package, stored_by
from panelloom.llm.words import SPACED, chunks, mix, prefix_sums, range_hash, sliding_min, words

RUN = 8
GRAM = 4
#: Bytes of html in one piece of pages, rows in it at most, and words of all pages for each bucket of keys.
PIECE_BYTES = 1 << 22
PIECE_ROWS = 50_000
BUCKET_KEYS = 1 << 22
#: Owners of keys that a piece has in open blocks of two pages or more, and of none; buckets of pieces at most (what Spark
#: allows).
MANY = 65535
NONE = 65534
MOST_PARTS = 100_000

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+")

# HTML element names by how they count here.
RAW = frozenset("script style title textarea template iframe noembed noframes svg head select".split())
CHROME = frozenset("nav footer aside form menu dialog button fieldset datalist audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Chrome that stays chrome around an article, where its end tag follows.
FIRM = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words of class, id and role that name page furniture.
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)


def _furniture(attrs: str, inside: bool) -> bool:
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            if inside:  # whole names only: repetition decides on the others
                if any(parts and HINTS.issuperset(parts) and parts != ["header"] for parts in (list(filter(None, _SPLIT.split(v))) for v in value.split())):
                    return True
            elif HINTS.intersection(_SPLIT.split(value)):
                return True
        elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Finder:
    """Next place of a string in a page; one that isn't there any more isn't sought again, which keeps parsing linear."""

    def __init__(self, page: str) -> None:
        self.page, self.next = page, {}

    def find(self, what: str, at: int) -> int:
        known = self.next.get(what, -2)
        if known != -1 and known < at:
            known = self.next[what] = self.page.find(what, at)
        return known


def markup(page: str):
    """(text before, tag name with its slash or "", attributes) of each piece of markup, in page order; the last has no tag."""
    finder = _Finder(page)
    at = done = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = finder.find("-->", at + 4)
            yield page[done:at], "", ""
            at = done = len(page) if end < 0 else end + 3
            continue
        name = _NAME.match(page, at + 1)
        if name is None:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = finder.find(">", at)
                yield page[done:at], "", ""
                at = done = len(page) if end < 0 else end + 1
            else:
                at += 1  # a plain less-than sign
            continue
        to = name.end()
        while (m := _STOP.search(page, to)) is not None and m.group() != ">":
            to = finder.find(m.group(), m.end()) + 1
            if not to:  # never closed: the tag ends where it can
                m = _STOP.search(page, end - 1) if (end := finder.find(">", name.end()) + 1) else None
                break
        yield page[done:at], name.group().lower(), page[name.end() : m.start()] if m else ""
        at = done = m.end() if m else len(page)
        if m and name.group().lower() in RAW and page[m.start() - 1] != "/":
            if (end := re.compile(rf"</{re.escape(name.group())}\b[^>]*>", re.I).search(page, at)) is None:
                at = done = len(page)
            else:
                at = done = end.end()
    yield page[done:], "", ""


def _closed(tags: list[tuple[str, str, str]]) -> set[int]:
    """Which start tags have an end tag of their name of their own."""
    open_: dict[str, list[int]] = {}
    out = set()
    for k, (_, name, _) in enumerate(tags):
        if name.startswith("/"):
            if mine := open_.get(name[1:]):
                out.add(mine.pop())
        elif name:
            open_.setdefault(name, []).append(k)
    return out


class _Chrome:
    """Open elements from the outermost chrome element on, with how many of each name, and of firm ones, are open."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bool]] = []
        self.count: Counter = Counter()
        self.firm = 0

    def __bool__(self) -> bool:
        return bool(self.names)

    def push(self, name: str, firm: bool) -> None:
        self.names.append((name, firm))
        self.count[name] += 1
        self.firm += firm

    def pop(self) -> str:
        name, firm = self.names.pop()
        self.count[name] -= 1
        self.firm -= firm
        return name

    def clear(self) -> None:
        while self.names:
            self.pop()

    def inline(self) -> bool:
        """Chrome inside a line: its words go, the line stays one block."""
        return self.names[0][0] not in BLOCKS and self.names[0][0] not in CHROME


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order; kind 0 chrome, 1 open, 2 article."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    skip = _Chrome()
    depth = 0  # of article and main
    tags = list(markup(page))
    closed = _closed(tags)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, 0 if skip and not skip.inline() else 2 if depth else 1))

    for k, (text, name, attrs) in enumerate(tags):
        if text and not (skip and skip.inline()):
            parts.append(text)
        if not name or name in RAW:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name[0] == "/":
            name = name[1:]
            if name in BLOCKS or name in CHROME:
                flush()
            if skip.count[name]:
                while skip.pop() != name:
                    pass
            elif name in ("article", "main") and depth:
                depth -= 1
            continue
        if name in BLOCKS or name in CHROME:
            flush()
        if name in VOID or attrs.endswith("/"):
            continue
        chrome = name in CHROME or name in ("header", "noscript") and not depth or bool(attrs) and _furniture(attrs, depth > 0 or name in ("article", "main"))
        if name in ("article", "main") and not chrome:
            if skip and not depth and not skip.firm:
                skip.clear()  # furniture that was never closed, or that names a whole page's layout
            if not skip:
                depth += 1
                continue
        if skip or chrome:
            if name not in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or not skip:  # their end tags may be left out
                skip.push(name, chrome and k in closed and (name in FIRM or bool(attrs) and name not in ("html", "body", "form") and _furniture(attrs, True)))
    flush()
    return out


def covered(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a stretch of `run` tokens that stands on two pages or more."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    gone = np.zeros(int(sizes.sum()), bool)
    if len(gone) >= run:
        column = pa.array([" ".join(s) for s in streams], pa.large_string())
        w = words(column, SPACED)
        page = np.repeat(np.arange(len(streams)), sizes)
        rank = np.unique(w.hashes, return_inverse=True)[1].astype(np.int64)
        # a suffix ends with its page: ends are separators that differ from page to page
        total = len(rank)
        end = np.cumsum(sizes)[page]
        depth = 1
        while depth < run:
            step = min(depth, run - depth)
            nxt = np.minimum(np.arange(total) + step, total - 1)
            later = np.where(np.arange(total) + step < end, rank[nxt], rank.max() + 1 + page)
            rank = np.unique(rank * (int(later.max()) + 1) + later, return_inverse=True)[1]
            depth += step
        array = np.argsort(rank, kind="stable")
        ordered = rank[array]
        group = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        first = np.full(int(group[-1]) + 1, len(streams))
        last = np.full(int(group[-1]) + 1, -1)
        np.minimum.at(first, group, page[array])
        np.maximum.at(last, group, page[array])
        repeated = array[(first < last)[group]]
        repeated = repeated[repeated + run <= end[repeated]]
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + run, -1)
        gone = np.cumsum(change[:-1]) > 0
    return np.split(gone, np.cumsum(sizes)[:-1]) if len(streams) else []


def _pieces(batches):
    """Pieces of pages, one a row: their block texts (a line each) and kinds (a digit each)."""
    for chunk in chunks(batches, "html", PIECE_BYTES):
        for piece in (chunk.slice(at, PIECE_ROWS) for at in range(0, chunk.num_rows, PIECE_ROWS)):
            pages, size = [], 0
            for page_id, url, host, page in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
                found = blocks(page) if page else []
                text = "\n".join(t for t, _ in found)
                size += text.count(" ") + len(found)
                pages.append({"page_id": page_id, "url": url, "host": host, "text": text, "kinds": "".join(str(k) for _, k in found)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([size], pa.int64()), pa.array([pages], _PAGES)], names=["piece", "n_words", "pages"]
            )


_PAGES = pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("text", pa.string()), ("kinds", pa.string())]))
_PIECES = "piece long, n_words long, pages array<struct<page_id:long,url:string,host:string,text:string,kinds:string>>"


class _Piece:
    """Runs of a piece's pages (at: first word), with their page, key and anchor, whether they touch an open block, and each page's
    identity: its article, or what it has outside chrome."""

    def __init__(self, pages: list[dict]) -> None:
        self.w = w = words(pa.array([p["text"] for p in pages], pa.large_string()), SPACED)
        hosts = words(pa.array(["h" + p["host"].replace(" ", "_") for p in pages], pa.large_string()), np.ones(256, bool)).hashes
        lines = [p["text"].split("\n") if p["kinds"] else [] for p in pages]
        main = ["a" + "\n".join(t for t, k in zip(mine, p["kinds"]) if k == max(p["kinds"])) for mine, p in zip(lines, pages)]
        self.identity = mix(words(pa.array(main, pa.large_string()), np.ones(256, bool)).hashes ^ mix(hosts))
        total, row_of = len(w.hashes), w.row_of
        if total < RUN:
            self.at, self.page, self.key, self.anchor, self.open = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        sums, salt = prefix_sums(w.hashes), mix(hosts)[row_of]
        i = np.arange(total - RUN + 1)
        whole = i + RUN <= w.first[1:][row_of[: len(i)]]
        j = np.arange(total - GRAM + 1)
        anchor = sliding_min(mix(range_hash(sums, j, j + GRAM) ^ salt[: len(j)]), RUN - GRAM + 1)
        self.at = i[whole]
        self.page = row_of[self.at]
        self.key = mix(range_hash(sums, self.at, self.at + RUN) ^ salt[self.at])
        self.anchor = anchor[self.at]
        sizes = [line.count(" ") + 1 for mine in lines for line in mine]
        open_ = np.repeat(np.frombuffer("".join(p["kinds"] for p in pages).encode(), np.uint8) == ord("1"), sizes)
        before = np.append(0, np.cumsum(open_))
        self.open = before[self.at + RUN] > before[self.at]

    def keep(self, mask: np.ndarray) -> None:
        self.at, self.page, self.key, self.anchor, self.open = self.at[mask], self.page[mask], self.key[mask], self.anchor[mask], self.open[mask]


class _Keys:
    """The distinct keys of a piece in the order they are sent: by bucket, owner and key.

    owner is the identity of the page that has the key in an open block (its number among `pages`), MANY where the piece has two or
    more such pages, NONE where it has none."""

    def __init__(self, p: _Piece, runs: bool, buckets: int) -> None:
        keys, self.back = np.unique(p.key if runs else p.anchor, return_inverse=True)
        self.pages, who = np.unique(p.identity, return_inverse=True)
        lo, hi = np.full(len(keys), len(self.pages)), np.full(len(keys), -1)
        np.minimum.at(lo, self.back[p.open], who[p.page[p.open]])
        np.maximum.at(hi, self.back[p.open], who[p.page[p.open]])
        owner = np.where(hi < 0, NONE, np.where(lo < hi, MANY, lo)).astype(np.uint16)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((keys, owner, bucket))
        self.owner, bucket = owner[self.order], bucket[self.order]
        keys = keys[self.order]
        self.keys = keys if runs else (keys >> np.uint64(32)).astype(np.uint32)
        self.buckets, first = np.unique(bucket, return_index=True)
        self.ends = np.append(first, len(keys))

    def answered(self, answers: list[dict] | None) -> np.ndarray:
        """Whether the bit of each run or anchor of the piece is set."""
        bits = np.zeros(len(self.keys), bool)
        place = {b: i for i, b in enumerate(self.buckets.tolist())}
        for a in answers or []:
            i = place[a["bucket"]]
            mine = slice(self.ends[i], self.ends[i + 1])
            bits[self.order[mine]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=self.ends[i + 1] - self.ends[i]).astype(bool)
        return bits[self.back]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _sent_pages(pages: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The identities that a bucket's keys name, and the owners as numbers among those."""
    named, number = np.unique(owner, return_inverse=True)
    single = named[named < NONE]  # the first ones: NONE and MANY are larger
    return pages[single], np.append(np.arange(len(single)), named[len(single) :]).astype(np.uint16)[number]


def _send(buckets: int, runs: bool):
    """Distinct anchors of each piece, or distinct runs of the answered anchors, for each bucket."""

    def send(batches):
        for row in _rows(batches):
            p = _Piece(row["pages"])
            if runs:
                p.keep(_Keys(p, False, buckets).answered(row["anchors"]))
            k = _Keys(p, runs, buckets)
            for b, lo, hi in zip(k.buckets.tolist(), k.ends[:-1].tolist(), k.ends[1:].tolist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([row["piece"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (*_sent_pages(k.pages, k.owner[lo:hi]), k.keys[lo:hi]))],
                    names=["bucket", "piece", "pages", "owner", "keys"],
                )

    return send


def _answer(runs: bool, batches):
    """A bit for each key of a bucket that stands in open blocks of two distinct pages or more; a bucket's rows come one after the
    other."""
    bucket, rows = None, []

    def flush():
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64 if runs else np.uint32) for r in rows])
        owner = [np.frombuffer(r["owner"], np.uint16) for r in rows]
        least, most = (np.concatenate([np.append(np.frombuffer(r["pages"], np.uint64), none)[np.minimum(o, len(r["pages"]) // 8)] for r, o in zip(rows, owner)]) for none in (np.uint64(2**64 - 1), np.uint64(0)))
        many = np.concatenate(owner) == MANY
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        repeated = np.logical_or.reduceat(many[order], first) | (np.minimum.reduceat(least[order], first) < np.maximum.reduceat(most[order], first))
        bits = np.zeros(len(keys), bool)
        bits[order] = np.repeat(repeated, np.diff(np.append(first, len(keys))))
        at = np.cumsum([0] + [len(o) for o in owner])
        packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r["piece"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "bucket", "bits"])

    for row in _rows(batches):
        if row["bucket"] != bucket:
            if rows:
                yield flush()
            bucket, rows = row["bucket"], []
        rows.append(row)
    if rows:
        yield flush()


def _cut(buckets: int):
    """Texts of the pages without their host's repeated runs and without chrome."""

    def cut(batches):
        for row in _rows(batches):
            p = _Piece(row["pages"])
            p.keep(_Keys(p, False, buckets).answered(row["anchors"]))
            p.keep(_Keys(p, True, buckets).answered(row["runs"]))
            total = len(p.w.hashes)
            lines = [page["text"].split("\n") if page["kinds"] else [] for page in row["pages"]]
            sizes = np.array([line.count(" ") + 1 for page in lines for line in page], np.int64)
            block = np.repeat(np.arange(len(sizes)), sizes)
            inner = p.at[block[p.at] == block[p.at + RUN - 1]]

            def cover(at):
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + RUN, -1)
                return np.cumsum(change[:-1]) > 0

            gone, any_ = cover(inner), cover(p.at)
            first = np.cumsum(sizes) - sizes
            some, whole = (np.logical_or.reduceat(gone, first), np.logical_and.reduceat(any_, first)) if len(sizes) else (gone, any_)
            texts, k = [], 0
            for page, mine in zip(row["pages"], lines):
                kept = []
                for line, kind in zip(mine, page["kinds"]):
                    if kind != "0" and not whole[k]:
                        if some[k]:
                            line = " ".join(t for t, g in zip(line.split(" "), gone[first[k] : first[k] + sizes[k]].tolist()) if not g)
                        if line:
                            kept.append(line)
                    k += 1
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["page_id"] for x in row["pages"]], pa.int64()), pa.array([x["url"] for x in row["pages"]], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return cut


def _exchange(pieces: DataFrame, buckets: int, parts: int, runs: bool) -> DataFrame:
    """For each piece the answers to its keys, dealt as the pieces are."""
    sent = pieces.mapInArrow(_send(buckets, runs), "bucket int, piece long, pages binary, owner binary, keys binary")
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_answer, runs), "piece long, bucket int, bits binary")
    name = "runs" if runs else "anchors"
    gathered = answers.repartition(parts, "piece").groupBy("piece").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return stored_by(gathered, "piece", parts, name)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url and text (blocks of the main text, joined by line feeds)."""
    ship_package(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[^/?#]*//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    parts = min(MOST_PARTS, max(1, rows.rdd.getNumPartitions()))
    pieces = stored_by(rows.mapInArrow(_pieces, _PIECES), "piece", parts, "pieces")
    buckets = int(pieces.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_KEYS + 1
    with_anchors = pieces.join(_exchange(pieces, buckets, parts, False).hint("shuffle_hash"), "piece", "left")
    answered = with_anchors.join(_exchange(with_anchors, buckets, parts, True).hint("shuffle_hash"), "piece", "left")
    return answered.select("pages", "anchors", "runs").mapInArrow(_cut(buckets), "page_id long, url string, text string")
