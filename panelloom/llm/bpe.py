"""Byte-level BPE by public ranks: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

A text is cut by the tokenizer's pattern; each match is encoded separately. Tier one: the distinct pre-tokens of a piece
that aren't remembered yet are hashed together and looked up in a minimal perfect hash over the vocabulary; a slot's bytes
are compared, so strangers never pass. Tier two: the others start as a linked list of bytes, and a heap gives the pair of
lowest rank (leftmost of equals) to merge until no pair has a rank: n log n however long the pre-token.

Nulls and edges: a null text is empty and gives no ids; ids of a null array decode to no bytes; every byte is a token, so
any text can be encoded; special tokens' strings are ordinary text; pairs of equal rank merge from the left; texts of any
length are encoded whole; repeated rows get equal ids; an empty table gives an empty result. Other columns stay as they are, but
for one that is named like the output, which takes its place.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelloom.llm import frames
from panelloom.llm.frames import ship_package
from panelloom.llm.words import _BYTE_VALUES, chunks, mix, prefix_sums, range_hash

#: Pre-tokens a task remembers before it starts anew: some 50 MB.
REMEMBERED = 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Texts without characters from here on are cut by the standard library's faster engine.
NARROW = 0x250


def narrow_pattern(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s spelt out for characters below NARROW."""
    low = [chr(c) for c in range(NARROW)]
    kinds = {"\\p{L}": "".join(c for c in low if unicodedata.category(c)[0] == "L"), "\\p{N}": "".join(c for c in low if unicodedata.category(c)[0] == "N"), "\\s": re.escape("".join(c for c in low if regex.match(r"\s", c)))}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((k for k in (*kinds, "\\S") if pattern.startswith(k, at)), None)
        if name == "\\S":
            out.append(f"[^{kinds['\\s']}]")  # outside a class only
        elif name:
            out.append(kinds[name] if inside else f"[{kinds[name]}]")
        else:
            inside = inside and pattern[at] != "]" or pattern[at] == "["
            out.append(pattern[at])
        at += len(name or " ")
    return "".join(out)


def byte_hashes(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(k) for k in keys])
    data = np.frombuffer(b"".join(keys), np.uint8)
    return range_hash(prefix_sums(_BYTE_VALUES[data]), np.concatenate(([0], ends[:-1])), ends)


class PerfectHash:
    """Minimal perfect hash by displacement: one seed a bucket sends n keys to n slots without a clash."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        hashes = byte_hashes(keys)
        self.buckets = max(1, n // 4)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.seed = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        sizes = np.diff(edges)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            todo = np.flatnonzero(sizes == size)
            members = order[edges[todo][:, None] + np.arange(size)]
            seed = 1
            while len(todo):  # all buckets of one size try the same seed; those without a clash are settled
                slots = self._slots(hashes[members], np.uint64(seed))
                ordered = np.sort(slots, axis=1)
                good = np.flatnonzero(free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                owner = np.full(n, len(todo))
                np.minimum.at(owner, slots[good].ravel(), np.repeat(good, size))
                good = good[(owner[slots[good]] == good[:, None]).all(axis=1)]
                self.seed[todo[good]] = seed
                self.slot_key[slots[good]] = members[good]
                free[slots[good]] = False
                rest = np.ones(len(todo), bool)
                rest[good] = False
                todo, members, seed = todo[rest], members[rest], seed + 1
        rest = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():  # lone keys take the slots left: -1 - slot
            slot = next(rest)
            self.seed[b] = -1 - slot
            self.slot_key[slot] = order[edges[b]]

    def _slots(self, h: np.ndarray, seed) -> np.ndarray:
        with np.errstate(over="ignore"):
            shift = seed * np.uint64(0x9E3779B97F4A7C15)
        return (mix(h ^ shift) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the number of the only vocabulary key it can be."""
        h = byte_hashes(keys)
        seed = self.seed[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seed < 0, -1 - seed, self._slots(h, np.maximum(seed, 0).astype(np.uint64)))
        return self.slot_key[slots]


class Encoder:
    """Vocabulary, perfect hash and memory of one tokenizer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.perfect = PerfectHash(self.keys)
        self._ready()

    def _ready(self) -> None:
        self.memory: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile(self.pattern).findall
        self.cut_narrow = re.compile(narrow_pattern(self.pattern)).findall
        self.beyond = re.compile(f"[^\x00-{chr(NARROW - 1)}]").search

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memory", "cut", "cut_narrow", "beyond")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._ready()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Tier two: merge the linked bytes of a pre-token, pair of lowest rank first."""
        ranks = self.ranks
        n = len(word)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != to:
                continue  # one of the two parts has grown since
            alive[j] = False
            end[i] = to
            if to < n:
                before[to] = i
                if (r := ranks.get(word[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            p = before[i]
            if p >= 0 and (r := ranks.get(word[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def learn(self, tokens: set[str]) -> None:
        """Encode pre-tokens that aren't remembered."""
        new = [t for t in tokens if t not in self.memory]
        if not new:
            return
        raw = [t.encode() for t in new]
        for token, word, k in zip(new, raw, self.perfect.find(raw).tolist()):
            key = self.keys[k]
            self.memory[token] = (self.ranks[key],) if key == word else self.merge(word)

    def encode(self, text: str) -> list[int]:
        tokens = (self.cut if self.beyond(text) else self.cut_narrow)(text)
        try:
            return list(chain.from_iterable(map(self.memory.__getitem__, tokens)))
        except KeyError:
            distinct = set(tokens)
            if len(self.memory) + len(distinct) > REMEMBERED:
                self.memory.clear()
            self.learn(distinct)
        return list(chain.from_iterable(map(self.memory.__getitem__, tokens)))


def _encode(shared, column: str, out: str, kept: list[str]):
    def run(batches):
        encoder: Encoder = shared.value
        for piece in chunks(batches, column):
            values, sizes = [], [0]
            for text in piece.column(column).to_pylist():
                ids = encoder.encode(text) if text else []
                values.append(np.array(ids, dtype=np.int32))
                sizes.append(len(ids))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(values)))
            yield frames.batch(piece, kept, **{out: ids})

    return run


def _decode(shared, column: str, out: str, kept: list[str]):
    def run(batches):
        tokens: pa.Array = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = batch.column(batch.schema.names.index(column))
                if ids.null_count:
                    ids = pa.array([x or [] for x in ids.to_pylist()], ids.type)
                flat = ids.flatten()
                joined = tokens.take(flat)
                ends = np.frombuffer(joined.buffers()[1], np.int64 if pa.types.is_large_binary(joined.type) else np.int32)[: len(joined) + 1]
                counts = np.concatenate(([0], np.cumsum(np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]))))
                offsets = ends[counts] if len(joined) else np.zeros(len(ids) + 1, np.int64)
                data = joined.buffers()[2]
                decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data if data is not None else pa.py_buffer(b"")])
                yield frames.batch(batch, kept, **{out: decoded})

    return run


def bpe_encode(df: DataFrame, vocab: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with an array of ids of each whole text. vocab: path of a .tiktoken file that the driver reads."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Encoder(load_ranks(vocab), pattern))
    return frames.with_columns(df, partial(_encode, shared, text_col, out), f"`{out}` array<int>")


def _tokens(ranks: dict[bytes, int]) -> pa.Array:
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def bpe_round_trip(df: DataFrame, vocab: str, pattern: str, text_col: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the ids of each whole text and the bytes that those ids decode to: both in one Python worker of each task."""
    ship_package(df.sparkSession)
    ranks = load_ranks(vocab)
    encoder, tokens = (df.sparkSession.sparkContext.broadcast(x) for x in (Encoder(ranks, pattern), _tokens(ranks)))

    def make(kept: list[str]):
        encode, decode = _encode(encoder, text_col, ids, kept), _decode(tokens, ids, out, [*kept, ids])
        return lambda batches: decode(encode(batches))

    return frames.with_columns(df, make, f"`{ids}` array<int>, `{out}` binary")


def bpe_decode(df: DataFrame, vocab: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that each array of ids stands for."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(_tokens(load_ranks(vocab)))
    return frames.with_columns(df, partial(_decode, shared, ids_col, out), f"`{out}` binary")
