r"""Phrase collocations: candidates from sketch bounds, counted exactly by delimiter-guarded automata, scored per language.

Texts are lower-cased (A-Z), split at [.,;:!?\x0A-\x0D] into pieces and those into words [^\x20\x09]+. Phrases are 2 to 3 words
in a row inside a piece; f is their number of occurrences in a language, overlapping ones included.

1. Sketch. Each task hashes the runs of 1, 2 and 3 words of its texts, counts them and deals the cells (the upper bits of the
   hash) out by hash ranges, whose number follows the bytes of text. A range adds up what all tasks sent: an upper bound of f
   for whatever falls into the cell, as collisions only add. Cells that reach the least count become bits of a map of 2**MAP_BITS
   bits (32 MB, whatever the input); that map is all that the driver and the tasks hold of the corpus.
2. Count. Each task collects the runs of a piece of text whose bits are set, compiles them into a pyahocorasick automaton,
   guarded by a blank before, between and after the words, and scans the text for all matches, which may overlap. Counts per
   task are added up by (language, phrase) strings; what stays below the least count goes. Where the map fills up, more
   phrases are counted that then go; the result is the same.
3. Score. Every part of a phrase that is frequent is frequent as well, so one equi-join on the part finds its count.

Nulls and edges: null texts are empty; null languages are `und` and one with a language of that name; pieces without words
have no phrases; phrases never cross pieces or documents; repeated documents count each time; texts of any length are taken
whole; other columns are ignored, whatever their names; an empty table gives an empty result. Hashes have 64 bits; two runs of
one piece of text that agree in all of them would be taken for one (about 1e-7 for a million runs).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.frames import release, ship_package, stored
from panelloom.llm.words import LOWER, mix, prefix_sums, range_hash, text_buffers, words

LONGEST = 3
#: Bytes of text of one language that a task handles at once, and of text whose runs one range of the sketch adds up.
PIECE_BYTES = 3 << 19
RANGE_BYTES = 4 << 20
#: Bits of a cell inside its range (some 1.3 million runs), and of the map of frequent cells: 32 MB.
CELL_BITS = 24
MAP_BITS = 28
_CUTS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_CUTS & ~np.isin(np.arange(256), [0x20, 0x09])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language at a time, of about `most` bytes together or one longer text."""
    held: dict[str, list[pa.Array]] = {}
    size: Counter = Counter()
    for b in batches:
        codes = b.column("lang").dictionary_encode()
        code = codes.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            texts = b.column("text").filter(pa.array(code == k))
            held.setdefault(lang, []).append(texts)
            size[lang] += texts.nbytes
            if size[lang] >= most:
                yield lang, pa.concat_arrays(held.pop(lang))
                del size[lang]
    for lang, texts in held.items():
        yield lang, pa.concat_arrays(texts)


class Runs:
    """Runs of up to LONGEST words inside the pieces of some texts: where they start and end, and their hashes."""

    def __init__(self, lang: str, texts: pa.Array) -> None:
        w = words(texts, _WORD, lower=True)
        cuts = np.append(0, np.cumsum(_CUTS[w.data], dtype=np.int32))
        new = np.ones(len(w.begin), dtype=bool)
        new[1:] = cuts[w.begin[1:]] != cuts[w.end[:-1]]
        first = w.first[:-1]
        new[first[first < len(new)]] = True
        self.w, self.new = w, new
        piece = np.cumsum(new, dtype=np.int32)
        salt = mix(words(pa.array([f"{lang}"], pa.large_string()), np.ones(256, bool)).hashes * _MULT) if lang else np.zeros(1, np.uint64)
        sums = prefix_sums(w.hashes)
        self.at, self.hashes = [], []
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(piece[: max(len(piece) - n + 1, 0)] == piece[n - 1 :])
            self.at.append(at)
            self.hashes.append(mix(range_hash(sums, at, at + n) ^ salt))

    def guarded(self) -> tuple[bytes, np.ndarray]:
        """The text to scan: a blank before and after each word, a line break between pieces; and where each word starts."""
        w, size = self.w, self.w.end - self.w.begin
        # a piece opens with a line break and a blank, each word ends with a blank
        step = size + 1 + 2 * self.new
        begin = np.cumsum(step) - size - 1
        out = np.full(int(step.sum()), 0x20, dtype=np.uint8)
        out[begin[self.new] - 2] = 0x0A
        at = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        out[at] = w.data[np.repeat(w.begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
        return out.tobytes(), begin


def _packed(cells: np.ndarray) -> bytes:
    """Numbers of CELL_BITS bits as three bytes each."""
    return np.ascontiguousarray(cells.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.uint32)
    return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16


def _sketched(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of CELL_BITS + bits bits, a row for each of 2**bits ranges: those that occur once, then those that occur more often, of
    which counts holds how often (255 at most: the least count is below)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches, PIECE_BYTES):
            cells, n = np.unique(np.concatenate(Runs(lang, texts).hashes) >> np.uint64(64 - CELL_BITS - bits), return_counts=True)
            if not len(cells):
                continue
            ends = np.searchsorted(cells, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(CELL_BITS))
            begins = np.append(0, ends[:-1])
            low, n = (cells & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
            out = []
            for p in np.flatnonzero(ends > begins).tolist():
                own, count = low[begins[p] : ends[p]], n[begins[p] : ends[p]]
                out.append((p, _packed(np.concatenate((own[count == 1], own[count > 1]))), count[count > 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["range", "cells", "counts"])

    return rows


def _frequent(bits: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """A range's part of the map: the bits of its cells whose counts add up to the least count."""

    def part(table: pa.Table) -> pa.Table:
        cells = [_unpacked(x.as_py()) for x in table["cells"]]
        more = [np.frombuffer(x.as_py(), np.uint8) for x in table["counts"]]
        counts = np.concatenate([x for c, m in zip(cells, more) for x in (np.ones(len(c) - len(m), np.uint8), m)])
        cells = np.concatenate(cells)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        edge = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        often = cells[edge][np.add.reduceat(counts[order], edge, dtype=np.int64) >= least]
        own = np.zeros(1 << (MAP_BITS - bits), dtype=bool)
        own[often >> np.uint32(CELL_BITS - (MAP_BITS - bits))] = True
        return pa.table({"range": table["range"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    return part


def _map_of_cells(docs: DataFrame, least: int) -> np.ndarray:
    """The map of cells that may hold a run of at least `least` occurrences, as bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((total // RANGE_BYTES).bit_length(), 4), 24)
    rows = docs.mapInArrow(_sketched(bits), "range int, cells binary, counts binary")
    parts = rows.groupBy("range").applyInArrow(_frequent(bits, least), "range int, bits binary")
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    size = len(out) >> bits
    for r in parts.toLocalIterator():
        out[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _counted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, k, phrase, f) of the runs of k words that may be frequent, for each piece of text; k = 0: all word occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(shared.value, np.uint8)
        for lang, texts in _by_lang(batches, PIECE_BYTES):
            runs = Runs(lang, texts)
            raw, begin = runs.guarded()
            text = raw.decode("latin-1")  # a character a byte: blanks and line breaks never lie inside another character
            end = begin + runs.w.end - runs.w.begin
            found: list[tuple[int, str, int]] = [(0, "", len(begin))]
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            names: list[tuple[int, str]] = []
            for n in range(1, LONGEST + 1):
                cell = runs.hashes[n - 1] >> np.uint64(64 - MAP_BITS)
                likely = np.flatnonzero(often[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
                _, one, count = np.unique(runs.hashes[n - 1][likely], return_index=True, return_counts=True)
                at = runs.at[n - 1][likely[one]]
                first, last = begin[at].tolist(), end[at + n - 1].tolist()
                if n == 1:
                    found += [(1, text[a:b], c) for a, b, c in zip(first, last, count.tolist())]
                    continue
                for a, b in zip(first, last):
                    automaton.add_word(text[a - 1 : b + 1], len(names))
                    names.append((n, text[a:b]))
            if names:
                automaton.make_automaton()
                found += [(*names[k], f) for k, f in Counter(map(itemgetter(1), automaton.iter(text))).items()]
            for at in range(0, len(found), 20_000):
                k, phrase, f = zip(*found[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int32()), pa.array([p.encode("latin-1") for p in phrase], pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "k", "phrase", "f"])

    return rows


def phrase_counts(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, k, phrase, f) of all runs of k = 1 to 3 words with f >= least, and each language's word occurrences as k = 0."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_map_of_cells(rows, min(least, 255)).tobytes())
    counts = rows.mapInArrow(_counted(shared), "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    out = stored(counts.filter(f"k = 0 OR f >= {int(least)}"), "phrases")
    shared.unpersist()
    return out


def collocations(docs: DataFrame, least: int = 10, cover_percent: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: (lang, rank, phrase, a, l, r, n, score), best first.

    a, l, r: occurrences of the phrase and of the two parts of its worst cut; n: words of the language; score: floor(10**6 a a /
    (l r)) of that cut. Phrases inside a longer one with at least cover_percent of their occurrences are left out."""
    counts = phrase_counts(docs, least)
    w = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    ask = lambda slot, p: F.struct(F.lit(slot).alias("slot"), p.alias("part"))
    asked = F.when(F.col("k") == 2, F.array(ask("l1", part(1, 1)), ask("r1", part(2, 1)))).otherwise(F.array(ask("l1", part(1, 1)), ask("r1", part(2, 2)), ask("l2", part(1, 2)), ask("r2", part(3, 1))))
    asks = counts.filter("k >= 2").select("lang", "phrase", F.col("f").alias("a"), F.inline(asked))
    known = counts.filter("k BETWEEN 1 AND 2").select("lang", F.col("phrase").alias("part"), "f")
    told = asks.join(known, ["lang", "part"]).select("lang", "phrase", "a", "slot", "f")
    inside = counts.filter("k = 3").select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit("longer").alias("slot"), "f")
    slots = ["l1", "r1", "l2", "r2", "longer"]
    each = told.unionByName(inside).groupBy("lang", "phrase").agg(F.max("a").alias("a"), *(F.max(F.when(F.col("slot") == s, F.col("f"))).alias(s) for s in slots))
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    rows = each.withColumns({f"_{c}": exact(c) for c in ("a", "l1", "r1", "l2", "r2")})
    rows = rows.withColumns({"s1": F.expr("(_a * _a * CAST(1000000 AS DECIMAL(7,0))) div (_l1 * _r1)"), "s2": F.expr("(_a * _a * CAST(1000000 AS DECIMAL(7,0))) div (_l2 * _r2)")})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    cut = lambda one, two: F.when(second, F.col(two)).otherwise(F.col(one))
    kept = rows.filter(F.coalesce(F.expr(f"100 * longer < {int(cover_percent)} * a"), F.lit(True)))
    scored = kept.select("lang", "phrase", "a", cut("l1", "l2").alias("l"), cut("r1", "r2").alias("r"), cut("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    sizes = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, cover_percent: int = 50, top: int = 2000) -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
),
runs AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)
),
sizes AS (SELECT lang, count(*) AS n FROM runs WHERE k = 1 GROUP BY lang),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {least}),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:], ' ') AS q FROM cands, (VALUES (1), (2)) AS cs(c) WHERE c < k),
scored AS (
  SELECT x.lang, x.phrase, x.a, x.c, l.f AS l, r.f AS r, CAST((1000000 * x.a::HUGEINT * x.a::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = x.p JOIN counts r ON r.lang = x.lang AND r.phrase = x.q
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cands WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cands WHERE k = 3) GROUP BY ALL
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM worst s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.a IS NULL OR 100 * g.a < {cover_percent} * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}"""
