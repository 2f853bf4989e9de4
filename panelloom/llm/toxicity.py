"""Toxic spans by a linear-chain conditional random field; forward-backward marginals give document scores and offsets.

Tokens are runs of ASCII letters, digits and non-ASCII characters, lower-cased (A-Z). Features of a token are its word and
its first three, four and five bytes, hashed into BUCKETS weights; the chain has two states (0 clean, 1 toxic) and four
transition weights. The field is trained on the driver by gradient ascent of the conditional likelihood on labelled tokens:
in documents labelled toxic, tokens with a feature that such documents use in far more contexts than clean ones (different
words before it, in the sample) count as toxic, all others as clean. The sample holds at most `sample` labelled documents, by hash of the id,
toxic and clean ones in equal parts where there are enough; of a longer text the field learns from `sample_chars` characters, from
a place that the id's hash picks.

Marginals are exact for texts of any length: blocks of BLOCK tokens get their transfer matrices, blocks are chained per
document, and a second pass fills in the states. A document's score is a logistic function, fitted on the sample, of its
largest marginal and of the sum of marginals from 0.2 on; an empty text gets the score of no evidence.

Nulls and edges: a null text is an empty one; null labels or ids are never learned from; without a toxic or a clean label
the scores are 0 or 1 for all; an id labelled both ways is never learned from, and of an id's several texts the least; texts
of any length are scored whole; repeated rows score alike; an empty table gives an empty result. Other columns stay as they
are, but for those that are named like an output, which takes their place.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm import frames
from panelloom.llm.frames import ship_package
from panelloom.llm.words import _BYTE_VALUES, ALNUM, Words, chunks, mix, prefix_sums, range_hash, words

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5)
BLOCK = 64
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float32())]))


def tokens(column: pa.Array) -> Words:
    return words(column, ALNUM, lower=True)


def features(w: Words) -> np.ndarray:
    """Bucket numbers (feature, token)."""
    sums = prefix_sums(_BYTE_VALUES[w.data])
    rows = [w.hashes]
    for n in PREFIXES:
        rows.append(mix(range_hash(sums, w.begin, np.minimum(w.begin + n, w.end)) + np.uint64(n)))
    return np.stack([(r % np.uint64(BUCKETS)).astype(np.int64) for r in rows])


class ChainCRF:
    """Weights of features for state 1 and of transitions; state 0 is the base."""

    def __init__(self) -> None:
        self.weight = np.zeros(BUCKETS, np.float32)
        self.move = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.doc = np.array([-3.0, 0.0, 0.0])  # bias, largest marginal, log of summed marginals

    def marginals(self, unary: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(state 1) of each token; with pairs also the sums of the transitions' marginals."""
        n = len(unary)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        sizes = np.diff(first)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        order = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # number of the block in its document
        begin = first[doc] + order * BLOCK
        grid = begin[:, None] + np.arange(BLOCK)
        real = grid < first[doc + 1][:, None]
        grid = np.minimum(grid, n - 1)
        emit = np.exp(np.clip(np.where(real, unary[grid], 0.0), -30, 30))
        m = np.exp(self.move)
        s = np.exp(self.start)

        def step(state, t, back=False):
            """One token on: state (block, 2) -> (block, 2); filled-up places change nothing."""
            if back:  # from beta after t to beta before t
                e0, e1 = state[:, 0], emit[:, t] * state[:, 1]
                new = np.stack((m[0, 0] * e0 + m[0, 1] * e1, m[1, 0] * e0 + m[1, 1] * e1), axis=1)
            else:
                new0 = m[0, 0] * state[:, 0] + m[1, 0] * state[:, 1]
                new1 = (m[0, 1] * state[:, 0] + m[1, 1] * state[:, 1]) * emit[:, t]
                new = np.stack((new0, new1), axis=1)
            return np.where(real[:, t, None], new, state)

        def chain(back: bool) -> np.ndarray:
            """State at each block's near edge: before its first token, or after its last one."""
            basis = [np.tile(np.array(b), (len(doc), 1)) for b in ([1.0, 0.0], [0.0, 1.0])]
            for t in range(BLOCK - 1, -1, -1) if back else range(BLOCK):
                basis = [step(b, t, back) for b in basis]
                if t % 4 == 0 or t == BLOCK - 1:
                    scale = basis[0].sum(axis=1) + basis[1].sum(axis=1)
                    basis = [b / scale[:, None] for b in basis]
            edge = np.ones((len(doc), 2)) * 0.5
            at = np.flatnonzero(order == (blocks[doc] - 1 if back else 0))
            state = np.full((len(at), 2), 0.5)
            if not back:
                # before the first token: such that one move gives the start weights
                state = np.tile(np.linalg.solve(m.T, s) if abs(np.linalg.det(m)) > 1e-9 else np.array([0.5, 0.5]), (len(at), 1))
            while len(at):
                edge[at] = state
                state = basis[0][at] * state[:, :1] + basis[1][at] * state[:, 1:]
                state = state / np.abs(state).sum(axis=1, keepdims=True)
                nxt = at + (-1 if back else 1)
                ok = (nxt >= 0) & (nxt < len(doc))
                ok[ok] &= doc[nxt[ok]] == doc[at[ok]]
                at, state = nxt[ok], state[ok]
            return edge

        alpha = np.empty((len(doc), BLOCK, 2))
        state = chain(False)
        for t in range(BLOCK):
            state = step(state, t)
            state = state / np.abs(state).sum(axis=1, keepdims=True)
            alpha[:, t] = state
        beta = np.empty((len(doc), BLOCK, 2))
        state = chain(True)
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = state
            state = step(state, t, back=True)
            state = state / state.sum(axis=1, keepdims=True)
        both = np.maximum(alpha * beta, 0)
        p = np.empty(n)
        p[grid[real]] = (both[..., 1] / np.maximum(both.sum(axis=2), 1e-300))[real]
        if not pairs:
            return p
        a = np.empty((n, 2))
        b = np.empty((n, 2))
        a[grid[real]], b[grid[real]] = alpha[real], beta[real]
        e = np.exp(np.clip(unary, -30, 30))
        inner = np.ones(n, bool)
        inner[first[:-1][sizes > 0]] = False
        at = np.flatnonzero(inner)
        joint = a[at - 1][:, :, None] * m * (b[at] * np.stack((np.ones(len(at)), e[at]), axis=1))[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        heads = p[first[:-1][sizes > 0]]
        return p, joint.sum(axis=0), np.array([(1 - heads).sum(), heads.sum()])

    def unary(self, feats: np.ndarray) -> np.ndarray:
        return self.weight[feats].sum(axis=0, dtype=np.float64)

    def fit(self, texts: list[str], toxic: np.ndarray, rounds: int = 16) -> None:
        w = tokens(pa.array(texts, pa.large_string()))
        feats = features(w)
        gold = token_labels(w, feats, toxic)
        n = max(1, len(gold))
        inner = np.ones(len(gold), bool)
        heads = w.first[:-1][np.diff(w.first) > 0]
        inner[heads] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(gold[at - 1] * 2 + gold[at], minlength=4).reshape(2, 2).astype(float)
        open_ = np.array([(gold[heads] == 0).sum(), (gold[heads] == 1).sum()], float)
        squares = np.full(BUCKETS, 1e-8)
        sq_move, sq_open = np.full((2, 2), 1e-8), np.full(2, 1e-8)
        for _ in range(rounds):
            p, moves, opens = self.marginals(self.unary(feats), w.first, pairs=True)
            miss = gold - p
            grad = np.zeros(BUCKETS)
            for row in feats:
                grad += np.bincount(row, miss, BUCKETS)
            grad = grad / n - 1e-7 * self.weight
            squares += grad**2
            self.weight += (grad / np.sqrt(squares)).astype(np.float32)
            for value, g, sq in ((self.move, (seen - moves) / n, sq_move), (self.start, (open_ - opens) / n, sq_open)):
                sq += g**2
                value += 0.5 * g / np.sqrt(sq)
        self.weight[np.abs(self.weight) < 1e-6] = 0
        self._calibrate(self.evidence(self.marginals(self.unary(feats), w.first), w.first), toxic)

    @staticmethod
    def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each document: 1, largest marginal, log(1 + summed marginals of the likelier tokens)."""
        sums = np.concatenate(([0.0], np.cumsum(np.where(p >= 0.2, p, 0))))
        total = np.maximum(sums[first[1:]] - sums[first[:-1]], 0)
        top = np.zeros(len(first) - 1)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            top[some] = np.maximum.reduceat(p, first[:-1][some])
        return np.stack((np.ones(len(top)), top, np.log1p(total)), axis=1)

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by damped Newton steps."""

        def loss(c):
            m = x @ c
            return np.logaddexp(0, m).sum() - y @ m + 0.05 * c @ c

        c = np.zeros(3)
        for _ in range(50):
            q = 1 / (1 + np.exp(-x @ c))
            move = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - q) - 0.1 * c)
            size = 1.0
            while loss(c + size * move) > loss(c) and size > 1e-6:
                size /= 2
            c = c + size * move
        self.doc = c

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(p, first) @ self.doc, -30, 30)))


def token_labels(w: Words, feats: np.ndarray, toxic: np.ndarray, ratio: float = 20.0) -> np.ndarray:
    """1 for tokens of toxic documents with a telling feature.

    A feature tells if it follows at least 0.5 % as many different words in toxic documents as there are such documents (and
    four), `ratio` times the clean documents' share. Counting neighbours, not documents, keeps copied passages from telling.
    """
    row = w.row_of
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    before = np.concatenate(([0], (w.hashes[:-1] >> np.uint64(24)).astype(np.int64))) if len(row) else np.zeros(0, np.int64)
    gold = np.zeros(len(row), bool)
    for feat in feats:
        counts = []
        for y in (1, 0):
            mine = toxic[row] == y
            pairs = np.unique(np.stack((feat[mine], before[mine])), axis=1)
            counts.append(np.bincount(pairs[0], minlength=BUCKETS))
        telling = (counts[0] >= max(4, 0.005 * n1)) & ((counts[0] + 0.5) / n1 >= ratio * (counts[1] + 0.5) / n0)
        gold |= telling[feat]
    return (gold & (toxic[row] == 1)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000, sample_chars: int = 20000) -> ChainCRF | float:
    """A trained field; where one of the two labels is missing, the constant score instead."""
    labels = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_y"), F.max(F.col(label_col).cast("int")).alias("_most"))
    labels = labels.filter("_y = _most").select("_id", "_y")
    picked = [labels.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most `sample` rows
    text, room = F.col(text_col), F.greatest(F.char_length(text_col) - sample_chars + 1, F.lit(1)).cast("long")
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.substring(text, F.pmod(F.xxhash64(F.col(id_col)), room).cast("int") + 1, F.lit(sample_chars)).alias("t"))
    got = rows.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: (r["_id"], r["_y"], r["t"]))
    toxic = np.array([int(r["_y"] > 0) for r in got])
    if len(set(toxic.tolist())) < 2:
        return float(toxic[0]) if len(toxic) else 0.0
    crf = ChainCRF()
    crf.fit([r["t"] for r in got], toxic)
    return crf


def _tag(shared, column: str, at_least: float, kept: list[str]):
    def run(batches):
        crf = shared.value
        for piece in chunks(batches, column):
            w = tokens(piece.column(column))
            rows = piece.num_rows
            spans: list[list] = [[] for _ in range(rows)]
            if isinstance(crf, float):
                score = np.full(rows, crf)
            else:
                p = crf.marginals(crf.unary(features(w)), w.first)
                score = crf.score(p, w.first)
                row_of = w.row_of
                base = np.cumsum([0, *[len((x or "").encode()) for x in piece.column(column).to_pylist()]])
                before = -2
                for i in np.flatnonzero(p >= at_least).tolist():
                    r = int(row_of[i])
                    if before == i - 1 and row_of[i - 1] == r:
                        spans[r][-1]["end"] = int(w.end[i] - base[r])
                        spans[r][-1]["p"] = max(spans[r][-1]["p"], float(p[i]))
                    else:
                        spans[r].append({"begin": int(w.begin[i] - base[r]), "end": int(w.end[i] - base[r]), "p": float(p[i])})
                    before = i
            yield frames.batch(piece, kept, score=pa.array(score, pa.float64()), toxic_spans=pa.array(spans, _SPANS))

    return run


def tag(df: DataFrame, model: ChainCRF | float, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """df with score and toxic_spans (first byte, byte after the last, largest marginal) of each whole text."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    return frames.with_columns(df, partial(_tag, shared, text_col, at_least), "score double, toxic_spans array<struct<begin:int,end:int,p:float>>")
