"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's UTF-8 bytes in stretches of at most STRETCH bytes; all stretches of a text are read, so every
byte gets a label distribution from a forward and a backward gated recurrent layer. A document's probabilities are the mean
of the distributions at its letters' bytes; the likeliest language is predicted, and its probability is the score.

Training is backpropagation through time with Adam, on the driver, from a bounded sample: about `sample` labelled rows by hash of
the id, as many of each language as there are (of at most MOST_LANGUAGES), `pieces` pieces of each row. Gates use x / (1 + |x|), scaled to 0..1 where a gate needs that, in place of the
exponential forms: the same network with cheaper curves.

Nulls and edges: a null text, or one without any letter, is `und` with score 0; no labelled row at all gives `und` for
every row; null labels are never learned from, and of an id's several rows the first in order; of equal probabilities the
first language in order is predicted; texts of any length are read whole; repeated rows get equal predictions; an empty table
gives an empty result. Other columns stay as they are, but for those that are named like an output, which takes their place.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm import frames
from panelloom.llm.frames import ship_package
from panelloom.llm.words import chunks, text_buffers

#: Bytes that the recurrent layers run over at once.
STRETCH = 128
HIDDEN = 16
_BLOCK = 2048
UNKNOWN = "und"
MOST_LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")
_IN_LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


class ByteGRU:
    """Two gated recurrent layers over bytes (0 forward, 1 backward) and a softmax at each position."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        k = len(classes)
        self.p = {
            "W": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "U": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32),
            "V": rng.normal(0, 0.3, (2, hidden, k)).astype(np.float32),
            "c": np.zeros(k, np.float32),
        }

    def _forward(self, seq: np.ndarray):
        """seq: bytes (time, batch). All states and what the backward pass needs."""
        steps, batch = seq.shape
        h, w, u = self.hidden, self.p["W"], self.p["U"]
        both = (seq, seq[::-1])
        state = np.zeros((2, batch, h), np.float32)
        states, trace = [state], []
        for t in range(steps):
            x = np.stack((w[0][both[0][t]], w[1][both[1][t]]))
            g = state @ u
            a = x[..., : 2 * h] + g[..., : 2 * h]
            gates = 0.5 + 0.5 * a / (1 + np.abs(a))
            r, z = gates[..., :h], gates[..., h:]
            gn = g[..., 2 * h :]
            b = x[..., 2 * h :] + r * gn
            n = b / (1 + np.abs(b))
            state = n + z * (state - n)
            states.append(state)
            trace.append((a, r, z, gn, b, n))
        return states, trace

    def _logits(self, states) -> np.ndarray:
        v = self.p["V"]
        f = np.stack([s[0] for s in states[1:]]) @ v[0]
        b = np.stack([s[1] for s in states[1:]])[::-1] @ v[1]
        return f + b + self.p["c"]

    def gradients(self, seq: np.ndarray, target: np.ndarray, mask: np.ndarray):
        """Mean cross-entropy at the masked positions and its gradients. target: class of each sequence."""
        steps, batch = seq.shape
        h = self.hidden
        states, trace = self._forward(seq)
        y = self._logits(states)
        y -= y.max(axis=2, keepdims=True)
        prob = np.exp(y)
        prob /= prob.sum(axis=2, keepdims=True)
        total = max(1, mask.sum())
        loss = -(np.log(prob[:, np.arange(batch), target] + 1e-9) * mask).sum() / total
        d = prob
        d[:, np.arange(batch), target] -= 1
        d *= (mask / total)[..., None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["c"] = d.sum(axis=(0, 1))
        at_step = (d, d[::-1])
        for k in (0, 1):
            grad["V"][k] = np.einsum("tbh,tbk->hk", np.stack([s[k] for s in states[1:]]), at_step[k])
        dx = np.empty((2, steps, batch, 3 * h), np.float32)
        dh = np.zeros((2, batch, h), np.float32)
        ut = self.p["U"].transpose(0, 2, 1)
        vt = self.p["V"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            a, r, z, gn, b, n = trace[t]
            prev = states[t]
            dh = dh + np.stack((at_step[0][t], at_step[1][t])) @ vt
            db = dh * (1 - z) / (1 + np.abs(b)) ** 2
            da = np.concatenate((db * gn, dh * (prev - n)), axis=2) * 0.5 / (1 + np.abs(a)) ** 2
            dg = np.concatenate((da, db * r), axis=2)
            dx[:, t] = np.concatenate((da, db), axis=2)
            grad["U"] += prev.transpose(0, 2, 1) @ dg
            dh = dh * z + dg @ ut
        for k, flat in ((0, seq.ravel()), (1, seq[::-1].ravel())):
            order = np.argsort(flat, kind="stable")
            values, first = np.unique(flat[order], return_index=True)
            grad["W"][k][values] = np.add.reduceat(dx[k].reshape(-1, 3 * h)[order], first)
        return loss, grad

    def fit(self, texts: list[bytes], labels: list[int], rounds: int = 160, batch: int = 128, steps: int = 64, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over random stretches of the labelled pieces, classes drawn evenly."""
        rng = np.random.default_rng(seed)
        by_class = [[i for i, y in enumerate(labels) if y == c and len(texts[i]) > 1] for c in range(len(self.classes))]
        present = [c for c, m in enumerate(by_class) if m]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for r in range(1, rounds + 1 if present else 1):
            target = rng.choice(present, batch)
            seq = np.full((steps, batch), 0x20, np.uint8)
            for j, c in enumerate(target.tolist()):
                raw = texts[by_class[c][rng.integers(len(by_class[c]))]]
                at = int(rng.integers(max(1, len(raw) - steps + 1)))
                part = raw[at : at + steps]
                seq[: len(part), j] = np.frombuffer(part, np.uint8)
            loss, grad = self.gradients(seq, target, _IN_LETTERS[seq])
            step = rate * min(1.0, 2 * (1 - (r - 1) / rounds))
            for k, g in grad.items():
                np.clip(g, -1, 1, out=g)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (step * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-6)).astype(np.float32)
        return float(loss)

    def label(self, seq: np.ndarray) -> np.ndarray:
        """Distributions (time, batch, class) of byte stretches (time, batch)."""
        steps, batch = seq.shape
        h, k = self.hidden, len(self.classes)
        out = np.empty((steps, k, batch), np.float32)
        out[:] = self.p["c"][:, None]
        x, g, d = (np.empty((3 * h, batch), np.float32) for _ in range(3))
        y = np.empty((k, batch), np.float32)
        a, n, da, dn, gn = x[: 2 * h], g[2 * h :], d[: 2 * h], d[2 * h :], x[2 * h :]
        r, z = x[:h], x[h : 2 * h]
        for way in (0, 1):
            w, u, v = (np.ascontiguousarray(self.p[name][way].T) for name in ("W", "U", "V"))
            state = np.zeros((h, batch), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(w, seq[t], axis=1, out=x, mode="clip")
                np.matmul(u, state, out=g)
                a += g[: 2 * h]
                np.abs(a, out=da)
                da += 1
                a /= da
                a *= 0.5
                a += 0.5
                n *= r
                n += gn
                np.abs(n, out=dn)
                dn += 1
                n /= dn
                state -= n
                state *= z
                state += n
                np.matmul(v, state, out=y)
                out[t] += y
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out.transpose(0, 2, 1)


def stretches(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all rows as (stretch, byte), filled up with blanks, and each stretch's first byte."""
    counts = -(-np.diff(off) // size)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    grid = begin[:, None] + np.arange(size)
    inside = grid < off[row + 1][:, None]
    seq = np.where(inside, data[np.minimum(grid, max(0, len(data) - 1))], 0x20).astype(np.uint8)
    return seq, begin


def _predict(shared, column: str, labels: bool, kept: list[str]):
    def run(batches):
        net: ByteGRU | None = shared.value
        for piece in chunks(batches, column):
            data, off = text_buffers(piece.column(column))
            rows = piece.num_rows
            k = len(net.classes) if net else 1
            sums, weight = np.zeros((rows, k)), np.zeros(rows)
            marks = np.zeros(len(data), np.uint8)
            if net and len(data):
                seq, begin = stretches(data, off, STRETCH)
                row = np.searchsorted(off, begin, side="right") - 1
                ends = off[row + 1]
                for at in range(0, len(seq), _BLOCK):
                    part = seq[at : at + _BLOCK]
                    dist = net.label(np.ascontiguousarray(part.T))
                    mask = _IN_LETTERS[part]
                    np.add.at(sums, row[at : at + _BLOCK], np.einsum("tbk,bt->bk", dist, mask.astype(np.float32)))
                    np.add.at(weight, row[at : at + _BLOCK], mask.sum(axis=1))
                    if labels:
                        best = dist.argmax(axis=2).T.astype(np.uint8)
                        grid = begin[at : at + _BLOCK, None] + np.arange(STRETCH)
                        inside = grid < ends[at : at + _BLOCK, None]
                        marks[grid[inside]] = best[inside]
            prob = sums / np.maximum(weight, 1)[:, None]
            best = prob.argmax(axis=1)
            lang, score = [], []
            for r, text in enumerate(piece.column(column).to_pylist()):
                known = net is not None and text is not None and _LETTER.search(text) is not None and weight[r] > 0
                lang.append(net.classes[best[r]] if known else UNKNOWN)
                score.append(float(min(1.0, prob[r, best[r]])) if known else 0.0)
            out = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            if labels:
                raw = marks.tobytes()
                out["byte_labels"] = pa.array([raw[off[r] : off[r + 1]] for r in range(rows)], pa.binary())
            yield frames.batch(piece, kept, **out)

    return run


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000, pieces: int = 2, piece_chars: int = 400, **fit) -> ByteGRU | None:
    """A network from `sample` rows by hash of the id, `pieces` pieces of `piece_chars` characters of each; None without labels."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # a bound on the hash for each language, so that about as many rows of each lie below it; a row for each language
    sizes = rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(MOST_LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(float(sample)) / (F.count("*").over(Window.partitionBy()) * F.col("_n")))
    bounds = sizes.select("_lang", share.alias("_share"))
    room = F.greatest(F.char_length(F.col(text_col)) - piece_chars, F.lit(1))
    cuts = [F.substring(F.col(text_col), F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), room.cast("long")).cast("int") + 1, F.lit(piece_chars)).alias(f"p{k}") for k in range(pieces)]
    got = (
        rows.withColumn("_h", F.xxhash64(F.col(id_col)))
        .join(F.broadcast(bounds), F.col(lang_col) == F.col("_lang"))
        .filter(F.pmod(F.col("_h"), F.lit(1 << 40)) < F.col("_share") * (1 << 40))
        .groupBy("_h")
        .agg(F.min(F.struct(F.col(lang_col).alias("lang"), *cuts)).alias("r"))
        .select("r.*", "_h")
        .collect()
    )
    got.sort(key=lambda r: (r["_h"], r["lang"], r["p0"]))
    classes = sorted({r["lang"] for r in got})
    if not classes:
        return None
    texts = [r[f"p{k}"].encode() for r in got for k in range(pieces)]
    labels = [classes.index(r["lang"]) for r in got for _ in range(pieces)]
    net = ByteGRU(classes)
    net.fit(texts, labels, **fit)
    return net


def identify(df: DataFrame, net: ByteGRU | None, text_col: str = "text", labels: bool = False) -> DataFrame:
    """df with lang_pred and score, and with byte_labels (class number of each byte) if asked for."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)
    return frames.with_columns(df, partial(_predict, shared, text_col, labels), "lang_pred string, score double" + ", byte_labels binary" * labels)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts
