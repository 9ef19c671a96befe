"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read windows of a text's UTF-8 bytes, one from either end; every
position gets label probabilities from both states, and a document's are the mean over all
its bytes. The network is trained here, in numpy, by backpropagation through time, on a
bounded sample of labelled texts: at most `slots` snippets of `snippet` bytes for each label,
chosen by a hash of the text, so that copies count once. Whole texts are predicted.

Learned from text and label only; doc_id decides nothing but who is held out. At most `labels`
labels are learned, those of most documents (of equals, the first in order); so dirty labels bound
neither the network nor its sample. A very long text is read window by window. Defined
results: `und` with score 0 for a null text, one without a letter, or where there was nothing
to learn from; a null doc_id is neither held out nor learned from; repeated rows are each
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import in_arrow, pick, slices, texts_as_bytes, written

UNKNOWN = "und"


@dataclass(frozen=True)
class GruRules:
    """window: bytes that the network reads at once. slots, snippet: the bound of the training sample, by label.
    span: windows that are predicted together. labels: learned at most."""

    hidden: int = 6
    window: int = 64
    slots: int = 96
    snippet: int = 320
    steps: int = 240
    batch: int = 128
    rate: float = 0.02
    span: int = 3072
    labels: int = 512
    seed: int = 7


@dataclass(frozen=True)
class Network:
    """By direction: inputs (256 x 3H, a row for each byte), states (H x 3H) and their offsets; then output weights and offsets."""

    labels: tuple[str, ...]
    weights: tuple[np.ndarray, ...]


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, between -1 and 1: a third of the cost of tanh where that has no vector instructions."""
    return x / (1 + np.abs(x))


def _run(x: np.ndarray, inputs: np.ndarray, states: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T x B x H) over byte windows (T x B), and what backpropagation needs."""
    size, h = states.shape[0], np.zeros((x.shape[1], states.shape[0]), np.float32)
    out, tape = np.empty((*x.shape, size), np.float32), []
    for t in range(len(x)):
        a, g = inputs[x[t]], h @ states + offsets
        raw = a[:, : 2 * size] + g[:, : 2 * size]
        gates = 0.5 * _squash(raw) + 0.5
        r, z = gates[:, :size], gates[:, size:]
        raw_n = a[:, 2 * size :] + r * g[:, 2 * size :]
        n = _squash(raw_n)
        tape.append((h, r, z, n, g[:, 2 * size :], 0.5 / np.square(1 + np.abs(raw)), 1 / np.square(1 + np.abs(raw_n))))
        h = n + z * (h - n)
        out[t] = h
    return out, tape


def _back(x: np.ndarray, grad: np.ndarray, tape: list, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, states and offsets for the states' gradients, back through time."""
    size = states.shape[0]
    d_inputs, d_states, d_offsets = np.zeros((256, 3 * size), np.float32), np.zeros_like(states), np.zeros(3 * size, np.float32)
    carry = np.zeros((x.shape[1], size), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, r, z, n, g, slope, slope_n = tape[t]
        d = grad[t] + carry
        dn = d * (1 - z) * slope_n
        dz = d * (h - n) * slope[:, size:]
        dr = dn * g * slope[:, :size]
        da = np.concatenate([dr, dz, dn], 1)
        dg = np.concatenate([dr, dz, dn * r], 1)
        np.add.at(d_inputs, x[t], da)
        d_states += h.T @ dg
        d_offsets += dg.sum(0)
        carry = d * z + dg @ states.T
    return d_inputs, d_states, d_offsets


def train(samples: Sequence[tuple[str, bytes]], rules: GruRules = GruRules()) -> Network:
    """A network for (label, bytes) samples. The same samples give the same network."""
    samples = sorted(samples)
    labels = tuple(sorted({s[0] for s in samples}))
    rng, size, width = np.random.default_rng(rules.seed), rules.hidden, rules.window
    by_label = [[np.frombuffer(b, np.uint8) for l, b in samples if l == label and b] for label in labels]
    spread = 1 / np.sqrt(size)
    w = []
    for _ in range(2):
        w += [rng.normal(0, 0.3, (256, 3 * size)), rng.normal(0, spread, (size, 3 * size)), np.zeros(3 * size)]
    w += [rng.normal(0, spread, (2 * size, len(labels))), np.zeros(len(labels))]
    w = [x.astype(np.float32) for x in w]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, rules.steps + 1):
        x, y, mask = np.zeros((width, rules.batch), np.uint8), rng.integers(0, len(labels), rules.batch), np.zeros((width, rules.batch), np.float32)
        for i, label in enumerate(y):
            b = by_label[label][rng.integers(len(by_label[label]))]
            at = rng.integers(max(1, len(b) - width + 1))
            keep = width if rng.random() < 0.8 else rng.integers(4, width)  # short texts are learned too
            b = b[at : at + keep]
            x[: len(b), i], mask[: len(b), i] = b, 1
        ahead, tape_a = _run(x, *w[0:3])
        behind, tape_b = _run(x[::-1], *w[3:6])
        both = np.concatenate([ahead, behind[::-1]], 2)
        scores = both @ w[6] + w[7]
        p = np.exp(scores - scores.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        d = p
        d[:, np.arange(rules.batch), y] -= 1
        d *= (mask / mask.sum())[:, :, None]
        d_both = d @ w[6].T
        grads = [*_back(x, d_both[:, :, :size], tape_a, w[1]), *_back(x[::-1], d_both[::-1, :, size:], tape_b, w[4])]
        grads += [both.reshape(-1, 2 * size).T @ d.reshape(-1, len(labels)), d.sum((0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = rules.rate * min(1.0, 2.0 * (1 - step / (rules.steps + 1)))
        for i, g in enumerate(grads):
            g = g / max(1.0, norm)
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            w[i] -= (rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(labels, tuple(w))


class Reader:
    """Predicts texts with a network. Arrays are features x windows here, so that each step runs over whole rows."""

    def __init__(self, network: Network, rules: GruRules):
        self.labels, self.rules, self.directions = network.labels, rules, []
        size = rules.hidden
        for k in (0, 3):
            inputs, states, offsets = network.weights[k : k + 3]
            outer = offsets.copy()
            outer[2 * size :] = 0  # the candidate's offset is inside the reset product
            self.directions.append((np.ascontiguousarray((inputs + outer).T), np.ascontiguousarray(states.T), offsets[2 * size :, None].copy()))
        self.out, self.offset = np.ascontiguousarray(network.weights[6].T), network.weights[7][:, None]

    def states(self, x: np.ndarray, inputs: np.ndarray, states: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """T x H x B."""
        size, (steps, wide) = self.rules.hidden, x.shape
        h, out = np.zeros((size, wide), np.float32), np.empty((steps, size, wide), np.float32)
        a, g, low = (np.empty((3 * size, wide), np.float32) for _ in range(3))
        gates, n, r, z = a[: 2 * size], g[2 * size :], a[:size], a[size : 2 * size]
        for t in range(steps):
            np.take(inputs, x[t], axis=1, out=a, mode="clip")
            np.matmul(states, h, out=g)
            gates += g[: 2 * size]
            np.abs(gates, out=low[: 2 * size])
            low[: 2 * size] += 1
            gates /= low[: 2 * size]
            gates *= 0.5
            gates += 0.5
            n += inner
            n *= r
            n += a[2 * size :]
            np.abs(n, out=low[2 * size :])
            low[2 * size :] += 1
            n /= low[2 * size :]
            h -= n
            h *= z
            h += n
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities of every position (T x labels x B) of byte windows (T x B)."""
        size, x = self.rules.hidden, x.astype(np.intp)
        scores = np.matmul(self.out[:, :size], self.states(x, *self.directions[0]))
        scores += np.matmul(self.out[:, size:], self.states(x[::-1], *self.directions[1])[::-1])
        scores += self.offset
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def predict(self, texts: Sequence[bytes]) -> np.ndarray:
        """Mean label probabilities (texts x labels) over all bytes of each text; every text must have one."""
        width, labels = self.rules.window, len(self.labels)
        total = np.zeros((len(texts), labels))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = -(-lengths // width)
        padded = np.zeros(int(counts.sum()) * width, np.uint8)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) * width
        for b, s in zip(texts, starts, strict=True):
            padded[s : s + len(b)] = np.frombuffer(b, np.uint8)
        windows, owner = padded.reshape(-1, width), np.repeat(np.arange(len(texts)), counts)
        filled = np.full(len(owner), width)
        filled[np.cumsum(counts) - 1] = lengths - (counts - 1) * width
        for i in range(0, len(windows), self.rules.span):
            part = slice(i, i + self.rules.span)
            p = self.probabilities(np.ascontiguousarray(windows[part].T))
            p *= (np.arange(width)[:, None] < filled[part])[:, None, :]
            np.add.at(total, owner[part], p.sum(0).T)
        return total / lengths[:, None]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, rules: GruRules = GruRules()) -> list[tuple[str, bytes]]:
    """At most rules.slots snippets for each label, from documents that are not held out."""
    rows = pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("text")
    at = F.pmod(F.shiftright(h, 16), F.greatest(F.lit(1), F.length("text") - rules.snippet)) + 1
    rows = rows.select("lang", F.pmod(h, F.lit(rules.slots)).alias("slot"), h.alias("h"), F.substr("text", at.cast("int"), F.lit(rules.snippet)).alias("snippet"))
    best = rows.groupBy("lang", "slot").agg(F.min(F.struct("h", "snippet")).alias("m"), F.count("*").alias("n"))
    best = written(best, "language-sample")
    common = best.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(rules.labels)
    best = best.join(common.select("lang"), "lang").orderBy("lang", "slot").select("lang", "m.snippet").collect()
    return [(r["lang"], r["snippet"].encode()) for r in best]


def identify(docs: DataFrame, rules: GruRules = GruRules()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the predicted label's probability)."""
    samples = training_sample(docs, rules)
    network = train(samples, rules) if samples else None
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network, rules) if network else None
        for b in slices(batches):
            texts = texts_as_bytes(b)
            at = [i for i, t in enumerate(texts) if t] if reader else []
            label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if at:
                p = reader.predict([texts[i] for i in at])
                for i, k, s in zip(at, p.argmax(1), p.max(1), strict=True):
                    label[i], score[i] = reader.labels[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return in_arrow(rows, judge, schema)
