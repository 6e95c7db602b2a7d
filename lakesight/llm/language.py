"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of a fixed number of bytes. In each, one recurrent layer reads
forwards and one backwards; from both states every position gets a label's probabilities,
and their mean over all positions of the text is the document's. The network is small and
trained here, in numpy, by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesight.llm.common import bounded_batches, documents, whole, without
from lakesight.session import materialize

HIDDEN = 8
SEGMENT = 96
#: Bound of the training sample: distinct texts of each language, segments of each text; texts of all languages, shared
#: evenly where there are many of them (each keeps one at least).
SAMPLE_TEXTS, SAMPLE_SEGMENTS, ALL_TEXTS = 300, 2, 76_800
STEPS, BATCH, RATE = 400, 64, 0.02
#: Segments that go through the network together.
LANES = 4096
UNKNOWN = "und"
OUTPUT = ["lang_pred", "score"]


class Layer:
    """A gated recurrent layer whose input weights are a table by byte.

    Columns of ``table`` and ``recurrent``: update gate, reset gate, candidate.
    """

    def __init__(self, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.recurrent = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def forward(self, steps: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each of ``steps`` (positions × lanes), and what the gradient needs."""
        h = np.zeros((steps.shape[1], HIDDEN), np.float32)
        states, kept = np.empty((*steps.shape, HIDDEN), np.float32), []
        for t, byte in enumerate(steps):
            x, a = self.table[byte], h @ self.recurrent
            gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])) + 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            kept.append((h, z, r, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def backward(self, steps: np.ndarray, kept: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and the recurrent weights from those of the states."""
        d_table, d_recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
        inputs = np.empty((*steps.shape, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(grads[0])
        for t in range(len(steps) - 1, -1, -1):
            before, z, r, n, inner = kept[t]
            dh = dh + grads[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            inputs[t, :, : 2 * HIDDEN], inputs[t, :, 2 * HIDDEN :] = da[:, : 2 * HIDDEN], dn
            d_recurrent += before.T @ da
            dh = dh * z + da @ self.recurrent.T
        order = np.argsort(steps, axis=None, kind="stable")
        seen, starts = np.unique(steps.ravel()[order], return_index=True)
        d_table[seen] = np.add.reduceat(inputs.reshape(-1, 3 * HIDDEN)[order], starts, axis=0)
        return d_table, d_recurrent


class Network:
    """Two layers and the labels' weights on their states."""

    def __init__(self, labels: list[str], seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.behind = Layer(rng), Layer(rng)
        self.weights = rng.normal(0, 0.3, (2 * HIDDEN, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def gradients(self, segments: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions of ``segments`` (lanes × positions)."""
        ahead = np.ascontiguousarray(segments.T)
        behind = np.ascontiguousarray(ahead[::-1])
        states_a, kept_a = self.ahead.forward(ahead)
        states_b, kept_b = self.behind.forward(behind)
        both = np.concatenate([states_a, states_b[::-1]], axis=2)
        d = _softmax(both @ self.weights + self.bias)
        d[:, np.arange(len(label)), label] -= 1
        d /= d.shape[0] * d.shape[1]
        d_both = d @ self.weights.T
        return [
            *self.ahead.backward(ahead, kept_a, d_both[:, :, :HIDDEN]),
            *self.behind.backward(behind, kept_b, d_both[::-1, :, HIDDEN:]),
            np.tensordot(both, d, axes=([0, 1], [0, 1])), d.sum((0, 1)),
        ]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.recurrent, self.behind.table, self.behind.recurrent, self.weights, self.bias]

    def train(self, segments: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = 4) -> Network:
        """Adam with a falling rate, on batches drawn evenly over the labels."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(label == k) for k in range(len(self.labels))]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            drawn = np.array([rng.choice(groups[k]) for k in rng.integers(0, len(groups), BATCH)])
            rate = RATE * (1 - (step - 1) / steps)
            for p, g, m, v in zip(self.parameters(), self.gradients(segments[drawn], label[drawn]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label_sums(self, segments: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per segment, the sum of its positions' label probabilities over its first ``sizes`` positions."""
        halved = [(_halved(layer.table), _halved(layer.recurrent)) for layer in (self.ahead, self.behind)]
        out = np.zeros((len(segments), len(self.labels)), np.float32)
        for start in range(0, len(segments), LANES):
            lanes = np.ascontiguousarray(segments[start : start + LANES].T)
            size = sizes[start : start + LANES]
            ahead = np.empty((*lanes.shape, HIDDEN), np.float32)
            h = np.zeros((lanes.shape[1], HIDDEN), np.float32)
            for t, byte in enumerate(lanes):
                h = _advance(h, byte, *halved[0])
                ahead[t] = h
            h = np.zeros_like(h)
            sums = out[start : start + LANES]
            for t in range(len(lanes) - 1, -1, -1):
                h = _advance(h, lanes[t], *halved[1])
                p = _softmax(ahead[t] @ self.weights[:HIDDEN] + h @ self.weights[HIDDEN:] + self.bias)
                sums += p * (size > t)[:, None]
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Per text, the mean of its positions' label probabilities; zeros for an empty one."""
        counts = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        padded = b"".join(t.ljust(int(c) * SEGMENT) for t, c in zip(texts, counts, strict=True))
        segments = np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT)
        lengths = np.array([len(t) for t in texts], np.int64)
        of = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        sums = self.label_sums(segments, np.minimum(lengths[of] - nth * SEGMENT, SEGMENT))
        total = np.zeros((len(texts), len(self.labels)))
        np.add.at(total, of, sums)
        return total / np.maximum(lengths, 1)[:, None]


def _halved(weights: np.ndarray) -> np.ndarray:
    """Gate columns at half weight, as the sigmoid is taken as a hyperbolic tangent of half its argument."""
    out = weights.copy()
    out[:, : 2 * HIDDEN] *= 0.5
    return out


def _advance(h: np.ndarray, byte: np.ndarray, table: np.ndarray, recurrent: np.ndarray) -> np.ndarray:
    x, a = table.take(byte, axis=0), h @ recurrent
    gates = x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    n = gates[:, HIDDEN:] * a[:, 2 * HIDDEN :]
    n += x[:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    return n + gates[:, :HIDDEN] * (h - n)


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def held_out() -> Column:
    """The documents whose language is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, bytes) segments for training: of each language ``SAMPLE_TEXTS`` distinct texts, cut at random places.

    The texts of the smallest hashes are taken, so that copies count once and every language
    is learned; the choice, like the places, depends on the texts alone.
    """
    text = whole("text")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & text.rlike(r"\p{L}")).select(
        "lang", text.alias("text"), F.xxhash64(text, F.lit(-1)).alias("_h"))
    hashes = materialize(known.select("lang", "_h").distinct(), "hashes")
    languages = hashes.select("lang").distinct().count()
    if not languages:
        return []
    each = max(1, min(SAMPLE_TEXTS, ALL_TEXTS // languages))
    least = Window.partitionBy("lang").orderBy("_h")
    chosen = materialize(hashes.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= each).select("lang", "_h"), "chosen")
    spots = [
        F.encode(F.substring("text", (1 + F.pmod(F.xxhash64("text", F.lit(i)), F.greatest(F.char_length("text") - SEGMENT, F.lit(0)) + 1)).cast("int"),
                             F.lit(SEGMENT)), "UTF-8")
        for i in range(SAMPLE_SEGMENTS)
    ]
    # At most ALL_TEXTS rows (or one for each language) meet the texts; the copies of a text fold to one before they travel.
    cut = known.join(F.broadcast(chosen), ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.min(F.array(*spots)).alias("spots"))
    rows = sorted((r["lang"], r["_h"], [bytes(s) for s in r["spots"]]) for r in cut.collect())
    return [(lang, s[:SEGMENT].ljust(SEGMENT)) for lang, _, spots in rows for s in spots]


def fit(docs: DataFrame) -> Network | None:
    """A network trained on a sample of the documents that are not held out; None without any label."""
    segments = sample(docs)
    labels = sorted({lang for lang, _ in segments})
    if not labels:
        return None
    data = np.frombuffer(b"".join(s for _, s in segments), np.uint8).reshape(-1, SEGMENT)
    return Network(labels).train(data, np.array([labels.index(lang) for lang, _ in segments]))


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """All rows of ``docs`` with ``lang_pred`` and ``score``, from the text alone.

    A null text or one without a letter is ``und`` with score 0, as is every text when there
    was nothing to learn from. Repeated rows are predicted alike; an empty table gives an
    empty table. Input columns named like an output are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, *OUTPUT, "_text")
    source = docs.withColumn("_text", F.when(whole("text").rlike(r"\p{L}"), F.col("text")))
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("_text").to_pylist()]
            if network is None:
                best, score = [None] * len(texts), np.zeros(len(texts))
            else:
                p = network.probabilities(texts)
                best, score = [network.labels[i] for i in p.argmax(axis=1)], np.minimum(p.max(axis=1), 1.0)
            lang = [b if t and b is not None else UNKNOWN for t, b in zip(texts, best, strict=True)]
            score = np.where([x != UNKNOWN for x in lang], score, 0.0)
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*kept.schema.names, *OUTPUT])

    return source.mapInArrow(run, schema)


def op4_language(spark, folder: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = documents(spark, folder)
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), *OUTPUT)
