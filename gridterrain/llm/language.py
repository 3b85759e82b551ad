"""Operator 2: language identification by a bidirectional gated recurrent network over bytes.

Two networks of gated recurrent units read a segment of bytes forwards and backwards; a softmax layer over both
states labels every position. A document's probabilities are the means over all positions of its
whole text, cut into segments of ``STEPS`` bytes that are run side by side, so a text of any length is read in
full. Gates and candidates are squashed by ``x / (1 + |x|)``. Places behind a text's end keep the state at zero, in training and after, so a segment's
result does not depend on what it is run with. The network is trained in numpy by
backpropagation through time on the driver, from a bounded sample: the segments of at most
``SAMPLE_DOCS`` labelled documents a language, chosen by hash, ``SAMPLE_SEGMENTS`` of each, spread over its text.

Texts that are null or have no letter are ``und`` with score 0. Without any labelled document all texts are.
Ties between labels go to the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridterrain.llm.workers import slices, utf8

STEPS, UNITS = 64, 16
SAMPLE_DOCS, SAMPLE_SEGMENTS = 600, 4
EPOCHS, BATCH, RATE, SEED = 12, 256, 0.02, 5
# A small sample is gone through more often, as few steps leave the model hardly better than a guess.
LEAST_STEPS = 120
# Stands for no byte.
PAD = 256
_SIDE = 1024
UNKNOWN = "und"


@dataclass
class Direction:
    """Weights of one direction: a row of inputs for each byte, the recurrent matrices and the bias of the
    candidate's recurrent part. The parts stand as update gate, reset gate, candidate."""

    table: np.ndarray  # (3, 256, units)
    back: np.ndarray  # (3, units, units)
    bias: np.ndarray  # (units,)


@dataclass
class LanguageModel:
    labels: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (2 units, labels)
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.back, self.forward.bias, self.backward.table, self.backward.back, self.backward.bias, self.out, self.out_bias]


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(squashed: np.ndarray) -> np.ndarray:
    """Derivative of the squashing function, from its value."""
    return (1 - np.abs(squashed)) ** 2


def _new_model(labels: list[str], rng: np.random.Generator) -> LanguageModel:
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    side = lambda: Direction(normal(0.3, 3, PAD, UNITS), normal(UNITS**-0.5, 3, UNITS, UNITS), np.zeros(UNITS, np.float32))
    return LanguageModel(labels, side(), side(), normal((2 * UNITS) ** -0.5, 2 * UNITS, len(labels)), np.zeros(len(labels), np.float32))


def _run_direction(d: Direction, codes: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States after each step, ``(steps + 1, batch, units)``, and what the way back needs."""
    steps, batch = codes.shape
    states, kept = np.zeros((steps + 1, batch, UNITS), np.float32), []
    for t in range(steps):
        h, inputs = states[t], d.table[:, codes[t]]
        z, r = 0.5 + 0.5 * _squash(inputs[:2] + h @ d.back[:2])
        inner = h @ d.back[2] + d.bias
        n = _squash(inputs[2] + r * inner)
        states[t + 1] = (n + z * (h - n)) * real[t]
        kept.append((z, r, inner, n))
    return states, kept


def _back_direction(d: Direction, codes: np.ndarray, real: np.ndarray, states: np.ndarray, kept: list[tuple], into: np.ndarray) -> list[np.ndarray]:
    """Gradients of a direction's weights, through time; ``into`` has those of the states by step."""
    table, back, bias = np.zeros_like(d.table), np.zeros_like(d.back), np.zeros_like(d.bias)
    carried = np.zeros_like(states[0])
    for t in reversed(range(len(codes))):
        z, r, inner, n = kept[t]
        h, g = states[t], (into[t] + carried) * real[t]
        dn = g * (1 - z) * _slope(n)
        dz, dr = g * (h - n) * 0.5 * _slope(2 * z - 1), dn * inner * 0.5 * _slope(2 * r - 1)
        again = np.stack([dz, dr, dn * r])
        for part, change in zip(table, (dz, dr, dn), strict=True):
            np.add.at(part, codes[t], change)
        back += h.T @ again
        bias += (dn * r).sum(axis=0)
        carried = g * z + (again @ d.back.transpose(0, 2, 1)).sum(axis=0)
    return [table, back, bias]


def loss_and_gradients(model: LanguageModel, codes: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions that are not ``PAD``, and its gradient for every part of the model."""
    held = (codes != PAD).astype(np.float32)[:, :, None]
    real, codes = held[:, :, 0], np.where(codes == PAD, 0, codes)
    f, f_kept = _run_direction(model.forward, codes, held)
    b, b_kept = _run_direction(model.backward, codes[::-1], held[::-1])
    both = np.concatenate([f[1:], b[1:][::-1]], axis=2)
    logits = both @ model.out + model.out_bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    weight = real / max(1.0, real.sum())
    at = np.arange(len(target))
    loss = -float((np.log(p[:, at, target] + 1e-9) * weight).sum())
    p[:, at, target] -= 1
    p *= weight[:, :, None]
    flat = lambda x: x.reshape(-1, x.shape[2])
    states = p @ model.out.T
    grads = _back_direction(model.forward, codes, held, f, f_kept, states[:, :, :UNITS]) + _back_direction(model.backward, codes[::-1], held[::-1], b, b_kept, states[::-1, :, UNITS:])
    return loss, [*grads, flat(both).T @ flat(p), flat(p).sum(axis=0)]


def train(segments: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> LanguageModel:
    """A model of labelled segments by Adam with a falling rate. The same input gives the same model."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    model = _new_model(names, rng)
    codes = np.full((len(segments), STEPS), PAD, np.int64)
    for i, s in enumerate(segments):
        codes[i, : len(s[:STEPS])] = np.frombuffer(s[:STEPS], np.uint8)
    target = np.array([names.index(x) for x in labels])
    first, second = ([np.zeros_like(p) for p in model.parts()] for _ in range(2))
    total, step = epochs * max(1, -(-len(codes) // BATCH)), 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            _, grads = loss_and_gradients(model, codes[rows].T, target[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for p, g, m, v in zip(model.parts(), grads, first, second, strict=True):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _add_direction(d: Direction, out: np.ndarray, codes: np.ndarray, real: np.ndarray | None, into: np.ndarray) -> None:
    """Add a direction's share of every position's label values to ``into``, ``(steps, labels, batch)``.

    The same as in training, in place. A gate is half of one plus its squashed input; the halves are taken later.
    """
    steps, batch = codes.shape
    h, inner, size = np.zeros((batch, UNITS), np.float32), np.empty((batch, UNITS), np.float32), np.empty((2, batch, UNITS), np.float32)
    inputs, again = np.empty((3, batch, UNITS), np.float32), np.empty((3, batch, UNITS), np.float32)
    half, n, last = np.float32(0.5), inputs[2], out.T.copy()
    for t in range(steps):
        for part, rows in zip(d.table, inputs, strict=True):
            np.take(part, codes[t], axis=0, out=rows, mode="clip")
        np.matmul(h, d.back, out=again)
        gates, inner = inputs[:2], again[2]
        gates += again[:2]
        np.abs(gates, out=size)
        size += 1
        gates /= size
        gates += 1
        inner += d.bias
        inner *= gates[1]
        inner *= half
        n += inner
        np.abs(n, out=inner)
        inner += 1
        n /= inner
        h -= n
        h *= gates[0]
        h *= half
        h += n
        if real is not None:
            h *= real[t]
        into[t] += last @ h.T


def label_positions(model: LanguageModel, codes: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Probabilities of every position, ``(steps, labels, batch)``, of segments ``(steps, batch)``; what is not real has zeros."""
    held = None if real.all() else real.astype(np.float32)[:, :, None]
    p = np.zeros((codes.shape[0], len(model.labels), codes.shape[1]), np.float32)
    p += model.out_bias[:, None]
    _add_direction(model.forward, model.out[:UNITS], codes, held, p)
    _add_direction(model.backward, model.out[UNITS:], codes[::-1], None if held is None else held[::-1], p[::-1])
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    if held is not None:
        p *= real[:, None, :]
    return p


def pooled(model: LanguageModel, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean probabilities over all bytes of each text; texts lie end to end. Empty texts have zeros.

    Segments are run in the order of their length, each block for as many steps as its longest one has.
    """
    size = np.diff(bounds)
    per_text = -(-size // STEPS)
    text = np.repeat(np.arange(len(size)), per_text)
    within = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = bounds[text] + within * STEPS
    lengths = np.minimum(STEPS, bounds[text + 1] - starts)
    order = np.argsort(lengths, kind="stable")
    sums = np.zeros((len(size), len(model.labels)))
    for a in range(0, len(order), _SIDE):
        rows = order[a : a + _SIDE]
        steps = np.arange(lengths[rows[-1]])[:, None]
        codes = data[np.minimum(steps + starts[rows], len(data) - 1)].astype(np.intp)
        p = label_positions(model, codes, steps < lengths[rows])
        np.add.at(sums, text[rows], p.sum(axis=0).T)
    return sums / np.maximum(size, 1)[:, None]


def is_held_out(key: Column) -> Column:
    """Documents that are never learnt from: the CRC-32 of the id as text leaves 1 when divided by 3. A null id is not one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel | None:
    """The model of a bounded sample of the labelled documents that are not held out; none if there are none."""
    length = F.greatest(F.length(text) - STEPS, F.lit(0))
    segment = lambda i: F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(i)), length + 1) + 1).cast("int"), F.lit(STEPS))
    known = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}") & ~is_held_out(F.col(key)))
    drawn = known.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.lit("sample")).alias("draw"), F.array(*[segment(i) for i in range(SAMPLE_SEGMENTS)]).alias("segments"))
    # Tasks send their best; first each of 64 parts of a language is cut down, so that the last step is small for any input.
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("draw", "segments"))
    parts = drawn.withColumn("n", number("lang", F.pmod("draw", F.lit(64)))).filter(F.col("n") <= sample_docs)
    best = parts.withColumn("n", number("lang")).filter(F.col("n") <= sample_docs)
    rows = sorted((r["lang"], r["n"], s) for r in best.select("lang", "n", "segments").collect() for s in r["segments"])
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(rows) // BATCH))))
    return train([s.encode() for _, _, s in rows], [name for name, _, _ in rows], epochs) if rows else None


def label_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the mean probability of that label); columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    names = [f"c{i}" for i in range(len(kept))]  # no name of the input can meet one of ours
    rows, text = docs.select(*[F.col(f"`{c}`") for c in kept]).toDF(*names), names[kept.index(text)]
    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "letters": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(text))
            labels, scores = [], []
            for a, b in slices(bounds):
                p = pooled(model, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                labels += [model.labels[i] for i in p.argmax(axis=1).tolist()]
                scores += np.minimum(p.max(axis=1), 1.0).tolist()
            columns = [*[batch.column(c) for c in names], pa.array(labels, pa.string()), pa.array(scores, pa.float64()), batch.column("letters")]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "letters"])

    rows = rows.withColumn("letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None))
    named = rows.mapInArrow(run, schema) if model is not None else rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    found = [F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN), F.when(F.col("letters"), F.col("score")).otherwise(0.0)]
    return named.select(*names, *found).toDF(*kept, "lang_pred", "score")
