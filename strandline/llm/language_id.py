"""Language identification: a bidirectional gated recurrent network over bytes, trained here by backpropagation through time.

The network reads a text's bytes forwards and backwards and labels every position; a document's probabilities are the
mean over all its positions. Texts are read in windows of ``WINDOW`` bytes, whatever words they cut: the forward state
comes from ``HALO`` bytes before the window and the backward state from ``HALO`` bytes behind it, as far as the text has
them; so every byte is labelled once, in its context, and windows of many texts run side by side, one byte a step.

Training uses a bounded sample of labelled rows: ``per_lang`` documents a language, chosen by a hash of their id, and
``sample_chars`` characters of each from a hashed position. Counts of labels, which set the sampling rates, cover all
rows. Prediction reads whole texts.

Defined results: ``und`` with score 0 for a null text, a text without letters, or when nothing could be learned; rows
with a null id are never learned from nor held out; equal texts get equal predictions (scores are rounded to six
digits); columns of the input named ``lang_pred`` or ``score`` give way to the new ones. Texts must be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.scratch import keep
from strandline.llm.tokens import utf8

WINDOW, HALO = 192, 32
#: Windows that run side by side; fewer are filled up to a multiple of LANES, so that sums do not depend on their number.
BATCH, LANES = 2048, 64
SLICE_BYTES = 2 << 20
BROADCAST_LANGS = 10_000
#: Bytes of a training sequence.
SEQUENCE = 96
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _squash(x: np.ndarray) -> np.ndarray:
    """From -1 to 1, of slope ``(1 - |y|)**2`` at its value y; needs no exponential."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (_squash(0.5 * x) + 1)


@dataclass
class Model:
    langs: list[str]
    inputs: list[np.ndarray]  # for each direction, byte to gate inputs (256, 3 * hidden), in the order z, r, n
    recurrent: list[np.ndarray]  # (hidden, 3 * hidden)
    out: np.ndarray  # (2 * hidden, langs)
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.out, self.bias]


def _states(model: Model, codes: np.ndarray, length: np.ndarray, way: int, tape: list | None = None) -> np.ndarray:
    """Hidden state after each byte (steps, hidden, columns) of ``codes`` (steps, columns); ``way`` 1 reads backwards.

    Columns end after ``length`` bytes; reading backwards, the state is zero until there.
    """
    steps, n = codes.shape
    inputs, recurrent = model.inputs[way].T, model.recurrent[way].T
    h = len(recurrent) // 3
    state = np.zeros((h, n), inputs.dtype)
    out = np.zeros((steps, h, n), inputs.dtype)
    for t in range(steps - 1, -1, -1) if way else range(steps):
        gate, hidden = inputs[:, codes[t]], recurrent @ state
        zr = _gate(gate[: 2 * h] + hidden[: 2 * h])
        new = _squash(gate[2 * h :] + zr[h:] * hidden[2 * h :])
        if tape is not None:
            tape.append((t, state, zr, new, hidden[2 * h :]))
        state = new + zr[:h] * (state - new)
        if way:
            state *= length > t
        out[t] = state
    return out


def _softmax(score: np.ndarray, axis: int) -> np.ndarray:
    score = np.exp(score - score.max(axis=axis, keepdims=True))
    score /= score.sum(axis=axis, keepdims=True)
    return score


def position_probabilities(model: Model, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(steps, langs, columns): probabilities at every position of whole texts, column by column."""
    both = np.concatenate([_states(model, codes, length, way) for way in (0, 1)], axis=1)
    return _softmax(model.out.T @ both + model.bias[:, None], 1)


def _gradients(model: Model, codes: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradient for each of ``model.weights``, back through time."""
    h, (steps, n) = model.recurrent[0].shape[0], codes.shape
    tapes: list[list] = [[], []]
    both = np.concatenate([_states(model, codes, length, way, tapes[way]) for way in (0, 1)], axis=1)
    score = _softmax(model.out.T @ both + model.bias[:, None], 1)
    mask = (np.arange(steps)[:, None] < length[None, :]).astype(both.dtype)
    total = mask.sum()
    columns = np.arange(n)
    loss = -float((np.log(score[:, label, columns] + 1e-9) * mask).sum() / total)
    delta = score * mask[:, None, :]
    delta[:, label, columns] -= mask
    delta /= total
    grad = [np.zeros_like(w) for w in model.weights]
    grad[4] = np.tensordot(both, delta, axes=([0, 2], [0, 2]))
    grad[5] = delta.sum(axis=(0, 2))
    above = model.out @ delta
    flat = codes.ravel()
    for way in (0, 1):
        carried = np.zeros((h, n), both.dtype)
        gates = np.zeros((3 * h, steps, n), both.dtype)
        for t, state, zr, new, hidden in reversed(tapes[way]):
            z, r = zr[:h], zr[h:]
            d = carried + above[t, way * h : (way + 1) * h]
            if way:
                d *= length > t
            d_new = d * (1 - z) * (1 - np.abs(new)) ** 2
            slope = (0.5 - np.abs(zr - 0.5)) ** 2
            d_hidden = np.concatenate([d * (state - new) * slope[:h], d_new * hidden * slope[h:], d_new * r])
            gates[: 2 * h, t], gates[2 * h :, t] = d_hidden[: 2 * h], d_new
            grad[2 + way] += state @ d_hidden.T
            carried = d * z + model.recurrent[way] @ d_hidden
        for k, row in enumerate(gates.reshape(3 * h, -1)):
            grad[way][:, k] = np.bincount(flat, row, 256)
    return loss, grad


def train(texts: list[str], labels: list[str], hidden: int = 16, steps: int = 240, batch: int = 256, seed: int = 3) -> Model:
    """Adam over random stretches of the sample, each language as likely as the others."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
    model = Model(langs, [small(256, 3 * hidden), small(256, 3 * hidden)], [small(hidden, 3 * hidden), small(hidden, 3 * hidden)], small(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    sizes = np.diff(offsets)
    of_text = np.array([langs.index(x) for x in labels])
    by_lang = [x for x in (np.flatnonzero((of_text == i) & (sizes > 0)) for i in range(len(langs))) if len(x)]
    if not by_lang:
        return Model([], [], [], model.out, model.bias)
    m = [np.zeros_like(w) for w in model.weights]
    v = [np.zeros_like(w) for w in model.weights]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, batch // len(by_lang) + 1) for x in by_lang])
        begin = offsets[pick] + (rng.random(len(pick)) * np.maximum(sizes[pick] - SEQUENCE + 1, 1)).astype(np.int64)
        length = np.minimum(offsets[pick + 1] - begin, SEQUENCE)
        codes = data[np.minimum(begin + np.arange(SEQUENCE)[:, None], len(data) - 1)]
        _, grad = _gradients(model, codes, length, of_text[pick])
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(model.weights, grad, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 400, sample_chars: int = 1500) -> DataFrame:
    """At most ``per_lang`` labelled rows a language, with ``sample_chars`` characters each; never held-out rows."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.xxhash64(F.col("doc_id"), F.lit(11))
    # a few numbers a language; they are broadcast unless there are very many
    counts = keep(counts, "lang-counts")
    rates = F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts
    near = known.select("lang", "text", draw.alias("draw")).join(rates, "lang").filter(F.pmod(F.col("draw"), F.lit(1 << 30)) < F.lit(3.0 * per_lang * (1 << 30)) / F.col("n") + 1)
    begin = 1 + F.pmod(F.col("draw"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1)))
    ranked = near.select("lang", "draw", F.expr("text").substr(begin.cast("int"), F.lit(sample_chars)).alias("text")).withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw", "text")))
    return ranked.filter(F.col("nth") <= per_lang).select("lang", "text", "draw")


def fit(docs: DataFrame, per_lang: int = 400, sample_chars: int = 1500) -> Model:
    rows = sorted(map(tuple, sample(docs, per_lang, sample_chars).collect()))
    if not rows:
        return Model([], [], [], np.zeros((0, 0)), np.zeros(0))
    return train([r[1] for r in rows], [r[0] for r in rows])


class Reader:
    """A trained network, laid out to run many windows side by side."""

    def __init__(self, model: Model):
        self.h = h = model.recurrent[0].shape[0]
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5  # a gate squashes half its argument
        self.inputs = [np.ascontiguousarray(w.T * half) for w in model.inputs]
        self.recurrent = [np.ascontiguousarray(w.T * np.float32(0.5)) for w in model.recurrent]  # the rest: half of the gate in front of it
        self.out = np.ascontiguousarray(model.out.T)
        self.bias = model.bias[:, None]

    def _step(self, way: int, codes: np.ndarray, state: np.ndarray, gate: np.ndarray, hidden: np.ndarray) -> None:
        """``state`` after the next bytes; ``gate`` and ``hidden`` are room to work in."""
        h = self.h
        np.take(self.inputs[way], codes, axis=1, out=gate, mode="clip")
        np.matmul(self.recurrent[way], state, out=hidden)
        zr, new, room = gate[: 2 * h], gate[2 * h :], hidden[: 2 * h]
        zr += room
        np.abs(zr, out=room)
        room += 1
        zr /= room
        zr += 1
        hidden[2 * h :] *= zr[h:]
        new += hidden[2 * h :]
        np.abs(new, out=room[:h])
        room[:h] += 1
        new /= room[:h]
        state -= new
        state *= zr[:h]
        state *= 0.5
        state += new

    def windows(self, data: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(windows, langs): summed probabilities over the bytes of each window; ``begins`` and ``ends`` are its text's."""
        n, h = len(starts), self.h
        room = -(-n // LANES) * LANES
        fill = lambda x: np.append(x, np.repeat(x[-1:], room - n))
        starts, begins, ends = fill(starts), fill(begins), fill(ends)
        steps = np.arange(-HALO, WINDOW + HALO)
        codes = data[np.clip(starts + steps[:, None], 0, len(data) - 1)].astype(np.intp)
        state = np.zeros((h, room), np.float32)
        work = np.empty((3 * h, room), np.float32), np.empty((3 * h, room), np.float32)
        both = np.empty((WINDOW, 2 * h, room), np.float32)
        for t in range(-HALO, WINDOW):
            if t == 0:
                state[:, starts == begins] = 0  # nothing is before a text's first window
            self._step(0, codes[t + HALO], state, *work)
            if t >= 0:
                both[t, :h] = state
        left = ends - starts
        short = bool((left < WINDOW + HALO).any())
        state[:] = 0
        total = np.zeros((len(self.bias), room), np.float32)
        for t in range(WINDOW + HALO - 1, -1, -1):
            self._step(1, codes[t + HALO], state, *work)
            if short:
                state *= left > t
            if t < WINDOW:
                both[t, h:] = state
                p = _softmax(self.out @ both[t] + self.bias, 0)
                total += p * (left > t) if short else p
        return total[:, :n].T

    def texts(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(texts, langs): mean probabilities over all bytes of each text, none of them empty."""
        count = -(-(ends - begins) // WINDOW)
        text = np.repeat(np.arange(len(begins)), count)
        starts = begins[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        sums = np.zeros((len(begins), len(self.bias)))
        for at in range(0, len(text), BATCH):
            part = text[at : at + BATCH]
            np.add.at(sums, part, self.windows(data, starts[at : at + BATCH], begins[part], ends[part]))
        return sums / (ends - begins)[:, None]


def _has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[data], out=letters[1:])
    out = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return out


def _label(shared, position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model) if model.langs else None
        for batch in batches:
            data, offsets = utf8(batch.column(position))
            row = 0
            while row < len(batch):
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
                part, at = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
                known = _has_letters(part, at)
                best, score = np.zeros(stop - row, int), np.zeros(stop - row)
                if reader and known.any():
                    full = np.flatnonzero(known)
                    pooled = reader.texts(part, at[full], at[full + 1])
                    best[full], score[full] = pooled.argmax(axis=1), np.clip(pooled.max(axis=1), 0, 1).round(6)
                named = [model.langs[b] if k and model.langs else "und" for k, b in zip(known.tolist(), best.tolist())]
                score[[x == "und" for x in named]] = 0
                rows = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(named, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])
                row = stop

    return run


def label(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, reading whole texts."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB at most: 256 bytes x gates
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(_label(shared, docs.columns.index(text_col)), T.StructType(docs.schema.fields + found))


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return label(rows, fit(docs)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
