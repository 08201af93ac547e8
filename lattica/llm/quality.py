"""Quality classifier: a byte-level convolutional network in numpy (operator 3).

Filters of 8 bytes slide over the whole text in steps of 4. Rectified responses are averaged in
chunks of 64 steps that overlap by half; a hidden layer looks at each chunk; its units are max-pooled
over all chunks of the text and combined into one probability. Byte filters, hidden layer and output
are learned together by back propagation (Adam).

Training runs on the driver over a bounded sample: at most ``ROWS`` labelled texts of each class, whole.
Only the chunks that win the pooling of a hidden unit pass a gradient back, so memory does not follow the
length of a text there. Scoring covers every byte and needs no shuffle; filters run over ``BLOCK`` half chunks at
a time, so that memory follows a few bytes for each byte of the longest text. Null and empty texts have no chunk
and get the probability of the bias. Without labels of both classes the score is the smoothed share of label
1. Repeated rows get equal scores; where an id repeats with different texts, the smallest text is trained
on. Empty tables give no scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.llm import textops
from lattica.llm.labelled import held_out, sample
from lattica.llm.session import lean

ROWS, BLOCK = 1500, 4096
WIDTH, STEP, HALF, FILTERS, HIDDEN = 8, 4, 32, 16, 12
EPOCHS, STEPS, BATCH, RATE, DECAY = 10, 400, 48, 4e-3, 1e-4
PAD = 256


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.35, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.filters[:, PAD] = 0
        self.lift = np.full(FILTERS, 0.1, np.float32)
        self.hidden = rng.normal(0, 0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.base = np.full(HIDDEN, 0.05, np.float32)
        self.out = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.shift = 0.0

    def params(self) -> dict[str, np.ndarray]:
        return {k: v for k, v in vars(self).items() if isinstance(v, np.ndarray)}

    @staticmethod
    def layout(offs: np.ndarray):
        """Steps and half chunks of each text, and where they begin."""
        steps = -(-np.diff(offs) // STEP)
        halves = -(-steps // HALF)
        chunks = np.where(halves > 0, np.maximum(halves - 1, 1), 0)
        return steps, halves, chunks

    @staticmethod
    def spaced(data: np.ndarray, offs: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, ``PAD`` after the end of each, and where the first step of each text begins."""
        room = steps * STEP + (WIDTH - STEP)
        place = np.cumsum(room) - room
        text = np.full(int(room.sum()), PAD, np.int16)
        if len(data):
            text[np.arange(len(data)) + np.repeat(place - offs[:-1], np.diff(offs))] = data
        return text, place

    @staticmethod
    def under(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes under each step of half chunks that begin at these bytes and have so many steps."""
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return text[(np.repeat(begin, size) + STEP * step)[:, None] + np.arange(WIDTH)]

    def responses(self, under: np.ndarray) -> np.ndarray:
        total = np.take(self.filters[0], under[:, 0], axis=0)
        for k in range(1, WIDTH):
            total += np.take(self.filters[k], under[:, k], axis=0)
        total += self.lift
        return np.maximum(total, 0, out=total)

    @staticmethod
    def halving(steps: np.ndarray, halves: np.ndarray, place: np.ndarray):
        """The first byte and the number of steps of each half chunk."""
        owner = np.repeat(np.arange(len(steps)), halves)
        rank = np.arange(int(halves.sum())) - np.repeat(np.cumsum(halves) - halves, halves)
        return place[owner] + HALF * STEP * rank, np.minimum(HALF, steps[owner] - HALF * rank)

    @staticmethod
    def pairing(halves: np.ndarray, chunks: np.ndarray):
        """The two half chunks of each chunk (the second equals the first where there is one only)."""
        owner = np.repeat(np.arange(len(halves)), chunks)
        rank = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        left = (np.cumsum(halves) - halves)[owner] + rank
        return left, left + (halves[owner] > 1), owner

    def forward(self, data, offs):
        steps, halves, chunks = self.layout(offs)
        n = len(steps)
        if not steps.sum():
            return np.full(n, self.bias[0] + self.shift), None
        text, place = self.spaced(data, offs, steps)
        begin, size = self.halving(steps, halves, place)
        sums = np.empty((len(size), FILTERS), self.filters.dtype)
        for lo in range(0, len(size), BLOCK):
            some = size[lo : lo + BLOCK]
            sums[lo : lo + BLOCK] = np.add.reduceat(self.responses(self.under(text, begin[lo : lo + BLOCK], some)), np.cumsum(some) - some, axis=0)
        left, right, owner = self.pairing(halves, chunks)
        two = (right > left)[:, None]
        weight = 1.0 / (size[left] + np.where(right > left, size[right], 0)).astype(np.float32)[:, None]
        mean = (sums[left] + np.where(two, sums[right], 0)) * weight
        unit = np.maximum(mean @ self.hidden + self.base, 0)
        some = np.flatnonzero(chunks)
        opens = (np.cumsum(chunks) - chunks)[some]
        pooled = np.zeros((n, HIDDEN), unit.dtype)
        pooled[some] = np.maximum.reduceat(unit, opens, axis=0)
        logit = pooled @ self.out + self.bias[0] + self.shift
        return logit, (text, begin, size, left, right, owner, weight, mean, unit, pooled)

    def gradients(self, data, offs, y, weight_of):
        logit, kept = self.forward(data, offs)
        p = 1 / (1 + np.exp(-logit))
        push = ((p - y) * weight_of / len(y)).astype(np.float32)
        text, begin, size, left, right, owner, weight, mean, unit, pooled = kept
        grads = {"bias": push.sum(keepdims=True), "out": pooled.T @ push}
        back = push[:, None] * self.out
        top = (unit == pooled[owner]) & (unit > 0)
        ties = np.zeros_like(pooled)
        np.add.at(ties, owner, top)
        d_unit = np.where(top, back[owner] / np.maximum(ties[owner], 1), 0).astype(np.float32)
        grads["hidden"], grads["base"] = mean.T @ d_unit, d_unit.sum(0)
        d_mean = (d_unit @ self.hidden.T) * weight
        d_sums = np.zeros((len(size), FILTERS), np.float32)
        np.add.at(d_sums, left, d_mean)
        two = right > left
        np.add.at(d_sums, right[two], d_mean[two])
        won = np.flatnonzero(d_sums.any(1))
        under = self.under(text, begin[won], size[won])
        d_act = np.repeat(d_sums[won], size[won], axis=0)
        d_act[self.responses(under) <= 0] = 0
        grads["lift"] = d_act.sum(0)
        grads["filters"] = g = np.zeros_like(self.filters)
        for k in range(WIDTH):
            tap = under[:, k].astype(np.int64)
            for f in range(FILTERS):
                g[k, :, f] = np.bincount(tap, d_act[:, f], 257)
        g[:, PAD] = 0
        return grads, float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * weight_of).mean())


def train(texts: list[str], y: list[int], share: float, seed: int = 7, epochs: int = EPOCHS) -> Net:
    """Fit the network; ``share`` of label 1 sets the bias back to the labels' own proportions."""
    net, rng = Net(seed), np.random.default_rng(seed)
    share = min(max(share, 0.01), 0.99)
    y = np.asarray(y, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.out[:] = 0
        net.shift = float(np.log(share / (1 - share)))
        return net
    raws = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    even = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean())
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.params().items()}
    a_round = -(-len(raws) // BATCH)
    epochs = max(epochs, -(-STEPS // a_round))  # few texts are seen more often
    n_step, total = 0, epochs * a_round
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            if not sum(len(raws[i]) for i in pick):
                continue
            data = np.concatenate([raws[i] for i in pick])
            offs = np.concatenate([[0], np.cumsum([len(raws[i]) for i in pick])])
            grads, _ = net.gradients(data, offs, y[pick], even[pick])
            n_step += 1
            rate = RATE * (1 - n_step / (total + 1))
            for k, v in net.params().items():
                m, s = moments[k]
                g = grads[k] + DECAY * v
                m += 0.1 * (g - m)
                s += 0.002 * (g * g - s)
                v -= rate * (m / (1 - 0.9**n_step)) / (np.sqrt(s / (1 - 0.998**n_step)) + 1e-8)
    net.shift = float(np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, label: str = "quality") -> Net:
    return train(*sample(docs, labels, label, rows))


def scored(docs: DataFrame, net: Net, name: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1 as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            for part in textops.chunks(batch, text_col, 1 << 20):
                logit, _ = net.forward(*textops.packed(part.column(part.schema.get_field_index(text_col))))
                p = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every text; labels train only rows that are not held out."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(slim, fit(slim, labels, rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
