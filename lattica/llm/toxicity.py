"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks (operator 5).

A unit is the letters of a word in lower case (a-z and all bytes over 127) between a start and an end mark; what
else stands in the word is left out, so signs between letters change nothing. Three or more words of
one letter each in a row, signs between them or not, are one more unit. Long units are covered by
overlapping windows of ``SPAN`` bytes. The kernel of a unit and a landmark sums lambda^(length in both) over
their common subsequences of ``P`` bytes, marks included, so gaps, inserted and dropped letters weaken a
match but do not end it. It is scaled by the landmark's own kernel, and squared, which is a kernel too; it is
taken as zero where over a fifth of the landmark's different letters (one at least) are not in the unit. A
sentence (up to . ! ? or a line end) takes for each landmark the strongest unit; the Nystrom map turns these
into features, and a linear machine with hinge loss decides. A text takes its strongest sentence, and a
logistic curve makes it a probability.

Training runs on the driver over a bounded sample: at most ``ROWS`` labelled texts of each class, whole; near
copies among them count once.
Landmarks (at most ``LANDMARKS``) are letter sequences that set toxic texts apart. A toxic label does
not say which sentence is toxic, so the machine is refitted with the strongest sentence of each toxic
text as its witness, and of each clean text as the hardest to leave alone; the words of toxic texts that hold a landmark are trained on alone too, as they are
and with letters inserted, doubled or dropped.

Scoring covers whole texts, one pass, no shuffle; temporary memory follows a few megabytes of text, or the
longest text. Null and empty texts have no sentence and get the probability of an empty one. Without
labels of both classes the score is the smoothed share of label 1. Repeated rows get equal scores; where
an id repeats with different texts, the smallest text is trained on. Empty tables give no scores.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.llm import textops
from lattica.llm.flat import distinct
from lattica.llm.graph import Forest
from lattica.llm.labelled import held_out, sample
from lattica.llm.session import lean

ROWS, LANDMARKS = 1500, 48
P, LAMBDA, SPAN, LETTERS, POWER = 4, 0.75, 24, 0.8, 3
LEAST, MOST, PURE = 5, 12, 12
START, END = 1, 2
_END = np.isin(np.arange(256), list(b".!?\n"))
_WORD = np.arange(256) >= 128
_WORD[97:123] = True


def kernels(units: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The subsequence kernel of pairs: row i of ``units`` with row i of ``landmarks`` (0 pads)."""
    n, width = units.shape
    long = landmarks.shape[1]
    decay = np.float32(LAMBDA)
    total = np.zeros(n, np.float32)
    prime = [np.ones((long + 1, n), np.float32)] + [np.zeros((long + 1, n), np.float32) for _ in range(P - 1)]
    for a in range(int(sizes.max(initial=0))):
        letter = units[:, a]
        live = letter != 0
        match = [(landmarks[:, j] == letter) & live for j in range(long)]
        for j in range(long):
            total += np.where(match[j], prime[P - 1][j] * decay * decay, 0)
        for i in range(P - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(long):
                run = decay * (run + np.where(match[j], decay * prime[i - 1][j], 0))
                prime[i][j + 1] = np.where(live, decay * prime[i][j + 1] + run, prime[i][j + 1])
        # row 0 of orders above 0 stays zero: no subsequence ends before the first letter
    return total


def letter_sets(rows: np.ndarray) -> np.ndarray:
    """The letters of each row as bits of a 64-bit number."""
    bits = np.zeros(len(rows), textops.U)
    for k in range(rows.shape[1]):
        c = rows[:, k].astype(textops.U)
        bits |= np.where(c > 0, textops.U(1) << (c & textops.U(63)), textops.U(0))
    return bits


def padded(words: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w[:width], np.uint8)
    return out


class Machine:
    def __init__(self, landmarks: list[bytes]):
        self.landmarks = padded(landmarks, MOST)
        self.lengths = np.array([len(x) for x in landmarks], np.int64)
        self.letters = letter_sets(self.landmarks)
        several = np.bitwise_count(self.letters).astype(np.int64)
        self.least = np.minimum(np.ceil(LETTERS * several), several - 1).astype(np.uint8)
        m = len(landmarks)
        if m:
            wide = np.zeros((m, SPAN), np.uint8)
            wide[:, :MOST] = self.landmarks
            left, right = np.repeat(np.arange(m), m), np.tile(np.arange(m), m)
            full = kernels(wide[left], self.lengths[left], self.landmarks[right], self.lengths[right]).reshape(m, m).astype(np.float64)
            self.own = np.diag(full).copy()
            values, vectors = np.linalg.eigh((full / np.sqrt(np.outer(self.own, self.own))) ** POWER)
            keep = values > 1e-4
            self.nystrom = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
        else:
            self.own, self.nystrom = np.zeros(0), np.zeros((0, 0))
        self.weights, self.bias = np.zeros(m), 0.0
        self.slope, self.level = 0.0, 0.0

    def responses(self, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Kernel of each unit with each landmark, scaled by the landmark's own."""
        out = np.zeros((len(units), len(self.own)), np.float32)
        order = np.argsort(sizes, kind="stable")
        bits = letter_sets(units)[order]
        for j in range(len(self.own)):
            near = order[np.flatnonzero(np.bitwise_count(bits & self.letters[j]) >= self.least[j])]
            for lo in range(0, len(near), 1 << 13):  # units of like sizes together
                some = near[lo : lo + (1 << 13)]
                mark = np.broadcast_to(self.landmarks[j, : self.lengths[j]], (len(some), self.lengths[j]))
                out[some, j] = kernels(units[some], sizes[some], mark, None) / self.own[j]
        return np.minimum(out, 1.2) ** POWER

    def decide(self, pooled: np.ndarray) -> np.ndarray:
        return (pooled @ self.nystrom) @ self.weights + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.level, -30, 30)))


def unit_rows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of lower-cased texts, a row of ``SPAN`` bytes each (0 pads), their sizes, and the first byte and
    the text of the word that each begins in."""
    starts, ends, text = textops.spans(data, offs)
    letter = _WORD[data]
    before = np.concatenate([[0], np.cumsum(letter)])
    a, b = before[starts], before[ends]
    some = np.flatnonzero(b > a)
    starts, text, a, b = starts[some], text[some], a[some], b[some]
    if not len(a):
        return np.zeros((0, SPAN), np.uint8), a, starts, text
    one = b - a == 1
    linked = one[1:] & one[:-1] & (text[1:] == text[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~linked]))
    size = np.diff(np.append(first, len(a)))
    runs = np.flatnonzero(size >= 3)
    head, tail = first[runs], first[runs] + size[runs] - 1
    starts, text = np.concatenate([starts, starts[head]]), np.concatenate([text, text[head]])
    a, b = np.concatenate([a, a[head]]), np.concatenate([b, b[tail]])
    room, step = SPAN - 2, (SPAN - 2) // 2
    parts = 1 + np.maximum(-(-(b - a - room) // step), 0)
    owner = np.repeat(np.arange(len(a)), parts)
    skip = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * step
    low, high = a[owner] + skip, np.minimum(a[owner] + skip + room, b[owner])
    size, open_ = high - low, skip == 0
    letters = np.append(data[letter], 0)
    out = np.zeros((len(owner), SPAN), np.uint8)
    out[open_, 0] = START
    put = open_.astype(np.int64)
    for k in range(room):
        on = np.flatnonzero(size > k)
        out[on, put[on] + k] = letters[low[on] + k]
    closed = np.flatnonzero(high == b[owner])
    out[closed, (put + size)[closed]] = END
    return out, put + size + (high == b[owner]), starts[owner], text[owner]


def sentence_of(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sentence number of each unit: sentences end after . ! ? at a word's end, and at line ends."""
    stop = _END[data]
    inside = np.zeros(len(data), bool)
    inside[:-1] = stop[:-1] & ~textops._WS[data[1:]] & (data[:-1] != 10)
    number = np.concatenate([[0], np.cumsum(stop & ~inside)])
    return number[starts] + np.searchsorted(offs, starts, "right")


def pooled(machine: Machine, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text, sentence) of the sentences in which some unit answers to a landmark."""
    data = textops.LOWER[data]
    units, sizes, starts, text = unit_rows(data, offs)
    none = np.zeros((0, len(machine.own)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts) or not len(machine.own):
        return none
    keys = textops.mix(units.view(textops.U) * np.array([3, 5, 7], textops.U) + np.array([1, 2, 3], textops.U))
    key = textops.mix(keys[:, 0] + textops.mix(keys[:, 1] + textops.mix(keys[:, 2])))
    _, first, back = distinct(key)
    answer = machine.responses(units[first], sizes[first])
    some = np.flatnonzero(answer.any(1)[back])
    if not len(some):
        return none
    sentence = sentence_of(data, offs, starts[some])
    order = np.argsort(sentence, kind="stable")
    some, sentence = some[order], sentence[order]
    cut = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    return np.maximum.reduceat(answer[back[some]], cut, axis=0), text[some[cut]], sentence[cut]


def strongest(machine: Machine, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The decision of each text: its strongest sentence, an empty sentence at least."""
    out = np.full(len(offs) - 1, machine.decide(np.zeros((1, len(machine.own))))[0])
    features, text, _ = pooled(machine, data, offs)
    if len(features):
        np.maximum.at(out, text, machine.decide(features))
    return out


def _words(text: str) -> set[bytes]:
    """The units of a text, but for windows of long words."""
    data, offs = _stacked([text])
    units, sizes, _, _ = unit_rows(textops.LOWER[data], offs)
    return {u[:n].tobytes() for u, n in zip(units, sizes.tolist(), strict=True)}


def _apart(texts: list[str]) -> list[str]:
    """One of each group of near copies: texts that share a MinHash value of their three-word shingles."""
    sets = textops.shingle_sets(pa.array(texts, pa.large_string()), 3)
    forest, first = Forest(len(texts)), {}
    for i, own in enumerate(sets):
        for k in range(1, 5) if len(own) else ():
            least = int(textops.mix(own * textops.U(2 * k + 1)).min())
            forest.join(first.setdefault((k, least), i), i)
    return [t for i, t in enumerate(texts) if forest.find(i) == i]


def _sequences(unit: bytes) -> set[bytes]:
    return {unit[a:b] for a in range(max(len(unit) - LEAST + 1, 0)) for b in range(a + LEAST, min(len(unit), a + MOST) + 1)}


def find_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> tuple[list[bytes], int]:
    """Letter sequences of units that set toxic texts apart, chosen greedily until the odd units of toxic
    texts are covered; then the clean units that hold them. The second value is the number of the former."""
    of_toxic = [_words(t) for t in toxic]
    seen_toxic, seen_clean = Counter(w for own in of_toxic for w in own), Counter()
    for t in clean:
        seen_clean.update(_words(t))
    share = len(clean) / max(len(toxic), 1)
    least = 2 if len(toxic) < 300 else 3
    odd = {w for w, n in seen_toxic.items() if n >= least and (n + 0.5) * share > 8 * (seen_clean[w] + 0.5)}
    units_of, holders, like = defaultdict(set), defaultdict(set), defaultdict(list)
    for w in odd:
        for x in _sequences(w):
            units_of[x].add(w)
    for i, own in enumerate(of_toxic):
        for w in own & odd:
            for x in _sequences(w):
                holders[x].add((i, w))
    for w, n in seen_clean.items():
        for x in _sequences(w) & units_of.keys():
            like[x].append((n, w))
    nearest = {x: sorted(like[x], reverse=True)[:2] for x in units_of}
    spared = {x: sum(n for n, _ in like[x]) - sum(n for n, _ in nearest[x]) for x in units_of}
    pool = [x for x in units_of if len(holders[x]) * share > PURE * (spared[x] + 1)]
    chosen: list[bytes] = []
    left, floor = {(i, w) for i, own in enumerate(of_toxic) for w in own & odd}, max(least, len(toxic) // 50)
    while pool and len(chosen) < most:
        gain = {x: len(holders[x] & left) for x in pool}
        pool = [x for x in pool if gain[x] >= floor]
        if not pool:
            break
        floor = max(floor, 0.04 * max(gain.values()))
        best = max(pool, key=lambda x: (gain[x] * len(x) ** 0.5 / (1 + spared[x]) ** 0.25, x))
        chosen.append(best)
        left -= holders[best]
    found = len(chosen)
    for x in chosen[:found]:
        chosen += [w for n, w in nearest[x] if n >= 2 and len(w) <= MOST and w not in chosen]
    return chosen, found


def _stacked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge loss with a small ridge, by Newton steps over the rows inside the margin."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    weight = weight / weight.sum()
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        some = x[inside] * weight[inside][:, None]
        new = np.linalg.solve(x[inside].T @ some + ridge * np.eye(x.shape[1]), some.T @ y[inside])
        w = new if not w.any() else (w + new) / 2
        now = y * (x @ w) < 1
        if (now == inside).all() and np.abs(new - w).max() < 1e-9:
            break
        inside = now
    return w[:-1], float(w[-1])


def _variants(word: bytes) -> list[bytes]:
    """A unit as it is, and with a letter inserted, doubled or dropped at each place between its marks."""
    last = len(word) - 1
    out = [word]
    for at in range(2, last):
        out += [word[:at] + b"x" + word[at:], word[:at] + word[at - 1 : at] * 2 + word[at:]]
        if len(word) > 7:
            out.append(word[:at] + word[at + 1 :])
    return out


def _strongest_of(strength: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Where the strongest sentence of each text is."""
    best = np.full(n, -np.inf)
    np.maximum.at(best, text, strength)
    return np.flatnonzero(strength >= best[text])


def train(texts: list[str], y: list[int], share: float) -> Machine:
    share = min(max(share, 0.01), 0.99)
    toxic, clean = [t or "" for t, k in zip(texts, y, strict=True) if k], [t or "" for t, k in zip(texts, y, strict=True) if not k]
    toxic, clean = _apart(toxic), _apart(clean)
    marks, found = find_landmarks(toxic, clean) if toxic and clean else ([], 0)
    machine = Machine(marks)
    machine.level = float(np.log(share / (1 - share)))
    if not len(machine.own):
        return machine
    pos, pos_text, _ = pooled(machine, *_stacked(toxic))
    neg, neg_text, _ = pooled(machine, *_stacked(clean))
    counted = Counter(w for t in toxic for w in _words(t))
    marks = [mark[:n].tobytes() for mark, n in zip(machine.landmarks[:found], machine.lengths, strict=False)]
    whole = [max((w for w in counted if m in w), key=lambda w: (counted[w], w)) for m in marks]
    gapped = [v for w in whole for v in _variants(w)]
    alone = lambda units: machine.responses(padded(units, SPAN), np.array([min(len(u), SPAN) for u in units]))
    exact, extra = alone(whole), alone(gapped)
    none = np.zeros((1, len(machine.own)), np.float32)
    push, pull = pos.max(1), neg.max(1)
    for _ in range(4):
        witness, nearest = _strongest_of(push, pos_text, len(toxic)), _strongest_of(pull, neg_text, len(clean))
        parts = [(pos[witness], 1, 0.05), (exact, 1, 0.3), (extra, 1, 0.4), (neg[nearest], -1, 0.2), (neg, -1, 0.03), (none, -1, 0.02)]
        parts = [(x @ machine.nystrom, y, share) for x, y, share in parts if len(x)]
        target = np.concatenate([np.full(len(x), y) for x, y, _ in parts])
        weight = np.concatenate([np.full(len(x), share / len(x)) for x, _, share in parts])
        machine.weights, machine.bias = _fit_linear(np.concatenate([x for x, _, _ in parts]), target, weight)
        push, pull = machine.decide(pos), machine.decide(neg)
    decision = np.full(len(toxic) + len(clean), machine.decide(np.zeros((1, len(machine.own))))[0])
    np.maximum.at(decision, np.concatenate([pos_text, len(toxic) + neg_text]), machine.decide(np.concatenate([pos, neg])))
    decision = np.concatenate([decision, machine.decide(exact), machine.decide(extra)])  # texts of one insult
    label = np.ones(len(decision))
    label[len(toxic) : len(toxic) + len(clean)] = 0
    parts = [(len(toxic), share / 4), (len(clean), 1 - share), (len(exact), share / 2), (len(extra), share / 4)]
    weight = np.concatenate([np.full(n, part / n) for n, part in parts if n])
    a, c = 1.0, machine.level
    for _ in range(300):  # Newton steps with a small ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(a * decision + c, -30, 30)))
        g = np.array([((p - label) * weight) @ decision + 1e-4 * a, ((p - label) * weight).sum()])
        v = p * (1 - p) * weight
        h = np.array([[v @ (decision * decision) + 1e-4, v @ decision], [v @ decision, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 2 / (np.abs(step).max() + 1e-12))
        a, c = a - size * step[0], c - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    machine.slope, machine.level = float(max(a, 0)), float(c)
    return machine


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, label: str = "toxic") -> Machine:
    return train(*sample(docs, labels, label, rows))


def scored(docs: DataFrame, machine: Machine, name: str = "score", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1 as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            for part in textops.chunks(batch, text_col, 2 << 20):
                p = shared.value.probability(strongest(shared.value, *textops.packed(part.column(part.schema.get_field_index(text_col)))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p.astype(np.float64))], [*part.schema.names, name])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every text; labels train only rows that are not held out."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(slim, fit(slim, labels, rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
