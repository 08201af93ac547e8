"""Substring dedup by paragraph MinHash banding (operator 4).

Paragraphs are lines of at least ``LINE`` words. Whole texts, lines or not, are also cut into parts at words
that the content picks: a word whose three-word hash is the smallest among ``RADIUS`` words on each side, where
starts of sentences (after . ! ? before white space) come before all others. Equal runs of words are cut
alike but near their ends, so a passage is found whatever stands around it, with or without sentences or
the same line breaks, and an edit costs the parts around it: a passage of 60 words with one
word changed is 0.83 similar and found, with a word changed in every twelve it is not similar at all (0.4). Inside a sentence up to some 7 words at each end of a
passage are not told apart from what surrounds it and stay.

1. Every task sums equal paragraphs and parts before anything is shuffled: count and first place.
2. Distinct lines get ``BANDS`` keys of ``ROWS`` MinHash values over their sets of five-word shingles. Both are
   tuned: the most rows a band, so the fewest chance collisions, with which two lines at Jaccard 0.8 still
   collide with probability ``RECALL`` and ``HASHES`` values are enough. Lines that are neighbours in a bucket are
   joined; what is joined, directly or not, forms blocks, and inside a block links are verified by exact
   Jaccard similarity.
3. Lines are clustered by components of verified links. In each cluster the first occurrence, by
   (doc_id, text, place), stays and all others go. Equal parts go likewise, where the repeated parts of a text
   that lie together (gaps of at most ``GAP`` words) have at least ``RUN`` words in all; so short parts
   that two texts happen to share stay. Parts inside a line that goes count with it; inside a line that
   stays, as the first of its cluster, those go that stand earlier elsewhere.

Words are taken in lower case (A-Z). Null and empty texts have no paragraphs. A row is known by its id
and a hash of its text: rows equal in both are cut alike. Null ids take no part and are left as they
are. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lattica.llm import jaccard, textops
from lattica.llm.graph import components
from lattica.llm.session import lean, unused

LINE, RADIUS, GAP, RUN = 20, 3, 12, 25
RECALL, HASHES, WORDS = 0.999, 64, 5
NUM, DEN = 80, 100


def tuned(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``recall`` is reached at ``similarity`` with so many hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


BANDS, ROWS = tuned(NUM / DEN, RECALL, HASHES)
_STOP = np.isin(np.arange(256), list(b".!?"))
_MULTIPLIERS = textops.mix(np.arange(1, BANDS * ROWS + 1, dtype=textops.U) * textops.U(0xE7037ED1A0B428DB)) | textops.U(1)


class Units:
    """Lines and parts of the texts of a batch, as ranges of words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.text = textops.spans(data, offs)
        self.words = textops.hashes(textops.LOWER[data], self.starts, self.ends)
        self.offs = offs
        n = len(self.starts)
        if not n:
            self.line, self.part = (np.zeros((2, 0), np.int64),) * 2
            return
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        new_line = np.ones(n, bool)
        new_line[1:] = (breaks[self.starts[1:]] != breaks[self.ends[:-1]]) | (self.text[1:] != self.text[:-1])
        new_sentence = np.ones(n, bool)
        new_sentence[1:] = _STOP[data[self.ends[:-1] - 1]]
        self.line, self.part = self._ranges(new_line, LINE), self._ranges(self._cuts(new_sentence), RADIUS + 1)

    def _cuts(self, preferred: np.ndarray) -> np.ndarray:
        """Where a part starts: at each text's first word, and at least ``RADIUS`` + 1 words apart."""
        n = len(self.words)
        value = textops.mix(self.words)
        for k in (1, 2):  # words of the next text do not count
            value[: n - k] += np.where(self.text[k:] == self.text[: n - k], self.words[k:], textops.U(0)) * textops.U(2 * k + 3)
            value = textops.mix(value)
        value = (value >> textops.U(1)) | ((~preferred).astype(textops.U) << textops.U(63))
        first = np.ones(n, bool)
        first[1:] = self.text[1:] != self.text[:-1]
        value[first] = 0
        cut = np.ones(n, bool)
        for d in range(1, RADIUS + 1):
            same = self.text[d:] == self.text[: n - d]
            cut[d:] &= ~same | (value[d:] < value[: n - d])
            cut[: n - d] &= ~same | (value[: n - d] <= value[d:])
        return cut

    @staticmethod
    def _ranges(new: np.ndarray, least: int) -> np.ndarray:
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(new)]])
        on = b - a >= least
        return np.stack([a[on], b[on]])

    def keys(self, ranges: np.ndarray, kind: int) -> np.ndarray:
        """A 64-bit id of the words of each range."""
        out = np.empty(ranges.shape[1], textops.U)
        i, size = 0, 1 << 16
        while i < ranges.shape[1]:
            j = max(i + 1, int(np.searchsorted(ranges[1], ranges[0, i] + size, "right")))
            lo, hi = int(ranges[0, i]), int(ranges[1, j - 1])
            up, down = textops._pow(hi - lo)
            total = np.concatenate([np.zeros(1, textops.U), np.cumsum(self.words[lo:hi] * up[: hi - lo])])
            a, b = ranges[0, i:j] - lo, ranges[1, i:j] - lo
            out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(textops.U)
            i = j
        return textops.mix(out + textops.U(kind)).view(np.int64)

    def sets(self, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Five-word shingles of the ranges (each has five words at least) and their range numbers."""
        size = ranges[1] - ranges[0] - WORDS + 1
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + ranges[0][owner]
        acc = np.zeros(len(at), textops.U)
        for k in range(WORDS):
            acc = textops.mix(acc + self.words[at + k] * textops.U(2 * k + 3))
        return acc, owner

    def bands(self, ranges: np.ndarray) -> np.ndarray:
        """``BANDS`` 32-bit keys of each range."""
        shingles, owner = self.sets(ranges)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, int)
        out = np.zeros((ranges.shape[1], BANDS), np.uint32)
        for b in range(BANDS):
            acc = np.full(ranges.shape[1], textops.U(b + 1))
            for r in range(ROWS):
                hashed = shingles * _MULTIPLIERS[b * ROWS + r]
                hashed ^= hashed >> textops.U(29)
                acc = textops.mix(acc + np.minimum.reduceat(hashed * _MULTIPLIERS[r], first) if len(first) else acc)
            out[:, b] = acc >> textops.U(32)
        return out


def _batches(batches):
    for batch in batches:
        for part in textops.chunks(batch, "text", 2 << 20):
            yield part, Units(*textops.packed(part.column(part.schema.get_field_index("text"))))


def text_keys(part: pa.RecordBatch) -> np.ndarray:
    """A 64-bit hash of each whole text."""
    data, offs = textops.packed(part.column(part.schema.get_field_index("text")))
    out = np.zeros(part.num_rows, textops.U)
    on = np.flatnonzero(np.diff(offs))
    out[on] = textops.hashes(data, offs[on], offs[on + 1])
    return out.view(np.int64)


def distinct_units(docs: DataFrame) -> DataFrame:
    """(cls, line, count, first, n, bands): a row per distinct line, and per part that is found again."""

    def run(batches):
        for part, units in _batches(batches):
            ids, texts = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), text_keys(part)
            for is_line, ranges in ((True, units.line), (False, units.part)):
                if not ranges.shape[1]:
                    continue
                keys = units.keys(ranges, int(is_line))
                row = units.text[ranges[0]]
                place = units.starts[ranges[0]] - units.offs[row]
                order = np.lexsort((place, texts[row], ids[row], keys))
                at = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
                count = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])), [len(keys)]]))
                size = ranges[1, at] - ranges[0, at]
                bands = pa.array([b.tobytes() for b in units.bands(ranges[:, at])], pa.binary()) if is_line else pa.nulls(len(at), pa.binary())
                cols = [keys[at], np.full(len(at), is_line), count, ids[row[at]], texts[row[at]], place[at], size]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), bands], names)

    def merged(batches):
        """One row a unit: the rows of each come together, the first place before the others."""
        for table in textops.whole(batches, ["cls"]):
            first = np.flatnonzero(textops.changes(table, ["cls"]))
            total = np.add.reduceat(table["count"].to_numpy(), first)
            wanted = table["line"].to_numpy()[first] | (total > 1)
            rows = table.take(pa.array(first[wanted]))
            yield from rows.set_column(names.index("count"), "count", pa.array(total[wanted])).combine_chunks().to_batches()

    names = ["cls", "line", "count", "doc", "txt", "place", "n", "bands"]
    schema = "cls long, line boolean, count long, doc long, txt long, place long, n long, bands binary"
    rows = docs.mapInArrow(lean(run), schema).repartition("cls").sortWithinPartitions("cls", "doc", "txt", "place")
    return rows.mapInArrow(lean(merged), schema).select("cls", "line", "count", F.struct("doc", "txt", "place").alias("first"), "n", "bands")


def colliding(lines: DataFrame) -> DataFrame:
    """(a, b): each line of a band's bucket with the one before it there."""

    def spread(batches):
        for batch in batches:
            if batch.num_rows:
                cls = batch.column(0).to_numpy()
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS).astype(np.int64)
                keys += np.arange(BANDS, dtype=np.int64) << 32
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(cls, BANDS))], ["key", "cls"])

    def meet(batches):
        for table in textops.whole(batches, ["key"]):
            key, cls = table["key"].to_numpy(), table["cls"].to_numpy()
            same = (key[1:] == key[:-1]) & (cls[1:] != cls[:-1])
            if same.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[1:][same]), pa.array(cls[:-1][same])], ["a", "b"])

    return lines.select("cls", "bands").mapInArrow(lean(spread), "key long, cls long").repartition("key").sortWithinPartitions("key", "cls").mapInArrow(lean(meet), "a long, b long")


def _line_sets(batch: pa.RecordBatch):
    for part, units in _batches([batch]):
        if not units.line.shape[1]:
            continue
        keys = units.keys(units.line, 1)
        _, at = np.unique(keys, return_index=True)
        value, owner = units.sets(units.line[:, at])
        sets = textops.distinct(value, owner, len(at))
        yield part.column(0).take(pa.array(units.text[units.line[0, at]])), keys[at], sets


def repeated(docs: DataFrame) -> DataFrame:
    """(cls, first): lines and parts that are found again, and the place of the first of them."""
    units = distinct_units(docs).checkpoint()
    lines = units.where("line")
    known = lines.select("cls", F.col("n"), F.col("first.doc").alias("rep"))
    near = jaccard.verified(docs, colliding(lines), known, _line_sets, NUM, DEN)
    roots = components(near)
    joined = units.select("cls", "count", "first").join(roots, units.cls == roots.node, "left").select("cls", "count", "first", F.coalesce("root", "cls").alias("root"))
    total = joined.groupBy("root").agg(F.sum("count").alias("found"), F.min("first").alias("kept")).where("found > 1")
    return joined.join(total, "root").select("cls", F.col("kept").alias("first"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every occurrence of a repeated passage: (doc_id, txt, start, end, n_words, whole_line, first_doc_id,
    removed); start and end are bytes of the text in UTF-8, the first occurrence is not removed."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    classes = repeated(slim).checkpoint()
    hot = jaccard.bitmap(classes.select("cls"), lambda batch: [batch.column(0).to_numpy().view(textops.U)], jaccard.CELLS * 4, lambda c: c > 0)
    marks = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for part, units in _batches(batches):
            ids, texts = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), text_keys(part)
            for is_line, ranges in ((True, units.line), (False, units.part)):
                keys = units.keys(ranges, int(is_line))
                on = jaccard.has(marks.value, keys.view(textops.U))
                if on.any():
                    keys, (a, b) = keys[on], ranges[:, on]
                    row = units.text[a]
                    first_word = np.searchsorted(units.text, row)
                    cols = [keys, ids[row], texts[row], units.starts[a] - units.offs[row], units.ends[b - 1] - units.offs[row], a - first_word, b - first_word]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(a), is_line))], ["cls", "doc_id", "txt", "start", "end", "w0", "w1", "whole_line"])

    found = slim.mapInArrow(lean(run), "cls long, doc_id long, txt long, start long, end long, w0 long, w1 long, whole_line boolean").dropDuplicates(["doc_id", "txt", "start", "end", "whole_line"])
    placed = found.join(classes, "cls")

    def runs(batches):
        """Drop parts inside a removed line, first parts inside any repeated line, and parts that do not add
        up to a passage."""
        for table in textops.whole(batches, ["doc_id", "txt"]):
            text = np.cumsum(textops.changes(table, ["doc_id", "txt"])).astype(np.int64)
            a, b, line, gone = (table[name].to_numpy() for name in ("w0", "w1", "whole_line", "removed"))
            lines = np.flatnonzero(line)
            parts = np.flatnonzero(~line)
            if len(lines) and len(parts):
                at = np.searchsorted(text[lines] << 32 | a[lines], text[parts] << 32 | a[parts], "right") - 1
                own = lines[np.maximum(at, 0)]
                outside = (at < 0) | (text[own] != text[parts]) | (b[own] < b[parts])
                parts = parts[outside | (gone[parts] & ~gone[own])]
            found = [lines]
            for some in (parts[gone[parts]], parts[~gone[parts]]):
                if len(some):
                    apart = (text[some[1:]] != text[some[:-1]]) | (a[some[1:]] - b[some[:-1]] > GAP)
                    run = np.concatenate([[0], np.cumsum(apart)])
                    found.append(some[np.bincount(run, (b - a)[some])[run] >= RUN])
            kept = table.take(pa.array(np.sort(np.concatenate(found))))
            kept = kept.append_column("n_words", pa.array(kept["w1"].to_numpy() - kept["w0"].to_numpy()))
            yield from kept.select(["doc_id", "txt", "start", "end", "n_words", "whole_line", "first_doc_id", "removed"]).to_batches()

    own = F.struct(F.col("doc_id").alias("doc"), F.col("txt"), F.col("start").alias("place"))
    spans = placed.select("doc_id", "txt", "start", "end", "w0", "w1", "whole_line", F.col("first.doc").alias("first_doc_id"), (own != F.col("first")).alias("removed"))
    ordered = spans.repartition("doc_id", "txt").sortWithinPartitions("doc_id", "txt", "w0", F.desc("w1"), F.desc("whole_line"))
    return ordered.mapInArrow(lean(runs), "doc_id long, txt long, start long, end long, n_words long, whole_line boolean, first_doc_id long, removed boolean")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed spans cut out of the text; texts that lose all their words go.

    Texts without removed spans take no part in the join: a bitmap of fixed size tells them apart.
    """
    id_, txt, cut_, cuts_ = (unused(docs, n) for n in ("_id", "_txt", "_cut", "_cuts"))
    spans = duplicate_spans(docs, id_col, text_col).where("removed").select(F.col("doc_id").alias(id_), F.col("txt").alias(txt), "start", "end").checkpoint()
    hit = jaccard.bitmap(spans.select(id_), lambda batch: [textops.mix(batch.column(0).to_numpy().view(textops.U))], jaccard.CELLS, lambda c: c > 0)
    marks = docs.sparkSession.sparkContext.broadcast(hit)
    named = docs.withColumn(id_, F.col(id_col).cast("long"))
    cuts = spans.groupBy(id_, txt).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts_))

    def split(batches):
        for batch in batches:
            for part in textops.chunks(batch, text_col):
                ids = part.column(part.schema.get_field_index(id_))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                at = part.schema.get_field_index(text_col)
                keys = text_keys(pa.RecordBatch.from_arrays([part.column(at)], ["text"]))
                cut = known & jaccard.has(marks.value, textops.mix(ids.view(textops.U)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys), pa.array(cut)], [*part.schema.names, txt, cut_])

    extra = [StructField(txt, LongType()), StructField(cut_, BooleanType())]
    marked = named.mapInArrow(lean(split), StructType([*named.schema.fields, *extra]))

    def shorten(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, cuts = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index(cuts_)).to_pylist()
            out, keep = [], []
            for text, own in zip(texts, cuts, strict=True):
                if own and text:
                    raw, last, left = text.encode(), 0, []
                    for span in own:
                        left.append(raw[last : max(span["start"], last)])
                        last = max(last, span["end"])
                    left.append(raw[last:])
                    lines = [x for x in b"".join(left).decode().split("\n")]
                    text = "\n".join(x.strip(" ") for x in lines if x.strip())
                out.append(text)
                keep.append(not own or bool(text))
            cols = list(batch.columns)
            cols[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    joined = marked.where(F.col(cut_)).join(cuts, [id_, txt], "left")
    cleaned = joined.mapInArrow(lean(shorten), joined.schema).select(*docs.columns)
    return marked.where(~F.col(cut_)).select(*docs.columns).union(cleaned)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """All occurrences of repeated passages, without the internal text hash."""
    return duplicate_spans(docs).drop("txt")
