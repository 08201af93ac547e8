"""Byte-pair encoding with word ends (operators 2 and 7), by heap and linked list.

Each pre-token starts as one symbol a byte, the last marked as a word end. A heap holds the merge
rank and place of every adjacent pair; a doubly linked list joins the symbols that are left. The
lowest pair is popped, skipped if either side has changed since it was pushed, and merged; its new
neighbours are pushed. Counting does the same and only counts merges: symbols less merges.

Words repeat, so each worker keeps bounded tables from words to results (``TABLE`` entries of words of up
to ``LONG`` letters, some 100 MB at most, emptied when full); this changes no result. The text is split at white space before any other step, which
is exact because no pre-token and no composition in NFC spans white space.

Code points that Unicode had not assigned by version 15 may be taken for other kinds than in the library.
Null texts count as empty. Special strings inside a text become their own single token, as the
tokenizers library does by default. Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.session import lean

TABLE, LONG = 400_000, 64
DEFAULT = "word_bpe_49k.json"
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def vocabulary(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 letters stand
    for themselves, the others for the letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Table(dict):
    """A bounded memo of a function of one word; words over ``LONG`` letters are not kept."""

    def __init__(self, make, most: int = TABLE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class WordBpe:
    """The vocabulary file of a BPE with word ends, as the tokenizers library reads it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.plain = [vocab[c] for c in letters]
        self.ending = [vocab[c + end] for c in letters]
        self.rank, self.left, self.right, self.made = {}, [], [], []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s.encode() for s, i in (vocab | self.special).items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.piece_ids, self.piece_counts = Table(self.piece), Table(self._piece_count)
        self.word_ids, self.word_counts, self.word_both = Table(self._word_ids), Table(self._word_count), Table(self._word_both)

    def merged(self, raw: bytes) -> tuple[list[int], list[int], int]:
        """Symbols by place, the next place of each (the last: the length), and the number of merges.
        An entry of the heap is rank << 32 | place, so equal ranks come from left to right."""
        n = len(raw)
        plain, rank, left, right = self.plain, self.rank.get, self.left, self.right
        symbol = [plain[b] for b in raw]
        symbol[-1] = self.ending[raw[-1]]
        symbol.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap, last = [], symbol[0]
        for i in range(1, n):
            this = symbol[i]
            found = rank(last << 20 | this)
            if found is not None:
                heap.append(found << 32 | i - 1)
            last = this
        heapify(heap)
        done = 0
        while heap:
            found = heappop(heap)
            i, found = found & 0xFFFFFFFF, found >> 32
            j = after[i]
            if symbol[i] != left[found] or symbol[j] != right[found]:
                continue  # stale
            done += 1
            symbol[i] = new = self.made[found]
            symbol[j] = -2
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = rank(new << 20 | symbol[k])
                if found is not None:
                    heappush(heap, found << 32 | i)
            h = before[i]
            if h >= 0:
                found = rank(symbol[h] << 20 | new)
                if found is not None:
                    heappush(heap, found << 32 | h)
        return symbol, after, done

    def piece(self, piece: str) -> bytes:
        """The ids of one lower-case pre-token."""
        symbol, _, _ = self.merged(piece.encode())
        return array("I", [x for x in symbol if x >= 0]).tobytes()

    def _piece_count(self, piece: str) -> int:
        raw = piece.encode()
        return len(raw) - self.merged(raw)[2]

    @staticmethod
    def lowered(word: str) -> str:
        """Lower case letter by letter: a capital sigma gives the same letter everywhere."""
        return word.replace("Σ", "σ").lower()

    def _word_ids(self, word: str) -> bytes:
        ids, low = self.piece_ids, self.lowered(word)
        if low.isalpha():
            return ids[low]
        return b"".join([ids[p] for p in self.pieces(low)])

    def _word_count(self, word: str) -> int:
        count, low = self.piece_counts, self.lowered(word)
        if low.isalpha():
            return count[low]
        return sum([count[p] for p in self.pieces(low)])

    def _word_both(self, word: str) -> tuple[bytes, bytes]:
        ids = self._word_ids(word)
        return ids, b" ".join([self.strings[i] for i in array("I", ids)])

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """The text in order: special tokens as (id, []), what stands between them as (None, words)."""
        at = 0
        if "<|" in text:
            for m in self.specials.finditer(text):
                yield None, self.words(text[at : m.start()])
                yield self.special[m.group()], []
                at = m.end()
        yield None, self.words(text[at:] if at else text)

    @staticmethod
    def words(text: str) -> list[str]:
        if text.isascii():
            if not _ODD_SPACE.search(text):
                return text.split()
        else:
            text = unicodedata.normalize("NFC", text)
            if not _ODD_SPACE.search(text):
                return text.split()
        return [w for w in _SPACE.split(text) if w]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.joined(self.parts(text))

    def joined(self, parts) -> bytes:
        get = self.word_ids.__getitem__
        return b"".join([np.uint32(i).astype("<u4").tobytes() if i is not None else b"".join(map(get, words)) for i, words in parts])

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """The ids and the decoded text: the vocabulary strings of all ids, a space between each two."""
        ids, out = [], []
        get = self.word_both.__getitem__
        for i, words in self.parts(text):
            if i is not None:
                ids.append(np.uint32(i).astype("<u4").tobytes())
                out.append(self.strings[i])
            elif words:
                a, b = zip(*map(get, words), strict=True)
                ids.extend(a)
                out.extend(b)
        return b"".join(ids), b" ".join([x for x in out if x])

    def decode(self, ids) -> str:
        return b" ".join([self.strings[int(i)] for i in ids]).decode()

    def merged_together(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (each row's at its left) and their number for pieces of equal length, a row each."""
        if not hasattr(self, "pair_keys"):
            pairs = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
            self.pair_order = np.argsort(pairs)
            self.pair_keys = pairs[self.pair_order]
            self.pair_made = np.array(self.made)
        none = len(self.pair_keys)

        def ranks(a, b):
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), none - 1)
            return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_order[at], none)

        symbol = np.array(self.plain)[raw]
        symbol[:, -1] = np.array(self.ending)[raw[:, -1]]
        count = np.full(len(raw), raw.shape[1])
        if raw.shape[1] == 1:
            return symbol, count
        out = symbol.copy()
        rows, rank = np.arange(len(raw)), ranks(symbol[:, :-1], symbol[:, 1:])
        while len(rows):
            at = rank.argmin(1)
            each = np.arange(len(rows))
            best = rank[each, at]
            done = best == none
            if done.any():
                out[rows[done], : symbol.shape[1]] = symbol[done]
                live = ~done
                rows, symbol, rank, at, best = rows[live], symbol[live], rank[live], at[live], best[live]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            count[rows] -= 1
            symbol[each, at] = self.pair_made[best]
            column = np.arange(symbol.shape[1] - 1)
            symbol = np.where(column > at[:, None], symbol[:, 1:], symbol[:, :-1])
            if symbol.shape[1] == 1:
                out[rows, :1] = symbol
                break
            rank = np.where(column[:-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            inner = at < symbol.shape[1] - 1
            i = np.flatnonzero(inner)
            rank[i, at[i]] = ranks(symbol[i, at[i]], symbol[i, at[i] + 1])
            i = np.flatnonzero(at > 0)
            rank[i, at[i] - 1] = ranks(symbol[i, at[i] - 1], symbol[i, at[i]])
        return out, count

    def count(self, text: str) -> int:
        get = self.word_counts.__getitem__
        return sum([1 if i is not None else sum(map(get, words)) for i, words in self.parts(text)])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder a worker; its tables last over the tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(1).to_pylist()]


def bpe_encode(docs: DataFrame, vocab: str | None = None, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    ``keep`` adds the ids (binary, little-endian unsigned 32-bit) and the decoded text. ``vocab`` is
    the path of the vocabulary file; default: ``vocabulary()`` on each worker. One pass, no shuffle.
    """

    def run(batches):
        bpe = load(vocab or vocabulary())
        for batch in batches:
            rows = [bpe.encode_decode(x) for x in _texts(batch)]
            cols = [batch.column(0), pa.array([len(a) // 4 for a, _ in rows], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for _, b in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols += [pa.array([a for a, _ in rows], pa.binary()), pa.array([b.decode() for _, b in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)


def token_counts(docs: DataFrame, vocab: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every text: (doc_id, n_bytes, n_tokens, over_limit). One pass, no shuffle."""

    def run(batches):
        bpe = load(vocab or vocabulary())
        for batch in batches:
            texts = _texts(batch)
            n = np.array([bpe.count(x) for x in texts], np.int64)
            size = np.array([len(x.encode()) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
