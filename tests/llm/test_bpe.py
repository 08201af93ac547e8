import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import documents, texts
from tokenizers import Tokenizer

from lattica.llm import bpe, flat, packing
from lattica.llm.session import prepared

LIBRARY = Tokenizer.from_file(bpe.vocabulary())
ALPHABET = st.sampled_from(["the", "THE", "don't", "'s", "'", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "ΑΣ", "İ", "é", "́", "\x1c", "\x85", "​", "½", "²", "漢字", "🙂", " ", "\n", "　", "12", "_", "\x00", "ﬁ"])

LATIN = st.sampled_from(["À", "Þ", "ß", "ÿ", "÷", "×", "Æ", "ñ", "à", "a9", "1½", "<", "|", "<|", "ab<|c", "e\u0301", "Ÿ", "'S", "n't", "--", "a.b", "Ö.", "\u00a0"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=12).map("".join))
def test_ids_equal_the_library(text):
    own, want = bpe.load(bpe.vocabulary()), LIBRARY.encode(text, add_special_tokens=False).ids
    ids, decoded = own.encode_decode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == LIBRARY.decode(want, skip_special_tokens=False) == own.decode(want)
    assert own.count(text) == len(want)
    fresh = bpe.WordBpe(bpe.vocabulary()) if len(text) > 60 else own
    assert fresh.encode(text) == ids


def in_flat_arrays(encoder, rows):
    ids, cut = encoder.encode(pa.array(rows, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(ALPHABET | LATIN | st.text(st.characters(exclude_categories=['Cs', 'Cn']), max_size=6), max_size=12).map("".join) | st.none(), max_size=5))
def test_flat_arrays_equal_the_library(rows):
    small = flat.FlatEncoder(bpe.load(bpe.vocabulary()), most=2000)  # emptied again and again
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert in_flat_arrays(flat.loaded(bpe.vocabulary()), rows) == want == in_flat_arrays(small, rows) == in_flat_arrays(small, rows)


def test_flat_arrays_over_prose_and_long_words():
    rows = [t for _, t in texts(3)] + ["x" * 5000, "ab" * 30 + "é" * 40, "aÀÞßÿ÷×é9'9"]
    assert in_flat_arrays(flat.loaded(bpe.vocabulary()), rows) == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_operators_over_odd_rows(spark):
    docs = documents(prepared(spark))
    rows = bpe.bpe_encode(docs).collect()
    counts = {(r.doc_id, r.n_bytes): r for r in bpe.token_counts(docs, limit=100).collect()}
    source = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) == len(source)
    by_id = {r.doc_id: r for r in rows}
    for i, text in source:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        r = by_id[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == LIBRARY.decode(ids, skip_special_tokens=False) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        c = counts[i, len((text or "").encode())]
        assert c.n_tokens == len(ids) and c.over_limit == (len(ids) > 100)
    assert bpe.bpe_encode(documents(spark, empty=True)).count() == 0
    assert bpe.token_counts(documents(spark, empty=True)).count() == 0


@pytest.mark.parametrize("sizes", [[5, 4, 3, 3, 3], [1] * 17, [2047, 2, 2047], [1400] * 9, [9], list(range(1, 60))])
def test_windows_hold_everything_within_capacity(sizes):
    groups = packing.windows(sizes, 2048)
    parts = sorted(p for g in groups for p in g)
    for i, size in enumerate(sizes):
        own = [(first, n) for j, first, n in parts if j == i]
        assert all(n > 0 for _, n in own) and sum(n for _, n in own) == size
        assert [first for first, _ in own] == [sum(n for _, n in own[:x]) for x in range(len(own))]
    assert all(sum(n for _, _, n in g) <= 2048 for g in groups)
    assert len(groups) <= -(-sum(sizes) // 2048)


def plain_differencing(sizes, k):
    """Karmarkar-Karp with lists of (sum, members), the two partitions of the largest spread first."""
    parts = [(0, i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    parts = [(p[0][0] - p[-1][0], n, p) for _, n, p in parts]
    serial = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda x: (-x[0], x[1]))
        (_, _, a), (_, _, b), *parts = parts
        both = sorted([(x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1], strict=True)], key=lambda z: -z[0])
        low = both[-1][0]
        both = [(x - low, p) for x, p in both]
        serial += 1
        parts.append((both[0][0], serial, both))
    return sorted(sorted(p) for _, p in parts[0][2])


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing_equals_brute_force(k):
    rng = np.random.default_rng(k)
    for n in (1, 2, 5, 17, 40):
        sizes = rng.integers(1, 50, n).tolist()
        assert sorted(packing.differencing(sizes, k)) == plain_differencing(sizes, k)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(10, 900, 200).tolist()
    sums = [sum(sizes[i] for i in g) for g in packing.differencing(sizes, 20)]
    assert max(sums) - min(sums) < 40


def test_packing_holds_every_id_once(spark):
    docs = documents(prepared(spark)).coalesce(2)
    pieces = packing.pack(docs, keep=True).collect()
    want = [np.array([*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()]
    found = {}
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        found.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.ids))
    assert sum(p.length for p in pieces) == sum(map(len, want))
    joined = {}
    for r, ids in zip(docs.collect(), want, strict=True):
        joined.setdefault((r.doc_id, len(ids)), []).append(ids.tobytes())
    for key, parts in found.items():
        parts.sort()
        copies = len(joined[key])
        assert b"".join(x for _, x in parts[::copies]) == joined[key][0]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents(spark, empty=True)).count() == 0


def test_padding_and_cut_pieces(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), " ".join(["the"] * int(n))) for i, n in enumerate(rng.integers(0, 3000, 900))] + [(5000, "the " * 20_000)]
    pieces = packing.pack(prepared(spark).createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    total = sum(len(t.split()) + 1 for _, t in rows)
    assert sum(p.length for p in pieces) == total
    assert len({p.sequence_id for p in pieces}) <= total / 2048 + 1
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    for parts in by_doc.values():
        at = 0
        for start, length, doc_tokens in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == doc_tokens
