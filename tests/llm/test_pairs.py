import glob
import math
import os
import random
import re
import tempfile
import zlib
from itertools import combinations

import numpy as np
import pytest
from tests.llm.fixtures import documents, prose

from lattica.llm import graph, jaccard, paragraphs, textops
from lattica.llm.session import prepared

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, n):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def brute(rows, n, num, den):
    """doc_id -> (set size, smallest linked id)."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        both = len(x & y)
        if x and y and den * both >= num * (len(x) + len(y) - both):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, n, num):
    docs = documents(prepared(spark))
    out = jaccard.ngram_join(docs, n, num, 100)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert out.count() == len(rows)
    assert answer(out) == brute(rows, n, num, 100)
    assert out.where("doc_id is null and component_id is not null").count() == 0


def test_every_link_is_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SUB", 4)  # families are split into pairs of sub-blocks
    docs = documents(prepared(spark))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets.setdefault(i, []).append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    flat = [(i, s) for i, own in sets.items() if i is not None for s in own]
    want = sorted((i, sum(1 for k, (_, b) in enumerate(flat) if k != at and a and b and 100 * len(a & b) >= 85 * len(a | b))) for at, (i, a) in enumerate(flat))
    got = jaccard.ngram_join(docs, 4, 85, 100, every=True).collect()
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == want
    assert all(r.n_links is None for r in got if r.doc_id is None) and max(n for _, n in want) > 5
    plain = jaccard.ngram_join(docs, 4, 85, 100)
    assert sorted(map(str, plain.collect())) == sorted(str(r) for r in jaccard.ngram_join(docs, 4, 85, 100, every=True).drop("n_links").collect())


def test_families_larger_than_a_short_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 4)
    monkeypatch.setattr(jaccard, "SUB", 6)
    rng = random.Random(5)
    words = prose(rng, 70).split(" ")
    rows = []
    for i in range(40):
        own = list(words)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = prose(rng, 1)
        rows.append((i, " ".join(own)))
    rows += [(100 + i, prose(rng, 60)) for i in range(20)]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    assert answer(jaccard.ngram_join(docs, 4, 85, 100)) == brute(rows, 4, 85, 100)


def stock_lines(rng, docs):
    """Texts that link with nothing but a changed copy, each with two of few lines that many texts share."""
    stock = [prose(rng, 12) for _ in range(12)]
    rows = []
    for i in range(docs):
        rows.append((i, "\n".join([prose(rng, 270), *rng.sample(stock, 2)])))
    for i in range(0, docs, 40):
        words = rows[i][1].split(" ")
        words[100] = "changed"
        rows.append((docs + i, " ".join(words)))
    return rows


def widest_block(monkeypatch):
    """The sizes of the blocks of a join, as they are found."""
    sizes, real = [], graph.components

    def counted(links):
        found = real(links).checkpoint()
        sizes.append(max((r["count"] for r in found.groupBy("root").count().collect()), default=0))
        return found

    monkeypatch.setattr(jaccard, "components", counted)
    return sizes


def test_lines_that_many_texts_share_do_not_chain_them_under_a_full_sketch(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELLS", 1 << 10)  # as full as the usual one over some GB
    sizes = widest_block(monkeypatch)
    rows = stock_lines(random.Random(31), 600)
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    assert answer(jaccard.ngram_join(docs, 4, 85, 100)) == brute(rows, 4, 85, 100)
    assert 2 <= sizes[0] < 20


def test_pipeline_join_does_not_chain_texts_of_shared_lines(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "CELLS", 1 << 10)
    sizes = widest_block(monkeypatch)
    rows = stock_lines(random.Random(32), 600)
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    want = sorted(i for i, (_, component) in brute(rows, 5, 80, 100).items() if i == component)
    assert sorted(r.doc_id for r in kept.collect()) == want and len(want) == 600
    assert 2 <= sizes[0] < 20


def shuffle_files(spark):
    folders = {spark.conf.get("spark.local.dir", "/tmp"), tempfile.gettempdir(), os.environ.get("SPARK_LOCAL_DIRS", "/tmp")}
    return {f: os.path.getsize(f) for d in folders for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*.data")}


def test_pipeline_join_leaves_no_shuffles_behind(spark):
    import corpus_pipeline

    rng = random.Random(33)
    rows = [(i, prose(rng, 300)) for i in range(600)]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    before = shuffle_files(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    left = sum(n for f, n in shuffle_files(spark).items() if f not in before)
    assert kept.count() == 600
    # the prefixes of all texts are some 600 * 60 rows of 20 bytes; these, the sketch and the sets are used up here
    assert left < 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_wide_blocks_are_copied_a_few_times_only(spark):
    cases = [(1, 300), (256, 80_000), (2560, 500_000), (7600, 2_800_000), (40, 3 << 20), (38_000, 14_000_000), (500_000, 1 << 27)]
    frame = spark.createDataFrame(cases, "c long, s long")
    sub = [r.m for r in frame.select(jaccard.sub_blocks(frame.c, frame.s).alias("m")).collect()]
    assert sub == [1, 1, 10, 16, 3, 16, 16]


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("two", [False, True])
def test_search_by_pieces_equals_search(monkeypatch, every, two):
    rng = np.random.default_rng(34)
    base = [rng.integers(0, 1 << 60, 60, textops.U) for _ in range(6)]
    sets = []
    for i in range(90):
        one = base[i % 6].copy()
        one[rng.integers(0, 60, 3)] = rng.integers(0, 1 << 60, 3, textops.U)
        sets.append(np.unique(one))
    sides = np.arange(90) % 4 // 2 if two else np.zeros(90, int)
    assert len(jaccard.search(sets, sides, 80, 100, every)) > 20
    want = jaccard.search(sets, sides, 80, 100, every)
    monkeypatch.setattr(jaccard, "SUB_SIZE", 500)  # some 8 sets a piece
    got = jaccard.search_pieces(sets, sides, 80, 100, every)

    def joined(links):
        forest = graph.Forest(90)
        for a, b in links:
            forest.join(a, b)
        return [forest.find(x) for x in range(90)]

    assert joined(got) == joined(want)
    if every:
        assert sorted(map(sorted, got)) == sorted(map(sorted, want))
    if two:
        assert all(sides[a] != sides[b] for a, b in got)


def test_counters_are_packed_small():
    rng = np.random.default_rng(35)
    for counts in (np.zeros(64, np.int64), np.arange(64) * 70_000, rng.poisson(0.1, 1 << 16).astype(np.uint16), np.full(4096, 65535, np.uint16)):
        assert (jaccard.unpacked(jaccard.packed(counts), len(counts)) == counts).all()
    sparse = rng.poisson(0.1, 1 << 16).astype(np.uint16)
    assert 2 * len(jaccard.packed(sparse)) < len(zlib.compress(sparse.tobytes(), 1))


def test_empty_table(spark):
    assert jaccard.ngram_join(documents(prepared(spark), empty=True)).count() == 0


def test_divide_skip_finds_all_that_reach_the_need():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(12), rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        need = rng.randint(1, 6)
        count = {m: sum(m in x for x in lists) for m in range(12)}
        found = jaccard.divide_skip(lists, need)
        assert {m for m, c in count.items() if c >= need} <= {m for m, c in found.items()}
        assert all(found[m] == c for m, c in count.items() if c >= need)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 140)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(prepared(spark).createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in up if any(x in e and e[0] != e[1] for e in edges))


def test_words_and_hashes():
    import numpy as np
    import pyarrow as pa

    column = pa.array(["a b\tc", None, "", " é  É ", "a b"])
    data, offs = textops.packed(column.slice(0, 5))
    starts, ends, text = textops.spans(data, offs)
    assert text.tolist() == [0, 0, 0, 3, 3, 4, 4]
    h = textops.hashes(data, starts, ends)
    assert h[0] == h[5] and h[1] == h[6] and len(np.unique(h)) == 5
    old = textops.SEGMENT
    textops.SEGMENT = 2
    try:
        assert (textops.hashes(data, starts, ends) == h).all()
    finally:
        textops.SEGMENT = old


def test_passages_go_and_clean_texts_stay(spark):
    docs = documents(prepared(spark))
    spans = paragraphs.duplicate_spans(docs)
    found = {r.doc_id: r for r in spans.where("whole_line and doc_id between 40 and 43").collect()}
    assert set(found) == {40, 41, 42, 43} and [found[i].removed for i in sorted(found)] == [False, True, True, True]
    before = {(r.doc_id, r.text) for r in docs.collect()}
    after = paragraphs.without_duplicates(docs)
    assert after.columns == docs.columns
    left = after.collect()
    texts = {r.doc_id: r.text for r in left}
    for i in (0, 1, 3, 50, 51, 52, 53, 54, 55, 56, 60):
        assert (i, texts[i]) in before
    assert len(texts[41].split()) == 55 and len(texts[40].split()) == 115
    assert 21 not in texts  # a copy has nothing left
    assert paragraphs.without_duplicates(documents(spark, empty=True)).count() == 0


def test_passage_inside_a_longer_line(spark):
    rng = random.Random(9)
    passage = ". ".join(prose(rng, 12, 99) for _ in range(5)) + "."
    rows = [(i, prose(rng, 40, 7) + ". " + passage + " " + prose(rng, 30, 7)) for i in range(3)] + [(9, prose(rng, 100, 7))]
    spans = paragraphs.duplicate_spans(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    for i, text in rows:
        cut = sum(s.end - s.start for s in spans if s.doc_id == i and s.removed)
        assert (cut > 0.8 * len(passage)) == (i in (1, 2))


def test_minhash_bands_collide_at_the_threshold():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    hit = total = 0
    for _ in range(40):
        words = prose(rng, 60, 99).split(" ")
        near = list(words)
        near[20] = "swap"
        sets = [shingles(" ".join(w), 5) for w in (words, near)]
        assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
        units = paragraphs.Units(*textops.packed(pa.array([" ".join(words), " ".join(near)])))
        bands = units.bands(units.line)
        hit += bool((bands[0] == bands[1]).any())
        total += 1
    assert hit == total
    assert np.unique(bands).size > paragraphs.BANDS


def test_near_copies_of_a_paragraph(spark):
    rng = random.Random(8)
    words = prose(rng, 70, 99).split(" ")
    near = list(words)
    near[30] = "swap"
    rows = [(1, " ".join(words)), (2, "Other line here.\n" + " ".join(near)), (3, prose(rng, 70, 99))]
    spans = paragraphs.substring_dedup(prepared(spark).createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.doc_id, s.first_doc_id, s.removed) for s in spans] == [(1, 1, False), (2, 1, True)]


def _cut(spark, rows):
    """Words that are removed from each text, and the spans."""
    spans = paragraphs.duplicate_spans(prepared(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    return {i: sum(s.n_words for s in spans if s.doc_id == i and s.removed) for i, _ in rows}, spans


def test_one_sentence_as_a_line_and_inside_a_line(spark):
    rng = random.Random(12)
    sentence = prose(rng, 55, 99) + "."
    rows = [(1, prose(rng, 30, 99) + ".\n" + sentence + "\n" + prose(rng, 30, 99) + "."), (2, prose(rng, 30, 99) + ". " + sentence + " " + prose(rng, 30, 99) + "."), (3, prose(rng, 60, 99))]
    cut, _ = _cut(spark, rows)
    assert cut[1] == cut[3] == 0 and cut[2] >= 50


def test_passage_inside_a_line_that_stays(spark):
    rng = random.Random(13)
    passage = ". ".join(prose(rng, 12, 99) for _ in range(5)) + "."
    line = prose(rng, 40, 7) + ". " + passage + " " + prose(rng, 40, 7) + "."
    rows = [(1, prose(rng, 40, 7) + ". " + passage + " " + prose(rng, 40, 7) + "."), (2, line), (3, line), (4, prose(rng, 90, 7))]
    cut, spans = _cut(spark, rows)
    assert cut[1] == cut[4] == 0 and 55 <= cut[2] <= 66 and cut[3] == len(line.split())
    assert {s.first_doc_id for s in spans if s.doc_id == 2 and s.removed} == {1}


def test_runs_of_words_without_sentences(spark):
    rng = random.Random(14)
    run = prose(rng, 60, 99).split(" ")
    long = prose(rng, 101, 99).split(" ")
    edited = [*long[:50], "changed", *long[51:]]
    lone = [prose(rng, 60, 99) for _ in range(8)]
    rows = [(1, f"{lone[0]} {' '.join(run)} {lone[1]}"), (2, f"{lone[2]} {' '.join(run)} {lone[3]}"), (6, f"{lone[4]} {' '.join(long)} {lone[5]}"), (7, f"{lone[5][::-1]} {' '.join(edited)} {lone[4][::-1]}")]
    rows += [(4, "\n".join(" ".join(run[k : k + 12]) for k in range(0, 60, 12)) + "\n" + lone[6]), (5, lone[7])]
    cut, _ = _cut(spark, rows)
    assert cut[1] == cut[5] == 0 and 36 <= cut[2] <= 60 and 25 <= cut[4] <= 60 and cut[6] == 0 and 60 <= cut[7] <= 100


def test_parts_do_not_follow_the_batch():
    import pyarrow as pa

    rng = random.Random(15)
    texts = [prose(rng, n, 7) for n in (1, 3, 200, 5, 90)] + ["same " * 50, "a. b. c. d. e. f. g. h. i. j."]
    both = paragraphs.Units(*textops.packed(pa.array(texts)))
    sizes = both.part[1] - both.part[0]
    assert sizes.min() > paragraphs.RADIUS and (both.text[both.part[0]] == both.text[both.part[1] - 1]).all()
    together = sorted(both.keys(both.part, 0).tolist())
    alone = [paragraphs.Units(*textops.packed(pa.array([t]))) for t in texts]
    assert together == sorted(k for u in alone for k in u.keys(u.part, 0).tolist())


def test_bands_are_tuned():
    for similarity, recall in ((0.8, 0.999), (0.7, 0.99), (0.9, 0.9999)):
        bands, rows = paragraphs.tuned(similarity, recall, 64)
        assert bands * rows <= 64 and 1 - (1 - similarity**rows) ** bands >= recall
        more = math.ceil(math.log(1 - recall) / math.log(1 - similarity ** (rows + 1)))
        assert more * (rows + 1) > 64


def test_near_lines_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(25):
        words = prose(rng, rng.randint(24, 90)).split(" ")
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(["alpha", "beta", "gamma"])
            rows.append((len(rows), " ".join(copy)))
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    shingled = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in rows)}
    similar = {(a, b) for a in shingled for b in shingled if a < b and 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b])}
    gone = {r.doc_id for r in paragraphs.substring_dedup(docs).where("whole_line and removed").collect()}
    want = {b for _, b in similar}
    assert len(want) > 15 and len(gone & want) >= 0.99 * len(want) and gone <= want


def test_passages_inside_lines_with_a_word_changed(spark):
    rng = random.Random(22)
    rows, planted = [], []
    for n in range(30):
        words = prose(rng, 70).split(" ")
        for k in range(3):
            own = list(words)
            if k:
                own[rng.randrange(10, 60)] = "changed"
            planted.append(len(rows))
            rows.append((len(rows), prose(rng, 25) + " " + " ".join(own) + " " + prose(rng, 25)))
    rows += [(1000 + i, prose(rng, 150)) for i in range(100)]
    docs = prepared(spark).createDataFrame(rows, "doc_id long, text string")
    spans = paragraphs.substring_dedup(docs).where("removed").collect()
    cut = {}
    for r in spans:
        cut[r.doc_id] = cut.get(r.doc_id, 0) + r.n_words
    later = [i for i in planted if i % 3]
    assert sum(cut.get(i, 0) >= 35 for i in later) >= 0.9 * len(later)
    assert not any(i >= 1000 or i % 3 == 0 for i in cut)
