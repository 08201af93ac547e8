import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.fixtures import documents, prose, texts

from lattica.llm import labelled, quality, rules, textops, toxicity
from lattica.llm.session import prepared

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def base(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(rb"[#*$%&|<>]", raw)), dup, len(covered)


ODD = ["", None, " \n\n ", "a b c a b c", "x\nx\nx\n x\n\n", "é|é|é <>", "a a a a", "one two three", "l1\r\nl1\r\nl1", "a b\nc a b c"]


def test_base_measures_equal_brute_force():
    rows = ODD + [t for _, t in texts(4)][:20] + [" ".join(random.Random(1).choices("ab", k=200))]
    data, offs = textops.packed(pa.array(rows))
    starts, ends, text = textops.spans(data, offs)
    found = rules.base_measures(data, offs, starts, ends, text, textops.hashes(data, starts, ends))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(found[n][i]) for n in names) for i in range(len(rows))] == [base(t) for t in rows]


def test_rules_operator(spark):
    docs = documents(prepared(spark))
    rows = {(r.doc_id, r.n_words): r for r in rules.quality_rules(docs).collect()}
    for r in docs.collect():
        n, chars, symbols, dup, repeat = base(r.text)
        got = rows[r.doc_id, n]
        assert (got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (chars, symbols, dup, repeat)
        assert got.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert got.kept in (False, not got.base_failed)
    assert rules.quality_rules(documents(spark, empty=True)).count() == 0
    kept = rules.passing(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rules.quality_rules(docs).collect())


def stream(text):
    """What the model reads of a text: its words, a space after each; and the spaces before it."""
    return b" " * (rules.ORDER - 1), b"".join(w + b" " for w in WORD.findall((text or "").encode()))


def brute_force(rows):
    """Log perplexities by a plain modified Kneser-Ney model, level by level."""
    counts = {n: {} for n in range(1, rules.ORDER + 1)}
    for t in rows:
        before, own = stream(t)
        for i in range(len(own)):
            gram = (before + own)[i : i + rules.ORDER]
            counts[rules.ORDER][gram] = counts[rules.ORDER].get(gram, 0) + 1
    for n in range(rules.ORDER - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] = counts[n].get(gram[1:], 0) + 1
    cut = {n: rules.discounts([sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    after = {n: {} for n in counts}
    for n, table in counts.items():
        for gram, c in table.items():
            after[n].setdefault(gram[:-1], []).append(c)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        seen, d = after[n].get(gram[:-1]), cut[n]
        if not seen:
            return p(gram[1:])
        c = counts[n].get(gram, 0)
        return ((c - d[min(c, 3) - 1] if c else 0) + sum(d[min(x, 3) - 1] for x in seen) * p(gram[1:])) / sum(seen)

    out = []
    for t in rows:
        before, own = stream(t)
        logs = [np.log(p((before + own)[i : i + rules.ORDER])) for i in range(len(own))]
        out.append(-float(np.mean(logs)) if logs else 0.0)
    return out, p, after


def test_perplexity_and_verdict_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [prose(rng, rng.randint(45, 70)) for _ in range(30)] + ["é漢 \x00 z" * 20, "", " \n", prose(rng, 60).upper(), " ".join(rng.choices("qwxz", k=90))] + [None]
    langs = ["en" if i % 3 else None for i in range(len(rows))]
    docs = prepared(spark).createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(rows, langs, strict=True))], "doc_id long, text string, lang string").repartition(3)
    want, p, after = brute_force(rows)
    for context in list(after[rules.ORDER])[:3]:
        assert abs(sum(p(context + bytes([b])) for b in range(256)) - 1) < 1e-9
    found = sorted(rules.quality_rules(docs, low=2.0, high=2.0).collect())
    assert np.allclose([r.log_perplexity for r in found], want, atol=1e-5)
    passed = [(lang, x) for lang, x, r in zip(langs, want, found, strict=True) if not r.base_failed]

    def middle(xs):
        xs = sorted(xs)
        quarter = [xs[max(-(-len(xs) * k // 4) - 1, 0)] for k in (1, 2, 3)]
        return quarter[1], max((quarter[2] - quarter[0]) / 1.349, rules.FLOOR / 4)

    every = middle([x for _, x in passed])
    for lang, x, r in zip(langs, want, found, strict=True):
        own = [y for k, y in passed if k == lang]
        share = len(own) / (len(own) + rules.PRIOR)
        mid, spread = (share * a + (1 - share) * b for a, b in zip(middle(own), every, strict=True))
        inside = abs(x - mid) <= 2.0 * spread * (1 + 1 / len(own)) ** 0.5
        assert r.kept == (not r.base_failed and inside)
    assert any(not r.base_failed and not r.kept for r in found)


def test_shards_change_no_result(spark):
    docs = documents(prepared(spark))
    rows = [docs.collect(), rules.quality_rules(docs).collect(), rules.quality_rules(docs, shard=700).collect()]
    assert rules.fit(docs, shard=700).shards > 3
    one, many = ({(r.doc_id, r.n_words, r.word_chars): r for r in x} for x in rows[1:])
    assert len(rows[1]) == len(rows[2]) == len(rows[0]) and one.keys() == many.keys()
    assert all(one[k].kept == many[k].kept and abs(one[k].log_perplexity - many[k].log_perplexity) < 1e-6 for k in one)
    assert sorted(map(str, rules.passing(docs).collect())) == sorted(map(str, rules.passing(docs, shard=700).collect()))


def test_gram_counts_equal_brute_force(spark):
    rows = [t for _, t in texts(6)][:8] + ["é", "a", None]
    docs = prepared(spark).createDataFrame([(t,) for t in rows] * 2, "text string").repartition(3)
    want = {}
    for t in rows * 2:
        before, own = stream(t)
        for i in range(len(own)):
            key = int.from_bytes((before + own)[i : i + rules.ORDER], "big")
            want[key] = want.get(key, 0) + 1
    assert {r.gram: r.n for r in rules.gram_counts(docs).collect()} == want


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(5)
    long = " ".join(prose(rng, 2000) for _ in range(220))
    assert len(long) > 2 << 20
    docs = prepared(spark).createDataFrame([(1, long, "en"), (2, long[: 1 << 19], "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert got[1].n_words == 220 * 2000 and got[1].word_chars == len(long.replace(" ", ""))
    assert abs(got[1].log_perplexity - got[2].log_perplexity) < 0.05


def test_perplexity_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 90), "en") for i in range(260)]
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(90))
    docs = prepared(spark).createDataFrame([*rows, (900, noise, "en"), (901, noise[::-1].upper(), "xx")], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert not kept[900] and not kept[901]
    assert sum(kept[i] for i in range(260)) >= 258


def test_bands_move_little_with_one_more_text(spark):
    rows = [("en", 2.0 + 0.001 * (i % 100)) for i in range(2000)] + [("xx", 2.5 + 0.001 * (i % 100)) for i in range(200)]

    def band(rows):
        measured = prepared(spark).createDataFrame([(lang, (90, 0, p)) for lang, p in rows], "lang string, _q struct<n_words: long, n_repeat_words: long, log_perplexity: double>")
        return next((r.low, r.high) for r in rules.bands(measured).collect() if r.band_lang == "xx")

    (low, high), (low_less, high_less) = band(rows), band(rows[:-1])
    assert abs(low - low_less) < 0.02 and abs(high - high_less) < 0.02


def test_bands_reject_beyond_their_widths(spark):
    rows = [2.0 + 0.001 * (i % 1000) for i in range(2000)]
    spread = 0.5 / 1.349
    rows += [2.4995 + 4.7 * spread, 2.4995 + 4.3 * spread, 2.4995 - 8.2 * spread, 2.4995 - 7.8 * spread]
    measured = prepared(spark).createDataFrame([(i, "en", (90, 0, p)) for i, p in enumerate(rows)], "doc_id long, lang string, _q struct<n_words: long, n_repeat_words: long, log_perplexity: double>")
    out, verdict = rules.kept(measured, rules.bands(measured))
    assert {r.doc_id: r[verdict] for r in out.where("doc_id >= 2000").collect()} == {2000: False, 2001: True, 2002: False, 2003: True}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labels(spark):
    """Documents whose labels a person could tell: shouting is bad, two words are insults."""
    rng = random.Random(3)
    docs, marks = [], []
    for i in range(400):
        text = prose(rng, rng.randint(20, 120))
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(["grunthog", "wexfool"])
            text = " ".join(words)
        docs.append((i, text, "en"))
        marks.append((i, int(not bad), int(toxic)))
    docs += [(1000, None, "en"), (1001, "", "en"), (None, "no id", None), (5, docs[5][1], "en")]
    marks += [(2000, 1, 0), (3, None, None), (None, 1, 1)]
    s = prepared(spark)
    return s.createDataFrame(docs, "doc_id long, text string, score string"), s.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def accuracy(rows, want, least):
    test = [r for r in rows if r.doc_id in want and held(r.doc_id)]
    assert all(r.held_out == held(r.doc_id) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == want[r.doc_id] for r in test) >= least * len(test)


def test_quality_on_held_out_rows(labels):
    docs, marks, known = labels
    rows = quality.quality_classifier(docs, marks).collect()
    assert len(rows) == docs.count()
    accuracy(rows, {i: q for i, q, _ in known if q is not None and i is not None and i < 400}, 0.95)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_on_held_out_rows(labels):
    docs, marks, known = labels
    rows = toxicity.toxicity(docs, marks).collect()
    assert len(rows) == docs.count()
    accuracy(rows, {i: t for i, _, t in known if t is not None and i is not None and i < 400}, 0.95)


def test_no_labels_and_no_documents(spark, labels):
    docs, marks, _ = labels
    for run in (quality.quality_classifier, toxicity.toxicity):
        assert len({r.score for r in run(docs, marks.limit(0)).collect()}) == 1
        assert run(docs.limit(0), marks).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows(labels):
    docs, marks, known = labels
    found, y, share = labelled.sample(docs, marks, "toxic", 30)
    assert len(found) == len(y) <= 60 and 0 < share < 1
    train = {t for i, t, _ in docs.collect() if i is not None and not held(i)}
    assert set(found) <= train


def kernel(s, t):
    """The subsequence kernel by listing all subsequences."""
    from itertools import combinations

    def weights(x):
        out = {}
        for at in combinations(range(len(x)), toxicity.P):
            key = bytes(x[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.LAMBDA ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_subsequence_kernel_equals_brute_force():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 10))) for _ in range(60)]
    left, right = toxicity.padded(words[:30], toxicity.SPAN), toxicity.padded(words[30:], toxicity.MOST)
    got = toxicity.kernels(left, np.array([len(w) for w in words[:30]]), right, None)
    want = [kernel(a, b) for a, b in zip(words[:30], words[30:], strict=True)]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6)


def units_of(rows):
    data, offs = textops.packed(pa.array(rows))
    units, sizes, starts, text = toxicity.unit_rows(textops.LOWER[data], offs)
    assert all((u[n:] == 0).all() and (u[:n] > 0).all() for u, n in zip(units, sizes, strict=True))
    return [{units[i, : sizes[i]].tobytes() for i in np.flatnonzero(text == t)} for t in range(len(rows))]


def test_units_drop_signs_join_letters_and_cover_long_words():
    spaced, signs, long, none = units_of(["you I d - i o t. now", "I.D.I.O.T !!! a b é-x id*iot###", "abcdefghij" * 6, "12 ... | "])
    assert spaced == {b"\1you\2", b"\1i\2", b"\1d\2", b"\1o\2", b"\1t\2", b"\1idiot\2", b"\1now\2"}
    assert signs == {b"\1idiot\2", b"\1a\2", b"\1b\2", "\1éx\2".encode()}
    assert max(map(len, long)) <= toxicity.SPAN and none == set()
    assert all(any((b"abcdefghij" * 6)[i : i + 8] in x for x in long) for i in range(52))


def test_insults_with_signs_gaps_and_letters_inserted():
    rng = random.Random(3)
    texts_, marks = [], []
    for i in range(240):
        words = prose(rng, 60).split(" ")
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(["grunthog", "wexfooler"])
        texts_.append(" ".join(words))
        marks.append(int(i % 4 == 0))
    machine = toxicity.train(texts_, marks, 0.25)
    score = lambda rows: machine.probability(toxicity.strongest(machine, *toxicity._stacked(rows)))
    plain = prose(rng, 30)
    for w in ("grunthog", "wexfooler"):
        forms = [w, w.upper(), w + "###", ".".join(w), "-".join(w), " ".join(w), w[:3] + "*" + w[3:], w[:4] + "x" + w[4:], w[:2] + w[1] * 2 + w[2:], w[:5] + "-" + w[5:]]
        assert (score([f"{plain} {v} {plain}" for v in forms]) >= 0.5).all()
    clean = [prose(rng, 200) for _ in range(20)] + ["".join(rng.choice(["ka", "lo", "mi", "ren", "tas", "vol"]) for _ in range(12)) for _ in range(50)] + ["g r o w", "fool", ""]
    assert (score(clean) < 0.5).mean() > 0.98


def test_the_score_equals_brute_force():
    rng = random.Random(4)
    rows = [prose(rng, 40) + (" grunthog" if i % 3 == 0 else "") for i in range(60)]
    machine = toxicity.train(rows, [int(i % 3 == 0) for i in range(60)], 0.3)
    marks = [m[:n].tobytes() for m, n in zip(machine.landmarks, machine.lengths, strict=True)]

    def answer(unit, mark):
        several = len({c & 63 for c in mark})
        if len({c & 63 for c in mark} & {c & 63 for c in unit}) < min(int(np.ceil(toxicity.LETTERS * several)), several - 1):
            return 0.0
        return min(kernel(unit, mark) / kernel(mark, mark), 1.2) ** toxicity.POWER

    def plain(text):
        best = machine.decide(np.zeros((1, len(marks))))[0]
        for sentence in re.split(r"(?<=[.!?])\s|\n", text):
            units = units_of([sentence])[0]
            features = np.array([[max((answer(u, m) for u in units), default=0.0) for m in marks]])
            best = max(best, machine.decide(features)[0]) if features.any() else best
        return best

    some = [rows[0], rows[1], "Grunt-hog ka. lo grxunthog\nvol", "", "a b"]
    got = toxicity.strongest(machine, *toxicity._stacked(some))
    assert np.allclose(got, [plain(t) for t in some], atol=1e-3)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = quality.Net(3)
    raws = [rng.integers(60, 90, n).astype(np.uint8) for n in (300, 7, 150, 1)]
    data, offs = np.concatenate(raws), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    y, w = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    for k in vars(net):
        if isinstance(getattr(net, k), np.ndarray):
            setattr(net, k, getattr(net, k).astype(np.float64))
    grads, _ = net.gradients(data, offs, y, w)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(data, offs)[0]))
        return -np.log(np.where(y > 0, p, 1 - p)).mean()

    for name in ("filters", "lift", "hidden", "base", "out", "bias"):
        param = getattr(net, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), param.shape)
        param[at] += 1e-3
        up = loss()
        param[at] -= 2e-3
        down = loss()
        param[at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def test_the_network_equals_brute_force():
    net = quality.Net(5)
    rows = ["", "a", "short text", "x" * 127, "y" * 128, "z" * 129, " ".join(prose(random.Random(9), 400) for _ in range(3))]

    def plain(text):
        raw = [*text.encode()]
        acts = []
        for at in range(0, len(raw), quality.STEP):
            under = [raw[at + k] if at + k < len(raw) else quality.PAD for k in range(quality.WIDTH)]
            acts.append(np.maximum(sum(net.filters[k, c] for k, c in enumerate(under)) + net.lift, 0))
        halves = [acts[i : i + quality.HALF] for i in range(0, len(acts), quality.HALF)]
        chunks = [a + b for a, b in zip(halves, halves[1:], strict=False)] or halves
        units = [np.maximum(np.mean(c, 0) @ net.hidden + net.base, 0) for c in chunks]
        return (np.max(units, 0) if units else np.zeros(quality.HIDDEN)) @ net.out + net.bias[0] + net.shift

    got = net.forward(*textops.packed(pa.array(rows)))[0]
    assert np.allclose(got, [plain(t) for t in rows], atol=1e-3)


def test_blocks_change_no_score(monkeypatch):
    net = quality.Net(3)
    rows = [t for _, t in texts(2)]
    want = net.forward(*textops.packed(pa.array(rows)))[0]
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert np.allclose(net.forward(*textops.packed(pa.array(rows)))[0], want, atol=1e-5)


def test_scores_do_not_depend_on_the_batch():
    net = quality.Net(3)
    rows = [t for _, t in texts(2) if t is not None]
    whole = net.forward(*textops.packed(pa.array(rows)))[0]
    single = [net.forward(*textops.packed(pa.array([t])))[0][0] for t in rows]
    assert np.allclose(whole, single, atol=1e-4)
