import random

import corpus_pipeline
from tests.llm.fixtures import prose

from lattica.llm import bpe
from lattica.llm.session import prepared


def corpus(spark, folder):
    rng = random.Random(11)
    rows = [(i, prose(rng, 90), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)]  # copies
    passage = prose(rng, 60)
    rows += [(200 + i, prose(rng, 70) + "\n" + passage, "en", "s", 0) for i in range(3)]
    rows += [(300 + i, prose(rng, 90).upper().replace(" ", "!! "), "en", "s", 0) for i in range(40)]  # shouting
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "too short", "en", "s", 0)]
    labels = [(i, int(not 300 <= i < 400), 0) for i, *_ in rows]
    s = prepared(spark)
    s.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    s.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {i: t for i, t, *_ in rows}


def test_stages_and_run(spark, tmp_path):
    texts = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/stage{n}")
            docs = spark.read.parquet(f"{tmp_path}/stage{n}")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            pieces = out.collect()
    assert not any(300 <= i < 400 for i in kept["quality classifier"])
    assert 402 not in kept["quality rules"] and set(range(60)) <= set(kept["quality rules"])
    assert not any(100 <= i < 105 for i in kept["n-gram Jaccard join"]) and set(range(60)) <= set(kept["n-gram Jaccard join"])
    final = kept["substring dedup"]
    assert [len(final[200 + i].split()) for i in range(3)] == [130, 70, 70]
    assert all(final[i] == texts[i] for i in range(60))
    encoder = bpe.load(bpe.vocabulary())
    assert sum(p.length for p in pieces) == sum(encoder.count(t or "") + 1 for t in final.values())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, whole.collect())) == sorted(map(key, pieces))


def test_stages_equal_their_operators_row_by_row(spark, tmp_path):
    """Each stage against plain Python over what its operator finds (the operators have brute-force tests)."""
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda df: sorted((r.doc_id, r.text or "", r.n_chars) for r in df.collect())
    quality, rules, near, cut = (f for _, f in corpus_pipeline.STAGES[:4])
    step = quality(spark, docs, str(tmp_path)).checkpoint()
    good = {r.doc_id for r in corpus_pipeline.quality.quality_classifier(docs, marks).collect() if r.score >= 0.3}
    assert rows(step) == [r for r in rows(docs) if r[0] in good]
    docs, step = step, rules(spark, step, str(tmp_path)).checkpoint()
    kept = {r.doc_id for r in corpus_pipeline.rules.quality_rules(docs).collect() if r.kept}
    assert rows(step) == [r for r in rows(docs) if r[0] in kept]
    docs, step = step, near(spark, step, str(tmp_path)).checkpoint()
    first = {r.doc_id for r in corpus_pipeline.jaccard.ngram_join(docs).collect() if r.component_id == r.doc_id}
    assert rows(step) == [r for r in rows(docs) if r[0] in first]
    docs, step = step, cut(spark, step, str(tmp_path)).checkpoint()
    want = []
    for i, text, n in rows(docs):
        raw = text.encode()
        gone = set()
        for r in corpus_pipeline.paragraphs.substring_dedup(docs).where(f"removed and doc_id = {i}").collect() if 200 <= i < 203 else []:
            gone |= set(range(r.start, r.end))
        left = bytes(b for at, b in enumerate(raw) if at not in gone).decode()
        left = "\n".join(x.strip(" ") for x in left.split("\n") if x.strip()) if gone else text
        if left or not gone:
            want.append((i, left, len(left) if gone else n if n else len(text)))
    assert [(i, t) for i, t, _ in rows(step)] == [(i, t) for i, t, _ in want]


def test_stages_take_clashing_columns_and_empty_tables(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 as _q", "2 as _score", "'x' as _txt", "3 as low", "4 as cls", "5 as start", "6 as _Kept")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
