import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.fixtures import documents

from lattica.llm import sharding, topk
from lattica.llm.session import prepared

MASK = (1 << 64) - 1


def table(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(-50, 400)]
    rows += [(500, [0.25] * 8), (501, [0.25] * 8), (502, [0.25] * 8), (550, None), (600, [1.0, None]), (650, [float("nan")] * 8), (700, [float("inf")] * 8), (None, [9.0] * 8), (750, []), (800, [1.0, -2.0]), (0, rows[50][1])]
    return prepared(spark).createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, every, k):
    held = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((i, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for q, v in held:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in held if i != q)[:k]
            out.append((q, [(-s, i) for s, i in scored]))
    return out


def test_top_k_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark).collect()]
    want = {q: v for q, v in brute(rows, 50, 5) if q != 0}
    for block in (8192, 60):
        got = {}
        for r in topk.top_k(table(spark).selectExpr("*", "1 as v", "2 as block", "3 as score"), block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
        assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items() if q != 0} == want
        assert all(sorted(n for n, _, _ in v) == list(range(1, len(v) + 1)) for v in got.values())


def test_top_k_of_few_and_none(spark):
    rows = prepared(spark).createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(rows).collect()] == [(0, 1, 256 * 512)]
    assert topk.top_k(rows.limit(0)).count() == 0
    assert topk.top_k(rows.where("vec_id = 0")).count() == 0


def test_large_values_stay_exact(spark):
    rows = prepared(spark).createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(rows).orderBy("rank").collect()]
    big = 256 * 10**6
    assert got == [(1, 2, big * big + 768 * 512), (2, 1, big * big + 768 * 256)]


def draw(key, child, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest((key & MASK).to_bytes(8, "little"), 42)
    bits = xxhash.xxh64_intdigest(child.encode(), seed)
    return -np.log(((bits >> 11) + 1) / 2.0**53) / weight


def place(key, shards):
    regions = sharding.tree(shards)
    drawn = {s: draw(key, f"shard {s}", 1) for s in range(shards)}
    of_rack = lambda rack: min((drawn[s], s) for s in rack)
    region = min(regions.values(), key=lambda racks: min(map(of_rack, racks.values())))
    return of_rack(min(region.values(), key=of_rack))[1]


def test_shards_equal_brute_force(spark):
    docs = documents(prepared(spark))
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(((r.text or "")))
    for r in rows:
        assert r.shard == place(r.doc_id, 8) and r.grown_shard == place(r.doc_id, 9) and r.law == "key"
        assert (r.size, r.text_crc32) in {(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]}
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(documents(spark, empty=True)).count() == 0


def test_growth_moves_rows_into_the_new_shard_only(spark):
    ids = prepared(spark).range(20000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard(ids).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    sizes = np.bincount([r.shard for r in rows], minlength=8)
    assert sizes.min() > 0.9 * 2500 and sizes.max() < 1.1 * 2500
    assert abs(sum(r.grown_shard == 8 for r in rows) - 20000 / 9) < 200


@pytest.mark.parametrize("shards", range(8, 16))
def test_every_growth_moves_rows_into_the_new_shard_only(spark, shards):
    ids = prepared(spark).range(4000).select(sharding.place(F.col("id"), shards).alias("a"), sharding.place(F.col("id"), shards + 1).alias("b")).collect()
    assert all(r.b in (r.a, shards) for r in ids)
    assert abs(sum(r.b == shards for r in ids) - 4000 / (shards + 1)) < 90


def test_a_weight_changes_one_shard_only(spark):
    key = F.col("id")
    ids = prepared(spark).range(9000).select(sharding.place(key, 8).alias("a"), sharding.place(key, 8, {3: 2.0}).alias("b"), sharding.place(key, 8, {5: 0.5}).alias("c")).collect()
    assert all(r.b in (r.a, 3) for r in ids) and all(r.c == r.a or r.a == 5 for r in ids)
    assert abs(sum(r.b == 3 for r in ids) - 2000) < 150 and abs(sum(r.c == 5 for r in ids) - 600) < 90


def test_slots_without_the_broadcast(spark, monkeypatch):
    docs = documents(prepared(spark))
    want = sorted(map(str, sharding.shard(docs).collect()))
    monkeypatch.setattr(sharding, "FEW", 0)
    assert sorted(map(str, sharding.shard(docs).collect())) == want


def test_main_path_is_native(spark):
    plan = sharding.shard(documents(prepared(spark)))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
