from fractions import Fraction

import numpy as np
import pytest

from churnlens.llm import ann, topk

SMALL = dict(shard_rows=40, query_rows=7)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 6)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist()) for i in range(60)]  # one common vector
    rows += [(2001, None), (2002, [0.0] * 6), (2003, [1.0, None] + [0.0] * 4), (2004, [float("nan")] * 6),
             (2005, [float("inf")] + [0.0] * 5), (2006, []), (2007, [1.0, 2.0]), (2008, [2.0, -1.0]), (None, x[5].tolist())]
    return spark.createDataFrame([(*r, "x", 0) for r in rows],
                                 "vec_id long, embedding array<float>, rank string, score int").cache()


def usable(vectors, zero):
    out = []
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(c is None or not np.isfinite(c) for c in v) or not (zero or any(v)):
            continue
        out.append((r.vec_id, np.array(v, float)))
    return out


def brute(rows, score, k):
    want = {}
    for i, q in rows:
        if i % 20 == 0 or i > 2000:
            found = [(-score(q, v), j) for j, v in rows if j != i and len(v) == len(q)]
            want[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return want


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i, rows in got.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, len(rows) + 1))
    return {i: [r[1:] for r in sorted(rows)] for i, rows in got.items()}


def test_factor_one_is_exact(vectors):
    queries = vectors.filter("vec_id % 20 = 0 or vec_id > 2000")
    got = found(ann.nearest_neighbours(vectors, queries, 20, 1.0, **SMALL))
    want = {i: w for i, w in brute(usable(vectors, False), lambda a, b: float((a * b).sum()), 20).items() if w}
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]])


def test_relaxed_factor_keeps_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = found(ann.op4_vptree_ann(spark, sf))
    rows = usable(spark.read.parquet(f"{sf}/embeddings.parquet"), False)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    recall = []
    for i in got:
        s = x @ x[ids == i][0]
        s[ids == i] = -np.inf
        recall.append(len({j for j, _ in got[i]} & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert len(got) == 100 and np.mean(recall) >= 0.9


def test_top_k_is_exact(vectors):
    queries = vectors.filter("vec_id % 20 = 0 or vec_id > 2000")
    got = found(topk.top_k(vectors, queries, 20, **SMALL))
    rows = [(i, np.floor(64 * v)) for i, v in usable(vectors, True)]
    want = {i: w for i, w in brute(rows, lambda a, b: int((a * b).sum()), 20).items() if w}
    assert got == want


def test_repeated_ids_leave_room_for_others(spark):
    rng = np.random.default_rng(9)
    common = [3.0, -2.0, 1.0, 0.5]
    rows = [(20, common)] * 30 + [(i, common) for i in (*range(500, 510), *[7] * 25)]
    rows += [(40, v.tolist()) for v in (5 + rng.random((60, 4))).round(2)]  # many vectors of one id
    rows += [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 4)).round(2), 100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = {i: min(v for j, v in rows if j == i) for i in (20, 40, 100)}
    for sizes in ({}, SMALL):
        near = found(ann.nearest_neighbours(df, df.filter("vec_id in (20, 40, 100)"), 20, 1.0, **sizes))
        top = found(topk.top_k(df, df.filter("vec_id in (20, 40, 100)"), 20, **sizes))
        for i, q in asks.items():
            others = [(j, np.float32(v).astype(float)) for j, v in rows if j != i]
            q = np.float32(q).astype(float)
            want = sorted((-float((q * v).sum()), j) for j, v in others)[:20]
            assert [j for j, _ in near[i]] == [j for _, j in want]
            assert np.allclose([s for _, s in near[i]], [-s for s, _ in want])
            scaled = [(-int(np.floor(64 * q) @ np.floor(64 * v)), j) for j, v in others]
            assert top[i] == [(j, -s) for s, j in sorted(scaled)[:20]]


def test_top_k_of_vectors_of_any_size(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(240, 4)) * 10.0 ** rng.integers(-1, 9, (240, 1))
    x[:4] *= 1e20  # scores beyond a long
    x[4:8] = x[8]  # ties
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[8].tolist())] * 25
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    scaled = [(i, [(Fraction(c) * 64).__floor__() for c in v]) for i, v in rows]
    for sizes in ({}, SMALL):
        got = found(topk.top_k(df, df.filter("vec_id < 20 or vec_id % 20 = 0"), 20, **sizes))
        for i, q in dict(scaled).items():
            if i < 20 or i % 20 == 0:
                want = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in scaled if j != i)[:20]
                assert got[i] == [(j, -s if -2**63 <= -s < 2**63 else None) for s, j in want]


def test_top_k_is_exact_in_many_dimensions():
    # products that doubles would round: the last row is ahead by one
    d, big = 600, 1 << 21
    x = np.full((3, d), float(big))
    x[0, -1], x[1, -1], x[2, -1] = 1, 1, 2
    q = np.full((1, d), float(big))
    q[0, 0], q[0, -1] = big - 1, 1
    index = topk.ShardIndex(np.array([5, 6, 7]), x, 2)
    (_, ids, scores), = index.search(np.array([1]), q, 2)
    exact = [sum(int(a) * int(b) for a, b in zip(q[0], v)) for v in x]
    assert ids.tolist() == [7, 5] and list(scores) == [exact[2], exact[0]]


def test_op7_matches_brute_force_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    got = found(topk.op7_mtree_topk(spark, sf))
    rows = usable(spark.read.parquet(f"{sf}/embeddings.parquet"), True)
    ids, x = np.array([i for i, _ in rows]), np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    assert sorted(got) == [i for i in sorted(ids) if i % 20 == 0]
    for i, near in got.items():
        s, other = x @ x[ids == i][0], ids != i
        top = np.lexsort((ids[other], -s[other]))[:20]
        assert near == list(zip(ids[other][top].tolist(), s[other][top].tolist()))


def test_fewer_rows_than_k_and_none(vectors):
    few = vectors.filter("vec_id in (0, 20, 3)")
    assert {len(v) for v in found(ann.nearest_neighbours(few, few)).values()} == {2}
    assert {len(v) for v in found(topk.top_k(few, few)).values()} == {2}
    none = vectors.limit(0)
    assert ann.nearest_neighbours(none, none).count() == 0 and topk.top_k(few, none).count() == 0


def test_pruning_skips_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.01, (400, 4)) for c in rng.normal(0, 5, (20, 4))])
    ids = np.arange(len(x))
    tree, m = ann.ShardIndex(ids, x, 5), topk.ShardIndex(ids, np.floor(64 * x), 5)
    list(tree.search(ids[:50], x[:50], 5, 1.0))
    list(m.search(ids[:50], np.floor(64 * x[:50]), 5))
    assert tree.computed < 0.8 * 50 * len(x) and m.computed < 0.8 * 50 * len(x)
