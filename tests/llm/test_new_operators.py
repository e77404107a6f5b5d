"""Operators 11 to 13 and the training samples against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import langid, lexical, minhash, quality, whitening

SF = "/root/testdata/sf0.01"


# -- 11 -------------------------------------------------------------------------

def plain_components(rows, words, percent):
    """(id, text) rows -> [(id, set size, least id reachable)]."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    out = []
    for i, (own, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((own, len(sets[i]), min(group) if group else None))
    return out


def copies(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randrange(20, 160))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            n += 1
            rows.append((n, " ".join(copy)))
    hot = rng.choices(vocabulary, k=90)
    for _ in range(80):  # near copies of one text, and one text many times
        copy = list(hot)
        copy[rng.randrange(90)] = rng.choice(vocabulary)
        rows += [(len(rows) + 1000, " ".join(copy)), (len(rows) + 3000, " ".join(hot).upper())]
    odd = ["a b", "a  b", "a b c", "A\tB", "x y z x y z x", "y z x y z x y", "", None, " \n ", "été là", "one"]
    return rows + [(5000 + i, t) for i, t in enumerate(odd)]


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 16, "block_texts": 7}])
def test_similar_documents_match_all_pairs(spark, bounds):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.similar_documents(df, ["doc_id"], words=3, percent=85, **bounds)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == set(plain_components(rows, 3, 85)) | {
        (i, 0, i) for i, t in rows if not (t or "").split()}
    assert got.filter("kept <> (doc_id = component_id)").count() == 0


def test_similar_documents_edges(spark, edge, nothing):
    got = minhash.similar_documents(edge, ["doc_id", "lang", "score"], words=3, percent=85)
    assert got.columns == ["doc_id", "lang", "score", "n_shingles", "component_id", "kept"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == edge.count() and rows[4].component_id == 1 and not rows[4].kept
    assert rows[2].component_id == 2 and rows[2].n_shingles == 0 and rows[None].kept
    assert minhash.similar_documents(nothing, ["doc_id"]).count() == 0


def test_the_hamming_join_finds_every_pair_under_its_threshold():
    p = minhash.plan(1000, 85)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (40, p.length), dtype=np.uint8)
    rows = np.repeat(base, 6, axis=0)
    for row in rows:
        row[rng.choice(p.length, rng.integers(0, p.radius // 2 + 3), replace=False)] ^= 1
    chunk = rows.reshape(len(rows), p.chunks, p.bits).astype(np.int64) @ (1 << np.arange(p.bits))
    signs = minhash._packed(chunk, p).view(np.uint64)
    flips = np.concatenate([[0], 1 << np.arange(p.prefix)])
    lead = ((chunk >> (p.bits - p.prefix))[:, :, None] ^ flips) | (np.arange(p.chunks) << 48)[:, None]
    shard = lead.reshape(len(rows), -1).ravel()
    node = np.repeat(np.arange(len(rows)), p.chunks * len(flips))
    by = np.argsort(shard, kind="stable")
    part = np.cumsum(np.concatenate([[1], np.diff(shard[by]) != 0]))
    a, b = minhash.shard_links(shard[by], part, node[by], signs[node[by]], np.zeros(len(node), int), p)
    root = np.arange(len(rows))
    minhash.hook(root, a, b)
    want = np.arange(len(rows))
    near = np.argwhere((rows[:, None] != rows[None]).sum(-1) <= p.radius)
    minhash.hook(want, near[:, 0], near[:, 1])
    assert np.array_equal(root, want)


def test_op11_matches_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(minhash.oracle()).fetchall()
    got = minhash.op11_minhash(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# -- 12 ---------------------------------------------------------------------------

def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return value, y @ vector / np.sqrt(value), ((n * x - s) ** 2).sum(1), value / np.trace(y.T @ y / n)


def test_whitening_matches_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    value, white, deviation, share = plain_whitening([v for _, v in rows])
    got = whitening.op12_whitening(spark, SF).toPandas()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert np.abs(table * np.sign((table * white).sum(0)) - white).max() < 1e-8
    first = got.drop_duplicates("vec_id").set_index("vec_id").loc[[i for i, _ in rows]]
    assert first.deviation.tolist() == deviation.tolist() and set(got.n) == {len(rows)}
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, share, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(40, 3)))]
    odd = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [float("nan")] * 3, 1), (103, [float("inf"), 0.0, 0.0], 1),
           (104, [], 1), (105, [1.0], 1), (None, [9.0, 9.0, 9.0], 1), (3, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(3)
    got = whitening.whitened(df).toPandas()
    assert set(got.n) == {42} and len(got) == 42 * 3 and got.vec_id.isna().sum() == 3
    assert whitening.whitened(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whitened(same).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    huge = spark.createDataFrame([(i, [i * 1e14, 1.0 * i * i]) for i in range(4)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(huge).collect()} == {None}


def test_components_and_inertia():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for values in (rng.normal(size=30), [5.0] * 14 + [1.0] * 16, 10.0 ** -np.arange(30.0), [0.0] * 20 + [3.0] * 10):
        a = turn @ np.diag(values) @ turn.T
        a = (a + a.T) / 2
        got, vectors = whitening.components(a, 12)
        want = np.sort(values)[::-1]
        assert np.allclose(got, want[:12], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * got, atol=1e-11)
        for shift in (-2.03, 0.513, 2.01, 9.0):
            assert whitening.inertia(a, shift) == (want < shift).sum()


def test_components_among_close_neighbours():
    # eigenvalues next to both ends of an interval mix to values inside it
    for seed in (11, 12, 29, 75):
        a = np.cov(np.random.default_rng(seed).normal(size=(10_000, 64)).round(1).T, bias=True)
        got, vectors = whitening.components(a, 32)
        assert np.allclose(got, np.linalg.eigvalsh(a)[::-1][:32], atol=1e-12)
        assert np.allclose(a @ vectors, vectors * got, atol=1e-11)


# -- 13 ----------------------------------------------------------------------------

def test_terms():
    assert lexical.terms("Ab-c_D 0x9 ÉTÉ été là ~z") == [t.encode() for t in
                                                             ["ab", "c", "d", "0x9", "ÉtÉ", "été là", "z"]]
    assert lexical.terms(None) == lexical.terms("-- \n") == []


@pytest.mark.parametrize("blocks", [{}, {"block_items": 3, "block_terms": 40}])
def test_ranked_search_matches_plain_scores(spark, blocks):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)] + ["été", "漢字"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(150)]
    docs += [(i + 500, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (9, docs[9][1]), (700, None), (701, "--")]
    items = [(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(9)] + [(20, None), (21, "none-of-these"), (1, "t1 t2")]
    ddf = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, score int").repartition(4)
    idf = spark.createDataFrame(items, "item_id long, text string")
    bags = [(i, lexical.terms(t)) for i, t in docs]
    used = [(i, b) for i, b in bags if b]
    big_n, big_l = len(used), sum(len(b) for _, b in used)
    df = {t: sum(t in b for _, b in used) for t in {t for _, b in used for t in b}}
    want = []
    for item, text in items:
        scored = []
        for i, b in used:
            m = 100 - 90 + (90 * len(b) * big_n) // big_l
            s = sum(int(np.floor(1000 * np.log((2 * big_n + 2) / (2 * df[t] + 1))))
                    * ((1_000_000_000 * b.count(t)) // (1000 * b.count(t) + 8 * m))
                    for t in set(lexical.terms(text)) if t in b)
            if s > 0:
                scored.append((-s, i is None, i))
        want += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    got = [tuple(r) for r in lexical.ranked_search(ddf, idf, **blocks).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lexical.ranked_search(ddf.limit(0), idf).count() == 0 and lexical.ranked_search(ddf, idf.limit(0)).count() == 0


def test_op13_matches_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(lexical.oracle()).fetchall()
    assert sorted(map(tuple, lexical.op13_lexical_search(spark, SF).collect())) == sorted(want)


# -- training samples and the chain --------------------------------------------------

def test_a_rare_label_is_learned(spark):
    good = "Calm words stand in a plain row and say one thing after another."
    bad = "BUY NOW!!! $$$ | | | CLICK HERE!!! >>> FREE FREE FREE FREE"
    rows = [(i, good + f" Part {i % 50}.") for i in range(4000)] + [(10_000 + i, bad) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"))
    chosen = quality.training_labels(labels, None, 100).groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in chosen} == {0: 12, 1: 50}
    scored = quality.score_quality(docs, quality.fit_quality_model(docs, labels, max_docs=100), ["doc_id"])
    assert scored.filter("predicted <> cast(doc_id < 10000 as int)").count() == 0


def test_the_chain_gradient_is_one(monkeypatch):
    rng = np.random.default_rng(7)
    n = np.array([3, 1, 4])
    x, y = rng.normal(size=(8, 5)), rng.integers(0, 2, 8).astype(float)
    weight = np.repeat([0.5, 2.0, 1.25], n)
    theta = rng.normal(size=9) / 3

    def value(th):
        unary, pair, total, first = x @ th[:5], th[5:].reshape(2, 2), 0.0, 0
        for k in n:
            def energy(labels):
                return sum(unary[first + i] * v for i, v in enumerate(labels)) + sum(pair[a, b] for a, b in zip(labels, labels[1:]))
            own = [int(v) for v in y[first:first + k]]
            total += weight[first] * (energy(own) - np.log(sum(np.exp(energy(v)) for v in itertools.product((0, 1), repeat=int(k)))))
            first += k
        return total / weight.sum() - 0.01 / 2 * th @ th

    step = 1e-5
    slopes = [(value(theta + step * e) - value(theta - step * e)) / (2 * step) for e in np.eye(9)]
    assert np.allclose(quality.chain_gradient(theta, x, y, weight, n, 0.01), slopes, atol=1e-7)


def test_document_score_is_the_length_weighted_mean():
    model = quality.QualityModel(np.linspace(-1, 1, quality.N_FEATURES), np.array([[0.5, -0.5], [-0.2, 0.4]]), 3.0, -1.0)
    text = "First line here.\n\nAND!!! | 3rd\nlast one"
    good, size, _ = model.line_marginals([text])
    plain = sum(g * (len(line.encode()) + 1) for g, line in zip(good, text.split("\n"))) / (len(text.encode()) + 1)
    assert size.tolist() == [len(line.encode()) for line in text.split("\n")]
    assert np.allclose(model.score([text]), 1 / (1 + np.exp(-(3.0 * plain - 1.0))))


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumns(
        {"_rejected": F.lit("r"), "_good": F.lit("g"), "pass": F.lit(3), "_0": F.lit(4.5)})
    for step in (langid.language_stage, quality.quality_stage):
        out = step(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() > 10
        assert out.select("_rejected", "_good", "pass", "_0").distinct().collect() == [("r", "g", 3, 4.5)]


def test_language_scores_match_a_plain_scorer(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").limit(80).collect()
    model = langid.train([r.text[:400] for r in rows if r.lang], [r.lang for r in rows if r.lang], epochs=1)
    got = model.predict([r.text for r in rows])
    for i, r in enumerate(rows):
        buckets, counts = langid._bag(r.text, model.bits)
        z = sum(float(c) * model.logits[b].astype(float) for b, c in zip(buckets, counts)) / counts.sum() + model.bias
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p = (p / p.sum())[:len(model.langs)]
        if langid.has_letter(r.text):
            assert got["lang_pred"][i] == model.langs[int(p.argmax())] and abs(got["score"][i] - p.max()) < 1e-4


def test_a_language_of_one_repeated_id_is_still_sampled(spark):
    rows = [(7, f"the cat {i} sat on the mat with dogs") for i in range(900)] + [(i, "le chat est ici avec nous") for i in range(900)]
    df = spark.createDataFrame([(i, t, "en" if i == 7 and t.startswith("the") else "fr") for i, t in rows],
                               "doc_id long, text string, lang string")
    got = langid.training_sample(df, F.lit(True), 20, 1000, 12).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 20, "fr": 20}
    starts = {r.text for r in langid.training_sample(df.filter("lang = 'en'"), F.lit(True), 20, 1000, 12).collect()}
    assert len({t[:4] for t in starts}) > 3  # windows from anywhere in the text
