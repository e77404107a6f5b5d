import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from churnlens.llm import langid, quality, sharding, simhash

SF = "/root/testdata/sf0.01"


# -- language identification -----------------------------------------------------

def test_language_held_out_accuracy(spark):
    rows = langid.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet")
                                                  .select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(edge, nothing):
    model = langid.fit_language_model(edge)
    assert model.langs == ["en", "fr"]
    got = langid.identify_language(edge, model, ["doc_id", "text"]).collect()
    assert len(got) == edge.count()
    for r in got:
        if langid.has_letter(r.text):
            assert r.lang_pred in model.langs and 0 < r.score <= 1
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    untrained = langid.fit_language_model(nothing)
    assert {r.lang_pred for r in langid.identify_language(edge, untrained, ["doc_id"]).collect()} == {"und"}
    assert langid.identify_language(nothing, model, ["doc_id"]).count() == 0
    assert langid.language_stage(edge.sparkSession, edge, SF).columns == edge.columns


def test_language_texts_do_not_mix_in_a_slice():
    model = langid.train(["the cat and the dog"] * 20 + ["le chat et le chien"] * 20, ["en"] * 20 + ["fr"] * 20)
    texts = ["the dog", "", "le chien", "12", "a" * 5, "the"]
    one = [model.predict([t]) for t in texts]
    all_ = model.predict(texts)
    assert all_["lang_pred"] == [o["lang_pred"][0] for o in one]
    assert np.allclose(all_["score"], [o["score"][0] for o in one])


def test_every_language_is_learned(spark):
    rows = [(100 * i + j, f"lang{i:02d} " * 3 + f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} " * 4, f"l{i:02d}")
            for i in range(70) for j in range(2 if i == 69 else 3)]
    rows += [(5, "shared id", "l00")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limits in ({}, {"max_rows": 70}):
        got = langid.training_sample(df, F.lit(True), limits.get("per_lang", 800), limits.get("max_rows", 51_200), 1500)
        counts = {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()}
        assert sorted(counts) == sorted({r[2] for r in rows})
        assert (max(counts.values()) == 1) == bool(limits)
    assert len(langid.fit_language_model(df, per_lang=2, epochs=1).langs) == 70


@pytest.mark.parametrize("left_out, share", [(("de",), 0.8), (("en", "es"), 0.8), (("de", "fr", "es"), 0.5)])
def test_unlearned_language_and_gibberish_are_rejected(spark, left_out, share):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
            if langid.has_letter(r.text) and r.lang]
    known = [r for r in rows if r.lang not in left_out]
    model = langid.train([r.text[:1500] for r in known[::2]], [r.lang for r in known[::2]])
    rng = np.random.default_rng(6)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for _ in range(100)]
    strange = [r.text for r in rows if r.lang in left_out]
    assert np.mean(model.predict([r.text for r in known[1::2]])["rejected"]) <= 0.02
    assert np.mean(model.predict(strange)["rejected"]) > share
    assert np.mean(model.predict(noise)["rejected"]) > 0.95


# -- quality -----------------------------------------------------------------

def brute_marginals(unary, pair):
    n = len(unary)
    total, good = 0.0, np.zeros(n)
    for code in range(2 ** n):
        s = [code >> i & 1 for i in range(n)]
        p = np.exp(sum(unary[i, s[i]] for i in range(n)) + sum(pair[a, b] for a, b in zip(s, s[1:])))
        total += p
        good += p * np.array(s)
    return good / total


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(2)
    sizes, pair = np.array([3, 1, 6, 2]), rng.normal(size=(2, 2))
    unary = rng.normal(size=(sizes.sum(), 2))
    got, joint, inner = quality.forward_backward(unary, pair, sizes, edges=True)
    at = 0
    for n in sizes:
        assert np.allclose(got[at:at + n, 1], brute_marginals(unary[at:at + n], pair))
        at += n
    assert np.isclose(joint.sum(), len(inner)) and len(inner) == (sizes - 1).sum()


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = quality.op6_quality_classifier(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_edge_cases(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (6, 0), (None, 1), (7, None), (99, 1)],
                                   "doc_id long, quality int")
    model = quality.fit_quality_model(edge, labels)
    got = quality.score_quality(edge, model, ["doc_id"]).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(nothing, model, ["doc_id"]).count() == 0
    for empty in (labels.limit(0), labels.filter("quality = 1")):
        flat = quality.fit_quality_model(edge, empty)
        assert len({r.score for r in quality.score_quality(edge, flat, ["doc_id"]).collect()}) == 1
    texts = ["", "one\ntwo", "a | b |", "\n\n"]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


# -- near-duplicates ------------------------------------------------------------

def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for t in ("", None, "a", "A b\x0bC", "É \x85 \xa0 x y z", "one two three four", "Q w e r t y " * 30):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("max_members,blocks", [(3, None), (2048, None), (2048, 8)])
def test_links_by_brute_force(spark, max_members, blocks):
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(0, 2**63, 12)}
    for x in list(prints):
        for _ in range(12):  # chains of near prints, some a bit too far
            for b in rng.integers(0, 64, int(rng.integers(1, 7))):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    comps = simhash.connected_components(simhash.near_links(df, blocks=blocks, max_members=max_members)).collect()
    root = {s: s for s in signed} | {r.node: r.root for r in comps}
    want, groups = plain_components(prints), {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(root[s])
    assert all(len(g) == 1 for g in groups.values()) and len(set(root.values())) == len(groups)


def test_blocks_grow_with_the_fingerprints():
    chosen = [simhash.choose_blocks(n) for n in (0, 1, 10**6, 10**9, 5 * 10**10, 10**13)]
    assert chosen[:4] == [6, 6, 6, 6] and chosen == sorted(chosen) and chosen[4] == 7
    assert all(n >> (64 * (b - 4) // b) <= 512 for n, b in zip((10**9, 5 * 10**10, 10**13), chosen[3:]))


def test_near_duplicates_edge_cases(edge, nothing):
    got = simhash.near_duplicates(edge, ["doc_id"]).collect()
    rows = edge.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    low = {}
    for r, c in zip(rows, plain_components(prints)):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, low.get(c)) for r, c in zip(rows, plain_components(prints))), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(nothing, ["doc_id"]).count() == 0
    kept = simhash.simhash_stage(edge.sparkSession, edge, SF)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, c in want}, key=repr)


def test_stage_keeps_one_row_of_each_group_whatever_the_ids(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]),
            (3, texts[4]), (5, texts[4]), (5, texts[5]), (5, texts[5]), (None, texts[5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(3)
    kept = simhash.simhash_stage(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (5, texts[5])], key=repr)


def test_stage_shuffles_no_text(spark):
    rows = [(i % 50, f"w{i % 40} b c d e f", "x") for i in range(400)]
    # one id, one fingerprint, two texts: the least text hash stays, whatever the order
    rows += [(1000, "One two three four FIVE", "x"), (1000, "one two three four five", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    kept = simhash.simhash_stage(spark, df, SF)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "SortAggregate" not in plan
    again = simhash.simhash_stage(spark, df.repartition(5), SF)
    pick = [sorted(r.text for r in k.filter("doc_id = 1000").collect()) for k in (kept, again)]
    assert len(pick[0]) == 1 and pick[0] == pick[1]


def test_connected_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 500)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500
    assert simhash.connected_components(links.limit(0)).count() == 0


# -- sharding --------------------------------------------------------------------

def test_sharding_edge_cases(edge, nothing):
    got = sharding.shard_records(edge).collect()
    assert len(got) == edge.count()
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(v) == 1 for v in by_key.values())
    assert sorted(r.size for r in got) == sorted(len((r.text or "").encode()) + 1 for r in edge.collect())
    assert sharding.shard_records(nothing).count() == 0


def test_sharding_follows_weights_and_moves_little(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_records(ids, 3, [1, 2, 1]).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 20000 for r in got}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    moved = sharding.shard_records(ids, 4).filter("grown_shard <> shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {4}
    assert abs(moved.count() / 20000 - 0.2) < 0.02


def test_sharding_matches_its_sql(spark):
    from compare import compare, duck
    sf = "/root/testdata/sf0.001"
    ok, msg = compare(sharding.op10_sharding(spark, sf), duck(sf), sharding.oracle())
    assert ok, msg
