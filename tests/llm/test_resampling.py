import math
import random

import numpy as np
import pyarrow as pa

from tidemark.llm import resampling

SCHEMA = "doc_id long, text string, good boolean, key string, n int"
LABELS = "doc_id long, quality int, toxic int, text string"


def made(n=300):
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [f"w{rnd.randrange(50)}" for _ in range(rnd.randint(5, 60))]
        if bad:
            w = [x + "$$$" for x in w] if i % 8 else w + ["scum", "idiot"] * 2
        docs.append((i, " ".join(w), None, "x", 1))
        if i % 3:
            labels.append((i, int(not bad or i % 8 == 0), int(i % 8 == 0), "t"))
    docs += [(9000, None, None, "x", 1), (9001, "", None, "x", 1), (9002, " ", None, "x", 1), (None, "w1 w2", None, "x", 1)]
    return docs, labels + [(None, 1, 0, "t"), (77777, 1, 0, "t"), (5, None, None, "t")]


def run(spark, **kw):
    docs, labels = made()
    return resampling.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), **kw).collect()


def test_scores_separate_unlabelled_documents_and_the_share_holds(spark):
    got = run(spark, keep=0.6)
    assert len(got) == 304 and sum(r["selected"] for r in got) == round(0.6 * 304)
    keys = sorted((r["key"] for r in got if r["key"] is not None), reverse=True)
    assert {r["key"] for r in got if r["selected"]} == set(keys[: round(0.6 * 304)])
    unseen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["doc_id"] % 3 == 0]
    good, bad = ([r["score"] for r in unseen if (r["doc_id"] % 4 == 0) == b] for b in (False, True))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["log_weight"] is None and not r["selected"] for r in got if r["doc_id"] in (9000, 9001, 9002))


def test_default_share_and_no_labels(spark):
    got = run(spark)
    assert 0 < sum(r["selected"] for r in got) < len(got)
    docs, _ = made(20)
    plain = resampling.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], LABELS)).collect()
    assert all(r["score"] in (None, 0.0) for r in plain)
    assert resampling.resample(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


def test_threshold_is_exact(spark):
    rnd = random.Random(2)
    keys = [rnd.gauss(0, 1) ** 5 for _ in range(3000)] + [0.25] * 50
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key double")
    for k in (1, 7, 1500, 3050):
        assert resampling.threshold(df, k) == sorted(keys, reverse=True)[k - 1]
    assert resampling.threshold(df, 0) is None


def test_ratio_against_plain_counts(spark):
    docs = [(1, "a b", None, "", 1), (2, "a c", None, "", 1)]
    ratios = resampling.log_ratios(spark.createDataFrame(docs, SCHEMA).select("doc_id", "text"), spark.createDataFrame([(1,)], "doc_id long"))
    _, counts, buckets = next(resampling.features(pa.array(["a b", "a c"])))
    assert counts.tolist() == [5, 5]
    k = resampling.SMOOTH
    assert math.isclose(ratios[buckets[0]], math.log((1 + k) / (1 + k)), abs_tol=1e-6)
    only = set(buckets[:5].tolist()) - set(buckets[5:].tolist())
    assert all(math.isclose(ratios[b], math.log((1 + k) / (0.5 + k)), rel_tol=1e-5) for b in only)


def test_keys_and_selection_against_plain_python(spark):
    import xxhash

    docs, labels = made(120)
    got = {r["doc_id"]: r for r in resampling.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), keep=0.5, seed=3).collect()}
    good = {d for d, q, t, _ in labels if d is not None and d < 120 and q == 1 and t == 0 and d != 5}
    raw, target, own = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS), {}
    for doc_id, text, *_ in docs:
        for _, _, buckets in resampling.features(pa.array([text or ""])):
            own[doc_id] = buckets
            np.add.at(raw, buckets, 1)
            if doc_id in good:
                np.add.at(target, buckets, 1)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + resampling.SMOOTH) / (expected + resampling.SMOOTH))
    keys = {}
    for doc_id, buckets in own.items():
        if not len(buckets):
            assert got[doc_id]["key"] is None
            continue
        assert math.isclose(got[doc_id]["log_weight"], ratio[buckets].sum(), rel_tol=1e-4, abs_tol=1e-4)
        if doc_id is None:
            continue
        h = xxhash.xxh64(int(3).to_bytes(4, "little"), seed=xxhash.xxh64(int(doc_id).to_bytes(8, "little", signed=True), seed=42).intdigest()).intdigest()
        uniform = (h % (1 << 52) + 0.5) / (1 << 52)
        keys[doc_id] = got[doc_id]["log_weight"] / math.sqrt(len(buckets)) - math.log(-math.log(uniform))
        assert math.isclose(got[doc_id]["key"], keys[doc_id], rel_tol=1e-9, abs_tol=1e-9)
    whole = sorted((r["key"] for r in got.values() if r["key"] is not None), reverse=True)
    assert all(r["selected"] == (r["key"] is not None and r["key"] >= whole[round(0.5 * len(docs)) - 1]) for r in got.values())


def test_selection_frequencies_follow_the_weights(spark):
    """Of many copies of a few scores, each key is the greatest as often as its weight says."""
    from pyspark.sql import functions as F

    scores = [0.0, 0.5, 1.0, 2.0]
    draws = spark.range(40_000).select((F.col("id") * 4).alias("base"))
    keys = [(F.lit(s) / 1.0 + resampling.noise(F.col("base") + i, 7)).alias(f"k{i}") for i, s in enumerate(scores)]
    best = draws.select(*keys).select(*((F.col(f"k{i}") == F.greatest("k0", "k1", "k2", "k3")).cast("int").alias(f"k{i}") for i in range(4)))
    found = best.agg(*(F.avg(f"k{i}") for i in range(4))).first()
    weights = np.exp(scores) / np.exp(scores).sum()
    assert np.allclose(list(found), weights, atol=0.012)
