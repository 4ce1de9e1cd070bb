import math
import re
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import imatch, order

SCHEMA = "doc_id long, text string, term string, code int, _bucket int"


def made(n, step=1):
    words = [f"w{i}" for i in range(60)]
    return [(i * step, None if i % 17 == 3 else "" if i % 19 == 4 else " ".join(words[(i * 7 + k * (i % 5 + 1)) % 60] for k in range(i % 23 + 1)) + " é!", "x", 1, 2) for i in range(n)]


@pytest.mark.parametrize("n,per", [(1, 500), (2, 500), (60, 7), (61, 500)])
def test_edited_text_of_each_row(spark, monkeypatch, n, per):
    monkeypatch.setattr(order, "bounds", lambda d, f=order.bounds: f(d, rows_per_bucket=per))
    rows = made(n, 3)
    got = {r["doc_id"]: r for r in imatch.edit_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [r[0] for r in rows]
    texts = [r[1] or "" for r in rows]
    for i, (doc_id, *_) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % n]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[doc_id]["n_chars"] == len(text)
        assert got[doc_id]["edited_sha256"] == sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc_id]["near_edited"] <= 1 and 0 <= got[doc_id]["near_next"] <= 1
        if text == after:
            assert got[doc_id]["near_next"] == 1
        if text == edited:
            assert got[doc_id]["near_edited"] == 1 and got[doc_id]["fingerprint"] == got[doc_id]["edited_fingerprint"]
    for a in got.values():
        for b in got.values():
            if texts[a["doc_id"] // 3] == texts[b["doc_id"] // 3]:
                assert a["fingerprint"] == b["fingerprint"]


def test_band_and_kept_terms_against_brute_force(spark):
    rows = made(80)
    docs = spark.createDataFrame(rows, SCHEMA)
    df = Counter(t for r in rows for t in {t for t in re.split(r"[\W_]+", (r[1] or "").lower()) if t})
    kept = {t for t, c in df.items() if math.exp(-2.5) * 80 <= c <= math.exp(-1.2) * 80}
    words = imatch.lexicon(docs, least_idf=1.2, most_idf=2.5)
    assert words.count() == len(kept) > 0
    got = {r["doc_id"]: r["hashes"] for r in imatch.fingerprints(docs, words).collect()}
    sets = {r[0]: frozenset(t for t in re.split(r"[\W_]+", (r[1] or "").lower()) if t in kept) for r in rows}
    for a in got:
        for b in got:
            if sets[a] == sets[b]:
                assert got[a] == got[b]
        if not sets[a]:
            assert set(got[a]) == {0}


def test_small_edits_stay_like_and_others_do_not(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(f"t{(i * 31 + k * 7) % 997}" for k in range(150)), "x", 1, 1) for i in range(40)]
    rows += [(100, " ".join(base), "x", 1, 1), (101, " ".join(["t500", *base[1:]]), "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["hashes"] for r in imatch.fingerprints(docs, imatch.lexicon(docs, least_idf=0.0)).collect()}

    def like(a, b):
        held = [(x, y) for x, y in zip(got[a], got[b], strict=True) if x or y]
        return sum(x == y for x, y in held) / len(held)

    assert like(100, 101) >= 0.5 > like(100, 5)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, 1)] * 3 + [(None, "a b c", "x", 1, 1)], SCHEMA)
    got = imatch.edit_report(docs).collect()
    assert len(got) == 4 and sum(r["doc_id"] is None for r in got) == 1
    assert imatch.edit_report(docs.limit(0)).collect() == []


def plain_report(rows, least_idf=imatch.LEAST_IDF, most_idf=imatch.MOST_IDF):
    """doc_id -> (fingerprint, near_edited, near_next) in plain Python; rows come by doc_id."""
    import hashlib

    import xxhash

    def x(*values):
        seed = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
        return seed - (seed >> 63 << 64)

    def small(v):
        return v.to_bytes(4, "little")

    def terms(text):
        return {t for t in re.split(r"[\W_]+", text.lower()) if t}

    df = Counter(t for r in rows for t in terms(r[1] or ""))
    band = [t for t, c in df.items() if math.exp(-most_idf) * len(rows) <= c <= math.exp(-least_idf) * len(rows)]
    mask = (1 << imatch.HASH_BITS) - 1
    codes = {}
    for t in band:
        term = x(t)
        codes[t] = [j << imatch.HASH_BITS | x(term, "code") & mask for j, rate in enumerate(imatch.RATES) if x(term, small(j)) & (1 << rate) - 1 == 0]

    def hashed(text):
        out = {}
        for c in sorted(c for t in terms(text) if t in codes for c in codes[t]):
            j = c >> imatch.HASH_BITS
            out[j] = x(out[j], c) if j in out else x(c)
        return {j: h & mask for j, h in out.items()}

    def shown(text):
        found = hashed(text)
        return ".".join(f"{j << imatch.HASH_BITS | h:x}" for j, h in sorted(found.items())) or "text:" + hashlib.md5(text.encode()).hexdigest()

    def near(a, b):
        p, q = hashed(a), hashed(b)
        held = p.keys() | q.keys()
        return sum(p.get(j) == q.get(j) for j in held) / len(held) if held else float(a == b)

    out = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out[doc_id] = (shown(text), shown(edited), near(text, edited), near(text, after))
    return out


def test_whole_report_against_plain_python(spark):
    rows = made(150, 2)
    want = plain_report(rows)
    for r in imatch.edit_report(spark.createDataFrame(rows, SCHEMA)).collect():
        fingerprint, edited, near_edited, near_next = want[r["doc_id"]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint, edited)
        assert math.isclose(r["near_edited"], near_edited) and math.isclose(r["near_next"], near_next)


def test_edited_texts_are_nearer_than_the_next(spark):
    import random

    rnd = random.Random(5)
    topics = [[f"t{k}x{i}" for i in range(80)] for k in range(30)]
    rows = [(i, " ".join(rnd.choice(topics[i % 30] if rnd.random() < 0.5 else rnd.choice(topics)) for _ in range(rnd.choice([30, 100, 400, 4000]))), "x", 1, 1) for i in range(300)]
    got = imatch.edit_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 0.9 * len(got)


def test_very_long_text_and_tied_ids(spark):
    long = " ".join(f"w{i % 20011}" for i in range(200_000))
    rows = [(1, "a b c", "x", 1, 1), (1, long, "x", 1, 1), (2, "a b d", "x", 1, 1)]
    got = imatch.edit_report(spark.createDataFrame(rows, SCHEMA), least_idf=0.0).collect()
    assert len(got) == 3 and sorted(r["n_chars"] for r in got) == sorted([5, len(long), 5])


@pytest.mark.parametrize("cap", [2, 3])
def test_more_rows_than_one_list_of_cuts_serves(spark, monkeypatch, cap):
    monkeypatch.setattr(order, "MAX_BUCKETS", cap)
    monkeypatch.setattr(order, "bounds", lambda d, f=order.bounds: f(d, rows_per_bucket=5))
    monkeypatch.setattr(order, "finer", lambda d, c, f=order.finer: f(d, c, rows_per_bucket=5))
    rows = made(60, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert order.finer(docs, order.bounds(docs)) is not None
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.edit_report(docs).collect()}
    texts = [r[1] or "" for r in rows]
    for i, (doc_id, *_) in enumerate(rows):
        half = len(texts[i]) // 2
        assert got[doc_id] == sha256((texts[i][: len(texts[i]) - half] + texts[(i + 1) % 60][:half]).encode()).hexdigest()


def test_bucket_numbers_beyond_32_bits(spark):
    n = 2 * order.MAX_BUCKETS
    docs = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
    cuts = order.bounds(docs, rows_per_bucket=1)
    inner = order.finer(docs, cuts, rows_per_bucket=1)
    assert len(cuts) * order.PARTS > 1 << 31 and inner is not None
    within = Window.partitionBy("_bucket").orderBy("_guest", "_key")
    got = order.with_guests(docs, cuts, inner=inner).withColumn("next", F.lead("text").over(within)).filter("_guest = 0")
    assert sorted((int(r["text"]), int(r["next"])) for r in got.collect()) == [(i, (i + 1) % n) for i in range(n)]
