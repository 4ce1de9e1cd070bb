import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ngram_join, shingles

SCHEMA = "doc_id long, text string, n int, component string, key int"


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, per_cent):
    sets = [shingle_set(t, size) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= per_cent * (len(a) + len(sets[j]) - common):
                up[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 63), (1 << 62) if d is None else d)
    return sorted((-1 if d is None else d, len(sets[i]), least[root(i)] if least[root(i)] < 1 << 62 else None) for i, (d, *_) in enumerate(rows))


def made(seed=2):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Ab", "aB"]
    rows = []
    for base in range(30):
        n = rnd.choice([3, 8, 12, 14, 22, 25, 40, 60, 150, 400])
        body = [rnd.choice(vocab) for _ in range(n)]
        for _ in range(rnd.choice([1, 2, 3, 8])):
            w = list(body)
            for _ in range(rnd.randint(0, max(1, n // 25))):
                how, at = rnd.random(), rnd.randrange(len(w))
                if how < 0.5:
                    w[at] = rnd.choice(vocab)
                elif how < 0.75:
                    w.insert(at, rnd.choice(vocab))
                elif len(w) > 1:
                    w.pop(at)
            rows.append((len(rows) * 3, rnd.choice([" ", "\n", " \t "]).join(w), 1, "x", 1))
    rows += [(1000, None, 1, "x", 1), (1001, "", 1, "x", 1), (1002, " \n", 1, "x", 1), (1003, "Solo", 1, "x", 1), (1004, "solo", 1, "x", 1), (1005, "solo due", 1, "x", 1), (None, "null id here too", 1, "x", 1)]
    rnd.shuffle(rows)
    return rows


def compare(spark, rows, size, per_cent):
    got = ngram_join.grouped(spark.createDataFrame(rows, SCHEMA).repartition(3), size, per_cent).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, size, per_cent)


@pytest.mark.parametrize("size,per_cent,light", [(3, 90, None), (5, 80, None), (3, 90, 0), (3, 90, 32)])
def test_same_components_as_brute_force(spark, monkeypatch, size, per_cent, light):
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda *a: light)
    compare(spark, made(), size, per_cent)


def test_long_lists_in_blocks_and_two_rounds(monkeypatch):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    sets = []
    for _ in range(300):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(50)}"
        sets.append(next(shingles.sets(pa.array([" ".join(w)]), 3))[1])
    sets = list({s.tobytes(): s for s in sets}.values())
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    rows = {"cid": order, "n": n[order], "own": order, "part": order % 3, "token": np.zeros(len(n), np.int64), "first": np.ones(len(n), bool)}
    rows["sketch"] = np.stack([ngram_join.folded(ngram_join.wide_sketch(sets[i]), 64).view(np.uint64) for i in order])
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    whole = rows | {c: np.zeros(len(n), np.int64) for c in ("lo", "hi", "part")}
    assert linked <= set(map(tuple, ngram_join._scan(whole, 90, 0, True)))
    first = set(map(tuple, ngram_join._scan(whole, 90, 0, False)))
    assert len(first) < len(n)  # one pair a member
    met = set()
    for lo in range(3):
        for hi in range(lo, 3):
            keep = np.isin(rows["part"], [lo, hi])
            block = {c: x[keep] for c, x in rows.items()} | {"lo": np.full(keep.sum(), lo), "hi": np.full(keep.sum(), hi)}
            met |= set(map(tuple, ngram_join._scan(block, 90, 0, True)))
    assert linked <= met


def test_dense_group_end_to_end(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    monkeypatch.setattr(ngram_join, "HEAVY_PART", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # lists go on from batch to batch
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(80)] = f"x{rnd.randrange(99)}"
        rows.append((i, " ".join(w), 1, "x", 1))
    compare(spark, rows, 3, 90)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_stays_and_empty_table(spark):
    rows = made()
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    stays = {c for d, _, c in brute([r for r in rows if r[0] is not None], 5, 80)}
    assert {r["doc_id"] for r in ngram_join.first_of_each(docs).collect()} == stays
    assert ngram_join.grouped(docs.limit(0)).collect() == []


def test_one_row_stays_of_repeated_rows_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a, 1, "x", 1), (5, a, 1, "x", 1), (6, a, 1, "x", 1), (None, a, 1, "x", 1), (None, b, 1, "x", 1), (None, b, 1, "x", 1), (7, "", 1, "x", 1), (7, "", 1, "x", 1), (None, None, 1, "x", 1)]
    got = sorted(((r[0], r[1]) for r in ngram_join.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, a), (None, b), (7, ""), (7, ""), (None, None)], key=str)
