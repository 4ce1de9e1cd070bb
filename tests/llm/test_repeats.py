import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bwt, repeats

SCHEMA = "doc_id long, text string, h long, content string, t int"


def brute(rows):
    low = -(1 << 63)
    first = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            first[s] = min(first.get(s, 1 << 63), low if d is None else d)
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < (low if d is None else d):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(raw), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(out)


def compare(spark, rows, parts=4):
    got = repeats.dedup(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows)


def made(seed, n=80):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([49, 50, 51, 60, 99, 130, 300]))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append("".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 120))))
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                cut = rnd.randint(0, len(p) // 3) if rnd.random() < 0.5 else 0
                parts.append(p[cut:])
        rows.append((i * 2, "".join(parts), 1, "x", 1))
    rows += [(500, rows[3][1], 1, "x", 1), (500, rows[3][1], 1, "x", 1), (501, None, 1, "x", 1), (502, "", 1, "x", 1), (503, "a" * 400, 1, "x", 1), (504, "a" * 90, 1, "x", 1), (505, "ab" * 60, 1, "x", 1), (506, "ab" * 40, 1, "x", 1)]
    rows += [(507, passages[5] + "x", 1, "x", 1), (507, passages[5] + "y", 1, "x", 1), (None, passages[6], 1, "x", 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(repeats, "PART", 300)
        monkeypatch.setattr(repeats, "SHARD", 200)
    compare(spark, made(seed))


def test_one_document_and_empty_table(spark):
    compare(spark, [(1, "abc " * 100, 1, "x", 1)])
    assert repeats.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_gives_sorted_rotations_and_intervals(shards):
    rnd = random.Random(shards)
    strings = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(8, 30))).encode() for _ in range(60)})
    rnd.shuffle(strings)
    cut = [strings[i::shards] for i in range(shards)]
    source, place, interval = bwt.merge([bwt.transform(c) for c in cut], 8)
    texts = [b"".join(s + b"\xff" for s in c) for c in cut]

    def rotation(z, p):
        begin = texts[z].rfind(b"\xff", 0, p) + 1
        own = texts[z][begin : texts[z].index(b"\xff", p) + 1]
        k = p - begin
        return ((own[k:] + own[:k]) * 8)[:8]

    rows = [rotation(z, p) for z, p in zip(source.tolist(), place.tolist(), strict=True)]
    assert rows == sorted(rows)
    assert np.array_equal(interval, np.cumsum([0] + [a != b for a, b in zip(rows, rows[1:], strict=False)]))


def hot(n, seed=5):
    """Texts of n different contexts in all around one piece of 20 bytes, whose hash is so low that it is their anchor."""
    rnd = random.Random(seed)
    raw = np.frombuffer(rnd.randbytes(1 << 20), np.uint8) % 26 + 97
    at = int(repeats.gram_hashes(raw).argmin())
    piece = raw[at : at + 20].tobytes().decode()
    half = ["".join(rnd.choices("abcdefgh", k=30)) for _ in range(n)]
    return [(i, half[i] + piece + half[(7 * i + 3) % n], 1, "x", 1) for i in range(n)] + [(n + i, half[i] + piece + half[(5 * i + 1) % n], 1, "x", 1) for i in range(0, n, 9)]


def merged(rows, large):
    """The runs of all texts (anchor, hash, content, doc), each a bucket of its own, and what _merged makes of them by bucket."""
    texts = [r[1].encode() for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    found = sorted((int(h), hash(texts[k][s : s + n + 49]) & (1 << 62) - 1, texts[k][s : s + n + 49], rows[k][0]) for k, h, s, n in zip(*repeats.runs(offsets, raw), strict=True))
    blobs = []
    for a in range(0, len(found), 500):
        h, c, content, doc = zip(*found[a : a + 500], strict=True)
        at = np.arange(a, a + len(h))
        columns = [np.array(x, k) for x, k in zip((h, c, at, at, doc, [5000] * len(h), [len(x) for x in content]), repeats.RUN, strict=False)]
        blobs.append(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([repeats.pack(*columns, b"".join(content))], pa.binary())], names=["key", "blob"]))
    least, passed = {}, []
    for batch in repeats._merged(iter(blobs), large):
        for r in batch.to_pylist():
            if r["content"] is not None:
                passed.append(r)
                continue
            i, count, at, value = repeats.unpack(r["blob"], *repeats.ANSWER)
            ends = np.cumsum(count)
            for k, e, n in zip(i.tolist(), ends.tolist(), count.tolist(), strict=True):
                assert k == r["d"]
                least[k] = list(zip(at[e - n : e].tolist(), value[e - n : e].tolist(), strict=True))
    return found, least, passed


def held_out(found, least, among):
    """Whether each answer has the least doc of each string."""
    first = {}
    for k in among:
        _, _, x, doc = found[k]
        for i in range(len(x) - 49):
            first[x[i : i + 50]] = min(first.get(x[i : i + 50], 1 << 63), doc)
    for k in among:
        x, got = found[k][2], []
        for (at, value), (stop, _) in zip(least[k], [*least[k][1:], (len(found[k][2]) - 49, 0)], strict=True):
            assert at == len(got) < stop
            got += [value] * (stop - at)
        assert got == [first[x[i : i + 50]] for i in range(len(x) - 49)]


def test_one_anchor_of_more_than_256_shards(monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 200)
    found, least, passed = merged(hot(1200), 1 << 30)
    sizes = {}
    for h, _, content, _ in dict.fromkeys((*f[:3], 0) for f in found):
        sizes[h] = sizes.get(h, 0) + len(content) + 1
    assert max(sizes.values()) > 256 * 281 and not passed and len(least) == len(found)
    held_out(found, least, range(len(found)))


@pytest.mark.parametrize("held", [1 << 26, 20_000])
def test_runs_of_a_large_anchor_pass_through_once(monkeypatch, held):
    monkeypatch.setattr(repeats, "HELD", held)
    found, least, passed = merged(hot(1200), 5000)
    assert len(passed) > 1200 and len({r["d"] for r in passed}) == len(passed)
    assert {r["d"] for r in passed} | set(least) == set(range(len(found))) and not {r["d"] for r in passed} & set(least)
    assert all(r["content"] == found[r["d"]][2] and r["i"] == r["d"] for r in passed)
    by = {}
    for k in least:
        by.setdefault(found[k][0], []).append(k)
    for among in by.values():
        held_out(found, least, among)


@pytest.mark.parametrize("large", [0, 5000])
def test_divided_anchors_same_as_brute_force(spark, large):
    rows = hot(300) + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in made(3, 40)]
    got = repeats.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), large=large).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows)


def test_ranges_of_anchors_hold_equally_many_runs():
    raw = np.frombuffer(random.Random(3).randbytes(400_000), np.uint8)
    _, anchor, *_ = repeats.runs(np.array([0, len(raw)]), raw)
    sizes = np.bincount(repeats.range_of(anchor >> np.uint64(16), 40), minlength=40)
    assert sizes.max() < 1.2 * sizes.mean() and sizes.min() > 0.8 * sizes.mean()


@pytest.mark.parametrize("most", [0, 500_000])
def test_later_copies_take_no_part(spark, monkeypatch, most):
    kept = []

    def held(df, name, *a, f=repeats.materialized, **k):
        out = f(df, name, *a, **k)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(repeats, "COPIES", most)
    monkeypatch.setattr(repeats, "materialized", held)
    text = [random.Random(k).randbytes(300).hex() for k in range(6)]
    rows = [(10 * copy + k, text[k]) for copy in range(4) for k in range(6)] + [(15, text[5]), (None, text[4])]
    for changed in ([], [(40 + k, text[k] + "x" * 60) for k in range(2)]):
        kept.clear()
        got = repeats.dedup(spark.createDataFrame([(*r, None, None, None) for r in rows + changed], SCHEMA).repartition(5)).collect()
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, got)) == brute(rows + changed)
        # whole copies need no runs; changed ones do
        assert [n > 0 for name, n in kept if name == "contexts"] == [bool(changed)]
        assert sum(name == "merged" for name, _ in kept) == repeats.PASSES
