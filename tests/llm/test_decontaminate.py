import random
import re
from collections import Counter

from tidemark.llm import decontaminate

DOC = "doc_id long, text string, item_id long, n int, start int"
ITEM = "item_id long, text string, doc_id long"
WORDS = [f"w{i}" for i in range(400)]


def shingles(w):
    g = min(5, len(w))
    return Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1))


def words(t):
    return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]


def brute(docs, items):
    """Every item-sized window of every document."""
    found = {}
    for d, t, *_ in docs:
        w = words(t)
        for i, it, *_ in items:
            v = words(it)
            if not v or not w:
                continue
            b, n = shingles(v), len(v)
            for s in range(-n + 1, len(w)):
                x = w[max(0, s) : max(0, s) + (s + n - max(0, s))]
                if not x or (len(x) < min(5, n)):
                    continue
                a = shingles(x) if n >= 5 else Counter([tuple(x)])
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8:
                    found[d, i] = max(found.get((d, i), 0), sim)
    return found


def made():
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(8, 40))), 7) for i in range(12)]
    items += [(50, "Zeta omega!", 1), (51, None, 1), (52, " ?? ", 1), (53, "la la la la la la la la la la", 1)]
    docs = []
    for d in range(60):
        body = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 120))]
        if d % 3 == 0:
            v = words(items[d % 12][1])
            if d % 2:
                v[len(v) // 2] = "edited"
            body[len(body) // 2 : len(body) // 2] = v
        docs.append((d, " ".join(body).upper() if d % 4 == 0 else ", ".join(body), 1, 1, 1))
    docs += [(100, None, 1, 1, 1), (101, "", 1, 1, 1), (102, "so zeta, Omega end", 1, 1, 1), (103, "la " * 9, 1, 1, 1), (104, items[0][1], 1, 1, 1), (104, items[0][1], 1, 1, 1), (None, items[1][1], 1, 1, 1)]
    return docs, items


def test_same_as_all_windows_by_brute_force(spark):
    docs, items = made()
    got = decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    assert {k: round(v, 9) for k, v in found.items()} == {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len(found) > 10 and (102, 50) in found and (None, 1) in found


def test_clean_documents_stay(spark):
    docs, items = made()
    bad = {d for d, _ in brute(docs, items)}
    got = decontaminate.clean(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)
    assert got.columns == ["doc_id", "text", "item_id", "n", "start"]


def test_blocks_cover_the_radius(spark):
    rnd = random.Random(1)
    for _ in range(300):
        flips = rnd.sample(range(64), decontaminate.RADIUS)
        per = Counter(b // decontaminate.BLOCK_BITS for b in flips)
        assert min(per.get(b, 0) for b in range(decontaminate.BLOCKS)) <= decontaminate.BLOCK_RADIUS


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    full_docs, full_items = (spark.createDataFrame(r, s) for r, s in zip(made(), (DOC, ITEM), strict=True))
    assert decontaminate.leaks(docs, full_items).collect() == []
    assert decontaminate.leaks(full_docs, items).collect() == []
