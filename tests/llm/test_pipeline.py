import random
import time

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tidemark.llm import bpe, common, secrets  # noqa: E402
from tests.llm.test_decontaminate import brute as leaks  # noqa: E402
from tests.llm.test_ngram_join import brute as groups  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rnd = random.Random(12)
    english = "the house and this that with from have where would some other people".split()
    german = "der und nicht eine werden schon über zwischen haben ist auch noch".split()
    items = [(i, " ".join(rnd.choice(english + german) + str(rnd.randrange(30)) for _ in range(25)), 0) for i in range(3)]
    rows = []
    for i in range(60):
        w = [rnd.choice(german if i % 3 == 0 else english) + (str(rnd.randrange(9)) if rnd.random() < 0.3 else "") for _ in range(60)]
        if i % 10 == 1:
            w = w[:20] + items[i % 3][1].split() + w[20:]
        if i % 10 == 2:
            w += ["token", "=", "q8Zr4Tn1Vb6Xc3Ym" if i > 30 else f"k{i}Lw9Qx2Rf7Hd5Ps"]
        rows.append((i, " ".join(w), "de" if i % 3 == 0 else "en", f"s{i % 7}"))
    rows += [(100 + i, rows[i][1] + " extra", rows[i][2], "s1") for i in range(0, 20, 4)]
    rows += [(200, None, "en", "s1"), (201, "", "en", "s1"), (202, "123 456", "en", "s1")]
    return [(*r, len(r[1] or "")) for r in rows], items


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, items = made()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, x int").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        seen.append(docs)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r["doc_id"]: r for r in d.collect()} for d in seen]
    assert set(ids[0]) == {r[0] for r in rows} - {200, 201, 202}
    kept = [r for r in rows if r[0] in ids[0]]
    assert set(ids[1]) == {c for _, _, c in groups(kept, 5, 80)}
    kept = [r for r in kept if r[0] in ids[1]]
    bad = {d for d, _ in leaks(kept, items)}
    assert bad and set(ids[2]) == {r[0] for r in kept} - bad
    assert set(ids[3]) == set(ids[2])
    changed = {d for d in ids[3] if ids[3][d]["text"] != ids[2][d]["text"]}
    assert changed and all("[SECRET]" in ids[3][d]["text"] and ids[3][d]["n_chars"] == len(ids[3][d]["text"]) for d in changed)
    assert changed == {d for d in ids[2] if secrets.find(ids[2][d]["text"])} - {d for d in ids[2] if "q8Zr4Tn1Vb6Xc3Ym" in ids[2][d]["text"]}
    vocabulary = bpe.Vocabulary(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    for d, r in ids[4].items():
        assert vocabulary.decode(np.array(r["ids"])).decode() == ids[3][d]["text"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == sorted(ids[4])


def test_empty_tables_go_through(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows, items = made()
    value = "9f8e7d6c5b4a39281706f5e4"
    text = f"the house and this that with from have where would some other people token = {value} house where have"
    more = [(None, text, "en", "s1", 1), (None, text, "en", "s1", 1), (7, rows[7][1], "en", "s1", 1), (7, rows[7][1], "en", "s1", 1), (None, None, None, None, None)]
    sf = str(tmp_path)
    extra = "rejected string, live string, margin string, key string, h string, `a.b` string"
    docs = spark.createDataFrame([(*r, "r", "l", "m", "k", "h", "d") for r in rows + more], f"{SCHEMA}, {extra}")
    spark.createDataFrame(items, "item_id long, text string, x int").write.parquet(f"{sf}/benchmark.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
    got = docs.collect()
    assert all(tuple(r)[5:] == ("r", "l", "m", "k", "h", "d") for r in got)
    own = [r["text"] for r in got if r["doc_id"] is None]
    assert own == [text.replace(value, "[SECRET]")]
    assert sum(r["doc_id"] == 7 for r in got) == 1


def states(spark):
    """What the Python workers hold, each told once by as many tasks as there are cores."""

    def told(batches):
        time.sleep(0.5)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(common._HELD)] * batch.num_rows)], names=["s"])

    cores = spark.sparkContext.defaultParallelism
    return {r["s"] for r in spark.range(0, cores, 1, cores).mapInArrow(told, "s string").collect()}


def test_released_workers_hold_nothing_of_the_step_before(spark):
    def holding(batches):
        common.worker_state("large", lambda: bytes(1 << 20))
        time.sleep(0.5)
        yield from batches

    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).mapInArrow(holding, "id long").collect()
    common.released(spark, workers=False)
    assert "large" in states(spark)
    common.released(spark)
    assert states(spark) == {"released"}


def test_every_stage_begins_with_memory_given_back(spark, tmp_path, monkeypatch):
    rows, items = made()
    sf, calls = str(tmp_path), []
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(items, "item_id long, text string, x int").write.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "released", lambda s, workers=True: calls.append((name, workers)))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf)
    # decontaminate keeps to DataFrame operations, so the workers are seen to at the end of the stage before it
    assert calls == [("language", True), ("near_duplicates", True), ("near_duplicates", True), ("decontaminate", False), ("secrets", True), ("bpe", True)]
