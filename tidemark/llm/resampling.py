"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features are words between white space, words without ASCII punctuation, and pairs of these, hashed into BUCKETS. The
raw model counts them over all documents, the target model over up to `most_targets` documents that are labelled good
(quality 1, not toxic), picked by the hash of their id. A feature's log ratio is ln((t + K) / (e + K)), where t is its
count in the target text and e the count that the raw model leads to expect there; K keeps rare features neutral.

A document's log_weight is the sum over its features: the log of its importance weight. Weights are tempered by length:
the score is log_weight over the square root of the number of features, so that long texts neither win nor lose by their
length. The sampling key is score / `temperature` plus Gumbel noise from the hash of the id, and the documents with the
`keep` share of greatest keys are selected: a sample without replacement in which each next document is drawn in
proportion to exp(score / temperature). By default `keep` is the share of good ones among labelled documents. The
threshold is found exactly, by histograms of 4096 bins that are narrowed until one key remains; rows that tie with it are
selected too.

Counts are added up in two steps, in slices of buckets, so no task reads what all others have counted.

Texts that are null or without words have null weights and are never selected. Without any labelled good document all
scores are 0. Repeated rows get equal keys. Labels for unknown documents do nothing, and of several labels of a document
the worst counts. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import materialized

BUCKETS = 1 << 18
SMOOTH = 3.0
SLICES, GROUPS = 16, 64
BINS = 4096
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, number of features of each text, their buckets) of parts of the texts."""
    for first, offsets, raw in shingles.parts(texts):
        spaced, n_spaced = shingles.words(offsets, raw)
        plain, n_plain = shingles.words(offsets, _PLAIN[raw])
        owner = np.repeat(np.arange(len(n_plain)), n_plain)
        inner = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
        pairs = shingles.mixed(plain[:-1] * np.uint64(3) + plain[1:])[inner]
        held = np.concatenate((spaced ^ np.uint64(0xA5A5A5A5), plain, pairs))
        of = np.concatenate((np.repeat(np.arange(len(n_spaced)), n_spaced), owner, owner[1:][inner]))
        order = np.argsort(of, kind="stable")
        counts = np.bincount(of, minlength=len(n_plain))
        yield first, counts, (shingles.mixed(held[order]) % np.uint64(BUCKETS)).astype(np.int64)


def log_ratios(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """Log ratio of every bucket; docs: doc_id, text; targets: doc_id, of a bounded number."""

    width, schema = BUCKETS // SLICES, "slice int, part int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch["good"].to_numpy(zero_copy_only=False)
            for first, counts, buckets in features(batch["text"]):
                raw += np.bincount(buckets, minlength=BUCKETS)
                chosen = np.repeat(good[first : first + len(counts)], counts)
                target += np.bincount(buckets[chosen], minlength=BUCKETS)
        group = TaskContext.get().partitionId() % GROUPS
        rows = [(i, group, np.stack((raw, target))[:, i * width : (i + 1) * width].tobytes()) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slice", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch["slice"].to_pylist(), batch["counts"], strict=True):
                own = np.frombuffer(counts.as_buffer(), np.int64)
                held[i] = held[i] + own if i in held else own.copy()
        arrays = [pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["slice", "part", "counts"])

    flagged = docs.join(F.broadcast(targets.withColumn("good", F.lit(True))), "doc_id", "left")
    counted = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(count, schema)
    added = counted.repartition("slice", "part").mapInArrow(add, schema).repartition("slice").mapInArrow(add, schema)
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in added.collect():  # SLICES rows
        at = slice(r["slice"] * width, (r["slice"] + 1) * width)
        raw[at], target[at] = np.frombuffer(r["counts"], np.int64).reshape(2, width)
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + SMOOTH) / (expected + SMOOTH)).astype(np.float32)


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight, score."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, counts, buckets in features(batch["text"]):
                total = np.concatenate(([0.0], np.cumsum(held.value[buckets], dtype=np.float64)))
                ends = np.cumsum(counts)
                n[first : first + len(counts)] = counts
                weight[first : first + len(counts)] = total[ends] - total[ends - counts]
            none = n == 0
            arrays = [pa.array(n), pa.array(weight, mask=none), pa.array(weight / np.sqrt(np.maximum(n, 1)), mask=none)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], names=["doc_id", "n_features", "log_weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, log_weight double, score double")


def threshold(keys: DataFrame, k: int) -> float | None:
    """The k-th greatest value of the column `key`; None if k is 0. The driver sees BINS rows a round."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    k = min(k, n)
    if k <= 0:
        return None
    while low < high:
        width = (high - low) / BINS
        if low + width == low:
            return low
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1)).alias("bin")
        found = keys.filter(F.col("key").between(low, high)).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if r["n"] >= k:
                low, high, exact = r["low"], r["high"], r["n"] == k
                break
            k -= r["n"]
        if exact:
            return low
    return low


def noise(id_: Column, seed: int) -> Column:
    """Standard Gumbel noise from the hash of an id."""
    uniform = (F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def good_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and good: quality 1 and not toxic; a null counts as neither."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(good).alias("good"))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = 1, most_targets: int = 20_000, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, log_weight, score, key, selected of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judged = good_labels(labels)
    n, n_good = judged.agg(F.count(F.lit(1)), F.sum(F.col("good").cast("int"))).first()
    share = min(1.0, most_targets / max(n_good or 0, 1))
    # every id has the same chance, by its hash, so about most_targets are broadcast whatever the number of labels
    targets = judged.filter(F.col("good") & (F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 30)) < int(share * (1 << 30)))).select("doc_id")
    if keep is None:
        keep = (n_good or 0) / n if n else 1.0
    scored = weighed(docs, log_ratios(docs, targets)).withColumn("key", F.col("score") / temperature + noise(F.col("doc_id"), seed))
    scored = materialized(scored, "scores")
    least = threshold(scored, round(keep * scored.count()))
    chosen = F.lit(False) if least is None else F.coalesce(F.col("key") >= least, F.lit(False))
    return scored.withColumn("selected", chosen)
