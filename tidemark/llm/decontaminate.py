"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted verification.

Words are runs of letters and digits, lower-cased; shingles are five words (an item of fewer words is one shingle). For
every benchmark item, windows of the item's length are laid over the documents wherever a document holds one of the
item's shingles, aligned so that the shingle falls at its place in the item; a window without any of them has
similarity 0, so nothing is lost. A window is clipped where its document ends. Each window's shingles give a 64-bit
SimHash, weighted by how often each occurs. The fingerprints are cut into BLOCKS blocks, and every item is listed under
all values within BLOCK_RADIUS bits of each of its blocks: two fingerprints within RADIUS bits agree that closely in some
block, so the equi-join on (length, block, value) finds every pair within RADIUS. The pairs left are verified by the
exact weighted Jaccard similarity of their shingles, sum of least over sum of greatest counts, at 0.8 or more.

Equal texts are searched once, by their hash. Null and empty texts, and items without a word, match nothing. Null
doc_ids are reported as null. Repeated rows give equal rows. Empty tables give empty results. Only the named columns are
read. The benchmark side is broadcast only up to MAX_BROADCAST bytes, which are added up; beyond that the joins shuffle.
The work is DataFrame expressions throughout.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialized

SHINGLE, SIMILAR = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
MAX_BROADCAST = 64 << 20
ROW_BYTES = 64  # of a row besides its arrays
SHORT = 256  # up to so many hashes places are looked up one by one
SEPARATOR = r"[^\p{L}\p{N}]+"
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def grams(held: Column, size: Column | int) -> Column:
    """Hashes of all runs of `size` words; of the whole if there are fewer."""
    size = F.lit(size) if isinstance(size, int) else size
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(held) - size, F.lit(0))), lambda i: F.xxhash64(F.slice(held, i + 1, size)))
    return F.when(F.size(held) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def numbered(held: Column) -> Column:
    """Hashes in which repeats differ by their number, so that set operations count them."""
    held = F.sort_array(held)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(24))))

    def below(h: Column) -> Column:
        """How many are less than h: by halving, so that a long item doesn't cost the square of its length."""

        def step(at: Column, by: Column) -> Column:
            return F.when(F.coalesce(F.get(held, at + by - 1) < h, F.lit(False)), at + by).otherwise(at)

        return F.aggregate(steps, F.lit(0), step).cast("long") + 1

    def all_numbered(first) -> Column:
        return F.transform(held, lambda h, i: F.xxhash64(h, i.cast("long") - first(h)))

    return F.when(F.size(held) <= SHORT, all_numbered(lambda h: F.array_position(held, h))).otherwise(all_numbered(below))


def simhash(held: Column) -> Column:
    """64-bit SimHash of hashes, each weighing as often as it occurs."""
    ones = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(held, F.lit(0), lambda acc, h: acc + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int")),
    )
    # a bit is set where more than half of the hashes have it
    bits = F.transform(ones, lambda n, b: F.when(n * 2 > F.size(held), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def block_values(fingerprint: Column, radius: int) -> Column:
    """(block, value) of each block, and of all values within radius bits of it."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BLOCK_BITS), r)]
    held = F.array(*map(F.lit, masks))

    def around(block: int) -> Column:
        value = F.shiftright(fingerprint, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        return F.transform(held, lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*map(around, range(BLOCKS)))


def small(df: DataFrame, arrays: tuple[str, ...] = ()) -> DataFrame:
    """df with a broadcast hint if its bytes add up to little enough; arrays: its columns of hashes."""
    size = F.lit(ROW_BYTES).cast("long")
    for c in arrays:
        size = size + 8 * F.size(c)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST else df


def indexed(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, n (words), g (words of a shingle), held (shingles), fingerprint of every item with a word."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    items = items.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("g"), "w")
    items = items.withColumn("held", grams(F.col("w"), F.col("g"))).drop("w")
    return items.withColumn("fingerprint", simhash(F.col("held")))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR
) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the window's beginning), distance and text_md5: the best window of
    every document and item that match."""
    items = materialized(indexed(benchmark, item_id_col, item_text_col), "items")
    sizes = [r["g"] for r in items.select("g").distinct().collect()]  # SHINGLE values at most
    schema = "doc_id long, item_id long, similarity double, start int, distance int, text_md5 string"
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    text = F.col(text_col)
    rows = docs.filter(text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("text_md5"))

    # places of benchmark shingles in the documents, and the windows that they call for
    parts = small(items.select("item_id", "n", "g", F.posexplode("held").alias("at", "h")))
    held = rows.withColumn("w", words(F.col("text")))
    anchors = None
    for g in sorted(sizes):
        own = held.filter(F.size("w") >= g).select("doc_id", "text_md5", F.posexplode(grams(F.col("w"), g)).alias("pos", "h"))
        found = own.join(parts.filter(F.col("g") == g), "h").select("doc_id", "text_md5", "n", "g", (F.col("pos") - F.col("at")).alias("start"))
        anchors = found if anchors is None else anchors.unionByName(found)
    wanted = materialized(anchors.distinct(), "windows")

    # one document for each text; its windows' shingles
    first = wanted.groupBy("text_md5").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("key"))
    windows = wanted.select("text_md5", "n", "g", "start").distinct()
    texts = rows.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).join(first, ["key", "text_md5"]).select("text_md5", "text").distinct()
    cut = texts.select("text_md5", words(F.col("text")).alias("w")).join(windows, "text_md5")
    from_, to = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("n"), F.size("w"))
    cut = cut.withColumn("held", grams(F.slice("w", from_ + 1, to - from_), F.col("g"))).drop("w")
    cut = materialized(cut.withColumn("fingerprint", simhash(F.col("held"))), "fingerprints")

    # windows and items within RADIUS bits
    listed = small(items.select("item_id", "n", F.col("fingerprint").alias("item_fp"), F.explode(block_values(F.col("fingerprint"), BLOCK_RADIUS)).alias("v")))
    listed = listed.select("item_id", "n", "item_fp", "v.block", "v.value")
    probes = cut.select("text_md5", "n", "start", "fingerprint", F.explode(block_values(F.col("fingerprint"), 0)).alias("v"))
    probes = probes.select("text_md5", "n", "start", "fingerprint", "v.block", "v.value")
    near = probes.join(listed, ["n", "block", "value"]).withColumn("distance", F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fp"))))
    near = near.filter(F.col("distance") <= RADIUS).select("text_md5", "n", "start", "item_id", "distance").distinct()

    # exact weighted similarity
    pairs = near.join(cut.select("text_md5", "n", "start", numbered(F.col("held")).alias("a")), ["text_md5", "n", "start"])
    pairs = pairs.join(small(items.select("item_id", numbered(F.col("held")).alias("b")), ("b",)), "item_id")
    both = F.size(F.array_intersect("a", "b"))
    judged = pairs.withColumn("similarity", both / (F.size("a") + F.size("b") - both)).filter(F.col("similarity") >= similar)
    best = judged.groupBy("text_md5", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))).alias("m"))
    owners = wanted.select("doc_id", "text_md5").distinct()
    return best.join(owners, "text_md5").select(
        "doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.s")).alias("start"), (-F.col("m.d")).alias("distance"), "text_md5"
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark item was found; rows without a text stay."""
    found = leaks(docs, benchmark, text_col=text_col, **options).select(F.col("text_md5").alias("_leaked")).distinct()
    return docs.join(materialized(found, "leaked"), F.md5(F.col(text_col)) == F.col("_leaked"), "left_anti")
