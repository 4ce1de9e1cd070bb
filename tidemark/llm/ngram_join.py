"""N-gram Jaccard self-join with connected components: size-aware, heavy sets by lists and light sets by subsets.

A document's set is the set of its distinct word shingles. Two documents link when their Jaccard similarity is at least
per_cent / 100; the result is exact. Equal sets are joined first, by a hash of the set, so copies never meet one by one.

Light sets (up to a boundary size) are joined by subsets: a linked pair shares a subset that holds at least per_cent of
either set, so each set lists its subsets of those few fixed sizes by hash. Whoever shares a subset is linked to the
smallest set that has it, if similar enough; a pair that links is linked to it both times, so the components are right
without any pair being listed.

Heavier sets are joined by inverted lists. Shingles are put in one order for all, those found in many documents last and
the others by hash; a linked pair shares a shingle among the first (100 - per_cent) % of the larger set and a smaller
part of the other, so only these are listed. Each list is scanned by size: a pair is kept if the sizes allow a link and if the parity sketches do. A sketch
has SKETCH bits (NARROW for long lists), each flipped by the shingles that hash to it, so two sketches never differ in more bits than the sets
differ in shingles: nothing that links is lost. Pairs are held against wider sketches of the same kind next, twice as
wide as the sets are large, and what is left is verified with the sets themselves.

The boundary is the one with the least total cost, from the counts of all sizes. A list longer than LONG gives, in a
first round, one pair for each member with a leader it may link with; after these are verified, a second round takes
only pairs whose members are still in different components, so a dense group costs its size, not the square. Lists longer
than BLOCK are parted by bands of sizes, of which only neighbours can link, and dealt out in pairs of blocks of these. Memory goes with a block and with the longest text, not with groups.

Null, empty and blank texts have no set and link with nothing; their component is their own doc_id. Rows with a null
doc_id take part, and a component of such rows alone has a null component_id. Repeated rows get a row each. Empty tables
give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import discard, materialized, worker_state
from tidemark.llm.components import components

LIGHTEST = 32  # largest boundary that is weighed
SKETCH = 128
LONG, BLOCK = 16, 2048
NARROW = 512  # bits of the sketches that long lists are scanned with
WIDEST = 1 << 14  # bits of the widest sketch that pairs are held against
HEAVY_SHARE = 1000  # a shingle found in one document of so many is put last
HEAVY_PART = 3
VERIFY_COST = 4  # of a pair, against listing a shingle
NO_ID = (1 << 63) - 1
SET_COLUMNS = "doc_id long, th long, n long, h1 long, h2 long, tokens array<long>, narrow binary, wide binary"
PAIRS = "a long, b long"


def kept(n: int, per_cent: int) -> int:
    """The least number of its n shingles that a set shares with a set it links with."""
    return -(-per_cent * n // 100)


def listed(n: int, per_cent: int) -> int:
    return n - kept(n, per_cent) + 1


def indexed(n: int, per_cent: int) -> int:
    """How many of its first shingles a set need share with a set that is no smaller and links with it."""
    return n + (-2 * per_cent * n // (100 + per_cent)) + 1


def subsets(n: int, per_cent: int) -> int:
    return sum(comb(n, d) for d in range(n - kept(n, per_cent) + 1))


def _signed(x) -> int:
    x = int(x)
    return x - (1 << 64) if x >> 63 else x


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """Bytes of the parity sketch whose width, a power of two, is at least twice the size of the set."""
    width = min(WIDEST, max(NARROW, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(wide: np.ndarray, size: int) -> np.ndarray:
    """The sketch of `size` bytes that the same set has."""
    return np.bitwise_xor.reduce(wide.reshape(-1, size), axis=0)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return _signed(np.add.reduce(shingles.mixed(s ^ np.uint64(0x5851F42D4C957F2D)))), _signed(np.bitwise_xor.reduce(shingles.mixed(s + np.uint64(0x14057B7EF767814F))))


def heavy_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles found in about one document of HEAVY_SHARE or more, ascending. One that common is that common in some
    part of the documents, so counting what is common within each part finds it; at most HEAVY_SHARE times the mean size
    of a set come back."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, taken = [], 0
            last = batch.num_rows - 1
            for i, s in shingles.sets(batch["text"], size):
                held.append(s)
                taken += len(s)
                if taken > 500_000 or i == last:
                    found, n = np.unique(np.concatenate(held), return_counts=True)
                    often = n >= max(HEAVY_PART, len(held) // HEAVY_SHARE)
                    yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["s", "n"])
                    held, taken = [], 0

    n = docs.count()
    found = docs.select("text").mapInArrow(common, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= max(HEAVY_PART, n // HEAVY_SHARE)).select("s").toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).view(np.uint64))


def document_sets(docs: DataFrame, size: int, per_cent: int, heavy: np.ndarray, whole: bool = False) -> DataFrame:
    """SET_COLUMNS of every document: tokens are all shingles of a set of up to LIGHTEST (or of all if whole), otherwise
    those to be listed; always in the common order."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    held = docs.sparkSession.sparkContext.broadcast(heavy)  # bounded, see heavy_shingles
    names = [c.split()[0] for c in SET_COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = held.value
        worker_state("sets")
        for batch in batches:
            rows = []
            for _, s in shingles.sets(batch["text"], size):
                if not len(s):
                    rows.append((0, 0, 0, [], b"", b""))
                    continue
                is_late = late[np.searchsorted(late, s).clip(max=len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
                tokens = np.concatenate((s[~is_late], s[is_late])) if is_late.any() else s
                if not whole and len(s) > LIGHTEST:
                    tokens = tokens[: listed(len(s), per_cent)]
                wide = wide_sketch(s)
                rows.append((len(s), *identity(s), tokens.view(np.int64), folded(wide, SKETCH // 8).tobytes(), wide.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.mapInArrow(run, SET_COLUMNS)


def boundary(sizes: dict[int, int], list_length: float, per_cent: int) -> int:
    """The size up to which subsets cost less than lists, from the number of sets of each size up to LIGHTEST."""

    def cost(x: int) -> float:
        by_subset = sum(n * subsets(k, per_cent) for k, n in sizes.items() if k <= x)
        by_list = sum(n * listed(k, per_cent) * (1 + VERIFY_COST * list_length) for k, n in sizes.items() if k >= kept(x + 1, per_cent))
        return by_subset + by_list

    return min(range(LIGHTEST + 1), key=lambda x: (cost(x), x))


def light_links(classes: DataFrame, per_cent: int, most: int) -> DataFrame:
    """Links among sets of up to `most` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, rows = [], [], []
            for row, (n, tokens) in enumerate(zip(batch["n"].to_pylist(), batch["tokens"].to_pylist(), strict=True)):
                weights = shingles.mixed(np.array(tokens, np.int64).view(np.uint64))
                total = weights.sum(dtype=np.uint64)
                for d in range(n - kept(n, per_cent) + 1):
                    without = np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)
                    found = shingles.mixed(total - weights[without].sum(axis=1, dtype=np.uint64) + np.uint64(n - d))
                    keys.append(found.view(np.int64))
                    sizes.append(np.full(len(found), n - d, np.int64))
                    rows.append(np.full(len(found), row, np.int64))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), batch["cid"].take(at), batch["n"].take(at)], names=["key", "c", "cid", "n"])

    # sets of fewer shingles than this link with equal ones only
    least = next(n for n in range(1, 1000) if kept(n, per_cent) < n)
    rows = classes.filter(F.col("n").between(least - 1, most)).select("cid", "n", "tokens").mapInArrow(run, "key long, c long, cid long, n long")
    least_set = rows.groupBy("key", "c").agg(F.min(F.struct("n", "cid")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = rows.join(least_set.select("key", "c", F.col("m.n").alias("m"), F.col("m.cid").alias("b")), ["key", "c"])
    return met.filter((F.col("cid") != F.col("b")) & (100 * F.col("c") >= per_cent * (F.col("n") + F.col("m") - F.col("c")))).select(F.col("cid").alias("a"), "b")


def _may_link(na: np.ndarray, nb: np.ndarray, bits: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sets of these sizes can link when they differ in so many shingles at least."""
    common = -(-per_cent * (na + nb) // (100 + per_cent))
    return (100 * np.minimum(na, nb) >= per_cent * np.maximum(na, nb)) & (bits <= na + nb - 2 * common)


def _scan(rows: dict[str, np.ndarray], per_cent: int, most_light: int, second: bool) -> np.ndarray:
    """Pairs of cid of whole lists, which stand one after the other, each by size."""
    n, cid, part, group, first = (rows[c] for c in ("n", "cid", "part", "own", "first"))
    sketches = rows["sketch"]
    starts = np.flatnonzero(np.concatenate(([True], np.any([rows[c][1:] != rows[c][:-1] for c in ("token", "lo", "hi")], axis=0))))
    lengths = np.diff(np.concatenate((starts, [len(n)])))
    found: list[np.ndarray] = []

    def pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the smaller of the two comes first, and its share of the list is shorter
        i, j = i[first[i]], j[first[i]]
        bits = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
        ok = _may_link(n[i], n[j], bits, per_cent) & (np.maximum(n[i], n[j]) > most_light) & (cid[i] != cid[j])
        # in a list dealt in blocks, members of one block meet in that block alone
        ok &= (rows["lo"][i] == rows["hi"][i]) | (part[i] != part[j])
        if second:
            ok &= group[i] != group[j]
        return i[ok], j[ok]

    short = lengths <= LONG if not second else np.zeros(len(lengths), bool)
    left = np.repeat(np.where(short, lengths, 0), lengths) - (np.arange(len(n)) - np.repeat(starts, lengths))
    at = np.flatnonzero(left > 1)
    for k in range(1, LONG):
        at = at[left[at] > k]
        if not len(at):
            break
        i, j = pairs(at, at + k)
        found.append(np.stack((cid[i], cid[j]), axis=1))
    for start, length in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
        led = np.zeros(length, bool)
        for at in range(start, start + length - 1):
            if not second and led[at - start]:
                continue  # some leader has it
            last = start + np.searchsorted(n[start : start + length], 100 * n[at] // per_cent, "right")
            j = np.arange(at + 1, last)
            if not second:
                j = j[~led[j - start]]
            _, j = pairs(np.full(len(j), at), j)
            led[j - start] = True
            found.append(np.stack((np.full(len(j), cid[at]), cid[j]), axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(out, axis=1), axis=0) if len(out) else out


def list_pairs(postings: DataFrame, per_cent: int, most_light: int, second: bool) -> DataFrame:
    """Distinct pairs that lists let through; postings: token, lo, hi, part, cid, n, first, own, sketch (binary, of one
    size)."""
    names = ("token", "lo", "hi", "part", "cid", "n", "first", "own")

    def sketched(column: pa.Array) -> np.ndarray:
        _, _, data = column.buffers()
        size = len(column[0].as_buffer())
        return np.frombuffer(data, np.uint64, len(column) * size // 8, column.offset * size).reshape(len(column), size // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scanned(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            out = _scan(rows, per_cent, most_light, second)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in names} | {"sketch": sketched(batch["sketch"])}
            if held is not None:
                rows = {c: np.concatenate((held[c], x)) for c, x in rows.items()}
            new = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in ("token", "lo", "hi")], axis=0))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last list may go on in the next batch
            if cut:
                yield scanned({c: x[:cut] for c, x in rows.items()})
            held = {c: x[cut:] for c, x in rows.items()}
        if held is not None and len(held["n"]):
            yield scanned(held)

    dealt = postings.select(*names, "sketch").repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "cid")
    return dealt.mapInArrow(run, PAIRS).distinct()


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [folded(np.frombuffer(w.as_buffer(), np.uint8), NARROW // 8).tobytes() for w in batch["w"]]
        yield pa.RecordBatch.from_arrays([batch["cid"], pa.array(made, pa.binary())], names=["cid", "sketch"])


def near(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """The pairs that the wide sketches let through."""
    own = classes.select("cid", "n", "wide")
    met = pairs.join(own.toDF("a", "na", "wa"), "a").join(own.toDF("b", "nb", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, wa, wb in zip(batch["na"].to_pylist(), batch["nb"].to_pylist(), batch["wa"], batch["wb"], strict=True):
                x, y = np.frombuffer(wa.as_buffer(), np.uint8), np.frombuffer(wb.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                bits = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep.append(bits <= na + nb - 2 * -(-per_cent * (na + nb) // (100 + per_cent)))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return met.mapInArrow(run, PAIRS)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """The pairs whose sets are similar enough, by the sets themselves, made again from the texts of the classes that the
    wide sketches leave."""
    pairs = materialized(near(pairs, classes, per_cent), "near")
    met = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    picked = classes.join(met, "cid").select(F.col("rep").alias("key"), "cid", "n", "h1", "h2")
    texts = docs.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).join(picked.select("key").distinct(), "key").select("doc_id", "text")
    found = document_sets(texts, size, per_cent, np.zeros(0, np.uint64), whole=True)
    sets = found.join(picked, ["n", "h1", "h2"]).groupBy("cid").agg(F.first("tokens").alias("held"))
    sets = materialized(sets, "sets")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("held").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= per_cent * (F.size("x") + F.size("y") - common)).select("a", "b")


def long_lists(postings: DataFrame, per_cent: int) -> DataFrame:
    """token and bands (band -> blocks; null if the list isn't dealt out) of the lists longer than LONG."""
    per = postings.groupBy("token", band(F.col("n"), per_cent).alias("band")).agg(F.count(F.lit(1)).alias("k"))
    # sizes up to a million make a few hundred bands at most
    bands = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("k") / BLOCK).cast("int"))))
    lists = per.groupBy("token").agg(F.sum("k").alias("k"), bands.alias("bands")).filter(F.col("k") > LONG)
    return lists.select("token", F.when(F.col("k") > BLOCK, F.col("bands")).alias("bands"))


def band(n: Column, per_cent: int) -> Column:
    """Sets that link lie in the same band of sizes or in neighbouring ones, as each is wider than 100 / per_cent."""
    return F.floor(F.log(n.cast("double")) / log(1.001 * 100 / per_cent)).cast("int")


#: blocks of a band are numbered below this
IN_BAND = 1 << 20


def blocks_of(per_cent: int) -> tuple[Column, Column]:
    """(the block of a posting, those whose postings it meets) from cid, n and bands; 0 in a list that isn't dealt."""
    own = band(F.col("n"), per_cent)
    block = own * IN_BAND + F.pmod(F.xxhash64("cid"), F.element_at("bands", own)).cast("int")

    def all_of(b: Column) -> Column:
        count = F.coalesce(F.try_element_at("bands", b), F.lit(0))
        numbers = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: b * IN_BAND + i)

    met = F.concat(all_of(own - 1), all_of(own), all_of(own + 1))
    none = F.col("bands").isNull()
    return F.when(none, 0).otherwise(block), F.when(none, F.array(F.lit(0))).otherwise(met)


def grouped(docs: DataFrame, size: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = _grouped(docs, size, per_cent, id_col, text_col)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(F.coalesce("name", "key"), F.lit(NO_ID)).alias("component_id"))


def _grouped(docs: DataFrame, size: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (doc_id, or NO_ID), th (hash of the text), n and name (the least key of the component; null without a
    set) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    heavy = heavy_shingles(docs, size)
    found = document_sets(docs, size, per_cent, heavy).withColumn("cid", F.xxhash64("n", "h1", "h2"))
    found = materialized(found.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))), "sets")
    rows = found.select("doc_id", "key", "th", "n", "cid")
    by = found.filter("n > 0").groupBy("cid", "n", "h1", "h2")
    classes = by.agg(F.min("key").alias("rep"), F.first("tokens").alias("tokens"), F.first("narrow").alias("narrow"), F.first("wide").alias("wide"))
    classes = materialized(classes, "classes")
    rows = materialized(rows, "rows")
    discard(found)  # the sets are with their classes now

    prefix = F.slice("tokens", 1, (F.col("n") - F.ceil(F.lit(per_cent) * F.col("n") / 100) + 1).cast("int"))
    sizes = {r["n"]: r["k"] for r in classes.filter(F.col("n") <= LIGHTEST).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    total = classes.select(F.explode(prefix).alias("t")).agg(F.count(F.lit(1)), F.approx_count_distinct("t")).first()
    most_light = boundary(sizes, total[0] / max(total[1], 1), per_cent)

    heavier = classes.filter(F.col("n") >= kept(most_light + 1, per_cent))
    few = F.col("n") - F.ceil(F.lit(2 * per_cent) * F.col("n") / (100 + per_cent)) + 1
    postings = heavier.select(F.posexplode(prefix).alias("at", "token"), "cid", "n", F.col("narrow").alias("sketch"), few.alias("few"))
    postings = postings.withColumn("first", F.col("at") < F.col("few")).drop("at", "few")
    longer = materialized(long_lists(postings, per_cent), "long")
    part, met = blocks_of(per_cent)
    others = F.explode(met).alias("other")

    def dealt(rows_: DataFrame, how: str) -> DataFrame:
        spread = rows_.join(longer, "token", how).withColumn("part", part).select("*", others)
        return spread.select("token", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cid", "n", "first", "own", "sketch")

    pairs = materialized(list_pairs(dealt(postings.withColumn("own", F.col("cid")), "left"), per_cent, most_light, False), "pairs")
    links = verified(pairs, classes, docs, size, per_cent).unionByName(light_links(classes, per_cent, most_light))
    links = materialized(links, "links")
    if longer.limit(1).count():
        joined = materialized(components(links), "first")
        own = postings.join(longer.select("token"), "token").join(joined, F.col("cid") == F.col("node"), "left")
        own = own.withColumn("own", F.coalesce("component", "cid")).select("token", "cid", "n", "first", "own")
        narrow = classes.select("cid", F.col("wide").alias("w")).mapInArrow(_narrowed, "cid long, sketch binary")
        more = materialized(list_pairs(dealt(own.join(narrow, "cid"), "inner"), per_cent, most_light, True), "more")
        links = links.unionByName(verified(more.join(pairs, ["a", "b"], "left_anti"), classes, docs, size, per_cent))
    whole = components(links)
    # a component is named by the least doc_id of its classes
    named = classes.select("cid", "rep").join(whole, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialized(named.select("cid", "rep", "component"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("component", "least")
    names = named.join(least, "component", "left").select("cid", F.coalesce("least", "rep").alias("name"))
    return rows.join(names, "cid", "left").select("doc_id", "key", "th", "n", "name")


def first_of_each(docs: DataFrame, size: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that of the least doc_id (nulls last), of several such rows one with the least
    hash of the text, and of rows that agree in both any one. Rows whose text has no word stay, repeated or not."""
    rows = materialized(_grouped(docs, size, per_cent, id_col, text_col).filter("n > 0").groupBy("name", "key", "th").agg(F.count(F.lit(1)).alias("k")), "members")
    stays = materialized(rows.groupBy("name").agg(F.min(F.struct("key", "th", "k")).alias("s")).select("s.*"), "first")
    mark = uuid.uuid4().hex[:8]

    def of(found: DataFrame):
        own = found.select(F.col("key").alias(f"_key_{mark}"), F.col("th").alias(f"_th_{mark}"))
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
        return own, (key == F.col(f"_key_{mark}")) & (F.xxhash64(F.col(text_col)) == F.col(f"_th_{mark}"))

    out = docs.join(*of(rows.join(stays, ["key", "th"], "left_anti")), "left_anti")
    repeated = stays.filter("k > 1").select("key", "th")
    if repeated.limit(1).count():
        once = docs.join(*of(repeated), "left_semi").withColumns({f"_k_{mark}": F.col(id_col).cast("long"), f"_t_{mark}": F.xxhash64(F.col(text_col))})
        once = once.dropDuplicates([f"_k_{mark}", f"_t_{mark}"]).drop(f"_k_{mark}", f"_t_{mark}")
        out = out.join(*of(repeated), "left_anti").unionByName(once)
    return out
