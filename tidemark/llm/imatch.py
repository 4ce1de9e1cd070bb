"""I-Match document fingerprints: hashes of the distinct mid-frequency terms, over several randomised lexicon subsets.

A term is a run of letters and digits, lower-cased. Its document frequency is counted over all documents, and the
lexicon keeps the terms whose inverse document frequency ln(N / df) lies within a band. The band's upper end bounds the
lexicon: terms in at least a share s of the documents number at most (mean distinct terms of a document) / s, whatever
the size of the corpus. That is checked before it is broadcast; beyond MAX_BROADCAST terms the join shuffles instead.

Every term of the lexicon draws the subsets it belongs to from its hash; subset j keeps one term in 2 ** RATES[j]. A
document's distinct terms are sorted within each subset, and each subset that holds any is hashed. The fingerprint is the
list of these hashes, each behind the number of its subset. Most subsets are so sparse that a text of any length has some
that hold a term or two of it: these stay the same with the chance that a term stays, while the few dense ones change
with almost any edit. So the share of hashes that agree grades likeness: among the subsets that hold a term of either
text, the share with equal hashes. A text without any term in a subset has a hash of all its characters as its
fingerprint, and is like only its equals.

Null text counts as an empty one. Ties of doc_id are ordered by text. Repeated rows get a row each. Empty tables give
empty results. Only the id and text columns are read. The work is DataFrame expressions throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import order
from tidemark.llm.common import materialized

#: log2 of one over the share of the lexicon that each subset keeps: few dense subsets, eight of each sparse rate
RATES = (1, 1, 2, 2, *(rate for rate in range(3, 13) for _ in range(8)))
HASH_BITS = 48
LEAST_IDF, MOST_IDF = math.log(5), math.log(2000)
MAX_BROADCAST = 2_000_000
SEPARATOR = r"[^\p{L}\p{N}]+"
END = "\x01"  # stands for no term; holds a document's row together when none of its terms is in the lexicon


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.split(F.lower(text), SEPARATOR))


def memberships(term: Column) -> Column:
    """For each subset that the term belongs to the subset's number in front of HASH_BITS bits of the term's hash."""
    own = F.xxhash64(term, F.lit("code")).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    draws = [F.when(F.xxhash64(term, F.lit(j)).bitwiseAND(F.lit((1 << rate) - 1)) == 0, F.lit(j << HASH_BITS).bitwiseOR(own)) for j, rate in enumerate(RATES)]
    return F.array_compact(F.array(*draws))


def lexicon(docs: DataFrame, text_col: str = "text", least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """term (its 64-bit hash), df and codes (see memberships) of the terms in the band."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = docs.agg(F.count(F.lit(1))).first()[0]
    held = docs.select(F.explode(terms(text)).alias("w")).filter("w <> ''").select(F.xxhash64("w").alias("term"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # df / N within [exp(-most), exp(-least)]
    band = df.filter(F.col("df").between(math.exp(-most_idf) * n, math.exp(-least_idf) * n))
    return band.select("term", "df", memberships(F.col("term")).alias("codes"))


def hashes(codes: Column) -> Column:
    """From the codes of a text's terms the hash of each subset that holds any, behind the subset's number, ascending."""
    none = F.array().cast("array<bigint>")

    def of(code: Column) -> Column:
        return F.shiftright(code, HASH_BITS)

    def entry(state: Column) -> Column:
        return F.array(F.shiftleft(state["subset"], HASH_BITS).bitwiseOR(state["hash"].bitwiseAND(F.lit((1 << HASH_BITS) - 1))))

    def step(state: Column, code: Column) -> Column:
        # sorted codes: the terms of a subset stand together, in order
        same = of(code) == state["subset"]
        fresh = same | (state["subset"] < 0)
        return F.struct(
            of(code).alias("subset"),
            F.when(same, F.xxhash64(state["hash"], code)).otherwise(F.xxhash64(code)).alias("hash"),
            F.when(fresh, state["out"]).otherwise(F.concat(state["out"], entry(state))).alias("out"),
        )

    start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).cast("long").alias("hash"), none.alias("out"))
    return F.aggregate(F.sort_array(codes), start, step, lambda s: F.when(s["subset"] < 0, none).otherwise(F.concat(s["out"], entry(s))))


def shown(found: Column, exact: Column) -> Column:
    """The fingerprint as text."""
    return F.when(F.size(found) == 0, F.concat(F.lit("text:"), exact)).otherwise(F.array_join(F.transform(found, lambda h: F.lower(F.hex(h))), "."))


def likeness(a: Column, b: Column, exact_a: Column, exact_b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either text."""

    def subsets(found: Column) -> Column:
        return F.transform(found, lambda h: F.shiftright(h, HASH_BITS))

    held = F.size(F.array_union(subsets(a), subsets(b)))
    same = F.size(F.array_intersect(a, b))
    return F.when(held == 0, (exact_a == exact_b).cast("double")).otherwise(same / F.greatest(held, F.lit(1)))


def _with_codes(rows: DataFrame, words: DataFrame, keys: list[str], texts: list[str], carried: list[str]) -> DataFrame:
    """keys, carried, and for each text column t its codes as t_codes. keys tell rows apart."""
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried]
    parts = [F.struct(F.lit(i).alias("which"), terms(F.col(t)).alias("held"), *none) for i, t in enumerate(texts)]
    parts.append(F.struct(F.lit(-1).alias("which"), F.array(F.lit(END)).alias("held"), *(F.col(c) for c in carried)))
    wide = rows.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.which", *(f"p.{c}" for c in carried), F.explode("p.held").alias("w"))
    ended = words.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term"), F.array().cast("array<bigint>").alias("codes"))
    known = words.select("term", "codes").unionByName(ended)
    if words.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    found = wide.withColumn("term", F.xxhash64("w")).drop("w").join(known, "term")
    lists = [F.flatten(F.collect_list(F.when(F.col("which") == i, F.col("codes")))).alias(f"{t}_codes") for i, t in enumerate(texts)]
    return found.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in carried), *lists)


def fingerprints(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and hashes (of each subset, 0 where it holds no term) of every document; doc_id has to tell rows
    apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("exact", F.md5("text"))
    coded = _with_codes(rows, words, ["doc_id"], ["text"], ["exact"]).withColumn("found", hashes(F.col("text_codes")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(len(RATES) - 1).cast("long"))
    dense = F.transform(every, lambda j: F.coalesce(F.get(F.filter("found", lambda h: F.shiftright(h, HASH_BITS) == j), F.lit(0)), F.lit(0).cast("long")))
    return coded.select("doc_id", shown(F.col("found"), F.col("exact")).alias("fingerprint"), dense.alias("hashes"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by the beginning of the next
    document's, with the likeness to it and to the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    cuts = order.bounds(rows)
    if not cuts:
        return spark.createDataFrame([], schema)
    words = materialized(lexicon(rows, "text", least_idf, most_idf), "lexicon")
    within = Window.partitionBy("_bucket").orderBy("_guest", "_key", "text")
    inner = order.finer(rows, cuts)
    inner = inner if inner is None else materialized(inner, "inner")
    dealt = order.with_guests(rows, cuts, inner=inner).withColumns({"pos": F.row_number().over(within), "next": F.lead("text").over(within)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.coalesce("next", F.lit("")).substr(F.lit(1), half))
    made = dealt.withColumn("edited", edited).select(
        "_bucket",
        "pos",
        "_guest",
        "doc_id",
        "text",
        "edited",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.md5("text").alias("exact"),
        F.md5("edited").alias("edited_exact"),
    )
    carried = ["_guest", "doc_id", "n_chars", "edited_sha256", "exact", "edited_exact"]
    # grouped by (_bucket, pos) where rows lie by _bucket already, so nothing is shuffled again
    coded = _with_codes(made, words, ["_bucket", "pos"], ["text", "edited"], carried)
    hashed = coded.select("_bucket", "pos", *carried, hashes(F.col("text_codes")).alias("own"), hashes(F.col("edited_codes")).alias("other"))
    after = Window.partitionBy("_bucket").orderBy("pos")
    hashed = hashed.withColumns({"next_own": F.lead("own").over(after), "next_exact": F.lead("exact").over(after)})
    return hashed.filter("_guest = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own"), F.col("exact")).alias("fingerprint"),
        shown(F.col("other"), F.col("edited_exact")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), F.col("exact"), F.col("edited_exact")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), F.col("exact"), F.col("next_exact")).alias("near_next"),
    )
