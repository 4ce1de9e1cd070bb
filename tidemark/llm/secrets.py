"""Secret scans: patterns find candidates, and the corpus-wide ownership of each value tells examples from live ones.

Every value found is hashed, and the hashes are counted over the whole corpus by distinct repositories and distinct
owners. A value is an example that has been copied about if `example_owners` owners hold it in `example_repos`
repositories, or two owners in `wide_repos` repositories. Any other value is its owners' own, however many repositories
of one owner hold it, and if it looks random it is reported as a `live` span. Base spans stay whatever their ownership.

Kinds, in listed order: assign, access, hex (base); pem, jwt, hosted (added patterns); live (added by ownership).
Spans count code points of the whole text, end exclusive, and are leftmost and non-overlapping within a kind; a match
that is too short is dropped after matching, so it still covers its characters. Null text counts as an empty one and has
no spans. Null owners or repositories count as one owner or repository. Repeated rows are scanned each for itself. Empty
tables give empty results. Only the named columns are read.

Ownership is counted in steps that combine before each shuffle, so a value that a third of all rows hold costs each task
one row; the join back is a plain equi-join, which the adaptive planner splits where a value is hot.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialized, worker_state

KINDS = ("assign", "access", "hex", "pem", "jwt", "hosted", "live")
BASE = 3
#: (kind, pattern, group with the value, least length of the value); fixed values
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+"), 0, 64),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 30),
    ("hosted", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"), 0, 14),
)
LEAST_BITS = 2.5


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def find(text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(start, kind, end, value start, value end, hash of the value or 0 if it doesn't look random)."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            value = m[group]
            if len(value) >= least:
                key = int.from_bytes(blake2b(value.encode(), digest_size=8).digest(), "big", signed=True) or 1
                found.append((m.start(), kind, m.end(), m.start(group), m.end(group), key if bits(value) >= LEAST_BITS else 0))
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("v0", pa.int32()), ("v1", pa.int32()), ("hash", pa.int64())])
SCHEMA = (
    "doc_id long, repo string, owner string, text_key binary, base_sha256 string, n_assign long, n_access long, n_hex long, "
    "found array<struct<start:int,kind:int,end:int,v0:int,v1:int,hash:bigint>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("secrets")
    for batch in batches:
        found = [find(t.as_py() or "") for t in batch["text"]]
        base = [[s for s in spans if s[1] < BASE] for spans in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["repo"],
                batch["owner"],
                batch["text_key"],
                pa.array([sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                *(pa.array([sum(s[1] == kind for s in spans) for spans in base], pa.int64()) for kind in range(BASE)),
                pa.array([[dict(zip(("start", "kind", "end", "v0", "v1", "hash"), s, strict=True)) for s in spans] for spans in found], pa.list_(SPAN)),
            ],
            names=["doc_id", "repo", "owner", "text_key", "base_sha256", "n_assign", "n_access", "n_hex", "found"],
        )


def text_key(text_col: str) -> Column:
    return F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))


def scanned(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str, keyed: bool) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        (text_key(text_col) if keyed else F.lit(None).cast("binary")).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    found = rows.mapInArrow(_scan, SCHEMA).withColumn("row_id", F.monotonically_increasing_id())
    return materialized(found, "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of every value that looks random."""
    held = found.select("repo", "owner", F.explode("found.hash").alias("hash")).filter("hash <> 0")
    repos = held.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    # a repository has one owner, so the repositories of all owners add up
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    example_owners: int = 3,
    example_repos: int = 3,
    wide_repos: int = 20,
    keyed: bool = False,
) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, n_copies
    (repositories that hold the most copied of its values), live (spans of live values, array of start and end), and
    text_key, a hash of the text, if `keyed`."""
    found = scanned(docs, id_col, text_col, repo_col, owner_col, keyed)
    values = found.select("row_id", F.explode("found").alias("s")).filter("s.hash <> 0")
    values = values.select("row_id", "s.v0", "s.v1", F.col("s.hash").alias("hash")).distinct()
    copied = (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)
    wide = (F.col("n_owners") > 1) & (F.col("n_repos") >= wide_repos)
    judged = values.join(ownership(found), "hash").withColumn("example", copied | wide)
    live = judged.groupBy("row_id").agg(
        F.collect_set(F.when(~F.col("example"), F.struct(F.col("v0").alias("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("v1").alias("end")))).alias("live"),
        F.sum(F.col("example").cast("long")).alias("n_examples"),
        F.max("n_repos").alias("n_copies"),
    )
    rows = found.join(live, "row_id", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    own = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.sort_array(F.concat(own, F.coalesce("live", none)))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    return rows.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        text.alias("spans"),
        F.size(F.coalesce("live", none)).cast("long").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).alias("n_examples"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.transform(F.sort_array(F.coalesce("live", none)), lambda s: F.struct(s["start"], s["end"])).alias("live"),
        *(["text_key"] if keyed else []),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """docs with every live value replaced by `mark` in the text, and n_chars brought up to date if there is one.
    Documents without a live value come back as they are. Every row comes back once, whether its doc_id is null, repeated
    or its own: live spans follow from the text alone, so they are joined by its hash."""
    live = scan(docs, id_col=id_col, text_col=text_col, keyed=True, **options).filter("n_live > 0")
    key, spans = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("key", "live"))  # no column of docs has these names
    live = live.groupBy(F.col("text_key").alias(key)).agg(F.first("live").alias(spans))
    out = docs.join(live, text_key(text_col) == F.col(key), "left")
    text, found = F.col(text_col), F.col(spans)
    # walking the spans from left to right: what stands between them, and a mark for each (overlapping ones share one)
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] + 1 >= acc["at"]
        between = F.concat(acc["out"], F.substring(text, acc["at"], F.greatest(s["start"] + 1 - acc["at"], F.lit(0))), F.when(fresh, F.lit(mark)).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), between.alias("out"))

    cleaned = F.aggregate(found, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))))
    out = out.withColumn(text_col, F.when(found.isNull(), text).otherwise(cleaned))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found.isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
