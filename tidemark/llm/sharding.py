"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS cells; every shard owns `replicas` of them (virtual nodes), and a cell belongs to the next virtual
node clockwise. A row's cell comes from the hash of its text, so equal texts start at the same place. A shard holds at
most its load: rows that find it full continue clockwise to the next shard that is not. The loads add up to exactly the
number of rows, so row counts differ by one at most, and only the rows of full shards move.

Rows are dealt by slices (cell, part of the cell): a cell with many rows, such as a large group of equal texts, is
divided by the hash of doc_id, so no task ever gets a hot cell whole. The driver sees one count for each slice; there
are at most CELLS + MAX_PARTS of them, however many rows there are.

Null text counts as an empty one. Repeated rows get a slot each. An empty table gives an empty result. Only doc_id and
the text column are read; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = 4096
MAX_PARTS = 32768
LEAST_PART = 64


def ring(n_shards: int, replicas: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, by cell. Two nodes never share a cell: the later one moves on."""
    if n_shards * replicas > CELLS:
        raise ValueError(f"{n_shards} x {replicas} virtual nodes do not fit {CELLS} cells")
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for copy in range(replicas):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{copy}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def loads(n_rows: int, n_shards: int) -> list[int]:
    return [n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)]


def clockwise(nodes: list[tuple[int, int]], n_shards: int) -> list[list[int]]:
    """For every cell the distinct shards in the order in which they are met clockwise."""
    after: list[list[int]] = []
    for start in range(len(nodes)):
        seen: dict[int, None] = {}
        for step in range(len(nodes)):
            seen.setdefault(nodes[(start + step) % len(nodes)][1])
            if len(seen) == n_shards:
                break
        after.append(list(seen))
    cells = [cell for cell, _ in nodes]
    return [after[bisect_left(cells, cell) % len(nodes)] for cell in range(CELLS)]


def place(slices: list[tuple[int, int, int]], n_shards: int, replicas: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (cell, part, first rank, last rank, shard, slot of the first): each slice goes to its first shard that
    isn't full, and what does not fit continues clockwise."""
    free, used = loads(sum(n for _, _, n in slices), n_shards), [0] * n_shards
    order = clockwise(ring(n_shards, replicas), n_shards)
    pieces = []
    for cell, part, n in sorted(slices):
        rank = 1
        for shard in order[cell]:
            if n == 0:
                break
            if (take := min(n, free[shard])) > 0:
                pieces.append((cell, part, rank, rank + take - 1, shard, used[shard]))
                free[shard] -= take
                used[shard] += take
                rank += take
                n -= take
    return pieces


def shard(docs: DataFrame, n_shards: int = 24, replicas: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
    )
    cells = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = max(LEAST_PART, math.ceil(sum(cells.values()) / MAX_PARTS))
    parts = [(cell, math.ceil(n / target)) for cell, n in cells.items()]
    # at most CELLS rows, so broadcasting is safe at any size of docs
    sliced = rows.join(F.broadcast(spark.createDataFrame(parts or [(0, 1)], "cell int, parts int")), "cell")
    sliced = sliced.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    counts = sliced.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()
    pieces = place([(r["cell"], r["part"], r["n"]) for r in counts], n_shards, replicas)
    schema = "cell int, part int, first long, last long, shard int, base long"
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")).cast("long")
    # one piece for each slice and one more for each shard that fills up: bounded as the slices are
    dealt = sliced.withColumn("rank", rank).join(F.broadcast(spark.createDataFrame(pieces, schema)), ["cell", "part"])
    return dealt.filter("rank BETWEEN first AND last").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
