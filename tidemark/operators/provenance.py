"""Fingerprints, manifests, the ledger of findings, and checks that a transform does not look ahead."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fingerprint(df: DataFrame) -> str:
    """Content hash that depends on neither the order of rows nor of columns: sums of row hashes, which merge anywhere."""
    cols = sorted(df.columns)
    h = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    kinds = sorted(df.dtypes)
    return hashlib.sha256(json.dumps([kinds, row["n"], *(str(row[f"p{i}"]) for i in range(4))]).encode()).hexdigest()


def manifest(df: DataFrame, params: dict, code: str, version: str = "1") -> dict:
    data = fingerprint(df)
    run = hashlib.sha256(json.dumps([data, code, version, params], sort_keys=True).encode()).hexdigest()[:16]
    return {"run_id": run, "data": data, "code": code, "version": version, "params": params}


def verified(found: dict, df: DataFrame, code: str) -> bool:
    return manifest(df, found["params"], code, found["version"]) == found


def upsert(ledger: DataFrame | None, rows: DataFrame, key: str = "name", at: str = "found_at") -> DataFrame:
    """The newest row of each name."""
    both = rows if ledger is None else ledger.unionByName(rows, allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter("_rn = 1").drop("_rn")


def looks_ahead(transform: Callable[[DataFrame], DataFrame], rows: DataFrame, pos: str, cutoffs: list[int], seed: int = 0) -> list[str]:
    """What is wrong, if anything: outputs up to a cutoff have to be the same on the rows up to it alone (truncation) and
    when numbers after it are scrambled (perturbation)."""
    whole, wrong = transform(rows), []
    numbers = [c for c, t in rows.dtypes if t == "double"]
    for k in cutoffs:
        want = whole.filter(F.col(pos) <= k)
        scrambled = rows.withColumns({c: F.when(F.col(pos) > k, F.col(c) * (1 + F.rand(seed))).otherwise(F.col(c)) for c in numbers})
        for name, given in (("truncation", rows.filter(F.col(pos) <= k)), ("perturbation", scrambled)):
            got = transform(given).filter(F.col(pos) <= k)
            if want.exceptAll(got).limit(1).count() or got.exceptAll(want).limit(1).count():
                wrong.append(f"{name} at {k}")
    return wrong
