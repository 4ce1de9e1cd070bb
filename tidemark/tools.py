"""Research tools over files: screens, the factory, the ledger of findings and its manifests. The command line and a tool
server can call these alike; each returns plain values."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import crosssection as xs
from tidemark.operators import provenance, research
from tidemark.operators import statistics as st
from tidemark.sources import store

LEDGER_VERSION = 2


def long_frame(panel: DataFrame, return_col: str = "forward_return", date_col: str = "date", asset_col: str = "asset") -> DataFrame:
    """name, instrument, date, factor, forward_return from a panel with a column for each factor."""
    factors = [c for c, t in panel.dtypes if c not in (return_col, date_col, asset_col) and t in ("double", "float", "int", "bigint")]
    if not factors:
        raise ValueError("the panel has no factor")
    long = panel.select(F.col(date_col).alias("date"), F.col(asset_col).alias("instrument"), F.col(return_col).cast("double").alias("forward_return"), *(F.col(f"`{c}`").cast("double").alias(c) for c in factors))
    return long.unpivot(["date", "instrument", "forward_return"], factors, "name", "factor").filter("factor IS NOT NULL AND forward_return IS NOT NULL")


def factory(frame: DataFrame, hac_lags: int = 5, fdr: float = 0.1, dsr_threshold: float = 0.95) -> DataFrame:
    """name, mean, t, q, dsr, passed, reason of each factor of a long frame: significant after correction for all factors,
    and a deflated Sharpe ratio of the long-short path that is high enough."""
    found = xs.screen(frame, hac_lags=hac_lags, fdr=fdr)
    paths = xs.long_short(frame.withColumn("date", F.struct("name", "date")))
    paths = paths.select(F.col("date.name").alias("name"), F.col("ls_return").alias("ret")).filter("ret IS NOT NULL")
    trials = frame.select("name").distinct().count()
    deflated = st.dsr(paths, ["name"], trials).select("name", "sr", "dsr")
    joined = found.join(deflated, "name", "left").withColumn("passed", F.coalesce(F.col("significant") & (F.col("dsr") >= dsr_threshold), F.lit(False)))
    reason = F.when(F.col("passed"), "passed").when(~F.col("significant"), "not significant").otherwise("deflated Sharpe too low")
    return joined.select("name", "n", "mean", "t", "q", "sr", "dsr", "passed", reason.alias("reason"))


def screen_file(spark: SparkSession, path: str, return_col: str = "forward_return", date_col: str = "date", asset_col: str = "asset", hac_lags: int = 5, fdr: float = 0.1) -> list[dict]:
    rows = xs.screen(long_frame(store.read_panel(spark, path), return_col, date_col, asset_col), hac_lags=hac_lags, fdr=fdr)
    return json.loads(research.as_json(rows.orderBy("rank")))


def factory_file(spark: SparkSession, path: str, return_col: str = "forward_return", date_col: str = "date", asset_col: str = "asset", **options) -> list[dict]:
    return json.loads(research.as_json(factory(long_frame(store.read_panel(spark, path), return_col, date_col, asset_col), **options).orderBy("name")))


class DiscoveryLedger:
    """Findings by name, the newest of each, and the manifests of the runs that made them, as one JSON file in any store.
    Files of the first version, a plain list of findings, are read too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.findings, self.manifests = spark, path, {}, {}
        if store.exists(spark, path):
            held = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
            rows = held if isinstance(held, list) else held["findings"]
            self.findings = reduce(lambda d, r: d | {r["name"]: r}, rows, {})
            self.manifests = {} if isinstance(held, list) else held["manifests"]

    def upsert(self, rows: list[dict], manifest: dict | None = None) -> None:
        now = datetime.now(UTC).isoformat(timespec="seconds")
        for r in rows:
            self.findings[r["name"]] = r | {"found_at": r.get("found_at", now)} | ({"run_id": manifest["run_id"]} if manifest else {})
        if manifest:
            self.manifests[manifest["run_id"]] = manifest

    def save(self) -> None:
        """A new file is written whole before the old one goes."""
        text = json.dumps({"version": LEDGER_VERSION, "findings": self.list(), "manifests": self.manifests}, indent=2, sort_keys=True)
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target, fresh = jvm.Path(self.path), jvm.Path(f"{self.path}.new")
        fs = target.getFileSystem(conf)
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(fresh, target)

    def list(self) -> list[dict]:
        return [self.findings[k] for k in sorted(self.findings)]


def factory_and_register(spark: SparkSession, path: str, ledger_path: str, return_col: str = "forward_return", date_col: str = "date", asset_col: str = "asset", **options) -> list[dict]:
    """Runs the factory on a panel file and keeps what passed, with a manifest of data, code and settings."""
    panel = store.read_panel(spark, path)
    rows = json.loads(research.as_json(factory(long_frame(panel, return_col, date_col, asset_col), **options).orderBy("name")))
    manifest = provenance.manifest(panel, {"return_col": return_col, "date_col": date_col, "asset_col": asset_col, **options}, research.code_version().commit)
    ledger = DiscoveryLedger(spark, ledger_path)
    ledger.upsert([r for r in rows if r["passed"]], manifest)
    ledger.save()
    return rows


def list_discoveries(spark: SparkSession, ledger_path: str) -> list[dict]:
    return DiscoveryLedger(spark, ledger_path).list()


def list_manifests(spark: SparkSession, ledger_path: str) -> list[dict]:
    held = DiscoveryLedger(spark, ledger_path).manifests
    return [held[k] for k in sorted(held)]


def verify_discovery(spark: SparkSession, ledger_path: str, run_id: str, panel_path: str) -> dict:
    """Whether a run's data and code are what they were."""
    held = DiscoveryLedger(spark, ledger_path).manifests
    if run_id not in held:
        raise KeyError(run_id)
    return research.manifest_check(held[run_id], store.read_panel(spark, panel_path), research.code_version().commit)


def list_factors(category: str | None = None, tag: str | None = None) -> list[str]:
    return [s.name for s in research.FACTORS.list(category, tag)]


def search_factors(text: str) -> list[str]:
    return [s.name for s in research.FACTORS.search(text)]


def describe_factor(name: str) -> str:
    s = research.FACTORS.get(name)
    return f"{s.name} ({s.category}): {s.summary}. Needs {', '.join(s.inputs)}. {s.module}.{s.function}"


def list_categories() -> list[str]:
    return research.FACTORS.categories()


def catalog_json() -> str:
    return research.FACTORS.to_json()
