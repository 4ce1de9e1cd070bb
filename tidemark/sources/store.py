"""A market data lake's readers and writers: the catalog of views, per-key Parquet folders, signal artifacts, runs."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.operators import pit
from tidemark.sources import catalog

STATEMENTS = ("balance_sheet", "income_stmt", "cash_flow")
COMPRESSION = "zstd"


@dataclass(frozen=True)
class Layout:
    """Where a lake keeps its files, below one root."""

    root: str

    def path(self, zone: str, name: str = "") -> str:
        if zone not in ("raw", "processed", "catalog"):
            raise ValueError(f"no zone {zone}")
        return "/".join(x for x in (self.root.rstrip("/"), zone, name) if x)

    def raw(self, digest: str, suffix: str = "parquet") -> str:
        """The file of a content hash: two levels of folders by its first characters."""
        if not re.fullmatch(r"[0-9a-f]{64}", digest):
            raise ValueError("not a sha256 digest")
        return self.path("raw", f"{digest[:2]}/{digest[2:4]}/{digest}.{suffix}")


class Catalog:
    """Views over a lake's folders, with the reads that research needs. Nothing is read before an action."""

    def __init__(self, spark: SparkSession, folders: dict[str, str], key: str = "ticker", date: str = "date"):
        self.spark, self.key, self.date = spark, key, date
        self.views = {name: catalog.view(spark, name, folder) for name, folder in folders.items()}

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def scan(self, view: str, keys=None, start=None, end=None, columns=None) -> DataFrame:
        return catalog.scan(self.views[view], keys, start, end, columns, self.key, self.date)

    def daily(self, keys=None, start=None, end=None, columns=None) -> DataFrame:
        return self.scan("daily", keys, start, end, columns)

    def intraday(self, keys=None, start=None, end=None, columns=None) -> DataFrame:
        return self.scan("intraday", keys, start, end, columns)

    def statement(self, view: str, keys=None, freq: str | None = None, metric: str | None = None) -> DataFrame:
        """Rows of a statement (key, date, freq, metric, value), with optional equality on freq and metric."""
        df = self.scan(view, keys)
        for name, value in (("freq", freq), ("metric", metric)):
            df = df if value is None else df.filter(F.col(name) == value)
        return df

    def balance_sheet(self, keys=None, freq=None, metric=None) -> DataFrame:
        return self.statement("balance_sheet", keys, freq, metric)

    def income(self, keys=None, freq=None, metric=None) -> DataFrame:
        return self.statement("income_stmt", keys, freq, metric)

    def cash_flow(self, keys=None, freq=None, metric=None) -> DataFrame:
        return self.statement("cash_flow", keys, freq, metric)

    def earnings(self, keys=None) -> DataFrame:
        return self.scan("earnings", keys).orderBy(self.key, self.date)

    def fundamentals_wide(self, keys, metrics: list[str], view: str = "income_stmt", freq: str = "Q") -> DataFrame:
        return catalog.widen(self.statement(view, keys, freq), [self.key, self.date], metrics)

    def price_fundamentals(self, keys, metrics: list[str], freq: str = "Q", start=None, view: str = "income_stmt") -> DataFrame:
        """Prices with the last statement on or before each date."""
        wide = self.fundamentals_wide(keys, metrics, view, freq)
        return pit.asof_join(self.daily(keys, start), wide, [self.key], self.date, self.date, metrics)

    def keys(self, view: str = "daily") -> DataFrame:
        return self.views[view].select(self.key).distinct().orderBy(self.key)

    def metrics(self, view: str = "income_stmt", key: str | None = None) -> DataFrame:
        df = self.views[view] if key is None else self.views[view].filter(F.col(self.key) == key)
        return df.select("metric").distinct().orderBy("metric")

    def date_range(self, view: str = "daily") -> DataFrame:
        return catalog.summary(self.views[view], view, self.key, self.date).select("first_date", "last_date")

    def summary(self) -> DataFrame:
        out = None
        for name, df in self.views.items():
            one = catalog.summary(df, name, self.key, self.date)
            out = one if out is None else out.unionByName(one)
        return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_by_key(df: DataFrame, folder: str, key: str = "ticker", compression: str = COMPRESSION, mode: str = "overwrite") -> None:
    """One folder of Parquet files for each key; each key's rows are gathered first, so that it gets few files."""
    df.repartition(key).sortWithinPartitions(key).write.mode(mode).option("compression", compression).partitionBy(key).parquet(folder)


def cached_daily(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """Daily bars from `path`; make() (a DataFrame with ts, instrument, close) is run and written only if they aren't
    there, or on refresh. Prices that are not above 0 go."""
    if refresh or not exists(spark, path):
        tidy_daily(make()).write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    return spark.read.parquet(path)


def tidy_daily(raw: DataFrame, ts: str = "ts", key: str = "instrument", price: str = "close") -> DataFrame:
    """Vendor bars as (key, date, ...) with positive prices, ordered within each key's range."""
    out = raw.withColumn("date", F.to_date(ts)).drop(ts).filter(F.col(price) > 0)
    return out.select(key, "date", *(c for c in out.columns if c not in (key, "date"))).orderBy(key, "date")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV panel, told by the suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    raise ValueError(f"not a panel: {path}")


def load_prices(spark: SparkSession, path: str, at: str = "ts") -> DataFrame:
    """A wide price table with one row for each time; repeated or missing times are an error."""
    df = spark.read.parquet(path).withColumn(at, F.col(at).cast("timestamp"))
    n, known, distinct = df.agg(F.count(F.lit(1)), F.count(at), F.count_distinct(at)).first()
    if not n == known == distinct:
        raise ValueError("times of a price table have to be there once each")
    return df.orderBy(at)


def universe(spark: SparkSession, path: str) -> DataFrame:
    """ticker, from a text file with one to a line; blank lines and what follows a # don't count."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("ticker"))
    return lines.filter("ticker <> ''").distinct()


def members(df: DataFrame, as_of, date: str = "date", key: str = "ticker", member: str | None = None) -> DataFrame:
    """The distinct keys of a dated membership table on exactly that date, of those flagged if there is a flag."""
    out = df.filter(F.col(date) == F.lit(as_of))
    return (out if member is None else out.filter(F.col(member))).select(key).distinct().orderBy(key)


def check_keys(df: DataFrame, key: str = "ticker") -> DataFrame:
    """df, if its keys are there, not blank and unique; otherwise an error."""
    n, good, distinct = df.agg(F.count(F.lit(1)), F.count_if(F.trim(key) != ""), F.count_distinct(key)).first()
    if not n or n != good or n != distinct:
        raise ValueError(f"{key} has to be non-empty, not blank and unique")
    return df


def lake_rows(mapped: DataFrame, columns: dict[str, str], values: list[str]) -> DataFrame:
    """Vendor columns bound to those of a bitemporal table; columns: lake name -> vendor name, with entity, event_date and
    knowledge_date among them."""
    missing = {"entity", "event_date", "knowledge_date"} - set(columns)
    if missing:
        raise ValueError(f"no column for {sorted(missing)}")
    return mapped.select(*(F.col(v).alias(k) for k, v in columns.items()), *values).filter("entity IS NOT NULL AND event_date IS NOT NULL")


# --- signals -----------------------------------------------------------------------------------------------------------


def check_signal(signal: DataFrame, alpha: float) -> None:
    """Raises unless tickers are unique, numbers finite, lower <= upper and 0 < alpha < 1."""
    if not 0 < alpha < 1:
        raise ValueError("alpha has to lie between 0 and 1")
    check_keys(signal)
    numbers = [f.name for f in signal.schema.fields if isinstance(f.dataType, NumericType)]
    finite = F.lit(True)
    for c in ("expected_return", "lower", "upper", *(c for c in numbers if c == "kelly_weight")):
        x = F.col(c).cast("double")
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    bad = signal.filter(~(finite & (F.col("lower") <= F.col("upper")))).limit(1).count()
    if bad:
        raise ValueError("a signal has to be finite, with lower <= upper")


def write_signal(signal: DataFrame, out: str, *, run_id: str, model_sha: str, as_of, alpha: float, fmt: str = "parquet", extra: dict | None = None) -> dict:
    """Writes ticker, expected_return, lower, upper and optional kelly_weight with a manifest beside them, which it returns.
    The manifest is written last, so a signal without one is unfinished."""
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt is parquet or json")
    check_signal(signal, alpha)
    manifest = {"run_id": run_id, "model_sha": model_sha, "as_of": str(as_of), "alpha": alpha, "format": fmt, "n_rows": signal.count()}
    if set(manifest) & set(extra or {}):
        raise ValueError(f"extra must not hold {sorted(set(manifest) & set(extra or {}))}")
    manifest |= extra or {}
    spark = signal.sparkSession
    getattr(signal.write.mode("overwrite"), fmt)(f"{out}/signal")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest")
    return manifest


def read_signal(spark: SparkSession, out: str) -> tuple[DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    df = getattr(spark.read, manifest["format"])(f"{out}/signal")
    missing = {"ticker", "expected_return", "lower", "upper"} - set(df.columns)
    if missing:
        raise ValueError(f"a signal without {sorted(missing)}")
    return df, manifest


def latest_signal(signals: DataFrame, as_of, min_date=None, key: str = "ticker", date: str = "date") -> DataFrame:
    """The last row of each key with min_date <= date <= as_of."""
    rows = signals.filter(F.col(date) <= F.lit(as_of))
    rows = rows if min_date is None else rows.filter(F.col(date) >= F.lit(min_date))
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(date)).alias("_s")).select(key, "_s.*")


def panel_weights(weights: DataFrame, keys: DataFrame, as_of, key: str = "ticker", date: str = "date", weight: str = "weight") -> DataFrame:
    """key, weight of each of `keys` from the last row of the panel on or before as_of; 0 where the panel has none."""
    last = latest_signal(weights, as_of, key=key, date=date).select(key, weight)
    return keys.select(key).join(last, key, "left").select(key, F.coalesce(weight, F.lit(0.0)).alias(weight))


# --- runs --------------------------------------------------------------------------------------------------------------

RUN_TABLES = ("orders", "fills", "positions", "events")


class RunStore:
    """Runs in a folder: each table parted by run_id, and a row in `runs` written last, which makes the run count."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str, run_id: str | None = None) -> str:
        return f"{self.folder}/{table}" + (f"/run_id={run_id}" if run_id else "")

    def save(self, tables: dict[str, DataFrame], *, run_id: str, digest: str, initial_cash: float | None = None, skipped_steps: int = 0, metadata: dict | None = None) -> str:
        if not re.fullmatch(r"[\w.-]+", run_id):
            raise ValueError("run_id is a name")
        if exists(self.spark, self._path("runs", run_id)):
            raise ValueError(f"run {run_id} is there already")
        for name in RUN_TABLES:
            if name in tables:
                tables[name].write.mode("overwrite").option("compression", COMPRESSION).parquet(self._path(name, run_id))
        row = (digest, initial_cash, skipped_steps, json.dumps(metadata or {}, sort_keys=True), datetime.now(UTC))
        schema = "digest string, initial_cash double, skipped_steps long, metadata string, saved_at timestamp"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("errorifexists").parquet(self._path("runs", run_id))
        return run_id

    def load(self, run_id: str) -> dict[str, DataFrame]:
        if not exists(self.spark, self._path("runs", run_id)):
            raise KeyError(run_id)
        found = {n: self.spark.read.parquet(self._path(n, run_id)) for n in RUN_TABLES if exists(self.spark, self._path(n, run_id))}
        return found | {"runs": self.spark.read.parquet(self._path("runs", run_id))}

    def list(self) -> DataFrame:
        """Runs, newest first."""
        if not exists(self.spark, self._path("runs")):
            return self.spark.createDataFrame([], "run_id string, digest string, initial_cash double, skipped_steps long, metadata string, saved_at timestamp")
        df = self.spark.read.parquet(self._path("runs")).withColumn("run_id", F.col("run_id").cast("string"))
        return df.orderBy(F.desc("saved_at"))

    def delete(self, run_id: str) -> None:
        """Takes the run out; its row goes first, so a half-deleted run doesn't count."""
        for name in ("runs", *RUN_TABLES):
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name, run_id))
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Journal:
    """Append-only events as JSON lines, in numbered files of a folder: a file is there whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, events: DataFrame) -> None:
        events.write.mode("append").json(self.folder)

    def read(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(self.folder) if exists(self.spark, self.folder) else self.spark.createDataFrame([], schema)


# --- feeds and costs ---------------------------------------------------------------------------------------------------


def synthetic_ticks(spark: SparkSession, n: int, seed: int = 0, instrument: int = 1, price: float = 100.0, start_ns: int = 0, step_ns: int = 1_000_000, volatility: float = 0.0005) -> DataFrame:
    """ts_event, instrument_id, seq, price, size: a geometric walk whose steps follow from the seed and the row's number
    (Box-Muller on hashes), whatever the partitioning."""

    def uniform(salt: int):
        return (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    from pyspark.sql.window import Window

    rows = spark.range(n).withColumn("_z", F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2)))
    walk = F.sum(F.col("_z") * volatility).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))  # one series, n rows
    return rows.select(
        (F.lit(start_ns) + F.col("id") * step_ns).alias("ts_event"), F.lit(instrument).alias("instrument_id"), F.col("id").alias("seq"),
        (price * F.exp(walk)).alias("price"), (1 + F.floor(uniform(3) * 100)).cast("long").alias("size"),
    )


def trade_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed trades as a stream; a trigger takes so many files at most, which is the bound on what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def feed_metrics(query) -> dict:
    """rows, batches and the rate of a running stream, from its progress."""
    progress = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in progress), "batches": len(progress), "rows_per_second": progress[-1]["processedRowsPerSecond"] if progress else 0.0}


@dataclass(frozen=True)
class LinearCosts:
    bps: float = 1.0
    per_share: float = 0.005
    least: float = 1.0

    @classmethod
    def from_surface(cls, spark: SparkSession, path: str, discipline: str = "at_open", **options) -> LinearCosts:
        """Basis points of a discipline from a JSON file {"disciplines": {name: {"cost_bps": x}}}."""
        found = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))["disciplines"]  # one small file
        if discipline not in found:
            raise KeyError(f"no discipline {discipline}; there are {sorted(found)}")
        return cls(float(found[discipline]["cost_bps"]), **options)


# --- features over the lake --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LakeRef:
    """A bitemporal table as it was known at a time: the only input that a feature gets."""

    table: DataFrame
    keys: tuple[str, ...]
    as_of: str

    def read(self) -> DataFrame:
        return pit.as_of(self.table, list(self.keys), self.as_of)


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: a function of LakeRefs by the names of its dependencies."""

    name: str
    version: str
    fn: object
    deps: tuple[str, ...]
    fn_hash: str = ""


def fn_hash(fn) -> str:
    """SHA-256 of a function's source, or of its code where there is no source."""
    import inspect

    try:
        text = inspect.getsource(fn)
    except (OSError, TypeError):
        text = fn.__code__.co_code.hex() + repr(fn.__code__.co_consts)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class FeatureRegistry:
    specs: dict[tuple[str, str], FeatureSpec] = field(default_factory=dict)

    def register(self, name: str, version: str, fn, deps: tuple[str, ...]) -> FeatureSpec:
        """A name and version stand for one function: the same one may be registered again, another may not."""
        spec = FeatureSpec(name, version, fn, tuple(deps), fn_hash(fn))
        known = self.specs.get((name, version))
        if known is not None and known.fn_hash != spec.fn_hash:
            raise ValueError(f"{name} {version} is another function")
        return self.specs.setdefault((name, version), spec)


def watermarks(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], spec: FeatureSpec, as_of: str) -> dict[str, int]:
    """How far each dependency was known at the time."""
    return {d: pit.watermark(tables[d][0], as_of).first()[0] for d in spec.deps}


def signature(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], spec: FeatureSpec, as_of: str) -> str:
    """Name, version, function, time, and how far each dependency was known by then."""
    marks = watermarks(tables, spec, as_of)
    return hashlib.sha256(json.dumps([spec.name, spec.version, spec.fn_hash, as_of, marks], sort_keys=True).encode()).hexdigest()


def materialize(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, tuple[str, ...]]], spec: FeatureSpec, as_of: str) -> DataFrame:
    """The feature at a time, from the folder if the same signature has been computed, otherwise computed and kept; tables:
    name -> bitemporal table and its keys."""
    path = f"{folder.rstrip('/')}/{spec.name}/{signature(tables, spec, as_of)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        out = spec.fn(**{d: LakeRef(*tables[d], as_of) for d in spec.deps})
        out.write.mode("overwrite").option("compression", COMPRESSION).parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Source:
    """Where a table comes from, the biases it is known for, and columns that are null together with a flag."""

    table: str
    source: str
    biases: tuple[str, ...] = ()
    nullable_with_flag: tuple[str, ...] = ()
    knowledge_basis: str = "published"

    def row(self) -> dict:
        return asdict(self)


def sources_frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    return spark.createDataFrame([(s.table, s.source, list(s.biases), list(s.nullable_with_flag), s.knowledge_basis) for s in sources], "table string, source string, biases array<string>, nullable_with_flag array<string>, knowledge_basis string")


def unsourced(df: DataFrame, source: Source) -> DataFrame:
    """How many rows of each flagged column are null without their flag (`<column>_missing`)."""
    out = [F.count_if(F.col(c).isNull() & ~F.coalesce(F.col(f"{c}_missing"), F.lit(False))).alias(c) for c in source.nullable_with_flag]
    return df.agg(*out) if out else df.limit(0).select()
