"""Catalog sources: folders of Parquet files as views, symbology JSON, wide vendor panels, content-addressed raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLOGY = "map<string, array<struct<d0:string, d1:string, s:string>>>"


def view(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """All Parquet files of a folder as one view, columns united by name; files that begin with _ are left out."""
    df = spark.read.option("mergeSchema", "true").option("pathGlobFilter", "[!_]*.parquet").parquet(folder)
    df.createOrReplaceTempView(name)
    return df


def build(spark: SparkSession, folders: dict[str, str], key: str = "ticker") -> DataFrame:
    """Registers every view and returns name, n_rows, n_keys of each."""
    out = None
    for name, folder in folders.items():
        one = view(spark, name, folder).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
        out = one if out is None else out.unionByName(one)
    return out


def scan(df: DataFrame, keys: list | None = None, start=None, end=None, columns: list[str] | None = None, key: str = "ticker", date: str = "date") -> DataFrame:
    """Rows of the keys within inclusive dates; the predicates are plain columns, so they reach the scan."""
    if keys is not None:
        df = df.filter(F.col(key).isin(list(keys)))
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end))
    return df.select(*columns) if columns else df


def summary(df: DataFrame, name: str, key: str, date: str) -> DataFrame:
    return df.agg(F.lit(name).alias("view"), F.count_distinct(key).alias("n_keys"), F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def widen(eav: DataFrame, ids: list[str], metrics: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """One column for each metric: the greatest value of duplicates."""
    return eav.groupBy(*ids).agg(*(F.max(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics))


def lengthen(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """ids, metric, value; values that are no numbers become NULL, and NULLs go."""
    long = wide.select(*ids, *(F.expr(f"try_cast(`{m}` AS double)").alias(m) for m in metrics)).unpivot(ids, metrics, "metric", "value")
    return long.filter("value IS NOT NULL")


def normalized_names(df: DataFrame) -> DataFrame:
    """Column names in lower case, blanks as _ and % as pct."""
    return df.toDF(*(c.strip().lower().replace(" ", "_").replace("%", "pct").replace("(", "").replace(")", "") for c in df.columns))


def melt_vendor_panel(wide: DataFrame, date: str = "Date") -> DataFrame:
    """Columns named ('RIC', 'Field') become rows ric, date and a column for each field."""
    names = [c for c in wide.columns if c != date]
    safe = wide.toDF(*(c if c == date else f"c{i}" for i, c in enumerate(wide.columns)))
    cols = [f"c{i}" for i, c in enumerate(wide.columns) if c != date]
    long = safe.unpivot([date], cols, "c", "value")
    lookup = F.create_map(*(F.lit(x) for pair in zip(cols, names, strict=True) for x in pair))
    named = long.withColumn("n", lookup[F.col("c")])
    parsed = named.select(F.regexp_extract("n", r"^\('([^']*)'", 1).alias("ric"), F.col(date).alias("date"), F.regexp_extract("n", r", '([^']*)'\)$", 1).alias("field"), "value")
    fields = sorted({n.rsplit("'", 2)[1] for n in names})
    return widen(parsed, ["ric", "date"], fields, "field")


def symbology(df: DataFrame, payload: str = "payload") -> DataFrame:
    """instrument, symbol, valid_from, valid_to of a JSON map of intervals; empty symbols and "None" go."""
    rows = df.select(F.explode(F.from_json(payload, SYMBOLOGY)).alias("instrument", "spans")).select("instrument", F.explode("spans").alias("s"))
    out = rows.select("instrument", F.col("s.s").alias("symbol"), F.to_date("s.d0").alias("valid_from"), F.to_date("s.d1").alias("valid_to"))
    return out.filter(F.col("symbol").isNotNull() & ~F.col("symbol").isin("", "None"))


def split_ric(ric) -> tuple:
    """(root, venue) of ROOT.VENUE, split at the last dot; no venue without a dot."""
    venue = F.regexp_extract(ric, r"\.([^.]*)$", 1)
    has = F.instr(ric, ".") > 0
    return F.when(has, F.regexp_extract(ric, r"^(.*)\.[^.]*$", 1)).otherwise(ric), F.when(has, venue)


def raw_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, bytes, modified of every file, for a content-addressed copy."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def quality_report(df: DataFrame, key: str = "instrument", date: str = "date") -> DataFrame:
    """Issues of each instrument's bars: nulls, closes of 0 or less, high below low, days without volume, double dates."""
    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    out = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        n(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()).alias("n_null"),
        n(F.col("close") <= 0).alias("n_bad_close"),
        n(F.col("high") < F.col("low")).alias("n_crossed"),
        n(F.col("volume") == 0).alias("n_no_volume"),
        (F.count(F.lit(1)) - F.count_distinct(date)).alias("n_double"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("n_null") > 0, F.concat(F.col("n_null"), F.lit(" nulls"))),
        F.when(F.col("n_bad_close") > 0, F.concat(F.col("n_bad_close"), F.lit(" bad closes"))),
        F.when(F.col("n_crossed") > 0, F.concat(F.col("n_crossed"), F.lit(" crossed"))),
        F.when(F.col("n_no_volume") > 0.05 * F.col("n_rows"), F.lit("volume often 0")),
        F.when(F.col("n_double") > 0, F.concat(F.col("n_double"), F.lit(" double dates"))),
    ))
    return out.withColumn("issues", F.array_join(issues, "; "))


def manifest(df: DataFrame, key: str) -> DataFrame:
    """One JSON row: the sorted keys and the number of rows."""
    return df.agg(F.to_json(F.struct(F.sort_array(F.collect_set(key)).alias("keys"), F.count(F.lit(1)).alias("n_rows"))).alias("manifest"))


def decoded_trades(df: DataFrame) -> DataFrame:
    """Fixed-point vendor trades: price / 1e9 with the greatest long as missing; side A is -1, B +1, others 0."""
    side = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1).otherwise(0)
    price = F.when(F.col("price") != 9223372036854775807, F.col("price") / F.lit(1e9))
    return df.withColumns({"price": price, "side": side.cast("byte")})
