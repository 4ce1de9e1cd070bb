"""Point-in-time operators over append-only bitemporal tables, and the price panels made from them.

A bitemporal table has entity keys, event_date, knowledge_date and seq; what is known at T is, for each (keys,
event_date), the row with the greatest (knowledge_date, seq) that has knowledge_date <= T. NULL is the only missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1 << 16  # of a batch that is appended
SPLIT_RATIOS = (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 15.0, 20.0, 1.5)


def as_of(rows: DataFrame, keys: list[str], at, event: str = "event_date", knowledge: str = "knowledge_date", seq: str = "seq") -> DataFrame:
    """What was known at `at`: the latest version of each (keys, event)."""
    latest = Window.partitionBy(*keys, event).orderBy(F.desc(knowledge), F.desc(seq))
    known = rows.filter(F.col(knowledge) <= F.lit(at).cast("timestamp"))
    return known.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def watermark(rows: DataFrame, at, knowledge: str = "knowledge_date", seq: str = "seq") -> DataFrame:
    """One row: the greatest seq visible at `at`, -1 if none is."""
    seen = F.max(F.when(F.col(knowledge) <= F.lit(at).cast("timestamp"), F.col(seq)))
    return rows.agg(F.coalesce(seen, F.lit(-1)).alias("watermark"))


def append(existing: DataFrame | None, rows: DataFrame, keys: list[str], version: int = 1) -> DataFrame:
    """Existing rows and the new ones, stamped with the sequence numbers that follow; validates the contract."""
    required = {*keys, "event_date", "knowledge_date"}
    if missing := required - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if taken := {"seq", "schema_version"} & set(rows.columns):
        raise ValueError(f"reserved columns: {sorted(taken)}")
    first = 0 if existing is None else existing.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    # numbered within buckets of (keys, event_date), by content, and shifted by the sizes of the buckets before: both jobs
    # see the same buckets whatever the partitioning, and versions of one event are numbered in one bucket, in order
    bucket = F.pmod(F.xxhash64(*keys, "event_date"), F.lit(BUCKETS))
    placed = rows.withColumn("_b", bucket)
    sizes = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")  # BUCKETS rows at most
    offsets = sizes.select("_b", (before + first).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*rows.columns)) - 1
    stamped = placed.withColumn("_i", place).join(F.broadcast(offsets), "_b")
    stamped = stamped.select(*rows.columns, (F.col("_first") + F.col("_i")).cast("long").alias("seq"), F.lit(version).alias("schema_version"))
    return stamped if existing is None else existing.unionByName(stamped)


def snapshot_join(left: DataFrame, rows: DataFrame, on: list[str], at, suffix: str = "_r", **names) -> DataFrame:
    """left with every event known at `at` of its keys (several events fan out); NULL keys match NULL keys."""
    right = as_of(rows, on, at, **names)
    renamed = right.select(*(F.col(c).alias(f"{c}{suffix}") for c in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return left.join(renamed, cond, "left").drop(*(f"{k}{suffix}" for k in on))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of the same keys at or before it: one union, one sort by key and time."""
    held = F.struct(*(F.col(v) for v in values), F.col(right_at).alias("_at"))
    a = left.withColumns({"_t": F.col(left_at), "_side": F.lit(1)})
    a = a.select(*by, "_t", "_side", F.struct(*(F.col(c) for c in left.columns)).alias("_row"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("_held"))
    b = right.select(*by, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    so_far = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_held", F.last("_held", ignorenulls=True).over(so_far)).filter("_side = 1")
    return both.select("_row.*", *(F.col(f"_held.{v}").alias(v) for v in values), F.col("_held._at").alias(f"{right_at}_matched"))


def latest_valid(prices: DataFrame, at, universe: DataFrame | None = None, key: str = "instrument", date: str = "date", price: str = "close") -> DataFrame:
    """The last usable price (not null, above 0) of each instrument on or before `at`."""
    rows = prices.filter((F.col(date) <= F.lit(at).cast("date")) & F.col(price).isNotNull() & (F.col(price) > 0))
    if universe is not None:
        rows = rows.join(universe.select(key).distinct(), key, "left_semi")
    return rows.groupBy(key).agg(F.max(date).alias(date), F.max_by(price, date).alias(price))


def resolve(identities: DataFrame, symbols: DataFrame, at, symbol: str = "symbol") -> DataFrame:
    """Symbols with the id that is valid at `at` (valid_from <= at < valid_to, open if null); the least id of several."""
    day = F.lit(at).cast("date")
    valid = identities.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
    return symbols.join(valid.groupBy(symbol).agg(F.min("id").alias("id")), symbol, "left")


def mapped_and_quarantined(rows: DataFrame, mapping: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is mapped, with the mapping's columns, and those whose key is not."""
    return rows.join(mapping, key), rows.join(mapping.select(key), key, "left_anti")


def identifier_overlaps(identities: DataFrame, by: str = "symbol") -> DataFrame:
    """Intervals that end after the next one of the same symbol begins."""
    w = Window.partitionBy(by).orderBy("valid_from", "id")
    after = F.lead("valid_from").over(w)
    return identities.withColumn("next_from", after).filter(after_is_late("next_from"))


def after_is_late(after: str) -> Column:
    return F.col(after).isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(after)))


def vendor_parity(left: DataFrame, right: DataFrame, on: list[str], left_col: str, right_col: str, conventions_match: bool, tol: float = 0.01) -> DataFrame:
    """One row: rows compared and the share that disagrees by more than tol, relative to the right side."""
    if not conventions_match:
        raise ValueError("price conventions of the two vendors differ; adjust one side first")
    both = left.select(*on, F.col(left_col).alias("_l")).join(right.select(*on, F.col(right_col).alias("_r")), on)
    valid = both.filter(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_r") != 0))
    off = F.abs(F.col("_l") / F.col("_r") - 1) > tol
    return valid.agg(F.count(F.lit(1)).alias("n_compared"), F.avg(off.cast("double")).alias("disagreement_rate"))


def detect_splits(panel: DataFrame, key: str = "instrument", date: str = "date", tolerance: float = 0.025) -> DataFrame:
    """panel with split_ratio: the candidate ratio (or its inverse) that the gap from the last close to the open is near,
    if the day moved at most 20 % and, for forward splits, volume is at least 0.3 * ratio * median of up to 6 days before."""
    w = Window.partitionBy(key).orderBy(date)
    gap = F.lag("close").over(w) / F.col("open")
    before = F.array_sort(F.collect_list("volume").over(w.rowsBetween(-6, -1)))
    rows = panel.withColumns({"_gap": gap, "_vols": before})
    k = F.size("_vols")
    middle = (F.get("_vols", F.floor((k - 1) / 2).cast("int")) + F.get("_vols", F.floor(k / 2).cast("int"))) / 2
    rows = rows.withColumn("_median", F.when(k > 0, middle))
    calm = F.abs(F.col("close") / F.col("open") - 1) <= 0.2
    ratio = F.lit(None).cast("double")
    for r in reversed(SPLIT_RATIOS):
        near = F.abs(F.col("_gap") / r - 1) <= tolerance
        loud = F.coalesce(F.col("volume") >= 0.3 * r * F.col("_median"), F.lit(True))
        ratio = F.when(near & loud, F.lit(r)).when(F.abs(F.col("_gap") * r - 1) <= tolerance, F.lit(1 / r)).otherwise(ratio)
    return rows.withColumn("split_ratio", F.when(calm, ratio)).drop("_gap", "_vols", "_median")


def adjust_splits(panel: DataFrame, ratio: str = "split_ratio", key: str = "instrument", date: str = "date") -> DataFrame:
    """panel with adj_factor, the product of all later ratios, and adj_close = close / adj_factor."""
    later = Window.partitionBy(key).orderBy(date).rowsBetween(1, Window.unboundedFollowing)
    factor = F.coalesce(F.product(F.coalesce(F.col(ratio), F.lit(1.0))).over(later), F.lit(1.0))
    return panel.withColumn("adj_factor", factor).withColumn("adj_close", F.col("close") / F.col("adj_factor"))


def adjusted_prices(prices: DataFrame, actions: DataFrame, at, key: str = "entity", price: str = "close") -> DataFrame:
    """Prices known at `at`, times the product of 1 / raw_factor over splits known at `at` with a later event_date."""
    known = as_of(prices, [key], at)
    splits = as_of(actions.filter(F.col("type") == "split"), [key], at).select(key, F.col("event_date").alias("_ex"), "raw_factor")
    # split dates are few for each entity: gather them once and fold over those after the price's date
    per_key = splits.groupBy(key).agg(F.collect_list(F.struct("_ex", "raw_factor")).alias("_splits"))
    later = F.filter("_splits", lambda s: s["_ex"] > F.col("event_date"))
    factor = F.aggregate(later, F.lit(1.0), lambda acc, s: acc / s["raw_factor"])
    return known.join(per_key, key, "left").withColumn("adj_factor", F.coalesce(factor, F.lit(1.0))).withColumn(f"adj_{price}", F.col(price) * F.col("adj_factor")).drop("_splits")


def residual_rate(panel: DataFrame, price: str = "adj_close", threshold: float = 0.5, key: str = "instrument", date: str = "date") -> DataFrame:
    """Share of returns beyond the threshold in size."""
    move = F.col(price) / F.lag(price).over(Window.partitionBy(key).orderBy(date)) - 1
    return panel.select(move.alias("_r")).filter("_r IS NOT NULL").agg(F.avg((F.abs("_r") > threshold).cast("double")).alias("residual_rate"), F.count(F.lit(1)).alias("n_returns"))


def delistings(panel: DataFrame, gap_days: int = 20, key: str = "instrument", date: str = "date") -> DataFrame:
    """First and last date, number of days, and whether the last one is more than gap_days before the panel's end."""
    per = panel.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n_days"))
    end = panel.agg(F.max(date).alias("_end"))  # one row
    return per.join(F.broadcast(end)).withColumn("delisted", F.col("last_date") < F.date_sub("_end", gap_days)).drop("_end")


def liquidity_universe(panel: DataFrame, effective, top_n: int, window: int = 126, lag: int = 5, key: str = "instrument", date: str = "date") -> DataFrame:
    """The top_n instruments by median dollar volume over `window` sessions that end `lag` sessions before `effective`."""
    days = panel.filter(F.col(date) < F.lit(effective).cast("date")).select(date).distinct()
    # the calendar has a row for each session, so its order is cheap wherever it runs
    ranked = days.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(date)))).filter(F.col("_k").between(lag + 1, lag + window)).select(date)
    inside = panel.join(F.broadcast(ranked), date).withColumn("_dv", F.col("close") * F.col("volume"))
    scored = inside.groupBy(key).agg(F.median("_dv").alias("median_dollar_volume"))
    return scored.orderBy(F.desc("median_dollar_volume"), key).limit(top_n)


def panel_report(panel: DataFrame, key: str = "instrument", date: str = "date") -> DataFrame:
    """One row of checks on a price panel."""
    return panel.agg(
        F.count_distinct(key).alias("n_instruments"),
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and((F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)).alias("all_positive"),
        F.bool_and((F.col("high") >= F.col("low"))).alias("high_above_low"),
        (F.count(F.lit(1)) == F.count_distinct(key, date)).alias("unique_key"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def append_checked(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """append(), if the batch says nothing that is known already of the same (keys, event_date, knowledge_date)."""
    on = [*keys, "event_date", "knowledge_date"]
    if rows.join(existing.select(*on), on, "left_semi").limit(1).count():
        raise ValueError("the batch holds versions that are known already")
    return append(existing, rows, keys)


def mint(existing: DataFrame, keys: DataFrame, key: str = "symbol", id_col: str = "id") -> DataFrame:
    """id, key of every key: the id it has, or one that follows the greatest; new ids go by key order within buckets."""
    first = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    known = existing.groupBy(key).agg(F.min(id_col).alias(id_col))
    new = keys.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    placed = new.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    sizes = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n") + first).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    minted = placed.withColumn("_i", place).join(F.broadcast(offsets), "_b").select((F.col("_first") + F.col("_i")).cast("long").alias(id_col), key)
    return keys.select(key).distinct().join(known, key).select(F.col(id_col).cast("long").alias(id_col), key).unionByName(minted)


def merge_identities(identities: DataFrame, target: int, acquirer: int, effective, knowledge) -> DataFrame:
    """New versions that close the target's open identifiers at `effective` and name the acquirer as successor."""
    open_ = identities.filter((F.col("id") == target) & F.col("valid_to").isNull())
    return open_.withColumns({"valid_to": F.lit(effective).cast("date"), "successor": F.lit(acquirer).cast("long"), "knowledge_date": F.lit(knowledge).cast("timestamp")})


#: a Reuters-style code: a root, and an exchange suffix of one to three capitals; a fixed format
RIC = r"^[A-Za-z0-9]{1,12}(\.[A-Z]{1,3})?$"


def ric_mapping(rics: DataFrame, identities: DataFrame, key: str = "ric") -> tuple[DataFrame, DataFrame]:
    """(id, ric of the well-formed codes, minted where new; the malformed ones)."""
    good = F.coalesce(F.col(key).rlike(RIC), F.lit(False))
    return mint(identities.withColumnRenamed("symbol", key), rics.filter(good), key), rics.filter(~good).select(key).distinct()


def unified_master(identities: DataFrame, symbology: DataFrame, rics: DataFrame, valid_from: str = "2008-01-01") -> dict[str, DataFrame]:
    """One master of two vendors: symbology (iid, symbol, valid_from, valid_to) and codes (ric, symbol). A symbol keeps its
    id or gets one; `instruments`: iid -> id by the latest interval of each iid; `codes`: ric -> id; `overlaps`: intervals
    of a symbol that run into the next; `minted`: symbols that only the codes have, valid from `valid_from`."""
    symbols = symbology.select("symbol").unionByName(rics.select("symbol")).distinct()
    ids = mint(identities, symbols)
    last = symbology.groupBy("iid").agg(F.max_by("symbol", F.struct("valid_from", "symbol")).alias("symbol"))
    instruments = last.join(ids, "symbol").select("iid", "id")
    codes = rics.filter(F.coalesce(F.col("ric").rlike(RIC), F.lit(False))).join(ids, "symbol").select("ric", "id").distinct()
    only = rics.select("symbol").distinct().join(symbology.select("symbol").distinct(), "symbol", "left_anti")
    minted = only.join(ids, "symbol").select("id", "symbol", F.lit(valid_from).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    intervals = symbology.join(ids, "symbol").select("id", "symbol", "valid_from", "valid_to")
    return {"ids": ids, "instruments": instruments, "codes": codes, "minted": minted, "overlaps": identifier_overlaps(intervals)}


def vendor_rows(panel: DataFrame, mapping: DataFrame, key: str, date: str, values: list[str], lag_days: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows of a vendor panel as entity, event_date, knowledge_date and values, by a mapping of its ids; the unmapped)."""
    mapped, rest = mapped_and_quarantined(panel, mapping, key)
    known = F.date_add(F.col(date).cast("date"), lag_days).cast("timestamp")
    return mapped.select(F.col("id").alias("entity"), F.col(date).cast("date").alias("event_date"), known.alias("knowledge_date"), *values), rest


def membership(announced: DataFrame, at) -> DataFrame:
    """Members known at `at`: entity, announced, effective, status; the last announcement counts, once it is effective. A
    delisting without a return is flagged (`return_missing`)."""
    rows = announced.filter((F.col("announced") <= F.lit(at).cast("timestamp")) & (F.col("effective") <= F.lit(at).cast("date")))
    last = rows.groupBy("entity").agg(F.max_by(F.struct("status", "effective", "delisting_return"), F.struct("effective", "announced")).alias("s")).select("entity", "s.*")
    return last.withColumn("return_missing", (F.col("status") == "delisted") & F.col("delisting_return").isNull())


def worst_disagreements(left: DataFrame, right: DataFrame, on: list[str], left_col: str, right_col: str, n: int = 10) -> DataFrame:
    """The n rows of two vendors that differ most, relative to the right side."""
    both = left.select(*on, F.col(left_col).alias("left")).join(right.select(*on, F.col(right_col).alias("right")), on)
    return both.withColumn("off", F.abs(F.try_divide("left", "right") - 1)).filter("off IS NOT NULL").orderBy(F.desc("off"), *on).limit(n)


def build_panel(raw: DataFrame, key: str = "instrument", date: str = "date") -> DataFrame:
    """The adjusted price panel with its ten columns, from raw bars: splits are detected, prices divided and volumes
    multiplied by the product of later ratios; dividends and splits are 0 after adjustment."""
    adjusted = adjust_splits(detect_splits(raw, key, date), key=key, date=date)
    k = F.col("adj_factor")
    prices = [(F.col(c) / k).alias(c) for c in ("open", "high", "low", "close")]
    return adjusted.select(key, date, *prices, (F.col("volume") * k).alias("volume"), (F.col("close") / k).alias("adj_close"), F.lit(0.0).alias("dividends"), F.lit(0.0).alias("splits"))
