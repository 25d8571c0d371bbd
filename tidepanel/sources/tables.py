"""Readers and table clean-up steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.joins import keep_one
from tidepanel.sources.codes import normalize_code

# Trade types of a book.
TRADE_TYPES = ("buy", "sell", "set", "dividend")


def number(x: Column) -> Column:
    """Number in an export cell: thousands separators and blanks removed, anything else missing."""
    return F.regexp_replace(F.trim(x), r"[,，\s]", "").try_cast("double")


def read_broker_csv(spark: SparkSession, path: str, columns: dict[str, str], cash_labels=("cash", "现金")) -> DataFrame:
    """Positions of a broker export: mapped columns, normalised codes, value from price where missing, one cash row."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").schema(
        ", ".join(f"`{c}` string" for c in columns.values())).csv(path)
    d = raw.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
    is_cash = F.lower(F.trim("code")).isin(*[c.lower() for c in cash_labels])
    d = d.withColumns({k: number(F.col(k)) for k in ("quantity", "price", "market_value") if k in d.columns})
    value = F.coalesce("market_value", F.col("quantity") * F.col("price"))
    pos = d.where(~is_cash).select(normalize_code(F.col("code")).alias("code"), "quantity", "price", value.alias("market_value"))
    cash = d.where(is_cash).agg(F.sum(F.coalesce("market_value", "quantity")).alias("v")).where("v is not null")
    return pos.unionByName(cash.select(F.lit("CASH").alias("code"), F.col("v").alias("quantity"), F.lit(1.0).alias("price"), F.col("v").alias("market_value")))


def trade_log_issues(df: DataFrame) -> DataFrame:
    """Counts of rows a trade log may not hold."""
    c = F.col
    return df.agg(F.count(F.when(~c("type").isin(*TRADE_TYPES) | c("type").isNull(), 1)).alias("bad_type"), F.count(F.when(c("date").isNull(), 1)).alias("no_date"),
                  F.count(F.when(c("quantity").isNull() | (c("quantity") < 0), 1)).alias("bad_quantity"), F.count("*").alias("rows"))


def upsert_bars(stored: DataFrame, fresh: DataFrame, key="code", date="date", load="load_time") -> DataFrame:
    """Append rows after each key's stored end; the latest load of a day wins."""
    end = stored.groupBy(key).agg(F.max(date).alias("_end"))
    add = fresh.join(end, key, "left").where(F.col("_end").isNull() | (F.col(date) > F.col("_end"))).drop("_end")
    return keep_one(stored.unionByName(add), [key, date], [load])


def complete_snapshots(df: DataFrame, by: str, weight: str, lo=98.0, hi=102.0) -> DataFrame:
    """Snapshot dates whose weights sum to about one hundred."""
    ok = df.groupBy(by).agg(F.sum(weight).alias("_s")).where(F.col("_s").between(lo, hi)).select(by)
    return df.join(ok, by, "left_semi")


def unify(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Tables of different shape brought to one schema; columns a source lacks are missing."""
    out = None
    for df, cols in parts:
        d = df.select(*[c.alias(n) for n, c in cols.items()])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def name_levels(history: DataFrame, names: DataFrame, switch: str) -> DataFrame:
    """Book version by effective date and availability, then names of the three code prefixes.

    ``names``: version (old, new), sw_code, name.  Prefix keys are six digits, so the
    name table is code-book sized and left to the optimiser's size check.
    """
    have = names.select("sw_code", "version").distinct()
    d = history.join(have.where("version = 'old'").select("sw_code", F.lit(True).alias("_old")), "sw_code", "left")
    d = d.join(have.where("version = 'new'").select("sw_code", F.lit(True).alias("_new")), "sw_code", "left")
    late = F.col("effective_date") >= F.lit(switch).cast("date")
    old, new = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    d = d.withColumn("version", F.when(new & (late | ~old), "new").when(old & (~late | ~new), "old").otherwise("unknown")).drop("_old", "_new")
    labels = keep_one(names, ["version", "sw_code"], ["name"])
    for level, width in ((1, 2), (2, 4), (3, 6)):
        k = f"l{level}_code"
        d = d.withColumn(k, F.rpad(F.substring("sw_code", 1, width), 6, "0"))
        d = d.join(labels.select("version", F.col("sw_code").alias(k), F.col("name").alias(f"l{level}_name")), ["version", k], "left")
    return d


def unanimous_names(members: DataFrame, key: str, name: str) -> DataFrame:
    """Name of a key when all its members agree."""
    g = members.groupBy(key).agg(F.count_distinct(name).alias("_n"), F.min(name).alias("name"))
    return g.where("_n = 1").select(key, "name")
