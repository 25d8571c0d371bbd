"""Panel, statement, trade and text stand-ins derived from the sample tables.

Sums run over fixed-point longs so that their value does not depend on the order
of the rows; simulated columns are arithmetic on keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import div
from tidepanel.operators.grid import densify
from tidepanel.operators.rolling import ts_lead, ts_return
from tidepanel.operators.staging import materialize

HORIZONS = (1, 3, 6)
# Currency rate of the stand-in prices; a long fraction keeps averages off rounding ties.
RATE = 0.13876543219
UNIT = 10000.0


def fixed(x: Column) -> Column:
    """Fixed-point long with four decimals: its sums do not depend on row order and stay in codegen."""
    return F.floor(x * UNIT + 0.5)
FIELDS = ["open", "high", "low", "close", "vwap", "volume", "amount", "n_lines", "turnover", "circ_mv", "pb_mrq",
          "pe_ttm"]


def with_labels(df: DataFrame, horizons=HORIZONS, price: str = "open", buyable: str = "buyable") -> DataFrame:
    """Return from the next open to the open h days on, only where the next day can be bought."""
    entry = ts_lead(price, 1)
    can = F.coalesce(ts_lead(buyable, 1), F.lit(False))
    return df.withColumns({f"label_{h}": F.when(can, div(ts_lead(price, 1 + h), entry) - 1) for h in horizons})


class Stage:
    """Lazy views over one folder of sample tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def suppliers(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("grp"), F.col("n_regionkey").alias("region"))

    @cached_property
    def bars(self) -> DataFrame:
        """Supplier by month bars: one row per (date, code) with at least one line."""
        li = self.table("lineitem").select(
            F.col("l_suppkey").alias("code"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"),
            fixed(F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("px"),
            F.dayofmonth("l_shipdate").alias("dom"),
            F.col("l_quantity").alias("q"),
            fixed(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amt"),
        )
        early = F.when(F.col("dom") <= 15, F.col("px"))
        g = li.groupBy("code", "date").agg(
            (F.sum(early) / UNIT).alias("_so"), F.count(early).alias("_co"), (F.max("px") / UNIT).alias("high"),
            (F.min("px") / UNIT).alias("low"), (F.sum("px") / UNIT).alias("_sc"), F.count("px").alias("n_lines"),
            F.sum("q").alias("volume"), (F.sum("amt") / UNIT).alias("amount"))
        return g.select(
            "code", "date", (F.col("_so") / F.nullif("_co", F.lit(0)) * RATE).alias("open"),
            (F.col("high") * RATE).alias("high"), (F.col("low") * RATE).alias("low"),
            (F.col("_sc") / F.nullif("n_lines", F.lit(0)) * RATE).alias("close"),
            (F.col("amount") / F.nullif("volume", F.lit(0.0)) * RATE).alias("vwap"),
            "volume", (F.col("amount") * RATE).alias("amount"), "n_lines")

    @cached_property
    def _months(self) -> DataFrame:
        """Calendar with the month's volume, from one pass over two columns; one row per month."""
        m = self.table("lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")).agg(F.sum("l_quantity").alias("_v"))
        return m.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("pos"), "_v")

    @cached_property
    def cal(self) -> DataFrame:
        return self._months.select("date", "pos")

    @cached_property
    def core(self) -> DataFrame:
        """Bars with position and derived fields, before the group labels."""
        p = self.bars.join(F.broadcast(self._months), "date")
        book = 500 + F.col("code") * 7919 % 700
        eps = F.col("code") * 31 % 97 - 10
        return p.select(
            "*", (F.col("volume") / F.nullif("_v", F.lit(0.0))).alias("turnover"), F.col("amount").alias("circ_mv"),
            (F.col("close") / book).alias("pb_mrq"), div("close", eps.cast("double")).alias("pe_ttm")).drop("_v")

    @cached_property
    def panel(self) -> DataFrame:
        return self.core.join(self.suppliers, "code")

    @cached_property
    def dense(self) -> DataFrame:
        """Panel on the full grid with group labels, one-day return and buyability."""
        d = densify(self.core, self.cal, FIELDS)
        d = d.withColumn("ret_1d", ts_return("close")).join(self.suppliers, "code")
        return d.withColumns({
            "buyable": F.coalesce((F.col("n_lines") >= 2) & F.col("open").isNotNull(), F.lit(False)),
            "in_universe": F.coalesce(F.col("n_lines") >= 3, F.lit(False)),
        })

    @cached_property
    def labelled(self) -> DataFrame:
        return with_labels(self.dense)

    @cached_property
    def stored(self) -> DataFrame:
        """The labelled grid as a written table, for queries that read it more than once."""
        return materialize(self.labelled)
