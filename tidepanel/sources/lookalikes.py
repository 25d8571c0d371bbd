"""Event, statement, margin, flow and classification tables derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.adapters import UNIT, Stage, fixed


def _dec(c) -> F.Column:
    return F.sum(fixed(c)) / UNIT


def _ship():
    return F.col("l_shipdate").cast("date")


def marks(s: Stage) -> DataFrame:
    """Sparse dated values per supplier: one row per (code, pub_date)."""
    li = s.table("lineitem")
    return li.groupBy(F.col("l_suppkey").alias("code"), _ship().alias("pub_date")).agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"))


def margin(s: Stage) -> DataFrame:
    li = s.table("lineitem")
    x, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    return li.groupBy(F.col("l_suppkey").alias("code"), _ship().alias("date")).agg(
        _dec(x).alias("fin"), _dec(F.when(flag == "A", x).otherwise(0.0)).alias("fin_buy"),
        _dec(F.when(flag == "R", x).otherwise(0.0)).alias("fin_refund"), _dec(x * F.col("l_tax")).alias("sec"))


def industry_history(s: Stage) -> DataFrame:
    """Bitemporal labels: effective date, last update date, two levels."""
    d = s.table("lineitem").select(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("y")).distinct()
    k, y = F.col("code"), F.col("y")
    d = d.where((k + y) % 2 == 0)
    eff = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), ((k * 31 + y * 17) % 300).cast("int"))
    d = d.withColumn("effective_date", eff)
    return d.select("code", "effective_date",
                    F.date_add("effective_date", ((k * 7 + y * 13) % 500 - 100).cast("int")).alias("updated_at"),
                    F.concat(F.lit("I"), ((k + y) % 7).cast("string")).alias("l1"),
                    F.concat(F.lit("J"), ((k * 3 + y) % 13).cast("string")).alias("l2"))


def splits(s: Stage) -> DataFrame:
    d = s.table("lineitem").select(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("y")).distinct()
    k, y = F.col("code"), F.col("y")
    return d.where((k + y) % 3 == 0).select(
        "code", F.make_date(y, (1 + (k + y) % 12).cast("int"), F.lit(15)).alias("ex_date"),
        ((10 + (k * 3 + y) % 5 + (y - 1994) * 2) / F.lit(10.0)).alias("factor"))


def members(s: Stage) -> DataFrame:
    """Index membership snapshots, every second month."""
    b = s.panel.where(F.col("pos") % 2 == 0)
    idx = F.when(F.col("volume") >= 200, "big").when(F.col("volume") >= 120, "mid")
    return b.select(F.col("date").alias("snapshot_date"), "code", idx.alias("index")).where(F.col("index").isNotNull())


def flows(s: Stage) -> DataFrame:
    li = s.table("lineitem")
    x, flag, st, q = F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    net = lambda c: _dec(F.when(c, x).otherwise(-x))
    return li.groupBy(F.col("l_suppkey").alias("code"), F.trunc(_ship(), "month").alias("date")).agg(
        net(flag == "A").alias("main"), net(flag == "N").alias("jumbo"), net(st == "O").alias("block"),
        net(q > 25).alias("mid"), net(F.col("l_tax") > 0.04).alias("small"))


def statements(s: Stage) -> dict[str, DataFrame]:
    """Income, balance and cash statements per customer and quarter with their publication dates."""
    o = s.table("orders")
    d = o.groupBy(F.col("o_custkey").alias("code"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("qs")).agg(
        _dec(F.col("o_totalprice")).alias("rev"))
    q = F.year("qs") * 4 + F.quarter("qs")
    d = d.withColumn("q", q).withColumn("stat_date", F.date_sub(F.add_months("qs", 3), 1))
    k, q, rev = F.col("code"), F.col("q"), F.col("rev")
    pub = lambda lag, a, b: F.date_add("stat_date", (lag + (k * a + q * b) % 90).cast("int"))
    income = d.select("code", "stat_date", pub(20, 13, 7).alias("pub_income"), "rev",
                      (rev * ((k * 7 + q * 3) % 11 * 2 - 6) / 100).alias("profit"), (rev * (20 + (k + q) % 30) / 100).alias("gross"))
    liab = rev * (40 + k % 7 * 10) / 100
    eq = rev * (60 + k % 5 * 10) / 100
    balance = d.where((k + q) % 17 != 0).select(
        "code", "stat_date", pub(25, 11, 5).alias("pub_balance"), liab.alias("liab"), eq.alias("total_equity"),
        (eq * 95 / 100).alias("equity"), (eq * ((k * 5 + q) % 9) / 10).alias("goodwill"), (rev * ((k + q) % 6) / 10).alias("receivable"),
        (rev * ((k * 3 + q) % 8) / 10).alias("inventory"), (rev * ((k + q * 2) % 5) / 10).alias("cash"),
        (liab * ((k * 2 + q) % 4) / 10).alias("loan"), (rev * ((k * 11 + q * 5) % 7) / 50).alias("prepaid"),
        (rev * ((k * 17 + q) % 9) / 90).alias("other_receivable"))
    cash = d.where((k * 3 + q) % 19 != 0).select(
        "code", "stat_date", pub(22, 17, 3).alias("pub_cash"), (rev * ((k * 5 + q * 11) % 7 * 10 - 25) / 100).alias("ocf"))
    return {"income": income, "balance": balance, "cash": cash}


def publications(s: Stage) -> DataFrame:
    """Published quarters with later re-publications of the same quarter and late old quarters."""
    i = statements(s)["income"].select("code", "stat_date", F.col("pub_income").alias("pub_date"), F.col("rev").alias("value"))
    k = F.col("code")
    again = i.where((k + F.month("stat_date")) % 5 == 0).select(
        "code", "stat_date", F.date_add("pub_date", 60).alias("pub_date"), (F.col("value") * 2).alias("value"))
    late = i.where((k + F.year("stat_date")) % 7 == 0).select(
        "code", "stat_date", F.date_add("pub_date", 400).alias("pub_date"), F.col("value"))
    keep = i.where((k + F.year("stat_date")) % 7 != 0)
    return keep.unionByName(again).unionByName(late)
