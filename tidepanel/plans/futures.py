"""Index-future hedge leg from contract bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import div
from tidepanel.functions.dates import third_friday
from tidepanel.operators.grid import next_trading_day


def settlement_days(cal: DataFrame) -> DataFrame:
    """Per month of the calendar: third Friday, or the next trading day after it."""
    m = cal.select(F.trunc("date", "month").alias("month")).distinct()
    return next_trading_day(m.withColumn("_f", third_friday(F.col("month"))), cal, "_f", "settle", "settle_pos", inclusive=True).drop("_f")


def front_leg(bars: DataFrame, spot: DataFrame, cal: DataFrame, settle: DataFrame) -> DataFrame:
    """Daily return of holding the front contract to settlement and rolling at that close.

    ``bars``: pos, contract month ``month``, close; ``spot``: pos, spot.  The calendar
    side has one row per day, so its lookups are broadcast.
    """
    e = settle.select(F.col("month"), F.col("settle_pos").alias("expiry"))
    live = cal.select("pos").join(F.broadcast(e), F.col("expiry") > F.col("pos"))
    held = live.groupBy("pos").agg(F.min_by("month", "expiry").alias("month"), F.min("expiry").alias("expiry"))
    d = held.join(bars, ["pos", "month"], "left").join(spot, "pos", "left")
    d = d.withColumn("ok", F.col("close").isNotNull() & F.col("spot").isNotNull())
    w = W.orderBy("pos")
    d = d.withColumns({"_m": F.lag(F.when(F.col("ok"), F.col("month"))).over(w), "_c": F.lag(F.when(F.col("ok"), F.col("close"))).over(w)})
    now = bars.select("pos", F.col("month").alias("_m"), F.col("close").alias("_now"))
    d = d.join(now, ["pos", "_m"], "left")
    roll = e.select(F.col("expiry").alias("pos"), F.lit(1).alias("roll")).distinct()
    d = d.join(F.broadcast(roll), "pos", "left")
    return d.select("pos", "month", (div("_now", "_c") - 1).alias("fut_ret"), F.when(F.col("ok"), div("close", "spot") - 1).alias("basis"),
                    F.when(F.col("ok"), F.col("expiry") - F.col("pos")).alias("days_to_expiry"), F.coalesce("roll", F.lit(0)).alias("roll"))


def splice_leg(cont: DataFrame, settle: DataFrame, converged: float) -> DataFrame:
    """Return of a continuous series with rolls inferred on settlement days.

    A wide basis on a settlement day means the series already quotes the next
    contract: that day earns spot over yesterday's future.  Otherwise the next day
    earns the spot return.  ``cont``: pos, future, spot (one row per day).
    """
    w = W.orderBy("pos")
    s = settle.select(F.col("settle_pos").alias("pos"), F.lit(1).alias("_s")).distinct()
    last = cont.agg(F.max("pos").alias("_last"))
    d = cont.join(F.broadcast(s), "pos", "left").join(F.broadcast(last))
    d = d.withColumns({"basis": div("future", "spot") - 1, "_pf": F.lag("future").over(w), "_ps": F.lag("spot").over(w)})
    is_s = (F.col("_s") == 1) & (F.col("pos") < F.col("_last"))
    d = d.withColumn("_wide", F.when(is_s, F.abs("basis") > converged))
    after = F.lag("_wide").over(w)
    r = (F.when(F.col("_wide"), div("spot", "_pf") - 1).when(after == F.lit(False), div("spot", "_ps") - 1).otherwise(div("future", "_pf") - 1))
    return d.select("pos", r.alias("fut_ret"), "basis", F.coalesce(is_s, F.lit(False)).cast("int").alias("roll"))


def complete_roll_start(bars: DataFrame, cal: DataFrame, settle: DataFrame) -> DataFrame:
    """First settlement from which every front contract has a price on every day it is held."""
    e = settle.select("month", F.col("settle_pos").alias("expiry"))
    w = W.orderBy("expiry")
    seg = e.withColumns({"front": F.lead("month").over(w), "until": F.lead("expiry").over(w)}).where(F.col("front").isNotNull())
    days = seg.join(F.broadcast(cal.select("pos")), (F.col("pos") >= F.col("expiry")) & (F.col("pos") <= F.col("until")))
    b = bars.where(F.col("close").isNotNull()).select("pos", F.col("month").alias("front"), F.lit(1).alias("_has"))
    full = days.join(b, ["pos", "front"], "left").groupBy("expiry").agg((F.count("_has") == F.count("*")).cast("int").alias("full"))
    rev = W.orderBy(F.desc("expiry")).rowsBetween(W.unboundedPreceding, 0)
    return full.withColumn("_all", F.min("full").over(rev)).where("_all = 1").agg(F.min("expiry").alias("start_pos"))
