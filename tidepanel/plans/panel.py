"""Panel construction steps: prices, flags, universes, labels, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import col, div
from tidepanel.operators import ordering as O
from tidepanel.operators import rolling as R
from tidepanel.operators.cross import with_stats


def limit_ratio(code: Column, date: Column, is_st: Column, reform: str = "2020-08-24") -> Column:
    """Daily price limit: 5% special treatment, 10% main board, 20% growth board since its reform and the
    innovation board, 30% the third exchange."""
    growth = code.rlike(r"^sz\.30[01]") & (date >= F.lit(reform).cast("date"))
    return (F.when(code.startswith("bj."), 0.30).when(code.startswith("sh.688") | growth, 0.20)
            .when(is_st, 0.05).otherwise(0.10))


def half_up_cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def trade_flags(df: DataFrame, free_days: int = 5, reform: str = "2020-08-24") -> DataFrame:
    """Limit prices and what could be bought or sold at the open.

    Needs code_text, date, is_st, preclose, open_raw, volume, trading, days_listed.
    """
    ratio = limit_ratio(F.col("code_text"), F.col("date"), F.col("is_st"), reform)
    d = df.withColumn("limit_ratio", ratio)
    d = d.withColumns({"limit_up": half_up_cents(F.col("preclose") * (1 + F.col("limit_ratio"))),
                       "limit_down": half_up_cents(F.col("preclose") * (1 - F.col("limit_ratio"))),
                       "is_suspended": (F.col("trading") == 0) | (F.col("volume") <= 0)})
    limited = (F.col("days_listed") >= free_days) & ~F.col("is_suspended")
    up = F.coalesce(limited & (F.col("open_raw") >= F.col("limit_up") - 1e-6), F.lit(False))
    down = F.coalesce(limited & (F.col("open_raw") <= F.col("limit_down") + 1e-6), F.lit(False))
    d = d.withColumns({"limit_up_open": up, "limit_down_open": down})
    return d.withColumns({"tradable_buy": ~F.col("is_suspended") & ~F.col("limit_up_open"),
                          "tradable_sell": ~F.col("is_suspended") & ~F.col("limit_down_open")})


def share_fields(df: DataFrame) -> DataFrame:
    """vwap, float shares (held over days without turnover) and float cap."""
    shares = F.when((F.col("turn") > 0) & (F.col("volume") > 0), F.col("volume") / F.nullif(F.col("turn") / 100, F.lit(0.0)))
    d = df.withColumns({"vwap": F.when(F.col("volume") > 0, div("amount", "volume")), "_s": shares})
    d = d.withColumn("float_shares", R.ffill("_s"))
    return d.withColumn("float_cap", F.col("close") * F.col("float_shares")).drop("_s")


def rule_universe(df: DataFrame, window: int, drop: float, eligible: Column) -> DataFrame:
    """Eligible names whose mean amount ranks above the dropped fraction of the eligible ones of the date."""
    d = df.withColumn("_ma", R.ts_mean("amount", window))
    d = d.withColumn("_e", F.coalesce(eligible & F.col("_ma").isNotNull(), F.lit(False)))
    d = O.with_rank(d, ["date"], F.when(F.col("_e"), F.col("_ma")), "_pct")
    return d.withColumn("in_universe", F.coalesce(F.col("_e") & (F.col("_pct") > drop), F.lit(False))).drop("_ma", "_e", "_pct")


def embargo(df: DataFrame, horizons, last_pos: Column) -> DataFrame:
    """Drop labels whose exit lies past the window."""
    return df.withColumns({f"label_{h}": F.when(F.col("pos") + 1 + h <= last_pos, F.col(f"label_{h}")) for h in horizons})


def quality_report(df: DataFrame, min_names: int, horizon: str) -> DataFrame:
    """Check rows over the panel: universe size, close and label coverage, wild returns."""
    uni = F.col("in_universe")
    days = df.groupBy("date").agg(F.count(F.when(uni, 1)).alias("n"))
    small = days.agg(F.min("n").alias("v")).select(F.lit("min_universe").alias("check"), F.col("v").cast("double").alias("value"),
                                                   (F.col("v") >= min_names).cast("int").alias("passed"))
    n = F.nullif(F.count(F.when(uni, 1)), F.lit(0))
    a = df.agg((F.count(F.when(uni, F.col("close"))) / n).alias("close_coverage"),
               (F.count(F.when(uni, F.col(horizon))) / n).alias("label_coverage"),
               (F.count(F.when(uni & (F.abs("ret_1d") > 0.5), 1)) / n).alias("anomaly_rate"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), ok.cast("int").alias("passed"))
        for k, ok in (("close_coverage", F.col("close_coverage") >= 0.95), ("label_coverage", F.col("label_coverage") >= 0.5),
                      ("anomaly_rate", F.col("anomaly_rate") <= 0.01))]))
    return small.unionByName(a.select(rows.alias("x")).select("x.*"))


def describe(df: DataFrame, fields, probs=(0.01, 0.25, 0.5, 0.75, 0.99), keys=("code", "date")) -> DataFrame:
    """Coverage, mean, std and exact quantiles per numeric field, one row per field."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])).alias("v")).select(*keys, "v.*")
    a = long.groupBy("field").agg((F.count("x") / F.count("*")).alias("coverage"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    q = O.quantiles(long, ["field"], {f"q{int(p * 100):02d}": ("x", p) for p in probs}, keys=keys)
    return a.join(q, "field")


def top_values(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), field).limit(n)


def with_proxy(etf: DataFrame, index: DataFrame, prices=("open", "close")) -> DataFrame:
    """Prepend the tracked index, rescaled to the fund's first close, before the fund's first day."""
    first = etf.groupBy("code").agg(F.min("date").alias("_first"), F.min_by("close", "date").alias("_c"))
    at = index.join(first, "code").where(F.col("date") == F.col("_first")).select("code", div("_c", "close").alias("_scale"))
    pre = index.join(first, "code").where(F.col("date") < F.col("_first")).join(at, "code")
    pre = pre.select("code", "date", *[(F.col(p) * F.col("_scale")).alias(p) for p in prices], F.lit(1).alias("is_proxy"))
    pre = pre.where(F.col("close").isNotNull())
    return etf.select("code", "date", *prices, F.lit(0).alias("is_proxy")).unionByName(pre)


def fund_panel(df: DataFrame, horizons, listed: int, min_amount: float, window: int, least: int) -> DataFrame:
    """Listed count, liquidity screen and labels of a fund panel on the dense grid."""
    w = R.by_code().rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumns({"listed": F.count("close").over(w),
                        "_a": R.ts_mean(F.when(F.col("amount") > 0, F.col("amount")), window, least),
                        "has_bar": F.col("close").isNotNull() & F.col("open").isNotNull()})
    liquid = F.col("_a").isNull() | (F.col("_a") >= min_amount)
    d = d.withColumn("in_universe", F.col("has_bar") & (F.col("listed") >= listed) & liquid)
    can = F.coalesce(R.ts_lead("has_bar", 1), F.lit(False))
    return d.withColumns({f"label_{h}": F.when(can, div(R.ts_lead("open", 1 + h), R.ts_lead("open", 1)) - 1) for h in horizons}).drop("_a")


def weight_returns(panel: DataFrame, snaps: DataFrame, cal: DataFrame) -> DataFrame:
    """Index return from published weights: held from the next day and drifting with prices until replaced.

    ``snaps``: snap_pos, code, weight; ``panel``: pos, code, close.  Every position is
    mapped to the snapshot in force the day before it.
    """
    p0 = snaps.join(panel.select(F.col("pos").alias("snap_pos"), "code", F.col("close").alias("p0")), ["snap_pos", "code"])
    p0 = p0.where((F.col("p0") > 0) & (F.col("weight") > 0)).withColumn("shares", F.col("weight") / F.nullif("p0", F.lit(0.0)))
    held = snap_in_force(snaps, cal)
    px = panel.select("pos", "code", "close").withColumn("prev", F.lag("close").over(R.by_code()))
    j = px.join(F.broadcast(held), "pos").join(p0.select("snap_pos", "code", "shares"), ["snap_pos", "code"])
    return j.groupBy("pos").agg((div(F.sum(F.col("shares") * F.col("close")), F.sum(F.col("shares") * F.col("prev"))) - 1).alias("ret"),
                                F.count("*").alias("names"))


def snap_in_force(snaps: DataFrame, cal: DataFrame, lag: int = 1) -> DataFrame:
    """Position -> latest snapshot position at most ``pos - lag``; calendar sized."""
    s = snaps.select(F.col("snap_pos").alias("pos")).distinct().withColumn("_s", F.col("pos"))
    c = cal.select("pos").join(F.broadcast(s.select((F.col("pos") + lag).alias("pos"), "_s")), "pos", "left")
    return c.select("pos", F.last("_s", True).over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).alias("snap_pos")).where("snap_pos is not null")


def drifted_weights(panel: DataFrame, snaps: DataFrame, cal: DataFrame) -> DataFrame:
    """Reference weights of every day, drifting with prices since the snapshot of the day or before."""
    p0 = snaps.join(panel.select(F.col("pos").alias("snap_pos"), "code", F.col("close").alias("p0")), ["snap_pos", "code"])
    j = panel.select("pos", "code", "close").join(F.broadcast(snap_in_force(snaps, cal, 0)), "pos").join(p0, ["snap_pos", "code"])
    j = j.withColumn("_w", F.col("weight") * div("close", "p0")).where("_w is not null")
    return with_stats(j, "pos", {"_t": F.sum("_w")}).select("pos", "code", div("_w", "_t").alias("weight"))


def cap_weighted(panel: DataFrame, member: Column) -> DataFrame:
    """Prior-day cap weights times today's return, per date (dense grid)."""
    d = panel.withColumn("_w", F.when(member & (F.col("circ_mv") > 0), F.col("circ_mv")).otherwise(0.0))
    d = d.withColumn("_w", R.ts_delay("_w", 1))
    return d.groupBy("date").agg(div(F.sum(F.col("_w") * F.coalesce("ret_1d", F.lit(0.0))), F.sum("_w")).alias("proxy"))


def detect_changes(df: DataFrame, fields, out: str) -> DataFrame:
    """1 where a present value differs from the previous row's (missing before counts as a change)."""
    hit = F.lit(False)
    for f in fields:
        x = col(f)
        hit = hit | (x.isNotNull() & ~x.eqNullSafe(F.lag(x).over(R.by_code())))
    return df.withColumn(out, hit.cast("int"))


def retrain_points(cal: DataFrame, every: str, first) -> DataFrame:
    """First trading day of each week, month or quarter from ``first`` on."""
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}[every]
    d = cal.where(F.col("date") >= first)
    return d.groupBy(F.trunc("date", unit).alias("period")).agg(F.min("date").alias("date"), F.min("pos").alias("pos"))
