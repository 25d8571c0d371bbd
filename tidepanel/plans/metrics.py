"""Signal and return statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import corr, div


def benchmark_returns(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """Close-to-close return on calendar days with the last known price carried (calendar sized)."""
    w = W.orderBy("date")
    d = cal.join(F.broadcast(prices), "date", "left")
    d = d.select("date", F.last("px", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("px"))
    return d.select("date", (div("px", F.lag("px").over(w)) - 1).alias("bret"))


MIN_NAMES = 20


def rank_ic(long: DataFrame, value: str, target: str, by=("factor", "date"), keys=("code",), min_names: int = MIN_NAMES,
            valid=None, write: bool = True) -> DataFrame:
    """Spearman correlation per group over rows where both sides are present.

    Missing when there are too few names or a side does not vary.  Rounding at 1e-12 keeps
    an exact zero from turning into a signed speck of float noise.
    """
    from tidepanel.operators.ordering import with_ranks

    ok = F.col(value).isNotNull() & F.col(target).isNotNull()
    if valid is not None:
        ok = ok & valid
    d = with_ranks(long.where(ok), list(by), {"_ra": value, "_rb": target}, pct=False, keys=keys, write=write)
    varies = (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    return d.groupBy(*by).agg(F.when((F.count("*") >= min_names) & varies, F.round(corr("_ra", "_rb"), 12)).alias("ic"), F.count("*").alias("names"))


def summarize_ic(ic: DataFrame, by=("factor",)) -> DataFrame:
    """Mean, std, ratio, positive share, days and bias-corrected shape of a daily series."""
    x = F.col("ic")
    d = ic.where(x.isNotNull()).groupBy(*by).agg(
        F.avg(x).alias("ic_mean"), F.stddev_samp(x).alias("ic_std"), F.avg((x > 0).cast("double")).alias("positive"),
        F.count("*").alias("days"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    n, g1, g2 = F.col("days"), F.col("_g1"), F.col("_g2")
    return d.select(
        *by, "ic_mean", "ic_std", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.nullif("ic_std", F.lit(0.0))).alias("icir"), "positive", "days",
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).otherwise(0.0).alias("skew"),
        F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) + 3).otherwise(3.0).alias("kurtosis"))


def coverage(long: DataFrame, by=("factor",)) -> DataFrame:
    """Mean over dates of the share of universe names with a value."""
    u = F.col("in_universe")
    d = long.groupBy(*by, "date").agg(F.count(F.when(u, 1)).alias("n"), F.count(F.when(u, F.col("value"))).alias("c"))
    return d.where("n > 0").groupBy(*by).agg(F.avg(F.col("c") / F.nullif("n", F.lit(0))).alias("coverage"))


def wide_coverage(d: DataFrame, names: list[str]) -> DataFrame:
    """``coverage`` of the columns of a wide table, one row for each column."""
    u = F.col("in_universe")
    g = d.groupBy("date").agg(F.count(F.when(u, 1)).alias("_n"), *[F.count(F.when(u, F.col(f))).alias(f) for f in names]).where("_n > 0")
    g = g.agg(*[F.avg(F.col(f) / F.nullif("_n", F.lit(0))).alias(f) for f in names])
    return g.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("coverage")) for f in names])).alias("_e")).select("_e.*")


def bucket_returns(daily: DataFrame, q: int, by=("factor",)) -> DataFrame:
    """Mean over dates of the bucket means (factor, date, bucket, m), and top minus bottom."""
    d = daily.groupBy(*by).agg(*[F.avg(F.when(F.col("bucket") == i, F.col("m"))).alias(f"q{i}") for i in range(1, q + 1)])
    return d.withColumn("long_short", F.col(f"q{q}") - F.col("q1"))


def quantile_returns(long: DataFrame, target: str, q: int = 5, by=("factor",), keys=("code",), write=True) -> DataFrame:
    """Mean over dates of the mean target per value bucket, and top minus bottom."""
    from tidepanel.operators.ordering import with_rank

    d = long.where(F.col("value").isNotNull() & F.col(target).isNotNull() & F.col("in_universe"))
    d = with_rank(d, [*by, "date"], "value", "_p", keys=keys, write=write)
    b = F.least(F.greatest(F.ceil(F.col("_p") * q), F.lit(1)), F.lit(q))
    d = d.groupBy(*by, "date", b.alias("bucket")).agg(F.avg(target).alias("m"))
    d = d.groupBy(*by).pivot("bucket", list(range(1, q + 1))).agg(F.avg("m"))
    d = d.select(*by, *[F.col(str(i)).alias(f"q{i}") for i in range(1, q + 1)])
    return d.withColumn("long_short", F.col(f"q{q}") - F.col("q1"))


def subwindow_means(ic: DataFrame, n: int, by=("factor",)) -> DataFrame:
    """Means over n equal chunks of the dates (first chunks one longer)."""
    d = ic.where(F.col("ic").isNotNull()).withColumn("chunk", F.ntile(n).over(W.partitionBy(*by).orderBy("date")))
    return d.groupBy(*by, "chunk").agg(F.avg("ic").alias("ic"))


def top_fraction(df: DataFrame, value: str, every: int, fraction: float, cost: float) -> DataFrame:
    """Equal-weight best names each ``every`` days, next open to next open, against all buyable names.

    ``df`` is a dense grid with open, buyable, in_universe.  One row per rebalance.
    """
    from tidepanel.operators import rolling as R
    from tidepanel.operators.cross import with_stats
    from tidepanel.operators.ordering import position

    last = df.agg(F.max("pos").alias("_last"))
    d = df.withColumns({"_in": R.ts_lead("open", 1), "_out": R.ts_lead("open", 1 + every), "_buy": F.coalesce(R.ts_lead("buyable", 1), F.lit(False))})
    d = d.join(F.broadcast(last)).where((F.col("pos") % every == 0) & (F.col("pos") + every + 1 <= F.col("_last")))
    scored = F.col("in_universe") & F.col(value).isNotNull()
    d = d.select("date", "pos", "code", value, F.coalesce(div("_out", "_in") - 1, F.lit(0.0)).alias("_r"), scored.alias("_s"),
                 (scored & F.col("_buy")).alias("_e"), (F.col("in_universe") & F.col("_buy")).alias("_b"))
    d = position(d, ["pos"], [F.when(F.col("_e"), -F.col(value)), "code"], "_place")
    d = with_stats(d, "pos", {"_n": F.greatest(F.floor(F.count(F.when(F.col("_s"), 1)) * fraction), F.lit(1))})
    d = d.withColumn("_w", F.when(F.col("_place") <= F.col("_n"), 1.0).otherwise(0.0))
    d = with_stats(d, "pos", {"_k": F.sum("_w")}).withColumn("_w", F.coalesce(div("_w", "_k"), F.lit(0.0)))
    d = d.withColumn("_pw", F.coalesce(F.lag("_w").over(R.by_code()), F.lit(0.0)))
    g = d.groupBy("date", "pos").agg(F.sum(F.col("_w") * F.col("_r")).alias("port"), F.coalesce(F.avg(F.when(F.col("_b"), F.col("_r"))), F.lit(0.0)).alias("bench"),
                                     F.sum(F.abs(F.col("_w") - F.col("_pw"))).alias("turnover"))
    g = g.withColumn("excess", F.col("port") - F.col("bench"))
    return g.withColumn("excess_net", F.col("excess") - F.col("turnover") * cost)


def _signed(ret: str, over) -> tuple[Column, Column]:
    """Sign (0 once everything is lost) and size of the product of 1 + ret."""
    x = F.col(ret)
    lost = F.coalesce(over(F.max((x == -1).cast("int"))), F.lit(0))
    flips = F.coalesce(over(F.sum((x < -1).cast("int"))), F.lit(0))
    return F.when(lost == 1, 0).otherwise(1 - 2 * (flips % 2)), F.exp(over(F.sum(F.ln(F.when(x != -1, F.abs(1 + x))))))


def compounded(ret: str, window) -> Column:
    """Running product of 1 + ret.  A loss of everything takes it to zero for good."""
    sign, size = _signed(ret, lambda c: c.over(window))
    return F.when(sign == 0, 0.0).otherwise(sign * size)


def annual_growth(ret: str, ann: int) -> Column:
    """Annual rate of the compounded returns: -100 % if everything was lost, missing below that."""
    sign, size = _signed(ret, lambda c: c)
    rate = F.pow(size, F.lit(float(ann)) / F.nullif(F.count("*"), F.lit(0))) - 1
    return F.when(sign == 0, -1.0).when(sign > 0, rate)


def drawdown(df: DataFrame, ret: str, by: list[str], out="drawdown") -> DataFrame:
    """Cumulative curve and its fall from the running peak; series are calendar sized."""
    w = W.partitionBy(*by) if by else W.partitionBy()
    w = w.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("curve", compounded(ret, w))
    return d.withColumn(out, F.coalesce(div("curve", F.max("curve").over(w)) - 1, F.when(F.col("curve") == 0, -1.0)))


def performance(daily: DataFrame, ann: int, by: list[str] | None = None) -> DataFrame:
    """Return, benchmark, excess, tracking error, ratio, worst fall and cost of a daily table (date, ret, bench, cost)."""
    by = by or []
    d = daily.withColumn("excess", F.col("ret") - F.col("bench"))
    d = drawdown(d, "excess", by)
    a = lambda c: annual_growth(c, ann)
    te = F.stddev_samp("excess") * F.sqrt(F.lit(float(ann)))
    g = d.groupBy(*by).agg(
        F.count("*").alias("days"), a("ret").alias("annual_return"), a("bench").alias("annual_benchmark"), (F.avg("excess") * ann).alias("annual_excess"),
        te.alias("tracking_error"), F.min("drawdown").alias("max_drawdown"), (F.sum("cost") * ann / F.count("*")).alias("annual_cost"))
    return g.withColumn("information_ratio", F.when(F.col("tracking_error") > 0, F.col("annual_excess") / F.nullif("tracking_error", F.lit(0.0))))


def return_stats(daily: DataFrame, ann: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    d = drawdown(daily, "ret", by)
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(float(ann)))
    g = d.groupBy(*by).agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"),
                           annual_growth("ret", ann).alias("annual_return"), vol.alias("annual_vol"),
                           F.min("drawdown").alias("max_drawdown"), F.avg("ret").alias("_m"))
    return g.withColumn("sharpe", F.when(F.col("annual_vol") > 0, F.col("_m") * ann / F.nullif("annual_vol", F.lit(0.0)))).drop("_m")


def decile(place, n, bins: int = 10):
    """0-based bin of a 1-based first-order place, as equal-frequency cut edges assign it."""
    return F.greatest(F.ceil((place - 1) * bins / F.nullif(n - 1, F.lit(0))), F.lit(1)) - 1


def gate_first(m: DataFrame, limits: dict[str, float]) -> DataFrame:
    """First gate: coverage, days, mean, ratio, and library correlation unless clearly better than the match."""
    c = F.col
    better = (c("matched_icir").isNotNull()) & (c("icir") >= limits["replacement"] * F.abs("matched_icir"))
    checks = {"coverage": c("coverage") >= limits["coverage"], "valid_dates": c("days") >= limits["days"], "ic_mean": c("ic_mean") >= limits["ic_mean"],
              "icir": c("icir") >= limits["icir"], "library_corr": (c("max_abs_corr") <= limits["corr"]) | better}
    arr = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    d = m.withColumn("checks", arr)
    return d.withColumns({"passed": F.forall("checks", lambda x: x["passed"]),
                          "replacement": F.coalesce((c("max_abs_corr") > limits["corr"]) & better, F.lit(False))})


def gate_second(m: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Second gate: sub-window signs, neutral share, net excess (informational) and marginal gain."""
    c = F.col
    checks = {"same_sign": (c("same_sign") >= limits["same_sign"], False), "neutral_ratio": (div("neutral_ic", "ic_mean") >= limits["neutral"], False),
              "net_excess": (c("net_excess") > limits["net_excess"], True), "marginal": (c("marginal_ic") > limits["marginal"], False)}
    arr = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed"), F.lit(i).alias("informational")) for k, (v, i) in checks.items()])
    return m.withColumn("checks", arr).withColumn("passed", F.forall("checks", lambda x: x["passed"] | x["informational"]))
