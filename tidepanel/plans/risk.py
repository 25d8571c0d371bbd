"""Factor-risk estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import div, log_
from tidepanel.operators import rolling as R
from tidepanel.operators.cross import with_stats

# Style names of the risk model.
STYLES = ("size", "beta", "momentum", "volatility", "liquidity", "value")


def style_windows(df: DataFrame, year: int = 12, beta_n=24, beta_least=12, vol_n=24, vol_least=16, mom=(1, 12),
                  liq_n=12, liq_least=9) -> DataFrame:
    """Raw style values: log cap, paired beta, momentum skipping the latest stretch, log vol, log amount, log 1/PB.

    Defaults suit a monthly grid; pass the daily lengths (beta 60/30, vol 60/40,
    momentum 20 to 252, liquidity 20/15, year 252) for daily bars.
    """
    num = F.sum(F.col("ret_1d") * F.col("circ_mv"))
    den = F.sum(F.when(F.col("ret_1d").isNotNull(), F.col("circ_mv")))
    d = with_stats(df, "date", {"mkt": div(num, den)})
    d = d.withColumns({
        "size": log_("circ_mv"), "beta": R.ts_beta("ret_1d", "mkt", beta_n, beta_least),
        "_near": R.ts_delay("close", mom[0]), "_far": R.ts_delay("close", mom[1]),
        "_vol": R.ts_std_pop("ret_1d", vol_n, vol_least), "_liq": R.ts_mean("amount", liq_n, liq_least),
        "value": F.when(F.col("pb_mrq") > 0, -F.ln("pb_mrq")),
    })
    return d.withColumns({
        "momentum": log_(div("_near", "_far")), "volatility": log_(F.col("_vol") * F.sqrt(F.lit(float(year)))),
        "liquidity": log_("_liq"),
    }).drop("_near", "_far", "_vol", "_liq")


def style_exposures(df: DataFrame, styles=STYLES, min_names=100, min_cover=0.8) -> DataFrame:
    """Universe-fitted z of every style: columns ``{style}_z`` and ``{style}_z_available``."""
    from tidepanel.operators.cross import standardize_on

    return standardize_on(df, {f"{x}_z": x for x in styles}, F.col("in_universe"), size=("size_z",), min_names=min_names, min_cover=min_cover)


def exposures_long(df: DataFrame, styles: list[str], industry: str) -> DataFrame:
    """(date, code, factor, exposure): market, own industry and styles."""
    rows = F.array(
        F.struct(F.lit("market").alias("factor"), F.lit(1.0).alias("exposure")),
        F.struct(F.concat(F.lit("industry:"), F.col(industry).cast("string")).alias("factor"), F.lit(1.0).alias("exposure")),
        *[F.struct(F.lit(x).alias("factor"), F.col(x).alias("exposure")) for x in styles])
    return df.select("date", "code", F.explode(rows).alias("_e")).select("date", "code", "_e.*")


def factor_returns(df: DataFrame, styles: list[str], industry: str, ret_next: str, ridge: float, min_names: int = 100) -> DataFrame:
    """Per-date constrained weighted regression: (date, factor, value).

    Weights are root caps; benchmark-weighted industry returns sum to zero.  A name
    loads on the market, one industry and the styles, so all normal equations follow
    from sums per (date, industry); the dense solve sees one row per industry, never
    the names.
    """
    cap = F.col("circ_mv")
    bench_ok = F.col("in_universe") & (cap > 0)
    ok = bench_ok & F.col(ret_next).isNotNull()
    c = lambda x: F.when(ok, x)
    om, y = F.sqrt(cap), F.col(ret_next)
    k = len(styles)
    aggs = [F.sum(F.when(bench_ok, cap)).alias("b"), F.sum(c(om)).alias("o"), F.sum(c(om * y)).alias("oy"), F.count(c(om)).alias("n")]
    aggs += [F.sum(c(om * F.col(a))).alias(f"s{i}") for i, a in enumerate(styles)]
    aggs += [F.sum(c(om * F.col(a) * y)).alias(f"t{i}") for i, a in enumerate(styles)]
    aggs += [F.sum(c(om * F.col(a) * F.col(b))).alias(f"q{i}_{j}") for i, a in enumerate(styles) for j, b in enumerate(styles) if j >= i]
    cells = df.groupBy("date", F.col(industry).cast("string").alias("industry")).agg(*aggs)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"date": pd.Series(dtype=object), "factor": pd.Series(dtype=object), "value": pd.Series(dtype=float)})
        p = pdf.fillna(0.0).sort_values("industry").reset_index(drop=True)
        active = p[p["n"] > 0].reset_index(drop=True)
        if p["n"].sum() < min_names or len(active) == 0 or (p.loc[p["n"] == 0, "b"] > 0).any():
            return none
        scale = active["o"].sum()
        g = len(active)
        m = np.zeros((1 + g + k, 1 + g + k))
        v = np.zeros(1 + g + k)
        o, oy = active["o"].to_numpy() / scale, active["oy"].to_numpy() / scale
        s = active[[f"s{i}" for i in range(k)]].to_numpy() / scale
        m[0, 0], v[0] = o.sum(), oy.sum()
        idx = np.arange(1, 1 + g)
        m[0, idx] = m[idx, 0] = o
        m[idx, idx] = o
        v[idx] = oy
        m[0, 1 + g:] = m[1 + g:, 0] = s.sum(axis=0)
        m[1:1 + g, 1 + g:] = s
        m[1 + g:, 1:1 + g] = s.T
        for i in range(k):
            v[1 + g + i] = active[f"t{i}"].sum() / scale
            for j in range(i, k):
                m[1 + g + i, 1 + g + j] = m[1 + g + j, 1 + g + i] = active[f"q{i}_{j}"].sum() / scale
        b = active["b"].to_numpy() / p["b"].sum()
        ref = int(np.argmax(b))
        keep = [0, *[1 + i for i in range(g) if i != ref], *range(1 + g, 1 + g + k)]
        t = np.zeros((1 + g + k, len(keep)))
        for col_, row in enumerate(keep):
            t[row, col_] = 1.0
            if 1 <= row <= g:
                t[1 + ref, col_] = -b[row - 1] / b[ref]
        lhs = t.T @ m @ t
        lhs[-k:, -k:] += np.eye(k) * ridge
        f = t @ np.linalg.solve(lhs, t.T @ v)
        names = ["market", *("industry:" + x for x in active["industry"]), *styles]
        return pd.DataFrame({"date": pdf["date"].iloc[0], "factor": names, "value": f})

    return cells.groupBy("date").applyInPandas(solve, "date date, factor string, value double")


def residual_returns(df: DataFrame, returns: DataFrame, styles: list[str], industry: str, ret_next: str) -> DataFrame:
    """Next return minus its factor part, for the dates with a fit."""
    wide = returns.groupBy("date").agg(F.max(F.when(F.col("factor") == "market", F.col("value"))).alias("_f_m"),
                                       *[F.max(F.when(F.col("factor") == x, F.col("value"))).alias(f"_f_{x}") for x in styles])
    ind = returns.where(F.col("factor").startswith("industry:")).select("date", F.substring("factor", 10, 1000).alias("_ind"), F.col("value").alias("_f_i"))
    d = df.withColumn("_ind", F.col(industry).cast("string")).join(F.broadcast(wide), "date").join(ind, ["date", "_ind"], "left")
    fit = F.col("_f_m") + F.col("_f_i")
    for x in styles:
        fit = fit + F.col(f"_f_{x}") * F.col(x)
    return d.withColumn("residual", F.when(F.col("in_universe") & (F.col("circ_mv") > 0), F.col(ret_next) - fit)).drop("_ind", "_f_m", "_f_i", *[f"_f_{x}" for x in styles])


def ew_covariance(returns: DataFrame, cal: DataFrame, half_life: float, window: int, least: int, shrink: float = 0.1) -> DataFrame:
    """Exponentially weighted factor covariance at every position: (pos, i, j, cov).

    Unbiased denominator, diagonal shrink.  ``returns``: pos, factor, value.  Pairs are
    those of the model's factors and each pair's series is calendar sized.
    """
    days = returns.select("pos").distinct()
    names = returns.agg(F.array_sort(F.collect_set("factor")).alias("_all"))
    grid = days.join(F.broadcast(names)).select("pos", F.explode("_all").alias("factor"))
    full = grid.join(returns, ["pos", "factor"], "left").select("pos", "factor", F.coalesce("value", F.lit(0.0)).alias("v"))
    a, b = full.select("pos", F.col("factor").alias("i"), F.col("v").alias("vi")), full.select("pos", F.col("factor").alias("j"), F.col("v").alias("vj"))
    p = a.join(b, "pos").where(F.col("i") <= F.col("j"))
    q = F.pow(F.lit(2.0), F.col("pos") / F.lit(float(half_life)))
    w = W.partitionBy("i", "j").orderBy("pos").rangeBetween(-(window - 1), 0)
    p = p.withColumn("_q", q)
    c = F.col
    p = p.withColumns({"_s": F.sum("_q").over(w), "_s2": F.sum(c("_q") * c("_q")).over(w), "_a": F.sum(c("_q") * c("vi")).over(w),
                       "_b": F.sum(c("_q") * c("vj")).over(w), "_ab": F.sum(c("_q") * c("vi") * c("vj")).over(w), "days": F.count("*").over(w)})
    den = 1 - div("_s2", c("_s") * c("_s"))
    cov = div(div("_ab", "_s") - div("_a", "_s") * div("_b", "_s"), den)
    p = p.where(c("days") >= least).select("pos", "i", "j", "days", cov.alias("cov"))
    return p.withColumn("cov", F.when(c("i") == c("j"), c("cov") + 1e-12).otherwise((1 - shrink) * c("cov")))


def specific_variance(res: DataFrame, half_life: float, window: int, least: int, group: str, min_group: int, at=None) -> DataFrame:
    """Weighted residual variance per name, half shrunk to the industry (or pooled) median.

    ``res``: dense code, pos, residual, in_universe and the group label.  Trailing sums
    are differences of running sums: weights grow with time, so the older prefix is the
    small part and nothing cancels.
    """
    from tidepanel.operators.ordering import quantiles
    from tidepanel.operators.staging import materialize

    x = F.col("residual")
    q = F.when(x.isNotNull(), F.pow(F.lit(2.0), F.col("pos") / F.lit(float(half_life))))
    d = res.withColumns({"_q": q, "_q1": q * x, "_q2": q * x * x, "_qq": q * q, "_one": x.isNotNull().cast("double")})
    cols = ["_q", "_q1", "_q2", "_qq", "_one"]
    d = d.withColumns({f"_c{c}": F.sum(F.coalesce(c, F.lit(0.0))).over(W.partitionBy("code").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) for c in cols})
    d = d.withColumns({f"_w{c}": F.col(f"_c{c}") - F.coalesce(F.lag(f"_c{c}", window).over(W.partitionBy("code").orderBy("pos")), F.lit(0.0)) for c in cols})
    if at is not None:
        d = d.where(at)
    mean = div("_w_q1", "_w_q")
    second = div("_w_q2", "_w_q") - mean * mean
    corr = 1 - div("_w_qq", F.col("_w_q") * F.col("_w_q"))
    raw = F.when((F.col("_w_one") >= least) & (corr > 0), second / F.when(corr > 0, corr))
    d = materialize(d.select("code", "pos", group, "in_universe", raw.alias("raw")))
    use = d.where(F.col("in_universe") & F.col("raw").isNotNull())
    pool = quantiles(use, ["pos"], {"_pool": ("raw", 0.5)}, write=False)
    grp = quantiles(use, ["pos", group], {"_g": ("raw", 0.5)}, write=False)
    n = use.groupBy("pos", group).agg(F.count("*").alias("_n"))
    d = d.join(F.broadcast(pool), "pos").join(grp.join(n, ["pos", group]), ["pos", group], "left")
    prior = F.when(F.col("_n") >= min_group, F.col("_g")).otherwise(F.col("_pool"))
    return d.select("code", "pos", group, F.greatest(F.when(F.col("raw").isNull(), prior).otherwise(0.5 * F.col("raw") + 0.5 * prior), F.lit(1e-8)).alias("d"),
                    F.col("raw").isNull().cast("int").alias("is_prior"))


def tracking_error(active: DataFrame, exposures: DataFrame, cov: DataFrame, spec: DataFrame, ann: int) -> tuple[DataFrame, DataFrame]:
    """Ex-ante tracking error per position, and its split by factor.

    ``active``: pos, code, a; ``exposures``: pos, code, factor, exposure.  Names are
    summed to factors first, so the covariance join is factor sized.
    """
    xf = active.join(exposures, ["pos", "code"]).groupBy("pos", "factor").agg(F.sum(F.col("a") * F.col("exposure")).alias("x"))
    both = cov.unionByName(cov.where("i <> j").select("pos", F.col("j").alias("i"), F.col("i").alias("j"), "days", "cov"))
    fx = both.join(xf.select("pos", F.col("factor").alias("j"), F.col("x").alias("xj")), ["pos", "j"]).groupBy("pos", "i").agg(F.sum(F.col("cov") * F.col("xj")).alias("fx"))
    euler = xf.join(fx.withColumnRenamed("i", "factor"), ["pos", "factor"]).withColumn("contribution", F.col("x") * F.col("fx"))
    fv = euler.groupBy("pos").agg(F.sum("contribution").alias("factor_variance"))
    sv = active.join(spec, ["pos", "code"]).groupBy("pos").agg(F.sum(F.col("d") * F.col("a") * F.col("a")).alias("specific_variance"))
    d = fv.join(F.broadcast(sv), "pos")
    total = F.greatest(F.col("factor_variance") + F.col("specific_variance"), F.lit(0.0))
    return d.withColumn("te", F.sqrt(F.lit(float(ann)) * total)), euler


def exposure_report(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    """Portfolio, benchmark and active exposure per (date, factor); missing weight where the exposure is unknown.

    ``weights``: date, code, w, b.
    """
    j = weights.join(exposures, ["date", "code"])
    x = F.coalesce("exposure", F.lit(0.0))
    miss = F.col("exposure").isNull()
    return j.groupBy("date", "factor").agg(
        F.sum(F.col("w") * x).alias("portfolio"), F.sum(F.col("b") * x).alias("benchmark"), F.sum((F.col("w") - F.col("b")) * x).alias("active"),
        F.sum(F.when(miss, F.col("w")).otherwise(0.0)).alias("missing_portfolio"), F.sum(F.when(miss, F.col("b")).otherwise(0.0)).alias("missing_benchmark"))


def pit_quality(df: DataFrame, checks: dict[str, F.Column], limit: float = 0.05) -> DataFrame:
    """Per date: weight failing each check in portfolio and benchmark; provisional above the limit."""
    aggs = []
    for n, bad in checks.items():
        aggs += [F.sum(F.when(bad, F.col("w")).otherwise(0.0)).alias(f"{n}_w"), F.sum(F.when(bad, F.col("b")).otherwise(0.0)).alias(f"{n}_b")]
    d = df.groupBy("date").agg(*aggs)
    worst = F.greatest(*[F.col(f"{n}_{s}") for n in checks for s in ("w", "b")])
    return d.withColumn("quality", F.when(worst > limit, "provisional").otherwise("valid"))


def validate_bias(daily: DataFrame, periods: dict[str, tuple[int, int]], ann: int) -> DataFrame:
    """Ratio of realised next excess to ex-ante risk per named year range."""
    y = F.year("date")
    hit = F.explode(F.filter(F.array(*[F.when(y.between(a, b), F.lit(k)) for k, (a, b) in periods.items()]), lambda x: x.isNotNull()))
    d = daily.withColumn("period", hit)
    free = F.coalesce(F.col("no_execution"), F.lit(False))
    good = free & (F.col("daily_variance") > 1e-12) & (F.col("quality") == "valid") & F.col("excess_next").isNotNull()
    z = F.when(good, F.col("excess_next") / F.sqrt(F.when(F.col("daily_variance") > 0, F.col("daily_variance"))))
    g = d.groupBy("period").agg(
        F.count(F.when(good, 1)).alias("pairs"), F.count(F.when(free, 1)).alias("eligible"), F.stddev_samp(z).alias("bias"),
        (F.stddev_samp(F.when(good, F.col("excess_next"))) * F.sqrt(F.lit(float(ann)))).alias("realised_te"),
        F.sqrt(ann * F.avg(F.when(good, F.col("daily_variance")))).alias("exante_te"))
    return g.withColumn("coverage", F.coalesce(div("pairs", "eligible"), F.lit(0.0)))
