"""Cross-section operators: one date (or one date and group) at a time.

Moments come from a partial aggregate joined back; order statistics from
``ordering``.  No date is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import col, div
from tidepanel.operators import ordering as O
from tidepanel.operators.staging import materialize


def with_stats(df: DataFrame, by, stats: dict[str, Column]) -> DataFrame:
    """Join group aggregates back.  Per-date tables have one row per calendar day and are broadcast;
    finer ones are left to the optimiser's size check."""
    by = [by] if isinstance(by, str) else list(by)
    agg = df.groupBy(*by).agg(*[c.alias(k) for k, c in stats.items()])
    return df.join(F.broadcast(agg) if by in (["date"], ["pos"]) else agg, by, "left")


def cs_rank(df, x, out, by=("date",), **kw) -> DataFrame:
    return O.with_rank(df, list(by), x, out, True, **kw)


def cs_zscore(df, outs: dict[str, str], by=("date",), pop=False) -> DataFrame:
    """(x - mean) / std for each output name -> column, one aggregate for all."""
    sd = F.stddev_pop if pop else F.stddev_samp
    stats = {}
    for o, x in outs.items():
        stats |= {f"_m_{o}": F.avg(col(x)), f"_s_{o}": sd(col(x))}
    d = with_stats(df, list(by), stats)
    return d.withColumns({o: div(col(x) - F.col(f"_m_{o}"), F.col(f"_s_{o}")) for o, x in outs.items()}).drop(*stats)


def cs_demean(df, outs: dict[str, str], by=("date",)) -> DataFrame:
    stats = {f"_m_{o}": F.avg(col(x)) for o, x in outs.items()}
    d = with_stats(df, list(by), stats)
    return d.withColumns({o: col(x) - F.col(f"_m_{o}") for o, x in outs.items()}).drop(*stats)


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def cs_winsorize(df, outs: dict[str, str], lo=0.01, hi=0.99, by=("date",), keys=("code",), fit: Column | None = None,
                 write=True) -> DataFrame:
    """Clip to linear quantiles, fitted on the rows where ``fit`` holds."""
    if write:
        df = materialize(df)
    xs = {o: F.col(x) if fit is None else F.when(fit, F.col(x)) for o, x in outs.items()}
    base = df.select(*by, *keys, *[c.alias(f"_x_{o}") for o, c in xs.items()])
    probs = {}
    for o in outs:
        probs |= {f"_lo_{o}": (f"_x_{o}", lo), f"_hi_{o}": (f"_x_{o}", hi)}
    q = O.quantiles(base, list(by), probs, keys, write=False)
    d = df.join(F.broadcast(q) if list(by) == ["date"] else q, list(by), "left")
    return d.withColumns({o: clip(col(x), F.col(f"_lo_{o}"), F.col(f"_hi_{o}")) for o, x in outs.items()}).drop(*probs)


def group_rank(df, x, out, group="grp", **kw) -> DataFrame:
    return O.with_rank(df, ["date", group], x, out, True, **kw)


def group_demean(df, x, out, group="grp") -> DataFrame:
    return cs_demean(df, {out: x}, ("date", group))


def cs_neutralize(df, outs: dict[str, str], size, group="grp", margin=5, valid: Column | None = None,
                  min_names: int | None = None, by=("date",)) -> DataFrame:
    """Residual of the per-date regression of x on group dummies and one regressor.

    Partialling the dummies out leaves beta = sum(s~ x~) / sum(s~^2) with both
    sides demeaned in their group, so two aggregates give the residual.  Dates with
    fewer names than the distinct groups of all codes plus ``margin`` (or fewer than
    ``min_names``) stay missing.
    """
    by, sv = list(by), col(size)
    d, cells, sums = df, {}, {}
    for o, x in outs.items():
        ok = col(x).isNotNull() & sv.isNotNull()
        if valid is not None:
            ok = ok & valid
        d = d.withColumns({f"_x_{o}": F.when(ok, col(x)), f"_z_{o}": F.when(ok, sv)})
        cells |= {f"_gx_{o}": F.avg(f"_x_{o}"), f"_gz_{o}": F.avg(f"_z_{o}")}
        xt, zt = F.col(f"_x_{o}"), F.col(f"_z_{o}")
        sums |= {f"_sxz_{o}": F.sum(xt * zt), f"_szz_{o}": F.sum(zt * zt), f"_cnt_{o}": F.count(xt)}
    d = with_stats(d, [*by, group], cells)
    d = d.withColumns({f"_{k}_{o}": F.col(f"_{k}_{o}") - F.col(f"_g{k}_{o}") for o in outs for k in "xz"})
    d = with_stats(d, by, sums)
    need = F.lit(min_names)
    if min_names is None:
        n = df.select(group).distinct().agg(F.count("*").alias("_groups"))
        d = d.join(F.broadcast(n))
        need = F.col("_groups") + margin
    for o in outs:
        beta = F.coalesce(div(f"_sxz_{o}", f"_szz_{o}"), F.lit(0.0))
        d = d.withColumn(o, F.when(F.col(f"_cnt_{o}") >= need, F.col(f"_x_{o}") - beta * F.col(f"_z_{o}")))
    return d.drop(*cells, *sums, "_groups", *[f"_{k}_{o}" for o in outs for k in "xz"])


def neutralized(x: np.ndarray, size: np.ndarray, group: np.ndarray, need: int) -> np.ndarray:
    """``cs_neutralize`` of one date whose rows have met in one task; NaN is missing, ``need`` the least number of names."""
    ok = ~(np.isnan(x) | np.isnan(size))
    out = np.full(len(x), np.nan)
    if ok.sum() < max(need, 1):
        return out
    _, at = np.unique(group[ok], return_inverse=True)
    rows = np.bincount(at)
    xt, zt = (v - (np.bincount(at, v) / rows)[at] for v in (x[ok], size[ok]))
    szz = np.einsum("i,i->", zt, zt)
    out[ok] = xt - (np.einsum("i,i->", xt, zt) / szz if szz else 0.0) * zt
    return out


def winsor_z(df, outs: dict[str, str], lo=0.01, hi=0.99, valid: Column | None = None, write=True) -> DataFrame:
    """Clip to quantiles, then population z; at least three names and a positive spread."""
    d = df.withColumns({f"_wx_{o}": col(x) if valid is None else F.when(valid, col(x)) for o, x in outs.items()})
    d = cs_winsorize(d, {f"_wc_{o}": f"_wx_{o}" for o in outs}, lo, hi, write=write)
    stats = {}
    for o in outs:
        c = f"_wc_{o}"
        stats |= {f"_m_{o}": F.avg(c), f"_s_{o}": F.stddev_pop(c), f"_k_{o}": F.count(c)}
    d = with_stats(d, "date", stats)
    for o in outs:
        m, s, k, c = (F.col(f"_{n}_{o}") for n in ("m", "s", "k", "wc"))
        d = d.withColumn(o, F.when((k >= 3) & (s > 0), (c - m) / F.nullif(s, F.lit(0.0))))
    return d.drop(*stats, *[f"_{n}_{o}" for o in outs for n in ("wx", "wc")])


def rank_z(df, outs: dict[str, str], group: str | None = None, valid: Column | None = None, write=True) -> DataFrame:
    """Percentile rank (inside ``group`` if given), then population z over the date."""
    d = df.withColumns({f"_rx_{o}": col(x) if valid is None else F.when(valid, col(x)) for o, x in outs.items()})
    d = O.with_ranks(d, ["date"] + ([group] if group else []), {f"_rr_{o}": f"_rx_{o}" for o in outs}, write=write)
    if group:
        sizes = df.select("code", group).distinct().groupBy(group).agg(F.count("*").alias("_gs"))
        d = d.join(sizes, group, "left").withColumns({
            f"_rr_{o}": F.when((F.col("_gs") < 2) & F.col(f"_rx_{o}").isNotNull(), F.lit(0.5)).otherwise(F.col(f"_rr_{o}"))
            for o in outs}).drop("_gs")
    d = cs_zscore(d, {o: f"_rr_{o}" for o in outs}, pop=True)
    return d.drop(*[f"_{k}_{o}" for o in outs for k in ("rx", "rr")])


def centred_ranks(df, outs: dict[str, str], valid: Column | None = None, by=("date",), keys=("code",), write=True) -> DataFrame:
    """Percentile minus one half among valid names, zero elsewhere."""
    vals = {o: col(x) if valid is None else F.when(valid, col(x)) for o, x in outs.items()}
    d = O.with_ranks(df, list(by), vals, keys=keys, write=write)
    return d.withColumns({o: F.coalesce(F.col(o) - 0.5, F.lit(0.0)) for o in outs})


def standardize_on(df, outs: dict[str, str], universe: Column, size: tuple[str, ...] = (), min_names=100,
                   min_cover=0.8) -> DataFrame:
    """Fit on the universe, transform every row: clip, median fill, population z.

    Outputs named in ``size`` keep raw values, fit on present names only and map
    missing to zero.  Adds ``{out}_available`` (0/1).
    """
    d = materialize(df.withColumn("_u", universe))
    fit = F.col("_u")
    clipped = {o: x for o, x in outs.items() if o not in size}
    base = d.select("date", "code", *[F.when(fit, F.col(x)).alias(f"_x_{o}") for o, x in outs.items()])
    probs = {}
    for o in outs:
        probs |= {f"_lo_{o}": (f"_x_{o}", 0.01), f"_hi_{o}": (f"_x_{o}", 0.99), f"_med_{o}": (f"_x_{o}", 0.5)}
    d = d.join(F.broadcast(O.quantiles(base, ["date"], probs, write=False)), "date", "left")
    stats = {"_n": F.count(F.when(fit, 1))}
    for o, x in outs.items():
        c = clip(F.col(x), F.col(f"_lo_{o}"), F.col(f"_hi_{o}")) if o in clipped else F.col(x)
        d = d.withColumn(f"_f_{o}", F.coalesce(c, F.col(f"_med_{o}")))
        used = F.when(fit, F.col(x) if o in size else F.col(f"_f_{o}"))
        stats |= {f"_m_{o}": F.avg(used), f"_s_{o}": F.stddev_pop(used), f"_g_{o}": F.count(F.when(fit, F.col(x)))}
    d = with_stats(d, "date", stats)
    for o, x in outs.items():
        m, s, g, f = (F.col(f"_{k}_{o}") for k in ("m", "s", "g", "f"))
        z = F.when(s > 0, (f - m) / F.nullif(s, F.lit(0.0))).otherwise(0.0)
        if o in size:
            z = F.when(F.col(x).isNull(), F.lit(0.0)).otherwise(z)
        ok = (g >= min_names) & (g / F.nullif("_n", F.lit(0)) >= min_cover) & (s > 0)
        d = d.withColumns({o: F.when(g > 0, z).otherwise(F.lit(0.0)),
                           f"{o}_available": F.coalesce(ok, F.lit(False)).cast("int")})
    return d.drop("_u", *stats, *probs, *[f"_f_{o}" for o in outs])
