"""Regression pieces built from grouped sufficient statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions.columns import col, div, slope
from tidepanel.operators.cross import with_stats


def residualize(df: DataFrame, y: str, regressors: list[str], out: str, group: str, valid: Column,
                min_names: int = 100) -> DataFrame:
    """Per-date residual of y on group dummies and one or two regressors; group-mean residual when thin.

    Group demeaning removes the dummies; the remaining normal equations are solved in
    closed form from one aggregate per date.
    """
    if not 1 <= len(regressors) <= 2:
        raise ValueError("one or two regressors")
    ok = valid & col(y).isNotNull()
    for x in regressors:
        ok = ok & col(x).isNotNull()
    names = [y, *regressors]
    d = df.withColumns({f"_v{i}": F.when(ok, col(c).cast("double")) for i, c in enumerate(names)})
    g = d.where(F.col("_v0").isNotNull()).groupBy("date", group).agg(
        *[F.avg(f"_v{i}").alias(f"_g{i}") for i in range(len(names))])
    d = d.join(g, ["date", group], "left").withColumns(
        {f"_v{i}": F.col(f"_v{i}") - F.col(f"_g{i}") for i in range(len(names))})
    p = lambda i, j: F.sum(F.col(f"_v{i}") * F.col(f"_v{j}"))
    stats = {"_k": F.count("_v0"), "_a": p(1, 1), "_ay": p(0, 1)}
    if len(regressors) == 2:
        stats |= {"_b": p(2, 2), "_ab": p(1, 2), "_by": p(0, 2)}
    d = with_stats(d, "date", stats)
    v = F.col
    if len(regressors) == 1:
        fit = div(v("_ay"), v("_a")) * v("_v1")
    else:
        det = v("_a") * v("_b") - v("_ab") * v("_ab")
        fit = (div(v("_ay") * v("_b") - v("_by") * v("_ab"), det) * v("_v1")
               + div(v("_by") * v("_a") - v("_ay") * v("_ab"), det) * v("_v2"))
    d = d.withColumn(out, F.when(v("_k") >= min_names, v("_v0") - fit).when(v("_k") >= 3, v("_v0")))
    return d.drop(*[f"_v{i}" for i in range(len(names))], *[f"_g{i}" for i in range(len(names))], *stats)


def ridge_stats(df: DataFrame, xs: list[str], y: str, by=("pos",)) -> DataFrame:
    """Per-day sums a ridge needs: n, sums, cross sums.  One aggregate, all map-side combined."""
    c = F.col
    aggs = [F.count("*").cast("double").alias("n"), F.sum(y).alias("sy")]
    aggs += [F.sum(x).alias(f"s_{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(c(x) * c(y)).alias(f"t_{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(c(a) * c(b)).alias(f"q_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if j >= i]
    return df.groupBy(*by).agg(*aggs)


def fold_stats(stats: DataFrame, folds: DataFrame, key: list[str]) -> DataFrame:
    """Sum the daily statistics over each fold's [lo, hi); both sides are calendar sized."""
    sums = [c for c in stats.columns if c not in ("pos", "date")]
    j = stats.join(F.broadcast(folds), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    rest = [c for c in folds.columns if c not in key]
    return j.groupBy(*key, *rest).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("train_days"))


def solve_ridge(fs: DataFrame, k: int, penalty: Column, skip: int = 0) -> DataFrame:
    """Closed-form ridge with a free intercept on the first ``k`` regressors: adds ``w`` and ``b``.

    One small solve per fold, vectorised over the folds of a batch.
    """
    tri = [(i, j) for i in range(k) for j in range(i, k)]

    @F.pandas_udf("struct<w:array<double>,b:double>")
    def solve(n: pd.Series, sy: pd.Series, lam: pd.Series, s: pd.Series, t: pd.Series, q: pd.Series) -> pd.DataFrame:
        ws, bs = [], []
        for n_, sy_, l_, s_, t_, q_ in zip(n, sy, lam, s, t, q, strict=True):
            m = np.zeros((k, k))
            for (i, j), v in zip(tri, q_, strict=True):
                m[i, j] = m[j, i] = v
            mx, my = np.asarray(s_) / n_, sy_ / n_
            w = np.linalg.solve(m - n_ * np.outer(mx, mx) + l_ * np.eye(k), np.asarray(t_) - n_ * mx * my)
            ws.append(w.tolist())
            bs.append(float(my - mx @ w))
        return pd.DataFrame({"w": ws, "b": bs})

    arr = lambda names: F.array(*names)
    sol = solve("n", "sy", penalty.cast("double"), arr([f"s_{i}" for i in range(k)]), arr([f"t_{i}" for i in range(k)]), arr([f"q_{i}_{j}" for i, j in tri]))
    return fs.withColumn("_sol", sol).withColumns({"w": F.col("_sol.w"), "b": F.col("_sol.b")}).drop("_sol")


def apply_weights(df: DataFrame, weights: DataFrame, xs: list[str], out: str) -> DataFrame:
    """Score rows with the fold covering their position: weights hold start, stop, w, b (a few per calendar)."""
    days = weights.select(F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"), *[c for c in weights.columns if c not in ("lo", "hi", "pos")])
    d = df.join(F.broadcast(days.select("pos", "w", "b", *[c for c in days.columns if c in ("fold_id", "alpha", "year")])), "pos")
    s = F.col("b")
    for i, x in enumerate(xs):
        s = s + F.col("w")[i] * F.col(x)
    return d.withColumn(out, s).drop("w", "b")


def retrain_folds(cal: DataFrame, every: str, warmup_months: int, train_months: int, gap: int) -> DataFrame:
    """Fold per retrain point: train on [lo, hi), score [start, stop)."""
    from tidepanel.plans.panel import retrain_points

    bounds = cal.agg(F.min("date").alias("_d0"), F.max("pos").alias("_last"))
    c = cal.join(F.broadcast(bounds))
    pts = retrain_points(c.where(F.col("date") >= F.add_months("_d0", warmup_months)), every, F.lit("0001-01-01").cast("date"))
    pts = pts.select("date", F.col("pos").alias("start")).join(F.broadcast(bounds))
    pts = pts.withColumn("stop", F.coalesce(F.lead("start").over(W.orderBy("start")), F.col("_last") + 1))
    first = pts.withColumn("_from", F.add_months("date", -train_months))
    lo = first.join(F.broadcast(cal.select(F.col("date").alias("_cd"), F.col("pos").alias("_cp"))), F.col("_cd") >= F.col("_from"))
    lo = lo.groupBy("start", "stop").agg(F.min("_cp").alias("lo"))
    return lo.withColumn("hi", F.greatest(F.col("start") - gap, F.col("lo")))


def walk_forward_ridge(df: DataFrame, cal: DataFrame, xs: list[str], y: str, train: Column, every="monthly", warmup_months=24,
                       train_months=60, horizon=5, alpha=10.0, min_rows=1000, out="score") -> tuple[DataFrame, DataFrame]:
    """Scores and fold weights of a ridge refitted at each retrain point on trailing, embargoed rows."""
    stats = ridge_stats(df.where(train), xs, y)
    fs = fold_stats(stats, retrain_folds(cal, every, warmup_months, train_months, horizon + 1), ["start", "stop"])
    w = solve_ridge(fs.where(F.col("n") >= min_rows), len(xs), F.lit(alpha)).select("start", "stop", "n", "w", "b")
    return apply_weights(df, w, xs, out), w


def importance(weights: DataFrame, xs: list[str]) -> DataFrame:
    """Share of absolute weight per feature over all folds."""
    d = weights.select(F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.sum(F.abs("v")).alias("a"))
    total = d.agg(F.sum("a").alias("_t"))
    names = F.array(*[F.lit(x) for x in xs])
    return d.join(F.broadcast(total)).select(F.element_at(names, F.col("i") + 1).alias("feature"), div("a", "_t").alias("share"))


def yearly_folds(cal: DataFrame, min_years: int, gap: int) -> DataFrame:
    y = cal.groupBy(F.year("date").alias("year")).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    y = y.withColumn("_i", F.row_number().over(W.orderBy("year"))).where(F.col("_i") > min_years).drop("_i")
    return y.withColumns({"lo": F.lit(0), "hi": F.greatest(F.col("start") - gap, F.lit(0))})


def marginal_ic(df: DataFrame, cal: DataFrame, base: list[str], candidate: str, y: str, label: str, train: Column, valid: Column,
                horizon: int, alpha=10.0, min_years=2, min_days=250, min_rows=1000, min_names=20) -> DataFrame:
    """Walk-forward rank IC with and without the candidate: one row.

    The baseline block is a prefix of the full block, so one set of daily sums serves
    both models.
    """
    from tidepanel.plans.metrics import rank_ic

    xs = [*base, candidate]
    fs = fold_stats(ridge_stats(df.where(train), xs, y), yearly_folds(cal, min_years, horizon + 1), ["year", "start", "stop"])
    fs = fs.where((F.col("train_days") >= min_days) & (F.col("n") >= min_rows))
    both = solve_ridge(fs, len(xs), F.lit(alpha)).select("start", "stop", F.col("w").alias("w1"), F.col("b").alias("b1"))
    only = solve_ridge(fs, len(base), F.lit(alpha)).select("start", "stop", F.col("w").alias("w0"), F.col("b").alias("b0"))
    w = both.join(only, ["start", "stop"])
    days = w.select(F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos"), "w1", "b1", "w0", "b0")
    d = df.where(valid).join(F.broadcast(days), "pos")
    p1, p0 = F.col("b1"), F.col("b0")
    for i, x in enumerate(xs):
        p1 = p1 + F.col("w1")[i] * F.col(x)
        if i < len(base):
            p0 = p0 + F.col("w0")[i] * F.col(x)
    rows = F.explode(F.array(F.struct(F.lit("with").alias("m"), p1.alias("p")), F.struct(F.lit("without").alias("m"), p0.alias("p"))))
    # Equal ranks give equal scores up to float noise; rounding keeps those ties.
    long = d.select("date", "code", label, rows.alias("_x")).select("date", "code", label, "_x.m", F.round("_x.p", 10).alias("p"))
    ic = rank_ic(long, "p", label, ("m", "date"), min_names=min_names).groupBy("m").agg(F.avg("ic").alias("ic"))
    g = ic.agg(F.max(F.when(F.col("m") == "with", F.col("ic"))).alias("ic_with"), F.max(F.when(F.col("m") == "without", F.col("ic"))).alias("ic_without"))
    return g.withColumn("marginal_ic", F.col("ic_with") - F.col("ic_without"))


def walk_forward_select(df: DataFrame, cal: DataFrame, xs: list[str], ys: dict[int, str], train: Column, predict: Column, alphas: list[float],
                        every="monthly", warmup_months=24, train_months=36, purge=2, inner=3, min_rows=1000, min_group=10) -> DataFrame:
    """Horizon-blended scores with the penalty picked once a year on purged inner folds.

    At the first retrain point of each year every penalty is scored on ``inner``
    validation stretches of the training span; the best mean ICIR holds for the year.
    Each refit is z-scored per date and horizons are averaged.
    """
    from tidepanel.operators.cross import cs_zscore
    from tidepanel.operators.staging import materialize
    from tidepanel.plans.metrics import rank_ic

    df = materialize(df)
    folds = retrain_folds(cal, every, warmup_months, train_months, purge)
    year = cal.select(F.col("pos").alias("start"), F.year("date").alias("year"))
    folds = folds.join(F.broadcast(year), "start")
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    out = None
    for h, y in ys.items():
        stats = materialize(ridge_stats(df.where(train & F.col(y).isNotNull()), xs, y))
        sel = folds.groupBy("year").agg(F.min_by(F.struct("lo", "hi", "start"), "start").alias("_s")).select("year", "_s.*")
        seen = stats.select("pos").join(F.broadcast(sel), (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
        span = seen.groupBy("year", "lo").agg(F.min("pos").alias("t0"), (F.max("pos") + 1).alias("t1"))
        edge = lambda i: (F.col("t0") + (F.col("t1") - F.col("t0")) * i / (inner + 1)).cast("int")
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), edge(i + 1).alias("v_lo"), edge(i + 2).alias("v_hi")) for i in range(inner)]))
        inner_f = span.select("year", "lo", cells.alias("_c")).select("year", "lo", "_c.*").withColumn("hi", F.col("v_lo") - purge)
        fs = fold_stats(stats, inner_f, ["year", "fold"]).where(F.col("n") >= min_rows // 2)
        fs = fs.withColumn("alpha", F.explode(grid))
        w = solve_ridge(fs, len(xs), F.col("alpha") * F.col("n") / 1000.0).where(F.col("v_hi") > F.col("v_lo"))
        w = w.select("year", "fold", "alpha", F.explode(F.sequence(F.col("v_lo"), F.col("v_hi") - 1)).alias("pos"), "w", "b")
        v = df.where(train & F.col(y).isNotNull()).select("date", "pos", "code", y, *xs).join(F.broadcast(w), "pos")
        s = F.col("b")
        for i, x in enumerate(xs):
            s = s + F.col("w")[i] * F.col(x)
        ic = rank_ic(v.select("year", "fold", "alpha", "date", "code", y, s.alias("_p")), "_p", y, ("year", "fold", "alpha", "date"), min_names=min_group)
        ir = ic.where(F.col("ic").isNotNull()).groupBy("year", "fold", "alpha").agg(div(F.avg("ic"), F.stddev_pop("ic")).alias("ir"))
        best = ir.groupBy("year", "alpha").agg(F.avg("ir").alias("ir")).groupBy("year").agg(
            F.max_by("alpha", F.struct(F.coalesce("ir", F.lit(-1e300)), -F.col("alpha"))).alias("alpha"))
        fits = fold_stats(stats, folds, ["start", "stop", "year"]).where(F.col("n") >= min_rows).join(F.broadcast(best), "year")
        fits = solve_ridge(fits, len(xs), F.col("alpha") * F.col("n") / 1000.0).select("start", "stop", "alpha", "w", "b")
        p = apply_weights(df.where(predict).select("date", "pos", "code", *xs), fits, xs, f"raw_{h}").select("date", "pos", "code", f"raw_{h}", F.col("alpha").alias(f"alpha_{h}"))
        p = cs_zscore(materialize(p), {f"z_{h}": f"raw_{h}"})
        out = p if out is None else out.join(p, ["date", "pos", "code"], "full")
    zs = [F.coalesce(f"z_{h}", F.lit(0.0)) for h in ys]
    have = F.coalesce(*[F.col(f"z_{h}") for h in ys]).isNotNull()
    total = zs[0]
    for z in zs[1:]:
        total = total + z
    return out.withColumn("score", F.when(have, total / len(ys)))


def fit_asof(df: DataFrame, xs: list[str], expected: list[str], y: str, label_end: str, asof: int, train_from: int, purge: int, alpha: float, min_rows: int) -> DataFrame:
    """Frozen refit for one day on mature labels only; the feature order must be the locked one."""
    if xs != expected or not xs:
        raise ValueError("feature columns differ from the locked order")
    rows = df.where((F.col("pos") >= train_from) & (F.col("pos") < asof - purge) & (F.col(label_end) <= asof) & F.col(y).isNotNull())
    fs = ridge_stats(rows.withColumn("fit", F.lit(asof)), xs, y, ("fit",))
    fs = fs.where(F.when(F.col("n") >= min_rows, F.lit(True)).otherwise(F.raise_error(F.lit("too few mature training rows")).cast("boolean")))
    return solve_ridge(fs, len(xs), F.col("n") * alpha / 1000.0).select("fit", "n", "w", "b")


def sample_table(df: DataFrame, features: dict[str, str], label: str, train: Column, predict: Column, stride: int, min_coverage: float,
                 indicator_share: float = 0.01) -> DataFrame:
    """Rows of the training and prediction pools with rank-z features, missing flags and the winsorised label.

    Features below the coverage limit are dropped; the coverage table has one row.
    """
    from tidepanel.operators.cross import rank_z, winsor_z
    from tidepanel.operators.staging import materialize

    pool = F.coalesce(train | predict, F.lit(False))
    d = materialize(df.withColumns({"_pool": pool, "_train": F.coalesce(train, F.lit(False)), "_pred": F.coalesce(predict, F.lit(False))}))
    cov = d.where("_pool").agg(*[(F.count(c) / F.count("*")).alias(n) for n, c in features.items()]).first()
    keep = {n: c for n, c in features.items() if cov[n] >= min_coverage}
    d = rank_z(d, {f"z_{n}": c for n, c in keep.items()}, valid=F.col("_pool"), write=False)
    d = winsor_z(d, {"y": label}, valid=F.col("_train"))
    cols = []
    for n in keep:
        if 1 - cov[n] > indicator_share:
            cols.append(F.col(f"z_{n}").isNull().cast("int").alias(f"missing_{n}"))
        cols.append(F.coalesce(f"z_{n}", F.lit(0.0)).alias(n))
    d = d.withColumn("_tr", F.col("_train") & (F.col("pos") % stride == 0)).where(F.col("_tr") | F.col("_pred"))
    return d.select("date", "code", "pos", *cols, F.when(F.col("_tr"), F.col("y")).alias("y"), F.col("_pred").cast("int").alias("predict"))


def alpha_scale(df: DataFrame, z: str, y: str, min_names: int, window: int, least: int, fallback: float, cal: DataFrame) -> DataFrame:
    """Trailing mean of the per-date slope of returns on the score, floored at zero; fallback while too few days.

    The slope table has one row per date, so its window is calendar sized.
    """
    ok = df.where(F.col(z).isNotNull() & F.col(y).isNotNull())
    s = ok.groupBy("pos").agg(F.when(F.count("*") >= min_names, slope(y, z)).alias("slope"))
    w = W.orderBy("pos").rowsBetween(-(window - 1), 0)
    d = cal.join(F.broadcast(s), "pos", "left")
    d = d.withColumns({"valid_days": F.count("slope").over(w), "_m": F.avg("slope").over(w)})
    return d.select("date", "pos", "valid_days", F.when(F.col("valid_days") >= least, F.greatest(F.col("_m"), F.lit(0.0))).otherwise(fallback).alias("alpha_scale"))
