"""Sufficient-statistic models against dense numpy fits; invariants of the evaluation."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.functions import normal
from tidepanel.plans import book as B, inference as I, metrics as M, models as MO, risk as K


def panel(n_dates=30, n_codes=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(n_dates):
        x = rng.normal(size=(n_codes, 2))
        y = x @ [0.5, -0.2] + rng.normal(size=n_codes)
        for c in range(n_codes):
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(t), t, c, *map(float, x[c]), float(y[c])))
    return pd.DataFrame(rows, columns=["date", "pos", "code", "x1", "x2", "y"])


def test_ridge_equals_dense_solution(spark):
    p = panel()
    d = spark.createDataFrame(p)
    folds = spark.createDataFrame([(20, 30, 5, 18)], "start int, stop int, lo int, hi int")
    w = MO.solve_ridge(MO.fold_stats(MO.ridge_stats(d, ["x1", "x2"], "y"), folds, ["start", "stop"]), 2, F.lit(10.0)).first()
    q = p[(p["pos"] >= 5) & (p["pos"] < 18)]
    x, y = q[["x1", "x2"]].to_numpy(), q["y"].to_numpy()
    xc = x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ (y - y.mean()))
    np.testing.assert_allclose(w["w"], want, rtol=1e-9)
    np.testing.assert_allclose(w["b"], y.mean() - x.mean(axis=0) @ want, rtol=1e-9)


def test_shuffled_labels_have_no_ic(spark):
    p = panel(60, 60)
    rng = np.random.default_rng(1)
    p["noise"] = rng.permutation(p["y"].to_numpy())
    d = spark.createDataFrame(p)
    real = M.rank_ic(d, "x1", "y", ("date",)).agg(F.avg("ic")).first()[0]
    null = M.rank_ic(d, "x1", "noise", ("date",)).agg(F.avg("ic")).first()[0]
    assert real > 0.3 and abs(null) < 0.06


def test_ic_summary_shape_moments(spark):
    x = pd.Series(np.random.default_rng(4).gamma(2, size=50))
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "date int, ic double")
    r = M.summarize_ic(d, ()).first()
    np.testing.assert_allclose([r["skew"], r["kurtosis"]], [x.skew(), x.kurt() + 3], rtol=1e-9)


def test_factor_returns_match_dense_constrained_fit(spark):
    rng = np.random.default_rng(7)
    n = 150
    p = pd.DataFrame({"date": dt.date(2020, 1, 1), "code": range(n), "ind": [f"g{i % 4}" for i in range(n)], "circ_mv": rng.lognormal(3, 1, n), "in_universe": True,
                      "s1": rng.normal(size=n), "s2": rng.normal(size=n), "ret": rng.normal(0, 0.02, n)})
    f = K.factor_returns(spark.createDataFrame(p), ["s1", "s2"], "ind", "ret", 1e-4, 100).toPandas().set_index("factor")["value"]
    d = pd.get_dummies(p["ind"]).to_numpy(float)
    b = np.array([p.loc[p["ind"] == g, "circ_mv"].sum() for g in sorted(p["ind"].unique())]) / p["circ_mv"].sum()
    ref = int(b.argmax())
    keep = [j for j in range(4) if j != ref]
    a = np.column_stack([np.ones(n), *[d[:, j] - d[:, ref] * b[j] / b[ref] for j in keep], p["s1"], p["s2"]])
    om = np.sqrt(p["circ_mv"].to_numpy())
    om /= om.sum()
    lhs = a.T @ (om[:, None] * a)
    lhs[-2:, -2:] += np.eye(2) * 1e-4
    c = np.linalg.solve(lhs, a.T @ (om * p["ret"].to_numpy()))
    np.testing.assert_allclose(f["market"], c[0], rtol=1e-8)
    np.testing.assert_allclose([f["s1"], f["s2"]], c[-2:], rtol=1e-8)
    ind = np.array([f[f"industry:g{j}"] for j in range(4)])
    assert abs(ind @ b) < 1e-12


def test_hac_keeps_gaps(spark):
    x = [0.1, -0.2, 0.3, 0.25, -0.1, 0.4]
    days = [0, 1, 2, 5, 6, 9]
    d = spark.createDataFrame([("s", t, v) for t, v in zip(days, x)], "series string, ordinal int, value double")
    r = I.hac_mean(d, ["series"], 3).first()
    m = np.mean(x)
    e = dict(zip(days, np.array(x) - m))
    lag = max(2, int(np.ceil(4 * (len(x) / 100) ** (2 / 9))))
    lr = sum(v * v for v in e.values()) / len(x)
    for k in range(1, lag + 1):
        lr += 2 * (1 - k / (lag + 1)) * sum(v * e.get(t - k, 0.0) for t, v in e.items()) / len(x)
    assert r["lag"] == lag
    np.testing.assert_allclose(r["se"], np.sqrt(lr / len(x)), rtol=1e-12)


def test_normal_functions(spark):
    r = spark.range(1).select(normal.cdf(F.lit(1.0)), normal.sf(F.lit(1.0)), normal.ppf(F.lit(0.975)), normal.ppf(F.lit(1.5))).first()
    np.testing.assert_allclose(r[:3], [0.8413447460685429, 0.15865525393145707, 1.959963984540054], rtol=1e-9)
    assert r[3] is None


def test_average_cost_matches_a_loop(spark):
    rng = np.random.default_rng(11)
    rows, held, basis, want = [], 0.0, 0.0, {}
    for i in range(80):
        px = float(np.round(rng.uniform(5, 15), 2))
        kind = rng.choice(["buy", "sell", "set", "dividend"], p=[0.6, 0.28, 0.06, 0.06])
        q = float(rng.integers(1, 20))
        if kind == "sell":
            q = min(q, held)
            if q == 0:
                kind = "dividend"
        if kind == "buy":
            basis, held = basis + px * q, held + q
        elif kind == "sell":
            basis, held = basis * (held - q) / held, held - q
        elif kind == "set":
            held, basis = q, q * px
        rows.append((1, 7, dt.date(2020, 1, 1) + dt.timedelta(i // 3), i, str(kind), q, px, px * q))
        if held > 0:
            want[i] = basis / held
    d = spark.createDataFrame(rows, "account int, code int, date date, seq int, type string, quantity double, price double, amount double")
    got = {r["seq"]: r["cost"] for r in B.average_cost(B.replay(d)).where("held > 0").collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9)


def test_bootstrap_interval_covers_the_mean(spark):
    x = np.random.default_rng(0).normal(3, 1, 400)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, x double")
    r = B.bootstrap_mean(d, "k", "x", 400).first()
    half = 1.96 * x.std() / 20
    assert abs(r["lo"] - (x.mean() - half)) < 0.05 and abs(r["hi"] - (x.mean() + half)) < 0.05


def test_total_losses_stay_in_the_curve(spark):
    from tidepanel.plans import metrics as M

    rows = [(k, dt.date(2020, 1, i + 1), x) for k, xs in (("lost", (0.1, -1.0, 0.1)), ("below", (0.1, -1.5, 0.2)), ("fine", (0.1, -0.5, 0.2))) for i, x in enumerate(xs)]
    got = {r.k: r for r in M.return_stats(spark.createDataFrame(rows, "k string, date date, ret double"), 3, ["k"]).collect()}
    assert got["lost"].annual_return == -1 and got["lost"].max_drawdown == -1
    assert got["below"].annual_return is None and abs(got["below"].max_drawdown - (-0.66 / 1.1 - 1)) < 1e-12
    assert abs(got["fine"].annual_return - (1.1 * 0.5 * 1.2 - 1)) < 1e-12 and abs(got["fine"].max_drawdown + 0.5) < 1e-12


def test_average_cost_of_a_long_stretch(spark):
    from tidepanel.plans import book as B

    rows, held, cost, want = [("a", 1, dt.date(2020, 1, 1), 0, "set", 100.0, 5.0, 0.0, 100.0)], 100.0, 500.0, []
    for i in range(1200):  # half sales and purchases: the running product falls to 2^-1200
        held, cost = held / 2, cost / 2
        rows.append(("a", 1, dt.date(2020, 1, 2), 2 * i + 1, "sell", held, 5.0, 5.0 * held, held))
        bought = 10.0 + i % 3
        held, cost = held + bought, cost + bought * (4 + i % 2)
        rows.append(("a", 1, dt.date(2020, 1, 2), 2 * i + 2, "buy", bought, 4.0 + i % 2, bought * (4 + i % 2), held))
        want.append(cost / held)
    d = spark.createDataFrame(rows, "account string, code int, date date, seq int, type string, quantity double, price double, amount double, held double")
    got = [r.cost for r in B.average_cost(d).where("type = 'buy'").orderBy("seq").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_disposition_counts_positions_held_before_sale_days(spark):
    """Random books against a walk over every sale day and name."""
    rng = np.random.default_rng(4)
    day = lambda i: dt.date(2021, 1, 20) + dt.timedelta(int(i))
    states = {(a, c, d): (float(rng.integers(-1, 3)), float(rng.integers(1, 9))) for a in range(3) for c in range(4) for d in rng.choice(120, 6, replace=False)}
    sales = {(int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(0, 120))): float(rng.integers(1, 9)) + 0.5 for _ in range(60)}
    prices = {(c, int(d)): float(rng.integers(1, 9)) + 0.25 for c in range(4) for d in rng.choice(120, 30, replace=False)}
    want = {}
    for a in range(3):
        counts = [0, 0, 0, 0]
        for d in {k[2] for k in sales if k[0] == a}:
            for c in range(4):
                before = [k[2] for k in states if k[:2] == (a, c) and k[2] < d]
                held, cost = states[a, c, max(before)] if before else (0, 0)
                known = [k[1] for k in prices if k[0] == c and k[1] <= d]
                sold = sales.get((a, c, d))
                px = sold if sold is not None else prices[c, max(known)] if known else None
                if held > 0 and px is not None:
                    counts[2 * (sold is None) + (px <= cost)] += 1
        if any(counts):
            want[a] = tuple(counts)
    s = spark.createDataFrame([(a, c, day(d), h, p) for (a, c, d), (h, p) in states.items()], "account int, code int, date date, held double, cost double")
    t = spark.createDataFrame([(a, c, day(d), p) for (a, c, d), p in sales.items()], "account int, code int, date date, px double")
    x = spark.createDataFrame([(c, day(d), p) for (c, d), p in prices.items()], "code int, date date, px double")
    got = {r.account: (r.realized_gain, r.realized_loss, r.paper_gain, r.paper_loss) for r in B.disposition(s, t, x).collect()}
    assert got == want


def test_bootstrap_states_add_up(spark):
    """The interval does not depend on the split of the rows, and rows without a value do not count."""
    x = np.random.default_rng(1).normal(0, 1, 900)
    rows = [(i, float(v)) for i, v in enumerate(x)] + [(5000, None), (None, 3.0)]
    got = [tuple(B.bootstrap_mean(spark.createDataFrame(rows, "k long, x double").repartition(n), "k", "x", 300).first()) for n in (1, 7)]
    n = B.poisson_counts(np.arange(900), np.arange(300))
    m = (n * x[:, None]).sum(0) / n.sum(0)
    assert np.allclose(got, [np.quantile(m, [0.025, 0.975])] * 2)
    assert abs(n.mean() - 1) < 0.01 and abs(n.var() - 1) < 0.02 and abs(np.corrcoef(n[:, 0], n[:, 1])[0, 1]) < 0.12
