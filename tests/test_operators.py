"""Grid, rolling, as-of and group operators on planted facts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import columns as C
from tidepanel.functions.registry import OPERATORS
from tidepanel.operators import cross as X, joins as J, rolling as R
from tidepanel.operators.grid import calendar, densify, next_trading_day, with_pos
from tidepanel.plans import panel as P, pit


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(5)
    w = pd.DataFrame(rng.normal(10, 2, (40, 6)), index=pd.date_range("2020-01-01", periods=40), columns=range(6))
    w[rng.random(w.shape) < 0.12] = np.nan
    w.iloc[0], w.iloc[-1] = 1.0, 2.0
    return w


@pytest.fixture(scope="module")
def grid(spark, wide):
    long = wide.stack().reset_index()
    long.columns = ["date", "code", "x"]
    long["date"] = long["date"].dt.date
    d = spark.createDataFrame(long.sample(frac=1, random_state=1), "date date, code long, x double")
    cal = calendar(d)
    return densify(with_pos(d, cal), cal, ["x"])


def wide_of(d, col):
    p = d.select("date", "code", col).toPandas()
    return p.pivot(index="date", columns="code", values=col).to_numpy(float)


def test_dense_grid(grid, wide):
    assert grid.count() == wide.size
    np.testing.assert_array_equal(wide_of(grid, "x"), wide.to_numpy())


@pytest.mark.parametrize("name", ["mean", "std", "sum", "max", "min"])
def test_rolling(grid, wide, name):
    got = wide_of(grid.withColumn("y", getattr(R, f"ts_{name}")("x", 5)), "y")
    np.testing.assert_allclose(got, getattr(wide.rolling(5, min_periods=5), name)().to_numpy(), rtol=1e-9)


def test_rank_decay_skew_delay(grid, wide):
    d = grid.withColumns({"a": R.ts_rank("x", 4), "b": R.ts_decay_linear("x", 4), "c": R.ts_skew("x", 12, 6), "d": R.ts_delay("x", 3)})
    np.testing.assert_allclose(wide_of(d, "a"), wide.rolling(4, min_periods=4).rank(pct=True).to_numpy(), rtol=1e-9)
    want = sum(wide.shift(k) * (4 - k) for k in range(4)) / 10
    np.testing.assert_allclose(wide_of(d, "b"), want.to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(wide_of(d, "c"), wide.rolling(12, min_periods=6).skew().to_numpy(), rtol=1e-6)
    np.testing.assert_allclose(wide_of(d, "d"), wide.shift(3).to_numpy())


def test_truncation_does_not_change_history(grid):
    full = grid.withColumn("y", R.ts_zscore("x", 5))
    cut = grid.where("pos < 25").withColumn("y", R.ts_zscore("x", 5))
    a, b = wide_of(full.where("pos < 25"), "y"), wide_of(cut, "y")
    np.testing.assert_array_equal(a, b)


def test_neutralize_is_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 60
    p = pd.DataFrame({"date": [dt.date(2020, 1, 1)] * n, "code": range(n), "grp": rng.integers(0, 4, n), "x": rng.normal(size=n), "z": rng.normal(size=n)})
    got = X.cs_neutralize(spark.createDataFrame(p), {"r": "x"}, "z").toPandas().sort_values("code")["r"].to_numpy()
    design = np.column_stack([pd.get_dummies(p["grp"]).to_numpy(float), p["z"]])
    beta, *_ = np.linalg.lstsq(design, p["x"].to_numpy(), rcond=None)
    np.testing.assert_allclose(got, p["x"].to_numpy() - design @ beta, atol=1e-10)


def test_null_rules(spark):
    d = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (-4.0, 2.0)], "x double, y double")
    r = d.select(C.div("x", "y"), C.log_("x"), C.sqrt_("x"), C.max2("x", "y"), C.where("x", 1.0, 0.0), C.signed_power("x", 0.5)).collect()
    assert [tuple(v) for v in r] == [(None, 0.0, 1.0, 1.0, 1.0, 1.0), (None, None, None, None, None, None), (-2.0, None, None, 2.0, 0.0, -2.0)]


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "code string, date int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 30)], "code string, date int, v int")
    get = lambda **k: {(r["code"], r["date"]): r["v"] for r in J.asof_join(left, right, fields=["v"], **k).collect()}
    assert get() == {("a", 1): 10, ("a", 3): 20, ("b", 2): None}
    assert get(allow_equal=False) == {("a", 1): None, ("a", 3): 20, ("b", 2): None}
    assert get(unique_left=False) == get()


def test_next_day_is_strictly_after(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 8)]
    cal = calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    q = spark.createDataFrame([(dt.date(2023, 12, 1),), (dt.date(2024, 1, 2),), (dt.date(2024, 1, 5),), (dt.date(2024, 1, 8),)], "d date")
    got = {r["d"].day: r["eff_date"].day for r in next_trading_day(q, cal, "d").collect()}
    assert got == {1: 2, 2: 3, 5: 8}
    same = {r["d"].day: r["eff_date"].day for r in next_trading_day(q, cal, "d", inclusive=True).collect()}
    assert same == {1: 2, 2: 2, 5: 8, 8: 8}


def test_late_old_label_does_not_undo_a_newer_one(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i),) for i in range(20)]
    cal = calendar(spark.createDataFrame(days, "date date"))
    h = spark.createDataFrame([("a", dt.date(2024, 1, 2), dt.date(2024, 1, 2), "new", "x"), ("a", dt.date(2023, 6, 1), dt.date(2024, 1, 9), "old", "y")],
                              "code string, effective_date date, updated_at date, l1 string, l2 string")
    panel = spark.createDataFrame([("a", d[0]) for d in days], "code string, date date")
    got = {r["date"].day: r["l1"] for r in pit.attach_industry(panel, h, cal).collect()}
    assert got[2] == "unknown" and got[3] == "new" and got[15] == "new"


def test_limit_ratio(spark):
    d = spark.createDataFrame([("sh.688001", False), ("sz.300001", False), ("bj.830001", True), ("sh.600001", True), ("sz.000001", False)], "c string, st boolean")
    r = d.select(P.limit_ratio(F.col("c"), F.lit("2021-01-01").cast("date"), F.col("st"))).collect()
    assert [x[0] for x in r] == [0.2, 0.2, 0.3, 0.05, 0.1]


def test_operator_registry_checks_arguments():
    with pytest.raises(ValueError):
        OPERATORS["ts_mean"]("x", 7)
    with pytest.raises(ValueError):
        OPERATORS["ts_mean"]("x")
    with pytest.raises(ValueError):
        OPERATORS["ts_corr"]("x", 3.0, 5)
    assert len(OPERATORS) >= 37
