"""Order statistics against pandas, with cuts forced on small data and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import ordering as O


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = np.round(rng.normal(size=n), 2)
    x[rng.random(n) < 0.35] = 0.25  # one value holds a third of the rows
    p = pd.DataFrame({"date": rng.integers(0, 3, n), "code": np.arange(n), "x": x})
    p.loc[p["date"] == 1, "x"] = np.where(rng.random((p["date"] == 1).sum()) < 0.1, np.nan, p.loc[p["date"] == 1, "x"])
    q = p.astype(object).where(p.notna(), None)
    return p, spark.createDataFrame(q.values.tolist(), "date long, code long, x double")


def test_average_rank(frame):
    p, d = frame
    got = O.with_rank(d, ["date"], "x", "r", pct=True).toPandas().sort_values("code")
    want = p.groupby("date")["x"].rank(pct=True)
    np.testing.assert_allclose(got["r"].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_two_values_share_passes(frame):
    p, d = frame
    d = d.withColumn("y", -F.col("x") + F.col("code") / 10000)
    got = O.with_ranks(d, ["date"], {"a": "x", "b": "y"}).toPandas().sort_values("code")
    p = p.assign(y=-p["x"] + p["code"] / 10000)
    for c, v in (("a", "x"), ("b", "y")):
        np.testing.assert_allclose(got[c].to_numpy(float), p.groupby("date")[v].rank(pct=True).to_numpy(), rtol=1e-12)


def test_quantiles(frame):
    p, d = frame
    got = O.quantiles(d, ["date"], {"lo": ("x", 0.01), "mid": ("x", 0.5), "hi": ("x", 0.99)}).toPandas().set_index("date").sort_index()
    for c, q in (("lo", 0.01), ("mid", 0.5), ("hi", 0.99)):
        np.testing.assert_allclose(got[c], p.groupby("date")["x"].quantile(q), rtol=1e-12)


def test_position_breaks_ties_by_code(frame):
    p, d = frame
    got = O.position(d, ["date"], [-F.col("x"), "code"], "place", "n").toPandas().sort_values("code")
    s = p.dropna(subset=["x"]).sort_values(["date", "x", "code"], ascending=[True, False, True])
    want = (s.groupby("date").cumcount() + 1).reindex(p.index)
    np.testing.assert_array_equal(got["place"].to_numpy(float), want.to_numpy())


def test_running(frame):
    p, d = frame
    d, p = d.where("x is not null"), p.dropna(subset=["x"])
    got = O.running(d, ["date"], ["code"], {"s": ("sum", "x"), "m": ("max", "x"), "k": ("min", "x")}).toPandas().sort_values("code")
    g = p.sort_values("code").groupby("date")["x"]
    np.testing.assert_allclose(got["s"], g.cumsum(), rtol=1e-9, atol=1e-9)
    np.testing.assert_array_equal(got["m"], g.cummax())
    np.testing.assert_array_equal(got["k"], g.cummin())


def test_many_groups_and_one_group(spark):
    rng = np.random.default_rng(5)
    n = 200_000
    p = pd.DataFrame({"g": rng.integers(0, 50_000, n), "code": np.arange(n), "x": rng.integers(0, 40, n), "one": 1})
    d = spark.createDataFrame(p)
    for by in ("g", "one"):
        got = O.with_rank(d, [by], "x", "r", pct=False).select("code", "r").toPandas().sort_values("code")
        np.testing.assert_array_equal(got["r"].to_numpy(float), p.groupby(by)["x"].rank().to_numpy())
        got = O.running(d, [by], ["x", "code"], {"s": ("sum", "code")}).select("code", "s").toPandas().set_index("code")["s"]
        want = p.sort_values(["x", "code"]).groupby(by)["code"].cumsum()
        assert (got.sort_index().to_numpy() == want.sort_index().to_numpy()).all()


def test_a_tie_over_many_partitions(spark):
    """One value fills several partitions between smaller and larger ones."""
    n = 6000
    x = np.where(np.arange(n) < 500, -1.0, np.where(np.arange(n) < 5500, 0.0, np.arange(n)))
    p = pd.DataFrame({"date": 1, "code": np.arange(n), "x": x})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = O.order_stats(spark.createDataFrame(p), ["date"], {"": "x"}).toPandas().sort_values("code")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    r = p["x"].rank(method="min") - 1
    np.testing.assert_array_equal(got["less"], r)
    np.testing.assert_array_equal(got["ties"], p.groupby("x")["x"].transform("size"))


def test_tasks_follow_the_rows(frame, monkeypatch):
    """A session's fixed number of partitions would let one task's share grow with the input."""
    p, d = frame
    monkeypatch.setattr(O, "TASK_ROWS", 500)
    got = O.with_ranks(d.withColumn("y", -F.col("x")), ["date"], {"a": "x", "b": "y"})
    assert got.rdd.getNumPartitions() >= 2 * 3000 / 500
    got = got.toPandas().sort_values("code")
    np.testing.assert_allclose(got["a"].to_numpy(float), p.groupby("date")["x"].rank(pct=True).to_numpy(), rtol=1e-12)
