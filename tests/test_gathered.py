"""Correlations of gathered groups against brute force and against the ranged way; what the library's queries write."""

import os
import sys

import duckdb
import numpy as np
import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools")]

import __spark_entry__ as E  # noqa: E402
from compare import TABLES, compare  # noqa: E402
from test_masked import COLUMNS, brute, frame, table  # noqa: E402
from tidepanel.operators import gathered, masked  # noqa: E402
from tidepanel.operators.cross import neutralized  # noqa: E402
from tidepanel.sources import adapters  # noqa: E402

DATA = "/root/testdata/sf0.001"
PAIRS = [(x, y) for i, x in enumerate(COLUMNS) for y in COLUMNS[: i + 1]]


def series(d):
    got = {}
    for r in d.collect():
        got.setdefault((r.a, r.b), {})[r.g] = (None if r.ic is None else round(r.ic, 9), r.names)
    return got


def wanted(d, pairs, least):
    out = {}
    for x, y in pairs:
        if x != y:
            w = brute(d, x, y, least)
        else:
            w = {g: (1.0 if len(t) >= least and t.nunique() > 1 else None, len(t)) for g, t in ((g, t[x].dropna()) for g, t in d.groupby("g")) if len(t)}
        if w:
            out[x, y] = w
    return out


@pytest.mark.parametrize("room", [8, 3, 2, 1])
def test_all_pairs_match_brute_force(spark, monkeypatch, room):
    """All columns in one task, in sets of three and two columns, and by ranges where not even two fit."""
    d = table(1)
    monkeypatch.setattr(gathered, "TASK_VALUES", 600 * room)
    assert gathered.fits(600) == (room > 1)
    assert series(gathered.correlations(frame(spark, d), PAIRS, 20, 600, "g")) == wanted(d, PAIRS, 20)


def test_sets_cover_every_pair_once():
    names = [f"c{i}" for i in range(18)]
    pairs = [(a, b) for a in names for b in names if a < b]
    for room in (2, 3, 6, 11, 18, 40):
        sets = gathered.column_sets(pairs, lambda c: (c,), room)
        assert sorted(p for ps, _ in sets for p in ps) == list(range(len(pairs)))
        assert all(len(cs) <= room and {c for p in ps for c in pairs[p]} == set(cs) for ps, cs in sets)
    star = gathered.column_sets([(n, "y") for n in names], lambda c: (c,), 7)
    assert len(star) == 3 and all(len(cs) <= 7 for _, cs in star)


@pytest.mark.parametrize("room", [8, 3])
def test_derived_columns_meet_what_they_read(spark, monkeypatch, room):
    """A pair's derived column is computed from a whole group's columns, in whatever set the pair is."""
    d = table(2)
    monkeypatch.setattr(gathered, "TASK_VALUES", 600 * room)
    derive = lambda v, wanted: {w: v[w[2:]] - v["flat"] * np.nanmean(v[w[2:]]) for w in wanted}
    pairs = [("d_a", "b"), ("d_c", "b"), ("y", "b")]
    s = gathered.pair_sums(frame(spark, d), pairs, 600, "g", {"d_a": ("a", "flat"), "d_c": ("c", "flat")}, derive)
    got = series(masked.named(s, pairs, "g", 20))
    d["d_a"], d["d_c"] = d["a"], d["c"]  # ranks do not change when a constant is taken off
    assert got == wanted(d, pairs, 20)
    assert {r.rows for r in s.collect()} == {int(n) for n in d["g"].value_counts()}


def test_no_groups(spark):
    d = spark.createDataFrame([], "g int, a double, b double")
    assert gathered.correlations(d, [("a", "b")], 1, 0, "g").count() == 0


def checked(spark, monkeypatch, name, data=DATA):
    """Run a query, compare it with its SQL, and return the row counts of the tables it wrote on its way."""
    written = []

    def counted(write):
        def run(df):
            out = write(df)
            written.append(out.count())
            return out

        return run

    from tidepanel.catalog import evaluation

    for m in (masked, adapters, evaluation):
        monkeypatch.setattr(m, "materialize", counted(m.materialize))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    res = compare(E.queries()[name](spark, data).toPandas(), con.execute(E.oracle_sql()[name]).df())
    assert res.startswith("ok"), res
    return written


def test_turnover_writes_no_table(spark, monkeypatch):
    """The grid, the wide rows and their ranks were written before: eleven times the input."""
    assert checked(spark, monkeypatch, "turnover_proxy") == []


def test_neutralized_is_a_regression_on_groups_and_size():
    rng = np.random.default_rng(3)
    n = 200
    g, z = rng.integers(0, 4, n).astype(float), rng.normal(size=n)
    x = 2 * z + g + rng.normal(size=n)
    x[rng.random(n) < 0.2], z[rng.random(n) < 0.1] = np.nan, np.nan
    ok = ~(np.isnan(x) | np.isnan(z))
    a = np.column_stack([g[ok] == k for k in range(4)] + [z[ok]]).astype(float)
    want = x[ok] - a @ np.linalg.lstsq(a, x[ok], rcond=None)[0]
    got = neutralized(x, z, g, 9)
    np.testing.assert_allclose(got[ok], want, atol=1e-12)
    assert np.isnan(got[~ok]).all() and np.isnan(neutralized(x, z, g, int(ok.sum()) + 1)).all() and np.isnan(neutralized(x * np.nan, z, g, 0)).all()
    np.testing.assert_allclose(neutralized(x, g, g, 9)[~np.isnan(x)], neutralized(x, np.zeros(n), g, 9)[~np.isnan(x)], atol=1e-12)  # a size that does not vary in a group


@pytest.mark.parametrize("values", [16_000_000, 500, 300])
def test_second_gate_writes_sums_only(spark, monkeypatch, values):
    """With all columns of a date in one task, five of them, or too few for a residual; the grid, the wide rows (twice) and all ranks (twice) were written before."""
    monkeypatch.setattr(gathered, "TASK_VALUES", values)
    written = checked(spark, monkeypatch, "gate_second_level", "/root/testdata/sf0.01")
    assert (len(written) == 1 and written[0] <= 84 * 35) == (values > 300)


@pytest.mark.parametrize("values", [16_000_000, 500, 150])
def test_first_gate_writes_sums_only(spark, monkeypatch, values):
    """All columns of a date in one task, sets of five, or too few for a pair; besides the sums the factors' summary is written."""
    monkeypatch.setattr(gathered, "TASK_VALUES", values)
    written = checked(spark, monkeypatch, "gate_checks", "/root/testdata/sf0.01")
    assert (len(written) == 2 and written[0] <= 84 * 189 and written[1] == 18) == (values > 150)
