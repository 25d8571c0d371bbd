"""Correlations of held pairs against pandas, in one group and in many."""

import numpy as np
import pandas as pd
import pytest

from tidepanel.plans import book as B


@pytest.mark.parametrize("pairs", [1_000_000, 40])
def test_pair_correlation_makes_no_row_for_a_day(spark, monkeypatch, pairs):
    rng = np.random.default_rng(5)
    x = pd.DataFrame(np.round(rng.normal(size=(30, 24)), 6)).mask(rng.random((30, 24)) < 0.3)
    x[3] = 0.1  # does not vary
    x[4], x[5] = x[4].where(x.index < 10), x[5].where(x.index >= 20)  # no common day
    members = [(a, int(c)) for a in range(40) for c in rng.choice(24, rng.integers(1, 6), replace=False)] + [(90, 4), (90, 5), (91, 6), (91, 30)]
    days = [(int(c), int(p), None if np.isnan(v) else float(v)) for c in x for p, v in x[c].items()]
    monkeypatch.setattr(B, "PAIRS", pairs)
    d = B.pair_correlation(spark.createDataFrame(members + members[:5], "account long, code long"), spark.createDataFrame(days, "code long, pos int, ret double"), 12)
    got = {r.account: r for r in d.collect()}
    want = {}
    for a, names in pd.DataFrame(members, columns=["account", "code"]).groupby("account")["code"]:
        names, found = sorted(set(names) & set(x)), []
        for i, u in enumerate(names):
            for v in names[i + 1 :]:
                both = x[[u, v]].dropna()
                if len(both):
                    found.append(both[u].corr(both[v]) if len(both) >= 12 and both[u].nunique() > 1 and both[v].nunique() > 1 else np.nan)
        if found:
            want[a] = found
    assert sorted(got) == sorted(want) and 90 not in got and 91 not in got
    for a, c in want.items():
        good = [v for v in c if not np.isnan(v)]
        assert got[a].pairs == len(good)
        if good:
            np.testing.assert_allclose([got[a].mean_corr, got[a].max_corr], [np.mean(good), max(good)], rtol=1e-9)
        else:
            assert got[a].mean_corr is None and got[a].max_corr is None
