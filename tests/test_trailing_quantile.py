"""Trailing quantile of event scores against a plain reading."""

import numpy as np
import pytest

from tidepanel.plans import eventscores as E


@pytest.mark.parametrize("lookback, ranges, q", [(5, 8, 0.9), (30, 64, 0.5), (3, 1, 0.25), (50, 256, 1.0)])
def test_trailing_quantile(spark, lookback, ranges, q):
    rng = np.random.default_rng(lookback)
    rows = [(i, int(p), None if i % 17 == 0 else float(np.round(rng.normal(), 1 if i % 2 else 6))) for i, p in enumerate(rng.integers(0, 60, 700) * rng.integers(1, 3, 700))]
    rows += [(1000 + i, 7, 0.5) for i in range(300)]
    got = {r.pos: (r.n, r.cut) for r in E.trailing_quantile(spark.createDataFrame(rows, "event_id long, pos int, score double"), lookback, q, ranges).collect()}
    scored = [r for r in rows if r[2] is not None]
    want = {}
    for p in {r[1] for r in scored}:
        past = [s for _, x, s in scored if p - lookback <= x < p]
        if past:
            want[p] = (len(past), np.quantile(past, q))
    assert got.keys() == want.keys()
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1e-12) for p in want)


def test_no_scores(spark):
    d = spark.createDataFrame([(1, 3, None)], "event_id long, pos int, score double")
    assert E.trailing_quantile(d, 5, 0.9).count() == 0 and E.trailing_entries(d, 5, 0.9, 1).count() == 0
    assert E.trailing_entries(d.limit(0), 5, 0.9, 1).count() == 0
