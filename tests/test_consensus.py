"""Consensus states against a day-by-day walk over all reports."""

import datetime as dt
import random
from statistics import mean, median

import pytest

from tidepanel.plans import pit


def brute(day, rows):
    """rows: (report_id, published, broker, fiscal_year, eps, score, revision) of one code."""
    seen = [r for r in rows if r[2] is not None and r[1] is not None and dt.timedelta(0) < day - r[1] <= dt.timedelta(180)]

    def latest(value, ok):
        out = {}
        for r in sorted((r for r in seen if ok(r)), key=lambda r: (r[1], r[0], r[3] or 0)):
            out[r[2]] = value(r)
        return list(out.values())

    age = lambda r: (day - r[1]).days
    at = lambda year: latest(lambda r: r[4], lambda r: r[4] is not None and r[3] == year)
    of = lambda f, x: round(f(x), 9) if x else None
    revision = lambda n: latest(lambda r: r[6], lambda r: r[6] is not None and age(r) <= n)
    return (len({r[2] for r in seen if age(r) <= 90}), len({r[2] for r in seen}), of(median, at(day.year)), of(median, at(day.year + 1)),
            of(mean, latest(lambda r: r[5], lambda r: r[5] is not None)), of(mean, revision(30)), of(mean, revision(90)))


@pytest.mark.parametrize("seed,sweep", [(1, 200_000), (2, 20)])
def test_consensus_matches_a_walk_over_days(spark, monkeypatch, seed, sweep):
    """Same-day reports, renewals on the last live day, year turns, missing parts, one code with nearly all reports."""
    monkeypatch.setattr(pit, "SWEEP_ROWS", sweep)
    rng, start = random.Random(seed), dt.date(2019, 6, 1)
    rows = []
    for i in range(240):
        code = 1 if rng.random() < 0.7 else rng.randrange(2, 5)
        day = start + dt.timedelta(rng.choice([rng.randrange(700), 30, 60, 120, 210, 211]))
        pick = lambda x: None if rng.random() < 0.2 else x
        rows.append((code, i, pick(day) if rng.random() < 0.1 else day, pick(f"b{rng.randrange(4)}"), pick(day.year + rng.randrange(-1, 3)), pick(float(rng.randrange(1, 9))), pick(float(rng.randrange(1, 6))), pick(float(rng.randrange(-1, 2)))))
    reports = spark.createDataFrame(rows, "code long, report_id long, publish_date date, broker string, fiscal_year int, eps double, score double, revision double")
    days = [start + dt.timedelta(k) for k in range(0, 950, 3)]
    panel = spark.createDataFrame([(c, d) for c in range(1, 6) for d in days], "code long, date date")
    got = {(r.code, r.date): tuple(None if r[c] is None else round(r[c], 9) for c in pit.STATE) for r in pit.consensus(panel, reports).collect()}
    want = {(c, d): brute(d, [r[1:] for r in rows if r[0] == c]) for c in range(1, 6) for d in days}
    assert got == want
    assert pit.consensus_states(reports).count() < 30 * len(rows)


def test_consensus_without_reports(spark):
    none = spark.createDataFrame([], "code long, report_id long, publish_date date, broker string, fiscal_year int, eps double, score double, revision double")
    panel = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "code long, date date")
    r = pit.consensus(panel, none).first()
    assert (r.coverage_90, r.coverage_180, r.eps_fy1, r.rating) == (0, 0, None, None)
