"""Replayed trades dealt once, and positions counted without a row for each day they are held."""

import datetime as dt
import random

import pytest

from tidepanel.operators import ordering as O
from tidepanel.plans import book as B

DAY = dt.date(2020, 1, 1)


def trade_rows(n, pairs, seed):
    rng = random.Random(seed)
    return [(0, rng.randrange(pairs), DAY + dt.timedelta(days=rng.randrange(900)), i, rng.choice(["buy"] * 6 + ["sell"] * 4 + ["set", "dividend"]), float(rng.randint(1, 9)), 50.0 + rng.random()) for i in range(n)]


def by_loop(rows):
    """seq -> (held, basis)"""
    state, out = {}, {}
    for _, code, _, seq, kind, q, price in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        held, basis = state.get(code, (0.0, 0.0))
        if kind == "buy":
            held, basis = held + q, (basis if held or basis else 0.0) + q * price
        elif kind == "sell":
            keep = (held - q) / held if held > 0 else 0.0
            held, basis = held - q, basis * (keep if keep > 1e-9 else 0.0)
        elif kind == "set":
            held, basis = q, q * price
        state[code] = out[seq] = (held, basis)
    return out


@pytest.mark.parametrize("pairs", [1, 40])
def test_pairs_cut_by_borders_are_dealt_once(spark, monkeypatch, pairs):
    """One pair fills all partitions, or many pairs lie in each; trades are written once for quantity and cost."""
    rows, dealt = trade_rows(1500, pairs, pairs), []
    real = O.materialize
    monkeypatch.setattr(O, "materialize", lambda df: (dealt.append(df.columns) if "amount" in df.columns else None) or real(df))
    d = spark.createDataFrame([(*r[:6], r[5] * r[6], r[6]) for r in rows], "account int, code int, date date, seq int, type string, quantity double, amount double, price double")
    got = {r.seq: r for r in B.replay_with_cost(d.repartition(7)).collect()}
    want = by_loop(rows)
    assert len(dealt) == 1 and got.keys() == want.keys()
    for seq, (held, basis) in want.items():
        assert got[seq].held == held
        if held > 0:
            assert got[seq].cost == pytest.approx(basis / held, rel=1e-9, abs=1e-9)


def test_paper_days_match_a_loop(spark):
    rng = random.Random(5)
    at = lambda n: DAY + dt.timedelta(days=n)
    spans, prices = [], []
    for account in range(2):
        for code in range(6):
            cuts = sorted(rng.sample(range(1200), 8))
            spans += [(account, code, float(rng.randint(1, 9)), at(a + 1), at(z) if z < cuts[-1] else dt.date(9999, 12, 31)) for a, z in zip(cuts[::2], cuts[1::2], strict=True)]
    for code in range(5):
        prices += [(code, at(n), rng.choice([None, *map(float, range(1, 10))])) for n in sorted(rng.sample(range(1200), 60))]
    days = [(a, at(n)) for a in range(2) for n in rng.sample(range(1200), 300)] + [(7, at(3))]
    want = {a: [0, 0] for a in (0, 1, 7)}
    for a, day in days:
        for b, code, cost, first, last in spans:
            px = [p for c, d, p in prices if c == code and d <= day][-1:]
            if a == b and first <= day <= last and px and px[0] is not None:
                want[a][px[0] <= cost] += 1
    got = B.paper_days(spark.createDataFrame(spans, "account int, code int, cost double, first date, last date"),
                       spark.createDataFrame(prices, "code int, date date, px double"), spark.createDataFrame(days, "account int, date date"))
    assert {r.account: [r.gains, r.losses] for r in got.collect()} == want
