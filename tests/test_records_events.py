"""Pairing of trial records and event features, hand-worked."""

import pytest

from tidepanel.plans import eventscores as E, inference as I


def test_pairing(spark):
    rows = [(1, 1, "started", None), (1, 2, "completed", None),
            (2, 1, "started", None), (2, 2, "failed", None), (2, 3, "void", 2),
            (3, 1, "started", None), (3, 2, "failed", None), (3, 3, "void", 2), (3, 4, "completed", None), (3, 5, "void", 2),
            (4, 1, "started", None), (4, 2, "completed", None), (4, 3, "failed", None),
            (5, 1, "completed", None), (6, 1, "started", None), (6, 2, "started", None),
            (7, 1, "void", 9), (8, 1, "started", None), (8, 2, "void", 1), (9, 1, "started", None), (9, 2, "completed", None), (9, 3, "void", None)]
    got = I.record_pairing(spark.createDataFrame(rows, "trial long, seq long, kind string, voids long")).collect()
    assert {r.trial: (r.starts, r.results, r.state) for r in got} == {
        1: (1, 1, "ok"), 2: (1, 0, "open"), 3: (1, 1, "ok"), 4: (1, 2, "many_results"), 5: (0, 1, "bad_start"), 6: (2, 0, "bad_start"), 8: (1, 0, "open"), 9: (1, 1, "ok")}


def test_event_features(spark):
    rows = [(i, "a" if i < 4 else "b", 1, float(i) if i != 3 else None, float(-i)) for i in range(8)]
    d = spark.createDataFrame(rows, "event_id long, type string, month int, x double, y double")
    got = {r.event_id: r for r in E.event_features(d, {"a": "a", "c": "c"}, ["x", "y"], "month", ("event_id",)).collect()}
    assert "missing_x" in d.sparkSession.createDataFrame([got[0]]).columns and not hasattr(got[0], "missing_y")
    assert [got[i].x for i in range(4)] == pytest.approx([-1, 0, 1, 0]) and [got[i].missing_x for i in range(8)] == [0, 0, 0, 1, 0, 0, 0, 0]
    assert [(got[i].is_a, got[i].is_c) for i in (0, 7)] == [(1, 0), (0, 0)]
    assert got[4].y == pytest.approx(-got[7].y) and got[4].y > got[5].y > got[6].y
    assert E.event_features(d.limit(0), {"a": "a"}, ["x"], "month", ("event_id",)).count() == 0
