"""Sealed ingest: late rows, conflicts, changed and older days, replayed batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.streaming.sealed import SealedStore, seal

SCHEMA = "event_date date, code long, observed_at timestamp, value double"


def rows(spark, *r):
    return spark.createDataFrame([(dt.date(2024, 1, d), c, dt.datetime(2024, 1, d, h), v) for d, c, h, v in r], SCHEMA)


def cutoff():
    return F.col("event_date").cast("timestamp") + F.expr("interval 20 hours")


def test_last_observation_wins_and_late_is_left_out(spark):
    d = seal(rows(spark, (1, 1, 9, 1.0), (1, 1, 12, 2.0), (1, 2, 22, 3.0), (1, 3, 9, 4.0), (1, 3, 9, 5.0)), cutoff())
    assert [(r["code"], r["value"]) for r in d.collect()] == [(1, 2.0)]


def test_days_are_append_only(spark):
    s = SealedStore(spark)
    first = rows(spark, (2, 1, 9, 1.0), (2, 2, 9, 2.0))
    s.append(first, 0, cutoff())
    s.append(first, 1, cutoff())  # same content: nothing happens
    s.append(rows(spark, (2, 1, 9, 7.0)), 2, cutoff())  # changed day
    s.append(rows(spark, (1, 1, 9, 1.0)), 3, cutoff())  # older day
    s.append(rows(spark, (3, 1, 9, 1.0)), 4, cutoff())
    s.append(rows(spark, (3, 1, 9, 1.0)), 4, cutoff())  # replay of a batch
    assert sorted((r["event_date"].day, r["code"], r["value"]) for r in s.read(SCHEMA).collect()) == [(2, 1, 1.0), (2, 2, 2.0), (3, 1, 1.0)]
    assert sorted(r["reason"] for r in s.refused().collect()) == ["changed", "older"]
    assert s.read(SCHEMA, "2024-01-02").count() == 2


def test_labels_are_refused(spark):
    with pytest.raises(ValueError):
        SealedStore(spark).append(rows(spark, (1, 1, 9, 1.0)).withColumn("label_1", F.lit(0.0)), 0, cutoff())


def test_day_features_leave_at_the_watermark_and_survive_a_restart(spark, tmp_path):
    """Ticks out of order over several files and two runs; a tick behind the watermark is dropped; open days wait."""
    import math

    from tidepanel.streaming import dayfeatures as DF

    at = lambda d, h, m=0: dt.datetime(2024, 3, d, h, m)
    ticks = {  # day: (hour, minute, value) of code 7; a bar has 60 minutes
        1: [(9, 0, 1.0), (9, 30, 3.0), (10, 5, 7.0), (10, 50, 1.0), (11, 0, 4.0)],
        2: [(9, 30, 0.0), (12, 0, 2.0)],
        3: [(9, 0, 5.0), (10, 0, 6.0)],
    }
    rows = [(i, at(d, h, m), 7, v) for i, (d, h, m, v) in enumerate((d, *t) for d, day in ticks.items() for t in day)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    setting = {"width": "60 minutes", "delay": "3 hours", "per_day": 2, "edge": 1}
    files = [[rows[1], rows[4]], [rows[0], rows[3], rows[2]], [rows[6]], [rows[5], (90, at(1, 9, 10), 7, 99.0)], rows[7:]]

    def run(new):
        for part in new:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            DF.run_day_features(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", **setting)
        return {r.date.day: r for r in spark.read.schema(DF.OUT).parquet(f"{tmp_path}/out").collect()}

    assert run(files[:2]) == {}
    got = run(files[2:])
    assert sorted(got) == [1, 2]
    one = got[1]  # bars (2, 4), (8, 2), (5, 5) of 2, 2 and 1 ticks
    moves = [4 / 2 - 1, 2 / 4 - 1, 5 / 2 - 1]
    assert (one.bars, one.tail_share, one.open_ret) == (3, 1 / 5, 4 / 2 - 1)
    assert math.isclose(one.rv, math.sqrt(sum(m * m for m in moves))) and one.up_share == 3 / 5
    assert got[2].bars == 2 and math.isclose(got[2].rv, 2.0)  # (1, 1), (3, 3): 0 and 2


def test_day_features_of_one_bar():
    from tidepanel.streaming.dayfeatures import features

    assert features([(2.0, 3.0, 4)], 6) == (0.5, 1.0, 0.5, 1.0)
    assert features([(0.0, 0.0, 1), (1.0, 2.0, 1)], 1) == (None, 0.5, None, 0.0)


def test_day_features_leave_state_to_the_engine(spark, tmp_path, capsys):
    """No Python call for each (code, day) holds state: that took longer than the data with many codes."""
    from tidepanel.streaming import dayfeatures as DF

    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, value double").parquet(str(tmp_path))
    DF.stream_day_features(events, width="60 minutes", delay="3 hours", per_day=2, edge=1).explain()
    plan = capsys.readouterr().out
    assert "StateStoreSave" in plan and "WithState" not in plan
