"""Factor values are found again by panel and definition only."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.plans.factors import Factor, definition
from tidepanel.sources import factorstore as ST


def test_changed_definitions_are_computed_anew(spark, tmp_path):
    d = spark.createDataFrame([(c, dt.date(2024, 1, i), float(c * i)) for c in (1, 2) for i in (1, 2, 3)], "code long, date date, x double")
    one = lambda name, k, direction=1: Factor(name, lambda: [{name: F.col("x") * k}], direction)
    assert definition(one("a", 2)) == definition(one("a", 2)) and len({definition(one("a", 2)), definition(one("a", 3)), definition(one("a", 2, -1))}) == 3
    root, sign = str(tmp_path), ST.panel_signature(d, ["x"])
    values = lambda got: {r.factor: r.value for r in got.where("code = 2 and day(date) = 3").collect()}
    assert values(ST.through_store(d, [one("a", 2), one("b", 5)], root, sign)) == {"a": 12.0, "b": 30.0}
    poisoned = d.withColumn("x", F.lit(-1.0))  # what is stored is not computed again
    assert values(ST.through_store(poisoned, [one("a", 3), one("b", 5)], root, sign)) == {"a": -3.0, "b": 30.0}
    assert values(ST.load_factors(spark, root, sign, {"a": definition(one("a", 2))})) == {"a": 12.0}
    assert ST.panel_signature(poisoned, ["x"]) != sign and ST.load_factors(spark, root, "none", {"a": "x"}).count() == 0
