"""Trial ledger and forecasts derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources.adapters import Stage


def trials(s: Stage) -> DataFrame:
    """One trial per order: campaign, candidate, level passed, ratio, gate JSON."""
    k = F.col("o_orderkey")
    o = s.table("orders")
    lvl = (k * 7 + F.col("o_custkey")) % 10
    level = F.when(lvl < 4, 0).when(lvl < 7, 1).when(lvl < 9, 2).otherwise(3)
    icir = F.when(k % 17 != 0, (F.col("o_totalprice") % 1000) / 1000 * 0.87654321 - 0.3)
    gate = F.to_json(F.struct(F.array(
        F.struct(F.lit("coverage").alias("name"), (k % 3 != 0).alias("passed")),
        F.struct(F.lit("icir").alias("name"), (k % 5 != 0).alias("passed"))).alias("checks")))
    return o.select(k.alias("trial"), (k % 6).alias("campaign"), F.col("o_custkey").alias("candidate"), level.alias("level"), icir.alias("icir"),
                    F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("form"), gate.alias("gate_json"),
                    (F.lit(20) + k % 400).alias("days"))
