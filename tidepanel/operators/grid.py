"""Trading calendar and the dense (date, code) grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct days with their position.  One row per day, so it is small whatever the panel holds."""
    days = df.select(F.col(date).alias("date")).distinct()
    return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("pos"))


def with_pos(df: DataFrame, cal: DataFrame, date: str = "date", pos: str = "pos") -> DataFrame:
    """Attach the calendar position; a calendar has at most one row per day, hence the broadcast."""
    c = cal.select(F.col("date").alias(date), F.col("pos").alias(pos))
    return df.join(F.broadcast(c), date)


def densify(panel: DataFrame, cal: DataFrame, fields: Sequence[str], code: str = "code") -> DataFrame:
    """One row per code and calendar day; days without a panel row carry NULL fields.

    Each row fills the gap up to the next row of its code (the first one also the
    gap before it), so the grid needs no product of dates and codes and no join:
    one exchange by code, which the rolling windows that follow share.
    """
    days = cal.agg(F.sort_array(F.collect_list("date")).alias("_days"))
    w = W.partitionBy(code).orderBy("pos")
    gap = panel.select(code, "pos", *fields)
    gap = gap.withColumn("_from", F.when(F.lag("pos").over(w).isNull(), F.lit(0)).otherwise(F.col("pos")))
    gap = gap.withColumn("_next", F.lead("pos").over(w))
    gap = gap.join(F.broadcast(days))
    last = F.coalesce(F.col("_next"), F.size("_days")) - 1
    gap = gap.withColumn("_p", F.explode(F.sequence("_from", last)))
    hit = F.col("_p") == F.col("pos")
    return gap.select(
        F.col(code),
        F.element_at("_days", F.col("_p") + 1).alias("date"),
        F.col("_p").alias("pos"),
        *[F.when(hit, F.col(f)).alias(f) for f in fields],
    )


def day_lookup(cal: DataFrame) -> DataFrame:
    """Natural day -> first calendar day strictly after it, for every day from the first to the last calendar day."""
    prev = F.lag("date").over(W.orderBy("date"))
    d = cal.withColumn("_prev", prev).where(F.col("_prev").isNotNull())
    return d.select(
        F.explode(F.sequence("_prev", F.date_sub("date", 1))).alias("day"),
        F.col("date").alias("next_day"),
        F.col("pos").alias("next_pos"),
    )


def next_trading_day(df: DataFrame, cal: DataFrame, on: str, out: str = "eff_date", pos: str = "eff_pos",
                     inclusive: bool = False) -> DataFrame:
    """First calendar day strictly after ``on`` (on or after with ``inclusive``); later rows are dropped.

    The lookup has one row per natural day of the calendar's span.
    """
    key = F.date_sub(on, 1) if inclusive else F.col(on)
    lk = day_lookup(cal)
    first = cal.agg(F.min(F.struct("date", "pos")).alias("_first"))
    d = df.withColumn("_day", key).join(F.broadcast(lk), F.col("_day") == F.col("day"), "left")
    d = d.join(F.broadcast(first))
    early = F.col("_day") < F.col("_first.date")
    d = d.withColumn(out, F.when(early, F.col("_first.date")).otherwise(F.col("next_day")))
    d = d.withColumn(pos, F.when(early, F.col("_first.pos")).otherwise(F.col("next_pos")))
    return d.where(F.col(out).isNotNull()).drop("_day", "day", "next_day", "next_pos", "_first")
