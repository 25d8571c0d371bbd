"""Row numbers inside groups of any size, by ranges instead of one task for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators.staging import materialize


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Add ``out``, the 0-based place of each row inside ``by`` under ``order``.

    Rows are dealt by ranges of (group, order), so a group may fill many partitions and a
    partition many groups.  Their place in the written partitions fixes the numbers; the rows of
    a group in earlier partitions are counted from one row for each (group, partition).
    """
    by, order = list(by), [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(c) for c in by] + order
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt).withColumn("_part", F.shiftright("_at", 33))
    names = {c: f"_g{i}" for i, c in enumerate(by)}
    heads = dealt.groupBy(*[F.col(c).alias(n) for c, n in names.items()], F.col("_part").alias("_q")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = W.partitionBy(*names.values()).orderBy("_q")
    heads = heads.withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows")).drop("_rows")
    same = F.col("_part") == F.col("_q")
    for c, n in names.items():
        same &= F.col(c).eqNullSafe(F.col(n))
    placed = dealt.join(heads, same)
    return placed.withColumn(out, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_q", "_first", "_before", *names.values())
