"""Point-in-time joins and key-wise de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) under ``order``.

    An aggregate with map-side combine, so a hot key is reduced before the shuffle.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])
    pick = F.max_by if last else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), key).alias("_r"))
    return one.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str = "date",
    by: Sequence[str] = ("code",),
    fields: Sequence[str] = (),
    right_on: str | None = None,
    unique_left: bool = True,
    allow_equal: bool = True,
) -> DataFrame:
    """Latest right row with right_on <= on (or <) for each left row.

    Both sides hold at most one row per (by, day): the right one by contract, the
    left one because a panel does.  With ``unique_left=False`` the left side is
    first reduced to its distinct (by, day) keys and joined back afterwards, so a
    key with very many rows never sits in one window.
    """
    by = list(by)
    if not unique_left:
        keys = left.select(*by, on).distinct()
        hit = asof_join(keys, right, on, by, fields, right_on, True, allow_equal)
        return left.join(hit, [*by, on], "left")
    pack = F.struct(*[F.col(f) for f in fields])
    r = right.select(*by, F.col(right_on or on).alias(on), pack.alias("_r"), F.lit(0 if allow_equal else 2).alias("_side"))
    l = left.withColumn("_side", F.lit(1))
    w = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    u = l.unionByName(r, allowMissingColumns=True)
    u = u.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return u.select(*left.columns, *[F.col(f"_r.{f}").alias(f) for f in fields])


def carry(df: DataFrame, fields: Sequence[str], age: Column, limit: int, age_field: str | None = None) -> DataFrame:
    """NULL out carried fields older than ``limit`` positions."""
    fresh = age <= limit
    df = df.withColumns({f: F.when(fresh, F.col(f)) for f in fields})
    return df.withColumn(age_field, F.when(fresh, age)) if age_field else df


def running_period(df: DataFrame, by: str, order: Sequence[str], period: str) -> DataFrame:
    """Drop rows whose period is behind the newest one already seen for the key.

    A key holds one row per period, so its window is as long as its report history.
    """
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_mx", F.max(period).over(w)).where(F.col(period) >= F.col("_mx")).drop("_mx")


def source_before(a: DataFrame, b: DataFrame, key: str = "code", date: str = "date") -> DataFrame:
    """Rows of ``a`` dated before the first row of ``b`` for the same key, or all where ``b`` has none."""
    first = b.groupBy(key).agg(F.min(date).alias("_first"))
    return a.join(first, key, "left").where(F.col("_first").isNull() | (F.col(date) < F.col("_first"))).drop("_first")


def union_prefer(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union where a later part wins on equal keys."""
    u = None
    for i, p in enumerate(parts):
        p = p.withColumn("_prio", F.lit(i))
        u = p if u is None else u.unionByName(p, allowMissingColumns=True)
    return keep_one(u, keys, ["_prio"]).drop("_prio")
