"""Exact ranks, quantiles and running aggregates of groups of any size and number.

A cross-section (all names of one date) grows with the data, so it is never sorted in a single
task.  Rows are dealt by ranges of (group, value): a large group fills many partitions and a
partition holds many small groups.  The dealt rows are written once, with the number of their
partition, which fixes the ranges for all later passes.  Inside a (group, partition) cell plain
windows count smaller and equal rows; one row for each cell then adds what earlier cells of the group
hold.  A value that fills several cells is counted from the first and last value of each cell, so heavy
ties spread over partitions by a hash of the row keys.

There is one path for all sizes.  Nothing is collected, no array is built, and the cell table is joined
by (group, partition), where no key has more rows than a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators.staging import materialize


TASK_ROWS = 400_000  # rows that are sorted or gathered in one task


def _tasks(spark, rows: int) -> int:
    """Partitions for so many rows: they follow the rows, as a task's memory would otherwise; few rows take fewer than the session's number."""
    return max(1, -(-rows // TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 20_000))


def _dealt(df: DataFrame, by: list[str], value: str, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Rows written by ranges of (group, value), missing values last, with their partition."""
    ranges = [*[F.col(c) for c in by], F.col(value).asc_nulls_last(), F.xxhash64(*keys)]
    dealt = df.repartitionByRange(tasks, *ranges) if tasks else df.repartitionByRange(*ranges)
    return materialize(dealt.withColumn("_part", F.spark_partition_id()))


def _with_before(cells: DataFrame, by: list[str]) -> DataFrame:
    """Add to the cell table the rows of earlier cells of the group and of the whole group; a group has a cell for each partition at most."""
    w = W.partitionBy(*by)
    return cells.withColumns({"_before": F.sum("_c").over(w.orderBy("_part")) - F.col("_c"), "_n": F.sum("_c").over(w)})


def _ranked(df: DataFrame, by: list[str], value: str, keys: Sequence[str], unique: bool, tasks: int | None = None) -> DataFrame:
    """Add ``_less``, ``_ties`` and ``_n`` of ``value``; an order key without ties needs no count of them."""
    cell = [*by, "_part"]
    d = _dealt(df, by, value, keys, tasks)
    d = d.repartition(tasks or _tasks(d.sparkSession, d.count()), *cell)
    present = F.col(value).isNotNull()
    d = d.withColumn("_lt", F.rank().over(W.partitionBy(*cell).orderBy(F.col(value).asc_nulls_last())) - 1)
    if unique:
        cells = _with_before(d.groupBy(*cell).agg(F.count(value).alias("_c")), by)
        d = d.join(cells, cell, "left")
        less, ties = F.col("_before") + F.col("_lt"), F.lit(1).cast("long")
    else:
        d = d.withColumn("_eq", F.count("*").over(W.partitionBy(*cell, value)))
        ends = d.where(present).groupBy(*cell).agg(F.count("*").alias("_c"), F.min(F.struct(value, "_eq")).alias("_a"), F.max(F.struct(value, "_eq")).alias("_z"))
        ends = _with_before(ends, by).withColumns({"_first": F.col(f"_a.{value}"), "_last": F.col(f"_z.{value}")})
        one = F.struct(F.col("_first").alias("_end"), F.col("_a._eq").alias("_m"), F.lit(True).alias("_is_first"), (F.col("_first") == F.col("_last")).alias("_is_last"))
        two = F.struct(F.col("_last").alias("_end"), F.col("_z._eq").alias("_m"), F.lit(False).alias("_is_first"), F.lit(True).alias("_is_last"))
        each = F.explode(F.when(F.col("_first") == F.col("_last"), F.array(one)).otherwise(F.array(one, two)))
        ends = ends.select(*cell, "_before", "_n", each.alias("_e")).select(*cell, "_before", "_n", "_e.*")
        w = W.partitionBy(*by, "_end")
        ends = ends.withColumns({"_sooner": F.sum("_m").over(w.orderBy("_part")) - F.col("_m"), "_all": F.sum("_m").over(w)})
        cells = ends.groupBy(*cell).agg(
            F.max("_before").alias("_before"), F.max("_n").alias("_n"),
            *[F.max(F.when(F.col(f), F.col(v))).alias(n) for n, f, v in (("_first", "_is_first", "_end"), ("_sooner", "_is_first", "_sooner"), ("_first_all", "_is_first", "_all"), ("_last", "_is_last", "_end"), ("_last_all", "_is_last", "_all"))],
        )
        d = d.join(cells, cell, "left")
        at_first, at_last = F.col(value) == F.col("_first"), F.col(value) == F.col("_last")
        less = F.col("_before") + F.col("_lt") - F.when(at_first, F.col("_sooner")).otherwise(0)
        ties = F.when(at_first, F.col("_first_all")).when(at_last, F.col("_last_all")).otherwise(F.col("_eq"))
    d = d.withColumns({"_less": F.when(present, less), "_ties": F.when(present, ties), "_n": F.when(present, F.col("_n"))})
    return d.drop("_part", "_lt", "_eq", "_before", "_first", "_sooner", "_first_all", "_last", "_last_all", "_c")


def order_stats(df: DataFrame, by: Sequence[str], values: dict[str, str | Column], keys: Sequence[str] = ("code",), write: bool = True, unique: bool = False) -> DataFrame:
    """For each prefix p of ``values`` add ``{p}less``, ``{p}ties`` and ``{p}n`` of its value inside the group.

    ``less`` counts smaller values, ``ties`` equal ones (the row included), ``n`` all present ones.  Rows
    with a missing value keep NULLs.  ``keys`` identify a row inside the group.  Several values are ranked
    as (value number, value) rows in one pass and joined back, for which the input is written first unless
    it is a plain scan (``write=False``).
    """
    by, keys = list(by), list(keys)
    names = [f"_v{i}" for i in range(len(values))]
    df = df.withColumns({n: v if isinstance(v, Column) else F.col(v) for n, v in zip(names, values.values(), strict=True)})
    if len(names) == 1:
        p = next(iter(values))
        return _ranked(df, by, "_v0", keys, unique).withColumnsRenamed({"_less": f"{p}less", "_ties": f"{p}ties", "_n": f"{p}n"}).drop("_v0")
    if len({df.schema[n].dataType.simpleString() for n in names}) > 1:
        df = df.withColumns({n: F.col(n).cast("double") for n in names})
    if write:
        df = materialize(df)
    row = list(dict.fromkeys([*by, *keys]))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(n).alias("_x")) for i, n in enumerate(names)]))
    s = df.select(*row, cells.alias("_e")).where("_e._x is not null").select(*row, "_e._i", "_e._x")
    # A row's values meet before they are gathered: partial rows of all columns for each value would be the larger shuffle.
    tasks = _tasks(df.sparkSession, df.count() * len(names))
    s = _ranked(s, [*by, "_i"], "_x", keys, unique, tasks)
    s = s.select(*row, "_i", "_less", "_ties", "_n").repartition(tasks, *row)
    s = s.groupBy(*row).agg(*[F.max(F.when(F.col("_i") == i, F.col(f"_{c}"))).alias(f"{p}{c}") for i, p in enumerate(values) for c in ("less", "ties", "n")])
    return df.repartition(tasks, *row).join(s, row, "left").drop(*names)


def avg_rank(prefix: str = "") -> Column:
    """Average-tie rank, 1-based, from the columns of ``order_stats``."""
    return F.col(f"{prefix}less") + (F.col(f"{prefix}ties") + 1) / F.lit(2.0)


def pct_rank(prefix: str = "") -> Column:
    return avg_rank(prefix) / F.col(f"{prefix}n")


def with_ranks(df, by, outs: dict[str, str | Column], pct: bool = True, keys=("code",), write=True) -> DataFrame:
    """Average-tie ranks (percentiles by default) of several values inside ``by``."""
    s = order_stats(df, by, {f"_{o}_": v for o, v in outs.items()}, keys, write)
    s = s.withColumns({o: pct_rank(f"_{o}_") if pct else avg_rank(f"_{o}_") for o in outs})
    return s.drop(*[f"_{o}_{k}" for o in outs for k in ("less", "ties", "n")])


def with_rank(df, by, value, out: str, pct: bool = True, keys=("code",), write=True) -> DataFrame:
    return with_ranks(df, by, {out: value}, pct, keys, write)


def quantiles(df, by, values: dict[str, tuple[str, float]], keys=("code",), write=True) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group, one column per name of ``values`` = (column, p).

    Several columns are ranked in one pass as (column name, value) rows.
    """
    by, keys = list(by), list(keys)
    cols = list(dict.fromkeys(c for c, _ in values.values()))
    probs = list(dict.fromkeys(float(p) for _, p in values.values()))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).alias("_x")) for c in cols])) if len(cols) > 1 else (
        F.struct(F.lit(cols[0]).alias("_name"), F.col(cols[0]).alias("_x")))
    long = df.select(*by, *[k for k in keys if k not in by], cells.alias("_e")).where("_e._x is not null")
    long = long.select(*by, *[k for k in keys if k not in by], "_e._name", "_e._x")
    s = order_stats(long, [*by, "_name"], {"_o_": "_x"}, keys, write)
    less, aggs = F.col("_o_less"), [F.max("_o_n").alias("_n")]
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("_o_n") - 1)
        aggs += [F.max(F.when(less <= F.floor(h), F.col("_x"))).alias(f"_lo{i}"),
                 F.max(F.when(less <= F.ceil(h), F.col("_x"))).alias(f"_hi{i}")]
    g = s.groupBy(*by, "_name").agg(*aggs)
    outs = []
    for name, (c, p) in values.items():
        i = probs.index(float(p))
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append(F.max(F.when(F.col("_name") == c, lo + (hi - lo) * (h - F.floor(h)))).alias(name))
    return g.groupBy(*by).agg(*outs)


def order_key(order: Sequence[Column | str]) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return F.when(cols[0].isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)]))


def position(df, by, order: Sequence[Column | str], out: str = "place", total: str | None = None, keys=("code",), write=True) -> DataFrame:
    """1-based place of each row inside ``by`` under a total order.

    ``order`` is a list of columns compared left to right; the last ones must make
    the order unique.  Negate a number for a descending order.  A row whose first
    order column is missing gets no place.
    """
    s = order_stats(df, by, {"_o_": order_key(order)}, keys, write, unique=True).withColumn(out, F.col("_o_less") + 1)
    if total:
        s = s.withColumn(total, F.col("_o_n"))
    return s.drop("_o_less", "_o_ties", "_o_n")


_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df, by, order, outs: dict[str, tuple[str, str]], keys=("code",), write=True) -> DataFrame:
    """Running sum / max / min from the first row of the group to the current one.

    ``outs`` maps an output name to (function, column); the order must be unique
    and its first column present.
    """
    by, keys = list(by), list(keys)
    cell = [*by, "_part"]
    d = _dealt(df.withColumn("_v0", order_key(order)), by, "_v0", keys)
    upto = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*cell).agg(*[_FN[fn](c).alias(f"_t_{o}") for o, (fn, c) in outs.items()])
    totals = totals.select(*cell, *[_FN[fn](f"_t_{o}").over(upto).alias(f"_p_{o}") for o, (fn, _) in outs.items()])
    inside = W.partitionBy(*cell).orderBy("_v0").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({f"_w_{o}": _FN[fn](c).over(inside) for o, (fn, c) in outs.items()}).join(totals, cell, "left")
    for o, (fn, _) in outs.items():
        w, p = F.col(f"_w_{o}"), F.col(f"_p_{o}")
        both = {"sum": w + p, "max": F.greatest(w, p), "min": F.least(w, p)}[fn]
        d = d.withColumn(o, F.coalesce(both, w, p))
    return d.drop("_v0", "_part", *[f"_w_{o}" for o in outs], *[f"_p_{o}" for o in outs])


def deal_in_order(df, by, order) -> DataFrame:
    """Rows written once by ranges of (group, order), with their partition; the order must be unique in the group."""
    return materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def split_groups(dealt: DataFrame, by: Sequence[str]) -> DataFrame:
    """The groups of dealt rows that lie in several partitions; each partition border cuts one group at most."""
    ends = dealt.groupBy(*by).agg(F.min("_part").alias("_a"), F.max("_part").alias("_z")).where("_a < _z")
    return materialize(ends.select(*by))


def cell_starts(split: DataFrame, by, order, value: str, scale: str) -> DataFrame:
    """(group, partition, _start): what a recurrence x = a * x + b has reached before each cell of groups in several partitions.

    ``value`` is a row's x when its cell starts from zero, ``scale`` the product of a from the start of the cell.
    A group has one row for each partition here.
    """
    last = F.max_by(F.struct(F.col(value).alias("x"), F.col(scale).alias("a")), F.struct(*order))
    cells = split.groupBy(*by, "_part").agg(last.alias("_l")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_part", "_l"))).alias("_cells"))
    first = lambda n: F.slice("_cells", F.lit(1), n)
    before = F.transform("_cells", lambda c, i: F.struct(c["_part"].alias("_part"), F.aggregate(first(i), F.lit(0.0), lambda x, e: e["_l"]["x"] + e["_l"]["a"] * x).alias("_start")))
    return materialize(cells.select(*by, F.explode(before).alias("_c")).select(*by, "_c._part", "_c._start"))


def with_start(d: DataFrame, starts: DataFrame, by, value: str, scale: str) -> DataFrame:
    """Add to ``value`` what its cell starts from; ``starts`` has few rows, two for each partition at most."""
    d = d.join(F.broadcast(starts), [*by, "_part"], "left")
    return d.withColumn(value, F.col(value) + F.col(scale) * F.coalesce("_start", F.lit(0.0))).drop("_start")
