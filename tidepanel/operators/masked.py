"""Ranks of every column of a wide table inside the rows where another column is present too, for all pairs at once.

The rank correlation of two columns takes the rows on which both are present, so a column has another rank for
each partner.  Which rows these are depends on where the partner is missing and on nothing else about it.
Columns that are missing on the same rows form one class, and one running count for each class, kept while the
values of a column are walked in order, gives its ranks for all partners together: a row is never multiplied by
pairs, and each column is ordered once.

Values are dealt by ranges of (column, group, value, row), so a group fills as many partitions as it needs.
Each partition counts the present rows of every class before and at each value and adds one summary row for
each (column, group) it holds; summaries of a group, at most one for each partition, say what earlier
partitions hold and which values go on into the next.  Ranks are then brought together by row in slices of a
group, where a slice's products are one small matrix for each pair and are summed over slices.

NULL is the only missing value.  Ranks are average-tie ranks minus their mean, exact multiples of one half.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.staging import materialize

PARTITION_ROWS = 500_000  # values of one partition
SLICE_ROWS = 20_000  # rows of a group that meet in one task


@dataclass(frozen=True)
class MaskedRanks:
    """``rows``: group, _row, i (column number), _here (bit c: class c is present), carried columns, v{c} (centred rank among rows of class c), n{c} (their number)."""

    rows: DataFrame
    columns: tuple[str, ...]
    classes: tuple[int, ...]  # of each column
    by: str
    slices: int


def _classes(base: DataFrame, columns: Sequence[str]) -> list[int]:
    """A number for each column, equal for columns that are missing on the same rows."""
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(columns)]
    seen = bits[0]
    for b in bits[1:]:
        seen = seen.bitwiseOR(b)
    always = base.select(seen.alias("_seen"), *columns).agg(*[F.bit_and(F.when(F.col(c).isNotNull(), F.col("_seen"))) for c in columns]).first()
    with_ = [int(x or 0) for x in always]  # columns present wherever this one is
    out: list[int] = []
    for i in range(len(columns)):
        same = next((j for j in range(i) if with_[i] >> j & 1 and with_[j] >> i & 1), None)
        out.append(max(out, default=-1) + 1 if same is None else out[same])
    return out


def _counts(table: pa.Table, part: int, by: str, classes: int, carried: Sequence[str]) -> tuple[dict, dict]:
    """Rows and summaries of one partition: twice the rank among the rows of each class that stand here."""
    i, x = table.column("i").to_numpy(), table.column("x").to_numpy()
    group = table.column(by).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((x, group, i))
    i, x, group, here = i[order], x[order], group[order], table.column("_here").to_numpy()[order]
    n = len(i)
    seen = np.zeros((n + 1, classes), np.int64)
    np.cumsum(here[:, None] >> np.arange(classes) & 1, axis=0, out=seen[1:])
    new_group = np.append(True, (i[1:] != i[:-1]) | (group[1:] != group[:-1]))
    new_run = new_group | np.append(True, x[1:] != x[:-1])
    starts, heads = np.flatnonzero(new_run), np.flatnonzero(new_group)
    ends, tails = np.append(starts[1:], n), np.append(heads[1:], n)
    cell = np.cumsum(new_group[starts]) - 1  # of each run
    twice = seen[starts] + seen[ends] - 2 * seen[heads[cell]] + 1
    edge = (starts == heads[cell]) + 2 * (ends == tails[cell])
    run = np.repeat(np.arange(len(starts)), ends - starts)
    first, last = np.searchsorted(starts, heads), np.searchsorted(ends, tails)
    taken = table.select([by, "_row", "_here", *carried]).take(pa.array(order))
    rows = {c: taken.column(c) for c in taken.column_names} | {"i": pa.array(i), "edge": pa.array(edge[run].astype(np.int32))}
    rows |= {f"t{c}": pa.array(np.ascontiguousarray(twice[run, c])) for c in range(classes)}
    held = table.select([by]).take(pa.array(order[heads]))
    cells = {by: held.column(by), "i": pa.array(i[heads]), "first": pa.array(x[heads]), "last": pa.array(x[tails - 1])}
    for name, counts in (("total", seen[tails] - seen[heads]), ("head", seen[ends[first]] - seen[starts[first]]), ("tail", seen[ends[last]] - seen[starts[last]])):
        cells[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1) * classes, pa.int32()), pa.array(counts.ravel()))
    return rows | {"part": pa.array(np.full(n, part, np.int32))}, cells | {"part": pa.array(np.full(len(heads), part, np.int32))}


def _placed(t: pa.Table, by: str, classes: int) -> pa.Table:
    """For all partitions of some (column, group): what the ranks counted inside them lack."""
    t = t.select([by, "i", "part", "first", "last", "total", "head", "tail"]).combine_chunks()
    i, part = t.column("i").to_numpy(), t.column("part").to_numpy()
    group = t.column(by).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((part, group, i))
    i, group, t = i[order], group[order], t.take(pa.array(order))
    total, head, tail = (t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, classes) for c in ("total", "head", "tail"))
    first, last = t.column("first").to_numpy(), t.column("last").to_numpy()
    k = len(i)
    goes_on = np.append((i[1:] == i[:-1]) & (group[1:] == group[:-1]), False)  # into the next row
    starts = np.flatnonzero(~np.append(False, goes_on[:-1]))
    sizes = np.diff(np.append(starts, k))
    n = np.repeat(np.add.reduceat(total, starts), sizes, axis=0)
    before = np.cumsum(total, 0) - total
    before -= np.repeat(before[starts], sizes, axis=0)
    sooner, later = np.zeros_like(total), np.zeros_like(total)  # of the first value in earlier partitions, of the last one in later ones
    shared = np.flatnonzero(goes_on[:-1] & (last[:-1] == first[1:])).tolist()
    for j in shared:
        sooner[j + 1] = tail[j] + (sooner[j] if first[j] == last[j] else 0)
    for j in reversed(shared):
        later[j] = head[j + 1] + (later[j + 1] if first[j + 1] == last[j + 1] else 0)
    one = (first == last)[:, None]
    base, at_head = 2 * before - n - 1, np.where(one, later, 0) - sooner
    out = {by: t.column(by), "i": t.column("i"), "part": t.column("part")}
    for c in range(classes):
        out |= {f"base{c}": base[:, c], f"head{c}": at_head[:, c], f"tail{c}": later[:, c], f"n{c}": n[:, c]}
    return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(np.ascontiguousarray(v)) for k, v in out.items()})


def masked_ranks(df: DataFrame, columns: Sequence[str], by: str = "date", carry: Sequence[str] = ()) -> MaskedRanks:
    """Rank each of ``columns`` inside ``by`` for the rows of every class of missing values; ``carry`` names numbers that stay with the rows."""
    spark, columns = df.sparkSession, list(columns)
    kept = list(dict.fromkeys([*columns, *carry]))
    base = materialize(df.select(by, *[F.col(c).cast("double").alias(c) for c in kept]).withColumn("_row", F.monotonically_increasing_id()))
    classes = _classes(base, columns)
    m = max(classes) + 1
    largest, total = base.groupBy(by).count().agg(F.max("count"), F.sum("count")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) * len(columns) // PARTITION_ROWS)
    here = F.lit(0).cast("long")
    for c in range(m):
        here = here.bitwiseOR(F.when(F.col(columns[classes.index(c)]).isNotNull(), F.lit(1 << c)).otherwise(0).cast("long"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col(c) + 0.0).alias("x")) for i, c in enumerate(columns)]))
    carried = [f"_c{i}" for i in range(len(carry))]
    long = base.select(by, "_row", here.alias("_here"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)], cells.alias("_e"))
    long = long.where("_e.x is not null").select(by, "_row", "_here", *carried, "_e.i", "_e.x")
    kind = df.schema[by].dataType.simpleString()
    schema = f"part int, `{by}` {kind}, i int, _row long, _here long, edge int" + "".join(f", {c} double" for c in carried) + "".join(f", t{c} long" for c in range(m)) + ", first double, last double, total array<long>, head array<long>, tail array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        for columns_ in _counts(pa.Table.from_batches(held), TaskContext.get().partitionId(), by, m, carried):
            size = len(columns_["part"])
            arrays = {f.name: columns_.get(f.name, pa.nulls(size, f.type)) for f in arrow}
            yield from pa.table(arrays).cast(arrow).combine_chunks().to_batches(max_chunksize=50_000)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    counted = materialize(long.repartitionByRange(parts, "i", by, "x", "_row").mapInArrow(count, schema))
    lacks = f"`{by}` {kind}, i int, part int" + "".join(f", base{c} long, head{c} long, tail{c} long, n{c} long" for c in range(m))
    summaries = counted.where("_row is null").select(by, "i", "part", "first", "last", "total", "head", "tail")
    dealt = summaries.withColumn("_deal", F.pmod(F.xxhash64(by, "i"), F.lit(parts)))  # a group's summaries, at most one for each partition, meet in one task
    lacking = dealt.groupBy("_deal").applyInArrow(lambda t: _placed(t, by, m), lacks)
    d = counted.where("_row is not null").join(F.broadcast(lacking), [by, "i", "part"])  # a row for each (column, group) and partition border
    edges = lambda c: F.when(F.col("edge").isin(1, 3), F.col(f"head{c}")).when(F.col("edge") == 2, F.col(f"tail{c}")).otherwise(0)
    ranks = [((F.col(f"t{c}") + F.col(f"base{c}") + edges(c)) / F.lit(2.0)).alias(f"v{c}") for c in range(m)]
    rows = d.select(by, "_row", "i", "_here", *[F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)], *ranks, *[f"n{c}" for c in range(m)])
    return MaskedRanks(rows, tuple(columns), tuple(classes), by, max(1, -(-(largest or 0) // SLICE_ROWS)))


def pair_correlations(ranks: MaskedRanks, pairs: Sequence[tuple[str, str]], min_names: int) -> DataFrame:
    """(a, b, group, ic, names): rank correlation of each pair of columns, missing with too few names or where a side does not vary."""
    by, names, m = ranks.by, list(ranks.columns), max(ranks.classes) + 1
    left, right = (np.array([names.index(p[k]) for p in pairs]) for k in (0, 1))
    cls = np.array(ranks.classes)
    # A rank is read for the classes of its column's partners only; the others cross the network as NULLs.
    readers = [sorted({*left[cls[right] == c].tolist(), *right[cls[left] == c].tolist()}) for c in range(m)]
    used = [c for c in range(m) if readers[c]]
    place = np.array([used.index(c) if c in used else 0 for c in range(m)])
    kind = ranks.rows.schema[by].dataType.simpleString()

    def products(t: pa.Table) -> pa.Table:
        keys, at = np.unique(t.column("_row").to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, i = at[order], t.column("i").to_numpy()[order]
        v = np.stack([t.column(f"v{c}").to_numpy()[order] for c in used], 1)
        sums = np.zeros((4, len(left)))
        for lo in range(0, len(keys), 1000):
            a, z = np.searchsorted(at, [lo, lo + 1000])
            cube = np.zeros((min(1000, len(keys) - lo), len(names), len(used)))
            seen = np.zeros(cube.shape[:2], bool)
            cube[at[a:z] - lo, i[a:z]], seen[at[a:z] - lo, i[a:z]] = v[a:z], True
            both = seen[:, left] & seen[:, right]
            x, y = np.where(both, cube[:, left, place[cls[right]]], 0.0), np.where(both, cube[:, right, place[cls[left]]], 0.0)
            sums += [(x * y).sum(0), (x * x).sum(0), (y * y).sum(0), both.sum(0)]
        group = pa.array([t.column(by)[0].as_py()] * len(left), t.schema.field(by).type)
        return pa.table({by: group, "_p": pa.array(np.arange(len(left), dtype=np.int32)), "xy": sums[0], "xx": sums[1], "yy": sums[2], "names": pa.array(sums[3].astype(np.int64))})

    slice_ = F.pmod(F.xxhash64("_row"), F.lit(ranks.slices)).alias("_slice")
    rows = ranks.rows.select(by, slice_, "_row", "i", *[F.when(F.col("i").isin(readers[c]), F.col(f"v{c}")).alias(f"v{c}") for c in used])
    got = rows.groupBy(by, "_slice").applyInArrow(products, f"`{by}` {kind}, _p int, xy double, xx double, yy double, names long")
    got = got.groupBy(by, "_p").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "names")])
    return named(got, pairs, by, min_names)


def named(sums: DataFrame, pairs: Sequence[tuple[str, str]], by: str, min_names: int) -> DataFrame:
    """(a, b, group, ic, names) from sums of products of centred ranks by (group, pair number)."""
    varies = (F.col("xx") > 0) & (F.col("yy") > 0) & (F.col("names") >= min_names)
    ic = F.when(varies, F.round(F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0)), 12))
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("_p") + 1)
    return sums.where("names > 0").select(name(0).alias("a"), name(1).alias("b"), by, ic.alias("ic"), "names")


def buckets(ranks: MaskedRanks, values: Sequence[str], target: str, q: int) -> DataFrame:
    """(factor, group, bucket, m): mean of the carried ``target`` in q buckets of each column's percentile among the rows that have both."""
    names, cls = list(ranks.columns), dict(zip(ranks.columns, ranks.classes, strict=True))
    c = cls[target]
    n = F.col(f"n{c}")
    share = (F.col(f"v{c}") + (n + 1) / F.lit(2.0)) / F.nullif(n, F.lit(0))
    bucket = F.least(F.greatest(F.ceil(share * q), F.lit(1)), F.lit(q))
    factor = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1)
    d = ranks.rows.where(F.col("i").isin([names.index(v) for v in values]) & (F.shiftright("_here", c).bitwiseAND(F.lit(1)) == 1))
    return d.groupBy(factor.alias("factor"), ranks.by, bucket.alias("bucket")).agg(F.avg(target).alias("m"))
