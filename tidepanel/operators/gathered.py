"""Rank correlations of pairs of columns inside groups of rows that fit one task.

A row's values cross the network once, side by side, and a group's columns meet in one task, where each column is sorted
once and the ranks for every class of missing values come from that order.  Nothing is a row for a value and no rank leaves
its task, so the disk is that of the columns themselves.  A group too large for all columns is dealt as several sets
of columns that cover the pairs; one too large for a single pair is left to ``masked.py``, which deals by ranges of values.

NULL is the only missing value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import masked

TASK_VALUES = 8_000_000  # values that meet in one task
SHARE = 20_000  # values of a group for each partition: a large group seldom meets another one

Pairs = Sequence[tuple[str, str]]


def fits(most: int, columns: int = 2) -> bool:
    """Whether a group of ``most`` rows is gathered; ``columns`` are those that the widest pair reads."""
    return most * columns <= TASK_VALUES


def column_sets(pairs: Pairs, reads: Callable[[str], Sequence[str]], room: int) -> list[tuple[list[int], list[str]]]:
    """(numbers of pairs, their columns): every pair in one set, no set with more columns than ``room`` unless one pair has."""
    columns = [list(dict.fromkeys(c for x in p for c in reads(x))) for p in pairs]
    place = {c: i for i, c in enumerate(dict.fromkeys(c for cs in columns for c in cs))}
    block = max(1, room // 2)
    out: list[tuple[list[int], list[str]]] = []
    for p in sorted(range(len(pairs)), key=lambda p: sorted(place[c] // block for c in columns[p])):
        held = list(dict.fromkeys([*out[-1][1], *columns[p]])) if out else []
        if out and len(held) <= room:
            out[-1] = ([*out[-1][0], p], held)
        else:
            out.append(([p], columns[p]))
    return out


def _ranks(x: np.ndarray, order: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Average-tie ranks minus their mean among the rows of ``both``, zero elsewhere."""
    o = order[both[order]]
    v, n = x[o], len(o)
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    ends = np.append(starts[1:], n)
    out = np.zeros(len(x))
    out[o] = np.repeat((starts + ends - n) / 2.0, ends - starts)
    return out


def products(values: dict[str, np.ndarray], pairs: Pairs) -> np.ndarray:
    """For each pair sums of xy, xx and yy of centred ranks, and the rows that have both; NaN is missing."""
    here = {c: ~np.isnan(values[c]) for c in dict.fromkeys(c for p in pairs for c in p)}
    packed = {c: np.packbits(h).tobytes() for c, h in here.items()}
    number = {k: i for i, k in enumerate(dict.fromkeys(packed.values()))}
    order: dict[str, np.ndarray] = {}
    alike: dict[tuple[int, int], list[int]] = {}  # pairs whose columns have the same rows in common
    for i, (a, b) in enumerate(pairs):
        u, v = sorted((number[packed[a]], number[packed[b]]))
        alike.setdefault((u, v), []).append(i)
    out = np.zeros((len(pairs), 4))
    for members in alike.values():
        both = here[pairs[members[0]][0]] & here[pairs[members[0]][1]]
        n, ranks = int(both.sum()), {}
        for c in dict.fromkeys(c for i in members for c in pairs[i]):
            if c not in order:
                order[c] = np.argsort(values[c]).astype(np.int32)
            ranks[c] = _ranks(values[c], order[c], both)
        for i in members:
            x, y = (ranks[c] for c in pairs[i])
            out[i] = *(np.einsum("i,i->", u, v) for u, v in ((x, y), (x, x), (y, y))), n
    return out


def pair_sums(df: DataFrame, pairs: Pairs, most: int, by: str = "date", derived: dict[str, Sequence[str]] | None = None,
              derive: Callable[[dict[str, np.ndarray], list[str]], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """(group, _p, xy, xx, yy, names, rows) for each group and pair number; ``most`` bounds the rows of a group.

    A pair may name columns that ``derive`` computes from a group's columns where they have met; ``derived`` gives what each reads.
    """
    derived = derived or {}
    sets = column_sets(pairs, lambda c: derived.get(c, (c,)), max(2, TASK_VALUES // max(most, 1)))
    width = max(len(columns) for _, columns in sets)
    kind = df.schema[by].dataType.simpleString()
    value = lambda c: F.col(c).cast("double")
    if len(sets) == 1:
        key, rows = [by], df.select(by, *[value(c).alias(f"_v{j}") for j, c in enumerate(sets[0][1])])
    else:
        none = F.lit(None).cast("double")
        cells = [F.struct(F.lit(k).alias("_set"), *[(value(cs[j]) if j < len(cs) else none).alias(f"_v{j}") for j in range(width)]) for k, (_, cs) in enumerate(sets)]
        key, rows = [by, "_set"], df.select(by, F.explode(F.array(*cells)).alias("_e")).select(by, "_e.*")

    def meet(t: pa.Table) -> pa.Table:
        numbers, columns = sets[t.column("_set")[0].as_py() if len(sets) > 1 else 0]
        values = {c: t.column(f"_v{j}").to_numpy() for j, c in enumerate(columns)}
        mine = [pairs[p] for p in numbers]
        wanted = [c for c in dict.fromkeys(c for p in mine for c in p) if c in derived]
        if wanted:
            values |= derive(values, wanted)
        s = products(values, mine)
        k = len(numbers)
        group = pa.array([t.column(by)[0].as_py()] * k, t.schema.field(by).type)
        return pa.table({by: group, "_p": pa.array(np.array(numbers, np.int32)), "xy": s[:, 0].copy(), "xx": s[:, 1].copy(), "yy": s[:, 2].copy(),
                         "names": pa.array(s[:, 3].astype(np.int64)), "rows": pa.array(np.full(k, t.num_rows, np.int64))})

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1000, most * width // SHARE))
    return rows.repartition(parts, *key).groupBy(*key).applyInArrow(meet, f"`{by}` {kind}, _p int, xy double, xx double, yy double, names long, rows long")


def correlations(df: DataFrame, pairs: Pairs, min_names: int, most: int, by: str = "date") -> DataFrame:
    """(a, b, group, ic, names) of each pair as ``masked.pair_correlations`` gives it, gathered where groups fit."""
    if fits(most):
        return masked.named(pair_sums(df, pairs, most, by), pairs, by, min_names)
    return masked.pair_correlations(masked.masked_ranks(df, list(dict.fromkeys(c for p in pairs for c in p)), by), pairs, min_names)
