"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Only vectors with equal, non-null labels (and as many components) are compared, by cosine in double
precision.  Equal vectors are one node with a count, so a vector that holds a third of the rows is one
node.  Labels with more than ``cell_rows`` nodes are divided into cells around centroids fitted on a
bounded sample of ``sample`` nodes; there are at most ``most_cells`` centroids in all, so what tasks
receive is bounded.

Every node is compared in its own cell and visits each other cell that may hold a neighbour: with unit
vectors x and centroids a (its own) and b, a vector of cell b is at least asin(x . (a - b) / |a - b|) away, so
x visits b where that is within the link angle, if a precedes b.  No linked pair is missed.

A cell is compared in blocks of some ``block`` rows, one group for each pair of blocks, so no task holds a
whole cell.  A group returns link counts, and of its links a spanning forest: enough for the components,
while the counts keep every link.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, are
returned with no link and as their own component; repeated rows are equal vectors and link; a null vec_id is
linked but never a component's smallest id unless there is no other; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import connected_components
from tidepanel.operators.staging import materialize


@dataclass(frozen=True)
class Setting:
    threshold: float = 0.98
    cell_rows: int = 512
    most_cells: int = 4096
    sample: int = 32_768
    rounds: int = 8
    block: int = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k unit centroids (fewer if cells run empty), from evenly spaced rows."""
    c = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        size = np.linalg.norm(total, axis=1)
        c = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def _matrix(column, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _cells(nodes: DataFrame, setting: Setting) -> dict[tuple, tuple[int, np.ndarray]]:
    """Centroids by (label, dimension) and the number of the first, for groups larger than a cell."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = nodes.count()
    least = max(setting.cell_rows, -(-total // setting.most_cells))
    large = sizes.where(F.col("n") > least).collect()  # fewer than most_cells groups
    if not large:
        return {}
    share = min(1.0, setting.sample / sum(r.n for r in large))
    unit_hash = F.shiftrightunsigned(F.xxhash64("v", F.lit(5)), 11) / F.lit(float(1 << 53))
    picked = nodes.where(unit_hash < share).select("label", "dim", "v")
    names = nodes.sparkSession.createDataFrame([(r.label, r.dim) for r in large], nodes.select("label", "dim").schema)
    rows: dict[tuple, list] = {}
    for r in picked.join(F.broadcast(names), ["label", "dim"], "left_semi").orderBy(F.xxhash64("v")).toLocalIterator():
        rows.setdefault((r.label, r.dim), []).append(r.v)
    out, first = {}, 0
    for r in large:
        v = rows.get((r.label, r.dim))
        if v:
            c = spherical_kmeans(unit(np.array(v, np.float64)), -(-r.n // least), setting.rounds)
            out[(r.label, r.dim)] = (first, c)
            first += len(c)
    return out


def _forest(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of links that join parts not yet joined."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    keep = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            keep.append(i)
    return keep


def near_vectors(rows: DataFrame, setting: Setting = Setting(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id and kept (it represents its component)."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)), F.col("v")))
    nodes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}))
    cells = _cells(nodes, setting)
    sent = rows.sparkSession.sparkContext.broadcast(cells)
    reach = float(np.sqrt(max(0.0, 1 - setting.threshold**2))) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cell, home = [], [], []
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                by.setdefault(key, []).append(i)
            for key, own in by.items():
                if key not in sent.value:
                    at += own
                    cell += [-1] * len(own)
                    home += [True] * len(own)
                    continue
                first, c = sent.value[key]
                x = _matrix(b.column(4).take(pa.array(own)), key[1])
                near = x @ c.T
                best = near.argmax(axis=1)
                gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[best]
                visit = (near[np.arange(len(x)), best][:, None] - near <= reach * gap + 1e-12) & (np.arange(len(c)) > best[:, None])
                i, k = np.nonzero(visit)
                own = np.array(own)
                at += [*own.tolist(), *own[i].tolist()]
                cell += [*(best + first).tolist(), *(k + first).tolist()]
                home += [True] * len(own) + [False] * len(i)
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(at, pa.int64())) for j in range(5)), pa.array(cell, pa.int64()), pa.array(home, pa.bool_())], ["label", "dim", "node", "copies", "v", "cell", "home"])

    schema = nodes.select("label", "dim", "node", "copies", "v").schema.add("cell", "long").add("home", "boolean")
    placed = materialize(nodes.select("label", "dim", "node", "copies", "v").mapInArrow(assign, schema))
    group = ["label", "dim", "cell"]
    blocks = placed.groupBy(*group).agg(*[F.ceil(F.count(F.when(F.col("home") == h, 1)) / setting.block).cast("int").alias(n) for h, n in ((True, "homes"), (False, "visits"))])
    dealt = placed.join(blocks, group)
    own = F.pmod(F.xxhash64("node", F.lit(9)), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits"))).cast("int")
    # Pairs of blocks: home i with home j (i <= j), home i with visiting block j (counted on from the homes).
    dealt = dealt.withColumn("own", own + F.when(F.col("home"), 0).otherwise(F.col("homes")))
    others = F.when(F.col("home"), F.sequence(F.lit(0), F.col("homes") + F.col("visits") - 1)).otherwise(F.when(F.col("homes") > 0, F.sequence(F.lit(0), F.col("homes") - 1)))
    dealt = dealt.withColumn("other", F.explode(others)).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(t: pa.Table) -> pa.Table:
        dim, i, j = (t.column(n)[0].as_py() for n in ("dim", "i", "j"))
        own, node, copies = (t.column(n).to_numpy() for n in ("own", "node", "copies"))
        x = _matrix(t.column("v"), dim)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        hit = x[a] @ x[b].T >= setting.threshold
        if i == j:
            np.fill_diagonal(hit, False)
        links = np.zeros(len(own), np.int64)
        links[a] += hit @ copies[b]
        if i != j:
            links[b] += hit.T @ copies[a]
        p, q = np.nonzero(np.triu(hit) if i == j else hit)
        p, q = node[a[p]], node[b[q]]
        keep = _forest(p, q)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(np.append(node[some], p[keep])), "peer": pa.array([None] * len(some) + q[keep].tolist(), pa.int64()), "links": pa.array(np.append(links[some], np.zeros(len(keep), np.int64)))})

    found = materialize(dealt.select("label", "dim", "cell", "i", "j", "own", "node", "copies", "v").groupBy("label", "dim", "cell", "i", "j").applyInArrow(compare, "node long, peer long, links long"))
    links = found.where("peer is null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    info = nodes.select("label", "v", "node", "first_id", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    info = materialize(info)
    least = info.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = info.join(least, "component").select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    got = rows.join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
