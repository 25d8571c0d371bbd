"""Interleaving sources to target weights by Pfair scheduling.

Rows of a source stand in hash order of their ids and are cut into blocks.  Block j of a source with
weight w out of W is released at slot floor(j W / w) and due at slot ceil((j + 1) W / w); each slot
goes to the released block with the earliest deadline.  The weights add up to W, so every deadline is
met and each source stays within one block of its target share at every slot.  When a source runs
out, the others share its weight from the next slot on, in a new phase; phase 0 is the mixture with
the target weights.

Row numbers come from ranges over all rows.  The schedule sees one entry for each block; a block holds
``1 / most_blocks`` of the rows, so its size follows the table and the schedule does not.

Cases: a null source is a source of its own; a source without a positive weight is not scheduled and has
nulls; equal ids are ordered arbitrarily but each row has its own place; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.operators.ranged import numbered

_SCHEDULE = "_source string, _block long, slot long, phase int, release long, deadline long, _first long"


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """(source, block, slot, phase, release, deadline) in slot order; weights are positive integers."""
    order = {s: i for i, s in enumerate(sorted(blocks, key=lambda s: (s is None, s)))}
    done, out, slot, phase = dict.fromkeys(blocks, 0), [], 0, 0
    live = [s for s in order if blocks[s]]
    while live:
        total, start = sum(weights[s] for s in live), slot
        waiting = [(start, order[s], s, 0) for s in live]
        heapq.heapify(waiting)
        ready: list[tuple] = []
        while True:
            while waiting and (waiting[0][0] <= slot or not ready):
                release, i, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (start - (-(j + 1) * total // weights[s]), i, s, j, release))
            deadline, i, s, j, release = heapq.heappop(ready)
            out.append((s, done[s], slot, phase, release, deadline))
            done[s] += 1
            slot += 1
            if done[s] == blocks[s]:
                break
            heapq.heappush(waiting, (start + (j + 1) * total // weights[s], i, s, j + 1))
        live = [s for s in live if done[s] < blocks[s]]
        phase += 1
    return out


def tempered(counts: dict, power: float) -> dict:
    """Target weights in proportion to a power of the sources' rows."""
    return {s: max(1, round(1_000_000 * (n / sum(counts.values())) ** power)) for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict | None = None, power: float = 0.7, most_blocks: int = 1 << 16, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, block, slot, phase, release, deadline and position in the whole mixture.

    ``weights`` maps a source to a positive integer; without it weights are ``tempered``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"))
    counts = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    goal = {s: w for s, w in (weights or tempered(counts, power)).items() if w > 0}
    each = max(1, -(-sum(counts.values()) // most_blocks))
    plan, first = [], 0
    for s, b, slot, phase, release, deadline in schedule({s: -(-n // each) for s, n in counts.items() if s in goal}, goal):
        plan.append((s, b, slot, phase, release, deadline, first))
        first += min(each, counts[s] - b * each)
    placed = numbered(rows, ["source"], [F.xxhash64("doc_id"), "doc_id"], "_row").withColumn("block", F.expr(f"_row div {each}"))
    table = F.broadcast(spark.createDataFrame(plan, _SCHEDULE))  # at most one row for each block and source
    got = placed.join(table, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    return got.select("doc_id", "source", "block", "slot", "phase", "release", "deadline", (F.col("_first") + F.col("_row") % each).alias("position"))


def _in_place(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The documents of ``found`` with their columns, in files and rows by position; rows with equal ids stand at the first place of any of them."""
    place = found.groupBy(F.col("doc_id").alias("_mixed_id")).agg(F.min("position").alias("_position"))
    got = docs.join(place, docs[doc_id].eqNullSafe(place["_mixed_id"]))
    return got.repartitionByRange(place["_position"]).sortWithinPartitions(place["_position"]).select(*[docs[c] for c in docs.columns])


def mixed_documents(docs: DataFrame, weights: dict | None = None, power: float = 0.7, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents of phase 0 with their columns, in files and rows by position: the longest mixture that has the target
    weights without repeating a document.  Rows with equal ids stand at the first place of any of them."""
    return _in_place(docs, mix(docs, weights, power, doc_id=doc_id, source=source).where("phase = 0"), doc_id)


def whole_mixture(docs: DataFrame, weights: dict | None = None, power: float = 0.7, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """All scheduled documents, of every phase, with their columns, in files and rows by position."""
    return _in_place(docs, mix(docs, weights, power, doc_id=doc_id, source=source).where("position is not null"), doc_id)


def in_file_order(docs: DataFrame, out: str) -> DataFrame:
    """Documents read from Parquet files, with the number of each row in the order of file names and rows; one row for each file is broadcast."""
    d = docs.select(*docs.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = d.groupBy("_file").agg(F.count("*").alias("_rows"))
    files = files.select("_file", (F.sum("_rows").over(W.orderBy("_file")) - F.col("_rows")).alias("_before"))
    return d.join(F.broadcast(files), "_file").withColumn(out, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
