"""A hash-chained ledger over trials, with planted faults for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ordering import position

SEGMENT = 64


def chained(t: DataFrame) -> DataFrame:
    """Sequence number, previous hash and hash per candidate and segment.

    A hash needs the one before it, so a chain is folded in order; it restarts every
    ``SEGMENT`` rows, which bounds the fold however long a record grows.
    """
    d = position(t.select("candidate", "trial", "level"), ["candidate"], ["trial"], "_n", keys=("trial",))
    d = d.withColumns({"segment": F.floor((F.col("_n") - 1) / SEGMENT), "seq": F.col("_n").cast("int")})
    item = F.struct("seq", "trial", "level", F.to_json(F.struct("level", "trial")).alias("canon"))
    g = d.groupBy("candidate", "segment").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    start = F.array().cast("array<struct<seq:int,trial:bigint,level:int,prev_hash:string,hash:string>>")

    def step(acc, x):
        prev = F.when(F.size(acc) > 0, F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))["hash"]).otherwise(F.lit(""))
        row = F.struct(x["seq"].alias("seq"), x["trial"].alias("trial"), x["level"].alias("level"), prev.alias("prev_hash"),
                       F.sha2(F.concat(prev, x["canon"]), 256).alias("hash"))
        return F.concat(acc, F.array(row))

    g = g.select("candidate", "segment", F.inline(F.aggregate("rows", start, step)))
    relinked, changed = F.col("trial") % 97 == 5, F.col("trial") % 89 == 7
    return g.select("candidate", "segment", "seq", "trial", F.when(changed, F.col("level") + 10).otherwise(F.col("level")).alias("level"),
                    F.when(relinked, F.lit("0")).otherwise(F.col("prev_hash")).alias("prev_hash"), "hash")
