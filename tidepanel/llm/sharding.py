"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

A group is all documents with equal text; it stays in one shard unless it is larger than a shard in
some dimension, when it is split by the documents' hash into pieces of an eighth of a shard.  Groups
with over ``1 / 2^14`` of the bytes, tokens or rows are items of their own, the rest are bundled by
hash into ``bundles`` items.  So the packing sees a bounded number of items whatever the input:
3 * 2^14 groups, their pieces and the bundles.  Items, largest first, go to the shard where the dot
product of their vector with the residual capacities is highest.

Cases: a null text has no bytes and is grouped with the empty ones; null and repeated ids are rows like
others; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.ranged import numbered
from tidepanel.operators.staging import materialize

DIMENSIONS = ("size", "tokens", "rows")


def place_items(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``items`` holds shares of the whole, one column for each dimension."""
    room = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        left = (room - items[i]).min(axis=1)
        out[i] = int(np.argmax(np.where(left >= 0, room @ items[i], left - 1e6)))  # where none has room, the least excess
        room[out[i]] -= items[i]
    return out


def shard(docs: DataFrame, shards: int = 8, bundles: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    ))
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    whole = [max(1, total[d] or 0) for d in DIMENSIONS]
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    share = F.greatest(*[F.col(d) / F.lit(float(n)) for d, n in zip(DIMENSIONS, whole, strict=True)])
    groups = materialize(groups.withColumn("share", share))
    heavy = groups.where(F.col("share") > 1 / (1 << 14)).collect()
    light = groups.where(F.col("share") <= 1 / (1 << 14)).groupBy(F.pmod("h1", F.lit(bundles)).alias("bundle"))
    light = light.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).collect()
    items, names = [], []
    for g in heavy:
        pieces = 1 if g.share * shards <= 1 else int(np.ceil(8 * g.share * shards))
        for piece in range(pieces):
            items.append([g[d] / n / pieces for d, n in zip(DIMENSIONS, whole, strict=True)])
            names.append((g.h1, g.h2, pieces, piece, None))
    for b in light:
        items.append([b[d] / n for d, n in zip(DIMENSIONS, whole, strict=True)])
        names.append((None, None, None, None, b.bundle))
    found = place_items(np.array(items).reshape(-1, len(DIMENSIONS)), shards).tolist()
    placed = [(*n, s) for n, s in zip(names, found, strict=True)]
    own = spark.createDataFrame([x for x in placed if x[4] is None], "h1 long, h2 long, pieces int, piece int, bundle long, own_shard int").drop("bundle")
    rest = spark.createDataFrame([(x[4], x[5]) for x in placed if x[4] is not None], "bundle long, rest_shard int")
    split = own.select("h1", "h2", "pieces").distinct()
    got = rows.join(F.broadcast(split), ["h1", "h2"], "left")
    got = got.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("pieces"))).cast("int"))
    got = got.join(F.broadcast(own.drop("pieces")), ["h1", "h2", "piece"], "left").withColumn("bundle", F.pmod("h1", F.lit(bundles)))
    got = got.join(F.broadcast(rest), "bundle", "left").withColumn("shard", F.coalesce("own_shard", "rest_shard"))
    got = numbered(got.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id"], "slot")
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
