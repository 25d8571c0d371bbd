"""Ranks for every pattern of missing values against brute force on each pair."""

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import masked


def table(seed, n=600, groups=3):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"g": rng.integers(0, groups, n)})
    d["a"] = rng.normal(size=n)
    d["b"] = rng.integers(0, 4, n).astype(float)  # heavy ties
    d["c"] = d["a"] + rng.normal(size=n)
    d["same"] = -d["c"]
    d["flat"] = 1.0
    d["y"] = d["a"] * 0.5 + rng.normal(size=n)
    d.loc[rng.random(n) < 0.3, "a"] = np.nan
    gone = rng.random(n) < 0.5
    d.loc[gone, ["c", "same"]] = np.nan
    d.loc[d["g"] == 2, "y"] = np.nan
    d["zero"] = np.where(rng.random(n) < 0.5, 0.0, -0.0)
    d["none"] = np.nan
    return d


COLUMNS = ["a", "b", "c", "same", "flat", "y", "zero", "none"]


def brute(d, x, y, least):
    out = {}
    for g, t in d.groupby("g"):
        t = t[[x, y]].dropna().rank()
        if len(t):
            ok = len(t) >= least and t[x].nunique() > 1 and t[y].nunique() > 1
            out[g] = (round(float(np.corrcoef(t[x], t[y])[0, 1]), 9) if ok else None, len(t))
    return out


def frame(spark, d):
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in d.to_numpy().tolist()]
    return spark.createDataFrame([(int(r[0]), *r[1:]) for r in rows], "g int, " + ", ".join(f"{c} double" for c in d.columns[1:]))


@pytest.mark.parametrize("seed,partition,piece", [(1, 500_000, 20_000), (2, 60, 25), (3, 7, 1000)])
def test_pairs_match_brute_force(spark, monkeypatch, seed, partition, piece):
    """With small partitions a group, and one tied value, fills many of them; small slices are summed."""
    monkeypatch.setattr(masked, "PARTITION_ROWS", partition)
    monkeypatch.setattr(masked, "SLICE_ROWS", piece)
    d = table(seed, 300 if partition < 10 else 600)
    pairs = [(x, y) for i, x in enumerate(COLUMNS) for y in COLUMNS[:i]]
    ranks = masked.masked_ranks(frame(spark, d), COLUMNS, "g")
    assert ranks.classes[2] == ranks.classes[3] and ranks.classes[1] == ranks.classes[4] == ranks.classes[6] and len(set(ranks.classes)) == 5
    got = {}
    for r in masked.pair_correlations(ranks, pairs, 20).collect():
        got.setdefault((r.a, r.b), {})[r.g] = (None if r.ic is None else round(r.ic, 9), r.names)
    want = {p: w for p in pairs if (w := brute(d, *p, 20))}
    assert got == want


@pytest.mark.parametrize("partition", [500_000, 50])
def test_buckets_match_brute_force(spark, monkeypatch, partition):
    monkeypatch.setattr(masked, "PARTITION_ROWS", partition)
    d = table(5)
    ranks = masked.masked_ranks(frame(spark, d), ["a", "b", "y"], "g", carry=["y"])
    got = {(r.factor, r.g, r.bucket): round(r.m, 9) for r in masked.buckets(ranks, ["a", "b"], "y", 5).collect()}
    want = {}
    for x in ("a", "b"):
        for g, t in d.groupby("g"):
            t = t[[x, "y"]].dropna()
            b = np.clip(np.ceil(t[x].rank(pct=True) * 5), 1, 5)
            want |= {(x, g, int(k)): round(float(v), 9) for k, v in t["y"].groupby(b).mean().items()}
    assert got == want


def test_no_rows(spark):
    d = spark.createDataFrame([], "g int, a double, b double")
    ranks = masked.masked_ranks(d, ["a", "b"], "g", carry=["b"])
    assert masked.pair_correlations(ranks, [("a", "b")], 1).count() == 0 and masked.buckets(ranks, ["a"], "b", 3).count() == 0


def test_rows_are_not_shuffled_to_meet_their_summaries(spark):
    """Only summaries are small by contract, whatever the optimiser knows; a factor carries the ranks of its target's class alone."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ranks = masked.masked_ranks(frame(spark, table(4)), COLUMNS, "g")
        ic = masked.pair_correlations(ranks, [(c, "b") for c in ("a", "c", "same")], 20)
        plan = ic._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        d, got = table(4), {}
        for r in ic.collect():
            got.setdefault(r.a, {})[r.g] = (None if r.ic is None else round(r.ic, 9), r.names)
        assert got == {c: brute(d, c, "b", 20) for c in ("a", "c", "same")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
