"""Order-free comparison of two result frames."""

import math

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows(df):
    cols = sorted(df.columns)
    return cols, [tuple(norm(v) for v in t) for t in df[cols].astype(object).itertuples(index=False, name=None)]


def key(t):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "n",
                  round(v, 3) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in t)


def compare(a, b):
    ca, ra = rows(a)
    cb, rb = rows(b)
    if ca != cb:
        return f"columns differ {set(ca) ^ set(cb)}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} vs {len(rb)}"
    ra.sort(key=key)
    rb.sort(key=key)
    bad, exact = 0, 0
    first = None
    for x, y in zip(ra, rb):
        for c, u, v in zip(ca, x, y):
            if u == v and (u is None) == (v is None):
                continue
            if isinstance(u, (int, float)) and isinstance(v, (int, float)) and not isinstance(u, bool):
                if abs(u - v) <= 1e-9 * max(1.0, abs(u)):
                    exact += 1
                    continue
            bad += 1
            first = first or (c, u, v, x, y)
    if bad:
        return f"{bad} cells differ, first {first}"
    return f"ok{' (' + str(exact) + ' cells inexact)' if exact else ''}" if ra else "EMPTY"
