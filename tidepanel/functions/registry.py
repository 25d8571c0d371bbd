"""Operators by name, with the arguments each takes.

Argument letters: x a series, e a series or a constant, w a window, c a constant.
Time-series and element-wise operators are Column builders; cross-section ones map
a DataFrame to a DataFrame with one more column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidepanel.functions import columns as C
from tidepanel.operators import cross as X
from tidepanel.operators import rolling as R

# Windows a factor may use.
WINDOWS = (2, 3, 5, 10, 20, 40, 60, 120, 250)


@dataclass(frozen=True)
class Operator:
    name: str
    fn: Callable
    args: str
    kind: str

    def __call__(self, *args):
        if len(args) != len(self.args):
            raise ValueError(f"{self.name} takes {len(self.args)} arguments")
        for a, k in zip(args, self.args, strict=True):
            if k == "w" and (not isinstance(a, int) or a not in WINDOWS):
                raise ValueError(f"{self.name}: window must be one of {WINDOWS}")
            if k == "c" and not isinstance(a, (int, float)):
                raise ValueError(f"{self.name}: a constant is required")
            if k == "x" and isinstance(a, (int, float)):
                raise ValueError(f"{self.name}: a series is required")
        return self.fn(*args)


OPERATORS: dict[str, Operator] = {}


def register(name: str, fn: Callable, args: str, kind: str) -> None:
    OPERATORS[name] = Operator(name, fn, args, kind)


for _n, _f in {"ts_mean": R.ts_mean, "ts_std": R.ts_std, "ts_sum": R.ts_sum, "ts_max": R.ts_max, "ts_min": R.ts_min,
               "ts_rank": R.ts_rank, "ts_delta": R.ts_delta, "ts_delay": R.ts_delay, "ts_zscore": R.ts_zscore,
               "ts_decay_linear": R.ts_decay_linear}.items():
    register(_n, _f, "xw", "ts")
register("ts_corr", R.ts_corr, "xxw", "ts")
register("ts_cov", R.ts_cov, "xxw", "ts")
for _n, _f in {"abs": C.abs_, "log": C.log_, "sqrt": C.sqrt_, "sign": C.sign, "neg": C.neg}.items():
    register(_n, _f, "e", "element")
for _n, _f in {"add": C.add, "sub": C.sub, "mul": C.mul, "div": C.div, "max2": C.max2, "min2": C.min2, "gt": C.gt,
               "lt": C.lt, "ge": C.ge, "le": C.le}.items():
    register(_n, _f, "ee", "element")
register("signed_power", C.signed_power, "xc", "element")
register("fill_na", C.fill_na, "xc", "element")
register("where", C.where, "xee", "element")
register("cs_rank", lambda x, out: lambda df: X.cs_rank(df, x, out), "xx", "cs")
register("cs_zscore", lambda x, out: lambda df: X.cs_zscore(df, {out: x}), "xx", "cs")
register("cs_demean", lambda x, out: lambda df: X.cs_demean(df, {out: x}), "xx", "cs")
register("cs_winsorize", lambda x, out: lambda df: X.cs_winsorize(df, {out: x}), "xx", "cs")
register("cs_neutralize", lambda x, size, out: lambda df: X.cs_neutralize(df, {out: x}, size), "xxx", "cs")
register("group_rank", lambda x, out: lambda df: X.group_rank(df, x, out), "xx", "cs")
register("group_demean", lambda x, out: lambda df: X.group_demean(df, x, out), "xx", "cs")
