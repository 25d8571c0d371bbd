"""Arithmetic formulas over named columns."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions a formula may call and what they are called in SQL.
ALLOWED = {"min": "least", "max": "greatest", "abs": "abs"}
_NAME = re.compile(r"[A-Za-z_]\w*")
_SHAPE = re.compile(r"[\w\s+\-*/^(),.]*")


def formula(text: str, names) -> F.Column:
    """Column for ``text``: numbers, the given names, + - * / ^, min, max and abs."""
    if not _SHAPE.fullmatch(text):
        raise ValueError("a formula holds only names, numbers and + - * / ^ ( ) ,")
    unknown = [n for n in _NAME.findall(text) if n not in names and n not in ALLOWED]
    if unknown:
        raise ValueError(f"unknown names in formula: {unknown}")
    sql = _NAME.sub(lambda m: ALLOWED.get(m[0], m[0]) if m[0] not in names else f"`{m[0]}`", text)
    sql = re.sub(r"(`?\w+`?|\))\s*\^\s*(`?[\w.]+`?)", r"power(\1, \2)", sql)
    return F.expr(sql)


def scenario_values(df: DataFrame, key: str, text: str, names, scenarios: dict[str, dict[str, float]]) -> DataFrame:
    """Value of the formula per row and scenario (factors on parameters) and its gap to the unscaled value."""
    table = F.array(*[
        F.struct(F.lit(sc).alias("scenario"), *[F.lit(float(f.get(n, 1.0))).alias(n) for n in names])
        for sc, f in scenarios.items()
    ])
    d = df.withColumn("_base", formula(text, names)).withColumn("_s", F.explode(table))
    d = d.select(key, "_base", F.col("_s.scenario").alias("scenario"), *[(F.col(n) * F.col(f"_s.{n}")).alias(n) for n in names])
    d = d.withColumn("value", formula(text, names))
    return d.select(key, "scenario", "value", (F.col("value") - F.col("_base")).alias("impact"))
