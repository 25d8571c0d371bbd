"""Factor values kept by the signature of the panel they were computed on and by the definition of the factor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans.factors import Factor, definition, evaluate, to_long

SCHEMA = "date date, code long, value float, factor string, definition string"


def panel_signature(panel: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("code", "date")) -> str:
    """Hash of the panel's rows in any order: a change of any listed field changes it.  List derived fields that definitions use by name."""
    row = F.xxhash64(*keys, *fields)
    got = panel.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s"))
    return got.select(F.sha2(F.concat_ws("|", F.lit(",".join(fields)), "n", "x", "s"), 256).alias("h")).first().h[:32]


def store_factors(long: DataFrame, root: str, signature: str, definitions: Mapping[str, str]) -> None:
    """Write (factor, date, code, value as float) under the definitions given by name; what is stored under the same definition is replaced, all else stays."""
    spark = long.sparkSession
    names = F.create_map(*[F.lit(x) for pair in definitions.items() for x in pair])
    rows = long.where(F.col("factor").isin(*definitions)).select("date", "code", F.col("value").cast("float").alias("value"), "factor", names[F.col("factor")].alias("definition"))
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("factor", "definition").parquet(f"{root}/{signature}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def _stored(spark: SparkSession, root: str, signature: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(f"{root}/{signature}")
    except Exception as e:  # noqa: BLE001 - only a missing folder means that nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def load_factors(spark: SparkSession, root: str, signature: str, definitions: Mapping[str, str]) -> DataFrame:
    """Stored (factor, date, code, value) of the named factors under exactly these definitions; only their folders are read."""
    keys = [F.struct(F.lit(k), F.lit(v)) for k, v in definitions.items()]
    return _stored(spark, root, signature).where(F.struct("factor", "definition").isin(*keys)).select("factor", "date", "code", "value")


def through_store(panel: DataFrame, factors: Sequence[Factor], root: str, signature: str) -> DataFrame:
    """Values of all ``factors``; those without stored values under their present definition are computed and stored first."""
    spark, wanted = panel.sparkSession, {f.name: definition(f) for f in factors}
    known = {(r.factor, r.definition) for r in _stored(spark, root, signature).select("factor", "definition").distinct().collect()}  # of the registry's size
    missing = [f for f in factors if (f.name, wanted[f.name]) not in known]
    if missing:
        store_factors(to_long(evaluate(panel, missing), missing, ["date", "code"]), root, signature, {f.name: wanted[f.name] for f in missing})
    return load_factors(spark, root, signature, wanted)
