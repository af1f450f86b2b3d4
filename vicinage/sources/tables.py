"""Scans with checked schemas, registries, and sinks with stated headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(df: DataFrame, want: StructType) -> DataFrame:
    """The wanted columns, or an error naming what is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    bad = [f"{f.name}: want {f.dataType.simpleString()}, have {have[f.name].simpleString() if f.name in have else 'none'}" for f in want if have.get(f.name) != f.dataType]
    if bad:
        raise ValueError("; ".join(bad))
    return df.select(*want.names)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_registry(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The objects of a JSON document's array ``field``, one row each."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def strict(text: Column, kind: str) -> Column:
    """A cast that fails on wrong text (empty text is null)."""
    t = F.trim(text)
    return F.when(t == "", F.lit(None)).otherwise(F.coalesce(t.try_cast(kind), F.when(t.isNotNull(), F.raise_error(F.concat(F.lit(f"not a {kind}: "), t)).cast(kind))))


def write_union(parts: list[DataFrame], path: str) -> None:
    """CSV whose header is the union of the parts' columns, nested cells as JSON."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    cells = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in out.schema]
    out.select(*cells).write.mode("errorifexists").option("header", True).csv(path)
