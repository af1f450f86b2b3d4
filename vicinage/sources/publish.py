"""Publishing: content hashes, manifests, staged releases, fingerprinted checkpoints, event logs and reports.

Small files (manifests, logs, reports) go through Hadoop's file system, so every
path that Spark can read will do.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NULL = "\u0000"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def row_digest(cols: list[Column]) -> Column:
    """Hash of a row as an integer of 32 bits, from the exact text of its columns."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(_NULL)) for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, digest): the same for the same rows in any order and any files; no column order but the frame's own.

    Sums of row hashes merge in any order, so no sort is needed.
    """
    cells = [F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(row_digest(cells).alias("_d")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_d"), F.lit(0)).alias("digest"))


def manifest(tables: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(name, role, columns, rows, digest), one row per named (role, table)."""
    out = None
    for name, (role, df) in sorted(tables.items()):
        one = content_hash(df).select(F.lit(name).alias("name"), F.lit(role).alias("role"), F.lit(",".join(df.columns)).alias("columns"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def hash_gate(found: DataFrame, frozen: DataFrame) -> DataFrame:
    """(name, status) against a frozen manifest: OK, CHANGED, MISSING or UNREGISTERED."""
    a, b = found.select("name", "rows", "digest"), frozen.select("name", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    status = F.when(F.col("rows").isNull(), "MISSING").when(F.col("_rows").isNull(), "UNREGISTERED").when((F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest")), "OK").otherwise("CHANGED")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: to a name of its own, then renamed; an existing one is an error."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(temp, p):
        fs.delete(temp, False)
        raise FileExistsError(path)


def _plain(v):
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    return None if isinstance(v, float) and not math.isfinite(v) else v


def write_json(spark: SparkSession, path: str, value: object, nulled: bool = False) -> None:
    """JSON with sorted keys; numbers that are not finite are an error, or null with ``nulled``."""
    write_small(spark, path, json.dumps(_plain(value) if nulled else value, sort_keys=True, indent=1, allow_nan=False) + "\n")


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables or none: staged beside ``path``, renamed one by one, the manifest last.

    Readers take a release as complete by its manifest.  A run that stopped half
    way is taken up again: tables already in place stay if their content is the
    same.  A complete release is never overwritten.
    """
    if exists(spark, f"{path}/MANIFEST.json"):
        raise FileExistsError(path)
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    hashes = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{stage}/{name}")
        hashes[name] = content_hash(spark.read.parquet(f"{stage}/{name}")).first().asDict()
    fs, root = _fs(spark, path)
    fs.mkdirs(root)
    for name in sorted(tables):
        _, there = _fs(spark, f"{path}/{name}")
        if fs.exists(there):
            if content_hash(spark.read.parquet(f"{path}/{name}")).first().asDict() == hashes[name]:
                continue
            raise FileExistsError(f"{path}/{name}")
        if not fs.rename(_fs(spark, f"{stage}/{name}")[1], there):
            raise OSError(f"cannot publish {name}")
    fs.delete(_fs(spark, stage)[1], True)
    write_json(spark, f"{path}/MANIFEST.json", hashes)


def checkpointed(spark: SparkSession, path: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was finished under this fingerprint, else built anew; another fingerprint's is replaced."""
    mark = f"{path}.fingerprint"
    if exists(spark, mark) and read_small(spark, mark).strip() == fingerprint:
        return spark.read.parquet(path)
    fs, p = _fs(spark, mark)
    fs.delete(p, False)
    build().write.mode("overwrite").parquet(path)
    write_small(spark, mark, fingerprint)
    return spark.read.parquet(path)


def append_event(spark: SparkSession, path: str, event: str, **counters: int) -> None:
    """Append one event with its counters to a log of JSON lines; events are never changed."""
    row = spark.range(1).select(F.lit(event).alias("event"), F.current_timestamp().alias("at"), F.create_map(*[F.lit(x) for k, v in sorted(counters.items()) for x in (k, int(v))]).cast("map<string,bigint>").alias("counters") if counters else F.lit(None).cast("map<string,bigint>").alias("counters"))
    row.coalesce(1).write.mode("append").json(path)


def ledger_gate(events: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(counter, expected, found, ok): summed counters of a log against what they must be; counters not expected must be 0."""
    found = events.select(F.explode("counters").alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("found"))
    want = events.sparkSession.createDataFrame(sorted(expected.items()), "counter string, expected long")
    both = want.join(found, "counter", "full_outer").select("counter", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.withColumn("ok", F.col("expected") == F.col("found"))


def report(title: str, metrics: DataFrame, most: int = 10_000) -> str:
    """Markdown of a small table of metrics, in the order of its first column; more rows than ``most`` are an error."""
    got = metrics.orderBy(metrics.columns[0]).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else format(v, ".6g") if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + "-|" * len(metrics.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in got)]) + "\n"


def exact_text(c: Column) -> Column:
    """A double as text that reads back as the same bits."""
    return c.cast("string")


def same_bits(a: Column, b: Column) -> Column:
    """Whether two doubles have the same bits (all NaN count as one): the exact text tells -0.0 from 0.0."""
    return exact_text(a).eqNullSafe(exact_text(b))
