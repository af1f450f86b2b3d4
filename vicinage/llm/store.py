"""Written tables in the folder that all executors share, to cut lineage and to reuse costly passes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on one machine (tests), a new temporary one.

    Unset on a cluster, it is an error: executors do not see each other's folders.
    """
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vicinage-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    A lost executor then costs a reread of finished files, not a rerun of all
    that came before.  ``release`` removes what a session has written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vicinage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's written tables; results that still read them must have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/vicinage/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until the table has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which are meant to be set in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in ``order``, with no task that holds a whole key.

    Rows are dealt by range over (keys, order), so a key that holds a third of
    all rows is spread over a third of the tasks.  Each task numbers its own
    rows; a table of one row per (task, key) then gives each task its start.
    """
    spark = df.sparkSession
    n = parts(spark)
    dealt = materialize(
        df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id() % F.lit(1 << 33)), "dealt"
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    from pyspark.sql import Window

    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    on = F.col("_part") == F.col("_p")
    for s in same:
        on = on & s
    return dealt.join(starts, on).withColumn(out, F.col("_start") + F.col("_mono") - F.col("_first")).drop("_part", "_mono", "_p", "_first", "_start", *[f"_{k}" for k in keys])
