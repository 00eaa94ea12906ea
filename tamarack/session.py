"""Session helpers: lineage cuts that survive lost executors, skew-aware joins, table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where it is unset (tests, local
    mode) a folder of this machine is made."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tamarack-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table or checkpoint, wherever the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(cut_df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more: what came of it has been checkpointed itself."""
    file = cut_df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(cut_df.sparkSession, file.get())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, *, how: str = "left", salts: int = 16, share: float = 1 / 64, counts: DataFrame | None = None
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique in ``key``), splitting keys that hold more than ``share`` of
    ``rows`` over ``salts`` tasks. At most ``1/share`` keys can be that hot, so their list has a proven
    size and is broadcast. Rows with a null key match nothing. counts: (key, count) where it is known."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count() if counts is None else counts.select(key, "count")
    total = counts.agg(F.sum("count").alias("_total"))
    hot = (
        counts.crossJoin(F.broadcast(total))
        .where(F.col("count") > F.greatest(F.col("_total") * share, F.lit(10_000)))
        .select(F.col(key).alias("_hot_key"))
    )
    hot = F.broadcast(hot)
    left = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    right = (
        lookup.join(hot, F.col(key) == F.col("_hot_key"), "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot_key")
    )
    return left.drop("_hot_key").join(right, [key, "_salt"], how).drop("_salt")


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """rows with, for every name in ``values``, the sum over the rows of the same group that come earlier (0 for the first).
    No group is gathered: rows are range-partitioned by group and order and written, sums run within the parts
    of a group, and what lies in its earlier parts is added, from a table of at most a row per group and part. The
    order must be total; columns of ``by`` may be null, or there may be none."""
    by = list(by)
    keyed = rows.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    part = ["_part", *by]
    placed = cut(keyed.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values])
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.struct(*part).alias("_at"), *[F.coalesce(F.sum(f"_v_{n}").over(over), F.lit(0)).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_at", F.struct(*part)).select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in values])
    return summed.join(offsets, summed["_at"].eqNullSafe(offsets["_at"])).select(*rows.columns, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
