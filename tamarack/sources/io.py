"""Sources and sinks: delimited files with embedded line breaks, catalogued releases, JSON lines, images' bytes,
validated Parquet, an answer cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.text import blank_to_null
from tamarack.operators.corpus import TableSpec, validate


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a CSV whose cells may hold line breaks, all strings, blank as null. Missing columns are named."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{missing} not in {df.columns}")
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in columns])


def melt_labels(wide: DataFrame, key: str, concepts: Sequence[str]) -> DataFrame:
    """(key, concept, raw): one row per concept, nulls included."""
    return wide.select(key, *[F.col(f"`{c}`").cast("string").alias(c) for c in concepts]).unpivot([key], list(concepts), "concept", "raw")


def read_label_lines(spark: SparkSession, path: str, key: str, concepts: Sequence[str]) -> DataFrame:
    """The same from JSON lines; a key that isn't there is null. Broken lines are an error."""
    schema = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in concepts]])
    return melt_labels(spark.read.schema(schema).option("mode", "FAILFAST").json(path), key, concepts)


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path) of files below a folder, relative to it; the files' contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    return df.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("path"))


def read_catalog(spark: SparkSession, path: str) -> dict[str, tuple[list[str], int]]:
    """{file: (columns, rows)} from a pipe-delimited catalog: file, description, columns, number of columns, rows."""
    out = {}
    for r in spark.read.text(path).collect():
        f = r.value.split("|")
        out[f[0]] = (f[2].split(","), int(f[4]))
    return out


def read_delimited(spark: SparkSession, folder: str, name: str, catalog: dict[str, tuple[list[str], int]], columns: Sequence[str]) -> DataFrame:
    """Columns of a catalogued pipe-delimited file without header or quoting; every line ends with a delimiter. A line
    of another width than the catalog's is an error when it is read."""
    named, _ = catalog[name]
    parts = F.split("value", r"\|")
    good = F.when(F.size(parts) == len(named) + 1, parts).otherwise(F.raise_error(F.concat(F.lit(f"{name}: width "), F.size(parts).cast("string"))).cast("array<string>"))
    return spark.read.text(f"{folder}/{name}").select(good.alias("p")).select(*[F.col("p")[named.index(c)].alias(c) for c in columns])


def write_validated(df: DataFrame, spec: TableSpec, path: str, partition_by: Sequence[str] = ()) -> None:
    """Writes Parquet if the contract holds; the committer makes it visible as a whole or not at all."""
    writer = validate(df, spec).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def latest_answers(log: DataFrame, key: str, answer: str, seq: str) -> DataFrame:
    """(key, answer): the latest record that has an answer, of an append-only log; errors never win."""
    return log.where(F.col(answer).isNotNull()).groupBy(key).agg(F.max_by(answer, F.struct(seq, answer)).alias(answer))


def to_do(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Items without a cached answer."""
    return items.join(cache.select(key).distinct(), key, "left_anti")


def upsert_reviews(proposed: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored decisions survive: a known row keeps review and note, a new one takes the proposal, and stored rows
    that aren't proposed again stay. Both have (*keys, review, note)."""
    s = stored.select(*keys, F.col("review").alias("_r"), F.col("note").alias("_n"), F.lit(True).alias("_known"))
    merged = proposed.join(s, list(keys), "left").select(
        *keys, F.when(F.col("_known"), F.col("_r")).otherwise(F.col("review")).alias("review"), F.when(F.col("_known"), F.col("_n")).otherwise(F.col("note")).alias("note")
    )
    return merged.unionByName(stored.select(*keys, "review", "note").join(proposed.select(*keys), list(keys), "left_anti"))
