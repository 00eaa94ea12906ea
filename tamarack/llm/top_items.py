"""Top N items within every group, by statistics-guided skipping.

Rows are clustered once: range-partitioned and sorted by group and descending score, and written with small
row groups, so that a large group spreads over many tasks and its best items stand in its first row group.
The row groups' statistics (group range, highest score) are then read from the files' footers. Row groups
of one and the same group form a chain that is read in descending order of the highest score, until that lies
strictly below the group's N-th score so far; row groups with several groups are read once each. What the
chains return is at most N rows for each group and chain, and is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import cut, remove, scratch

NONE, SEP = "\x01", "\x02"


def group_key(columns: list[str]) -> Column:
    """One sortable string of the group's columns; null stands for itself."""
    return F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in columns])


def _open(uri: str) -> pq.ParquetFile:
    for hadoop in ("s3a://", "s3n://"):  # Hadoop's names for s3
        uri = uri.replace(hadoop, "s3://", 1) if uri.startswith(hadoop) else uri
    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path))


def write_clustered(rows: DataFrame, groups: list[str], item: str, score: str, *, row_group_bytes: int) -> str:
    """Writes (grp, item, score) clustered by group and descending score; returns the path. Rows whose score is
    null, NaN or infinite or whose item is null are left out."""
    s = F.col(score).cast("double")
    path = scratch(rows.sparkSession, "clustered")
    (
        rows.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & F.col(item).isNotNull())
        .select(group_key(groups).alias("grp"), F.col(item).alias("item"), (s + 0.0).alias("score"))
        .repartitionByRange(F.col("grp"), F.col("score").desc())
        .sortWithinPartitions("grp", F.col("score").desc(), "item")
        .write.option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )
    return path


def row_groups(spark, path: str) -> DataFrame:
    """(file, rg, chain, highest): what the footers tell of every row group."""
    files = spark.read.parquet(path).inputFiles()

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for uri in b.column(0).to_pylist():
                meta = _open(uri).metadata
                for i in range(meta.num_row_groups):
                    rg = meta.row_group(i)
                    columns = {rg.column(k).path_in_schema: rg.column(k).statistics for k in range(rg.num_columns)}
                    g, s = columns["grp"], columns["score"]
                    known = g is not None and g.has_min_max and s is not None and s.has_min_max
                    single = known and g.min == g.max
                    out.append((uri, i, f"g{g.min}" if single else f"f{uri}#{i}", float(s.max) if known else float("inf")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.float64()))],
            names=["file", "rg", "chain", "highest"],
        )

    at = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return at.mapInArrow(footers, "file string, rg int, chain string, highest double")


def best_of_chain(found: list[tuple[float, str, int]], n: int, *, single: bool) -> tuple[pd.DataFrame, int]:
    """(grp, item, score) of the n best items of each group in row groups (highest score, file, number), and how many
    row groups were read. In a chain of one group those strictly below its n-th score so far are skipped."""
    opened: dict[str, pq.ParquetFile] = {}
    kept, read = None, 0
    for highest, uri, rg in sorted(found, key=lambda r: (-r[0], r[1], r[2])):
        if single and kept is not None and len(kept) >= n and highest < kept["score"].iloc[n - 1]:
            break
        if uri not in opened:
            opened = {uri: _open(uri)}
        part = opened[uri].read_row_group(rg, columns=["grp", "item", "score"]).to_pandas(date_as_object=True)
        read += 1
        if kept is not None:
            part = pd.concat([kept, part])
        part = part.sort_values(["grp", "score", "item"], ascending=[True, False, True], kind="stable").drop_duplicates(["grp", "item"])
        kept = part.groupby("grp", sort=False).head(n)
    return kept[["grp", "item", "score"]], read


def top_items(
    rows: DataFrame, groups: list[str], item: str, score: str, n: int, *, row_group_bytes: int = 512 << 10
) -> DataFrame:
    """(*groups, item, score, place): per group the n items (all, if fewer) with the highest score. An item counts
    once, with its best score; only finite scores and items that aren't null count; equal scores go to the
    smaller item, in the order of the item's own type (number, text, time); null group columns form a group of
    their own. n below 1 or no usable row gives no rows. The clustered table is deleted once the result,
    which is checkpointed, stands."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    item_t = to_arrow_type(rows.schema[item].dataType, timestamp_utc=True)
    path = write_clustered(rows, groups, item, score, row_group_bytes=row_group_bytes)

    def read(chain: pa.Table) -> pa.Table:
        found = list(zip(*(chain.column(c).to_pylist() for c in ("highest", "file", "rg"))))
        kept, _ = best_of_chain(found, n, single=chain.column("chain")[0].as_py().startswith("g"))
        return pa.Table.from_pandas(kept, schema=pa.schema([("grp", pa.string()), ("item", item_t), ("score", pa.float64())]), preserve_index=False)

    described = row_groups(spark, path)
    tasks = 4 * spark.sparkContext.defaultParallelism  # a stated number: the few bytes that describe row groups must not end in one task
    partial = described.repartition(tasks, "chain").groupBy("chain").applyInArrow(read, f"grp string, item {kinds[item]}, score double")
    once = partial.groupBy("grp", "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy("grp").orderBy(F.col("score").desc(), "item")
    top = once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    parts = F.split("grp", SEP)
    back = [F.when(parts[i] != NONE, parts[i]).cast(kinds[g]).alias(g) for i, g in enumerate(groups)]
    result = cut(top.select(*back, F.col("item").alias(item), "score", "place"))
    remove(spark, path)
    return result
