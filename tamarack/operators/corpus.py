"""Corpus building: eligibility, one row per group, join audits, splits by hash, fingerprints, contracts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import blank_to_null, hex_mod, image_key, image_path, view_index
from tamarack.session import running_sums


def eligible(rows: DataFrame, *, projection: str, text: Sequence[str], path: str, available: DataFrame | None = None, views: Sequence[str] = ("AP", "PA")) -> DataFrame:
    """Rows with a frontal view, some text, and a path that is available (no list: all are)."""
    some = F.coalesce(*[blank_to_null(c) for c in text]).isNotNull() if text else F.lit(True)
    out = rows.where(F.col(projection).isin(*views) & some)
    return out if available is None else out.join(available.select(path).distinct(), path, "left_semi")


def one_per_group(rows: DataFrame, group: str, path: str) -> DataFrame:
    """The row with the lowest view number of each group, ties by path, then by all columns."""
    order = F.struct(view_index(path).alias("v"), F.col(path).alias("p"), F.struct(*rows.columns).alias("all"))
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(F.struct(*rows.columns), order).alias("m")).select("m.*")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def join_audit(left: DataFrame, left_path: str, right: DataFrame, right_path: str) -> DataFrame:
    """(strategy, total, matched, rate): share of the left paths that have a match, for three ways to make keys."""
    ways = {"exact": F.trim, "posix_lower": lambda c: F.lower(F.regexp_replace(c, r"\\", "/")), "image_key": image_key}
    out = []
    for name, key in ways.items():
        a = left.select(key(F.col(left_path)).alias("k"))
        b = right.select(key(F.col(right_path)).alias("k")).where("k IS NOT NULL").distinct().withColumn("hit", F.lit(1))
        joined = a.join(b, "k", "left")
        out.append(joined.agg(F.lit(name).alias("strategy"), F.count(F.lit(1)).alias("total"), F.count("hit").alias("matched")))
    return reduce(DataFrame.unionByName, out).withColumn("rate", F.round(F.try_divide("matched", "total"), 6))


def corpus_mode(rate: float) -> str:
    """What a measured join rate allows."""
    return "full" if rate >= 0.95 else "reduced" if rate >= 0.7 else "abort"


def hash_split(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows with ``is_val``: a key's SHA-256 with the seed, as a number modulo 1000, below fraction * 1000."""
    return rows.withColumn("is_val", hex_mod(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), 1000) < int(round(fraction * 1000)))


def seeded_sample(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A share of the rows, at least one: the first in the order of a seeded hash, ties by key, then by all columns. They are
    numbered by running sums over range partitions, so a large share doesn't pass through one task."""
    n = rows.count()
    k = max(1, int(round(n * fraction))) if n else 0
    order = [F.col("_h"), F.col(key), F.xxhash64(*rows.columns)]
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    return running_sums(hashed, [], order, {"_n": F.lit(1)}).where(F.col("_n") < k).drop("_h", "_n")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, fingerprint): one digest for a table whatever its row order: the digest of sums of row digests' parts,
    which are partial aggregates, so nothing is gathered."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(5)]
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(5)]), 256).alias("fingerprint"))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def shard_bounds(n: int, size: int) -> list[tuple[int, int]]:
    if size < 1:
        raise ValueError("shard size")
    return [(s, min(s + size, n)) for s in range(0, n, size)]


@dataclass(frozen=True)
class TableSpec:
    """What a table must look like: its columns and types, its key, closed value sets, columns that may be null."""

    columns: dict[str, str]
    key: tuple[str, ...]
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    nullable: frozenset[str] = frozenset()


def contract_checks(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(check, bad): for every rule the number of rows that break it: columns, key_null, key_duplicate, and one per
    domain. One aggregate over the rows, one over the keys."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    wrong = sum(kinds.get(c) != t for c, t in spec.columns.items()) + len(set(kinds) - set(spec.columns))
    if wrong:
        return spark.createDataFrame([("columns", wrong)], "check string, bad bigint")
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in spec.key])
    rules = [F.count_if(nulls).alias("key_null")]
    for c, values in spec.domains.items():
        legal = F.coalesce(F.col(c).isin(*values), F.lit(c in spec.nullable))
        rules.append(F.count_if(~legal).alias(f"domain_{c}"))
    keys = df.where(~nulls).groupBy(*spec.key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("key_duplicate"))
    one = df.agg(*rules).crossJoin(keys).withColumn("columns", F.lit(0).cast("bigint"))
    return one.unpivot([], one.columns, "check", "bad").select("check", F.col("bad").cast("bigint").alias("bad"))


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The table itself, or an error that names every broken rule."""
    bad = {r.check: r.bad for r in contract_checks(df, spec).where("bad > 0").collect()}
    if bad:
        raise ValueError(f"contract broken: {bad}")
    return df


# fixed values: the contract of the images table
IMAGES = TableSpec(
    {
        "image_id": "string", "study_id": "string", "patient_id": "string", "path_to_image": "string", "local_image_path": "string", "view": "string",
        "projection": "string", "dataset_split": "string", "image_checksum": "string", "width": "int", "height": "int",
    },
    ("image_id",),
    {"view": ("FRONTAL",), "projection": ("AP", "PA"), "dataset_split": ("train", "valid")},
)


def with_ids(rows: DataFrame, path: str) -> DataFrame:
    """Rows with the canonical path and its SHA-256 as image_id."""
    return rows.withColumn("canonical_path", image_path(path)).withColumn("image_id", F.sha2("canonical_path", 256))
