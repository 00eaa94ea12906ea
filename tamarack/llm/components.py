"""Splits that keep related records together: hash-to-min components and weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import cut, release, salted_lookup

FILLERS = ("", "n/a", "na", "none", "null", "pending", "unknown", "-", "?")
#: SHA-256 of the empty input: what a file's checksum is when there was no file.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def image_links(images: DataFrame) -> DataFrame:
    """(image_id, key): what links an image to others: its study, its patient (from patient_id and from the
    study's id, however spelt) and its file (image_checksum). Missing and filler values give no key; a
    checksum counts if it is 64 hexadecimal digits, not all the same and not that of an empty file."""

    def tidy(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), r"\\", "/"), r"/+|\s+", "/")

    study, patient = F.regexp_replace(tidy("study_id"), "^/|/$", ""), F.regexp_replace(tidy("patient_id"), "^/|/$", "")
    check = F.lower(F.trim(F.coalesce(F.col("image_checksum"), F.lit(""))))

    def person(c: Column) -> Column:
        plain = F.regexp_replace(c, "[^a-z0-9]", "")
        digits = F.regexp_extract(plain, r"0*([0-9]+)$", 1)
        return F.when(digits != "", F.concat(F.regexp_extract(plain, r"^([a-z]*)", 1), digits)).otherwise(plain)

    of_study = F.when(study.contains("/"), F.regexp_extract(study, "^([^/]+)", 1)).otherwise(F.lit(""))
    within = F.regexp_extract(study, "/(.+)$", 1)
    keys = F.array(
        F.when(~study.isin(*FILLERS), F.concat(F.lit("s:"), F.when(within != "", F.concat(person(of_study), F.lit("/"), within)).otherwise(study))),
        F.when(~patient.isin(*FILLERS), F.concat(F.lit("p:"), person(patient))),
        F.when(~of_study.isin(*FILLERS), F.concat(F.lit("p:"), person(of_study))),
        F.when(
            check.rlike("^[0-9a-f]{64}$") & ~check.rlike(r"^(.)\1*$") & (check != EMPTY_SHA256),
            F.concat(F.lit("f:"), check),
        ),
    )
    return (
        images.where(F.col("image_id").isNotNull())
        .select("image_id", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))
        .distinct()
    )


def hash_to_min(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): of every node that occurs in an edge, the smallest node of its component.

    Every node v holds a cluster of nodes, at first its neighbours and itself. A round sends v's cluster to
    its smallest member and that member to all others, until nothing changes; then every node holds its
    root and every root its component. Clusters are kept as rows, never gathered, and nodes with large
    clusters are salted. Null ends are ignored."""
    e = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("v"), F.col(right).alias("u"))
    state = cut(e.union(e.select("u", "v")).union(e.select("v", F.col("v"))).union(e.select("u", F.col("u"))).distinct())

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("v", "u")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1_000_003)).cast("decimal(38,0)")), F.bit_xor(h)).first())

    last = mark(state)
    while True:
        least = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("count"))
        joined = salted_lookup(state, least.select("v", "m"), "v", how="inner", counts=least)
        before, state = state, cut(joined.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p")).select("p.*").distinct())
        release(before)
        now = mark(state)
        if now == last:
            break
        last = now
    return state.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")


def grouped_images(images: DataFrame) -> DataFrame:
    """(image_id, group_image_id): every image_id once, with the smallest of its group. An image that nothing
    links is its own group; rows without image_id are left out; repeated rows count once. Components are found
    over numbers that stand for image_ids."""
    ids = cut(images.where(F.col("image_id").isNotNull()).select("image_id").distinct().withColumn("n", F.monotonically_increasing_id()))
    links = cut(image_links(images).join(ids, "image_id").select("n", "key"))
    first = links.groupBy("key").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("count")).where("count > 1")
    edges = salted_lookup(links, first.select("key", "first"), "key", how="inner", counts=first).select("n", "first").where("n <> first").distinct()
    roots = cut(hash_to_min(edges, "n", "first").withColumnRenamed("node", "n"))
    release(links)
    held = ids.join(roots, "n")
    least = held.groupBy("root").agg(F.min("image_id").alias("group_image_id"), F.count(F.lit(1)).alias("count"))
    grouped = salted_lookup(held, least.select("root", "group_image_id"), "root", how="inner", counts=least).select("image_id", "group_image_id")
    alone = ids.join(roots.select("n"), "n", "left_anti").select("image_id", F.col("image_id").alias("group_image_id"))
    return grouped.unionByName(alone)


def rendezvous(group: str, weights: dict[str, float], seed: int) -> Column:
    """The split of a group by weighted rendezvous hashing: every split draws -weight / ln(u) with u from a hash
    of group and split, the highest wins. A changed weight moves groups to or from that split only. Weights
    must be positive."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    draws = []
    for name, weight in sorted(weights.items()):
        h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(group)), 256), 1, 13), 16, 10).cast("double")
        draws.append(F.struct((F.lit(-float(weight)) / F.log((h + 1) / F.lit(float(16**13 + 1)))).alias("draw"), F.lit(name).alias("name")))
    return F.array_max(F.array(*draws))["name"] if len(draws) > 1 else draws[0]["name"]


def assign_splits(images: DataFrame, weights: dict[str, float] | None = None, seed: int = 20) -> DataFrame:
    """(image_id, group_image_id, split): groups are assigned whole; the shares hold in expectation over
    groups, so one very large group can move them (see split_shares)."""
    weights = weights or {"train": 0.8, "validation": 0.1, "test": 0.1}
    return grouped_images(images).withColumn("split", rendezvous("group_image_id", weights, seed))


def split_shares(assigned: DataFrame) -> DataFrame:
    """(split, images, groups, image_share, group_share) as they came out."""
    by = assigned.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.sum((F.col("image_id") == F.col("group_image_id")).cast("bigint")).alias("groups")
    )
    total = by.agg(F.sum("images").alias("ti"), F.sum("groups").alias("tg"))
    return by.crossJoin(total).select("split", "images", "groups", F.expr("round(images / ti, 6)").alias("image_share"), F.expr("round(groups / tg, 6)").alias("group_share"))
