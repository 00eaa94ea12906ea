"""Label assertions: states, resolution by priority, matrices, strata, constraint filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import all_of, running_sums

SILENT = "NOT_MENTIONED"
# fixed values: the sources in order of priority, and the four states
PRIORITY = ("CHEXBERT_REPORT", "CHEXBERT_IMPRESSION", "CHEXBERT_FINDINGS", "CHEXPERT_V1")
STATES = ("PRESENT", "UNCERTAIN", "ABSENT", "NOT_MENTIONED")


def status(c: str) -> Column:
    """A label code or spelt state as one of the four states: null, NaN and blank are NOT_MENTIONED, what is
    unknown is an error."""
    s = F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return (
        F.when(s.isin("", "NAN", SILENT), SILENT)
        .when(s.isin("1", "1.0", "PRESENT"), "PRESENT")
        .when(s.isin("0", "0.0", "ABSENT"), "ABSENT")
        .when(s.isin("-1", "-1.0", "UNCERTAIN"), "UNCERTAIN")
        .otherwise(F.raise_error(F.concat(F.lit("unknown label code: "), s)))
    )


def newest(labels: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """(study_id, concept, source, status): each source's newest assertion; equal times go to the greater state."""
    rows = labels if sources is None else labels.where(F.col("source").isin(*sources))
    return (
        rows.withColumn("status", status("status"))
        .groupBy("study_id", "concept", "source")
        .agg(F.max(F.struct("asserted_at", "status")).alias("m"))
        .select("study_id", "concept", "source", F.col("m.status").alias("status"))
    )


def resolve(assertions: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """(study_id, concept, status, source): the first source in priority that isn't silent; all silent gives
    NOT_MENTIONED and no source. An unknown source is an error."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source")).cast("int")
    known = F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null")))).cast("int"))
    pick = F.min_by(F.struct("status", "source"), F.struct((F.col("status") == SILENT), known))
    return (
        assertions.groupBy("study_id", "concept")
        .agg(pick.alias("p"))
        .select("study_id", "concept", F.col("p.status").alias("status"), F.when(F.col("p.status") != SILENT, F.col("p.source")).alias("source"))
    )


def column_of(concept: str) -> str:
    return concept.lower().replace(" ", "_")


def matrix(resolved: DataFrame, studies: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """One row per study and one state column per concept; what isn't there is NOT_MENTIONED."""
    wide = resolved.groupBy("study_id").pivot("concept", list(concepts)).agg(F.first("status"))
    return studies.select("study_id").distinct().join(wide, "study_id", "left").select(
        "study_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(SILENT)).alias(column_of(c)) for c in concepts]
    )


def agreement_counts(assertions: DataFrame) -> DataFrame:
    """(study_id, concept, status, n): sources that assert a state; silence isn't counted."""
    return assertions.where(F.col("status") != SILENT).groupBy("study_id", "concept", "status").agg(F.count(F.lit(1)).alias("n"))


def rarity(resolved: DataFrame) -> DataFrame:
    """(concept, n, rank): concepts by number of studies with it PRESENT, the rarest first, ties by name."""
    n = resolved.groupBy("concept").agg(F.sum((F.col("status") == "PRESENT").cast("bigint")).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy("n", "concept")))


def strata(resolved: DataFrame) -> DataFrame:
    """(study_id, stratum): the rarest concept that is PRESENT, else ``none``. The rank table has one row per concept."""
    present = resolved.where(F.col("status") == "PRESENT").join(F.broadcast(rarity(resolved).select("concept", "rank")), "concept")
    rarest = present.groupBy("study_id").agg(F.min_by("concept", "rank").alias("stratum"))
    return resolved.select("study_id").distinct().join(rarest, "study_id", "left").select("study_id", F.coalesce("stratum", F.lit("none")).alias("stratum"))


def interleave(assigned: DataFrame, seed: int, pinned: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """(study_id, stratum, rank_in_manifest): strata spread evenly over the order, so that every prefix keeps their
    mix; order within a stratum by the hash of seed and study. Pinned studies come first; one that isn't there is
    an error. Ranks are contiguous from 0, ``limit`` keeps a prefix. Neither a stratum nor the whole is
    sorted in one task: both numberings are running sums over range partitions."""
    hashed = assigned.select("study_id", "stratum").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("study_id")), 256))
    first = F.col("study_id").isin(*pinned) if pinned else F.lit(False)
    if pinned:
        unknown = set(pinned) - {r.study_id for r in assigned.where(first).select("study_id").distinct().collect()}
        if unknown:
            raise ValueError(f"pinned studies that aren't there: {sorted(unknown)}")
    placed = running_sums(hashed, ["stratum"], [F.col("h"), F.col("study_id")], {"_j": F.lit(1)})
    sizes = assigned.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))  # a row per concept
    spread = placed.join(F.broadcast(sizes), "stratum").withColumn("_spread", (F.col("_j") + 0.5) / F.col("_n")).withColumn("_pin", (~first).cast("int"))
    ranked = running_sums(spread, [], [F.col("_pin"), F.col("_spread"), F.col("h"), F.col("study_id")], {"rank_in_manifest": F.lit(1)})
    out = ranked.select("study_id", "stratum", F.col("rank_in_manifest").cast("bigint").alias("rank_in_manifest"))
    return out if limit is None else out.where(F.col("rank_in_manifest") < limit)


def constraint(include: Sequence[tuple[str, str]], exclude: Sequence[str], *, absence: str = "exclude_present", uncertainty: str = "EXCLUDE") -> Column:
    """A condition over a matrix's columns. include: (concept, PRESENT or UNCERTAIN); PRESENT also takes UNCERTAIN
    if uncertainty is INCLUDE. exclude: concepts that must not be PRESENT (nor UNCERTAIN, unless uncertainty is
    INCLUDE), or must be ABSENT under ``explicit_absence_required``. No constraint at all is an error."""
    if not include and not exclude:
        raise ValueError("no constraint")
    if absence not in ("exclude_present", "explicit_absence_required") or uncertainty not in ("INCLUDE", "EXCLUDE"):
        raise ValueError("unknown policy")
    parts = []
    for c, want in include:
        states = ["UNCERTAIN"] if want == "UNCERTAIN" else ["PRESENT", "UNCERTAIN"] if uncertainty == "INCLUDE" else ["PRESENT"]
        parts.append(F.col(column_of(c)).isin(*states))
    for c in exclude:
        barred = ["PRESENT"] if uncertainty == "INCLUDE" else ["PRESENT", "UNCERTAIN"]
        parts.append(F.col(column_of(c)) == "ABSENT" if absence == "explicit_absence_required" else ~F.col(column_of(c)).isin(*barred))
    return all_of(parts)


def satisfies(matrix: DataFrame, study: str, include: Sequence[tuple[str, str]], exclude: Sequence[str], **policy: str) -> bool:
    """Whether one study meets a constraint; a study that isn't there doesn't."""
    return not matrix.where(F.col("study_id") == study).where(constraint(include, exclude, **policy)).isEmpty()


def ordered_matches(matrix: DataFrame, condition: Column, seed: int, most: int | None = None) -> DataFrame:
    """(study_id) of the studies that match, in one seeded order that doesn't depend on the condition."""
    rows = matrix.where(condition).select("study_id").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("study_id")), 256), "study_id")
    return rows if most is None else rows.limit(most)


def sample_window(manifest: DataFrame, images: DataFrame, start: int, n: int, split: str = "train") -> DataFrame:
    """(study_id, stratum, rank_in_manifest, image_id) of n places of a manifest from ``start``; a study without exactly one image of the split
    is an error."""
    window = manifest.where(F.col("rank_in_manifest").between(start, start + n - 1))
    rows = window.join(images.where(F.col("dataset_split") == split).select("study_id", "image_id"), "study_id", "left")
    told = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("image_id").alias("found"), F.countDistinct("study_id").alias("studies")).first()
    if not told.rows == told.found == told.studies:
        raise ValueError(f"{told.studies} studies met {told.found} images in {told.rows} rows")
    return rows.select("study_id", "stratum", "rank_in_manifest", "image_id")


def crosstab(resolved: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """(concept, status, n) for all states of the given concepts, zeros included."""
    spark = resolved.sparkSession
    grid = spark.createDataFrame([(c, s) for c in concepts for s in STATES], "concept string, status string")
    n = resolved.groupBy("concept", "status").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["concept", "status"], "left").select("concept", "status", F.coalesce("n", F.lit(0)).alias("n"))
