"""Full hierarchies from parent-child rows, by pointer doubling.

Every node keeps a pointer to an ancestor and the number of links to it. A round joins the pointers with
themselves, which doubles the jump, so a node at depth d is resolved after ceil(log2 d) rounds. All depths
below a resolved node occur, so a round that resolves no node proves that what is left lies on or below a
circle: the loop ends there, without a bound on the depth. Resolved nodes leave the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import cut, salted_lookup

CYCLE = "CYCLE"


def _code(c: str) -> Column:
    digits = F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(?i)^\s*(?:cui:\s*)?c(\d+)\s*$", 1)
    padded = F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)  # lpad alone would cut longer codes
    return F.when(digits != "", F.concat(F.lit("C"), padded))


def hierarchy_links(edges: DataFrame) -> DataFrame:
    """(rel, child, parent) of the two hierarchies IS_A and PART_OF.

    Codes are read whatever their case, padding and prefix, relations whatever their spelling; rows that
    state the reverse relation are turned round. Rows with an empty or unreadable end, another or null
    relation, or review ``drop`` don't count; repeated links count once. Other columns are ignored."""
    rel = F.regexp_replace(F.lower(F.coalesce(F.col("rel"), F.lit(""))), r"[^a-z]", "")
    kind = F.when(rel.isin("isa", "inverseisa"), "IS_A").when(rel.isin("partof", "haspart"), "PART_OF")
    return (
        edges.where(F.lower(F.trim(F.coalesce(F.col("review"), F.lit("")))) != "drop")
        .select(kind.alias("rel"), rel.isin("inverseisa", "haspart").alias("_turn"), _code("src").alias("_s"), _code("dst").alias("_d"))
        .where(F.col("rel").isNotNull() & F.col("_s").isNotNull() & F.col("_d").isNotNull())
        .select(
            "rel",
            F.when(F.col("_turn"), F.col("_d")).otherwise(F.col("_s")).alias("child"),
            F.when(F.col("_turn"), F.col("_s")).otherwise(F.col("_d")).alias("parent"),
        )
        .distinct()
    )


def resolve_hierarchy(links: DataFrame, *, paths: bool = True) -> DataFrame:
    """(rel, cui, root, depth bigint[, path array]) of every code in ``links`` (rel, child, parent).

    path runs from the root to the code. A code without a parent is its own root at depth 0; on or below a
    circle (a code that is its own parent is one) root is ``CYCLE``, depth -1 and path null. Should a code
    have several parents, the smallest is followed and ``unfollowed_links`` tells the others. Null ends are ignored;
    no links give no rows."""
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull())
    up = links.groupBy("rel", "child").agg(F.min("parent").alias("parent"))
    nodes = links.select("rel", F.col("child").alias("cui")).union(links.select("rel", F.col("parent"))).distinct()
    start = (
        nodes.join(up, (nodes.rel == up.rel) & (nodes.cui == up.child), "left")
        .select(
            F.concat_ws("|", nodes.rel, "cui").alias("node"),
            nodes.rel,
            "cui",
            F.coalesce("parent", "cui").alias("anc"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
            F.col("parent").isNull().alias("done"),
            *([F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent")).alias("up_path")] if paths else []),
        )
    )
    state = cut(start)
    finished = [state.where("done")]
    active = state.where("NOT done")
    left = active.count()
    pointers = state
    while left:
        keep = ["rel", "anc", "depth", "done"] + (["up_path"] if paths else [])
        right = pointers.select(F.col("node").alias("at"), *[F.col(c).alias("_" + c) for c in keep if c != "rel"])
        step = salted_lookup(active.withColumn("at", F.concat_ws("|", "rel", "anc")), right, "at", how="inner").select(
            "node",
            "rel",
            "cui",
            F.col("_anc").alias("anc"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_done").alias("done"),
            *([F.concat("up_path", "_up_path").alias("up_path")] if paths else []),
        )
        step = cut(step)
        finished.append(step.where("done"))
        active = step.where("NOT done")
        now = active.count()
        if now == left:
            break
        left = now
        pointers = finished[0]
        for f in finished[1:]:
            pointers = pointers.unionByName(f)
        pointers = pointers.unionByName(active)
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    fields = ["rel", "cui", F.col("anc").alias("root"), "depth"]
    if paths:
        fields.append(F.concat(F.reverse("up_path"), F.array("cui")).alias("path"))
    out = out.select(*fields)
    if left:
        lost = ["rel", "cui", F.lit(CYCLE).alias("root"), F.lit(-1).cast("bigint").alias("depth")]
        out = out.unionByName(active.select(*lost, *([F.lit(None).cast("array<string>").alias("path")] if paths else [])))
    return out


def unfollowed_links(links: DataFrame) -> DataFrame:
    """(rel, child, parent, followed): the links that ``resolve_hierarchy`` doesn't follow, since their child has a
    smaller parent, which is ``followed``. A hierarchy that is one has none."""
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("rel", "child", "parent").distinct()
    up = links.groupBy("rel", "child").agg(F.min("parent").alias("followed"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return links.join(up, ["rel", "child"]).where("parent <> followed").select("rel", "child", "parent", "followed")


def descendants(resolved: DataFrame) -> DataFrame:
    """(rel, cui, descendant, distance): one row per code and code below it, from resolved paths. The rows are
    made where the path lies; nothing is gathered by ancestor. Codes on or below circles have none."""
    return (
        resolved.where(F.col("path").isNotNull() & (F.size("path") > 1))
        .select("rel", F.col("cui").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)))
        .select("rel", F.col("col").alias("cui"), "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
