"""Graph operators over edge tables: bounded search, closures, reachability, co-mention weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators.hierarchy import hierarchy_links
from tamarack.session import cut, release


def clean_edges(edges: DataFrame) -> DataFrame:
    """(src, rel, dst, source, n, n_src, p, review): one spelling of codes and relations, reverse rows turned round,
    rows without a readable end left out, the strongest of repeated links kept. Adjudicated rows stay."""
    digits = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(?i)^\s*(?:cui:\s*)?([ct]\d+)\s*$", 1)
    rel = F.regexp_replace(F.lower(F.coalesce(F.col("rel"), F.lit(""))), "[^a-z]", "")
    name = F.create_map(*[F.lit(x) for x in ("isa", "IS_A", "inverseisa", "IS_A", "partof", "PART_OF", "haspart", "PART_OF", "suggests", "SUGGESTS", "typicallyat", "TYPICALLY_AT", "hassty", "HAS_STY")])
    turn = rel.isin("inverseisa", "haspart")
    rows = edges.select(
        F.upper(F.when(turn, digits("dst")).otherwise(digits("src"))).alias("src"), name[rel].alias("rel"), F.upper(F.when(turn, digits("src")).otherwise(digits("dst"))).alias("dst"),
        "source", "n", "n_src", "p", F.lower(F.trim("review")).alias("review"),
    ).where("src <> '' AND dst <> '' AND rel IS NOT NULL")
    best = F.max(F.struct(F.coalesce("p", F.lit(-1.0)).alias("k"), "source", "n", "n_src", "p", "review")).alias("m")
    return rows.groupBy("src", "rel", "dst").agg(best).select("src", "rel", "dst", "m.source", "m.n", "m.n_src", "m.p", "m.review")


def kept(c: str = "review") -> Column:
    return F.coalesce(F.col(c), F.lit("keep")) != "drop"


def steps(edges: DataFrame, start: DataFrame, depth: int | None = None, *, allowed: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node, hops): level by level along edges (a, b) from start (seed, node), each pair once with the fewest
    hops, start pairs excluded. Nodes must be ``allowed``; nodes in ``stop`` aren't entered. Visited pairs are
    left out of the next level, so circles end; without a depth it runs until a level is empty."""
    along = edges.select("a", "b").distinct()
    if allowed is not None:
        along = along.join(allowed.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    if stop is not None:
        along = along.join(stop.select(F.col("node").alias("b")).distinct(), "b", "left_anti")
    along = cut(along)
    front = cut(start.select("seed", "node").distinct())
    seen, levels, hops = front, [], 0
    while depth is None or hops < depth:
        hops += 1
        level = front.join(along, front.node == along.a).select("seed", F.col("b").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
        front = cut(level)
        if front.isEmpty():
            break
        levels.append(front.withColumn("hops", F.lit(hops)))
        seen = cut(seen.unionByName(front)) if hops % 8 == 0 else seen.unionByName(front)
    out = start.select("seed", "node", F.lit(0).alias("hops")).limit(0)
    for x in levels:
        out = out.unionByName(x)
    return out


def is_a(edges: DataFrame, rel: str = "IS_A") -> DataFrame:
    """(child, parent) of one hierarchy."""
    return hierarchy_links(edges).where(F.col("rel") == rel).select("child", "parent")


def scorable_below(links: DataFrame, seeds: DataFrame, scorable: DataFrame, depth: int) -> DataFrame:
    """(seed, cui, hops): scorable concepts at or up to depth links below each seed."""
    seeds = seeds.select(F.col("seed"), F.col("seed").alias("node")).distinct()
    down = steps(links.select(F.col("parent").alias("a"), F.col("child").alias("b")), seeds, depth)
    return seeds.withColumn("hops", F.lit(0)).unionByName(down).join(scorable.select(F.col("cui").alias("node")).distinct(), "node", "left_semi").select("seed", F.col("node").alias("cui"), "hops")


def scorable_above(links: DataFrame, seeds: DataFrame, scorable: DataFrame, depth: int) -> DataFrame:
    """(seed, cui, hops): the nearest scorable concept above each seed, ties by code; none, no row."""
    seeds = seeds.select(F.col("seed"), F.col("seed").alias("node")).distinct()
    up = steps(links.select(F.col("child").alias("a"), F.col("parent").alias("b")), seeds, depth)
    near = up.join(scorable.select(F.col("cui").alias("node")).distinct(), "node", "left_semi")
    return near.groupBy("seed").agg(F.min(F.struct("hops", F.col("node").alias("cui"))).alias("m")).select("seed", "m.cui", "m.hops")


def strongest_into(edges: DataFrame, rel: str, links: DataFrame, seeds: DataFrame, scorable: DataFrame, depth: int, min_n: int, *, manual_exempt: bool, review: bool, top: int | None = None) -> DataFrame:
    """(seed, cui, p, n, target): scorable findings with an edge ``rel`` into the seed or up to depth below it, each
    with its strongest edge (ties by target); weak counts are left out, hand-made edges exempt if asked, and
    edges dropped on review if asked. With ``top``, the strongest per seed only."""
    seeds = seeds.select(F.col("seed"), F.col("seed").alias("node")).distinct()
    reach = seeds.unionByName(steps(links.select(F.col("parent").alias("a"), F.col("child").alias("b")), seeds, depth).select("seed", "node"))
    strong = F.col("n") >= min_n
    rows = edges.where((F.col("rel") == rel) & ((F.col("source") == "manual") | strong if manual_exempt else strong) & (kept() if review else F.lit(True)))
    rows = rows.join(scorable.select(F.col("cui").alias("src")).distinct(), "src", "left_semi")
    met = reach.join(rows, reach.node == rows.dst)
    best = met.groupBy("seed", "src").agg(F.max_by(F.struct("p", "n", F.col("dst").alias("target")), F.struct(F.coalesce("p", F.lit(-1.0)), "dst")).alias("m"))
    out = best.select("seed", F.col("src").alias("cui"), "m.p", "m.n", "m.target")
    if top is None:
        return out
    w = Window.partitionBy("seed").orderBy(F.col("p").desc_nulls_last(), "cui")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


#: So many steps of ``reaches`` make a round, after which the new states are written.
HOPS = 4


def reaches(nodes: DataFrame, edges: DataFrame, links: DataFrame, wholes: DataFrame) -> DataFrame:
    """(cui, reaches): whether a concept leads to a scorable one: itself, along IS_A upwards, into a disease by a kept
    SUGGESTS, or into an anatomy, and the wholes it is part of, by TYPICALLY_AT; to a fixed point. A state is a
    concept and whether it was reached as a region, from where it goes on along PART_OF as well; all arcs between
    states are one table, and only the new states of a round of ``HOPS`` steps are written."""
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    arcs = [
        links.select("parent", both.alias("from_region"), "child", F.lit(False)),
        edges.where((F.col("rel") == "SUGGESTS") & kept()).select("src", both, "dst", F.lit(False)),
        edges.where(F.col("rel") == "TYPICALLY_AT").select("src", both, "dst", F.lit(True)),
        wholes.select("child", F.lit(True), "parent", F.lit(True)),
    ]
    along = arcs[0].union(arcs[1]).union(arcs[2]).union(arcs[3]).toDF("via", "via_region", "to", "to_region").distinct()
    along = cut(along)
    front = cut(nodes.where("scorable").select("cui", F.lit(False).alias("region")).distinct())
    seen, parts = front, [front]
    while not front.isEmpty():
        step, met = front, None
        for _ in range(HOPS):
            on = (step.cui == along.via) & (step.region == along.via_region)
            step = step.join(along, on).select(F.col("to").alias("cui"), F.col("to_region").alias("region")).distinct()
            met = step if met is None else met.unionByName(step)
        front = cut(met.distinct().join(seen, ["cui", "region"], "left_anti"))
        parts.append(front)
        seen = seen.unionByName(front)
        if len(parts) % 8 == 0:  # keeps the plan small
            seen = cut(seen)
    release(along)
    hit = seen.select("cui").distinct().withColumn("hit", F.lit(True))
    return nodes.select("cui").distinct().join(hit, "cui", "left").select("cui", F.coalesce("hit", F.lit(False)).alias("reaches"))


def shortest_paths(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, hops, path): the shortest path from start to each node within depth, the smallest in alphabetical
    order of its nodes; start itself excluded."""
    spark = edges.sparkSession
    along = cut(edges.select("a", "b").distinct())
    front = spark.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = front.select("node")
    out = None
    for hops in range(1, depth + 1):
        level = front.join(along, front.node == along.a).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
        front = cut(level.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node"))
        part = front.select("node", F.lit(hops).alias("hops"), "path")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "node string, hops int, path array<string>")


def weighted_edges(pairs: DataFrame, sources: DataFrame, report: str, src: str, dst: str, min_n: int) -> DataFrame:
    """(src, dst, n, n_src, p): n = distinct reports with the pair, n_src = with the source at all, p = n / n_src;
    self-pairs and pairs below min_n are left out."""
    n = pairs.where((F.col(src) != F.col(dst)) & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.countDistinct(report).alias("n")).where(F.col("n") >= min_n)
    n_src = sources.groupBy(F.col(src).alias("src")).agg(F.countDistinct(report).alias("n_src"))
    return n.join(n_src, "src").select("src", "dst", "n", "n_src", F.round(F.col("n") / F.col("n_src"), 6).alias("p"))


def review_overlay(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges with the adjudicated review where there is one; decisions: (src, rel, dst, review)."""
    d = decisions.select("src", "rel", "dst", F.col("review").alias("_r"))
    return edges.join(d, ["src", "rel", "dst"], "left").withColumn("review", F.coalesce("_r", "review")).drop("_r")


def tree_edges(codes: DataFrame, code: str) -> DataFrame:
    """(child, parent) of a tree written as dotted codes."""
    up = F.regexp_replace(F.col(code), r"\.[^.]*$", "")
    have = codes.select(F.col(code).alias("parent")).distinct()
    return codes.where(F.col(code).contains(".")).select(F.col(code).alias("child"), up.alias("parent")).join(have, "parent", "left_semi").select("child", "parent").distinct()


def missing_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str] = ("src", "dst")) -> DataFrame:
    """Edges less those with an end that isn't a node."""
    out = edges
    for c in columns:
        out = out.join(nodes.select(F.col("cui").alias(c)).distinct(), c, "left_semi")
    return out
