"""Queries of parent-child hierarchies (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.hierarchy import descendants, hierarchy_links, resolve_hierarchy, unfollowed_links
from tamarack.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(hierarchy_links(table(spark, d, "edges")), paths=False)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    r = resolve_hierarchy(hierarchy_links(table(spark, d, "edges")))
    return r.select("rel", "cui", F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(cut(resolve_hierarchy(hierarchy_links(table(spark, d, "edges")))))


def p1_unfollowed(spark: SparkSession, d: str) -> DataFrame:
    return unfollowed_links(hierarchy_links(table(spark, d, "edges")))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_unfollowed)}

_LINKS = """
WITH RECURSIVE said AS (
  SELECT regexp_replace(lower(coalesce(rel, '')), '[^a-z]', '', 'g') AS r,
    regexp_extract(coalesce(src, ''), '^\\s*(?:[cC][uU][iI]:\\s*)?[cC](\\d+)\\s*$', 1) AS s, regexp_extract(coalesce(dst, ''), '^\\s*(?:[cC][uU][iI]:\\s*)?[cC](\\d+)\\s*$', 1) AS t
  FROM edges WHERE lower(trim(coalesce(review, ''))) <> 'drop'
), links AS (
  SELECT DISTINCT CASE WHEN r IN ('isa', 'inverseisa') THEN 'IS_A' ELSE 'PART_OF' END AS rel,
    'C' || lpad(CASE WHEN r IN ('isa', 'partof') THEN s ELSE t END, greatest(8, length(CASE WHEN r IN ('isa', 'partof') THEN s ELSE t END))::INTEGER, '0') AS child,
    'C' || lpad(CASE WHEN r IN ('isa', 'partof') THEN t ELSE s END, greatest(8, length(CASE WHEN r IN ('isa', 'partof') THEN t ELSE s END))::INTEGER, '0') AS parent
  FROM said WHERE r IN ('isa', 'inverseisa', 'partof', 'haspart') AND s <> '' AND t <> ''
), nodes AS (SELECT rel, child AS cui FROM links UNION SELECT rel, parent FROM links),
tree(rel, cui, root, depth, path) AS (
  SELECT n.rel, n.cui, n.cui, CAST(0 AS BIGINT), n.cui FROM nodes n LEFT JOIN links l ON n.rel = l.rel AND n.cui = l.child WHERE l.child IS NULL
  UNION ALL
  SELECT t.rel, l.child, t.root, t.depth + 1, t.path || '/' || l.child FROM tree t JOIN links l ON t.rel = l.rel AND t.cui = l.parent
)
"""
SQL = {
    "p1_found": _LINKS + "SELECT n.rel, n.cui, coalesce(t.root, 'CYCLE') AS root, coalesce(t.depth, -1) AS depth FROM nodes n LEFT JOIN tree t ON n.rel = t.rel AND n.cui = t.cui",
    "p1_unfollowed": _LINKS + "SELECT rel, child, parent, followed FROM (SELECT *, min(parent) OVER (PARTITION BY rel, child) AS followed FROM links) WHERE parent <> followed",
    "p1_paths": _LINKS + "SELECT n.rel, n.cui, t.path FROM nodes n LEFT JOIN tree t ON n.rel = t.rel AND n.cui = t.cui",
    "p1_descendants": _LINKS
    + """, below(rel, cui, descendant, distance) AS (
  SELECT l.rel, l.parent, l.child, CAST(1 AS BIGINT) FROM links l JOIN tree t ON l.rel = t.rel AND l.child = t.cui
  UNION ALL
  SELECT b.rel, l.parent, b.descendant, b.distance + 1 FROM below b JOIN links l ON b.rel = l.rel AND b.cui = l.child
) SELECT rel, cui, descendant, distance FROM below""",
}
