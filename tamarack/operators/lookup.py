"""Concept lookup: token index, candidate ranking, preferred names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import coverage, dice, name_norm, singular_candidate, words


def token_index(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, doc, tf): one row per term of a document."""
    return docs.where(F.col(doc).isNotNull()).select(doc, F.explode(words(text)).alias("term")).groupBy("term", doc).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def exact_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, cui, tier): names equal to a query's normal form or its singular; queries (query), names (cui, text)."""
    q = queries.select("query", name_norm("query").alias("norm")).where("norm <> ''").distinct()
    forms = q.select("query", F.explode(F.array_distinct(F.array_compact(F.array("norm", singular_candidate("norm"))))).alias("norm"))
    return forms.join(names.select("cui", name_norm("text").alias("norm")).distinct(), "norm").select("query", "cui", F.lit(0).alias("tier")).distinct()


def ranked_names(queries: DataFrame, names: DataFrame, most: int = 12, least_coverage: float = 0.5) -> DataFrame:
    """(query, cui, tier, score, rank): exact matches first (tier 0), then names that share words: tier 1 if they have at
    least ``least_coverage`` of the query's words, else 2; by tier, Dice's coefficient rounded to 3, and code. Names
    meet a query on its rarest words only: of n words the n - ceil(n * least_coverage) + 1 that fewest names
    have, of which every name of tier 1 has one; names that share none of these are no candidates. Null and
    wordless queries have none."""
    q = queries.select("query").where("query IS NOT NULL").distinct().withColumn("qw", F.array_distinct(words("query"))).where(F.size("qw") > 0)
    n = names.select("cui", "text").distinct().withColumn("nw", F.array_distinct(words("text")))
    held = n.select("cui", "text", F.explode("nw").alias("w"))
    df = held.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    asked = q.select("query", F.explode("qw").alias("w")).join(df, "w", "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))
    take = (F.size("o") - F.ceil(F.size("o") * F.lit(float(least_coverage))) + 1).cast("int")
    rare = asked.select("query", F.explode(F.slice("o", F.lit(1), F.greatest(take, F.lit(1)))).alias("x")).select("query", F.col("x.w").alias("w"))
    pairs = rare.join(held, "w").select("query", "cui", "text").distinct()
    scored = pairs.join(q, "query").join(n, ["cui", "text"]).select("query", "cui", dice(F.col("qw"), F.col("nw")).alias("s"), coverage(F.col("qw"), F.col("nw")).alias("c"))
    loose = scored.select("query", "cui", F.when(F.col("c") >= least_coverage, 1).otherwise(2).alias("tier"), F.bround("s", 3).alias("score"))
    exact = exact_names(queries, names).select("query", "cui", "tier", F.lit(1.0).alias("score"))
    best = exact.unionByName(loose).groupBy("query", "cui").agg(F.min_by(F.struct("tier", "score"), F.struct("tier", -F.col("score"))).alias("m")).select("query", "cui", "m.tier", "m.score")
    w = Window.partitionBy("query").orderBy("tier", F.col("score").desc(), "cui")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def preferred(names: DataFrame, key: str, text: str, order: Sequence[str]) -> DataFrame:
    """(key, text): the first name of each key in a total order of columns, then of the text."""
    return names.groupBy(key).agg(F.min_by(text, F.struct(*order, text)).alias(text))
