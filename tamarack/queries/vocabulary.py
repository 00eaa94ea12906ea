"""Queries of mentions and vocabulary. Line items stand for mentions: an order is a study, a line an Observation of its part's
brand, located at an Anatomy, its supplier's nation; the return flag is the polarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import graph as G
from tamarack.operators import vocab as V
from tamarack.queries.graphs import CLEAN, edges, links
from tamarack.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.concat(F.lit("O"), "l_orderkey").alias("study_id"), F.col("l_linestatus").alias("section"), F.col("l_linenumber").alias("n"), "p_brand", "s_nationkey", "l_returnflag")
    )
    polarity = F.when(F.col("l_returnflag") == "N", "present").when(F.col("l_returnflag") == "R", "uncertain").otherwise("absent")
    anat = F.concat(F.lit("a"), "n")
    obs = rows.select("study_id", "section", F.concat(F.lit("o"), "n").alias("entity"), F.lit("Observation").alias("kind"), polarity.alias("polarity"), F.col("p_brand").alias("joined"), F.when(F.col("n") % 3 > 0, F.array(anat)).otherwise(F.array().cast("array<string>")).alias("located_at"))
    place = rows.select("study_id", "section", anat.alias("entity"), F.lit("Anatomy").alias("kind"), F.lit(None).cast("string").alias("polarity"), F.concat(F.lit("N"), "s_nationkey").alias("joined"), F.array().cast("array<string>").alias("located_at"))
    return obs.unionByName(place).withColumn("suggests", F.array().cast("array<string>")).withColumn("dropped_head", F.col("joined").isin("N3", "Brand#11"))


MENTIONS = """WITH r AS (SELECT 'O' || l_orderkey AS study_id, l_linestatus AS section, l_linenumber AS n, p_brand, s_nationkey, CASE l_returnflag WHEN 'N' THEN 'present' WHEN 'R' THEN 'uncertain' ELSE 'absent' END AS polarity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT * FROM (SELECT study_id, section, 'o' || n AS entity, 'Observation' AS kind, polarity, p_brand AS joined, CASE WHEN n % 3 > 0 THEN 'a' || n END AS located_at FROM r UNION ALL SELECT study_id, section, 'a' || n, 'Anatomy', NULL, 'N' || s_nationkey, NULL FROM r) WHERE joined NOT IN ('N3', 'Brand#11')),
pairs AS (SELECT o.study_id, o.section, o.entity, o.joined AS obs, a.joined AS anat FROM m o JOIN m a ON o.study_id = a.study_id AND o.section = a.section AND o.located_at = a.entity WHERE o.kind = 'Observation' AND a.kind = 'Anatomy')
"""


@query(MENTIONS + "SELECT kind, joined AS string, count(*) AS mentions, count(DISTINCT study_id) AS studies FROM m GROUP BY ALL")
def vocabulary_table(spark: SparkSession, d: str) -> DataFrame:
    return V.vocabulary(mentions(spark, d))


@query(
    MENTIONS + """, t AS (SELECT kind, joined, count(*) AS n FROM m GROUP BY ALL), c AS (SELECT kind, n, row_number() OVER w AS rn, sum(n) OVER (PARTITION BY kind ORDER BY n DESC, joined ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY kind) AS total FROM t WINDOW w AS (PARTITION BY kind ORDER BY n DESC, joined))
SELECT kind, (SELECT count(*) FROM t WHERE t.kind = c.kind) AS strings, CAST(any_value(total) AS BIGINT) AS mentions, level, min(rn) AS needed, CASE WHEN kind = 'Observation' AND level = 0.9 THEN min(rn) <= 20 END AS passed FROM c, (SELECT unnest([0.8, 0.9, 0.95]::DOUBLE[]) AS level) WHERE cum >= level * total - 1e-9 GROUP BY kind, level"""
)
def vocabulary_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.vocabulary_summary(mentions(spark, d), (0.8, 0.9, 0.95), ("Observation", 0.9, 20))


@query(MENTIONS + "SELECT study_id, section, entity, obs, anat FROM pairs")
def located_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.located_pairs(mentions(spark, d))


@query(
    MENTIONS + """, n AS (SELECT obs, anat, count(*) AS n FROM pairs GROUP BY ALL), b AS (SELECT 'Observation' AS side, obs AS string, anat AS other, n FROM n UNION ALL SELECT 'Anatomy', anat, obs, n FROM n)
SELECT side, string, other, n, CAST(row_number() OVER (PARTITION BY side, string ORDER BY n DESC, other) AS INTEGER) AS place FROM b QUALIFY row_number() OVER (PARTITION BY side, string ORDER BY n DESC, other) <= 5"""
)
def located_context(spark: SparkSession, d: str) -> DataFrame:
    return V.context(V.located_pairs(mentions(spark, d)))


@query(
    MENTIONS + """, n AS (SELECT obs, anat, count(*) AS n FROM pairs GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY obs) AS t, sum(n) OVER (PARTITION BY obs ORDER BY n DESC, anat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY obs ORDER BY n DESC, anat) AS i FROM n)
SELECT obs, anat, n, round(n / t::DOUBLE, 6) AS share FROM w WHERE i <= 12 AND coalesce(b, 0) / t < 0.5"""
)
def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.frequent_pairs(V.located_pairs(mentions(spark, d)), 0.5, 12)


def string_links(spark: SparkSession, d: str) -> DataFrame:
    """(kind, string, cui): strings whose number is even have a concept."""
    v = V.vocabulary(mentions(spark, d))
    return v.select("kind", "string", "mentions", F.when(F.regexp_extract("string", "([0-9]+)$", 1).cast("int") % 2 == 0, F.concat(F.lit("C"), F.col("string"))).alias("cui"))


def pair_concepts(spark: SparkSession, d: str) -> DataFrame:
    """(obs, anat, n, phrase, cui): frequent pairs; those whose count is divisible by 3 have no concept."""
    p = frequent_pairs(spark, d)
    return p.select("obs", "anat", "n", F.concat_ws(" ", "anat", "obs").alias("phrase"), F.when(F.col("n") % 3 != 0, F.concat(F.lit("P"), "obs", "anat")).alias("cui"))


LINKED = MENTIONS + """, v AS (SELECT kind, joined AS string, count(*) AS mentions FROM m GROUP BY ALL), links AS (SELECT *, CASE WHEN regexp_extract(string, '([0-9]+)$', 1)::INTEGER % 2 = 0 THEN 'C' || string END AS cui FROM v),
n AS (SELECT obs, anat, count(*) AS n FROM pairs GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY obs) AS t, sum(n) OVER (PARTITION BY obs ORDER BY n DESC, anat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY obs ORDER BY n DESC, anat) AS i FROM n),
plinks AS (SELECT obs, anat, n, anat || ' ' || obs AS phrase, CASE WHEN n % 3 <> 0 THEN 'P' || obs || anat END AS cui FROM w WHERE i <= 12 AND coalesce(b, 0) / t < 0.5),
pc AS (SELECT study_id, section, entity, min(cui) AS cui FROM pairs JOIN plinks USING (obs, anat) WHERE cui IS NOT NULL GROUP BY ALL),
mc AS (SELECT m.study_id, m.section, m.entity, m.kind, m.polarity, coalesce(pc.cui, l.cui) AS cui, m.located_at FROM m LEFT JOIN (SELECT kind, string, cui FROM links WHERE cui IS NOT NULL) l ON m.kind = l.kind AND m.joined = l.string
  LEFT JOIN pc ON m.study_id = pc.study_id AND m.section = pc.section AND m.entity = pc.entity AND m.kind = 'Observation' WHERE coalesce(pc.cui, l.cui) IS NOT NULL)
"""


@query(LINKED + "SELECT study_id, section, entity, kind, polarity, cui FROM mc")
def mention_concepts(spark: SparkSession, d: str) -> DataFrame:
    return V.mention_concepts(mentions(spark, d), string_links(spark, d), pair_concepts(spark, d)).select("study_id", "section", "entity", "kind", "polarity", "cui")


@query(
    LINKED + """, rel AS (SELECT s.study_id, s.cui AS src, t.cui AS dst FROM mc s JOIN mc t ON s.study_id = t.study_id AND s.section = t.section AND s.located_at = t.entity WHERE s.kind = 'Observation' AND s.polarity = 'present' AND t.kind = 'Anatomy'),
ns AS (SELECT cui AS src, count(DISTINCT study_id) AS n_src FROM mc WHERE kind = 'Observation' AND polarity = 'present' GROUP BY cui)
SELECT src, dst, n, n_src, round(n / n_src::DOUBLE, 6) AS p FROM (SELECT src, dst, count(DISTINCT study_id) AS n FROM rel WHERE src <> dst GROUP BY ALL HAVING count(DISTINCT study_id) >= 5) JOIN ns USING (src)"""
)
def typical_edges(spark: SparkSession, d: str) -> DataFrame:
    found = cut(V.mention_concepts(mentions(spark, d), string_links(spark, d), pair_concepts(spark, d)))
    present = found.where("kind = 'Observation' AND polarity = 'present'").select("study_id", F.col("cui").alias("src"))
    return G.weighted_edges(V.related_concepts(found, "located_at", "Anatomy"), present, "study_id", "src", "dst", 5)


@query(LINKED + "SELECT cui, string, CAST(sum(mentions) AS BIGINT) AS mentions FROM (SELECT cui, string, mentions FROM links WHERE cui IS NOT NULL UNION ALL SELECT cui, phrase, n FROM plinks WHERE cui IS NOT NULL) GROUP BY ALL")
def pool_strings(spark: SparkSession, d: str) -> DataFrame:
    return V.pool_strings(string_links(spark, d), pair_concepts(spark, d))


@query(
    LINKED + """, spot AS (SELECT obs AS string, study_id, section, entity, bool_or(cui IS NOT NULL) AS l FROM pairs LEFT JOIN plinks USING (obs, anat) GROUP BY ALL), a AS (SELECT string, count(*) AS located, count(*) FILTER (l) AS linked FROM spot GROUP BY string)
SELECT joined AS string, count(*) AS mentions, coalesce(any_value(located), 0) AS located, coalesce(any_value(linked), 0) AS linked FROM m LEFT JOIN a ON joined = string WHERE kind = 'Observation' GROUP BY joined"""
)
def pair_share(spark: SparkSession, d: str) -> DataFrame:
    return V.pair_share(mentions(spark, d), pair_concepts(spark, d))


@query(
    CLEAN + """, said2 AS (SELECT 'R' || row_number() OVER (ORDER BY src, rel, dst) AS study_id, src AS cui, CASE rel WHEN 'SUGGESTS' THEN 'PRESENT' WHEN 'TYPICALLY_AT' THEN 'UNCERTAIN' ELSE 'ABSENT' END AS polarity FROM clean WHERE rel IN ('SUGGESTS', 'TYPICALLY_AT', 'IS_A')),
walk(concept, cui) AS (SELECT DISTINCT dst, dst FROM clean WHERE rel = 'SUGGESTS' UNION SELECT w.concept, l.child FROM walk w JOIN links l ON l.rel = 'IS_A' AND l.parent = w.cui)
SELECT substr(sha256(cui), 1, 1) AS study_id, concept, CASE min(CASE polarity WHEN 'PRESENT' THEN 1 WHEN 'UNCERTAIN' THEN 2 ELSE 3 END) WHEN 1 THEN 'PRESENT' WHEN 2 THEN 'UNCERTAIN' ELSE 'ABSENT' END AS status FROM said2 JOIN walk USING (cui) GROUP BY ALL"""
)
def silver_status(spark: SparkSession, d: str) -> DataFrame:
    """Each source of an edge is a mention in a study (the first digit of its hash); a disease takes the strongest polarity of
    itself and all concepts below it."""
    e = edges(spark, d)
    polarity = F.when(F.col("rel") == "SUGGESTS", "present").when(F.col("rel") == "TYPICALLY_AT", "uncertain").otherwise("absent")
    found = e.where("rel IN ('SUGGESTS', 'TYPICALLY_AT', 'IS_A')").select(F.substring(F.sha2("src", 256), 1, 1).alias("study_id"), F.col("src").alias("cui"), polarity.alias("polarity"))
    tops = e.where("rel = 'SUGGESTS'").select(F.col("dst").alias("concept")).distinct()
    down = links(spark, d).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    below = G.steps(down, tops.select(F.col("concept").alias("seed"), F.col("concept").alias("node"))).select(F.col("seed").alias("concept"), F.col("node").alias("cui"))
    return V.silver_status(found, tops.select("concept", F.col("concept").alias("cui")).unionByName(below))
