"""Queries of linking and graph building. Parts stand for a terminology: a brand is a concept, part names are its names, part
types their sources; concepts of the edge table are related by its hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import linking as K
from tamarack.session import table

QUERIES, SQL = {}, {}
ORDER = ("STANDARD", "ECONOMY", "PROMO")
SIDES = ("small", "large")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("cui"), F.col("p_name").alias("text"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("source"), (F.col("p_size") % 5 == 0).alias("preferred"))


def types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("cui"), F.concat(F.lit("T"), F.col("p_size") % 7).alias("type")).distinct()


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Observation", "T1"), ("Observation", "T2"), ("Anatomy", "T3")], "kind string, type string")


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Brand#n lies below Brand#(n modulo 5 + 1), the first five below none."""
    b = table(spark, d, "part").select(F.col("p_brand").alias("child"), F.substring("p_brand", 7, 9).cast("int").alias("n")).distinct().where("n > 5")
    return b.select(F.concat(F.lit("Brand#"), F.col("n") % 5 + 1).alias("parent"), "child")


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Observation", "Brand#2", "-"), ("Observation", "Brand#6", "+"), ("Anatomy", "Brand#4", "-")], "kind string, cui string, sign string")


def inside(spark: SparkSession, d: str) -> DataFrame:
    return K.domain(types(spark, d), kinds(spark), names(spark, d), ["PROMO"], relations(spark, d), roots(spark))


TERMS = """WITH RECURSIVE names AS (SELECT p_brand AS cui, p_name AS text, string_split(p_type, ' ')[1] AS source, p_size % 5 = 0 AS preferred FROM part), types AS (SELECT DISTINCT p_brand AS cui, 'T' || (p_size % 7) AS type FROM part),
kinds(kind, type) AS (VALUES ('Observation', 'T1'), ('Observation', 'T2'), ('Anatomy', 'T3')), rel AS (SELECT DISTINCT 'Brand#' || (substr(p_brand, 7)::INTEGER % 5 + 1) AS parent, p_brand AS child FROM part WHERE substr(p_brand, 7)::INTEGER > 5),
roots(kind, cui, sign) AS (VALUES ('Observation', 'Brand#2', '-'), ('Observation', 'Brand#6', '+'), ('Anatomy', 'Brand#4', '-')),
below(kind, sign, cui) AS (SELECT kind, sign, cui FROM roots UNION SELECT b.kind, b.sign, r.child FROM below b JOIN rel r ON r.parent = b.cui),
dropped AS (SELECT kind, cui FROM below WHERE sign = '-' EXCEPT SELECT kind, cui FROM below WHERE sign = '+'),
domain AS (SELECT DISTINCT kind, cui FROM types JOIN kinds USING (type) WHERE cui IN (SELECT cui FROM names WHERE source <> 'PROMO') AND (kind, cui) NOT IN (SELECT (kind, cui) FROM dropped)),
queries AS (SELECT DISTINCT k.kind, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS query FROM names, (SELECT DISTINCT kind FROM kinds) k),
norm AS (SELECT cui, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS query, preferred FROM names), nsrc AS (SELECT cui, count(DISTINCT source) AS n FROM names GROUP BY cui),
exact AS (SELECT kind, query, cui, row_number() OVER (PARTITION BY kind, query ORDER BY p DESC, n DESC, cui) AS rank, count(*) OVER (PARTITION BY kind, query) AS n_candidates FROM (SELECT q.kind, q.query, cui, bool_or(preferred) AS p FROM queries q JOIN norm USING (query) JOIN domain USING (kind, cui) GROUP BY ALL) JOIN nsrc USING (cui))
"""


@query(TERMS + "SELECT kind, cui FROM domain")
def concept_domain(spark: SparkSession, d: str) -> DataFrame:
    return inside(spark, d)


@query(TERMS + "SELECT kind, count(*) AS label_table, count(*) FILTER ((kind, cui) IN (SELECT (kind, cui) FROM domain)) AS domain FROM (SELECT DISTINCT kind, cui FROM types JOIN kinds USING (type)) GROUP BY kind")
def domain_sizes(spark: SparkSession, d: str) -> DataFrame:
    return K.domain_sizes(types(spark, d), kinds(spark), inside(spark, d))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.functions.text import name_norm

    q = names(spark, d).select(name_norm("text").alias("query")).distinct()
    return q.crossJoin(F.broadcast(kinds(spark).select("kind").distinct()))


def exact(spark: SparkSession, d: str) -> DataFrame:
    return K.exact_matches(_queries(spark, d), names(spark, d), inside(spark, d))


@query(TERMS + "SELECT kind, query, cui, CAST(rank AS INTEGER) AS rank, n_candidates FROM exact")
def exact_matches(spark: SparkSession, d: str) -> DataFrame:
    return exact(spark, d)


@query(
    TERMS + """, s AS (SELECT cui, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources FROM names GROUP BY cui), t AS (SELECT cui, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM types GROUP BY cui)
SELECT cui, text AS name, n_sources, sources, types FROM (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY cui ORDER BY NOT preferred, CASE WHEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) > 0 THEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) - 1 ELSE 3 END, source, text) = 1) JOIN s USING (cui) LEFT JOIN t USING (cui)"""
)
def preferred_names(spark: SparkSession, d: str) -> DataFrame:
    return K.describe(names(spark, d), types(spark, d), ORDER)


@query(
    TERMS + """, forms AS (SELECT DISTINCT string_split(text, ' ')[1] AS label, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS form, length(text) % 2 = 0 AS own FROM names),
per AS (SELECT label, cui, bool_or(own) AS own, count(DISTINCT form) AS n_forms, bool_or(preferred) AS p FROM forms JOIN norm ON form = query GROUP BY ALL)
SELECT label, cui, own, n_forms, CAST(row_number() OVER w AS INTEGER) AS rank FROM per JOIN nsrc USING (cui) WINDOW w AS (PARTITION BY label ORDER BY own DESC, n_forms DESC, p DESC, n DESC, cui) QUALIFY row_number() OVER w <= 3"""
)
def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    from tamarack.functions.text import name_norm

    forms = names(spark, d).select(F.split_part("text", F.lit(" "), F.lit(1)).alias("label"), name_norm("text").alias("form"), (F.length("text") % 2 == 0).alias("own")).distinct()
    return K.label_candidates(forms, names(spark, d), 3)


def decided(spark: SparkSession, d: str) -> DataFrame:
    """(kind, string, mentions, method, decision, cui, agree): part names with what was decided about them."""
    p = table(spark, d, "part").join(table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")), "p_partkey", "left")
    per = p.groupBy(F.when(F.col("p_size") % 2 == 0, "Observation").otherwise("Anatomy").alias("kind"), F.col("p_name").alias("string")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("mentions"), F.min("p_brand").alias("b"), F.count(F.lit(1)).alias("c"))
    k = F.col("c") % 4
    return per.select("kind", "string", "mentions", F.when(k == 0, "exact").when(k == 1, "llm").when(k == 2, "llm_disagree").otherwise("rule").alias("method"), F.when(k == 2, "pending").otherwise("cui").alias("decision"), F.when(k != 2, F.col("b")).alias("cui"), F.when(k.isin(1, 2), k == 1).alias("agree"))


DECIDED = TERMS + """, dec AS (SELECT kind, string, mentions, CASE c % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'llm' WHEN 2 THEN 'llm_disagree' ELSE 'rule' END AS method, CASE WHEN c % 4 = 2 THEN 'pending' ELSE 'cui' END AS decision, CASE WHEN c % 4 <> 2 THEN b END AS cui, CASE WHEN c % 4 IN (1, 2) THEN c % 4 = 1 END AS agree
  FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'Observation' ELSE 'Anatomy' END AS kind, p_name AS string, CAST(sum(coalesce(n, 0)) AS BIGINT) AS mentions, min(p_brand) AS b, count(*) AS c FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY ALL))
"""


@query(DECIDED + "SELECT kind, round(sum(mentions) FILTER (decision NOT IN ('none', 'pending')) / sum(mentions)::DOUBLE, 6) AS decided, round(sum(mentions) FILTER (cui IS NOT NULL) / sum(mentions)::DOUBLE, 6) AS linked FROM dec GROUP BY GROUPING SETS ((kind), ())")
def link_coverage(spark: SparkSession, d: str) -> DataFrame:
    return K.link_coverage(decided(spark, d))


@query(DECIDED + "SELECT kind, method, count(*) AS strings, CAST(sum(mentions) AS BIGINT) AS mentions FROM dec GROUP BY ALL")
def link_methods(spark: SparkSession, d: str) -> DataFrame:
    return K.method_counts(decided(spark, d))


@query(DECIDED + "SELECT kind, count(*) AS answered, count(*) FILTER (agree) AS agree FROM dec WHERE agree IS NOT NULL GROUP BY kind")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    return K.model_agreement(decided(spark, d))


@query(
    DECIDED + """, ph AS (SELECT DISTINCT string_split(string, ' ')[1] AS label, string FROM dec), ex AS (SELECT DISTINCT string_split(text, ' ')[1] AS label, cui FROM names WHERE preferred)
SELECT label, count(*) AS strings, count(dec.cui) AS linked, count(ex.cui) AS ok FROM dec JOIN ph USING (string) LEFT JOIN ex USING (label, cui) WHERE kind = 'Observation' AND label IN (SELECT label FROM ex) GROUP BY GROUPING SETS ((label), ())"""
)
def phrase_rates(spark: SparkSession, d: str) -> DataFrame:
    rows, n = decided(spark, d), names(spark, d)
    phrases = rows.select(F.split_part("string", F.lit(" "), F.lit(1)).alias("label"), "string")
    return K.phrase_rates(rows, phrases, n.where("preferred").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("label"), "cui"))


@query(
    DECIDED + """, s AS (SELECT cui, list(DISTINCT source) AS sources FROM names GROUP BY cui), t AS (SELECT cui, list(DISTINCT type) AS types FROM types GROUP BY cui), kt AS (SELECT kind, list(type) AS kt FROM kinds GROUP BY kind),
pn AS (SELECT cui, text AS name FROM names QUALIFY row_number() OVER (PARTITION BY cui ORDER BY NOT preferred, CASE WHEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) > 0 THEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) - 1 ELSE 3 END, source, text) = 1)
SELECT dec.kind, string, dec.cui, array_to_string(list_sort(list_filter([CASE WHEN dec.cui IS NOT NULL AND list_has_all(['STANDARD', 'ECONOMY', 'PROMO'], sources) THEN 'thin_sources' END,
  CASE WHEN dec.cui IS NOT NULL AND list_has_any(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), ['small', 'red']) THEN 'off_domain_word' END, CASE WHEN dec.cui IS NOT NULL AND NOT coalesce(list_has_any(types, kt), false) THEN 'type_mismatch' END,
  CASE WHEN dec.cui IS NOT NULL AND string[1] = 's' THEN 'skip_listed' END], lambda x: x IS NOT NULL)), ';') AS flags FROM dec LEFT JOIN s USING (cui) LEFT JOIN t USING (cui) LEFT JOIN pn USING (cui) LEFT JOIN kt USING (kind)"""
)
def link_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = decided(spark, d).withColumn("lateral_unresolved", F.lit(False))
    skipped = [r.string for r in rows.where("string LIKE 's%'").select("string").distinct().collect()]  # a stated list of a few names
    return K.link_flags(rows, K.describe(names(spark, d), types(spark, d), ORDER), kinds(spark), thin=ORDER, words=["small", "red"], skipped=skipped or [""]).select("kind", "string", "cui", "flags")


@query(
    DECIDED + """, g AS (SELECT CASE length(string) % 4 WHEN 0 THEN 'incorrect' WHEN 1 THEN 'unsure' ELSE 'correct' END AS g, mentions AS m FROM dec WHERE cui IS NOT NULL), n AS (SELECT count(*) FILTER (g = 'correct') AS correct, count(*) FILTER (g <> 'unsure') AS graded, count(*) FILTER (g = 'unsure') AS unsure, sum(m) FILTER (g = 'correct') AS r, sum(m) FILTER (g <> 'unsure') AS t FROM g),
w AS (SELECT *, correct / graded::DOUBLE AS p, 1.96 * 1.96 AS zz FROM n)
SELECT correct, graded, unsure, round(p, 6) AS precision, round((p + zz / (2 * graded)) / (1 + zz / graded) - 1.96 * sqrt(p * (1 - p) / graded + zz / (4 * graded * graded)) / (1 + zz / graded), 6) AS low,
  round((p + zz / (2 * graded)) / (1 + zz / graded) + 1.96 * sqrt(p * (1 - p) / graded + zz / (4 * graded * graded)) / (1 + zz / graded), 6) AS high, round(r / t::DOUBLE, 6) AS by_mentions FROM w"""
)
def link_precision(spark: SparkSession, d: str) -> DataFrame:
    k = F.length("string") % 4
    return K.precision(decided(spark, d).where("cui IS NOT NULL").withColumn("grade", F.when(k == 0, "incorrect").when(k == 1, "unsure").otherwise("correct")), "grade")


# graph building over the concepts of the edge table

from tamarack.operators import graph as G  # noqa: E402
from tamarack.operators import kgraph as B  # noqa: E402
from tamarack.queries.graphs import CLEAN, edges, links, scorable  # noqa: E402
from tamarack.queries.retrieval import SCORES, scores  # noqa: E402
from tamarack.session import cut  # noqa: E402


@query(
    TERMS.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + """, core(cui, kind) AS (VALUES ('Brand#1', 'Anatomy'), ('Brand#3', 'Observation'), ('Brand#9', 'Observation')), finds AS (SELECT DISTINCT cui FROM types WHERE type IN ('T1', 'T2', 'T4')),
dom AS (SELECT DISTINCT kind, cui FROM types, (VALUES ('Anatomy'), ('Observation')) k(kind)), obs AS (SELECT cui FROM dom JOIN finds USING (cui) WHERE kind = 'Observation'),
g AS (SELECT child AS cui, 'Anatomy' AS kind FROM rel JOIN core ON parent = cui WHERE kind = 'Anatomy' AND child IN (SELECT cui FROM dom) UNION SELECT parent, 'Anatomy' FROM rel JOIN core ON child = cui WHERE kind = 'Anatomy' AND parent IN (SELECT cui FROM dom)
  UNION SELECT child, 'Observation' FROM rel JOIN core ON parent = core.cui WHERE kind = 'Observation' AND core.cui IN (SELECT cui FROM finds) AND child IN (SELECT cui FROM obs)
  UNION SELECT parent, 'Observation' FROM rel JOIN core ON child = core.cui WHERE kind = 'Observation' AND core.cui IN (SELECT cui FROM finds) AND parent IN (SELECT cui FROM obs) AND parent <> 'Brand#2'),
lat AS (SELECT cui FROM (SELECT cui, text FROM names QUALIFY row_number() OVER (PARTITION BY cui ORDER BY NOT preferred, CASE WHEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) > 0 THEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) - 1 ELSE 3 END, source, text) = 1) WHERE list_has_any(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), ['small', 'large']))
SELECT cui, kind, true AS in_core FROM core UNION ALL SELECT cui, kind, false FROM g WHERE cui NOT IN (SELECT cui FROM lat) AND (cui, kind) NOT IN (SELECT (cui, kind) FROM core)"""
)
def core_growth(spark: SparkSession, d: str) -> DataFrame:
    core = spark.createDataFrame([("Brand#1", "Anatomy"), ("Brand#3", "Observation"), ("Brand#9", "Observation")], "cui string, kind string")
    every = types(spark, d).select("cui").distinct().crossJoin(F.broadcast(spark.createDataFrame([("Anatomy",), ("Observation",)], "kind string")))
    findings = types(spark, d).where("type IN ('T1', 'T2', 'T4')").select("cui").distinct()
    r = relations(spark, d)
    stop = spark.createDataFrame([("Brand#2",)], "node string")
    return B.grow(core, every, findings, r, r, K.describe(names(spark, d), types(spark, d), ORDER), anatomy_depth=1, down=1, up=1, stop=stop, sides=SIDES)


@query(TERMS + ", e AS (SELECT DISTINCT child, parent, source FROM rel JOIN names ON names.cui = child) SELECT child AS src, 'IS_A' AS rel, parent AS dst, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM e GROUP BY ALL")
def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    stated = relations(spark, d).join(names(spark, d).select(F.col("cui").alias("child"), "source").distinct(), "child")
    return B.hierarchy_edges(stated, types(spark, d), "IS_A").select("src", "rel", "dst", "source")


@query(
    TERMS + """, a AS (SELECT cui, text, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS norm, 'en' AS lang, source FROM names)
SELECT cui, text, norm, lang, source FROM a QUALIFY row_number() OVER (PARTITION BY cui, norm, lang ORDER BY CASE WHEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) > 0 THEN list_position(['STANDARD', 'ECONOMY', 'PROMO'], source) - 1 ELSE 3 END, text, source) = 1"""
)
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    rows = names(spark, d).withColumn("lang", F.lit("en")).groupBy("cui", "text", "lang").agg(F.min_by("source", F.struct(K.source_rank(ORDER), "source")).alias("source"))
    return B.alias_table(rows, ORDER)


@query(
    TERMS + """, a AS (SELECT DISTINCT cui, trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) AS norm FROM names), o AS (SELECT norm, count(*) AS n FROM a GROUP BY norm)
SELECT cui, norm, array_to_string(list_filter([CASE WHEN norm IN ('red bolt', 'hot gear') THEN 'blocked' END, CASE WHEN n > 1 THEN 'ambiguous' END, CASE WHEN length(norm) < 3 THEN 'short' END], lambda x: x IS NOT NULL), ';') AS flags FROM a JOIN o USING (norm)"""
)
def alias_flags(spark: SparkSession, d: str) -> DataFrame:
    return B.alias_flags(alias_table(spark, d), ["red bolt", "hot gear"])


@query(CLEAN + "SELECT cui, array_to_string(list_slice(list_sort(list(DISTINCT parent) FILTER (parent IS NOT NULL)), 1, 3), '/') AS parents FROM scorable LEFT JOIN (SELECT * FROM links WHERE rel = 'IS_A') l ON l.child = cui GROUP BY cui")
def concept_parents(spark: SparkSession, d: str) -> DataFrame:
    return B.parents_of(links(spark, d), scorable(edges(spark, d))).select("cui", F.when(F.size("parents") > 0, F.array_join("parents", "/")).alias("parents"))


@query(CLEAN + "SELECT src, dst, n, p FROM clean WHERE rel = 'SUGGESTS' ORDER BY n DESC NULLS LAST, p DESC NULLS LAST, src, dst LIMIT 30")
def strongest_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.strongest_edges(edges(spark, d), "SUGGESTS", 30).select("src", "dst", "n", "p")


@query(
    SCORES + "SELECT concept, vec_id AS image, round(logit, 6) AS logit, CAST(row_number() OVER (PARTITION BY concept ORDER BY round(logit, 6) DESC, vec_id) AS INTEGER) AS rank FROM (UNPIVOT (SELECT vec_id, "
    + ", ".join(f"c{i}" for i in range(10)) + " FROM s) ON * EXCLUDE (vec_id) INTO NAME concept VALUE logit) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY round(logit, 6) DESC, vec_id) <= 5"
)
def predicted_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).select("vec_id", *[F.round(f"c{i}", 6).alias(f"c{i}") for i in range(10)])
    return B.predicted_edges(rows, [f"c{i}" for i in range(10)], "vec_id", 5)


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the edge table with labels by what relations they have; mentioned as often as they have edges."""
    e = edges(spark, d)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("cui"), F.concat(F.lit("s"), "rel").alias("r")), F.struct(F.col("dst").alias("cui"), F.concat(F.lit("d"), "rel").alias("r")))).alias("x")).select("x.*")
    n = ends.where("cui LIKE 'C%'").groupBy("cui").agg(F.count(F.lit(1)).alias("n_pool"), F.bool_or(F.col("r") == "dSUGGESTS").alias("dis"), F.bool_or(F.col("r") == "dTYPICALLY_AT").alias("ana"), F.bool_or(F.col("r").isin("sSUGGESTS", "sTYPICALLY_AT")).alias("scorable"))
    labels = F.array_join(F.array_compact(F.array(F.when(F.col("ana"), "Anatomy"), F.when(F.col("dis"), "Disease"), F.when(~F.col("ana") & ~F.col("dis"), "Finding"))), ",")
    return cut(n.select("cui", F.col("cui").alias("name"), labels.alias("labels"), "scorable", "n_pool"))


NODES = CLEAN + """, ends AS (SELECT src AS cui, 's' || rel AS r FROM clean UNION ALL SELECT dst, 'd' || rel FROM clean),
nodes AS (SELECT cui, count(*) AS n_pool, concat_ws(',', CASE WHEN bool_or(r = 'dTYPICALLY_AT') THEN 'Anatomy' END, CASE WHEN bool_or(r = 'dSUGGESTS') THEN 'Disease' END, CASE WHEN NOT bool_or(r IN ('dTYPICALLY_AT', 'dSUGGESTS')) THEN 'Finding' END) AS labels, bool_or(r IN ('sSUGGESTS', 'sTYPICALLY_AT')) AS scorable FROM ends WHERE cui LIKE 'C%' GROUP BY cui)
"""


@query(NODES + "SELECT 'node' AS what, name, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS name FROM nodes) GROUP BY name UNION ALL SELECT 'edge', rel, count(*) FROM clean GROUP BY rel")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.graph_counts(graph_nodes(spark, d), edges(spark, d))


@query(
    NODES + """, r AS (SELECT cui, n_pool, CASE WHEN list_has_any(string_split(labels, ','), ['Anatomy', 'Device']) OR NOT list_has_any(string_split(labels, ','), ['Finding', 'Disease']) THEN 'anatomy or device' WHEN cui LIKE '%7' THEN 'nothing names it' ELSE '' END AS reason FROM nodes),
k AS (SELECT cui, row_number() OVER (ORDER BY n_pool DESC, cui) AS i FROM r WHERE reason = '')
SELECT r.cui, r.n_pool, CASE WHEN i <= 40 THEN 'candidate' ELSE 'excluded' END AS status, CASE WHEN i > 40 THEN 'beyond the first 40' ELSE reason END AS reason FROM r LEFT JOIN k USING (cui)"""
)
def candidate_cascade(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    strings = n.where("cui NOT LIKE '%7'").select("cui", F.concat(F.lit("name of "), "cui").alias("string"), F.lit(1).alias("mentions"))
    return B.candidate_cascade(n, strings, [], [], 40).select("cui", "n_pool", "status", "reason")


@query(
    NODES + """, walk(seed, cui) AS (SELECT cui, cui FROM nodes UNION SELECT w.seed, l.child FROM walk w JOIN links l ON l.rel = 'IS_A' AND l.parent = w.cui),
up(seed, cui, h) AS (SELECT cui, cui, 0 FROM nodes UNION SELECT u.seed, l.parent, u.h + 1 FROM up u JOIN links l ON l.rel = 'IS_A' AND l.child = u.cui WHERE u.h < 3)
SELECT n.cui, CASE WHEN scorable THEN 'direct' WHEN EXISTS (SELECT 1 FROM walk w JOIN scorable s ON s.cui = w.cui WHERE w.seed = n.cui) THEN 'wider' WHEN EXISTS (SELECT 1 FROM up w JOIN scorable s ON s.cui = w.cui WHERE w.seed = n.cui) THEN 'narrower'
  WHEN list_contains(string_split(labels, ','), 'Disease') AND n.cui IN (SELECT dst FROM clean WHERE rel = 'SUGGESTS' AND coalesce(review, 'keep') <> 'drop') THEN 'suggests' WHEN list_contains(string_split(labels, ','), 'Anatomy') AND n.cui IN (SELECT dst FROM clean WHERE rel = 'TYPICALLY_AT') THEN 'typically_at' ELSE 'none' END AS route FROM nodes n"""
)
def concept_routes(spark: SparkSession, d: str) -> DataFrame:
    n, e, l = graph_nodes(spark, d), edges(spark, d), links(spark, d)
    seeds, s = n.select(F.col("cui").alias("seed")), scorable(e)
    down = G.steps(l.select(F.col("parent").alias("a"), F.col("child").alias("b")), seeds.select("seed", F.col("seed").alias("node"))).join(s.select(F.col("cui").alias("node")), "node", "left_semi").select("seed", F.col("node").alias("cui"))
    up = G.scorable_above(l, seeds, s, 3)
    into = lambda rel, c: e.where((F.col("rel") == rel) & c).select(F.col("dst").alias("seed"), F.col("src").alias("cui"))
    return B.routes(n, down, up, into("SUGGESTS", G.kept()), into("TYPICALLY_AT", F.lit(True)), s.limit(0))


@query(CLEAN + "SELECT count(*) AS n FROM clean e WHERE src IN (SELECT cui FROM scorable) AND dst IN (SELECT cui FROM scorable)")
def edges_between_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.missing_ends(e, scorable(e)).agg(F.count(F.lit(1)).alias("n"))
