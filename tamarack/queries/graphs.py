"""Queries of the concept graph, of parsing and of lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import parsing as P
from tamarack.operators import graph as G
from tamarack.operators.lookup import ranked_names
from tamarack.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    return cut(G.clean_edges(table(spark, d, "edges")))


def scorable(e: DataFrame) -> DataFrame:
    """Concepts with a score column stand for those that any report suggests something from."""
    return e.where("rel IN ('SUGGESTS', 'TYPICALLY_AT')").select(F.col("src").alias("cui")).distinct()


def seeds(e: DataFrame, rel: str) -> DataFrame:
    return e.where(F.col("rel") == rel).select(F.col("dst").alias("seed")).distinct()


def links(spark: SparkSession, d: str, rel: str = "IS_A") -> DataFrame:
    return cut(G.is_a(table(spark, d, "edges"), rel))


CLEAN = """WITH RECURSIVE said AS (
  SELECT regexp_replace(lower(coalesce(rel, '')), '[^a-z]', '', 'g') AS r, regexp_extract(upper(coalesce(src, '')), '^\\s*(?:CUI:\\s*)?([CT]\\d+)\\s*$', 1) AS s,
    regexp_extract(upper(coalesce(dst, '')), '^\\s*(?:CUI:\\s*)?([CT]\\d+)\\s*$', 1) AS t, source, n, n_src, p, lower(trim(review)) AS review FROM edges
), turned AS (
  SELECT CASE WHEN r IN ('inverseisa', 'haspart') THEN t ELSE s END AS src, CASE WHEN r IN ('isa', 'inverseisa') THEN 'IS_A' WHEN r IN ('partof', 'haspart') THEN 'PART_OF'
    WHEN r = 'suggests' THEN 'SUGGESTS' WHEN r = 'typicallyat' THEN 'TYPICALLY_AT' WHEN r = 'hassty' THEN 'HAS_STY' END AS rel, CASE WHEN r IN ('inverseisa', 'haspart') THEN s ELSE t END AS dst, source, n, n_src, p, review FROM said
), clean AS (
  SELECT * FROM turned WHERE src <> '' AND dst <> '' AND rel IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src, rel, dst ORDER BY coalesce(p, -1) DESC, source DESC NULLS LAST, n DESC NULLS LAST, n_src DESC NULLS LAST, p DESC NULLS LAST, review DESC NULLS LAST) = 1
), scorable AS (SELECT DISTINCT src AS cui FROM clean WHERE rel IN ('SUGGESTS', 'TYPICALLY_AT')),
links AS (SELECT DISTINCT turned.rel, src AS child, dst AS parent FROM turned WHERE turned.rel IN ('IS_A', 'PART_OF') AND src LIKE 'C%' AND dst LIKE 'C%' AND coalesce(review, '') <> 'drop')
"""


@query(CLEAN + "SELECT rel, coalesce(source, '-') AS source, count(*) AS n FROM clean GROUP BY ALL")
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.clean_edges(table(spark, d, "edges")).groupBy("rel", F.coalesce("source", F.lit("-")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _below(seed_rel: str, link_rel: str, depth: int) -> str:
    return f""", below(seed, node, hops) AS (
  SELECT DISTINCT dst, dst, 0 FROM clean WHERE rel = '{seed_rel}'
  UNION
  SELECT b.seed, l.child, b.hops + 1 FROM below b JOIN links l ON l.rel = '{link_rel}' AND l.parent = b.node WHERE b.hops < {depth}
), reach AS (SELECT seed, node, min(hops) AS hops FROM below GROUP BY ALL)
"""


@query(CLEAN + _below("SUGGESTS", "IS_A", 3) + "SELECT seed, node, CAST(hops AS INTEGER) AS hops FROM reach WHERE hops > 0")
def bounded_steps(spark: SparkSession, d: str) -> DataFrame:
    s = seeds(edges(spark, d), "SUGGESTS")
    down = links(spark, d).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return G.steps(down, s.select("seed", F.col("seed").alias("node")), 3)


@query(
    CLEAN
    + """, walk(seed, node) AS (
  SELECT DISTINCT dst, dst FROM clean WHERE rel = 'SUGGESTS' UNION SELECT w.seed, l.child FROM walk w JOIN links l ON l.rel = 'IS_A' AND l.parent = w.node
) SELECT seed, node FROM walk WHERE seed <> node"""
)
def closure_down(spark: SparkSession, d: str) -> DataFrame:
    s = seeds(edges(spark, d), "SUGGESTS")
    down = links(spark, d).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return G.steps(down, s.select("seed", F.col("seed").alias("node"))).select("seed", "node")


@query(CLEAN + _below("SUGGESTS", "IS_A", 3) + "SELECT seed, node AS cui, CAST(hops AS INTEGER) AS hops FROM reach JOIN scorable ON node = cui")
def scorable_below(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.scorable_below(links(spark, d), seeds(e, "SUGGESTS"), scorable(e), 3)


@query(
    CLEAN
    + """, up(seed, node, hops) AS (
  SELECT DISTINCT dst, dst, 0 FROM clean WHERE rel = 'TYPICALLY_AT' UNION SELECT u.seed, l.parent, u.hops + 1 FROM up u JOIN links l ON l.rel = 'IS_A' AND l.child = u.node WHERE u.hops < 4)
SELECT seed, node AS cui, CAST(hops AS INTEGER) AS hops FROM up JOIN scorable ON node = cui WHERE hops > 0 AND node <> seed QUALIFY row_number() OVER (PARTITION BY seed ORDER BY hops, node) = 1"""
)
def scorable_above(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.scorable_above(links(spark, d), seeds(e, "TYPICALLY_AT"), scorable(e), 4)


@query(
    CLEAN
    + _below("SUGGESTS", "IS_A", 2)
    + """, met AS (SELECT seed, src AS cui, p, n, dst AS target FROM reach JOIN clean ON clean.dst = reach.node WHERE rel = 'SUGGESTS' AND (source = 'manual' OR n >= 20) AND coalesce(review, 'keep') <> 'drop' AND src IN (SELECT cui FROM scorable))
SELECT seed, cui, p, n, target FROM met QUALIFY row_number() OVER (PARTITION BY seed, cui ORDER BY coalesce(p, -1) DESC, target DESC) = 1"""
)
def suggesting(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.strongest_into(e, "SUGGESTS", links(spark, d), seeds(e, "SUGGESTS"), scorable(e), 2, 20, manual_exempt=True, review=True)


@query(
    CLEAN
    + _below("TYPICALLY_AT", "PART_OF", 2)
    + """, met AS (SELECT seed, src AS cui, p, n, dst AS target FROM reach JOIN clean ON clean.dst = reach.node WHERE rel = 'TYPICALLY_AT' AND n >= 10 AND src IN (SELECT cui FROM scorable)),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY seed, cui ORDER BY coalesce(p, -1) DESC, target DESC) = 1)
SELECT seed, cui, p, n, target FROM best QUALIFY row_number() OVER (PARTITION BY seed ORDER BY p DESC NULLS LAST, cui) <= 5"""
)
def anatomy_findings(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return G.strongest_into(e, "TYPICALLY_AT", links(spark, d, "PART_OF"), seeds(e, "TYPICALLY_AT"), scorable(e), 2, 10, manual_exempt=False, review=False, top=5)


@query(
    CLEAN
    + """, r(cui, region) AS (
  SELECT cui, false FROM scorable
  UNION
  SELECT a.t, a.region FROM r JOIN (
    SELECT parent AS f, child AS t, false AS region, false AS only_region FROM links WHERE rel = 'IS_A'
    UNION ALL SELECT src, dst, false, false FROM clean WHERE rel = 'SUGGESTS' AND coalesce(review, 'keep') <> 'drop'
    UNION ALL SELECT src, dst, true, false FROM clean WHERE rel = 'TYPICALLY_AT'
    UNION ALL SELECT child, parent, true, true FROM links WHERE rel = 'PART_OF') a ON a.f = r.cui AND (r.region OR NOT a.only_region)
) SELECT n.cui, n.cui IN (SELECT cui FROM r) AS reaches FROM (SELECT src AS cui FROM clean UNION SELECT dst FROM clean) n"""
)
def reach_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("cui")).union(e.select("dst")).distinct().join(scorable(e).withColumn("scorable", F.lit(True)), "cui", "left").select("cui", F.coalesce("scorable", F.lit(False)).alias("scorable"))
    return G.reaches(nodes, e, links(spark, d), links(spark, d, "PART_OF"))


def _levels(depth: int) -> str:
    out = ", e AS (SELECT DISTINCT src AS a, dst AS b FROM clean), l0 AS (SELECT min(src) AS node, [min(src)] AS path FROM clean WHERE rel = 'SUGGESTS')"
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(k))
        out += f", l{k} AS (SELECT b AS node, min(list_append(path, b)) AS path FROM l{k - 1} JOIN e ON a = node WHERE b NOT IN ({before}) GROUP BY b)"
    return out + " " + " UNION ALL ".join(f"SELECT node, CAST({k} AS INTEGER) AS hops, array_to_string(path, '/') AS path FROM l{k}" for k in range(1, depth + 1))


@query(CLEAN + _levels(6))
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    start = e.where("rel = 'SUGGESTS'").agg(F.min("src")).first()[0]
    found = G.shortest_paths(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), start, 6)
    return found.select("node", "hops", F.array_join("path", "/").alias("path"))


_PAIRS = "WITH m AS (SELECT l_orderkey, p_brand AS src, 'S' || l_suppkey AS dst FROM lineitem JOIN part ON l_partkey = p_partkey)\n"


@query(
    _PAIRS
    + """, n AS (SELECT src, dst, count(DISTINCT l_orderkey) AS n FROM m GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 30), s AS (SELECT src, count(DISTINCT l_orderkey) AS n_src FROM m GROUP BY ALL)
SELECT src, dst, n, n_src, round(n / n_src::DOUBLE, 6) AS p FROM n JOIN s USING (src)"""
)
def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"))
    return G.weighted_edges(m, m, "l_orderkey", "src", "dst", 30)


@query(_PAIRS + "SELECT src, count(DISTINCT l_orderkey) AS n_pool FROM m GROUP BY src")
def n_pool(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return m.groupBy(F.col("p_brand").alias("src")).agg(F.countDistinct("l_orderkey").alias("n_pool"))


@query(
    """WITH rank AS (SELECT evidence_id, study_id, concept, CASE polarity WHEN 'PRESENT' THEN 1 WHEN 'UNCERTAIN' THEN 2 WHEN 'ABSENT' THEN 3 ELSE 4 END AS r FROM evidence WHERE concept IS NOT NULL)
SELECT study_id, concept, CASE min(r) WHEN 1 THEN 'PRESENT' WHEN 2 THEN 'UNCERTAIN' WHEN 3 THEN 'ABSENT' ELSE 'NOT_MENTIONED' END AS status FROM rank GROUP BY ALL"""
)
def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """The strongest polarity that any evidence of a study gives a concept."""
    order = F.when(F.col("polarity") == "PRESENT", 1).when(F.col("polarity") == "UNCERTAIN", 2).when(F.col("polarity") == "ABSENT", 3).otherwise(4)
    best = table(spark, d, "evidence").where("concept IS NOT NULL").groupBy("study_id", "concept").agg(F.min(order).alias("r"))
    return best.select("study_id", "concept", F.element_at(F.array(*map(F.lit, ("PRESENT", "UNCERTAIN", "ABSENT", "NOT_MENTIONED"))), F.col("r")).alias("status"))


FINDINGS = ("band", "cavity", "collapse", "density", "line", "lucency", "mass", "opacity", "plaque", "scar", "shadow", "swelling", "thickening")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CUES = ", ".join(f"('{c}', '{side}', {len(c.split())})" for side, cues in (("before", P.ABSENT_BEFORE), ("after", P.ABSENT_AFTER), ("unsure", P.UNCERTAIN)) for c in cues)
PARSED = f"""WITH t AS (SELECT record_id, regexp_extract_all(lower(nfc_normalize(text)), '[,;.]|[^\\s\\x0b\\x1c-\\x1f\\x85\\pZ,;.?!:()\\[\\]"''/]+') AS w FROM (SELECT DISTINCT record_id, coalesce(question, query) AS text FROM questions) WHERE text IS NOT NULL),
cues(cue, side, n) AS (VALUES {_CUES}),
spot AS (SELECT record_id, w, CAST(unnest(range(1, len(w) + 1)) AS INTEGER) AS i FROM t),
hit AS (SELECT record_id, w, i, w[i] AS concept FROM spot WHERE w[i] IN ({', '.join(f"'{f}'" for f in FINDINGS)})),
cue AS (SELECT record_id, w, i AS s, i + n AS e, side FROM spot JOIN cues ON w[i] = string_split(cue, ' ')[1] AND list_slice(w, i, i + n - 1) = string_split(cue, ' ')),
gap AS (SELECT h.record_id, h.w, h.i, h.concept, c.side, CASE WHEN c.e <= h.i THEN h.i - c.e ELSE c.s - h.i - 1 END AS g FROM hit h JOIN cue c ON h.record_id = c.record_id AND h.w = c.w
  WHERE (c.side IN ('before', 'unsure') AND c.e <= h.i AND h.i - c.e <= 5 AND NOT list_has_any(list_slice(h.w, c.e, h.i - 1), {_list(sorted(P.SCOPE_ENDS))}))
     OR (c.side IN ('after', 'unsure') AND c.s > h.i AND c.s - h.i - 1 <= 3 AND NOT list_has_any(list_slice(h.w, h.i + 1, c.s - 1), {_list(sorted(P.SCOPE_ENDS))}))),
near AS (SELECT record_id, w, i, min(g) FILTER (side = 'unsure') AS u, min(g) FILTER (side <> 'unsure') AS n FROM gap GROUP BY ALL),
said AS (SELECT h.record_id, h.w, h.i, h.concept, CASE WHEN u IS NOT NULL AND (n IS NULL OR u <= n) THEN 'UNCERTAIN' WHEN n IS NOT NULL THEN 'ABSENT' ELSE 'PRESENT' END AS polarity FROM hit h LEFT JOIN near USING (record_id, w, i)),
parsed AS (SELECT record_id, w, concept, arg_max(polarity, i) AS polarity, min(i) AS first FROM said GROUP BY ALL),
parser AS (SELECT record_id, concept, polarity, CAST(row_number() OVER (PARTITION BY record_id, w ORDER BY first) AS INTEGER) AS place FROM parsed)
"""


@query(PARSED + "SELECT record_id, concept, polarity, place FROM parser")
def rule_parser(spark: SparkSession, d: str) -> DataFrame:
    """Findings and their polarity in every question."""
    q = table(spark, d, "questions").select("record_id", F.coalesce("question", "query").alias("t")).distinct()
    return P.parse_column(q, "record_id", "t", [((f,), f) for f in FINDINGS])


_NAME_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({t}), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(
    f"""WITH n AS (SELECT 'P' || p_partkey AS cui, p_name AS text, {_NAME_WORDS.format(t='p_name')} AS nw FROM part), q AS (SELECT DISTINCT query, {_NAME_WORDS.format(t='query')} AS qw FROM (SELECT concept AS query FROM labels UNION SELECT p_name FROM part) WHERE query IS NOT NULL),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(nw) AS w FROM n) GROUP BY w), asked AS (SELECT query, len(qw) AS k, unnest(qw) AS w FROM q),
rare AS (SELECT query, w FROM asked LEFT JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY query ORDER BY coalesce(df, 0), w) <= greatest(1, k - ceil(k * 0.5) + 1)),
pair AS (SELECT DISTINCT query, cui, text FROM rare JOIN (SELECT cui, text, unnest(nw) AS w FROM n) USING (w)),
loose AS (SELECT query, cui, CASE WHEN len(list_intersect(qw, nw)) / len(qw) >= 0.5 THEN 1 ELSE 2 END AS tier, round_even(2.0 * len(list_intersect(qw, nw)) / (len(qw) + len(nw)), 3)::DOUBLE AS score FROM pair JOIN q USING (query) JOIN n USING (cui, text)),
qn AS (SELECT query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS norm FROM q),
forms AS (SELECT query, norm FROM qn UNION SELECT query, CASE WHEN regexp_matches(norm, '[^ ]s$') AND NOT regexp_matches(norm, '(as|ss|us|is)$') THEN CASE WHEN regexp_matches(norm, 'ies$') THEN regexp_replace(norm, 'ies$', 'y') ELSE regexp_replace(norm, 's$', '') END END FROM qn),
exact AS (SELECT DISTINCT query, cui, 0 AS tier, 1.0::DOUBLE AS score FROM forms JOIN (SELECT cui, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM n) USING (norm) WHERE norm <> ''),
best AS (SELECT * FROM (SELECT * FROM exact UNION ALL SELECT * FROM loose) QUALIFY row_number() OVER (PARTITION BY query, cui ORDER BY tier, score DESC) = 1)
SELECT query, cui, CAST(tier AS INTEGER) AS tier, score, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, cui) AS INTEGER) AS rank FROM best QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, cui) <= 12"""
)
def concept_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("cui"), F.col("p_name").alias("text"))
    return ranked_names(table(spark, d, "labels").select(F.col("concept").alias("query")).distinct().unionByName(names.select(F.col("text").alias("query")).distinct()), names)
