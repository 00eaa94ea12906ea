"""Queries of evaluation: relevance by labels, runs, parsers, judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import assess as A
from tamarack.operators import labels as L
from tamarack.queries.corpus import CONCEPTS, NEWEST, WIDE, matrix, resolved, sources
from tamarack.queries.graphs import FINDINGS, PARSED
from tamarack.queries.retrieval import ranked
from tamarack.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


GOLDS = (
    A.Gold("q1", (("Pleural Effusion", "PRESENT"),), group="single"), A.Gold("q2", (("Edema", "UNCERTAIN"),), group="uncertainty"), A.Gold("q3", (("Edema", "PRESENT"),), ("Pneumonia",), group="negation"),
    A.Gold("q4", (("Lung Opacity", "PRESENT"), ("Cardiomegaly", "PRESENT")), group="multi"), A.Gold("q5", (), ("Support Devices",), group="negation"), A.Gold("q6", (("Fracture", "PRESENT"),), ("No Finding", "Edema"), group="negation"),
)


def _where(g: A.Gold, absence: str, uncertainty: str) -> str:
    parts = []
    for c, s in g.include:
        states = "'UNCERTAIN'" if s == "UNCERTAIN" else "'PRESENT', 'UNCERTAIN'" if uncertainty == "INCLUDE" else "'PRESENT'"
        parts.append(f"{L.column_of(c)} IN ({states})")
    for c in g.exclude:
        barred = "'PRESENT'" if uncertainty == "INCLUDE" else "'PRESENT', 'UNCERTAIN'"
        parts.append(f"{L.column_of(c)} = 'ABSENT'" if absence == "explicit_absence_required" else f"{L.column_of(c)} NOT IN ({barred})")
    return " AND ".join(parts)


def _matching(absence: str, uncertainty: str) -> str:
    return " UNION ALL ".join(f"SELECT '{g.id}' AS qid, study_id FROM wide WHERE {_where(g, absence, uncertainty)}" for g in GOLDS)


_ASKED = ", ".join(f"('{g.id}', '{c}', '{s}')" for g in GOLDS for c, s in g.asked)


def _relevant(absence: str, uncertainty: str, name: str = "relevant") -> str:
    return f""", m_{name} AS ({_matching(absence, uncertainty)}),
{name} AS (SELECT qid, study_id, round(1 + avg(coalesce(n, 0)), 6) AS grade FROM m_{name} JOIN asked USING (qid) LEFT JOIN agree USING (study_id, concept, status) GROUP BY ALL)"""


_BASE = WIDE + f""", asked(qid, concept, status) AS (VALUES {_ASKED}), agree AS (SELECT study_id, concept, status, count(*) AS n FROM newest WHERE status <> 'NOT_MENTIONED' GROUP BY ALL)"""


@query(_BASE + _relevant("exclude_present", "EXCLUDE") + " SELECT qid, study_id, grade FROM relevant")
def relevance_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.relevance(matrix(spark, d), L.agreement_counts(sources(spark, d)), GOLDS, "exclude_present", "EXCLUDE")


_COUNTS = ", ".join(f"('{g.id}', '{a}/{u}', (SELECT count(*) FROM wide WHERE {_where(g, a, u)}))" for g in GOLDS for a, u in A.POLICIES)


@query(WIDE + f"SELECT * FROM (VALUES {_COUNTS}) v(qid, policy, n)")
def label_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_counts(matrix(spark, d), GOLDS)


@query(WIDE + f", c(qid, policy, n) AS (VALUES {_COUNTS}) SELECT policy, count(*) AS queries, median(n) AS median, min(n) AS least, count(*) FILTER (n = 0) AS zero FROM c GROUP BY policy")
def label_filter_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.count_summary(A.filter_counts(matrix(spark, d), GOLDS), ["policy"])


def runs(spark: SparkSession, d: str) -> DataFrame:
    """(system, qid, study_id, rank): two ways to rank studies per request: by the best score of any column, by the mean of
    each column's best; request r stands for gold query q1 to q6 in turn."""
    best = ranked(spark, d).groupBy("request_id", "study_id").agg(F.max("score").alias("best"), F.avg("score").alias("mean"))
    per = best.withColumn("qid", F.concat(F.lit("q"), F.pmod("request_id", F.lit(6)) + 1)).groupBy("qid", "study_id").agg(F.round(F.max("best"), 9).alias("best"), F.round(F.avg("mean"), 9).alias("mean"))
    long = per.unpivot(["qid", "study_id"], ["best", "mean"], "system", "score")
    from pyspark.sql import Window

    return long.withColumn("rank", F.row_number().over(Window.partitionBy("system", "qid").orderBy(F.col("score").desc(), "study_id"))).where("rank <= 10").select("system", "qid", "study_id", "rank")


_RUNS = """, hb AS (SELECT request_id, column_name AS concept, study_id, max(score) AS score FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY ALL),
hr AS (SELECT request_id, study_id, max(score) AS best, avg(score) AS mean FROM hb GROUP BY ALL),
hq AS (SELECT 'q' || (request_id % 6 + 1) AS qid, study_id, round(max(best), 9) AS best, round(avg(mean), 9) AS mean FROM hr GROUP BY ALL),
hl AS (SELECT 'best' AS system, qid, study_id, best AS score FROM hq UNION ALL SELECT 'mean', qid, study_id, mean FROM hq),
runs AS (SELECT system, qid, study_id, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, study_id) AS rank FROM hl QUALIFY row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, study_id) <= 10)"""
_EXCLUDED = ", ".join(f"('{g.id}', '{c}')" for g in GOLDS for c in g.exclude)
_GROUPS = ", ".join(f"('{g.id}', '{g.group}')" for g in GOLDS)


def _metrics(policy: str, name: str, only: str = "") -> str:
    return f"""SELECT '{policy}' AS policy, s.system, q.qid, q.qgroup,
  round(coalesce((SELECT sum(1 / log2(rank + 1)) FROM runs r JOIN {name} g USING (qid, study_id) WHERE r.system = s.system AND r.qid = q.qid) / (SELECT sum(1 / log2(i + 1)) FROM (SELECT row_number() OVER (ORDER BY grade DESC, study_id) AS i FROM {name} g WHERE g.qid = q.qid) WHERE i <= 10), 0), 6) AS ndcg_binary,
  round(coalesce((SELECT sum(grade / log2(rank + 1)) FROM runs r JOIN {name} g USING (qid, study_id) WHERE r.system = s.system AND r.qid = q.qid) / (SELECT sum(grade / log2(i + 1)) FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC, study_id) AS i FROM {name} g WHERE g.qid = q.qid) WHERE i <= 10), 0), 6) AS ndcg_graded,
  round((SELECT count(*) FROM runs r JOIN {name} g USING (qid, study_id) WHERE r.system = s.system AND r.qid = q.qid AND rank <= 5) / 5.0, 6) AS p_at_5,
  round((SELECT count(*) FROM runs r JOIN {name} g USING (qid, study_id) WHERE r.system = s.system AND r.qid = q.qid) / 10.0, 6) AS p_at_k,
  round(coalesce(1.0 / (SELECT min(rank) FROM runs r JOIN {name} g USING (qid, study_id) WHERE r.system = s.system AND r.qid = q.qid), 0), 6) AS mrr,
  CASE WHEN q.qid IN (SELECT b.qid FROM banned b) THEN round((SELECT count(*) FROM runs r JOIN banned b USING (qid, study_id) WHERE r.system = s.system AND r.qid = q.qid)::DOUBLE / nullif((SELECT count(*) FROM runs r WHERE r.system = s.system AND r.qid = q.qid), 0), 6) END AS violation,
  round((SELECT count(*) FROM runs r WHERE r.system = s.system AND r.qid = q.qid) / 10.0, 6) AS returned
FROM (SELECT DISTINCT system FROM runs) s, queries q {only}"""


_EVALUATED = (
    _BASE + _relevant("exclude_present", "EXCLUDE", "one") + _relevant("exclude_present", "INCLUDE", "two") + _RUNS
    + f", queries(qid, qgroup) AS (VALUES {_GROUPS}), banned AS (SELECT DISTINCT e.qid, study_id FROM resolved JOIN (VALUES {_EXCLUDED}) e(qid, concept) USING (concept) WHERE status = 'PRESENT')"
    + ", scored AS (" + _metrics("exclude_present/EXCLUDE", "one") + " UNION ALL " + _metrics("exclude_present/INCLUDE", "two", f"WHERE q.qid IN ({', '.join(repr(g.id) for g in GOLDS if g.exclude)})") + ")"
)
METRICS = ("ndcg_binary", "ndcg_graded", "p_at_5", "p_at_k", "mrr", "violation", "returned")


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    present = resolved(spark, d).where("status = 'PRESENT'").select("concept", "study_id")
    return A.evaluate_runs(cut(runs(spark, d)), cut(matrix(spark, d)), L.agreement_counts(sources(spark, d)), present, GOLDS)


@query(_EVALUATED + " SELECT * FROM scored")
def retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluated(spark, d)


@query(
    _EVALUATED + " SELECT policy, system, scope, count(*) AS n, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in METRICS)
    + " FROM (SELECT *, 'all' AS scope FROM scored UNION ALL SELECT *, qgroup FROM scored) GROUP BY ALL"
)
def evaluation_means(spark: SparkSession, d: str) -> DataFrame:
    return A.macro_means(cut(evaluated(spark, d)), ["policy", "system"], METRICS, "qgroup")


@query(
    _EVALUATED + """, long AS (UNPIVOT (SELECT system, qid, ndcg_graded, mrr FROM scored WHERE policy = 'exclude_present/EXCLUDE') ON ndcg_graded, mrr INTO NAME metric VALUE v)
SELECT 'best' AS first, 'mean' AS second, metric, count(*) AS n, round(avg(a.v - b.v), 6) AS mean, count(*) FILTER (a.v > b.v) AS wins, count(*) FILTER (a.v < b.v) AS losses, count(*) FILTER (a.v = b.v) AS ties
FROM long a JOIN long b USING (qid, metric) WHERE a.system = 'best' AND b.system = 'mean' GROUP BY metric"""
)
def system_differences(spark: SparkSession, d: str) -> DataFrame:
    scored = evaluated(spark, d).where("policy = 'exclude_present/EXCLUDE'")
    return A.system_differences(cut(scored), [("best", "mean")], ["ndcg_graded", "mrr"])


_JUDGED = """, judged AS (SELECT g.qid, r.study_id, max(CASE WHEN r.status = g.status THEN 2 WHEN r.status = 'UNCERTAIN' THEN 1 ELSE 0 END) AS grade, bool_or(g.status = 'ABSENT' AND r.status = 'PRESENT') AS violates
  FROM resolved r JOIN asked g USING (concept) GROUP BY ALL)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(qid, study_id, grade, violates): 2 if a study has what any asked concept should be, 1 if it is uncertain, else 0."""
    asked = spark.createDataFrame([(g.id, c, s) for g in GOLDS for c, s in g.asked], "qid string, concept string, asked string")
    rows = resolved(spark, d).join(F.broadcast(asked), "concept")
    grade = F.when(F.col("status") == F.col("asked"), 2).when(F.col("status") == "UNCERTAIN", 1).otherwise(0)
    return rows.groupBy("qid", "study_id").agg(F.max(grade).alias("grade"), F.bool_or((F.col("asked") == "ABSENT") & (F.col("status") == "PRESENT")).alias("violates"))


@query(
    _BASE + _RUNS + _JUDGED + f""", queries AS (SELECT qid, qid IN (SELECT v.qid FROM (VALUES {_EXCLUDED}) v(qid, c)) AS ex FROM (VALUES {_GROUPS}) x(qid, g)), pool AS (SELECT DISTINCT qid, study_id FROM runs),
ideal AS (SELECT qid, sum((pow(2, g) - 1) / log2(i + 1)) AS ideal FROM (SELECT qid, coalesce(grade, 0) AS g, row_number() OVER (PARTITION BY qid ORDER BY coalesce(grade, 0) DESC, study_id) AS i FROM pool LEFT JOIN judged USING (qid, study_id)) WHERE i <= 10 GROUP BY qid),
got AS (SELECT system, qid, sum((pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade = 2) AS two, count(*) FILTER (grade >= 1) AS one, count(*) FILTER (violates) AS v FROM runs LEFT JOIN judged USING (qid, study_id) GROUP BY ALL)
SELECT s.system, q.qid, round(CASE WHEN coalesce(ideal, 0) > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg, round(coalesce(two, 0) / 10.0, 6) AS p10, round(coalesce(one, 0) / 10.0, 6) AS p10_lenient,
  CASE WHEN ex THEN round(coalesce(v, 0) / 10.0, 6) END AS violation, dcg IS NULL AS no_result
FROM (SELECT DISTINCT system FROM runs) s CROSS JOIN queries q LEFT JOIN got ON got.system = s.system AND got.qid = q.qid LEFT JOIN ideal ON ideal.qid = q.qid"""
)
def graded_evaluation(spark: SparkSession, d: str) -> DataFrame:
    found = cut(runs(spark, d))
    queries = spark.createDataFrame([(g.id, bool(g.exclude)) for g in GOLDS], "qid string, has_exclusion boolean")
    return A.graded_metrics(found, judged(spark, d), A.judging_pool(found, 10), queries)


@query(_BASE + _RUNS + " SELECT DISTINCT qid, study_id FROM runs WHERE rank <= 5")
def judging_pool(spark: SparkSession, d: str) -> DataFrame:
    return A.judging_pool(runs(spark, d), 5)


@query(
    _BASE + _JUDGED + """, h AS (SELECT qid, study_id, grade, row_number() OVER (PARTITION BY grade ORDER BY sha256('5:' || qid || ':' || study_id), qid, study_id) AS i FROM judged), o AS (
  SELECT *, row_number() OVER (ORDER BY i > 33 + CASE WHEN list_position([2, 1, 0], grade) <= 1 THEN 1 ELSE 0 END, list_position([2, 1, 0], grade), i) AS o FROM h WHERE i <= 100)
SELECT qid, study_id, grade FROM o WHERE o <= 100"""
)
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.balanced_sample(judged(spark, d).select("qid", "study_id", "grade"), ["qid", "study_id"], "grade", 100, 5)


@query(
    _BASE + _JUDGED + """, two AS (SELECT study_id, qid, a.grade AS x, b.grade AS y FROM judged a JOIN (SELECT qid, study_id, CASE WHEN length(study_id) % 2 = 0 THEN grade ELSE least(grade + 1, 2) END AS grade FROM judged) b USING (qid, study_id)),
c AS (SELECT x AS a, y AS b, count(*) AS c FROM two GROUP BY ALL), r AS (SELECT a, sum(c) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(c) AS cb FROM c GROUP BY b)
SELECT (SELECT count(*) FROM two) AS pairs, (SELECT round(avg((x = y)::INTEGER), 4) FROM two) AS agreement, (SELECT round(avg(((x = 2) = (y = 2))::INTEGER), 4) FROM two) AS relevant_agreement,
  round(1 - (SELECT sum(c * (a <> b)::INTEGER) FROM c) * (SELECT sum(c) FROM c) / (SELECT sum(ra * cb * (a <> b)::INTEGER) FROM r, k)::DOUBLE, 6) AS kappa,
  round(1 - (SELECT sum(c * (a - b) * (a - b)) FROM c) * (SELECT sum(c) FROM c) / (SELECT sum(ra * cb * (a - b) * (a - b)) FROM r, k)::DOUBLE, 6) AS kappa_quadratic"""
)
def judge_statistics(spark: SparkSession, d: str) -> DataFrame:
    j = cut(judged(spark, d))
    other = j.withColumn("grade", F.when(F.length("study_id") % 2 == 0, F.col("grade")).otherwise(F.least(F.col("grade") + 1, F.lit(2))))
    return A.judge_statistics(j, other)


def parsed_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """gold: what the rule parser finds; predicted: each finding as PRESENT, without regard to cues; and the queries."""
    from tamarack.functions import parsing as P

    q = table(spark, d, "questions").where("record_id IS NOT NULL").groupBy(F.col("record_id").alias("qid")).agg(F.min(F.coalesce("question", "query")).alias("t"), F.min(F.coalesce("language", F.lit("none"))).alias("language"), F.bool_or(F.coalesce("fallback_used", F.lit(False))).alias("fallback"))
    gold = cut(P.parse_column(q, "qid", "t", [((f,), f) for f in FINDINGS]).select("qid", "concept", F.col("polarity").alias("status")))
    failed = q.where("fallback").select("qid")
    return gold, gold.withColumn("status", F.lit("PRESENT")).join(failed, "qid", "left_anti"), q.select("qid", "language", (~F.col("fallback")).alias("valid"))


_ITEMS = PARSED.replace("(SELECT DISTINCT record_id, coalesce(question, query) AS text FROM questions)", "(SELECT record_id, min(coalesce(question, query)) AS text FROM questions WHERE record_id IS NOT NULL GROUP BY record_id)") + """,
q AS (SELECT record_id AS qid, min(coalesce(language, 'none')) AS language, NOT bool_or(coalesce(fallback_used, false)) AS valid FROM questions WHERE record_id IS NOT NULL GROUP BY record_id),
gold AS (SELECT record_id AS qid, concept, polarity AS status FROM parser), pred AS (SELECT qid, concept, 'PRESENT' AS status FROM gold JOIN q USING (qid) WHERE valid)"""


@query(
    _ITEMS + """, b AS (SELECT coalesce(g.status, p.status) AS class, g.qid IS NOT NULL AS g, p.qid IS NOT NULL AS p FROM gold g FULL JOIN pred p ON g.qid = p.qid AND g.concept = p.concept AND g.status = p.status),
n AS (SELECT class, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY class)
SELECT class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support FROM n"""
)
def parser_classes(spark: SparkSession, d: str) -> DataFrame:
    gold, pred, _ = parsed_items(spark, d)
    return A.item_scores(gold, pred, ["concept", "status"], F.col("status"))


@query(
    _ITEMS + """, c AS (SELECT q.language, coalesce(g.concept, p.concept) AS k, 2.0 * count(*) FILTER (g.qid IS NOT NULL AND p.qid IS NOT NULL) / (count(g.qid) + count(p.qid)) AS f1 FROM (SELECT DISTINCT qid, concept FROM gold) g FULL JOIN (SELECT DISTINCT qid, concept FROM pred) p ON g.qid = p.qid AND g.concept = p.concept JOIN q ON q.qid = coalesce(g.qid, p.qid) GROUP BY ALL),
b AS (SELECT coalesce(g.qid, p.qid) AS qid, coalesce(g.status, p.status) AS k, g.qid IS NOT NULL AS g, p.qid IS NOT NULL AS p FROM gold g FULL JOIN pred p ON g.qid = p.qid AND g.concept = p.concept AND g.status = p.status),
s AS (SELECT language, k, 2.0 * count(*) FILTER (g AND p) / (count(*) FILTER (g) + count(*) FILTER (p)) AS f1 FROM b JOIN q USING (qid) GROUP BY ALL)
SELECT language, count(*) AS n, round(avg(valid::INTEGER), 6) AS valid, round(avg((qid NOT IN (SELECT qid FROM b WHERE NOT g OR NOT p))::INTEGER), 6) AS exact,
  (SELECT round(avg(f1), 6) FROM c WHERE c.language = q.language) AS concept_f1, (SELECT round(avg(f1), 6) FROM s WHERE s.language = q.language) AS status_f1,
  coalesce((SELECT round(avg(f1), 6) FROM c WHERE c.language = q.language) >= 0.8, true) AND coalesce((SELECT round(avg(f1), 6) FROM s WHERE s.language = q.language) >= 0.8, true) AND round(avg(valid::INTEGER), 6) >= 0.9 AS passed FROM q GROUP BY language"""
)
def parser_evaluation(spark: SparkSession, d: str) -> DataFrame:
    gold, pred, q = parsed_items(spark, d)
    return A.verdict(A.parser_report(gold, pred, q, ["language"]), 0.8, 0.9)


@query(
    _ITEMS + """, n AS (SELECT q.qid, count(g.qid) FILTER (status <> 'ABSENT') AS i, count(g.qid) FILTER (status = 'ABSENT') AS e, coalesce(bool_or(status = 'UNCERTAIN'), false) AS u FROM q LEFT JOIN gold g USING (qid) GROUP BY q.qid)
SELECT qid, unnest(list_filter([CASE WHEN i = 1 AND e = 0 THEN 'single' END, CASE WHEN i + e >= 2 THEN 'multi' END, CASE WHEN e > 0 THEN 'negation' END, CASE WHEN u THEN 'uncertainty' END, CASE WHEN i + e = 0 THEN 'other' END], lambda x: x IS NOT NULL)) AS qgroup FROM n"""
)
def query_groups(spark: SparkSession, d: str) -> DataFrame:
    gold, _, q = parsed_items(spark, d)
    n = q.select("qid").join(gold, "qid", "left").groupBy("qid").agg(F.count_if(F.col("status") != "ABSENT").alias("i"), F.count_if(F.col("status") == "ABSENT").alias("e"), F.coalesce(F.bool_or(F.col("status") == "UNCERTAIN"), F.lit(False)).alias("u"))
    return n.select("qid", F.explode(A.groups_of(F.col("i"), F.col("e"), F.col("u"), F.lit(0))).alias("qgroup"))


@query(
    """SELECT parser AS step, count(*) AS calls, round(sum(ms), 4) AS cost, round(round(sum(ms), 4) / 1000 * 1000, 3) AS per_1000, round(count(*) / 1000.0, 2) AS calls_per_question FROM questions WHERE parser IS NOT NULL AND ms IS NOT NULL AND NOT isnan(ms) GROUP BY GROUPING SETS ((parser), ())"""
)
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.cost_table(table(spark, d, "questions").where("parser IS NOT NULL AND ms IS NOT NULL AND NOT isnan(ms)"), "parser", "ms", 1000)
