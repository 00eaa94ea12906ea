"""Queries of vectors, scoring and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import evaluate as E
from tamarack.operators import labels as L
from tamarack.operators import ml as M
from tamarack.operators import vectors as V
from tamarack.plans import intents as P
from tamarack.queries.corpus import NEWEST, resolved, sources
from tamarack.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _weights(spark: SparkSession, d: str) -> dict[str, list[float]]:
    """One model vector per label: the centroids, ten rows."""
    rows = V.centroids(table(spark, d, "embeddings"), "label", "embedding").collect()
    return {f"c{r.label}": r.vec for r in sorted(rows, key=lambda r: r.label)}


def scores(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, projection and ten logit columns, 10 * cosine to each label's centroid."""
    rows = table(spark, d, "embeddings").withColumn("projection", F.when(F.col("vec_id") % 5 == 0, "PA").otherwise("AP"))
    return V.score_matrix(rows, "vec_id", "embedding", _weights(spark, d), scale=10.0, keep=("projection",))


CENTROIDS = """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_inner_product(e, e))) AS e FROM x),
parts AS (SELECT label, i, avg(e[i]) AS m FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
means AS (SELECT label, list(m ORDER BY i) AS m FROM parts GROUP BY label),
cent AS (SELECT label, list_transform(m, lambda v: v / sqrt(list_inner_product(m, m))) AS v FROM means)
"""
SCORES = CENTROIDS + ", s AS (SELECT u.vec_id, CASE WHEN u.vec_id % 5 = 0 THEN 'PA' ELSE 'AP' END AS projection, " + ", ".join(
    f"10 * max(CASE WHEN cent.label = {i} THEN list_inner_product(u.e, cent.v) END) AS c{i}" for i in range(10)
) + " FROM u, cent GROUP BY u.vec_id)\n"


@query(CENTROIDS + "SELECT label, i - 1 AS i, round(v[i], 6) AS x FROM cent, (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS i)")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    return V.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("vec").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


_TOP = CENTROIDS + """, t AS (SELECT u.vec_id, round(list_inner_product(u.e, cent.v), 6) AS score FROM u, cent WHERE cent.label = 3 {where})
SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM t ORDER BY score DESC, vec_id LIMIT 10"""


@query(_TOP.format(where=""))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.nearest_to(table(spark, d, "embeddings"), _weights(spark, d)["c3"], 10, key="vec_id", vec="embedding")


@query(_TOP.format(where="AND u.vec_id % 5 = 0 AND u.vec_id IN (SELECT vec_id FROM embeddings WHERE label <> 3)"))
def vector_topk_view(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.nearest_to(e, _weights(spark, d)["c3"], 10, key="vec_id", vec="embedding", where=F.col("vec_id") % 5 == 0, allowed=e.where("label <> 3"))


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda v: v / sqrt(list_inner_product(e, e))) AS e FROM x),
p AS (SELECT q.vec_id AS query, u.vec_id, round(list_inner_product(q.e, u.e), 6) AS score FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10"""
)
def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.batch_nearest(e.where("vec_id % 20 = 0"), e, 10, key="vec_id", vec="embedding")


@query(SCORES + "SELECT vec_id, projection, " + ", ".join(f"round(c{i}, 6) AS c{i}" for i in range(10)) + " FROM s")
def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("vec_id", "projection", *[F.round(f"c{i}", 6).alias(f"c{i}") for i in range(10)])


@query(
    SCORES
    + "SELECT concept, vec_id, round(logit, 6) AS logit, CAST(row_number() OVER (PARTITION BY concept ORDER BY round(logit, 6) DESC, vec_id) AS INTEGER) AS rank FROM (UNPIVOT (SELECT vec_id, "
    + ", ".join(f"c{i}" for i in range(10))
    + " FROM s) ON * EXCLUDE (vec_id) INTO NAME concept VALUE logit) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY round(logit, 6) DESC, vec_id) <= 20"
)
def topn_per_column(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    cols = [f"c{i}" for i in range(10)]
    long = scores(spark, d).select("vec_id", *cols).unpivot(["vec_id"], cols, "concept", "logit").withColumn("logit", F.round("logit", 6))
    w = Window.partitionBy("concept").orderBy(F.col("logit").desc(), "vec_id")
    return long.withColumn("rank", F.row_number().over(w)).where("rank <= 20")


_Z = "least(greatest(c{i}, -30), 30)"
_LS = "(-ln(1 + exp(-(" + _Z + "))))"
_LN = "(-ln(1 + exp(" + _Z + ")))"
_SG = "(1 / (1 + exp(-(" + _Z + "))))"
_PARTS = ((1, 0.5), (4, 0.3), (7, 0.2))


def _f(t: str, i: int) -> str:
    return t.replace("{i}", str(i))


_none = " * ".join(f"(1 - {w} * {_f(_SG, i)})" for i, w in _PARTS)
_clear = " + ".join(_f(_LN, i) for i, _ in _PARTS)
FORMS = {
    "single": ("single", "PRESENT", _f(_LS, 1)),
    "single_absent": ("single", "ABSENT", _f(_LN, 1)),
    "noisy_or": ("noisy_or", "PRESENT", f"ln(1 - exp({_clear}))"),
    "noisy_or_absent": ("noisy_or", "ABSENT", _clear),
    "weighted": ("weighted", "PRESENT", " + ".join(f"{w} * {_f(_LS, i)}" for i, w in _PARTS)),
    "weighted_absent": ("weighted", "ABSENT", "ln(" + " + ".join(f"{w} * (1 - {_f(_SG, i)})" for i, w in _PARTS) + ")"),
    "weighted_or": ("weighted_noisy_or", "PRESENT", f"ln(1 - {_none})"),
    "weighted_or_absent": ("weighted_noisy_or", "ABSENT", f"ln({_none})"),
    "max": ("max", "PRESENT", "ln(greatest(" + ", ".join(_f(_SG, i) for i, _ in _PARTS) + "))"),
    "max_absent": ("max", "ABSENT", "ln(1 - greatest(" + ", ".join(_f(_SG, i) for i, _ in _PARTS) + "))"),
}


def _intent(combine: str, polarity: str) -> P.Intent:
    parts = tuple(P.Part(f"c{i}", w) for i, w in _PARTS)
    return P.Intent("q", polarity, combine, parts[:1] if combine == "single" else parts)


for _name, (_combine, _polarity, _sql) in FORMS.items():

    def _run(spark: SparkSession, d: str, combine=_combine, polarity=_polarity) -> DataFrame:
        return scores(spark, d).select("vec_id", F.round(P.score([_intent(combine, polarity)]), 6).alias("score"))

    QUERIES[f"score_{_name}"] = _run
    SQL[f"score_{_name}"] = SCORES + f"SELECT vec_id, round({_sql}, 6) AS score FROM s"

QUESTION = [_intent("weighted_noisy_or", "PRESENT"), P.Intent("b", "ABSENT", "single", (P.Part("c2"),)), P.Intent("n")]


@query(
    SCORES
    + f", t AS (SELECT vec_id, round({FORMS['weighted_or'][2]} + {_f(_LN, 2)}, 6) AS score FROM s WHERE projection = 'AP') SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM t ORDER BY score DESC, vec_id LIMIT 10"
)
def score_sum_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).where("projection = 'AP'").select("vec_id", F.round(P.score(QUESTION), 6).alias("score"))
    return V.top_k(rows, "score", "vec_id", 10)


@query(SCORES + f"SELECT vec_id, round(1 - {_none}, 6) AS p_q, round(1 - {_f(_SG, 2)}, 6) AS p_b FROM s")
def probabilities(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("vec_id", F.round(P.probability(QUESTION[0]), 6).alias("p_q"), F.round(P.probability(QUESTION[1]), 6).alias("p_b"))


@query(
    SCORES
    + f""", k AS (SELECT vec_id, projection, {FORMS['weighted_or'][2]} AS kg, c5 / 10 AS cosine FROM s),
z AS (SELECT vec_id, projection, (kg - avg(kg) OVER ()) / stddev_pop(kg) OVER () + 0.5 * (cosine - avg(cosine) OVER ()) / stddev_pop(cosine) OVER () AS f FROM k)
SELECT vec_id, round(f, 6) AS fused FROM z WHERE projection = 'PA'"""
)
def zscore_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = scores(spark, d).select("vec_id", "projection", P.score(QUESTION[:1]).alias("kg"), (F.col("c5") / 10).alias("cosine"))
    return P.fuse(rows, "kg", "cosine", 0.5).where("projection = 'PA'").select("vec_id", F.round("fused", 6).alias("fused"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, concept, study_id, score, rank): every request's studies by best finite score."""
    from pyspark.sql import Window

    s = F.col("score")
    best = (
        table(spark, d, "hits").where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).groupBy("request_id", F.col("column_name").alias("concept"), "study_id").agg(F.max("score").alias("score"))
    )
    w = Window.partitionBy("request_id", "concept").orderBy(F.col("score").desc(), F.col("study_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(w))


RANKED = NEWEST + """, best AS (SELECT request_id, column_name AS concept, study_id, max(score) AS score FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, concept ORDER BY score DESC, study_id) AS rank FROM best),
grades AS (SELECT concept, study_id, status, CASE status WHEN 'PRESENT' THEN 2 WHEN 'UNCERTAIN' THEN 1 ELSE 0 END AS grade FROM resolved)
"""


def _grades(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).select("concept", "study_id", "status", F.when(F.col("status") == "PRESENT", 2).when(F.col("status") == "UNCERTAIN", 1).otherwise(0).alias("grade"))


_AUC = """, x AS (SELECT ranked.concept, score, CASE WHEN status = 'PRESENT' THEN 1 WHEN {neg} THEN 0 END AS y FROM ranked JOIN grades USING (concept, study_id)),
r AS (SELECT concept, y, rank() OVER (PARTITION BY concept ORDER BY score) + (count(*) OVER (PARTITION BY concept, score) - 1) / 2.0 AS r FROM x WHERE y IS NOT NULL)
SELECT concept, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
  round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auroc FROM r GROUP BY concept"""


@query(RANKED + _AUC.format(neg="status = 'ABSENT'"))
def auroc_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked(spark, d).join(_grades(spark, d), ["concept", "study_id"])
    return E.auroc(rows, ["concept"], "score", F.col("status") == "PRESENT", F.col("status") == "ABSENT")


@query(RANKED + _AUC.format(neg="status IN ('ABSENT', 'NOT_MENTIONED')"))
def auroc_lenient(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked(spark, d).join(_grades(spark, d), ["concept", "study_id"])
    return E.auroc(rows, ["concept"], "score", F.col("status") == "PRESENT", F.col("status").isin("ABSENT", "NOT_MENTIONED"))


_NDCG = """, asked AS (SELECT DISTINCT request_id, concept FROM ranked), judged AS (SELECT a.request_id, a.concept, study_id, grade FROM asked a JOIN grades g ON a.concept = g.concept WHERE grade > 0),
got AS (SELECT r.request_id, r.concept, sum(coalesce({gain}, 0) / log2(r.rank + 1)) AS dcg FROM ranked r LEFT JOIN judged j ON r.request_id = j.request_id AND r.concept = j.concept AND r.study_id = j.study_id WHERE r.rank <= 10 GROUP BY ALL),
ideal AS (SELECT request_id, concept, sum({gain} / log2(i + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY request_id, concept ORDER BY grade DESC, study_id) AS i FROM judged j) j WHERE i <= 10 GROUP BY ALL)
SELECT request_id, concept, round(CASE WHEN coalesce(ideal, 0) > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM got LEFT JOIN ideal USING (request_id, concept)"""


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    """(concept, study_id, grade) of all relevant studies; they hang on the concept alone, so no request repeats them."""
    return _grades(spark, d).where("grade > 0").select("concept", "study_id", "grade")


@query(RANKED + _NDCG.format(gain="j.grade"))
def ndcg_graded(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg(ranked(spark, d), _relevant(spark, d), ["request_id", "concept"], "study_id", "grade", 10, of=["concept"])


@query(RANKED + _NDCG.format(gain="(pow(2, j.grade) - 1)"))
def ndcg_exponential(spark: SparkSession, d: str) -> DataFrame:
    return E.ndcg(ranked(spark, d), _relevant(spark, d), ["request_id", "concept"], "study_id", "grade", 10, exponential=True, of=["concept"])


@query(
    RANKED
    + """, t AS (SELECT r.request_id, r.concept, r.rank, g.status = 'PRESENT' AS hit FROM ranked r LEFT JOIN grades g USING (concept, study_id) WHERE r.rank <= 10)
SELECT request_id, concept, round(count(*) FILTER (hit AND rank <= 5) / 5.0, 6) AS p_at_5, round(count(*) FILTER (hit) / 10.0, 6) AS p_at_k, round(coalesce(1.0 / min(rank) FILTER (hit), 0), 6) AS mrr FROM t GROUP BY ALL"""
)
def precision_mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.rank_metrics(ranked(spark, d), _relevant(spark, d).where("grade = 2"), ["request_id", "concept"], "study_id", of=["concept"])


@query(
    RANKED
    + """, bad AS (SELECT DISTINCT study_id FROM resolved WHERE concept = 'Support Devices' AND status = 'PRESENT')
SELECT request_id, concept, count(*) AS returned, round(count(b.study_id) / count(*)::DOUBLE, 6) AS violation FROM ranked LEFT JOIN bad b USING (study_id) WHERE rank <= 10 GROUP BY ALL"""
)
def exclude_violation(spark: SparkSession, d: str) -> DataFrame:
    top = ranked(spark, d)
    bad = resolved(spark, d).where("concept = 'Support Devices' AND status = 'PRESENT'").select("study_id")
    banned = top.where("rank <= 10").join(bad, "study_id", "left_semi").select("request_id", "concept", "study_id")
    return E.violation_rate(top, banned, ["request_id", "concept"], "study_id")


def _two(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d)
    a = s.where("source = 'CHEXPERT_V1'").select("study_id", "concept", F.col("status").alias("x"))
    b = s.where("source = 'CHEXBERT_REPORT'").select("study_id", "concept", F.col("status").alias("y"))
    return a.join(b, ["study_id", "concept"])


_TWO = NEWEST + """, two AS (SELECT a.status AS x, b.status AS y FROM newest a JOIN newest b USING (study_id, concept) WHERE a.source = 'CHEXPERT_V1' AND b.source = 'CHEXBERT_REPORT')
"""


@query(
    _TWO
    + """, c AS (SELECT list_position(['ABSENT', 'UNCERTAIN', 'PRESENT'], x) AS a, list_position(['ABSENT', 'UNCERTAIN', 'PRESENT'], y) AS b, count(*) AS c FROM two WHERE x <> 'NOT_MENTIONED' AND y <> 'NOT_MENTIONED' GROUP BY ALL),
r AS (SELECT a, sum(c) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(c) AS cb FROM c GROUP BY b)
SELECT CAST((SELECT sum(c) FROM c) AS BIGINT) AS n, round(1 - (SELECT sum(c * (a - b) * (a - b)) FROM c) * (SELECT sum(c) FROM c) / (SELECT sum(ra * cb * (a - b) * (a - b)) FROM r, k)::DOUBLE, 6) AS kappa"""
)
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return E.cohen_kappa(_two(spark, d), "x", "y", ("ABSENT", "UNCERTAIN", "PRESENT"), weighted=True)


@query(
    _TWO
    + """, c AS (SELECT DISTINCT x AS c FROM two UNION SELECT DISTINCT y FROM two), f AS (SELECT c, 2.0 * count(*) FILTER (x = c AND y = c) / (count(*) FILTER (x = c) + count(*) FILTER (y = c)) AS f1 FROM two, c GROUP BY c)
SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1 FROM f"""
)
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return E.macro_f1(_two(spark, d), "x", "y")


@query(
    NEWEST
    + """, t AS (SELECT source, count(*) AS n, count(*) FILTER (newest.status = r.status) AS k FROM newest JOIN (SELECT study_id, concept, status FROM resolved) r USING (study_id, concept) WHERE newest.status <> 'NOT_MENTIONED' GROUP BY source),
w AS (SELECT source, n, k, k / n::DOUBLE AS p, 1.96 * 1.96 AS zz FROM t)
SELECT source, n, k, round((p + zz / (2 * n)) / (1 + zz / n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS low,
  round((p + zz / (2 * n)) / (1 + zz / n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n), 6) AS high FROM w"""
)
def wilson_agreement(spark: SparkSession, d: str) -> DataFrame:
    s = sources(spark, d).where(F.col("status") != L.SILENT)
    r = resolved(spark, d).select("study_id", "concept", F.col("status").alias("r"))
    t = s.join(r, ["study_id", "concept"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == F.col("r")).alias("k"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return t.select("source", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT parser, kind, count(*) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95 FROM questions WHERE ms IS NOT NULL AND NOT isnan(ms) GROUP BY ALL")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return E.percentiles(table(spark, d, "questions"), ["parser", "kind"], "ms")


@query("SELECT qgroup, count(*) AS n, round(avg(CASE WHEN fallback_used THEN 1.0 ELSE 0.0 END), 6) AS fallback, round(avg(CASE WHEN retried THEN 1.0 ELSE 0.0 END), 6) AS retried FROM questions GROUP BY GROUPING SETS ((qgroup), ())")
def coverage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions")
    share = lambda c: F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 6)
    return q.groupingSets([["qgroup"], []], "qgroup").agg(F.count(F.lit(1)).alias("n"), share("fallback_used").alias("fallback"), share("retried").alias("retried"))


_COUNTS = "WITH c AS (SELECT column_name AS concept, study_id, count(*) AS n FROM hits GROUP BY ALL)\n"
_RUN = _COUNTS + ", r AS (SELECT *, row_number() OVER w AS rn, sum(n) OVER (PARTITION BY concept ORDER BY n DESC, study_id ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY concept) AS total FROM c WINDOW w AS (PARTITION BY concept ORDER BY n DESC, study_id))\n"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hits").groupBy(F.col("column_name").alias("concept"), "study_id").agg(F.count(F.lit(1)).alias("n"))


@query(_RUN + "SELECT concept, level, min(rn) AS needed FROM r, (SELECT unnest([0.8, 0.9, 0.95]::DOUBLE[]) AS level) WHERE cum >= level * total - 1e-9 GROUP BY ALL")
def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage_curve(_counts(spark, d), ["concept"], "study_id", "n", (0.8, 0.9, 0.95))


@query(
    _RUN
    + "SELECT concept, study_id, n, CAST(CASE WHEN (cum - n) / total::DOUBLE < 0.8 - 1e-9 THEN 80 WHEN (cum - n) / total::DOUBLE < 0.9 - 1e-9 THEN 90 ELSE 95 END AS INTEGER) AS band FROM r WHERE (cum - n) / total::DOUBLE < 0.95 - 1e-9"
)
def scope_bands(spark: SparkSession, d: str) -> DataFrame:
    return E.scope_bands(_counts(spark, d), ["concept"], "study_id", "n")


@query(
    _COUNTS
    + """, p AS (SELECT *, sum(n) OVER (ORDER BY n DESC, concept, study_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, concept, study_id) AS rn FROM c)
SELECT concept, study_id, n, round(n / total::DOUBLE, 6) AS share FROM p WHERE rn <= 500 AND coalesce(before, 0) / total::DOUBLE < 0.05"""
)
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.top_pairs(_counts(spark, d), ["concept", "study_id"], "n", 0.05, 500)


def _paired_gains(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, concept, ndcg, b): both gains of each ranking, in one pass over the rankings and the judgements."""
    by = ["request_id", "concept"]
    both = E.ndcgs(ranked(spark, d), _relevant(spark, d), by, "study_id", "grade", 10, {"ndcg": False, "b": True}, of=["concept"])
    return both.where("request_id IS NOT NULL AND concept IS NOT NULL")  # pairs join on these


@query(
    "WITH a AS (" + RANKED + _NDCG.format(gain="j.grade") + "), b AS (" + RANKED + _NDCG.format(gain="(pow(2, j.grade) - 1)") + ")"
    + " SELECT count(*) AS n, round(avg(a.ndcg - b.ndcg), 6) AS mean, count(*) FILTER (a.ndcg > b.ndcg) AS wins, count(*) FILTER (a.ndcg < b.ndcg) AS losses, count(*) FILTER (a.ndcg = b.ndcg) AS ties FROM a JOIN b USING (request_id, concept)"
)
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    return E.paired_difference(_paired_gains(spark, d), "ndcg", "b").withColumn("mean", F.round("mean", 6))


@query()
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap_mean_diff(cut(_paired_gains(spark, d)), "ndcg", "b", 200, 20)  # a row per request and concept, read twice


def _rated(spark: SparkSession, d: str) -> DataFrame:
    """(concept, study_id, score, status): each study's best finite score of a concept over all requests, and its state."""
    best = ranked(spark, d).groupBy("concept", "study_id").agg(F.max("score").alias("score"))
    return best.join(_grades(spark, d).select("concept", "study_id", "status"), ["concept", "study_id"])


_RATED = RANKED + ", x AS (SELECT r.concept, study_id, r.score AS s, status AS y FROM (SELECT concept, study_id, max(score) AS score FROM best GROUP BY ALL) r JOIN grades USING (concept, study_id))\n"


def _u(neg: str, name: str) -> str:
    return f""", {name}_r AS (SELECT concept, y = 'PRESENT' AS pos, rank() OVER (PARTITION BY concept ORDER BY s) + (count(*) OVER (PARTITION BY concept, s) - 1) / 2.0 AS r FROM x WHERE y = 'PRESENT' OR {neg}),
{name} AS (SELECT concept, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0), 6) AS auroc FROM {name}_r GROUP BY concept)"""


@query(
    _RATED + _u("y = 'ABSENT'", "st") + _u("y IN ('ABSENT', 'NOT_MENTIONED')", "le")
    + """, n AS (SELECT concept, count(*) FILTER (y = 'PRESENT') AS n_pos, count(*) FILTER (y = 'ABSENT') AS n_neg_strict, count(*) FILTER (y IN ('ABSENT', 'NOT_MENTIONED')) AS n_neg_lenient,
  round(count(*) FILTER (y = 'PRESENT') / count(*)::DOUBLE, 6) AS prevalence,
  round(avg(s) FILTER (y = 'PRESENT'), 6) AS present_mean, round(quantile_cont(s, 0.05) FILTER (y = 'PRESENT'), 6) AS present_p5, round(quantile_cont(s, 0.95) FILTER (y = 'PRESENT'), 6) AS present_p95,
  round(avg(s) FILTER (y = 'ABSENT'), 6) AS absent_mean, round(quantile_cont(s, 0.05) FILTER (y = 'ABSENT'), 6) AS absent_p5, round(quantile_cont(s, 0.95) FILTER (y = 'ABSENT'), 6) AS absent_p95 FROM x GROUP BY concept),
h AS (SELECT concept, round(avg((y = 'PRESENT')::INTEGER), 6) AS p_at_10 FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY concept ORDER BY s DESC, study_id) <= 10) GROUP BY concept)
SELECT n.*, p_at_10, CASE WHEN n.n_pos >= 10 AND n_neg_strict >= 10 THEN st.auroc END AS auroc_strict, CASE WHEN n.n_pos >= 10 AND n_neg_lenient >= 10 THEN le.auroc END AS auroc_lenient
FROM n JOIN h USING (concept) LEFT JOIN st USING (concept) LEFT JOIN le USING (concept)"""
)
def concept_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.concept_metrics(_rated(spark, d), "concept", "study_id", "score", "status")


@query(RANKED + "SELECT concept, count(*) FILTER (status = 'PRESENT') AS n_pos, count(*) FILTER (status = 'ABSENT') AS n_neg FROM resolved GROUP BY concept HAVING count(*) FILTER (status = 'PRESENT') >= 30 AND count(*) FILTER (status = 'ABSENT') >= 30")
def eligible_concepts(spark: SparkSession, d: str) -> DataFrame:
    return M.eligible(resolved(spark, d), 30)


@query(_RATED + _u("y IN ('ABSENT', 'NOT_MENTIONED')", "le") + "SELECT concept, n_pos, n_neg, auroc AS auroc_lenient, auroc < 0.5 AS weak FROM le")
def quality_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _rated(spark, d)
    a = E.auroc(rows, ["concept"], "score", F.col("status") == "PRESENT", F.col("status").isin("ABSENT", "NOT_MENTIONED")).withColumnRenamed("auroc", "auroc_lenient")
    return M.quality(a.withColumn("low", F.lit(0.0)), 0.5).select("concept", "n_pos", "n_neg", "auroc_lenient", "weak")


@query()
def quality_intervals(spark: SparkSession, d: str) -> DataFrame:
    """``quality_table`` with bootstrap intervals and whether a concept is on the border."""
    rows = cut(_rated(spark, d))
    pos, neg = F.col("status") == "PRESENT", F.col("status").isin("ABSENT", "NOT_MENTIONED")
    a = E.auroc(rows, ["concept"], "score", pos, neg).withColumnRenamed("auroc", "auroc_lenient")
    ci = M.interval(M.bootstrap_auroc(rows, ["concept"], "study_id", "score", pos, neg, 50, 20), ["concept"], "auroc")
    return M.quality(a.join(ci, "concept", "left"), 0.5)


@query()
def caption_calibration(spark: SparkSession, d: str) -> DataFrame:
    return M.calibrate(_rated(spark, d).withColumn("y", M.target(F.col("status"))), "concept", "score", "y")


def _embedded(spark: SparkSession, d: str, concepts: int = 3) -> DataFrame:
    """(vec_id, embedding, patient, a state per label): PRESENT for the label itself, UNCERTAIN for the next, else ABSENT."""
    at = lambda k: F.when(F.col("label") == k, "PRESENT").when(F.col("label") == k + 1, "UNCERTAIN").otherwise("ABSENT")
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("patient"), F.floor(F.col("vec_id") / 3)).alias("patient"), *[at(k).alias(f"c{k}") for k in range(concepts)])


@query()
def probe_weights(spark: SparkSession, d: str) -> DataFrame:
    fits = M.train_probe(_embedded(spark, d), "embedding", ["c0", "c1", "c2"], 10.0, 64)
    return spark.createDataFrame([(c, i, float(x)) for c, w in fits.items() for i, x in enumerate(w)], "concept string, i int, w double")


@query()
def penalty_selection(spark: SparkSession, d: str) -> DataFrame:
    best, scored = M.select_penalty(_embedded(spark, d), "embedding", ["c0", "c1", "c2"], "patient", [1.0, 10.0, 100.0], 64, share=0.3, seed=7)
    return scored.withColumn("chosen", F.col("penalty") == best)


@query()
def column_probes(spark: SparkSession, d: str) -> DataFrame:
    fits = M.fit_columns(_embedded(spark, d), "embedding", ["c0", "c1", "c2"], F.col("vec_id") % 4 == 0, [1.0, 10.0], 64)
    return spark.createDataFrame([(c, f["penalty"], float(f["a"]), float(f["b"])) for c, f in fits.items()], "concept string, penalty double, a double, b double")
