"""Queries of corpus builds, texts against their sources, and fusion grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import render as R
from tamarack.functions import text as X
from tamarack.operators import corpus as C
from tamarack.operators import evaluate as E
from tamarack.operators import labels as L
from tamarack.operators import vectors as V
from tamarack.plans import intents as P
from tamarack.queries.corpus import CONCEPTS, NEWEST, RARITY, WIDE, resolved, sources
from tamarack.queries.retrieval import FORMS, QUESTION, SCORES, scores
from tamarack.session import cut, table
from tamarack.sources import builds as B

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _images(spark: SparkSession, d: str) -> DataFrame:
    return C.one_per_group(table(spark, d, "images"), "study_id", "path_to_image").select("study_id", "patient_id", "path_to_image", "projection", "image_id", "dataset_split")


ONE = """one AS (SELECT study_id, patient_id, path_to_image, projection, image_id, dataset_split FROM images WHERE study_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY coalesce(try_cast(nullif(regexp_extract(path_to_image, 'view([0-9]+)', 1), '') AS INTEGER), 1000000), path_to_image NULLS FIRST,
  image_id, study_id, patient_id NULLS FIRST, local_image_path NULLS FIRST, "view" NULLS FIRST, projection NULLS FIRST, dataset_split NULLS FIRST, image_checksum NULLS FIRST, width NULLS FIRST, height NULLS FIRST) = 1)
"""


@query("WITH " + ONE + ", corpus AS (SELECT DISTINCT patient_id FROM one WHERE image_id IN (SELECT image_id FROM corpus_vectors) AND patient_id IS NOT NULL AND substr(sha256(patient_id), 1, 1) < '8') SELECT study_id, patient_id, path_to_image, projection FROM one WHERE starts_with(path_to_image, 'train/') AND patient_id IS NOT NULL AND patient_id NOT IN (SELECT patient_id FROM corpus)")
def pool_selection(spark: SparkSession, d: str) -> DataFrame:
    one = _images(spark, d)
    corpus = one.join(table(spark, d, "corpus_vectors").select("image_id").distinct(), "image_id", "left_semi").where(F.col("patient_id").isNotNull() & (F.substring(F.sha2("patient_id", 256), 1, 1) < "8"))
    return B.select_pool(one.select("study_id", "patient_id", "path_to_image", "projection"), corpus)


@query(
    "WITH " + ONE + """, r AS (SELECT study_id, any_value(patient_id) AS patient_id, max(nullif(regexp_replace(findings, '^\\s+|\\s+$', '', 'g'), '')) AS f, max(nullif(regexp_replace(impression, '^\\s+|\\s+$', '', 'g'), '')) AS i FROM reports WHERE study_id IS NOT NULL GROUP BY study_id)
SELECT study_id, image_id AS selected_image_id, f IS NOT NULL OR i IS NOT NULL AS has_report, i IS NOT NULL AS has_impression, f IS NOT NULL AS has_findings, 'complete' AS ingestion_status FROM r JOIN one USING (study_id)"""
)
def studies_table(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").where("study_id IS NOT NULL").groupBy("study_id").agg(F.min("patient_id").alias("patient_id"), F.max(X.blank_to_null("findings")).alias("findings"), F.max(X.blank_to_null("impression")).alias("impression"))
    return B.studies_of(r, _images(spark, d).select("study_id", "image_id")).drop("patient_id")


@query(
    RARITY + ", " + ONE + """, mix AS (SELECT 'stratum' AS what, stratum AS name, count(*) AS n FROM strata GROUP BY 2 UNION ALL SELECT 'projection', projection, count(*) FROM one GROUP BY 2 UNION ALL SELECT 'dataset_split', dataset_split, count(*) FROM one GROUP BY 2
  UNION ALL SELECT 'count', 'studies', count(DISTINCT study_id) FROM one UNION ALL SELECT 'count', 'patients', count(DISTINCT patient_id) FROM one)
SELECT what, name, NULL::VARCHAR AS status, n FROM mix UNION ALL SELECT 'status', g.concept, g.status, count(r.study_id) FROM (SELECT concept, status FROM (SELECT unnest([""" + ", ".join(f"'{c}'" for c in CONCEPTS)
    + "]) AS concept), (SELECT unnest(['PRESENT', 'UNCERTAIN', 'ABSENT', 'NOT_MENTIONED']) AS status)) g LEFT JOIN resolved r ON g.concept = r.concept AND g.status = r.status GROUP BY ALL"
)
def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    r = cut(resolved(spark, d))
    return B.corpus_report(_images(spark, d), L.strata(r), L.crosstab(r, CONCEPTS))


@query("SELECT evidence_id, row_number() OVER (ORDER BY evidence_id DESC) - 1 AS source_row_index FROM (SELECT DISTINCT evidence_id FROM evidence)")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.with_row_number(table(spark, d, "evidence").select("evidence_id").distinct(), [F.col("evidence_id").desc()])


@query(NEWEST + "SELECT study_id, concept, source, status FROM newest WHERE source <> 'CHEXBERT_FINDINGS' OR study_id IN (SELECT study_id FROM reports WHERE regexp_replace(findings, '^\\s+|\\s+$', '', 'g') <> '')")
def silenced_source(spark: SparkSession, d: str) -> DataFrame:
    with_findings = table(spark, d, "reports").where(X.blank_to_null("findings").isNotNull())
    return B.silence_without_input(sources(spark, d), "CHEXBERT_FINDINGS", with_findings)


@query(NEWEST + "SELECT s.study_id, c.concept, coalesce(r.status, 'NOT_MENTIONED') AS status, r.source FROM (SELECT DISTINCT study_id FROM labels) s CROSS JOIN (SELECT unnest([" + ", ".join(f"'{c}'" for c in CONCEPTS[:4]) + "]) AS concept) c LEFT JOIN resolved r ON s.study_id = r.study_id AND c.concept = r.concept")
def label_provenance(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "labels").select("study_id").distinct().withColumn("concept", F.explode(F.array(*map(F.lit, CONCEPTS[:4]))))
    return grid.join(resolved(spark, d), ["study_id", "concept"], "left").select("study_id", "concept", F.coalesce("status", F.lit(L.SILENT)).alias("status"), "source")


_SAID = {c: c.lower() for c in CONCEPTS}


@query(
    NEWEST + """, t AS (SELECT study_id, string_agg(CASE WHEN concept = 'No Finding' THEN 'normal chest' ELSE lower(concept) END, ' and ' ORDER BY concept) FILTER (status = 'PRESENT') AS i, string_agg('no ' || lower(concept), ' and ' ORDER BY concept) FILTER (status = 'ABSENT') AS e,
  coalesce(bool_or(status = 'ABSENT' AND concept = 'No Finding'), false) AS bad FROM resolved GROUP BY study_id)
SELECT study_id, CASE WHEN NOT bad THEN nullif(concat_ws(' and ', i, e), '') END AS template FROM t"""
)
def study_templates(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda s: F.collect_set(F.when(F.col("status") == s, F.col("concept")))
    per = resolved(spark, d).groupBy("study_id").agg(pick("PRESENT").alias("i"), pick("ABSENT").alias("e"))
    return per.select("study_id", R.template_column(F.col("i"), F.col("e"), _SAID, sorted(CONCEPTS)).alias("template"))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "reports").groupBy("study_id").agg(F.max("search_text").alias("search_text"))
    return table(spark, d, "evidence").where("text IS NOT NULL").select("evidence_id", "study_id", "text").distinct().join(reports, "study_id")


@query(
    """WITH q AS (SELECT DISTINCT evidence_id, study_id, text FROM evidence WHERE text IS NOT NULL), r AS (SELECT study_id, max(search_text) AS search_text FROM reports GROUP BY study_id)
SELECT evidence_id, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda n: NOT list_contains(regexp_extract_all(coalesce(search_text, ''), '[0-9]+'), n))) AS strange FROM q JOIN r USING (study_id)"""
)
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    """How many different numbers of a quote aren't in its report."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), 1)
    return _quotes(spark, d).select("evidence_id", F.size(F.array_except(numbers(F.col("text")), numbers(F.col("search_text")))).cast("bigint").alias("strange"))


_W = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(
    f"""WITH q AS (SELECT DISTINCT evidence_id, study_id, text FROM evidence WHERE text IS NOT NULL), r AS (SELECT study_id, max(search_text) AS t FROM reports GROUP BY study_id), w AS (SELECT evidence_id, {_W.format(c='text')} AS a, {_W.format(c="coalesce(t, '')")} AS b FROM q JOIN r USING (study_id))
SELECT evidence_id, coalesce(list_has_any(list_transform(range(1, len(a) - 3), lambda i: array_to_string(list_slice(a, i, i + 4), ' ')), list_transform(range(1, len(b) - 3), lambda i: array_to_string(list_slice(b, i, i + 4), ' '))), false) AS copied FROM w"""
)
def copied_runs(spark: SparkSession, d: str) -> DataFrame:
    return _quotes(spark, d).select("evidence_id", X.copied(X.words("text"), X.words(F.coalesce("search_text", F.lit(""))), 5).alias("copied"))


@query(
    """WITH q AS (SELECT DISTINCT record_id, trim(regexp_replace(lower(coalesce(question, query)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM questions WHERE coalesce(question, query) IS NOT NULL)
SELECT record_id, norm, array_to_string(list_filter(string_split(norm, ' '), lambda w: w NOT IN ('left', 'right', 'upper', 'lower')), ' ') AS stripped FROM q"""
)
def side_words(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("record_id", X.name_norm(F.coalesce("question", "query")).alias("norm")).where("norm IS NOT NULL").distinct()
    return q.select("record_id", "norm", X.strip_words("norm", ["left", "right", "upper", "lower"]).alias("stripped"))


_FREE = _W.format(c="coalesce(question, query)")


@query(f"WITH q AS (SELECT DISTINCT record_id, coalesce(question, query) AS question, NULL AS query FROM questions WHERE coalesce(question, query) IS NOT NULL), w AS (SELECT record_id, question, {_FREE} AS w FROM q) SELECT record_id, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN length(w[i]) >= 4 AND w[i] NOT IN ('films', 'hours') AND list_position(w, w[i]) = i THEN w[i] END), lambda x: x IS NOT NULL), ' ') AS tokens FROM w")
def free_tokens(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").select("record_id", F.coalesce("question", "query").alias("t")).where("t IS NOT NULL").distinct()
    return q.select("record_id", F.array_join(X.free_text_tokens("t", 4, ["films", "hours"]), " ").alias("tokens"))


@query(
    NEWEST + """, s AS (SELECT study_id, coalesce(list(DISTINCT concept) FILTER (source = 'CHEXPERT_V1' AND status = 'PRESENT'), []) AS a, coalesce(list(DISTINCT concept) FILTER (source = 'CHEXBERT_REPORT' AND status = 'PRESENT'), []) AS b FROM newest GROUP BY study_id)
SELECT study_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM s"""
)
def source_set_f1(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda n: F.collect_set(F.when((F.col("source") == n) & (F.col("status") == "PRESENT"), F.col("concept")))
    return sources(spark, d).groupBy("study_id").agg(pick("CHEXPERT_V1").alias("a"), pick("CHEXBERT_REPORT").alias("b")).select("study_id", F.round(E.set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


_GRID = (0.0, 0.25, 0.5, 1.0)


@query(
    SCORES + f""", k AS (SELECT vec_id, projection, {FORMS['weighted_or'][2]} AS kg, c5 / 10 AS cosine FROM s), z AS (SELECT vec_id, projection, (kg - avg(kg) OVER ()) / stddev_pop(kg) OVER () AS a, (cosine - avg(cosine) OVER ()) / stddev_pop(cosine) OVER () AS b FROM k),
g AS (SELECT w, vec_id, round(a + w * b, 6) AS score FROM z, (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS w) WHERE projection = 'PA')
SELECT w, vec_id, score, CAST(row_number() OVER (PARTITION BY w ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, vec_id) <= 10"""
)
def fusion_grid(spark: SparkSession, d: str) -> DataFrame:
    """The first ten of every weight of the fusion, ranked after the whole corpus has been standardised once."""
    from pyspark.sql import Window

    rows = scores(spark, d).select("vec_id", "projection", P.score(QUESTION[:1]).alias("kg"), (F.col("c5") / 10).alias("cosine"))
    z = P.zscore(rows, ["kg", "cosine"]).where("projection = 'PA'").withColumn("w", F.explode(F.array(*[F.lit(x) for x in _GRID])))
    ranked = Window.partitionBy("w").orderBy(F.col("score").desc(), "vec_id")
    return z.select("w", "vec_id", F.round(F.col("kg") + F.col("w") * F.col("cosine"), 6).alias("score")).withColumn("rank", F.row_number().over(ranked)).where("rank <= 10")


@query(
    SCORES + f""", t AS (SELECT vec_id, round({FORMS['max'][2]}, 6) AS score FROM s WHERE projection = 'PA') SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM t ORDER BY score DESC, vec_id LIMIT 10"""
)
def rescored_max_topk(spark: SparkSession, d: str) -> DataFrame:
    """A stored plan scored again under another way of combining."""
    plan = P.transform(QUESTION[:1], "max")
    return V.top_k(scores(spark, d).where("projection = 'PA'").select("vec_id", F.round(P.score(plan), 6).alias("score")), "score", "vec_id", 10)


@query(WIDE + "SELECT study_id FROM wide WHERE pleural_effusion = 'PRESENT' ORDER BY sha256('3:' || study_id), study_id LIMIT 25")
def ordered_matches(spark: SparkSession, d: str) -> DataFrame:
    return L.ordered_matches(L.matrix(resolved(spark, d), table(spark, d, "labels"), CONCEPTS), L.constraint([("Pleural Effusion", "PRESENT")], []), 3, 25)


@query("WITH v AS (SELECT DISTINCT image_id FROM corpus_vectors WHERE image_id IS NOT NULL), i AS (SELECT image_id, min(projection) AS projection FROM images GROUP BY image_id) SELECT v.image_id, coalesce(i.projection, '') AS view FROM v LEFT JOIN i USING (image_id)")
def image_views(spark: SparkSession, d: str) -> DataFrame:
    """The view of every indexed image, an empty text where it isn't known."""
    views = table(spark, d, "images").groupBy("image_id").agg(F.min("projection").alias("projection"))
    return table(spark, d, "corpus_vectors").select("image_id").where("image_id IS NOT NULL").distinct().join(views, "image_id", "left").select("image_id", F.coalesce("projection", F.lit("")).alias("view"))
