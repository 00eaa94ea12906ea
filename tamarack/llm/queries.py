"""Queries of the llm operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import components, consensus, leaks, mixing, neighbours, overlap, personal, sentences, top_items
from tamarack.session import cut, table


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest_neighbours(table(spark, d, "corpus_vectors"))
    return near.withColumn("cos", F.round("cos", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(table(spark, d, "corpus_vectors")))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    reports, evidence = table(spark, d, "reports"), table(spark, d, "evidence")
    parts = [
        sentences.split_sentences(t, key, field).withColumn("field", F.lit(name))
        for t, key, field, name in ((reports, "study_id", "findings", "findings"), (reports, "study_id", "impression", "impression"), (evidence, "evidence_id", "text", "evidence"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("record_key", "field", "place", "start", "sentence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sentences(spark, d).select("record_key", "field", "sentence")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return components.assign_splits(table(spark, d, "images"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.grouped_images(table(spark, d, "images")).where("image_id <> group_image_id").select("group_image_id", "image_id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return components.split_shares(cut(p4_splits(spark, d)))


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.dawid_skene(consensus.asserted(table(spark, d, "labels")))
    return items


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_consensus(spark, d).where("n_sources >= 3").select("study_id", "concept", "status")


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    _, sources = consensus.dawid_skene(consensus.asserted(table(spark, d, "labels")))
    return sources


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.chance_corrected(consensus.asserted(table(spark, d, "labels")))


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    return top_items.top_items(table(spark, d, "hits"), ["request_id", "column_name"], "study_id", "score", 10)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top(spark, d).select("request_id", "column_name", "study_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "questions"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "questions"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_likenesses(spark: SparkSession, d: str) -> DataFrame:
    """``p8_leaks`` with the faulty runs that are another passage's text."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), likenesses=True)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p8_leaks(spark, d), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return leaks.without_leaks(documents, cut(leaks.find_runs(documents, table(spark, d, "eval_items"))))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.local_shuffle(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.mixture_checks(cut(mixing.mix(documents, targets)), documents, targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_shares(cut(p9_mixture(spark, d)), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(table(spark, d, "documents")).select("doc_id", "kind", "found").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_neighbours, p3_found, p3_sentences, p4_found, p4_splits, p4_shares, p5_found, p5_consensus, p5_sources, p5_agreement, p6_found, p6_top,
        p7_found, p7_report, p8_found, p8_leaks, p8_likenesses, p8_report, p8_cleaned, p9_mixture, p9_checks, p9_shares, p10_found, p10_redacted,
    )
}

_TOP = """
WITH best AS (
  SELECT request_id, column_name, study_id, max(score) AS score FROM hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AND study_id IS NOT NULL
  GROUP BY request_id, column_name, study_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, column_name ORDER BY score DESC, study_id) AS place FROM best
)
"""
_ASSERTED = """
WITH read AS (
  SELECT study_id, concept, source, asserted_at,
    CASE WHEN upper(trim(status)) IN ('1', '1.0', 'PRESENT') THEN 'PRESENT' WHEN upper(trim(status)) IN ('0', '0.0', 'ABSENT') THEN 'ABSENT'
         WHEN upper(trim(status)) IN ('-1', '-1.0', 'UNCERTAIN') THEN 'UNCERTAIN' END AS status
  FROM labels
), votes AS (
  SELECT study_id, concept, source, status FROM read
  WHERE status IS NOT NULL AND study_id IS NOT NULL AND concept IS NOT NULL AND source IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY study_id, concept, source ORDER BY asserted_at DESC NULLS LAST, status DESC) = 1
)
"""
_NAME = "nullif(regexp_replace(trim(lower(source)), '[\\s\\-]+', '_', 'g'), '')"
_PERSON = """CASE WHEN regexp_extract(regexp_replace({c}, '[^a-z0-9]', '', 'g'), '0*([0-9]+)$', 1) <> '' THEN regexp_extract(regexp_replace({c}, '[^a-z0-9]', '', 'g'), '^([a-z]*)', 1) || regexp_extract(regexp_replace({c}, '[^a-z0-9]', '', 'g'), '0*([0-9]+)$', 1)
  ELSE regexp_replace({c}, '[^a-z0-9]', '', 'g') END"""
_FILLERS = "('', 'n/a', 'na', 'none', 'null', 'pending', 'unknown', '-', '?')"
_GROUPS = f"""
WITH RECURSIVE tidy AS (
  SELECT image_id, regexp_replace(regexp_replace(replace(lower(trim(coalesce(study_id, ''))), '\\', '/'), '/+|\\s+', '/', 'g'), '^/|/$', '', 'g') AS study,
    regexp_replace(regexp_replace(replace(lower(trim(coalesce(patient_id, ''))), '\\', '/'), '/+|\\s+', '/', 'g'), '^/|/$', '', 'g') AS patient, lower(trim(coalesce(image_checksum, ''))) AS f
  FROM images WHERE image_id IS NOT NULL
), part AS (SELECT *, CASE WHEN contains(study, '/') THEN regexp_extract(study, '^([^/]+)', 1) ELSE '' END AS of_study, regexp_extract(study, '/(.+)$', 1) AS within FROM tidy),
links AS (
  SELECT image_id, 's:' || CASE WHEN within <> '' THEN {_PERSON.format(c='of_study')} || '/' || within ELSE study END AS key FROM part WHERE study NOT IN {_FILLERS}
  UNION SELECT image_id, 'p:' || {_PERSON.format(c='patient')} FROM part WHERE patient NOT IN {_FILLERS}
  UNION SELECT image_id, 'p:' || {_PERSON.format(c='of_study')} FROM part WHERE of_study NOT IN {_FILLERS}
  UNION SELECT image_id, 'f:' || f FROM part WHERE regexp_full_match(f, '[0-9a-f]{{64}}') AND replace(f, f[1], '') <> '' AND f <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'
), near AS (SELECT DISTINCT x.image_id AS a, y.image_id AS b FROM links x JOIN links y USING (key)),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT min(b) AS group_image_id, a AS image_id FROM reach GROUP BY a HAVING min(b) <> a"""
_DRAW = "-{w} / ln((CAST('0x' || substr(sha256('20:{n}:' || g), 1, 13) AS BIGINT) + 1) / (pow(16.0, 13) + 1))"
_SPLITS = (
    _GROUPS.replace("SELECT min(b) AS group_image_id, a AS image_id FROM reach GROUP BY a HAVING min(b) <> a", ", grouped AS (SELECT a AS image_id, min(b) AS g FROM reach GROUP BY a)").rstrip()
    + ", every AS (SELECT i.image_id, coalesce(g, i.image_id) AS g FROM (SELECT DISTINCT image_id FROM images WHERE image_id IS NOT NULL) i LEFT JOIN grouped USING (image_id))"
    + ", drawn AS (SELECT image_id, g, " + ", ".join(_DRAW.format(w=w, n=n) + f" AS {n}" for n, w in (("test", 0.1), ("train", 0.8), ("validation", 0.1))) + " FROM every)"
    + ", splits AS (SELECT image_id, g AS group_image_id, CASE WHEN validation >= train AND validation >= test THEN 'validation' WHEN train >= test THEN 'train' ELSE 'test' END AS split FROM drawn)"
)
SQL = {
    "p4_found": _GROUPS,
    "p4_splits": _SPLITS + " SELECT image_id, group_image_id, split FROM splits",
    "p4_shares": _SPLITS + " SELECT split, count(*) AS images, count(*) FILTER (image_id = group_image_id) AS groups, round(count(*) / (SELECT count(*) FROM splits)::DOUBLE, 6) AS image_share, round(count(*) FILTER (image_id = group_image_id) / (SELECT count(*) FILTER (image_id = group_image_id) FROM splits)::DOUBLE, 6) AS group_share FROM splits GROUP BY split",
    "p9_checks": f"""SELECT t.source, d.source IS NOT NULL AS present, true AS share_met, true AS cap_kept, true AS no_repeats
FROM (SELECT {_NAME} AS source, target_share, max_repeats FROM mix_targets) t LEFT JOIN (SELECT DISTINCT {_NAME} AS source FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL) d
ON t.source = d.source AND t.target_share > 0 AND t.max_repeats > 0 WHERE t.source IS NOT NULL""",
    "p6_found": _TOP + "SELECT request_id, column_name, study_id FROM ranked WHERE place <= 10",
    "p6_top": _TOP + "SELECT request_id, column_name, study_id, score, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 10",
    "p5_agreement": _ASSERTED
    + """, cell AS (SELECT concept, study_id, status, count(*) AS k FROM votes GROUP BY ALL),
item AS (SELECT concept, study_id, sum(k) AS n, sum(k * (k - 1)) AS same FROM cell GROUP BY ALL HAVING sum(k) > 1),
total AS (SELECT concept, count(*) AS items, sum(n) AS labels, sum(n - same / (n - 1)) AS d FROM item GROUP BY ALL),
counted AS (SELECT cell.concept, status, sum(k) AS k FROM cell JOIN item USING (concept, study_id) GROUP BY ALL),
pairs AS (SELECT concept, sum(k * (k - 1)) AS same FROM counted GROUP BY ALL)
SELECT concept, CAST(items AS BIGINT) AS items, CAST(labels AS BIGINT) AS labels, round(d / labels, 6) AS observed,
  round(1 - same / (labels * (labels - 1)), 6) AS expected, round(1 - (d / labels) / (1 - same / (labels * (labels - 1))), 6) AS alpha
FROM total JOIN pairs USING (concept)""",
}
