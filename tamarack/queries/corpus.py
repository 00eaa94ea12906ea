"""Queries of corpus building, labels and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import text as X
from tamarack.operators import corpus as C
from tamarack.operators import labels as L
from tamarack.operators.lookup import document_frequency, token_index
from tamarack.session import table

# fixed values: the concepts of the label table
CONCEPTS = (
    "Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Enlarged Cardiomediastinum", "Fracture", "Lung Lesion", "Lung Opacity", "No Finding", "Pleural Effusion",
    "Pleural Other", "Pneumonia", "Pneumothorax", "Support Devices",
)
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, d: str) -> DataFrame:
    return L.newest(table(spark, d, "labels"), L.PRIORITY)


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve(sources(spark, d))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return L.matrix(resolved(spark, d), table(spark, d, "labels"), CONCEPTS)


NEWEST = """WITH read AS (
  SELECT study_id, concept, source, asserted_at,
    CASE WHEN upper(trim(coalesce(status, ''))) IN ('', 'NAN', 'NOT_MENTIONED') THEN 'NOT_MENTIONED' WHEN upper(trim(status)) IN ('1', '1.0', 'PRESENT') THEN 'PRESENT'
         WHEN upper(trim(status)) IN ('0', '0.0', 'ABSENT') THEN 'ABSENT' ELSE 'UNCERTAIN' END AS status
  FROM labels WHERE source IN ('CHEXBERT_REPORT', 'CHEXBERT_IMPRESSION', 'CHEXBERT_FINDINGS', 'CHEXPERT_V1')
), newest AS (
  SELECT study_id, concept, source, status FROM read
  QUALIFY row_number() OVER (PARTITION BY study_id, concept, source ORDER BY asserted_at DESC NULLS LAST, status DESC) = 1
), resolved AS (
  SELECT study_id, concept, status, CASE WHEN status <> 'NOT_MENTIONED' THEN source END AS source FROM newest
  QUALIFY row_number() OVER (PARTITION BY study_id, concept ORDER BY status = 'NOT_MENTIONED',
    list_position(['CHEXBERT_REPORT', 'CHEXBERT_IMPRESSION', 'CHEXBERT_FINDINGS', 'CHEXPERT_V1'], source)) = 1
)
"""
WIDE = NEWEST + ", wide AS (SELECT s.study_id, " + ", ".join(
    f"coalesce(max(CASE WHEN concept = '{c}' THEN status END), 'NOT_MENTIONED') AS {L.column_of(c)}" for c in CONCEPTS
) + " FROM (SELECT DISTINCT study_id FROM labels) s LEFT JOIN resolved r ON s.study_id = r.study_id GROUP BY s.study_id)\n"


@query(NEWEST + "SELECT * FROM resolved")
def resolve_priority(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)


@query(WIDE + "SELECT * FROM wide")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@query(NEWEST + "SELECT study_id, concept, status, count(*) AS n FROM newest WHERE status <> 'NOT_MENTIONED' GROUP BY ALL")
def agreement_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.agreement_counts(sources(spark, d))


RARITY = NEWEST + """, rarity AS (SELECT concept, n, CAST(row_number() OVER (ORDER BY n, concept) AS INTEGER) AS rank
  FROM (SELECT concept, CAST(sum(CASE WHEN status = 'PRESENT' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM resolved GROUP BY concept))
, strata AS (SELECT study_id, coalesce(arg_min(CASE WHEN status = 'PRESENT' THEN concept END, CASE WHEN status = 'PRESENT' THEN rank END), 'none') AS stratum
  FROM resolved JOIN rarity USING (concept) GROUP BY study_id)
"""


@query(RARITY + "SELECT * FROM rarity")
def concept_rarity(spark: SparkSession, d: str) -> DataFrame:
    return L.rarity(resolved(spark, d))


@query(RARITY + "SELECT * FROM strata")
def stratum_rarest(spark: SparkSession, d: str) -> DataFrame:
    return L.strata(resolved(spark, d))


@query(
    RARITY
    + """, h AS (SELECT study_id, stratum, sha256('20260101:' || study_id) AS h FROM strata),
s AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, study_id) - 0.5) / count(*) OVER (PARTITION BY stratum)::DOUBLE AS spread FROM h)
SELECT study_id, stratum, row_number() OVER (ORDER BY spread, h, study_id) - 1 AS rank_in_manifest FROM s"""
)
def manifest_interleave(spark: SparkSession, d: str) -> DataFrame:
    return L.interleave(L.strata(resolved(spark, d)), 20260101)


@query(
    NEWEST
    + "SELECT g.concept, g.status, count(r.study_id) AS n FROM (SELECT concept, status FROM (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in CONCEPTS)
    + "]) AS concept), (SELECT unnest(['PRESENT', 'UNCERTAIN', 'ABSENT', 'NOT_MENTIONED']) AS status)) g LEFT JOIN resolved r ON g.concept = r.concept AND g.status = r.status GROUP BY ALL"
)
def status_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return L.crosstab(resolved(spark, d), CONCEPTS)


CASES = {
    "include_present": ((("Pleural Effusion", "PRESENT"),), (), "exclude_present", "EXCLUDE", "pleural_effusion = 'PRESENT'"),
    "include_uncertain": ((("Edema", "UNCERTAIN"),), (), "exclude_present", "INCLUDE", "edema = 'UNCERTAIN'"),
    "include_or_uncertain": ((("Edema", "PRESENT"),), ("Pneumonia",), "exclude_present", "INCLUDE", "edema IN ('PRESENT', 'UNCERTAIN') AND pneumonia <> 'PRESENT'"),
    "exclude_present": ((("Lung Opacity", "PRESENT"),), ("Edema",), "exclude_present", "EXCLUDE", "lung_opacity = 'PRESENT' AND edema NOT IN ('PRESENT', 'UNCERTAIN')"),
    "explicit_absence": ((), ("Support Devices",), "explicit_absence_required", "EXCLUDE", "support_devices = 'ABSENT'"),
}
for _name, (_inc, _exc, _ab, _un, _where) in CASES.items():

    def _run(spark: SparkSession, d: str, inc=_inc, exc=_exc, ab=_ab, un=_un) -> DataFrame:
        return matrix(spark, d).where(L.constraint(inc, exc, absence=ab, uncertainty=un)).select("study_id")

    QUERIES[f"constraint_{_name}"] = _run
    SQL[f"constraint_{_name}"] = WIDE + f"SELECT study_id FROM wide WHERE {_where}"


@query(
    """SELECT study_id, image_id, path_to_image FROM images WHERE study_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY coalesce(try_cast(nullif(regexp_extract(path_to_image, 'view([0-9]+)', 1), '') AS INTEGER), 1000000), path_to_image NULLS FIRST,
  image_id, study_id, patient_id NULLS FIRST, local_image_path NULLS FIRST, "view" NULLS FIRST, projection NULLS FIRST, dataset_split NULLS FIRST, image_checksum NULLS FIRST, width NULLS FIRST, height NULLS FIRST) = 1"""
)
def one_image_per_study(spark: SparkSession, d: str) -> DataFrame:
    return C.one_per_group(table(spark, d, "images"), "study_id", "path_to_image").select("study_id", "image_id", "path_to_image")


@query(
    """SELECT image_id, i.study_id, projection FROM images i JOIN (SELECT DISTINCT study_id FROM reports WHERE trim(coalesce(findings, ''), ' \n\t\r') <> '' OR trim(coalesce(impression, ''), ' \n\t\r') <> '') r
ON i.study_id = r.study_id WHERE projection IN ('AP', 'PA') AND local_image_path IN (SELECT local_image_path FROM images WHERE width > 320)"""
)
def eligibility_filter(spark: SparkSession, d: str) -> DataFrame:
    images, reports = table(spark, d, "images"), table(spark, d, "reports")
    some = reports.where(F.coalesce(X.blank_to_null("findings"), X.blank_to_null("impression")).isNotNull()).select("study_id").distinct()
    rows = images.join(some, "study_id", "left_semi")
    return C.eligible(rows, projection="projection", text=(), path="local_image_path", available=images.where("width > 320")).select("image_id", "study_id", "projection")


@query(
    """WITH l AS (SELECT path_to_image AS p FROM images), r AS (SELECT regexp_replace(local_image_path, '^small/', '') AS p FROM images),
ways AS (
  SELECT 'exact' AS strategy, trim(p) AS k, 0 AS side FROM l UNION ALL SELECT 'exact', trim(p), 1 FROM r UNION ALL
  SELECT 'posix_lower', lower(replace(p, '\\', '/')), 0 FROM l UNION ALL SELECT 'posix_lower', lower(replace(p, '\\', '/')), 1 FROM r UNION ALL
  SELECT 'image_key', nullif(regexp_extract(lower(replace(p, '\\', '/')), '(patient[0-9]+/study[0-9]+/view[0-9]+[a-z_]*)', 1), ''), 0 FROM l UNION ALL
  SELECT 'image_key', nullif(regexp_extract(lower(replace(p, '\\', '/')), '(patient[0-9]+/study[0-9]+/view[0-9]+[a-z_]*)', 1), ''), 1 FROM r)
SELECT a.strategy, count(*) AS total, count(b.k) AS matched, round(count(b.k) / count(*)::DOUBLE, 6) AS rate
FROM (SELECT * FROM ways WHERE side = 0) a LEFT JOIN (SELECT DISTINCT strategy, k FROM ways WHERE side = 1 AND k IS NOT NULL) b ON a.strategy = b.strategy AND a.k = b.k GROUP BY a.strategy"""
)
def join_rate_audit(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "images")
    local = images.select(F.regexp_replace("local_image_path", "^small/", "").alias("local"))
    return C.join_audit(images, "path_to_image", local, "local")


@query(
    """SELECT DISTINCT patient_id, (list_reduce(list_transform(string_split(sha256('7:' || patient_id), ''), lambda x: instr('0123456789abcdef', x) - 1), lambda a, x: (a * 16 + x) % 1000)) < 150 AS is_val
FROM images WHERE patient_id IS NOT NULL"""
)
def patient_split(spark: SparkSession, d: str) -> DataFrame:
    return C.hash_split(table(spark, d, "images").select("patient_id").where("patient_id IS NOT NULL").distinct(), "patient_id", 0.15, 7)


@query(
    """WITH p AS (SELECT DISTINCT path_to_image AS p FROM images WHERE trim(coalesce(path_to_image, '')) <> ''),
c AS (SELECT p, regexp_replace(regexp_replace(trim(replace(p, '\\', '/')), '/+', '/', 'g'), '^(\\./)+', '') AS canonical_path FROM p)
SELECT canonical_path, sha256(canonical_path) AS image_id, nullif(regexp_extract(canonical_path, '(patient[0-9]+/study[0-9]+)', 1), '') AS study, nullif(regexp_extract(canonical_path, '(patient[0-9]+)', 1), '') AS patient FROM c"""
)
def path_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "images").select("path_to_image").where(X.blank_to_null("path_to_image").isNotNull()).distinct()
    return C.with_ids(rows, "path_to_image").select("canonical_path", "image_id", X.study_of("canonical_path").alias("study"), X.patient_of("canonical_path").alias("patient"))


@query(
    """WITH h AS (SELECT DISTINCT path_to_image, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path_to_image)) AS h FROM images WHERE path_to_image IS NOT NULL)
SELECT path_to_image, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 AS INTEGER), 1) || substr(h, 18, 3), substr(h, 21, 12)) AS point_id FROM h"""
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "images").select("path_to_image").where("path_to_image IS NOT NULL").distinct()
    return rows.select("path_to_image", X.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", "path_to_image").alias("point_id"))


@query(
    """SELECT * FROM (SELECT 'columns' AS "check", CAST(0 AS BIGINT) AS bad UNION ALL SELECT 'key_null', count(*) FILTER (image_id IS NULL) FROM images
UNION ALL SELECT 'key_duplicate', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM images WHERE image_id IS NOT NULL GROUP BY image_id)
UNION ALL SELECT 'domain_view', count(*) FILTER (NOT coalesce("view" IN ('FRONTAL'), false)) FROM images
UNION ALL SELECT 'domain_projection', count(*) FILTER (NOT coalesce(projection IN ('AP', 'PA'), false)) FROM images
UNION ALL SELECT 'domain_dataset_split', count(*) FILTER (NOT coalesce(dataset_split IN ('train', 'valid'), false)) FROM images)"""
)
def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    return C.contract_checks(table(spark, d, "images"), C.IMAGES)


@query(
    """SELECT image_id, 'left' AS side FROM (SELECT image_id FROM images EXCEPT SELECT image_id FROM corpus_vectors) WHERE image_id IS NOT NULL
UNION ALL SELECT image_id, 'right' FROM (SELECT image_id FROM corpus_vectors EXCEPT SELECT image_id FROM images) WHERE image_id IS NOT NULL"""
)
def orphans_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return C.orphans(table(spark, d, "images"), table(spark, d, "corpus_vectors"), "image_id")


@query("SELECT image_id, count(*) AS copies FROM images GROUP BY image_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "images").groupBy("image_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query(
    "WITH h AS (SELECT sha256(coalesce(study_id, chr(0)) || chr(31) || coalesce(search_text, chr(0))) AS h FROM reports) SELECT count(*) AS rows, sha256(concat_ws(':', count(*), "
    + ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS HUGEINT)), 0)" for i in range(5)) + ")) AS fingerprint FROM h"
)
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return C.fingerprint(table(spark, d, "reports"), ["study_id", "search_text"])


@query(
    """WITH e AS (SELECT DISTINCT evidence_id, study_id, concept FROM evidence)
SELECT * FROM e ORDER BY sha256('11:' || evidence_id), evidence_id LIMIT (SELECT CAST(greatest(1, round(count(*) * 0.1)) AS BIGINT) FROM e)"""
)
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.seeded_sample(table(spark, d, "evidence").select("evidence_id", "study_id", "concept").distinct(), "evidence_id", 0.1, 11)


@query(
    """SELECT study_id, concat_ws('\n\n', nullif(regexp_replace(impression, '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(findings, '^\\s+|\\s+$', '', 'g'), '')) AS body FROM reports"""
)
def report_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").select("study_id", F.concat_ws("\n\n", X.blank_to_null("impression"), X.blank_to_null("findings")).alias("body"))


# words of any script, as X.word_norm makes them, with the underscore as a separator
WORDS = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}]+', ' ', 'g')"


@query(f"SELECT doc_id, trim({WORDS.format(c='title')}) AS norm, replace(trim({WORDS.format(c='title')}), ' ', '') AS text_key FROM documents WHERE title IS NOT NULL")
def name_norms(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of titles of any script."""
    norm = X.word_norm(F.translate("title", "_", " "))
    return table(spark, d, "documents").where("title IS NOT NULL").select("doc_id", norm.alias("norm"), F.replace(norm, F.lit(" "), F.lit("")).alias("text_key"))


@query("SELECT cui, norm, text_key FROM (SELECT 'P' || p_partkey AS cui, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS text_key FROM part)")
def ascii_norms(spark: SparkSession, d: str) -> DataFrame:
    """The ASCII normal form of names."""
    return table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("cui"), X.name_norm("p_name").alias("norm"), X.text_key("p_name").alias("text_key"))


@query(
    """SELECT doc_id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+', ' ', 'g')) AS norm, translate(lower(title), 'àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ', 'aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd') AS bare,
  regexp_matches(lower(text), '[ăâđêôơưàáảãạắằẳẵặấầẩẫậèéẻẽẹếềểễệìíỉĩịòóỏõọốồổỗộớờởỡợùúủũụứừửữựýỳỷỹỵ]') AS vietnamese FROM documents"""
)
def word_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.word_norm("title").alias("norm"), X.strip_marks("title").alias("bare"), X.is_vietnamese("text").alias("vietnamese"))


@query(
    f"""WITH w AS (SELECT study_id, unnest(string_split(trim({WORDS.format(c='findings')}), ' ')) AS term FROM (SELECT DISTINCT study_id, findings FROM reports WHERE findings IS NOT NULL AND study_id IS NOT NULL))
SELECT term, count(DISTINCT study_id) AS df, count(*) AS tf FROM w WHERE term <> '' GROUP BY term"""
)
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Document and term frequencies of findings of any script."""
    rows = table(spark, d, "reports").select("study_id", "findings").distinct().where("findings IS NOT NULL")
    return document_frequency(token_index(rows.withColumn("findings", F.translate("findings", "_", " ")), "study_id", "findings"))


def similar(rows: DataFrame) -> DataFrame:
    """Titles whose word sets have Dice 0.8 or more. Of two such sets the smaller has at least 2/3 of the larger's
    words, so each shares one of its rarest words with the other: only these prefixes are joined."""
    t = rows.select("title").distinct().withColumn("a", F.array_distinct(X.words("title"))).where(F.size("a") > 0)
    long = t.select("title", F.explode("a").alias("w"))
    df = long.groupBy("w").count()
    ordered = long.join(df, "w").groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "w"))), lambda s: s["w"]).alias("o"))
    # shared words are at least 2/3 of either set: the first n - ceil(2n/3) + 1 in rarity order hold one of them
    prefix = ordered.withColumn("k", F.size("o") - F.ceil(F.size("o") * 2 / 3).cast("int") + 1).select("title", F.explode(F.expr("slice(o, 1, k)")).alias("w"))
    pairs = prefix.join(prefix.select(F.col("title").alias("other"), "w"), "w").where("title < other").select("title", "other").distinct()
    both = pairs.join(t, "title").join(t.select(F.col("title").alias("other"), F.col("a").alias("b")), "other")
    return both.select("title", "other", F.round(X.dice(F.col("a"), F.col("b")), 6).alias("dice")).where("dice >= 0.8")


@query(
    f"""WITH t AS (SELECT title, list_distinct(list_filter(string_split(trim({WORDS.format(c="title").replace('p{Nl}]', 'p{Nl}_]')}), ' '), lambda x: x <> '')) AS a FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL))
SELECT x.title, y.title AS other, round(2.0 * len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a)), 6) AS dice FROM t x JOIN t y ON x.title < y.title
WHERE 2.0 * len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a)) >= 0.8 AND len(x.a) > 0 AND len(y.a) > 0"""
)
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different titles of any script."""
    return similar(table(spark, d, "documents").where("title IS NOT NULL"))
