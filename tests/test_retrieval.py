import math

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evaluate as E
from tamarack.queries import retrieval as R

REQUESTS, STUDIES = 60, 50


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """60 requests for one concept that 50 studies have, of which each request returned three; and one without a request, one of an unknown concept."""
    d = tmp_path_factory.mktemp("tables")
    study = lambda i: f"s{i:03d}"
    hits = [(r, "Edema", study((r + 7 * i) % STUDIES), 3.0 - i) for r in range(REQUESTS) for i in range(3)] + [(None, "Edema", study(0), 1.0), (1, "Scar", study(0), 1.0), (0, "Edema", study(0), float("nan"))]
    spark.createDataFrame(hits, "request_id bigint, column_name string, study_id string, score double").write.parquet(f"{d}/hits.parquet")
    labels = [(study(i), "Edema", "PRESENT" if i % 2 else "UNCERTAIN", "CHEXPERT_V1") for i in range(STUDIES)]
    spark.createDataFrame(labels, "study_id string, concept string, status string, source string").withColumn("asserted_at", F.lit("2026-01-01").cast("timestamp")).write.parquet(f"{d}/labels.parquet")
    return str(d)


def shuffled(spark, run):
    """What run gives, and the most rows that one of its stages wrote for a shuffle, without the broadcasts that only small tables get."""
    sc = spark.sparkContext
    listed = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    before = {s.stageId() for s in map(listed().apply, range(listed().size()))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = listed()
    return got, max(s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size())) if s.stageId() not in before)


def gains(r, exponential):
    grade = [2 if ((r + 7 * i) % STUDIES) % 2 else 1 for i in range(3)]
    gain = (lambda g: 2**g - 1) if exponential else (lambda g: g)
    return round(sum(gain(g) / math.log2(i + 2) for i, g in enumerate(grade)) / sum(gain(2) / math.log2(i + 2) for i in range(10)), 6)


@pytest.mark.parametrize("exponential", [True, False])
def test_ndcg(spark, folder, exponential):
    query = R.ndcg_exponential if exponential else R.ndcg_graded
    got, most = shuffled(spark, lambda: {(r.request_id, r.concept): r.ndcg for r in query(spark, folder).collect()})
    assert got == {(r, "Edema"): pytest.approx(gains(r, exponential), abs=1e-6) for r in range(REQUESTS)} | {(None, "Edema"): 0, (1, "Scar"): 0}
    assert most < 5 * REQUESTS  # not one row per request and relevant study


def test_precision_mrr(spark, folder):
    got, most = shuffled(spark, lambda: {(r.request_id, r.concept): (r.p_at_5, r.p_at_k, r.mrr) for r in R.precision_mrr(spark, folder).collect()})
    want = {(None, "Edema"): (0, 0, 0), (1, "Scar"): (0, 0, 0)}
    for r in range(REQUESTS):
        hits = [i + 1 for i in range(3) if ((r + 7 * i) % STUDIES) % 2]
        want[r, "Edema"] = len(hits) / 5, len(hits) / 10, pytest.approx(1 / hits[0], abs=1e-6)
    assert got == want and most < 5 * REQUESTS  # not one row per request and relevant study


def test_precision_without_request(spark):
    ranked = spark.createDataFrame([(None, "c", "a", 1), (None, "c", "b", 2)], "q int, c string, i string, rank int")
    relevant = spark.createDataFrame([("c", "b")], "c string, i string")
    assert [tuple(r) for r in E.rank_metrics(ranked, relevant, ["q", "c"], "i", of=["c"]).collect()] == [(None, "c", 0.2, 0.1, 0.5)]  # as in the SQL


def paired():
    """(n, mean, wins, losses, ties) of graded against exponential gains."""
    d = [gains(r, False) - gains(r, True) for r in range(REQUESTS)] + [0.0]
    return len(d), sum(d) / len(d), sum(x > 0 for x in d), sum(x < 0 for x in d), sum(x == 0 for x in d)


def test_paired_bootstrap(spark, folder):
    got, most = shuffled(spark, lambda: R.paired_bootstrap(spark, folder).first())
    n, mean, *rest = paired()
    assert (got.n, got.wins, got.losses, got.ties) == (n, *rest) and got.mean == pytest.approx(mean, abs=1e-9) and got.low <= mean <= got.high
    assert most < 4 * 200 + 1  # sums of 200 rounds in 4 partitions, not one row per request and relevant study


def test_paired_difference(spark, folder):
    got, most = shuffled(spark, lambda: R.paired_difference(spark, folder).first())
    n, mean, *rest = paired()
    assert tuple(got) == (n, pytest.approx(mean, abs=1e-6), *rest)
    assert most < 5 * REQUESTS  # not one row per request and relevant study


def test_ideal_of_few_and_equal_grades(spark):
    ranked = spark.createDataFrame([(1, "c", "a", 1), (2, "c", "x", 1), (2, "c", "b", 2), (1, "none", "a", 1)], "q int, c string, i string, rank int")
    judged = spark.createDataFrame([("c", "a", 2), ("c", "b", 1), ("c", "d", 1), ("c", "e", 1), ("c", "f", 0)], "c string, i string, grade int")
    for k, places in ((10, (2, 1, 1, 1)), (3, (2, 1, 1)), (1, (2,))):
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(places))
        got = {(r.q, r.c): r.ndcg for r in E.ndcg(ranked, judged, ["q", "c"], "i", "grade", k, of=["c"]).collect()}
        assert got == {(1, "c"): pytest.approx(2 / ideal, abs=1e-6), (2, "c"): pytest.approx((1 / math.log2(3) if k > 1 else 0) / ideal, abs=1e-6), (1, "none"): 0}
        each = spark.createDataFrame([(1,), (2,)], "q int").crossJoin(judged)
        assert got == {(r.q, r.c): r.ndcg for r in E.ndcg(ranked, each, ["q", "c"], "i", "grade", k).collect()}


def test_rank_of_missing_studies(spark, tmp_path):
    hits = [(1, "Edema", None, 1.0), (1, "Edema", "a", 1.0), (1, "Edema", "b", 2.0)]
    spark.createDataFrame(hits, "request_id bigint, column_name string, study_id string, score double").write.parquet(f"{tmp_path}/hits.parquet")
    assert {r.study_id: r.rank for r in R.ranked(spark, str(tmp_path)).collect()} == {"b": 1, "a": 2, None: 3}  # as in the SQL
