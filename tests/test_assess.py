import math

import pytest
from pyspark.sql import functions as F

from tamarack.operators import assess as A

GOLDS = (A.Gold("q1", (("Edema", "PRESENT"),), ("Fracture",), ("AP",), "negation"), A.Gold("q2", (("Edema", "UNCERTAIN"),), group="uncertainty"), A.Gold("q3"))


@pytest.fixture(scope="module")
def world(spark):
    matrix = spark.createDataFrame([("a", "PRESENT", "ABSENT", "AP"), ("b", "PRESENT", "NOT_MENTIONED", "AP"), ("c", "PRESENT", "PRESENT", "AP"), ("d", "UNCERTAIN", "ABSENT", "PA"), ("e", "PRESENT", "ABSENT", None)], "study_id string, edema string, fracture string, projection string")
    agreement = spark.createDataFrame([("a", "Edema", "PRESENT", 3), ("a", "Fracture", "ABSENT", 1), ("b", "Edema", "PRESENT", 2), ("d", "Edema", "UNCERTAIN", 1)], "study_id string, concept string, status string, n bigint")
    return matrix, agreement


def test_relevance(world):
    matrix, agreement = world
    got = lambda *p: {(r.qid, r.study_id): r.grade for r in A.relevance(matrix, agreement, GOLDS, *p, projection="projection").collect()}
    assert got("exclude_present", "EXCLUDE") == {("q1", "a"): 3.0, ("q1", "b"): 2.0, ("q2", "d"): 2.0}
    assert got("explicit_absence_required", "EXCLUDE") == {("q1", "a"): 3.0, ("q2", "d"): 2.0}
    counts = {(r.qid, r.policy): r.n for r in A.filter_counts(matrix, GOLDS).collect()}
    assert counts["q1", "exclude_present/EXCLUDE"] == 3 and counts["q2", "exclude_present/INCLUDE"] == 1 and len(counts) == 8
    assert A.matching(matrix, (), "exclude_present", "EXCLUDE").count() == 0


def test_metrics_of_runs(spark, world):
    matrix, agreement = world
    relevant = A.relevance(matrix, agreement, GOLDS[:2], "exclude_present", "EXCLUDE", "projection")
    runs = spark.createDataFrame([("s", "q1", "c", 1), ("s", "q1", "b", 2), ("t", "q2", "d", 1)], "system string, qid string, study_id string, rank int")
    queries = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    banned = spark.createDataFrame([("q1", "c")], "qid string, study_id string")
    got = {(r.system, r.qid): r for r in A.query_metrics(runs, relevant, banned, queries=queries).collect()}
    ideal = 3 + 2 / math.log2(3)
    assert got["s", "q1"].ndcg_graded == pytest.approx(2 / math.log2(3) / ideal, abs=1e-6) and got["s", "q1"].mrr == 0.5 and got["s", "q1"].violation == 0.5
    assert got["t", "q2"].ndcg_binary == 1 and got["t", "q2"].violation is None and got["t", "q1"].returned == 0 and got["t", "q1"].violation is None
    means = {(r.system, r.scope): r for r in A.macro_means(A.query_metrics(runs, relevant, banned, queries=queries).withColumn("g", F.array(F.lit("x"), F.col("qid"))), ["system"], ["mrr", "violation"], "g").collect()}
    assert means["s", "all"].mrr == 0.25 and means["s", "all"].violation == 0.5 and means["s", "x"].n == 2 and means["s", "q1"].mrr == 0.5


def test_graded_runs_and_differences(spark):
    runs = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2), ("t", "q", "b", 1)], "system string, qid string, study_id string, rank int")
    judged = spark.createDataFrame([("q", "a", 2, False), ("q", "b", 1, True)], "qid string, study_id string, grade int, violates boolean")
    queries = spark.createDataFrame([("q", True), ("none", False)], "qid string, has_exclusion boolean")
    pool = A.judging_pool(runs, 10)
    got = {(r.system, r.qid): r for r in A.graded_metrics(runs, judged, pool, queries).collect()}
    assert got["s", "q"].ndcg == 1 and got["s", "q"].p10 == 0.1 and got["s", "q"].p10_lenient == 0.2 and got["s", "q"].violation == 0.1
    assert got["t", "q"].ndcg == pytest.approx(1 / (3 + 1 / math.log2(3)), abs=1e-6) and got["t", "none"].no_result and got["t", "none"].violation is None
    off = {r.system: r.p10_lenient for r in A.graded_metrics(runs, judged, pool, queries.where("qid = 'q'"), view_ok=F.col("study_id") == "a").collect()}
    assert off == {"s": 0.1, "t": 0.0}
    d = A.system_differences(A.graded_metrics(runs, judged, pool, queries), [("s", "t")], ["ndcg", "violation"]).orderBy("metric").collect()
    assert [(r.metric, r.n, r.wins, r.ties) for r in d] == [("ndcg", 2, 1, 1), ("violation", 1, 0, 1)]
    assert A.losing(A.graded_metrics(runs, judged, pool, queries), "t", "s", "ndcg").count() == 1
    cells = spark.createDataFrame([("w1", 0.1, 0.02), ("w2", 0.2, -0.1), ("w3", None, None)], "cell string, mean double, low double")
    assert A.fusion_choice(cells, 0.05).first().asDict() == {"best": "w2", "mean": 0.2, "low": -0.1, "kept": False} and A.fusion_choice(cells.where("cell = 'w1'"), 0.05).first().kept


def test_parsers(spark):
    gold = spark.createDataFrame([("1", "Edema", "PRESENT"), ("1", "Mass", "ABSENT"), ("2", "Edema", "PRESENT")], "qid string, concept string, status string")
    pred = spark.createDataFrame([("1", "Edema", "PRESENT"), ("1", "Mass", "PRESENT"), ("3", "Scar", "PRESENT")], "qid string, concept string, status string")
    q = spark.createDataFrame([("1", True, "en"), ("2", False, "en"), ("3", True, "vi"), ("4", True, "vi")], "qid string, valid boolean, language string")
    classes = {r["class"]: (r.tp, r.fp, r.fn, r.f1) for r in A.item_scores(gold, pred, ["concept"], F.col("concept")).collect()}
    assert classes == {"Edema": (1, 0, 1, 0.666667), "Mass": (1, 0, 0, 1.0), "Scar": (0, 1, 0, 0.0)}
    all_ = A.parser_report(gold, pred, q).first()
    assert (all_.n, all_.valid, all_.exact) == (4, 0.75, 0.25) and all_.concept_f1 == pytest.approx(5 / 9, abs=1e-6)
    by = {r.language: r for r in A.verdict(A.parser_report(gold, pred, q, ["language"]), 0.5, 0.5).collect()}
    assert by["en"].exact == 0 and by["vi"].concept_f1 == 0 and by["en"].status_f1 == 0.25 and by["en"].passed is False
    empty = A.verdict(A.parser_report(gold.limit(0), pred.limit(0), q), 0.5, 0.5).first()
    assert empty.concept_f1 is None and empty.passed  # what can't be measured doesn't fail


def test_understanding_and_steps(spark):
    rows = spark.createDataFrame(
        [(["c1|P"], ["c1|P"], ["c1"], ["+c1"], ["+c1"], [], []), ([], ["c1|P"], ["c1"], [], ["+c1"], ["w"], ["w", "x"]), ([], ["c1|P"], ["c2"], [], ["+c1"], [], []), (["c1|P"], ["c1|P"], [], ["+c2"], ["+c1"], [], [])],
        "chosen array<string>, gold array<string>, cand array<string>, got array<string>, want array<string>, warned array<string>, expected array<string>",
    )
    out = rows.select(A.error_step("gold", "chosen", "cand", "got", "want").alias("step"), *[c.alias(n) for n, c in A.understanding("chosen", "gold", "got", "want", "warned", "expected").items()]).collect()
    assert [r.step for r in out] == ["ranking", "choice", "parse_or_lookup", "expansion"]
    assert (out[0].hits, out[0].columns_exact, out[0].warnings_recall) == (1, True, None) and (out[1].hits, out[1].columns_f1, out[1].warnings_recall) == (0, 0.0, 0.5)


def test_samples_splits_and_shares(spark):
    judged = spark.createDataFrame([(f"q{i}", "s", 2 if i < 2 else i % 2) for i in range(30)], "qid string, study_id string, grade int")
    got = A.balanced_sample(judged, ["qid", "study_id"], "grade", 9, 1)
    assert got.count() == 9 and {r.grade: r["count"] for r in got.groupBy("grade").count().collect()} == {2: 2, 1: 4, 0: 3}
    assert A.balanced_sample(judged.limit(0), ["qid"], "grade", 9, 1).count() == 0 and A.balanced_sample(judged, ["qid"], "grade", 99, 1).count() == 30
    rows = [{"id": f"{g}{i}{lang}", "group": g, "lang": lang, "pair": f"{g}{i}" if i < 2 else None} for g in "ab" for i in range(4) for lang in ("en", "vi")]
    split = A.split_pairs(rows, 4, 3)
    assert all(split[f"{g}{i}en"] == split[f"{g}{i}vi"] for g in "ab" for i in range(2)) and sum(v == "dev" for v in split.values()) == 8
    for g in "ab":
        langs = [k[-2:] for k, v in split.items() if v == "dev" and k[0] == g]
        assert langs.count("en") == langs.count("vi") == 2
    answers = spark.createDataFrame([("ok", 3, ["number: 3", "concept: x"]), ("failed", 1, None)], "status string, kept int, dropped array<string>")
    assert A.answer_shares(answers).first().asDict() == {"answers": 2, "ok_share": 0.5, "sentences": 6, "grounded_share": 0.6667, "dropped_share": 0.3333}
    assert {(r.reason, r.share) for r in A.dropped_reasons(answers).collect()} == {("number", 0.5), ("concept", 0.5)}
    votes = spark.createDataFrame([("A", True), ("B", True), ("tie", True), ("A", False)], "v string, b boolean")
    assert [r[0] for r in votes.select(A.blind_outcome(F.col("v"), F.col("b"))).collect()] == [-1, 1, 0, 1]
    sides = [r[0] for r in spark.range(200).select(A.second_is_b(F.col("id"), 1)).collect()]
    assert 60 < sum(sides) < 140
    costs = {r.step: (r.calls, r.cost) for r in A.cost_table(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0)], "step string, usd double"), "step", "usd", 10).collect()}
    assert costs == {"a": (2, 3.0), "b": (1, 4.0), None: (3, 7.0)}
    assert spark.range(1).select(A.token_cost(F.lit(1_000_000), F.lit(500_000), 2.0, 4.0)).first()[0] == 4.0
