import datetime as dt
import itertools
import math
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions import parsing, text
from tamarack.operators import corpus, evaluate, graph, labels, lookup, ml, vectors
from tamarack.plans import intents as P
from tamarack.sources import io
from tamarack.streaming.incremental import score_stream

STATES = ("PRESENT", "UNCERTAIN", "ABSENT", "NOT_MENTIONED")


def test_label_codes(spark):
    rows = [("1",), ("0.0",), ("-1",), (" present ",), (None,), ("NaN",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(labels.status("s")).collect()]
    assert got == ["PRESENT", "ABSENT", "UNCERTAIN", "PRESENT", "NOT_MENTIONED", "NOT_MENTIONED", "NOT_MENTIONED"]
    with pytest.raises(Exception, match="unknown label code"):
        spark.createDataFrame([("2",)], "s string").select(labels.status("s")).collect()


def test_constraint_truth_table(spark):
    df = spark.createDataFrame([(s,) for s in STATES], "edema string")
    for absence, uncertainty in itertools.product(("exclude_present", "explicit_absence_required"), ("INCLUDE", "EXCLUDE")):
        keep = uncertainty == "INCLUDE"

        def ok(**k):
            return {r.edema for r in df.where(labels.constraint(absence=absence, uncertainty=uncertainty, **k)).collect()}

        assert ok(include=[("Edema", "PRESENT")], exclude=[]) == ({"PRESENT", "UNCERTAIN"} if keep else {"PRESENT"})
        assert ok(include=[("Edema", "UNCERTAIN")], exclude=[]) == {"UNCERTAIN"}
        want = {"ABSENT"} if absence == "explicit_absence_required" else {"ABSENT", "NOT_MENTIONED"} | ({"UNCERTAIN"} if keep else set())
        assert ok(include=[], exclude=["Edema"]) == want
    with pytest.raises(ValueError):
        labels.constraint([], [])


def test_priority_skips_silent_sources(spark):
    rows = [("s", "c", "CHEXBERT_REPORT", "NOT_MENTIONED"), ("s", "c", "CHEXPERT_V1", "ABSENT"), ("t", "c", "CHEXPERT_V1", "NOT_MENTIONED")]
    df = spark.createDataFrame(rows, "study_id string, concept string, source string, status string")
    assert {tuple(r) for r in labels.resolve(df).collect()} == {("s", "c", "ABSENT", "CHEXPERT_V1"), ("t", "c", "NOT_MENTIONED", None)}
    assert labels.resolve(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown source"):
        labels.resolve(df.withColumn("source", F.lit("X"))).collect()


def test_manifest_is_contiguous_and_prefix_stable(spark):
    df = spark.createDataFrame([(f"s{i:03d}", "a" if i % 10 else "b") for i in range(200)], "study_id string, stratum string")
    got = labels.interleave(df, 7).collect()
    assert sorted(r.rank_in_manifest for r in got) == list(range(200))
    assert 8 <= sum(r.stratum == "b" for r in got if r.rank_in_manifest < 100) <= 12
    again = {r.study_id: r.rank_in_manifest for r in labels.interleave(df.repartition(7), 7).collect()}
    assert again == {r.study_id: r.rank_in_manifest for r in got}
    pinned = {r.study_id: r.rank_in_manifest for r in labels.interleave(df, 7, pinned=["s150"], limit=50).collect()}
    assert pinned["s150"] == 0 and sorted(pinned.values()) == list(range(50))
    with pytest.raises(ValueError, match="pinned"):
        labels.interleave(df, 7, pinned=["nope"])


def closed_form(i, z: dict[str, float]) -> float:
    """The closed form of an intent's score."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    v = [max(-P.CLIP, min(P.CLIP, z[p.column])) for p in i.parts]
    yes = i.polarity == "PRESENT"
    if i.combine == "single":
        return math.log(sig(v[0] if yes else -v[0]))
    if i.combine == "weighted":
        return sum(p.weight * math.log(sig(x)) for p, x in zip(i.parts, v)) if yes else math.log(sum(p.weight * sig(-x) for p, x in zip(i.parts, v)))
    if i.combine == "max":
        return math.log(max(map(sig, v))) if yes else math.log(1 - max(map(sig, v)))
    w = [p.weight if i.combine == "weighted_noisy_or" else 1.0 for p in i.parts]
    none = math.prod(1 - a * sig(x) for a, x in zip(w, v))
    return math.log(1 - none) if yes else math.log(none)


@pytest.mark.parametrize("combine, polarity", list(itertools.product(P.COMBINES, ("PRESENT", "ABSENT"))))
def test_scores_match_closed_forms(spark, combine, polarity):
    parts = (P.Part("x", 0.5), P.Part("y", 0.3), P.Part("z", 0.2))
    i = P.Intent("q", polarity, combine, parts[:1] if combine == "single" else parts)
    rows = [(-3.0, 0.5, 2.0), (0.0, 0.0, 0.0), (8.0, -1.0, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double, z double").select(P.score([i])).collect()]
    for g, r in zip(got, rows):
        try:
            want = closed_form(i, dict(zip("xyz", r)))
        except ValueError:
            continue
        assert g == pytest.approx(want, abs=1e-9)


def test_expansion_routes():
    e = lambda c, pol="PRESENT", **k: P.expand(c, pol, scorable={"a", "b", "w"}, weak={"w"}, **k)
    assert e("a").route == "direct" and e("w").warnings == ("weak",)
    assert e("x", manual=[("a", 1.0)], below=["b"]).route == "manual"
    assert [p.column for p in e("x", below=["a", "w", "b", "a"]).parts] == ["a", "b"]
    assert e("x", above="a").route == "narrower" and e("x", "ABSENT", above="a").parts == ()
    s = e("x", kind="Disease", suggests=[("a", 0.6), ("b", 0.2)])
    assert [p.weight for p in s.parts] == pytest.approx([0.75, 0.25]) and s.combine == "weighted"
    t = e("x", kind="Anatomy", typical=[("a", 0.8), ("w", 0.7), ("b", 0.4)])
    assert [p.weight for p in t.parts] == pytest.approx([1.0, 0.5]) and t.combine == "weighted_noisy_or"
    assert e("x").route == "none" and P.score([]) is not None
    assert P.needs_text([e("x")]) and not P.needs_text([e("a")])
    assert len(P.dedupe([e("a"), e("a"), e("a", "ABSENT")])) == 2


def test_topk_ties_nan_and_allow_list(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, float("nan")), (4, None), (5, 0.5)], "id int, s double")
    assert [(r.id, r.rank) for r in vectors.top_k(df, "s", "id", 2).collect()] == [(1, 1), (3, 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    assert [r.id for r in vectors.nearest_to(v, [1.0, 0.2], 3, key="id", vec="v").collect()] == [1, 3, 2]
    assert vectors.nearest_to(v, [1.0, 0.2], 3, key="id", vec="v", allowed=v.limit(0)).count() == 0
    near = {(r.query, r.id) for r in vectors.batch_nearest(v, v.unionByName(spark.createDataFrame([(9, [0.0, 0.0]), (8, None)], "id int, v array<double>")), 1, key="id", vec="v").collect()}
    assert near == {(1, 3), (2, 3), (3, 1)}


def test_auroc_ndcg_kappa(spark):
    df = spark.createDataFrame([("c", 0.9, 1), ("c", 0.8, 0), ("c", 0.8, 1), ("c", 0.1, 0), ("d", 1.0, 1)], "g string, s double, y int")
    got = {r.g: r.auroc for r in evaluate.auroc(df, ["g"], "s", F.col("y") == 1, F.col("y") == 0).collect()}
    assert got == {"c": 0.875, "d": None}
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "z", 1)], "q string, i string, rank int")
    judged = spark.createDataFrame([("q", "b", 2), ("q", "c", 1)], "q string, i string, grade int")
    ideal = 2 + 1 / math.log2(3)
    assert {r.q: r.ndcg for r in evaluate.ndcg(ranked, judged, ["q"], "i", "grade", 10).collect()} == {"q": pytest.approx((2 / math.log2(3)) / ideal, abs=1e-6), "r": 0.0}
    pairs = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b"), ("b", "a")], "x string, y string")
    assert evaluate.cohen_kappa(pairs, "x", "y", ("a", "b"), weighted=False).first().kappa == 0
    assert evaluate.macro_f1(pairs, "x", "y").first().macro_f1 == 0.5
    b = evaluate.bootstrap_mean_diff(spark.createDataFrame([(float(i), float(i) - 1) for i in range(50)], "a double, b double"), "a", "b", 50, 1).first()
    assert b.mean == 1 and b.low == pytest.approx(1) and b.wins == 50


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0).astype(float)
    z = np.column_stack([x, np.ones(300)])
    df = spark.createDataFrame([(r.tolist(), int(t), None if i % 3 == 0 else int(t)) for i, (r, t) in enumerate(zip(x, y))] + [(None, 1, 1)], "x array<double>, y int, part int")
    fits = ml.fit_logistic(df, "x", ["y", "part"], [2.0, 0.5], 3)
    for (name, lam), w in fits.items():
        use = np.ones(300, bool) if name == "y" else np.arange(300) % 3 != 0
        grad = z[use].T @ (1 / (1 + np.exp(-z[use] @ w)) - y[use]) + lam * np.append(w[:-1], 0)
        assert np.abs(grad).max() < 1e-6
    assert np.abs(ml.fit_logistic(df.limit(0), "x", ["y"], [1.0], 3)["y", 1.0]).max() == 0
    rows = [("c", float(s), int(t)) for s, t in zip(x[:, 0], y)] + [("few", 1.0, 1), ("far", None, 1)] + [("far", v * 30.0 + n, int(v > 0)) for v in (-1, 1) for n in (0.0, 5.0) for _ in range(10)] + [("far", 200.0, 1)]
    cal = {r.k: r for r in ml.calibrate(spark.createDataFrame(rows, "k string, s double, t int"), "k", "s", "t", max_iter=12).collect()}
    s1 = np.column_stack([x[:, 0], np.ones(300)])
    assert np.abs(s1.T @ (1 / (1 + np.exp(-s1 @ [cal["c"].a, cal["c"].b])) - y)).max() < 1e-5
    assert cal["c"].note is None and cal["few"].note == "uncalibrated" and (cal["few"].a, cal["few"].b) == (1, 0) and cal["far"].note == "saturated"
    assert ml.best_penalty([(1.0, 0.7), (10.0, 0.7 + 1e-12), (0.1, None)]) == 10.0 and ml.best_penalty([(10.0, 0.7), (1.0, 0.70001)]) == 1.0


def status_rows(spark, n=400, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    states = [np.where(x[:, j] + 0.4 * rng.normal(size=n) > 0.3, "PRESENT", np.where(rng.random(n) < 0.5, "ABSENT", np.where(rng.random(n) < 0.5, "UNCERTAIN", "NOT_MENTIONED"))) for j in range(2)]
    rows = [(i, f"p{i // 2}", x[i].tolist(), str(states[0][i]), str(states[1][i]), "ABSENT") for i in range(n)]
    return spark.createDataFrame(rows, "i int, patient string, x array<double>, a string, b string, never string")


def test_penalties_and_probes(spark):
    df = status_rows(spark)
    best, table = ml.select_penalty(df, "x", ["a", "b", "never"], "patient", [0.1, 1.0, 1000.0], 4, share=0.3, seed=7)
    got = table.collect()
    assert {(r.concept, r.penalty) for r in got} == {(c, p) for c in "ab" for p in (0.1, 1.0, 1000.0)} and all(r.auroc > 0.8 for r in got) and best in (0.1, 1.0, 1000.0)
    with pytest.raises(ValueError):
        ml.select_penalty(df, "x", ["never"], "patient", [1.0], 4, share=0.3, seed=7)
    probe = ml.train_probe(df, "x", ["a", "b"], best, 4)
    assert probe["a"][0] > abs(probe["a"][2]) and probe["b"][1] > abs(probe["b"][3])
    columns = ml.fit_columns(df, "x", ["a", "b"], F.col("i") % 3 == 0, [0.1, 10.0], 4)
    assert all(c["a"] > 0 and set(c["scores"]) == {0.1, 10.0} and len(c["weights"]) == 5 for c in columns.values())


def test_bootstraps_quality_and_gate(spark):
    df = status_rows(spark).select("i", F.col("x")[0].alias("good"), F.col("x")[3].alias("bad"), "a").withColumn("concept", F.lit("a"))
    pos, neg = F.col("a") == "PRESENT", F.col("a").isin("ABSENT", "NOT_MENTIONED")
    d = ml.paired_delta(df, ["concept"], "i", "good", "bad", pos, neg, 40, 5).first()
    assert d.accept and d.low < d.delta < d.high and d["first"] > 0.9
    assert not ml.paired_delta(df, ["concept"], "i", "bad", "bad", pos, neg, 10, 5).first().accept
    long = df.unpivot(["i", "concept", "a"], ["good", "bad"], "model", "score")
    m = {r.model: r for r in ml.macro_bootstrap(long, "model", "concept", "i", "score", "a", 20, 5).collect()}
    assert m["good"].low <= m["good"].macro <= m["good"].high and m["good"].low > m["bad"].high
    q = ml.quality(spark.createDataFrame([("x", 0.66, 0.6), ("y", 0.5, 0.4), ("z", 0.9, 0.8)], "concept string, auroc_lenient double, low double"), 0.65)
    assert {r.concept: (r.weak, r.borderline) for r in q.collect()} == {"x": (False, True), "y": (True, True), "z": (False, False)}
    models = lambda rows: spark.createDataFrame([(n, "cpu", 0, 8, 8, m, 1.0, s, lic) for n, m, s, lic in rows], "name string, device string, errors int, dim_image int, dim_text int, macro double, forecast_hours double, seconds_per_image double, licence string")
    assert ml.choose_model(models([("a", 0.7, 1.0, "mit"), ("b", 0.6, 0.1, "mit")]))[0] == "a"
    assert ml.choose_model(models([("a", 0.7, 1.0, "mit"), ("b", 0.69, 0.1, "mit")]))[0] == "b"
    assert ml.choose_model(models([("a", 0.7, 1.0, "cc-by-nc-4.0"), ("b", 0.69, 0.95, "mit")]))[0] == "b"
    assert ml.choose_model(models([("a", 0.5, 1.0, "mit")])) == (None, [("a", ["macro strict AUROC too low"])])


def test_running_sums(spark):
    from tamarack.session import running_sums

    df = spark.createDataFrame([(i % 3 if i % 7 else None, i, float(i)) for i in range(200)], "g int, o int, v double").repartition(5)
    got = running_sums(df, ["g"], [F.col("o").desc()], {"before": F.col("v"), "n": F.lit(1)}).collect()
    rows = df.collect()
    for r in got:
        earlier = [x for x in rows if x.g == r.g and x.o > r.o]
        assert r.before == sum(x.v for x in earlier) and r.n == len(earlier)
    assert sorted(r.n for r in running_sums(df, [], [F.col("o")], {"n": F.lit(1)}).collect()) == list(range(200))
    assert running_sums(df.limit(0), ["g"], [F.col("o")], {"n": F.lit(1)}).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Đường  Thở, ABC-1",)], "s string")
    r = df.select(text.name_norm("s").alias("a"), text.word_norm("s").alias("b"), text.strip_marks("s").alias("c"), text.tokens("s").alias("d"), text.hex_mod(F.sha2(F.lit("7:x"), 256), 1000).alias("h"), text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.lit("x/y")).alias("u")).first()
    import hashlib
    import uuid

    assert r.a == "ng th abc 1" and r.b == "đường thở abc 1" and r.c == "duong  tho, abc-1" and r.d == ["đường", "thở", ",", "abc-1"]
    assert r.h == int(hashlib.sha256(b"7:x").hexdigest(), 16) % 1000 and r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "x/y"))
    s = spark.createDataFrame([("cavities",), ("masses",), ("bands",), ("pelvis",), ("opacity",)], "w string").select(text.singular_candidate("w")).collect()
    assert [x[0] for x in s] == ["cavity", "masse", "band", None, None]
    paths = spark.createDataFrame([("./a\\b//view2_x.jpg",)], "p string").select(text.image_path("p"), text.view_index("p")).first()
    assert tuple(paths) == ("a/b/view2_x.jpg", 2)


def test_cues_reach_and_scope():
    forms = [(("pleural", "effusion"), "effusion"), (("effusion",), "fluid"), (("pneumothorax",), "air"), (("edema",), "edema"), (("phù",), "edema", "vi"), (("no", "finding"), "none")]
    p = lambda t: dict(parsing.parse(t, forms))
    assert p("no effusion and pneumothorax") == {"fluid": "ABSENT", "air": "ABSENT"} and p("no effusion with edema") == {"fluid": "ABSENT", "edema": "PRESENT"}
    assert p("No pleural effusion but edema") == {"effusion": "ABSENT", "edema": "PRESENT"} and p("no, edema") == {"edema": "PRESENT"}
    assert p("no a b c d e edema") == {"edema": "ABSENT"} and p("no a b c d e f edema") == {"edema": "PRESENT"}
    assert p("edema a b c excluded") == {"edema": "ABSENT"} and p("edema a b c d excluded") == {"edema": "PRESENT"}
    assert p("possible edema") == {"edema": "UNCERTAIN"} and p("no possible edema") == {"edema": "UNCERTAIN"} and p("possible no edema") == {"edema": "ABSENT"}
    assert p("edema without effusion") == {"edema": "PRESENT", "fluid": "ABSENT"} and p("edema. no edema") == {"edema": "ABSENT"}
    assert p("no finding and edema") == {"none": "PRESENT", "edema": "PRESENT"} and p("không có phù và edema") == {"edema": "ABSENT"}
    assert p("no evidence of edema") == {"edema": "ABSENT"} and p("cannot exclude edema") == {"edema": "UNCERTAIN"} and p("") == p(None) == {}
    # equally near cues: uncertain
    assert p("edema suspected") == {"edema": "UNCERTAIN"} and p("absent a edema a likely") == {"edema": "UNCERTAIN"}


def test_forms_views_and_language():
    g = parsing.Grammar(
        [(("lower", "lobe"), "lobe"), (("lobe", "mass", "lesion", "x"), "late"), (("mass",), "mass"), (("phù",), "edema", "vi")], [(("pa",), "PA"), (("thẳng",), "FRONTAL", "vi")], [("phù", "hợp")]
    )
    assert g.parse("lower lobe mass lesion x").mentions == (("lobe", "PRESENT"), ("mass", "PRESENT"))  # from left to right
    r = g.parse("no mass on PA and pa")
    assert r.views == ("PA",) and r.exclude == ["mass"] and r.include == [] and r.language == "en"
    assert g.parse("phù hợp").mentions == () and g.parse("phu, phù").language == "vi" and g.parse("mass thẳng").views == ("FRONTAL",)


def test_sentences_and_evidence():
    cut = lambda t: [t[a:b] for a, b in parsing.sentence_spans(t)]
    assert cut("1. Clear lungs. No edema here.\nEdema? Maybe\nmore. 2.") == ["1. Clear lungs.", "No edema here.", "Edema?", "Maybe\nmore."]
    assert cut("One.\nTwo.\nThree.") == ["One.", "Two.", "Three."] and cut("2.5 cm a.b") == ["2.5 cm a.b"] and cut(" \n") == cut(None) == []
    assert cut("  x  ") == ["x"] and cut("1. 2. Both. 123. alone") == ["1. 2. Both.", "123.", "alone"]
    forms = [(("edema",), "edema"), (("mass",), "mass")]
    assert parsing.pick_evidence("Edema seen. No edema now.", {"edema": "ABSENT", "mass": "PRESENT"}, forms) == [("edema", 12, 25, "ABSENT")]
    assert parsing.pick_evidence("Edema.\nEdema.", {"edema": "ABSENT"}, forms) == [("edema", 0, 6, "PRESENT")]
    assert parsing.wanted_polarity([("a", "UNCERTAIN")], ["b"]) == {"a": "UNCERTAIN", "b": "ABSENT"}
    assert parsing.best_sentence("a b. c d a. a d.", ["a", "d"]) == (5, 11) and parsing.best_sentence("x.", ["a"]) is None


def test_parsing_over_columns(spark):
    df = spark.createDataFrame([(1, "No edema. Mass."), (2, None), (3, "")], "k int, t string")
    forms = [(("edema",), "edema"), (("mass",), "mass")]
    assert {tuple(r) for r in parsing.parse_column(df, "k", "t", forms).collect()} == {(1, "edema", "ABSENT", 1), (1, "mass", "PRESENT", 2)}
    got = parsing.evidence_column(df, "k", "t", {"edema": "ABSENT"}, forms).collect()
    assert [tuple(r) for r in got] == [(1, "edema", 0, 9, "No edema.", "ABSENT")]


def test_contracts_sources_and_cache(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n\n1,"two\nlines",3\n2,  ,4\n')
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text"]).collect()] == [("1", "two\nlines"), ("2", None)]
    with pytest.raises(KeyError):
        io.read_csv(spark, str(tmp_path / "a.csv"), ["nope"])
    (tmp_path / "l.jsonl").write_text('{"path": "p", "Edema": 1.0}\n')
    assert {(r.concept, r.raw) for r in io.read_label_lines(spark, str(tmp_path / "l.jsonl"), "path", ["Edema", "Fracture"]).collect()} == {("Edema", "1.0"), ("Fracture", None)}
    (tmp_path / "MRFILES").write_text("NAMES|x|CUI,STR|2|1|9\n")
    (tmp_path / "NAMES").write_text("C1|one|\n")
    cat = io.read_catalog(spark, str(tmp_path / "MRFILES"))
    assert [tuple(r) for r in io.read_delimited(spark, str(tmp_path), "NAMES", cat, ["STR"]).collect()] == [("one",)]
    (tmp_path / "NAMES").write_text("C1|one|more|\n")
    with pytest.raises(Exception, match="width"):
        io.read_delimited(spark, str(tmp_path), "NAMES", cat, ["STR"]).collect()
    spec = corpus.TableSpec({"k": "string", "v": "string"}, ("k",), {"v": ("a", "b")})
    good = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    io.write_validated(good, spec, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    bad = spark.createDataFrame([("1", "a"), ("1", "z"), (None, "a")], "k string, v string")
    assert {r.check: r.bad for r in corpus.contract_checks(bad, spec).collect()} == {"key_null": 1, "domain_v": 1, "key_duplicate": 1, "columns": 0}
    with pytest.raises(ValueError):
        corpus.validate(bad, spec)
    log = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", None, 1)], "k string, ans string, seq int")
    assert [tuple(r) for r in io.latest_answers(log, "k", "ans", "seq").collect()] == [("a", "x")]
    new = spark.createDataFrame([("a", "keep", "n1"), ("b", "keep", "n2")], "k string, review string, note string")
    old = spark.createDataFrame([("a", "drop", "mine"), ("z", "keep", "old")], "k string, review string, note string")
    assert {tuple(r) for r in io.upsert_reviews(new, old, ["k"]).collect()} == {("a", "drop", "mine"), ("b", "keep", "n2"), ("z", "keep", "old")}


def test_groups_and_fingerprints(spark):
    rows = spark.createDataFrame([("s", "x/view2_a", 1), ("s", "x/view1_a", 2), ("t", "noview", 3), (None, "x/view1", 4)], "g string, p string, n int")
    assert {(r.g, r.n) for r in corpus.one_per_group(rows, "g", "p").collect()} == {("s", 2), ("t", 3)}
    assert corpus.fingerprint(rows, ["g", "p"]).first() == corpus.fingerprint(rows.repartition(5), ["g", "p"]).first()
    assert corpus.fingerprint(rows, ["g"]).first() != corpus.fingerprint(rows.limit(2), ["g"]).first()
    assert corpus.shard_bounds(5, 2) == [(0, 2), (2, 4), (4, 5)] and corpus.corpus_mode(0.8) == "reduced"


def test_graph_steps_and_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e")], "a string, b string")
    start = spark.createDataFrame([("a", "a")], "seed string, node string")
    assert {(r.node, r.hops) for r in graph.steps(e, start).collect()} == {("b", 1), ("d", 1), ("c", 2), ("e", 3)}
    stop = spark.createDataFrame([("c",)], "node string")
    assert {r.node for r in graph.steps(e, start, 5, stop=stop).collect()} == {"b", "d"}
    assert {r.node: r.path for r in graph.shortest_paths(e, "a", 3).collect()}["e"] == ["a", "b", "c", "e"]
    assert graph.steps(e.limit(0), start).count() == 0


def test_lookup(spark):
    names = spark.createDataFrame([("1", "Lung mass"), ("2", "mass of lung tissue"), ("3", "band")], "cui string, text string")
    q = spark.createDataFrame([("lung mass",), ("bands",), (None,)], "query string")
    got = {(r.query, r.cui): (r.tier, r["rank"]) for r in lookup.ranked_names(q, names).collect()}
    assert got == {("lung mass", "1"): (0, 1), ("lung mass", "2"): (1, 2), ("bands", "3"): (0, 1)}


def test_stream_equals_batch(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i % 3 + 1), 1.0]) for i in range(20)], "id int, v array<double>")
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    w = {"c": [1.0, 0.0]}
    q = score_stream(spark, str(tmp_path / "in"), "id int, v array<double>", str(tmp_path / "out"), str(tmp_path / "cp"), "id", "v", w)
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "c")
    assert got.exceptAll(vectors.score_matrix(v, "id", "v", w)).count() == 0 and got.count() == 20


def test_core_does_not_need_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "tamarack"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tamarack\.llm", p.read_text()), p
    assert dt


def test_queries_over_all_scripts(spark, tmp_path):
    from tamarack.queries import corpus as Q

    texts = ["No effusion. No mass_effect.", "Épanchement pleural, pas de masse", "Không có tràn dịch", "छाया नहीं है।", "انصباب جنبي", "胸水なし。", "   ", None]
    titles = ["Great red kettle", "great RED kettle!", "Très bon café noir", "très bon CAFÉ, noir", "tres bon cafe noir", "素晴らしい やかん", "素晴らしい やかん!", "ấm đun nước", None]
    spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)] + [("s0", texts[0])], "study_id string, findings string").write.parquet(str(tmp_path / "reports.parquet"))
    spark.createDataFrame(list(enumerate(titles)), "doc_id bigint, title string").write.parquet(str(tmp_path / "documents.parquet"))

    def words(t):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd" else " " for c in t.lower())
        return kept.split()

    df, tf = Counter(), Counter()
    for t in texts[:-1]:
        tf.update(words(t))
        df.update(set(words(t)))
    assert {r.term: (r.df, r.tf) for r in Q.inverted_index(spark, str(tmp_path)).collect()} == {w: (df[w], tf[w]) for w in tf}
    norms = {r.doc_id: (r.norm, r.text_key) for r in Q.name_norms(spark, str(tmp_path)).collect()}
    assert norms == {i: (" ".join(words(t)), "".join(words(t))) for i, t in enumerate(titles) if t}
    sets = {t: set(words(t)) for t in titles if t}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]))}
    assert len(want) == 3 and {(r.title, r.other) for r in Q.similar_titles(spark, str(tmp_path)).collect()} == want
