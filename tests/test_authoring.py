import pytest
from pyspark.sql import functions as F

from tamarack.operators import authoring as W
from tamarack.operators import labels as L


def test_questions(spark):
    rows = [("1", "Any edema?", "en", "p1", ["E"]), ("2", "Có phù không?", "vi", "p1", ["E"]), ("3", "any EDEMA", "en", None, ["E"]), ("4", " ", "en", None, []), ("5", "Có phù", "en", "p2", ["E", "ZZ"]), ("6", "Old one", "vi", None, ["E"])]
    q = spark.createDataFrame(rows, "id string, question string, lang string, pair string, cuis array<string>")
    got = {}
    for r in W.question_problems(q, spark.createDataFrame([("E",)], "cui string"), spark.createDataFrame([("old one!",)], "question string")).collect():
        got.setdefault(r.id, set()).add(r.problem)
    assert got == {"1": {"repeated"}, "3": {"repeated"}, "4": {"blank", "no concept"}, "5": {"unknown concept", "wrong language", "incomplete pair"}, "6": {"used before"}}
    ids = W.assign_ids(spark.createDataFrame([("g", "en", "b", "k"), ("g", "vi", "c", "k"), ("g", "en", "a", None)], "group string, lang string, question string, pair_key string"), 5)
    assert {(r.question, r.id, r.pair) for r in ids.collect()} == {("b", "g-en-005", "g-vi-005"), ("c", "g-vi-005", "g-en-005"), ("a", "g-en-006", None)}
    assert W.extension_quotas({"a": {"en": 3, "vi": 1}, "b": {}}, 5) == {"a": {"en": 1, "vi": 2}, "b": {"en": 1, "vi": 1}}


def test_mappings_and_overrides(spark):
    m = {"Edema": {"id": "C1", "is_a": "C1"}, "Mass": {"id": "C1"}, "Own": {"id": "PRJ:x"}, "Odd": {"id": ""}}
    assert W.mapping_problems(m, ["Edema", "Mass", "Own", "Gone"]) == ["Gone: not mapped", "Odd: unknown label", "Edema: its own ancestor", "Mass: same id as Edema", "Own: own id without parent or children", "Odd: no id"]
    o = spark.createDataFrame([("Observation", "a", "C1234567"), ("Observation", "b", "x"), ("Nope", "c", None), ("Observation", "d", None), ("Observation", "d", None)], "kind string, string string, cui string")
    assert {tuple(r) for r in W.override_problems(o, ["Observation"]).collect()} == {("b", "ill-formed concept"), ("c", "unknown kind"), ("d", "repeated")}


def test_verdicts_and_definitions(spark):
    a = spark.createDataFrame([(1, ["x", "y"], {"x": "keep", "y": "drop"}), (2, ["x", "y"], {"x": "keep"}), (3, ["x"], {"x": "keep", "z": "keep"})], "key int, asked array<string>, verdicts map<string, string>")
    assert [r.complete for r in W.complete_verdicts(a).orderBy("key").collect()] == [True, False, False]
    items = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 3)], "batch string, key int")
    assert [r.batch for r in W.complete_batches(items, spark.createDataFrame([(1,), (3,)], "key int")).collect()] == ["b2"]
    v = spark.createDataFrame([(True, ""), (True, "short"), (None, "")], "a boolean, f string")
    assert [r[0] for r in v.select(W.accepted_alias(F.col("a"), F.col("f"))).collect()] == ["keep", "wait", "wait"]
    g = spark.createDataFrame([("fluid in the lung", ["there is fluid in the lung now"]), ("", []), ("a cancer of many many words", None)], "g string, s array<string>")
    assert [r[0] for r in g.select(W.gloss_flags(F.col("g"), F.col("s"), ["cancer"], 5, 4)).collect()] == ["copied", "blank", "long;barred"]
    d = spark.createDataFrame([("a", "x", True, "", None), ("b", "x", True, "long", None), ("c", "x", False, "long", "accept"), ("d", "x", True, "", "reject")], "cui string, gloss string, agreed boolean, flags string, decision string")
    aliases = spark.createDataFrame([("a", "phù", "phù", "vi", "m"), ("a", "phù phổi", "phù phổi", "vi", "m"), ("a", "phù phổi cấp tính", "phù phổi cấp tính", "vi", "term"), ("c", "edema", "edema", "en", "m")], "cui string, text string, norm string, lang string, source string")
    nodes = spark.createDataFrame([("a", "A", "Finding", True), ("c", "C", "Anatomy", True)], "cui string, name string, labels string, in_core boolean")
    assert {(r.cui, r.local) for r in W.knowledge_table(d, aliases, nodes, "vi", "term").collect()} == {("a", "phù phổi"), ("c", None)}
    assert [r.cui for r in W.review_rows(d.drop("decision"), d.select("cui", "decision"), ["cui"]).collect()] == ["c", "a", "b", "d"]
    assert {r.norm: r.cuis for r in W.grounding_names(aliases, nodes, ["phù"]).collect()} == {"phù phổi": ["a"], "phù phổi cấp tính": ["a"]}
    assert {(r.bare, r.norm) for r in W.unaccented_names(aliases, spark.createDataFrame([("phu phoi cap tinh",)], "norm string")).collect()} == {("phu phoi", "phù phổi")}
    text = W.definition_inputs(spark.createDataFrame([("a",)], "cui string"), aliases, spark.createDataFrame([("a", "long text", "B"), ("a", "text", "B"), ("a", "first", "A")], "cui string, text string, source string"), 1, ["A"], 2).first().input
    assert text == '{"cui":"a","names":[{"lang":"vi","text":"phù"}],"definitions":["first","text"]}'
    near = spark.createDataFrame([("q", "a", "x", 0.9), ("q", "a", "y", 0.95), ("q", "b", "z", 0.92), ("q", "c", "w", 0.1)], "query string, cui string, text string, score double")
    assert [(r.cui, r.text, r["rank"]) for r in W.alias_search(near, 2).orderBy("rank").collect()] == [("a", "y", 1), ("b", "z", 2)]
    assert spark.range(1).select(W.facts_json(F.lit("q"), F.array(F.lit(1)), F.array(F.lit("k")))).first()[0] == '{"question":"q","results":[1],"knowledge":["k"]}'


def test_single_studies_orders_and_windows(spark):
    m = spark.createDataFrame([(f"s{i}", "PRESENT" if i % 2 else "ABSENT") for i in range(20)], "study_id string, edema string")
    assert L.satisfies(m, "s1", [("Edema", "PRESENT")], []) and not L.satisfies(m, "s2", [("Edema", "PRESENT")], []) and not L.satisfies(m, "nope", [("Edema", "PRESENT")], [])
    all_ = [r.study_id for r in L.ordered_matches(m, F.lit(True), 1).collect()]
    some = [r.study_id for r in L.ordered_matches(m, F.col("edema") == "PRESENT", 1).collect()]
    assert some == [s for s in all_ if int(s[1:]) % 2] and some != sorted(some)
    manifest = spark.createDataFrame([("s1", "x", 0), ("s2", "x", 1), ("s3", "x", 2)], "study_id string, stratum string, rank_in_manifest bigint")
    images = spark.createDataFrame([("s1", "i1", "train"), ("s2", "i2", "train"), ("s3", "i3", "valid")], "study_id string, image_id string, dataset_split string")
    assert {r.image_id for r in L.sample_window(manifest, images, 0, 2).collect()} == {"i1", "i2"}
    with pytest.raises(ValueError):
        L.sample_window(manifest, images, 1, 2)
