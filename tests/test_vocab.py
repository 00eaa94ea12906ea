import json

import pytest

from tamarack.operators import vocab as V


def entity(tokens, label, at, *relations):
    return {"tokens": tokens, "label": label, "start_ix": at, "relations": [list(r) for r in relations]}


ENTITIES = {
    "1": entity("Small", "Observation::definitely present", 0, ("modify", "3")),
    "2": entity("left", "Anatomy::definitely present", 3, ("modify", "4")),
    "3": entity("effusions", "Observation::definitely present", 1, ("located_at", "4"), ("suggestive_of", "5")),
    "4": entity("lung", "Anatomy::definitely present", 4),
    "5": entity("Edema", "Observation::uncertain", 6),
    "6": entity("round", "Observation::definitely absent", 8, ("modify", "7")),
    "7": entity("trip", "Observation::definitely absent", 9, ("modify", "6")),
    "8": entity("lost", "Observation::definitely absent", 10, ("located_at", "99"), ("located_at", "2")),
}


def test_mentions_of_a_record():
    got = {m[4]: m for m in V.mentions_of(ENTITIES)}
    assert set(got) == {"3", "4", "5", "8"}  # what modifies another is no mention, circles neither
    assert got["3"] == ("Observation", "present", ["small", "effusions"], 1, "3", ["4"], ["5"])
    assert got["4"] == ("Anatomy", None, ["left", "lung"], 1, "4", [], [])
    assert got["5"][1] == "uncertain" and got["8"][5] == ["4"]  # by the head of the phrase it points into
    assert V.mentions_of({}) == []


@pytest.fixture(scope="module")
def mentions(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("notes") / "notes.json"
    path.write_text(json.dumps([{"0": {"text": "Small effusions, left lung.", "entities": ENTITIES}}, {"0": {"text": "other", "entities": {}}}]))
    notes = V.read_annotations(spark, str(path))
    sections = spark.createDataFrame([("s1", "findings", "small EFFUSIONS left lung"), ("s2", "findings", "Small effusions; left lung!"), ("s3", "findings", "none"), ("s4", "findings", None)], "study_id string, section string, text string")
    assert [tuple(r) for r in V.match_shares(sections, notes).collect()] == [("findings", 3, 2)]
    return V.extract_mentions(sections, notes)


def test_extraction_joins_by_text(mentions):
    rows = {(r.study_id, r.entity): r for r in mentions.collect()}
    assert set(rows) == {(s, e) for s in ("s1", "s2") for e in "3458"}
    assert rows["s1", "3"].tokens == ["small", "effusions"] and rows["s2", "3"].located_at == ["4"]


def test_phrase_rules(spark, mentions):
    names = spark.createDataFrame([("small effusion",), ("effusion",), ("lung",)], "name string")
    r = {x.entity: x for x in V.apply_rules(mentions.where("study_id = 's1'"), names, {"Observation": ["lost"], "Anatomy": ["left"]}).collect()}
    assert (r["3"]["head"], r["3"].joined) == ("effusion", "small effusion")
    assert (r["4"].joined, r["4"].dropped_head) == ("lung", False) and r["8"].dropped_head
    bare = {x.entity: x.joined for x in V.apply_rules(mentions, names.limit(0), {}).collect()}
    assert bare["3"] == "effusions" and bare["4"] == "lung"
    three = spark.createDataFrame([("s", "f", "1", "Observation", ["big", "old", "scar"], 2)], "study_id string, section string, entity string, kind string, tokens array<string>, head_index int")
    one = spark.createDataFrame([("old scar",)], "name string")
    assert V.apply_rules(three, one, {}).first().joined == "old scar"
    assert V.apply_rules(three.limit(0), one, {}).count() == 0


def test_pairs_and_concepts(spark, mentions):
    m = V.apply_rules(mentions, spark.createDataFrame([], "name string"), {})
    pairs = V.located_pairs(m)
    assert {(r.study_id, r.obs, r.anat) for r in pairs.collect()} == {(s, o, "lung") for s in ("s1", "s2") for o in ("effusions", "lost")}
    links = spark.createDataFrame([("Observation", "effusions", "C1"), ("Anatomy", "lung", "C2"), ("Observation", "Edema", None)], "kind string, string string, cui string")
    linked = spark.createDataFrame([("effusions", "lung", "C9"), ("effusions", "lung", "C8")], "obs string, anat string, cui string")
    found = V.mention_concepts(m, links, linked)
    assert {(r.study_id, r.entity, r.cui) for r in found.collect()} == {(s, e, c) for s in ("s1", "s2") for e, c in (("3", "C8"), ("4", "C2"))}
    assert {tuple(r) for r in V.related_concepts(found, "located_at", "Anatomy").collect()} == {("s1", "C8", "C2"), ("s2", "C8", "C2")}
    share = {r.string: tuple(r)[1:] for r in V.pair_share(m, linked).collect()}
    assert share["effusions"] == (2, 2, 2) and share["lost"] == (2, 2, 0) and share["edema"] == (2, 0, 0)


def test_silver_status_includes_what_lies_below(spark):
    found = spark.createDataFrame([("s1", "c", "absent"), ("s1", "below", "PRESENT"), ("s2", "c", "uncertain"), ("s2", "c", "absent"), ("s3", "other", "present"), ("s4", "c", None)], "study_id string, cui string, polarity string")
    concepts = spark.createDataFrame([("c", "c"), ("c", "below"), ("c", "below")], "concept string, cui string")
    assert {tuple(r) for r in V.silver_status(found, concepts).collect()} == {("s1", "c", "PRESENT"), ("s2", "c", "UNCERTAIN")}


def test_sections_meet_one_report_each(spark):
    pool = spark.createDataFrame([("s1", "a"), ("s2", "b")], "study_id string, path string")
    reports = spark.createDataFrame([("a", " x ", None), ("b", "", "y"), ("z", "q", "q")], "path string, f string, i string")
    got = {tuple(r) for r in V.pool_sections(pool, reports, "path", {"findings": "f", "impression": "i"}).collect()}
    assert got == {("s1", "findings", "x"), ("s2", "impression", "y")}
    for bad in (reports.union(reports.limit(1)), reports.where("path <> 'a'")):
        with pytest.raises(ValueError):
            V.pool_sections(pool, bad, "path", {"findings": "f"})
