from tamarack.operators import linking as K

KINDS = [("Observation", "T1"), ("Anatomy", "T2")]


def names(spark):
    rows = [("A", "Lung Mass", "X", True), ("A", "mass of lung", "Y", False), ("B", "lung mass", "X", False), ("B", "odd", "CODE", True), ("C", "left lung", "X", True), ("D", "lung", "X", True), ("E", "coded", "CODE", True), ("F", "tall organ", "X", True), ("G", "organ", "X", True)]
    return spark.createDataFrame(rows, "cui string, text string, source string, preferred boolean")


def types(spark):
    return spark.createDataFrame([("A", "T1"), ("B", "T1"), ("C", "T2"), ("D", "T2"), ("E", "T1"), ("F", "T2"), ("G", "T2"), ("Z", "T9")], "cui string, type string")


def kinds(spark):
    return spark.createDataFrame(KINDS, "kind string, type string")


def test_domain(spark):
    rel = spark.createDataFrame([("F", "G"), ("G", "D"), ("D", "F")], "parent string, child string")
    roots = spark.createDataFrame([("Anatomy", "G", "-"), ("Anatomy", "D", "+")], "kind string, cui string, sign string")
    got = K.domain(types(spark), kinds(spark), names(spark), ["CODE"], rel.where("parent <> 'D'"), roots)
    assert {tuple(r) for r in got.collect()} == {("Observation", "A"), ("Observation", "B"), ("Anatomy", "C"), ("Anatomy", "D"), ("Anatomy", "F")}
    sizes = {r.kind: (r.label_table, r.domain) for r in K.domain_sizes(types(spark), kinds(spark), got).collect()}
    assert sizes == {"Observation": (3, 2), "Anatomy": (4, 3)}


def test_exact_and_preferred_names(spark):
    inside = spark.createDataFrame([("Observation", "A"), ("Observation", "B")], "kind string, cui string")
    q = spark.createDataFrame([("Observation", "lung mass"), ("Observation", "nothing"), ("Observation", "left lung")], "kind string, query string")
    got = K.exact_matches(q, names(spark), inside).orderBy("rank").collect()
    assert [(r.cui, r["rank"], r.n_candidates) for r in got] == [("A", 1, 2), ("B", 2, 2)]
    assert K.outside(q, names(spark), types(spark).where("cui <> 'C'"), kinds(spark)).collect()[0].query == "left lung"
    told = {r.cui: (r.name, r.sources, r.types) for r in K.describe(names(spark), types(spark), ["X"]).collect()}
    assert told["A"] == ("Lung Mass", "X,Y", "T1") and told["B"] == ("odd", "CODE,X", "T1")


def test_sides_move_to_the_parent(spark):
    links = spark.createDataFrame([("Anatomy", "left lung", "C", "left lung"), ("Anatomy", "lung", "D", "lung"), ("Anatomy", "none", None, None), ("Anatomy", "left organ", "L", "left organ")], "kind string, string string, cui string, matched string")
    info = spark.createDataFrame([("C", "Left lung"), ("D", "Lung"), ("L", "Left organ"), ("G", "organ"), ("F", "tall organ")], "cui string, name string")
    parents = spark.createDataFrame([("C", "D"), ("L", "G"), ("L", "F"), ("L", "Q")], "cui string, parent string")
    inside = spark.createDataFrame([("Anatomy", c) for c in "DGF"], "kind string, cui string")
    got = {r.string: (r.cui, r.lateral_from, r.lateral_unresolved) for r in K.unlateralise(links, info, parents, inside, ["left", "right"]).collect()}
    assert got == {"left lung": ("D", "C", False), "lung": ("D", None, False), "none": (None, None, False), "left organ": ("G", "L", False)}
    lost = K.unlateralise(links, info, parents, inside.where("cui = 'Z'"), ["left"]).where("string = 'left lung'").first()
    assert lost.cui == "C" and lost.lateral_unresolved


def test_pairs_choices_and_review(spark):
    pairs = spark.createDataFrame([("mass", "lung", 5), ("scar", "rib", 3)], "obs string, anat string, n bigint")
    exact = spark.createDataFrame([("Observation", "lung mass", "A", 1, 2), ("Observation", "mass lung", "B", 1, 1)], "kind string, query string, cui string, rank int, n_candidates bigint")
    linked = K.pair_links(pairs, exact)
    assert {(r.obs, r.phrase, r.cui, r.n_candidates) for r in linked.collect()} == {("mass", "lung mass", "A", 2), ("scar", None, None, 0)}
    heads = spark.createDataFrame([("old",)], "string string")
    assert [r.string for r in K.descriptive_pairs(linked, ["scar", "mass"], heads).collect()] == ["scar rib"]
    hand = spark.createDataFrame([("scar", "rib", "H"), ("mass", "lung", None)], "obs string, anat string, cui string")
    assert {(r.obs, r.cui) for r in K.override(linked, hand, ["obs", "anat"]).collect()} == {("mass", None), ("scar", "H")}
    cands = spark.createDataFrame([("Observation", "m", "A", 1)], "kind string, string string, cui string, rank int")
    said = lambda *rows: spark.createDataFrame(list(rows), "kind string, string string, decision string, cui string")
    a = K.checked_choices(said(("Observation", "m", "cui", "A"), ("Observation", "n", "cui", "Z"), ("Observation", "o", "none", None)), cands)
    assert {(r.string, r.decision, r.cui) for r in a.collect()} == {("m", "cui", "A"), ("n", "rejected", None), ("o", "none", None)}
    b = said(("Observation", "m", "cui", "A"), ("Observation", "n", "rejected", None), ("Observation", "o", "cui", "B"), ("Observation", "p", "cui", "B"))
    got = {r.string: (r.via, r.agree, r.cui) for r in K.agreed_choices(a, b, said(("Observation", "o", "cui", "B"))).collect()}
    assert got == {"m": ("llm", True, "A"), "n": (None, False, None), "o": ("adjudicated", False, "B"), "p": (None, None, None)}
    rows = spark.createDataFrame([("Observation", "a", 5, "llm", ""), ("Observation", "b", 9, "llm", ""), ("Observation", "c", 1, "llm", "x"), ("Anatomy", "d", 1, "llm_disagree", "")], "kind string, string string, mentions int, method string, flags string")
    assert [r.string for r in rows.orderBy(*K.review_order(rows)).collect()] == ["d", "c", "b", "a"]


def test_grades_and_gate(spark):
    sample = spark.createDataFrame([("Observation", "m", "A", "A"), ("Observation", "n", "A", "B")], "kind string, string string, link_cui string, argmax_cui string")
    items = K.judge_items(sample)
    assert {(r.string, r.which, r.cui) for r in items.collect()} == {("m", "link", "A"), ("n", "link", "A"), ("n", "argmax", "B")}
    grades = spark.createDataFrame([("Observation", "m", "link", "correct"), ("Observation", "n", "link", "incorrect")], "kind string, string string, which string, grade string")
    graded = K.apply_grades(items, grades)
    assert graded.where("grade IS NULL").count() == 1
    p = K.precision(graded.withColumn("mentions", graded.kind.isNotNull().cast("int") * 3), "grade")
    r = p.first()
    assert (r.correct, r.graded, r.unsure, r.precision) == (1, 2, 0, 0.5) and r.low < 0.5 < r.high
    assert not K.link_gate(p, 0.95, 0.9, 0.9).first().passed and K.link_gate(p, 0.95, 0.5, 0.9).first().passed
    bad = K.adjudication_problems(spark.createDataFrame([("Observation", "x", "A"), ("Observation", "y", "D"), ("Observation", "z", "NO"), ("Observation", "w", "B"), ("Observation", "v", None)], "kind string, string string, cui string"), names(spark), types(spark), kinds(spark), spark.createDataFrame([("Observation", "A")], "kind string, cui string"))
    assert {(r.string, r.problem) for r in bad.collect()} == {("y", "wrong type"), ("z", "unknown"), ("w", "outside domain")}
    text = K.selection_inputs(spark.createDataFrame([("Observation", "m", 4)], "kind string, string string, mentions int"), spark.createDataFrame([("Observation", "m", "A", 2), ("Observation", "m", "B", 1)], "kind string, string string, cui string, rank int"), K.describe(names(spark), types(spark), ["X"]), spark.createDataFrame([("Observation", "m", "lung", 3, 1)], "side string, string string, other string, n int, place int")).first().input
    assert text == '{"string":"m","kind":"Observation","mentions":4,"partners":[{"string":"lung","n":3}],"candidates":[{"cui":"B","name":"odd","types":"T1"},{"cui":"A","name":"Lung Mass","types":"T1"}]}'
