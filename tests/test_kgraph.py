from tamarack.operators import graph as G
from tamarack.operators import kgraph as B


def test_growth_stops_and_leaves_sides_out(spark):
    core = spark.createDataFrame([("a0", "Anatomy"), ("o0", "Observation")], "cui string, kind string")
    inside = spark.createDataFrame([(c, k) for c in ("a0", "a1", "a2", "aL", "o0", "o1", "o2", "oU", "oS") for k in ("Anatomy", "Observation")], "cui string, kind string")
    findings = spark.createDataFrame([(c,) for c in ("o0", "o1", "o2", "oU", "oS", "oV")], "cui string")
    parts = spark.createDataFrame([("a0", "a1"), ("a1", "a2"), ("a0", "aL")], "parent string, child string")
    is_a = spark.createDataFrame([("o0", "o1"), ("o1", "o2"), ("oU", "o0"), ("oS", "o0"), ("oV", "oS")], "parent string, child string")
    names = spark.createDataFrame([("aL", "Left thing"), ("a1", "thing")], "cui string, name string")
    got = B.grow(core, inside, findings, parts, is_a, names, anatomy_depth=1, down=2, up=1, stop=spark.createDataFrame([("oS",)], "node string"), sides=["left"])
    assert {tuple(r) for r in got.collect()} == {("a0", "Anatomy", True), ("o0", "Observation", True), ("a1", "Anatomy", False), ("o1", "Observation", False), ("o2", "Observation", False), ("oU", "Observation", False)}


def test_edges_of_all_producers(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "cui string")
    rel = spark.createDataFrame([("a", "b", "Y"), ("a", "b", "X"), ("a", "a", "X"), ("a", "zz", "X")], "parent string, child string, source string")
    h = B.hierarchy_edges(rel, nodes, "IS_A")
    assert [(r.src, r.dst, r.source, r.n) for r in h.collect()] == [("b", "a", "X,Y", None)]
    hand = B.hand_edges(spark, [("x", "y")], {"d": ["f", "g", "h"]})
    assert {(r.src, r.rel, r.dst, r.p) for r in hand.collect()} == {("x", "IS_A", "y", None), *((f, "SUGGESTS", "d", 0.3333) for f in "fgh")}
    mapping = {"Edema": {"id": "E", "is_a": "O", "children": ["e1"]}, "Lung Opacity": {"id": "O"}}
    links = spark.createDataFrame([("Observation", "haze", "Z"), ("Observation", "none", None)], "kind string, string string, cui string")
    generic = spark.createDataFrame([("Lung Opacity", "haze"), ("Edema", "none"), ("Edema", "lost")], "label string, string string")
    got, missing = B.label_edges(spark, mapping, {"Edema": "Lung Opacity"}, generic, links)
    assert {(r.src, r.dst) for r in got.collect()} == {("E", "O"), ("e1", "E"), ("Z", "O")} and {r.string for r in missing.collect()} == {"none", "lost"}
    assert B.edge_union([h, hand, got]).columns == list(B.EDGE) and B.edge_union([h, hand]).count() == 5
    core = B.core_set(spark, links.withColumnRenamed("string", "s"), spark.createDataFrame([("P",), (None,)], "cui string"), mapping, ["dev"])
    assert {(r.cui, r.kind) for r in core.collect()} == {(c, "Observation") for c in ("Z", "P", "E", "O", "e1", "dev")}


def test_nodes_devices_and_aliases(spark):
    grown = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("OWN", True)], "cui string, in_core boolean")
    info = spark.createDataFrame([("a", "Name A")], "cui string, name string")
    types = spark.createDataFrame([("a", "T2"), ("a", "T1"), ("a", "T9")], "cui string, type string")
    rows = {r.cui: r for r in B.node_table(grown, info, types, {"Finding": ["T1", "T2"]}, {"Edema": "a"}, {"OWN": "Device"}, spark.createDataFrame([("a", 5)], "cui string, n_pool bigint")).collect()}
    assert (rows["a"].name, rows["a"].labels, rows["a"].sty, rows["a"].label, rows["a"].scorable, rows["a"].n_pool, rows["a"].in_core) == ("Name A", "Finding", "T1,T2,T9", "Edema", True, 5, True)
    assert rows["b"].name == "b" and rows["b"].n_pool == 0 and rows["OWN"].labels == "Device"
    devices = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "cui string")
    texts = spark.createDataFrame([("d1", "A central LINE, old"), ("d2", "centralline")], "cui string, text string")
    assert {(r.cui, r.support) for r in B.device_groups(devices, texts, ["central line"], ["d3"]).collect()} == {("d1", True), ("d2", False), ("d3", True)}
    a = spark.createDataFrame([("x", "Phù Phổi!", "vi", "llm"), ("x", "phù phổi", "vi", "manual"), ("y", "phù phổi", "vi", "llm"), ("y", "--", "vi", "llm"), ("y", "ab", "en", "z")], "cui string, text string, lang string, source string")
    table = B.alias_table(a, ["manual", "llm"])
    assert {(r.cui, r.text, r.norm) for r in table.collect()} == {("x", "phù phổi", "phù phổi"), ("y", "phù phổi", "phù phổi"), ("y", "ab", "ab")}
    assert {(r.cui, r.norm): r.flags for r in B.alias_flags(table, ["ab"]).collect()} == {("x", "phù phổi"): "ambiguous", ("y", "phù phổi"): "ambiguous", ("y", "ab"): "blocked;short"}
    assert {(r.cui, r.text) for r in B.first_alias(a, ["manual", "llm"]).collect()} == {("x", "phù phổi"), ("y", "--")}


def test_routes_shadows_catalog_and_checks(spark):
    nodes = spark.createDataFrame([("s", "Finding", True, True), ("w", "Finding", False, False), ("n", "Finding", False, False), ("d", "Disease", False, True), ("a", "Anatomy", False, False), ("z", "Anatomy,Disease", False, False)], "cui string, labels string, scorable boolean, in_core boolean").selectExpr("*", "cui AS name")
    pairs = lambda *p: spark.createDataFrame(list(p), "seed string, cui string")
    weak = spark.createDataFrame([("k",)], "cui string")
    got = {r.cui: r.route for r in B.routes(nodes, pairs(("w", "s"), ("n", "k")), pairs(("n", "s")), pairs(("d", "s"), ("a", "s")), pairs(("a", "s"), ("d", "s")), weak).collect()}
    assert got == {"s": "direct", "w": "wider", "n": "narrower", "d": "suggests", "a": "typically_at", "z": "none"}
    q = spark.createDataFrame([("s", 0.6, True, True)], "cui string, auroc_lenient double, weak boolean, borderline boolean")
    assert {(r.cui, r.column) for r in B.benchmark_catalog(nodes, q, ["a"]).collect()} == {("s", True), ("d", False), ("a", False)}
    assert B.with_quality(nodes, q).where("weak").count() == 1
    stated = spark.createDataFrame([("q1", "s", False), ("q2", "s", True)], "qid string, cui string, weak boolean")
    assert [r.qid for r in B.weak_disagreements(stated, q).collect()] == ["q1"]
    names = spark.createDataFrame([("L", "edema"), ("s", "edema"), ("s", "other"), ("w", "edema")], "cui string, norm string")
    closure = spark.createDataFrame([("L", "s"), ("L", "w")], "seed string, node string")
    label = spark.createDataFrame([("Edema", "L")], "label string, cui string")
    assert [tuple(r) for r in B.shadowing_forms(names, label, closure, spark.createDataFrame([("s",)], "cui string")).collect()] == [("Edema", "edema", "s")]
    edges = B.as_edges(spark.createDataFrame([("s", "SUGGESTS", "d", None), ("w", "SUGGESTS", "d", "drop"), ("q", "TYPICALLY_AT", "d", "keep")], "src string, rel string, dst string, review string"))
    parts = spark.createDataFrame([("d", "s", 0.2), ("d", "w", 0.9), ("d", "q", 0.5)], "concept string, column string, weight double")
    assert [(r.src, r.place) for r in B.path_edges(parts, edges).orderBy("place").collect()] == [("q", 1), ("s", 2)]
    checks = {r.name: r.ok for r in B.load_checks(nodes, edges, ["s", "lost"], 6).collect()}
    assert checks == {"node count": True, "score columns": False, "edge ends": False, "unique nodes": True}
    assert {r.cui: r.parents for r in B.parents_of(spark.createDataFrame([("w", p) for p in "dcba"], "child string, parent string"), nodes.where("cui IN ('w', 's')")).collect()} == {"w": ["a", "b", "c"], "s": []}
    assert G.missing_ends(edges, nodes).count() == 2


def test_candidates_and_written_graph(spark, tmp_path):
    rows = [("a", "Finding", 9), ("b", "Finding", 8), ("c", "Anatomy", 7), ("d", "Disease", 6), ("e", "Finding", 5), ("f", "Finding", 1), ("g", "Device,Finding", 1), ("h", None, 1)]
    nodes = spark.createDataFrame(rows, "cui string, labels string, n_pool bigint").selectExpr("*", "cui AS name")
    strings = spark.createDataFrame([("a", "a scar", 3), ("b", "normal lung", 1), ("d", "x", 1), ("d", "y", 2), ("e", "z", 1), ("f", "q", 1), ("f", "abnormality", 1)], "cui string, string string, mentions int")
    got = {r.cui: (r.status, r.reason) for r in B.candidate_cascade(nodes, strings, ["e"], ["f"], 2).collect()}
    assert got["a"] == ("candidate", "") and got["f"] == ("candidate", "") and got["d"] == ("excluded", "beyond the first 2")
    assert got["b"][1] == "normal statement" and got["c"][1] == got["g"][1] == got["h"][1] == "anatomy or device" and got["e"][1] == "generic"
    caps = {r.cui: r.captions for r in B.candidate_cascade(nodes, strings, [], [], 2).collect()}
    assert caps["d"] == ["y", "x"] and caps["h"] == []
    edges = B.as_edges(spark.createDataFrame([("a", "IS_A", "b"), ("a", "SUGGESTS", "d")], "src string, rel string, dst string"))
    B.write_graph(nodes, edges, spark.createDataFrame([("a", "x")], "cui string, text string"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/edges").where("rel = 'IS_A'").count() == 1
    assert {(r.what, r.name, r.n) for r in B.graph_counts(nodes, edges).collect()} >= {("node", "Finding", 5), ("edge", "IS_A", 1)}
