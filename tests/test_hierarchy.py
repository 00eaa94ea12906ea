from tamarack.operators.hierarchy import descendants, hierarchy_links, resolve_hierarchy, unfollowed_links

EDGES = "src string, rel string, dst string, review string, root string, depth int"


def edges(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 1) if len(r) == 3 else (*r, "clash", 1) for r in rows], EDGES)


def c(n):
    return f"C{n:08d}"


def found(df):
    return {(r.rel, r.cui): (r.root, r.depth) for r in df.collect()}


def test_spellings_reversals_and_dropped_rows(spark):
    links = hierarchy_links(
        edges(
            spark,
            [
                (" cui:C00000002 ", "is a", c(1)),
                (c(2), "IS_A", c(1)),
                (c(2), "inverse_isa", c(3)),
                (c(5), "Part-Of", c(4)),
                (c(4), "HAS_PART", c(6)),
                (c(7), "SUGGESTS", c(1)),
                (None, "IS_A", c(1)),
                ("", "IS_A", c(1)),
                (c(8), None, c(1)),
                (c(9), "IS_A", c(1), "drop"),
                (c(9), "IS_A", c(2), "keep"),
            ],
        )
    )
    got = {tuple(r) for r in links.collect()}
    assert got == {("IS_A", c(2), c(1)), ("IS_A", c(3), c(2)), ("PART_OF", c(5), c(4)), ("PART_OF", c(6), c(4)), ("IS_A", c(9), c(2))}


def test_chain_circle_and_loop(spark):
    chain = [(c(i + 1), "IS_A", c(i)) for i in range(1, 21)]
    circle = [(c(101), "IS_A", c(102)), (c(102), "IS_A", c(103)), (c(103), "IS_A", c(101)), (c(104), "IS_A", c(101)), (c(105), "IS_A", c(104)), (c(106), "IS_A", c(106))]
    r = resolve_hierarchy(hierarchy_links(edges(spark, chain + circle)))
    got = found(r)
    for i in range(1, 22):
        assert got["IS_A", c(i)] == (c(1), i - 1)
    for i in range(101, 107):
        assert got["IS_A", c(i)] == ("CYCLE", -1)
    paths = {x.cui: x.path for x in r.collect()}
    assert paths[c(4)] == [c(1), c(2), c(3), c(4)] and paths[c(105)] is None
    below = {(x.cui, x.descendant, x.distance) for x in descendants(r).collect()}
    assert (c(1), c(21), 20) in below and len(below) == 20 * 21 // 2


def test_hot_parent_and_empty(spark):
    star = [(c(i), "IS_A", c(1)) for i in range(2, 500)] + [(c(1), "IS_A", c(900)), (c(900), "IS_A", c(901))]
    got = found(resolve_hierarchy(hierarchy_links(edges(spark, star)), paths=False))
    assert got["IS_A", c(3)] == (c(901), 3) and len(got) == 501
    assert resolve_hierarchy(hierarchy_links(edges(spark, [])), paths=False).count() == 0


def test_salted_lookup_splits_hot_keys(spark):
    from pyspark.sql import functions as F

    from tamarack.session import salted_lookup

    rows = spark.range(60_000).select("id", F.when(F.col("id") < 50_000, 7).otherwise(F.col("id")).alias("k"))
    look = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = salted_lookup(rows, look, "k")
    assert out.count() == 60_000 and out.where("v IS NULL OR v <> k * 2").count() == 0


def test_long_codes_stay_whole_and_other_parents_are_told(spark):
    long = [("C123456781", "IS_A", c(1)), ("C123456782", "IS_A", c(2)), ("c12", "IS_A", c(1))]
    got = found(resolve_hierarchy(hierarchy_links(edges(spark, long)), paths=False))
    assert got["IS_A", "C123456781"] == (c(1), 1) and got["IS_A", "C123456782"] == (c(2), 1) and got["IS_A", c(12)] == (c(1), 1)
    two = hierarchy_links(edges(spark, [(c(3), "IS_A", c(1)), (c(3), "IS_A", c(2)), (c(3), "PART_OF", c(2))]))
    assert {tuple(r) for r in unfollowed_links(two).collect()} == {("IS_A", c(3), c(2), c(1))}
