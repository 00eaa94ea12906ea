import random

from tamarack.llm.top_items import best_of_chain, row_groups, top_items, write_clustered

SCHEMA = "request_id bigint, column_name string, study_id string, score double, grp string, place int"


def hits(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


def brute(rows, n):
    best = {}
    for g, c, s, x in rows:
        if s is not None and x is not None and x == x and abs(x) != float("inf"):
            key = (g, c)
            best.setdefault(key, {})
            best[key][s] = max(x, best[key].get(s, x))
    return {(g, c, s) for (g, c), d in best.items() for s, _ in sorted(d.items(), key=lambda p: (-p[1], p[0]))[:n]}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), f"s{rng.randrange(40)}", rng.choice([rng.random(), 0.5, 0.5, None, float("nan"), float("inf"), -float("inf")])) for _ in range(3000)]
    rows += [(7, "hot", f"s{rng.randrange(2000):04d}", round(rng.random(), 3)) for _ in range(9000)]
    rows += [(8, "a", None, 1.0), (9, "a", "x", None)]
    rows += rows[:50]
    got = top_items(hits(spark, rows), ["request_id", "column_name"], "study_id", "score", 10, row_group_bytes=16 << 10)
    assert {(r.request_id, r.column_name, r.study_id) for r in got.collect()} == brute(rows, 10)
    assert got.count() == len(brute(rows, 10))
    assert top_items(hits(spark, []), ["request_id", "column_name"], "study_id", "score", 10).count() == 0


def test_hot_group_has_a_chain_of_row_groups(spark):
    rng = random.Random(2)
    rows = [(7, "hot", f"s{rng.randrange(10**9)}", rng.random()) for _ in range(60_000)]
    path = write_clustered(hits(spark, rows), ["request_id", "column_name"], "study_id", "score", row_group_bytes=64 << 10)
    chains = row_groups(spark, path).groupBy("chain").count().collect()
    assert max(c["count"] for c in chains) >= 3
    hot = [(r.highest, r.file, r.rg) for r in row_groups(spark, path).collect() if r.chain.startswith("g")]
    kept, read = best_of_chain(hot, 10, single=True)
    assert read == 1 < len(hot) and set(kept["item"]) == {s for _, _, s in brute(rows, 10)}


def test_ties_in_the_order_of_the_items_type(spark):
    df = spark.createDataFrame([(1, i, 1.0) for i in (9, 10, 100, 2)], "g int, item bigint, score double")
    assert [(r["item"], r.place) for r in top_items(df, ["g"], "item", "score", 3).orderBy("place").collect()] == [(2, 1), (9, 2), (10, 3)]
    days = df.selectExpr("g", "date_add(DATE'2024-01-01', CAST(item AS INT)) AS item", "score")
    assert [str(r["item"]) for r in top_items(days, ["g"], "item", "score", 2).orderBy("place").collect()] == ["2024-01-03", "2024-01-10"]
