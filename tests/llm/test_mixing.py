import numpy as np
import pytest

from tamarack.llm.mixing import local_shuffle, mix, mixture_checks, mixture_shares, plan_quotas, split_tree, token_counts

SCHEMA = "doc_id bigint, text string, source string, tokens string, copy int"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, n=3000):
    rows = [(i, f"word {i} and some more words here", ["Shop-Web", "shop web", "mail", None, "other"][i % 5], "clash", 1) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "x", "mail", "c", 1), (n, None, "mail", "c", 1), (n + 1, "", "mail", "c", 1), (0, rows[0][1], rows[0][2], "c", 1)], SCHEMA)


def test_quotas():
    there = {"a": (10, 1000), "b": (10, 100)}
    assert plan_quotas(there, {"a": (0.5, 1), "b": (0.4, 3), "gone": (0.1, 2)}) == pytest.approx({"a": 375, "b": 300})
    assert plan_quotas(there, {}) == {} and plan_quotas({}, {"a": (1.0, 1)}) == {}
    with pytest.raises(ValueError):
        plan_quotas(there, {"a": (0.5, 1), "b": (0.5, 1)}, total=500)


def test_tree_is_exact():
    counts = np.array([100, 7, 0, 33])
    dealt = split_tree(counts, 8, np.random.default_rng(1))
    assert (dealt.sum(axis=0) == counts).all() and (dealt >= 0).all() and dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("shop_web", 0.5, 1), ("mail", 0.4, 2), ("letters", 0.1, 3)], TARGETS)
    m = mix(docs(spark), targets, shards=4).cache()
    share = {r.source: r for r in mixture_shares(m, targets).collect()}
    assert share["shop_web"].actual_share == pytest.approx(5 / 9, abs=0.01) and share["mail"].actual_share == pytest.approx(4 / 9, abs=0.01)
    assert share["letters"].actual_share == 0 and share["mail"].most_copies <= 2
    assert m.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert m.select("shard").distinct().count() == 4
    again = mix(docs(spark).repartition(7), targets, shards=4)
    assert again.exceptAll(m).count() == 0
    assert mix(docs(spark).limit(0), targets).count() == 0 and mix(docs(spark), targets.limit(0)).count() == 0


def test_tokens(spark):
    got = {r.doc_id: r.tokens for r in token_counts(spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


def test_shards_are_read_in_the_order_of_their_draws(spark):
    targets = spark.createDataFrame([("shop_web", 0.5, 1), ("mail", 0.4, 2), ("letters", 0.1, 3)], TARGETS)
    m = mix(docs(spark), targets, shards=4).cache()
    rows = [(r.shard, r.draw) for r in local_shuffle(m).collect()]
    assert rows == sorted(rows) and len(rows) == m.count() and {s for s, _ in rows} == {0, 1, 2, 3}
    ids = [r.doc_id for r in local_shuffle(m).where("shard = 0").collect()]
    assert ids != sorted(ids)
    ok = {r.source: tuple(r)[1:] for r in mixture_checks(m, docs(spark), targets).collect()}
    assert ok == {"shop_web": (True,) * 4, "mail": (True,) * 4, "letters": (False, True, True, True)}
    twice = {r.source: r.no_repeats for r in mixture_checks(m.unionByName(m), docs(spark), targets).collect()}
    assert not twice["mail"]
