import numpy as np
import pytest

from tamarack.llm.neighbours import nearest_neighbours, neighbour_pairs, rotate

SCHEMA = "image_id string, vec array<float>, cos string, members string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA)


def brute(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(s[a, b], 6), ids[b]))[:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order}
    return out


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(rotate(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)


@pytest.mark.parametrize("leaf", [40, 1000])
def test_recall_against_brute_force(spark, leaf):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 64)) * rng.uniform(0.1, 0.7, (600, 1))
    rows = [(f"i{n:04d}", v.astype(np.float32).tolist()) for n, v in enumerate(x)]
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(frame(spark, rows), leaf=leaf)).collect()}
    want = brute(rows, 10)
    assert len(got & want) / len(want) >= 0.9
    assert len(got) <= 6_000


def test_unusable_vectors_copies_and_repeats(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(f"c{n:03d}", (base * (1 + n)).astype(np.float32).tolist()) for n in range(30)]  # one direction, 30 lengths
    rows += [("far1", rng.normal(size=64).tolist()), ("far1", rng.normal(size=64).tolist()), (None, base.tolist())]
    rows += [("short", [1.0] * 5), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("none", None), ("hole", [None] + [1.0] * 63)]
    near = nearest_neighbours(frame(spark, rows), k=3)
    by = {}
    for r in near.orderBy("image_id", "place").collect():
        by.setdefault(r.image_id, []).append(r.neighbour)
    assert set(by) == {f"c{n:03d}" for n in range(30)} | {"far1"}
    assert by["c000"] == ["c001", "c002", "c003"] and by["c001"] == ["c000", "c002", "c003"] and by["c029"] == ["c000", "c001", "c002"]
    assert len(by["far1"]) == 3


def test_hot_leaf_is_spread_and_stays_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    x = base + rng.normal(size=(300, 64)) * 0.05  # nearly all in one leaf of every table, beyond its size
    rows = [(f"h{n:03d}", v.tolist()) for n, v in enumerate(x)]
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(frame(spark, rows), leaf=20)).collect()}
    want = brute([(i, np.float32(v)) for i, v in rows], 10)
    assert len(got & want) / len(want) >= 0.95


def test_few_and_none(spark):
    one = frame(spark, [("a", [1.0] * 64)])
    assert nearest_neighbours(one).count() == 0
    assert nearest_neighbours(frame(spark, [])).count() == 0
    two = frame(spark, [("a", [1.0] * 64), ("b", [1.0] * 63 + [2.0])])
    assert {tuple(r) for r in neighbour_pairs(nearest_neighbours(two)).collect()} == {("a", "b")}
