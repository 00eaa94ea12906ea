import datetime as dt

import numpy as np
import pytest

from tamarack.llm.consensus import CLASSES, asserted, chance_corrected, dawid_skene

SCHEMA = "study_id string, concept string, status string, source string, asserted_at timestamp, s string, votes int"
T = dt.datetime(2024, 1, 1)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_newest_assertion_counts(spark):
    d = dt.timedelta(days=1)
    rows = [
        ("s", "c", "1", "a", T),
        ("s", "c", " absent ", "a", T + d),
        ("s", "c", None, "a", T + 2 * d),
        ("s", "c", "-1.0", "b", None),
        ("s", "c", "PRESENT", "d", T),
        ("s", "c", "UNCERTAIN", "d", T),
        ("s", "c", "maybe", "e", T),
        (None, "c", "1", "e", T),
        ("s", "c", "0", "f", T),
        ("s", "c", "0", "f", T),
    ]
    got = {(r.source, r.status) for r in asserted(labels(spark, rows)).collect()}
    assert got == {("a", "ABSENT"), ("b", "UNCERTAIN"), ("d", "UNCERTAIN"), ("f", "ABSENT")}


def test_recovers_truth_better_than_majority(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 3, 1500)
    good = {"r1": 0.97, "r2": 0.6}
    rows = []
    for i, t in enumerate(truth):
        for s, p in good.items():
            rows.append((f"s{i}", "c", CLASSES[t if rng.random() < p else rng.integers(0, 3)], s, T))
        for s in ("r3", "r4"):  # two that nearly always say PRESENT
            rows.append((f"s{i}", "c", "PRESENT" if rng.random() < 0.85 else CLASSES[t], s, T))
    items, sources = dawid_skene(asserted(labels(spark, rows)))
    out = {r.study_id: r for r in items.collect()}
    right = np.mean([out[f"s{i}"].status == CLASSES[t] for i, t in enumerate(truth)])
    acc = {r.source: r for r in sources.collect()}
    assert right > 0.93
    assert acc["r1"].accuracy > 0.93 > acc["r2"].accuracy > acc["r3"].accuracy and acc["r3"].informedness < 0.4
    assert all(0 <= r.agreement <= 1 for r in out.values()) and all(r.n_sources == 4 for r in out.values())
    again = dawid_skene(asserted(labels(spark, rows[::-1])))[0]
    assert {r.study_id: r.status for r in again.collect()} == {k: v.status for k, v in out.items()}


def test_alpha_and_edges(spark):
    rows = [("s1", "c", "1", "a", T), ("s1", "c", "1", "b", T), ("s2", "c", "0", "a", T), ("s2", "c", "0", "b", T), ("s3", "c", "1", "a", T), ("s3", "c", "0", "b", T), ("s4", "c", "1", "a", T)]
    r = chance_corrected(asserted(labels(spark, rows))).first()
    # 6 labels: 3 PRESENT, 3 ABSENT; observed 1/3, expected 1 - 12/30
    assert (r.items, r.labels) == (3, 6) and r.observed == pytest.approx(1 / 3, abs=1e-6) and r.expected == pytest.approx(0.6) and r.alpha == pytest.approx(1 - (1 / 3) / 0.6, abs=1e-6)
    items, sources = dawid_skene(asserted(labels(spark, [])))
    assert items.count() == 0 and sources.count() == 0
    one = dawid_skene(asserted(labels(spark, rows[:1])))[0].first()
    assert one.status == "PRESENT" and one.agreement is None
