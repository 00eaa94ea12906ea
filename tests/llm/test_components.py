import random

from tamarack.llm.components import assign_splits, grouped_images, hash_to_min, rendezvous, split_shares

SCHEMA = "image_id string, study_id string, patient_id string, image_checksum string, root string, key int"
H = "ab" * 32


def images(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def groups(df):
    return {r.image_id: r.group_image_id for r in df.collect()}


def test_links_and_fillers(spark):
    rows = [
        ("i1", "patient01/study1", "patient01", None),
        ("i2", "Patient01\\study1 ", None, "N/A"),
        ("i3", None, "PATIENT01", "0" * 64),
        ("i4", "patient02/study1", " ", H),
        ("i5", None, None, H.upper()),
        ("i6", None, "", "pending"),
        ("i7", None, None, "0" * 64),
        ("i7", None, None, "0" * 64),
        ("i8", "patient03//study2", "", "N/A"),
        ("i9", "patient03/study9", None, ""),
        (None, "patient03/study9", None, ""),
    ]
    got = groups(grouped_images(images(spark, rows)))
    assert got == {"i1": "i1", "i2": "i1", "i3": "i1", "i4": "i4", "i5": "i4", "i6": "i6", "i7": "i7", "i8": "i8", "i9": "i8"}
    assert grouped_images(images(spark, [])).count() == 0


def test_hash_to_min_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs + [(None, 1)], "a bigint, b bigint")
    got = {r.node: r.root for r in hash_to_min(df, "a", "b").collect()}
    assert got == {x: find(x) for x in {y for p in pairs for y in p}}


def test_splits_keep_groups_and_shares(spark):
    rows = [(f"i{n:05d}", f"patient{n // 2}/study1", None, None) for n in range(4000)]
    out = assign_splits(images(spark, rows))
    assert out.groupBy("group_image_id").agg({"split": "max", "image_id": "count"}).count() == 2000
    assert out.select("group_image_id", "split").distinct().count() == 2000
    share = {r.split: r.group_share for r in split_shares(out).collect()}
    assert abs(share["train"] - 0.8) < 0.04 and abs(share["test"] - 0.1) < 0.03
    more = {"train": 0.8, "validation": 0.1, "test": 0.2}
    moved = out.withColumn("again", rendezvous("group_image_id", more, 20)).where("again <> split")
    assert moved.where("again <> 'test'").count() == 0 and moved.count() > 0
