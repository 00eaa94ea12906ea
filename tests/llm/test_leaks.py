import random

from tamarack.llm.leaks import Passages, find_leaks, find_runs, leak_report, without_leaks, words_of

P = "During the long storm the beekeeper counted the amber kettle under the glass roof because page 5891 was missing. While the oven ticked one engineer unfolded the whisk across the orchard until bell 4584 rang!"
W = P.split()


def test_words():
    assert words_of("Straße <b>Über</b> cus-\n> hion ＡＢ đá")[0] == ["strasse", "uber", "cushion", "ab", "da"]


def leak(text, words=15):
    return [x[0] for x in Passages([(1, P)], words).leaks(text)]


def test_runs():
    assert leak("x y " + " ".join(W[3:20]) + " z") == [1]
    assert leak(" ".join(W[3:17])) == []
    assert leak("<p>" + "\n> ".join(W[0:16]).upper() + "</p>") == [1]
    two = W[0:15]
    two[5], two[10] = "beekeper", "really"
    assert leak(" ".join(two)) == [1]
    three = list(two)
    three[1] = "teh"
    assert leak(" ".join(three)) == []
    inserted = W[2:9] + "as it says on the sheet".split() + W[9:20]
    assert leak(" ".join(inserted)) == [1]
    assert leak("") == [] and leak(None) == [] and leak("word " * 5000) == []


def test_against_brute_force():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    passages = [(k, " ".join(rng.choice(vocab) for _ in range(30))) for k in range(3)]
    test = Passages(passages, 15)
    for _ in range(150):
        k, p = rng.choice(passages)
        w = p.split()
        a, n = rng.randrange(0, 16), rng.randrange(12, 20)
        piece = w[a : a + n]
        for _ in range(rng.randrange(0, 4)):
            piece[rng.randrange(len(piece))] = "zz"
        doc = ["q"] * 5 + piece + ["q"] * 5
        want = any(
            sum(w[i + o] != doc[j + o] for o in range(m)) * 6 <= m
            for m in range(15, 31)
            for i in range(0, 31 - m)
            for j in range(0, len(doc) - m + 1)
        )
        assert (k in [x[0] for x in test.leaks(" ".join(doc), likenesses=True)]) == want


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "before " + P + " after", "c"), (2, None, "c"), (3, "", "c"), (4, "nothing here", "c"), (None, P, "c"), (1, "before " + P + " after", "c")], "doc_id bigint, text string, item_id string"
    )
    items = spark.createDataFrame([(9, "b", P), (8, "b", None), (7, "b", "short one")], "item_id bigint, benchmark string, passage string")
    got = find_leaks(docs, items)
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1, 9)]
    assert {(r.item_id, r.documents) for r in leak_report(got, items).collect()} == {(9, 1), (8, 0), (7, 0)}
    clean = without_leaks(docs.where("doc_id = 1").distinct(), got).first()
    assert clean.text == "before ! after" and clean.removed_chars == len(P) - 1
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def cut_out(text):
    """The words that stay when all runs of the passage are taken out."""
    gone = [(s, e) for _, s, e, _ in Passages([(1, P)], 15).runs(text)]
    out, at = words_of(text)
    return [w for w, (a, b) in zip(out, at) if not any(s <= a and b <= e for s, e in gone)]


def test_all_runs_are_taken_out():
    whole = " ".join(W)
    assert cut_out(f"one {whole} two {whole} three") == ["one", "two", "three"]
    assert cut_out("one " + " ".join(W[:16]) + " two " + " ".join(W[17:]) + " three") == ["one", "three"]  # words put in for one
    assert cut_out("one " + " ".join(W[18:]) + " two " * 20 + " ".join(W[:17]) + " three") == ["one", *["two"] * 20, "three"]
    bent = "one " + " ".join(W[:12] + "as it says on the sheet".split() + W[12:24] + ["and", "so", "on"] + W[24:]) + " two"
    assert cut_out(bent) == ["one", "two"]
    assert [x[3] for x in Passages([(1, P)], 15).leaks(bent)] == [len(W)]
    left = "one " + " ".join(W[:10] + W[11:]) + " two"
    assert cut_out(left) == ["one", "two"]


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        p = [f"w{rng.randrange(40)}" for _ in range(36)]
        a = rng.randrange(0, 15)
        piece = p[a : a + rng.randrange(13, 22)]
        for _ in range(rng.randrange(0, 5)):
            piece[rng.randrange(len(piece))] = "zz"
        doc = ["q"] * 4 + piece + ["q"] * rng.randrange(1, 30) + piece[: rng.randrange(1, len(piece))] + ["q"] * 4
        want = set()
        for i in range(36):
            for j in range(len(doc)):
                right = []
                for m in range(1, min(36 - i, len(doc) - j) + 1):
                    right.append(p[i + m - 1] == doc[j + m - 1])
                    if m >= 15 and right.count(False) * 6 <= m and (m == 15 or right[0] and right[-1]):
                        want.update(range(j + right.index(True), j + m - right[::-1].index(True)))
        text = " ".join(doc)
        at = words_of(text)[1]
        got = {k for _, s, e, _ in Passages([(1, " ".join(p))], 15).runs(text) for k, (b, c) in enumerate(at) if s <= b and c <= e}
        assert want <= got
        assert got <= set(range(4, len(doc) - 4))


def test_cleaned_rows(spark):
    docs = spark.createDataFrame([(1, f"before {P} between {P} after"), (2, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "b", P)], "item_id bigint, benchmark string, passage string")
    got = find_runs(docs, items)
    assert got.count() == 2 and find_leaks(docs, items).count() == 1
    assert [(r.doc_id, r.text) for r in without_leaks(docs, got).collect()] == [(1, "before ! between ! after")]


def test_every_passage_that_meets_the_definition_is_found():
    other = W[:16] + "some thing else stands here from this word on and never comes back to it".split()
    faulty = list(W)
    faulty[4], faulty[9] = "teh", "zz"
    test = Passages([(1, P), (2, P), (3, " ".join(other)), (4, " ".join(faulty)), (5, " ".join(W[16:]))], 15)
    assert sorted(x[0] for x in test.leaks(f"one {P} two")) == [1, 2, 3, 4, 5]
    bent = " ".join(W[:12] + "as it says on the sheet".split() + W[12:])
    assert sorted((x[0], x[3]) for x in test.leaks(bent)) == [(1, 35), (2, 35), (3, 16), (4, 35), (5, 19)]


def test_likenesses_of_other_passages():
    a = "after the storm the pilot weighed the amber lantern behind the old mill because page 41 was missing and nobody noticed".split()
    b = list(a)
    b[4], b[12] = "courier", "new"
    test = Passages([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a))], 15)
    assert sorted(x[0] for x in test.leaks("so " + " ".join(a) + " so")) == [1, 3]  # equal passages stay
    assert sorted(x[0] for x in test.leaks("so " + " ".join(a) + " so", likenesses=True)) == [1, 2, 3]
    misspelt = list(a)
    misspelt[6], misspelt[15] = "teh", "pgae"
    assert sorted(x[0] for x in test.leaks(" ".join(misspelt))) == [1, 3]
    only = Passages([(2, " ".join(b))], 15)
    assert [x[0] for x in only.leaks(" ".join(a))] == [2]  # nothing else explains it


def test_mark_up_and_blocks(spark, monkeypatch):
    import tamarack.llm.leaks as L

    assert words_of("a < b and c > d")[0] == ["a", "b", "and", "c", "d"]
    assert words_of("x <b class='y'>e</b> f&nbsp;g<br/>h <!-- no -->i")[0] == ["x", "e", "f", "g", "h", "i"]
    items = spark.createDataFrame([(k, "b", " ".join(f"w{k}x{i}" for i in range(20))) for k in range(6)], "item_id bigint, benchmark string, passage string")
    docs = items.select("item_id", "passage").withColumnRenamed("item_id", "doc_id").withColumnRenamed("passage", "text")
    monkeypatch.setattr(L, "BLOCK_WORDS", 30)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()} == {(k, k) for k in range(6)}
