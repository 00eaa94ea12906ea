from tamarack.llm.overlap import cross_split_pairs, moved, one_edit, overlap_report, tidy, tokens

SCHEMA = "record_id bigint, split string, source string, question string, query string, seq string, bag int"


def questions(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


BASE = "Which films have a ring-like band at the lower left spine but no smooth cavity within {} hours?"


def test_words():
    assert tidy(tokens("Pls: Show W/ 820h, Không ko!")) == ["show", "with", "820", "h", "khong", "khong"]
    assert tidy(tokens("Hi, hello - please")) == ["hello"]
    assert one_edit("films", "fims") and one_edit("hours", "horus") and one_edit("a", "b") and not one_edit("left", "right")
    assert moved("a b c d".split(), "c d a b".split()) and not moved("a x b".split(), "b x a".split())


def test_pairs(spark):
    rows = [(i, "train", "s", BASE.format(100 + i), None) for i in range(60)]
    rows += [
        (1000, "dev", "s", None, "within 103h, which films have a ring-like band at the lower left spine but no smooth cavity??"),
        (1001, " HELDOUT", None, None, "hello, WHICH FIMS HAVE A RING-LIKE BAND AT THE LOWER LEFT SPINE BUT NO SMOOTH CAVITY WITHIN 104H"),
        (1002, "heldout", "s", BASE.format(999), None),
        (1003, None, "s", BASE.format(105), None),
        (1004, "dev", "s", "Which films have a ring-like band at the lower right spine but no smooth cavity within 106 hours?", None),
        (1005, "dev", "s", None, None),
        (1006, "dev", "s", "", " "),
        (1000, "dev", "s", None, "within 103h, which films have a ring-like band at the lower left spine but no smooth cavity??"),
        (None, "dev", "s", BASE.format(107), None),
    ]
    df = questions(spark, rows)
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == {(3, 1000), (4, 1001)}
    report = {(r.split, r.source): (r.records, r.overlapping, r.train_matches) for r in overlap_report(df).collect()}
    assert report == {("dev", "s"): (2, 1, 1), ("heldout", None): (1, 1, 1), ("heldout", "s"): (1, 0, 0)}
    assert cross_split_pairs(df.limit(0)).count() == 0


def test_hot_text_is_whole(spark):
    rows = [(i, "train", "s", BASE.format(5), None) for i in range(300)] + [(1000 + i, "dev", "s", BASE.format(5), None) for i in range(20)]
    assert cross_split_pairs(questions(spark, rows)).count() == 6000


def test_moved_clause_loses_its_linking_word(spark):
    show, without, when = "Cho tôi xem đám mờ ở đỉnh phổi bên {}", "không có dải mờ", "chụp trong vòng {} giờ sau nhập viện"
    rows = [(i, "train", "s", f"{show.format('trái')} mà {without}, {when.format(100 + i)}", None) for i in range(40)]
    rows += [
        (1000, "dev", "s", f"{without.capitalize()}, {show.format('trái').lower()}, {when.format(103)}?", None),
        (1001, "heldout", "s", f"{without.capitalize()}, {show.format('phải').lower()}, {when.format(104)}", None),
        (1002, "heldout", "s", f"{show.format('trái')}, {when.format(105)}", None),
        (1003, "dev", "s", f"Ma ko co dai mo, {show.format('trái')}, {when.format(106)}", None),
    ]
    df = questions(spark, rows)
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == {(3, 1000), (6, 1003)}
    assert sum(r.overlapping for r in overlap_report(df).collect()) == 2


def test_words_of_the_dictionary_are_no_slips_however_rare(spark):
    ask = "Show films where the patient has a mass on the {} side within {} hours"
    rows = [(i, "train", "s", ask.format("left" if i % 2 else "right", 100 + i), None) for i in range(400)]
    rows += [
        (1000, "dev", "s", ask.format("lift", 101), None),
        (1001, "dev", "s", ask.format("night", 102), None),
        (1002, "dev", "s", ask.replace("mass", "mask").format("left", 103), None),
        (1003, "dev", "s", ask.format("lfet", 105), None),
        (1004, "dev", "s", ask.replace("mass", "masss").format("left", 107), None),
        (1005, "dev", "s", ask.format("zzleftzz", 109), None),
    ]
    assert {tuple(r) for r in cross_split_pairs(questions(spark, rows)).collect()} == {(5, 1003), (7, 1004)}


def test_dictionary_and_syllables():
    from tamarack.llm.overlap import SYLLABLE
    from tamarack.llm.vocabulary import whole_words

    words = whole_words()
    assert {"left", "lift", "night", "mask"} <= words and not {"lfet", "masss", "hoours"} & words
    assert all(SYLLABLE.fullmatch(w) for w in ("khong", "nghieng", "quanh", "u", "xuong")) and not SYLLABLE.fullmatch("khng") and not SYLLABLE.fullmatch("film")
