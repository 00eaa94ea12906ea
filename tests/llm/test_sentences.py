import pytest

from tamarack.llm.sentences import spans, split_sentences


def cutup(t):
    return [t[a:b] for a, b in spans(t)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The U.S. team met Dr. Lee at 2:30 p.m. by phone. It went well!", 2),
        ("Lungs are clear... apart from a scar.", 1),
        ("No change since Jan. 2020. Fig. 3 shows it.", 2),
        ("A 3.5 cm mass.Next one follows.", 2),
        ('The note reads "Cough for 5 days. No fever." and gives no more. Then this.', 2),
        ("THE NOTE READS \"COUGH. NO FEVER.\" AND GIVES NONE. ALL IS WELL.", 2),
        ("Die 8. Rippe zeigt z. B. wegen Erguss nichts. Kein Pneumothorax!", 2),
        ("On note liquide. La demande indique « Toux. Pas de fièvre. » sans détail. Pas de foyer !", 3),
        ("1. First item\n2) Second item, etc., here\n3. Third", 3),
        ("- one\n- two.\n- three", 3),
        ("Wrapped by\nhand here. And so\non it goes.", 2),
        ("依頼書には「咳が8日続く。発熱なし。」とあります。変化ありません。", 2),
        ("申请单写“咳嗽9天。无发热。”未提供其他病史。第6肋骨骨折。", 2),
        ("डॉ. तारवेल से 9 बजे बात हुई। 1.6 से.मी. की छाया है। क्या यह नई है?", 3),
        ("هل الخط جديد؟ نوقشت مع د. تافرين الساعة 9. لا يوجد انصباب!", 3),
        ("ขนาดหัวใจปกติ พบเงาทึบกลมขนาด 4.6 ซม. ที่ฐานปอดซ้าย ปลายสายอยู่เหนือแครินา 8 ซม. กะบังลมเรียบดี", 4),
        ("Có dịch, v.v. Không thấy. ThS. Lê Mộc đọc phim số 4. Bóng tim không to.", 4),
        ("para one\n\npara two", 2),
        ("", 0),
        (" \n ", 0),
        (None, 0),
        ("...", 1),
        ("no stop", 1),
    ],
)
def test_counts(text, want):
    assert len(cutup(text) if text else spans(text)) == want


def test_slices_cover_the_text_and_keep_breaks():
    t = "  One line\nbroken here. Two. \n\n3 more words? "
    parts = cutup(t)
    assert parts[0] == "One line\nbroken here." and all(p == p.strip() for p in parts)
    assert "".join("".join(parts).split()) == "".join(t.split())


def test_long_texts_are_read_whole():
    t = "A plain sentence stands here. " * 4000 + "x" * 50_000 + ". The end is near."
    got = spans(t)
    assert len(got) == 4001 and got[-1][1] == len(t)


def test_rows(spark):
    rows = [("a", "One. Two."), ("a", "One. Two."), ("b", None), ("c", "  "), (None, "Three.")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "study_id string, findings string, sentence string, place int")
    got = sorted((r.record_key or "", r.place, r.start, r.sentence) for r in split_sentences(df, "study_id", "findings").collect())
    assert got == [("", 1, 0, "Three."), ("a", 1, 0, "One."), ("a", 2, 5, "Two.")]
    assert split_sentences(df.limit(0), "study_id", "findings").count() == 0


@pytest.mark.parametrize("n", [1, 6, 60, 300])
def test_a_quotation_is_not_split_for_its_length(n):
    inner = " ".join(["No fever was seen."] * n)
    for opener, closer in ('""', "«»", "“”", "„“"):
        assert cutup(f"All is well. The note reads {opener}{inner}{closer} and gives no more. Then this.")[1:] == [f"The note reads {opener}{inner}{closer} and gives no more.", "Then this."]
    assert len(cutup("依頼書には「" + "咳が続く。" * n + "」とあります。変化ありません。")) == 2
    assert len(cutup(f"The note of 5\" reads {inner} It ends.")) == n + 1
    assert len(cutup(f'The note reads "{inner} It ends.')) >= n


@pytest.mark.parametrize(
    "text, want",
    [
        ("ሰላም ነው። ደህና ነኝ።", ["ሰላም ነው።", "ደህና ነኝ።"]),
        ("Բարեւ ձեզ։ Ինչպես եք։", ["Բարեւ ձեզ։", "Ինչպես եք։"]),
        ("မင်္ဂလာပါ။ နေကောင်းလား။", ["မင်္ဂလာပါ။", "နေကောင်းလား။"]),
        ("សួស្តី។ អ្នកសុខសប្បាយទេ។", ["សួស្តី។", "អ្នកសុខសប្បាយទេ។"]),
        ("We saw Gen. Lee there. He left.", ["We saw Gen. Lee there.", "He left."]),
        ("See Sec. 4. It helps.", ["See Sec. 4.", "It helps."]),
        ("It took 5 sec. Then it ended.", ["It took 5 sec.", "Then it ended."]),
        ("Smith et al. found it. Fine.", ["Smith et al. found it.", "Fine."]),
    ],
)
def test_stops_of_other_scripts_and_more_abbreviations(text, want):
    assert [text[a:b] for a, b in spans(text)] == want
