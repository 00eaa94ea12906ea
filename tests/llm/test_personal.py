import pytest

from tamarack.llm.personal import find, find_personal, luhn, mod11, mod23, mod97, redact


def got(t):
    return [(k, t[s:e]) for s, e, k in find(t)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to a.b+c@mail.example.org if so.", [("email", "a.b+c@mail.example.org")]),
        ("mail: jo[at]post[dot]test, thanks", [("email", "jo[at]post[dot]test")]),
        ("my mail: jo.x @ post.example.net ok", [("email", "jo.x @ post.example.net")]),
        ("Call me on 2125550145 after six.", [("phone", "2125550145")]),
        ("Rückruf bitte unter +49 (0)30 23125-542.", [("phone", "+49 (0)30 23125-542")]),
        ("電話は 000-5873-8391 まで。", [("phone", "000-5873-8391")]),
        ("Order 351-3436396 came. Model RX-453-9630. Artikel 2977674645561.", []),
        ("Firmware 20.95.2, bought 2024-10-09 for 12.12, see www.guide.example/x, @bargain_284.", []),
        ("My passport no. XZ3664247 was printed on the parcel.", [("id_number", "XZ3664247")]),
        ("tax number (QQ 27 87 80 Z).", [("id_number", "QQ 27 87 80 Z")]),
        ("Họ hỏi số CCCD 000 988 357401 của tôi.", [("id_number", "000 988 357401")]),
        ("Das Paket lag vor Alte Coppergategasse 38a im Regen.", [("address", "Alte Coppergategasse 38a")]),
        ("My address is Flat 19, 258 Alderfield's Row, Villafell, as on the invoice.", [("address", "Flat 19, 258 Alderfield's Row, Villafell")]),
        ("Livrez plutôt au 330, rue des Copperfields, 00088 Altdunmere, merci.", [("address", "330, rue des Copperfields, 00088 Altdunmere")]),
        ("Giao lại tới 383/4 ngõ Trăng Bạc, quận Hồ Lam, cảm ơn.", [("address", "383/4 ngõ Trăng Bạc, quận Hồ Lam")]),
        ("I spoke with Mr. Olmorel on the phone.", [("name", "Olmorel")]),
        ("Signed, Zubrdane, Dana They keep it.", [("name", "Zubrdane, Dana")]),
        ("Tôi tên là Lưu Tường Khuê. Ồn.", [("name", "Lưu Tường Khuê")]),
        ("Emma Teakwell makes a better one.", []),
        ("Please contact Maria Garcia about it.", [("name", "Maria Garcia")]),
        ("Written by Peter Jackson, a fan.", [("name", "Peter Jackson")]),
        ("Works well.\nBest,\nAnna Lee", [("name", "Anna Lee")]),
        ("My colleague Tom O'Neill said so. My neighbour Junopark Home makes a better one.", [("name", "Tom O'Neill")]),
        ("Write or 555-123-4567 works too.", [("phone", "555-123-4567")]),
        ("My NHS number 943 476 5919 is on it.", [("id_number", "943 476 5919")]),
        ("It says 943 476 5918 there.", []),
        ("Numéro 2 55 08 14 168 025 38 sur la boîte.", [("id_number", "2 55 08 14 168 025 38")]),
        ("Numéro 2 55 08 14 168 025 39 sur la boîte.", []),
        ("Mine is 123-45-6789, theirs 000-45-6789.", [("id_number", "123-45-6789")]),
        ("私は山田太郎と申します。住所は東京都新宿区西新宿2-8-1です。", [("name", "山田太郎"), ("address", "東京都新宿区西新宿2-8-1")]),
        ("The best Coffee Grinder I had. Best, by far.", []),
        ("", []),
    ],
)
def test_found(text, want):
    assert got(text) == want


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("255081416802538") and not mod97("255081416802539")
    assert mod11("9434765919") and not mod11("9434765918") and not mod11("0000000000")
    assert mod23("12345678Z") and not mod23("12345678A")


def test_rows(spark):
    long = "filler words here. " * 20_000 + "Write to a@b.example now."
    df = spark.createDataFrame([(1, "Write to a@b.example now.", "c"), (2, None, "c"), (3, "", "c"), (4, long, "c"), (None, "a@b.example", "c")], "doc_id bigint, text string, found string")
    rows = {(r.doc_id, r.kind, r.found) for r in find_personal(df).collect()}
    assert rows == {(1, "email", "a@b.example"), (4, "email", "a@b.example")}
    texts = {r.doc_id: (r.text, r.replaced) for r in redact(df.where("doc_id < 4")).collect()}
    assert texts == {1: ("Write to [EMAIL] now.", 1), 2: (None, 0), 3: ("", 0)}
    assert find_personal(df.limit(0)).count() == 0
