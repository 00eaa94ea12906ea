"""Personal information inside free text: proposed by patterns, confirmed by checksums, weighed by context.

Patterns propose spans of five kinds: email, phone, id_number, address and name. Each starts with a score for
how telling its form is; checksums (Luhn, mod 97, mod 23, mod 11) raise it, and decide where the form alone
doesn't; words nearby raise or lower it. Spans from ``THRESHOLD`` on are kept, the better first where they
overlap. Names of persons have no telling form: they are proposed beside phrases that introduce or follow them.

One automaton over all literal cues tells which patterns a text can match at all; the others aren't tried on
it, which changes no result, since a pattern needs one of its cues.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1.0
KINDS = ("address", "email", "id_number", "name", "phone")

EMAIL = re.compile(
    r"(?<![\w.+@-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*(?:\s?@\s?|\s?(?:\[at\]|\(at\)|\{at\})\s?)[\p{L}\p{N}-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)[\p{L}\p{N}-]+)+", re.I
)
DIGITS = re.compile(
    r"(?<![\p{L}\p{N}_#@/-])(?<!\d[.,:])(?:\+\s?\d{1,3}[\s.-]?(?:\(0\)\s?)?(?:\(\d{1,4}\)\s?)?\d(?:[\s.\-/]?\d){5,12}|\(\d{2,4}\)\s?\d{3}[\s.-]?\d{3,4}(?:[\s.-]\d{2,4})?|\d(?:[ .\-/]?\d){7,14})(?![\p{L}\p{N}_])(?![.,:]\d)"
)
# fixed values: words that introduce a telephone number, and words that introduce other numbers
PHONE_BEFORE = re.compile(
    r"(?:\b(?:call(?:ed)?(?: me)?(?: (?:on|at))?|text|phone|mobile|cell|whatsapp|fax|ring|rang from|reach me (?:on|at)|tel|tél|telefon|téléphone|teléfono(?: es)?|handy|rückruf(?: bitte)? unter|unter|appelez(?: le| au)?|llamen al?|llámenme al?|gọi(?: tôi| cho tôi)?(?: số)?|điện thoại|sđt)|電話は?|携帯)[\s.:：]*$",
    re.I,
)
NUMBER_BEFORE = re.compile(
    r"(?:\b(?:order|model|article|artikel|bestellung|commande|référence|código|pedido|mã|đơn|firmware|version|serial|ref|code(?: under the \w+)? says|says|page|seite|isbn|ean)|注文番号|番号|型番)[\s.:#№°-]*$", re.I
)
DATE = re.compile(r"^(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})$")
PHONE_FORMS = re.compile(r"^(?:\+|\(\d{3}\)\s?\d{3}-\d{4}$|\d{3}[-.]\d{3}[-.]\d{4}$|0\d(?:[ .]\d\d){4}$|020 \d{4} \d{4}$|07\d{3} \d{6}$|000-\d{3,4}-\d{3,4}$|0\d{2,4}[ /]\d{5,8}$)")

#: Of the known forms those that nothing but a telephone number has.
OPEN_FORM = re.compile(r"^(?:\(\d{3}\)\s?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|020 \d{4} \d{4}|07\d{3} \d{6})$")

ID = re.compile(
    r"(?<![\p{L}\p{N}_-])(?=[\p{Lu}\d])(?:"
    r"(?P<ssn>\d{3}[- ]\d{2}[- ]\d{4})|(?P<ni>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])|(?P<pass>[A-Z]{2}\d{7})|(?P<dl>[A-Z]{2}-\d{4}-\d{4})|"
    r"(?P<dni>\d{2}\.\d{3}\.\d{3}-?[A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])|(?P<de>[A-Z]\d{2}(?: \d{3}){2}|[A-Z]\d{8}|[A-Z]\d{2}[A-Z]\d{5})|(?P<fr>\d[A-Z]\d{2}[A-Z]{2}\d{5}|\d{11} \d)|"
    r"(?P<nir>[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2})|(?P<long>\d{3} \d{3} \d{6}|\d{3} \d{3} \d{4}|\d{9,15}|\d{2,3}(?:[ .]\d{3}){2,3})|(?P<any>(?=[\p{Lu}\d]*\d[\p{Lu}\d]*\d)[\p{Lu}\d]{6,14})"
    r")(?![\p{L}\p{N}_])(?!-\d)"
)
# fixed values: words that introduce or follow the number of a document
ID_BEFORE = re.compile(
    r"(?:\b(?:passport|nhs|medicare|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e|identity card|id card|social security|tax|insurance|ssn|nino|id|ausweisnummer|ausweis|personalausweis|reisepass|führerschein|steuer-?id|steuernummer|carte d['’]identité|passeport|permis(?: de conduire)?|sécurité sociale|numéro fiscal|dni|nie|nif|pasaporte|carnet|cccd|cmnd|hộ chiếu|mã số thuế|giấy phép lái xe)|マイナンバー|パスポート|旅券|免許証)"
    r"(?:[\s,.:：(n°º#]|\b(?:no|nr|num|number|nummer|numéro|número|số|ist|is|was|番号|は)\b)*$",
    re.I,
)
ID_AFTER = re.compile(r"^\)?\s*(?:was (?:printed|asked)|wurde kopiert|stand auf|al entregar|của tôi)", re.I)
ID_FORM = {"ssn": 1.0, "ni": 1.0, "pass": 0.9, "dl": 0.9, "dni": 0.7, "de": 0.5, "fr": 0.5, "nir": 0.4, "long": 0.0, "any": 0.0}

_W = r"[\p{L}][\p{L}'’-]*"
_C = r"\p{Lu}[\p{L}'’-]*"
_STOP = r"(?!(?i:in|as|at|on|and|between|gracias|merci|cảm|im|liefern|por|pour|bitte)\b)"
_CITY = rf"{_STOP}(?:(?i:port|north|south|east|west|new|old|saint|san|santa|bad|mount|fort|st\.)[ -]{_W}|{_C}(?:[ -]\p{{Lu}}[\p{{L}}'’-]+)?)"
_TAIL = rf"(?:,\s(?:\d{{4,6}}\s{_CITY}|{_CITY}(?:\s\d{{4,6}})?))?"
# fixed values: words for ways and dwellings
ADDRESS = [
    re.compile(
        rf"(?:\b(?i:flat|apt\.?|unit|suite)\s\d+\w?,\s)?(?<![\p{{L}}\p{{N}}.,-])\d{{1,5}}(?:-?[A-Z])?\s(?:[NSEW]\.\s)?(?:{_C}\s){{1,4}}(?i:street|st\.|st|road|rd\.?|avenue|ave\.?|blvd\.?|boulevard|row|lane|ln\.?|drive|way|court|square|place|terrace|close)(?![\p{{L}}])"
        rf"(?:,\s(?i:apt\.?|suite|unit|flat|floor)\s\w+)?{_TAIL}"
    ),
    re.compile(r"(?<=\b(?:at|outside|is|to|in)\s)\d{1,5}\s\p{Ll}+\s(?i:lane|road|street|avenue|way|drive|court|close)(?![\p{L}])"),
    re.compile(rf"\b(?i:p\.?\s?o\.?\sbox)\s\d+{_TAIL}"),
    re.compile(rf"(?<![\p{{L}}\p{{N}}-])(?:(?i:alte|neue|große|kleine|am|im)\s)?\p{{Lu}}[\p{{L}}-]*(?i:gasse|straße|strasse|str\.|weg|platz|allee|ring|ufer|damm)\s\d+\s?[a-z]?(?![\p{{L}}\p{{N}}]){_TAIL}"),
    re.compile(rf"(?<![\p{{L}}\p{{N}}-])(?i:am|im|an der|zum|zur|auf dem)\s{_C}\s\d+\s?[a-z]?(?![\p{{L}}\p{{N}}]),\s(?:\d{{4,6}}\s)?{_CITY}"),
    re.compile(
        rf"(?<![\p{{L}}\p{{N}}.,-])\d{{1,4}}(?:\s(?i:bis|ter|quater))?,?\s(?i:rue|avenue|allée|boulevard|bd\.?|place|chemin|impasse|quai|route|cours)(?:\s(?i:du|des|de la|de l['’]|de|d['’]))?\s?{_C}(?:\s\p{{Lu}}[\p{{L}}-]+)*{_TAIL}"
    ),
    re.compile(
        rf"\b(?i:calle|avda\.?|avenida|plaza|paseo|camino|ronda|c/)(?:\s(?i:del|de la|de los|de las|de))?\s{_C}(?:\s\p{{Lu}}[\p{{L}}-]+)*,?\s\d+(?:,\s\d+[ºª]\s?\p{{L}})?{_TAIL}"
    ),
    re.compile(
        rf"(?:\b(?i:số)\s)?(?<![\p{{L}}\p{{N}}.,-])\d{{1,5}}(?:/\d+)*\s(?i:đường|phố|ngõ|hẻm|ngách)(?:\s{_C}){{1,4}}(?:,\s(?i:phường|quận|huyện|xã|thị xã|thành phố|tp\.|tỉnh)(?:\s{_C}){{1,4}})*"
    ),
    re.compile(r"(?:〒?\d{3}-\d{4}\s?)?[\p{Han}]{2,3}[都道府県][\p{Han}\p{Hiragana}\p{Katakana}ー]{1,8}?[市区町村郡][\p{Han}\p{Hiragana}\p{Katakana}ー]{0,12}?(?:\d{1,4}(?:丁目|番地?|号|[-－ー−])?){1,4}"),
]
# of which one must occur, for each of these patterns; none: always tried
WAYS = (
    None, None, ("box",), ("gasse", "straße", "strasse", "str.", "weg", "platz", "allee", "ring", "ufer", "damm"), None,
    ("rue", "avenue", "allée", "boulevard", "bd", "place", "chemin", "impasse", "quai", "route", "cours"), ("calle", "avda", "avenida", "plaza", "paseo", "camino", "ronda", "c/"),
    ("đường", "phố", "ngõ", "hẻm", "ngách"), ("都", "道", "府", "県"),
)
NUMBERED = re.compile(r"\d(?:-?[A-Z])?\s(?:[NSEW]\.\s)?\p{Lu}")
# fixed values: phrases before a name, and after one
_P = r"\p{L}[\p{L}'’]+(?:-\p{L}[\p{L}'’]+)?"
_FULL = rf"(?:{_P},\s{_P}|\p{{L}}\.\s{_P}|{_P}\s\p{{L}}\.\s{_P}|{_P}\s{_P}|{_P}\s\p{{L}}\.)"
_VI = r"\p{Lu}\p{L}+(?:\s\p{Lu}\p{L}+){1,2}"
# a first name or initial and a last name, both with capitals
_CAPS = rf"(?:\p{{Lu}}[\p{{Ll}}'’]+(?:-\p{{Lu}}\p{{Ll}}+)?|\p{{Lu}}\.)\s(?:(?:van|von|de|da|del|della|bin|al|el|le|la|\p{{Lu}}\.)\s)?\p{{Lu}}[\p{{L}}'’]+(?:-\p{{Lu}}\p{{L}}+)?"
_KANJI = r"[\p{Han}]{1,4}[\s　]?[\p{Han}\p{Hiragana}\p{Katakana}]{1,5}?"
# (words of which one must occur, pattern)
NAMES = [
    (("mr", "ms", "miss", "mx", "dr", "prof", "herr", "frau", "mme", "mlle", "monsieur", "madame", "señor", "sr", "don", "doña"), re.compile(rf"\b(?i:mr|mrs|ms|miss|mx|dr|prof|herrn?|frau|mme|mlle|monsieur|madame|señora?|sra?|don|doña)\.?\s(?P<n>\p{{Lu}}(?:[\p{{L}}'’]+|\.\s\p{{L}}[\p{{L}}'’]+)(?:-\p{{L}}+)?(?:\s\p{{Lu}}[\p{{L}}'’-]+)?)(?![\p{{L}}])(?=\s(?i:on|hat|m['’]a|muy|from|at|was|who|and|called|said|told|und|et|y|a|est|ist|war|is)\b|[.,;:)!?]|$)")),
    (("i spoke with", "i talked to"), re.compile(rf"(?i:i spoke with|i talked to)\s(?!(?i:mr|mrs|ms|dr)\b)(?P<n>{_FULL})\s(?i:on the phone)")),
    (("regards", "sincerely", "cheers", "signed", "cordialement", "grüße", "saludos", "atentamente", "trân trọng", "thân ái"), re.compile(rf"(?:(?i:kind regards|best regards|regards|sincerely|cheers|signed|cordialement|mit freundlichen grüßen|viele grüße|saludos|atentamente|trân trọng|thân ái),?\s*(?:\n\s*)?)(?P<n>{_FULL})(?![\p{{L}}])")),
    (("from support", "from the shop", "from customer service"), re.compile(rf"(?P<n>{_FULL})(?=\s(?i:from support|from the shop|from customer service)\b)")),
    (("a present for", "ask for", "thanks to", "my name is", "i am called"), re.compile(rf"(?i:was a present for|is a present for|ask for|big thanks to|many thanks to|my name is|i am called)\s(?P<n>{_FULL})(?=,?\s(?i:who|nobody|at|and|as|for|from)\b|[.,!)]|\s*$)")),
    (("the courier", "the driver", "the clerk", "der fahrer", "le livreur", "el repartidor"), re.compile(rf"(?i:the courier|the driver|the clerk|der fahrer|le livreur|el repartidor),?\s\(?(?P<n>{_FULL})(?=,|\))")),
    (("verified", "vérifié", "verifiziert", "comprador", "client", "kunde"), re.compile(rf"\((?P<n>{_FULL})(?=,?\s(?i:verified|vérifié|verifiziert|comprador|client|kunde)\b)")),
    (("appelle", "heiße", "mein name", "me llamo", "mon nom"), re.compile(rf"(?i:je m['’]appelle|ich heiße|mein name ist|me llamo|mon nom est)\s(?P<n>{_FULL})(?=,|\s(?i:und|et|y|cliente?|client)\b|[.!)])")),
    (("danke an", "merci à", "gracias a"), re.compile(rf"(?i:danke an|merci à|gracias a)\s(?P<n>{_FULL})(?=\s(?i:vom|von|aus|du|de|pour|por)\b|[.,!)])")),
    (("atendió", "atendido"), re.compile(rf"(?i:me atendió|fui atendido por)\s(?!(?i:la|el)\b)(?P<n>{_FULL})(?![\p{{L}}])")),
    (("tên", "giao là", "cảm ơn", "gặp"), re.compile(rf"(?i:tôi tên là|tên tôi là|người giao là(?: (?:anh|chị|ông|bà|cô|chú))?|cảm ơn(?: (?:anh|chị|ông|bà|cô|chú|bạn))|gặp(?: (?:anh|chị|ông|bà|cô|chú))|ký tên[:,]?)\s(?P<n>{_VI})")),
    (("contact", "written by", "reviewed by", "posted by", "sold by", "spoke with", "spoke to", "talked to", "thanks to", "thank you", "dear"), re.compile(rf"\b(?i:contact|written by|reviewed by|posted by|sold by|spoke (?:with|to)|talked to|thanks to|thank you,?|dear)\s(?P<n>{_CAPS})(?![\p{{L}}])")),
    (("colleague", "friend", "neighbour", "neighbor", "wife", "husband", "manager"), re.compile(rf"\b(?i:my|our|the)\s(?i:colleague|friend|neighbou?r|wife|husband|manager),?\s(?P<n>{_CAPS})(?=[,.!)]|\s(?:who|said|told|says|was|is|has|had)\b)")),
    (("best", "yours", "love", "greetings", "bises", "amicalement", "un saludo", "gruß"), re.compile(rf"(?:^|[\n.!?]\s*)(?i:best(?: wishes)?|yours(?: truly| sincerely| faithfully)?|(?:with )?love|greetings|bises|amicalement|un saludo|liebe grüße|gruß),?[^\S\n]*\n?\s*(?P<n>{_CAPS})[.!]?(?=\s*(?:\n|$))")),
    (("contacte", "écrit par", "escrito por", "geschrieben von", "kontakt", "liên hệ", "viết bởi"), re.compile(rf"(?i:contactez|contacte a|écrit par|escrito por|geschrieben von|kontaktieren sie|liên hệ|viết bởi)\s(?P<n>{_CAPS}|{_VI})(?![\p{{L}}])")),
    (("と申します", "という者", "担当の", "担当は", "私は", "名前は", "様より"), re.compile(rf"(?:(?:私は|名前は|担当の|担当は)(?P<n>[\p{{Han}}]{{1,3}}[\s　]?[\p{{Han}}\p{{Katakana}}]{{1,4}})(?=と申します|という者|さん|様|氏|です|が)|(?<![\p{{Han}}])(?P<n>[\p{{Han}}]{{1,3}}[\s　]?[\p{{Han}}]{{1,3}})(?=と申します|という者))")),
]
NOT_NAME = re.compile(r"^(?i:the|a|an|my|our|your|it|i|we|you|he|she|they|this|that|see|mine|order|model|bought|support|for|after|in|so|no|and|or|but)$")


def cue_automaton() -> ahocorasick.Automaton:
    """All literal cues; each tells the numbers of the patterns that need it: addresses first, then names."""
    by_cue: dict[str, set[int]] = {}
    for i, cues in enumerate([*WAYS, *(c for c, _ in NAMES)]):
        for c in cues or ():
            by_cue.setdefault(c, set()).add(i)
    found = ahocorasick.Automaton()
    for c, which in by_cue.items():
        found.add_word(c, tuple(which))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(digits: str) -> bool:
    """The last two digits are 97 less the rest modulo 97, as in French social security numbers."""
    return len(digits) > 4 and 97 - int(digits[:-2]) % 97 == int(digits[-2:])


def mod23(number: str) -> bool:
    """The letter of a Spanish identity number."""
    plain = re.sub(r"[^0-9A-Z]", "", number.upper()).replace("X", "0", number[:1].upper() == "X").replace("Y", "1", number[:1].upper() == "Y").replace("Z", "2", number[:1].upper() == "Z")
    return plain[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(plain[:-1]) % 23] == plain[-1]


def mod11(digits: str) -> bool:
    """The last of ten digits is 11 less the weighted sum of the others modulo 11, as in British health numbers."""
    if len(digits) != 10 or len(set(digits)) == 1:
        return False
    rest = 11 - sum(int(d) * w for d, w in zip(digits, range(10, 1, -1))) % 11
    return rest % 11 == int(digits[-1]) and rest != 10


def social_security(digits: str) -> bool:
    """Whether nine digits can be an American number: no part is zero, the area is neither 666 nor 900 and above."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _checked(form: str, number: str, digits: str) -> float:
    """What checksums add to an identity number's score."""
    if form == "dni":
        return 0.5 * mod23(number)
    if form == "ssn":
        return 0.0 if social_security(digits) else -0.6
    if form == "nir":
        return 0.6 if mod97(digits) else -0.4
    if form == "long":
        return 0.4 * luhn(digits) + 0.5 * (len(digits) == 15 and mod97(digits)) + 0.4 * mod11(digits)
    return 0.5 * (len(digits) == 15 and mod97(digits))


def _proposals(text: str, cues: ahocorasick.Automaton) -> Iterator[tuple[float, int, int, str]]:
    can = {i for _, which in cues.iter(text.lower()) for i in which}
    if "@" in text or re.search(r"(?i)at[\])}]", text):
        for m in EMAIL.finditer(text):
            yield 3.0, m.start(), m.end(), "email"
    if any(c.isdigit() for c in text):
        for m in DIGITS.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if not 8 <= n <= 15 or DATE.match(m[0]):
                continue
            before = text[max(0, m.start() - 45) : m.start()]
            known = PHONE_FORMS.match(m[0])
            score = (1.6 if PHONE_BEFORE.search(before) else 0) + (0.9 if known else 0) + (0.4 if m[0][0] == "+" else 0) + 0.1 * bool(known and known[0][0] != "+" and OPEN_FORM.match(m[0]))
            score -= 2.5 * bool(NUMBER_BEFORE.search(before)) + 2.0 * bool(ID_BEFORE.search(before))
            score -= 0.5 * (n >= 13 and luhn(re.sub(r"\D", "", m[0])))
            alone = not re.search(r"[\p{L}\p{N}]\s*$", before.rpartition("\n")[2]) or re.search(r"[.!?。)]\s*$", before)
            if score < THRESHOLD and score > 0.5 and alone:
                score += 0.3
            yield score, m.start(), m.end(), "phone"
        for m in ID.finditer(text):
            before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 40]
            form = m.lastgroup
            digits = re.sub(r"\D", "", m[0])
            score = ID_FORM[form] + 1.6 * bool(ID_BEFORE.search(before)) + 0.6 * bool(ID_AFTER.search(after)) + _checked(form, m[0], digits)
            score -= 2.0 * bool(PHONE_BEFORE.search(before)) + 2.5 * bool(NUMBER_BEFORE.search(before))
            yield score, m.start(), m.end(), "id_number"
        numbered = NUMBERED.search(text)
        for i, p in enumerate(ADDRESS):
            if WAYS[i] is not None and i not in can or i == 0 and not numbered:
                continue
            for m in p.finditer(text):
                end = m.end()
                if text[end - 1] == "." and not re.search(r"(?i)(?:st|rd|ave|blvd|str|ln)\.$", m[0]):
                    end -= 1
                yield 2.0 + (m.end() - m.start()) / 1000, m.start(), end, "address"
    for i, (_, p) in enumerate(NAMES, len(ADDRESS)):
        if i not in can:
            continue
        for m in p.finditer(text):
            s, e = m.span("n")
            if any(NOT_NAME.match(w) for w in re.split(r"[\s,.]+", m["n"]) if len(w) > 1):
                continue
            yield 1.5 + (e - s) / 1000, s, e, "name"


def find(text: str | None, cues: ahocorasick.Automaton | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what was found, in order and without overlaps. Null and empty texts have none. cues: the
    automaton of ``cue_automaton``, where it is at hand."""
    if not text:
        return []
    kept: list[tuple[int, int, str]] = []
    for score, s, e, kind in sorted(_proposals(text, cues or cue_automaton()), key=lambda p: (-p[0], p[1], -p[2], p[3])):
        if score < THRESHOLD:
            break
        if all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, kind))
    return sorted(kept)


def find_personal(documents: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, found, start, end): every span with personal information. Null ids and texts give none;
    whole texts are read, however long; repeated rows count once; other columns are ignored."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_t = to_arrow_type(documents.schema[doc].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = cue_automaton()
        for b in batches:
            got = [(d, k, t[s:e], s, e) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s, e, k in find(t, cues)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[i] for g in got], t) for i, t in enumerate((id_t, pa.string(), pa.string(), pa.int32(), pa.int32()))],
                names=["doc_id", "kind", "found", "start", "end"],
            )

    rows = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, text)
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)[doc]}, kind string, found string, start int, end int")


def redact(documents: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, replaced): texts with each span replaced by ``[KIND]`` in capitals and otherwise unchanged,
    and how many were. Null texts stay null."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_t = to_arrow_type(documents.schema[doc].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = cue_automaton()
        for b in batches:
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                spans = find(t, cues)
                for s, e, k in reversed(spans):
                    t = f"{t[:s]}[{k.upper()}]{t[e:]}"
                texts.append(t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_t), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "replaced"])

    return documents.select(doc, text).mapInArrow(run, f"doc_id {dict(documents.dtypes)[doc]}, text string, replaced int")
