"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming.

A text is first cut where layout leaves no choice: at blank lines and before list items. Within such a block
every place that may end a sentence is a candidate, and the sequence of whole spans with the best total score
is chosen. A span's score adds up its closing (the stop, and the word before it: abbreviations, initials,
ordinals), the opening of what follows (case, closed-class words where case tells nothing), its length, and
whether its quotation marks and brackets are balanced. Stops before the end of a quotation inside a sentence
are no candidates, however many they are. The weights are set by hand, not trained.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: abbreviations after which a sentence goes on, and those that may also end one
NEVER = frozenset("dr prof mr mrs ms st no nr fig vs approx ca cf env e.g i.e z.b z.n p.ex d.h u.a bzw li re med pr mme bs ths tp gs pgs sr sra gen col capt lt sgt rev hon gov sen pres prot al eq d डॉ से.मी د".split())
MAYBE = frozenset("sec ch etc wks wk p.m a.m sem usw approx min max inc ltd co jan feb mar apr jun jul aug sep sept oct nov dec".split())
BEFORE_NUMBER = frozenset("no nr fig jan feb mar apr may jun jul aug sep sept oct nov dec approx ca env p pp s vol sec ch art par tab eq cap kap abb abs".split())
ARTICLES = frozenset("die der das den dem des am im vom zum zur eine einer".split())
# fixed values: words that hardly open a sentence; they count where case tells nothing
INSIDE = frozenset("by from of to and or but und oder aber et ou mais và hoặc nhưng y o pero".split())
INSIDE_THAI = ("ที่", "ใน", "ของ", "และ", "หรือ", "กับ", "โดย", "ซึ่ง")
PAIRS = {"(": ")", "[": "]", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "《": "》", "（": "）"}
CLOSERS = "\"'”“’»」』》)]）"

WESTERN = ".!?…"
#: Stops of any script, by Unicode's property of characters that end sentences. Those besides ``WESTERN`` have no other use
#: and may stand without a space behind them.
STOP = re.compile(rf"(?:[{WESTERN}]+|(?:(?![{WESTERN}])\p{{Sentence_Terminal}})+)[{re.escape(CLOSERS)}]*(?:\s+[»](?=\s|$))?")
ITEM = re.compile(r"(?m)^[ \t]*(?:([-*•–·‣▪])[ \t]+|\(?(\d{1,3})[.)][ \t]+)(?=\S)")
INLINE = re.compile(r"(?<=[.!?…。！？\"”»)])[ \t]+\(?(\d{1,3})[.)][ \t]+(?=\S)")
THAI_SPACE = re.compile(r"(?<=[\p{Thai}])\s+(?=[\p{Thai}])")
BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
WORD_BEFORE = re.compile(r"[\p{L}\p{M}\p{N}_](?:[\p{L}\p{M}\p{N}_.\-']*[\p{L}\p{M}\p{N}_])?$")
FIRST = re.compile(r"[\s\"'“”„«»‘’「『《（(\[¿¡*\-•–]*([\p{L}\p{M}\p{N}_]*)")
CASED = re.compile(r"[\p{Lu}\p{Ll}]")
TOKEN = re.compile(r"[\p{L}\p{M}\p{N}]+")
SPACELESS = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Khmer}\p{Lao}\p{Myanmar}]")
MARKS = re.compile(r"[\"()\[\]«»“”„「」『』《》（）]")
QUOTES = {o: c for o, c in PAIRS.items() if o not in "([（"} | {'"': '"'}
QUOTE = re.compile(f"[{''.join({*QUOTES, *QUOTES.values()})}]")
#: So many plausible stops a single sentence can hold inside.
WINDOW = 48


def _items(text: str) -> list[int]:
    """Starts of list items: bullets at line starts; numbers where the text opens with one and they count on."""
    found = [(m.start(), int(m[2]) if m[2] else None, True) for m in ITEM.finditer(text)]
    first = next((f for f in found if f[1] is not None), None)
    cuts = [at for at, number, _ in found if number is None]
    if first is None or text[: first[0]].strip():
        return cuts
    marks = sorted(found + [(m.start(), int(m[1]), False) for m in INLINE.finditer(text)], key=lambda f: f[0])
    expected = None
    for at, number, _ in marks:
        if number is None:
            continue
        if expected is None or number == expected:
            cuts.append(at)
            expected = number + 1
    return sorted(cuts)


def _blocks(text: str) -> list[tuple[int, int]]:
    cuts = {0, len(text), *_items(text)}
    cuts.update(m.end() for m in BLANK_LINE.finditer(text))
    ordered = sorted(cuts)
    return list(zip(ordered, ordered[1:]))


def _word_before(text: str, start: int, end: int) -> str:
    m = WORD_BEFORE.search(text[max(start, end - 80) : end])
    return m[0] if m else ""


def _within(text: str, start: int, m: re.Match) -> bool:
    """Whether the quotation that the stop m closes stands inside a sentence."""
    close = m[0].rstrip()[-1]
    openers = [o for o, c in PAIRS.items() if c == close] or [close]
    at = max(text.rfind(o, start, m.start()) for o in openers)
    before = text[max(start, at - 40) : max(at, start)].rstrip()
    return at >= start and bool(before) and not STOP.search(before[-1:])


def _closing(text: str, start: int, m: re.Match, cased: bool) -> float:
    """How well a sentence ends at the stop m."""
    stop = m[0]
    mark, tail = stop[0], text[m.end() : m.end() + 1]
    embedded = stop[-1] in CLOSERS and _within(text, start, m)
    if mark not in WESTERN:
        return -3.0 if embedded else 3.0
    if mark in "!?":
        return 2.0 - (0 if cased or not embedded else 3)
    if stop.startswith(("...", "…")):
        return 0.5 if cased else -4
    word = _word_before(text, start, m.start())
    if not word:
        return 1.0
    w = word.lower().rstrip(".")
    last = w.rpartition(".")[2]
    score = 1.5 - (0 if cased or not embedded else 3)
    follows = text[m.end() : m.end() + 40].lstrip()[:1]
    if w in NEVER or last in NEVER and last not in ("d", "no", "re", "li", "st", "co"):
        if w == "no" and not follows.isdigit():
            return score
        return -6
    if w in MAYBE:
        return -6 if follows.isdigit() and w in BEFORE_NUMBER else -0.5 if cased else -2.5
    if w in BEFORE_NUMBER and follows.isdigit():
        return -6
    if w == "v.v":
        return 1.0
    if len(last) == 1 and last.isalpha() and not SPACELESS.match(last):
        return -6 if tail else 1.0
    if last.isdigit():
        end = m.start() - len(word)
        before = text[max(start, end - 40) : end].split()
        if before and before[-1].lower() in ARTICLES:
            return -6
        return 0.6
    return score


def _opening(text: str, at: int, cased: bool) -> float:
    """How well a sentence opens at this place."""
    word = FIRST.match(text, at)[1]
    if not word:
        return 0.0
    lower = word.lower()
    if word[0].isdigit():
        return -0.2
    if cased and CASED.match(word):
        return 1.0 if any(c.isupper() for c in word) else -5.0
    return -3.0 if lower in INSIDE or word.startswith(INSIDE_THAI) else 0.5


def _unbalanced(marks: str) -> int:
    stack: list[str] = []
    straight = wrong = 0
    for c in marks:
        if c == '"':
            straight += 1
        elif stack and c == stack[-1]:
            stack.pop()
        elif c in PAIRS:
            stack.append(PAIRS[c])
        elif c in "」』》）»)]":
            wrong += 1
    return len(stack) + straight % 2 + (wrong > 0)


def _quoted(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places of the marks of every closed quotation that stands inside a sentence, the outermost ones."""
    found, stack = [], []
    for m in QUOTE.finditer(text, start, end):
        c, at = m[0], m.start()
        straight = c == '"'
        k = next((k for k in reversed(range(len(stack))) if QUOTES[stack[k][0]] == c), None)
        if k is not None and not (straight and text[at - 1].isspace()):
            found.append((stack[k][1], at))
            del stack[k:]
        elif c in QUOTES and not (straight and (text[at + 1 : at + 2].strip() == "" or at > start and (text[at - 1].isalnum() or text[at - 1] in ".!?"))):
            stack.append((c, at))
    out: list[tuple[int, int]] = []
    for s, t in sorted(found):
        before = text[max(start, s - 40) : s].rstrip()
        if before and not STOP.search(before[-1:]) and not (out and t < out[-1][1]):
            out.append((s, t))
    return out


def spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without white space at its ends. Null and blank texts have none."""
    if not text or not text.strip():
        return []
    letters = CASED.findall(text)
    cased = any(c.islower() for c in letters) and any(c.isupper() for c in letters)
    out = []
    for b, e in _blocks(text):
        places: list[tuple[int, float]] = []
        last = e
        while last > b and text[last - 1].isspace():
            last -= 1
        item = ITEM.match(text, b, e) or INLINE.match(text, b, e)
        begin = item.end() if item else b
        quoted = _quoted(text, b, e)
        opens = [s for s, _ in quoted]
        inside = lambda p: (k := bisect.bisect_left(opens, p)) > 0 and p <= quoted[k - 1][1]
        for m in STOP.finditer(text, b, e):
            if m.end() >= last or m.end() <= begin or inside(m.end()):
                continue
            nxt = text[m.end()]
            if not nxt.isspace() and m[0][0] in WESTERN:
                if m[0][0] == "." and (not nxt.isupper() or (prev := text[m.start() - 1 : m.start()]).isdigit() and nxt.isdigit() or not prev.isalnum() and prev not in CLOSERS):
                    continue
                if m[0][0] != "." and not nxt.isalpha():
                    continue
            score = _closing(text, b, m, cased) + _opening(text, m.end(), cased)
            if not nxt.isspace() and m[0][0] == "." and len(_word_before(text, b, m.start())) < 2:
                score -= 6
            if score > -5:
                places.append((m.end(), score))
        stops = {p for p, _ in places}
        for m in THAI_SPACE.finditer(text, b, e):
            if m.start() not in stops and not inside(m.start()):
                places.append((m.start(), 2.0 + _opening(text, m.end(), cased)))
        places.sort()
        at = [b, *(p for p, _ in places), e]
        gain = [0.0, *(s for _, s in places), 0.0]
        best, back = [0.0] * len(at), [0] * len(at)
        counts = [t.start() for t in TOKEN.finditer(text, b, e)]
        tokens_to = [bisect.bisect_left(counts, p) for p in at]
        dense = [t.start() for t in SPACELESS.finditer(text, b, e)]
        dense_to = [bisect.bisect_left(dense, p) for p in at]
        found = [(t.start(), t[0]) for t in MARKS.finditer(text, b, e)]
        marks = "".join(c for _, c in found)
        marks_to = [bisect.bisect_left(found, (p,)) for p in at]
        for j in range(1, len(at)):
            top = None
            for i in range(max(0, j - WINDOW), j):
                size = tokens_to[j] - tokens_to[i]
                spaceless = dense_to[j] > dense_to[i]
                length = 0.0 if spaceless and size else -8.0 if size == 0 else -1.0 if size == 1 else -0.3 if size == 2 else -0.5 * (size > 60)
                s = best[i] + length 
                if marks_to[j] > marks_to[i]:
                    s -= 5 * _unbalanced(marks[marks_to[i] : marks_to[j]])
                if top is None or s > top:
                    top, back[j] = s, i
            best[j] = top + gain[j]
        j, picked = len(at) - 1, []
        while j:
            picked.append((at[back[j]], at[j]))
            j = back[j]
        for s, t in reversed(picked):
            piece = text[s:t]
            s += len(piece) - len(piece.lstrip())
            t = s + len(piece.strip())
            if t > s:
                out.append((s, t))
    return out


def split_sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(record_key, place, start, sentence): every sentence of ``text``, the exact slice, place from 1. Rows
    with a null or blank text give none; whole texts are read, however long; a text that occurs again under
    the same key is split once; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, starts, parts = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, (s, e) in enumerate(spans(t), 1):
                    keys.append(k)
                    places.append(n)
                    starts.append(s)
                    parts.append(t[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(starts, pa.int32()), pa.array(parts, pa.string())], names=["record_key", "place", "start", "sentence"])

    wanted = rows.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    return wanted.mapInArrow(run, "record_key string, place int, start int, sentence string")
