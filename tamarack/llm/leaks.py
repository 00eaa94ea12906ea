"""Evaluation passages in training texts: a hash set of test n-grams, a scan of token windows, and a check.

A leak is a run of ``words`` or more successive words of a passage of which at most one in six is misspelt
or replaced. Any such run holds ``GRAM`` successive clean words, so the n-gram set finds all of them; the
check then decides each. Passages of one set resemble each other, so a leak of one is often a faulty run of
others: a faulty match most of whose right words stand in a longer clean run of another passage is that
passage's text, and left out unless asked for. Words put in between don't count, up to ``GAP`` at a place, as long as what stands
between two such places holds ``GRAM`` successive clean words of its own.

Most texts hold no n-gram of the set: a batch of texts is coded by word and looked up at once, and only texts
that hold one are read with places, cut words and mark-up. The passages are the only side that is broadcast,
indexed, in blocks of at most ``BLOCK_WORDS``; texts are scanned once for each block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4
GAP = 12
ERRORS = 5  # a wrong word costs what five right ones gain: at most one in six is wrong
BLOCK_WORDS = 2_000_000

# mark-up: a tag has a name, attributes with values and at most one without; and characters written as entities
TAG = re.compile(r"""<(?:/?[a-zA-Z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))*(?:\s+[\w:-]+)?\s*/?|!--[^<>]*--)>|&(?:[a-zA-Z]{2,8}|#\d{1,6});""")
BROKEN = re.compile(r"(?<=\w)[-­‐]\s*\n[\s>|]*(?=\w)|­|​")
WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_]+")


def _plain(word: str) -> str:
    """A word without case and accents."""
    w = word.casefold()
    if w.isascii():
        return w
    w = unicodedata.normalize("NFKD", w.replace("đ", "d"))
    return "".join(c for c in w if not unicodedata.combining(c))


def unmarked(text: str) -> str:
    """The text with blanks in place of mark-up."""
    return TAG.sub(lambda m: " " * len(m[0]), text) if "<" in text or "&" in text else text


def words_of(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The text's words without case, accents, mark-up and hyphenation, and where they stand in the text."""
    clean = unmarked(text or "")
    glue = [(m.start(), m.end()) for m in BROKEN.finditer(clean)]
    out, at = [], []
    g = 0
    for m in WORD.finditer(clean):
        w = _plain(m[0])
        while g < len(glue) and glue[g][1] < m.start():
            g += 1
        if out and g < len(glue) and glue[g][1] == m.start() and at[-1][1] == glue[g][0]:
            out[-1] += w
            at[-1] = (at[-1][0], m.end())
        elif w:
            out.append(w)
            at.append((m.start(), m.end()))
    return out, at


class Codes(dict):
    """Numbers of words as they are written, by a vocabulary of plain words; -1 if there is none. It forgets what it has
    seen when that is much."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[word] = self.vocab.get(_plain(word), -1)
        return code


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM`` successive codes."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for g in range(GRAM):
            out = (out ^ codes[g : g + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Passages:
    """The n-gram set of the passages and the check of texts against it."""

    def __init__(self, items: list[tuple], words: int):
        self.words = words
        self.ids, self.codes = [], []
        self.vocab: dict[str, int] = {}
        hashes, which, where = [], [], []
        for item, passage in items:
            code = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(passage)[0]], np.int64)
            h = gram_hashes(code)
            hashes.append(h)
            which.append(np.full(len(h), len(self.ids)))
            where.append(np.arange(len(h)))
            self.ids.append(item)
            self.codes.append(code)
        order = np.argsort(np.concatenate(hashes), kind="stable") if hashes else np.zeros(0, np.int64)
        empty = [np.zeros(0, np.int64)]
        self.grams = np.concatenate(hashes or [np.zeros(0, np.uint64)])[order]
        self.which, self.where = np.concatenate(which or empty)[order], np.concatenate(where or empty)[order]

    def candidates(self, texts: list[str | None], seen: Codes) -> list[int]:
        """Places of the texts that hold an n-gram of the set, and maybe of some that don't: those with cut words, which
        are read only by ``runs``."""
        least = self.words - self.words // 6
        picked, codes, owner = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            clean = unmarked(t)
            if BROKEN.search(clean):
                picked.append(i)
                continue
            code = [seen[w] for w in WORD.findall(clean)]
            if len(code) - code.count(-1) >= least:
                codes += code
                codes += [-1] * GRAM
                owner += [i] * (len(code) + GRAM)
        all_codes = np.array(codes, np.int64)
        h = gram_hashes(all_codes)
        if len(h) and len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            known = np.flatnonzero(self.grams[at] == h)
            picked += np.unique(np.array(owner)[known]).tolist()
        return sorted(picked)

    def _run(self, gains: np.ndarray) -> bool:
        """Whether a stretch of at least ``words`` places has a sum that isn't negative."""
        n, w = len(gains), self.words
        if n < w:
            return False
        sums = np.concatenate([[0], np.cumsum(gains)])
        return bool((sums[w:] >= np.minimum.accumulate(sums[: n - w + 1])).any())

    def runs(self, text: str | None) -> list[tuple]:
        """(item, first character, end, words) of every maximal run of every passage in the text: one that no
        other run of the passage holds. A run begins and ends with a right word; ``words`` counts the passage's
        words in it, wrong ones too."""
        found_words, at = words_of(text)
        if len(found_words) < self.words - self.words // 6:
            return []
        doc = np.array([self.vocab.get(w, -1) for w in found_words], np.int64)
        # a run has at most one wrong word in six, so fewer known words than that hold none
        if (doc >= 0).sum() < self.words - self.words // 6:
            return []
        hits = self._hits(doc)
        out = []
        for rows in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else ():
            k, diagonals = int(rows[0, 0]), rows[:, 1]
            passage = self.codes[k]
            n = len(passage)
            if n < self.words:
                continue
            ds = diagonals
            j = np.arange(n) + ds[:, None]
            inside = (j >= 0) & (j < len(doc))
            same = inside & (doc[np.clip(j, 0, len(doc) - 1)] == passage)
            if not self._run(np.where(same.any(axis=0), 1, -ERRORS)):
                continue
            found = [run for x, d in enumerate(ds.tolist()) for run in self._straight(same[x], d, len(doc))]
            for part in np.split(np.arange(len(ds)), np.flatnonzero(np.diff(ds) > GAP) + 1):
                if len(part) > 1:
                    found += self._bent(ds[part], same[part], inside[part])
            last = -1
            for first, end, words in sorted(found, key=lambda f: (f[0], -f[1], -f[2])):
                if end > last:
                    out.append((self.ids[k], at[first][0], at[end][1], words))
                    last = end
        return out

    def _hits(self, doc: np.ndarray) -> np.ndarray:
        """Different (passage, diagonal) of the n-grams that a coded text shares with passages, in order."""
        h = gram_hashes(doc)
        low, high = np.searchsorted(self.grams, h, "left"), np.searchsorted(self.grams, h, "right")
        size = high - low
        j = np.repeat(np.arange(len(h)), size)
        at_gram = np.repeat(low, size) + np.arange(len(j)) - np.repeat(np.cumsum(size) - size, size)
        return np.unique(np.column_stack([self.which[at_gram], j - self.where[at_gram]]), axis=0)

    def _clean_runs(self, doc: np.ndarray, hits: list[list[int]]) -> dict[int, np.ndarray]:
        """For every passage of the hits, the length of its longest clean run at each place of the text."""
        out: dict[int, np.ndarray] = {}
        for k, d in hits:
            low, high = max(0, d), min(len(doc), len(self.codes[k]) + d)
            same = np.concatenate([[0], doc[low:high] == self.codes[k][low - d : high - d], [0]]).astype(np.int64)
            turn = np.flatnonzero(np.diff(same))
            length = np.zeros(len(doc), np.int64)
            for s, e in zip(turn[::2], turn[1::2]):
                length[low + s : low + e] = e - s
            out[k] = np.maximum(out[k], length) if k in out else length
        return out

    def leaks(self, text: str | None, likenesses: bool = False) -> list[tuple]:
        """(item, first character, end, words) of every passage that the text contains, with its longest run. Without
        ``likenesses``, a match without a clean run of ``words`` is left out if at more than half of its right words
        another passage has a longer clean run; equal passages never leave each other out."""
        best: dict = {}
        for x in self.runs(text):
            if x[0] not in best or x[3] > best[x[0]][3]:
                best[x[0]] = x
        if likenesses or not best:
            return list(best.values())
        found, at = words_of(text)
        doc = np.array([self.vocab.get(w, -1) for w in found], np.int64)
        starts, ends = np.array(at).T
        hits = self._hits(doc).tolist()
        number = {self.ids[k]: k for k, _ in hits if self.ids[k] in best}
        own = self._clean_runs(doc, [h for h in hits if self.ids[h[0]] in best])
        within = {item: np.where((starts >= x[1]) & (ends <= x[2]), own[number[item]], 0) for item, x in best.items()}
        if all(n.max() >= self.words for n in within.values()):
            return list(best.values())
        lengths = self._clean_runs(doc, hits)
        out = []
        for item, x in best.items():
            mine = within[item]
            longest = np.max([n for k, n in lengths.items() if k != number[item]] or [np.zeros(len(doc), np.int64)], axis=0)
            right = mine > 0
            if mine.max() >= self.words or (longest[right] > mine[right]).mean() <= 0.5:
                out.append(x)
        return out

    def _straight(self, same: np.ndarray, d: int, size: int) -> list[tuple[int, int, int]]:
        """(first, last, words), places in the text: for each right word of a diagonal the longest run that begins there."""
        low, high = max(0, -d), min(len(same), size - d)
        right, w = same[low:high], self.words
        if len(right) < w:
            return []
        sums = np.concatenate([[0], np.cumsum(np.where(right, 1, -ERRORS))])
        # the last right word up to which the sum isn't negative
        top = np.maximum.accumulate(np.where(right, sums[1:], -(10**9))[::-1])[::-1]
        begin = np.flatnonzero(right)
        end = np.searchsorted(-top, -sums[begin], side="right") - 1
        out = [(a, b, b - a + 1) for a, b in zip(begin.tolist(), end.tolist()) if b - a + 1 >= w]
        # a run of just ``words`` may have its wrong words at the ends
        for a in np.flatnonzero(sums[w:] >= sums[:-w]).tolist():
            there = np.flatnonzero(right[a : a + w])
            out.append((a + int(there[0]), a + int(there[-1]), w))
        return [(a + low + d, b + low + d, words) for a, b, words in out]

    def _bent(self, ds: np.ndarray, same: np.ndarray, inside: np.ndarray) -> list[tuple[int, int, int]]:
        """(first, last, words), places in the text, of runs that change to later diagonals where words were put in
        (or to an earlier one where one was left out): for each right word and diagonal the longest that begins
        at that word and ends on that diagonal."""
        many, n = same.shape
        gain = np.where(same, 1, np.where(inside, -ERRORS, -(10**6)))
        # the diagonals from which each can be reached; index ``many`` stands for none
        came = [[x for x in range(many) if 0 <= ds[y] - ds[x] <= GAP or ds[y] - ds[x] == -1] for y in range(many)]
        came = np.array([c + [many] * (GAP + 2 - len(c)) for c in came])
        begin, on = np.nonzero(same.T)
        out = []
        block = max(1, 2_000_000 // came.size)
        for b in range(0, len(begin), block):
            a, x = begin[b : b + block], on[b : b + block]
            score = np.full((len(a), many + 1), -(10**9))
            last = np.full((len(a), many), -1)
            for i in range(int(a[0]), n):
                score[:, :many] = np.maximum(score[:, came].max(axis=2) + gain[:, i], -(10**9))
                new = np.flatnonzero(a == i)
                score[new, x[new]] = 1
                last[(score[:, :many] >= 0) & same[:, i] & (i - a[:, None] + 1 >= self.words)] = i
            for k, y in zip(*(z.tolist() for z in np.nonzero(last >= 0))):
                out.append((int(a[k] + ds[x[k]]), int(last[k, y] + ds[y]), int(last[k, y] - a[k] + 1)))
        return out


def _scanned(documents: DataFrame, items: DataFrame, read: Callable[[Passages, str], list[tuple]], doc: str, text: str, item: str, passage: str, words: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = items.where(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(item, passage).distinct()
    kinds = {**dict(documents.dtypes), **{"item": dict(items.dtypes)[item]}}
    doc_t, item_t = (to_arrow_type(t) for t in (documents.schema[doc].dataType, items.schema[item].dataType))
    wanted = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, text)
    schema = f"doc_id {kinds[doc]}, item_id {kinds['item']}, start int, end int, words int"

    def against(block: list[tuple]) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(Passages(block, words))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = sent.value
            seen = Codes(test.vocab)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                got = [(ids[i], *leak) for i in test.candidates(texts, seen) for leak in read(test, texts[i])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[k] for g in got], t) for k, t in enumerate((doc_t, item_t, pa.int32(), pa.int32(), pa.int32()))],
                    names=["doc_id", "item_id", "start", "end", "words"],
                )

        return wanted.mapInArrow(scan, schema)

    parts, block, size = [], [], 0
    for r in rows.orderBy(item, passage).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 5 + 1
        if size >= BLOCK_WORDS:
            parts.append(against(block))
            block, size = [], 0
    if block or not parts:
        parts.append(against(block))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def find_runs(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", words: int = 15) -> DataFrame:
    """(doc_id, item_id, start, end, words): every maximal run of a passage in a document, with where in the
    text. Null texts, passages and ids give none; passages shorter than ``words`` can't be found; whole
    texts are scanned. Repeated rows count once."""
    return _scanned(documents, items, Passages.runs, doc, text, item, passage, words).distinct()


def find_leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", words: int = 15, likenesses: bool = False) -> DataFrame:
    """(doc_id, item_id, start, end, words): every pair of a document and a passage it contains, with its longest
    run (of equal ones the first). Faulty runs that are another passage's text are left out unless ``likenesses``
    are asked for (see ``Passages.leaks``). Otherwise as ``find_runs``."""
    best = F.max_by(F.struct("start", "end", "words"), F.struct("words", -F.col("start"), "end")).alias("best")
    found = _scanned(documents, items, lambda test, t: test.leaks(t, likenesses), doc, text, item, passage, words)
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """(doc_id, text, removed_chars): the texts of documents with leaks, with the leaked spans taken out and a
    space in their place. Spans that overlap are joined first."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                out, last, gone = [], 0, 0
                for s in sorted((x["start"], x["end"]) for x in spans):
                    if s[1] <= last:
                        continue
                    start = max(s[0], last)
                    out.append(t[last:start])
                    gone += s[1] - start
                    last = s[1]
                out.append(t[last:])
                texts.append(" ".join(x for x in (p.strip() for p in out) if x))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed_chars"])

    spans = leaks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = dict(leaks.dtypes)["doc_id"]
    return documents.select("doc_id", "text").join(spans, "doc_id").mapInArrow(cut_out, f"doc_id {kind}, text string, removed_chars int")


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, benchmark, documents): every test item with the number of documents that contain it, 0 if none."""
    n = leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return items.select("item_id", "benchmark").distinct().join(n, "item_id", "left").select("item_id", "benchmark", F.coalesce("n", F.lit(0)).alias("documents"))
