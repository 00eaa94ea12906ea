"""The same or nearly the same records across splits, by hashes of canonical texts.

Canonical means: case, accents, punctuation, white space, short forms, units and courtesy words at either
end are evened out, and slips are corrected. What is a slip doesn't depend on how rare a word is: words of a
fixed dictionary (the whole words of a public tokenizer's vocabulary), strings formed like a Vietnamese
syllable and numbers are never changed, so ``lift`` doesn't become ``left`` in any corpus. A string that is no word
in that sense becomes the common word of the corpus one edit away (insertion, deletion, substitution or swap;
two edits for longer words if there is none) that was seen beside one of its neighbours, the one that fits
them best if there are several; a slip that makes another word of the dictionary stays. The linking word of a
clause that may be moved (``mà`` before ``không có``) is left out.

Records whose canonical words have the same hash are one request; those with the same words in another order
are compared once per pair of different word sequences: one block of words moved (clauses in another order).

What is broadcast: the dictionary, of fixed size, tokens with at least ``RARE`` and word pairs with at least a
tenth of that share of all, hence at most 1/RARE and 10/RARE entries; the last two are only what slips are
corrected to.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.vocabulary import DEFAULT, whole_words
from tamarack.session import cut

RARE = 1e-4
# fixed values: how a Vietnamese syllable without its marks is formed: opening, vowels, ending
SYLLABLE = re.compile(
    r"(?:ngh|ng|nh|gh|gi|kh|ph|qu|th|tr|ch|[bcdghklmnpqrstvx])?"
    r"(?:uye|uya|uyu|oai|oay|oeo|uay|uoi|uou|ieu|yeu|ai|ao|au|ay|eo|eu|ia|ie|iu|oa|oe|oi|oo|ua|ue|ui|uo|uu|uy|ye|a|e|i|o|u|y)"
    r"(?:ng|nh|ch|[cmnpt])?"
)
# fixed values
COURTESY = tuple(
    tuple(x.split())
    for x in (
        "please|pls|plz|kindly|hi|hello|hey|dear|thanks|thank you|q|question|could you|can you|would you|"
        "xin vui long|vui long|lam on|chao ban|xin chao|xin|chao|cam on"
    ).split("|")
)
SHORT = {"w": "with", "ko": "khong", "k": "khong", "hok": "khong", "wo": "without"}
HOURS = frozenset({"h", "hr", "hrs", "hour", "hours", "gio"})
# a linking word that goes when its clause is moved, and what follows it
LINK, LINKED = "ma", ("khong", "co")
MARKS = re.compile(r"\bw/o\b")
TOKEN = re.compile(r"[^\W\d_]+|\d+")


def tokens(text: str | None) -> list[str]:
    """Lower-case words and numbers without accents; ``820h``, ``820 hours`` and ``820 giờ`` give 820 and h."""
    t = unicodedata.normalize("NFKD", (text or "").casefold().replace("đ", "d"))
    t = MARKS.sub("without ", "".join(c for c in t if not unicodedata.combining(c)))
    return TOKEN.findall(t)


def tidy(words: list[str]) -> list[str]:
    """Short forms written out, units evened out, courtesy words dropped at both ends."""
    out = [SHORT.get(w, w) for w in words]
    out = ["h" if w in HOURS and i and out[i - 1].isdigit() else w for i, w in enumerate(out)]
    changed = True
    while changed:
        changed = False
        for c in COURTESY:
            n = len(c)
            if len(out) > n and tuple(out[:n]) == c:
                out, changed = out[n:], True
            if len(out) > n and tuple(out[-n:]) == c:
                out, changed = out[:-n], True
    return out


def unlinked(words: list[str]) -> list[str]:
    """Without the linking word before a clause, which stands only where the clause comes second."""
    return [w for i, w in enumerate(words) if w != LINK or tuple(words[i + 1 : i + 3]) != LINKED]


def near(word: str) -> set[str]:
    """Keys by which words one edit apart meet: the word, and the word less each letter."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y)))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[-1]


def correct(words: list[str], known: dict[str, int], index: dict[str, list[str]], pairs: dict[tuple[str, str], int], dictionary: frozenset[str]) -> list[str]:
    """Words of the dictionary, Vietnamese syllables, numbers, words in ``known`` and strings below three letters stay."""
    out = list(words)
    for i, w in enumerate(words):
        if w in known or w.isdigit() or len(w) < 3 or w in dictionary or SYLLABLE.fullmatch(w):
            continue
        fits = {k for key in near(w) for k in index.get(key, ()) if one_edit(w, k)}
        if not fits and len(w) > 4:
            fits = {k for less in near(w) for key in near(less) for k in index.get(key, ()) if len(k) > 4 and edits(w, k) == 2}
        left, right = (out[i - 1] if i else "^"), (words[i + 1] if i + 1 < len(words) else "$")
        fits = {k for k in fits if (left, k) in pairs or (k, right) in pairs}
        if fits:
            out[i] = max(sorted(fits), key=lambda k: ((pairs.get((left, k), 0) + 1) * (pairs.get((k, right), 0) + 1), known[k]))
    return out


def moved(a: list[str], b: list[str]) -> bool:
    """Whether b is a with one block of words moved elsewhere, or the same."""
    s = 0
    while s < len(a) and s < len(b) and a[s] == b[s]:
        s += 1
    e = 0
    while e < len(a) - s and e < len(b) - s and a[-1 - e] == b[-1 - e]:
        e += 1
    x, y = a[s : len(a) - e], b[s : len(b) - e]
    if not x and not y:
        return True
    return len(x) == len(y) and any(x[k:] + x[:k] == y for k in range(1, len(x)))


def split_name(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("train", "dev", "heldout"), s)


def canonical_records(questions: DataFrame, dictionary: str = DEFAULT) -> DataFrame:
    """(record_id, split, source, seq, bag): the canonical words of each record (seq, space-separated) and the
    hash of its words in alphabetical order (bag). split is train, dev, heldout or null, source null stays.
    The text is question, or query where question is null or blank. Records without id or without words are
    left out; repeated rows count once; a record with several texts keeps each. dictionary: path of a
    vocabulary file (see ``vocabulary``)."""
    text = F.when(F.trim(F.coalesce("question", F.lit(""))) != "", F.col("question")).otherwise(F.col("query"))
    rows = questions.where("record_id IS NOT NULL").select("record_id", split_name(F.col("split")).alias("split"), "source", text.alias("text")).where("text IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [tidy(tokens(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words, pa.list_(pa.string()))], names=["record_id", "split", "source", "words"])

    kind = dict(questions.dtypes)["record_id"]
    read_rows = cut(rows.distinct().mapInArrow(read, f"record_id {kind}, split string, source string, words array<string>").where(F.size("words") > 0))
    counts = read_rows.select(F.explode("words").alias("w")).where(~F.col("w").rlike("^[0-9]+$")).groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    floor = max(2, int(total * RARE))
    known = {r.w: r["count"] for r in counts.where(F.col("count") >= floor).collect()}
    for w in (*HOURS, *(w for c in COURTESY for w in c)):
        if len(w) > 2:
            known.setdefault(w, 1)
    two = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.get("words", i - 1).alias("a"), F.get("words", i).alias("b")))
    pair_counts = read_rows.where(F.size("words") > 1).select(F.explode(two).alias("p")).groupBy("p.a", "p.b").count()
    pairs = {(r.a, r.b): r["count"] for r in pair_counts.where(F.col("count") >= max(2, int(total * RARE / 10))).collect()}
    index: dict[str, list[str]] = {}
    for w in known:
        for key in near(w):
            index.setdefault(key, []).append(w)
    fixed_words = questions.sparkSession.sparkContext.broadcast(frozenset(x for w in whole_words(dictionary) for x in tokens(w)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = [unlinked(tidy(correct(w, known, index, pairs, fixed_words.value))) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([" ".join(w) for w in fixed], pa.string()), pa.array([" ".join(sorted(w)) for w in fixed], pa.string())],
                names=["record_id", "split", "source", "seq", "bag"],
            )

    out = read_rows.mapInArrow(write, f"record_id {kind}, split string, source string, seq string, bag string")
    return out.withColumn("bag", F.xxhash64("bag"))


def same_texts(canonical: DataFrame) -> DataFrame:
    """(seq_a, seq_b), both orders and each with itself: canonical texts that are one request. Only different
    texts with one bag of words are compared, once each."""
    once = canonical.select("bag", "seq").distinct()
    a, b = once.select("bag", F.col("seq").alias("seq_a")), once.select("bag", F.col("seq").alias("seq_b"))
    pairs = a.join(b, "bag").where("seq_a < seq_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [moved(x.split(), y.split()) for x, y in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = pairs.select("seq_a", "seq_b").mapInArrow(verify, "seq_a string, seq_b string")
    return found.union(found.select("seq_b", "seq_a")).union(once.select("seq", "seq"))


def _sides(questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    canonical = cut(canonical_records(questions).withColumn("h", F.xxhash64("seq")))
    same = cut(same_texts(canonical).select("seq_a", "seq_b"))
    return canonical.where("split IN ('dev', 'heldout')"), canonical.where("split = 'train'"), same


def cross_split_pairs(questions: DataFrame, salts: int = 16) -> DataFrame:
    """(record_id_a, record_id_b), smaller id first, one in train and one in dev or heldout, that are one
    request. Training records are salted, so that a text that very many share is joined by many tasks."""
    held, train, same = _sides(questions)
    asked = held.select("seq", F.col("record_id").alias("e")).join(same, F.col("seq") == F.col("seq_a")).select("e", F.col("seq_b").alias("seq"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    there = train.select("seq", F.col("record_id").alias("t")).withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int"))
    return (
        asked.join(there, ["seq", "salt"])
        .where("e <> t")
        .select(F.least("e", "t").alias("record_id_a"), F.greatest("e", "t").alias("record_id_b"))
        .distinct()
    )


def overlap_report(questions: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, train_matches): per evaluation split and source, how many records
    there are, how many also stand in train, and how many training records they match in all. Matches are
    counted per text, not listed."""
    held, train, same = _sides(questions)
    per_text = train.groupBy("seq").agg(F.countDistinct("record_id").alias("n"))
    hits = same.join(per_text, same.seq_b == per_text.seq).groupBy("seq_a").agg(F.sum("n").alias("n"))
    per = held.groupBy("split", "source", "seq").agg(F.countDistinct("record_id").alias("r"))
    return (
        per.join(hits, per.seq == hits.seq_a, "left")
        .groupBy("split", "source")
        .agg(
            F.sum("r").alias("records"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("r")).otherwise(0)).alias("overlapping"),
            F.sum(F.coalesce(F.col("r") * F.col("n"), F.lit(0))).alias("train_matches"),
        )
    )
