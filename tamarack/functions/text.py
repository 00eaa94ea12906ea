"""Column functions on strings: normal forms, ids, tokens and similarities. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Vietnamese letters and their bare forms
_MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_BARE = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Without white space at its ends; what is blank then is null."""
    t = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def name_norm(c: Column | str) -> Column:
    """ASCII letters and digits in lower case, all else one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def text_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def word_norm(c: Column | str) -> Column:
    """Words of any script in lower case, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)[^\w]+", " "))


def strip_marks(c: Column | str) -> Column:
    """Vietnamese without its marks, in lower case."""
    return F.translate(F.lower(col(c)), _MARKED, _BARE)


def is_vietnamese(c: Column | str) -> Column:
    return F.lower(col(c)).rlike("[ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]")


def image_path(c: Column | str) -> Column:
    """A path with single forward slashes and without a leading ``./``; an empty one is an error."""
    p = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(col(c), r"\\", "/")), "/+", "/"), r"^(\./)+", "")
    return F.when(F.coalesce(p, F.lit("")) == "", F.raise_error(F.lit("empty image path"))).otherwise(p)


def patient_of(c: Column | str) -> Column:
    p = F.regexp_extract(col(c), r"(patient[0-9]+)", 1)
    return F.when(p != "", p)


def study_of(c: Column | str) -> Column:
    p = F.regexp_extract(col(c), r"(patient[0-9]+/study[0-9]+)", 1)
    return F.when(p != "", p)


def image_key(c: Column | str) -> Column:
    """The loosest key: patient, study and view without prefix and extension; null if one is missing."""
    p = F.regexp_extract(F.lower(F.regexp_replace(col(c), r"\\", "/")), r"(patient[0-9]+/study[0-9]+/view[0-9]+[a-z_]*)", 1)
    return F.when(p != "", p)


def view_index(c: Column | str, missing: int = 1_000_000) -> Column:
    n = F.regexp_extract(col(c), r"view([0-9]+)", 1)
    return F.when(n != "", n.cast("int")).otherwise(F.lit(missing))


def uuid5(namespace: str, c: Column | str) -> Column:
    """Name-based UUID, version 5, from the SHA-1 of namespace and name."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(col(c), "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substr(variant, nibble + 1, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def hex_mod(c: Column | str, modulus: int) -> Column:
    """A hexadecimal string of any length, as a number, modulo ``modulus``."""
    digits = F.transform(F.split(F.lower(col(c)), ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda a, d: ((a * 16 + d) % modulus).cast("int"))


def singular_candidate(c: Column | str) -> Column:
    """-ies to -y, else without a final s; null where there is none: as, ss, us and is are kept, and a lone s."""
    w = col(c)
    plural = w.rlike("[^ ]s$") & ~w.rlike("(as|ss|us|is)$")
    return F.when(plural & w.rlike("ies$"), F.regexp_replace(w, "ies$", "y")).when(plural, F.regexp_replace(w, "s$", ""))


def strip_words(c: Column | str, words: list[str]) -> Column:
    """A normalised text without the given words, the longest first."""
    out = F.concat(F.lit(" "), col(c), F.lit(" "))
    for w in sorted(words, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(f" {w} "), F.lit(" "))
    return F.trim(out)


def tokens(c: Column | str) -> Column:
    """Lower-case tokens; comma, semicolon and full stop stand alone, other punctuation separates."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"""([,;.]|[^\s,;.?!:()\[\]"'/]+)"""), 1)


def words(c: Column | str) -> Column:
    return F.filter(F.split(word_norm(c), " "), lambda w: w != "")


def dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays as sets; null if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))


def coverage(phrase: Column, alias: Column) -> Column:
    """Share of the phrase's words that the alias has; null for no words."""
    p = F.array_distinct(phrase)
    return F.try_divide(F.size(F.array_intersect(p, alias)).cast("double"), F.size(p))


def free_text_tokens(c: Column | str, least: int, stop: list[str]) -> Column:
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= least) & ~w.isin(stop)))


def ngrams(a: Column, n: int) -> Column:
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))


def copied(text: Column, source: Column, run: int) -> Column:
    """Whether two word arrays share a run of ``run`` words."""
    return F.arrays_overlap(ngrams(text, run), ngrams(source, run))
