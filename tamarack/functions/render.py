"""Texts made from parsed questions: templates, captions, warnings, facts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the concept that stands for no finding, and how it is said
NO_FINDING, NO_FINDING_SAID = "No Finding", "normal chest"


def phrase(concept: str, names: Mapping[str, str]) -> str:
    """How a concept is said: its first English form."""
    return NO_FINDING_SAID if concept == NO_FINDING else names[concept]


def template(include: Sequence[str], exclude: Sequence[str], names: Mapping[str, str], order: Sequence[str]) -> str:
    """``a and b and no c``, in the order of the labels. Empty ones, a negated No Finding and concepts that are both wanted
    and not are errors."""
    if not include and not exclude:
        raise ValueError("no concept")
    if NO_FINDING in exclude:
        raise ValueError("No Finding can't be negated")
    if set(include) & set(exclude):
        raise ValueError("wanted and not wanted")
    ordered = lambda cs: sorted(set(cs), key=list(order).index)
    return " and ".join([phrase(c, names) for c in ordered(include)] + ["no " + phrase(c, names) for c in ordered(exclude)])


def template_column(include: Column, exclude: Column, names: Mapping[str, str], order: Sequence[str]) -> Column:
    """The same over arrays of concepts; null where the template would be an error."""
    ranked = F.array(*map(F.lit, order))
    said = F.create_map(*[x for c in order for x in (F.lit(c), F.lit(phrase(c, names)))])
    sort = lambda a: F.filter(ranked, lambda c: F.array_contains(a, c))
    good = (F.size(include) + F.size(exclude) > 0) & ~F.array_contains(exclude, NO_FINDING) & ~F.arrays_overlap(include, exclude)
    parts = F.concat(F.transform(sort(include), lambda c: said[c]), F.transform(sort(exclude), lambda c: F.concat(F.lit("no "), said[c])))
    return F.when(good, F.array_join(parts, " and "))


def query_text(include: Sequence[tuple[str, str]], exclude: Sequence[str], free: str | None, names: Mapping[str, str], order: Sequence[str]) -> tuple[str | None, list[str]]:
    """(text, warnings): the template, else the free text, else nothing. A negated No Finding is dropped, what is uncertain is
    searched as present."""
    kept = [c for c in exclude if c != NO_FINDING]
    warnings = ["no_finding_dropped"] if len(kept) < len(exclude) else []
    if not include and not kept:
        return (free, [*warnings, "no_concept"]) if free else (None, [*warnings, "nothing_to_search"])
    if any(s == "UNCERTAIN" for _, s in include):
        warnings.append("uncertain_as_present")
    if not include:
        warnings.append("only_negations")
    if len(include) + len(kept) > 2:
        warnings.append("more_than_two")
    return template([c for c, _ in include], kept, names, order), warnings


def prompts(names: Mapping[str, str], pattern: str, concepts: Sequence[str]) -> list[str]:
    """A prompt per concept; pattern holds {}."""
    return [pattern.format(phrase(c, names)) for c in concepts]


def usable(text: str | None) -> str:
    """A translation without blanks and quotation marks around it."""
    return re.sub(r"^[\s\"'“”‘’«»]+|[\s\"'“”‘’«»]+$", "", text or "")


def first_said(*texts: str | None) -> str | None:
    """The first text that isn't blank."""
    return next((t.strip() for t in texts if t and t.strip()), None)


def messages(codes: Sequence[str], language: str, table: Mapping[str, Mapping[str, str]]) -> list[str]:
    """The texts of warning codes (``code`` or ``code:value``), each once in order; unknown codes stand for themselves."""
    out = []
    for c in codes:
        name, _, value = c.partition(":")
        out.append(table.get(name, {}).get(language, name).replace("{}", value))
    return list(dict.fromkeys(out))


def percent(p: Column) -> Column:
    """Whole percents, halves to the even one."""
    return F.bround(p * 100, 0).cast("int")


def sides(question_words: Sequence[str], parsed: Sequence[str], unambiguous: Mapping[str, str]) -> list[str]:
    """The sides a question asks for: what the parser found and words that mean one side only, each once."""
    return list(dict.fromkeys([*parsed, *(unambiguous[w] for w in question_words if w in unambiguous)]))
