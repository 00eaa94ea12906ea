"""The scoring plan: intents over concept columns, compiled to one column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 30.0
COMBINES = ("single", "noisy_or", "weighted", "weighted_noisy_or", "max")


@dataclass(frozen=True)
class Part:
    column: str
    weight: float = 1.0


@dataclass(frozen=True)
class Intent:
    concept: str
    polarity: str = "PRESENT"
    combine: str = "single"
    parts: tuple[Part, ...] = ()
    route: str = "direct"
    warnings: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.polarity not in ("PRESENT", "ABSENT") or self.combine not in COMBINES:
            raise ValueError(f"{self.polarity} {self.combine}")


def _z(p: Part) -> Column:
    return F.least(F.greatest(F.col(f"`{p.column}`").cast("double"), F.lit(-CLIP)), F.lit(CLIP))


def _log_sigmoid(z: Column) -> Column:
    return -F.log1p(F.exp(-z))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _complement(s: Column) -> Column:
    """log(1 - exp(s)) for s below 0, kept finite."""
    return F.log(-F.expm1(F.least(s, F.lit(-1e-30))))


def intent_score(i: Intent) -> Column:
    """The log probability that an intent holds; an intent without columns adds nothing."""
    if not i.parts:
        return F.lit(0.0)
    present = i.polarity == "PRESENT"
    z = [_z(p) for p in i.parts]
    if i.combine == "single":
        return _log_sigmoid(z[0] if present else -z[0])
    if i.combine == "noisy_or":
        s = F.least(_add([_log_sigmoid(-x) for x in z]), F.lit(-1e-30))
        return _complement(s) if present else s
    if i.combine == "weighted_noisy_or":
        s = F.least(_add([F.log1p(-F.lit(p.weight) * _sigmoid(x)) for p, x in zip(i.parts, z)]), F.lit(-1e-30))
        return _complement(s) if present else s
    if i.combine == "weighted":
        if present:
            return _add([F.lit(p.weight) * _log_sigmoid(x) for p, x in zip(i.parts, z)])
        return F.log(_add([F.lit(p.weight) * _sigmoid(-x) for p, x in zip(i.parts, z)]))
    top = reduce(lambda a, b: F.greatest(a, b), [_sigmoid(x) for x in z])
    top = F.least(F.greatest(top, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log(top) if present else F.log1p(-top)


def score(intents: Sequence[Intent]) -> Column:
    """One expression for a whole question: the sum over its intents."""
    return _add([intent_score(i) for i in intents]) if intents else F.lit(0.0)


def probability(i: Intent) -> Column:
    """The probability to show for an intent; weighted parts mix arithmetically here. Null without columns."""
    if not i.parts:
        return F.lit(None).cast("double")
    p = [_sigmoid(_z(x)) for x in i.parts]
    if i.combine == "single":
        yes = p[0]
    elif i.combine == "weighted":
        yes = _add([F.lit(x.weight) * q for x, q in zip(i.parts, p)])
    elif i.combine == "max":
        yes = reduce(lambda a, b: F.greatest(a, b), p)
    else:
        weights = [x.weight if i.combine == "weighted_noisy_or" else 1.0 for x in i.parts]
        yes = F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - F.lit(w) * q for w, q in zip(weights, p)])
    return yes if i.polarity == "PRESENT" else F.lit(1.0) - yes


def dedupe(intents: Sequence[Intent]) -> list[Intent]:
    """The first intent of each concept and polarity."""
    seen: dict = {}
    for i in intents:
        seen.setdefault((i.concept, i.polarity), i)
    return list(seen.values())


def drop_places(intents: Sequence[Intent], places: set[str]) -> list[Intent]:
    """A location beside a finding says where, not what: it is left out."""
    if any(i.concept not in places for i in intents):
        return [i for i in intents if i.concept not in places]
    return list(intents)


def needs_text(intents: Sequence[Intent]) -> bool:
    """Whether nothing that is wanted has a column."""
    return not any(i.parts for i in intents if i.polarity == "PRESENT")


def suggested(concept: str, rows: Sequence[tuple[str, float]], *, share: str = "sum", top: int | None = None) -> Intent:
    """An intent over suggesting columns: weights p / sum p (a geometric mix) or p / max p (a noisy or)."""
    rows = list(rows)[:top]
    scale = sum(p for _, p in rows) if share == "sum" else max((p for _, p in rows), default=1.0)
    parts = tuple(Part(c, p / scale) for c, p in rows) if rows and scale > 0 else ()
    return Intent(concept, "PRESENT", "weighted" if share == "sum" else "weighted_noisy_or", parts, "suggests" if share == "sum" else "typically_at")


def expand(
    concept: str, polarity: str, *, scorable: set[str], weak: set[str], manual: Sequence[tuple[str, float]] = (), below: Sequence[str] = (), above: str | None = None,
    kind: str = "Finding", suggests: Sequence[tuple[str, float]] = (), typical: Sequence[tuple[str, float]] = (), top: int = 5,
) -> Intent:
    """How a concept is scored; the first rule that fires: its own column; hand-made suggestions; a noisy or over
    strong descendants; the nearest ancestor (a negation then says nothing and is skipped); a disease's
    suggesting findings; an anatomy's typical findings; nothing."""
    base = Intent(concept, polarity)
    if concept in scorable:
        return replace(base, parts=(Part(concept),), warnings=("weak",) if concept in weak else ())
    if manual:
        return replace(suggested(concept, manual), polarity=polarity, route="manual")
    strong = tuple(Part(c) for c in dict.fromkeys(below) if c in scorable and c not in weak)
    if strong:
        return replace(base, combine="noisy_or", parts=strong, route="wider")
    if above is not None:
        if polarity == "ABSENT":
            return replace(base, route="narrower", warnings=("negation_skipped",))
        return replace(base, parts=(Part(above),), route="narrower", warnings=("narrower",))
    if kind == "Disease" and suggests:
        return replace(suggested(concept, suggests), polarity=polarity)
    strong_typical = [r for r in typical if r[0] in scorable and r[0] not in weak]
    if kind == "Anatomy" and strong_typical:
        return replace(suggested(concept, strong_typical, share="max", top=top), polarity=polarity)
    return replace(base, route="none", warnings=("no_route",))


def transform(intents: Sequence[Intent], name: str) -> list[Intent]:
    """Plan rewrites for ablations."""
    if name == "no_weights":
        return [replace(i, parts=tuple(Part(p.column) for p in i.parts), combine="noisy_or" if i.combine.startswith("weighted") else i.combine) for i in intents]
    if name == "no_negation":
        return [i for i in intents if i.polarity == "PRESENT"]
    if name == "max":
        return [replace(i, combine="max") for i in intents]
    raise ValueError(name)


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as z-scores over all rows (population deviation; 0 counts as 1), from one aggregate row."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        s = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / s)
    return out.drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])


def fuse(df: DataFrame, kg: str, cosine: str, weight: float) -> DataFrame:
    """z(kg) + weight * z(cosine) over the whole corpus, as column ``fused``; filters come after."""
    return zscore(df, [kg, cosine]).withColumn("fused", F.col(kg) + F.lit(weight) * F.col(cosine))
