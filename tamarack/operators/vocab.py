"""Mentions and vocabulary: nested annotations to phrases, phrase rules, located pairs, counts, concepts of mentions.

Mentions are rows (study_id, section, entity, kind, polarity, tokens, head_index, located_at, suggests); with the
phrase rules applied also head, joined and dropped_head."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import blank_to_null, singular_candidate, text_key
from tamarack.operators.evaluate import coverage_curve

KEY = ("study_id", "section", "entity")
# fixed values: the annotations' labels of certainty
POLARITY = {"definitely present": "present", "definitely absent": "absent", "uncertain": "uncertain"}
ANNOTATION = "text string, entities map<string, struct<tokens: string, label: string, start_ix: bigint, relations: array<array<string>>>>"
MENTION = "kind string, polarity string, tokens array<string>, head_index int, entity string, located_at array<string>, suggests array<string>"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(text, entities) from a JSON array of records whose only field "0" holds a text and its entities by id."""
    return spark.read.schema(f"`0` struct<{ANNOTATION.replace('text string', 'text: string').replace('entities map', 'entities: map')}>").option("multiLine", True).json(path).select("0.text", "0.entities")


def pool_sections(pool: DataFrame, reports: DataFrame, path: str, sections: Mapping[str, str]) -> DataFrame:
    """(study_id, section, text) of every section that isn't blank. sections: {section: column}. Every study of the pool
    must meet exactly one report, or it is an error."""
    joined = pool.select("study_id", path).join(reports.select(path, *sections.values()), path, "left")
    n = joined.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("study_id").alias("studies")).first()
    wanted, unmatched = pool.count(), pool.join(reports.select(path).distinct(), path, "left_anti").count()
    if not n.rows == n.studies == wanted or unmatched:
        raise ValueError(f"{wanted} studies met {n.rows} reports, {unmatched} met none")
    parts = F.array(*[F.struct(F.lit(s).alias("section"), blank_to_null(c).alias("text")) for s, c in sections.items()])
    return joined.select("study_id", F.explode(parts).alias("p")).select("study_id", "p.section", "p.text").where("text IS NOT NULL")


def _norm(text: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def mentions_of(entities: Mapping[str, Mapping]) -> list[tuple]:
    """(kind, polarity, tokens, place of the head, id of the head, located_at, suggests) of every entity that modifies no
    other: its tokens with those of its direct modifiers in text order, and the heads of the Anatomy phrases it is
    located at and of the Observation phrases it suggests, by itself or by a modifier. A chain of modifiers that runs in
    a circle ends where it would repeat."""
    modifies: dict[str, str] = {}
    modifiers: dict[str, list[str]] = {}
    for name, e in entities.items():
        for rel, target in e["relations"] or ():
            if rel == "modify":
                modifies.setdefault(name, target)
                modifiers.setdefault(target, []).append(name)

    def head(name: str) -> str:
        walked = [name]
        while (up := modifies.get(walked[-1])) in entities and up not in walked:
            walked.append(up)
        return walked[-1]

    def targets(parts: Sequence[str], rel: str, kind: str, own: str) -> list[str]:
        ends = {head(t) for p in parts for r, t in entities[p]["relations"] or () if r == rel and t in entities}
        return sorted(h for h in ends if h != own and entities[h]["label"].startswith(kind))

    out = []
    for name, e in entities.items():
        if name in modifies:
            continue
        parts = sorted([name, *modifiers.get(name, ())], key=lambda p: entities[p]["start_ix"])
        label = e["label"].split("::")
        polarity = POLARITY.get(label[-1]) if label[0] == "Observation" else None
        tokens = [" ".join(_norm(entities[p]["tokens"])) for p in parts]
        out.append((label[0], polarity, tokens, parts.index(name), name, targets(parts, "located_at", "Anatomy", name), targets(parts, "suggestive_of", "Observation", name)))
    return out


def extract_mentions(sections: DataFrame, annotations: DataFrame) -> DataFrame:
    """(study_id, section, *mention): sections meet annotations by text, never by position: letters and digits in lower case;
    equal texts share an annotation. Each annotated text is read once."""
    key = lambda df: df.where("text IS NOT NULL").withColumn("_k", text_key("text"))
    wanted = key(sections).select("_k", "study_id", "section")
    once = key(annotations).groupBy("_k").agg(F.min_by("entities", "text").alias("entities"))
    met = once.join(wanted.select("_k").distinct(), "_k", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        for b in batches:
            got = [(k, *m) for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(maps_as_pydicts="strict")) for m in mentions_of(e or {})]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(types)], names=["_k", "kind", "polarity", "tokens", "head_index", "entity", "located_at", "suggests"])

    return wanted.join(met.mapInArrow(run, f"_k string, {MENTION}"), "_k").drop("_k")


def match_shares(sections: DataFrame, annotations: DataFrame) -> DataFrame:
    """(section, texts, matched): how many texts found their annotation."""
    keys = annotations.where("text IS NOT NULL").select(text_key("text").alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return sections.where("text IS NOT NULL").withColumn("_k", text_key("text")).join(keys, "_k", "left").groupBy("section").agg(F.count(F.lit(1)).alias("texts"), F.count("_hit").alias("matched"))


def singular_if(phrase: Column, candidate: Column, known: Column) -> Column:
    return F.when(known, candidate).otherwise(phrase)


def apply_rules(mentions: DataFrame, names: DataFrame, drop: Mapping[str, Sequence[str]]) -> DataFrame:
    """mentions with head (singular where that is another head or a name), joined and dropped_head. joined is the first
    that is a name (names: name): the head with all its modifiers that aren't on the kind's drop list, then with each
    of them alone, in text order; else the head. Mentions with an empty head are left out."""
    m = mentions.withColumn("_h", F.get("tokens", "head_index")).where(F.coalesce("_h", F.lit("")) != "")
    known = names.select(F.col("name").alias("_s")).union(m.select("_h")).where("_s IS NOT NULL").distinct().withColumn("_is", F.lit(True))
    heads = m.select("_h").distinct().withColumn("_s", singular_candidate("_h")).join(known, "_s", "left").select("_h", singular_if(F.col("_h"), F.col("_s"), F.coalesce("_is", F.lit(False))).alias("head"))
    m = m.join(heads, "_h")
    none = F.array().cast("array<string>")
    dropped = none
    for kind, barred in drop.items():
        dropped = F.when(F.col("kind") == kind, F.array(*map(F.lit, barred)) if barred else none).otherwise(dropped)
    at = F.sequence(F.lit(0), F.size("tokens") - 1)
    kept = F.filter(at, lambda i: (i != F.col("head_index")) & (F.get("tokens", i) != "") & ~F.array_contains(dropped, F.get("tokens", i)))
    word = lambda i: F.when(i == F.col("head_index"), F.col("head")).otherwise(F.get("tokens", i))
    phrase = lambda places: F.array_join(F.transform(F.array_sort(places), word), " ")
    tries = F.when(F.size("_kept") > 0, F.concat(F.array(phrase(F.concat("_kept", F.array("head_index")))), F.transform("_kept", lambda i: phrase(F.array(i, F.col("head_index")))))).otherwise(F.array().cast("array<string>"))
    m = m.withColumn("_kept", kept).withColumn("_try", F.array_distinct(tries)).withColumn("_id", F.xxhash64("kind", "head", "_try"))
    # different phrases are looked up once
    once = m.select("_id", "_try").distinct().select("_id", F.posexplode("_try").alias("_p", "name")).join(names.select("name").distinct(), "name").groupBy("_id").agg(F.min_by("name", "_p").alias("_name"))
    out = m.join(once, "_id", "left").withColumn("joined", F.coalesce("_name", "head")).withColumn("dropped_head", F.array_contains(dropped, F.col("head")))
    return out.drop("_h", "_kept", "_try", "_id", "_name")


def vocabulary(mentions: DataFrame, column: str = "joined") -> DataFrame:
    """(kind, string, mentions, studies) of a column, less mentions whose head is on a drop list."""
    return mentions.where("NOT dropped_head").groupBy("kind", F.col(column).alias("string")).agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("study_id").alias("studies"))


def vocabulary_summary(mentions: DataFrame, levels: Sequence[float], gate: tuple[str, float, int]) -> DataFrame:
    """(kind, strings, mentions, level, needed, passed): per kind how many strings cover each level of its mentions; passed is
    for the gate's kind and level: whether at most so many strings are needed, else null."""
    table = vocabulary(mentions)
    size = table.groupBy("kind").agg(F.count(F.lit(1)).alias("strings"), F.sum("mentions").alias("mentions"))
    curve = coverage_curve(table, ["kind"], "string", "mentions", levels)
    kind, level, most = gate
    at_gate = (F.col("kind") == kind) & (F.abs(F.col("level") - level) < 1e-9)
    return size.join(curve, "kind").withColumn("passed", F.when(at_gate, F.col("needed") <= most)).select("kind", "strings", "mentions", "level", "needed", "passed")


def located_pairs(mentions: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """(study_id, section, entity, obs, anat): an Observation (of ``strings``, column string) and each Anatomy it is located at."""
    kept = mentions.where("NOT dropped_head")
    obs = kept.where("kind = 'Observation'")
    if strings is not None:
        obs = obs.join(strings.select(F.col("string").alias("joined")).distinct(), "joined", "left_semi")
    at = obs.select(*KEY, F.col("joined").alias("obs"), F.explode("located_at").alias("at"))
    anat = kept.where("kind = 'Anatomy'").select("study_id", "section", F.col("entity").alias("at"), F.col("joined").alias("anat"))
    return at.join(anat, ["study_id", "section", "at"]).select(*KEY, "obs", "anat")


def context(pairs: DataFrame, most: int = 5) -> DataFrame:
    """(side, string, other, n, place): the most frequent partners of every observation and anatomy, ties by name."""
    n = pairs.groupBy("obs", "anat").agg(F.count(F.lit(1)).alias("n"))
    side = lambda name, a, b: n.select(F.lit(name).alias("side"), F.col(a).alias("string"), F.col(b).alias("other"), "n")
    both = side("Observation", "obs", "anat").unionByName(side("Anatomy", "anat", "obs"))
    w = Window.partitionBy("side", "string").orderBy(F.col("n").desc(), "other")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def frequent_pairs(pairs: DataFrame, coverage: float, most: int) -> DataFrame:
    """(obs, anat, n, share): per observation its most frequent anatomies until they cover a share, at most ``most``."""
    n = pairs.groupBy("obs", "anat").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("obs").orderBy(F.col("n").desc(), "anat")
    total = n.groupBy("obs").agg(F.sum("n").alias("_t"))
    head = n.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)  # what lies beyond never counts
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.col("_t")
    return head.join(total, "obs").withColumn("_b", before).where(F.col("_b") < coverage).select("obs", "anat", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def mention_concepts(mentions: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(study_id, section, entity, kind, polarity, cui, located_at, suggests): a located Observation takes the concept of its
    pair link, the smallest of several, else its string's; mentions without a concept are left out. links: (kind,
    string, cui); pairs: (obs, anat, cui)."""
    kept = mentions.where("NOT dropped_head")
    one = links.where("cui IS NOT NULL").select("kind", F.col("string").alias("joined"), "cui")
    linked = pairs.where("cui IS NOT NULL").select("obs", "anat", F.col("cui").alias("_pair"))
    paired = located_pairs(mentions).join(linked, ["obs", "anat"]).groupBy(*KEY).agg(F.min("_pair").alias("_pair"))
    out = kept.join(one, ["kind", "joined"], "left").join(paired.withColumn("kind", F.lit("Observation")), [*KEY, "kind"], "left")
    return out.withColumn("cui", F.coalesce("_pair", "cui")).where("cui IS NOT NULL").select(*KEY, "kind", "polarity", "cui", "located_at", "suggests")


def related_concepts(found: DataFrame, column: str, target_kind: str) -> DataFrame:
    """(study_id, src, dst) of present Observations and the concepts they point to by ``located_at`` or ``suggests``."""
    src = found.where("kind = 'Observation' AND polarity = 'present'").select("study_id", "section", F.col("cui").alias("src"), F.explode(column).alias("_t"))
    dst = found.where(F.col("kind") == target_kind).select("study_id", "section", F.col("entity").alias("_t"), F.col("cui").alias("dst"))
    return src.join(dst, ["study_id", "section", "_t"]).select("study_id", "src", "dst")


def silver_status(found: DataFrame, concepts: DataFrame) -> DataFrame:
    """(study_id, concept, status): the strongest polarity that a study gives a concept or any concept below it; what it doesn't
    mention isn't listed. found: (study_id, cui, polarity); concepts: (concept, cui), each with its descendants."""
    rank = F.when(F.lower("polarity") == "present", 1).when(F.lower("polarity") == "uncertain", 2).when(F.lower("polarity") == "absent", 3)
    best = found.withColumn("_r", rank).where("_r IS NOT NULL").join(concepts.distinct(), "cui").groupBy("study_id", "concept").agg(F.min("_r").alias("_r"))
    return best.select("study_id", "concept", F.element_at(F.array(*map(F.lit, ("PRESENT", "UNCERTAIN", "ABSENT"))), F.col("_r")).alias("status"))


def pool_strings(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cui, string, mentions): strings of single links and phrases of pair links, counts of the same added up."""
    both = links.where("cui IS NOT NULL").select("cui", "string", "mentions").unionByName(pairs.where("cui IS NOT NULL").select("cui", F.col("phrase").alias("string"), F.col("n").alias("mentions")))
    return both.groupBy("cui", "string").agg(F.sum("mentions").alias("mentions"))


def pair_share(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(string, mentions, located, linked): of every Observation string its mentions, those located somewhere, and those with
    a located pair that has a concept. pairs: (obs, anat, cui)."""
    total = mentions.where("kind = 'Observation' AND NOT dropped_head").groupBy(F.col("joined").alias("string")).agg(F.count(F.lit(1)).alias("mentions"))
    at = located_pairs(mentions).join(pairs.where("cui IS NOT NULL").select("obs", "anat").distinct().withColumn("_l", F.lit(1)), ["obs", "anat"], "left")
    per = at.groupBy(F.col("obs").alias("string"), *KEY).agg(F.max("_l").alias("_l")).groupBy("string").agg(F.count(F.lit(1)).alias("located"), F.count("_l").alias("linked"))
    return total.join(per, "string", "left").select("string", "mentions", F.coalesce("located", F.lit(0)).alias("located"), F.coalesce("linked", F.lit(0)).alias("linked"))
