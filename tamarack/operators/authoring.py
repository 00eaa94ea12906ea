"""Tables that people and models write: validation of questions, mappings and overrides, verdicts, definitions, name dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import copied, is_vietnamese, strip_marks, word_norm, words
from tamarack.operators.linking import source_rank


def problems(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, problem): every rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("problem"))


def question_problems(questions: DataFrame, known: DataFrame, used: DataFrame) -> DataFrame:
    """(id, problem) of authored questions (id, question, lang, pair, cuis): blank, used before, no concept, unknown concepts, another
    language than stated, repeated, a pair without its other language."""
    text = F.coalesce("question", F.lit(""))
    flat = questions.select("id", F.explode_outer("cuis").alias("cui")).join(known.select("cui").distinct().withColumn("_k", F.lit(True)), "cui", "left")
    lost = flat.where("cui IS NOT NULL AND _k IS NULL").select("id").distinct().withColumn("_lost", F.lit(True))
    again = questions.groupBy(word_norm("question").alias("_norm")).agg(F.count(F.lit(1)).alias("_n"))
    langs = questions.where("pair IS NOT NULL").groupBy("pair").agg(F.countDistinct("lang").alias("_l"), F.count(F.lit(1)).alias("_p"))
    before = used.select(word_norm("question").alias("_norm")).distinct().withColumn("_used", F.lit(True))
    rows = questions.withColumn("_norm", word_norm("question")).join(again, "_norm", "left").join(before, "_norm", "left").join(lost, "id", "left").join(langs, "pair", "left")
    return problems(
        rows, "id",
        {
            "blank": F.trim(text) == "", "repeated": (F.col("_n") > 1) & (F.trim(text) != ""), "used before": F.col("_used"), "no concept": F.coalesce(F.size("cuis"), F.lit(0)) <= 0, "unknown concept": F.col("_lost"),
            "wrong language": (F.col("lang") == "en") & is_vietnamese("question"), "incomplete pair": F.col("pair").isNotNull() & ((F.col("_l") != 2) | (F.col("_p") != 2)),
        },
    )


def assign_ids(questions: DataFrame, start: int = 1) -> DataFrame:
    """questions (group, lang, question, pair_key) with id ``group-lang-number``, numbered per group and language by pair and question from
    ``start``, and pair, the id of the translation (null if there is none)."""
    w = Window.partitionBy("group", "lang").orderBy(F.col("pair_key").asc_nulls_last(), "question")
    rows = questions.withColumn("id", F.format_string("%s-%s-%03d", "group", "lang", F.row_number().over(w) + (start - 1)))
    other = rows.where("pair_key IS NOT NULL").select("group", "pair_key", F.col("lang").alias("_lang"), F.col("id").alias("pair"))
    return rows.join(other, (rows["group"] == other["group"]) & (rows.pair_key == other.pair_key) & (rows.lang != other["_lang"]), "left").select(rows["*"], "pair")


def extension_quotas(have: Mapping[str, Mapping[str, int]], total: int, languages: Sequence[str] = ("en", "vi")) -> dict[str, dict[str, int]]:
    """{group: {language: how many to add}} so that ``total`` are added, spread evenly over groups, and within each to the language that
    has fewer."""
    groups = sorted(have)
    out = {}
    for i, g in enumerate(groups):
        n = total // len(groups) + (i < total % len(groups))
        now = {lang: have[g].get(lang, 0) for lang in languages}
        add = dict.fromkeys(languages, 0)
        for _ in range(n):
            least = min(languages, key=lambda lang: (now[lang] + add[lang], languages.index(lang)))
            add[least] += 1
        out[g] = add
    return out


def mapping_problems(mapping: Mapping[str, Mapping], labels: Sequence[str]) -> list[str]:
    """What is wrong with a mapping of labels (id, is_a, children): labels that lack or that nobody knows, ids that are missing or used
    twice, own ids without a parent, parents that are their own child."""
    out = [f"{x}: not mapped" for x in labels if x not in mapping] + [f"{x}: unknown label" for x in mapping if x not in labels]
    seen: dict[str, str] = {}
    for label, e in mapping.items():
        name = e.get("id")
        if not name:
            out.append(f"{label}: no id")
            continue
        if name in seen:
            out.append(f"{label}: same id as {seen[name]}")
        seen.setdefault(name, label)
        if name.startswith("PRJ:") and not (e.get("is_a") or e.get("children")):
            out.append(f"{label}: own id without parent or children")
        if e.get("is_a") == name or name in e.get("children", ()) or e.get("is_a") and e["is_a"] in e.get("children", ()):
            out.append(f"{label}: its own ancestor")
    return out


def override_problems(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(string, problem) of overrides (kind, string, cui): unknown kind, blank string, ill-formed concept, two for one string."""
    n = Window.partitionBy("kind", "string")
    marked = rows.withColumn("_n", F.count(F.lit(1)).over(n))
    return problems(marked, "string", {"unknown kind": ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "blank": F.trim("string") == "", "ill-formed concept": F.col("cui").isNotNull() & ~F.col("cui").rlike(r"^(C\d{7,8}|PRJ:\w+)$"), "repeated": F.col("_n") > 1}).distinct()


def complete_verdicts(answers: DataFrame) -> DataFrame:
    """answers (key, asked array, verdicts map) with complete: whether every asked alias has exactly one verdict and nothing else has."""
    return answers.withColumn("complete", F.array_sort(F.array_distinct("asked")) == F.array_sort(F.map_keys("verdicts")))


def complete_batches(items: DataFrame, done: DataFrame) -> DataFrame:
    """(batch): those all of whose items (batch, key) have been done (key)."""
    d = done.select("key").distinct().withColumn("_d", F.lit(True))
    return items.join(d, "key", "left").groupBy("batch").agg(F.bool_and(F.coalesce("_d", F.lit(False))).alias("all")).where("all").select("batch")


def accepted_alias(agrees: Column, flags: Column) -> Column:
    """keep at once if the second model agrees and nothing is flagged, else wait."""
    return F.when(F.coalesce(agrees, F.lit(False)) & (F.coalesce(flags, F.lit("")) == ""), "keep").otherwise("wait")


def gloss_flags(gloss: Column, sources: Column, barred: Sequence[str], most: int, run: int) -> Column:
    """What speaks against a definition, joined by semicolons: blank, longer than ``most`` words, copied from a source (``run`` words in a
    row), barred words."""
    ws = words(gloss)
    said = F.arrays_overlap(ws, F.array(*map(F.lit, barred))) if barred else F.lit(False)
    rules = (("blank", F.trim(gloss) == ""), ("long", F.size(ws) > most), ("copied", F.exists(sources, lambda s: copied(ws, words(s), run))), ("barred", said))
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])), ";")


def usable_definitions(rows: DataFrame) -> DataFrame:
    """rows (cui, gloss, agreed, flags, decision) that may be shown: accepted by hand, or agreed on without a flag and not rejected."""
    d = F.coalesce("decision", F.lit(""))
    return rows.where((d == "accept") | ((d == "") & F.coalesce("agreed", F.lit(False)) & (F.coalesce("flags", F.lit("")) == "")))


def review_rows(rows: DataFrame, decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the decision there already is, and place: what isn't agreed on first, then by key."""
    merged = rows.join(decided.select(*keys, "decision"), list(keys), "left")
    return merged.withColumn("first", (~F.coalesce("agreed", F.lit(False))).cast("int")).orderBy(F.col("first").desc(), *keys).drop("first")


def knowledge_table(definitions: DataFrame, aliases: DataFrame, nodes: DataFrame, lang: str, not_from: str) -> DataFrame:
    """(cui, name, local, gloss): usable definitions with the concept's name and its longest alias of a language that isn't from a source."""
    local = aliases.where((F.col("lang") == lang) & (F.col("source") != not_from)).groupBy("cui").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("local"))
    return usable_definitions(definitions).join(nodes.select("cui", "name"), "cui").join(local, "cui", "left").select("cui", "name", "local", "gloss")


def definition_inputs(concepts: DataFrame, names: DataFrame, definitions: DataFrame, most_names: int, order: Sequence[str], most_definitions: int) -> DataFrame:
    """(cui, input): one JSON text per concept with its first names per language and its first definitions by source, length and text."""
    n = Window.partitionBy("cui", "lang").orderBy(F.length("text"), "text")
    named = names.withColumn("_r", F.row_number().over(n)).where(F.col("_r") <= most_names).groupBy("cui").agg(F.transform(F.array_sort(F.collect_list(F.struct("lang", "_r", "text"))), lambda x: F.struct(x["lang"].alias("lang"), x["text"].alias("text"))).alias("names"))
    d = Window.partitionBy("cui").orderBy(source_rank(order), F.length("text"), "text")
    told = definitions.withColumn("_r", F.row_number().over(d)).where(F.col("_r") <= most_definitions).groupBy("cui").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("definitions"))
    rows = concepts.select("cui").distinct().join(named, "cui", "left").join(told, "cui", "left")
    return rows.select("cui", F.to_json(F.struct("cui", "names", "definitions")).alias("input"))


def grounding_names(aliases: DataFrame, nodes: DataFrame, stop: Sequence[str]) -> DataFrame:
    """(norm, cuis): the names by which findings and diseases of the core are recognised in sentences, less stop words."""
    core = nodes.where("in_core").where(F.arrays_overlap(F.split(F.coalesce("labels", F.lit("")), ","), F.array(F.lit("Finding"), F.lit("Disease")))).select("cui")
    named = aliases.join(core, "cui", "left_semi").where(F.col("norm") != "")
    return (named.where(~F.col("norm").isin(*stop)) if stop else named).groupBy("norm").agg(F.array_sort(F.collect_set("cui")).alias("cuis"))


def unaccented_names(aliases: DataFrame, english: DataFrame) -> DataFrame:
    """(bare, norm): Vietnamese names of several words without their marks that stand for one name only and are no English name."""
    vi = aliases.where("lang = 'vi'").select("norm", strip_marks("norm").alias("bare")).where("bare <> norm AND bare LIKE '% %'").distinct()
    one = vi.groupBy("bare").agg(F.min("norm").alias("norm"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return one.join(english.select(F.col("norm").alias("bare")).distinct(), "bare", "left_anti")


def alias_search(found: DataFrame, most: int) -> DataFrame:
    """(query, cui, text, score, rank): of the nearest aliases (query, cui, text, score) one per concept, its best, the best concepts first."""
    one = Window.partitionBy("query", "cui").orderBy(F.col("score").desc(), "text")
    best = found.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "cui")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def facts_json(question: Column, results: Column, knowledge: Column) -> Column:
    """The facts of an answer as one JSON text."""
    return F.to_json(F.struct(question.alias("question"), results.alias("results"), knowledge.alias("knowledge")))
