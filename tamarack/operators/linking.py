"""Linking of strings to concepts of a terminology: domains, exact names, preferred names, pairs, decisions, gates.

A terminology is three tables: names (cui, text, source, preferred boolean), types (cui, type) and relations (parent,
child). Kinds are a small table (kind, type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import name_norm
from tamarack.operators.evaluate import wilson
from tamarack.operators.graph import steps


def source_rank(order: Sequence[str], c: str = "source") -> Column:
    """Place of a source in an order of preference; those not in it come last, alike."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(c)).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(order))


def domain(types: DataFrame, kinds: DataFrame, names: DataFrame, code_sources: Sequence[str], relations: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, cui): concepts of a kind's types that have a name outside the code systems, unless they lie below one of the
    kind's negative roots and below none of its positive ones; a root lies below itself. roots: (kind, cui, sign + or -)."""
    table = types.join(F.broadcast(kinds), "type").select("kind", "cui").distinct()
    named = names.where(~F.coalesce(F.col("source").isin(*code_sources), F.lit(False))).select("cui").distinct()
    seeds = roots.select(F.concat_ws("|", "kind", "sign").alias("seed"), F.col("cui").alias("node")).distinct()
    below = steps(relations.select(F.col("parent").alias("a"), F.col("child").alias("b")), seeds).select("seed", "node").unionByName(seeds).distinct()
    part = below.select(F.split_part("seed", F.lit("|"), F.lit(1)).alias("kind"), F.split_part("seed", F.lit("|"), F.lit(2)).alias("sign"), F.col("node").alias("cui"))
    dropped = part.where("sign = '-'").drop("sign").join(part.where("sign = '+'").drop("sign"), ["kind", "cui"], "left_anti")
    return table.join(named, "cui", "left_semi").join(dropped, ["kind", "cui"], "left_anti").select("kind", "cui")


def domain_sizes(types: DataFrame, kinds: DataFrame, inside: DataFrame) -> DataFrame:
    """(kind, label_table, domain): how many concepts a kind's types have and how many of them the domain keeps."""
    table = types.join(F.broadcast(kinds), "type").select("kind", "cui").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("label_table"))
    return table.join(inside.groupBy("kind").agg(F.count(F.lit(1)).alias("domain")), "kind", "left").select("kind", "label_table", F.coalesce("domain", F.lit(0)).alias("domain"))


def exact_matches(queries: DataFrame, names: DataFrame, inside: DataFrame) -> DataFrame:
    """(kind, query, cui, rank, n_candidates): concepts of the kind's domain that have the query (a normalised name) as a name:
    those that prefer it first, then those that more sources name, then by code."""
    met = names.select("cui", name_norm("text").alias("query"), "preferred").join(queries.select("kind", "query").distinct(), "query").join(inside, ["kind", "cui"])
    per = met.groupBy("kind", "query", "cui").agg(F.bool_or(F.coalesce("preferred", F.lit(False))).alias("_p"))
    sources = names.join(per.select("cui").distinct(), "cui", "left_semi").groupBy("cui").agg(F.countDistinct("source").alias("_n"))
    w = Window.partitionBy("kind", "query")
    return per.join(sources, "cui").withColumn("rank", F.row_number().over(w.orderBy(F.col("_p").desc(), F.col("_n").desc(), "cui"))).withColumn("n_candidates", F.count(F.lit(1)).over(w)).select("kind", "query", "cui", "rank", "n_candidates")


def outside(queries: DataFrame, names: DataFrame, types: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, query): queries that are names, but only of concepts without a type of any kind."""
    met = names.select("cui", name_norm("text").alias("query")).join(queries.select("kind", "query").distinct(), "query")
    typed = types.join(F.broadcast(kinds.select("type").distinct()), "type", "left_semi").select("cui").distinct()
    return met.select("kind", "query").distinct().join(met.join(typed, "cui", "left_semi").select("kind", "query"), ["kind", "query"], "left_anti")


def label_candidates(forms: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(label, cui, own, n_forms, rank): concepts named like a label's forms, best first: by its own name, by more forms, by a
    preferred name, by more sources, by code. forms: (label, form normalised, own boolean)."""
    met = names.select("cui", name_norm("text").alias("form"), "preferred").join(forms, "form")
    per = met.groupBy("label", "cui").agg(F.bool_or("own").alias("own"), F.countDistinct("form").alias("n_forms"), F.bool_or(F.coalesce("preferred", F.lit(False))).alias("_p"))
    n = names.groupBy("cui").agg(F.countDistinct("source").alias("_n"))
    w = Window.partitionBy("label").orderBy(F.col("own").desc(), F.col("n_forms").desc(), F.col("_p").desc(), F.col("_n").desc(), "cui")
    return per.join(n, "cui").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("label", "cui", "own", "n_forms", "rank")


def describe(names: DataFrame, types: DataFrame, order: Sequence[str]) -> DataFrame:
    """(cui, name, n_sources, sources, types): the name of the first in the order preferred or not, source, name; the sources
    and types as sorted lists."""
    name = F.min_by("text", F.struct((~F.coalesce("preferred", F.lit(False))).alias("a"), source_rank(order).alias("b"), F.col("source").alias("c"), F.col("text").alias("d")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = names.groupBy("cui").agg(name.alias("name"), F.countDistinct("source").alias("n_sources"), joined("source").alias("sources"))
    return told.join(types.groupBy("cui").agg(joined("type").alias("types")), "cui", "left").select("cui", "name", "n_sources", "sources", "types")


def sided(text: Column, sides: Sequence[str]) -> Column:
    """Whether a text has a word that tells a side."""
    return F.coalesce(F.arrays_overlap(F.split(name_norm(text), " "), F.array(*map(F.lit, sides))), F.lit(False))


def unlateralise(links: DataFrame, info: DataFrame, parents: DataFrame, inside: DataFrame, sides: Sequence[str]) -> DataFrame:
    """links (kind, string, cui, matched) with lateral_from and lateral_unresolved: a concept whose matched or preferred name
    tells a side moves to its parent without one in the kind's domain, if there is one such parent or one that is named
    like the matched name without the side; else it stays and is marked. parents: (cui, parent)."""
    named = info.select("cui", "name")
    base = links.join(named, "cui", "left").withColumn("_lat", F.col("cui").isNotNull() & (sided(F.col("matched"), sides) | sided(F.col("name"), sides))).drop("name")
    words = F.filter(F.split(F.coalesce("matched", F.lit("")), " "), lambda w: ~w.isin(*sides))
    options = (
        base.where("_lat").select("kind", "string", "cui", F.array_join(words, " ").alias("_bare")).join(parents.distinct(), "cui")
        .join(named.select(F.col("cui").alias("parent"), F.col("name").alias("_pn")), "parent", "left").join(inside.select("kind", F.col("cui").alias("parent")), ["kind", "parent"], "left_semi").where(~sided(F.col("_pn"), sides))
    )
    like = F.coalesce(name_norm("_pn") == F.col("_bare"), F.lit(False))
    pick = options.groupBy("kind", "string").agg(F.count(F.lit(1)).alias("_n"), F.min("parent").alias("_one"), F.count_if(like).alias("_k"), F.min(F.when(like, F.col("parent"))).alias("_like"))
    new = F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_k") == 1, F.col("_like"))
    out = base.join(pick, ["kind", "string"], "left").withColumn("_new", F.when(F.col("_lat"), new))
    return out.select(*[c for c in links.columns if c != "cui"], F.coalesce("_new", "cui").alias("cui"), F.when(F.col("_new").isNotNull(), F.col("cui")).alias("lateral_from"), (F.col("_lat") & F.col("_new").isNull()).alias("lateral_unresolved"))


def pair_links(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """(obs, anat, n, phrase, cui, n_candidates): the first of ``anat obs`` and ``obs anat`` that is a name. exact: as of
    exact_matches, of kind Observation."""
    best = exact.where("kind = 'Observation' AND rank = 1").select(F.col("query").alias("phrase"), "cui", "n_candidates")
    tried = pairs.select("obs", "anat", "n", F.posexplode(F.array(F.concat_ws(" ", "anat", "obs"), F.concat_ws(" ", "obs", "anat"))).alias("_p", "phrase")).join(best, "phrase")
    first = tried.groupBy("obs", "anat").agg(F.min_by(F.struct("phrase", "cui", "n_candidates"), "_p").alias("m")).select("obs", "anat", "m.*")
    return pairs.select("obs", "anat", "n").join(first, ["obs", "anat"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def descriptive_pairs(pairs: DataFrame, words: Sequence[str], heads: DataFrame) -> DataFrame:
    """(obs, anat, n, string): pairs of descriptive words without a concept, as phrases that aren't strings of their own."""
    rows = pairs.where(F.col("obs").isin(*words) & F.col("cui").isNull()).select("obs", "anat", "n", F.concat_ws(" ", "obs", "anat").alias("string"))
    return rows.join(heads.select("string").distinct(), "string", "left_anti")


def override(rows: DataFrame, hand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the concept set by hand where there is one; hand: (*keys, cui), null for none."""
    h = hand.select(*keys, F.col("cui").alias("_c"), F.lit(True).alias("_by_hand"))
    return rows.join(h, list(keys), "left").withColumn("cui", F.when(F.col("_by_hand"), F.col("_c")).otherwise(F.col("cui"))).drop("_c", "_by_hand")


def adjudication_problems(decided: DataFrame, names: DataFrame, types: DataFrame, kinds: DataFrame, inside: DataFrame) -> DataFrame:
    """(kind, string, cui, problem) of hand decisions that are unknown, of no type of the kind, or outside its domain."""
    d = decided.where("cui IS NOT NULL")
    for name, table, keys in (("_k", names.select("cui"), ["cui"]), ("_t", types.join(F.broadcast(kinds), "type").select("kind", "cui"), ["kind", "cui"]), ("_d", inside.select("kind", "cui"), ["kind", "cui"])):
        d = d.join(table.distinct().withColumn(name, F.lit(True)), keys, "left")
    why = F.when(F.col("_k").isNull(), "unknown").when(F.col("_t").isNull(), "wrong type").when(F.col("_d").isNull(), "outside domain")
    return d.withColumn("problem", why).where("problem IS NOT NULL").select("kind", "string", "cui", "problem")


def link_coverage(links: DataFrame, undecided: Sequence[str] = ("none", "pending")) -> DataFrame:
    """(kind, decided, linked): shares of mentions that are decided and that have a concept, per kind and over all (null)."""
    m = F.sum("mentions")
    part = lambda c: F.round(F.sum(F.when(c, F.col("mentions")).otherwise(0)) / m, 6)
    return links.groupingSets([["kind"], []], "kind").agg(part(~F.col("decision").isin(*undecided)).alias("decided"), part(F.col("cui").isNotNull()).alias("linked"))


def method_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("kind", "method").agg(F.count(F.lit(1)).alias("strings"), F.sum("mentions").alias("mentions"))


def model_agreement(links: DataFrame) -> DataFrame:
    """(kind, answered, agree) of strings that both models answered."""
    return links.where("agree IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("answered"), F.count_if("agree").alias("agree"))


def phrase_rates(links: DataFrame, phrases: DataFrame, expected: DataFrame) -> DataFrame:
    """(label, strings, linked, ok): of the Observation strings that are a label's phrases how many have a concept and how many
    an expected one, per label and over all (null). phrases: (label, string); expected: (label, cui)."""
    rows = links.where("kind = 'Observation'").select("string", "cui").join(phrases.distinct(), "string").join(expected.select("label").distinct(), "label", "left_semi")
    ok = rows.join(expected.distinct().withColumn("_ok", F.lit(1)), ["label", "cui"], "left")
    return ok.groupingSets([["label"], []], "label").agg(F.count(F.lit(1)).alias("strings"), F.count("cui").alias("linked"), F.count("_ok").alias("ok"))


def link_flags(links: DataFrame, info: DataFrame, kinds: DataFrame, *, thin: Sequence[str], words: Sequence[str], skipped: Sequence[str]) -> DataFrame:
    """links with flags, joined by semicolons: thin_sources (named by these sources only), off_domain_word, type_mismatch,
    skip_listed, lateral_unresolved."""
    of_kind = kinds.groupBy("kind").agg(F.collect_set("type").alias("_kt"))
    rows = links.join(info.select("cui", "name", "sources", "types"), "cui", "left").join(F.broadcast(of_kind), "kind", "left")
    known = F.col("cui").isNotNull() & F.col("sources").isNotNull()
    rules = (
        ("thin_sources", known & (F.size(F.array_except(F.split("sources", ","), F.array(*map(F.lit, thin)))) == 0)), ("off_domain_word", known & sided(F.col("name"), words)),
        ("type_mismatch", known & ~F.coalesce(F.arrays_overlap(F.split(F.coalesce("types", F.lit("")), ","), F.col("_kt")), F.lit(False))),
        ("skip_listed", F.col("cui").isNotNull() & F.col("string").isin(*skipped)), ("lateral_unresolved", F.coalesce("lateral_unresolved", F.lit(False))),
    )
    flags = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))), ";")
    return rows.select(*links.columns, flags.alias("flags"))


def review_order(links: DataFrame) -> list[Column]:
    """The order of a review: what the models disagree on, then flagged rows, then the rest by kind and mentions."""
    return [F.when(F.col("method") == "llm_disagree", 0).when(F.coalesce("flags", F.lit("")) != "", 1).otherwise(2), F.col("kind"), F.col("mentions").desc(), F.col("string")]


def judge_items(sample: DataFrame) -> DataFrame:
    """(kind, string, which, cui): the link of every sampled string and, where it differs, the nearest concept."""
    return sample.select("kind", "string", F.explode(F.map_from_arrays(F.array(F.lit("link"), F.lit("argmax")), F.array("link_cui", "argmax_cui"))).alias("which", "cui"), F.col("link_cui").alias("_l")).where("which = 'link' OR NOT (cui <=> _l)").drop("_l")


def apply_grades(items: DataFrame, grades: DataFrame) -> DataFrame:
    """Items with their grade; those nobody answered keep null."""
    return items.join(grades.select("kind", "string", "which", "grade"), ["kind", "string", "which"], "left")


def precision(graded: DataFrame, grade: str, weight: str = "mentions") -> DataFrame:
    """(correct, graded, unsure, precision, low, high, by_mentions): correct of correct and incorrect, with Wilson's interval, and
    the same weighted by mentions."""
    right, wrong = F.col(grade) == "correct", F.col(grade) == "incorrect"
    s = graded.agg(F.count_if(right).alias("correct"), F.count_if(right | wrong).alias("graded"), F.count_if(F.col(grade) == "unsure").alias("unsure"), F.sum(F.when(right, F.col(weight)).otherwise(0)).alias("_r"), F.sum(F.when(right | wrong, F.col(weight)).otherwise(0)).alias("_t"))
    low, high = wilson(F.col("correct"), F.col("graded"))
    return s.select("correct", "graded", "unsure", F.round(F.try_divide("correct", "graded"), 6).alias("precision"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(F.try_divide("_r", "_t"), 6).alias("by_mentions"))


def link_gate(measured: DataFrame, decided: float, least_precision: float, least_coverage: float) -> DataFrame:
    return measured.withColumn("passed", F.coalesce(F.col("precision") >= least_precision, F.lit(False)) & F.lit(decided >= least_coverage))


def selection_inputs(strings: DataFrame, candidates: DataFrame, info: DataFrame, context: DataFrame) -> DataFrame:
    """(kind, string, input): one JSON text per string with its candidates, by rank, and its frequent partners."""
    c = candidates.join(info.select("cui", "name", "types"), "cui", "left").groupBy("kind", "string").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cui", "name", "types"))), lambda x: F.struct(x["cui"].alias("cui"), x["name"].alias("name"), x["types"].alias("types"))).alias("candidates"))
    p = context.groupBy(F.col("side").alias("kind"), "string").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other", "n"))), lambda x: F.struct(x["other"].alias("string"), x["n"].alias("n"))).alias("partners"))
    rows = strings.join(c, ["kind", "string"], "left").join(p, ["kind", "string"], "left")
    return rows.select("kind", "string", F.to_json(F.struct("string", "kind", "mentions", "partners", "candidates")).alias("input"))


def checked_choices(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(kind, string, decision, cui): an answer that names a concept that isn't a candidate is ``rejected``."""
    ok = candidates.select("kind", "string", "cui").distinct().withColumn("_ok", F.lit(True))
    rows = answers.join(ok, ["kind", "string", "cui"], "left")
    bad = F.col("cui").isNotNull() & F.col("_ok").isNull()
    return rows.select("kind", "string", F.when(bad, "rejected").otherwise(F.col("decision")).alias("decision"), F.when(~bad, F.col("cui")).alias("cui"))


def agreed_choices(first: DataFrame, second: DataFrame, hand: DataFrame) -> DataFrame:
    """(kind, string, via, agree, cui): what was adjudicated, else what two models agree on; agree is null unless both answered."""
    keys = ["kind", "string"]
    a, b = first.select(*keys, F.col("decision").alias("_d1"), F.col("cui").alias("_c1")), second.select(*keys, F.col("decision").alias("_d2"), F.col("cui").alias("_c2"))
    h = hand.select(*keys, F.col("cui").alias("_h"), F.lit(True).alias("_hand"))
    rows = a.join(b, keys, "full").join(h, keys, "full")
    agree = F.when(F.col("_d1").isNotNull() & F.col("_d2").isNotNull(), (F.col("_d1") == F.col("_d2")) & F.col("_c1").eqNullSafe(F.col("_c2")) & (F.col("_d1") != "rejected"))
    by_hand, both = F.coalesce("_hand", F.lit(False)), F.coalesce(agree, F.lit(False))
    return rows.select(*keys, F.when(by_hand, "adjudicated").when(both, "llm").alias("via"), agree.alias("agree"), F.when(by_hand, F.col("_h")).when(both, F.col("_c1")).alias("cui"))
