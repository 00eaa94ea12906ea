"""Building of the concept graph: growth of the core, edges of several producers, nodes, aliases, routes, checks.

Edges have one schema: src, rel, dst, source, n, n_src, p, review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import name_norm, word_norm
from tamarack.operators.graph import kept, steps
from tamarack.operators.linking import sided, source_rank

# fixed value: the schema of edges
EDGE = {"src": "string", "rel": "string", "dst": "string", "source": "string", "n": "bigint", "n_src": "bigint", "p": "double", "review": "string"}


def as_edges(df: DataFrame) -> DataFrame:
    """A producer's rows under the edges' schema; columns it lacks are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EDGE.items()])


def edge_union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [as_edges(p) for p in parts])


def core_set(spark: SparkSession, links: DataFrame, pairs: DataFrame, mapping: Mapping[str, Mapping], extra: Sequence[str]) -> DataFrame:
    """(cui, kind): linked concepts, those of pairs (Observation), and those of the labels' mapping (id, is_a, children) and
    of ``extra``."""
    told = [c for e in mapping.values() for c in (e["id"], e.get("is_a"), *e.get("children", ())) if c] + list(extra)
    fixed = spark.createDataFrame([(c, "Observation") for c in told], "cui string, kind string")
    return links.where("cui IS NOT NULL").select("cui", "kind").unionByName(pairs.where("cui IS NOT NULL").select("cui", F.lit("Observation").alias("kind"))).unionByName(fixed).distinct()


def grow(core: DataFrame, inside: DataFrame, findings: DataFrame, parts: DataFrame, is_a: DataFrame, names: DataFrame, *, anatomy_depth: int, down: int, up: int, stop: DataFrame, sides: Sequence[str]) -> DataFrame:
    """(cui, kind, in_core): the core and what it grows to inside the domain: anatomies along parts both ways, findings along
    the hierarchy down and up, never into ``stop`` on the way up. Grown concepts whose name tells a side are left out.
    core, inside: (cui, kind); findings: (cui); parts, is_a: (parent, child); names: (cui, name); stop: (node)."""

    def reach(links: DataFrame, a: str, b: str, kind: str, start: DataFrame, allowed: DataFrame, depth: int, barred: DataFrame | None = None) -> DataFrame:
        seeds = start.select(F.lit(kind).alias("seed"), F.col("cui").alias("node"))
        return steps(links.select(F.col(a).alias("a"), F.col(b).alias("b")), seeds, depth, allowed=allowed.select(F.col("cui").alias("node")), stop=barred).select(F.col("node").alias("cui"), F.lit(kind).alias("kind"))

    anatomy, observed = inside.where("kind = 'Anatomy'"), inside.where("kind = 'Observation'").join(findings, "cui", "left_semi")
    a0, o0 = core.where("kind = 'Anatomy'"), core.where("kind = 'Observation'").join(findings, "cui", "left_semi")
    grown = reach(parts, "parent", "child", "Anatomy", a0, anatomy, anatomy_depth).unionByName(reach(parts, "child", "parent", "Anatomy", a0, anatomy, anatomy_depth))
    grown = grown.unionByName(reach(is_a, "parent", "child", "Observation", o0, observed, down)).unionByName(reach(is_a, "child", "parent", "Observation", o0, observed, up, stop)).distinct()
    lateral = names.where(sided(F.col("name"), sides)).select("cui").distinct()
    new = grown.join(lateral, "cui", "left_anti").join(core.select("cui", "kind"), ["cui", "kind"], "left_anti").withColumn("in_core", F.lit(False))
    return core.select("cui", "kind").distinct().withColumn("in_core", F.lit(True)).unionByName(new)


def node_table(grown: DataFrame, info: DataFrame, types: DataFrame, labels: Mapping[str, Sequence[str]], mapping: Mapping[str, str], own_labels: Mapping[str, str], n_pool: DataFrame) -> DataFrame:
    """(cui, name, labels, sty, label, scorable, n_pool, in_core): a row per concept, in the core if any of its kinds is. labels
    follow its types; a concept of one's own takes ``own_labels``; mapping: {label: cui} of the scorable ones."""
    spark = grown.sparkSession
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows or [(None, None)], schema))
    by = grown.groupBy("cui").agg(F.bool_or("in_core").alias("in_core"))
    t = types.distinct().join(small([(t, k) for k, ts in labels.items() for t in ts], "type string, _l string"), "type", "left")
    sty = t.groupBy("cui").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("sty"), F.array_join(F.array_sort(F.collect_set("_l")), ",").alias("_labels"))
    rows = by.join(info.select("cui", "name"), "cui", "left").join(sty, "cui", "left").join(n_pool, "cui", "left")
    rows = rows.join(small([(c, k) for c, k in own_labels.items()], "cui string, _own string"), "cui", "left").join(small([(c, k) for k, c in mapping.items()], "cui string, label string"), "cui", "left")
    return rows.select("cui", F.coalesce("name", "label", "cui").alias("name"), F.coalesce("_own", "_labels").alias("labels"), F.coalesce("sty", F.lit("")).alias("sty"), "label", F.col("label").isNotNull().alias("scorable"), F.coalesce("n_pool", F.lit(0)).alias("n_pool"), "in_core")


def hierarchy_edges(relations: DataFrame, nodes: DataFrame, rel: str) -> DataFrame:
    """Edges child to parent between two different nodes; source lists those that state it, sorted. relations: (parent, child,
    source)."""
    have = nodes.select("cui").distinct()
    inner = relations.where("parent <> child").join(have.withColumnRenamed("cui", "parent"), "parent", "left_semi").join(have.withColumnRenamed("cui", "child"), "child", "left_semi")
    return as_edges(inner.groupBy(F.col("child").alias("src"), F.col("parent").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source")).withColumn("rel", F.lit(rel)))


def hand_edges(spark: SparkSession, is_a: Sequence[tuple[str, str]], suggests: Mapping[str, Sequence[str]]) -> DataFrame:
    """Edges written by hand: child to parent, and the findings of a disease with equal weights, rounded to 4."""
    rows = [(c, "IS_A", p, "manual", None) for c, p in is_a] + [(f, "SUGGESTS", d, "manual", round(1 / len(fs), 4)) for d, fs in suggests.items() for f in fs]
    return as_edges(spark.createDataFrame(rows, "src string, rel string, dst string, source string, p double"))


def label_edges(spark: SparkSession, mapping: Mapping[str, Mapping], hierarchy: Mapping[str, str], generic: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing): IS_A of the labels' mapping (id, is_a, children), of the hierarchy {child label: parent label}, and of
    generic strings (label, string) through their linked concept; missing are the strings without one."""
    ids = {label: e["id"] for label, e in mapping.items()}
    told = [(e["id"], e["is_a"]) for e in mapping.values() if e.get("is_a")] + [(c, e["id"]) for e in mapping.values() for c in e.get("children", ())] + [(ids[c], ids[p]) for c, p in hierarchy.items()]
    fixed = spark.createDataFrame(told or [("", "")], "src string, dst string")
    names = F.broadcast(spark.createDataFrame(list(ids.items()), "label string, dst string"))
    linked = links.where("kind = 'Observation' AND cui IS NOT NULL").select("string", F.col("cui").alias("src"))
    met = generic.join(linked, "string", "left")
    rows = fixed.unionByName(met.where("src IS NOT NULL").join(names, "label").select("src", "dst")).where("src <> dst").distinct()
    return as_edges(rows.withColumn("rel", F.lit("IS_A")).withColumn("source", F.lit("labels"))), met.where("src IS NULL").select("string").distinct()


def says(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a normalised text holds one of the phrases, word for word."""
    padded = F.concat(F.lit(" "), name_norm(text), F.lit(" "))
    return reduce(lambda a, b: a | b, [F.contains(padded, F.lit(f" {p} ")) for p in phrases], F.lit(False))


def device_groups(devices: DataFrame, texts: DataFrame, phrases: Sequence[str], children: Sequence[str]) -> DataFrame:
    """(cui, support): devices that are named by one of the phrases, in any text (cui, text), or are ``children``."""
    named = texts.where(says(F.col("text"), phrases)).select("cui").distinct().withColumn("_n", F.lit(True))
    return devices.select("cui").distinct().join(named, "cui", "left").select("cui", (F.coalesce("_n", F.lit(False)) | F.col("cui").isin(*children) if children else F.coalesce("_n", F.lit(False))).alias("support"))


def alias_table(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(cui, text, norm, lang, source): one alias per concept, norm and language: of the first source in ``order``, then the first
    text. norm is the words of any script in lower case."""
    norm = rows.withColumn("norm", word_norm("text")).where("norm <> ''")
    return norm.groupBy("cui", "norm", "lang").agg(F.min_by(F.struct("text", "source"), F.struct(source_rank(order), "text")).alias("m")).select("cui", "m.text", "norm", "lang", "m.source")


def first_alias(aliases: DataFrame, order: Sequence[str], most: int = 1) -> DataFrame:
    """(cui, text, place): the first aliases of each concept by source, length and text."""
    w = Window.partitionBy("cui").orderBy(source_rank(order), F.length("text"), "text")
    return aliases.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("cui", "text", "place")


def alias_flags(aliases: DataFrame, blocked: Sequence[str]) -> DataFrame:
    """(cui, norm, flags): ``ambiguous`` if several concepts have the name, ``short`` below three letters, ``blocked``."""
    owners = aliases.select("norm", "cui").distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("_n"))
    rules = ((F.col("norm").isin(*blocked) if blocked else F.lit(False), "blocked"), (F.col("_n") > 1, "ambiguous"), (F.length("norm") < 3, "short"))
    return aliases.select("cui", "norm").distinct().join(owners, "norm").select("cui", "norm", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])), ";").alias("flags"))


def parents_of(links: DataFrame, concepts: DataFrame, most: int = 3) -> DataFrame:
    """(cui, parents): up to ``most`` parents in order, none is an empty array. links: (child, parent)."""
    up = concepts.select("cui").distinct().join(links.select(F.col("child").alias("cui"), "parent").distinct(), "cui", "left")
    return up.groupBy("cui").agg(F.slice(F.array_sort(F.collect_set("parent")), 1, most).alias("parents"))


def strongest_edges(edges: DataFrame, rel: str, most: int) -> DataFrame:
    """The edges to review first: by n, then p, then their ends."""
    return edges.where(F.col("rel") == rel).orderBy(F.col("n").desc_nulls_last(), F.col("p").desc_nulls_last(), "src", "dst").limit(most)


def predicted_edges(scores: DataFrame, columns: Sequence[str], key: str, most: int) -> DataFrame:
    """(image, concept, logit, rank): the best scored images of every concept, equal scores by key."""
    long = scores.select(F.col(key).alias("image"), *columns).unpivot(["image"], list(columns), "concept", "logit").where("logit IS NOT NULL AND NOT isnan(logit)")
    w = Window.partitionBy("concept").orderBy(F.col("logit").desc(), "image")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def write_graph(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, path: str) -> None:
    """The graph as tables: nodes, edges partitioned by relation, aliases."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")
    aliases.write.mode("overwrite").parquet(f"{path}/aliases")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, n): nodes by label (a node may have several) and edges by relation."""
    a = nodes.select(F.explode(F.split("labels", ",")).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    b = edges.groupBy(F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.select(F.lit("node").alias("what"), "name", "n").unionByName(b.select(F.lit("edge").alias("what"), "name", "n"))


def with_quality(nodes: DataFrame, quality: DataFrame) -> DataFrame:
    """Nodes with weak and borderline of their score column; nodes without one have null."""
    return nodes.join(quality.select("cui", "auroc_lenient", "weak", "borderline"), "cui", "left")


def candidate_cascade(nodes: DataFrame, strings: DataFrame, generic: Sequence[str], forced: Sequence[str], most: int, captions: int = 3) -> DataFrame:
    """(cui, n_pool, captions, status, reason): which concepts get a score column of their own. Excluded, in this order, are
    anatomies and devices, statements of normality, generic concepts and those nothing names; forced ones come first,
    then the most mentioned, ``most`` in all. strings: (cui, string, mentions)."""
    w = Window.partitionBy("cui").orderBy(F.col("mentions").desc(), "string")
    said = strings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= captions).groupBy("cui").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "string"))), lambda s: s["string"]).alias("captions"))
    rows = nodes.join(said, "cui", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))
    kinds = F.split(F.coalesce("labels", F.lit("")), ",")
    has = lambda *k: F.arrays_overlap(kinds, F.array(*map(F.lit, k)))
    normal = F.exists(F.concat(F.array(F.coalesce("name", F.lit(""))), F.col("captions")), lambda t: t.rlike(r"(?i)\bnormal\b"))
    reason = (
        F.when(has("Anatomy", "Device") | ~has("Finding", "Disease"), "anatomy or device").when(normal, "normal statement").when(F.col("cui").isin(*generic) if generic else F.lit(False), "generic").when(F.size("captions") == 0, "nothing names it").otherwise("")
    )
    rows = rows.withColumn("reason", reason)
    first = (F.col("cui").isin(*forced) if forced else F.lit(False)).cast("int")
    order = Window.orderBy(first.desc(), F.col("n_pool").desc(), "cui")
    # only the head of those that aren't excluded is ranked
    head = rows.where("reason = ''").orderBy(first.desc(), F.col("n_pool").desc(), "cui").limit(most + len(forced)).withColumn("_i", F.row_number().over(order)).where((F.col("_i") <= most) | (first == 1)).select("cui", F.lit(True).alias("_in"))
    taken = F.coalesce("_in", F.lit(False))
    return rows.join(head, "cui", "left").select("cui", "n_pool", "captions", F.when(taken, "candidate").otherwise("excluded").alias("status"), F.when(taken | (F.col("reason") != ""), F.col("reason")).otherwise(F.lit(f"beyond the first {most}")).alias("reason"))


def routes(nodes: DataFrame, below: DataFrame, above: DataFrame, suggested: DataFrame, typical: DataFrame, weak: DataFrame) -> DataFrame:
    """(cui, route): how a concept can be shown: direct, wider, narrower, suggests (diseases), typically_at (anatomies) or none. below,
    above, suggested, typical: (seed, cui); weak: (cui)."""
    strong = below.join(weak, "cui", "left_anti").select(F.col("seed").alias("cui")).distinct().withColumn("_b", F.lit(True))
    flag = lambda df, n: df.select(F.col("seed").alias("cui")).distinct().withColumn(n, F.lit(True))
    rows = nodes.join(strong, "cui", "left").join(flag(above, "_a"), "cui", "left").join(flag(suggested, "_s"), "cui", "left").join(flag(typical, "_t"), "cui", "left")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    has = lambda k: F.array_contains(F.split(F.coalesce("labels", F.lit("")), ","), k)
    return rows.select("cui", F.when(F.col("scorable"), "direct").when(is_("_b"), "wider").when(is_("_a"), "narrower").when(has("Disease") & is_("_s"), "suggests").when(has("Anatomy") & is_("_t"), "typically_at").otherwise("none").alias("route"))


def shadowing_forms(aliases: DataFrame, label_ids: DataFrame, closure: DataFrame, scorable: DataFrame) -> DataFrame:
    """(label, norm, child): forms of a label that are also a name of a scorable concept below it. closure: (seed, node)."""
    forms = aliases.join(label_ids.select("label", "cui"), "cui").select("label", F.col("cui").alias("seed"), "norm")
    child = aliases.join(scorable.select("cui"), "cui", "left_semi").select(F.col("cui").alias("node"), "norm")
    return forms.join(closure.select("seed", "node"), "seed").join(child, ["node", "norm"]).where("seed <> node").select("label", "norm", F.col("node").alias("child")).distinct()


def benchmark_catalog(nodes: DataFrame, quality: DataFrame, extra: Sequence[str]) -> DataFrame:
    """(cui, name, labels, column, weak): concepts with a score column, of the core, or named as extra."""
    rows = nodes.join(quality.select("cui", F.lit(True).alias("column"), "weak"), "cui", "left")
    keep = F.coalesce("column", F.lit(False)) | F.col("in_core") | (F.col("cui").isin(*extra) if extra else F.lit(False))
    return rows.where(keep).select("cui", "name", "labels", F.coalesce("column", F.lit(False)).alias("column"), "weak")


def weak_disagreements(expected: DataFrame, quality: DataFrame) -> DataFrame:
    """(qid, cui, stated, weak): expected columns whose weak flag isn't the quality table's. expected: (qid, cui, weak)."""
    return expected.select("qid", "cui", F.col("weak").alias("stated")).join(quality.select("cui", "weak"), "cui").where("NOT (stated <=> weak)").select("qid", "cui", "stated", "weak")


def path_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(concept, src, rel, dst): of a plan's parts (concept, column, weight) the kept edges from their columns into the concept, the
    strongest part first and each edge once."""
    met = parts.join(edges.where(kept()), (F.col("column") == F.col("src")) & (F.col("concept") == F.col("dst")))
    w = Window.partitionBy("concept").orderBy(F.col("weight").desc(), "src", "rel")
    return met.groupBy("concept", "src", "rel", "dst").agg(F.max("weight").alias("weight")).withColumn("place", F.row_number().over(w)).select("concept", "src", "rel", "dst", "place")


def load_checks(nodes: DataFrame, edges: DataFrame, columns: Sequence[str], expected_nodes: int) -> DataFrame:
    """(name, ok, detail): the graph has its nodes, every scored column a node, no edge an end that isn't there, no node two rows."""
    spark = nodes.sparkSession
    have = nodes.select("cui").distinct()
    n, unique = nodes.count(), have.count()
    asked = spark.createDataFrame([(c,) for c in columns] or [(None,)], "cui string").where("cui IS NOT NULL")
    lost = asked.join(have, "cui", "left_anti").count()
    ends = edges.where("rel <> 'HAS_STY'").select(F.explode(F.array("src", "dst")).alias("cui")).distinct().join(have, "cui", "left_anti").count()
    rows = [("node count", n == expected_nodes, f"{n} of {expected_nodes}"), ("score columns", lost == 0, f"{lost} without a node"), ("edge ends", ends == 0, f"{ends} missing"), ("unique nodes", n == unique, f"{n - unique} repeated")]
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")
