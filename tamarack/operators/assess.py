"""Evaluation of parsers, runs and answers: relevance by labels, metrics per query, means by scope, differences.

Gold queries are a stated set that fits on the driver; studies, runs and judgements are tables of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators import evaluate as E
from tamarack.operators.labels import constraint

POLICIES = tuple((a, u) for a in ("exclude_present", "explicit_absence_required") for u in ("EXCLUDE", "INCLUDE"))


@dataclass(frozen=True)
class Gold:
    """A query with what it asks: include (concept, PRESENT or UNCERTAIN), exclude, views, its group."""

    id: str
    include: tuple[tuple[str, str], ...] = ()
    exclude: tuple[str, ...] = ()
    views: tuple[str, ...] = ()
    group: str = ""

    @property
    def asked(self) -> list[tuple[str, str]]:
        """(concept, status) that a source must assert to agree."""
        return [*self.include, *((c, "ABSENT") for c in self.exclude)]


def groups_of(n_include: Column, n_exclude: Column, uncertain: Column, n_views: Column) -> Column:
    """array<string>: every group that a query belongs to."""
    n = n_include + n_exclude
    named = (((n == 1) & (n_exclude == 0), "single"), (n >= 2, "multi"), (n_exclude > 0, "negation"), (uncertain, "uncertainty"), (n_views > 0, "view"), (n == 0, "other"))
    return F.array_compact(F.array(*[F.when(c, F.lit(g)) for c, g in named]))


def matching(matrix: DataFrame, golds: Sequence[Gold], absence: str, uncertainty: str, projection: str | None = None) -> DataFrame:
    """(qid, study_id) of all studies that a gold query's constraints and views let through: one pass over the wide
    matrix, whatever the number of queries. Queries without constraints match nothing."""
    asks = [g for g in golds if g.include or g.exclude]
    tests = []
    for g in asks:
        ok = constraint(g.include, g.exclude, absence=absence, uncertainty=uncertainty)
        if g.views and projection:
            ok = ok & F.coalesce(F.col(projection).isin(*g.views), F.lit(False))
        tests.append(F.when(ok, F.lit(g.id)))
    if not tests:
        return matrix.select(F.lit("").alias("qid"), "study_id").limit(0)
    return matrix.select(F.explode(F.array_compact(F.array(*tests))).alias("qid"), "study_id")


def relevance(matrix: DataFrame, agreement: DataFrame, golds: Sequence[Gold], absence: str, uncertainty: str, projection: str | None = None) -> DataFrame:
    """(qid, study_id, grade): the studies that match, graded 1 + the mean over what is asked of the number of sources
    that assert it. agreement: (study_id, concept, status, n)."""
    spark = matrix.sparkSession
    asked = spark.createDataFrame([(g.id, c, s) for g in golds for c, s in g.asked] or [("", "", "")], "qid string, concept string, status string")
    rows = matching(matrix, golds, absence, uncertainty, projection).join(F.broadcast(asked), "qid")
    found = rows.join(agreement.select("study_id", "concept", "status", "n"), ["study_id", "concept", "status"], "left")
    return found.groupBy("qid", "study_id").agg(F.round(1.0 + F.avg(F.coalesce("n", F.lit(0))), 6).alias("grade"))


def filter_counts(matrix: DataFrame, golds: Sequence[Gold], policies: Sequence[tuple[str, str]] = POLICIES) -> DataFrame:
    """(qid, policy, n): how many studies a query matches under each policy, zeros too; one aggregate over the matrix."""
    tests = [(g.id, f"{a}/{u}", constraint(g.include, g.exclude, absence=a, uncertainty=u)) for g in golds if g.include or g.exclude for a, u in policies]
    one = matrix.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, _, c) in enumerate(tests)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(p).alias("policy"), F.col(f"n{i}").alias("n")) for i, (q, p, _) in enumerate(tests)])).alias("m")).select("m.*")


def count_summary(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, queries, median, least, zero) of match counts."""
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("least"), F.count_if(F.col("n") == 0).alias("zero"))


def _dcg(rank: Column, gain: Column) -> Column:
    return F.sum(gain / F.log2(rank + 1.0))


def query_metrics(runs: DataFrame, relevant: DataFrame, banned: DataFrame | None = None, *, queries: DataFrame, k: int = 10) -> DataFrame:
    """(system, qid, ndcg_binary, ndcg_graded, p_at_5, p_at_k, mrr, violation, returned) for every system and query, also
    where nothing came back. runs: (system, qid, study_id, rank from 1); relevant: (qid, study_id, grade); banned:
    (qid, study_id), of the queries that exclude something. Precisions divide by k, violation by what came back
    and is null if nothing did or nothing is excluded; the ideal is the k best of all relevant."""
    top = runs.where(F.col("rank") <= k).join(relevant, ["qid", "study_id"], "left").withColumn("_hit", F.col("grade").isNotNull())
    sums = top.groupBy("system", "qid").agg(
        _dcg(F.col("rank"), F.col("_hit").cast("double")).alias("_db"), _dcg(F.col("rank"), F.coalesce("grade", F.lit(0.0))).alias("_dg"),
        F.count_if(F.col("_hit") & (F.col("rank") <= 5)).alias("_h5"), F.count_if("_hit").alias("_hk"), F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_first"), F.count(F.lit(1)).alias("_n"),
    )
    w = Window.partitionBy("qid").orderBy(F.col("grade").desc(), "study_id")
    ideal = relevant.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("qid").agg(_dcg(F.col("_r"), F.lit(1.0)).alias("_ib"), _dcg(F.col("_r"), F.col("grade")).alias("_ig"))
    grid = runs.select("system").distinct().crossJoin(F.broadcast(queries.select("qid").distinct()))  # systems by stated queries
    out = grid.join(sums, ["system", "qid"], "left").join(ideal, "qid", "left")
    if banned is None:
        out = out.withColumn("_bad", F.lit(None).cast("bigint")).withColumn("_ex", F.lit(False))
    else:
        bad = runs.where(F.col("rank") <= k).join(banned, ["qid", "study_id"], "left_semi").groupBy("system", "qid").agg(F.count(F.lit(1)).alias("_bad"))
        out = out.join(bad, ["system", "qid"], "left").join(banned.select("qid").distinct().withColumn("_ex", F.lit(True)), "qid", "left")
    n = F.coalesce("_n", F.lit(0))
    share = lambda a, b: F.round(F.when(F.coalesce(b, F.lit(0.0)) > 0, F.coalesce(a, F.lit(0.0)) / b).otherwise(0.0), 6)
    return out.select(
        "system", "qid", share(F.col("_db"), F.col("_ib")).alias("ndcg_binary"), share(F.col("_dg"), F.col("_ig")).alias("ndcg_graded"),
        F.round(F.coalesce("_h5", F.lit(0)) / 5, 6).alias("p_at_5"), F.round(F.coalesce("_hk", F.lit(0)) / k, 6).alias("p_at_k"), F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(F.col("_ex") & (n > 0), F.coalesce("_bad", F.lit(0)) / n), 6).alias("violation"), F.round(n / k, 6).alias("returned"),
    )


def macro_means(per_query: DataFrame, by: Sequence[str], metrics: Sequence[str], scope: str | None = None) -> DataFrame:
    """(*by, scope, n, *metrics): means over the rows that have a value, rounded to 4, over all and, with ``scope``, a
    column whose value or values name the groups a row belongs to, per group."""
    kinds = dict(per_query.dtypes)
    rows = per_query.withColumn("scope", F.lit("all"))
    if scope is not None:
        groups = F.col(scope) if kinds[scope].startswith("array") else F.array(scope)
        rows = rows.unionByName(per_query.withColumn("scope", F.explode(groups)))
    return rows.groupBy(*by, "scope").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 4).alias(m) for m in metrics])


def evaluate_runs(runs: DataFrame, matrix: DataFrame, agreement: DataFrame, present: DataFrame, golds: Sequence[Gold], policies: Sequence[tuple[str, str]] = POLICIES[:2], projection: str | None = None, k: int = 10) -> DataFrame:
    """(policy, system, qid, qgroup, *metrics): every run scored under every policy. The first policy scores all queries,
    others only those that exclude something. A policy changes what is relevant, not what was found. present:
    (concept, study_id) with the concept PRESENT, against which exclusions are held."""
    spark = runs.sparkSession
    out = []
    for i, (absence, uncertainty) in enumerate(policies):
        asks = [g for g in golds if (g.include or g.exclude) and (i == 0 or g.exclude)]
        if not asks:
            continue
        queries = spark.createDataFrame([(g.id, g.group) for g in asks], "qid string, qgroup string")
        excluded = spark.createDataFrame([(g.id, c) for g in asks for c in g.exclude] or [("", "")], "qid string, concept string")
        banned = present.join(F.broadcast(excluded), "concept").select("qid", "study_id").distinct()
        found = relevance(matrix, agreement, asks, absence, uncertainty, projection)
        scored = query_metrics(runs.join(F.broadcast(queries.select("qid")), "qid"), found, banned, queries=queries, k=k)
        out.append(scored.join(F.broadcast(queries), "qid").withColumn("policy", F.lit(f"{absence}/{uncertainty}")))
    return reduce(DataFrame.unionByName, out)


def item_scores(gold: DataFrame, predicted: DataFrame, item: Sequence[str], class_of: Column) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1, support) over items (qid, *item) that are in one or both."""
    keys = ["qid", *item]
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, keys, "full").withColumn("class", class_of).where("class IS NOT NULL")
    n = both.groupBy("class").agg(F.count_if(F.expr("_g = 1 AND _p = 1")).alias("tp"), F.count_if(F.expr("_g IS NULL")).alias("fp"), F.count_if(F.expr("_p IS NULL")).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.select("class", "tp", "fp", "fn", F.round(rate(tp, fp), 6).alias("precision"), F.round(rate(tp, fn), 6).alias("recall"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), (tp + fn).alias("support"))


def parser_report(gold: DataFrame, predicted: DataFrame, queries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, valid, exact, concept_f1, status_f1): shares of queries with a prediction and with exactly the gold's items,
    and macro F1 over concepts and over statuses. gold and predicted: (qid, concept, status); queries: (qid, valid,
    *by); a query whose parse failed has valid false and predicts nothing."""
    by = list(by)
    tag = queries.select("qid", *by).distinct()
    items = {}
    for name, item, cls in (("concept_f1", ["concept"], "concept"), ("status_f1", ["concept", "status"], "status")):
        keys = ["qid", *item]
        g, p = gold.select(*keys).distinct().withColumn("_g", F.lit(1)), predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
        both = g.join(p, keys, "full").join(tag, "qid")
        per = both.groupBy(*by, cls).agg((2.0 * F.count_if(F.expr("_g = 1 AND _p = 1")) / (F.count("_g") + F.count("_p"))).alias("f1"))
        items[name] = per.groupBy(*by).agg(F.round(F.avg("f1"), 6).alias(name)) if by else per.agg(F.round(F.avg("f1"), 6).alias(name))
        if name == "status_f1":
            wrong = both.where("_g IS NULL OR _p IS NULL").select("qid").distinct().withColumn("_wrong", F.lit(True))
    base = queries.join(wrong, "qid", "left")
    agg = (F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("valid"), F.round(F.avg(F.col("_wrong").isNull().cast("double")), 6).alias("exact"))
    out = base.groupBy(*by).agg(*agg) if by else base.agg(*agg)
    for name, table in items.items():
        out = out.join(table, by, "left") if by else out.crossJoin(table)
    return out


def verdict(report: DataFrame, least_f1: float, least_valid: float) -> DataFrame:
    """The report with passed: enough valid parses and every F1 that could be measured high enough."""
    good = [F.coalesce(F.col(c) >= least_f1, F.lit(True)) for c in ("concept_f1", "status_f1")]
    return report.withColumn("passed", reduce(lambda a, b: a & b, good, F.col("valid") >= least_valid))


def judging_pool(runs: DataFrame, k: int) -> DataFrame:
    """(qid, study_id): what any run has among its first k."""
    return runs.where(F.col("rank") <= k).select("qid", "study_id").distinct()


def graded_metrics(runs: DataFrame, judged: DataFrame, pool: DataFrame, queries: DataFrame, *, k: int = 10, view_ok: Column | None = None) -> DataFrame:
    """(system, qid, ndcg, p10, p10_lenient, violation, no_result): gains are 2^grade - 1 and 0 for studies that aren't
    judged or off the asked view; the ideal is the k best of the question's pool. judged: (qid, study_id, grade,
    violates); queries: (qid, has_exclusion); violation is null where nothing is excluded."""
    fine = F.lit(True) if view_ok is None else F.coalesce(view_ok, F.lit(False))
    j = judged.select("qid", "study_id", "grade", "violates", fine.alias("_ok"))
    grade = F.when(F.col("_ok"), F.coalesce("grade", F.lit(0))).otherwise(0)
    top = runs.where(F.col("rank") <= k).join(j, ["qid", "study_id"], "left").withColumn("g", grade)
    got = top.groupBy("system", "qid").agg(
        _dcg(F.col("rank"), F.pow(F.lit(2.0), F.col("g")) - 1.0).alias("_d"), F.count_if(F.col("g") == 2).alias("_two"), F.count_if(F.col("g") >= 1).alias("_one"), F.count_if(F.coalesce("violates", F.lit(False))).alias("_v")
    )
    p = pool.join(j, ["qid", "study_id"], "left").withColumn("g", grade)
    w = Window.partitionBy("qid").orderBy(F.col("g").desc(), "study_id")
    ideal = p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("qid").agg(_dcg(F.col("_r"), F.pow(F.lit(2.0), F.col("g")) - 1.0).alias("_i"))
    grid = runs.select("system").distinct().crossJoin(queries.select("qid", "has_exclusion").distinct())
    z = F.lit(0)
    return grid.join(got, ["system", "qid"], "left").join(ideal, "qid", "left").select(
        "system", "qid", F.round(F.when(F.coalesce("_i", F.lit(0.0)) > 0, F.coalesce("_d", F.lit(0.0)) / F.col("_i")).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.coalesce("_two", z) / k, 6).alias("p10"), F.round(F.coalesce("_one", z) / k, 6).alias("p10_lenient"),
        F.round(F.when(F.col("has_exclusion"), F.coalesce("_v", z) / k), 6).alias("violation"), F.col("_d").isNull().alias("no_result"),
    )


def system_differences(per_query: DataFrame, pairs: Sequence[tuple[str, str]], metrics: Sequence[str]) -> DataFrame:
    """(first, second, metric, n, mean, wins, losses, ties) over the queries that both systems have."""
    spark = per_query.sparkSession
    asked = F.broadcast(spark.createDataFrame(list(pairs), "first string, second string"))
    long = per_query.select("system", "qid", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select("system", "qid", "m.metric", "m.v")
    a = long.join(asked, F.col("system") == F.col("first")).select("first", "second", "qid", "metric", F.col("v").alias("a"))
    b = long.select(F.col("system").alias("second"), "qid", "metric", F.col("v").alias("b"))
    d = a.join(b, ["second", "qid", "metric"]).where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("first", "second", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties")
    )


def fusion_choice(differences: DataFrame, least_gain: float) -> DataFrame:
    """(best, mean, low, kept): the grid cell with the best mean gain over the system without fusion, kept if the gain is
    large enough and its interval above zero. differences: (cell, mean, low)."""
    best = differences.agg(F.max(F.struct(F.coalesce("mean", F.lit(-1.0)).alias("m"), "cell", "mean", "low")).alias("b"))
    return best.select(F.col("b.cell").alias("best"), "b.mean", "b.low", F.coalesce((F.col("b.mean") >= least_gain) & (F.col("b.low") > 0), F.lit(False)).alias("kept"))


def cost_table(ledger: DataFrame, step: str, cost: str, n_questions: int) -> DataFrame:
    """(step, calls, cost, per_1000, calls_per_question): costs of a ledger by step, and over all as step null."""
    return ledger.groupingSets([[step], []], step).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(cost), 4).alias("cost")).select(
        F.col(step).alias("step"), "calls", "cost", F.round(F.col("cost") / n_questions * 1000, 3).alias("per_1000"), F.round(F.col("calls") / n_questions, 2).alias("calls_per_question")
    )


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of a call from prices per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def judge_statistics(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pairs, agreement, relevant_agreement, kappa, kappa_quadratic) of two judges' grades 0 to 2 over what both judged."""
    keys = ["qid", "study_id"]
    both = first.select(*keys, F.col("grade").alias("x")).join(second.select(*keys, F.col("grade").alias("y")), keys).where("x IS NOT NULL AND y IS NOT NULL")
    agg = both.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 4).alias("agreement"), F.round(F.avg(((F.col("x") == 2) == (F.col("y") == 2)).cast("double")), 4).alias("relevant_agreement"))
    plain = E.cohen_kappa(both, "x", "y", (0, 1, 2), weighted=False).select("kappa")
    return agg.crossJoin(plain).crossJoin(E.cohen_kappa(both, "x", "y", (0, 1, 2), weighted=True).select(F.col("kappa").alias("kappa_quadratic")))


def balanced_sample(judged: DataFrame, keys: Sequence[str], grade: str, n: int, seed: int, grades: Sequence[int] = (2, 1, 0)) -> DataFrame:
    """n rows (all, if fewer) spread evenly over grades, each in the order of a seeded hash; what a grade lacks is taken
    from the others in the order of ``grades``. Only n rows a grade leave the partitions' tops."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)
    w = Window.partitionBy(grade).orderBy("_h", *keys)
    head = judged.where(F.col(grade).isin(*grades)).withColumn("_h", h).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    share, rest = divmod(n, len(grades))
    place = F.array_position(F.array(*map(F.lit, grades)), F.col(grade)).cast("int")
    quota = F.lit(share) + (place <= rest).cast("int")
    order = Window.orderBy((F.col("_i") > quota).cast("int"), place, "_i")  # at most n rows a grade
    return head.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= n).drop("_h", "_i", "_o")


def understanding(chosen: str, gold: str, got: str, want: str, warned: str, expected: str) -> dict[str, Column]:
    """Columns over arrays: hits and total of gold concepts chosen with their polarity, whether the signed columns are
    the gold's and their F1, and the share of expected warnings (null if none is)."""
    c = {n: F.array_distinct(F.col(n)) for n in (chosen, gold, got, want, warned, expected)}
    return {
        "hits": F.size(F.array_intersect(c[gold], c[chosen])), "total": F.size(c[gold]), "columns_exact": F.array_sort(c[got]) == F.array_sort(c[want]), "columns_f1": F.round(E.set_f1(c[got], c[want]), 6),
        "warnings_recall": F.round(F.try_divide(F.size(F.array_intersect(c[expected], c[warned])), F.size(c[expected])), 6),
    }


def error_step(gold: str, chosen: str, candidates: str, got: str, want: str) -> Column:
    """Where an answer went wrong: gold and chosen are arrays of ``concept|polarity``, candidates of concepts, got and want of
    signed columns. choice: a missed concept was a candidate; parse_or_lookup: none was; expansion: the concepts are
    right but not the columns; else ranking."""
    missed = F.array_except(F.col(gold), F.col(chosen))
    was = F.arrays_overlap(F.transform(missed, lambda m: F.split_part(m, F.lit("|"), F.lit(1))), F.col(candidates))
    return (
        F.when((F.size(missed) > 0) & F.coalesce(was, F.lit(False)), "choice").when(F.size(missed) > 0, "parse_or_lookup")
        .when(F.array_sort(F.array_distinct(F.col(got))) != F.array_sort(F.array_distinct(F.col(want))), "expansion").otherwise("ranking")
    )


def losing(per_query: DataFrame, system: str, against: str, metric: str) -> DataFrame:
    """(qid, value, other): the queries at which one system is worse than another."""
    a = per_query.where(F.col("system") == system).select("qid", F.col(metric).alias("value"))
    b = per_query.where(F.col("system") == against).select("qid", F.col(metric).alias("other"))
    return a.join(b, "qid").where("value < other")


def answer_shares(answers: DataFrame) -> DataFrame:
    """(answers, ok_share, sentences, grounded_share, dropped_share) of explanations (status, kept, dropped array of reasons)."""
    s = answers.agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("status") == "ok").alias("_ok"), F.coalesce(F.sum("kept"), F.lit(0)).alias("_k"), F.coalesce(F.sum(F.size(F.coalesce("dropped", F.array().cast("array<string>")))), F.lit(0)).alias("_d"))
    total = F.col("_k") + F.col("_d")
    return s.select("answers", F.round(F.try_divide("_ok", "answers"), 4).alias("ok_share"), total.alias("sentences"), F.round(F.try_divide(F.col("_k"), total), 4).alias("grounded_share"), F.round(F.try_divide(F.col("_d"), total), 4).alias("dropped_share"))


def dropped_reasons(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, reason, n, share): why sentences were dropped; a reason is what stands before a colon."""
    rows = answers.select(*by, F.explode("dropped").alias("r")).select(*by, F.split_part("r", F.lit(":"), F.lit(1)).alias("reason"))
    n = rows.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # a row per reason
    return n.withColumn("share", F.round(F.col("n") / total, 4))


def blind_outcome(answer: Column, second_is_b: Column) -> Column:
    """1 if the blind choice A, B or tie went to the second answer, -1 if to the first, 0 for a tie."""
    return F.when(answer == "tie", 0).when((answer == "B") == second_is_b, 1).otherwise(-1)


def second_is_b(key: Column, seed: int) -> Column:
    """The side of a blind comparison, by a seeded hash of the question."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(2)) == 1


def split_pairs(rows: Sequence[Mapping], per_group: int, seed: int) -> dict[str, str]:
    """{id: dev or heldout} of a small stated set (id, group, lang, pair): rows of a pair stay together, ``per_group`` rows
    of each group go to dev, if its pairs allow, with languages as even as can be; a greedy choice over seeded order."""
    import hashlib

    out: dict[str, str] = {}
    for group in sorted({r["group"] for r in rows}):
        units: dict[str, list[Mapping]] = {}
        for r in rows:
            if r["group"] == group:
                units.setdefault(r.get("pair") or r["id"], []).append(r)
        order = sorted(units, key=lambda u: hashlib.sha256(f"{seed}:{u}".encode()).hexdigest())
        # reachable: number of rows -> the most even way to reach it, by language balance
        ways: dict[int, tuple[int, dict[str, int], tuple[str, ...]]] = {0: (0, {}, ())}
        for u in order:
            for size, (_, langs, chosen) in sorted(ways.items(), reverse=True):
                n = size + len(units[u])
                count = dict(langs)
                for r in units[u]:
                    count[r["lang"]] = count.get(r["lang"], 0) + 1
                spread = max(count.values()) - min(count.values()) if len(count) > 1 else max(count.values())
                if n <= per_group and (n not in ways or spread < ways[n][0]):
                    ways[n] = (spread, count, (*chosen, u))
        dev = set(ways[max(ways)][2])
        out |= {r["id"]: "dev" if u in dev else "heldout" for u, rs in units.items() for r in rs}
    return out
