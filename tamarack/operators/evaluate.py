"""Retrieval evaluation and statistics, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.session import all_of, running_sums


def auroc(rows: DataFrame, by: Sequence[str], score: str, positive: Column, negative: Column, weight: str | None = None) -> DataFrame:
    """(*by, n_pos, n_neg, auroc): Mann-Whitney with average ranks for ties, over rows that are one or the other;
    null where a class is empty. Ties are counted per distinct score, and distinct scores are ranked by running
    sums over range partitions, so neither a group nor a score is gathered. ``weight`` counts rows several times."""
    n = F.lit(1) if weight is None else F.col(weight)
    per = rows.where(positive | negative).groupBy(*by, score).agg(F.sum(F.when(positive, n).otherwise(0)).alias("p"), F.sum(F.when(negative, n).otherwise(0)).alias("q"))
    won = running_sums(per, by, [F.col(score)], {"below": F.col("q")})
    return won.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u")).select(
        *by, "n_pos", "n_neg", F.round(F.try_divide("u", F.col("n_pos") * F.col("n_neg")), 6).alias("auroc")
    )


def gain_dcg(rank: Column, gain: Column) -> Column:
    return F.sum(gain / F.log2(rank + 1.0))


def ndcgs(ranked: DataFrame, judged: DataFrame, by: Sequence[str], item: str, grade: str, k: int, exponential: dict[str, bool], of: Sequence[str] | None = None) -> DataFrame:
    """(*by, a column per name in ``exponential``): ranked has (*by, item, rank from 1), judged (*of, item, grade). Gains
    are grades, or 2^grade - 1 where the name says so; the ideal is the k best of all that is judged; 0 where nothing is
    relevant or a column of ``by`` is null. of: the columns of ``by`` that judgements depend on (all, if not given), so that
    they aren't repeated for every group; if given, there are so few of these that their ideals are broadcast."""
    of_ = list(by if of is None else of)
    gain = lambda x: (F.pow(F.lit(2.0), F.col(grade)) - 1.0) if x else F.col(grade).cast("double")
    top = ranked.where(F.col("rank") <= k).select(*by, item, "rank").join(judged, [*of_, item], "left")
    got = top.groupBy(*by).agg(*[gain_dcg(F.col("rank"), F.coalesce(gain(x), F.lit(0.0))).alias(f"_dcg_{n}") for n, x in exponential.items()])
    # the ideal needs no items, only how many have each of the k best grades
    w = Window.partitionBy(*of_).orderBy(F.col(grade).desc())
    counts = judged.groupBy(*of_, grade).agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("_before", before).where(F.col("_before") < k).select(*of_, grade, F.explode(F.sequence(F.col("_before") + 1, F.least(F.col("_before") + F.col("_n"), F.lit(k).cast("bigint")))).alias("_r"))
    best = places.groupBy(*of_).agg(*[gain_dcg(F.col("_r"), gain(x)).alias(f"_ideal_{n}") for n, x in exponential.items()])
    asked = all_of([F.col(c).isNotNull() for c in by])
    score = lambda n: F.round(F.when(asked & (F.coalesce(f"_ideal_{n}", F.lit(0.0)) > 0), F.col(f"_dcg_{n}") / F.col(f"_ideal_{n}")).otherwise(0.0), 6).alias(n)
    return got.join(best if of is None else F.broadcast(best), of_, "left").select(*by, *[score(n) for n in exponential])


def ndcg(ranked: DataFrame, judged: DataFrame, by: Sequence[str], item: str, grade: str, k: int, *, exponential: bool = False, of: Sequence[str] | None = None) -> DataFrame:
    """(*by, ndcg): one column of ``ndcgs``."""
    return ndcgs(ranked, judged, by, item, grade, k, {"ndcg": exponential}, of)


def rank_metrics(ranked: DataFrame, relevant: DataFrame, by: Sequence[str], item: str, k: int = 10, of: Sequence[str] | None = None) -> DataFrame:
    """(*by, p_at_5, p_at_k, mrr): precisions divide by k even when fewer come back. of: the columns of ``by`` that
    relevant has and depends on (all, if not given)."""
    of = list(by if of is None else of)
    hit = relevant.select(*of, item).distinct().withColumn("hit", F.lit(1))
    top = ranked.where(F.col("rank") <= k).join(hit, [*of, item], "left")
    return top.groupBy(*by).agg(
        F.round(F.count_if(F.col("hit").isNotNull() & (F.col("rank") <= 5)) / 5, 6).alias("p_at_5"),
        F.round(F.count_if(F.col("hit").isNotNull()) / k, 6).alias("p_at_k"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("hit").isNotNull(), F.col("rank")))), F.lit(0.0)), 6).alias("mrr"),
    )


def violation_rate(ranked: DataFrame, banned: DataFrame, by: Sequence[str], item: str, k: int = 10) -> DataFrame:
    """(*by, returned, violation): share of what came back that is banned."""
    bad = banned.select(*by, item).distinct().withColumn("bad", F.lit(1))
    return ranked.where(F.col("rank") <= k).join(bad, [*by, item], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("returned"), F.round(F.count("bad") / F.count(F.lit(1)), 6).alias("violation")
    )


def cohen_kappa(pairs: DataFrame, x: str, y: str, labels: Sequence[str], *, weighted: bool) -> DataFrame:
    """(n, kappa) of two raters over ordered labels, with quadratic weights if asked; null where chance agreement is
    complete. Computed from the contingency table, whose size is that of the labels squared."""
    code = lambda c: F.array_position(F.array(*map(F.lit, labels)), F.col(c)).cast("double")
    cells = pairs.where(F.col(x).isin(*labels) & F.col(y).isin(*labels)).groupBy(code(x).alias("a"), code(y).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    rows = cells.groupBy("a").agg(F.sum("c").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("c").alias("cb"))
    weight = F.pow(F.col("a") - F.col("b"), 2.0) if weighted else (F.col("a") != F.col("b")).cast("double")
    seen = cells.agg(F.sum("c").alias("n"), F.sum(F.col("c") * weight).alias("o"))
    chance = rows.crossJoin(cols).agg(F.sum(F.col("ra") * F.col("cb") * weight).alias("e"))
    return seen.crossJoin(chance).select("n", F.round(1 - F.try_divide(F.col("o") * F.col("n"), F.col("e")), 6).alias("kappa"))


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(classes, macro_f1): mean F1 over the classes seen in gold or prediction."""
    long = rows.select(F.col(gold).alias("g"), F.col(predicted).alias("p"))
    stacked = long.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("c"), "g", "p").where("c IS NOT NULL")
    tp, ng, np_ = F.count_if((F.col("g") == F.col("c")) & (F.col("p") == F.col("c"))), F.count_if(F.col("g") == F.col("c")), F.count_if(F.col("p") == F.col("c"))
    per = stacked.groupBy("c").agg((2.0 * tp / (ng + np_)).alias("f1"))
    return per.agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("f1"), 6).alias("macro_f1"))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; both empty is 1."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k out of n; null for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / d
    return mid - half, mid + half


def percentiles(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(*by, n, p50, p95), exact, with linear interpolation; nulls are left out."""
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95")
    )


def _heads(counts: DataFrame, by: Sequence[str], key: str, n: str) -> DataFrame:
    """counts with rank (from 0) and before, the sum of what is more frequent, and the group's total."""
    run = running_sums(counts, by, [F.col(n).desc(), F.col(key)], {"_rank": F.lit(1), "_before": F.col(n)})
    total = counts.groupBy(*by).agg(F.sum(n).alias("_total")).select(F.struct(*by).alias("_g"), "_total")
    return run.withColumn("_g", F.struct(*by)).join(total, "_g").drop("_g")


def coverage_curve(counts: DataFrame, by: Sequence[str], key: str, n: str, levels: Sequence[float]) -> DataFrame:
    """(*by, level, needed): the fewest of the most frequent keys that make up a share of all; no group is gathered."""
    run = _heads(counts, by, key, n)
    long = run.select(*by, (F.col("_rank") + 1).alias("rn"), (F.col("_before") + F.col(n)).alias("cum"), "_total", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    return long.where(F.col("cum") >= F.col("level") * F.col("_total") - 1e-9).groupBy(*by, "level").agg(F.min("rn").cast("bigint").alias("needed"))


def scope_bands(counts: DataFrame, by: Sequence[str], key: str, n: str, levels: Sequence[int] = (80, 90, 95)) -> DataFrame:
    """(*by, key, n, band): the head of a vocabulary and the coverage level at which each key comes in."""
    run = _heads(counts, by, key, n).withColumn("before", F.col("_before") / F.col("_total"))
    band = F.coalesce(*[F.when(F.col("before") < level / 100 - 1e-9, F.lit(level)) for level in levels])
    return run.withColumn("band", band).where("band IS NOT NULL").select(*by, key, n, "band")


def top_pairs(counts: DataFrame, keys: Sequence[str], n: str, coverage: float, most: int) -> DataFrame:
    """(*keys, n, share): the most frequent pairs until they cover a share, at most ``most``. The order is global:
    only candidates above the limit's count reach the one task that adds them up."""
    total = counts.agg(F.sum(n).alias("_t"))
    head = counts.orderBy(F.col(n).desc(), *keys).limit(most).crossJoin(F.broadcast(total))
    w = Window.orderBy(F.col(n).desc(), *keys).rowsBetween(Window.unboundedPreceding, -1)
    return head.withColumn("_before", F.coalesce(F.sum(n).over(w), F.lit(0)) / F.col("_t")).where(F.col("_before") < coverage).select(*keys, n, F.round(F.col(n) / F.col("_t"), 6).alias("share"))


def poisson_weight(h: Column) -> Column:
    """A Poisson(1) draw from a hash: how often a row counts in a round of a bootstrap."""
    u = F.pmod(h, F.lit(1 << 52)) / float(1 << 52)
    steps, p, total = [], 0.36787944117144233, 0.0
    for i in range(8):
        total += p
        steps.append(total)
        p /= i + 1
    return sum(((u >= c).cast("int") for c in steps), F.lit(0))


def paired_difference(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean, wins, losses, ties) of paired differences; rows lacking either value are left out."""
    d = pairs.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).where("d IS NOT NULL AND NOT isnan(d)")
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))


def bootstrap_mean_diff(pairs: DataFrame, a: str, b: str, rounds: int, seed: int) -> DataFrame:
    """(n, mean, wins, losses, ties, low, high) of paired differences, with a 95 % percentile interval by the Poisson
    bootstrap: every row draws its weight per round from a seeded hash, so rounds are sums over partitions and no
    group is gathered. Rows lacking either value are left out."""
    d = pairs.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d"), F.xxhash64(*pairs.columns).alias("h")).where("d IS NOT NULL AND NOT isnan(d)")
    drawn = d.select("d", "h", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", poisson_weight(F.xxhash64("h", "round", F.lit(seed))))
    means = drawn.groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("m"))
    ci = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return paired_difference(pairs, a, b).crossJoin(ci)
