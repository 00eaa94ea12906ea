"""Mixing sources to target weights, with a cap on repeats, by a multivariate-hypergeometric splitting tree.

Sizes are in tokens of a public tokenizer. A source's documents are hashed into blocks; whole rounds of a
source and, for the rest of its quota, a prefix of its permuted blocks are taken (the last block document by
document, so a quota is met to within one document). A tree over the output shards then splits the exact
numbers of blocks of every source: at each node the left half's vector is drawn from the multivariate
hypergeometric distribution. Shards get disjoint runs of each source's permuted blocks, and every row a
number by which its shard is sorted, which shuffles locally (``local_shuffle``).

On the driver there are only blocks: at most ``BLOCKS`` for each target source and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.llm.vocabulary import DEFAULT, PATTERN, ranks
from tamarack.session import cut

BLOCKS = 2_048
PER_BLOCK = 64


def source_name(c: str) -> Column:
    """One spelling of a source: lower case, words joined by underscores; blank is null."""
    s = F.regexp_replace(F.trim(F.lower(F.col(c))), r"[\s\-]+", "_")
    return F.when(s != "", s)


def token_counts(documents: DataFrame, vocabulary: str = DEFAULT, *, pattern: str = PATTERN, doc: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, tokens, *keep). vocabulary: path of a byte-level BPE's ranks, pattern: how it cuts texts. The file is
    read once on the driver. A null text has 0 tokens."""
    content = Path(vocabulary).read_bytes()
    sent = documents.sparkSession.sparkContext.broadcast(content)
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), *keep)
    others = [f for f in rows.schema.fields if f.name != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(sent.value), special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            names = [f.name for f in others]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(n, pa.int64())], names=[*names, "tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(count, StructType([*others, StructField("tokens", LongType())]))


def plan_quotas(there: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens of each source. there: (documents, tokens) by source; targets: (share, most repeats). Targets without
    documents or tokens, or with a share or cap of zero, drop out and the others' shares are scaled to 1. Without
    a total the largest one is taken that no cap forbids; a larger total than that is an error."""
    live = {s: t for s, t in targets.items() if there.get(s, (0, 0))[1] > 0 and (t[0] or 0) > 0 and (t[1] or 0) > 0}
    if not live:
        return {}
    scale = sum(t[0] for t in live.values())
    most = min(t[1] * there[s][1] / (t[0] / scale) for s, t in live.items())
    if total is not None and total > most + 1e-6:
        raise ValueError(f"{total} tokens need more repeats than are allowed; at most {int(most)}")
    size = most if total is None else total
    return {s: size * t[0] / scale for s, t in live.items()}


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts by source, dealt to shards: rows are shards, sums over rows are counts."""
    if shards == 1:
        return counts[None]
    left = shards // 2
    take = int(round(counts.sum() * left / shards))
    part = rng.multivariate_hypergeometric(counts, take, method="marginals") if counts.sum() else counts
    return np.vstack([split_tree(part, left, rng), split_tree(counts - part, shards - left, rng)])


def mix(documents: DataFrame, targets: DataFrame, *, total: int | None = None, shards: int = 16, seed: int = 9, vocabulary: str = DEFAULT) -> DataFrame:
    """(doc_id, source, copy, shard, draw, tokens): the mixture, one row per document and copy; each shard is to be
    sorted by draw. Documents without id, with an unknown or null source, or without tokens take no part. Of
    repeated ids the row with the smallest source and size counts. No targets or no documents give no rows."""
    spark = documents.sparkSession
    wanted = {}
    for r in targets.withColumn("source", source_name("source")).where("source IS NOT NULL").collect():
        if r.source in wanted:
            raise ValueError(f"two targets for {r.source}")
        wanted[r.source] = (r.target_share, r.max_repeats)
    named = token_counts(documents.where("doc_id IS NOT NULL"), vocabulary, keep=(source_name("source").alias("source"),))
    sized = cut(
        named.where(F.col("tokens") > 0)
        .where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "tokens")).alias("m"))
        .select("doc_id", "m.source", "m.tokens")
    )
    there = {r.source: (r.n, r.t) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    quotas = plan_quotas(there, wanted, total)
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, source string, copy int, shard int, draw bigint, tokens bigint"
    if not quotas:
        return spark.createDataFrame([], schema)
    numbers = {s: max(1, min(BLOCKS, there[s][0] // PER_BLOCK)) for s in quotas}
    count_of = F.create_map(*[x for s, n in numbers.items() for x in (F.lit(s), F.lit(n))])
    blocks = sized.where(F.col("source").isin(list(quotas))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), count_of[F.col("source")]).cast("int"))
    weights: dict[str, dict[int, int]] = {s: {} for s in quotas}
    for r in blocks.groupBy("source", "block").agg(F.sum("tokens").alias("t")).collect():
        weights[r.source][r.block] = r.t

    rng = np.random.default_rng(seed)
    units: dict[str, list[tuple[int, int, float | None]]] = {}
    for s in sorted(quotas):
        size = there[s][1]
        whole, order = int(quotas[s] // size + 1e-9), sorted(weights[s])
        taken = [(c, b, None) for c in range(whole) for b in order]
        rest = quotas[s] - whole * size
        for b in rng.permutation(order).tolist():
            if rest <= 0.5 or whole >= wanted[s][1]:
                break
            t = weights[s][b]
            taken.append((whole, b, None if t <= rest else float(rest)))
            rest -= t
        units[s] = [taken[i] for i in rng.permutation(len(taken))]
    names = sorted(units)
    dealt = split_tree(np.array([len(units[s]) for s in names], np.int64), shards, rng)
    rows = []
    for k, s in enumerate(names):
        ends = np.concatenate([[0], np.cumsum(dealt[:, k])])
        for shard in range(shards):
            rows += [(s, b, c, shard, limit) for c, b, limit in units[s][ends[shard] : ends[shard + 1]]]
    plan = spark.createDataFrame(rows, "source string, block int, copy int, shard int, rest double")
    drawn = blocks.join(plan, ["source", "block"]).withColumn("draw", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    full = drawn.where("rest IS NULL")
    w = Window.partitionBy("source").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = drawn.where("rest IS NOT NULL").withColumn("_sum", F.sum("tokens").over(w)).where(F.col("_sum") - F.col("tokens") / 2 <= F.col("rest")).drop("_sum")
    return full.unionByName(last).select("doc_id", "source", "copy", "shard", "draw", "tokens")


def local_shuffle(mixture: DataFrame) -> DataFrame:
    """The mixture in the order in which it is to be read: shard after shard, within each by ``draw``. Parts are ranges of
    both, so a shard of any size is sorted by several tasks and a part holds neighbours only."""
    return mixture.repartitionByRange("shard", "draw", "doc_id").sortWithinPartitions("shard", "draw", "doc_id")


def mixture_checks(mixture: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, present, share_met, cap_kept, no_repeats): per target whether it has documents in the mixture, whether its
    tokens are its share of all to within its largest document and a half, whether no document is repeated more than
    is allowed, and whether no (document, copy) occurs twice."""
    once = mixture.groupBy("source", "doc_id", "copy").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("largest"))
    by = once.groupBy("source").agg(F.sum("t").alias("t"), F.max("largest").alias("largest"), (F.max("copy") + 1).alias("copies"), F.max("n").alias("n"))
    asked = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    have = asked.join(by, "source", "left")
    total = have.where("t IS NOT NULL").agg(F.sum("t").alias("_t"), F.sum("target_share").alias("_s"))
    due = F.col("_t") * F.col("target_share") / F.col("_s")
    return have.crossJoin(F.broadcast(total)).select(
        "source", F.col("t").isNotNull().alias("present"), (F.col("t").isNull() | (F.abs(F.col("t") - due) <= 1.5 * F.col("largest") + 1)).alias("share_met"),
        (F.col("t").isNull() | (F.col("copies") <= F.col("max_repeats"))).alias("cap_kept"), (F.col("t").isNull() | (F.col("n") == 1)).alias("no_repeats"),
    )


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_copies): the mixture as it came out; a target
    that took no part has share 0."""
    by = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("copy") + 1).alias("most_copies"))
    total = by.agg(F.sum("tokens").alias("_t"))
    return (
        targets.select(source_name("source").alias("source"), "target_share")
        .join(by, "source", "left")
        .crossJoin(total)
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("tokens") / F.col("_t"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
