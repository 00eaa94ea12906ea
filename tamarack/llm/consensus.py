"""Consensus of several annotators' labels by expectation-maximisation over their confusion matrices.

Items with the same labels by the same sources have the same posterior, so items are counted by pattern and
a round runs over patterns. A round is one pass: every partition adds up its expected counts, and what comes
back is a table of sources x classes x classes, whose size does not depend on the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import cut

CLASSES = ("ABSENT", "PRESENT", "UNCERTAIN")
#: The confusion matrices of so many sources are held in memory at most (72 bytes each).
MOST_SOURCES = 500_000


def asserted(labels: DataFrame) -> DataFrame:
    """(study_id, concept, source, status): the newest assertion of a source that isn't NOT_MENTIONED.

    Statuses are read in any case and padding or as codes 1, 0, -1; null and blank ones are NOT_MENTIONED and
    unknown ones are left out, as are rows without study, concept or source. Equal times go to the greater
    status in alphabetical order; a null time is older than any."""
    s = F.upper(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    status = (
        F.when(s.isin("1", "1.0", "PRESENT"), "PRESENT").when(s.isin("0", "0.0", "ABSENT"), "ABSENT").when(s.isin("-1", "-1.0", "UNCERTAIN"), "UNCERTAIN")
    )
    return (
        labels.select("study_id", "concept", "source", "asserted_at", status.alias("status"))
        .where("status IS NOT NULL AND study_id IS NOT NULL AND concept IS NOT NULL AND source IS NOT NULL")
        .groupBy("study_id", "concept", "source")
        .agg(F.max(F.struct("asserted_at", "status")).alias("m"))
        .select("study_id", "concept", "source", F.col("m.status").alias("status"))
    )


def _posterior(codes: np.ndarray, offsets: np.ndarray, prior: np.ndarray, confusion: np.ndarray) -> np.ndarray:
    """codes: source * C + label of all labels, offsets: where each pattern's begin. confusion[source, truth, label]."""
    c = len(prior)
    log = np.log(confusion)[codes // c, :, codes % c]
    sums = np.add.reduceat(np.vstack([log, np.zeros((1, c))]), offsets[:-1], axis=0)
    sums[offsets[:-1] == offsets[1:]] = 0
    sums += np.log(prior)
    sums -= sums.max(axis=1, keepdims=True)
    p = np.exp(sums)
    return p / p.sum(axis=1, keepdims=True)


def dawid_skene(votes: DataFrame, *, smoothing: float = 1.0, rounds: int = 300, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """votes: (study_id, concept, source, status). Returns

    items (study_id, concept, n_sources, status, posterior, agreement): the likeliest status of each item, its
    posterior, and the share of its pairs of sources that agree (null for one source); equal posteriors go to
    the first class in alphabetical order;
    sources (source, n_items, accuracy, informedness, confusion, converged): accuracy is the chance that the source names
    the true status, informedness the same corrected for chance, (accuracy - chance) / (1 - chance) with
    chance from the prior and the source's own label shares; confusion is the row-wise matrix over CLASSES; converged tells whether no probability moved by more
    than ``tolerance`` in the last of at most ``rounds`` rounds.

    smoothing is added to every cell of the confusion matrices, twice that to the diagonal, and to the
    prior's classes."""
    spark = votes.sparkSession
    votes = cut(votes)
    per_source = votes.groupBy("source").agg(F.count(F.lit(1)).alias("n_items")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [r.source for r in per_source]
    c, j = len(CLASSES), len(names)
    numbered = spark.createDataFrame(list(enumerate(names)), "s int, source string")
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("status")).cast("int") - 1
    items = cut(
        votes.join(F.broadcast(numbered) if j < 10_000 else numbered, "source")
        .groupBy("study_id", "concept")
        .agg(F.array_sort(F.collect_list(F.col("s") * c + label)).alias("votes"))
    )
    patterns = cut(items.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    prior = np.full(c, 1 / c)
    confusion = np.full((j, c, c), 0.15)
    confusion[:, np.arange(c), np.arange(c)] = 0.7
    confusion /= confusion.sum(axis=2, keepdims=True)

    def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        col = b.column("votes")
        offsets = col.offsets.to_numpy()
        return col.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]

    last, converged = None, False
    for _ in range(rounds if j else 0):
        now_prior, now_confusion = prior, confusion

        def expect(batches: Iterator[pa.RecordBatch], prior=now_prior, confusion=now_confusion) -> Iterator[pa.RecordBatch]:
            counts, share, ll = np.zeros((j * c, c)), np.zeros(c), 0.0
            for b in batches:
                if not b.num_rows:
                    continue
                codes, offsets = flat(b)
                weight = b.column("n").to_numpy().astype(float)
                p = _posterior(codes, offsets, prior, confusion) * weight[:, None]
                share += p.sum(axis=0)
                np.add.at(counts, codes, np.repeat(p, np.diff(offsets), axis=0))
            cells = np.concatenate([counts.ravel(), share])
            hit = np.nonzero(cells)[0]
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(cells[hit])], names=["cell", "w"])

        cells = np.zeros(j * c * c + c)
        for r in patterns.mapInArrow(expect, "cell bigint, w double").groupBy("cell").agg(F.sum("w").alias("w")).collect():
            cells[r.cell] = r.w
        counts = cells[: j * c * c].reshape(j, c, c).transpose(0, 2, 1)
        confusion = counts + smoothing * (np.ones((c, c)) + np.eye(c))
        confusion /= confusion.sum(axis=2, keepdims=True)
        prior = cells[j * c * c :] + smoothing
        prior /= prior.sum()
        state = np.concatenate([confusion.ravel(), prior])
        if last is not None and np.abs(state - last).max() < tolerance:
            converged = True
            break
        last = state

    final_prior, final_confusion = prior, confusion

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, offsets = flat(b)
            p = _posterior(codes, offsets, final_prior, final_confusion)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("votes"), pa.array([CLASSES[i] for i in best], pa.string()), pa.array(p[np.arange(len(best)), best])],
                names=["votes", "status", "posterior"],
            )

    decided = patterns.mapInArrow(decide, "votes array<int>, status string, posterior double")
    named = F.transform("votes", lambda v: v % c)
    n = F.size("votes")
    same = sum((F.size(F.filter(named, lambda v, k=k: v == k)) * (F.size(F.filter(named, lambda v, k=k: v == k)) - 1) for k in range(c)), F.lit(0))
    consensus = items.join(decided, "votes").select(
        "study_id", "concept", n.alias("n_sources"), "status", "posterior", F.when(n > 1, same / (n * (n - 1))).alias("agreement")
    )
    rows = []
    for i, r in enumerate(per_source):
        m = confusion[i]
        accuracy = float((prior * m.diagonal()).sum())
        chance = float((prior * (prior @ m)).sum())
        rows.append((r.source, r.n_items, accuracy, (accuracy - chance) / (1 - chance) if chance < 1 else None, [float(x) for x in m.ravel()], converged))
    sources = spark.createDataFrame(rows, "source string, n_items bigint, accuracy double, informedness double, confusion array<double>, converged boolean")
    return consensus, sources


def chance_corrected(votes: DataFrame) -> DataFrame:
    """(concept, items, labels, observed, expected, alpha): Krippendorff's alpha for nominal labels per concept,
    over items with at least two sources. alpha is null where expected disagreement is zero."""
    cell = votes.groupBy("concept", "study_id", "status").agg(F.count(F.lit(1)).alias("k"))
    item = cell.groupBy("concept", "study_id").agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same")).where("n > 1")
    total = item.groupBy("concept").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n").alias("labels"), F.sum(F.col("n") - F.col("same") / (F.col("n") - 1)).alias("d")
    )
    counted = cell.join(item.select("concept", "study_id"), ["concept", "study_id"]).groupBy("concept", "status").agg(F.sum("k").alias("k"))
    pairs = counted.groupBy("concept").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("same"))
    observed = F.col("d") / F.col("labels")
    expected = 1 - F.col("same") / (F.col("labels") * (F.col("labels") - 1))
    return total.join(pairs, "concept").select(
        "concept",
        "items",
        "labels",
        F.round(observed, 6).alias("observed"),
        F.round(expected, 6).alias("expected"),
        F.round(F.when(expected > 0, 1 - observed / expected), 6).alias("alpha"),
    )
