"""Exact vector operators: normalisation, similarity, top-k, batch search, zero-shot and linear scores.

Whole Arrow batches are multiplied by the weights at once. Sums over vectors are partial per batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector is an error."""
    n = norm(v)
    return F.when(n == 0, F.raise_error(F.lit("zero vector")).cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def unit_rows(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def rows_of(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, usable) of a batch's list column: a row per entry. Entries that are null, hold a null or have another
    length than ``dim`` (by default the first usable one's) are rows of NaN and not usable."""
    at = column.offsets.to_numpy()
    sizes = np.where(np.asarray(column.is_valid()), np.diff(at), -1)
    if dim is None:
        dim = int(sizes[sizes > 0][0]) if (sizes > 0).any() else 0
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
    good = sizes == dim
    out = np.full((len(sizes), dim), np.nan)
    if dim and good.any():
        out[good] = flat[at[:-1][good][:, None] + np.arange(dim)]
    return out, good & ~np.isnan(out).any(axis=1)


def scaled_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def top_k(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows with the highest finite score, ties by key: a partial top k in every task, merged."""
    s = F.col(score)
    rows = scored.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).orderBy(s.desc(), F.col(key)).limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(s.desc(), F.col(key))).cast("int"))


def score_matrix(
    vectors: DataFrame, key: str, vec: str, weights: dict[str, Sequence[float]], bias: dict[str, float] | None = None, *, scale: float = 1.0, keep: Sequence[str] = (), normalise: bool = True
) -> DataFrame:
    """key, *keep and one logit column per concept: scale * (w . v) + bias, v scaled to length 1 unless told otherwise.
    The weights are the model, one vector per concept; one pass, no shuffle. Vectors that are null or of another
    length than the weights, or hold a null or NaN, have null logits; a zero vector has the bias."""
    names = list(weights)
    w = np.array([weights[c] for c in names], float).reshape(len(names), -1)
    b = np.array([float((bias or {}).get(c, 0.0)) for c in names])
    rows = vectors.select(key, *keep, vec)
    passed = [f for f in rows.schema.fields[:-1]]
    schema = T.StructType([*passed, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = rows_of(batch.column(batch.num_columns - 1), w.shape[1])
            logits = (scaled_rows(x) if normalise else x) @ w.T * scale + b
            columns = [pa.array(logits[:, j], mask=~usable) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def nearest_to(vectors: DataFrame, query: Sequence[float], k: int, *, key: str, vec: str, where: Column | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score, rank): the k vectors most similar to one query by cosine, after a condition and an allow-list of
    keys. No allow-list restricts nothing, an empty one allows nothing."""
    rows = vectors if where is None else vectors.where(where)
    if allowed is not None:
        rows = rows.join(allowed.select(key).distinct(), key, "left_semi")
    unit = scaled_rows(np.array([query], float))[0].tolist()
    scored = score_matrix(rows, key, vec, {"score": unit}).select(key, F.round("score", 6).alias("score"))
    return top_k(scored, "score", key, k)


def batch_nearest(queries: DataFrame, vectors: DataFrame, k: int, *, key: str, vec: str, block: int = 4_096) -> DataFrame:
    """(query, key, score, rank): exact k nearest of each query by cosine, itself excluded. Both sides are packed into
    blocks of at most ``block`` rows where they lie; each block of queries meets each block of vectors once, as a
    matrix product that returns the local k best, and the local bests are merged. Unusable rows (null keys,
    null, empty or zero vectors, vectors of another length than the query) take no part."""
    kind = dict(vectors.dtypes)[key]
    key_t = vectors.schema[key].dataType

    def packed(df: DataFrame, prefix: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                sizes = np.diff(column.offsets.to_numpy())
                for dim in np.unique(sizes[np.asarray(column.is_valid()) & (sizes > 0)]).tolist():
                    x, usable = rows_of(column, dim)
                    x = scaled_rows(x)
                    usable &= (x * x).sum(axis=1) > 0.5
                    for at in range(0, int(usable.sum()), block):
                        pick = np.flatnonzero(usable)[at : at + block]
                        ids = batch.column(0).take(pa.array(pick))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([np.ascontiguousarray(x[pick]).tobytes()], pa.binary()), pa.array([dim], pa.int32())],
                            names=[f"{prefix}ids", f"{prefix}x", f"{prefix}dim"],
                        )

        schema = T.StructType([T.StructField(f"{prefix}ids", T.ArrayType(key_t)), T.StructField(f"{prefix}x", T.BinaryType()), T.StructField(f"{prefix}dim", T.IntegerType())])
        return df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(key, vec).mapInArrow(run, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("q_dim")[i].as_py()
                q_ids, ids = batch.column("q_ids")[i].values, batch.column("ids")[i].values
                q, x = (np.frombuffer(batch.column(c)[i].as_py(), float).reshape(-1, dim) for c in ("q_x", "x"))
                sims = np.round(q @ x.T, 6)
                rank_of_key = np.empty(len(ids), np.int64)
                rank_of_key[np.asarray(pa.compute.sort_indices(ids))] = np.arange(len(ids))
                order = np.lexsort((np.broadcast_to(rank_of_key, sims.shape), -sims), axis=1)[:, : k + 1]
                rows = np.repeat(np.arange(len(q_ids)), order.shape[1])
                out = pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows)), ids.take(pa.array(order.ravel())), pa.array(np.take_along_axis(sims, order, 1).ravel())], names=["query", key, "score"])
                yield out.filter(pa.compute.not_equal(out.column(0), out.column(1)))

    met = packed(queries, "q_").crossJoin(packed(vectors, "")).where("q_dim = dim").select("q_ids", "q_x", "q_dim", "ids", "x")
    found = met.mapInArrow(compare, T.StructType([T.StructField("query", key_t), T.StructField(key, key_t), T.StructField("score", T.DoubleType())])).distinct()
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select(F.col("query").cast(kind).alias("query"), key, "score", "rank")


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, vec): normalise, mean, normalise again. Each batch yields the sums of its groups, so a group of any size
    is a sum of partial sums. Vectors that are null or hold a null take no part; those of one group must be of
    one length."""
    rows = vectors.where(F.col(group).isNotNull()).select(group, vec)
    schema = T.StructType([rows.schema[group], T.StructField("i", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = rows_of(batch.column(1))
            if not usable.any():
                continue
            x = scaled_rows(x[usable])
            coded = batch.column(0).filter(pa.array(usable)).dictionary_encode()
            codes, names = np.asarray(coded.indices), coded.dictionary
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, codes, x)
            counts = np.bincount(codes, minlength=len(names))
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.repeat(np.arange(len(names)), d))), pa.array(np.tile(np.arange(d, dtype=np.int32), len(names))), pa.array(total.ravel()), pa.array(np.repeat(counts, d).astype(np.int64))],
                names=schema.names,
            )

    mean = rows.mapInArrow(sums, schema).groupBy(group, "i").agg((F.sum("s") / F.sum("n")).alias("x"))
    whole = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return whole.select(group, unit_rows(F.col("m")).alias("vec"))
