"""The k most similar vectors of every vector: cross-polytope hashing with multiprobe tables.

A vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
hashed to its nearest signed axis, one of 2d. Several such digits make a table's key. Keys have variable
length: a prefix that holds more than ``leaf`` vectors is split by the next digit, so that dense regions get
long keys and sparse ones short keys; how many digits there are grows with the logarithm of the number of
vectors, the size of leaves doesn't grow. Every vector probes the ``probes`` best leaves of every table and is
compared exactly, by blocks, with all members of them; the best k of all tables are kept.

No bucket is capped: a leaf that stays large after the last digit is compared in blocks, and a leaf with many
probing vectors is spread over several tasks. Vectors whose leaves hold fewer than k others are compared with
all, block by block. Vectors that are copies of each other (after scaling, to six digits) are hashed once and
expanded at the end, each class by its k + 1 smallest ids.

Which prefixes are split and which leaves exist is told by two bitmaps of hashed keys, of at most ``MOST_BITS``
bits each, the same for those who are asked and those who ask; two keys that share a bit split a prefix that
needn't be, or cost a probe of an empty leaf, and lose nothing else. Beside them at most ``MOST`` numbers of
blocks are broadcast: were there more, blocks grow, which changes what is compared in one task, not what is
compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.operators.vectors import batch_nearest, rows_of, scaled_rows
from tamarack.session import cut, release

MOST = 1_000_000
MOST_BITS = 1 << 28
#: How many axes are tried of each digit of a key; of later digits the nearest.
TRIED = (3, 3, 2)
PREFIX_BITS = 54  # of a key: table, number of digits, digits


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(image_id, copy, vec): one usable unit vector per id. Null ids, null vectors, other lengths, elements that are
    null, NaN or infinite, and zero vectors are left out; of an id's different vectors the one with the smallest
    hash counts. copy: two hashes of the unit vector, rounded to six digits."""
    schema = T.StructType([T.StructField("image_id", rows.schema[id_col].dataType), *T.StructType.fromDDL("a bigint, b bigint, vec array<float>").fields])
    factors = np.random.default_rng(0).integers(1, 1 << 63, (2, dim), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = rows_of(batch.column(1), dim)
            usable &= np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[usable] / np.abs(x[usable]).max(axis=1, keepdims=True) if usable.any() else x[:0]
            x = scaled_rows(x)
            rounded = np.rint(x * 1e6).astype(np.int64).view(np.uint64)
            with np.errstate(over="ignore"):
                a, b = ((rounded * f).sum(axis=1, dtype=np.uint64).view(np.int64) for f in factors)
            flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(usable)), pa.array(a), pa.array(b), vec], names=schema.names)

    good = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(read, schema)
    return good.groupBy("image_id").agg(F.min(F.struct("a", "b", "vec")).alias("m")).select("image_id", F.struct("m.a", "m.b").alias("copy"), "m.vec")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    size = 1 << (x.shape[1] - 1).bit_length()
    if size > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, size))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, table: int, digit: int, alternatives: int) -> tuple[np.ndarray, np.ndarray]:
    """The signed axes nearest to each row, best first, and how much less they are worth than the best."""
    y = rotate(x, 1_000 * table + digit)
    size = np.abs(y)
    order = np.argsort(-size, axis=1, kind="stable")[:, :alternatives]
    worth = np.take_along_axis(size, order, 1)
    sign = np.take_along_axis(y, order, 1) > 0
    return order * 2 + sign, worth[:, :1] - worth


def _key(table: int, length: int, prefix: np.ndarray) -> np.ndarray:
    return (np.int64(table) << 59) | (np.int64(length) << PREFIX_BITS) | prefix


def _spot(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((z ^ (z >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = _spot(keys, 8 * len(bitmap))
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """The bits of the hashed keys (column spot), built in parts where the keys are."""
    out = np.zeros(bits // 8, np.uint8)
    spot = F.col("spot") + 1  # Spark numbers bits from 1 and buckets of 32768 bits from 1
    parts = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("m"))
    for r in parts.collect():
        at = (r.b - 1) * 4096
        part = np.frombuffer(bytes(r.m), np.uint8)[: len(out) - at]
        out[at : at + len(part)] |= part
    return out


def _matrix(batch: pa.RecordBatch | pa.Table, name: str, dim: int) -> np.ndarray:
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def probe(x: np.ndarray, table: int, digits: int, split: np.ndarray, there: np.ndarray | None, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, valid) of each row, best first; the first is the row's own leaf. Digits are computed only for rows of
    which a prefix is split. Without ``there`` only the own leaf is given."""
    tried = [TRIED[g] if there is not None and g < min(len(TRIED), digits - 1) else 1 for g in range(digits)]
    width = int(2 * (1 << (x.shape[1] - 1).bit_length()))
    combos = np.array(list(itertools.product(*[range(t) for t in tried])))
    n = len(x)
    loss, prefix = np.zeros((n, len(combos)), np.float32), np.zeros((n, len(combos)), np.int64)
    leaf = np.full(prefix.shape, -1, np.int64)
    rows = np.arange(n)  # those with a prefix that goes on
    for g in range(digits):
        if not len(rows):
            break
        best, less = axes(x[rows], table, g, tried[g])
        prefix[rows] = prefix[rows] * width + best[:, combos[:, g]]
        open_ = leaf[rows] < 0
        loss[rows] += np.where(open_, less[:, combos[:, g]], 0)
        key = _key(table, g + 1, prefix[rows])
        ends = open_ & (~_in(split, key) if g < digits - 1 else True)
        leaf[rows] = np.where(ends, key, leaf[rows])
        rows = rows[(leaf[rows] < 0).any(axis=1)]
    order = np.argsort(loss, axis=1, kind="stable")
    leaf = np.take_along_axis(leaf, order, 1)
    valid = np.ones(leaf.shape, bool) if there is None else _in(there, leaf)
    for j in range(1, leaf.shape[1]):
        valid[:, j] &= ~(leaf[:, :j] == leaf[:, j : j + 1]).any(axis=1)
    valid &= np.cumsum(valid, axis=1) <= probes
    return leaf, valid


def nearest_classes(points: DataFrame, k: int, tables: int, probes: int, leaf: int, dim: int) -> DataFrame:
    """(id, nbr, cos) of each point's k nearest other points. points: id bigint, vec array<float>, checkpointed."""
    spark = points.sparkSession
    n = points.count()
    width = 2 * (1 << (dim - 1).bit_length())
    most_digits = PREFIX_BITS // (width.bit_length() - 1)
    digits = min(most_digits, 2 + math.ceil(max(1.0, math.log(max(1.0, n / leaf), width))))
    if tables > 16 or most_digits < 2:
        raise ValueError("at most 16 tables, and vectors of at most 2^26 numbers")
    bits = min(MOST_BITS, max(1 << 15, 1 << math.ceil(math.log2(1_024 * tables * (n / leaf + width)))))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, "vec", dim)
            for t in range(tables):
                p = np.zeros(len(x), np.int64)
                keys = []
                for g in range(digits - 1):
                    p = p * width + axes(x, t, g, 1)[0][:, 0]
                    keys.append(_key(t, g + 1, p))
                u, c = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(_spot(u, bits)), pa.array(c.astype(np.int64))], names=["key", "spot", "n"])

    big = points.select("vec").mapInArrow(prefixes, "key bigint, spot bigint, n bigint").groupBy("key", "spot").agg(F.sum("n").alias("n")).where(F.col("n") > leaf)
    split_b = spark.sparkContext.broadcast(_bitmap(big, bits))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, "vec", dim)
            for t in range(tables):
                u, c = np.unique(probe(x, t, digits, split_b.value, None, 1)[0][:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(_spot(u, bits)), pa.array(c.astype(np.int64))], names=["key", "spot", "n"])

    members = cut(points.select("vec").mapInArrow(own, "key bigint, spot bigint, n bigint").groupBy("key", "spot").agg(F.sum("n").alias("n")))
    there_b = spark.sparkContext.broadcast(_bitmap(members, bits))
    block, wide = max(leaf, n * tables // MOST + 1), max(4 * leaf, n * tables * probes // MOST + 1)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, "vec", dim)
            for t in range(tables):
                leaves, valid = probe(x, t, digits, split_b.value, there_b.value, probes)
                u, c = np.unique(leaves[valid], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["key", "n"])

    probing = points.select("vec").mapInArrow(tally, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("p"))
    grid = (
        probing.join(members.select("key", "n"), "key")
        .select("key", F.ceil(F.col("p") / wide).alias("chunks"), F.ceil(F.col("n") / block).alias("blocks"))
        .where("chunks > 1 OR blocks > 1")
        .orderBy("key")
        .collect()
    )
    release(members)
    grid_b = spark.sparkContext.broadcast((np.array([r.key for r in grid], np.int64), np.array([(r.chunks, r.blocks) for r in grid], np.int64).reshape(-1, 2)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per point and cell it takes part in; part: 1 it probes, 2 it is a member, 3 both. A leaf that the grid
        names has a cell for each chunk of those who probe and each block of members."""
        keys, sizes = grid_b.value
        for b in batches:
            if not b.num_rows:
                continue
            whole, all_ids = _matrix(b, "vec", dim), b.column("id").to_numpy()
            for s in range(0, len(all_ids), 2_000):
                x, ids = whole[s : s + 2_000], all_ids[s : s + 2_000]
                for t in range(tables):
                    leaves, valid = probe(x, t, digits, split_b.value, there_b.value, probes)
                    row, col = np.nonzero(valid)
                    key = leaves[row, col]
                    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                    spread = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                    plain = ~spread
                    yield _cells(key[plain], np.zeros(plain.sum(), np.int64), np.where(col[plain] == 0, 3, 1), ids[row[plain]], x[row[plain]])
                    if not spread.any():
                        continue
                    r, k_, mine = row[spread], key[spread], col[spread] == 0
                    chunks, blocks = sizes[at[spread]].T
                    with np.errstate(over="ignore"):
                        mix = ids[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    chunk, home = (mix >> np.uint64(33)).astype(np.int64) % chunks, ((mix >> np.uint64(13)) & np.uint64(0x7FFFFFFF)).astype(np.int64) % blocks
                    ask = np.repeat(np.arange(len(r)), blocks)
                    cell = chunk[ask] * blocks[ask] + np.concatenate([np.arange(z) for z in blocks])
                    yield _cells(k_[ask], cell, np.full(len(ask), 1), ids[r[ask]], x[r[ask]])
                    own_rows = np.flatnonzero(mine)
                    if len(own_rows):
                        be = np.repeat(own_rows, chunks[own_rows])
                        cell = np.concatenate([np.arange(z) for z in chunks[own_rows]]) * blocks[be] + home[be]
                        yield _cells(k_[be], cell, np.full(len(be), 2), ids[r[be]], x[r[be]])

    def _cells(key, cell, part, ids, x) -> pa.RecordBatch:
        flat = pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())
        vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(ids), [None, flat]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cell), pa.array(part.astype(np.int8)), pa.array(ids), vec], names=["key", "cell", "part", "id", "vec"])

    def compare(cell: pa.Table) -> pa.Table:
        part, ids = cell.column("part").to_numpy(), cell.column("id").to_numpy()
        col = cell.column("vec").combine_chunks()
        x = np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)
        mem = part >= 2
        mx, mids = x[mem], ids[mem]
        ask = np.nonzero(part != 2)[0]
        out_id, out_n, out_c = [], [], []
        if len(mids):
            q = min(k, len(mids))
            for s in range(0, len(ask), 1_024):
                a = ask[s : s + 1_024]
                sims = x[a] @ mx.T
                sims[ids[a][:, None] == mids[None]] = -9
                best = np.argpartition(-sims, q - 1, axis=1)[:, :q] if q < len(mids) else np.tile(np.arange(len(mids)), (len(a), 1))
                out_id.append(ids[a])
                out_n.append(mids[best])
                out_c.append(np.take_along_axis(sims, best, 1))
        width = out_n[0].shape[1] if out_n else 1
        i = np.concatenate(out_id) if out_id else np.zeros(0, np.int64)
        offsets = pa.array(np.arange(len(i) + 1, dtype=np.int32) * width)
        return pa.table(
            [
                pa.array(i),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out_n).ravel() if out_n else np.zeros(0, np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out_c).ravel() if out_c else np.zeros(0, np.float32))),
            ],
            names=["id", "nbr", "cos"],
        )

    compared = points.select("id", "vec").mapInArrow(assign, "key bigint, cell bigint, part tinyint, id bigint, vec binary").groupBy("key", "cell").applyInArrow(
        compare, "id bigint, nbr array<bigint>, cos array<float>"
    )
    gathered = compared.groupBy("id").agg(F.flatten(F.collect_list("nbr")).alias("nbr"), F.flatten(F.collect_list("cos")).alias("cos"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            oi, on, oc = [], [], []
            ids = b.column("id").to_numpy()
            ends = b.column("nbr").offsets.to_numpy()
            nbr, cos = b.column("nbr").values.to_numpy(), b.column("cos").values.to_numpy()
            for j, i in enumerate(ids):
                s, e = ends[j], ends[j + 1]
                order = np.lexsort((nbr[s:e], -cos[s:e]))
                m, c = nbr[s:e][order], cos[s:e][order]
                _, first = np.unique(m, return_index=True)
                first = np.sort(first[c[first] > -5])[:k]
                oi.append(np.full(len(first), i))
                on.append(m[first])
                oc.append(c[first])
            if oi:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(oi)), pa.array(np.concatenate(on)), pa.array(np.concatenate(oc))], names=["id", "nbr", "cos"])

    near = cut(gathered.mapInArrow(best, "id bigint, nbr bigint, cos float"))
    full = near.groupBy("id").count().where(F.col("count") >= min(k, n - 1)).select("id")
    lacking = cut(points.join(full, "id", "left_anti"))
    if n < 2 or lacking.isEmpty():
        return near
    found = batch_nearest(lacking, points, k, key="id", vec="vec").select(F.col("query").alias("id"), F.col("id").alias("nbr"), F.col("score").cast("float").alias("cos"))
    return near.join(lacking.select("id"), "id", "left_anti").unionByName(found)


def nearest_neighbours(
    rows: DataFrame, *, id_col: str = "image_id", vec_col: str = "vec", dim: int = 64, k: int = 10, tables: int = 6, probes: int = 3, leaf: int = 4_000
) -> DataFrame:
    """(image_id, neighbour, cos, place): the k most similar other ids of every id, nearest first, equal ones
    by smaller id. Unusable vectors (see unit_vectors) take no part; no usable vector gives no rows; with
    fewer than k + 1 ids each gets all others. Every vector is indexed and every vector asks; what is
    approximate is which leaves are looked at (recall against brute force: see the README)."""
    from pyspark.sql import Window

    unit = cut(unit_vectors(rows, id_col, vec_col, dim))
    first = Window.partitionBy("copy").orderBy("image_id")
    members = unit.select("copy", "image_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    classes = members.groupBy("copy").agg(F.array_sort(F.collect_list("image_id")).alias("members"))
    named = unit.groupBy("copy").agg(F.min_by("vec", "image_id").alias("vec"))
    points = cut(named.join(classes, "copy").sort(F.col("members")[0]).withColumn("id", F.monotonically_increasing_id()))
    near = nearest_classes(points.select("id", "vec"), k, tables, probes, leaf, dim)
    itself = points.where(F.size("members") > 1).select("id", F.col("id").alias("nbr"), F.lit(2.0).cast("float").alias("cos"))
    known = points.select(F.col("id").alias("nbr"), "members")
    listed = (
        near.unionByName(itself)
        .join(known, "nbr")
        .select("id", F.explode("members").alias("m"), "cos")
        .groupBy("id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), F.col("m")))), 1, k + 1).alias("near"))
    )
    asked = unit.select("image_id", "copy").join(points.select("copy", "id"), "copy").join(listed, "id")
    others = F.slice(F.filter("near", lambda x: x["m"] != F.col("image_id")), 1, k)
    return asked.select("image_id", F.posexplode(others).alias("pos", "n")).select(
        "image_id",
        F.col("n.m").alias("neighbour"),
        F.least(-F.col("n.d"), F.lit(1.0)).cast("double").alias("cos"),
        (F.col("pos") + 1).alias("place"),
    )


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(image_id_a, image_id_b), smaller id first, of which at least one is among the other's nearest."""
    return near.select(
        F.least("image_id", "neighbour").alias("image_id_a"), F.greatest("image_id", "neighbour").alias("image_id_b")
    ).distinct()
