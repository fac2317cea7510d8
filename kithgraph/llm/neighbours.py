"""The most similar vectors of every vector, by shifted space-filling curves.

Every unit vector is projected by several random rotations to a few coordinates, each coordinate made uniform by
quantiles, shifted, and the grid cell's place on a Hilbert curve becomes its key: one ordering of all vectors per
curve. Orderings are range-partitioned and sorted in Spark; each partition then streams over its rows in blocks and
compares every block with itself and the next few by matrix products of 8-bit codes. What comes near the threshold
is reranked by the true cosine of the stored vectors, and the k best of every vector are kept.

The only thing fitted are the quantiles, on a sample of at most SAMPLE rows; every usable row is indexed. Nothing is
broadcast but the rotations and quantiles, whose size is fixed.

Defined results: null, wrong-sized, not finite and all-zero vectors are not usable and have no neighbours; the
length of a vector doesn't matter; ties at the k-th place go to the smaller id. Exact copies are one row in the
windows, known by the hash of the vector, and get their partners back by id order, so a group of copies of any size yields
at most k pairs a row. A block keeps all partners of a row that may be among its k most similar by the error of the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.session import written

DIM = 64
CURVES = 10
AXES, BITS = 16, 2
BLOCK, AHEAD = 512, 3
#: Codes of 8 bits err by less than this, so what is within it of the threshold is reranked.
SLACK = 0.012
#: Bits of a key below the cell: one more level of the curve, then the place along the curve's first axis.
FINE = 15
SAMPLE = 20_000
ROWS_PER_TASK = 150_000
_SEED = 7


def rotations(curves: int = CURVES) -> np.ndarray:
    """(curves, DIM, AXES): the first columns of random orthogonal matrices."""
    r = np.random.default_rng(_SEED)
    return np.stack([np.linalg.qr(r.standard_normal((DIM, DIM)))[0][:, :AXES] for _ in range(curves)]).astype(np.float32)


def shifts(curves: int = CURVES) -> np.ndarray:
    return np.random.default_rng(_SEED + 1).uniform(-0.25, 0.25, (curves, AXES)).astype(np.float32)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells (n, axes), for axes * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the curve's rotations, from the coarsest bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def unit_vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable vectors of a list column."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(arr), 0))
    rows = np.flatnonzero(lengths == DIM)
    if not len(rows):
        return rows, np.empty((0, DIM), dtype=np.float32)
    flat = arr.take(pa.array(rows)).flatten()
    v = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, DIM)  # nulls become NaN
    ok = np.isfinite(v).all(1) & (v != 0).any(1)
    rows, v = rows[ok], v[ok]
    v = v / np.abs(v).max(1, keepdims=True)
    return rows, (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _encoder(quantiles: np.ndarray, curves: int):
    turn, shift = rotations(curves), shifts(curves)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, u = unit_vectors(batch.column("embedding"))
            if not len(rows):
                continue
            keys = np.empty((len(u), curves), dtype=np.int64)
            for c in range(curves):
                y = u @ turn[c]
                place = np.stack([np.searchsorted(quantiles[c, a], y[:, a]) for a in range(AXES)], axis=1) / quantiles.shape[2]
                cells = ((place + shift[c] + 0.25) / 1.5 * (2 << BITS)).astype(np.int64).clip(0, (2 << BITS) - 1)
                along = ((y[:, 0] + 1) / 2 * ((1 << FINE) - 1)).astype(np.int64).clip(0, (1 << FINE) - 1)
                keys[:, c] = hilbert(cells, BITS + 1) << FINE | along
            scale = np.abs(u).max(1, keepdims=True)
            codes = np.rint(u / scale * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), batch.column("rid").take(pa.array(rows)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, curves, dtype=np.int32)), pa.array(keys.ravel()))],
                names=["id", "rid", "code", "keys"],
            )

    return encode


def _fit(vectors: DataFrame, total: int, curves: int) -> np.ndarray:
    """Quantiles of every projected coordinate, on at most SAMPLE rows."""
    share = min(1.0, SAMPLE / max(1, total))
    rows = vectors.sample(share * 0.95, seed=_SEED).limit(SAMPLE) if share < 1 else vectors
    _, u = unit_vectors(rows.select("embedding").toArrow().column("embedding"))
    if not len(u):
        u = np.eye(DIM, dtype=np.float32)
    at = np.linspace(0, 1, 65)[1:-1]
    return np.stack([np.quantile(u @ t, at, axis=0).T for t in rotations(curves)]).astype(np.float32)


def _block_pairs(x: np.ndarray, y: np.ndarray, same: bool, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) at or above `least`, without those below the k-th similarity of both rows by more than
    two codes err."""
    s = x @ y.T
    if same:
        np.fill_diagonal(s, -2)
    near = s >= least
    if not near.any():
        return np.nonzero(near)
    if max(near.sum(0).max(), near.sum(1).max()) > k:
        kth = lambda m: np.partition(m, m.shape[1] - k, axis=1)[:, -k] if m.shape[1] > k else np.full(len(m), -2, m.dtype)
        near &= (s >= kth(s)[:, None] - 2 * SLACK) | (s >= kth(s.T)[None, :] - 2 * SLACK)
    return np.nonzero(np.triu(near) if same else near)


def _windows(least: float, k: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last AHEAD blocks of the curve
        rest_ids, rest_codes, curve = np.empty(0, dtype=np.int64), np.empty((0, DIM), dtype=np.int8), -1
        last = None  # (curve, vector) of the row before

        def block(ids: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            f = codes.astype(np.float32)
            f /= np.linalg.norm(f, axis=1, keepdims=True)
            for other_ids, other, same in [*((a, b, False) for a, b in held), (ids, f, True)]:
                i, j = _block_pairs(other, f, same, least, k)
                if len(i):
                    p, q = other_ids[i], ids[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])
            held.append((ids, f))
            del held[:-AHEAD]

        for batch in batches:
            ids, curves = batch.column("rid").to_numpy(), batch.column("curve").to_numpy()
            raw = batch.column("code")
            codes = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.int8).reshape(-1, DIM)
            if not len(ids):
                continue
            first = np.r_[(curves[0], ids[0]) != last, (curves[1:] != curves[:-1]) | (ids[1:] != ids[:-1])]
            last = (curves[-1], ids[-1])
            ids, curves, codes = ids[first], curves[first], codes[first]
            if not len(ids):
                continue
            edges = [0, *(np.flatnonzero(curves[1:] != curves[:-1]) + 1).tolist(), len(curves)]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if curves[s] != curve:
                    if len(rest_ids):
                        yield from block(rest_ids, rest_codes)
                    held.clear()
                    rest_ids, rest_codes, curve = rest_ids[:0], rest_codes[:0], curves[s]
                rest_ids, rest_codes = np.concatenate([rest_ids, ids[s:e]]), np.concatenate([rest_codes, codes[s:e]])
                while len(rest_ids) >= BLOCK:
                    yield from block(rest_ids[:BLOCK], rest_codes[:BLOCK])
                    rest_ids, rest_codes = rest_ids[BLOCK:], rest_codes[BLOCK:]
        if len(rest_ids):
            yield from block(rest_ids, rest_codes)

    return stream


def cosine(a, b):
    """Cosine of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def most_similar(vectors: DataFrame, least: float, k: int = 5, curves: int = CURVES) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: pairs of at least `least` in which one is among the other's k most similar.

    `vectors` has id and embedding.
    """
    vectors = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    quantiles = _fit(vectors, vectors.count(), curves)
    hashed = vectors.where("id IS NOT NULL").withColumn("rid", F.xxhash64("embedding"))
    table = written(hashed.mapInArrow(_encoder(quantiles, curves), "id string, rid bigint, code binary, keys array<bigint>"), "curves")
    rows = table.count() * curves
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    ordered = table.select("rid", "code", F.posexplode("keys").alias("curve", "key")).repartitionByRange(tasks, "curve", "key").sortWithinPartitions("curve", "key", "rid")
    near = ordered.mapInArrow(_windows(least - SLACK, k), "a bigint, b bigint").distinct()
    by_id = Window.partitionBy("rid").orderBy("id")
    names = table.select("rid", "id", F.dense_rank().over(by_id).alias("n"), F.first("id").over(by_id).alias("one")).distinct()
    names = written(names.withColumn("one", F.when(F.col("n") > 1, F.col("one"))), "names")  # `one`, the smallest id of equal vectors, stands for all
    copied = names.where("n = 2").select("one")
    copies = names.where("n > 1").select("one", "id", "n").unionByName(copied.select("one", F.col("one").alias("id"), F.lit(1).alias("n")))
    ones = names.where("n = 1")
    pairs = near.join(ones.select(F.col("rid").alias("a"), F.col("id").alias("p")), "a").join(ones.select(F.col("rid").alias("b"), F.col("id").alias("q")), "b").select("p", "q")
    pairs = pairs.unionByName(copied.select(F.col("one").alias("p"), F.col("one").alias("q")))
    left, right = vectors.select(F.col("id").alias("p"), F.col("embedding").alias("x")), vectors.select(F.col("id").alias("q"), F.col("embedding").alias("y"))
    exact = pairs.join(left, "p").join(right, "q").select("p", "q", cosine(F.col("x"), F.col("y")).alias("cosine")).where(F.col("cosine") >= least)
    both = exact.select(F.col("p").alias("of"), F.struct((-F.col("cosine")).alias("far"), F.col("q").alias("id")).alias("n")).unionByName(exact.select(F.col("q").alias("of"), F.struct((-F.col("cosine")).alias("far"), F.col("p").alias("id")).alias("n")))
    best = lambda d: d.groupBy("of").agg(F.slice(F.array_sort(F.collect_set("n")), 1, k + 1).alias("best"))
    # The first k + 1 vectors of each, itself among them if it has copies; then the first k + 1 ids; then k without its own.
    few = copies.where(F.col("n") <= k + 1).select("one", F.col("id").alias("copy"))
    wide = best(both).select("of", F.inline("best")).join(few.withColumnRenamed("one", "id"), "id", "left")
    lists = best(wide.select("of", F.struct("far", F.coalesce("copy", "id").alias("id")).alias("n")))
    every = lists.join(copies.select(F.col("one").alias("of"), F.col("id").alias("member")), "of", "left").select(F.coalesce("member", "of").alias("of"), "best")
    kept = every.select("of", F.inline(F.slice(F.filter("best", lambda n: n["id"] != F.col("of")), 1, k)))
    return kept.select(F.least("of", "id").alias("id_a"), F.greatest("of", "id").alias("id_b"), (-F.col("far")).alias("cosine")).distinct()
