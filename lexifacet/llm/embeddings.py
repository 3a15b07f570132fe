"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random (padded to 128 dimensions at least); the
signs are its code, and its factor is the inner product of the vector with its
code. The inner product of a code with another rotated vector, over the
factor, estimates the cosine without bias; its error is within
BOUND * sqrt((1 - f^2) / (f^2 (d - 1))) but for one pair in millions. Pairs
whose upper bound reaches the threshold are recomputed exactly in double
precision; others are passed over.

Equal vectors of a label are one class with a count. Classes meet in buckets
of equal signs at random hyperplanes, drawn afresh for each table so that
tables are independent, in as many tables as make a miss at the threshold rarer
than one in a million whatever the number of classes; within a bucket the codes
at a small distance are connected by a search that gives at most n - 1 edges. The components of these
are compared throughout, in blocks of BLOCK classes, so each vector moves once
unless its component is larger than a block, and no task holds a whole group.

Vectors that are null, empty, zero or hold null or non-finite components, and
those of null label, link with nothing and are kept. Vectors of different
lengths don't link. Repeated rows are vectors like any other; ties keep the
least vec_id. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, components, forest, runs
from .words import Cache, mix

THRESHOLD = 0.98
BOUND = 5.5
BLOCK = 1000
BUCKET = 20_000
SEED = 11


_ROTATION, _PLANES = Cache(), Cache()


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """(d, width): the first d rows of a random orthogonal matrix."""
    if (d, seed) not in _ROTATION:
        width = max(128, -(-d // 64) * 64)
        q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((width, width)))
        _ROTATION[d, seed] = (q * np.sign(np.diag(r)))[:d]
    return _ROTATION[d, seed]


def encode(x: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, signs as booleans, factors)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = unit @ rotation(x.shape[1], seed)
    return z, z > 0, np.abs(z).sum(1) / math.sqrt(z.shape[1])


def tables_for(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a bucket, tables): about four buckets for each class, and a miss at the threshold below 1e-6."""
    bits = min(48, max(8, math.ceil(math.log2(max(classes, 2))) + 2))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1e-6) / math.log(1 - alike))


def planes(d: int, bits: int, table: int, seed: int = SEED) -> np.ndarray:
    """(d, bits): the hyperplanes of one table."""
    key = d, bits, table, seed
    if key not in _PLANES:
        _PLANES[key] = np.random.default_rng([seed, d, table]).standard_normal((d, bits))
    return _PLANES[key]


def bucket_keys(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """For each table the signs of each vector at `bits` hyperplanes of its own."""
    power = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for t in range(tables):
        yield (x @ planes(x.shape[1], bits, t, seed) > 0).astype(np.uint64) @ power


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat, at = np.asarray(column.values, np.float64), np.asarray(column.offsets)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


def linked(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    scratch = Scratch(vectors.sparkSession)
    usable = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    marks = {"m": F.xxhash64("label", "embedding"), "m2": F.xxhash64(F.lit(1), "label", "embedding")}
    rows = rows.withColumns({k: F.when(F.col("usable"), v) for k, v in marks.items()})
    classes = rows.where("usable").groupBy("m", "m2", F.xxhash64("label", F.size("embedding")).alias("label"), "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = classes.withColumn("class", F.monotonically_increasing_id())  # numbers, so that none are mistaken

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, factor = [None] * len(b), np.zeros(len(b))
            for at, x in _matrix(b.column("embedding")):
                # scaled first: squares of very large or small components stay finite
                _, signs, f = encode(x / np.abs(x).max(1, keepdims=True))
                factor[at] = f
                for i, c in zip(at, np.packbits(signs, axis=1)):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("class", "m", "m2", "label", "embedding", "copies", "least")), pa.array(code, pa.binary()), pa.array(factor)], ["class", "m", "m2", "label", "embedding", "copies", "least", "code", "factor"])

    classes = scratch.save(classes.select("class", "m", "m2", "label", "embedding", "copies", "least").mapInArrow(codes, "class long, m long, m2 long, label long, embedding array<double>, copies long, least long, code binary, factor double"))
    bits, tables = tables_for(classes.count(), threshold)
    angle = math.acos(threshold) / math.pi

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column("label").to_numpy().view(np.uint64)
            key = np.zeros((len(b), tables), np.uint64)
            for at, x in _matrix(b.column("embedding")):
                for t, own in enumerate(bucket_keys(x / np.abs(x).max(1, keepdims=True), bits, tables)):
                    key[at, t] = own
            key = mix(mix(key) ^ mix(label)[:, None] ^ np.arange(1, tables + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
            take = pa.array(np.repeat(np.arange(len(b)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column("class").take(take), b.column("code").take(take)], ["bucket", "class", "code"])

    places = scratch.save(classes.select("class", "label", "embedding", "code").mapInArrow(buckets, "bucket long, class long, code binary"))
    full = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = blocks(places.join(full, "bucket"), "bucket", bucket)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, ["bucket", "x", "y"]):
            ids, code_of = t.column("class").to_numpy(), t.column("code").to_pylist()
            by: dict[int, list[int]] = {}
            for i, c in enumerate(code_of):
                by.setdefault(len(c), []).append(i)
            for w, own in by.items():
                code = np.frombuffer(b"".join(code_of[i] for i in own), np.uint64).reshape(len(own), w // 8)
                most = int(8 * w * angle + 6 * math.sqrt(8 * w * angle * (1 - angle)) + 2)
                for i, j in forest(len(own), lambda i, rest, code=code, most=most: np.bitwise_count(code[rest] ^ code[i]).sum(1) <= most):
                    a.append(ids[own[i]])
                    b.append(ids[own[j]])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    near = spread.select("bucket", "x", "y", "class", "code").mapInArrow(search, "a long, b long")
    groups = scratch.save(components(near, scratch))
    members = classes.join(groups.withColumnRenamed("id", "class"), "class")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    spread = blocks(members.join(sizes, "component"), "component", block)

    def compare(t: pa.Table) -> pa.RecordBatch:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        ids, sub, copies_of = t.column("class").to_numpy(), t.column("sub").to_numpy(), t.column("copies").to_numpy()
        links, a, b = np.zeros(len(ids), np.int64), [], []
        code_of, factor = t.column("code").to_pylist(), t.column("factor").to_numpy()
        for at, v in _matrix(t.column("embedding")):
            v = v / np.abs(v).max(1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            z = v @ rotation(v.shape[1])
            signs = np.unpackbits(np.frombuffer(b"".join(code_of[i] for i in at), np.uint8).reshape(len(at), -1), axis=1).astype(np.float32) * 2 - 1
            f = factor[at][:, None]
            estimate = (signs @ z.T.astype(np.float32)) / (math.sqrt(z.shape[1]) * f)
            upper = estimate + BOUND * np.sqrt(np.maximum(0, 1 - f**2) / (f**2 * (z.shape[1] - 1))) + 1e-4
            i, j = np.nonzero((upper >= threshold) | (upper.T >= threshold))
            ok = i < j
            if x != y:  # pairs inside a block are compared where the block meets itself
                ok &= sub[at[i]] != sub[at[j]]
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 200_000):
                p, q = i[s : s + 200_000], j[s : s + 200_000]
                good = np.einsum("nd,nd->n", v[p], v[q]) >= threshold
                p, q = at[p[good]], at[q[good]]
                np.add.at(links, p, copies_of[q])
                np.add.at(links, q, copies_of[p])
                a.append(p)
                b.append(q)
        p, q = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        root = np.arange(len(ids))
        while len(p):  # the least reachable row of each, so n - 1 edges at most leave
            new = root.copy()
            np.minimum.at(new, p, root[q])
            np.minimum.at(new, q, root[p])
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[root])], ["class", "links", "to"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["component", "x", "y"]):
            yield compare(t)

    found = scratch.save(spread.select("component", "x", "y", "sub", "class", "copies", "embedding", "code", "factor").mapInArrow(compared, "class long, links long, to long"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.where("class != to").select(F.col("class").alias("a"), F.col("to").alias("b")), scratch)
    named = classes.select("class", "m", "m2", "copies", "least").join(counts, "class", "left").join(joined.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(first, "component").select("m", "m2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.where("usable").select("vec_id", "m", "m2").join(named, ["m", "m2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
