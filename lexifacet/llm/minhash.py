"""Near-duplicate documents by a chosen-path similarity join on sets of word shingles.

Texts are lower-cased (A-Z) and cut into words; a text's set holds its distinct
shingles of k words, or its whole sequence if it has fewer. Texts with equal
sets form one class first, by a pre-aggregated grouping, so copies are never
paired.

Each tree branches the classes: a node takes BRANCH of the 64 minwise
coordinates by a hash of its path, and a class follows the value it has there,
so a pair of similarity s shares a child with 1 - (1 - s)^BRANCH. Nodes of one
class end, and nodes above SMALL classes branch on, DEPTH levels at most. A
small node is compared exhaustively by one byte of each coordinate, which
yields at most n - 1 edges; so is, in blocks of SMALL, one that is left at the
last level. TREES independent trees bring the chance to miss a pair at the
threshold to about one in a million. What these edges connect is a family.
Only members of families have their sets built again from their texts. The
edges themselves are confirmed on full sets first, a hub with BLOCK others at a
time; as nodes agree on hubs, a cluster's set moves a few times whatever the
cluster's size. A family that this leaves in several parts is compared in
blocks bounded by rows and bytes: the parts but the largest with each other
and with the largest, again with at most n - 1 edges out. These links join
into components. So pairs are never shuffled.

A null or wordless text has the empty set, links with nothing and is kept.
Rows repeated throughout are one document with several rows. Null ids count as
the largest. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Scratch, blocks, blocks_with_main, components, forest, free_name, row_key, runs
from .words import Words, chunks, mix, sets, utf8

COORDINATES = 64
TREES = 5
BRANCH = 2
SMALL = 2000
DEPTH = 4
#: Sets, and their bytes, that are compared with one hub at a time, or are a block of a family that its edges don't connect.
BLOCK = 500
BLOCK_BYTES = 16_000_000
_XOR = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(np.arange(101, COORDINATES + 101, dtype=np.uint64)) | np.uint64(1)


def digests(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, marks, coordinates) of each text: equal sets have equal marks, which are two hashes."""
    data, offsets = utf8(column)
    n = len(column)
    many, group = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
    low = np.zeros((n, COORDINATES), np.uint32)
    for lo, hi in chunks(offsets):
        element, first = sets(Words(data, offsets, lo, hi), k)
        many[lo:hi] = np.diff(first)
        some = np.flatnonzero(many[lo:hi])
        if not len(some):
            continue
        u, at = mix(element), first[:-1][some]
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            group[lo + some, i] = mix(np.add.reduceat(mix(u ^ np.uint64(salt)), at) + many[lo + some].astype(np.uint64))
        for i in range(COORDINATES):
            low[lo + some, i] = mix(np.minimum.reduceat((u ^ _XOR[i]) * _TIMES[i], at)) >> np.uint64(32)
    return many, group, low


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        element, first = sets(Words(data, offsets, lo, hi), k)
        for a, z in zip(first, first[1:]):
            yield element[a:z].astype(np.int64)


def _alike(num: int, den: int) -> int:
    """Coordinates that a pair at the threshold agrees in, but for one in a million."""
    p, n, total, d = 1 - num / den, COORDINATES, 0.0, 0
    term = (1 - p) ** n
    while True:
        total += term
        if total > 1 - 1e-6 or d == n:
            return n - d
        term *= (n - d) / (d + 1) * p / (1 - p)
        d += 1


def _codes(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, COORDINATES)


def links(docs: DataFrame, scratch: Scratch, key: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (key, doc_id, n_shingles, m, m2) of all documents; (m, m2, component) of the sets, by their marks.

    docs: key (a key of the whole row), doc_id, text. Sets with
    den * intersection >= num * union link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many, group, low = digests(b.column("text"), k)
            code = np.ascontiguousarray((low & np.uint32(255)).astype(np.uint8))
            fixed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(b), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for w, x in ((COORDINATES, code), (4 * COORDINATES, low))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(many), *(pa.array(group[:, i].copy().view(np.int64)) for i in (0, 1)), *fixed], ["key", "doc_id", "n_shingles", "m", "m2", "code", "low"])

    slim = docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.save(slim.mapInArrow(run, f"key {KEY}, doc_id long, n_shingles long, m long, m2 long, code binary, low binary"))
    least = rows.where("n_shingles > 0").groupBy("m", "m2").agg(F.min("key").alias("key"))
    classes = rows.select("m", "m2", "key", F.col("n_shingles").alias("size"), "code", "low").join(least, ["m", "m2", "key"]).dropDuplicates(["m", "m2"])
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()))  # numbers, so that none are mistaken
    alike = _alike(num, den)

    def children(nodes: DataFrame) -> DataFrame:
        """(path, class): nodes (path, class, low) one step on, at BRANCH coordinates that hang on the path."""
        picks = []
        for j in range(BRANCH):
            c = f"cast(pmod(xxhash64(path, {j}), {COORDINATES}) as int)"
            picks.append(F.expr(f"xxhash64(path, {j}, substring(low, {c} * 4 + 1, 4))"))
        return nodes.select("class", F.explode(F.array(*picks)).alias("path"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, ["path", "x", "y"]):
            code, ids = _codes(t), t.column("class").to_numpy()
            order = np.argsort(ids)  # the least class is the hub in every node where it occurs, so nodes name the same edges
            code, ids = code[order], ids[order]
            for i, j in forest(len(ids), lambda i, rest, code=code: (code[rest] == code[i]).sum(1) >= alike):
                a.append(ids[i])
                b.append(ids[j])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    trees = F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])).alias("path")
    nodes = children(classes.select("class", "low", trees))
    near: DataFrame | None = None
    for depth in range(1, DEPTH + 1):
        many = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        member = scratch.save(nodes.join(many, "path"))
        small = f"n <= {SMALL}" if depth < DEPTH else "true"
        edges = blocks(member.where(small).join(classes.select("class", "code"), "class"), "path", SMALL).select("path", "x", "y", "class", "code").mapInArrow(search, "a long, b long")
        edges = scratch.save(edges.distinct())
        near = edges if near is None else near.union(edges)
        large = member.where(f"not ({small})")
        if depth == DEPTH or large.isEmpty():
            break
        nodes = children(large.select("path", "class").join(classes.select("class", "low"), "class"))
    near = near.distinct()
    families = scratch.save(components(near, scratch))

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class", "size", "code"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list(text_sets(b.column("text"), k)), pa.list_(pa.int64()))], [*names, "elements"])

    wanted = classes.join(families.select(F.col("id").alias("class")), "class").select(F.col("key").alias(key), "class", "size", "code")
    sets_of = scratch.save(docs.select(key, "text").join(wanted, key).select("class", "size", "code", "text").mapInArrow(set_rows, "class long, size long, code binary, elements array<long>"))

    # edges first: each hub meets the sets it was joined to, HUB at a time
    number = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles * 8 / BLOCK_BYTES)).cast("int")
    edges = near.select("a", F.col("b").alias("class")).join(classes.select("class", "size"), "class")
    hubs = edges.groupBy("a").agg(number(F.count(F.lit(1)), F.sum("size")).alias("chunks"))
    spread = edges.join(hubs, "a").select("a", F.expr("cast(pmod(xxhash64(class), chunks) as int)").alias("chunk"), "class")
    spread = spread.union(spread.select("a", "chunk", F.col("a").alias("class")).distinct())

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, ["a", "chunk"]):
            ids, hub = t.column("class").to_numpy(), t.column("a")[0].as_py()
            rest = np.flatnonzero(ids != hub)
            hit = Sets(t, alike, num, den).near(int(np.flatnonzero(ids == hub)[0]), rest)
            a += [hub] * int(hit.sum())
            b += ids[rest[hit]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = spread.join(sets_of, "class").repartition("a", "chunk").sortWithinPartitions("a", "chunk")
    sure = scratch.save(met.select("a", "chunk", "class", "code", "elements").mapInArrow(confirm, "a long, b long"))
    own = scratch.save(components(sure, scratch).withColumnsRenamed({"id": "class", "component": "part"}))

    # then the families which that leaves in several parts: their largest part and the others, in blocks
    member = families.withColumnsRenamed({"id": "class", "component": "family"}).join(own, "class", "left").withColumn("part", F.coalesce("part", "class"))
    member = member.join(classes.select("class", "size"), "class")
    parts = member.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    of_family = parts.groupBy("family").agg(F.count(F.lit(1)).alias("many"), F.max_by("part", F.struct("n", "part")).alias("largest"), F.max(F.struct("n", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("many > 1")
    of_family = of_family.select("family", "largest", number(F.col("top.n"), F.col("top.shingles")).alias("main_parts"), number(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("other_parts"))
    apart = member.join(of_family, "family").select("family", "class", "part", (F.col("part") == F.col("largest")).alias("main"), "main_parts", "other_parts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, ["family", "x", "y"]):
            ids, part = t.column("class").to_numpy(), t.column("part").to_numpy()
            for i, j in linked_sets(t, alike, num, den):
                if part[i] != part[j]:
                    a.append(ids[i])
                    b.append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = blocks_with_main(apart.join(sets_of.drop("size"), "class"), "family")
    more = scratch.save(met.select("family", "x", "y", "class", "part", "code", "elements").mapInArrow(compare, "a long, b long"))
    joined = components(sure.union(more), scratch) if not more.isEmpty() else own.withColumnsRenamed({"class": "id", "part": "component"})
    named = classes.select("m", "m2", "class").join(joined.withColumnRenamed("id", "class"), "class", "left")
    return rows.select("key", "doc_id", "n_shingles", "m", "m2"), scratch.save(named.select("m", "m2", F.coalesce("component", "class").alias("component")))


class Sets:
    """Sets of a block, rows (code, elements, and part if some are known to be connected), to be compared with each other."""

    def __init__(self, t: pa.Table, alike: int, num: int, den: int):
        self.code, self.alike, self.num, self.den = _codes(t), alike, num, den
        self.part = t.column("part").to_numpy() if "part" in t.column_names else np.arange(t.num_rows)
        column = t.column("elements").combine_chunks()
        offsets = np.asarray(column.offsets).astype(np.int64)
        self.flat = np.unique(np.asarray(column.values), return_inverse=True)[1].astype(np.int32)
        self.offsets, self.size = offsets - offsets[0], np.diff(offsets)
        self.mark = np.zeros(self.flat.max() + 1 if len(self.flat) else 0, bool)

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Which of the sets `rest` link with set i, or are of its part."""
        size, same = self.size, self.part[rest] == self.part[i]
        hit = ~same
        hit[hit] = (self.code[rest[hit]] == self.code[i]).sum(1) >= self.alike
        hit &= np.minimum(size[rest], size[i]) * self.den >= np.maximum(size[rest], size[i]) * self.num
        some = rest[hit]
        if len(some):
            own = self.flat[self.offsets[i] : self.offsets[i + 1]]
            self.mark[own] = True
            many = size[some]
            first = np.cumsum(many) - many
            at = np.arange(many.sum()) + np.repeat(self.offsets[some] - first, many)
            shared = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), first)
            self.mark[own] = False
            hit[hit] = shared * (self.den + self.num) >= self.num * (many + size[i])
        return hit | same


def linked_sets(t: pa.Table, alike: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Edges that connect the sets of a block by links confirmed on full sets, and those of a part."""
    own = Sets(t, alike, num, den)
    return forest(len(own.size), own.near)


def document_components(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document (rows that repeat, repeat)."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(row_key("doc_id", "text").alias("__k"), "doc_id", "text")
    rows, named = links(keyed, scratch, "__k", k, num, den)
    rows = rows.select("doc_id", "n_shingles", "m", "m2")
    of_set = rows.where("n_shingles > 0").groupBy("m", "m2").agg(F.min("doc_id").alias("least")).join(named, ["m", "m2"])
    of_component = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    least = of_set.join(of_component, "component").select("m", "m2", "component_id")
    linked = rows.where("n_shingles > 0").join(least, ["m", "m2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, one of each component (least doc_id, then least row key) and all without words; all columns as they are."""
    scratch = Scratch(docs.sparkSession)
    name = free_name(docs, "__k")
    keyed = docs.withColumn(name, row_key(*docs.columns))
    rows, named = links(keyed, scratch, name, k, num, den)
    order = F.struct(F.coalesce("doc_id", F.lit(9223372036854775807)).alias("d"), F.col("key"))
    by_set = rows.where("n_shingles > 0").groupBy("m", "m2").agg(F.min(order).alias("o")).join(named, ["m", "m2"])
    keep = by_set.groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.key").alias(name))
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")).withColumnRenamed("key", name)
    keep = scratch.save(many.join(keep.withColumn("stays", F.lit(True)), name, "left").where("stays or n = 0").select(name, F.expr("rows > 1 and n > 0").alias("__several")))
    met = keyed.join(keep, name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return met.where("not __several").select(*columns).union(met.where("__several").select(*columns).distinct())
