"""What several operators share: tables in the shared folder, connected components, keys of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset on a local master, as in tests, a temporary one is used; unset on a cluster is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="lexifacet-"))
    return _OWN[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors. What is not dropped goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_folder(spark)}/lexifacet-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all."""
        try:
            jvm = self.spark._jvm
            for path in [t._scratch_path for t in tables] or [self.at]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if tables:
                raise


#: The type of row keys.
KEY = "struct<a: long, b: long>"


def row_hash(*columns: str) -> Column:
    """A 64-bit hash of a row; which columns are null counts, as the hash itself skips nulls."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*quoted, F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in quoted]))


def row_key(*columns: str) -> Column:
    """A key of a row, of two hashes: equal rows have equal keys, and 128 bits keep others apart at any number of rows."""
    quoted = [F.col(f"`{c}`") for c in columns]
    return F.struct(row_hash(*columns).alias("a"), F.xxhash64(F.lit(0x9E3779B9), *quoted).alias("b"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, **new: Column) -> DataFrame:
    """The table and new columns at its end; columns of the same names, in any case, are replaced."""
    names = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in new.items()])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the least id that each end of an edge (a, b) reaches; ids that have no edge do not occur.

    Alternating large-star and small-star steps: each takes the least neighbour
    by a pre-aggregated minimum and a join, so a hub is never gathered in one
    task (AQE splits its join partition). Ends when a round changes nothing.
    """
    at = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        n = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == (n["n"], n["s"]) or not n["n"]:
            return at.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(at.select(F.col("v"), F.col("v")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
        seen = (n["n"], n["s"])
        both = at.union(at.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a != b")
        new = scratch.save(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        scratch.drop(at)
        at = new


def drop_rows(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose key is in the column k of keys."""
    name = free_name(docs, "__k")
    return docs.withColumn(name, key).join(keys.select(F.col("k").alias(name)).distinct(), name, "left_anti").drop(name).select(*[f"`{c}`" for c in docs.columns])


def prefix_sums(df: DataFrame, group: list[str], cell: list[str], order: list[str], value: str) -> DataFrame:
    """df with `before` and `total`: the sums of `value` (whole numbers) over the rows ahead in the group, and over the group.

    The order is `cell`, then `order`; no column of group or cell may be null.
    Rows are summed by (group, cell) first, so that a task sorts one cell or
    the cells of one group, never the rows of a group: the caller picks cells
    that split any hot group, and bounds their number.
    """
    cells = df.groupBy(*group, *cell).agg(F.sum(value).alias("__cell"))
    ahead = Window.partitionBy(*group).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, *cell, F.coalesce(F.sum("__cell").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__cell").over(Window.partitionBy(*group)).alias("total"))
    inside = Window.partitionBy(*group, *cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(cells, [*group, *cell]).withColumn("before", F.col("__ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__ahead")


def blocks(rows: DataFrame, group: str, most: int) -> DataFrame:
    """rows (with class, and n, the size of their group) sorted into groups (group, x, y), each in one partition.

    A group of up to `most` rows has the one block pair (0, 0). A larger one is
    cut into blocks by a hash of the class, `sub`, and each pair of its blocks
    meets once, so that no task holds more than two blocks.
    """
    rows = rows.withColumn("parts", F.expr(f"cast(ceil(n / {most}) as int)")).withColumn("sub", F.expr("cast(pmod(xxhash64(class), parts) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return _pairs(rows.drop("parts", "n"), group)


def blocks_with_main(rows: DataFrame, group: str) -> DataFrame:
    """Like blocks(), for rows with class, main (whether of the part of the group that is known to be connected), main_parts and other_parts, its numbers of blocks.

    Two blocks of the main part needn't meet: each of its rows goes to the blocks of the others only.
    """
    first = "if(main, 0, main_parts)"
    rows = rows.withColumn("sub", F.expr(f"cast({first} + pmod(xxhash64(class), if(main, main_parts, other_parts)) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(if(main, main_parts, 0), main_parts + other_parts - 1)")))
    return _pairs(rows.drop("main", "main_parts", "other_parts"), group)


def _pairs(rows: DataFrame, group: str) -> DataFrame:
    rows = rows.withColumn("x", F.least("sub", "other")).withColumn("y", F.greatest("sub", "other")).drop("other")
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The stretches of equal keys of sorted batches, each as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """At most n - 1 edges that connect 0..n-1 as far as near(i, others), a mask, does."""
    rest, queue = np.arange(1, n), [0]
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        i = queue.pop()
        hit = near(i, rest)
        for j in rest[hit].tolist():
            yield i, j
            queue.append(j)
        rest = rest[~hit]
