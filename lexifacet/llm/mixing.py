"""Mixing sources to target weights by systematic sampling.

A document's expected copies are target / size of its source, the same for all
documents of a source. Within a source the documents lie in the order of (size
class, cell, id): each has the interval from b * rate + u to (b + 1) * rate + u,
where b counts the documents ahead and u is one random offset, and is emitted
once per whole number in (..]. So it gets floor or ceil of its expected copies,
at most 2 as no target is above twice its source's size; and as neighbours have
sizes within a sixteenth, the words taken come near the target.

Counts ahead are whole numbers summed per cell first, so reruns agree to the
row, and no task holds a source. Null texts have size 0, null sources are one
source (the last), equal rows share the copies that fall to them, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, prefix_sums, row_key

WORDS = r"[^\x20\x09-\x0D]+"
#: Cells of a size class; with about 16 classes a doubling they split any source.
CELLS = 1024
#: Sources up to which one task works out the targets.
FEW = 100_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source_key, source_size, target) for sizes (source_key, source_size): one row per source.

    Sources in the order of their key have the weights in turn and share
    share * all sizes; what is above most * source_size is given to the others by
    weight until none is above. In the order of cap / weight the capped ones come
    first, so the level of the rest is the largest of (total - caps ahead) /
    (weights - weights ahead).
    """
    few = sizes.limit(FEW + 1).count() <= FEW
    ranked = (ranks if few else ranks_of_many)(sizes).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size").cast("double"))
    if few:
        everything = Window.partitionBy()
        ahead = Window.orderBy(F.expr("cap / weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
        level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
        ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    else:  # reshare, round by round, until no further source is above its cap; sums of whole numbers, so as exact as in order
        total, level = share * ranked.agg(F.sum("source_size")).first()[0], 0.0
        while True:
            over = F.col("cap") <= level * F.col("weight")
            r = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weights")).first()
            new = (total - r["caps"]) / r["weights"] if r["weights"] else level
            if new <= level:
                break
            level = new
        ranked = ranked.withColumn("level", F.lit(level))
    return ranked.select("source_key", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def ranks(sizes: DataFrame) -> DataFrame:
    """sizes with rank: the place of each source in the order of its key, from 0."""
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy("source_key")).cast("long") - 1)


def ranks_of_many(sizes: DataFrame) -> DataFrame:
    """The same by ranges of keys, so that no task holds them all."""
    parts = Scratch(sizes.sparkSession).save(sizes.repartitionByRange("source_key").withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy("source_key")).cast("long")
    return parts.join(F.broadcast(counts), "part").withColumn("rank", own - 1 + F.col("ahead")).drop("part", "ahead")


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For rows (source, doc_id, size, further columns): one row each with source_size, target and copies.

    doc_id: whole numbers or null. Equal rows are counted first and spread again at the end.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key")
    columns = rows.columns
    rows = Scratch(rows.sparkSession).save(rows)  # the words are counted once
    rows = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select("*", key)
    of_source = targets(rows.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    bits = F.length(F.bin("size")).cast("int")
    classes = rows.withColumn("class", F.when(F.col("size") == 0, F.lit(0)).otherwise(bits * 32 + F.expr("(size * 32) div shiftleft(1L, length(bin(size)))")).cast("long"))
    more = [c for c in columns if c not in ("source", "doc_id", "size")]
    number = f"coalesce(doc_id, pmod(xxhash64({', '.join(more)}), 1000003L))" if more else "coalesce(doc_id, 0)"  # rows without an id lie apart too
    cells = classes.withColumn("cell", F.expr(f"(({number} % 1000003 + 1000003) % 1000003) * 2654435761 % 2147483647 % {CELLS}"))
    placed = prefix_sums(cells, ["source_key"], ["class", "cell"], ["doc_id", *[c for c in columns if c not in ("source", "doc_id")]], "n").join(of_source, "source_key")
    offset = F.conv(F.substring(F.md5("source_key"), 1, 8), 16, 10).cast("double") / 4294967296.0
    placed = placed.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("u", offset)
    one = placed.select(*columns, "source_size", "target", "rate", "u", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("b"))
    return one.select(*columns, "source_size", "target", F.expr("floor((b + 1) * rate + u) - floor(b * rate + u)").cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of each document."""
    slim = docs.select(F.col("source"), F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"))
    return copies(slim).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as many times as it has copies, in the table's columns.

    Copies are computed on ids and sizes; the texts are shuffled once, to meet
    them by a key of the whole row. Rows that are equal throughout meet one
    total and are collapsed before it is spread.
    """
    k, n, c = (free_name(docs, x) for x in ("__k", "__rows", "__copies"))
    keyed = docs.withColumn(k, row_key(*docs.columns))
    slim = keyed.select("source", F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"), F.col(k).alias("k"))
    total = copies(slim).groupBy(F.col("k").alias(k)).agg(F.sum("copies").alias(c), F.count(F.lit(1)).alias(n)).where(F.col(c) > 0)
    met = keyed.join(total, k)
    columns = [F.col(f"`{x}`") for x in docs.columns]
    single = met.where(F.col(n) == 1).select(*columns, c)
    repeated = met.where(F.col(n) > 1).groupBy(*columns).agg(F.first(c).alias(c))
    spread = single.union(repeated).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(c).cast("int"))))
    return spread.select(*columns)
