"""Count-ordered and index-ordered pages, and result windows around a target key.

A window needs at most max(offset, limit) keys below the target and
limit + max(-offset, 0) from it on: two bounded top-k plans, whatever the size
of the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(page: DataFrame, *order: Column) -> DataFrame:
    """pos 0, 1, .. of a page of bounded length."""
    return page.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


#: Cells that an unbounded page is cut into.
CELLS = 256


def _numbered_all(rows: DataFrame, key: Column) -> DataFrame:
    """pos 0, 1, .. of all rows by an ascending key, no row with an equal one; cells between sampled keys are numbered apart, after the rows of the cells ahead."""
    keyed = rows.withColumn("__key", key)
    bounds = keyed.select("__key").orderBy(F.xxhash64("__key")).limit(CELLS - 1).agg(F.array_sort(F.collect_list("__key")).alias("__bounds"))
    cut = keyed.crossJoin(F.broadcast(bounds)).withColumn("__cell", F.size(F.filter("__bounds", lambda b: b <= F.col("__key")))).drop("__bounds")
    ahead = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # over CELLS rows
    cells = cut.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).select("__cell", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy("__key"))
    return cut.join(F.broadcast(cells), "__cell").withColumn("pos", (place - 1 + F.col("__ahead")).cast("long")).drop("__cell", "__key", "__ahead")


def page(rows: DataFrame, limit: int, offset: int, *order: Column, key: Column) -> DataFrame:
    """rows offset .. offset + limit in the given order, with pos; limit < 0 is unbounded and uses `key`, the same order as one ascending value."""
    if limit < 0:
        every = _numbered_all(rows, key)
        return every.where(F.col("pos") >= offset).withColumn("pos", F.col("pos") - offset) if offset else every
    return _numbered(rows.orderBy(*order).offset(offset).limit(limit), *order)


def count_page(counts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(pos, term, cnt) by count descending, then term; limit < 0 is unbounded."""
    return page(counts, limit, offset, F.desc("cnt"), F.asc("term"), key=F.struct((-F.col("cnt")).alias("c"), "term"))


def index_page(counts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(pos, term, cnt) by term; limit < 0 is unbounded."""
    return page(counts, limit, offset, F.asc("term"), key=F.col("term"))


def target_window(keys: DataFrame, key: list[str], below: Column, limit: int, offset: int = 0) -> DataFrame:
    """keys around a target, with pos, n_rows and target_offset; below: whether a key is less than the target.

    The window holds `limit` keys if there are as many; within that, `offset`
    keys lie ahead of the target (negative: it starts so many after). At either
    end of the keys it is shifted to stay full. target_offset says where the
    target would stand in it; it may lie outside.
    """
    if limit < 1:
        raise ValueError("a target needs limit >= 1")
    down, up = [F.desc(k) for k in key], [F.asc(k) for k in key]
    low = keys.where(below).orderBy(*down).limit(max(offset, limit))
    high = keys.where(~below).orderBy(*up).limit(limit + max(-offset, 0))
    both = low.withColumn("__low", F.lit(True)).unionByName(high.withColumn("__low", F.lit(False)))
    every = Window.partitionBy()  # over the bounded union only
    ranked = both.withColumn("__b", F.count_if("__low").over(every)).withColumn("__a", F.count_if(~F.col("__low")).over(every)).withColumn("__rel", F.row_number().over(Window.orderBy(*up)) - 1 - F.col("__b"))
    ranked = ranked.withColumn("target_offset", F.least("__b", F.greatest(F.lit(offset).cast("long"), limit - F.col("__a"))).cast("long"))
    kept = ranked.where((F.col("__rel") >= -F.col("target_offset")) & (F.col("__rel") < limit - F.col("target_offset")))
    return kept.withColumn("n_rows", F.count(F.lit(1)).over(every)).withColumn("pos", (F.col("__rel") + F.col("target_offset")).cast("long")).drop("__low", "__b", "__a", "__rel")


def term_window(counts: DataFrame, target: str, limit: int, offset: int = 0) -> DataFrame:
    """target_window over (term, cnt)."""
    return target_window(counts, ["term"], F.col("term") < F.lit(target), limit, offset).select("pos", "term", "cnt", "n_rows", "target_offset")


def doc_window(rows: DataFrame, dictionary: DataFrame, target: str, target_doc: str, limit: int, offset: int = 0) -> DataFrame:
    """Window over (term, doc_key) pairs, offset and limit counting documents.

    A target that is no term of the dictionary (column term) starts at the first
    document of the next term, whatever target_doc says.
    """
    hit = dictionary.where(F.col("term") == target).limit(1).agg(F.count(F.lit(1)).alias("__hit"))
    rows = rows.crossJoin(F.broadcast(hit))  # one row: whether the target is a term
    doc = F.when(F.col("__hit") > 0, F.lit(target_doc)).otherwise(F.lit(""))
    below = (F.col("term") < F.lit(target)) | ((F.col("term") == F.lit(target)) & (F.col("doc_key") < doc))
    return target_window(rows, ["term", "doc_key"], below, limit, offset).drop("__hit")


def strict_window(rows: DataFrame, target: tuple[str, str, str | None], limit: int, offset: int = 0) -> DataFrame:
    """Window over (norm, filing, prefix) compared as a whole; a missing prefix is least."""
    n, f, p = (F.lit(x).cast("string") for x in target)
    below = F.struct("norm", "filing", "prefix") < F.struct(n.alias("norm"), f.alias("filing"), p.alias("prefix"))
    return target_window(rows, ["norm", "filing", "prefix"], below, limit, offset)
