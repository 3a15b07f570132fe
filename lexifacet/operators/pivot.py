"""Pivot facets: nested term counts, each level ranked and cut within its parent, and the heatmap grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_counts(df: DataFrame, fields: dict[str, Column], pred: Column | None = None, mincount: int = 1, limit: int | list[int] = -1, offset: int | list[int] = 0, by_count: bool | list[bool] = True, queries: dict[str, Column] | None = None) -> DataFrame:
    """(level, <fields>, cnt, <queries>, pos): one row per node; children of a node that is cut are cut too.

    One rollup gives every level; queries count below each node. limit, offset
    and by_count are the same for all levels or lists of one for each. Nodes are
    ranked within their parents in one window, then dropped with their parents in one more for each level.
    """
    names = list(fields)
    each = lambda x: x if isinstance(x, list) else [x] * len(names)
    rows = df if pred is None else df.where(pred)
    rows = rows.select(*[c.cast("string").alias(n) for n, c in fields.items()], *[q.alias(f"__q_{n}") for n, q in (queries or {}).items()]).where(F.col(names[0]).isNotNull())
    known = F.lit(0)
    for n in names:
        known = known + F.when(F.col(n).isNull(), 1).otherwise(0)
    aggregates = [F.count(F.lit(1)).alias("cnt"), *[F.count_if(F.col(f"`__q_{n}`")).alias(n) for n in queries or {}]]
    level = F.lit(0)
    for n in names:
        level = level + 1 - F.grouping(n)
    tree = rows.rollup(*names).agg(level.cast("int").alias("level"), *aggregates).where(F.col("level") > 0)
    tree = tree.where((F.col("cnt") >= mincount) & (known == len(names) - F.col("level")))
    of_level = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("level"))
    parents = [F.when(F.col("level") > i + 1, F.col(n)) for i, n in enumerate(names[:-1])]
    order = [F.when(of_level(each(by_count)), -F.col("cnt")), *[F.when(F.col("level") == i + 1, F.col(n)) for i, n in enumerate(names)]]
    tree = tree.withColumn("pos", F.row_number().over(Window.partitionBy("level", *parents).orderBy(*order)))
    starts, limits = each(offset), each(limit)
    if all(x >= 0 for x in limits):  # a bound that holds for all levels lets tasks drop most nodes before they are shuffled
        tree = tree.where(F.col("pos") <= max(s + n for s, n in zip(starts, limits)))
    ends = [s + n if n >= 0 else 2**62 for s, n in zip(starts, limits)]
    tree = tree.withColumn("pos", (F.col("pos") - 1).cast("long")).where((F.col("pos") >= of_level(starts)) & (F.col("pos") < of_level(ends)))
    for i in range(1, len(names)):  # nodes of a level below go where that node has gone
        here = F.max(F.col("level") == i).over(Window.partitionBy(*[F.when(F.col("level") >= i, F.col(n)) for n in names[:i]], F.col("level") >= i))
        tree = tree.withColumn("__kept", here).where((F.col("level") < i) | F.col("__kept")).drop("__kept")
    return tree.select("level", *names, "cnt", *[f"`{n}`" for n in queries or {}], (F.col("pos") - of_level(starts)).cast("long").alias("pos"))


def heatmap_counts(df: DataFrame, x: Column, y: Column, bounds: tuple[float, float, float, float], columns: int, rows: int, pred: Column | None = None, max_cells: int = 100_000) -> DataFrame:
    """(row, col, cnt) of the non-empty cells of a grid over bounds (min x, min y, max x, max y); the upper edges belong to the last cells."""
    if columns * rows > max_cells:
        raise ValueError(f"{columns * rows} cells are more than {max_cells}")
    x0, y0, x1, y1 = bounds
    inside = x.between(x0, x1) & y.between(y0, y1)
    points = df.where(inside if pred is None else inside & pred)
    cell = lambda v, lo, hi, n: F.least(F.floor((v - F.lit(lo)) * n / F.lit(hi - lo)), F.lit(n - 1)).cast("long")
    return points.groupBy(cell(y, y0, y1, rows).alias("row"), cell(x, x0, x1, columns).alias("col")).agg(F.count(F.lit(1)).alias("cnt"))


def heatmap_grid(cells: DataFrame, columns: int, rows: int) -> DataFrame:
    """(row, counts): each row of the grid as an array, null where it is empty; the grid is bounded."""
    full = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cnt"))).alias("m"))
    grid = cells.sparkSession.range(rows).withColumnRenamed("id", "row").join(full, "row", "left")
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")))
    return grid.select("row", F.when(F.col("m").isNotNull(), at).alias("counts"))
