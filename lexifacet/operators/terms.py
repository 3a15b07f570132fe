"""Term counts of a field over the documents that satisfy a predicate.

One scan serves the counts, the zero-count terms (the dictionary is that of the
whole table) and multi-select exclusion: predicates are conditional aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TermFilter:
    """Which terms to accept: by prefix, substring and exclusion list."""

    prefix: str | None = None
    contains: str | None = None
    ignore_case: bool = False
    exclude: tuple[str, ...] = ()

    def column(self, term: Column) -> Column:
        tests = [term.isNotNull()]
        if self.prefix:
            tests.append(term.startswith(self.prefix))
        if self.contains:
            tests.append(F.lower(term).contains(self.contains.lower()) if self.ignore_case else term.contains(self.contains))
        if self.exclude:
            tests.append(~term.isin(*self.exclude))
        return reduce(lambda a, b: a & b, tests)


def postings(df: DataFrame, term: Column, multi: bool, *keep: Column) -> DataFrame:
    """One row per document and distinct term; a multi-valued field counts each of its terms once."""
    return df.select(*keep, (F.explode_outer(F.array_distinct(term)) if multi else term).alias("term"))


def term_counts(df: DataFrame, term: Column, pred: Column | None = None, accept: TermFilter = TermFilter(), mincount: int = 0, multi: bool = False, exists: bool = False, group: Column | None = None) -> DataFrame:
    """(term, cnt) of accepted terms with cnt >= mincount; mincount 0 keeps terms that no matching document has.

    exists caps counts at 1; group counts distinct non-null groups instead of documents.
    """
    if exists and mincount > 1:
        raise ValueError("exists allows mincount 0 or 1 only")
    base = F.lit(True) if pred is None else F.coalesce(pred, F.lit(False))
    if mincount > 0 and pred is not None:  # no zero terms are asked for, so the predicate can reach the scan
        df, base = df.where(pred), F.lit(True)
    rows = postings(df, term, multi, base.alias("hit"), *([] if group is None else [group.alias("grp")])).where(accept.column(F.col("term")))
    if group is not None:
        count = F.count_distinct(F.when(F.col("hit"), F.col("grp")))
    else:
        count = F.count_if(F.col("hit"))
    counts = rows.groupBy("term").agg((F.least(count, F.lit(1)) if exists else count).cast("long").alias("cnt"))
    return counts.where(F.col("cnt") >= mincount) if mincount > 0 else counts


def missing_count(df: DataFrame, term: Column, pred: Column | None = None, multi: bool = False) -> DataFrame:
    """(term null, cnt): the matching documents without a value."""
    absent = (term.isNull() | (F.size(F.filter(term, lambda x: x.isNotNull())) == 0)) if multi else term.isNull()
    return df.select(F.lit(None).cast("string").alias("term"), (absent if pred is None else absent & pred).alias("hit")).groupBy("term").agg(F.count_if("hit").alias("cnt"))


def query_counts(df: DataFrame, named: dict[str, Column | None], group: Column | None = None) -> DataFrame:
    """(name, cnt) of each predicate, in the order given; a null predicate counts 0; with group, distinct groups."""
    one = lambda p: F.lit(0).cast("long") if p is None else (F.count_if(p) if group is None else F.count_distinct(F.when(p, group)))
    wide = df.agg(*[one(p).alias(f"c{i}") for i, p in enumerate(named.values())])
    return wide.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("cnt")) for i, n in enumerate(named)])).alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), "r.name", "r.cnt")


def listed_counts(df: DataFrame, term: Column, terms: list[str], pred: Column | None = None, multi: bool = False) -> DataFrame:
    """(pos, term, cnt) of listed terms, in list order, zeros kept."""
    found = term_counts(df, term, pred, multi=multi).where(F.col("term").isin(terms))
    wanted = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(terms)], "pos long, term string")
    return wanted.join(found, "term", "left").select("pos", "term", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def group_heads(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first document of each group in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def filters_without(filters: dict[str, Column], excluded: tuple[str, ...] = ()) -> Column:
    """The conjunction of the tagged filters but those excluded."""
    return reduce(lambda a, b: a & b, [c for t, c in filters.items() if t not in excluded], F.lit(True))


def merge_shards(*parts: DataFrame, exists: bool = False) -> DataFrame:
    """Sum of partial counts (term, cnt) by term; exact, so no refinement follows."""
    total = reduce(lambda a, b: a.unionByName(b), parts).groupBy("term").agg(F.sum("cnt").alias("cnt"))
    return total.withColumn("cnt", F.least("cnt", F.lit(1).cast("long"))) if exists else total
