"""Cross-reference metadata of terms, from postings (term, doc, ref_type, filing, prefix); a null ref_type is the term itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_counts(postings: DataFrame) -> DataFrame:
    """(term, scope, ref_type, display, cnt, filing, prefix): documents of each term in all, as itself, and by distinct reference.

    One pass over the postings: they are gathered by (term, document), then counted with partial sums.
    """
    once = postings.groupBy("term", "doc").agg(F.collect_set(F.struct("ref_type", "filing", "prefix")).alias("r"))
    item = "named_struct('scope', '{}', 'ref_type', {}, 'display', {}, 'n', {}, 'filing', {}, 'prefix', {})"
    none = "cast(null as string)"
    heads = [item.format("total", none, none, "1L", none, none), item.format("self", none, none, "if(exists(r, x -> x.ref_type is null), 1L, 0L)", none, none)]
    refs = item.format("ref", "x.ref_type", "coalesce(x.prefix, '') || coalesce(x.filing, '')", "1L", "x.filing", "x.prefix")
    items = once.select("term", F.explode(F.expr(f"concat(array({', '.join(heads)}), transform(filter(r, x -> x.ref_type is not null), x -> {refs}))")).alias("i")).select("term", "i.*")
    total = items.groupBy("term", "scope", "ref_type", "display").agg(F.sum("n").alias("cnt"), F.max(F.struct("filing", "prefix")).alias("m"))
    return total.select("term", "scope", "ref_type", "display", "cnt", F.col("m.filing").alias("filing"), F.col("m.prefix").alias("prefix"))


def merge_references(*parts: DataFrame) -> DataFrame:
    """Sum of partial reference counts."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    total = rows.groupBy("term", "scope", "ref_type", "display").agg(F.sum("cnt").alias("cnt"), F.max(F.struct("filing", "prefix")).alias("m"))
    return total.select("term", "scope", "ref_type", "display", "cnt", F.col("m.filing").alias("filing"), F.col("m.prefix").alias("prefix"))


def nested(counts: DataFrame) -> DataFrame:
    """(term, payload): the nested form; refs of a term are bounded by its distinct references."""
    entry = F.struct("ref_type", "display", "cnt", "filing", "prefix")
    return counts.groupBy("term").agg(
        F.max(F.when(F.col("scope") == "total", F.col("cnt"))).alias("cnt"),
        F.max(F.when(F.col("scope") == "self", F.col("cnt"))).alias("self_cnt"),
        F.array_sort(F.collect_list(F.when(F.col("scope") == "ref", entry))).alias("refs"),
    )


def positions(postings: DataFrame) -> DataFrame:
    """(term, entries): document, position and payload of each posting of a term; meant for terms of a window."""
    return postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc", "pos", "payload"))).alias("entries"))
