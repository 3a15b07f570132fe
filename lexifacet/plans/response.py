"""One JSON document of a response: pages are bounded by their limits, so each is gathered as an ordered array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(page: DataFrame) -> DataFrame:
    """One row: the page's rows, by pos (rows without one last), as a JSON array of objects."""
    order = F.col("pos") if "pos" in page.columns else F.lit(None).cast("long")
    row = F.struct(F.coalesce(order, F.lit(9223372036854775807)).alias("o"), F.struct(*page.columns).alias("r"))
    return page.agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])).alias("json"))


#: Rows that a facet may bring to the driver.
MOST = 100_000


def facet_counts(facets: dict[str, object]) -> dict[str, object]:
    """The response as nested dictionaries of rows; an action for each facet. A facet of more than MOST rows is an error: write its table instead."""

    def gathered(df: DataFrame) -> list[dict]:
        df = df.limit(MOST + 1)
        rows = (df.orderBy(F.asc_nulls_last("pos")) if "pos" in df.columns else df).collect()
        if len(rows) > MOST:
            raise ValueError(f"a facet has more than {MOST} rows")
        return [r.asDict() for r in rows]

    return {kind: gathered(v) if isinstance(v, DataFrame) else {k: gathered(x) for k, x in v.items()} for kind, v in facets.items()}
