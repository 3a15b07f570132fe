"""What a request needs to know of a field besides its column: how its terms are folded, packed and shown."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

Transform = Callable[[Column], Column]
KEY = ["norm", "filing", "prefix"]


@dataclass(frozen=True)
class FieldSpec:
    """Terms in folded order, with their external form.

    packed: the column holds norm, filing and prefix, joined by the delimiter of
    `level`; else the terms themselves, which `fold` brings to their norm.
    references: the column holds JSON references. display rewrites the external
    term, serialized gives a further column `value`. point: the two columns of
    longitude and latitude, for heatmaps.
    """

    packed: bool = False
    fold: bool = True
    level: int = 0
    references: bool = False
    display: Transform | None = None
    serialized: Transform | None = None
    point: tuple[str, str] | None = None

    def keyed(self, counts: DataFrame) -> DataFrame:
        """counts (term, ...) with norm, filing and prefix of each term; only distinct terms are folded."""
        if self.references:  # term is struct(filing, prefix)
            parts = F.struct((text.fold("term.filing") if self.fold else F.col("term.filing")).alias("norm"), "term.filing", "term.prefix")
        elif self.packed:
            parts = text.indexed(F.col("term"), self.level)
        else:
            parts = F.struct((text.fold("term") if self.fold else F.col("term")).alias("norm"), F.col("term").alias("filing"), F.lit(None).cast("string").alias("prefix"))
        rest = [c for c in counts.columns if c != "term"]
        return counts.select(parts.alias("__k"), *rest).select("__k.*", *rest)

    def target(self, target: str) -> Column:
        """The key of a target: a term, or a JSON object of filing and prefix."""
        filing, prefix = target, None
        if target.startswith("{"):
            parts = json.loads(target)
            filing, prefix = parts["filing"], parts.get("prefix")
        norm = text.fold_text(filing) if self.fold else filing
        return F.struct(F.lit(norm).alias("norm"), F.lit(filing).alias("filing"), F.lit(prefix).cast("string").alias("prefix"))

    def below(self, target: str, strict: bool) -> Column:
        """Whether a key is less than the target: by its norm, or, if strict, by the whole key."""
        own = self.target(target)
        return F.struct(*KEY) < own if strict else F.col("norm") < own["norm"]

    def at(self, target: str, strict: bool) -> Column:
        """Whether a key is the target."""
        own = self.target(target)
        return F.struct(*KEY).eqNullSafe(own) if strict else F.col("norm") == own["norm"]

    def external(self, page: DataFrame) -> DataFrame:
        """The page with `term`, the external form of its key, ahead (and `value`, if the field has one)."""
        shown = text.display(F.col("prefix"), F.coalesce("filing", "norm"))
        new = [(self.display(shown) if self.display else shown).alias("term"), *([self.serialized(shown).alias("value")] if self.serialized else [])]
        return page.select(*new, *page.columns)
