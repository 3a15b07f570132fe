"""Multi-part strings, display forms and folding, as functions from columns to columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUL = "\u0000"


def delimiter(level: int = 0) -> str:
    """The separator of parts at a level of hierarchy."""
    return NUL * (level + 1)


def indexed(packed: Column, level: int = 0) -> Column:
    """struct(norm, filing, prefix) of a packed term; absent parts are null."""
    parts = F.split(packed, delimiter(level), -1)
    return F.struct(F.get(parts, F.lit(0)).alias("norm"), F.get(parts, F.lit(1)).alias("filing"), F.get(parts, F.lit(2)).alias("prefix"))


def payload(packed: Column, level: int = 0) -> Column:
    """struct(filing, prefix) of a packed payload value."""
    parts = F.split(packed, delimiter(level), -1)
    return F.struct(F.get(parts, F.lit(0)).alias("filing"), F.get(parts, F.lit(1)).alias("prefix"))


def packed(*parts: Column, level: int = 0) -> Column:
    """The packed form; null parts are left out."""
    return F.concat_ws(delimiter(level), *parts)


def display(prefix: Column, filing: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(filing, F.lit("")))


def external(term: Column, level: int = 0) -> Column:
    """What lies between the first two delimiters; all of a term without one."""
    d = delimiter(level)
    return F.when(F.instr(term, d) == 0, term).otherwise(F.split_part(term, F.lit(d), F.lit(2)))


def normalized(term: Column, level: int = 0) -> Column:
    """What lies ahead of the first delimiter."""
    return F.substring_index(term, delimiter(level), 1)


def ignore_filing_prefix(x: Column) -> Column:
    """What follows the first TAB."""
    return F.regexp_replace(x, r"^[^\t]*\t", "")


def combine_non_filing_prefix(x: Column) -> Column:
    """The text without its first TAB."""
    return F.regexp_replace(x, r"^([^\t]*)\t", "$1")


def uri_escape(x: Column) -> Column:
    return F.url_encode(x)


def fold_text(x: str) -> str:
    """Case and diacritics folded: compatibility decomposition without marks, case-folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn").casefold()


@F.pandas_udf(StringType())
def fold(x: pd.Series) -> pd.Series:
    """fold_text of a column; apply it to distinct terms, not to every row."""
    return x.map(fold_text, na_action="ignore")
