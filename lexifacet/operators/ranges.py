"""Range, date-range and interval facets: conditional counts in one scan, so overlapping bounds may count a value twice."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCLUDES = {"lower", "upper", "edge", "outer", "all"}
OTHERS = {"before", "after", "between", "all", "none"}
_UNITS = {"SECOND": "seconds", "MINUTE": "minutes", "HOUR": "hours", "DAY": "days"}


def add_gap(at, gap):
    """at + gap; a text gap is date arithmetic: +N(SECOND|MINUTE|HOUR|DAY|MONTH|YEAR)."""
    if not isinstance(gap, str):
        return at + gap
    m = re.fullmatch(r"\+?(\d+)(SECOND|MINUTE|HOUR|DAY|MONTH|YEAR)S?", gap)
    if not m:
        raise ValueError(f"not a gap: {gap}")
    n, unit = int(m[1]), m[2]
    if unit in _UNITS:
        return at + dt.timedelta(**{_UNITS[unit]: n})
    months = at.year * 12 + at.month - 1 + n * (12 if unit == "YEAR" else 1)
    year, month = divmod(months, 12)
    last = (dt.date(year + month // 11, (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return at.replace(year=year, month=month + 1, day=min(at.day, last))


@dataclass(frozen=True)
class Bucket:
    name: str
    low: object
    high: object
    low_in: bool
    high_in: bool

    def test(self, x: Column) -> Column:
        tests = [x.isNotNull()]
        if self.low is not None:
            tests.append(x >= F.lit(self.low) if self.low_in else x > F.lit(self.low))
        if self.high is not None:
            tests.append(x <= F.lit(self.high) if self.high_in else x < F.lit(self.high))
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Buckets(list):
    """Buckets of which the first `many` are equal steps of a number from `start`, by `gap`."""

    start = gap = None
    many = 0


#: Buckets from which a value is sent to its own instead of being tested against each; the most that are allowed.
WIDE, MOST = 48, 1_000_000


def range_buckets(start, end, gap, hardend: bool = False, other: tuple[str, ...] = (), include: tuple[str, ...] = ("lower",)) -> list[Bucket]:
    """The buckets, then before, after and between as asked for."""
    if bad := (set(include) - INCLUDES) | (set(other) - OTHERS):
        raise ValueError(f"unknown: {sorted(bad)}")
    if add_gap(start, gap) <= start:
        raise ValueError("gap must be positive")
    flags = {"lower", "upper", "edge", "outer"} if "all" in include else set(include)
    edges, at, n = [start], start, 0
    while at < end:
        n += 1
        if n > MOST:
            raise ValueError(f"more than {MOST} buckets")
        at = start + n * gap if not isinstance(gap, str) else add_gap(at, gap)
        edges.append(min(at, end) if hardend else at)
    out = Buckets()
    if not isinstance(gap, (str, dt.timedelta)):
        out.start, out.gap, out.many = start, gap, len(edges) - 1
    for i, (a, z) in enumerate(zip(edges, edges[1:])):
        out.append(Bucket(str(a), a, z, "lower" in flags or ("edge" in flags and i == 0), "upper" in flags or ("edge" in flags and i == len(edges) - 2)))
    extra = set() if "none" in other else ({"before", "after", "between"} if "all" in other else set(other))
    low_in = out[0].low_in if out else False
    high_in = out[-1].high_in if out else False
    final = edges[-1]
    if "before" in extra:
        out.append(Bucket("before", None, start, True, "outer" in flags or not low_in))
    if "after" in extra:
        out.append(Bucket("after", final, None, "outer" in flags or not high_in, True))
    if "between" in extra:
        out.append(Bucket("between", start, final, low_in, high_in))
    return out


def bucket_counts(df: DataFrame, value: Column, buckets: list[Bucket], pred: Column | None = None, mincount: int = 0) -> DataFrame:
    """(pos, name, cnt) of each bucket; zeros kept unless mincount says otherwise.

    A few buckets are conditional counts of one aggregate. Many equal steps are
    counted by the step that a value falls in, so the plan doesn't grow with their number.
    """
    hit = F.lit(True) if pred is None else pred
    rows = df.select(value.alias("v"), hit.alias("hit"))
    if len(buckets) > WIDE and getattr(buckets, "many", 0) > 1:
        return _stepped(rows, buckets).where(F.col("cnt") >= mincount)
    wide = rows.agg(*[F.count_if(F.col("hit") & b.test(F.col("v"))).alias(f"c{i}") for i, b in enumerate(buckets)])
    rows = wide.select(F.posexplode(F.array(*[F.struct(F.lit(b.name).alias("name"), F.col(f"c{i}").alias("cnt")) for i, b in enumerate(buckets)])).alias("pos", "r"))
    return rows.select(F.col("pos").cast("long").alias("pos"), "r.name", "r.cnt").where(F.col("cnt") >= mincount)


def _stepped(rows: DataFrame, buckets: Buckets) -> DataFrame:
    n, v = buckets.many, F.col("v")
    edge = lambda i: F.lit(buckets.start) + i * F.lit(buckets.gap)
    rows = rows.where(F.col("hit") & v.isNotNull()).withColumn("s", F.floor((v - F.lit(buckets.start)) / F.lit(buckets.gap)).cast("long"))
    # a rounded quotient may be one off; the bounds themselves decide
    s = F.col("s")
    rows = rows.withColumn("step", F.when(v < edge(s), s - 1).when(v >= edge(s + 1), s + 1).otherwise(s))
    i, middle, first, last = F.col("step"), buckets[1], buckets[0], buckets[n - 1]
    low_in = F.when(i == 0, F.lit(first.low_in)).when(i == n - 1, F.lit(last.low_in)).otherwise(F.lit(middle.low_in))
    high_in = F.when(i == n, F.lit(last.high_in)).when(i == 1, F.lit(first.high_in)).otherwise(F.lit(middle.high_in))
    on_edge = v == edge(i)
    inside = (i >= 0) & (i < n) & (v < F.lit(last.high))
    places = [F.when(inside & (~on_edge | low_in), i), F.when((i > 0) & (i <= n) & on_edge & high_in & (v <= F.lit(last.high)), i - 1), F.when((i == n - 1) & (v == F.lit(last.high)) & F.lit(last.high_in) & ~on_edge, i)]
    places += [F.when(b.test(v), F.lit(n + j).cast("long")) for j, b in enumerate(buckets[n:])]
    found = rows.select(F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("cnt"))
    wanted = rows.sparkSession.createDataFrame([(i, b.name) for i, b in enumerate(buckets)], "pos long, name string")
    return wanted.join(found, "pos", "left").select("pos", "name", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def intervals(*items: tuple) -> list[Bucket]:
    """Buckets from (low, high, low included, high included, name) tuples; they may overlap."""
    return [Bucket(name, low, high, low_in, high_in) for low, high, low_in, high_in, name in items]
