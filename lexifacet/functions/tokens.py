"""An algebra of typed tokens in arrays of struct(term, type, pos_inc, start, end, payload).

split forks tokens, process rewrites them, join merges the tokens of a position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("term", "type", "pos_inc", "start", "end", "payload")
TOKEN = "struct<term:string,type:string,pos_inc:int,start:int,end:int,payload:string>"


def token(term: Column, type_: Column, pos_inc: Column, start: Column, end: Column, payload: Column) -> Column:
    return F.struct(term.alias("term"), type_.cast("string").alias("type"), pos_inc.cast("int").alias("pos_inc"), start.cast("int").alias("start"), end.cast("int").alias("end"), payload.cast("string").alias("payload"))


def _with(t: Column, **new: Column) -> Column:
    return token(*[new.get(f, t[f]) for f in FIELDS])


def _matches(t: Column, include: tuple[str, ...] | None, exclude: tuple[str, ...]) -> Column:
    test = F.lit(True) if include is None else F.coalesce(t["type"].isin(*include), F.lit(False))
    return test & ~F.coalesce(t["type"].isin(*exclude), F.lit(False)) if exclude else test


def _of_type(kind: str) -> Callable[[Column], Column]:
    return lambda t: t["type"] == kind


def split(tokens: Column, output_type: str, include: tuple[str, ...] | None = None, exclude: tuple[str, ...] = (), rename: str | None = None, delegate: Callable[[Column], Column] = lambda c: c) -> Column:
    """Matching tokens (renamed) are followed by a copy of output_type at the same position, its term through the delegate."""

    def fork(t: Column) -> Column:
        first = _with(t, type=F.lit(rename)) if rename else _with(t)
        second = _with(t, term=delegate(t["term"]), type=F.lit(output_type), pos_inc=F.lit(0))
        return F.when(_matches(t, include, exclude), F.array(first, second)).otherwise(F.array(_with(t)))

    return F.flatten(F.transform(tokens, fork))


def process(tokens: Column, delegate: Callable[[Column], Column], include: tuple[str, ...] | None = None, exclude: tuple[str, ...] = (), rename: str | None = None) -> Column:
    """Matching tokens are rewritten in place, positions kept."""

    def rewrite(t: Column) -> Column:
        new = _with(t, term=delegate(t["term"]), **({"type": F.lit(rename)} if rename else {}))
        return F.when(_matches(t, include, exclude), new).otherwise(_with(t))

    return F.transform(tokens, rewrite)


def positions(tokens: Column) -> Column:
    """Arrays of the tokens of each position; a token with pos_inc > 0 begins one."""
    empty = F.array().cast(f"array<array<{TOKEN}>>")

    def add(acc: Column, t: Column) -> Column:
        n = F.size(acc)
        more = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.concat(F.element_at(acc, n), F.array(t))))
        return F.when((t["pos_inc"] > 0) | (n == 0), F.concat(acc, F.array(F.array(t)))).otherwise(more)

    return F.aggregate(F.transform(tokens, lambda t: _with(t)), empty, add)


def join(tokens: Column, input_types: tuple[str, ...], output_type: str, delim: str, payload_type: str | None = None, output_components: bool = False, placeholders: bool = False) -> Column:
    """The tokens of a position whose types are listed are joined by delim in list order; a later one of a type replaces an earlier.

    Other tokens pass, ahead of the joined one. The payload is the first
    non-null one of payload_type in the position.
    """

    def merge(group: Column) -> Column:
        part = F.filter(group, lambda t: F.coalesce(t["type"].isin(*input_types), F.lit(False)))
        rest = group if output_components else F.filter(group, lambda t: ~F.coalesce(t["type"].isin(*input_types), F.lit(False)))
        slots = [F.get(F.reverse(F.filter(part, _of_type(k))), F.lit(0))["term"] for k in input_types]
        term = F.concat_ws(delim, *[F.coalesce(s, F.lit("")) for s in slots]) if placeholders else F.concat_ws(delim, *slots)
        pay = F.get(F.filter(part, lambda t: (t["type"] == F.lit(payload_type)) & t["payload"].isNotNull()), F.lit(0))["payload"] if payload_type else F.lit(None)
        step = F.get(group, F.lit(0))["pos_inc"]
        joined = token(term, F.lit(output_type), F.when(F.size(rest) > 0, F.lit(0)).otherwise(step), F.array_min(F.transform(part, lambda t: t["start"])), F.array_max(F.transform(part, lambda t: t["end"])), pay)
        leading = F.transform(rest, lambda t, i: _with(t, pos_inc=F.when(i == 0, step).otherwise(F.lit(0))))
        return F.when(F.size(part) == 0, F.transform(group, lambda t: _with(t))).otherwise(F.concat(leading, F.array(joined)))

    return F.flatten(F.transform(positions(tokens), merge))
