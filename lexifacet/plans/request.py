"""Facet requests as string parameters: defaults, per-field overrides, local parameters, validation."""

from __future__ import annotations

import datetime as dt
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import payload, pivot, ranges, terms, window
from ..sources import refs
from .fields import KEY, FieldSpec

Params = dict[str, "str | list[str]"]
_TRUE = {"true", "on", "yes", "1"}
_RANGE = "start end gap hardend other include".split()
#: Parameters after facet. or f.<field>.facet.; those of the second line only choose how an engine works and change no result.
_KNOWN = {
    *"field offset limit mincount zeros missing sort prefix contains contains.ignoreCase excludeTerms exists query pivot pivot.mincount range date interval interval.set target target.strict targetDoc extend heatmap".split(),
    *"threads method enum.cache.minDf overrequest.ratio overrequest.count distrib.mco range.method pivot.overrequest.ratio pivot.overrequest.count".split(),
    *(f"{kind}.{x}" for kind in ("range", "date") for x in _RANGE),
    *(f"heatmap.{x}" for x in "format geom gridLevel distErrPct distErr maxCells".split()),
}
_OTHER = {"facet", "q", "fq", "fl", "group.facet", "group.truncate", "group.field", "group.sort"}


def local_params(text: str) -> tuple[dict[str, str], str]:
    """({!a=b c='d e'}rest) as (parameters, rest)."""
    m = re.match(r"\{!([^}]*)\}(.*)", text, re.S)
    if not m:
        return {}, text
    return {k: v.strip("'\"") for k, v in re.findall(r"(\w+)=('[^']*'|\"[^\"]*\"|\S+)", m[1])}, m[2]


def interval_set(text: str, number) -> tuple[str, object, object, bool, bool]:
    """(name, low, high, low included, high included) of {!key=name}[low,high), * being unbounded."""
    local, body = local_params(text)
    m = re.fullmatch(r"\s*([\[(])\s*([^,]+?)\s*,\s*([^,]+?)\s*([\])])\s*", body)
    if not m:
        raise ValueError(f"not an interval: {text}")
    low, high = (None if x == "*" else number(x) for x in (m[2], m[3]))
    if low is not None and high is not None and low > high:
        raise ValueError(f"an interval that ends before it starts: {text}")
    return local.get("key", body), low, high, m[1] == "[", m[4] == "]"


class Request:
    """The parameters of one request over a table; predicates are SQL expressions.

    fields says how the terms of some columns are folded and shown; key names
    the column of unique document keys, which windows of documents need.
    """

    def __init__(self, df: DataFrame, params: Params, fields: dict[str, FieldSpec] | None = None, key: str | None = None):
        self.df, self.fields, self.key = df, fields or {}, key
        self.params = {k: list(dict.fromkeys([v] if isinstance(v, str) else v)) for k, v in params.items()}
        for k in self.params:
            name = re.sub(r"^(f\..+?\.)?facet\.", "", k)
            if k not in _OTHER and (name == k or name not in _KNOWN):
                raise ValueError(f"unknown parameter: {k}")
        self.filters: dict[str, Column] = {}
        for i, f in enumerate(self.every("fq")):
            local, expression = local_params(f)
            self.filters[f"{local.get('tag', '')}\n{i}"] = F.expr(expression)
        for q in self.every("q"):
            local, expression = local_params(q)
            if expression != "*:*":
                self.filters[f"{local.get('tag', '')}\nq"] = F.expr(expression)
        self.group = None
        if self.on("group.facet") or self.on("group.truncate"):
            if "group.field" not in self.params:
                raise ValueError("group.facet and group.truncate need group.field")
            self.group = F.col(f"`{self.params['group.field'][0]}`")
        if self.on("group.truncate"):  # of the documents that match, the first of each group stays
            order = [F.expr(x.rsplit(" ", 1)[0]).desc() if x.lower().endswith(" desc") else F.expr(re.sub(r"(?i) asc$", "", x)) for x in (self.params.get("group.sort") or [key or self.params["group.field"][0]])[0].split(",")]
            match = F.coalesce(reduce(lambda a, b: a & b, self.filters.values(), F.lit(True)), F.lit(False))
            head = F.row_number().over(Window.partitionBy(self.group, match).orderBy(*order)) == 1
            self.df = df.withColumn("__head", head & match)
            self.filters["\nhead"] = F.col("__head")

    def every(self, name: str) -> list[str]:
        return self.params.get(name, [])

    def on(self, name: str) -> bool:
        return (self.params.get(name) or ["false"])[0].lower() in _TRUE

    def get(self, field: str, name: str, default: str | None = None) -> str | None:
        """f.<field>.facet.<name>, else facet.<name>."""
        return (self.many(field, name) or [default])[0]

    def many(self, field: str, name: str) -> list[str]:
        for key in (f"f.{field}.facet.{name}", f"facet.{name}"):
            if key in self.params:
                return self.params[key]
        return []

    def need(self, field: str, name: str) -> str:
        value = self.get(field, name)
        if value is None:
            raise ValueError(f"missing parameter: facet.{name}")
        return value

    def flag(self, field: str, name: str) -> bool:
        return (self.get(field, name) or "").lower() in _TRUE

    def base(self, local: dict[str, str]) -> Column:
        """The conjunction of the filters whose tags aren't excluded."""
        out = set((local.get("ex") or "").split(",")) - {""}
        return terms.filters_without({k: v for k, v in self.filters.items() if not out & set(k.split("\n")[0].split(","))})

    def column(self, name: str) -> T.DataType:
        if name not in self.df.columns:
            raise ValueError(f"no such field: {name}")
        return self.df.schema[name].dataType

    def order(self, name: str, limit: int) -> str:
        sort = self.get(name, "sort")
        sort = {"true": "count", "false": "index"}.get(sort or "", sort)
        if sort not in (None, "count", "index"):
            raise ValueError(f"unknown sort: {sort}")
        targeted = self.get(name, "target") is not None or self.get(name, "targetDoc") is not None
        if targeted and sort == "count":
            raise ValueError("a target needs index order")
        return sort or ("index" if targeted or limit <= 0 else "count")

    def field(self, text: str) -> tuple[str, DataFrame]:
        local, name = local_params(text)
        kind = self.column(name)
        multi, numeric = isinstance(kind, T.ArrayType), isinstance(kind, T.NumericType)
        limit, offset = int(self.get(name, "limit", "100")), int(self.get(name, "offset", "0"))
        zeros = self.get(name, "zeros")
        mincount = int(self.get(name, "mincount", "0" if zeros is None or zeros.lower() in _TRUE else "1"))
        sort = self.order(name, limit)
        exclude = self.get(name, "excludeTerms")
        accept = terms.TermFilter(self.get(name, "prefix"), self.get(name, "contains"), self.flag(name, "contains.ignoreCase"), tuple(exclude.split(",")) if exclude else ())
        if numeric and accept != terms.TermFilter():
            raise ValueError(f"term filters don't apply to the numeric field {name}")
        exists = self.flag(name, "exists")
        if exists and (mincount > 1 or self.get(name, "method") not in (None, "enum")):
            raise ValueError("exists needs mincount of 0 or 1 and method enum")
        base, term, spec = self.base(local), F.col(f"`{name}`"), self.fields.get(name)
        group = self.group if self.on("group.facet") else None
        if spec is None and self.flag(name, "extend"):
            raise ValueError(f"extend needs a field of references: {name}")
        key = local.get("key", name)
        if "terms" in local:
            return key, terms.listed_counts(self.df, term if multi else term.cast("string"), local["terms"].split(","), base, multi)
        target, doc = self.get(name, "target"), self.get(name, "targetDoc")
        if doc is not None or target is not None and limit != 0:
            if limit < 1:
                raise ValueError("a target needs limit >= 1")
            if self.get(name, "method") not in (None, "fc"):
                raise ValueError("a target needs method fc")
            if group is not None:
                raise ValueError("a target can't be grouped")
        if doc is not None:
            page = self.documents(name, spec, multi, base, accept, mincount, target or "", doc, limit, offset)
        elif spec is not None:
            page = self.keyed(name, spec, multi, base, accept, mincount, exists, group, target, sort, limit, offset)
        else:
            counts = terms.term_counts(self.df, term, base, accept, mincount, multi, exists, group)
            if limit == 0:
                page = counts.select(F.lit(0).cast("long").alias("pos"), "term", "cnt").limit(0)
            elif target is not None:
                page = window.term_window(counts, target, limit, offset)
            else:
                page = (window.count_page if sort == "count" else window.index_page)(counts, limit, offset)
        if self.flag(name, "missing"):
            page = page.unionByName(terms.missing_count(self.df, term, base, multi), allowMissingColumns=True)
        return key, page

    def strict(self, name: str) -> bool:
        """Whether the whole key of a target counts; by default if a document is named."""
        asked = self.get(name, "target.strict")
        return bool(self.get(name, "targetDoc")) if asked is None else asked.lower() in _TRUE

    def keyed(self, name: str, spec: FieldSpec, multi: bool, base: Column, accept: terms.TermFilter, mincount: int, exists: bool, group: Column | None, target: str | None, sort: str, limit: int, offset: int) -> DataFrame:
        """A page or window of a field whose terms have norms; with extend, each term's references."""
        extend, posts = spec.references and self.flag(name, "extend"), None
        if spec.references:
            doc = F.struct((F.col(self._key()) if group is None else group).alias("d"), F.coalesce(base, F.lit(False)).alias("hit"))
            posts = refs.references(self.df, doc, F.col(f"`{name}`")).withColumn("term", F.struct("filing", "prefix"))
            posts = posts.where(accept.column(F.concat(F.coalesce("prefix", F.lit("")), F.col("filing"))))
            count = F.count_distinct(F.when(F.col("doc.hit"), F.col("doc.d")))
            counts = posts.groupBy("term").agg((F.least(count, F.lit(1)) if exists else count).cast("long").alias("cnt")).where(F.col("cnt") >= mincount)
        else:
            counts = terms.term_counts(self.df, F.col(f"`{name}`"), base, accept, mincount, multi, exists, group)
        keys = spec.keyed(counts)
        if target is not None and limit != 0:
            page = window.target_window(keys, KEY, spec.below(target, self.strict(name)), limit, offset)
        elif sort == "count":
            page = window.page(keys, limit, offset, F.desc("cnt"), *KEY, key=F.struct((-F.col("cnt")).alias("c"), *KEY))
        else:
            page = window.page(keys, limit, offset, *[F.asc(k) for k in KEY], key=F.struct(*KEY))
        page = spec.external(page)
        if extend:  # only what the page's terms need, of which there are at most `limit`
            wanted = page.select(F.struct("filing", "prefix").alias("w")).distinct()
            wanted = F.broadcast(wanted) if 0 <= limit <= 10_000 else wanted
            source = lambda c: F.when(F.col("ref_type").isNotNull(), F.col(c))
            own = posts.where("doc.hit").join(wanted, F.col("term").eqNullSafe(F.col("w")), "left_semi")
            own = own.select("term", F.col("doc.d").alias("doc"), "ref_type", source("raw_filing").alias("filing"), source("raw_prefix").alias("prefix"))
            found = payload.nested(payload.reference_counts(own)).select(F.col("term").alias("__key"), "self_cnt", "refs")
            page = page.join(found, F.struct("filing", "prefix").eqNullSafe(F.col("__key")), "left").drop("__key")
        return page

    def _key(self) -> str:
        if self.key is None:
            raise ValueError("this needs the column of document keys")
        return f"`{self.key}`"

    def documents(self, name: str, spec: FieldSpec | None, multi: bool, base: Column, accept: terms.TermFilter, mincount: int, target: str, doc: str, limit: int, offset: int) -> DataFrame:
        """A window of (term, document) pairs; fl names further columns of the documents."""
        if mincount > 1 or (spec is not None and spec.references):
            raise ValueError("windows of documents take mincount 0 or 1 and plain or packed terms")
        fl = [c for f in self.every("fl") for c in f.split(",") if c and c != self.key]
        kept = [F.col(self._key()).cast("string").alias("doc_key"), *[F.col(f"`{c}`") for c in fl]]
        term = F.col(f"`{name}`") if multi else F.col(f"`{name}`").cast("string")
        every = terms.postings(self.df, term, multi, F.coalesce(base, F.lit(False)).alias("__in"), *kept).where(accept.column(F.col("term")))
        if spec is None:
            out = window.doc_window(every.where("__in").drop("__in"), every.select("term"), target, doc, limit, offset)
            return out.select("pos", "term", "doc_key", *fl, "n_rows", "target_offset")
        keys, below, equal = spec.keyed(every.where("__in").drop("__in")), spec.below(target, self.strict(name)), spec.at(target, self.strict(name))
        # a target that is a term goes on from its document, else from the first document of the next one
        hit = spec.keyed(every.select("term").distinct()).where(equal).limit(1).agg(F.count(F.lit(1)).alias("__hit"))
        keys = keys.crossJoin(F.broadcast(hit))  # one row: whether the target is a term
        below = below | (equal & (F.col("doc_key") < F.when(F.col("__hit") > 0, F.lit(doc)).otherwise(F.lit(""))))
        page = window.target_window(keys, [*KEY, "doc_key"], below, limit, offset).drop("__hit")
        return spec.external(page.select("pos", *KEY, "doc_key", *fl, "n_rows", "target_offset"))

    def _numbers(self, name: str) -> tuple[Column, object]:
        """(the field's value, what reads a parameter of its type)."""
        kind = self.column(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.col(f"`{name}`").cast("timestamp_ntz"), lambda x: dt.datetime.fromisoformat(x.rstrip("Z"))
        if isinstance(kind, T.NumericType):
            return F.col(f"`{name}`"), int if isinstance(kind, T.IntegralType) else float
        return F.col(f"`{name}`").cast("string"), str

    def buckets(self, name: str, kind: str) -> list[ranges.Bucket]:
        at = self._numbers(name)[1]
        dated = isinstance(self.column(name), (T.TimestampType, T.TimestampNTZType, T.DateType))
        if at is str or kind == "date" and not dated:
            raise ValueError(f"no {kind} facet of {name}")
        gap = self.need(name, f"{kind}.gap")
        include = tuple(self.many(name, f"{kind}.include")) or (("lower", "upper", "edge") if kind == "date" else ("lower",))
        return ranges.range_buckets(at(self.need(name, f"{kind}.start")), at(self.need(name, f"{kind}.end")), gap if dated else at(gap), self.flag(name, f"{kind}.hardend"), tuple(self.many(name, f"{kind}.other")), include)

    def range(self, text: str, kind: str = "range") -> tuple[str, DataFrame]:
        local, name = local_params(text)
        value = self._numbers(name)[0]
        return local.get("key", name), ranges.bucket_counts(self.df, value, self.buckets(name, kind), self.base(local), int(self.get(name, "mincount", "0")))

    def interval(self, text: str) -> tuple[str, DataFrame]:
        local, name = local_params(text)
        if self.on("group.facet"):
            raise ValueError("interval facets can't be grouped")
        value, at = self._numbers(name)
        self.need(name, "interval.set")
        made = [interval_set(x, at) for x in self.many(name, "interval.set")]
        return local.get("key", name), ranges.bucket_counts(self.df, value, ranges.intervals(*[(low, high, low_in, high_in, n) for n, low, high, low_in, high_in in made]), self.base(local))

    def pivot(self, text: str) -> tuple[str, DataFrame]:
        local, names = local_params(text)
        fields = {n: F.col(f"`{n}`") for n in names.split(",") if self.column(n)}
        limits = [int(self.get(n, "limit", "100")) for n in fields]
        below: dict[str, Column] = {}
        tagged = lambda kind, tag: [x for x in self.every(f"facet.{kind}") if tag in local_params(x)[0].get("tag", "").split(",")]
        for tag in filter(None, local.get("query", "").split(",")):
            for q in tagged("query", tag):
                own, expression = local_params(q)
                below[own.get("key", expression)] = F.expr(expression)
        for tag in filter(None, local.get("range", "").split(",")):
            for r in tagged("range", tag):
                own, name = local_params(r)
                below |= {f"{own.get('key', name)}:{b.name}": b.test(self._numbers(name)[0]) for b in self.buckets(name, "range")}
        first = next(iter(fields))
        return local.get("key", names), pivot.pivot_counts(self.df, fields, self.base(local), int(self.get(first, "pivot.mincount", "1")), limits, [int(self.get(n, "offset", "0")) for n in fields], [self.order(n, x) == "count" for n, x in zip(fields, limits)], below)

    def heatmap(self, text: str) -> tuple[str, DataFrame]:
        """Rows of counts over the cells of a quad grid of the world that cover geom, with the grid's level, size and bounds."""
        local, name = local_params(text)
        if self.on("group.facet"):
            raise ValueError("heatmaps can't be grouped")
        if name not in self.fields or self.fields[name].point is None:
            raise ValueError(f"no points in field: {name}")
        if self.get(name, "heatmap.format", "ints2D") != "ints2D":
            raise ValueError("heatmaps have format ints2D only")
        number = r"\s*(-?[\d.]+)\s*"
        m = re.fullmatch(rf"\[{number} {number} TO {number} {number}\]", self.get(name, "heatmap.geom", "[-180 -90 TO 180 90]"))
        if not m:
            raise ValueError("heatmap.geom is [minX minY TO maxX maxY]")
        x0, y0, x1, y1 = (float(x) for x in m.groups())
        level = self.get(name, "heatmap.gridLevel")
        if level is None:  # cells no larger than the error that is allowed, by default a share of half the diagonal
            error = self.get(name, "heatmap.distErr")
            error = float(error) if error is not None else float(self.get(name, "heatmap.distErrPct", "0.15")) * math.hypot(x1 - x0, y1 - y0) / 2
            level = 1 if error <= 0 and x0 == x1 and y0 == y1 else max(1, math.ceil(math.log2(360 / error))) if error > 0 else 26
        side = 2 ** int(level)
        dx, dy = 360 / side, 180 / side
        c0, r0 = (min(side - 1, max(0, math.floor(x))) for x in ((x0 + 180) / dx, (y0 + 90) / dy))
        c1, r1 = (min(side, max(low + 1, math.ceil(x))) for low, x in ((c0, (x1 + 180) / dx), (r0, (y1 + 90) / dy)))
        bounds = (c0 * dx - 180, r0 * dy - 90, c1 * dx - 180, r1 * dy - 90)
        lon, lat = (F.col(f"`{c}`") for c in self.fields[name].point)
        columns, rows = c1 - c0, r1 - r0
        cells = pivot.heatmap_counts(self.df, lon, lat, bounds, columns, rows, self.base(local), int(self.get(name, "heatmap.maxCells", "100000")))
        about = {"grid_level": int(level), "columns": columns, "rows": rows, "min_x": bounds[0], "max_x": bounds[2], "min_y": bounds[1], "max_y": bounds[3]}
        grid = pivot.heatmap_grid(cells, columns, rows).select((F.lit(rows - 1) - F.col("row")).cast("long").alias("pos"), "counts")  # the first row is the northernmost
        return local.get("key", name), grid.select("*", *[F.lit(v).alias(k) for k, v in about.items()])


def run(df: DataFrame, params: Params, fields: dict[str, FieldSpec] | None = None, key: str | None = None) -> dict[str, object]:
    """The facets of a request, lazily: facet_queries, facet_fields, facet_ranges, facet_dates, facet_intervals, facet_heatmaps, facet_pivot."""
    r = Request(df, params, fields, key)
    if not r.on("facet"):
        return {}
    kinds = (("facet_fields", "field", r.field), ("facet_ranges", "range", r.range), ("facet_dates", "date", lambda x: r.range(x, "date")), ("facet_intervals", "interval", r.interval), ("facet_heatmaps", "heatmap", r.heatmap), ("facet_pivot", "pivot", r.pivot))
    out: dict[str, object] = {kind: dict(f(x) for x in r.every(f"facet.{name}")) for kind, name, f in kinds}
    if r.every("facet.query"):
        named, group = {}, r.group if r.on("group.facet") else None
        for q in r.every("facet.query"):
            local, expression = local_params(q)
            named[local.get("key", expression)] = r.base(local) & F.expr(expression)
        out["facet_queries"] = terms.query_counts(r.df, named, group)
    return out
