"""Queries of the faceting operators over the provided tables, each with its SQL equivalent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, tokens
from .operators import payload, pivot, ranges, terms, window
from .operators.terms import TermFilter
from .plans import request, response
from .plans.fields import FieldSpec
from .sources import refs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def add(name: str, f: Query, sql: str | None) -> None:
    _QUERIES[name] = f
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def page_sql(counts: str, order: str, limit: int, offset: int = 0) -> str:
    return f"select row_number() over (order by {order}) - 1 as pos, term, cnt from (select * from ({counts}) order by {order} limit {limit} offset {offset})"


def counts_sql(term: str, table: str, pred: str = "true", having: str = "") -> str:
    return f"select term, count(*) filter (where hit) as cnt from (select {term} as term, coalesce({pred}, false) as hit from {table}) where term is not null group by term {having}"


# pages of counts


def _count_page(limit: int, offset: int) -> Query:
    return lambda s, d: window.count_page(terms.term_counts(t(s, d, "part"), c("p_brand"), mincount=1), limit, offset)


add("facet_count_topk", _count_page(10, 0), page_sql(counts_sql("p_brand", "part"), "cnt desc, term", 10))
add("facet_count_topk_offset", _count_page(10, 5), page_sql(counts_sql("p_brand", "part"), "cnt desc, term", 10, 5))
add("facet_index_page", lambda s, d: window.index_page(terms.term_counts(t(s, d, "part"), c("p_name")), 10, 8), page_sql(counts_sql("p_name", "part"), "term", 10, 8))
add("facet_zero_terms", lambda s, d: terms.term_counts(t(s, d, "part"), c("p_name"), c("p_size") > 48), counts_sql("p_name", "part", "p_size > 48"))
add("facet_mincount", lambda s, d: terms.term_counts(t(s, d, "lineitem"), F.date_format("l_shipdate", "yyyy-MM-dd"), mincount=25), counts_sql("strftime(l_shipdate, '%Y-%m-%d')", "lineitem", having="having count(*) >= 25"))


@query("select term, count(*) as cnt from (select nullif(p_type, 'ECONOMY') as term from part) group by term")
def facet_missing(s: SparkSession, d: str) -> DataFrame:
    kind = F.nullif(c("p_type"), F.lit("ECONOMY"))
    part = t(s, d, "part")
    return terms.term_counts(part, kind).unionByName(terms.missing_count(part, kind))


def _filtered(name: str, accept: TermFilter, sql: str) -> None:
    add(name, lambda s, d: terms.term_counts(t(s, d, "part"), c("p_name"), accept=accept), counts_sql("p_name", f"(select * from part where {sql})"))


_filtered("facet_prefix", TermFilter(prefix="b"), "starts_with(p_name, 'b')")
_filtered("facet_contains", TermFilter(contains="re"), "contains(p_name, 're')")
_filtered("facet_contains_ci", TermFilter(contains="RE", ignore_case=True), "contains(lower(p_name), 're')")
_filtered("facet_exclude_terms", TermFilter(exclude=("red bolt", "blue bolt")), "p_name not in ('red bolt', 'blue bolt')")
_filtered("facet_filters_all", TermFilter("b", "l", False, ("blue bolt",)), "starts_with(p_name, 'b') and contains(p_name, 'l') and p_name not in ('blue bolt')")

add("facet_multivalued", lambda s, d: terms.term_counts(t(s, d, "part"), F.split("p_name", " "), multi=True), "select term, count(*) as cnt from (select unnest(list_distinct(string_split(p_name, ' '))) as term from part) group by term")
add("facet_multivalued_missing", lambda s, d: terms.missing_count(t(s, d, "part"), F.filter(F.split("p_name", " "), lambda x: x < "c"), multi=True), "select cast(null as varchar) as term, count(*) as cnt from part where len(list_filter(string_split(p_name, ' '), lambda x: x < 'c')) = 0")
add("facet_numeric_terms", lambda s, d: terms.term_counts(t(s, d, "lineitem"), c("l_linenumber")), counts_sql("l_linenumber", "lineitem"))
add("facet_boolean_terms", lambda s, d: terms.term_counts(t(s, d, "orders"), (c("o_totalprice") > 200000).cast("string")), counts_sql("cast(o_totalprice > 200000 as varchar)", "orders"))
add("facet_exists", lambda s, d: terms.term_counts(t(s, d, "orders"), c("o_orderpriority"), c("o_totalprice") > 400000, exists=True), f"select term, least(cnt, 1) as cnt from ({counts_sql('o_orderpriority', 'orders', 'o_totalprice > 400000')})")
add("facet_listed_terms", lambda s, d: terms.listed_counts(t(s, d, "orders"), c("o_orderpriority"), ["3-MEDIUM", "none", "1-URGENT"]), "select pos, l.term, count(o_orderkey) as cnt from (values (0::bigint, '3-MEDIUM'), (1::bigint, 'none'), (2::bigint, '1-URGENT')) l(pos, term) left join orders on o_orderpriority = l.term group by pos, l.term")
add(
    "facet_queries",
    lambda s, d: terms.query_counts(t(s, d, "orders"), {"dear": c("o_totalprice") > 300000, "open": c("o_orderstatus") == "O", "null": None}),
    "select 0::bigint as pos, 'dear' as name, count(*) filter (where o_totalprice > 300000) as cnt from orders union all select 1, 'open', count(*) filter (where o_orderstatus = 'O') from orders union all select 2, 'null', 0",
)


@query("select 'status' as field, o_orderstatus as term, count(*) filter (where o_totalprice > 100000) as cnt from orders group by 2 union all select 'priority', o_orderpriority, count(*) filter (where o_totalprice > 100000 and o_orderstatus = 'O') from orders group by 2")
def facet_multiselect(s: SparkSession, d: str) -> DataFrame:
    filters = {"st": c("o_orderstatus") == "O", "price": c("o_totalprice") > 100000}
    orders = t(s, d, "orders")
    a = terms.term_counts(orders, c("o_orderstatus"), terms.filters_without(filters, ("st",))).select(F.lit("status").alias("field"), "term", "cnt")
    return a.unionByName(terms.term_counts(orders, c("o_orderpriority"), terms.filters_without(filters)).select(F.lit("priority").alias("field"), "term", "cnt"))


add("facet_grouped", lambda s, d: terms.term_counts(t(s, d, "orders"), c("o_orderpriority"), group=c("o_custkey")), "select o_orderpriority as term, count(distinct o_custkey) as cnt from orders group by 1")
add("facet_grouped_query", lambda s, d: terms.query_counts(t(s, d, "orders"), {"dear": c("o_totalprice") > 300000, "open": c("o_orderstatus") == "O"}, c("o_custkey")), "select 0::bigint as pos, 'dear' as name, count(distinct o_custkey) filter (where o_totalprice > 300000) as cnt from orders union all select 1, 'open', count(distinct o_custkey) filter (where o_orderstatus = 'O') from orders")
add(
    "facet_group_truncate",
    lambda s, d: terms.term_counts(terms.group_heads(t(s, d, "orders"), "o_custkey", F.desc("o_totalprice"), F.asc("o_orderkey")), c("o_orderstatus")),
    "select o_orderstatus as term, count(*) as cnt from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1 group by 1",
)

# ranges

_range_sql = lambda table, rows: " union all ".join(f"select {i}::bigint as pos, '{n}' as name, count(*) filter (where {p}) as cnt from {table}" for i, (n, p) in enumerate(rows))


def _range(name: str, rows: list[tuple[str, str]], **kw: object) -> None:
    add(name, lambda s, d: ranges.bucket_counts(t(s, d, "orders"), c("o_totalprice"), ranges.range_buckets(**kw)), _range_sql("orders", rows))


_x = "o_totalprice"
_range("range_numeric", [(str(a), f"{_x} >= {a} and {_x} < {a + 100000}") for a in range(0, 500000, 100000)], start=0, end=500000, gap=100000)
_range("range_hardend", [("0", f"{_x} >= 0 and {_x} < 100000"), ("100000", f"{_x} >= 100000 and {_x} < 150000")], start=0, end=150000, gap=100000, hardend=True)
_range("range_soft_end", [("0", f"{_x} >= 0 and {_x} < 100000"), ("100000", f"{_x} >= 100000 and {_x} < 200000")], start=0, end=150000, gap=100000)
_range("range_other", [("100000", f"{_x} >= 100000 and {_x} < 200000"), ("200000", f"{_x} >= 200000 and {_x} < 300000"), ("before", f"{_x} < 100000"), ("after", f"{_x} >= 300000"), ("between", f"{_x} >= 100000 and {_x} < 300000")], start=100000, end=300000, gap=100000, other=("all",))
add(
    "range_include_upper",
    lambda s, d: ranges.bucket_counts(t(s, d, "lineitem"), c("l_quantity"), ranges.range_buckets(0, 50, 10, other=("before", "after"), include=("lower", "upper", "outer"))),
    _range_sql("lineitem", [(str(a), f"l_quantity >= {a} and l_quantity <= {a + 10}") for a in range(0, 50, 10)] + [("before", "l_quantity <= 0"), ("after", "l_quantity >= 50")]),
)
add(
    "range_include_edge",
    lambda s, d: ranges.bucket_counts(t(s, d, "lineitem"), c("l_quantity"), ranges.range_buckets(0, 50, 10, include=("edge",)), mincount=1),
    f"select * from ({_range_sql('lineitem', [(str(a), f'l_quantity >{"=" if a == 0 else ""} {a} and l_quantity <{"=" if a == 40 else ""} {a + 10}') for a in range(0, 50, 10)])}) where cnt >= 1",
)
_D0, _D1 = dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1)
_months = [(dt.datetime(1995, m, 1), dt.datetime(1995 + m // 12, m % 12 + 1, 1)) for m in range(1, 13)]
add(
    "range_date_month",
    lambda s, d: ranges.bucket_counts(t(s, d, "lineitem"), c("l_shipdate").cast("timestamp_ntz"), ranges.range_buckets(_D0, _D1, "+1MONTH", include=("lower", "upper", "edge"))),
    _range_sql("lineitem", [(str(a), f"l_shipdate >= timestamp '{a}' and l_shipdate <= timestamp '{z}'") for a, z in _months]),
)
add(
    "interval_facet",
    lambda s, d: ranges.bucket_counts(t(s, d, "lineitem"), c("l_quantity"), ranges.intervals((0, 10, True, True, "low"), (5, 25, False, True, "mid"), (20, None, True, True, "high"), (99, 100, True, True, "none"))),
    _range_sql("lineitem", [("low", "l_quantity between 0 and 10"), ("mid", "l_quantity > 5 and l_quantity <= 25"), ("high", "l_quantity >= 20"), ("none", "l_quantity between 99 and 100")]),
)

# pivots and heatmap

_year = lambda: F.date_format("o_orderdate", "yyyy")


@query(
    """with n as (select o_orderpriority as pr, o_orderstatus as st, count(*) as cnt, count(*) filter (where o_totalprice > 300000) as dear from orders group by rollup (pr, st)),
    a as (select pr, cnt, dear, row_number() over (order by cnt desc, pr) - 1 as pos from n where st is null and pr is not null),
    b as (select n.pr, n.st, n.cnt, n.dear, row_number() over (partition by n.pr order by n.cnt desc, n.st) - 1 as pos from n join a on a.pr = n.pr and a.pos < 3 where n.st is not null)
    select 1::int as level, pr, cast(null as varchar) as st, cnt, dear, pos from a where pos < 3 union all select 2, pr, st, cnt, dear, pos from b where pos < 3"""
)
def pivot_2level(s: SparkSession, d: str) -> DataFrame:
    return pivot.pivot_counts(t(s, d, "orders"), {"pr": c("o_orderpriority"), "st": c("o_orderstatus")}, limit=3, queries={"dear": c("o_totalprice") > 300000})


@query(
    """with o as (select o_orderpriority as pr, o_orderstatus as st, strftime(o_orderdate, '%Y') as yr from orders where o_totalprice > 50000),
    a as (select 1::int as level, pr, null::varchar as st, null::varchar as yr, count(*) as cnt, row_number() over (order by pr) - 1 as pos from o group by pr having count(*) >= 5),
    b as (select 2::int, pr, st, null::varchar, count(*), row_number() over (partition by pr order by st) - 1 from o group by pr, st having count(*) >= 5),
    e as (select 3::int, pr, st, yr, count(*), row_number() over (partition by pr, st order by yr) - 1 from o group by pr, st, yr having count(*) >= 5)
    select * from a union all select * from b union all select * from e"""
)
def pivot_3level(s: SparkSession, d: str) -> DataFrame:
    return pivot.pivot_counts(t(s, d, "orders"), {"pr": c("o_orderpriority"), "st": c("o_orderstatus"), "yr": _year()}, c("o_totalprice") > 50000, mincount=5, by_count=False)


_cell = "least(floor(({v} - 0.0) * {n} / {w}), {m})::bigint"
_heat = f"select {_cell.format(v='l_tax', n=4, w=0.08, m=3)} as row, {_cell.format(v='l_discount', n=5, w=0.1, m=4)} as col, count(*) as cnt from lineitem where l_discount between 0 and 0.1 and l_tax between 0 and 0.08 group by 1, 2"
_heat_cells = lambda s, d: pivot.heatmap_counts(t(s, d, "lineitem"), c("l_discount"), c("l_tax"), (0.0, 0.0, 0.1, 0.08), 5, 4)
add("heatmap_grid", _heat_cells, _heat.replace("0.08", "0.08::double").replace("0.1 ", "0.1::double ").replace("/ 0.1,", "/ 0.1::double,"))

# windows


def window_sql(keys: str, order: str, below: str, limit: int, offset: int, columns: str) -> str:
    """The closed form over the whole dictionary, on purpose another plan than the bounded one."""
    return f"""with k as ({keys}), r as (select *, row_number() over (order by {order}) - 1 as i, count(*) over () as n, count(*) filter (where {below}) over () as p from k),
    w as (select *, greatest(0, least(p - ({offset}), n - {limit})) as s from r), v as (select *, least(n, s + {limit}) as e from w)
    select i - s as pos, {columns}, e - s as n_rows, p - s as target_offset from v where i >= s and i < e"""


def _window(name: str, target: str, limit: int, offset: int, table: str = "part", term: str = "p_name", pred: str | None = None, accept: TermFilter = TermFilter(), where: str = "true") -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        counts = terms.term_counts(t(s, d, table), c(term), None if pred is None else F.expr(pred), accept, mincount=1)
        return window.term_window(counts, target, limit, offset)

    keys = f"select {term} as term, count(*) as cnt from {table} where {pred or 'true'} and {where} group by 1"
    add(name, run, window_sql(keys, "term", f"term < '{target}'", limit, offset, "term, cnt"))


_window("window_pos", "m", 5, 2)
_window("window_zero", "m", 5, 0)
_window("window_neg", "green", 4, -2)
_window("window_clamp_top", "b", 6, 5)
_window("window_clamp_bottom", "z", 6, -2)
_window("window_between_terms", "greenish", 5, 3)
_window("window_past_end", "zzzz", 5, 1)
_window("window_whole", "m", 500, 3)
_window("window_filtered", "m", 5, 2, pred="p_size > 20", accept=TermFilter(contains="r"), where="contains(p_name, 'r')")
_window("window_customers", "Customer#000000777", 7, 3, "customer", "c_name")

_first = lambda: F.split_part("text", F.lit(" "), F.lit(1))
_fold_sql = "replace(strip_accents(lower({x})), 'ß', 'ss')"


def _folded(s: SparkSession, d: str) -> DataFrame:
    """(norm, filing, prefix, cnt) of the first words of documents; only distinct words are folded."""
    words = terms.term_counts(t(s, d, "documents").where(_first() != ""), _first(), mincount=1)
    return words.select(text.fold("term").alias("norm"), c("term").alias("filing"), F.lit(None).cast("string").alias("prefix"), "cnt")


_folded_sql = f"select {_fold_sql.format(x='term')} as norm, term as filing, cast(null as varchar) as prefix, cnt from ({counts_sql('''split_part(text, ' ', 1)''', 'documents')}) where term <> ''"


@query(window_sql(_folded_sql, "norm, filing", "norm < 'ete'", 8, 3, "norm, filing, prefix, cnt"))
def window_folded(s: SparkSession, d: str) -> DataFrame:
    w = window.target_window(_folded(s, d), ["norm", "filing", "prefix"], c("norm") < text.fold_text("Été"), 8, 3)
    return w.select("pos", "norm", "filing", "prefix", "cnt", "n_rows", "target_offset")


@query(window_sql(_folded_sql, "norm, filing", "(norm, filing) < ('the', 'The')", 6, 2, "norm, filing, prefix, cnt"))
def window_strict(s: SparkSession, d: str) -> DataFrame:
    return window.strict_window(_folded(s, d), ("the", "The", None), 6, 2).select("pos", "norm", "filing", "prefix", "cnt", "n_rows", "target_offset")


@query(f"select row_number() over (order by norm, filing) - 1 as pos, norm, filing, cnt from (select * from ({_folded_sql}) order by norm, filing limit 40)")
def normalized_sort(s: SparkSession, d: str) -> DataFrame:
    page = _folded(s, d).orderBy("norm", "filing", "prefix").limit(40)
    return window._numbered(page, F.asc("norm"), F.asc("filing")).select("pos", "norm", "filing", "cnt")


def _docs(name: str, target: str, doc: str, limit: int, offset: int) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        part = t(s, d, "part")
        rows = part.where(c("p_size") > 10).select(c("p_name").alias("term"), c("p_partkey").cast("string").alias("doc_key"), "p_brand")
        return window.doc_window(rows, part.select(c("p_name").alias("term")), target, doc, limit, offset).select("pos", "term", "doc_key", "p_brand", "n_rows", "target_offset")

    keys = "select p_name as term, cast(p_partkey as varchar) as doc_key, p_brand from part where p_size > 10"
    hit = f"case when exists (select 1 from part where p_name = '{target}') then '{doc}' else '' end"
    add(name, run, window_sql(keys, "term, doc_key", f"(term, doc_key) < ('{target}', {hit})", limit, offset, "term, doc_key, p_brand"))


_docs("doc_window", "green bolt", "5", 8, 3)
_docs("doc_window_no_doc", "green bolt", "", 8, 0)
_docs("doc_window_missing_term", "greenish", "5", 8, 2)


@query(
    f"""with w as ({window_sql("select p_name as term, cast(p_partkey as varchar) as doc_key from part", "term, doc_key", "term < 'm'", 12, 4, "term, doc_key")})
    select term, string_agg(doc_key, ',' order by doc_key) as docs from w group by term"""
)
def doc_window_nested(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "part").select(c("p_name").alias("term"), c("p_partkey").cast("string").alias("doc_key"))
    w = window.doc_window(rows, rows.select("term"), "m", "", 12, 4)
    return w.groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("doc_key")), ",").alias("docs"))


# references

_json = lambda: F.when(c("p_partkey") % 3 == 0, F.to_json(F.struct(c("p_name").alias("x"))).substr(F.lit(6), F.length("p_name") + 2)).otherwise(
    F.to_json(F.struct(F.struct(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" ")).alias("prefix"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("filing")).alias("raw"), F.struct(F.array("p_type").alias("see_also"), F.array("p_brand").alias("use_for")).alias("refs")))
)
_post_sql = """select p_name as term, p_partkey as doc, cast(null as varchar) as ref_type, cast(null as varchar) as filing, cast(null as varchar) as prefix from part
union all select p_type, p_partkey, 'see_also', split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) || ' ' from part where p_partkey % 3 <> 0
union all select p_brand, p_partkey, 'use_for', split_part(p_name, ' ', 2), split_part(p_name, ' ', 1) || ' ' from part where p_partkey % 3 <> 0"""


def _refs_sql(post: str) -> str:
    return f"""with p as (select distinct * from ({post}))
    select term, 'total' as scope, null::varchar as ref_type, null::varchar as display, count(distinct doc) as cnt, null::varchar as filing, null::varchar as prefix from p group by term
    union all select term, 'self', null, null, count(distinct doc) filter (where ref_type is null), null, null from p group by term
    union all select term, 'ref', ref_type, prefix || filing, count(*), max(filing), max(prefix) from p where ref_type is not null group by term, ref_type, prefix || filing"""


def _postings(s: SparkSession, d: str) -> DataFrame:
    return refs.reference_postings(t(s, d, "part"), c("p_partkey"), _json())


add("refs_postings", _postings, _post_sql)
add("refs_payload", lambda s, d: payload.reference_counts(_postings(s, d)), _refs_sql(_post_sql))


@query(f"with w as (select term from ({window_sql(f'select term, count(distinct doc) as cnt from ({_post_sql}) group by term', 'term', '''term < 'S' ''', 4, 2, 'term, cnt')})) select r.* from ({_refs_sql(_post_sql)}) r join w using (term)")
def refs_payload_window(s: SparkSession, d: str) -> DataFrame:
    p = _postings(s, d)
    w = window.term_window(p.groupBy("term").agg(F.count_distinct("doc").alias("cnt")), "S", 4, 2)
    return payload.reference_counts(p.join(F.broadcast(w.select("term")), "term", "left_semi"))  # a window has at most `limit` terms


@query(_refs_sql(_post_sql))
def refs_merge(s: SparkSession, d: str) -> DataFrame:
    p = _postings(s, d)
    return payload.merge_references(*[payload.reference_counts(p.where(c("doc") % 3 == i)) for i in range(3)])


@query(f"select term, count(distinct doc) as cnt, count(distinct doc) filter (where ref_type is null) as self_cnt, count(distinct (ref_type, filing, prefix)) filter (where ref_type is not null) as n_refs from ({_post_sql}) group by term")
def refs_nested(s: SparkSession, d: str) -> DataFrame:
    return payload.nested(payload.reference_counts(_postings(s, d))).select("term", "cnt", "self_cnt", F.size("refs").cast("long").alias("n_refs"))


@query("select p_type as term, string_agg(p_partkey || ':' || p_size, ',' order by p_partkey) as entries from part where p_size > 45 group by 1")
def refs_positions(s: SparkSession, d: str) -> DataFrame:
    post = t(s, d, "part").where("p_size > 45").select(c("p_type").alias("term"), c("p_partkey").alias("doc"), F.lit(1).alias("pos"), c("p_size").cast("string").alias("payload"))
    return payload.positions(post).select("term", F.array_join(F.transform("entries", lambda e: F.concat(e["doc"], F.lit(":"), e["payload"])), ",").alias("entries"))


# tokens: the words of p_name are typed even, odd


def _tokens() -> Column:
    words = F.split("p_name", " ")
    start = lambda i: F.when(i == 0, 0).otherwise(F.length(F.get(words, F.lit(0))) + 1)
    return F.transform(words, lambda w, i: tokens.token(w, F.when(i % 2 == 0, "even").otherwise("odd"), F.lit(1), start(i), start(i) + F.length(w), F.lit(None)))


def _token_rows(s: SparkSession, d: str, f: Callable[[Column], Column]) -> DataFrame:
    rows = t(s, d, "part").select("p_partkey", F.posexplode(f(_tokens())).alias("n", "k"))
    return rows.select("p_partkey", c("n").cast("long").alias("n"), "k.term", "k.type", "k.pos_inc", "k.start", "k.end")


_W = "select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, length(split_part(p_name, ' ', 1)) as la, length(p_name) as l from part"
_tok = lambda rows: " union all ".join(f"select p_partkey, {n}::bigint as n, {term} as term, '{kind}' as type, {inc}::int as pos_inc, ({s})::int as start, ({e})::int as \"end\" from ({_W})" for n, (term, kind, inc, s, e) in enumerate(rows))
add("tokens_split", lambda s, d: _token_rows(s, d, lambda x: tokens.split(x, "even_fork", ("even",), rename="even_orig", delegate=F.upper)), _tok([("a", "even_orig", 1, "0", "la"), ("upper(a)", "even_fork", 0, "0", "la"), ("b", "odd", 1, "la + 1", "l")]))
add("tokens_process", lambda s, d: _token_rows(s, d, lambda x: tokens.process(x, F.upper, ("even",), rename="even_processed")), _tok([("upper(a)", "even_processed", 1, "0", "la"), ("b", "odd", 1, "la + 1", "l")]))
_forked = lambda x: tokens.split(x, "even_fork", ("even",), rename="even_orig", delegate=F.upper)
add("tokens_join", lambda s, d: _token_rows(s, d, lambda x: tokens.join(_forked(x), ("even_fork", "even_orig"), "joined", "!")), _tok([("upper(a) || '!' || a", "joined", 1, "0", "la"), ("b", "odd", 1, "la + 1", "l")]))
add(
    "tokens_join_components",
    lambda s, d: _token_rows(s, d, lambda x: tokens.join(_forked(x), ("even_fork", "none", "even_orig"), "joined", "!", output_components=True, placeholders=True)),
    _tok([("a", "even_orig", 1, "0", "la"), ("upper(a)", "even_fork", 0, "0", "la"), ("upper(a) || '!!' || a", "joined", 0, "0", "la"), ("b", "odd", 1, "la + 1", "l")]),
)

_src = "split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 1) || ' '"
_json_tokens = [("p_name", "filing", 1, "null", "="), ("split_part(p_name, ' ', 2)", "filing", 1, "null", "<>"), ("split_part(p_name, ' ', 1) || ' '", "prefix", 0, "null", "<>"), ("p_type", "filing", 2, f"'see_also|' || {_src}", "<>"), ("p_brand", "filing", 3, f"'use_for|' || {_src}", "<>")]


@query(" union all ".join(f"select p_partkey, {max(0, i - 1)}::bigint as n, {term} as term, '{kind}' as type, {inc}::int as pos_inc, ({pay})::varchar as payload from part where p_partkey % 3 {op} 0" for i, (term, kind, inc, pay, op) in enumerate(_json_tokens)))
def tokens_json(s: SparkSession, d: str) -> DataFrame:
    rows = refs.token_rows(t(s, d, "part"), c("p_partkey"), _json())
    return rows.select(c("doc").alias("p_partkey"), c("n").cast("long").alias("n"), "k.term", "k.type", "k.pos_inc", F.translate("k.payload", text.NUL, "|").alias("payload"))


# scalar functions

_packed = lambda: F.concat_ws(text.NUL, F.lower("p_brand"), "p_brand", F.when(c("p_size") > 25, F.split_part("p_name", F.lit(" "), F.lit(1))))
_prefix_sql = "case when p_size > 25 then split_part(p_name, ' ', 1) end"
add("multipart_parse", lambda s, d: t(s, d, "part").select("p_partkey", text.indexed(_packed()).alias("m")).select("p_partkey", "m.*"), f"select p_partkey, lower(p_brand) as norm, p_brand as filing, {_prefix_sql} as prefix from part")
add(
    "multipart_display",
    lambda s, d: t(s, d, "part").select("p_partkey", text.display(text.indexed(_packed())["prefix"], text.indexed(_packed())["filing"]).alias("display"), text.external(_packed()).alias("external"), text.normalized(_packed()).alias("norm")),
    f"select p_partkey, coalesce({_prefix_sql}, '') || p_brand as display, p_brand as external, lower(p_brand) as norm from part",
)
add("multipart_payload", lambda s, d: t(s, d, "part").select("p_partkey", text.payload(text.packed(c("p_brand"), F.when(c("p_size") > 25, c("p_type")))).alias("m")).select("p_partkey", "m.*"), "select p_partkey, p_brand as filing, case when p_size > 25 then p_type end as prefix from part")
add("transform_uri", lambda s, d: t(s, d, "part").select("p_partkey", text.uri_escape(F.concat("p_name", F.lit(" & é*~"))).alias("uri")), "select p_partkey, replace(replace(replace(url_encode(p_name || ' & é*~'), '%20', '+'), '~', '%7E'), '%2A', '*') as uri from part")
_tab = lambda: F.replace(c("p_name"), F.lit(" "), F.lit("\t"))
add("transform_prefix_ignore", lambda s, d: t(s, d, "part").select("p_partkey", text.ignore_filing_prefix(_tab()).alias("x")), "select p_partkey, split_part(p_name, ' ', 2) as x from part")
add("transform_prefix_combine", lambda s, d: t(s, d, "part").select("p_partkey", text.combine_non_filing_prefix(_tab()).alias("x")), "select p_partkey, replace(p_name, ' ', '') as x from part")
add("fold_terms", lambda s, d: _folded(s, d).groupBy("norm").agg(F.sum("cnt").alias("cnt")), f"select norm, cast(sum(cnt) as bigint) as cnt from ({_folded_sql}) group by norm")

# merging


@query("select l_returnflag || l_linestatus as term, count(*) as cnt from lineitem group by 1")
def shard_merge(s: SparkSession, d: str) -> DataFrame:
    line = t(s, d, "lineitem")
    return terms.merge_shards(*[terms.term_counts(line.where(c("l_suppkey") % 3 == i), F.concat("l_returnflag", "l_linestatus")) for i in range(3)])


@query(page_sql(counts_sql("o_orderpriority", "orders", "o_orderstatus = 'O'"), "cnt desc, term", 3, 1))
def request_params(s: SparkSession, d: str) -> DataFrame:
    params = {"facet": "true", "fq": "{!tag=st}o_orderstatus = 'O'", "facet.field": "o_orderpriority", "f.o_orderpriority.facet.limit": "3", "facet.offset": "1"}
    return request.run(t(s, d, "orders"), params)["facet_fields"]["o_orderpriority"]


@query(window_sql("select p_name as term, count(*) as cnt from part group by 1", "term", "term < 'm'", 5, 2, "term, cnt"))
def request_target(s: SparkSession, d: str) -> DataFrame:
    params = {"facet": "true", "facet.field": "{!key=names}p_name", "facet.target": "m", "facet.sort": "index", "facet.limit": "5", "facet.offset": "2", "facet.mincount": "1"}
    return request.run(t(s, d, "part"), params)["facet_fields"]["names"]


@query(window_sql("select l_shipmode as term, count(*) as cnt from lineitem group by 1", "term", "term < 'M'", 3, 1, "term, cnt").replace("l_shipmode", "strftime(l_shipdate, '%Y-%m')").replace("'M'", "'1995-03'"))
def window_shards(s: SparkSession, d: str) -> DataFrame:
    line, month = t(s, d, "lineitem"), F.date_format("l_shipdate", "yyyy-MM")
    merged = terms.merge_shards(*[terms.term_counts(line.where(c("l_suppkey") % 3 == i), month, mincount=1) for i in range(3)])
    return window.term_window(merged, "1995-03", 3, 1)


@query(f"""select '[' || string_agg('{{"pos":' || pos || ',"term":"' || term || '","cnt":' || cnt || '}}', ',' order by pos) || ']' as json from ({page_sql(counts_sql("p_brand", "part"), "cnt desc, term", 10)})""")
def response_json(s: SparkSession, d: str) -> DataFrame:
    return response.as_json(window.count_page(terms.term_counts(t(s, d, "part"), c("p_brand"), mincount=1), 10).select("pos", "term", "cnt"))


# requests


def _request(name: str, df: Callable[[SparkSession, str], DataFrame], kind: str, params: dict[str, str | list[str]], sql: str, spec: FieldSpec | None = None, key: str | None = None, then: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        own = {f.removeprefix("f.").split(".facet.")[0]: spec for f in [params[f"facet.{kind}"]]} if spec else {}
        return then(next(iter(request.run(df(s, d), {"facet": "true", **params}, own, key)[f"facet_{kind}s"].values())))

    add(name, run, sql)


_order = lambda s, d: t(s, d, "orders")
_line = lambda s, d: t(s, d, "lineitem")
_part = lambda s, d: t(s, d, "part")
_word = lambda s, d: t(s, d, "documents").select("doc_id", _first().alias("word")).where("word <> ''")
_keys = "filing as term, norm, filing, prefix, cnt"

_request(
    "request_doc_window", _part, "field",
    {"facet.field": "p_name", "fq": "p_size > 10", "facet.target": "green bolt", "facet.targetDoc": "5", "facet.limit": "8", "facet.offset": "3", "facet.sort": "index", "fl": "p_brand"},
    _SQL["doc_window"], key="p_partkey",
)
_request(
    "request_doc_window_folded", _word, "field", {"facet.field": "word", "facet.target": "the", "facet.target.strict": "false", "facet.targetDoc": "20", "facet.limit": "9", "facet.offset": "4"},
    window_sql(f"select {_fold_sql.format(x='word')} as norm, word as filing, null::varchar as prefix, doc_id::varchar as doc_key from (select doc_id, split_part(text, ' ', 1) as word from documents) where word <> ''", "norm, filing, doc_key",
               "norm < 'the' or norm = 'the' and doc_key < case when (select count(*) from k where norm = 'the') > 0 then '20' else '' end", 9, 4, "filing as term, norm, filing, prefix, doc_key"),
    FieldSpec(), "doc_id",
)
_request("request_folded", _word, "field", {"facet.field": "word", "facet.target": "Été", "facet.limit": "8", "facet.offset": "3", "facet.mincount": "1"}, window_sql(_folded_sql, "norm, filing", "norm < 'ete'", 8, 3, _keys), FieldSpec())
_request("request_strict", _word, "field", {"facet.field": "word", "facet.target": "The", "facet.target.strict": "true", "f.word.facet.limit": "6", "facet.offset": "2", "facet.zeros": "false"}, window_sql(_folded_sql, "norm, filing", "(norm, filing) < ('the', 'The')", 6, 2, _keys), FieldSpec())
_request(
    "request_external", lambda s, d: t(s, d, "part").select(_packed().alias("packed")), "field", {"facet.field": "packed", "facet.sort": "count", "facet.limit": "12", "facet.offset": "3"},
    f"""select row_number() over (order by cnt desc, norm, filing, prefix nulls first) - 1 as pos, replace(coalesce(prefix, '') || filing, '#', '-') as term, replace(url_encode(coalesce(prefix, '') || filing), '%20', '+') as value, norm, filing, prefix, cnt
    from (select lower(p_brand) as norm, p_brand as filing, {_prefix_sql} as prefix, count(*) as cnt from part group by all order by cnt desc, norm, filing, prefix nulls first limit 12 offset 3)""",
    FieldSpec(packed=True, display=lambda x: F.replace(x, F.lit("#"), F.lit("-")), serialized=text.uri_escape),
)
_own_sql = """select case when p_partkey % 3 = 0 then p_name else split_part(p_name, ' ', 2) end as filing, case when p_partkey % 3 <> 0 then split_part(p_name, ' ', 1) || ' ' end as prefix, p_partkey as doc, null::varchar as ref from part
union all select p_type, null, p_partkey, 'see_also|' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) from part where p_partkey % 3 <> 0 union all select p_brand, null, p_partkey, 'use_for|' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) from part where p_partkey % 3 <> 0"""
_request(
    "request_extended", lambda s, d: t(s, d, "part").select("p_partkey", _json().alias("j")), "field", {"facet.field": "j", "facet.target": "S", "facet.limit": "6", "facet.offset": "3", "facet.mincount": "1", "facet.extend": "true"},
    window_sql(f"select lower(filing) as norm, filing, prefix, count(distinct doc) as cnt, count(distinct doc) filter (where ref is null) as self_cnt, count(distinct ref) as n_refs from ({_own_sql}) group by all", "norm, filing, prefix nulls first", "norm < 's'", 6, 3,
               "coalesce(prefix, '') || filing as term, norm, filing, prefix, cnt, self_cnt, n_refs"),
    FieldSpec(references=True), "p_partkey", lambda x: x.withColumn("n_refs", F.size("refs").cast("long")).drop("refs"),
)
_request("request_group_truncate", _order, "field", {"facet.field": "o_orderstatus", "facet.mincount": "1", "group.truncate": "true", "group.field": "o_custkey", "group.sort": "o_totalprice desc, o_orderkey"}, f"select row_number() over (order by cnt desc, term) - 1 as pos, * from ({_SQL['facet_group_truncate']})")
_request(
    "request_interval", _line, "interval", {"facet.interval": "l_quantity", "f.l_quantity.facet.interval.set": ["[0,10]", "{!key=mid}(5,25]", "{!key=high}[20,*]", "(99,100)"]},
    _range_sql("lineitem", [("[0,10]", "l_quantity between 0 and 10"), ("mid", "l_quantity > 5 and l_quantity <= 25"), ("high", "l_quantity >= 20"), ("(99,100)", "l_quantity > 99 and l_quantity < 100")]),
)
_request(
    "request_date", _line, "date", {"facet.date": "l_shipdate", "facet.date.start": "1995-01-01T00:00:00Z", "facet.date.end": "1996-01-01T00:00:00Z", "facet.date.gap": "+1MONTH", "facet.date.other": ["before", "after"]},
    _range_sql("lineitem", [(str(a), f"l_shipdate >= timestamp '{a}' and l_shipdate <= timestamp '{z}'") for a, z in _months] + [("before", "l_shipdate < timestamp '1995-01-01'"), ("after", "l_shipdate > timestamp '1996-01-01'")]),
)
_request("request_range_fine", _order, "range", {"facet.range": "o_totalprice", "facet.range.start": "0", "facet.range.end": "500000", "facet.range.gap": "1000", "facet.range.other": "all", "facet.mincount": "1"}, f"""with b as (select i::bigint as pos, (i * 1000.0::double)::varchar as name, i * 1000.0::double as a from range(500) r(i))
    select pos, name, count(*) as cnt from b join orders on o_totalprice >= a and o_totalprice < a + 1000 group by pos, name union all select * from ({_range_sql("orders", [("before", "o_totalprice < 0"), ("after", "o_totalprice >= 500000"), ("between", "o_totalprice >= 0 and o_totalprice < 500000")]).replace("0::bigint as pos", "500::bigint as pos").replace("1::bigint as pos", "501::bigint as pos").replace("2::bigint as pos", "502::bigint as pos")}) where cnt > 0""")  # fmt: skip
_request(
    "request_heatmap", lambda s, d: t(s, d, "lineitem").select((c("l_discount") * 1800 - 90).alias("lon"), (c("l_tax") * 1000 - 40).alias("lat")).withColumn("where", F.lit(1)), "heatmap", {"facet.heatmap": "where", "facet.heatmap.geom": "[-80 -30 TO 60 35]", "facet.heatmap.gridLevel": "4"},
    """with x as (select l_discount::double * 1800 - 90 as lon, l_tax::double * 1000 - 40 as lat from lineitem), b as (select * from x where lon between -90 and 67.5 and lat between -33.75 and 45)
    select 6 - least(floor((lat + 33.75::double) * 7 / 78.75::double), 6)::bigint as pos, least(floor((lon + 90.0::double) * 7 / 157.5::double), 6)::bigint as col, count(*) as cnt, 4::int as grid_level, 7::int as columns, 7::int as rows from b group by 1, 2""",
    FieldSpec(point=("lon", "lat")), then=lambda x: x.select("pos", F.posexplode("counts").alias("col", "cnt"), "grid_level", "columns", "rows").where("cnt > 0").withColumn("col", c("col").cast("long")),
)


@query(
    """with n as (select o_orderpriority as pr, o_orderstatus as st, count(*) as cnt, count(*) filter (where o_totalprice > 300000) as dear, count(*) filter (where o_totalprice >= 0 and o_totalprice < 200000) as low, count(*) filter (where o_totalprice >= 200000 and o_totalprice < 400000) as high from orders group by rollup (pr, st)),
    a as (select *, row_number() over (order by cnt desc, pr) - 1 as pos from n where st is null and pr is not null),
    b as (select n.*, row_number() over (partition by n.pr order by n.st) - 1 as pos from n join a on a.pr = n.pr and a.pos < 3 where n.st is not null)
    select 1::int as level, pr, null::varchar as st, cnt, dear, low, high, pos from a where pos < 3 union all select 2, pr, st, cnt, dear, low, high, pos - 1 from b where pos between 1 and 2"""
)
def request_pivot_tags(s: SparkSession, d: str) -> DataFrame:
    params = {"facet": "true", "facet.pivot": "{!query=q range=r key=p}pr,st", "facet.query": "{!tag=q key=dear}o_totalprice > 300000", "facet.range": "{!tag=r key=price}o_totalprice", "facet.range.start": "0", "facet.range.end": "400000", "facet.range.gap": "200000"}
    params |= {"f.pr.facet.limit": "3", "f.st.facet.limit": "2", "f.st.facet.offset": "1", "f.st.facet.sort": "index"}
    orders = t(s, d, "orders").select("o_totalprice", c("o_orderpriority").alias("pr"), c("o_orderstatus").alias("st"))
    return request.run(orders, params)["facet_pivot"]["p"].withColumnsRenamed({"price:0.0": "low", "price:200000.0": "high"})
