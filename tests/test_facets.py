import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lexifacet import catalog
from lexifacet.functions import text, tokens
from lexifacet.operators import payload, pivot, ranges, terms
from lexifacet.plans import request, response
from lexifacet.plans.fields import FieldSpec
from lexifacet.sources import refs
from lexifacet.streaming.facets import windowed_counts

NUL = "\0"


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_zero_terms_and_missing(spark):
    df = spark.createDataFrame([("red", 1), ("red", 2), ("blue", 2), (None, 1)], "t string, x int")
    assert sorted(rows(terms.term_counts(df, F.col("t"), F.col("x") == 1), "term", "cnt")) == [("blue", 0), ("red", 1)]
    assert rows(terms.term_counts(df, F.col("t"), F.col("x") == 1, mincount=1), "term", "cnt") == [("red", 1)]
    assert rows(terms.missing_count(df, F.col("t"), F.col("x") == 1), "term", "cnt") == [(None, 1)]


def test_multivalued_terms_count_once(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],), (None,)], "t array<string>")
    assert sorted(rows(terms.term_counts(df, F.col("t"), multi=True), "term", "cnt")) == [("a", 2), ("b", 1)]
    assert rows(terms.missing_count(df, F.col("t"), multi=True), "cnt") == [(2,)]


@pytest.mark.parametrize("packed,want", [("norm␀filing", ("norm", "filing", None)), ("␀filing", ("", "filing", None)), ("␀", ("", "", None)), ("norm␀filing␀prefix", ("norm", "filing", "prefix")), ("␀filing␀prefix", ("", "filing", "prefix")), ("␀␀", ("", "", "")), ("norm␀filing␀", ("norm", "filing", "")), ("␀filing␀", ("", "filing", ""))])
def test_multipart(spark, packed, want):
    df = spark.createDataFrame([(packed.replace("␀", NUL),)], "s string")
    assert rows(df.select(text.indexed(F.col("s")).alias("m")).select("m.*"), "norm", "filing", "prefix") == [want]


def test_references(spark):
    values = [
        '{"raw":"some value","refs":{"use_for":["ref1","ref2"],"see_also":["ref3"]}}', '"something"', '{"filing":"something","prefix":"The "}', '{"prefix":"The ","filing":"something"}',
        '{"refs":{"use_for":["ref1",{"prefix":"a ","filing":"chicken"}],"see_also":["ref3"]},"raw":{"prefix":"the ","filing":"unconsoled"}}',
    ]
    df = spark.createDataFrame(list(enumerate(values)), "d int, v string")
    got = {}
    for r in refs.references(df, F.col("d"), F.col("v")).collect():
        got.setdefault(r["doc"], set()).add((r["filing"], r["prefix"], r["ref_type"], *((r["raw_filing"], r["raw_prefix"]) if r["ref_type"] else (None, None))))
    own = lambda f, p=None: (f, p, None, None, None)
    assert got[0] == {own("some value"), ("ref1", None, "use_for", "some value", None), ("ref2", None, "use_for", "some value", None), ("ref3", None, "see_also", "some value", None)}
    assert got[1] == {own("something")} and got[2] == got[3] == {own("something", "The ")}
    u = ("unconsoled", "the ")
    assert got[4] == {own(*u), ("ref1", None, "use_for", *u), ("chicken", "a ", "use_for", *u), ("ref3", None, "see_also", *u)}
    bad = spark.createDataFrame([(1, "{")], "d int, v string")
    assert refs.references(bad, F.col("d"), F.col("v"), failfast=False).count() == 0
    with pytest.raises(Exception):
        refs.references(bad, F.col("d"), F.col("v")).collect()


def test_cross_references(spark):
    df = spark.createDataFrame([(1, '{"raw":"Hegel","refs":{"see_also":["Hegelianism","Hegelianism"]}}'), (2, '"Hegelianism"'), (3, '"Hegelianism"')], "d int, v string")
    got = {(r["term"], r["scope"], r["ref_type"], r["display"]): r["cnt"] for r in payload.reference_counts(refs.reference_postings(df, F.col("d"), F.col("v"))).collect()}
    assert got == {("Hegelianism", "total", None, None): 3, ("Hegelianism", "self", None, None): 2, ("Hegelianism", "ref", "see_also", "Hegel"): 1, ("Hegel", "total", None, None): 1, ("Hegel", "self", None, None): 1}


def test_merge(spark):
    schema = "term string, scope string, ref_type string, display string, cnt long, filing string, prefix string"
    a = [("total", None, None, 9, None, None), ("self", None, None, 4, "Hegel", None), ("ref", "use_for", "G. Hegel", 2, "Hegel", "G. "), ("ref", "use_for", "Georg Hegel2", 3, "Hegel2", "Georg ")]
    b = [("total", None, None, 12, None, None), ("self", None, None, 3, "Hegel", None), ("ref", "use_for", "G. Hegel", 4, "Hegel", "G. "), ("ref", "use_for", "Hegel3", 1, "Hegel3", None), ("ref", "see_also", "G. W. F. Hegel", 4, "Hegel", "G. W. F. ")]
    frames = [spark.createDataFrame([("t", *x) for x in part], schema) for part in (a, b)]
    got = {(r["scope"], r["ref_type"], r["display"]): r["cnt"] for r in payload.merge_references(*frames).collect()}
    assert got == {("total", None, None): 21, ("self", None, None): 7, ("ref", "use_for", "G. Hegel"): 6, ("ref", "use_for", "Georg Hegel2"): 3, ("ref", "use_for", "Hegel3"): 1, ("ref", "see_also", "G. W. F. Hegel"): 4}


def _sentence(spark):
    words = "The quick red fox jumped over the lazy brown dogs".split()
    made = [tokens.token(F.lit(w), F.lit("even" if i % 2 == 0 else "odd"), F.lit(1), F.lit(i), F.lit(i + 1), F.lit(None)) for i, w in enumerate(words)]
    return spark.range(1).select(F.array(*made).alias("t")), words


def test_token_algebra(spark):
    df, words = _sentence(spark)
    even = lambda c: tokens.split(c, "even_fork", ("even",), rename="even_orig")
    both = lambda c: tokens.split(even(c), "odd_fork", ("odd",), rename="odd_orig")
    out = df.select(even(F.col("t")).alias("s"), tokens.process(F.col("t"), F.upper, ("even",), rename="even_processed").alias("p"), tokens.join(both(F.col("t")), ("even_orig", "even_fork"), "joined", "!", placeholders=True).alias("j"), tokens.join(both(F.col("t")), ("even_orig", "even_fork"), "joined", "!", output_components=True, placeholders=True).alias("c")).first()
    assert [(x["term"], x["type"], x["pos_inc"]) for x in out["s"]][:3] == [("The", "even_orig", 1), ("The", "even_fork", 0), ("quick", "odd", 1)] and len(out["s"]) == 15
    assert [x["term"] for x in out["p"]] == [w.upper() if i % 2 == 0 else w for i, w in enumerate(words)]
    assert len(out["j"]) == 15 and [(x["term"], x["type"], x["pos_inc"]) for x in out["j"]][:3] == [("The!The", "joined", 1), ("quick", "odd_orig", 1), ("quick", "odd_fork", 0)]
    assert len(out["c"]) == 25 and [(x["type"], x["pos_inc"]) for x in out["c"]][:5] == [("even_orig", 1), ("even_fork", 0), ("joined", 0), ("odd_orig", 1), ("odd_fork", 0)]


@pytest.mark.parametrize("kind,want", [("normalized", "payload1"), ("filing", None)])
def test_join_payload(spark, kind, want):
    group = [("unconsoled", "normalized", 1, "payload1"), ("Unconsoled", "filing", 0, None), ("The ", "prefix", 0, None)]
    made = F.array(*[tokens.token(F.lit(a), F.lit(b), F.lit(c), F.lit(0), F.lit(1), F.lit(p)) for a, b, c, p in group])
    got = spark.range(1).select(tokens.join(made, ("normalized", "filing", "prefix"), "indexed", "!", kind).alias("j")).first()["j"]
    assert [(x["term"], x["payload"]) for x in got] == [("unconsoled!Unconsoled!The ", want)]


def test_ranges_and_dates():
    names = [b.name for b in ranges.range_buckets(0, 25, 10, other=("all",))]
    assert names == ["0", "10", "20", "before", "after", "between"]
    assert [b.high for b in ranges.range_buckets(0, 25, 10, hardend=True)] == [10, 20, 25] and [b.high for b in ranges.range_buckets(0, 25, 10)] == [10, 20, 30]
    assert ranges.add_gap(dt.datetime(2024, 1, 31), "+1MONTH") == dt.datetime(2024, 2, 29) and ranges.add_gap(dt.datetime(2024, 11, 30), "+1MONTH") == dt.datetime(2024, 12, 30)
    for bad in (dict(gap=0), dict(gap=1, include=("x",)), dict(gap=1, other=("x",))):
        with pytest.raises(ValueError):
            ranges.range_buckets(0, 2, **bad)


@pytest.mark.parametrize("include", [("lower",), ("upper",), ("lower", "upper"), ("edge",), ("lower", "edge", "outer"), ("all",)])
@pytest.mark.parametrize("start,end,gap,hardend", [(0, 205, 2, True), (0, 205, 2, False), (-3.0, 7.0, 0.1, False), (0.1, 9.95, 0.1, True)])
def test_many_equal_steps(spark, include, start, end, gap, hardend):
    """Counted by step as by testing each bucket."""
    values = [start + i * gap / 2 for i in range(-20, 260)] + [start + i * gap for i in range(120)] + [end, end, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    buckets = ranges.range_buckets(start, end, gap, hardend, ("all",), include)
    assert len(buckets) > ranges.WIDE
    got = rows(ranges.bucket_counts(df, F.col("v"), buckets, F.col("v") < 150).orderBy("pos"), "pos", "name", "cnt")

    def hits(b, v):
        return v is not None and v < 150 and (b.low is None or v > b.low or b.low_in and v == b.low) and (b.high is None or v < b.high or b.high_in and v == b.high)

    assert got == [(i, b.name, sum(hits(b, v) for v in values)) for i, b in enumerate(buckets)]


@pytest.mark.parametrize("value,want", [
    ('{"raw": "some value", "refs": {"use_for":["ref1","ref2"], "see_also":["ref3"]}}', [("some value", "filing", 1, None), ("ref1", "filing", 2, "use_for␀some value"), ("ref2", "filing", 3, "use_for␀some value"), ("ref3", "filing", 4, "see_also␀some value")]),
    ('"something"', [("something", "filing", 1, None)]),
    ('{"filing":"something","prefix":"The "}', [("something", "filing", 1, None), ("The ", "prefix", 0, None)]),
    ('{"prefix":"The ","filing":"something"}', [("something", "filing", 1, None), ("The ", "prefix", 0, None)]),
    ('{"raw": {"prefix": "the ", "filing": "unconsoled"}, "refs": {"use_for":["ref1",{"prefix": "a ", "filing": "chicken"}], "see_also":["ref3"]}}', [
        ("unconsoled", "filing", 1, None), ("the ", "prefix", 0, None), ("ref1", "filing", 2, "use_for␀unconsoled␀the "), ("chicken", "filing", 3, "use_for␀unconsoled␀the "), ("a ", "prefix", 0, "use_for␀unconsoled␀the "), ("ref3", "filing", 4, "see_also␀unconsoled␀the "),
    ]),
])
def test_reference_tokens(spark, value, want):
    df = spark.createDataFrame([(1, value), (2, "{"), (3, None)], "d int, v string")
    got = refs.reference_tokens(df, F.col("d"), F.col("v"), failfast=False).collect()
    assert [(r["doc"], [(t["term"], t["type"], t["pos_inc"], t["payload"]) for t in r["tokens"]]) for r in got] == [(1, [(*x[:3], x[3] and x[3].replace("␀", NUL)) for x in want])]


def test_token_rows(spark):
    """The rows of reference_tokens' arrays, none for a value without tokens; each value is parsed once."""
    values = ['{"raw":{"prefix":"the ","filing":"a"},"refs":{"use_for":["b",{"prefix":"c ","filing":"d"}],"see_also":[]}}', '"e"', "{}", "[]", "null", "", None, '{"refs":{"use_for":["f"]}}', '{"raw":"g","refs":{}}', '{"raw":null,"refs":{"see_also":[null,{},"h"]}}', '{"filing":null,"prefix":"i"}', "7", '{"filing":"j"}']
    df = spark.createDataFrame(list(enumerate(values)), "d int, v string").repartition(2)
    arrays = refs.reference_tokens(df, F.col("d"), F.col("v"), failfast=False).collect()
    got = refs.token_rows(df, F.col("d"), F.col("v"), failfast=False).collect()
    want = [(r["doc"], n, k) for r in arrays for n, k in enumerate(r["tokens"])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got) and len({r["doc"] for r in arrays} - {r["doc"] for r in got}) == 2
    for bad in ("{", '{"raw":"a","refs":{"x":', '"a'):
        one = spark.createDataFrame([(1, bad)], "d int, v string")
        for f in (refs.references, refs.token_rows):
            assert f(one, F.col("d"), F.col("v"), failfast=False).count() == 0
            with pytest.raises(Exception, match="MALFORMED"):
                f(one, F.col("d"), F.col("v")).collect()
    for name in ("tokens_json", "refs_postings"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("parseJson("), plan.count("from_json(")) == (1, 1), name


def test_pivot_of_three_levels(spark):
    """Limits, offsets and orders for each level; children go with their parents; one rollup in the plan."""
    data = [(a, b, c) for a, n in (("x", 5), ("y", 9), ("z", 2)) for b in "pqr"[: n // 2] for c in "uvw" for _ in range(n if b == "p" else 1)] + [(None, "p", "u"), ("y", None, "u"), ("y", "p", None)]
    df = spark.createDataFrame(data, "a string, b string, c string")
    fields = {k: F.col(k) for k in "abc"}
    got = pivot.pivot_counts(df, fields, limit=[2, 2, 1], offset=[0, 0, 1], by_count=[True, True, False])
    want = []
    count = lambda *k: sum(r[: len(k)] == k for r in data)
    tops = sorted({r[0] for r in data} - {None}, key=lambda a: (-count(a), a))[:2]
    for i, a in enumerate(tops):
        want.append((1, a, None, None, count(a), i))
        mids = sorted({r[1] for r in data if r[0] == a} - {None}, key=lambda b: (-count(a, b), b))[:2]
        for j, b in enumerate(mids):
            want.append((2, a, b, None, count(a, b), j))
            want += [(3, a, b, c, count(a, b, c), n) for n, c in enumerate(sorted({r[2] for r in data if r[:2] == (a, b)} - {None})[1:2])]
    assert sorted(map(str, rows(got, "level", "a", "b", "c", "cnt", "pos"))) == sorted(map(str, want))
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Expand ") == 1


def test_heatmap(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 0.1), (2.0, 0.0)], "x double, y double")
    cells = pivot.heatmap_counts(df, F.col("x"), F.col("y"), (0.0, 0.0, 1.0, 1.0), 2, 3)
    assert sorted(rows(cells, "row", "col", "cnt")) == [(0, 0, 1), (0, 1, 1), (2, 1, 1)]
    assert rows(pivot.heatmap_grid(cells, 2, 3).orderBy("row"), "counts") == [([1, 1],), (None,), ([0, 1],)]
    with pytest.raises(ValueError):
        pivot.heatmap_counts(df, F.col("x"), F.col("y"), (0.0, 0.0, 1.0, 1.0), 1000, 1000)


def test_requests(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 2, "y"), (None, 2, "y")], "t string, n int, g string")
    out = request.run(df, {"facet": "true", "fq": ["{!tag=n}n = 2"], "facet.field": ["t", "{!key=all ex=n}t", "{!key=two terms=b,zz}t"], "facet.missing": "true", "facet.query": ["n = 1", "{!key=ys}g = 'y'"], "facet.range": "n", "facet.range.start": "1", "facet.range.end": "3", "facet.range.gap": "1", "facet.pivot": "g,t"})
    got = response.facet_counts(out)
    names = lambda f: [(r["term"], r["cnt"]) for r in got["facet_fields"][f]]
    assert names("t") == [("a", 1), ("b", 1), (None, 1)] and names("all") == [("a", 2), ("b", 1), (None, 1)] and names("two") == [("b", 1), ("zz", 0)]
    assert [r["cnt"] for r in got["facet_queries"]] == [0, 3] and [(r["name"], r["cnt"]) for r in got["facet_ranges"]["n"]] == [("1", 0), ("2", 3)]
    assert json.loads(response.as_json(out["facet_fields"]["t"]).first()["json"])[0]["term"] == "a"
    for bad in ({"facet.target": "a", "facet.sort": "count"}, {"facet.exists": "true", "facet.mincount": "2"}, {"facet.sort": "x"}, {"group.facet": "true"}):
        with pytest.raises(ValueError):
            request.run(df, {"facet": "true", "facet.field": "t"} | bad)
    with pytest.raises(ValueError):
        request.run(df, {"facet": "true", "facet.field": "n", "facet.prefix": "1"})


@pytest.mark.parametrize("params,message", [
    ({"facet.field": "t", "facet.targett": "a"}, "unknown parameter"), ({"facet.field": "t", "target": "a"}, "unknown parameter"), ({"facet.field": "t", "f.t.facet.limits": "1"}, "unknown parameter"), ({"facet.field": "zz"}, "no such field"),
    ({"facet.interval": "n", "facet.interval.set": "[1,2]", "group.facet": "true", "group.field": "g"}, "grouped"), ({"facet.interval": "n"}, "missing parameter"), ({"facet.interval": "n", "facet.interval.set": "1,2"}, "not an interval"), ({"facet.interval": "n", "facet.interval.set": "[2,1]"}, "ends before"),
    ({"facet.heatmap": "p", "group.facet": "true", "group.field": "g"}, "grouped"), ({"facet.heatmap": "n"}, "no points"), ({"facet.heatmap": "p", "facet.heatmap.format": "png"}, "ints2D"), ({"facet.heatmap": "p", "facet.heatmap.gridLevel": "12"}, "cells"), ({"facet.heatmap": "p", "facet.heatmap.geom": "world"}, "geom"),
    ({"facet.date": "n", "facet.date.start": "1", "facet.date.end": "2", "facet.date.gap": "1"}, "no date facet"), ({"facet.field": "t", "facet.targetDoc": "1"}, "document keys"), ({"facet.field": "t", "facet.target": "a", "facet.limit": "-1"}, "limit"), ({"facet.field": "t", "facet.target": "a", "facet.method": "enum"}, "method fc"),
    ({"facet.field": "t", "facet.target": "a", "facet.sort": "count"}, "index order"), ({"facet.field": "t", "facet.extend": "true"}, "references"), ({"facet.field": "t", "group.truncate": "true"}, "group.field"), ({"facet.field": "t", "facet.target": "a", "group.facet": "true", "group.field": "g"}, "grouped"),
    ({"facet.range": "n", "facet.range.start": "0", "facet.range.end": "9", "facet.range.gap": "1", "facet.range.include": "inner"}, "unknown"),
])
def test_requests_that_are_refused(spark, params, message):
    df = spark.createDataFrame([("a", 1, "x", 0.0, 0.0)], "t string, n int, g string, x double, y double")
    with pytest.raises(ValueError, match=message):
        request.run(df, {"facet": "true"} | params, {"p": FieldSpec(point=("x", "y"))})


def test_accepted_and_without_effect(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "t string, n int")
    more = {"facet.threads": "4", "facet.method": "fcs", "facet.enum.cache.minDf": "3", "facet.overrequest.ratio": "2", "facet.overrequest.count": "5", "facet.distrib.mco": "true"}
    one, two = (rows(request.run(df, {"facet": "true", "facet.field": "t"} | x)["facet_fields"]["t"], "pos", "term", "cnt") for x in ({}, more))
    assert one == two == [(0, "a", 1), (1, "b", 1)]


def test_keys_of_references(spark):
    values = ['{"raw":{"prefix":"The ","filing":"Été"},"refs":{"use_for":["summer"]}}', '{"prefix":"An ","filing":"été"}', '"Hegel"', '{"raw":"Hegel","refs":{"see_also":[{"prefix":"The ","filing":"Été"}]}}']
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)], "d int, v string, p int")
    ask = lambda **more: request.run(df, {"facet": "true", "facet.field": "v", "facet.extend": "true", "facet.mincount": "1"} | {k.replace("_", "."): x for k, x in more.items()}, {"v": FieldSpec(references=True)}, "d")["facet_fields"]["v"].orderBy("pos")
    got = ask(facet_sort="index")
    assert rows(got, "term", "norm", "cnt", "self_cnt") == [("The Été", "ete", 2, 1), ("An été", "ete", 1, 1), ("Hegel", "hegel", 2, 2), ("summer", "summer", 1, 0)]
    assert [[(x["ref_type"], x["display"], x["cnt"]) for x in r["refs"]] for r in got.collect()] == [[("see_also", "Hegel", 1)], [], [], [("use_for", "The Été", 1)]]
    strict = ask(facet_target='{"filing":"été","prefix":"An "}', facet_target_strict="true", facet_limit="1")
    assert rows(strict, "term", "target_offset") == [("An été", 0)]
    assert rows(ask(facet_target="ETE", facet_limit="1"), "term") == [("The Été",)] and rows(ask(fq="p = 1", facet_sort="index"), "term", "cnt") == [("The Été", 1), ("An été", 1), ("Hegel", 1)]


def test_response_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(response, "MOST", 5)
    facets = {"facet_fields": {"t": spark.range(6).withColumnRenamed("id", "pos")}}
    with pytest.raises(ValueError, match="more than 5"):
        response.facet_counts(facets)


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def refuse(name, *args, **kw):
        if name == "lexifacet.llm" or name == "zstandard":
            raise ImportError("no zstandard", name="zstandard")
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", refuse)
    with pytest.warns(UserWarning, match="left out"):
        assert "window_pos" in entry.queries()


def test_fold():
    assert text.fold_text("ÉtéSTRAẞE") == "etestrasse"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), k) for m, k in ((1, "a"), (2, "a"), (3, "b"))], "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, F.col("k")).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("counted"), "term", "cnt")) == [("a", 2), ("b", 1)]
