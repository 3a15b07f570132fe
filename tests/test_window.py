import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexifacet.operators import window

TABLE = [
    ("D", 1, 0, "D", 1, 0), ("D", 1, -1, "E", 1, -1), ("D", 1, 1, "C", 1, 1), ("Da", 1, 0, "E", 1, 0), ("Da", 2, 0, "E F", 2, 0), ("Fa", 2, 2, "E F", 2, 2), ("D", 2, 2, "C D", 2, 1),
    ("C", 2, 2, "C D", 2, 0), ("F", 2, -1, "F G", 2, 0), ("H", 2, -1, "F G", 2, 2), ("C", 6, 0, "C D E F G", 5, 0), ("D", 6, 0, "C D E F G", 5, 1), ("D", 6, -1, "C D E F G", 5, 1), ("D", 6, 6, "C D E F G", 5, 1),
]
ALL, EVEN, ODD = [1, 1, 1], [1, 0, 1, 0, 1], [0, 1, 0, 1, 0]
UNITS = [
    (ALL, 0, 0, 0, 0), (ODD, 0, 0, 0, 1), (EVEN, 0, 0, 0, 0), (ALL, 1, 0, 0, 1), (ODD, 1, 0, 0, 1), (EVEN, 1, 0, 0, 2), (ALL, 1, -1, -1, 2), (ODD, 1, -1, -1, 3), (ODD, 0, -1, -1, 3),
    (EVEN, 2, -1, -1, 4), (EVEN, 1, -1, -1, 4), (ALL, 1, -2, -1, 2), (ALL, 1, 1, 1, 0), (ODD, 3, 1, 1, 1), (ODD, 2, 1, 1, 1), (EVEN, 2, 1, 1, 0), (EVEN, 1, 1, 1, 0), (ALL, 1, 2, 1, 0),
    (ODD, 5, 2, 2, 1), (EVEN, 4, 2, 2, 0), (EVEN, 3, 2, 2, 0), (ALL, 3, 0, 1, 2), (ALL, 2, -1, 0, 2), (ALL, 3, -1, 1, 2), (ALL, 0, 1, 0, 0), (ALL, 0, 2, 0, 0),
]


def closed(keys, target, limit, offset):
    p, n = sum(k < target for k in keys), len(keys)
    start = max(0, min(p - offset, n - limit))
    return keys[start : start + limit], p - start


def run(spark, keys, target, limit, offset):
    df = spark.createDataFrame([(k, 1) for k in keys], "term string, cnt long")
    rows = window.term_window(df, target, limit, offset).orderBy("pos").collect()
    return [r["term"] for r in rows], rows[0]["target_offset"] if rows else None, [r["pos"] for r in rows], {r["n_rows"] for r in rows}


@pytest.mark.parametrize("target,limit,offset,terms,count,at", TABLE)
def test_windows(spark, target, limit, offset, terms, count, at):
    got = run(spark, list("CDEFG"), target, limit, offset)
    assert got == (terms.split(), at, list(range(count)), {count})


@pytest.mark.parametrize("counts,target,offset,at,index", UNITS)
def test_rejected_terms(spark, counts, target, offset, at, index):
    keys = [str(i) for i, c in enumerate(counts) if c >= 1]
    assert run(spark, keys, str(target), 1, offset)[:2] == ([str(index)], at)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 8), p=st.integers(0, 8), limit=st.integers(1, 10), offset=st.integers(-11, 11))
def test_bounded_form_is_the_closed_form(spark, n, p, limit, offset):
    keys = [chr(98 + i) for i in range(n)]
    target = chr(98 + min(p, n))
    want, at = closed(keys, target, limit, offset)
    got = run(spark, keys, target, limit, offset)
    assert got[0] == want and (not want or got[1] == at)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_unbounded_pages(spark, n):
    counts = spark.range(n).select(F.concat(F.lit("t"), F.col("id")).alias("term"), (F.col("id") % 7).alias("cnt"))
    data = [(f"t{i}", i % 7) for i in range(n)]
    got = sorted((r["pos"], r["term"]) for r in window.index_page(counts, -1, 2).collect())
    assert got == list(enumerate(sorted(t for t, _ in data)[2:]))
    page = window.count_page(counts, -1)
    assert sorted((r["pos"], r["term"]) for r in page.collect()) == list(enumerate(t for t, _ in sorted(data, key=lambda x: (-x[1], x[0]))))


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        window.term_window(spark.createDataFrame([("a", 1)], "term string, cnt long"), "a", 0)


def test_documents(spark):
    rows = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3"), ("C", "4"), ("C", "5")], "term string, doc_key string")
    for target in ("C", "Bb"):
        got = window.doc_window(rows, rows, target, "4", 3, 2).orderBy("pos").collect()
        assert [(r["term"], r["doc_key"], r["target_offset"]) for r in got] == [("A", "2", 2), ("B", "3", 2), ("C", "4", 2)]


def test_plan_is_two_bounded_sorts(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("term"), F.lit(1).alias("cnt")).write.parquet(str(tmp_path / "k"))
    plan = window.term_window(spark.read.parquet(str(tmp_path / "k")), "5", 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") >= 2 and "LessThan(term,5)" in plan
