"""Operators on small frames with nulls, ties, repeats and empty input."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.html import html_text
from quillspark.operators.aggregates import salted_distinct, top_rows
from quillspark.operators.subsets import not_in, sampled_by_key
from quillspark.operators.temporal import asof, sessions, within
from quillspark.operators.vectors import nearest
from quillspark.sources.tables import load, save
from quillspark.streaming import windows as streams

PAIRS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.integers(0, 9), st.integers(0, 5)), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS, PAIRS)
def test_asof_is_the_last_at_or_before(spark, left, right):
    a, b = spark.createDataFrame(left, "k int, t int, v int"), spark.createDataFrame(right, "k int, t int, v int")
    got = sorted(map(tuple, asof(a, b, "k", "t", "t", ["v"]).collect()), key=str)
    want = []
    for k, t, v in left:
        found = [(u, w) for q, u, w in right if k is not None and q == k and u <= t]
        want.append((k, t, v, max(found)[1] if found else None))
    assert got == sorted(want, key=str)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), max_size=10), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40)), max_size=8))
def test_within_equals_the_nested_loop(spark, points, spans):
    p = spark.createDataFrame([(x,) for x in points], "at long")
    s = spark.createDataFrame([(a, a + n) for a, n in spans], "start long, end long")
    got = sorted(map(tuple, within(p, s, "at", "start", "end", 7).select("at", "start", "end").collect()))
    assert got == sorted((x, a, a + n) for x in points for a, n in spans if a <= x < a + n)


def test_within_by_key(spark):
    p = spark.createDataFrame([(1, 5), (2, 5), (None, 5)], "k int, at long")
    s = spark.createDataFrame([(1, 0, 9)], "k int, start long, end long")
    assert [tuple(r) for r in within(p, s, "at", "start", "end", 4, "k").select("k", "at").collect()] == [(1, 5)]


def test_sessions_split_at_gaps(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 5, 20, 24)]
    df = spark.createDataFrame([("a", t) for t in at], "k string, ts timestamp_ntz")
    got = sorted((r["started"].minute, r["ended"].minute, r["n"]) for r in sessions(df, "k", "ts", "10 minutes").collect())
    assert got == [(0, 5, 2), (20, 24, 2)]


def test_salted_distinct_counts_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 2), (1, None), (2, 5)], "g int, v int")
    assert {r["g"]: r["n"] for r in salted_distinct(df, ["g"], "v", "n").collect()} == {None: 2, 1: 0, 2: 1}


def test_top_rows_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "c"), (None, 1, "d")], "g int, v int, n string")
    got = sorted(((r["g"], r["n"], r["rank"]) for r in top_rows(df, ["g"], [F.desc("v"), F.asc("n")], 2).collect()), key=str)
    assert got == [(1, "a", 1), (1, "b", 2), (None, "d", 1)]


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tbb \n",)], "t string")
    assert [r[0] for r in df.select(tx.word_count(F.col("t"))).collect()] == [0, 0, 2]
    assert [r[0] for r in df.select(tx.mean_word_length(F.col("t"))).collect()] == [None, None, 1.5]
    assert df.select(tx.share(F.col("t"), "ab")).collect()[1][0] is None


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    save(df, f"{tmp_path}/p", by=("n",))
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/p").select("n", "s").collect()} == {(1, "a"), (2, None)}
    save(df, f"{tmp_path}/j", "json")
    assert {tuple(r) for r in load(spark, f"{tmp_path}/j", "json", "n int, s string").collect()} == {(1, "a"), (2, None)}
    with pytest.raises(ValueError):
        load(spark, f"{tmp_path}/j", "json")


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_asof_of_a_hot_key_is_cut_into_slices(spark):
    left = [(1, t, t) for t in range(0, 2000, 3)] + [(None, 5, 0), (2, None, 0), (2, 700, 0), (3, 1, 0)]
    right = [(1, t, t) for t in range(40, 2000, 37)] + [(2, 1, 9), (None, 3, 3), (2, None, 4)]
    a, b = spark.createDataFrame(left, "k int, t int, v int"), spark.createDataFrame(right, "k int, t int, v int")
    for hot, slices in ((100, 8), (0, 3), (0, 1), (10_000, 8)):
        got = {(r["k"], r["t"], r["v"]): r["asof_v"] for r in asof(a, b, "k", "t", "t", ["v"], slices=slices, hot=hot).collect()}
        for k, t, v in left:
            assert got[k, t, v] == max((w for q, u, w in right if None not in (k, t, u) and q == k and u <= t), default=None)
    assert asof(a.limit(0), b, "k", "t", "t", ["v"]).count() == 0 and asof(a, b.limit(0), "k", "t", "t", ["v"]).where("asof_v is null").count() == len(left)


def test_filters_keep_what_is_true_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    ids = lambda c: [r["n"] for r in df.where(c).orderBy("n").collect()]
    s = F.col("s")
    assert ids(s == "a") == [1] and ids(s != "a") == [3] and ids(~(s == "a")) == [3] and ids(s.isin("a", None)) == [1]
    assert ids(~s.eqNullSafe("a")) == [2, 3] and ids((s == "a") | (F.col("n") > 1)) == [1, 2, 3] and ids(~((s == "a") & (F.col("n") > 0))) == [3]
    other = spark.createDataFrame([("a",), (None,)], "o string")
    assert df.join(other, s == F.col("o")).count() == 1 and df.join(other, s.eqNullSafe(F.col("o"))).count() == 2 and df.join(other, s == F.col("o"), "left_anti").count() == 2


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    for others in ([], [1], [1, None], [None]):
        right = spark.createDataFrame([(x,) for x in others], "b int")
        left.createOrReplaceTempView("not_in_left")
        right.createOrReplaceTempView("not_in_right")
        want = spark.sql("SELECT a FROM not_in_left WHERE a NOT IN (SELECT b FROM not_in_right)").collect()
        assert sorted(map(str, not_in(left, right, "a", "b").collect())) == sorted(map(str, want)), others


def test_nearest_equals_all_pairs(spark):
    r = np.random.RandomState(3)
    rows = [(i, r.randint(-3, 4, 5).astype(float).tolist()) for i in range(60)] + [(60, None), (61, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for x in nearest(df.where("id % 7 = 0"), df, 3, 4).orderBy("query", "place").collect():
        got.setdefault(x["query"], []).append((x["neighbour"], x["likeness"]))
    for q in range(0, 60, 7):
        like = sorted((-float(np.dot(rows[q][1], v)), i) for i, v in rows[:60] if i != q)
        assert got[q] == [(i, -s) for s, i in like[:3]]
    assert set(got) == set(range(0, 60, 7)) and nearest(df.limit(0), df, 3, 4).count() == 0


def test_text_of_pages(spark):
    page = "<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><!-- no\n<p> --><body><p>one <b>two</b>&nbsp;three<br>four</p><p>1 &lt; 2 &amp;lt; x < y</p></body>"
    df = spark.createDataFrame([(page,), (None,), ("",), ("plain",)], "html string")
    assert [r[0] for r in df.select(html_text(F.col("html"))).collect()] == ["A & B\none two three\nfour\n1 < 2 &lt; x < y", None, "", "plain"]


@pytest.mark.parametrize(("html", "text"), [
    ("a&#233;b &#x41;&#X1F642;&#0065;", "aéb A🙂A"), ("&#38;lt; &amp;#65; &#38;amp; &am&#112;;", "&lt; &#65; &amp; &amp;"), ("&#0; &#xD800; &#1114112; &#99999999;", "\ufffd \ufffd \ufffd \ufffd"),
    ("x &lt;b&gt; &unknown; &lt &#; &#x;", "x <b> &unknown; &lt &#; &#x;"), ("&ldquo;&hellip;&rdquo; 3&times;4&euro;", "“…” 3×4€"), ("&#32;&#10;&nbsp;", ""), ("&amp;", "&"), ("&#39;", "'"),
])
def test_entities_are_read_once(spark, html, text):
    import duckdb

    from quillspark.functions.html import html_text_sql

    assert spark.createDataFrame([(html,)], "html string").select(html_text(F.col("html"))).first()[0] == text
    assert duckdb.execute(f"SELECT {html_text_sql('html')} FROM (SELECT ? AS html)", [html]).fetchone()[0] == text


def test_sample_by_key_is_the_same_everywhere(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k")).unionAll(spark.createDataFrame([(None,)], "k string"))
    a, b = (sorted(r["k"] for r in sampled_by_key(df.repartition(n), "k", 10).collect()) for n in (1, 5))
    assert a == b and 400 < len(a) < 600


def test_stream_goes_on_behind_what_it_has_read(spark, tmp_path):
    source, out = f"{tmp_path}/source", (f"{tmp_path}/checkpoint", f"{tmp_path}/rows")
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    put = lambda rows: spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(source)
    read = lambda: streams.tumbling(spark.readStream.schema("ts timestamp, event_type string").parquet(source))
    put([(at(0, 5), "a"), (at(0, 50), "a"), (at(3, 0), "a")])
    assert {(r["started"].hour, r["n"]) for r in streams.drained(read(), *out).collect()} == {(0, 2)}
    put([(at(0, 40), "a"), (at(2, 55), "a"), (at(5, 0), "a")])  # behind the watermark of 2:50; before it; after
    assert {(r["started"].hour, r["n"]) for r in streams.drained(read(), *out).collect()} == {(0, 2), (2, 1), (3, 1)}
