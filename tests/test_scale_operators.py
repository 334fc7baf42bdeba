"""Joins on inequalities, order over all rows, mergeable aggregates, reach, list index, kept sketches: small frames with nulls, ties, hot values and empty input."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import keys, lists, order
from quillspark.operators import sketches as sk
from quillspark.operators.band import overlapping, within_bounds
from quillspark.operators.fixpoint import reached
from quillspark.operators.mergeable import Moments, Quantiles, Spread, aggregated
from quillspark.operators.subsets import weighted_sample
from quillspark.operators.vectors import nearest

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NUMBER = st.one_of(st.none(), st.integers(-8, 8))


def bag(df) -> Counter:
    return Counter(map(tuple, df.collect()))


# inequality joins


@SLOW
@given(st.lists(st.tuples(NUMBER, NUMBER), max_size=14), st.lists(NUMBER, max_size=14), st.booleans(), st.integers(1, 5))
def test_within_bounds_equals_the_nested_loop(spark, spans, points, above, rows):
    left = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i int, low int, high int")
    right = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, at int")
    want = Counter(
        (i, a, b, j, p) for i, (a, b) in enumerate(spans) for j, p in enumerate(points) if None not in (a, b, p) and (a < p if above else a <= p) and p <= b
    )
    out = within_bounds(left, right, "low", "high", "at", above=above, rows=rows)
    assert out.columns == ["i", "low", "high", "right_i", "at"] and bag(out) == want


@SLOW
@given(st.lists(st.tuples(NUMBER, NUMBER), max_size=12), st.lists(st.tuples(NUMBER, NUMBER), max_size=12))
def test_overlapping_equals_the_nested_loop(spark, one, other):
    left, right = (spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, start int, end int") for rows in (one, other))
    sound = lambda rows: [(i, *x) for i, x in enumerate(rows) if None not in x and x[0] <= x[1]]
    want = Counter((*a, *b) for a in sound(one) for b in sound(other) if a[1] <= b[2] and b[1] <= a[2])
    assert bag(overlapping(left, right, "start", "end", rows=3)) == want


def test_a_hot_value_and_hot_bounds_are_a_grid_of_cells(spark, monkeypatch):
    """Most values are one and most bounds are one: no cell holds more than its part; pairs come in many batches."""
    from quillspark.operators import band

    monkeypatch.setattr(band, "OUT", 100)
    left = spark.range(300).select("id", F.when(F.col("id") < 250, 5.0).otherwise(F.col("id") / 10).alias("low"), F.lit(20.0).alias("high"))
    right = spark.range(400).select(F.col("id").alias("r"), F.when(F.col("id") < 300, 7.0).otherwise(F.col("id") / 20).alias("at")).unionAll(spark.createDataFrame([(1000, float("nan")), (1001, None)], "r long, at double"))
    want = left.join(right.where("not isnan(at)"), (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high"))).select("id", "low", "high", "r", "at")
    out = within_bounds(left, right, "low", "high", "at", rows=50)
    assert bag(out) == bag(want) and sum(bag(want).values()) > 70_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bounds_of_times(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left, right = spark.createDataFrame([(at(1), at(5))], "low timestamp_ntz, high timestamp_ntz"), spark.createDataFrame([(at(m),) for m in (0, 1, 5, 6)], "t timestamp_ntz")
    assert sorted(r["t"].minute for r in within_bounds(left, right, "low", "high", "t").collect()) == [1, 5]
    assert within_bounds(left.limit(0), right, "low", "high", "t").count() == within_bounds(left, right.limit(0), "low", "high", "t").count() == 0


# order over all rows


@pytest.mark.parametrize("few", [3, 50_000])
def test_values_at_ranks(spark, few, monkeypatch):
    """Ties that hold most rows, bounds on either side of them, values once each; narrowed to the last value."""
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "PARTS", 20)
    r = random.Random(4)
    values = [5] * 500 + [6] * 300 + [r.randrange(1000) for _ in range(400)] + list(range(2000, 2300)) + [None] * 9
    r.shuffle(values)
    df, known = spark.createDataFrame([(v,) for v in values], "v int"), sorted(v for v in values if v is not None)
    ranks = [1, 2, 499, 700, 800, 801, 1200, 1201, 1499, 1500]
    assert order.at_ranks(df, "v", ranks) == [known[k - 1] for k in ranks]
    assert order.quantiles(df, "v", [0, 0.3, 0.5, 1]) == [float(np.percentile(known, 100 * q)) for q in (0, 0.3, 0.5, 1)]
    assert order.quantiles(df.limit(0), "v", [0.5]) == [None]
    with pytest.raises(ValueError):
        order.at_ranks(df, "v", [1501])


def test_numbers_of_rows(spark):
    rows = [(i % 3 if i % 4 else None, f"x{i % 50}") for i in range(600)] + [(7, "same")] * 20
    df = spark.createDataFrame(rows, "a int, __at string").repartition(5)
    got = order.numbered(df, [F.asc_nulls_last("a")], "n", 6).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 621))
    assert [r["a"] for r in got] == sorted((a for a, _ in rows), key=lambda a: (a is None, a or 0))
    assert Counter((r["a"], r["__at"]) for r in got) == Counter(rows)
    assert order.numbered(df.limit(0), [F.asc("a")]).count() == 0


def test_a_hot_value_is_numbered_by_many_tasks(spark):
    df = spark.range(8000).select(F.lit(1).alias("v"), "id")
    laid = order.numbered(df, [F.asc("v")], "n", 8)
    assert laid.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 8000, 8000)
    (path,) = {f.rsplit("/", 1)[0] for f in laid.inputFiles()}
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 8000 / 4


# aggregates of one's own


def test_mergeable_aggregates_equal_the_whole(spark, monkeypatch):
    from quillspark.operators import mergeable

    monkeypatch.setattr(mergeable, "GROUPS", 2)
    r = np.random.RandomState(1)
    rows = [(g, None if i % 13 == 0 else float("nan") if i % 17 == 0 else float(x), "s") for g in (None, "a", "b", "c") for i, x in enumerate(r.exponential(3, 250))] + [("none", None, "s")]
    df = spark.createDataFrame(rows, "g string, v double, t string").repartition(6)
    spreads = {r["g"]: r["spread"] for r in aggregated(df, ["g"], "v", Spread()).collect()}
    moments = {r["g"]: r for r in aggregated(df, ["t", "g"], "v", Moments()).collect()}
    assert set(spreads) == set(moments) == {None, "a", "b", "c", "none"} and spreads["none"] is None and moments["none"]["n"] == 0
    for g in (None, "a", "b", "c"):
        x = np.array([v for k, v, _ in rows if k == g and v is not None and not math.isnan(v)])
        m, n = moments[g], len(x)
        d = x - x.mean()
        assert spreads[g] == x.max() - x.min() and m["n"] == n
        assert np.allclose((m["mean"], m["variance"], m["skewness"]), (x.mean(), x.var(ddof=1), (d**3).mean() / (d**2).mean() ** 1.5 * (n * (n - 1)) ** 0.5 / (n - 2)))
    assert aggregated(df.limit(0), ["g"], "v", Spread()).count() == 0


def test_digest_of_quantiles_keeps_its_bound(spark):
    """A hot group over many tasks, sorted input, ties; ranks are off by pi / size at most."""
    df = spark.range(40_000, numPartitions=16).select(F.lit("hot").alias("g"), F.when(F.col("id") % 4 == 0, 100.0).otherwise(F.pow(F.col("id").cast("double"), 1.5)).alias("v"))
    (got,) = aggregated(df, ["g"], "v", Quantiles((0.01, 0.5, 0.9, 0.999), 100)).collect()
    x = np.sort([r["v"] for r in df.collect()])
    assert (got["n"], got["low"], got["high"]) == (40_000, x[0], x[-1])
    for q, v in zip((0.01, 0.5, 0.9, 0.999), got["quantiles"], strict=True):
        low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
        assert low - math.pi / 100 <= q <= high + math.pi / 100, (q, v)
    held = Quantiles(size=100)
    assert len(held.update(held.zero(), x)[0]) <= 200


# reach


def test_reach_equals_a_search(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(1, 1), (None, 2), (3, None), (100, 101), (101, 100)]
    steps, edge = {0: 0, 100: 0}, [0, 100]
    while edge:
        edge = [b for a, b in links if a in edge and b is not None and b not in steps and not steps.update({b: steps[a] + 1})]
    df, starts = spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(0,), (100,), (0,), (None,)], "node long")
    assert {tuple(x) for x in reached(df, starts).collect()} == set(steps.items()) and reached(df, starts).count() == len(steps)
    assert {tuple(x) for x in reached(df, starts, 2).collect()} == {x for x in steps.items() if x[1] <= 2}
    assert reached(df, starts.limit(0)).count() == 0 and reached(df.limit(0), starts).count() == 2


# vectors in lists


def test_list_index(spark, tmp_path, monkeypatch):
    """Every row is in it; all lists give the exact neighbours; few lists reach the recall that was asked for; few folders are read; a hot list is cut."""
    monkeypatch.setattr(lists, "ROWS", 16)
    monkeypatch.setattr(lists, "BLOCKS", 2)
    r = np.random.RandomState(5)
    centres = r.normal(size=(12, 8)) * 4
    rows = [(i, (centres[0 if i % 3 == 0 else i % 12] + r.normal(size=8)).tolist()) for i in range(500)] + [(600, None), (601, [1.0]), (602, [float("nan")] * 8), (None, [0.0] * 8), (7, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = lists.Index.build(df, f"{tmp_path}/index", 8, 12)
    stored = index.blocks(spark).collect()
    assert Counter(i for b in stored for i in np.frombuffer(b["ids"], np.int64).tolist()) == Counter([*range(500), 7])
    queries = df.where("id % 20 = 0")
    exact = nearest(queries.where("id < 500"), df.where("id is not null and size(v) = 8 and not isnan(v[0])"), 4, 3)
    assert bag(index.search(queries, 4, 12)) == bag(exact)
    probes = index.probes_for(queries, df.where("not isnan(v[0])"), 4, 0.9, 3)
    got = lists.recall(index.search(queries, 4, probes), exact).agg(F.sum("hit"), F.sum("wanted")).first()
    assert probes < 12 and got[0] >= 0.9 * got[1]
    plan = index.search(queries.where("id = 20"), 4, 1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ (= \d+|IN \(\d+\))", plan)  # the folder of one list
    assert index.search(queries.limit(0), 4, 3).count() == 0
    none = lists.Index.build(df.limit(0), f"{tmp_path}/none", 8, 12)
    assert none.search(queries, 4, 3).count() == 0


# sketches, samples


def test_merged_sketches_equal_one_pass(spark):
    e = spark.range(30_000, numPartitions=6).select((F.col("id") % 7).alias("day"), (F.col("id") * 7919 % 5000).alias("u"), F.when(F.col("id") % 11 > 0, F.sqrt("id")).alias("v"))
    kept = sk.sketched(e, ["day"], "u", "v")
    got = sk.merged(kept.withColumn("all", F.lit(1)), ["all"]).select("n", sk.distinct("who").alias("users"), sk.quantile("value", 0.5).alias("median"), sk.rank("value", 50.0).alias("rank")).first()
    exact = e.agg(F.count_distinct("u"), F.percentile("v", 0.5), F.avg((F.col("v") <= 50).cast("double"))).first()
    assert got["n"] == 30_000 and got["users"] == exact[0] and abs(got["rank"] - exact[2]) < 0.01
    assert abs(e.where(F.col("v") <= got["median"]).count() / e.where("v is not null").count() - 0.5) < 0.01
    days = {r["day"]: r for r in kept.collect()}
    users = lambda d: {r["u"] for r in e.where(F.col("day") == d).select("u").distinct().collect()}
    a, b = (spark.createDataFrame([(bytearray(days[d]["who"]),)], "s binary") for d in (0, 1))
    both = a.select(F.col("s").alias("a")).join(b.select(F.col("s").alias("b"))).select(sk.in_both("a", "b"), sk.only_in("a", "b")).first()
    assert tuple(both) == (len(users(0) & users(1)), len(users(0) - users(1)))
    assert sk.sketched(e.limit(0), ["day"], "u", "v").count() == 0


def test_weighted_sample_has_its_size_and_rates(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, "a").otherwise("b").alias("g"), F.when(F.col("id") % 10 == 0, 9.0).when(F.col("id") % 10 == 1, None).when(F.col("id") % 10 == 2, 0.0).otherwise(1.0).alias("w"))
    got = weighted_sample(df, ["g"], "w", "id", 300)
    again = weighted_sample(df.repartition(7), ["g"], "w", "id", 300)
    assert bag(got) == bag(again) and {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"a": 300, "b": 300}
    heavy = got.where("g = 'a' and w = 9").count()
    assert 110 <= heavy <= 165  # 300 draws without replacement, of 300 rows of weight 9 and 2,100 of weight 1: some 138 expected
    assert got.where("w is null or w = 0").count() == 0 and weighted_sample(df.where("id < 20"), ["g"], "w", "id", 300).count() == 16


# joins by kept buckets, key filters


def test_bucketed_tables_join_and_group_without_an_exchange(spark):
    a = keys.bucketed(spark.range(500).select((F.col("id") % 90).alias("k"), "id"), ["k"], 3)
    b = keys.bucketed(spark.createDataFrame([(i % 120 if i % 7 else None, i) for i in range(300)], "j long, v long"), ["j"], 3)
    met = a.hint("merge").join(b, F.col("k") == F.col("j")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for i in range(500):
        want.update(i % 90 for j in range(300) if j % 7 and j % 120 == i % 90)
    assert {r["k"]: r["n"] for r in met.collect()} == want


def test_likely_rows_keep_every_key(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("__key"), "id").unionAll(spark.createDataFrame([(None, -1)], "k string, id long"))
    few = spark.createDataFrame([(f"k{i}",) for i in range(0, 20_000, 400)] + [(None,), ("other",)], "k string")
    left = keys.likely(df, "__key", few, "k")
    ids = {r["id"] for r in left.collect()}
    assert left.columns == df.columns and ids >= set(range(0, 20_000, 400)) and -1 not in ids and len(ids) < 3000
    assert keys.likely(df, "__key", few.limit(0), "k").count() == 0
    assert keys.likely(df, "__key", df, "__key").count() == 20_000
