"""The data source in Python: round trips, a write that fails, files that filters leave out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.sources import arrow_files


@pytest.fixture
def source(spark, tmp_path):
    arrow_files.use(spark)
    path = f"file://{tmp_path}/rows"
    return path, lambda: spark.read.format(arrow_files.NAME).option("path", path).load()


def bag(df) -> Counter:
    return Counter(map(tuple, df.collect()))


def put(df, path, mode="append"):
    df.write.format(arrow_files.NAME).option("path", path).mode(mode).save()


def test_round_trip(spark, source):
    path, read = source
    rows = spark.createDataFrame([(1, "a", 1.5, [1]), (None, None, float("nan"), None), (1, "a", 1.5, [1])], "n long, s string, d double, l array<int>").repartition(3)
    put(rows, path)
    assert read().schema == rows.schema and Counter(map(str, read().collect())) == Counter(map(str, rows.collect()))
    put(rows.limit(1), path)
    assert read().count() == 4
    put(rows.where("n = 1"), path, "overwrite")
    assert read().count() == 2 and read().where("d = 1.5").count() == 2
    put(rows.limit(0), path, "overwrite")
    assert read().count() == 0 and read().schema == rows.schema
    with pytest.raises(Exception, match="columns"):
        put(rows.select("n"), path)


def test_a_write_that_fails_leaves_no_rows(spark, source):
    path, read = source
    put(spark.range(10), path)

    @F.udf("long")
    def stumble(i):
        if i == 777:
            raise RuntimeError("on purpose")
        return i

    with pytest.raises(Exception, match="on purpose"):
        put(spark.range(0, 1000, numPartitions=4).select(stumble("id").alias("id")), path)
    assert bag(read()) == Counter((i,) for i in range(10))


def test_filters_leave_files_out(spark, source):
    path, read = source
    for low in (0, 100, 200):
        put(spark.range(low, low + 50).select("id", F.concat(F.lit("k"), F.lpad("id", 4, "0")).alias("s")).coalesce(1), path)
    for f, n, files in (("id = 120", 1, 1), ("id >= 149", 51, 2), ("id < 100", 50, 1), ("s > 'k0220'", 29, 1), ("id > 30 and id <= 100", 20, 2), ("id = 75", 0, 0)):
        assert read().where(f).count() == n, f
        assert read().where(f).rdd.getNumPartitions() == files or files == 0, f
