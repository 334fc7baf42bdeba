"""Queries over the relational core, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.aggregates import money, salted_distinct, top_rows
from quillspark.operators.keys import bucketed, likely
from quillspark.operators.subsets import not_in, sampled_by_key
from quillspark.sources.tables import register, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def count() -> Column:
    return F.count(F.lit(1))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * (1 - l_discount) AS net_quantity FROM lineitem WHERE l_quantity > 45")
def scan_project(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net_quantity"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '1%' AND NOT o_orderdate < TIMESTAMP '1993-01-01'")
def filters(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.col("o_totalprice").between(100000, 300000) & F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").like("1%") & ~(F.col("o_orderdate") < F.expr("timestamp_ntz'1993-01-01'"))).select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, s, s <> 'F' AS differs, s = 'F' OR o_totalprice > 200000 AS either, s IS DISTINCT FROM 'F' AS apart, s IN ('F', 'P') AS listed
FROM (SELECT *, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE NOT (s = 'F' AND o_totalprice > 250000)""")
def filters_of_nulls(spark, d):
    """Three-valued logic: a comparison with null is null, and a filter keeps what is true alone."""
    o = table(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    s, dear = F.col("s"), F.col("o_totalprice")
    return o.where(~((s == "F") & (dear > 250000))).select("o_orderkey", "s", (s != "F").alias("differs"), ((s == "F") | (dear > 200000)).alias("either"), (~s.eqNullSafe("F")).alias("apart"), s.isin("F", "P").alias("listed"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
CAST(min(l_discount) AS DOUBLE) AS min_discount, max(l_tax) AS max_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.sum(money("l_extendedprice")).cast("double").alias("sum_price"),
        F.min("l_discount").alias("min_discount"), F.max("l_tax").alias("max_tax"), count().alias("n"))


@query("SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_inner(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(count().alias("n_orders"), F.sum(money("o_totalprice")).cast("double").alias("total"))


@query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_sort_merge(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o.hint("merge"), li["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderpriority").agg(count().alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, max(l_quantity) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def join_shuffled_hash(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o.hint("shuffle_hash"), li["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderstatus").agg(count().alias("n"), F.max("l_quantity").alias("most"))


@query("SELECT o_orderstatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def join_bucketed(spark, d):
    """Two tables kept in buckets of the order: their join shuffles neither."""
    o = bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 8)
    li = bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], 8)
    met = o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.groupBy("o_orderstatus").agg(count().alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY o_orderkey")
def join_key_filter(spark, d):
    """Lines of few orders: most other lines go before the shuffle."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select("o_orderkey")
    li = likely(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", o, "o_orderkey")
    return o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(count().alias("n"))


@query("SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").select("o_orderkey", "l_partkey")


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "right").select("n_name", "s_suppkey")


@query("""SELECT a.k AS customer_nation, b.k AS supplier_nation, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("customer_nation")).agg(count().alias("n_customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("supplier_nation")).agg(count().alias("n_suppliers"))
    return a.join(b, a["customer_nation"] == b["supplier_nation"], "full")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50)")
def join_semi(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity >= 50")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def join_not_in(spark, d):
    return not_in(table(spark, d, "customer"), table(spark, d, "supplier").where("s_acctbal > 9000"), "c_nationkey", "s_nationkey").select("c_custkey")


@query("""SELECT 'none' AS others, c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 1000000)
UNION ALL SELECT 'null', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 0) FROM nation)
UNION ALL SELECT 'some', c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 1)""")
def join_not_in_nulls(spark, d):
    """NOT IN against no rows, against a null, and of nulls."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    s, n = table(spark, d, "supplier").where("s_acctbal > 1000000"), table(spark, d, "nation")
    none, null = not_in(c, s, "k", "s_nationkey"), not_in(c, n.select(F.nullif("n_nationkey", F.lit(0)).alias("k2")), "c_nationkey", "k2")
    some = not_in(c, n.where("n_regionkey > 1"), "k", "n_nationkey")
    return none.select(F.lit("none").alias("others"), "c_custkey").unionAll(null.select(F.lit("null"), "c_custkey")).unionAll(some.select(F.lit("some"), "c_custkey"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey")
def join_cross(spark, d):
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).where("r_regionkey <> n_regionkey").select("r_name", "n_name")


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderstatus) AS n_statuses, count(*) AS n FROM orders GROUP BY o_orderpriority")
def distinct_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct("o_orderstatus").alias("n_statuses"), count().alias("n"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus")
def distinct_counts_salted(spark, d):
    return salted_distinct(table(spark, d, "orders"), ["o_orderstatus"], "o_custkey", "n_customers")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(count().alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("g"), count().alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupingSets([[li["l_returnflag"]], [li["l_linestatus"]], []], "l_returnflag", "l_linestatus").agg(count().alias("n"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"""count(*) FILTER (WHERE event_type = '{t}') AS "{t}\"""" for t in TYPES) + " FROM events GROUP BY user_id")
def pivot(spark, d):
    """Events of each type of a user; the types are named, so that none is looked for in the data."""
    out = table(spark, d, "events").groupBy("user_id").pivot("event_type", list(TYPES)).agg(count())
    return out.select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in TYPES))


@query("SELECT doc_id, kind, value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT (value FOR kind IN (quality, toxic))")
def unpivot(spark, d):
    return table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "kind", "value")


@query("""SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, max(l_quantity) - min(l_quantity) AS spread, mode(l_linestatus) AS usual, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag""")
def statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.percentile("l_quantity", 0.5).alias("median"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.mode("l_linestatus").alias("usual"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(None)
def approximate(spark, d):
    """Sketches: within a few percent of the exact figures, in a state of fixed size."""
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users_hll"), F.percentile_approx("value", 0.5, 1000).alias("median"))


@query("""SELECT event_type, true AS users_close, true AS hll_close, true AS median_close FROM events GROUP BY event_type""")
def approximate_bounds(spark, d):
    """The sketches beside exact figures: distinct counts within 6%, the median's rank within 1%."""
    e = table(spark, d, "events").select("event_type", "user_id", "value")
    exact = salted_distinct(e, ["event_type"], "user_id", "exact")
    found = approximate(spark, d).withColumnRenamed("event_type", "__type")
    rank = e.join(found, F.col("event_type") == F.col("__type")).groupBy("event_type").agg(count().alias("n"), F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    both = found.join(exact, F.col("__type") == exact["event_type"]).select("__type", "users", "users_hll", "exact").join(rank, F.col("__type") == rank["event_type"])
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.06 * F.col("exact")
    return both.select("event_type", near("users").alias("users_close"), near("users_hll").alias("hll_close"), ((F.col("below") <= 0.51 * F.col("n")) & (F.col("upto") >= 0.49 * F.col("n"))).alias("median_close"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, arg_max(text, turn) AS last_text, list_sort(list(DISTINCT role)) AS kinds FROM conversations GROUP BY conv_id")
def collecting(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.max_by("text", "turn").alias("last_text"), F.array_sort(F.collect_set("role")).alias("kinds"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS nth, rank() OVER p AS place, dense_rank() OVER p AS dense, ntile(4) OVER w AS quarter, percent_rank() OVER p AS share, cume_dist() OVER p AS upto FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranking(spark, d):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    long = lambda c, name: c.cast("long").alias(name)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", long(F.row_number().over(w), "nth"), long(F.rank().over(p), "place"), long(F.dense_rank().over(p), "dense"), long(F.ntile(4).over(w), "quarter"), F.percent_rank().over(p).alias("share"), F.cume_dist().over(p).alias("upto"))


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, first_value(role) OVER w AS opened, nth_value(role, 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbours(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.first("role").over(w).alias("opened"), F.nth_value("role", 2).over(whole).alias("second"))


@query("""SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS day_n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS max3 FROM events""")
def frames(spark, d):
    e = table(spark, d, "events").withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    day = Window.partitionBy("user_id").orderBy("__us").rangeBetween(-86_400_000_000, 0)
    three = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return e.select("event_id", count().over(day).alias("day_n"), F.max("value").over(three).alias("max3"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 3")
def top_k_of_groups(spark, d):
    return top_rows(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("(SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) EXCEPT ALL SELECT n_nationkey FROM nation")
def set_operations_all(spark, d):
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    return c.select(F.col("c_nationkey").alias("k")).unionByName(s.select(F.col("s_nationkey").alias("k"))).exceptAll(n.select("n_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def except_distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey").subtract(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def distinct_rows(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "doc_id")
    return docs.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT DISTINCT lang, source FROM documents")
def deduplicated(spark, d):
    return table(spark, d, "documents").select("lang", "source").dropDuplicates()


@query("SELECT lang, count(*) AS n_texts FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY lang")
def deduplicated_texts(spark, d):
    """Rows of one text count once: their digest is compared, so that texts aren't shuffled."""
    docs = table(spark, d, "documents").select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.dropDuplicates(["lang", "digest"]).groupBy("lang").agg(count().alias("n_texts"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds FROM conversations GROUP BY conv_id")
def listed(spark, d):
    register(spark, d, ("conversations",))
    return spark.sql("SELECT conv_id, listagg(role, ',') WITHIN GROUP (ORDER BY turn) AS roles, listagg(DISTINCT role, ',') WITHIN GROUP (ORDER BY role) AS kinds FROM conversations GROUP BY conv_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE ('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10 = 0")
def sampling_by_key(spark, d):
    return sampled_by_key(table(spark, d, "orders"), "o_orderkey", 10).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderpriority, true AS near_rate, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS repeats FROM orders GROUP BY o_orderpriority")
def sampling_rate(spark, d):
    """The sample by a seed beside its table: rates within five standard deviations of a tenth, no row that the table lacks, none twice."""
    all_rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(count().alias("n"))
    own = sampling(spark, d).groupBy("o_orderkey", "o_orderpriority").agg(count().alias("times"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("__key"), F.col("o_orderpriority").alias("__p"))
    held = own.join(o, (F.col("o_orderkey") == F.col("__key")) & (F.col("o_orderpriority") == F.col("__p")), "left")
    held = held.groupBy(F.col("o_orderpriority").alias("p")).agg(F.sum("times").alias("k"), F.count_if(F.col("__key").isNull()).alias("strangers"), F.count_if(F.col("times") > 1).alias("repeats"))
    near = F.abs(F.col("k") - 0.1 * F.col("n")) <= 5 * F.sqrt(0.09 * F.col("n")) + 1
    return all_rows.join(held, F.col("o_orderpriority") == F.col("p")).select("o_orderpriority", near.alias("near_rate"), "strangers", "repeats")


@query(None)
def sampling(spark, d):
    """A tenth of each priority by a seed; the same rows for the same partitions."""
    o = table(spark, d, "orders")
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return o.sampleBy("o_orderpriority", dict.fromkeys(kinds, 0.1), seed=7).select("o_orderkey", "o_orderpriority")


RECURSIVE = """WITH RECURSIVE steps(k, n) AS (SELECT CAST(0 AS INT), CAST(0 AS INT) UNION ALL SELECT CAST((k * 7 + 3) % 25 AS INT), CAST(n + 1 AS INT) FROM steps WHERE n < 12)
SELECT n, n_name FROM steps JOIN nation ON k = n_nationkey"""


@query(RECURSIVE)
def recursive(spark, d):
    register(spark, d, ("nation",))
    return spark.sql(RECURSIVE)




@query("SELECT p_partkey, p.p_brand FROM part p JOIN (SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM part GROUP BY p_brand) m ON p.p_brand = m.p_brand WHERE p_retailprice > mean + 0.01")
def correlated(spark, d):
    register(spark, d, ("part",))
    return spark.sql("SELECT p_partkey, p_brand FROM part AS p WHERE p_retailprice > (SELECT CAST(sum(CAST(q.p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) + 0.01 FROM part AS q WHERE q.p_brand = p.p_brand)")


LATERAL = "SELECT n_name, s.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) AS s"


@query(LATERAL)
def lateral(spark, d):
    register(spark, d, ("nation", "supplier"))
    return spark.sql(LATERAL)
