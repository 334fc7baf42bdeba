"""Queries over scalar and nested functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.html import html_text, html_text_sql
from quillspark.operators.vectors import nearest
from quillspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(r"""SELECT doc_id, upper(source) AS source, CAST(length(trim(text)) AS BIGINT) AS n, substring(text, 1, 12) AS head, CAST(strpos(text, 'the') AS BIGINT) AS at,
replace(lang, 'e', 'E') AS lang, regexp_replace(text, '[aeiou]+', '_', 'g') AS bare, split_part(text, ' ', 1) AS first_word, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS code, reverse(source) AS back FROM documents""")
def strings(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.upper("source").alias("source"), F.length(F.trim(t)).cast("long").alias("n"), F.substring(t, 1, 12).alias("head"), F.locate("the", t).cast("long").alias("at"),
        F.replace("lang", F.lit("e"), F.lit("E")).alias("lang"), F.regexp_replace(t, "[aeiou]+", "_").alias("bare"), F.split_part(t, F.lit(" "), F.lit(1)).alias("first_word"),
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("code"), F.reverse("source").alias("back"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS doy,
CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INT) AS days, CAST(o_orderdate + INTERVAL 45 DAY AS TIMESTAMP) AS due, strftime(o_orderdate, '%Y/%m/%d') AS written FROM orders""")
def dates(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_trunc("month", at).cast("timestamp_ntz").alias("month"), F.year(at).alias("y"), F.quarter(at).alias("q"), F.dayofyear(at).alias("doy"),
        F.datediff(at, F.lit("1992-01-01").cast("date")).alias("days"), (at + F.expr("interval 45 days")).alias("due"), F.date_format(at, "yyyy/MM/dd").alias("written"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity / 7, 4) AS DOUBLE) AS seventh, CAST(l_partkey % 11 AS BIGINT) AS m, CAST(floor(l_extendedprice) AS BIGINT) AS low, CAST(ceil(l_extendedprice) AS BIGINT) AS high,
round(ln(l_quantity), 9) AS lg, round(sqrt(l_quantity), 9) AS root, round(pow(1 + l_discount, 3), 9) AS cube, l_quantity / NULLIF(l_linenumber - 1, 0) AS ratio, abs(l_discount - 0.05) AS off, greatest(l_tax, l_discount) AS most, CAST(sign(l_tax - l_discount) AS INT) AS s FROM lineitem""")
def numbers(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(q / 7, 4).alias("seventh"), F.pmod("l_partkey", F.lit(11)).alias("m"), F.floor(p).alias("low"), F.ceil(p).alias("high"),
        F.round(F.log(q), 9).alias("lg"), F.round(F.sqrt(q), 9).alias("root"), F.round(F.pow(1 + F.col("l_discount"), 3), 9).alias("cube"), F.try_divide(q, F.col("l_linenumber") - 1).alias("ratio"), F.abs(F.col("l_discount") - 0.05).alias("off"),
        F.greatest("l_tax", "l_discount").alias("most"), F.signum(F.col("l_tax") - F.col("l_discount")).cast("int").alias("s"))


@query("""SELECT vec_id, CAST(len(embedding) AS INT) AS n, list_aggregate(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), 'sum')::BIGINT AS whole_sum,
CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive, CAST(list_max(embedding) AS DOUBLE) AS most, CAST(embedding[2] AS DOUBLE) AS second FROM embeddings""")
def arrays(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.aggregate(F.transform(e, lambda x: F.round(x.cast("double") * 1000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("whole_sum"),
        F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.array_max(e).cast("double").alias("most"), F.element_at(e, 2).cast("double").alias("second"))


@query("""SELECT label, CAST(i AS INT) AS i, CAST(round(sum(CAST(v AS DECIMAL(18,9))), 6) AS DOUBLE) AS total FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY label, i""")
def exploded(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.round(F.sum(F.col("v").cast("decimal(18,9)")), 6).cast("double").alias("total"))


@query("SELECT conv_id, map_keys(m) AS ks, map_values(m) AS vs FROM (SELECT conv_id, map_from_entries(list({'k': turn, 'v': role} ORDER BY turn)) AS m FROM conversations GROUP BY conv_id)")
def maps(spark, d):
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", "role"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.map_keys("m").alias("ks"), F.map_values("m").alias("vs"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS next FROM events")
def json_fields(spark, d):
    k = F.get_json_object("props", "$.k")
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", k.alias("k"), (parsed["k"] + 1).alias("next"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def variants(spark, d):
    v = F.variant_get(F.parse_json("props"), "$.k", "long")
    return table(spark, d, "events").select("event_id", v.alias("k")).where("k is not null")


@query(r"""SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, CAST(max(n) AS BIGINT) AS longest, CAST(sum(digits) AS BIGINT) AS digits FROM (SELECT lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents) GROUP BY lang""")
def text_statistics(spark, d):
    docs = table(spark, d, "documents").select("lang", tx.word_count(F.col("text")).alias("w"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"), F.max("w").alias("longest"), F.sum("digits").alias("digits"))


@query(f"SELECT page_id, {html_text_sql('html')} AS text FROM pages")
def page_text(spark, d):
    """The text of each whole page, without markup."""
    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT q.vec_id AS query, x.vec_id AS neighbour, round(list_dot_product(q.v, x.v), 6) AS likeness, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, x.v), 9) DESC, x.vec_id) AS INT) AS place
FROM e q JOIN e x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id QUALIFY place <= 5""")
def nearest_vectors(spark, d):
    """For each vector whose id is divisible by 20 the five most alike of all others, exactly."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = nearest(e.where("id % 20 = 0"), e, 5, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return found.select("query", "neighbour", F.round("likeness", 6).alias("likeness"), "place")


@query("SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_convs, CAST(max(length(text)) AS BIGINT) AS max_chars FROM conversations GROUP BY role")
def utterances(spark, d):
    """The flagship: turns, conversations and longest text of each role."""
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.count_distinct("conv_id").alias("n_convs"), F.max(F.length("text")).cast("long").alias("max_chars"))


@query(r"""SELECT role, turn, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_words, CAST(sum(CAST(text LIKE '%?' AS INT)) AS BIGINT) AS questions FROM conversations GROUP BY role, turn""")
def turn_statistics(spark, d):
    c = table(spark, d, "conversations").select("role", "turn", tx.word_count(F.col("text")).alias("w"), F.col("text").endswith("?").cast("int").alias("q"))
    return c.groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_words"), F.sum("q").alias("questions"))
