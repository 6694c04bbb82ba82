"""Queries of joins, set operations, aggregates and event folds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import validation
from ..sources import files
from ..streaming import streams
from .book import Book, table

book = Book()


@book.query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def semi_join_segments(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@book.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_pending(spark, sf_dir):
    """Customers without orders: what a resumed run still has to do."""
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return files.pending(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey")


@book.query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_totalprice > c_acctbal * 50)""")
def pending_customers(spark, sf_dir):
    """Customers without an order of the first priority that is large for their balance."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first = orders.agg(F.min("o_orderpriority").alias("first"))  # one row
    urgent = orders.join(F.broadcast(first), F.col("o_orderpriority") == F.col("first")).join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    done = urgent.filter(F.col("o_totalprice") > F.col("c_acctbal") * 50).select(F.col("o_custkey").alias("c_custkey"))
    return files.pending(customers, done, "c_custkey").select("c_custkey")


@book.query("""WITH d AS (SELECT source, lang, doc_id FROM documents), n AS (SELECT source || ':' || lang AS grp, doc_id % 7 = 3 AS held FROM d)
SELECT grp FROM n GROUP BY grp HAVING bool_or(held) AND NOT bool_and(held)""")
def pair_leaks(spark, sf_dir):
    """Pairs of source and language that stand on both sides of a split by id."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("grp"), "doc_id")
    return validation.group_leaks(docs.filter("doc_id % 7 != 3"), docs.filter("doc_id % 7 = 3"), "grp")


@book.query("""WITH new AS (SELECT c_custkey, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 7 = 0)
SELECT * FROM new UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)""")
def upsert_latest(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return files.upsert(old, old.filter("c_custkey % 7 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@book.query("""SELECT c_custkey, c_mktsegment, coalesce(o_orderpriority, 'none') AS last_priority FROM customer LEFT JOIN
(SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders) ON o_custkey = c_custkey AND i = 1""")
def left_join_last(spark, sf_dir):
    """Each customer with the priority of the last order."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.coalesce("p", F.lit("none")).alias("last_priority"))


@book.query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'only_customer', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.intersect(b), "both").unionAll(count(a.subtract(b), "only_customer")).unionAll(count(a.union(b).distinct(), "any"))


@book.query("""SELECT t AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part) GROUP BY 1""")
def exploded_counts(spark, sf_dir):
    """Counts over a multi-valued column."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@book.query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def merged_sets(spark, sf_dir):
    """Sorted union of values by key, first of the rest."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"), F.min("o_orderkey").alias("first"))


@book.query("""SELECT l_shipmode_like AS kind, max(n) / sum(n) AS top FROM (SELECT l_returnflag AS l_shipmode_like, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def concentration(spark, sf_dir):
    """The share of the most frequent value in each group."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("kind").agg((F.max("n") / F.sum("n")).alias("top"))


@book.query("""SELECT DISTINCT a.source FROM documents a WHERE a.doc_id % 10 = 0 AND a.source IN (SELECT source FROM documents WHERE doc_id % 10 = 1)""")
def group_leaks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return validation.group_leaks(docs.filter("doc_id % 10 = 0"), docs.filter("doc_id % 10 = 1"), "source")


@book.query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
runs AS (SELECT user_id, event_type, g, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS longest FROM runs GROUP BY user_id""")
def event_run_lengths(spark, sf_dir):
    """The longest run of one event type of each user."""
    by_user, by_type = W.partitionBy("user_id").orderBy("event_id"), W.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("g", F.row_number().over(by_user) - F.row_number().over(by_type))
    return rows.groupBy("user_id", "event_type", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@book.query("""WITH d AS (SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM d) WHERE i <= 2""")
def call_cap(spark, sf_dir):
    """Distinct calls of each user, two of each type at most."""
    once = table(spark, sf_dir, "events").groupBy("user_id", "event_type", "props").agg(F.min("event_id").alias("event_id"))
    rows = once.withColumn("i", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))).filter("i <= 2")
    return rows.select("user_id", "event_type", "event_id")


@book.query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@book.query("""SELECT user_id AS request_id, string_agg(event_type, '' ORDER BY event_id) AS text, CAST(0 AS INTEGER) AS errors, FALSE AS finished FROM events GROUP BY user_id""")
def trace_fold(spark, sf_dir):
    """Events of a user as a trace of tokens, folded to its text."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.lit("token").alias("type"), F.col("event_type").alias("content"), F.lit(None).cast("string").alias("tool"))
    return streams.fold_trace(events).select("request_id", "text", "errors", "finished")


@book.query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_events(spark, sf_dir):
    """Event counts by hour and type; beyond what the corpus pipelines need."""
    return streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@book.query("""SELECT n_name, r_name, count(*) AS orders, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(spark, sf_dir):
    """Dimensions joined onto facts."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
