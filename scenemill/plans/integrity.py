"""Queries of checks: references, completeness, uniqueness, splits, rules, matches and shared verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, sequence
from ..sources.tables import table
from .registry import query


@query("""
SELECT 'line_order' AS link, count(*) AS n_dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'nation_region', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2)
""")
def fk_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Dangling rows by link, where some targets are taken away."""
    t = {n: table(spark, folder, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    links = [
        ("line_order", t["lineitem"], "l_orderkey", t["orders"].where("o_orderkey % 10 <> 3"), "o_orderkey"),
        ("order_customer", t["orders"], "o_custkey", t["customer"].where("c_acctbal > 0"), "c_custkey"),
        ("customer_nation", t["customer"], "c_nationkey", t["nation"], "n_nationkey"),
        ("nation_region", t["nation"], "n_regionkey", t["region"].where("r_regionkey <> 2"), "r_regionkey"),
    ]
    return integrity.closure_report(links)


@query("""
SELECT l_orderkey, concat_ws(',', CASE WHEN NOT bool_or(l_returnflag = 'A') THEN 'A' END, CASE WHEN NOT bool_or(l_returnflag = 'N') THEN 'N' END,
                             CASE WHEN NOT bool_or(l_returnflag = 'R') THEN 'R' END) AS missing FROM lineitem GROUP BY l_orderkey
""")
def completeness(spark: SparkSession, folder: str) -> DataFrame:
    out = integrity.missing_values(table(spark, folder, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"])
    return out.select("l_orderkey", F.array_join("missing", ",").alias("missing"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 3)
""")
def complete_groups(spark: SparkSession, folder: str) -> DataFrame:
    out = integrity.complete_only(table(spark, folder, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.duplicates(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, min(o_orderstatus) AS least, max(o_orderstatus) AS largest FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def inconstant_values(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.inconstant(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus")


@query("""
WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0),
p AS (SELECT DISTINCT o_orderkey AS k, 'a' AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT DISTINCT o_orderkey, 'b' FROM orders WHERE o_orderkey % 3 = 0),
c AS (SELECT k, count(*) AS n FROM p GROUP BY k)
SELECT count(*) FILTER (n IS NULL) AS n_uncovered, count(*) FILTER (n > 1) AS n_overlapping, count(*) FILTER (w.k IS NULL) AS n_unknown FROM w FULL JOIN c ON w.k = c.k
""")
def partition_report(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    parts = {"a": orders.where("o_orderstatus = 'O'"), "b": orders.where("o_orderkey % 3 = 0")}
    return integrity.partition_report(orders.where("o_orderkey % 7 <> 0"), parts, "o_orderkey")


@query("""
WITH d AS (SELECT md5(text) AS content, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT content, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n, count(DISTINCT split) > 1 AS leaks FROM d GROUP BY content HAVING count(*) > 1
""")
def split_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that occur more than once, with the splits that hold them."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    rows = table(spark, folder, "documents").select(F.md5("text").alias("content"), split.alias("split"))
    return integrity.split_leaks(rows, "split", "content").withColumn("splits", F.array_join("splits", ","))


@query("""
WITH v AS (
  SELECT n_nationkey AS scene_token, 'solvent_customers' AS predicate, count(c_custkey) AS n_offenders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < 0 GROUP BY n_nationkey
  UNION ALL SELECT n_nationkey, 'solvent_suppliers', count(s_suppkey) FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY n_nationkey)
SELECT *, n_offenders = 0 AS passed FROM v
""")
def scene_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    checks = {
        "solvent_customers": table(spark, folder, "customer").where("c_acctbal < 0").withColumnRenamed("c_nationkey", "scene_token"),
        "solvent_suppliers": table(spark, folder, "supplier").where("s_acctbal < 0").withColumnRenamed("s_nationkey", "scene_token"),
    }
    return integrity.verdicts(checks, table(spark, folder, "nation").select(F.col("n_nationkey").alias("scene_token")))


@query("""
WITH f AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS match, count(*) AS n_matches FROM lineitem WHERE l_tax > 0.02 GROUP BY ALL)
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, match, coalesce(n_matches, 0) AS n_matches FROM lineitem l LEFT JOIN f USING (l_partkey, l_suppkey) WHERE l_quantity >= 25
""")
def exact_row_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    out = integrity.exact_matches(rows.where("l_quantity >= 25"), rows.where("l_tax > 0.02"), ["l_partkey", "l_suppkey"], "l_orderkey")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "match", "n_matches")


@query("""
WITH p AS (SELECT CASE WHEN l_quantity > 30 THEN l_linenumber WHEN l_quantity > 20 THEN 0 END AS object, CASE WHEN l_returnflag = 'R' THEN 24 END AS road FROM lineitem)
SELECT CASE WHEN coalesce(object, 0) <> 0 THEN object ELSE coalesce(road, 0) END AS label, count(*) AS n FROM p GROUP BY ALL
""")
def label_fold(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, folder, "lineitem").withColumn("object", F.when(q > 30, F.col("l_linenumber")).when(q > 20, 0)).withColumn("road", F.when(F.col("l_returnflag") == "R", 24))
    return rows.groupBy(integrity.folded(rows, "object", "road").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events),
a AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'unclear' WHEN 1 THEN 'error' WHEN 2 THEN 'confirmed' ELSE 'relabeled' END AS answer FROM r WHERE rank <= 3 AND user_id % 5 <> 0),
g AS (SELECT user_id, event_type, coalesce(arg_min(answer, rank) FILTER (answer NOT IN ('unclear', 'error')), arg_max(answer, rank) FILTER (answer = 'unclear'), arg_max(answer, rank)) AS verdict FROM a GROUP BY ALL)
SELECT event_id, rank::INTEGER AS rank, coalesce(verdict, 'skipped_small') AS verdict FROM r LEFT JOIN g USING (user_id, event_type)
""")
def verdict_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Three representatives of a group are asked, and all its members take the answer."""
    ranked = integrity.representatives(table(spark, folder, "events"), ["user_id", "event_type"], [F.col("value").desc(), F.col("event_id").asc()])
    says = F.element_at(F.array(*map(F.lit, ("unclear", "error", "confirmed", "relabeled"))), (F.col("event_id") % 4 + 1).cast("int"))
    asked = ranked.where("rank <= 3 and user_id % 5 <> 0").withColumn("answer", says)
    return integrity.propagated(ranked, asked, ["user_id", "event_type"], "answer").select("event_id", "rank", "verdict")


@query("""
WITH l AS (SELECT event_id, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN p % 5 <> 0 THEN p::VARCHAR ELSE '' END AS prev, CASE WHEN n % 5 <> 0 THEN n::VARCHAR ELSE '' END AS next FROM l WHERE event_id % 5 <> 0
""")
def scoped_links(spark: SparkSession, folder: str) -> DataFrame:
    """A scope's rows with the links that lead out of it blanked."""
    rows = sequence.linked(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "prev", "next")
    kept = rows.where("event_id % 5 <> 0").select(*(F.col(c).cast("string").alias(c) for c in ("event_id", "prev", "next")))
    return integrity.blanked(kept, ["prev", "next"], "event_id").withColumn("event_id", F.col("event_id").cast("long"))


@query("""
WITH k AS (SELECT * FROM events WHERE event_id % 5 <> 0)
SELECT event_id, coalesce(lag(event_id::VARCHAR) OVER w, '') AS prev, coalesce(lead(event_id::VARCHAR) OVER w, '') AS next FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def relinked_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Links closed over the rows that are left out."""
    rows = table(spark, folder, "events").where("event_id % 5 <> 0").withColumn("token", F.col("event_id").cast("string"))
    return integrity.relinked(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "prev", "next")


@query("""
SELECT concat_ws(',', CASE WHEN l_quantity < 5 THEN 'enough' END, CASE WHEN l_discount > 0.05 THEN 'cheap' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'known_flag' END) AS errors,
       count(*) AS n FROM lineitem GROUP BY ALL
""")
def contract_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"enough": F.col("l_quantity") >= 5, "cheap": F.col("l_discount") <= 0.05, "known_flag": F.col("l_returnflag").isin("A", "N")}
    return table(spark, folder, "lineitem").groupBy(F.array_join(integrity.rule_errors(rules), ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))
