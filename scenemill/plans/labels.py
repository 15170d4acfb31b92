"""Queries on labels: vocabularies, phrases, replies, captions, tokens and parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..sources.tables import table
from . import inputs
from .registry import query


@query("""
SELECT event_type, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' END AS resolved,
       CASE WHEN event_type = 'error' THEN 'blocked' WHEN event_type IN ('view', 'click', 'purchase') THEN 'mapped' ELSE 'unmapped' END AS state, count(*) AS n FROM events GROUP BY ALL
""")
def category_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Events by what a vocabulary says of their type, however the vocabulary is spelt."""
    mapping = spark.createDataFrame([(" View ", "look"), ("CLICK", "act"), ("purchase", "act")], "name string, target string")
    blocked = spark.createDataFrame([("Error",)], "name string")
    out = text.resolve_categories(table(spark, folder, "events"), mapping, blocked, "event_type")
    return out.groupBy("event_type", "resolved", "state").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(trim(text), '^(?:a|an|the)\s+', '', 'i')) AS phrase FROM documents")
def strip_article(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(text.strip_article(F.col("text"))).alias("phrase"))


#: What a reply says of an event, its own class and the label read from it, by the event's number.
_ALLOWED = ["a view", "a click", "the purchase"]


@query(r"""
WITH e AS (SELECT event_id, event_type AS t, CASE WHEN event_type = 'view' THEN 'a view' WHEN event_type = 'purchase' THEN 'the purchase' ELSE 'a click' END AS own, event_id % 7 AS k FROM events),
l AS (SELECT event_id, own, CASE k WHEN 0 THEN 'a ' || t WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN 'unclear' WHEN 5 THEN t WHEN 6 THEN t END AS label FROM e),
s AS (SELECT event_id, own, label, CASE WHEN label = 'unclear' THEN 'unclear' WHEN regexp_replace(label, '^a ', '') = 'view' THEN 'a view' WHEN regexp_replace(label, '^a ', '') = 'click' THEN 'a click' WHEN regexp_replace(label, '^a ', '') = 'purchase' THEN 'the purchase' END AS said FROM l)
SELECT event_id, label, CASE WHEN said IS NULL THEN 'error' WHEN said = 'unclear' THEN 'unclear' WHEN said = own THEN 'confirmed' ELSE 'relabeled' END AS verdict FROM s
""")
def parse_vlm_json(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with thoughts, articles, asides, capitals, full stops, numbers for labels, or nothing to read, judged against the row's own class."""
    t, k = F.col("event_type"), F.col("event_id") % 7
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    reply = (
        F.when(k == 0, say('<think>{"label": "no"}</think> so {"label": "A ', F.initcap(t), '."}'))
        .when(k == 1, say('{"label": "', t, ' (sure, {}) "} {"other": 1}'.replace("{}", "quite")))
        .when(k == 2, say('{"label": "x"} then {"label": "', F.upper(t), '"} {"label": 5}'))
        .when(k == 3, F.lit('{"label": " Unclear. "}'))
        .when(k == 4, say("no object: ", t))
        .when(k == 5, say('{"label": "', t, '"} {"label": broken}'))
        .otherwise(say('{"label": "', t, ' (a) (b)."}'))
    )
    own = F.when(t == "view", "a view").when(t == "purchase", "the purchase").otherwise("a click")
    rows = table(spark, folder, "events").select("event_id", own.alias("own"), text.reply_label(reply).alias("label"))
    return rows.select("event_id", "label", text.verdict(F.col("label"), F.col("own"), F.array(*map(F.lit, _ALLOWED))).alias("verdict"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", text.dug(F.col("props"), "k").alias("k"))


@query("""
WITH s AS (SELECT n_regionkey, n_nationkey, n_name, coalesce(sum(length(n_name) + 3) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM nation),
c AS (SELECT n_regionkey, string_agg(n_name, ' . ' ORDER BY n_nationkey) AS caption FROM nation GROUP BY n_regionkey)
SELECT n_nationkey, start, (start + length(n_name))::BIGINT AS stop, caption FROM s JOIN c USING (n_regionkey)
""")
def caption_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The nations of a region as one caption, with each one's span in it."""
    rows = table(spark, folder, "nation")
    spans = text.caption_spans(rows, ["n_regionkey"], "n_nationkey", "n_name")
    return spans.join(text.captions(rows, ["n_regionkey"], "n_nationkey", "n_name"), "n_regionkey").select("n_nationkey", "start", "stop", "caption")


@query("SELECT o_orderkey, md5('instance' || chr(31) || o_custkey || chr(31) || coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'None')) AS token FROM orders")
def token_hash(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, folder, "orders").select("o_orderkey", text.token("instance", F.col("o_custkey"), status).alias("token"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, array_to_string(list_sort(list_distinct(list_concat(range(l_linenumber, l_linenumber + 3), [l_quantity::BIGINT]))), ' ') AS numbers FROM lineitem
""")
def number_ranges(spark: SparkSession, folder: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    ranges = F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(", "), q)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.array_join(text.numbers_of(ranges), " ").alias("numbers"))


_TIERS = "['auto_accept', 'flagged', 'rejected']"


@query(f"SELECT {_TIERS}[greatest(l_linenumber % 3, l_partkey % 3) + 1] AS tier, count(*) AS n FROM lineitem GROUP BY ALL")
def worse_tier(spark: SparkSession, folder: str) -> DataFrame:
    tier = lambda c: F.element_at(F.array(F.lit("auto_accept"), F.lit("flagged"), F.lit("rejected")), (F.col(c) % 3 + 1).cast("int"))
    return table(spark, folder, "lineitem").groupBy(text.worse_tier(tier("l_linenumber"), tier("l_partkey")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {inputs.IMAGE_BOXES} SELECT image, index AS proposal_index, name, round(score, 9) AS score FROM boxes")
def parallel_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Rows put together into one row of arrays an image, and taken apart again."""
    rows = inputs.image_boxes(spark, folder).select("image", F.col("index").alias("proposal_index"), "name", F.round("score", 9).alias("score"))
    return arrays.apart(arrays.together(rows, ["image"], ["name", "score"]), ["name", "score"])
