"""Exact dedup by skew-safe combining, comparing full content at every stage.

Stages: rows of a task are combined as they are read (the partial aggregate); what is left of a
digest meets in salted groups; the winners of the salts are combined globally. All three group by
the digest and the whole text, so two texts of one digest are never merged. Only digests that hold
at least one in ``hot_share`` rows get more than one salt, so a text crosses the network once, and
at most ``hot_share`` digests are broadcast, whatever the size of the input.

Cases: a null text counts as empty. Of equal texts the row with the largest id stays; a null id
is smaller than any other. Of rows that repeat an id and a text, one stays and the others count as
copies; drop_copies() keeps the one whose columns have the largest hash. An empty table gives no rows.
Other columns are not read by exact_groups() and kept by drop_copies(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hashable, known, staged

#: A digest is hot if it has one row in so many or more; so there are at most so many hot ones.
HOT_SHARE = 1000
#: Groups that the rows of a hot digest are dealt out to.
SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, hot_share: int = HOT_SHARE, salts: int = SALTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    read = read.withColumn("digest", digest(F.col("text")))
    # the id that tells repeated rows apart is fixed by writing it
    members = staged(read.select("doc_id", "digest", F.monotonically_increasing_id().alias("row_no")), "exact-members")
    counted = staged(
        members.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("doc_id", "row_no")).alias("last")), "exact-digests"
    )
    total = members.count()
    hot = counted.where((F.col("rows") > 1) & (F.col("rows") * hot_share >= total)).select("digest", F.lit(True).alias("hot"))

    salted = read.join(F.broadcast(hot), "digest", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(-1))
    winners = salted.groupBy("digest", "hot", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # a digest that isn't hot has one group per text already; the text of a hot one goes on
    winners = winners.withColumn("text", F.when(F.col("hot"), F.col("text")))
    texts = winners.groupBy("digest", "hot", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    texts = texts.withColumn("texts", F.when(F.col("hot"), 1).otherwise(F.col("parts")))
    groups = texts.groupBy("digest", "hot").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.sum("texts").alias("texts"))
    groups = staged(groups.join(counted.select("digest", F.col("last.row_no").alias("last_row")), "digest"), "exact-groups")

    single = groups.where("texts = 1").select("digest", "hot", "keep_id", "group_size", "last_row")
    cold = members.join(F.broadcast(single.where("hot").select("digest")), "digest", "left_anti").join(single.where("not hot"), "digest")
    out = cold.unionByName(members.join(F.broadcast(single.where("hot")), "digest"))
    out = out.withColumn("kept", F.col("row_no") == F.col("last_row"))
    out = out.select("doc_id", "digest", "keep_id", "group_size", "kept")
    if not groups.where("texts > 1").isEmpty():
        out = out.unionByName(_of_shared_digests(read, groups.where("texts > 1").select("digest")))
    return out


def _of_shared_digests(read: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows whose digest several texts share: here the text itself is the key."""
    rows = staged(read.join(shared, "digest", "left_semi").withColumn("row_no", F.monotonically_increasing_id()), "exact-shared")
    wins = rows.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "row_no")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    wins = wins.select("digest", "text", F.col("last.doc_id").alias("keep_id"), F.col("last.row_no").alias("last_row"), "group_size")
    out = rows.join(wins, ["digest", "text"])
    return out.select("doc_id", "digest", "keep_id", "group_size", (F.col("row_no") == F.col("last_row")).alias("kept"))


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one whose columns have the largest hash; copies are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.xxhash64(*hashable(rows.schema)))
    (row,) = fresh(rows, "row")
    return rows.groupBy(*keys).agg(best.alias(row)).select(*(F.col(c) if c in keys else F.col(row)[c].alias(c) for c in rows.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key, sha = fresh(docs, "key", "sha")
    kept = exact_groups(docs, id_col, text_col).where("kept").select(known(F.col("doc_id")).alias(key), F.col("digest").alias(sha))
    rows = docs.withColumn(key, known(F.col(id_col))).withColumn(sha, sha256(F.coalesce(F.col(text_col), F.lit(""))))
    # one exchange of the texts, after copies are combined where they are read, serves both
    return one_of_each(rows, [key, sha]).join(kept, [key, sha], "left_semi").select(*docs.columns)
