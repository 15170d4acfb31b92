"""Merkle fixity audit of WARC files.

Records are laid out in files by a key, one after the other, and hashed. A tree stands over each file:
a leaf is a record with its offset range, an inner node hashes the ranges and hashes of up to FANOUT
children in order of offset. Replicas are compared root by root, and only below nodes that differ are
the children looked at, down to the records, so an audit of good files reads one row a file.

Cases: a null url or body counts as empty; records with a null or repeated key are kept, in the order of
their urls' hashes and their own within the key. Records without a file (null key) are a file too, and a
file of more than FILE_RECORDS records is split into parts of so many, each with a tree of its own; a
file is told by ``file`` and ``part``. Records that only one replica has differ from nothing and are found
like others; those behind them lie at other offsets and are told by their content. Records with equal keys
and contents are interchangeable. An empty table has no files. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_join, staged

FANOUT = 16
#: Records of a WARC file.
FILE_RECORDS = 256
#: Files of records without a key, and further parts of split files, are numbered from here on: no 64-bit key divided by FILE_RECORDS gives so much.
SPLIT_FILES = 1 << 56
FILE = ["file", "part"]
_END = "\r\n\r\n"


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC response record, as text."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END))
    return F.concat(head, body, F.lit(_END))


def matched(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """A join by equal columns of the same names, as by USING, in which nulls match."""
    right = right.select(*(F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in right.columns))
    on = reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"__{c}"]) for c in names])
    if how == "full":  # a name's column is null where only the other side has the row, so the sides are told apart
        both = left.withColumn("__in", F.lit(True)).join(right, on, how)
        return both.select(*(F.when(F.col("__in"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in names), *(c for c in both.columns if c.removeprefix("__") not in names and c != "__in"))
    return left.join(right, on, how).drop(*(f"__{c}" for c in names))


def hashed_records(pages: DataFrame, key: Column, file: Column, url: Column, body: Column, copy: Column | None = None, most: int = FILE_RECORDS) -> DataFrame:
    """key, file, part, place (from 0), start, end and hash of every record; only lengths and hashes are shuffled.

    With ``copy``, a replica's body of the same record, also copy_start, copy_end and copy_hash: the
    replica's record lies where the record does, whatever its own hash.
    """
    bodies = {"": body} | ({} if copy is None else {"copy_": copy})
    rows = pages.select(key.alias("key"), file.alias("file"), F.xxhash64(F.coalesce(url, F.lit(""))).alias("address"), *(record(url, b).alias(f"{n}record") for n, b in bodies.items()))
    told = [c for n in bodies for c in (F.octet_length(f"{n}record").cast("long").alias(f"{n}length"), F.sha2(f"{n}record", 256).alias(f"{n}hash"))]
    rows = rows.select("key", "file", "address", *told)
    order = [F.col("key").asc_nulls_first(), "address", "hash", "length"]
    overfull = staged(rows.groupBy("file").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") > most), "warc-overfull")
    if overfull.isEmpty():
        rows = _in_order(rows, order)
    else:
        rows = staged(rows.withColumn("row_no", F.monotonically_increasing_id()), "warc-records")
        marked = bounded_join(rows, overfull, "file", F.col("row_no"), "left")
        rows = _in_order(marked.where("records IS NULL").drop("records", "row_no"), order).unionByName(_split(marked.where("records IS NOT NULL").drop("records"), [*order, "row_no"], most))
    upto = Window.partitionBy(*FILE).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.sum(f"{n}length").over(upto).alias(f"{n}end") for n in bodies]
    rows = rows.select("*", *ends)
    return rows.select("key", *FILE, "place", *(c for n in bodies for c in ((F.col(f"{n}end") - F.col(f"{n}length")).alias(f"{n}start"), f"{n}end", f"{n}hash")))


def _in_order(rows: DataFrame, order: list) -> DataFrame:
    """Part and place of the records of files that aren't split."""
    place = F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("long") - 1
    return rows.withColumn("part", F.lit(0).cast("long")).withColumn("place", place)


def _split(rows: DataFrame, order: list, most: int) -> DataFrame:
    """Part and place of the records of overfull files, numbered over range partitions: no task has a file to itself."""
    dealt = staged(rows.repartitionByRange(F.col("file").asc_nulls_first(), *order).withColumn("slice", F.spark_partition_id()), "warc-dealt")
    before = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("file", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("file", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("file", "slice").orderBy(*order)).cast("long") - 1
    rows = matched(dealt.withColumn("at", at), counts, ["file", "slice"], "inner").withColumn("at", F.col("at") + F.col("before"))
    rows = rows.withColumn("part", F.floor(F.col("at") / most)).withColumn("place", F.col("at") % most)
    return rows.drop("at", "before", "slice", "row_no")


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level over nodes (file, part, place, start, end, hash): at most ``fanout`` children are gathered."""
    up = nodes.groupBy(*FILE, F.floor(F.col("place") / fanout).alias("place"))
    up = up.agg(F.sort_array(F.collect_list(F.struct("place", "start", "end", "hash"))).alias("children"))
    line = F.transform("children", lambda c: F.concat_ws(" ", c["start"].cast("string"), c["end"].cast("string"), c["hash"]))
    return up.select(*FILE, "place", F.col("children")[0]["start"].alias("start"), F.element_at("children", -1)["end"].alias("end"), F.sha2(F.array_join(line, "\n"), 256).alias("hash"))


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees over all files, records first, roots last."""
    level = records.select(*FILE, "place", "key", "start", "end", "hash")
    most = level.agg(F.max("place")).first()[0]
    levels = [level]
    while most is not None and most > 0:
        most //= fanout
        level = staged(parents(level, fanout), f"merkle-{len(levels)}")
        levels.append(level)
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> list[DataFrame]:
    """Level by level, roots first: file, part, place and both sides of nodes that differ below nodes that differ."""
    found, above = [], None
    while len(a) < len(b):  # the shorter side gets roots over its roots, as the larger side has
        a = [*a, parents(a[-1], fanout)]
    while len(b) < len(a):
        b = [*b, parents(b[-1], fanout)]
    for x, y in zip(reversed(a), reversed(b)):
        sides = []
        for side, name in ((x, "a"), (y, "b")):
            if above is not None:
                side = side.withColumn("up", F.floor(F.col("place") / fanout))
                side = matched(side, above, [*FILE, "up"], "left_semi")
            named = [c for c in ("start", "end", "hash", "key") if c in side.columns]
            sides.append(side.select(*FILE, "place", F.struct(*named).alias(name)))
        same = reduce(lambda p, q: p & q, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("start", "end", "hash")])
        both = matched(sides[0], sides[1], [*FILE, "place"], "full").where(~same)
        both = staged(both, "merkle-differing")
        found.append(both)
        above = both.select(*FILE, F.col("place").alias("up"))
    return found


def _numbered_in(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*names).orderBy("part", "place")))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, part, place, fault and both sides (start, end, hash, key) of the records in which two replicas differ.

    ``a`` and ``b`` are what hashed_records() returns. The leaves that differ by place are aligned within their
    file, by content first and then by key: a record of which the other side holds the content elsewhere has
    "moved" (as those behind a missing one have), one whose key has other content there is "changed", and the
    rest are "missing" (in b) or "added". The place is that in a, or in b for added ones.
    """
    last = differing(tree(a, fanout), tree(b, fanout), fanout)[-1]
    sides = []
    for name in ("a", "b"):
        rows = last.where(F.col(name).isNotNull()).select(*FILE, "place", F.col(name).alias("record"))
        sides.append(rows.withColumn("hash", F.col("record.hash")).withColumn("key", F.col("record.key")))

    def paired(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
        names = ["file", by, "number"]
        left, right = (_numbered_in(x, ["file", by]).select(*names, F.struct("part", "place", "record", "hash", "key").alias(n)) for x, n in ((left, "a"), (right, "b")))
        return staged(matched(left, right, names, "full").select("file", "a", "b"), "merkle-aligned")

    def left_over(both: DataFrame, side: str) -> DataFrame:
        return both.where(F.col("b" if side == "a" else "a").isNull()).select("file", f"{side}.*")

    by_content = paired(*sides, "hash")
    by_key = paired(left_over(by_content, "a"), left_over(by_content, "b"), "key")
    found = by_content.where("a IS NOT NULL AND b IS NOT NULL").withColumn("fault", F.lit("moved"))
    found = found.unionByName(by_key.withColumn("fault", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("changed")))
    at = F.coalesce("a", "b")
    return found.select("file", at["part"].alias("part"), at["place"].alias("place"), "fault", F.col("a.record").alias("a"), F.col("b.record").alias("b"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """file, part and root hash; a file of one record, whose tree ended early, has that of the levels above too."""
    return levels[-1].select(*FILE, F.col("hash").alias("root"))


def level_counts(found: list[DataFrame]) -> list[int]:
    """How many nodes differ on each level, roots first."""
    return reduce(lambda done, x: [*done, x.count()], found, [])


def numbered(files: DataFrame) -> DataFrame:
    """``files`` (file, part, ..., a row each) with ``number``, one a file: ``file`` itself for a first part, numbers from SPLIT_FILES for the rest."""
    first = "part = 0 AND file IS NOT NULL"
    later = Window.orderBy(F.col("file").asc_nulls_first(), "part")  # as many rows as files were split off
    rest = files.where(f"NOT ({first})").withColumn("number", F.row_number().over(later).cast("long") - 1 + SPLIT_FILES)
    return files.where(first).withColumn("number", F.col("file")).unionByName(rest)
