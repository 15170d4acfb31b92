"""Mixing sources to target weights by hash thresholds.

Every row has a 60-bit hash of its id, source, text and, among rows that are equal in these, number. A source that is to give ``base`` whole passes and a rest
takes each row ``base`` times, and once more if its hash lies below the source's threshold, so
thresholds of smaller budgets are nested in those of larger ones and reruns agree. Thresholds come
from histograms: sizes are summed by source and hash bucket, the bucket in which the budget ends is
found from the running sum over the buckets, and only the rows of that bucket are counted again in
finer buckets, until one hash is left. Rows are never sorted.

Cases: a null text has size 0. A null source is a source of its own, ordered last. Repeated rows and
rows without an id have hashes of their own, so any number of them is taken. At the boundary the row is
taken if that brings the source nearer to its target. A source without words gets the target 0; its rows
and others without words are taken as often as their hashes say, 3 times at most. An empty table gives no
rows. mix() keeps all columns of the input, whatever their names. The sources, a row each, are put in
order in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_join, fresh, known, staged

#: What a word is made of: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
BUCKET_BITS = 12
SALT = "mix-2"
#: A source gives each of its words so many times at most.
MOST_TIMES = 3


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """What tells rows apart: an MD5 of the MD5s of id, source and text."""
    parts = [F.md5(c.cast("binary")) for c in (known(doc_id), known(source), F.coalesce(text, F.lit("")))]
    return F.md5(F.concat(*parts).cast("binary"))


def hash60(key: Column, number: Column, salt: str = SALT) -> Column:
    """The first 60 bits of an MD5 of a row's key and its number among equal rows."""
    text = F.concat(F.lit(f"{salt}:"), key, F.lit(":"), number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def with_hashes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with the hash of every row as ``name``, in the place of the column ``key``.

    Only keys that rows repeat are numbered: their rows are written with the task that read them, numbered
    within such slices, and shifted by what earlier slices hold, so no task gathers the rows of a key.
    """
    many = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "mix-repeated")
    if many.isEmpty():
        return rows.withColumn(name, hash60(F.col(key), F.lit(1))).drop(key)
    slice_, at, before, number = fresh(rows, "slice", "at", "before", "number")
    alone = rows.join(many, key, "left_anti").withColumn(name, hash60(F.col(key), F.lit(1))).drop(key)
    again = rows.withColumn(slice_, F.spark_partition_id()).join(many, key, "left_semi")
    again = staged(again.withColumn(at, F.monotonically_increasing_id()), "mix-equal")
    counts = again.groupBy(key, slice_).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.select(key, slice_, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)), "mix-slices")
    within = Window.partitionBy(key, slice_).orderBy(at)
    again = again.withColumn(number, F.row_number().over(within)).join(counts, [key, slice_])
    again = again.withColumn(name, hash60(F.col(key), F.col(number) + F.col(before)))
    return alone.unionByName(again.select(*alone.columns))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, weight, target, base: the total size shared by weight, none above its limit.

    ``base`` says how many whole passes the target holds, from whole numbers. ``sizes`` holds source and size. The source whose limit is reached first is the one with the
    least size a weight, so one pass over the sources in that order finds which limits hold.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    scale = 1
    for w in weights:
        scale *= w
    fill = Window.orderBy((F.col("source_size") * F.lit(scale) / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of large sizes don't fit a long
    limits = F.coalesce(F.sum(F.col("source_size") * most_times).over(before), F.lit(0))
    total = total.withColumn("left_size", F.sum("source_size").over(everything) - limits)
    total = total.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    total = total.withColumn("full", number("left_size") * number("weight") >= number("source_size") * most_times * number("left_weight"))
    # what is left for the sources below their limit, and their weight
    rest = F.struct(
        F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most_times)).over(everything), F.lit(0)),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(0)),
    )
    total = total.withColumn("rest", rest)
    share = (F.col("rest.col1") * F.col("weight")).cast("double") / F.col("rest.col2")
    target = F.when(F.col("full"), (F.col("source_size") * most_times).cast("double")).otherwise(share)
    whole = F.expr("CAST(rest.col1 AS DECIMAL(38,0)) * weight DIV (CAST(rest.col2 AS DECIMAL(38,0)) * source_size)")
    base = F.when(F.col("source_size") == 0, 0).when(F.col("full"), most_times).otherwise(whole)
    return total.select("source", "source_size", "weight", target.alias("target"), base.cast("long").alias("base"))


def thresholds(rows: DataFrame, targets: DataFrame, bucket_bits: int = BUCKET_BITS, limit: int = BROADCAST_ROWS) -> DataFrame:
    """source, source_size, target, base, threshold: rows whose hash is below it are taken once more.

    ``rows`` holds source, size and hash, ``targets`` what source_targets() returns.
    """
    plan = targets.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    plan = staged(plan.select("source", "source_size", "target", "base", "rest"), "mix-targets")
    # lo: first hash of the range that is still looked into; rest: what it may still give
    state = plan.select("source", F.lit(0).cast("long").alias("lo"), "rest")
    shift, found = HASH_BITS, []
    while True:
        width, shift = shift, max(0, shift - bucket_bits)
        inside = bounded_join(rows, state, "source", F.col("hash"), limit=limit)
        inside = inside.where((F.col("hash") >= F.col("lo")) & (F.shiftright(F.col("hash") - F.col("lo"), width) == 0))
        sums = inside.groupBy("source", "lo", "rest", F.shiftright(F.col("hash") - F.col("lo"), shift).alias("bucket"))
        sums = sums.agg(F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("size").over(run))
        over = sums.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "least", "most", "size", "upto", "lo", "rest")).alias("b"))
        over = over.select("source", "b.*").withColumn("before", F.col("upto") - F.col("size"))
        ends = state.join(over.select(F.col("source").alias("s"), "bucket", "least", "most", "upto", "before"), F.col("source").eqNullSafe(F.col("s")), "left")
        ends = staged(ends.drop("s").withColumn("one", (F.col("least") == F.col("most")) | F.lit(shift == 0)), "mix-level")
        nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
        found += [
            ends.where("bucket is null").select("source", (F.col("lo") + F.lit(1 << width)).alias("threshold")),
            ends.where("one").select("source", F.when(nearer, F.col("least") + 1).otherwise(F.col("least")).alias("threshold")),
        ]
        lo = F.col("lo") + F.col("bucket") * F.lit(1 << shift)
        state = ends.where("not one").select("source", lo.alias("lo"), (F.col("rest") - F.col("before")).alias("rest"))
        if state.isEmpty():
            break
    ends = found[0]
    for part in found[1:]:
        ends = ends.unionByName(part)
    ends = ends.select(F.col("source").alias("s"), "threshold")
    joined = plan.join(ends, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("source", "source_size", "target", "base", "threshold")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The staged rows (doc_id, source, size, hash) and the thresholds by source."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"))
    rows = staged(with_hashes(staged(rows, "mix-sizes"), "key", "hash"), "mix-rows")
    return rows, staged(thresholds(rows, source_targets(rows), limit=limit), "mix-thresholds")


def times_taken(base: Column, hashed: Column, threshold: Column) -> Column:
    return (base + F.when((base < MOST_TIMES) & (hashed < threshold), 1).otherwise(0)).cast("int")


def mix_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every row of ``docs``."""
    rows, plan = mix_plan(docs, id_col, text_col, source_col, limit)
    out = bounded_join(rows, plan, "source", F.col("hash"), limit=limit).withColumn("times", times_taken(F.col("base"), F.col("hash"), F.col("threshold")))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = BROADCAST_ROWS) -> DataFrame:
    """The mixed corpus: each row of ``docs``, with all its columns, as often as the mix takes it."""
    _, plan = mix_plan(docs, id_col, text_col, source_col, limit)
    key, hashed, source, base, threshold, time = fresh(docs, "mix_key", "mix_hash", "mix_source", "mix_base", "mix_threshold", "mix_time")
    plan = plan.select(F.col("source").alias(source), F.col("base").alias(base), F.col("threshold").alias(threshold))
    rows = with_hashes(docs.withColumn(key, row_key(F.col(id_col), F.col(source_col), F.col(text_col))), key, hashed)
    rows = bounded_join(rows.withColumn(source, F.col(source_col)), plan, source, F.col(hashed), limit=limit)
    times = times_taken(F.col(base), F.col(hashed), F.col(threshold))
    return rows.withColumn(time, F.explode(F.array_repeat(F.lit(True), times))).select(*docs.columns)
