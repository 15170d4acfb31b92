"""Records as lines of JSON: read with the errors of every line, written so that a reader finds all of them or none."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Files

VERSION = "__schema_version__"
#: Errors that are told when a read fails.
SHOWN = 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_number within a file's split order, and text of every line that isn't blank."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    return text.where(F.trim("text") != "").select("file", (F.col("at") + 1).alias("line"), "text")


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str, version: str | None = None, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The good rows (file, line and the record's columns) and the errors (file, line, error) of all lines.

    A line is wrong if it isn't JSON of the schema, is of another version, or breaks a rule (name -> what
    must hold). Files are records of one scene each, and are read whole.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = schema if version is None else T.StructType([*schema, T.StructField(VERSION, T.StringType())])
    bad = "__corrupt"
    kept = T.StructType([*wanted, T.StructField(bad, T.StringType())])
    rows = lines(spark, path).withColumn("r", F.from_json("text", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    checks = [F.when(F.col(f"r.{bad}").isNotNull() | F.col("r").isNull(), F.lit("not valid JSON of the schema"))]
    if version is not None:
        checks.append(F.when(F.col(f"r.{bad}").isNull() & ~F.col(f"r.{VERSION}").eqNullSafe(version), F.concat(F.lit("schema version "), F.coalesce(f"r.{VERSION}", F.lit("null")))))
    values = rows.withColumn("faults", F.array_compact(F.array(*checks)))
    values = values.select("file", "line", "faults", *(F.col(f"r.{f.name}").alias(f.name) for f in schema))
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(f"breaks {name}")) for name, rule in (rules or {}).items()]
    if broken:
        values = values.withColumn("faults", F.when(F.size("faults") > 0, F.col("faults")).otherwise(F.array_compact(F.array(*broken))))
    good = values.where(F.size("faults") == 0).drop("faults")
    return good, values.where(F.size("faults") > 0).select("file", "line", F.explode("faults").alias("error"))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, version: str | None = None, rules: dict[str, Column] | None = None, unique: list[str] | None = None) -> DataFrame:
    """All records; if any line is wrong or a key repeats, a ValueError that tells the first SHOWN errors and their number."""
    good, errors = read_lines(spark, path, schema, version, rules)
    if unique:
        again = good.groupBy(*unique).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line")).alias("at")).where("n > 1")
        errors = errors.unionByName(again.select("at.file", "at.line", F.concat(F.lit("repeats "), F.concat_ws(", ", *(F.col(u).cast("string") for u in unique))).alias("error")))
    found = errors.orderBy("file", "line", "error").limit(SHOWN).collect()
    if found:
        told = "; ".join(f"{r.file.rsplit('/', 1)[-1]} line {r.line}: {r.error}" for r in found)
        raise ValueError(f"{errors.count()} errors in {path}: {told}")
    return good.drop("file", "line")


def digest(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum of their hashes, which the order doesn't change."""
    told = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(told), F.lit(0).cast("decimal(38,0)"))).first()
    return n, int(total)


def write_records(rows: DataFrame, path: str, version: str | None = None, rules: dict[str, Column] | None = None, format: str = "json") -> int:
    """Writes the rows as a folder of ``path``: checked, written aside, read back, compared, and only then renamed.

    Returns the number of rows. A rule that a row breaks, or a difference on reading, leaves the old folder as it was.
    """
    spark = rows.sparkSession
    files, aside = Files(spark), f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:8]}"
    for name, rule in (rules or {}).items():
        n = rows.where(~F.coalesce(rule, F.lit(False))).count()
        if n:
            raise ValueError(f"{n} rows break {name}")
    out = rows if version is None else rows.withColumn(VERSION, F.lit(version))
    try:
        writer = out.write.format(format)
        (writer.option("ignoreNullFields", "false") if format == "json" else writer).save(aside)
        back = spark.read.schema(out.schema).format(format).load(aside)
        # what was written is the reference: rows may come from a source that gives others on each run
        if digest(back)[0] != out.count() or digest(back.drop(VERSION)) != digest(rows):
            raise OSError(f"{aside} doesn't hold what was written")
        n = back.count()
        files.remove(path)
        files.rename(aside, path)
    except BaseException:
        files.remove(aside)
        raise
    return n


#: A box of a scene as another stage hands it over.
PRELABEL = (
    "token string, sample_token string, instance_token string, category string, frame string, t_ns bigint, time_base string, translation_m array<double>, size_wlh_m array<double>,"
    " rotation_wxyz array<double>, num_lidar_pts int, provenance struct<source: string, tier: string>, coverage_config string"
)


def read_prelabels(spark: SparkSession, root: str, version: str, frame: str = "global") -> DataFrame:
    """The prelabels of all scenes under a folder: of the version, whole, of one frame, each token once."""
    c = F.col
    rules = {
        "required fields": c("token").isNotNull() & c("sample_token").isNotNull() & c("category").isNotNull(),
        "frame": c("frame") == frame,
        "vector lengths": (F.size("translation_m") == 3) & (F.size("size_wlh_m") == 3) & (F.size("rotation_wxyz") == 4),
    }
    return read_records(spark, f"{root}/scenes/*/prelabels.jsonl", PRELABEL, version, rules, ["token"])


def read_human(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Human rows, each verified by someone, and which samples which pass covers."""
    rows = read_records(spark, f"{folder}/verified.jsonl", PRELABEL + ", verified_by string, verification_pass string", rules={"verified_by": F.coalesce(F.col("verified_by"), F.lit("")) != ""}, unique=["token"])
    coverage = spark.read.schema("sample_token string, pass string").json(f"{folder}/coverage.jsonl").distinct()
    return rows, coverage
