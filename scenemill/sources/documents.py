"""Documents of other tools and releases: metadata tables, COCO, 3D annotation exports, priors, logs and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Files

#: The metadata tables of a data root and their columns.
TABLES = {
    "scene": "token string, name string, nbr_samples int, first_sample_token string, last_sample_token string, log_token string, description string",
    "sample": "token string, timestamp bigint, prev string, next string, scene_token string",
    "sample_data": "token string, sample_token string, ego_pose_token string, calibrated_sensor_token string, timestamp bigint, fileformat string, is_key_frame boolean, filename string, height int, width int, prev string, next string",
    "ego_pose": "token string, timestamp bigint, translation array<double>, rotation array<double>",
    "calibrated_sensor": "token string, sensor_token string, translation array<double>, rotation array<double>, camera_intrinsic array<array<double>>",
    "sensor": "token string, channel string, modality string",
    "instance": "token string, category_token string, nbr_annotations int, first_annotation_token string, last_annotation_token string",
    "category": "token string, name string, description string",
    "attribute": "token string, name string, description string",
    "visibility": "token string, level string, description string",
    "log": "token string, logfile string, vehicle string, date_captured string, location string",
    "map": "token string, category string, filename string, log_tokens array<string>",
    "sample_annotation": "token string, sample_token string, instance_token string, visibility_token string, attribute_tokens array<string>, translation array<double>, size array<double>, rotation array<double>, prev string, next string, num_lidar_pts int, num_radar_pts int",
}


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The metadata tables, each a JSON array of objects; one that is missing is empty."""
    files = Files(spark)
    found = {}
    for name, schema in TABLES.items():
        path = f"{folder}/{name}.json"
        found[name] = spark.read.schema(schema).json(path, multiLine=True) if files.exists(path) else spark.createDataFrame([], schema)
    return found


def channels(tables: dict[str, DataFrame]) -> DataFrame:
    """sample_data with channel and modality, two lookups away."""
    sensor = tables["sensor"].select(F.col("token").alias("sensor_token"), "channel", "modality")
    rig = tables["calibrated_sensor"].select(F.col("token").alias("calibrated_sensor_token"), "sensor_token").join(sensor, "sensor_token")
    return tables["sample_data"].join(rig, "calibrated_sensor_token", "left")


def scene_samples(tables: dict[str, DataFrame], most: int = 100_000) -> DataFrame:
    """scene_token, token and place of the samples that a scene's pointers lead to.

    Samples are put in order by time, which the pointers must follow; what lies behind the first one whose
    ``next`` isn't the following sample is not reached.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("scene_token").orderBy("timestamp", "token")
    first = tables["scene"].select(F.col("token").alias("scene_token"), "first_sample_token")
    rows = tables["sample"].join(first, "scene_token")
    rows = rows.withColumn("follows", F.lag("next").over(order).eqNullSafe(F.col("token"))).withColumn("is_first", F.col("token") == F.col("first_sample_token"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("started", F.max(F.col("is_first").cast("int")).over(upto)).where("started = 1")
    rows = rows.withColumn("broken", F.sum(F.when(~F.col("is_first") & ~F.col("follows"), 1).otherwise(0)).over(upto)).where("broken = 0")
    return rows.select("scene_token", "token", (F.row_number().over(order) - 1).alias("place")).where(F.col("place") < most)


def write_release(spark: SparkSession, tables: dict[str, DataFrame], folder: str, meta: dict) -> dict[str, int]:
    """The tables as JSON arrays sorted by token, and release_meta.json with their counts and hashes, written last."""
    files, counts, hashes = Files(spark), {}, {}
    for name, rows in tables.items():
        # metadata tables are small beside the points; each is one document by the format's rule
        lines = rows.orderBy(rows.columns[0]).toJSON().toLocalIterator()
        text = "[\n" + ",\n".join(lines) + "\n]\n"
        files.write(f"{folder}/{name}.json", text)
        counts[name], hashes[name] = rows.count(), files.sha256(f"{folder}/{name}.json")
    files.write_json(f"{folder}/release_meta.json", {**meta, "counts": counts, "sha256": hashes})
    return counts


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """A hash of all metadata that no order of rows changes."""
    parts = []
    for name in sorted(tables):
        rows = tables[name]
        hashed = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)"))).first()
        parts.append(f"{name}:{n}:{total}")
    import hashlib

    return hashlib.sha256("|".join(parts).encode()).hexdigest()


# ---- COCO ----
COCO = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, categories array<struct<id: bigint, name: string>>,"
    " annotations array<struct<id: bigint, image_id: bigint, category_id: bigint, bbox: array<double>, segmentation: array<array<double>>, attributes: struct<score: double, suppressed: boolean>>>"
)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """A row an annotation: document, image, file_name, category, bbox (x, y, w, h), segmentation, score, suppressed."""
    docs = spark.read.schema(COCO).json(path, multiLine=True).withColumn("document", F.input_file_name())
    images = docs.select("document", F.explode("images").alias("i")).select("document", F.col("i.id").alias("image_id"), "i.file_name")
    names = docs.select("document", F.explode("categories").alias("c")).select("document", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    rows = docs.select("document", F.explode("annotations").alias("a")).select("document", "a.id", "a.image_id", "a.category_id", "a.bbox", "a.segmentation", "a.attributes.score", "a.attributes.suppressed")
    return rows.join(images, ["document", "image_id"]).join(names, ["document", "category_id"], "left").drop("category_id")


def write_coco(annotations: DataFrame, path: str) -> None:
    """One COCO document a document: file_name, category, bbox and score become images, categories and annotations.

    A column ``segmentation`` (polygons of x1, y1, x2, ...) goes into the annotations if there is one. Numbers are by name, from 1 on, so equal rows give equal documents. Each document is a file of its own.
    """
    outline = [c for c in annotations.columns if c == "segmentation"]
    rows = annotations.select("document", "file_name", "category", "bbox", "score", *outline)
    packed = rows.groupBy("document").agg(F.array_sort(F.collect_set("file_name")).alias("f"), F.array_sort(F.collect_set("category")).alias("c"), F.sort_array(F.collect_list(F.struct("file_name", "category", "bbox", "score", *outline))).alias("a"))
    images = F.transform("f", lambda n, i: F.struct((i + 1).cast("long").alias("id"), n.alias("file_name")))
    names = F.transform("c", lambda n, i: F.struct((i + 1).cast("long").alias("id"), n.alias("name")))
    marks = F.transform("a", lambda a, i: F.struct((i + 1).cast("long").alias("id"), F.array_position("f", a["file_name"]).alias("image_id"), F.array_position("c", a["category"]).alias("category_id"), a["bbox"].alias("bbox"), *(a[c].alias(c) for c in outline), F.struct(a["score"].alias("score")).alias("attributes")))
    packed.select("document", images.alias("images"), names.alias("categories"), marks.alias("annotations")).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


# ---- 3D annotation documents ----
CUBOIDS = (
    "categories struct<label: struct<labels: array<struct<name: string>>>>, items array<struct<id: string, attr: struct<frame: int>,"
    " annotations: array<struct<id: bigint, type: string, label_id: int, position: array<double>, rotation: array<double>, scale: array<double>, attributes: map<string, string>>>>>"
)


def read_cuboids(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """Boxes of 3D annotation documents: sample_token, frame, label, translation, size (w, l, h), yaw, record_token, track_id, attribute.

    An item's frame is found by its file's name, then by its number; one that matches neither, a label outside
    the categories, or a cuboid that isn't 3 + 3 + 3 numbers raises.
    """
    docs = spark.read.schema(CUBOIDS).json(path, multiLine=True)
    items = docs.select(F.col("categories.label.labels.name").alias("labels"), F.explode("items").alias("i")).select("labels", "i.*")
    items = items.withColumn("name", F.regexp_replace(F.regexp_replace("id", r"^.*/", ""), r"\.[^.]*$", ""))
    by_name = frames.select("name", F.struct("sample_token", "frame").alias("named"))
    by_frame = frames.select(F.col("frame").alias("number"), F.struct("sample_token", "frame").alias("counted"))
    rows = items.join(by_name, "name", "left").join(by_frame, F.col("attr.frame") == F.col("number"), "left")
    at = F.coalesce("named", "counted")
    rows = rows.withColumn("at", F.when(at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit("no frame for item "), "id")).cast(rows.schema["named"].dataType)))
    boxes = rows.select("at", "labels", F.explode("annotations").alias("a")).where("a.type = 'cuboid_3d'")
    ok = (F.size("a.position") == 3) & (F.size("a.rotation") == 3) & (F.size("a.scale") == 3) & F.col("a.label_id").between(0, F.size("labels") - 1)
    boxes = boxes.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("cuboid "), F.col("a.id").cast("string"), F.lit(" is wrong"))).cast("boolean")))
    s, blank = F.col("a.scale"), lambda n: F.nullif(F.col("a.attributes")[n], F.lit(""))
    return boxes.select("at.sample_token", "at.frame", F.col("labels")[F.col("a.label_id")].alias("label"), F.col("a.position").alias("translation"), F.array(s[1], s[0], s[2]).alias("size"), F.col("a.rotation")[2].alias("yaw"), blank("record_token").alias("record_token"), blank("track_id").alias("track_id"), blank("attribute").alias("attribute"))


def cuboid_documents(boxes: DataFrame, key: str = "scene") -> DataFrame:
    """A document a scene, of boxes with name (of the frame's file), frame, label, translation, size, yaw and record_token."""
    labels = boxes.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    mark = F.struct(F.lit("cuboid_3d").alias("type"), (F.array_position("labels", F.col("label")) - 1).cast("int").alias("label_id"), F.col("translation").alias("position"), F.array(F.lit(0.0), F.lit(0.0), F.col("yaw")).alias("rotation"), F.array(F.col("size")[1], F.col("size")[0], F.col("size")[2]).alias("scale"), F.create_map(F.lit("record_token"), F.coalesce("record_token", F.lit(""))).alias("attributes"))
    items = boxes.join(labels, key).withColumn("mark", mark).groupBy(key, "labels", "name", "frame").agg(F.collect_list("mark").alias("annotations"))
    item = F.struct("frame", F.col("name").alias("id"), F.struct("frame").alias("attr"), "annotations")
    packed = items.groupBy(key, "labels").agg(F.collect_list(item).alias("items"))
    in_order = F.transform(F.array_sort("items", lambda a, b: a["frame"] - b["frame"]), lambda i: F.struct(i["id"].alias("id"), i["attr"].alias("attr"), i["annotations"].alias("annotations")))
    named = F.struct(F.struct(F.transform("labels", lambda n: F.struct(n.alias("name"))).alias("labels")).alias("label"))
    return packed.select(key, named.alias("categories"), in_order.alias("items"))


# ---- priors, metrics, logs ----
def read_priors(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """category, n, and mean and deviation of w, l, h of a priors document; priors of too few instances or without extent raise."""
    side = "struct<mu: double, sigma: double>"
    schema = T.MapType(T.StringType(), T.StructType.fromDDL(f"n_instances int, dims struct<w: {side}, l: {side}, h: {side}>"))
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("category", "p"))
    rows = text.select("category", F.col("p.n_instances").alias("n"), *(F.col(f"p.dims.{d}.{s}").alias(f"{s}_{d}") for d in "wlh" for s in ("mu", "sigma")))
    ok = reduce(lambda a, b: a & b, [F.col(f"mu_{d}") > 0 for d in "wlh"] + [F.col(f"sigma_{d}") >= 0 for d in "wlh"]) & (F.col("n") >= least)
    return rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("no usable prior for "), "category")).cast("boolean")))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """run (the folder's name), metric (dotted path) and value of all numbers in runs' metric documents, to any depth of objects."""
    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run"), F.try_parse_json("value").alias("v"))
    docs.createOrReplaceTempView("__metrics")
    level = spark.sql("SELECT run, e.key AS metric, e.value AS v FROM __metrics, LATERAL variant_explode(v) e")
    found = []
    for _ in range(8):  # documents are nested a few levels deep; what lies deeper is no metric
        kind = F.schema_of_variant("v")
        found.append(level.where(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")).select("run", "metric", F.try_variant_get("v", "$", "double").alias("value")))
        level.where(kind.startswith("OBJECT")).createOrReplaceTempView("__level")
        level = spark.sql("SELECT run, concat(metric, '.', e.key) AS metric, e.value AS v FROM __level, LATERAL variant_explode(v) e")
    return reduce(DataFrame.unionByName, found)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """A row an epoch of a training log (CSV), names trimmed, numbers as doubles."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.select(*(F.col(f"`{c}`").try_cast("double").alias(c.strip().replace("/", "_")) for c in rows.columns))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key (dotted) and value of a configuration file of "key: value" lines, nested by indentation of two spaces."""
    from pyspark.sql import Window

    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"\s+#.*$|^\s*#.*$", "")).where(F.trim("line") != "")
    rows = rows.withColumn("depth", (F.length(F.regexp_extract("line", r"^( *)", 1)) / 2).cast("int")).withColumn("key", F.trim(F.regexp_extract("line", r"^\s*([^:]+):", 1))).withColumn("value", F.trim(F.regexp_extract("line", r":\s*(.*)$", 1)))
    order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one file's lines
    parts = [F.when(F.col("depth") >= k, F.last(F.when(F.col("depth") == k, F.col("key")), ignorenulls=True).over(order)) for k in range(6)]
    rows = rows.withColumn("path", F.concat_ws(".", *parts))
    return rows.where("value <> ''").select(F.col("path").alias("key"), F.regexp_replace("value", r"^(['\"])(.*)\1$", "$2").alias("value"))


def delivery_note(title: str, sections: dict[str, DataFrame]) -> str:
    """A note in Markdown: a table a section, of aggregates that are small by nature (a row a class or tier)."""
    out = [f"# {title}", ""]
    for name, rows in sections.items():
        out += [f"## {name}", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.orderBy(*rows.columns).collect()]
        out.append("")
    return "\n".join(out)
