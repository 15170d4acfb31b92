"""Point clouds, masks and label files: binary formats by whole file, in Arrow batches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

#: Fixed layout of a sweep: five floats a point.
FIELDS = ("x", "y", "z", "intensity", "ring")
#: Where a keyframe's points come from, best first.
GROUND_FILTERED, ARCHIVED, RAW, UNAVAILABLE = "ground_filtered", "ground_filtered_archive", "single_sweep_raw", "unavailable"
_POINTS = "file string, point_index int, x float, y float, z float, intensity float, ring float, error string"


def floats_of(data: bytes) -> np.ndarray:
    """Points of a raw sweep, rows of FIELDS."""
    if len(data) % 20:
        raise ValueError(f"{len(data)} bytes aren't rows of five floats")
    return np.frombuffer(data, "<f4").reshape(-1, 5)


def pcd_of(data: bytes) -> np.ndarray:
    """Points of a binary PCD v0.7 file, its fields by name in the order of FIELDS; missing ones are 0."""
    head, found, body = data.partition(b"DATA binary\n")
    if not found:
        raise ValueError("not a binary PCD file")
    told = dict(line.split(" ", 1) for line in head.decode("ascii", "replace").splitlines() if " " in line and not line.startswith("#"))
    names, sizes, kinds = (told[k].split() for k in ("FIELDS", "SIZE", "TYPE"))
    counts = told.get("COUNT", " ".join("1" for _ in names)).split()
    kind = np.dtype([(n, f"<{ {'F': 'f', 'I': 'i', 'U': 'u'}[t]}{s}", (int(c),) if int(c) > 1 else ()) for n, s, t, c in zip(names, sizes, kinds, counts)])
    n = int(told["POINTS"])
    if len(body) < n * kind.itemsize:
        raise ValueError(f"{len(body)} bytes for {n} points")
    rows = np.frombuffer(body, kind, n)
    return np.column_stack([rows[f].astype("f4") if f in kind.names else np.zeros(n, "f4") for f in FIELDS])


def pcd_bytes(points: np.ndarray) -> bytes:
    """A binary PCD v0.7 file of rows of FIELDS."""
    n = len(points)
    k = len(FIELDS)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(FIELDS)}\nSIZE {' '.join('4' * k)}\nTYPE {' '.join('F' * k)}\nCOUNT {' '.join('1' * k)}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + np.ascontiguousarray(points, "<f4").tobytes()


def cloud_of(name: str, data: bytes) -> np.ndarray:
    return pcd_of(data) if name.endswith(".pcd") else floats_of(data)


def _point_rows(named: Iterator[tuple[str, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for name, data in named:
        try:
            p, error = cloud_of(name, data), None
        except (ValueError, KeyError) as e:
            p, error = np.zeros((1, 5), "f4"), f"{type(e).__name__}: {e}"
        if not len(p):
            continue
        columns = [pa.array([name] * len(p)), pa.array(np.arange(len(p)), pa.int32()), *(pa.array(p[:, k], mask=np.full(len(p), error is not None)) for k in range(5)), pa.array([error] * len(p), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """file, point_index, x, y, z, intensity, ring of every point of raw sweeps (.bin) and PCD files; a broken file is one row with an error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    schema = to_arrow_schema(T.StructType.fromDDL(_POINTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                yield from _point_rows([(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _POINTS)


def read_archived_clouds(spark: SparkSession, path: str) -> DataFrame:
    """The same of the PCD files within zip archives; ``file`` is archive!member."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    schema = to_arrow_schema(T.StructType.fromDDL(_POINTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                with zipfile.ZipFile(io.BytesIO(batch.column(1)[k].as_py())) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(".pcd")):
                        yield from _point_rows([(f"{batch.column(0)[k].as_py()}!{member}", z.read(member))], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _POINTS)


def best_clouds(keyframes: DataFrame, filtered: DataFrame, archived: DataFrame, raw: DataFrame, key: str = "sample_token") -> DataFrame:
    """Which file a keyframe's points are read from, and on what basis: the first of three sources that has one."""
    out = keyframes.select(key).distinct()
    for name, files in (("a", filtered), ("b", archived), ("c", raw)):
        out = out.join(files.groupBy(key).agg(F.min("file").alias(name)), key, "left")
    basis = F.when(F.col("a").isNotNull(), GROUND_FILTERED).when(F.col("b").isNotNull(), ARCHIVED).when(F.col("c").isNotNull(), RAW).otherwise(UNAVAILABLE)
    return out.select(key, F.coalesce("a", "b", "c").alias("file"), basis.alias("basis"))


def write_clouds(points: DataFrame, keys: list[str], path: str) -> None:
    """Points in folders by key, sorted by number within."""
    points.repartition(*keys).sortWithinPartitions(*keys, "point_index").write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """file, channel, mask, row, col_lo, col_hi: the runs of set pixels of bit-packed mask files (npz)."""
    schema = "file string, channel string, mask int, row int, col_lo int, col_hi int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                with np.load(io.BytesIO(batch.column(1)[k].as_py())) as held:
                    width = int(held["__width_px__"][0])
                    packed = bool(int(held["__bit_packed__"][0]))
                    for channel in sorted(n for n in held.files if not n.startswith("__")):
                        for mask, plane in enumerate(held[channel]):
                            pixels = np.unpackbits(plane, axis=-1, count=width) if packed else plane.astype(np.uint8)
                            rows, lo, hi = runs_of(pixels)
                            n = len(rows)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([channel] * n), *(pa.array(v, pa.int32()) for v in (np.full(n, mask), rows, lo, hi))], ["file", "channel", "mask", "row", "col_lo", "col_hi"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def runs_of(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of set pixels."""
    edge = np.diff(np.pad(pixels.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1] - 1
    return rows, lo, hi


def mask_boxes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The tight box and the pixels of every mask."""
    return runs.groupBy(*keys).agg(F.min("col_lo").alias("x1"), F.min("row").alias("y1"), (F.max("col_hi") + 1).alias("x2"), (F.max("row") + 1).alias("y2"), F.sum(F.col("col_hi") - F.col("col_lo") + 1).alias("n_px"))


def write_labels(points: DataFrame, blob: str, path: str, label: str = "label") -> DataFrame:
    """One file of bytes a blob, the label of every point in order; returns blob, n and sha256 of what was written.

    Tasks write through Hadoop's file system by way of a table of files: a blob's labels are gathered, as a
    sweep has a bound, and the table's rows are the files.
    """
    packed = points.groupBy(blob).agg(F.sort_array(F.collect_list(F.struct("point_index", F.col(label).cast("int").alias("label")))).alias("p"))
    data = F.unhex(F.array_join(F.transform("p", lambda s: F.lpad(F.hex(s["label"]), 2, "0")), ""))
    files = packed.select(blob, F.size("p").alias("n"), data.alias("content"))
    files.write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path).select(blob, "n", F.sha2("content", 256).alias("sha256"))


def exported_labels(spark: SparkSession, path: str, folder: str, blob: str) -> int:
    """The labels of write_labels() as files of their own, <blob>.bin, blob by blob; returns their number."""
    files, n = Files(spark), 0
    for r in spark.read.parquet(path).toLocalIterator():
        fs, p = files._at(f"{folder}/{r[blob]}.bin")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(r["content"]))
        finally:
            stream.close()
        n += 1
    return n
