"""Points that project onto an image's edge, or whose results lie next to a rounding, against the queries' SQL on DuckDB."""

import math
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from scenemill.functions import geometry as G
from scenemill.plans import inputs
from scenemill.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events whose points lie on, or within rounding of, the edges of the first nation's image, for users of all remainders."""
    out = tmp_path_factory.mktemp("edges")
    shutil.copy("/root/testdata/sf0.001/nation.parquet", out)
    values = [15.5, 132.5, *(round(rest + 13 * k, 2) for rest in (1.3, 2.7) for k in range(40))]
    rows = [(35 * i + user, user, "view", value) for i, value in enumerate(values) for user in range(35)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{out}/events.parquet")
    return str(out)


def on_edges(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{folder}/nation.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_projected_points_on_an_edge(spark, folder):
    on_edges(spark, folder, "project_points")


def test_contested_points_on_an_edge(spark, folder):
    on_edges(spark, folder, "point_contest")


@pytest.mark.parametrize("users", [[81919], [45_035_996_273_704_961, 123_456_789_012_345_678, 2**63 - 1]])
def test_contest_wherever_users_stand(spark, tmp_path, users):
    """Users at whose place half a metre more would be rounded."""
    shutil.copy("/root/testdata/sf0.001/nation.parquet", tmp_path)
    rows = [(i * 10 + j, user, "view", value / 100) for i, value in enumerate((5474, 9162, 17174, 20862, 30709, 42409, *range(0, 3000, 37))) for j, user in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    on_edges(spark, tmp_path, "point_contest")


def test_rounded_as_duckdb_rounds(spark):
    halves = [(k + 0.5) * 1e-9 for k in range(545_631_564 - 500, 545_631_564 + 500)]
    values = [x for h in halves for x in (math.nextafter(math.nextafter(h, 0), 0), math.nextafter(h, 0), h, math.nextafter(h, 1))]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", inputs.rounded(F.col("x"), 9).alias("y")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(x,) for x in values])
    assert sorted(map(tuple, got)) == con.execute("SELECT x, round(x, 9) FROM t ORDER BY x").fetchall()


def test_cameras_by_quaternion_and_matrix(spark):
    """Both give what the hops one by one give, for rotations about all axes."""
    vec, quat = "struct<x: double, y: double, z: double>", "struct<w: double, x: double, y: double, z: double>"
    pose = f"struct<t: {vec}, q: {quat}>"
    row = (((900.0, -40.0, 2.0), (0.9, 0.1, -0.2, 0.4)), ((900.7, -39.6, 2.1), (0.8, 0.1, -0.1, 0.5)), ((1.5, 0.3, 1.2), (0.5, -0.5, 0.4, -0.6)), (12.0, -3.0, 0.7))
    frame = spark.createDataFrame([row], f"scan {pose}, image {pose}, turned {pose}, p {vec}")
    given = F.struct(F.col("turned.t").alias("t"), G.rotation_matrix(F.col("turned.q")).alias("r"))
    c = F.col
    by_quaternion = G.with_camera_matrix(frame, "scan", "image", "turned").select(G.moved(c("matrix"), c("p")).struct).first()[0]
    by_matrix = G.with_camera_matrix(frame.withColumn("given", given), "scan", "image", "given").select(G.moved(c("matrix"), c("p")).struct).first()[0]
    hops = frame.withColumn("p", G.transform(c("scan"), c("p")).struct).withColumn("p", G.inverse_transform(c("image"), c("p")).struct)
    want = hops.select(G.inverse_transform(c("turned"), c("p")).struct).first()[0]
    assert tuple(by_quaternion) == pytest.approx(tuple(want), abs=1e-9)
    assert tuple(by_matrix) == pytest.approx(tuple(want), abs=1e-9)
