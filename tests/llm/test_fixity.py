"""Fixity of tables with null and repeated keys, against trees built one by one."""

import hashlib

from pyspark.sql import functions as F

from scenemill.llm import queries, warc_fixity

SCHEMA = "page_id long, url string, html string"


def root_of(records):
    """The root over (length, hash) in order of place."""
    level, at = [], 0
    for length, digest in records:
        level.append((at, at + length, digest))
        at += length
    first = True
    while first or len(level) > 1:
        groups = [level[i : i + 16] for i in range(0, len(level), 16)]
        level = [(g[0][0], g[-1][1], hashlib.sha256("\n".join(f"{a} {b} {h}" for a, b, h in g).encode()).hexdigest()) for g in groups]
        first = False
    return level[0][2]


def test_null_and_repeated_keys_keep_all_records(spark, tmp_path):
    hot = next(k for k in range(256, 512) if int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 50 == 0)
    rows = [(None, f"n{k}", f"body {k}" if k % 3 else None) for k in range(400)] + [(k, f"u{k}", "b" * k) for k in range(256)] + [(hot, f"h{k}", f"text {k}") for k in range(600)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op4_warc_fixity(spark, str(tmp_path)).collect()
    key = lambda k: (k is None, k or 0)
    assert sorted((r.page_id for r in got), key=key) == sorted((r[0] for r in rows), key=key)
    assert all(r.file is not None and r.root for r in got)
    files = {}
    for r in got:
        files.setdefault(r.file, []).append(r)
    assert sorted(len(f) for f in files.values()) == [88, 144, 256, 256, 256, 256]
    for found in files.values():
        found.sort(key=lambda r: r.place)
        assert [r.place for r in found] == list(range(len(found)))
        assert found[0].start == 0 and all(a.end == b.start for a, b in zip(found, found[1:]))
        assert {r.root for r in found} == {root_of([(r.end - r.start, r.sha256) for r in found])}
    # of all records only those decay whose key says so, each found for itself
    assert {r.page_id for r in got if not r.intact} - {hot} == {k for k in range(256) if int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 50 == 0}
    assert sum(not r.intact for r in got if r.page_id == hot) == 600 and all(r.intact for r in got if r.page_id is None)


def test_audit_finds_the_fault_of_a_record_without_a_key(spark):
    pages = spark.createDataFrame([(None if k % 3 == 0 else k, f"u{k}", f"body {k}") for k in range(1000)], SCHEMA)
    bad = pages.withColumn("html", F.when(F.col("url").isin("u300", "u301"), F.translate("html", "body", "gone")).otherwise(F.col("html")))
    hashed = lambda d: warc_fixity.hashed_records(d, F.col("page_id"), F.floor(F.col("page_id") / 256), F.col("url"), F.col("html"))
    found = warc_fixity.audit(hashed(pages), hashed(bad)).collect()
    assert sorted((r.file is None, r.fault) for r in found) == [(False, "changed"), (True, "changed")]
    assert warc_fixity.audit(hashed(pages), hashed(pages)).isEmpty()


def test_empty_table_has_no_files(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op4_warc_fixity(spark, str(tmp_path)).count() == 0
