from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import day, table, tag
from tagloom.plans.shared import fresh_path, shared_dir, through_table
from tagloom.sources import exports, remote, snapshots


@pytest.fixture
def rows(spark):
    return table(spark, *[tag(i, f"r{i}", sts=[f"t{i % 3}"] if i % 2 else None) for i in range(30)])


def test_shared_dir_is_the_clusters(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named.rstrip("/")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_snapshots(spark, rows):
    root = fresh_path(spark, "test-snap")
    assert snapshots.latest_snapshot(snapshots.read_manifest(spark, root)).first()["outcome"] == "none"
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root)
    first = snapshots.write_snapshot(rows, root, datetime(2024, 4, 1)).first()
    assert (first["name"], first["row_count"], first["oversize"]) == ("tags2024-04.30", 30, False)
    assert first["bytes"] > 0
    # the same rows in another order are not written again
    assert snapshots.write_snapshot(rows.orderBy(F.desc("tid")), root, datetime(2024, 4, 2), skip_unchanged=True).count() == 0
    # the same number of rows with other content is
    edited = rows.withColumn("sts", F.coalesce("sts", F.array().cast("array<string>")))
    assert snapshots.write_snapshot(edited, root, datetime(2024, 4, 3), skip_unchanged=True).count() == 1
    snapshots.write_snapshot(rows.limit(3), root, datetime(2024, 4, 4), prefix="misc")
    manifest = snapshots.read_manifest(spark, root)
    assert manifest.count() == 3
    assert snapshots.latest_snapshot(manifest).first()["name"] == "tags2024-04.30"
    assert snapshots.latest_snapshot(manifest, "none-such").first()["outcome"] == "no match"
    assert snapshots.read_snapshot(spark, root).where("sts is null").count() == 0


def test_snapshot_passes_its_rows_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    root = fresh_path(spark, "test-snap")
    row = snapshots.write_snapshot(rows.mapInPandas(count, rows.schema), root, datetime(2024, 4, 1)).first()
    written = snapshots.read_snapshot(spark, root)
    assert seen.value == 30 and row["row_count"] == 30
    assert snapshots.content_hash(written).first()["content_hash"] == row["content_hash"]
    assert row["bytes"] == snapshots.folder_size(spark, row["path"]) > 0
    none = snapshots.write_snapshot(rows.limit(0), root, datetime(2024, 4, 2)).first()
    assert (none["row_count"], none["content_hash"]) == (0, 0)


def test_backups_and_tables(spark, rows):
    root = fresh_path(spark, "test-backup")
    snapshots.backup_rows(rows, root, "before merge", day(1))
    snapshots.backup_rows(rows.limit(2), root, "before merge", day(2))
    got = snapshots.read_backups(spark, root).groupBy("backup_key", "backup_at").count().collect()
    assert sorted(map(tuple, got)) == [("before merge", day(1), 30), ("before merge", day(2), 2)]
    assert through_table(rows, "test").count() == 30


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_formats(spark, rows, fmt):
    path = f"{fresh_path(spark, 'test-fmt')}"
    rows.write.format(fmt).save(path)
    got = remote.read_table(spark, path, fmt, rows.schema)
    assert got.exceptAll(rows).count() == 0 and got.count() == 30


def test_json(spark, rows):
    path = fresh_path(spark, "test-json")
    exports.export_json(rows, path)
    assert exports.read_json(spark, path).exceptAll(rows).count() == 0
    assert exports.json_rows(rows.where("tid = 0")).first()["json"].count("null") == 2
    checked = exports.check_array(spark.createDataFrame([("[1,2]",), ('{"a":1}',)], "body string")).collect()
    assert [(r["items"], r["error"]) for r in checked] == [(2, None), (None, '{"error":"not an array"}')]


def test_remote_round_trip(spark, rows):
    pushed = remote.push_rows(rows, "u")
    assert pushed.where("tid is null").count() == 1  # key 0 counts as missing
    back = remote.map_remote_to_tag(pushed.drop("user_id"))
    assert back.select("ref", "dt", "sts").exceptAll(rows.select("ref", "dt", "sts")).count() == 0
    assert remote.load_remote(rows, pushed.where("tid < 5").drop("user_id", "ats")).count() == 30
