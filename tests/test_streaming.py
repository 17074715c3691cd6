from datetime import timedelta

from pyspark.sql import functions as F

from helpers import DAY0, table, tag
from tagloom.plans.shared import fresh_path
from tagloom.schema import CHANGES
from tagloom.sources import remote
from tagloom.streaming import changes, live


def change(seq, op, tid, txt="x", entry=None):
    return (seq, op, entry, tid, txt, f"ref{tid}", ["t"], DAY0 + timedelta(seconds=seq), "k", None, None)


def write(spark, path, *rows):
    spark.createDataFrame(list(rows), CHANGES).coalesce(1).write.mode("append").parquet(path)


def state(df):
    return sorted((r["tid"], r["txt"]) for r in df.collect())


def test_changes_over_several_batches(spark):
    source, root, checkpoint = (fresh_path(spark, n) for n in ("src", "root", "cp"))
    base = table(spark, tag(1, "a", "old"), tag(2, "b", "old"), tag(9, "z", "old"))

    def run():
        stream = spark.readStream.schema(CHANGES).parquet(source)
        changes.write_changes(stream, root, checkpoint).awaitTermination()

    write(spark, source, change(1, "INSERT", 3, "new"), change(2, "UPDATE", 1, "u1"), change(3, "DELETE", 2))
    run()
    assert state(changes.current_table(base, root)) == [(1, "u1"), (3, "new"), (9, "old")]
    write(spark, source, change(4, "DELETE", 3), change(5, "INSERT", 2, "back"), change(6, "UPDATE", 1, "u2"),
          *[change(10 + i, "UPDATE", 7, f"hot{i:03}") for i in range(200)])
    run()
    want = [(1, "u2"), (2, "back"), (7, "hot199"), (9, "old")]
    assert state(changes.current_table(base, root)) == want
    run()  # nothing new
    assert state(changes.current_table(base, root)) == want
    compacted, position = changes.compact(base, root, fresh_path(spark, "compact"))
    assert state(compacted) == want and position == 209
    assert state(changes.current_table(compacted, root)) == want
    write(spark, source, change(300, "DELETE", 7))
    run()
    assert state(changes.current_table(compacted, root, position)) == [w for w in want if w[0] != 7]
    # Another stream on the same folder keeps its batches to itself.
    again = spark.readStream.schema(CHANGES).parquet(source)
    changes.write_changes(again, root, fresh_path(spark, "other")).awaitTermination()
    assert state(changes.current_table(base, root)) == [w for w in want if w[0] != 7]


def test_changes_meet_by_entry_and_by_tid(spark):
    start = table(spark).withColumn("entry_id", F.concat(F.lit("e"), F.col("tid").cast("string")))
    gone = spark.createDataFrame([change(1, "DELETE", None, "", "e1")], CHANGES)
    assert 1 not in [r["tid"] for r in changes.apply_changes(start, gone).collect()]
    both = spark.createDataFrame(
        [change(1, "INSERT", 50, "a", "x"), change(2, "UPDATE", None, "b", "x"), change(3, "INSERT", 51, "c", "y"),
         change(4, "DELETE", None, "", "y"), change(5, "INSERT", None, "d", "z")], CHANGES)
    got = {(r["tid"], r["txt"]) for r in changes.apply_changes(table(spark), both).collect()} - {tuple(r) for r in table(spark).select("tid", "txt").collect()}
    assert got == {(50, "b"), (None, "d")}


def test_rows_without_tid_go_by_entry(spark):
    rows = spark.createDataFrame(
        [change(1, "INSERT", None, "e1", "a"), change(2, "INSERT", None, "e2", "b"), change(3, "DELETE", None, "", "a")],
        CHANGES)
    start = table(spark).withColumn("entry_id", F.lit(None).cast("string"))
    got = changes.apply_changes(start, rows).collect()
    assert [(r["entry_id"], r["txt"]) for r in got] == [("b", "e2")]


def test_bootstrap_equals_full_replay(spark):
    rows = [change(i, ["INSERT", "UPDATE", "DELETE"][i * i % 3], i % 5, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, CHANGES)
    full = state(changes.apply_changes(table(spark), df))
    for mark in (0, 13, 39):
        loaded = changes.apply_changes(table(spark), df.where(F.col("seq") <= mark))
        assert state(changes.bootstrap(loaded, df, mark)) == full


def test_running_state(spark):
    source = fresh_path(spark, "src")
    write(spark, source, change(1, "INSERT", 1, "a"), change(2, "UPDATE", 1, "b"), change(3, "INSERT", 2, "c"))
    stream = spark.readStream.schema(CHANGES).parquet(source)
    query = (changes.latest_by_key_stream(stream).writeStream.format("memory").queryName("latest")
             .outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    assert state(spark.table("latest")) == [(1, "b"), (2, "c")]


def test_live_query_follows_the_table(spark):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("src", "live", "cp"))

    def search():
        return spark.read.schema(CHANGES).parquet(source).select("tid", "txt").orderBy(F.desc("tid")).limit(2)

    def run():
        live.live_query(spark.readStream.schema(CHANGES).parquet(source), search, target, checkpoint).awaitTermination()
        results = spark.read.schema("tid bigint, txt string, result long").parquet(target)
        return state(results.where(F.col("result") == results.select(F.max("result")).scalar()))

    write(spark, source, change(1, "INSERT", 1, "a"), change(2, "INSERT", 2, "b"))
    assert run() == [(1, "a"), (2, "b")]
    write(spark, source, change(3, "INSERT", 3, "c"))
    assert run() == [(2, "b"), (3, "c")]


def test_live_query_is_maintained(spark):
    """The table is read at the start, and when deletions have used up the reserve."""
    source, target, checkpoint = (fresh_path(spark, n) for n in ("src", "live", "cp"))
    content, scans = {i: f"hit {i}" if i % 2 else "other" for i in range(1, 41)}, []

    def load():
        scans.append(1)
        return spark.createDataFrame(sorted(content.items()), "tid bigint, txt string")

    def search(rows):
        return rows.where(F.startswith("txt", F.lit("hit"))).select("tid", "txt")

    seq = iter(range(1, 10_000))

    def run(*rows):
        for op, tid, txt in rows:
            if op == "DELETE":
                content.pop(tid, None)
            else:
                content[tid] = txt
        write(spark, source, *[change(next(seq), op, tid, txt) for op, tid, txt in rows])
        stream = spark.readStream.schema(CHANGES).parquet(source)
        live.live_query(stream, search, target, checkpoint, load, limit=4, reserve=3).awaitTermination()
        found = spark.createDataFrame([], "tid bigint, txt string").schema
        got = state(live.maintained_result(spark, target, found, 4))
        want = sorted(((i, t) for i, t in content.items() if t.startswith("hit")), reverse=True)[:4]
        assert got == sorted(want)

    run(("INSERT", 41, "hit 41"))
    assert len(scans) == 1
    run(("UPDATE", 39, "no more"), ("INSERT", 50, "hit 50"), ("UPDATE", 50, "hit again"), ("INSERT", 3, "hit old"))
    run(("DELETE", 50, ""), ("DELETE", 41, ""), ("UPDATE", 38, "hit 38"))
    run(("INSERT", 60, "other"), ("UPDATE", 36, "hit 36"))
    assert len(scans) == 1
    run(*[("DELETE", i, "") for i in (38, 37, 36, 35, 33, 31)])
    assert len(scans) == 2
    run(*[("DELETE", i, "") for i in range(1, 41)])
    run(("INSERT", 5, "hit 5"))
    run(("DELETE", 5, ""), ("INSERT", 6, "hit 6"))
    assert len(scans) == 3


def test_levels_of_the_change_log(spark, monkeypatch):
    """Entries fold into levels; a read from a position opens no older files."""
    monkeypatch.setattr(changes, "FAN", 3)
    source, root, checkpoint = (fresh_path(spark, n) for n in ("src", "root", "cp"))
    base, every = table(spark, tag(1, "a", "old"), tag(50, "z", "old")), []
    for turn in range(10):
        rows = [change(10 * turn + k, ["INSERT", "UPDATE", "DELETE"][(turn + k) % 3], (turn * k) % 7, f"v{turn}.{k}") for k in range(6)]
        every += rows
        write(spark, source, *rows)
        changes.write_changes(spark.readStream.schema(CHANGES).parquet(source), root, checkpoint).awaitTermination()
        if turn not in (2, 3, 9):
            continue
        whole = spark.createDataFrame(every, CHANGES)
        assert state(changes.current_table(base, root)) == state(changes.apply_changes(base, whole))
        entries = changes.log_entries(spark, root)
        assert len(entries) <= 2 * (1 + max(e["level"] for e in entries))
    assert max(e["level"] for e in changes.log_entries(spark, root)) == 2
    for mark in (0, 45, 200):
        loaded = changes.apply_changes(base, whole.where(F.col("seq") <= mark))
        assert state(changes.current_table(loaded, root, mark)) == state(changes.apply_changes(base, whole))
        opened = changes.stored_changes(spark, root, mark).inputFiles()
        older = [e["path"] for e in changes.log_entries(spark, root) if e["last"] <= mark]
        assert not any(p.split("/changes/")[1] in f for p in older for f in opened)
    assert changes.stored_changes(spark, root, 200).inputFiles() == []


def test_hand_over_with_overlap(spark):
    """A base taken at a position, and a log whose batches lie before, across and after it."""
    root, base = fresh_path(spark, "root"), table(spark, tag(1, "a", "old"), tag(2, "b", "old"))
    rows = [change(i, ["INSERT", "UPDATE", "DELETE"][i * i % 3], i % 5, f"v{i}") for i in range(60)]
    for first, last in ((0, 30), (20, 45), (40, 60)):  # the streams overlap
        source = fresh_path(spark, "src")
        write(spark, source, *rows[first:last])
        changes.write_changes(spark.readStream.schema(CHANGES).parquet(source), root, fresh_path(spark, "cp")).awaitTermination()
    full = state(changes.apply_changes(base, spark.createDataFrame(rows, CHANGES)))
    for mark in (-1, 10, 25, 42, 59):
        loaded = changes.apply_changes(base, spark.createDataFrame(rows[:mark + 1], CHANGES)) if mark >= 0 else base
        assert state(changes.current_table(loaded, root, mark)) == full


def test_pull_above_the_mark(spark):
    tags = table(spark, *[tag(i, f"r{i}", dt=DAY0 + timedelta(days=i)) for i in range(5)], tag(9, "n", dt=None))
    mark = live.high_water_mark(tags.where("tid < 3"))
    assert sorted(r["tid"] for r in live.incremental_pull(tags, mark).collect()) == [3, 4]
    assert live.incremental_pull(tags, None).count() == 6


def test_bursts_as_a_stream(spark):
    source = fresh_path(spark, "src")
    rows = [("a", 0, 1), ("a", 300, 2), ("a", 900, 3), ("b", 100, 4), ("flush", 600_000, 5), ("flush", 900_000, 6)]
    (spark.createDataFrame(rows, "key string, ms int, id int")
     .select("key", F.timestamp_millis("ms").alias("ts"), "id", F.col("id").cast("double").alias("value"))
     .coalesce(1).write.parquet(source))
    stream = spark.readStream.schema("key string, ts timestamp, id int, value double").parquet(source)
    query = (live.debounce_stream(stream, "400 milliseconds", "1 second").writeStream.format("memory")
             .queryName("bursts").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.table("bursts").collect() if r["key"] != "flush") == [2, 3, 4]


def test_upload_queue(spark):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("src", "up", "cp"))
    for turn in range(2):
        write(spark, source, change(turn, "INSERT", turn + 1, f"t{turn}"))
        stream = spark.readStream.schema(CHANGES).parquet(source)
        live.upload_queue(stream, lambda df: remote.push_rows(df, "u"), target, checkpoint).awaitTermination()
    assert state(spark.read.schema("tid bigint, txt string").parquet(target)) == [(1, "t0"), (2, "t1")]
