"""Sync rules: categories, merging, key clashes, whole rounds and convergence."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import by, day, table, tag
from tagloom.catalog import views
from tagloom.operators import search, sync
from tagloom.plans import sync_round
from tagloom.plans.shared import fresh_path
from tagloom.plans.sync_round import sync_once, sync_until_settled

SF = "/root/testdata/sf0.01"
CLOCKS = [day(200 + i) for i in range(5)]


def iso(when):
    return when.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def fixture_tables(spark):
    """The survey's base and client tables, which lack rows on either side."""
    docs = views.tags_documents(spark, SF)
    rest = F.col("tid") % 20
    base = docs.where(F.col("tid") % 5 != 4)
    local = docs.where(rest.isin(0, 1, 2, 4, 5, 6, 7)).select(
        "tid", F.when(rest.isin(0, 1), F.concat("txt", F.lit(" local"))).otherwise(F.col("txt")).alias("txt"),
        F.when(rest == 2, F.concat(F.lit("local/"), F.col("tid").cast("string"))).otherwise(F.col("ref")).alias("ref"),
        "sts", F.when(rest == 1, F.col("dt") - F.expr("interval 1 day")).when(
            ~rest.isin(2, 4), F.col("dt")).alias("dt"),
        "type", F.when(rest.isin(0, 1, 2, 4), F.lit(day(100))).alias("modAt"), "rec")
    return base, local


@pytest.mark.parametrize("mark, want", [
    (day(15), {"upd": 50, "toMerge": 50, "blocked": 100, "newer": 329, "unchanged": 371}),
    (day(28), {"upd": 50, "toMerge": 50, "ins": 100, "unchanged": 700}),
    (None, {"upd": 50, "toMerge": 50, "blocked": 100, "newer": 700}),
])
def test_expected_categories(spark, mark, want):
    base, local = fixture_tables(spark)
    got = sync.occ_classify(base, search.dirty_rows(local), mark).groupBy("category").count()
    assert dict(got.collect()) == want


def test_first_insert_into_an_empty_server(spark):
    got = sync.occ_classify(table(spark), table(spark, tag(1, "a", dt=None, dirty=True)), None).collect()
    assert [r["category"] for r in got] == ["ins"]


def test_type_and_ref_do_not_run_together(spark):
    base = table(spark, tag(1, "bc", type="a"))
    mods = table(spark, tag(2, "c", type="ab", dirty=True))
    got = by(sync.occ_classify(base, mods, day(0)), "type", "ref")
    assert got[("ab", "c")]["category"] == "ins" and got[("a", "bc")]["category"] == "unchanged"


def test_duplicate_keys_are_refused(spark):
    with pytest.raises(ValueError, match="not unique"):
        sync.require_unique(table(spark, tag(1, "a"), tag(2, "a")), "server table")


def merged(spark, mine, theirs):
    pair = table(spark, mine).select(sync.tag_struct().alias("m")).crossJoin(
        table(spark, theirs).select(sync.tag_struct().alias("t")))
    return pair.select(sync.merge_row(F.col("m"), F.col("t"), F.lit(day(150))).alias("r")).select("r.*").first()


def origin(txt, sts, when):
    return {"b4mod": {"dt": iso(when), "txt": txt, "sts": sts}}


def test_merge_without_origin_keeps_mine(spark):
    got = merged(spark, tag(1, "A", "local", day(1)), tag(1, "A", "server", day(2), rec=json.dumps({"prev_dt": iso(day(0))})))
    assert (got["txt"], got["dt"], got["modAt"]) == ("local", day(2), None)


def test_merge_with_another_origin_keeps_mine(spark):
    got = merged(spark, tag(1, "A", "local", day(2), rec=json.dumps(origin("base", [], day(0)))),
                 tag(1, "A", "server", day(3), rec=json.dumps({"prev_dt": iso(day(1))})))
    assert (got["txt"], got["dt"]) == ("local", day(3))


def test_merge_with_common_origin(spark):
    mine = tag(1, "mineRef", "hello there", day(2), type="mineType", sts=["a", "c"], rec=json.dumps(
        {**origin("hello", ["a", "b"], day(0)), "score": 5, "note": "local"}))
    theirs = tag(7, "serverRef", "hello world", day(3), type="test", sts=["a", "b", "x"], rec=json.dumps(
        {"prev_dt": iso(day(0)), "score": 3, "note": "server"}))
    got = merged(spark, mine, theirs)
    assert (got["txt"], got["sts"], got["dt"], got["modAt"]) == (
        "hello there world", ["a", "c", "x"], day(3), day(150))
    assert (got["ref"], got["type"]) == ("serverRef", "test")
    rec = json.loads(got["rec"])
    assert (rec["score"], rec["note"], rec["prev_dt"]) == (3, "server", iso(day(0))) and "b4mod" in rec


def reconcile(spark, local, incoming):
    return sorted((r["action"], r["tid"], r["txt"], r["modAt"] is not None)
                  for r in sync.sync_reconcile(table(spark, *local), table(spark, *incoming), day(150)).collect())


def test_reconcile(spark):
    server = tag(99, "S", "server")
    assert reconcile(spark, [], [server]) == [("server", 99, "server", False)]
    # my dirty row with the same unique key is merged, and moves nothing
    assert reconcile(spark, [tag(99, "S", "local", dirty=True)], [server]) == [("merged", 99, "local", True)]
    # another row on the key is moved away and becomes dirty
    assert reconcile(spark, [tag(99, "L", "local")], [server]) == [
        ("moved", None, "local", True), ("server", 99, "server", False)]
    # a clean copy of the same row is just replaced
    assert reconcile(spark, [tag(99, "S", "old")], [server]) == [("server", 99, "server", False)]
    # both: my edited row sits elsewhere, a third row holds the key
    assert reconcile(spark, [tag(5, "S", "mine", dirty=True), tag(99, "L", "other")], [server]) == [
        ("merged", 99, "mine", True), ("moved", None, "other", True)]


def test_bulk_merge(spark):
    live = table(spark, tag(1, "a", "live a"), tag(2, "b", "live b"), tag(3, "c", "live c"))
    incoming = table(spark, tag(1, "a", "new a", dt=day(3)), tag(2, "B", "new b"), tag(9, "z"))
    got = sorted((r["action"], r["tid"], r["ref"], r["txt"], r["modAt"] == day(150))
                 for r in sync.bulk_merge(live, incoming, day(150)).collect())
    assert got == [("displaced", None, "b", "live b", True), ("merged", 1, "a", "new a", True),
                   ("placed", 2, "B", "new b", True)]
    merged_rows = sync.bulk_merge(live, incoming, day(150))
    rows = sorted((r["tid"], r["ref"]) for r in sync.apply_bulk_merge(live, merged_rows, 9).collect())
    assert rows == [(1, "a"), (2, "B"), (3, "c"), (10, "b")]


def test_bulk_merge_has_one_owner_per_tid(spark):
    live = table(spark, tag(1, "a", "live a"), tag(2, "b", "live b"), tag(3, "c", "live c"))
    incoming = table(spark, tag(1, "x", "new x", dt=day(3)), tag(1, "y", "new y", dt=day(2)),
                     tag(2, "b", "mine b", dt=day(1)), tag(2, "q", "old q", dt=day(0)), tag(2, "q", "old q", dt=day(0)),
                     tag(3, "z", dt=None), tag(None, "n", "no key"))
    rows = sync.bulk_merge(live, incoming, day(150))
    got = sorted((r["action"], r["tid"] or 0, r["ref"], r["modAt"] == day(150)) for r in rows.collect())
    assert got == [("displaced", 0, "a", True), ("displaced", 0, "c", True), ("merged", 2, "b", True),
                   ("placed", 1, "x", True), ("placed", 3, "z", True), ("split", 0, "q", True), ("split", 0, "y", True)]
    after = sorted((r["tid"], r["ref"]) for r in sync.apply_bulk_merge(live, rows, 9).collect())
    assert [r for _, r in after[:3]] == ["x", "b", "z"] and {r for _, r in after[3:]} == {"a", "c", "q", "y"}
    assert len({t for t, _ in after}) == 7


class Device:
    """One client and the shared server, for whole rounds."""

    server = None

    def __init__(self, spark, *rows):
        self.spark, self.rows = spark, table(spark, *rows)

    def put(self, *rows):
        keys = [r[0] for r in rows]
        self.rows = self.rows.where(~F.col("tid").isin(keys)).unionByName(table(self.spark, *rows))

    def sync(self, clocks):
        base, self.rows, rounds = sync_until_settled(Device.server, self.rows, clocks)
        Device.server = base
        return rounds

    def all(self):
        return by(self.rows, "ref")


@pytest.fixture
def server(spark):
    Device.server = table(spark)


def clocks(n):
    return [day(200 + n) + timedelta(minutes=i) for i in range(5)]


def test_insert_reaches_the_other_device(spark, server):
    a, b = Device(spark, tag(100, "r", "hello", dt=None, dirty=True)), Device(spark)
    a.sync(clocks(0))
    rounds = b.sync(clocks(1))
    got = b.all()["r"]
    assert (got["tid"], got["txt"], got["modAt"], got["dt"]) == (100, "hello", None, clocks(0)[0])
    assert a.all()["r"]["modAt"] is None
    assert rounds[-1].settled and len(rounds) == 2


def test_update_and_conflict_converge(spark, server):
    a, b = Device(spark, tag(1, "r", "base", dt=None, dirty=True)), Device(spark)
    a.sync(clocks(0))
    b.sync(clocks(1))
    seen = a.all()["r"]["dt"]
    a.put(tag(1, "r", "base A", dt=seen, dirty=True))
    a.sync(clocks(2))
    b.put(tag(1, "r", "B base", dt=seen, dirty=True, rec=json.dumps(origin("base", [], seen))))
    rounds = b.sync(clocks(3))
    a.sync(clocks(4))
    assert a.all()["r"]["txt"] == b.all()["r"]["txt"] == "B base A"
    assert a.all()["r"]["modAt"] is None and b.all()["r"]["modAt"] is None
    assert [r.downloaded for r in rounds][:2] == [1, 0]


def test_blocked_until_caught_up(spark, server):
    a, b = Device(spark, tag(1, "anchor", dt=None, dirty=True)), Device(spark)
    a.sync(clocks(0))
    b.put(tag(2, "late", dt=None, dirty=True))
    rounds = b.sync(clocks(1))
    assert rounds[0].accepted == 0 and rounds[1].accepted == 1
    a.sync(clocks(2))
    assert set(a.all()) == set(b.all()) == {"anchor", "late"}


def test_three_devices_clash_on_one_key(spark, server):
    devices = [Device(spark, tag(99, f"{n}-content", n, dt=None, dirty=True)) for n in "ABC"]
    for turn in range(2):
        for i, device in enumerate(devices):
            device.sync(clocks(10 * turn + i))
    for device in devices:
        rows = device.all()
        assert set(rows) == {"A-content", "B-content", "C-content"}
        assert len({r["tid"] for r in rows.values()}) == 3
        assert all(r["modAt"] is None for r in rows.values())
    assert devices[0].all()["A-content"]["tid"] == 99


def test_moved_row_is_dirty_after_its_round(spark, server):
    Device.server = table(spark, tag(99, "apple", "apple", dt=day(5)))
    mine = table(spark, tag(99, "orange", "orange", dt=None, dirty=True))
    first = sync_once(Device.server, mine, day(150))
    rows = by(first.local, "ref")
    assert rows["apple"]["tid"] == 99 and rows["apple"]["modAt"] is None
    assert rows["orange"]["tid"] == 100 and rows["orange"]["modAt"] is not None
    assert {r["action"] for r in first.audit.collect()} == {"local", "server", "moved"}
    second = sync_once(first.base, first.local, day(151))
    assert by(second.local, "ref")["orange"]["modAt"] is None


def test_mixed_batch(spark, server):
    Device.server = table(spark, tag(601, "601", "v1", dt=day(1)), tag(602, "602", "v2", dt=day(3)),
                          tag(603, "603", "only A", dt=day(3)))
    b = Device(spark, tag(600, "600", "new", dt=None, dirty=True), tag(601, "601", "v1 B", dt=day(1), dirty=True),
               tag(602, "602", "stale B", dt=day(1), dirty=True))
    b.sync(clocks(0))
    rows = b.all()
    assert {k: r["txt"] for k, r in rows.items()} == {
        "600": "new", "601": "v1 B", "602": "stale B", "603": "only A"}
    assert all(r["modAt"] is None for r in rows.values())


def test_rows_at_scale_lose_no_key(spark):
    base, local = views.base(spark, SF, newer=True), views.local_sync(spark, SF)
    keys = set(map(tuple, base.select("type", "ref").union(local.select("type", "ref")).distinct().collect()))
    server_rows, rows, rounds = sync_until_settled(base, local, CLOCKS)
    assert len(rounds) <= 4 and rounds[-1].settled
    got = rows.select("tid", "type", "ref", "modAt").collect()
    assert len({(r["type"], r["ref"]) for r in got}) == len(got) == len({r["tid"] for r in got})
    assert not [r for r in got if r["modAt"] is not None]
    both = {(r["type"], r["ref"]) for r in got} | {
        (r["type"], r["ref"]) for r in server_rows.select("type", "ref").collect()}
    assert both == keys
    again = sync_once(server_rows, rows, day(300))
    assert again.settled


def test_hundred_rows_half_of_them_edited(spark, server):
    a = Device(spark, *[tag(i, f"R{i}", f"T{i}", dt=None if i < 50 else day(1), dirty=i < 50) for i in range(100)])
    rounds = a.sync(clocks(0))
    assert rounds[0].accepted == 50 and len(a.all()) == 100
    assert all(r["modAt"] is None for r in a.all().values())


def unique_tids(rows):
    held = [r["tid"] for r in rows if r["tid"] is not None]
    assert len(held) == len(set(held)) and len({(r["type"], r["ref"]) for r in rows}) == len(rows)


def test_two_server_rows_on_one_tid_are_parted(spark):
    base = table(spark, tag(99, "ra", "a", dt=day(2)), tag(99, "rb", "b", dt=day(3)), tag(5, "rc", "c", dt=day(1)))
    server_rows, rows, rounds = sync_until_settled(base, table(spark), CLOCKS, must_settle=True)
    for found in (server_rows.collect(), rows.collect()):
        unique_tids(found)
        assert {r["ref"]: r["txt"] for r in found} == {"ra": "a", "rb": "b", "rc": "c"}
        assert {r["ref"]: r["tid"] for r in found}["rb"] == 99 and None not in [r["tid"] for r in found]


def test_an_inserted_row_takes_no_tid_that_is_held(spark):
    base = table(spark, tag(99, "ra", "a", dt=day(2)))
    local = table(spark, tag(3, "ra", "a", dt=day(2)), tag(99, "mine", "m", dt=None, dirty=True), tag(99, "other", "o", dt=None, dirty=True))
    server_rows, rows, _ = sync_until_settled(base, local, CLOCKS, must_settle=True)
    for found in (server_rows.collect(), rows.collect()):
        unique_tids(found)
    tids = {r["ref"]: r["tid"] for r in server_rows.collect()}
    assert tids["ra"] == 99 and set(tids) == {"ra", "mine", "other"}
    assert {r["ref"]: r["tid"] for r in rows.collect()}["mine"] == tids["mine"]


def test_rounds_say_when_they_have_not_settled(spark):
    base, local = table(spark, tag(1, "a", dt=day(1))), table(spark, tag(2, "b", dt=None, dirty=True))
    _, _, rounds = sync_until_settled(base, local, CLOCKS[:1])
    assert not rounds[-1].settled
    with pytest.raises(RuntimeError, match="not settled"):
        sync_until_settled(base, local, CLOCKS[:1], must_settle=True)
    with pytest.raises(ValueError, match="clocks"):
        sync_until_settled(base, local, [*CLOCKS, *CLOCKS])


def test_records_that_are_not_json_stay_readable(spark):
    from tagloom.functions.merge import rec_merge
    df = spark.createDataFrame([("nope", '{"a":1}'), ('{"a":1}', "nope"), ("no", "nope"), (None, "nope")], "t string, s string")
    got = [r["m"] for r in df.select(rec_merge(F.col("t"), F.col("s")).alias("m")).collect()]
    assert got == ['{"a":1}', '{"a":1}', "no", "{}"]


def test_rounds_with_kept_facts_look_for_no_keys(spark, monkeypatch):
    """The same rounds, from facts that are kept with the table; the server's keys are not checked again."""
    base = table(spark, *[tag(i, f"r{i}", dt=day(i)) for i in range(8)])
    local = table(spark, tag(1, "r1", "mine", day(1), dirty=True), tag(5, "other", "new", None, dirty=True), tag(7, "r7", dt=day(7)))
    facts = sync_round.facts_of(base)
    assert (facts.dt, facts.tid) == (day(7), 7)
    path = fresh_path(spark, "facts")
    assert sync_round.read_facts(spark, path) is None
    plain = sync_until_settled(base, local, CLOCKS[:2])
    checked = []
    monkeypatch.setattr(sync_round, "require_unique", lambda df, what: checked.append(what))
    sync_round.write_facts(spark, path, 1, facts)
    kept = sync_until_settled(base, local, CLOCKS[:2], facts=sync_round.read_facts(spark, path))
    assert checked == ["dirty rows"]
    for a, b in zip(plain[:2], kept[:2]):
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    last = kept[2][-1].facts
    assert last == sync_round.facts_of(kept[0], check_keys=False)
    sync_round.write_facts(spark, path, 2, last)
    assert sync_round.read_facts(spark, path) == last
