"""Landed rows: nulls, broken payloads, missing files, repeats and late files."""

import datetime
import glob
import json

import pytest
from pyspark.sql import functions as F

from parley.operators import matching, payloads
from parley.sources import feeds
from parley.streaming import upserts

DAY = datetime.date(2026, 4, 16)


def test_broken_payloads_give_no_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]")], "seq int, payload string")
    assert payloads.normalize_caiso_events(rows, "2024-01-01", "2024-12-31").count() == 0
    assert payloads.normalize_miso_events(rows, "2024-01-01", "2024-12-31").count() == 0


def test_ical_skips_all_day_and_empty(spark):
    text = "BEGIN:VEVENT\r\nDTSTART;TZID=X:20260610T100000\r\nSUMMARY:A\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260610\r\nSUMMARY:B\r\nEND:VEVENT"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "calendar_id int, text string")
    assert [tuple(r) for r in payloads.parse_ical_events(rows).collect()] == [(1, datetime.date(2026, 6, 10), "A", "10:00 AM")]


def test_milestones(spark):
    text = "April 16, 2026 Configurable Parameters working group\nApril 30, 2026 Comments due"
    rows = spark.createDataFrame([(1, text, "Sep 26, 2023* Final", "Completed", None), (2, None, None, None, None), (3, "Apr 16, 2026 a", "April 16, 2026 b", "soon", "")], "issue_id int, stage_a string, stage_b string, stage_c string, stage_d string")
    got = sorted(tuple(r) for r in payloads.initiative_milestones(rows).collect())
    assert got == [(1, datetime.date(2023, 9, 26), "Final"), (1, DAY, "Configurable Parameters working group"), (1, datetime.date(2026, 4, 30), "Comments due"), (3, DAY, "a · b")]


def test_press_items(spark):
    rows = spark.createDataFrame([("Order", "see Docket No. ER24-1-000", "April 16, 2026"), ("An LNG Project", "x", "April 16, 2026"), (None, None, "April 15, 2026"), ("Old", "x", "April 1, 2026"), ("None", "x", None)], "title string, body string, date_text string")
    got = {(r["title"], r["docket"], r["text"]) for r in payloads.filter_press_items(rows, "2026-04-16", 2).collect()}
    assert got == {("Order", "ER24-1-000", "[Docket: ER24-1-000] see Docket No. ER24-1-000"), (None, None, None)}


def test_event_keys_of_both_shapes(spark):
    docs = spark.createDataFrame([("u1", "MC", '{"event_id": 7}'), ("u2", "MC", '[{"event_id": "7"}, {"event_id": "7"}]'), ("u3", "MC", None), ("u4", "MC", "{"), ("u5", None, '{"event_id": 7}')], "download_url string, committee string, events string")
    meetings = spark.createDataFrame([(1, "MC", "7"), (2, None, "7")], "id int, committee string, event_id string")
    assert sorted(tuple(r) for r in matching.link_documents_to_events(docs, meetings).collect()) == [(1, "u1"), (1, "u2")]


def test_missing_feed_is_empty(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, title string")
    assert feeds.read_calendar_feed(spark, feeds.new_folder(spark, "none"), rows.schema).count() == 0


def test_compact_csv(spark):
    path = feeds.new_folder(spark, "csv")
    rows = spark.createDataFrame([("PJM", 'a "b", c', ["x", "y"], None)], "rto string, title string, initiatives array<string>, url string")
    feeds.write_compact_csv(rows, path)
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/part-*"))
    data = b"".join(open(f, "rb").read() for f in files)
    assert data.decode() == "\ufeff" + ",".join(feeds.COMPACT_COLUMNS) + "\r\n" + 'PJM,,,,,"a ""b"", c",,,x; y,,,\r\n'


def _landed(spark, rows):
    """Rows as (seq, meeting fields, documents, issue fields, refs)."""
    return spark.createDataFrame(rows, upserts.LANDED)


def test_store_takes_late_repeated_and_failed_batches(spark, monkeypatch):
    base = feeds.new_folder(spark, "stream")
    meeting = lambda **x: {k: x.get(k) for k in ("rto", "title", "meeting_date", "meeting_time", "committee", "location", "source_url", "detail_url", "materials_url")}
    issue = lambda **x: {k: x.get(k) for k in ("rto", "native_id", "canonical_name", "short_title", "status", "stakeholder_phase", "committee_owner", "is_open", "url")}
    doc = lambda seq, url, **x: {"seq": seq, "download_url": url, **{k: x.get(k) for k in ("doc_type", "title", "filename", "posted_date", "member_url")}}
    land = lambda *rows: _landed(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/landed")
    run = lambda: upserts.incremental_upsert(spark, f"{base}/landed", f"{base}/store", f"{base}/progress", buckets=4)
    at = lambda s: (
        sorted((r["id"], r["title"], r["meeting_time"], r["committee"], r["last_seq"]) for r in s.meetings().collect()),
        sorted((r["download_url"], r["meeting_id"], r["rto"], r["title"]) for r in s.documents().collect()),
        sorted((r["id"], r["native_id"], r["status"]) for r in s.issues().collect()),
        sorted((r["issue_id"], r["ref_url"], r["ref_title"]) for r in s.references().collect()),
    )
    assert at(upserts.Store(spark, f"{base}/none")) == ([], [], [], [])
    land((5, meeting(rto="PJM", title="T", meeting_date=DAY, meeting_time="9:00 AM"), [doc(5, "u1", title="old")], None, None), (6, None, None, issue(rto="PJM", native_id="I"), [("u1", None)]))
    assert at(run()) == ([(5, "T", "9:00 AM", None, 5)], [("u1", 5, "PJM", "old")], [(6, "I", None)], [(6, "u1", None)])
    # Late ones: an earlier sighting of the meeting gives it another id, and the documents follow.
    land((2, meeting(rto="PJM", title="T", meeting_date=DAY, meeting_time="8:00 AM", committee="MC"), None, None, None), (7, meeting(rto="SPP", title="U", meeting_date=None), [doc(7, "u1", title="new"), doc(8, None)], None, None), (3, None, None, issue(rto="PJM", native_id="I", status="open"), [("u1", "a"), ("u2", None)]))
    want = ([(2, "T", "9:00 AM", "MC", 5), (7, "U", None, None, 7)], [("u1", 2, "PJM", "new")], [(3, "I", "open")], [(3, "u1", "a"), (3, "u2", None)])
    assert at(run()) == at(run()) == want
    # A batch that fails halfway leaves the store as it was, and runs again.
    land((9, meeting(rto="PJM", title="T", meeting_date=DAY, committee="OC"), [doc(9, "u3")], None, None))
    fold = upserts.Store.fold
    monkeypatch.setattr(upserts.Store, "fold", lambda self, rows, table, n: fold(self, rows, table, n) if table.name == "meetings" else 1 / 0)
    with pytest.raises(Exception):
        run()
    assert at(upserts.Store(spark, f"{base}/store", 4)) == want
    monkeypatch.setattr(upserts.Store, "fold", fold)
    after = at(run())
    assert after[0] == [(2, "T", "9:00 AM", "OC", 9), (7, "U", None, None, 7)] and after[1] == [("u1", 2, "PJM", "new"), ("u3", 2, "PJM", None)] and after[2:] == want[2:]
    # Parts that a batch does not touch keep their version.
    versions = {p.split("version=")[1].split("/")[0] for p in glob.glob(f"{base.removeprefix('file://')}/store/*/version=*/bucket=*")}
    assert len(versions) > 1
    # A batch that was marked is left out when it is handed over again.
    store = upserts.Store(spark, f"{base}/store", 4)
    store.apply(_landed(spark, [(50, meeting(rto="X", title="X"), None, None, None)]), store.done())
    assert at(store) == after


@pytest.mark.parametrize("indent", [None, 2])
def test_array_feed_is_read_by_byte_ranges(spark, indent):
    """Braces, quotes and escapes in strings, nested lists, empty records; several tasks read one file."""
    records = [{"id": i, "t": t, "x": [{"y": "{" * (i % 3)}, {"y": '"}'}]} for i, t in enumerate(["plain", 'a } b { "q" ]', "back\\slash\\", "é\n\u2028", "", None, "[{", "\\\"}", "x" * 500] * 12)]
    base = feeds.new_folder(spark, "array")
    spark.createDataFrame([(json.dumps(records, indent=indent),)], "value string").coalesce(1).write.option("lineSep", "\n").text(base)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        scan = spark.read.option("lineSep", "}").text(base)
        assert scan.rdd.getNumPartitions() > 5
        kind = spark.createDataFrame([], "id long, t string, x array<struct<y: string>>").schema
        got = sorted((r["id"], r["t"], [x["y"] for x in r["x"]]) for r in feeds.read_json_array(spark, base, kind).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(r["id"], r["t"], [x["y"] for x in r["x"]]) for r in records]


def test_array_feed_in_parts(spark):
    rows = spark.range(50).select("id", F.date_add(F.lit(DAY), (F.col("id") % 7).cast("int")).alias("date"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("}{ "), "id")).alias("title"))
    path = feeds.new_folder(spark, "array")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    feeds.write_calendar_feed_array(rows, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/part-*"))
    assert len(files) > 1
    whole = json.loads("".join(open(f).read() for f in files))
    assert [r["id"] for r in whole] == [r["id"] for r in rows.orderBy(F.desc("date"), "id").collect()] and "title" in whole[0]
    assert {tuple(r) for r in feeds.read_calendar_feed(spark, path, rows.schema, multi_line=True).collect()} == {tuple(r) for r in rows.collect()}
    feeds.write_calendar_feed_array(rows.limit(0), none := feeds.new_folder(spark, "array"))
    assert feeds.read_calendar_feed(spark, none, rows.schema, multi_line=True).count() == 0
