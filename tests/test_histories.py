"""Spelled days, trees, timelines and the digest on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.functions.text import committee_from_slug, committee_of_subtype
from parley.operators import digest, issues, matching, payloads

D = dt.date


@pytest.mark.parametrize("text, days", [
    ("Agenda-Apr-09-2026.pdf", {D(2026, 4, 9), D(2020, 4, 9)}), ("apr-09-26", {D(2026, 4, 9)}), ("Apr 09, 2026", {D(2026, 4, 9)}), ("04-09-2026", {D(2026, 4, 9)}), ("x4-9-2026", {D(2026, 4, 9)}),
    ("14-9-2026", {D(2026, 4, 9)}), ("4-09-2026", set()), ("2026-04-09", {D(2026, 4, 9)}), ("2026-02-30", set()), ("", set()),
])
def test_spelled_days(spark, text, days):
    row = spark.createDataFrame([(text,)], "t string").select(matching.spelled_days(F.col("t")).alias("d")).first()
    assert set(row["d"]) == days


def test_committee_names(spark):
    df = spark.createDataFrame([(" Name:Markets Committee]", "x"), ("Name:Other Committees and Working Groups", "NEPOOL Budget Meeting (Day 2)"), (None, "Meeting")], "s string, t string")
    assert [r[0] for r in df.select(committee_of_subtype(F.col("s"), F.col("t"))).collect()] == ["Markets Committee", "Budget", "Meeting"]
    df = spark.createDataFrame([("marketsplus-design-call-20240101",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(committee_from_slug(F.col("s"))).collect()] == ["Markets+ Design", None, None]


def test_trees_of_any_depth(spark):
    def tree(levels):
        node = ""
        for i in reversed(range(levels)):
            node = '{"type":"%s","data":{"url":"/%d"},"children":[%s%s]}' % ("Folder" if i % 5 == 4 else "Document", i, node, ',{"type":"Document","data":{"url":"/0"}}' if node else "")
        return f"[{node}]"

    df = spark.createDataFrame([(1, tree(12)), (2, None), (3, "{"), (4, "[]"), (5, "[1, null]"), (6, tree(40)), (7, tree(1))], "event_id int, tree string")
    want = sorted((e, f"https://www.caiso.com/{i}") for e, n in ((1, 12), (6, 40), (7, 1)) for i in range(n) if i % 5 != 4)
    for step in (12, 5):
        assert sorted(tuple(r) for r in payloads.flatten_document_tree(df, step=step).select("event_id", "download_url").collect()) == want


def test_timeline_bounds(spark):
    shape = "issue_id int, rto string, status string, stage_d string, initiated_date date, work_begins_date date, target_completion_date date, actual_completion_date date"
    rows = [(1, "PJM", None, None, D(2024, 1, 1), D(2024, 1, 6), D(2024, 1, 11), None), (2, "PJM", None, None, D(2024, 1, 1), None, None, None), (3, "CAISO", "Completed", None, None, None, None, None), (4, "CAISO", None, None, None, None, None, None)]
    stones = spark.createDataFrame([(3, D(2024, 1, 1)), (3, D(2024, 1, 5)), (3, D(2024, 1, 9)), (4, D(2024, 1, 1))], "issue_id int, milestone_date date")
    got = {r["issue_id"]: r for r in issues.initiative_timeline(spark.createDataFrame(rows, shape), stones, "2024-01-17").collect()}
    assert (got[1]["is_overdue"], got[1]["filled_pct"], got[1]["midpoints"]) == (True, 100.0, [D(2024, 1, 6)])
    assert got[2]["filled_pct"] is None and got[4]["start_date"] is None
    assert (got[3]["is_overdue"], got[3]["filled_pct"], got[3]["midpoints"]) == (False, 100.0, [D(2024, 1, 5)])


def test_digest_of_a_week(spark):
    issue = "array<struct<name string, short_title string, status string, stakeholder_phase string, owner string, url string>>"
    events = spark.createDataFrame(
        [(1, "PJM", "Talk", D(2024, 1, 16), "9:00 AM", "PC", None, "http://d", None, "Dams", True, [("Plan", "P", "active", None, "Board", None)]), (2, "MISO", "Idle", D(2024, 1, 9), None, None, None, None, None, None, False, None)],
        f"id int, rto string, title string, meeting_date date, time_label string, committee string, source_url string, detail_url string, materials_url string, reason string, is_relevant boolean, issues {issue}")
    docs = spark.createDataFrame(
        [(7, 1, None, "f.pdf", None, None, None, None, None, None, None, None, None, "u7", None, None, None, None),
         (8, 1, "Paper", None, "report", "2024-01-10", "direct", ["storage", "odd"], True, "Water", ["Ann (Acme)"], ["Plan"], "m8", "u8", "Sum.", "So.", False, [("c", "q", False)])],
        "id int, meeting_id int, title string, filename string, doc_type string, posted_date string, directness string, topics array<string>, relevant boolean, reason string, stakeholders array<string>, initiatives array<string>, member_url string, url string, ai_summary string, read_through string, source_names_subject boolean, evidence array<struct<claim string, quote string, verified boolean>>")
    got = {r["week"]: r["markdown"] for r in digest.digest_markdown(events, docs, "2024-01-17").collect()}
    head = "# RTO Hydro Digest — Week of {0}\n\n_Generated January 17, 2024. Window: {0} – {1}._\n\n"
    assert got[D(2024, 1, 8)] == head.format("January 8, 2024", "January 14, 2024") + "No hydro-relevant meetings flagged in this window."
    assert got[D(2024, 1, 15)] == head.format("January 15, 2024", "January 21, 2024") + "\n".join([
        "**1 hydro-relevant meeting** across PJM. 1 hydro-flagged document of 2 total.", "", "---", "", "## 1. PJM — Talk", "", "- **Date:** January 16, 2024 · 9:00 AM", "- **Committee:** PC", "- **Detail page:** http://d", "",
        "**Why hydro-relevant:** Dams", "", "### Initiatives (1)", "", "- **Plan** (P) — _active_", "  - Owner: Board", "", "### Documents (2 total, 1 hydro-relevant)", "",
        "#### [HYDRO] Paper", "- **Type:** report · **Posted:** 2024-01-10", "- **Confidence:** Direct — Changes a hydro or PSH revenue stream, obligation, or option", "- **Topics:** Storage & PSH · odd", "- **Why flagged:** Water",
        "- **Stakeholders:** Ann (Acme)", "- **Initiatives touched:** Plan", "- **URL:** m8", "", "**What the document says:**", "", "Sum.", "", "**Why it matters to hydro** — inference, not stated in the document:", "", "So.", "",
        digest.UNNAMED, "**Sourced from the document** — verbatim spans behind the dates and figures above:", "", '- [UNVERIFIED] c — "q"', "", digest.UNVERIFIED, "#### f.pdf", "- **URL:** u7", ""])
