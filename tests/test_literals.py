"""Literal cases with results written out by hand from the rules, so that a query and its SQL cannot share a mistake."""

import datetime

from pyspark.sql import functions as F

from parley.functions import dates, text
from parley.operators import analytics, linking, matching, screening
from parley.operators.textindex import TextIndex


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_titles(spark):
    names = [("20260416-item-05---pjm-rbp-design.pdf",), ("2026_edcs-tos_to_x.xlsx",), ("20260416.pdf",), ("a-" + "b" * 1500 + ".pdf",), (None,)]
    got = [r[0] for r in one(spark, names, "f string", text.title_from_filename(F.col("f")))]
    assert got == ["Item 05 – PJM RBP Design", "2026 Edcs Tos TO X", None, "A B" + "b" * 1499, None]
    rows = [("PDF", "a-b.pdf", "PJM"), ("PDF", "a-b.pdf", "MISO"), ("PDF", "pdf.pdf", "PJM"), (None, "20260101.pdf", "PJM"), ("Kept", "a-b.pdf", "PJM")]
    got = [r[0] for r in one(spark, rows, "t string, f string, r string", text.backfill_stored_title(F.col("t"), F.col("f"), F.col("r")))]
    assert got == ["A B", "PDF", "PDF", None, "Kept"]
    slugs = [("m2m-task-force-20260101",), ("marketsplus-design-meeting-20260101-12",)]
    assert [r[0] for r in one(spark, slugs, "s string", text.committee_from_slug(F.col("s")))] == ["M2M Task Force", "Markets+ Design"]


def test_lists(spark):
    rows = [(None,), ("",), ("a",), ("a;b",)]
    assert [r[0] for r in one(spark, rows, "t string", text.topics_array(F.col("t")))] == [[], [], ["a"], ["a", "b"]]
    rows = [(None,), ("no json",), ('[{"claim":"c","quote":"q","verified":true},{"quote":"x"}]',)]
    assert [r[0] for r in one(spark, rows, "e string", text.evidence_text(text.evidence_array(F.col("e"))))] == ["", "", 'c — "q" | ? — "x" [UNVERIFIED]']


def test_times(spark):
    day = datetime.date(2026, 1, 15)
    rows = [(day, "9:00 AM - 12:00 PM", "CAISO"), (day, "1:30 p.m. MT", "SPP"), (day, "2:05 PM", "Other"), (day, "TBD", "PJM")]
    r = dates.resolve_meeting_time(F.col("d"), F.col("t"), F.col("r"))
    got = one(spark, rows, "d date, t string, r string", r["zone"], r["start_utc"].cast("string"), r["end_utc"].cast("string"), r["time24"], r["raw"])
    assert got == [
        ("America/Los_Angeles", "2026-01-15 17:00:00", "2026-01-15 20:00:00", "12:00", None), ("America/Denver", "2026-01-15 20:30:00", None, "15:30", None),
        (None, None, None, "14:05", "2:05 PM"), ("America/New_York", None, None, None, None),
    ]
    rows = [("Starts 9:00 a.m. - 12:00 p.m. in A",), ("at 9:00 AM ET, sharp",), ("item 9:00",), (None,)]
    assert [r[0] for r in one(spark, rows, "t string", dates.time_in_text(F.col("t")))] == ["9:00 a.m. - 12:00 p.m.", "9:00 AM ET", None, None]


def test_material_url(spark):
    rows = [("20260101 Item 2 (a).pdf", 7, "pdf"), ("plain", 8, "xlsx")]
    got = [r[0] for r in one(spark, rows, "f string, o long, e string", matching.material_url(F.col("f"), F.col("o"), F.col("e")))]
    assert got == ["https://cdn.misoenergy.org/20260101%20Item%202%20%28a%297.pdf", "https://cdn.misoenergy.org/plain8.xlsx"]


def test_people_named_like_their_organisation(spark):
    people = spark.createDataFrame([
        (1, 1, "PJM", "PJM Interconnection, L.L.C.", None, None), (2, 1, "Ann Li", "PJM Interconnection, L.L.C.", "presenter", None), (3, 2, "ann li", "PJM", "Author", "a@x.org"),
        (4, 2, "ANN LI", "pjm interconnection", "presenter", None), (5, 2, "Bo", None, None, None), (6, 1, "Acme Corp.", "Acme Corp.", None, None),
    ], "seq long, document_id long, name string, entity string, role string, email string")
    docs = spark.createDataFrame([(1, 10, "PJM", "agenda", "A"), (2, 10, "PJM", "other", "B")], "id long, meeting_id long, rto string, doc_type string, title string")
    index = {(r["name_key"], r["org_key"]): (r["rtos"], r["doc_types"], r["meetings"]) for r in analytics.stakeholder_index(people, docs).collect()}
    assert index == {("ann li", "pjm"): ("PJM", "agenda", 1), ("bo", ""): ("PJM", "", 1), ("acme corp.", "acme"): ("PJM", "agenda", 1)}
    got = {r["name"]: (r["org"], r["email"], r["roles"], [d["id"] for d in r["documents"]], r["org_people"]) for r in analytics.meeting_stakeholders(people, docs).collect()}
    assert got == {"Ann Li": ("PJM", "a@x.org", "presenter,Author", [1, 2], 1), "Bo": ("Unaffiliated", None, "", [2], 1)}


def test_related_documents(spark):
    day = datetime.date(2024, 1, 10)
    rows = [
        (1, 1, "PJM", day, "agenda", [], "s"), (2, 2, "MISO", day, "report", [], "s"), (3, 3, "MISO", day, "agenda", ["storage"], "s"), (4, 4, "SPP", day, "agenda", [], None),
        (5, 5, "SPP", day + datetime.timedelta(days=11), "agenda", [], "s"), (6, 6, "SPP", day, "minutes", ["storage"], "s"), (7, 7, "PJM", day, "agenda", ["storage"], "s"), (8, 8, "ERCOT", day, "agenda", ["storage"], "s"),
    ]
    docs = spark.createDataFrame(rows, "id long, event_id long, rto string, event_date date, doc_type string, topics array<string>, ai_summary string")
    got = {}
    for r in linking.related_documents(docs).orderBy("id", "rn").collect():
        got.setdefault(r["id"], []).append((r["related_id"], r["score"]))
    # Without topics only the type is shared; two strong matches (7's) leave the weaker ones out.
    assert got[1] == [(3, 4), (8, 4)] and got[7] == [(3, 5), (8, 5)] and 2 not in got
    places = {(r["id"], r["related_rto"]): (r["place"], [i["id"] for i in r["items"]]) for r in linking.related_by_rto(linking.related_documents(docs)).collect()}
    assert places[1, "ERCOT"] == (1, [8]) and places[1, "MISO"] == (2, [3])


def test_member_urls(spark):
    docs = spark.createDataFrame([(1, 1, "SPP", "u/a.zip#z=b.pdf", None), (2, 1, "SPP Markets +", "u/A.ZIP", None), (3, 1, "SPP", "u/a.pdf", None), (4, 2, "SPP", "u/a.zip", None), (5, 1, "PJM", "u/a.zip", None)], "id long, meeting_id long, rto string, download_url string, member_url string")
    meetings = spark.createDataFrame([(1, "https://x/spp-documents-filings/?id=5"), (2, "https://x/other")], "id long, materials_url string")
    got = {r["id"]: (r["member_url"], r["still_missing"]) for r in linking.backfill_member_url(docs, meetings).collect()}
    page = "https://x/spp-documents-filings/?id=5"
    assert got == {1: (page, False), 2: (page, False), 3: (None, False), 4: (None, True), 5: (None, False)}


def test_stage2_gates(spark):
    docs = spark.createDataFrame([(1, "FERC", 1, None, None, None), (2, "NYISO", 1, "t", None, 0), (3, "PJM", 2, "t", "t", 1), (4, "PJM", 2, None, "t", None), (5, "ERCOT", 1, "t", "t", None)], "id long, rto string, meeting_id long, ai_processed_at string, stakeholders_extracted_at string, source_names_hydro int")
    meetings = spark.createDataFrame([(1, datetime.date(2024, 1, 1), 0), (2, datetime.date(2024, 1, 2), 1)], "id long, meeting_date date, hydro_relevant int")
    ids = lambda **how: [r["id"] for r in screening.stage2_candidates(docs, meetings, **how).collect()]
    assert ids() == [4, 2] and ids(rescreen=True) == [3, 4, 2, 5] and ids(rescreen=True, only_unrated=True) == [4, 5] and ids(rto="pjm") == [4]


def test_suggestions(spark):
    rows = [("rto", f"m{i} pe", f"m{i} pe", i, None) for i in range(6)] + [("entity", "apex", "apex", 9, None), ("entity", "peco", "peco", 1, None)] + [("meeting", str(i), "open", 1, datetime.date(2024, 1, 9 - i)) for i in range(7)]
    index = spark.createDataFrame(rows, "kind string, label string, search string, n long, date date")
    index = TextIndex(index, ["kind", "label"], F.col("search"))
    got = [(r["kind"], r["label"]) for r in analytics.search_suggestions(index, " PE").orderBy("kind", "rn").collect()]
    assert got == [("entity", "peco"), ("entity", "apex"), *[("meeting", str(i)) for i in (6, 5, 4, 3, 2)], *[("rto", f"m{i} pe") for i in (5, 4, 3, 2)]]
    assert analytics.search_suggestions(index, "p").count() == 0


def test_text_index_finds_what_a_scan_finds(spark):
    texts = [None, "", "a", "Ab", "abc", "xABCx", "ab c", "é\u00fcö ab", "aaaa", "a" * 5000 + "bc", "cab", "😀 abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = TextIndex(rows, ["id"], F.col("text"))
    for q in ("", "a", "ab", "abc", "ABC", "b c", "\u00fcö", "zz", "aaab", "😀 a", "aaaaa"):
        assert sorted(r["id"] for r in index.find(q).collect()) == [i for i, x in enumerate(texts) if q.lower() in (x or "").lower()], q


def test_time_labels_across_clock_changes(spark):
    rows = [("2024-03-08", "9:00 AM - 12:00 PM", "CAISO"), ("2024-03-11", "9:00 AM - 12:00 PM", "CAISO"), ("2024-11-01", "1:30 p.m.", "MISO"), ("2024-11-04", "1:30 p.m. MT", "MISO"), ("2024-07-01", "10:00 AM ET", "SPP"), ("2024-07-01", "10:00 AM", "Other"), ("2024-07-01", "TBD", "PJM")]
    r = dates.resolve_meeting_time(F.col("d").cast("date"), F.col("t"), F.col("r"))
    got = one(spark, rows, "d string, t string, r string", *[r[c] for c in ("shown", "zone_short", "source_shown")])
    assert got == [
        ("12:00 PM – 3:00 PM EST", "EST", "9:00 AM – 12:00 PM PST"), ("12:00 PM – 3:00 PM EDT", "EDT", "9:00 AM – 12:00 PM PDT"), ("2:30 PM EDT", "EDT", "1:30 PM CDT"), ("3:30 PM EST", "EST", "1:30 PM MST"),
        ("10:00 AM EDT", "EDT", None), ("10:00 AM", None, None), (None, None, None),
    ]
    abroad = dates.resolve_meeting_time(F.col("d").cast("date"), F.col("t"), F.col("r"), "Asia/Kolkata")
    assert one(spark, rows[:1], "d string, t string, r string", abroad["shown"], abroad["zone_short"]) == [("10:30 PM – 1:30 AM GMT+5:30", "GMT+5:30")]


def test_round_robin_in_order_with_remainder(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [(1, "A", day(2), None), (2, "A", day(3), "9"), (3, "A", day(4), None), (4, "B", day(3), None), (5, "B", day(3), "8"), (6, "C", day(9), None), (7, None, day(1), "x")]
    events = spark.createDataFrame(rows, "id int, rto string, meeting_date date, meeting_time string")
    take = lambda n: [(r["id"], r["place"], r["left_over"]) for r in analytics.diversify_round_robin(events, n).orderBy("place").collect()]
    assert take(5) == [(7, 1, 2), (1, 2, 2), (4, 3, 2), (2, 4, 2), (6, 5, 2)]
    assert [r[0] for r in take(9)] == [7, 1, 4, 5, 2, 3, 6] and take(9)[0][2] == 0


def test_issues_open_first(spark):
    issues = spark.createDataFrame([(1, "B", "n1", "z", None, "s", 0), (2, "A", "n2", "y", None, "s", 1), (3, "A", "n3", None, "short", "s", 1), (4, "A", "n4", "a", None, "s", None)], "id int, rto string, native_id string, canonical_name string, short_title string, status string, is_open int")
    refs = spark.createDataFrame([(2, "u", 5), (2, "v", None)], "issue_id int, ref_url string, matched_document_id int")
    assert [(r["id"], r["name"], r["is_open"], r["total_refs"], r["matched_refs"]) for r in linking.issues_with_reference_counts(issues, refs).collect()] == [(3, "short", True, 0, 0), (2, "y", True, 2, 1), (1, "z", False, 0, 0), (4, "a", None, 0, 0)]


def test_missing_types_are_documents(spark):
    rows = [(1, 1, "PJM", datetime.date(2024, 1, 1), None, None, "s"), (2, 2, "SPP", datetime.date(2024, 1, 2), "", [], "s"), (3, 3, "SPP", datetime.date(2024, 1, 2), "report", [], "s"), (4, 4, None, datetime.date(2024, 1, 3), "document", ["x"], "")]
    docs = spark.createDataFrame(rows, "id int, event_id int, rto string, event_date date, doc_type string, topics array<string>, ai_summary string")
    assert sorted((r["id"], r["related_id"], r["score"]) for r in linking.related_documents(docs).collect()) == [(1, 2, 4), (2, 1, 4), (4, 1, 4), (4, 2, 4)]


def test_evidence_in_text_with_other_spaces(spark):
    e = F.array(F.struct(F.lit("c").alias("claim"), F.col("q").alias("quote")))
    rows = [("a b", "x a\u2009b y"), ("a b", "a\u3000\u2028b"), ("a-b", "a\u2013b"), ("ab", "a\u200bb"), ("a b", "a\x1cb"), ("a b", "a.b"), ("\u2003", "a b")]
    got = one(spark, rows, "q string, t string", F.get(screening.verify_evidence(e, F.col("t")), F.lit(0))["verified"])
    assert [r[0] for r in got] == [True, True, True, True, True, False, False]


def test_lanes_first_fit(spark):
    import random

    rng = random.Random(1)
    rows = [(i, datetime.date(2024, 1, 1 + i % 5), rng.choice([None, *range(480, 700, 15)]), rng.choice([None, 600, 720, 500])) for i in range(300)]
    got = {r["id"]: (r["lane"], r["lanes"]) for r in analytics.week_lanes(spark.createDataFrame(rows, "id int, meeting_date date, start_min int, end_min int")).collect()}
    want = {}
    for day in {r[1] for r in rows}:
        ends, lanes = [], {}
        for start, i, end in sorted((s, i, e if e is not None and e > s else s + 60) for i, d, s, e in rows if d == day and s is not None):
            lane = next((k for k, e in enumerate(ends) if e <= start), len(ends))
            ends[lane:] = [end] + ends[lane + 1 :] if lane < len(ends) else [end]
            lanes[i] = lane
        want |= {i: (lane, len(ends)) for i, lane in lanes.items()}
    assert got == want
