"""Column functions on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from parley.functions import dates, text


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("3.10.2026", "2026-03-10"), ("TBD", None), ("2026/06/03", "2026-06-03"), ("Monday, Jun 15, 2026", "2026-06-15"), ("April 16, 2026", "2026-04-16"), ("2026-01-00", None), (None, None)])
def test_any_date(spark, raw, want):
    got = one(spark, dates.parse_any_date(F.lit(raw).cast("string")))
    assert got == (want and datetime.date.fromisoformat(want))


@pytest.mark.parametrize("raw, want", [("a-20260127-28-b", ["2026-01-27", "2026-01-28"]), ("x-202601006", []), ("20260130-0202", ["2026-01-30", "2026-01-31", "2026-02-01", "2026-02-02"])])
def test_compact_dates(spark, raw, want):
    assert [d.isoformat() for d in one(spark, dates.expand_compact_dates(F.lit(raw)))] == want


@pytest.mark.parametrize("raw, want", [("9:00 AM - 12:00 PM", (540, 720)), ("1:00 p.m. - 4:00 p.m.", (780, 960)), ("4:00 PM", (960, None)), ("3:00 PM CT", (900, None)), (None, (None, None)), ("TBD", (None, None))])
def test_meeting_time(spark, raw, want):
    assert tuple(one(spark, dates.parse_meeting_time(F.lit(raw).cast("string")))) == want


def test_titles_and_entities(spark):
    name = "20260416-item-05---pjm-reliability-backstop-procurement-design.pdf"
    assert one(spark, text.title_from_filename(F.lit(name))) == "Item 05 – PJM Reliability Backstop Procurement Design"
    for raw, want in (("PJM Interconnection, L.L.C.", "PJM"), ("PJM", "PJM"), ("Constellation Energy Generation, LLC", "Constellation"), ("Foo Bar (FB)", "Foo Bar"), ("", None)):
        assert one(spark, text.normalize_entity(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("hydropower", True), ("pumped-storage", True), ("PSH", True), ("run of river", True), ("hydrogen", False), ("hydrocarbon", False), (None, False)])
def test_subject_term(spark, raw, want):
    assert one(spark, text.source_names_term(F.lit(raw).cast("string"))) is want


def test_excerpt_keeps_both_ends(spark):
    got = one(spark, text.build_excerpt(F.lit("a" * 30000 + "b" * 30000)))
    assert got["elided"] and got["excerpt"].startswith("a" * 28800) and got["excerpt"].endswith("b" * 19200)
    assert one(spark, text.build_excerpt(F.lit(None).cast("string"))) == ("", False)


def test_typography(spark):
    assert one(spark, text.fold_typography(F.lit("Appendix V – Solar​…"))) == "Appendix V - Solar..."
