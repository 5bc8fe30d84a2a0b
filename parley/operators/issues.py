"""Issue rows, their action histories and timelines from landed pages: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import squeeze, unescape, without_tags
from .payloads import first_per

#: Class prefixes of an issue row and the field each one sets; statuses that end an issue.
#: They must equal the original system's for right results.
ROW_CLASSES = {"optisssts-": "status", "optstkhldprst-": "stakeholder_phase", "optcmt-": "committee_owner"}
ENDED = ["approved", "rejected", "withdrawn", "implemented"]
PROCESS_PAGE = "https://stakeholdercenter.caiso.com/RecurringStakeholderProcesses/"
INITIATIVES = "array<struct<InitiativeId string, LinkTitle string, Title string, DisplayTitle string, ShortTitle string, Status string, Phase string, EIMCategories string, StageA string, StageB string, StageC string, StageD string>>"


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _bare(markup: Column) -> Column:
    return squeeze(unescape(without_tags(markup)))


def us_date(text: Column) -> Column:
    """The date of a whole text such as 05/29/2026, May 29, 2026 or Aug 29, 2026."""
    t = F.trim(text)
    read = lambda shape, form: F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(form)).cast("date")
    return F.coalesce(read(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), read(r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"), read(r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"))


def issue_rows_from_classes(pages: DataFrame, site: str = "https://www.pjm.com") -> DataFrame:
    """Issue stubs of table rows whose fields stand in CSS classes ("~" for a space); rows without id or link go. pages: html."""
    row = pages.select(F.explode(F.split("html", r"(?i)(?=<tr\b)")).alias("row"))
    attr = lambda name: F.regexp_extract("row", rf"(?is)^<tr\b[^>]*\b{name}=\"([^\"]*)\"", 1)
    row = row.withColumns({"classes": F.split(F.trim(attr("class")), r"\s+"), "native_id": F.lower(attr("data-id"))}).where(F.array_contains("classes", "item-row"))

    def tail(prefix: str) -> Column:
        hits = F.filter("classes", lambda c: c.startswith(prefix))
        return F.substr(F.get(hits, F.size(hits) - 1), F.lit(len(prefix) + 1))

    cell = lambda name: F.regexp_extract("row", rf"(?is)<td\b[^>]*\b{name}\b[^>]*>(.*?)</td>", 1)
    name, owner = cell("issue-name-col"), cell("issue-owner-col")
    href = F.regexp_extract(name, r"(?is)<a\b[^>]*\bhref=\"([^\"]+)\"", 1)
    url = F.when(href.startswith("http"), href).when(href != "", F.concat(F.lit(site + "/"), F.regexp_replace(href, "^/+", "")))
    label = F.coalesce(_filled(F.regexp_extract(owner, r"(?is)<a\b[^>]*\btitle=\"([^\"]*)\"", 1)), _filled(_bare(owner)))
    out = row.select(
        "native_id", *[F.translate(tail(p), "~", " ").alias(f) for p, f in ROW_CLASSES.items()], label.alias("committee_owner_label"), (tail("selopncls-") == "open").alias("is_open"),
        tail("selannualyear-").try_cast("int").alias("annual_plan_year"), _filled(_bare(name)).alias("canonical_name"), url.alias("url"),
    )
    return out.where("native_id <> '' AND url IS NOT NULL")


def issue_rows_from_json(pages: DataFrame) -> DataFrame:
    """Issue stubs of the JSON list that a page's script assigns; /Date()/ values read as null, the text "None" too. pages: html."""
    raw = F.regexp_extract("html", r"(?s)var\s+currInitiatives\s*=\s*(\[.*?\]);", 1)
    item = pages.select(F.inline(F.from_json(F.regexp_replace(raw, r'"\\?/Date\([^)]+\)\\?/"', "null"), INITIATIVES)))
    slug = F.trim(F.replace(F.regexp_replace(F.trim("LinkTitle"), "/+$", ""), F.lit("%20"), F.lit("")))
    clean = lambda c: F.when((F.col(c) != "None") & (F.trim(c) != ""), F.col(c))
    return item.where(slug != "").select(
        F.lower(F.coalesce("InitiativeId", F.lit(""))).alias("native_id"), F.coalesce(_filled(F.col("Title")), "DisplayTitle").alias("canonical_name"), F.col("ShortTitle").alias("short_title"),
        F.concat(F.lit(PROCESS_PAGE), slug).alias("url"), F.col("Status").alias("status"), F.col("Phase").try_cast("int").alias("phase"), clean("EIMCategories").alias("eim_categories"),
        *[clean(f"Stage{s}").alias(f"stage_{s.lower()}") for s in "ABCD"],
    )


def issue_rows_from_list(pages: DataFrame) -> DataFrame:
    """Issue stubs of list rows, the first of an id per page; the third cell is a committee or the date of approval. pages: page_id, html."""
    row = pages.select("page_id", F.posexplode(F.split("html", r'(?=<tr\s+class="rrtr)')).alias("at", "row"))
    shape = r'(?s)^<tr\s+class="rrtr[^"]*"\s*>\s*<td><a href="/mktrules/issues/([A-Z]+\d+)">[^<]*</a></td>\s*<td>(.*?)</td>\s*<td>(.*?)</td>'
    part = lambda i: F.regexp_extract("row", shape, i)
    stub = first_per(row.withColumn("native_id", part(1)).where("native_id <> ''"), ["page_id", "native_id"], ["at"])
    third = _bare(part(3))
    day = us_date(third)
    return stub.select("page_id", "native_id", _filled(_bare(part(2))).alias("title"), F.when(day.isNull(), _filled(third)).alias("committee_owner"), day.alias("completion_date"))


def issue_action_history(issues: DataFrame, actions: DataFrame, key_docs: DataFrame) -> DataFrame:
    """Each issue with its milestones as lines, references, openness and date of completion.

    issues: native_id, status, date_posted; actions: native_id, pos, url, date_text, body, action; key_docs: native_id, pos,
    url, title. Milestones go by date, then label; a reference keeps its first title, actions before documents. One issue's
    actions are one array: its page lists them all.
    """
    posted = issues.select("native_id", us_date(F.col("date_posted")).alias("day"), F.lit("Posted").alias("label"))
    text = F.concat(F.when(F.trim("body") != "", F.concat("body", F.lit(": "))).otherwise(F.lit("")), "action")
    acted = actions.where("trim(action) <> ''").select("native_id", us_date(F.col("date_text")).alias("day"), text.alias("label"))
    steps = posted.unionByName(acted).where("day IS NOT NULL").groupBy("native_id").agg(F.array_sort(F.collect_list(F.struct("day", "label"))).alias("steps"))
    a = actions.select("native_id", F.lit(0).alias("rank"), "pos", "url", F.concat("native_id", F.lit(": "), F.coalesce(_filled(F.col("action")), F.lit("action"))).alias("title"))
    d = key_docs.select("native_id", F.lit(1).alias("rank"), "pos", "url", _filled(F.trim("title")).alias("title"))
    refs = first_per(a.unionByName(d).where("url <> ''"), ["native_id", "url"], ["rank", "pos", "title"]).groupBy("native_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "url", "title"))).alias("refs"))
    ended = F.lower(F.trim(F.coalesce("status", F.lit("")))).rlike("^(" + "|".join(ENDED) + ")")
    told = us_date(F.regexp_extract(F.coalesce("status", F.lit("")), r"(?i)\bon\s+([\d/]+)", 1))
    line = lambda s: F.concat(F.date_format(s["day"], "MMMM d, yyyy"), F.lit(" "), s["label"])
    return issues.join(steps, "native_id", "left").join(refs, "native_id", "left").select(
        "native_id", _filled(F.trim("status")).alias("status"), F.when(ended, 0).otherwise(1).alias("is_open"), us_date(F.col("date_posted")).alias("initiated_date"),
        F.when(ended, F.coalesce(told, F.get("steps", F.size("steps") - 1)["day"])).alias("actual_completion_date"), F.array_join(F.transform("steps", line), "\n").alias("stage_a"),
        F.when(ended, "Completed").alias("stage_d"), F.transform("refs", lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"))).alias("references"),
    )


def initiative_timeline(issues: DataFrame, milestones: DataFrame, today: str) -> DataFrame:
    """Start, end, inner dates and progress of each issue: by milestones for CAISO and ERCOT, by dated fields elsewhere.

    issues: issue_id, rto, status, stage_d, initiated_date, work_begins_date, target_completion_date, actual_completion_date;
    milestones: issue_id, milestone_date, one per date. Milestones need two dates, else there is no bar (all null) and the end
    is never overdue. An inner date shows strictly between 3 and 97 percent.
    """
    m = milestones.groupBy("issue_id").agg(F.array_sort(F.collect_list("milestone_date")).alias("days"))
    day, staged = F.lit(today).cast("date"), F.col("rto").isin("CAISO", "ERCOT")
    rows = issues.join(m, "issue_id", "left")
    enough = F.coalesce(F.size("days") >= 2, F.lit(False))
    done = F.when(staged, F.coalesce(F.col("stage_d") == "Completed", F.lit(False)) | F.coalesce(F.col("status") == "Completed", F.lit(False))).otherwise(F.col("actual_completion_date").isNotNull())
    start = F.when(staged & enough, F.get("days", F.lit(0))).when(~staged, F.col("initiated_date"))
    end = F.when(staged & enough, F.get("days", F.size("days") - 1)).when(~staged, F.coalesce("actual_completion_date", "target_completion_date"))
    inner = F.when(staged & enough, F.slice("days", F.lit(2), F.size("days") - 2)).when(~staged, F.array_compact(F.array("work_begins_date")))
    rows = rows.withColumns({"start_date": start, "end_date": end, "inner": inner, "is_complete": done})
    # a span of no days is an instant: whatever lies after its start has passed it
    share = lambda d: F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.datediff(d, F.col("start_date")) / F.greatest(F.datediff("end_date", "start_date").cast("double"), F.lit(1e-9))))
    bar = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    return rows.select(
        "issue_id", "rto", "start_date", "end_date", "is_complete", F.when(bar, ~staged & ~F.col("is_complete") & (day > F.col("end_date"))).alias("is_overdue"),
        F.when(bar, F.when(F.col("is_complete"), 100.0).otherwise(share(day))).alias("filled_pct"), F.when(bar, F.filter("inner", lambda d: (share(d) > 3) & (share(d) < 97))).alias("midpoints"),
    )
