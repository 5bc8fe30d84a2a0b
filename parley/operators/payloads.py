"""Landed payloads made into meeting rows: built-in expressions only, no crawling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_any_date
from ..functions.text import classify_document_by_source, committee_of_subtype
from ..sources.feeds import kept

CAISO_SITE = "https://www.caiso.com"
CAISO_EVENTS = "array<struct<id string, title string, hidden boolean, isoArchived boolean, format array<string>, `start` string, `end` string, allDay boolean, description string, url string, calendarTopics struct<titles array<string>>, calendarCategories struct<titles array<string>>, calendarTopicsUrl array<string>>>"
MISO_EVENTS = "array<struct<contentGuid string, linkURL string, eventCanceled boolean, meetingDate string, name string, startDate string, endDate string, hostLocation string, entityReferenceList array<struct<url string, text string>>>>"
ISONE_EVENTS = "array<struct<event_id string, event_title string, cancelled_flag string, deleted_flag string, event_type struct<name string>, event_subtypes array<struct<name string>>, event_start_date_gmt_str string, location string, committee_link string>>"
TREE_NODE = "struct<type string, label string, data struct<url string, filename string, title string, isoDatePosted string, siteInfos array<struct<siteId string, url string>>>, children array<string>>"
#: Titles of press items that are no market news. They must equal the original system's for right results.
SKIPPED_TITLES = [
    r"\bEnvironmental Impact Statement\b", r"\bDraft Environmental\b", r"\bNotice of Availability\b", r"\bNotice of Schedule\b.*(Pipeline|Expansion Project)", r"\bPipeline Project\b",
    r"\bExpansion Project\b", r"\bHydroelectric License\b", r"\bLicense Application\b", r"\bLiquefaction\b", r"\bLNG Project\b",
]


def _wall(text: Column) -> Column:
    """The wall time of an ISO text's first 19 characters, null where it is none."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def _clock(at: Column) -> Column:
    return F.date_format(at.cast("timestamp"), "h:mm a")


def _some(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def normalize_caiso_events(payloads: DataFrame, first: str, last: str) -> DataFrame:
    """One meeting per visible calendar event of the window; payloads: payload (a JSON array of events)."""
    e = payloads.select(F.inline(F.from_json("payload", CAISO_EVENTS)))
    day = F.when(F.substring("start", 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring("start", 1, 10))
    flagged = F.coalesce("hidden", F.lit(False)) | F.coalesce("isoArchived", F.lit(False))
    holiday = F.coalesce(F.exists("format", lambda f: F.lower(f) == "holiday"), F.lit(False))
    began, ended = _clock(_wall(F.col("start"))), _clock(_wall(F.col("end")))
    time = F.when(~F.coalesce("allDay", F.lit(False)) & began.isNotNull(), F.concat(F.concat_ws(" - ", began, ended), F.lit(" PT")))
    linked = F.regexp_extract(F.coalesce("description", F.lit("")), r"https://stakeholdercenter\.caiso\.com/StakeholderInitiatives/[^\s\"'<>]+", 0)
    topic = _some(F.get("calendarTopicsUrl", F.lit(0)))
    materials = F.when(linked != "", linked).otherwise(F.when(topic.startswith("http"), topic).otherwise(F.concat(F.lit(CAISO_SITE), topic)))
    return e.where(~flagged & ~holiday & day.between(first, last)).select(
        F.col("id").alias("event_id"), F.coalesce(_some(F.col("title")), F.lit("CAISO Meeting")).alias("title"), day.try_cast("date").alias("meeting_date"), time.alias("meeting_time"),
        F.coalesce(F.get("calendarTopics.titles", F.lit(0)), F.get("calendarCategories.titles", F.lit(0))).alias("committee"), F.col("url").alias("detail_url"), materials.alias("materials_url"),
    )


def normalize_miso_events(payloads: DataFrame, first: str, last: str, site: str = "https://www.misoenergy.org") -> DataFrame:
    """One meeting per event of overlapping month pages, the last page's version; payloads: seq, payload.

    committees and their guids (hyphenated) come from the linked entities; times go from UTC to Central, midnight being no time.
    """
    e = payloads.select("seq", F.inline(F.from_json("payload", MISO_EVENTS)))
    key = F.coalesce(_some(F.col("contentGuid")), _some(F.col("linkURL")))
    rows = e.withColumn("guid", key).where("guid IS NOT NULL")
    held = [c for c in rows.columns if c not in ("seq", "guid")]
    one = rows.groupBy("guid").agg(F.max_by(F.struct(*held), "seq").alias("e")).select("guid", "e.*")
    day = F.substring("meetingDate", 1, 10)
    hexed = lambda r: F.lower(F.regexp_extract(F.coalesce(r["url"], F.lit("")), r"([0-9A-Fa-f]{32})", 1))
    refs = F.filter(F.coalesce("entityReferenceList", F.array().cast("array<struct<url string, text string>>")), lambda r: hexed(r) != "")
    central = lambda c: F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), _wall(F.col(c)))
    start, end = central("startDate"), central("endDate")
    midnight = (F.hour(start) == 0) & (F.minute(start) == 0)
    link = F.when(F.col("linkURL").startswith("/"), F.concat(F.lit(site), "linkURL")).otherwise(_some(F.col("linkURL")))
    return one.where(~F.coalesce("eventCanceled", F.lit(False)) & day.between(first, last)).select(
        "guid", F.coalesce(_some(F.col("name")), F.lit("MISO meeting")).alias("title"), day.try_cast("date").alias("meeting_date"),
        F.when(~midnight, F.concat_ws(" - ", _clock(start), F.when(end > start, _clock(end)))).alias("meeting_time"),
        _some(F.get(refs, F.lit(0))["text"]).alias("committee"), _some(F.col("hostLocation")).alias("location"), link.alias("detail_url"),
        F.transform(refs, lambda r: F.regexp_replace(hexed(r), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).alias("committee_guids"),
    )


def normalize_isone_events(payloads: DataFrame, kinds: tuple[str, ...] = ("Meetings",), site: str = "https://www.iso-ne.com") -> DataFrame:
    """One meeting per event of the kept kinds that is neither cancelled nor deleted and has an id, a start and a committee."""
    e = payloads.select(F.inline(F.from_json("payload", ISONE_EVENTS)))
    gone = F.coalesce(F.col("cancelled_flag") == "Y", F.lit(False)) | F.coalesce(F.col("deleted_flag") == "Y", F.lit(False))
    title, at, key = F.coalesce(F.when(F.col("event_title") != "", F.col("event_title")), F.lit("(untitled)")), _wall(F.col("event_start_date_gmt_str")), _some(F.col("event_id"))
    committee = committee_of_subtype(F.get("event_subtypes", F.lit(0))["name"], title)
    out = e.where(~gone & F.col("event_type.name").isin(*kinds)).select(
        key.alias("event_id"), F.trim(title).alias("title"), at.cast("date").alias("meeting_date"), _clock(at).alias("meeting_time"), committee.alias("committee"), _some(F.col("location")).alias("location"),
        F.concat(F.lit(f"{site}/calendar?eventId="), key).alias("detail_url"), F.when(F.col("committee_link") != "", F.col("committee_link")).alias("materials_url"),
    )
    return out.where("event_id IS NOT NULL AND meeting_date IS NOT NULL AND committee IS NOT NULL")


def flatten_document_tree(trees: DataFrame, step: int = 12, site: str = CAISO_SITE) -> DataFrame:
    """event_id, download_url, doc_type, title, filename, posted_date of the documents of a folder tree, the first of each address.

    trees: event_id, tree (JSON nodes, or such JSON as a JSON string). Every level is one narrow step that splits nodes from
    their children; `step` levels make one plan. Nodes that still have children then go into the next one, from the shared
    folder, until none are left, so trees may be of any depth that Spark's JSON parser reads (some 500 levels). Only the last
    step, the first of each address in walking order, shuffles. Folders are no documents; a document may have children;
    videos are skipped. Unreadable trees give no rows.
    """
    inner = F.get(F.from_json(F.concat(F.lit("["), "tree", F.lit("]")), "array<string>"), F.lit(0))
    rows = trees.where("tree IS NOT NULL").select("event_id", F.posexplode(F.from_json(inner, "array<string>")).alias("at", "node")).select("event_id", F.array("at").alias("path"), "node", F.lit(True).alias("fresh"))
    children = F.coalesce(F.from_json("node", "struct<children array<string>>")["children"], F.array().cast("array<string>"))
    whole = None
    while True:
        for _ in range(step):
            below = F.when(F.col("fresh"), children).otherwise(F.array().cast("array<string>"))
            nodes = F.concat(F.array(F.struct("path", "node", F.lit(False).alias("fresh"))), F.transform(below, lambda c, i: F.struct(F.concat("path", F.array(i)).alias("path"), c.alias("node"), F.lit(True).alias("fresh"))))
            rows = rows.select("event_id", F.inline(nodes))
        rows = kept(rows.withColumn("fresh", F.col("fresh") & (F.size(children) > 0)), "tree_nodes")
        done = rows.where("NOT fresh").select("event_id", "path", "node")
        whole = done if whole is None else whole.unionByName(done)
        rows = rows.where("fresh")
        if rows.isEmpty():
            break
    rows = whole
    n = rows.select("event_id", "path", F.from_json("node", TREE_NODE).alias("n")).where(F.coalesce(F.lower("n.type"), F.lit("")) != "folder")
    copies = F.filter("n.data.siteInfos", lambda c: c["url"] != "")
    raw = F.coalesce(_some(F.col("n.data.url")), F.get(F.filter(copies, lambda c: c["siteId"] == "1"), F.lit(0))["url"], F.get(copies, F.lit(0))["url"])
    url = F.when(raw.startswith("http"), raw).otherwise(F.concat(F.lit(site + "/"), F.regexp_replace(raw, "^/+", "")))
    docs = n.withColumn("download_url", url).where(~F.lower("download_url").contains("youtu"))
    one = first_per(docs, ["event_id", "download_url"], ["path"])
    tail = F.regexp_extract("download_url", r"([^/]*)$", 1)
    name = F.coalesce(_some(F.col("n.data.filename")), F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail))
    out = one.withColumn("filename", name).withColumn("title", F.coalesce(_some(F.col("n.data.title")), _some(F.col("n.label")), "filename"))
    posted = F.when(F.length("n.data.isoDatePosted") >= 10, F.substring("n.data.isoDatePosted", 1, 10))
    return out.select("event_id", "download_url", classify_document_by_source(F.lit("CAISO"), F.lit(None).cast("string"), F.col("filename"), F.col("title")).alias("doc_type"), "title", "filename", posted.alias("posted_date"))


def parse_ical_events(calendars: DataFrame) -> DataFrame:
    """calendar_id, event_date, summary, meeting_time of every timed event; all-day ones are skipped."""
    blocks = calendars.select("calendar_id", F.posexplode(F.split("text", "BEGIN:VEVENT")).alias("at", "block")).where("at > 0")
    value = lambda name, form: F.regexp_extract("block", rf"(?m)^{name}[^:\r\n]*:{form}", 1)
    at = lambda name: F.try_to_timestamp(value(name, r"(\d{8}T\d{4})"), F.lit("yyyyMMdd'T'HHmm"))
    start, end = at("DTSTART"), at("DTEND")
    return blocks.where(start.isNotNull()).select("calendar_id", start.cast("date").alias("event_date"), F.trim(value("SUMMARY", r"([^\r\n]*)")).alias("summary"), F.concat_ws(" - ", _clock(start), _clock(end)).alias("meeting_time"))


def filter_press_items(items: DataFrame, today: str, lookback_days: int) -> DataFrame:
    """Press items of the last three lookbacks whose title is not skipped, flagged relevant, text led by its docket number."""
    day = parse_any_date(F.col("date_text"))
    docket = F.regexp_extract(F.coalesce("body", F.lit("")), r"(?i)\bdocket nos?\.?\s*([A-Z]{2}\d{2}-\d+(?:-\d+)?)", 1)
    skipped = F.coalesce("title", F.lit("")).rlike("(?i)" + "|".join(SKIPPED_TITLES))
    kept = items.withColumns({"meeting_date": day, "docket": F.when(docket != "", docket)}).where((F.col("meeting_date") >= F.date_sub(F.lit(today).cast("date"), 3 * lookback_days)) & ~skipped)
    return kept.withColumn("text", F.when(F.col("docket").isNull(), F.col("body")).otherwise(F.concat(F.lit("[Docket: "), "docket", F.lit("] "), "body"))).withColumn("hydro_relevant", F.lit(1))


def initiative_milestones(issues: DataFrame, key: str = "issue_id") -> DataFrame:
    """One row per (issue, date) of the stages' dated lines, labels joined in stage and line order."""
    stages = issues.select(key, F.posexplode(F.array("stage_a", "stage_b", "stage_c", "stage_d")).alias("stage", "raw")).where("raw <> 'Completed'")
    lines = stages.select(key, "stage", F.posexplode(F.split("raw", r"\r?\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    form = r"^([A-Z][a-z]{2,8}\.?\s+\d{1,2},?\s+\d{4})\*?\s+(.*)$"
    written = F.regexp_replace(F.regexp_extract("text", form, 1), r"(\d{1,2}),?\s+(\d{4})$", "$1, $2")
    dated = lines.select(key, "stage", "line", parse_any_date(written).alias("milestone_date"), F.regexp_extract("text", form, 2).alias("label")).where("milestone_date IS NOT NULL")
    found = F.array_sort(F.collect_list(F.when(F.col("label") != "", F.struct("stage", "line", "label"))))
    return dated.groupBy(key, "milestone_date").agg(F.array_join(F.transform(found, lambda x: x["label"]), " · ").alias("label"))


def merge_initiative_sources(facets: DataFrame, page: DataFrame) -> DataFrame:
    """Names known from facets and from the page of active ones, one row per name (case aside).

    facets: name; page: name, slug. A name on the page is Active under its slug, any other Implemented under one made of it.
    """
    f = facets.where(F.trim("name") != "").groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("facet_name"))
    p = page.where(F.trim("name") != "").groupBy(F.lower("name").alias("k")).agg(F.min_by("name", F.struct("slug", "name")).alias("page_name"), F.min("slug").alias("slug"), F.lit(True).alias("listed"))
    name = F.coalesce("page_name", "facet_name")
    made = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return f.join(p, "k", "full_outer").select(F.coalesce("slug", made).alias("native_id"), name.alias("name"), F.when(F.col("listed"), "Active").otherwise("Implemented").alias("status"))


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, nulls being equal."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
