"""Registered queries: landed payloads, links of landed rows, readers and writers, the incremental fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, matching, payloads
from ..sources import feeds
from ..streaming import upserts
from .calendar import ENTITY_SQL, STRIP_SQL
from .registry import query
from .store import _CALENDAR, _CORPUS, _ISSUE_LIST, _LINES, _PEOPLE, corpus, feed, people, resolved, shown_calendar

_GUID = "lower(concat('0a1b2c3d', lpad(cast(user_id % 9 AS string), 4, '0'), 'aaaabbbb', lpad(cast(user_id % 7 AS string), 12, '0')))"
_TEXT_GUID = "concat('0a1b2c3d-', lpad(cast(user_id % 9 AS string), 4, '0'), '-aaaa-bbbb-', lpad(cast(user_id % 7 AS string), 12, '0'))"
_ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
_LATER = "date_format(ts + interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss\")"


@query("""SELECT cast(event_id AS varchar) AS event_id, CASE WHEN event_id % 11 = 0 THEN 'CAISO Meeting' ELSE event_type END AS title, cast(ts AS date) AS meeting_date,
CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%-I:%M %p') || CASE WHEN event_id % 2 = 0 THEN ' - ' || strftime(ts + INTERVAL 1 HOUR, '%-I:%M %p') ELSE '' END || ' PT' END AS meeting_time,
CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 5 = 0 THEN 'General' END AS committee,
CASE event_id % 4 WHEN 0 THEN 'https://stakeholdercenter.caiso.com/StakeholderInitiatives/X' || user_id WHEN 1 THEN 'https://www.caiso.com/topic/' || user_id END AS materials_url
FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND cast(ts AS date) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def normalize_caiso_events(t):
    event = f"""struct(cast(event_id AS string) AS id, CASE WHEN event_id % 11 <> 0 THEN concat(' ', event_type, ' ') END AS title, event_id % 13 = 0 AS hidden, array(CASE WHEN event_id % 17 = 0 THEN 'Holiday' ELSE 'Meeting' END) AS format,
    {_ISO} AS start, CASE WHEN event_id % 2 = 0 THEN {_LATER} END AS `end`, event_id % 7 = 0 AS allDay, CASE WHEN event_id % 4 = 0 THEN concat('<a href="https://stakeholdercenter.caiso.com/StakeholderInitiatives/X', user_id, '">page</a>') END AS description,
    struct(CASE WHEN event_id % 3 = 0 THEN array(event_type) ELSE array() END AS titles) AS calendarTopics, struct(CASE WHEN event_id % 5 = 0 THEN array('General') END AS titles) AS calendarCategories,
    CASE WHEN event_id % 4 <= 1 THEN array(concat('/topic/', user_id)) END AS calendarTopicsUrl)"""
    landed = t.base("events").select(F.expr(f"concat('[', to_json({event}), ']')").alias("payload"))
    return payloads.normalize_caiso_events(landed, "2024-01-05", "2024-01-25").drop("detail_url")


@query(f"""WITH last AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id),
placed AS (SELECT *, timezone('America/Chicago', timezone('UTC', date_trunc('second', ts))) AS c FROM last)
SELECT concat('G', cast(user_id AS string)) AS guid, event_type AS title, cast(ts AS date) AS meeting_date,
CASE WHEN hour(c) + minute(c) > 0 THEN strftime(c, '%-I:%M %p') || CASE WHEN event_id % 2 = 0 THEN ' - ' || strftime(c + INTERVAL 1 HOUR, '%-I:%M %p') ELSE '' END END AS meeting_time,
CASE WHEN event_id % 3 <> 0 THEN event_type END AS committee, CASE WHEN event_id % 3 <> 0 THEN {_TEXT_GUID} ELSE '' END AS guids FROM placed WHERE event_id % 10 <> 0""")
def normalize_miso_events(t):
    event = f"""struct(concat('G', user_id) AS contentGuid, event_id % 10 = 0 AS eventCanceled, {_ISO} AS meetingDate, event_type AS name, concat({_ISO}, '+00:00') AS startDate,
    CASE WHEN event_id % 2 = 0 THEN concat({_LATER}, '+00:00') END AS endDate, array(CASE WHEN event_id % 3 <> 0 THEN struct(concat('~/link/', {_GUID}, '.aspx') AS url, event_type AS text) ELSE struct('/plain' AS url, 'Other' AS text) END) AS entityReferenceList)"""
    landed = t.base("events").select(F.col("event_id").alias("seq"), F.expr(f"concat('[', to_json({event}), ']')").alias("payload"))
    return payloads.normalize_miso_events(landed, "2024-01-01", "2024-12-31").select("guid", "title", "meeting_date", "meeting_time", "committee", F.array_join("committee_guids", ",").alias("guids"))


@query("SELECT event_id AS calendar_id, cast(ts AS date) AS event_date, event_type || ' group' AS summary, strftime(ts, '%-I:%M %p') || CASE WHEN event_id % 2 = 0 THEN ' - ' || strftime(ts + INTERVAL 1 HOUR, '%-I:%M %p') ELSE '' END AS meeting_time FROM events")
def parse_ical_events(t):
    form = "\"yyyyMMdd'T'HHmmss\""
    text = f"""concat('BEGIN:VCALENDAR\\r\\nBEGIN:VEVENT\\r\\nDTSTART;TZID=America/New_York:', date_format(ts, {form}), CASE WHEN event_id % 2 = 0 THEN concat('\\r\\nDTEND;TZID=America/New_York:', date_format(ts + interval 1 hour, {form})) ELSE '' END,
    '\\r\\nSUMMARY:', event_type, ' group \\r\\nEND:VEVENT\\r\\nBEGIN:VEVENT\\r\\nDTSTART;VALUE=DATE:', date_format(ts, 'yyyyMMdd'), '\\r\\nSUMMARY:Closed\\r\\nEND:VEVENT\\r\\nEND:VCALENDAR')"""
    return payloads.parse_ical_events(t.base("events").select(F.col("event_id").alias("calendar_id"), F.expr(text).alias("text")))


_PRESS = "CASE o_custkey % 5 WHEN 0 THEN 'Order on Tariff Revisions' WHEN 1 THEN 'Notice of Schedule for the Alpha Pipeline' WHEN 2 THEN 'draft environmental review' WHEN 3 THEN 'Order on Rehearing' ELSE 'Hydroelectric License Issued' END"


@query(f"""SELECT o_orderkey, {_PRESS} AS title, cast(o_orderdate AS date) AS meeting_date, CASE WHEN o_orderkey % 3 = 0 THEN concat('ER24-', cast(o_custkey AS string), '-000') END AS docket,
CASE WHEN o_orderkey % 3 = 0 THEN concat('[Docket: ER24-', cast(o_custkey AS string), '-000] In Docket No. ER24-', cast(o_custkey AS string), '-000, approved') ELSE 'No number' END AS text, 1 AS hydro_relevant
FROM orders WHERE o_custkey % 5 IN (0, 3) AND o_orderkey % 7 <> 0 AND cast(o_orderdate AS date) >= DATE '1995-06-17' - 600""")
def filter_press_items(t):
    body = "CASE WHEN o_orderkey % 3 = 0 THEN concat('In Docket No. ER24-', cast(o_custkey AS string), '-000, approved') ELSE 'No number' END"
    day = "CASE WHEN o_orderkey % 7 = 0 THEN 'TBD' ELSE date_format(o_orderdate, 'MMMM d, yyyy') END"
    items = t.base("orders").select("o_orderkey", F.expr(_PRESS).alias("title"), F.expr(body).alias("body"), F.expr(day).alias("date_text"))
    return payloads.filter_press_items(items, "1995-06-17", 200).drop("body", "date_text")


@query("""WITH d AS (SELECT p_partkey AS issue_id, p_size, DATE '2024-01-01' + p_size AS d1, DATE '2024-01-01' + cast(p_size + p_partkey % 3 AS integer) AS d2 FROM part),
rows AS (SELECT issue_id, d1 AS milestone_date, 'Draft paper' AS label, 0 AS k FROM d WHERE p_size % 3 <> 0 UNION ALL SELECT issue_id, d2, 'Comments due', 1 FROM d WHERE p_size % 3 <> 0 UNION ALL SELECT issue_id, DATE '2023-09-26', 'Final', 2 FROM d WHERE issue_id % 2 = 0)
SELECT issue_id, milestone_date, string_agg(label, ' · ' ORDER BY k) AS label FROM rows GROUP BY 1, 2""")
def initiative_milestones(t):
    a = "CASE WHEN p_size % 3 = 0 THEN 'Completed' ELSE concat(date_format(date_add(date'2024-01-01', p_size), 'MMMM d, yyyy'), ' Draft paper\\n ', date_format(date_add(date'2024-01-01', cast(p_size + p_partkey % 3 AS int)), 'MMM d yyyy'), '* Comments due') END"
    rows = t.base("part").select(F.col("p_partkey").alias("issue_id"), F.expr(a).alias("stage_a"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'Sep 26, 2023* Final' END").alias("stage_b"), F.lit(None).cast("string").alias("stage_c"), F.lit("To be set").alias("stage_d"))
    return payloads.initiative_milestones(rows)


@query(r"""WITH f AS (SELECT lower(p_name) AS k, min(upper(p_name)) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), p AS (SELECT lower(p_name) AS k, arg_min(p_name, concat('init-', cast(p_partkey AS string))) AS n, min(concat('init-', cast(p_partkey AS string))) AS slug FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT coalesce(p.slug, regexp_replace(regexp_replace(coalesce(p.k, f.k), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS native_id, coalesce(p.n, f.n) AS name, CASE WHEN p.k IS NULL THEN 'Implemented' ELSE 'Active' END AS status FROM f FULL JOIN p ON p.k = f.k""")
def merge_initiative_sources(t):
    part = t.base("part")
    return payloads.merge_initiative_sources(part.where("p_partkey % 3 <> 0").select(F.upper("p_name").alias("name")), part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.concat(F.lit("init-"), F.col("p_partkey").cast("string")).alias("slug")))


@query("""WITH s AS (SELECT DISTINCT matched_meeting_id AS event_id, 0 AS level, issue_id FROM matched_references WHERE matched_meeting_id IS NOT NULL UNION SELECT DISTINCT d.meeting_id, 1, r.issue_id FROM matched_references r JOIN stored_documents d ON d.id = r.matched_document_id),
o AS (SELECT event_id, issue_id, min(level) AS level FROM s GROUP BY 1, 2)
SELECT o.event_id, o.level, i.rto, CASE WHEN i.id % 10 = 0 THEN 'OLD' || i.id ELSE i.native_id END AS native_id, CASE WHEN i.id % 10 <> 0 THEN i.id END AS issue_id, CASE WHEN i.id % 10 = 0 THEN 'stub' ELSE canonical_name END AS canonical_name, CASE WHEN i.id % 10 = 0 THEN 'open' ELSE status END AS status,
CASE WHEN i.id % 10 <> 0 THEN short_title END AS short_title, CASE WHEN i.id % 10 <> 0 THEN is_open END AS is_open, CASE WHEN i.id % 10 <> 0 THEN stakeholder_phase END AS stakeholder_phase, CASE WHEN i.id % 10 <> 0 THEN committee_owner END AS committee_owner, CASE WHEN i.id % 10 <> 0 THEN url END AS url FROM o JOIN issues i ON i.id = o.issue_id""", stored=True)
def hydrate_issues(t):
    refs = resolved(t)
    own = t.issues.select(F.col("id").alias("issue_id"), "rto", F.when(F.col("id") % 10 == 0, F.concat(F.lit("OLD"), F.col("id").cast("string"))).otherwise(F.col("native_id")).alias("native_id"))
    by_meeting = refs.where("matched_meeting_id IS NOT NULL").select(F.col("matched_meeting_id").alias("event_id"), F.lit(0).alias("level"), "issue_id")
    by_document = refs.join(t.stored_documents.select(F.col("id").alias("matched_document_id"), "meeting_id"), "matched_document_id").select(F.col("meeting_id").alias("event_id"), F.lit(1).alias("level"), "issue_id")
    stubs = by_meeting.unionByName(by_document).join(own, "issue_id").select("event_id", "level", F.col("issue_id").alias("pos"), "rto", "native_id", F.lit("stub").alias("canonical_name"), F.lit("open").alias("status"))
    return matching.hydrate_issues(stubs, t.issues)


@query("""WITH k AS (SELECT download_url, rto, cast(id % 50 AS string) AS event_id FROM stored_documents UNION SELECT download_url, rto, cast(id % 50 + 1 AS string) FROM stored_documents WHERE id % 2 = 0)
SELECT DISTINCT m.id AS meeting_id, k.download_url FROM k JOIN meetings m ON m.rto = k.rto AND cast(m.id % 50 AS string) = k.event_id""")
def link_documents_to_events(t):
    keys = "CASE WHEN id % 2 = 0 THEN concat('[{\"event_id\":\"', id % 50, '\"},{\"event_id\":\"', id % 50 + 1, '\"}]') ELSE concat('{\"event_id\":', id % 50, '}') END"
    docs = t.stored_documents.select("download_url", F.col("rto").alias("committee"), F.expr(keys).alias("events"))
    return matching.link_documents_to_events(docs, t.meetings.select("id", F.col("rto").alias("committee"), (F.col("id") % 50).cast("string").alias("event_id")))


@query("""WITH g AS (SELECT id, rto, DATE '2024-01-01' + cast(id % 30 AS integer) AS day FROM stored_documents WHERE id % 4 <> 3)
SELECT DISTINCT m.id AS meeting_id, g.id AS object_id, concat('https://cdn.misoenergy.org/Item%20', cast(g.id AS string), '%20%28a%2Ab%29/x~y', cast(g.id AS string), '.', CASE g.id % 2 WHEN 0 THEN 'pdf' ELSE 'PDF' END) AS download_url FROM meetings m JOIN g ON g.day = m.meeting_date AND (g.rto = m.rto OR m.id % 3 = g.id % 3)""")
def link_materials_by_group_day(t):
    pages = lambda: F.array("rto", F.concat(F.lit("g"), (F.col("id") % 3).cast("string")))
    kind = F.when(F.col("id") % 4 == 3, "Committee Document").when(F.col("id") % 4 == 2, "Both").otherwise("Meeting Material")
    materials = t.stored_documents.select(F.col("id").alias("object_id"), pages().alias("related_guids"), kind.alias("kind"), F.concat(F.lit("Item "), F.col("id").cast("string"), F.lit(" (a*b)/x~y.pdf")).alias("filename"), F.when(F.col("id") % 2 == 0, "pdf").otherwise("PDF").alias("extension"), F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).cast("string"), F.lit("T09:00:00")).alias("meeting_at"))
    return matching.link_materials_by_group_day(t.meetings.select("id", "meeting_date", pages().alias("committee_guids")), materials)


@query("""WITH x AS (SELECT l_partkey AS issue_id, m.detail_url AS ref_url, m.title AS ref_title, 0 AS k FROM lineitem JOIN meetings m ON m.id = l_orderkey % 500 WHERE m.detail_url IS NOT NULL
UNION SELECT d.id % 200, d.download_url, d.title, 1 FROM stored_documents d UNION SELECT d.id % 200, m.detail_url, d.title, 2 FROM stored_documents d JOIN meetings m ON m.id = d.meeting_id WHERE m.detail_url IS NOT NULL)
SELECT issue_id, ref_url, ref_title FROM (SELECT *, row_number() OVER (PARTITION BY issue_id, ref_url ORDER BY k, ref_title NULLS FIRST) AS rn FROM x) y WHERE rn = 1""")
def collect_issue_references(t):
    activities = t.base("lineitem").select(F.col("l_partkey").alias("issue_id"), (F.col("l_orderkey") % 500).alias("event_id"))
    events = t.meetings.select(F.col("id").alias("event_id"), F.col("detail_url").alias("url"), "title")
    tagged = t.stored_documents.join(t.meetings.select(F.col("id").alias("meeting_id"), "detail_url"), "meeting_id", "left").select((F.col("id") % 200).alias("issue_id"), "download_url", "title", F.array_compact(F.array("detail_url")).alias("event_urls"))
    return matching.collect_issue_references(activities, events, tagged)


@query(_PEOPLE + f""", org AS (SELECT k.*, {ENTITY_SQL} AS org FROM (SELECT *, {STRIP_SQL} AS n FROM kept) k),
seen AS (SELECT d.meeting_id, lower(o.name) AS name, o.org FROM org o JOIN stored_documents d ON d.id = o.document_id)
SELECT 'committee' AS facet, id FROM meetings WHERE committee = 'Planning Committee' AND rto = 'PJM' UNION ALL SELECT DISTINCT 'stakeholder', meeting_id FROM seen WHERE name = 'person 7' AND org IS NULL UNION ALL SELECT DISTINCT 'entity', meeting_id FROM seen WHERE org = 'Acme Power'
UNION ALL SELECT DISTINCT 'initiative', r.matched_meeting_id FROM matched_references r JOIN issues i ON i.id = r.issue_id WHERE i.rto = 'CAISO' AND i.native_id = 'ISS10' AND r.matched_meeting_id IS NOT NULL""", stored=True)
def match_facet(t):
    links = resolved(t).where("matched_meeting_id IS NOT NULL").join(t.issues.select(F.col("id").alias("issue_id"), "rto", "native_id"), "issue_id").select(F.col("matched_meeting_id").alias("meeting_id"), "rto", "native_id")
    wants = {"committee": {"committee": "Planning Committee", "rto": "PJM"}, "stakeholder": {"name": "person 7", "entity": None}, "entity": {"entity": "Acme Power"}, "initiative": {"rto": "CAISO", "native_id": "ISS10"}}
    out = None
    for kind, want in wants.items():
        part = matching.match_facet(t.meetings, t.stored_documents, people(t), links, kind, **want).select(F.lit(kind).alias("facet"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(_CALENDAR, stored=True)
def calendar_feed(t):
    """Written, compressed as its lists repeat themselves from document to document, and read back."""
    path = feeds.new_folder(t.spark, "feed")
    feeds.write_calendar_feed(feed(t, in_order=True, as_json=True), path, in_order=True, compression="gzip")
    return shown_calendar(feeds.read_calendar_feed(t.spark, path, feed(t).schema))


@query(_CALENDAR, stored=True)
def calendar_feed_array(t):
    """The form of one JSON array, written in ordered, compressed parts and read back."""
    path = feeds.new_folder(t.spark, "feed")
    first = t.meetings.orderBy(F.desc("meeting_date"), "id").select("id").first()
    feeds.write_calendar_feed_array(feed(t, in_order=True, as_json=True), path, in_order=True, first=first and first["id"], compression="gzip")
    return shown_calendar(feeds.read_calendar_feed(t.spark, path, feed(t).schema, multi_line=True))


@query(_ISSUE_LIST, stored=True)
def issue_list(t):
    """Written and read back."""
    path, rows = feeds.new_folder(t.spark, "issues"), linking.issues_with_reference_counts(t.issues, resolved(t))
    feeds.write_json(rows, path)
    return feeds.read_calendar_feed(t.spark, path, rows.schema)


@query(_CORPUS + "SELECT * EXCLUDE (id) REPLACE (nullif(topics, '') AS topics, nullif(evidence, '') AS evidence, nullif(initiatives, '') AS initiatives, nullif(stakeholders, '') AS stakeholders) FROM flat", stored=True)
def corpus_csv(t):
    """Written and read back; an empty cell reads as null."""
    path, rows = feeds.new_folder(t.spark, "corpus"), t.once("corpus", lambda: corpus(t))
    feeds.write_corpus_csv(rows, path)
    return feeds.read_corpus_csv(t.spark, path, feeds.flat_corpus(rows).select(*feeds.CORPUS_COLUMNS).schema)


@query(_CORPUS + "SELECT * FROM flat", stored=True)
def corpus_json(t):
    """Written with its lists kept, and read back."""
    path, rows = feeds.new_folder(t.spark, "corpus"), t.once("corpus", lambda: corpus(t))
    feeds.write_json(feeds.in_corpus_order(rows), path)
    return feeds.flat_corpus(feeds.read_calendar_feed(t.spark, path, rows.schema))


@query(_CORPUS + _LINES + "SELECT id, line FROM lines", stored=True)
def corpus_csv_compact(t):
    rows = corpus(t)
    return rows.select("id", feeds.compact_csv_line(rows).alias("line"))


@query("""SELECT rto, 'meetings' AS scrape_type, concat('https://cal.example/', rto) AS target_url, 'success' AS status, count(*) AS events_found, 0 AS docs_found, 0 AS docs_downloaded, NULL AS error_message, 1.5 AS duration_seconds FROM meeting_scrapes GROUP BY rto
UNION ALL SELECT rto, 'documents', NULL, 'error', 0, count(*), count(posted_date), 'timed out', NULL FROM document_scrapes GROUP BY rto""")
def scrape_log(t):
    """Two runs appended and read back."""
    path, n = feeds.new_folder(t.spark, "log"), F.count("*")
    one = t.meeting_scrapes.groupBy("rto").agg(n.alias("events_found")).withColumns({"scrape_type": F.lit("meetings"), "status": F.lit("success"), "target_url": F.concat(F.lit("https://cal.example/"), F.col("rto")), "duration_seconds": F.lit(1.5)})
    two = t.document_scrapes.groupBy("rto").agg(n.alias("docs_found"), F.count("posted_date").alias("docs_downloaded")).withColumns({"scrape_type": F.lit("documents"), "status": F.lit("error"), "error_message": F.lit("timed out")})
    for run in (one, two):
        feeds.append_scrape_log(run, path)
    return t.spark.read.parquet(path)


def landed_records(t):
    """Meeting scrapes with the documents found at them, and issues with their references, as records of the stream."""
    docs = t.document_scrapes.select((F.col("seq") * 5).alias("at"), F.struct("seq", "download_url", F.lit(None).cast("string").alias("doc_type"), "title", "filename", "posted_date", "member_url").alias("d"))
    found = docs.groupBy("at").agg(F.collect_list("d").alias("documents"))
    met = t.meeting_scrapes.join(found, F.col("seq") == F.col("at"), "left").select("seq", F.struct("rto", "title", "meeting_date", "meeting_time", "committee", "location", "source_url", "detail_url", "materials_url").alias("meeting"), "documents")
    refs = t.issue_references.groupBy("issue_id").agg(F.collect_list(F.struct("ref_url", F.concat(F.lit("of "), F.col("issue_id").cast("string")).alias("ref_title"))).alias("refs"))
    none = F.lit(None).cast("string")
    issue = F.struct("rto", F.coalesce("short_title", "native_id").alias("native_id"), "canonical_name", "short_title", "status", none.alias("stakeholder_phase"), none.alias("committee_owner"), "is_open", none.alias("url"))
    raised = t.issues.join(refs, F.col("id") == F.col("issue_id"), "left").select(F.col("id").cast("long").alias("seq"), issue.alias("issue"), "refs")
    return met.unionByName(raised, allowMissingColumns=True)


_FOLDED = """WITH s AS (SELECT s.*, m.id AS meeting_id FROM document_scrapes s JOIN meetings m ON m.rto = s.rto AND m.title = s.meeting_title AND m.meeting_date = s.meeting_date),
i AS (SELECT *, coalesce(short_title, native_id) AS n FROM issues),
k AS (SELECT rto, n, min(id) AS id, arg_max(canonical_name, id) FILTER (WHERE canonical_name IS NOT NULL) AS canonical_name, arg_max(status, id) FILTER (WHERE status IS NOT NULL) AS status, arg_max(is_open, id) FILTER (WHERE is_open IS NOT NULL) AS is_open, max(id) AS last_seq FROM i GROUP BY 1, 2)
SELECT 'meetings' AS kind, id, concat_ws('|', rto, title, cast(meeting_date AS string)) AS key, concat_ws('|', coalesce(meeting_time, '-'), coalesce(committee, '-'), coalesce(location, '-'), coalesce(source_url, '-'), coalesce(detail_url, '-'), coalesce(materials_url, '-')) AS attributes, last_seq FROM meetings
UNION ALL SELECT 'documents', min(seq), download_url, concat_ws('|', cast(arg_min(meeting_id, seq) AS string), arg_min(rto, seq), coalesce(arg_max(title, seq) FILTER (WHERE title IS NOT NULL), '-'), coalesce(arg_max(filename, seq), '-'), coalesce(arg_max(posted_date, seq) FILTER (WHERE posted_date IS NOT NULL), '-')), max(seq) FROM s GROUP BY download_url
UNION ALL SELECT 'issues', id, concat_ws('|', rto, n), concat_ws('|', coalesce(canonical_name, '-'), coalesce(status, '-'), coalesce(cast(is_open AS string), '-')), last_seq FROM k
UNION ALL SELECT 'references', min(r.issue_id), concat_ws('|', cast(k.id AS string), r.ref_url), concat('of ', cast(max(r.issue_id) AS string)), max(r.issue_id) FROM issue_references r JOIN i ON i.id = r.issue_id JOIN k ON k.rto = i.rto AND k.n = i.n GROUP BY k.id, r.ref_url"""


@query(_FOLDED)
def incremental_upsert(t):
    """The records land in files that overlap, in no order, and are merged a few files at a time; all four tables are read back."""
    base = feeds.new_folder(t.spark, "stream")
    rows = landed_records(t)
    again = rows.where("seq % 5 = 0")
    rows.unionByName(again).repartition(6, F.pmod(F.xxhash64("seq"), F.lit(17))).write.parquet(f"{base}/landed")
    store = upserts.incremental_upsert(t.spark, f"{base}/landed", f"{base}/store", f"{base}/progress", files_per_batch=2)
    shown = lambda df, kind, key, attributes: df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.concat_ws("|", *key).alias("key"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in attributes]).alias("attributes"), F.col("last_seq").cast("long").alias("last_seq"))
    return (
        shown(store.meetings(), "meetings", ["rto", "title", "meeting_date"], ["meeting_time", "committee", "location", "source_url", "detail_url", "materials_url"])
        .unionByName(shown(store.documents(), "documents", ["download_url"], ["meeting_id", "rto", "title", "filename", "posted_date"]))
        .unionByName(shown(store.issues(), "issues", ["rto", "native_id"], ["canonical_name", "status", "is_open"]))
        .unionByName(shown(store.references(), "references", ["issue_id", "ref_url"], ["ref_title"]))
    )
