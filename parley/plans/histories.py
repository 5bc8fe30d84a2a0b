"""Registered queries: document trees, issue rows and histories, documents near a date, schedules, timelines, the markdown digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text
from ..operators import analytics, digest, issues, linking, matching, payloads
from .registry import TODAY, query
from .calendar import _EVENTS
from .store import _DOC_ISSUES, _PEOPLE, DOC_TYPE_SQL, links, people

_ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"


@query("""SELECT cast(event_id AS varchar) AS event_id, 'NEPOOL ' || event_type || ' Meeting (Day ' || user_id || ')' AS title, cast(ts AS date) AS meeting_date, strftime(ts, '%-I:%M %p') AS meeting_time,
CASE WHEN event_id % 4 = 0 THEN 'Markets ' || event_type ELSE event_type END AS committee, CASE WHEN event_id % 3 = 0 THEN 'Hall' END AS location, 'https://www.iso-ne.com/calendar?eventId=' || event_id AS detail_url, CASE WHEN event_id % 2 = 0 THEN 'https://www.iso-ne.com/c/' || user_id END AS materials_url
FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 7 <> 0 AND event_id % 17 <> 0""")
def normalize_isone_events(t):
    event = f"""struct(event_id, concat('NEPOOL ', event_type, ' Meeting (Day ', user_id, ')') AS event_title, CASE WHEN event_id % 11 = 0 THEN 'Y' ELSE 'N' END AS cancelled_flag, CASE WHEN event_id % 13 = 0 THEN 'Y' END AS deleted_flag,
    struct(CASE WHEN event_id % 7 = 0 THEN 'Holidays' ELSE 'Meetings' END AS name) AS event_type, CASE WHEN event_id % 4 = 0 THEN array(struct(concat(' Name:Markets ', event_type) AS name)) WHEN event_id % 4 = 1 THEN array(struct(' Name:Other Committees and Working Groups' AS name)) ELSE array() END AS event_subtypes,
    CASE WHEN event_id % 17 <> 0 THEN {_ISO} END AS event_start_date_gmt_str, CASE WHEN event_id % 3 = 0 THEN ' Hall ' ELSE ' ' END AS location, CASE WHEN event_id % 2 = 0 THEN concat('https://www.iso-ne.com/c/', user_id) ELSE '' END AS committee_link)"""
    return payloads.normalize_isone_events(t.base("events").select(F.expr(f"concat('[', to_json({event}), ']')").alias("payload")))


@query("""WITH b AS (SELECT o_orderkey AS event_id, o_custkey AS c FROM orders WHERE o_orderkey % 5 <> 0)
SELECT event_id, 'https://www.caiso.com/d/Agenda-' || c || '%20a.pdf' AS download_url, 'agenda' AS doc_type, 'Agenda-' || c || ' a.pdf' AS title, 'Agenda-' || c || ' a.pdf' AS filename, '2024-01-05' AS posted_date FROM b
UNION ALL SELECT event_id, 'https://x.example/' || c || '.pdf', 'presentation', 'Slides', 'f' || c || '.pdf', NULL FROM b
UNION ALL SELECT event_id, 'https://www.caiso.com/own/' || c, 'other', 'Paper', cast(c AS varchar), NULL FROM b WHERE event_id % 2 = 0""")
def flatten_document_tree(t):
    """Trees as JSON, every third as a JSON string of one: a folder in a folder, a document with children, a repeat, a video."""
    first = "concat('{\"type\":\"Document\",\"data\":{\"url\":\"/d/Agenda-', o_custkey, '%20a.pdf\",\"isoDatePosted\":\"2024-01-05T00:00:00\"},\"children\":[', inner, ']}')"
    inner = "concat('{\"type\":\"Document\",\"label\":\"Slides\",\"data\":{\"url\":\"https://x.example/', o_custkey, '.pdf\",\"filename\":\"f', o_custkey, '.pdf\"}},{\"type\":\"Document\",\"data\":{\"url\":\"https://youtu.be/', o_custkey, '\"}}')"
    own = "CASE WHEN o_orderkey % 2 = 0 THEN concat(',{\"type\":\"Document\",\"label\":\"Paper\",\"data\":{\"siteInfos\":[{\"siteId\":2,\"url\":\"/other/', o_custkey, '\"},{\"siteId\":1,\"url\":\"/own/', o_custkey, '\"}]}}') ELSE '' END"
    rows = t.base("orders").withColumn("inner", F.expr(inner)).withColumn("doc", F.expr(first))
    tree = F.expr(f"concat('[{{\"type\":\"Folder\",\"label\":\"A\",\"children\":[{{\"type\":\"folder\",\"children\":[', doc, ']}}]}},', inner, {own}, ']')")
    quoted = F.substring(F.to_json(F.struct(tree.alias("v"))), 6, 1_000_000)
    tree = F.when(F.col("o_orderkey") % 5 == 0, "no tree").when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(quoted, r"\}$", "")).otherwise(tree)
    return payloads.flatten_document_tree(rows.select(F.col("o_orderkey").alias("event_id"), tree.alias("tree")))


@query("""SELECT 'i' || p_partkey AS native_id, 'in process' AS status, CASE WHEN p_size % 2 = 0 THEN 'phase ' || p_size END AS stakeholder_phase, p_type AS committee_owner, CASE WHEN p_size % 3 = 0 THEN 'Planning' ELSE 'PC' END AS committee_owner_label,
p_size % 2 = 1 AS is_open, CASE WHEN p_size % 5 <> 0 THEN 2000 + p_size END AS annual_plan_year, p_name AS canonical_name, 'https://www.pjm.com/i/' || p_partkey AS url FROM part WHERE p_size % 7 <> 0""")
def issue_rows_from_classes(t):
    row = """concat('<tr class="item-row optisssts-in~process ', CASE WHEN p_size % 2 = 0 THEN concat('optstkhldprst-phase~', p_size, ' ') ELSE '' END, 'optcmt-', replace(p_type, ' ', '~'), ' selopncls-', CASE WHEN p_size % 2 = 1 THEN 'open' ELSE 'closed' END,
    ' selannualyear-', CASE WHEN p_size % 5 = 0 THEN 'none' ELSE cast(2000 + p_size AS string) END, '" data-id="I', p_partkey, '"><td class="issue-name-col">', CASE WHEN p_size % 7 <> 0 THEN concat('<a href="/i/', p_partkey, '">', p_name, '</a>') ELSE p_name END,
    '</td><td class="issue-owner-col"><a ', CASE WHEN p_size % 3 = 0 THEN 'title="Planning"' ELSE '' END, '>PC</a></td></tr><tr class="head"><td>x</td></tr>')"""
    return issues.issue_rows_from_classes(t.base("part").select(F.expr(row).alias("html")))


@query("""SELECT 'i' || p_partkey AS native_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS canonical_name, p_brand AS short_title, 'https://stakeholdercenter.caiso.com/RecurringStakeholderProcesses/P' || p_partkey AS url, 'Active' AS status,
CASE WHEN p_size % 3 = 0 THEN p_size END AS phase, CASE WHEN p_size % 4 = 0 THEN 'EIM' END AS eim_categories, 'May 1, 2024 Start' AS stage_a, cast(NULL AS varchar) AS stage_b, cast(NULL AS varchar) AS stage_c, cast(NULL AS varchar) AS stage_d FROM part WHERE p_size % 7 <> 0""")
def issue_rows_from_json(t):
    row = """concat('<script>var currInitiatives = [{"InitiativeId":"I', p_partkey, '","LinkTitle":"', CASE WHEN p_size % 7 <> 0 THEN concat('P', p_partkey, '%20/') ELSE ' ' END, '","StartDate":"\\\\/Date(17)\\\\/","Title":', CASE WHEN p_size % 2 = 0 THEN concat('"', p_name, '"') ELSE 'null' END, ',"DisplayTitle":"', p_brand,
    '","ShortTitle":"', p_brand, '","Status":"Active","Phase":', CASE WHEN p_size % 3 = 0 THEN cast(p_size AS string) ELSE '"x"' END, ',"EIMCategories":"', CASE WHEN p_size % 4 = 0 THEN 'EIM' ELSE 'None' END, '","StageA":"May 1, 2024 Start","StageB":null,"StageC":" ","StageD":"None"}];</script>')"""
    return issues.issue_rows_from_json(t.base("part").select(F.expr(row).alias("html")))


@query("""SELECT p_partkey AS page_id, 'NPRR' || p_size AS native_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'PRS & TAC' END AS committee_owner, CASE WHEN p_size % 2 = 1 THEN DATE '2026-05-29' END AS completion_date FROM part
UNION ALL SELECT p_partkey, 'SCR7', p_brand, NULL, NULL FROM part""")
def issue_rows_from_list(t):
    one = lambda key, name, third: f"""concat('<tr class="rrtr x"> <td><a href="/mktrules/issues/', {key}, '">n</a></td> <td>', {name}, '</td> <td>', {third}, '</td></tr>')"""
    third = "CASE WHEN p_size % 2 = 0 THEN '<a href=\"/c\">PRS &amp; TAC</a>' ELSE '05/29/2026' END"
    key = "concat('NPRR', p_size)"
    html = f"concat('<table>', {one(key, 'p_name', third)}, {one(chr(39) + 'SCR7' + chr(39), 'p_brand', chr(39) * 2)}, {one(key, chr(39) + 'again' + chr(39), third)}, '</table>')"
    return issues.issue_rows_from_list(t.base("part").select(F.col("p_partkey").alias("page_id"), F.expr(html).alias("html")))


@query("""WITH i AS (SELECT o_orderkey AS k, 'N' || o_orderkey AS native_id, o_custkey % 3 AS s, cast(o_orderdate AS date) AS d FROM orders),
a AS (SELECT l_orderkey AS k, cast(l_linenumber AS bigint) AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'https://m.example/' || (l_partkey % 3) END AS url, cast(l_shipdate AS date) AS d, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE 'PRS: ' || l_returnflag END AS label, l_returnflag AS act FROM lineitem),
m AS (SELECT k, d, 'Posted' AS label FROM i UNION ALL SELECT k, d, label FROM a),
st AS (SELECT k, string_agg(strftime(d, '%B %-d, %Y') || ' ' || label, chr(10) ORDER BY d, label) AS stage_a, max(d) AS last FROM m GROUP BY k),
r AS (SELECT k, count(DISTINCT url) + 1 AS n, arg_min('N' || k || ': ' || act, {'p': pos, 'u': url, 'a': act}) FILTER (WHERE url IS NOT NULL) AS first_title FROM a GROUP BY k)
SELECT i.native_id, CASE s WHEN 0 THEN 'Approved on 05/29/2026' WHEN 1 THEN 'Withdrawn' ELSE 'Pending' END AS status, CASE WHEN s < 2 THEN 0 ELSE 1 END AS is_open, i.d AS initiated_date,
CASE s WHEN 0 THEN DATE '2026-05-29' WHEN 1 THEN st.last END AS actual_completion_date, st.stage_a, CASE WHEN s < 2 THEN 'Completed' END AS stage_d, coalesce(r.n, 1) AS n_references, coalesce(r.first_title, 'Key document') AS first_reference
FROM i JOIN st ON st.k = i.k LEFT JOIN r ON r.k = i.k""")
def issue_action_history(t):
    rows = t.base("orders").select(F.expr("concat('N', o_orderkey)").alias("native_id"), F.expr("CASE o_custkey % 3 WHEN 0 THEN 'Approved on 05/29/2026' WHEN 1 THEN ' Withdrawn' ELSE 'Pending' END").alias("status"), F.date_format("o_orderdate", "MMM d, yyyy").alias("date_posted"))
    actions = t.base("lineitem").select(F.expr("concat('N', l_orderkey)").alias("native_id"), F.col("l_linenumber").cast("long").alias("pos"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN concat('https://m.example/', l_partkey % 3) ELSE '' END").alias("url"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("date_text"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'PRS' END").alias("body"), F.col("l_returnflag").alias("action"))
    docs = rows.select("native_id", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("https://k.example/"), "native_id").alias("url"), F.lit("Key document ").alias("title"))
    out = issues.issue_action_history(rows, actions, docs)
    return out.withColumns({"n_references": F.size("references").cast("long"), "first_reference": F.get("references", F.lit(0))["title"]}).drop("references")


_NEAR = """WITH d AS (SELECT id AS doc_id, rto AS initiative, id // 3 AS row_id, CASE WHEN id % 2 = 0 THEN DATE '2024-01-01' + cast(id % 40 AS integer) END AS named, CASE WHEN id % 3 <> 1 THEN DATE '2024-01-01' + cast(id % 37 AS integer) END AS posted FROM stored_documents),
hit AS (SELECT DISTINCT m.id AS meeting_id, d.doc_id FROM meetings m JOIN d ON d.initiative = m.rto AND d.named = m.meeting_date),
near AS (SELECT DISTINCT m.id AS meeting_id, e.doc_id FROM meetings m JOIN d ON d.initiative = m.rto AND d.posted BETWEEN m.meeting_date - 7 AND m.meeting_date + 1 JOIN d e ON e.initiative = d.initiative AND e.row_id = d.row_id WHERE m.id NOT IN (SELECT meeting_id FROM hit))
SELECT meeting_id, doc_id, true AS by_name FROM hit UNION ALL SELECT meeting_id, doc_id, false FROM near"""


@query(_NEAR)
def match_documents_near_date(t):
    day = "date_add(date'2024-01-01', cast(id % 40 AS int))"
    forms = ["MMM-dd-yyyy", "MMM dd, yyyy", "M-d-yyyy", "MM-dd-yyyy", "yyyy-MM-dd"]
    name = "CASE WHEN id % 2 = 0 THEN concat('Agenda ', CASE (id DIV 2) % 5 " + " ".join(f"WHEN {k} THEN date_format({day}, '{f}')" for k, f in enumerate(forms)) + " END, '.pdf') ELSE 'Agenda.pdf' END"
    docs = t.stored_documents.select(F.col("id").alias("doc_id"), F.col("rto").alias("initiative"), F.expr("id DIV 3").alias("row_id"), F.expr(name).alias("filename"), F.lit("Paper").alias("title"), F.expr("CASE WHEN id % 3 <> 1 THEN date_add(date'2024-01-01', cast(id % 37 AS int)) END").alias("posted_date"))
    return matching.match_documents_near_date(t.meetings.select("id", F.col("rto").alias("initiative"), "meeting_date"), docs)


_TOKENS = ["BIC", "MC/OC", "icap/MIWG/PRLWG", "NYSRC", "BYLAWS - TPAS"]
_SUMMARY = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_TOKENS))
_NAMES = list(dims.SCHEDULE_TOKENS)
_COMMITTEE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_NAMES[:6]))
_SCHEDULE_SQL = f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{x}')" for c, xs in dims.SCHEDULE_TOKENS.items() for x in xs)}) v(committee, token)),
s AS (SELECT event_id AS seq, cast(ts AS date) AS day, CASE user_id % 5 {_SUMMARY} END AS summary, strftime(ts, '%-I:%M %p') AS meeting_time FROM events),
w AS (SELECT DISTINCT seq, day, meeting_time, committee FROM (SELECT *, unnest(string_split_regex(upper(summary), '[^A-Z0-9]+')) AS token FROM s) x JOIN k USING (token)),
f AS (SELECT committee, day, arg_min(meeting_time, seq) AS meeting_time FROM w GROUP BY 1, 2),
m AS (SELECT id, CASE id % 6 {_COMMITTEE} END AS committee, meeting_date FROM meetings)
"""


def _schedule(t):
    return t.base("events").select(F.col("event_id").alias("seq"), F.to_date("ts").alias("event_date"), F.expr(f"CASE user_id % 5 {_SUMMARY} END").alias("summary"), F.date_format("ts", "h:mm a").alias("meeting_time"))


def _boards(t):
    return t.meetings.select("id", F.expr(f"CASE id % 6 {_COMMITTEE} END").alias("committee"), "meeting_date", "meeting_time")


@query(_SCHEDULE_SQL + "SELECT m.id, m.committee, m.meeting_date, f.meeting_time FROM m LEFT JOIN f ON f.committee = m.committee AND f.day = m.meeting_date")
def schedule_times(t):
    return matching.schedule_times(_boards(t), _schedule(t))


@query(_SCHEDULE_SQL + "SELECT committee AS title, day AS meeting_date, meeting_time, committee FROM f WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND NOT EXISTS (SELECT 1 FROM m WHERE m.committee = f.committee AND m.meeting_date = f.day AND m.id % 3 = 0)")
def schedule_only_meetings(t):
    return matching.schedule_only_meetings(_boards(t).where("id % 3 = 0"), _schedule(t), "2024-01-05", "2024-01-25")


@query(_SCHEDULE_SQL + "SELECT DISTINCT summary FROM s WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND seq NOT IN (SELECT seq FROM w)")
def unmatched_summaries(t):
    return matching.unmatched_summaries(_schedule(t), "2024-01-05", "2024-01-25")


@query(f"""WITH i AS (SELECT id AS issue_id, rto, id % 4 = 0 AS fin, DATE '2023-10-01' + cast(id % 50 AS integer) AS d0, DATE '2023-10-01' + cast(id % 50 + id % 70 AS integer) AS dw, CASE WHEN id % 5 <> 0 THEN DATE '2024-01-05' + cast(id % 30 AS integer) END AS dt, CASE WHEN id % 4 = 0 THEN DATE '2024-02-01' END AS da, rto IN ('CAISO', 'ERCOT') AS staged FROM issues),
m AS (SELECT l_partkey AS issue_id, list_sort(list(DISTINCT DATE '2023-12-01' + cast(l_quantity AS integer))) AS days FROM lineitem WHERE l_partkey % 6 > 0 OR l_quantity = 7 GROUP BY 1),
j AS (SELECT i.*, m.days, coalesce(len(m.days) >= 2, false) AS enough FROM i LEFT JOIN m USING (issue_id)),
b AS (SELECT issue_id, rto, fin, staged, CASE WHEN staged AND enough THEN days[1] WHEN NOT staged THEN d0 END AS a, CASE WHEN staged AND enough THEN days[len(days)] WHEN NOT staged THEN coalesce(da, dt) END AS z, CASE WHEN staged AND enough THEN days[2:len(days) - 1] WHEN NOT staged THEN [dw] END AS mid FROM j)
SELECT issue_id, rto, a AS start_date, z AS end_date, fin AS is_complete, CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN NOT staged AND NOT fin AND DATE '{TODAY}' > z END AS is_overdue,
CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN cast(round(CASE WHEN fin THEN 100 ELSE greatest(0, least(100, 100.0 * (DATE '{TODAY}' - a) / (z - a))) END) AS bigint) END AS filled_pct,
CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN len([x for x in mid if 100.0 * (x - a) / (z - a) > 3 AND 100.0 * (x - a) / (z - a) < 97]) END AS n_midpoints FROM b""")
def initiative_timeline(t):
    day = lambda base, n: f"date_add(date'{base}', cast({n} AS int))"
    rows = t.issues.select(
        F.col("id").alias("issue_id"), "rto", F.lit("Open").alias("status"), F.expr("CASE WHEN id % 4 = 0 THEN 'Completed' END").alias("stage_d"), F.expr(day("2023-10-01", "id % 50")).alias("initiated_date"),
        F.expr(day("2023-10-01", "id % 50 + id % 70")).alias("work_begins_date"), F.expr(f"CASE WHEN id % 5 <> 0 THEN {day('2024-01-05', 'id % 30')} END").alias("target_completion_date"), F.expr("CASE WHEN id % 4 = 0 THEN date'2024-02-01' END").alias("actual_completion_date"),
    )
    stones = t.base("lineitem").where("l_partkey % 6 > 0 OR l_quantity = 7").select(F.col("l_partkey").alias("issue_id"), F.expr(day("2023-12-01", "l_quantity")).alias("milestone_date")).distinct()
    out = issues.initiative_timeline(rows, stones, TODAY)
    return out.withColumns({"filled_pct": F.round("filled_pct").cast("long"), "n_midpoints": F.size("midpoints").cast("long")}).drop("midpoints")


@query(r"SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Markets+ Design' WHEN 1 THEN 'Cost Group ' || l_suppkey ELSE 'Plain' END AS committee FROM lineitem")
def committee_from_slug(t):
    slug = "CASE l_linenumber % 3 WHEN 0 THEN 'marketsplus-design-net-conference-20240115-16' WHEN 1 THEN concat('cost-group-', l_suppkey, '-meeting-20240115') ELSE 'plain' END"
    return t.base("lineitem").select("l_orderkey", "l_linenumber", text.committee_from_slug(F.expr(slug)).alias("committee"))


def _after(lead: str, text: str, tail: str = "") -> str:
    """SQL of a line that is left out where its text is null or empty."""
    return f"CASE WHEN ({text}) <> '' THEN '{lead}' || ({text}) || '{tail}' END"


_NAMED = lambda table, key: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_LONG = "strftime({}, '%B %-d, %Y')".format
_LABEL = _NAMED(dims.TOPIC_LABELS, "tp")
_DIGEST = _PEOPLE.rstrip() + ", " + _DOC_ISSUES[5:].rstrip() + ", " + _EVENTS[5:].rstrip() + f""",
who AS (SELECT document_id, string_agg(DISTINCT name || coalesce(' (' || entity || ')', ''), '; ' ORDER BY name || coalesce(' (' || entity || ')', '')) AS who FROM kept GROUP BY 1),
ini AS (SELECT document_id, string_agg(coalesce(short_title, canonical_name, native_id), '; ' ORDER BY coalesce(short_title, canonical_name, native_id)) AS ini FROM di JOIN issues i ON i.id = di.issue_id GROUP BY 1),
src AS (SELECT d.*, coalesce(hydro_relevant = 1, false) AS hot, {DOC_TYPE_SQL.replace("(x, ", "(low, ")} AS dt, coalesce(from_json(evidence, '[{{"claim":"VARCHAR","quote":"VARCHAR","verified":"BOOLEAN"}}]'), []) AS ev,
  array_to_string(list_transform(string_split(nullif(topics, ''), ';'), lambda tp: coalesce({_LABEL}, tp)), ' · ') AS tps FROM (SELECT *, lower(concat_ws(' ', title, filename)) AS low FROM stored_documents) d),
doc AS (SELECT meeting_id, id, hot, concat_ws('\n', '#### ' || CASE WHEN hot THEN '[HYDRO] ' ELSE '' END || coalesce(nullif(title, ''), nullif(filename, ''), '(untitled)'),
  {_after("- ", "concat_ws(' · ', " + _after("**Type:** ", "dt") + ", " + _after("**Posted:** ", "posted_date") + ")")}, {_after("- **Confidence:** ", _NAMED(dims.CONFIDENCE, "directness"))}, {_after("- **Topics:** ", "tps")},
  CASE WHEN hot THEN {_after("- **Why flagged:** ", "hydro_relevance_reason")} END, {_after("- **Stakeholders:** ", "who")}, {_after("- **Initiatives touched:** ", "ini")}, {_after("- **URL:** ", "coalesce(nullif(member_url, ''), download_url)")}, '',
  {_after(digest.SAYS, "ai_summary", chr(10))}, {_after(digest.MATTERS, "hydro_read_through", chr(10))}, CASE WHEN hydro_read_through <> '' AND NOT source_names_hydro = 1 THEN '{digest.UNNAMED}' END,
  {_after(digest.SOURCED, "array_to_string(list_transform(ev, lambda e: '- ' || CASE WHEN e.verified THEN '' ELSE '[UNVERIFIED] ' END || e.claim || ' — \"' || e.quote || '\"'), '" + chr(10) + "')", chr(10))},
  CASE WHEN len(list_filter(ev, lambda e: NOT coalesce(e.verified, false))) > 0 THEN '{digest.UNVERIFIED}' END) AS t FROM src LEFT JOIN who ON who.document_id = src.id LEFT JOIN ini ON ini.document_id = src.id),
docs AS (SELECT meeting_id, count(*) AS n, count(*) FILTER (WHERE hot) AS n_hot, string_agg(t, '\n' ORDER BY NOT hot, id) AS t FROM doc GROUP BY 1),
iss AS (SELECT matched_meeting_id AS mid, count(*) AS n, string_agg(concat_ws('\n', '- **' || name || '**' || CASE WHEN short_title <> '' AND short_title <> name THEN ' (' || short_title || ')' ELSE '' END || coalesce({_after(" — _", "status", "_")}, ''),
  {_after("  - Stakeholder phase: ", "stakeholder_phase")}, {_after("  - Owner: ", "committee_owner")}, {_after("  - ", "url")}), '\n' ORDER BY name, short_title NULLS FIRST, status NULLS FIRST, stakeholder_phase NULLS FIRST, committee_owner NULLS FIRST, url NULLS FIRST) AS t
  FROM (SELECT r.matched_meeting_id, i.*, coalesce(canonical_name, short_title, native_id) AS name FROM matched_references r JOIN issues i ON i.id = r.issue_id WHERE r.matched_meeting_id IS NOT NULL) x GROUP BY 1),
told AS (SELECT cast(date_trunc('week', e.meeting_date) AS date) AS week, row_number() OVER (PARTITION BY date_trunc('week', e.meeting_date) ORDER BY e.meeting_date, e.id) AS k, e.rto, coalesce(d.n, 0) AS n, coalesce(d.n_hot, 0) AS n_hot, m.*, d.t AS dt, iss.n AS n_iss, iss.t AS it
  FROM ev e JOIN meetings m ON m.id = e.id LEFT JOIN docs d ON d.meeting_id = e.id LEFT JOIN iss ON iss.mid = e.id WHERE e.is_relevant),
shown AS (SELECT week, k, rto, n, n_hot, concat_ws('\n', '---\n', '## ' || k || '. ' || rto || ' — ' || title || '\n', '- **Date:** ' || concat_ws(' · ', {_LONG("meeting_date")}, nullif(meeting_time, '')), {_after("- **Committee:** ", "committee")}, {_after("- **Source:** ", "source_url")},
  {_after("- **Detail page:** ", "detail_url")}, {_after("- **Materials:** ", "materials_url")}, '', {_after("**Why hydro-relevant:** ", "hydro_relevance_reason", chr(10))}, CASE WHEN n_iss > 0 THEN '### Initiatives (' || n_iss || ')\n\n' || it || '\n' END,
  '### Documents (' || n || ' total' || CASE WHEN n_hot > 0 THEN ', ' || n_hot || ' hydro-relevant' ELSE '' END || ')\n', CASE WHEN n = 0 THEN '_No documents attached._\n' ELSE dt END) AS t FROM told),
weeks AS (SELECT week, count(*) AS k, sum(n)::BIGINT AS docs, sum(n_hot)::BIGINT AS hot, array_to_string(list_sort(list(DISTINCT rto)), ', ') AS rtos, string_agg(t, '\n' ORDER BY k) AS t FROM shown GROUP BY 1),
spine AS (SELECT cast(unnest(generate_series(date_trunc('week', a), date_trunc('week', b), interval 7 day)) AS date) AS week FROM (SELECT min(meeting_date) AS a, greatest(max(meeting_date), DATE '{TODAY}') AS b FROM ev) x)
SELECT s.week, '# RTO Hydro Digest — Week of ' || {_LONG("s.week")} || '\n\n_Generated ' || {_LONG(f"DATE '{TODAY}'")} || '. Window: ' || {_LONG("s.week")} || ' – ' || {_LONG("s.week + 6")} || '._\n\n' || CASE WHEN k IS NULL THEN '{digest.EMPTY_WEEK}'
  ELSE '**' || k || ' hydro-relevant meeting' || CASE WHEN k = 1 THEN '' ELSE 's' END || '** across ' || rtos || '. ' || hot || ' hydro-flagged document' || CASE WHEN hot = 1 THEN '' ELSE 's' END || ' of ' || docs || ' total.\n\n' || t END AS markdown FROM spine s LEFT JOIN weeks w ON w.week = s.week"""


@query(_DIGEST, stored=True)
def digest_markdown(t):
    """Every week's text in full."""
    more = t.meetings.select("id", "source_url", "detail_url", "materials_url", F.col("meeting_time").alias("time_label"), F.col("hydro_relevance_reason").alias("reason"))
    full = t.issues.select(F.col("id").alias("issue_id"), linking.issue_name().alias("name"), "short_title", "status", "stakeholder_phase", F.col("committee_owner").alias("owner"), "url")
    tied = links(t).where("matched_meeting_id IS NOT NULL").select(F.col("matched_meeting_id").alias("id"), "issue_id").join(full, "issue_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", "short_title", "status", "stakeholder_phase", "owner", "url"))).alias("issues"))
    events = analytics.event_rollup(t.meetings, t.stored_documents).join(more, "id").join(tied, "id", "left")
    who = people(t).groupBy("document_id").agg(F.array_sort(F.collect_set(F.concat("name", F.coalesce(F.concat(F.lit(" ("), "entity", F.lit(")")), F.lit(""))))).alias("stakeholders"))
    named = linking.document_issues(links(t), t.stored_documents).join(t.issues.select(F.col("id").alias("issue_id"), F.coalesce("short_title", "canonical_name", "native_id").alias("n")), "issue_id").groupBy("document_id").agg(F.array_sort(F.collect_list("n")).alias("initiatives"))
    docs = t.stored_documents.withColumnRenamed("id", "document_id").join(who, "document_id", "left").join(named, "document_id", "left").select(
        F.col("document_id").alias("id"), "meeting_id", "title", "filename", text.classify_document(F.concat_ws(" ", "title", "filename")).alias("doc_type"), "posted_date", "directness", F.split(F.when(F.col("topics") != "", F.col("topics")), ";").alias("topics"), (F.col("hydro_relevant") == 1).alias("relevant"),
        F.col("hydro_relevance_reason").alias("reason"), "stakeholders", "initiatives", "member_url", F.col("download_url").alias("url"), "ai_summary", F.col("hydro_read_through").alias("read_through"), (F.col("source_names_hydro") == 1).alias("source_names_subject"), text.evidence_array(F.col("evidence")).alias("evidence"),
    )
    return digest.digest_markdown(events, docs, TODAY)
