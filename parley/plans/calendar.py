"""Registered queries: roll-ups, digests, indexes, windows and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.dates import parse_meeting_time, resolve_meeting_time
from ..functions.dates import time_in_text as time_in_text_of
from ..operators import analytics, linking
from ..operators.textindex import TextIndex
from .registry import TODAY, query
from .store import _DOC_ISSUES, _PEOPLE, DOC_TYPE_SQL, doc_sightings, feed, links, people, resolved
from ..operators import folds

_EVENTS = """WITH hot AS (SELECT meeting_id, count(*) AS n_docs, count(*) FILTER (WHERE hydro_relevant = 1) AS n_relevant, max(CASE WHEN hydro_relevant = 1 THEN CASE directness WHEN 'direct' THEN 3 WHEN 'precedent' THEN 2 WHEN 'reference' THEN 1 END END) AS directness_rank FROM stored_documents GROUP BY 1),
tops AS (SELECT meeting_id, list_sort(list(DISTINCT t)) AS topics FROM (SELECT meeting_id, unnest(string_split(topics, ';')) AS t FROM stored_documents WHERE topics <> '') u GROUP BY 1),
ev AS (SELECT m.id, m.rto, m.title, m.meeting_date, m.meeting_time, m.committee, coalesce(h.n_docs, 0) AS n_docs, coalesce(h.n_relevant, 0) AS n_relevant, coalesce(m.hydro_relevant, 0) = 1 OR coalesce(h.n_relevant, 0) > 0 AS is_relevant, coalesce(t.topics, []) AS topics, h.directness_rank,
  EXISTS (SELECT 1 FROM matched_references r WHERE r.matched_meeting_id = m.id) AS has_issues FROM meetings m LEFT JOIN hot h ON h.meeting_id = m.id LEFT JOIN tops t ON t.meeting_id = m.id)
"""


def events(t):
    return t.once("events", lambda: _events(t))


def _events(t):
    met = links(t).where("matched_meeting_id IS NOT NULL").select(F.col("matched_meeting_id").alias("meeting_id"))
    return analytics.event_rollup(t.meetings, t.stored_documents, met)


@query("SELECT m.rto, m.n AS meetings, coalesce(d.n, 0) AS documents, coalesce(d.p, 0) AS downloaded FROM (SELECT rto, count(*) AS n FROM meetings GROUP BY 1) m LEFT JOIN (SELECT rto, count(*) AS n, count(*) FILTER (WHERE downloaded = 1) AS p FROM stored_documents GROUP BY 1) d ON d.rto = m.rto")
def store_stats(t):
    return analytics.store_stats(t.meetings, t.stored_documents)


@query(_EVENTS + "SELECT id, rto, meeting_date, n_docs, n_relevant, is_relevant, array_to_string(topics, ',') AS topics, directness_rank, has_issues FROM ev")
def event_rollup(t):
    return events(t).select("id", "rto", "meeting_date", "n_docs", "n_relevant", "is_relevant", F.array_join("topics", ",").alias("topics"), "directness_rank", "has_issues")


@query(_EVENTS + f""", spine AS (SELECT cast(unnest(generate_series(date_trunc('week', a), date_trunc('week', b), interval 7 day)) AS date) AS week FROM (SELECT min(meeting_date) AS a, greatest(max(meeting_date), DATE '{TODAY}') AS b FROM ev) x)
SELECT s.week, count(e.id) AS events, coalesce(sum(e.n_docs), 0)::bigint AS docs, coalesce(sum(e.n_relevant), 0)::bigint AS relevant_docs, coalesce(array_to_string(list_sort(list(DISTINCT e.rto) FILTER (WHERE e.rto IS NOT NULL)), ', '), '') AS rtos
FROM spine s LEFT JOIN ev e ON e.is_relevant AND cast(date_trunc('week', e.meeting_date) AS date) = s.week GROUP BY 1""")
def weekly_digest(t):
    return analytics.weekly_digest(analytics.event_rollup(t.meetings, t.stored_documents), TODAY)


@query(_EVENTS + "SELECT 'rto' AS facet, rto AS value, count(*) AS n FROM ev GROUP BY rto UNION ALL SELECT 'topic', x, count(*) FROM (SELECT unnest(topics) AS x FROM ev) u GROUP BY x UNION ALL SELECT 'view', 'all', count(*) FROM ev UNION ALL SELECT 'view', 'relevant', count(*) FROM ev WHERE is_relevant HAVING count(*) > 0 UNION ALL SELECT 'view', 'issues', count(*) FROM ev WHERE has_issues HAVING count(*) > 0")
def facet_counts(t):
    return analytics.facet_counts(events(t))


@query(_EVENTS + "SELECT count(*) FILTER (WHERE directness_rank IS NULL OR directness_rank >= 1) AS at_least_1, count(*) FILTER (WHERE directness_rank IS NULL OR directness_rank >= 2) AS at_least_2, count(*) FILTER (WHERE directness_rank IS NULL OR directness_rank >= 3) AS at_least_3, count(*) FILTER (WHERE directness_rank IS NULL AND is_relevant) AS unrated_relevant FROM ev")
def confidence_counts(t):
    return analytics.confidence_counts(events(t))


@query(_EVENTS + "SELECT id, rto, directness_rank FROM ev WHERE directness_rank IS NULL OR directness_rank >= 2")
def filter_confidence(t):
    return analytics.filter_confidence(events(t), 2).select("id", "rto", "directness_rank")


@query("SELECT rto, committee, count(*) AS meetings FROM meetings WHERE committee IS NOT NULL GROUP BY 1, 2")
def committee_index(t):
    return t.meetings.where("committee IS NOT NULL").groupBy("rto", "committee").agg(F.count("*").alias("meetings"))


@query("SELECT i.rto, i.native_id, coalesce(canonical_name, short_title, native_id) AS name, i.status, count(DISTINCT r.matched_meeting_id) AS meetings FROM issues i JOIN matched_references r ON r.issue_id = i.id WHERE r.matched_meeting_id IS NOT NULL GROUP BY ALL")
def initiative_index(t):
    rows = linking.meeting_issues(resolved(t), t.issues).join(t.issues.select(F.col("id").alias("issue_id"), "rto"), "issue_id")
    return rows.groupBy("rto", "native_id", "name", "status").agg(F.countDistinct("meeting_id").alias("meetings"))


ENTITY_SQL = r"""CASE lower(n) WHEN 'pjm interconnection' THEN 'PJM' WHEN 'pjm interconnection l.l.c' THEN 'PJM' WHEN 'pjm interconnection llc' THEN 'PJM' WHEN 'constellation energy' THEN 'Constellation' WHEN 'constellation energy generation' THEN 'Constellation' WHEN 'constellation power' THEN 'Constellation' WHEN 'exelon generation' THEN 'Exelon'
WHEN 'duke energy ohio' THEN 'Duke Energy' WHEN 'duke energy ohio & kentucky' THEN 'Duke Energy' WHEN 'duke energy carolinas' THEN 'Duke Energy' WHEN 'first energy' THEN 'FirstEnergy' WHEN 'ferc' THEN 'FERC' ELSE nullif(n, '') END"""
STRIP_SQL = r"trim(regexp_replace(trim(regexp_replace(trim(entity), '\s*\([^)]+\)\s*$', '')), '(?i)[,.]?\s+(?:l\.?l\.?c\.?|llc|inc\.?|incorporated|corp\.?|corporation|co\.?|company|ltd\.?|limited|l\.?p\.?|llp|holdings?|group)\s*$', ''))"
_WHO = _PEOPLE + f""", who AS (SELECT k.*, {ENTITY_SQL} AS org FROM (SELECT *, {STRIP_SQL} AS n FROM kept) k),
seen AS (SELECT w.*, d.meeting_id, d.rto, d.title AS document_title, CASE WHEN d.doc_type NOT IN ('other', 'document') THEN d.doc_type END AS doc_type FROM who w JOIN stored_documents d ON d.id = w.document_id WHERE w.org IS NULL OR lower(w.name) <> lower(w.org))
"""
_SETS = "array_to_string(list_sort(list(DISTINCT rto)), ',') AS rtos, coalesce(array_to_string(list_sort(list(DISTINCT doc_type) FILTER (WHERE doc_type IS NOT NULL)), ','), '') AS doc_types"


@query(_WHO + f"SELECT lower(name) AS name_key, lower(coalesce(org, '')) AS org_key, {_SETS}, count(DISTINCT meeting_id) AS meetings FROM seen GROUP BY 1, 2")
def stakeholder_index(t):
    return analytics.stakeholder_index(people(t), t.stored_documents)


@query(_WHO + f"SELECT lower(org) AS org_key, {_SETS}, count(DISTINCT lower(name)) AS people, count(DISTINCT meeting_id) AS meetings FROM seen WHERE org IS NOT NULL GROUP BY 1")
def entity_index(t):
    return analytics.entity_index(people(t), t.stored_documents)


@query(_WHO + """, own AS (SELECT * FROM seen WHERE lower(name) <> lower(coalesce(entity, ''))),
roles AS (SELECT meeting_id, o, n, string_agg(role, ',' ORDER BY document_id, seq) AS roles FROM (SELECT DISTINCT ON (meeting_id, lower(coalesce(org, '')), lower(name), role) meeting_id, lower(coalesce(org, '')) AS o, lower(name) AS n, role, document_id, seq FROM own WHERE role <> '' ORDER BY meeting_id, lower(coalesce(org, '')), lower(name), role, document_id, seq) x GROUP BY 1, 2, 3),
docs AS (SELECT meeting_id, o, n, string_agg(cast(document_id AS string), ',' ORDER BY document_id) AS documents FROM (SELECT DISTINCT meeting_id, lower(coalesce(org, '')) AS o, lower(name) AS n, document_id FROM own) x GROUP BY 1, 2, 3),
one AS (SELECT meeting_id, lower(coalesce(org, '')) AS o, lower(name) AS n, arg_min(name, document_id * 10000000 + seq) AS name, arg_min(coalesce(org, 'Unaffiliated'), document_id * 10000000 + seq) AS org, arg_min(email, document_id * 10000000 + seq) FILTER (WHERE email <> '') AS email FROM own GROUP BY 1, 2, 3)
SELECT a.meeting_id, a.name, a.org, a.email, coalesce(r.roles, '') AS roles, d.documents, count(*) OVER (PARTITION BY a.meeting_id, a.org) AS org_people FROM one a JOIN docs d ON d.meeting_id = a.meeting_id AND d.o = a.o AND d.n = a.n LEFT JOIN roles r ON r.meeting_id = a.meeting_id AND r.o = a.o AND r.n = a.n""")
def meeting_stakeholders(t):
    rows = analytics.meeting_stakeholders(people(t), t.stored_documents)
    return rows.withColumn("documents", F.array_join(F.transform("documents", lambda d: d["id"].cast("string")), ","))


@query(f"""WITH typed AS (SELECT meeting_id, {DOC_TYPE_SQL} AS doc_type FROM (SELECT *, lower(concat_ws(' ', title, filename)) AS x FROM stored_documents) s)
SELECT meeting_id, doc_type, count(*) AS n, CASE WHEN list_position(['report','decision','proposal','vote','issue-charge','tariff','presentation','matrix','agenda','comment','minutes','manual','press-release','elibrary','other','document'], doc_type) > 0 THEN list_position(['report','decision','proposal','vote','issue-charge','tariff','presentation','matrix','agenda','comment','minutes','manual','press-release','elibrary','other','document'], doc_type) - 1 ELSE 16 END AS weight FROM typed GROUP BY 1, 2""")
def doc_type_tally(t):
    from ..functions.text import classify_document

    return analytics.doc_type_tally(t.stored_documents.withColumn("doc_type", classify_document(F.concat_ws(" ", "title", "filename"))))


@query(_EVENTS + f""", due AS (SELECT * FROM ev WHERE is_relevant AND meeting_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-26')
SELECT id, rto, title, meeting_date, meeting_time FROM due""")
def meetings_ahead(t):
    return analytics.meetings_ahead(events(t), TODAY).select("id", "rto", "title", "meeting_date", "meeting_time")


@query(_EVENTS + """, due AS (SELECT * FROM ev WHERE is_relevant AND meeting_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-26'),
turns AS (SELECT *, row_number() OVER (PARTITION BY rto ORDER BY meeting_date, coalesce(meeting_time, ''), id) AS turn FROM due),
leads AS (SELECT rto, meeting_date AS ld, coalesce(meeting_time, '') AS lt, id AS li FROM turns WHERE turn = 1)
SELECT id, rto, meeting_date, meeting_time, row_number() OVER (ORDER BY meeting_date, coalesce(meeting_time, ''), turn, ld, lt, li)::INTEGER AS place, greatest((SELECT count(*) FROM due) - 20, 0) AS left_over FROM (SELECT t.*, ld, lt, li, row_number() OVER (ORDER BY turn, ld, lt, li) AS k FROM turns t JOIN leads l ON l.rto = t.rto) x WHERE k <= 20""")
def diversify_round_robin(t):
    return analytics.diversify_round_robin(analytics.meetings_ahead(events(t), TODAY).select("id", "rto", "meeting_date", "meeting_time"), 20)


@query(_EVENTS + """, r AS (SELECT meeting_date, id, row_number() OVER (PARTITION BY meeting_date ORDER BY CASE WHEN is_relevant THEN 0 ELSE 1 END, coalesce(meeting_time, '99:99'), id) AS rn, count(*) OVER (PARTITION BY meeting_date) AS n, count(*) FILTER (WHERE is_relevant) OVER (PARTITION BY meeting_date) AS relevant FROM ev)
SELECT meeting_date, rn, id, greatest(n - 3, 0) AS more, relevant FROM r WHERE rn <= 3""")
def calendar_day_cells(t):
    return analytics.calendar_day_cells(events(t))


@query(_EVENTS + "SELECT id, meeting_time, CASE WHEN lag(meeting_date) OVER (PARTITION BY date_trunc('week', meeting_date) ORDER BY meeting_date, coalesce(meeting_time, ''), id) IS DISTINCT FROM meeting_date THEN meeting_date END AS shown_date FROM ev")
def agenda_rows(t):
    return analytics.agenda_rows(events(t))


@query(_EVENTS + "SELECT meeting_date - cast(dayofweek(meeting_date) AS integer) AS week_start, count(*) AS events, count(*) FILTER (WHERE is_relevant) AS relevant FROM ev GROUP BY 1")
def week_stats(t):
    return analytics.week_stats(events(t))


_TIMES = "(VALUES ('9:00 AM - 12:00 PM', 540, 720), ('1:30 p.m.', 810, NULL), ('10:00 AM – 3:00 PM MT', 600, 900), ('12:15 PM ET', 735, NULL)) s(label, start_min, end_min)"


@query(f"""WITH RECURSIVE timed AS (SELECT id, meeting_date, start_min, coalesce(end_min, start_min + 60) AS end_min, row_number() OVER (PARTITION BY meeting_date ORDER BY start_min, id) AS k FROM meetings JOIN {_TIMES} ON label = meeting_time),
laid AS (SELECT id, meeting_date, start_min, end_min, k, 0 AS lane, [end_min] AS ends FROM timed WHERE k = 1
UNION ALL SELECT id, meeting_date, start_min, end_min, k, CASE WHEN p > 0 THEN p - 1 ELSE len(ends) END, CASE WHEN p > 0 THEN list_concat(ends[1:p - 1], [end_min], ends[p + 1:]) ELSE list_append(ends, end_min) END
FROM (SELECT t.*, l.ends, coalesce(list_position(list_transform(l.ends, lambda e: e <= t.start_min), true), 0) AS p FROM laid l JOIN timed t ON t.meeting_date = l.meeting_date AND t.k = l.k + 1) x)
SELECT id, meeting_date, start_min::INTEGER AS start_min, end_min::INTEGER AS end_min, lane::INTEGER AS lane, (max(lane) OVER (PARTITION BY meeting_date) + 1)::INTEGER AS lanes FROM laid""")
def week_lanes(t):
    time = parse_meeting_time(F.col("meeting_time"))
    return analytics.week_lanes(t.meetings.select("id", "meeting_date", time["start_min"].alias("start_min"), time["end_min"].alias("end_min")))


def suggestion_index(t):
    """kind, label, search, n, date of the seven kinds of suggestions."""
    e, who = events(t), people(t)
    row = lambda df, kind, label, search, n="n", date=None: df.select(F.lit(kind).alias("kind"), label.alias("label"), F.lower(F.trim(search)).alias("search"), F.col(n).cast("long").alias("n"), (date if date is not None else F.lit(None).cast("date")).alias("date"))
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"))
    person = analytics.stakeholder_index(who, t.stored_documents)
    found = linking.meeting_issues(links(t), t.issues).join(t.issues.select(F.col("id").alias("issue_id"), "rto", "canonical_name"), "issue_id").groupBy("rto", "native_id", "canonical_name").agg(F.countDistinct("meeting_id").alias("n"))
    topic = F.create_map(*[F.lit(x) for kv in dims.TOPIC_LABELS.items() for x in kv])
    topics = count(e.select(F.explode("topics").alias("topic")), "topic").withColumn("label", F.try_element_at(topic, F.col("topic"))).where("label IS NOT NULL")
    parts = [
        row(person, "stakeholder", F.concat_ws(" / ", "name_key", "org_key"), F.concat_ws(" ", "name_key", "org_key"), "meetings"),
        row(analytics.entity_index(who, t.stored_documents), "entity", F.col("org_key"), F.col("org_key"), "meetings"),
        row(count(e.where("committee IS NOT NULL"), "rto", "committee"), "committee", F.concat_ws(" / ", "rto", "committee"), F.col("committee")),
        row(found, "initiative", F.concat_ws(" / ", "rto", "native_id"), F.concat_ws(" ", F.coalesce("canonical_name", F.lit("")), F.coalesce("native_id", F.lit("")))),
        row(topics, "topic", F.col("topic"), F.concat_ws(" ", "label", "topic")),
        row(e.withColumn("n", F.lit(1)), "meeting", F.col("id").cast("string"), F.col("title"), date=F.col("meeting_date")),
        row(count(e, "rto"), "rto", F.col("rto"), F.col("rto")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_SUGGEST = _WHO + ", " + _EVENTS[5:] + """, x AS (SELECT 'stakeholder' AS kind, lower(name) || ' / ' || lower(coalesce(org, '')) AS label, lower(name) || ' ' || lower(coalesce(org, '')) AS search, count(DISTINCT meeting_id) AS n, NULL::DATE AS date FROM seen GROUP BY 2, 3
UNION ALL SELECT 'entity', lower(org), lower(org), count(DISTINCT meeting_id), NULL FROM seen WHERE org IS NOT NULL GROUP BY 2
UNION ALL SELECT 'committee', rto || ' / ' || committee, lower(committee), count(*), NULL FROM ev WHERE committee IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'initiative', i.rto || ' / ' || native_id, lower(trim(coalesce(canonical_name, '') || ' ' || native_id)), count(DISTINCT r.matched_meeting_id), NULL FROM matched_references r JOIN issues i ON i.id = r.issue_id WHERE r.matched_meeting_id IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'topic', tp, CASE tp WHEN 'storage' THEN 'storage & psh storage' WHEN 'capacity-ra' THEN 'capacity & ra capacity-ra' WHEN 'transmission' THEN 'transmission transmission' WHEN 'price-formation' THEN 'price formation price-formation' ELSE 'ferc policy ferc-policy' END, count(*), NULL FROM (SELECT unnest(topics) AS tp FROM ev) u GROUP BY 2
UNION ALL SELECT 'meeting', cast(id AS string), lower(title), 1, meeting_date FROM ev UNION ALL SELECT 'rto', rto, lower(rto), count(*), NULL FROM ev GROUP BY 2),
q AS (SELECT unnest(['pe', 'is']) AS q),
r AS (SELECT q, kind, label, row_number() OVER (PARTITION BY q, kind ORDER BY CASE WHEN kind = 'meeting' THEN date END, CASE WHEN kind NOT IN ('meeting', 'rto', 'topic') AND starts_with(search, q) THEN 0 ELSE 1 END, CASE WHEN kind <> 'meeting' THEN n END DESC, label) AS rn FROM x JOIN q ON contains(search, q) AND length(q) >= 2)
SELECT q, kind, label, rn FROM r WHERE rn <= CASE WHEN kind IN ('rto', 'topic') THEN 4 ELSE 5 END"""


@query(_SUGGEST, stored=True)
def search_suggestions(t):
    index, out = TextIndex(suggestion_index(t), ["kind", "label"], F.col("search")), None
    for text in ("pe", "is"):
        part = analytics.search_suggestions(index, text).select(F.lit(text).alias("q"), "kind", "label", "rn")
        out = part if out is None else out.unionByName(part)
    return out


@query(_EVENTS + """SELECT id, week, rn FROM (SELECT id, cast(date_trunc('week', meeting_date) AS date) AS week, row_number() OVER (PARTITION BY date_trunc('week', meeting_date) ORDER BY meeting_date, id) AS rn FROM ev WHERE is_relevant) x WHERE rn <= 5""")
def digest_top_items(t):
    from pyspark.sql import Window

    week = analytics.monday(F.col("meeting_date"))
    return events(t).where("is_relevant").select("id", week.alias("week"), F.row_number().over(Window.partitionBy(week).orderBy("meeting_date", "id")).alias("rn")).where("rn <= 5")


@query(_EVENTS + "SELECT id, rto, meeting_date FROM ev WHERE is_relevant AND rto IN ('PJM', 'MISO', 'SPP') AND (list_contains(topics, 'storage') OR list_contains(topics, 'transmission')) AND contains(lower(concat_ws(' ', title, committee, rto)), 'committee')")
def filter_events(t):
    return analytics.filter_events(events(t), "relevant", ["PJM", "MISO", "SPP"], ["storage", "transmission"], "committee").select("id", "rto", "meeting_date")


#: Texts that are sought: in people and organisations, in issues, in titles, with spaces around, in one character.
_SOUGHT = ("acme power", "iss12", "straw prop", "person 7", "ü")


@query(_WHO + ", " + _EVENTS[5:].rstrip() + ", " + _DOC_ISSUES[5:] + f""", parts AS (SELECT id, concat_ws(' ', coalesce(title, ''), coalesce(committee, ''), rto) AS part FROM meetings UNION ALL SELECT meeting_id, title FROM stored_documents
UNION ALL SELECT d.meeting_id, concat(k.name, ' ', coalesce(k.entity, '')) FROM kept k JOIN stored_documents d ON d.id = k.document_id
UNION ALL SELECT r.matched_meeting_id, i.native_id FROM matched_references r JOIN issues i ON i.id = r.issue_id UNION ALL SELECT d.meeting_id, i.native_id FROM di JOIN stored_documents d ON d.id = di.document_id JOIN issues i ON i.id = di.issue_id),
sought AS (SELECT unnest({list(_SOUGHT)}) AS q)
SELECT 'today' AS way, id, rto, meeting_date FROM ev WHERE meeting_date BETWEEN DATE '{TODAY}' AND DATE '2024-01-19'
UNION ALL SELECT 'facet', id, rto, meeting_date FROM ev WHERE id IN (SELECT d.meeting_id FROM who w JOIN stored_documents d ON d.id = w.document_id WHERE w.org = 'Acme Power')
UNION ALL SELECT q, id, rto, meeting_date FROM ev JOIN (SELECT DISTINCT q, id AS part_of FROM sought JOIN parts ON contains(lower(part), q)) h ON h.part_of = ev.id""", stored=True)
def search_events(t):
    """The ways of the filter one by one: the days of this week, one entity, texts by an index over the events' haystacks."""
    from ..operators import matching

    who, rows, nested = people(t), events(t), feed(t)
    index = TextIndex(nested.select("id", analytics.haystack(nested).alias("hay")), ["id"], F.col("hay"))
    facet = matching.match_facet(t.meetings, t.stored_documents, who, None, "entity", entity="Acme Power")
    ways = {"today": {"view": "today", "today": TODAY, "week_end": "2024-01-19"}, "facet": {"facet": facet}} | {q: {"text": q, "index": index} for q in _SOUGHT}
    out = None
    for way, how in ways.items():
        part = analytics.filter_events(rows, **how).select(F.lit(way).alias("way"), "id", "rto", "meeting_date")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT id, rto, meeting_date FROM meetings WHERE meeting_date BETWEEN DATE '{TODAY}' - 7 AND DATE '{TODAY}' + 5")
def date_window_filter(t):
    day = F.lit(TODAY).cast("date")
    return t.meetings.where(F.col("meeting_date").between(F.date_sub(day, 7), F.date_add(day, 5))).select("id", "rto", "meeting_date")


@query("SELECT id, title FROM meetings WHERE rto = 'PJM' AND committee = 'Operating Committee' AND contains(lower(concat(title, ' ', coalesce(committee, ''))), 'operating') AND hydro_relevant = 1")
def filter_events_basic(t):
    return t.meetings.where((F.col("rto") == "PJM") & (F.col("committee") == "Operating Committee") & F.lower(F.concat_ws(" ", "title", "committee")).contains("operating") & (F.col("hydro_relevant") == 1)).select("id", "title")


@query("SELECT id, rto, meeting_date FROM meetings WHERE hydro_relevant IS NULL AND rto = 'CAISO'")
def stage1_candidates(t):
    from ..operators.screening import stage1_candidates as pick

    return pick(t.meetings, "CAISO").select("id", "rto", "meeting_date")


def screenable(t):
    return t.stored_documents.select("id", "rto", "meeting_id", "source_names_hydro", F.when(F.col("id") % 3 != 0, "t").alias("ai_processed_at"), F.when(F.col("id") % 2 == 0, "t").alias("stakeholders_extracted_at"))


_GATED = "SELECT d.id, d.rto, d.meeting_id, m.meeting_date FROM stored_documents d JOIN meetings m ON m.id = d.meeting_id WHERE (m.hydro_relevant = 1 OR d.rto IN ('NYISO', 'SPP', 'SPP Markets +', 'MISO', 'ERCOT'))"


@query(_GATED + " AND (d.id % 3 = 0 OR d.id % 2 <> 0) ORDER BY m.meeting_date DESC, d.id LIMIT 200")
def stage2_candidates(t):
    from ..operators.screening import stage2_candidates as pick

    return pick(screenable(t), t.meetings)


@query(_GATED + " AND d.source_names_hydro IS NULL AND d.rto = 'MISO' AND m.meeting_date BETWEEN DATE '2024-01-03' AND DATE '2024-02-20'")
def stage2_unrated(t):
    from ..operators.screening import stage2_candidates as pick

    return pick(screenable(t), t.meetings, rto="miso", since="2024-01-03", until="2024-02-20", rescreen=True, only_unrated=True, limit=None)


@query("""SELECT m.id, CASE WHEN s.start_min IS NOT NULL THEN s.start_min END AS start_min, s.end_min FROM meetings m JOIN (VALUES ('9:00 AM - 12:00 PM', 540, 720), ('1:30 p.m.', 810, NULL), ('10:00 AM – 3:00 PM MT', 600, 900), ('12:15 PM ET', 735, NULL), ('TBD', NULL, NULL), ('', NULL, NULL)) s(label, start_min, end_min) ON s.label = coalesce(m.meeting_time, '')""")
def parse_meeting_times(t):
    time = parse_meeting_time(F.col("meeting_time"))
    return t.meetings.select("id", time["start_min"].alias("start_min"), time["end_min"].alias("end_min"))


_RESOLVED = """WITH x AS (SELECT m.id, m.meeting_date, m.rto, s.label, s.start_min, s.end_min, coalesce(s.tag, CASE WHEN rto IN ('PJM', 'NYISO', 'ISO-NE') THEN 'America/New_York' WHEN rto = 'CAISO' THEN 'America/Los_Angeles' WHEN rto <> 'FERC' THEN 'America/Chicago' END) AS zone
FROM meetings m JOIN (VALUES ('9:00 AM - 12:00 PM', 540, 720, NULL), ('1:30 p.m.', 810, NULL, NULL), ('10:00 AM – 3:00 PM MT', 600, 900, 'America/Denver'), ('12:15 PM ET', 735, NULL, 'America/New_York'), ('TBD', NULL, NULL, NULL), ('', NULL, NULL, NULL)) s(label, start_min, end_min, tag) ON s.label = coalesce(m.meeting_time, ''))
"""


_SHORT = "CASE zone WHEN 'America/New_York' THEN 'E' WHEN 'America/Chicago' THEN 'C' WHEN 'America/Denver' THEN 'M' ELSE 'P' END || 'ST'"


@query(_RESOLVED + f"""SELECT id, coalesce(strftime(timezone('America/New_York', timezone('UTC', s)), '%-I:%M %p') || coalesce(' – ' || strftime(timezone('America/New_York', timezone('UTC', e)), '%-I:%M %p'), '') || ' EST', CASE WHEN start_min IS NOT NULL THEN label END) AS shown,
CASE WHEN s IS NOT NULL THEN 'EST' END AS zone_short, CASE WHEN s IS NOT NULL AND zone <> 'America/New_York' THEN strftime(timezone(zone, timezone('UTC', s)), '%-I:%M %p') || coalesce(' – ' || strftime(timezone(zone, timezone('UTC', e)), '%-I:%M %p'), '') || ' ' || {_SHORT} END AS source_shown
FROM (SELECT *, cast(timezone('UTC', timezone(zone, meeting_date + to_minutes(start_min))) AS timestamp) AS s, cast(timezone('UTC', timezone(zone, meeting_date + to_minutes(end_min))) AS timestamp) AS e FROM x) y""")
def meeting_time_labels(t):
    """The times as shown to a viewer in New York; all days of the stand-in meetings are winter days, the clock changes are tested on literal ones."""
    known = F.when(F.col("rto") != "FERC", F.col("rto"))
    r = resolve_meeting_time(F.col("meeting_date"), F.col("meeting_time"), known)
    return t.meetings.select("id", r.alias("r")).select("id", "r.shown", "r.zone_short", "r.source_shown")


@query(_RESOLVED + """SELECT id, zone, s AS start_utc, e AS end_utc, coalesce(strftime(timezone('America/New_York', timezone('UTC', s)), '%H:%M'), CASE label WHEN '9:00 AM - 12:00 PM' THEN '09:00' WHEN '1:30 p.m.' THEN '13:30' END) AS time24, CASE WHEN s IS NULL AND start_min IS NOT NULL THEN label END AS raw
FROM (SELECT *, cast(timezone('UTC', timezone(zone, meeting_date + to_minutes(start_min))) AS timestamp) AS s, cast(timezone('UTC', timezone(zone, meeting_date + to_minutes(end_min))) AS timestamp) AS e FROM x) y""")
def resolve_meeting_times(t):
    """FERC stands for a source without a known zone."""
    known = F.when(F.col("rto") != "FERC", F.col("rto"))
    r = resolve_meeting_time(F.col("meeting_date"), F.col("meeting_time"), known)
    return t.meetings.select("id", r.alias("r")).select("id", "r.zone", F.col("r.start_utc").cast("timestamp_ntz").alias("start_utc"), F.col("r.end_utc").cast("timestamp_ntz").alias("end_utc"), "r.time24", "r.raw")


@query("""SELECT id, CASE WHEN label IN ('', 'TBD') THEN NULL WHEN label LIKE '%MT' THEN '10:00 AM – 3:00 PM' ELSE label END AS found FROM (SELECT id, coalesce(meeting_time, '') AS label FROM meetings) x""")
def time_in_text(t):
    shown = F.concat(F.lit("Room 12 opens at "), F.coalesce("meeting_time", F.lit("")), F.lit("; lunch follows, see item 3:15"))
    return t.meetings.select("id", time_in_text_of(shown).alias("found"))
