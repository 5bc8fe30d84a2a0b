"""Registered queries: folds, links and exports of the keyed store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, folds, linking
from ..sources import feeds
from .registry import query


def doc_sightings(t):
    """Document sightings with their meeting's id and a type by the common rules."""
    m = t.meetings.select("id", "rto", F.col("title").alias("meeting_title"), "meeting_date")
    d = t.document_scrapes.drop("extracted_text").join(m, ["rto", "meeting_title", "meeting_date"])
    return d.withColumn("meeting_id", F.col("id")).drop("id").withColumn("doc_type", text.classify_document(F.concat_ws(" ", "title", "filename")))


def resolved(t):
    return t.once("resolved", lambda: _resolved(t))


def _resolved(t):
    return linking.resolve_issue_references(t.issue_references, t.stored_documents.select("id", "download_url"), t.meetings.select("id", "detail_url"))


def links(t):
    """The references that name a document or a meeting, without their URLs."""
    return t.once("links", lambda: _resolved(t).where("matched_document_id IS NOT NULL OR matched_meeting_id IS NOT NULL").drop("ref_url"))


@query("SELECT id, rto, title, meeting_date, meeting_time, committee, location, source_url, detail_url, materials_url, last_seq FROM meetings")
def upsert_meetings(t):
    return folds.upsert_meetings(t.meeting_scrapes)


DOC_TYPE_SQL = "CASE WHEN regexp_matches(x, 'agenda') THEN 'agenda' WHEN regexp_matches(x, 'minutes') THEN 'minutes' WHEN regexp_matches(x, 'presentation|slide|briefing') THEN 'presentation' WHEN regexp_matches(x, 'report|summary|update') THEN 'report' WHEN regexp_matches(x, 'vote|poll|ballot|motion') THEN 'vote' WHEN regexp_matches(x, 'manual|m[0-9][0-9]') THEN 'manual' WHEN regexp_matches(x, 'matrix') THEN 'matrix' WHEN regexp_matches(x, 'issue.?charge|problem.?statement') THEN 'issue-charge' WHEN regexp_matches(x, 'proposal|straw|issue.?paper') THEN 'proposal' WHEN regexp_matches(x, 'comment') THEN 'comment' WHEN regexp_matches(x, 'tariff|amendment') THEN 'tariff' WHEN regexp_matches(x, 'decision|memo') THEN 'decision' ELSE 'other' END"
_TYPED = f"""WITH typed AS (SELECT s.*, m.id AS meeting_id, {DOC_TYPE_SQL} AS doc_type FROM (SELECT d.*, lower(concat_ws(' ', title, filename)) AS x FROM document_scrapes d) s
JOIN meetings m ON m.rto = s.rto AND m.title = s.meeting_title AND m.meeting_date = s.meeting_date),
folded AS (SELECT download_url, min(seq) AS id, arg_min(meeting_id, seq) AS meeting_id, arg_min(rto, seq) AS rto, arg_max(doc_type, seq) AS doc_type, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title,
  arg_max(filename, seq) AS filename, arg_max(posted_date, seq) FILTER (WHERE posted_date IS NOT NULL) AS posted_date FROM typed GROUP BY download_url)
"""


@query(_TYPED + "SELECT id, download_url, meeting_id, rto, doc_type, title, filename, posted_date FROM folded")
def upsert_documents(t):
    return folds.upsert_documents(doc_sightings(t)).drop("member_url")


@query("""SELECT rto, short_title, arg_max(canonical_name, id) FILTER (WHERE canonical_name IS NOT NULL) AS canonical_name, arg_max(status, id) FILTER (WHERE status IS NOT NULL) AS status,
arg_max(is_open, id) FILTER (WHERE is_open IS NOT NULL) AS is_open, min(id) AS first_seq, max(id) AS last_seq FROM issues GROUP BY rto, short_title""")
def upsert_issues(t):
    return folds.upsert(t.issues.withColumnRenamed("id", "seq"), ["rto", "short_title"], ["canonical_name", "status", "is_open"])


@query("""SELECT l_partkey AS issue_id, l_orderkey % 2000 AS ref_key, arg_max(concat(l_returnflag, cast(l_suppkey AS string)), seq) FILTER (WHERE l_returnflag <> 'N') AS ref_title, min(seq) AS first_seq, max(seq) AS last_seq
FROM (SELECT *, l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber AS seq FROM lineitem) x GROUP BY 1, 2""")
def upsert_issue_references(t):
    rows = t.base("lineitem").select(F.col("l_partkey").alias("issue_id"), (F.col("l_orderkey") % 2000).alias("ref_key"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", F.col("l_suppkey").cast("string"))).alias("ref_title"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("seq"))
    return folds.upsert(rows, ["issue_id", "ref_key"], ["ref_title"])


_PEOPLE = """WITH people AS (SELECT p.seq, p.document_id, trim(p.name) AS name, CASE WHEN trim(p.entity) <> '' THEN trim(p.entity) END AS entity, lower(p.role) AS role,
  CASE WHEN contains(lower(d.text), lower(p.email)) THEN p.email END AS email FROM document_stakeholders p LEFT JOIN documents d ON d.doc_id = p.document_id WHERE trim(p.name) <> ''),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, name, entity ORDER BY seq) AS rn FROM people) x WHERE entity IS NULL OR rn = 1)
"""


def people(t):
    return t.once("people", lambda: _people(t))


def _people(t):
    texts = t.base("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("source_text"))
    return folds.replace_stakeholders(None, t.document_stakeholders, texts)


_AGAIN = _PEOPLE.replace("LEFT JOIN documents d ON d.doc_id = p.document_id WHERE trim(p.name) <> ''", "LEFT JOIN documents d ON d.doc_id = p.document_id WHERE trim(p.name) <> '' AND p.seq % 3 = 0 AND p.document_id % 2 = 0").replace("WITH people AS", "again AS").replace("kept AS", "new AS").replace("FROM people)", "FROM again)")


@query(_PEOPLE.rstrip() + ",\n" + _AGAIN + """SELECT document_id, seq, name, entity, role, email FROM new
UNION ALL SELECT document_id, seq, name, entity, role, email FROM kept WHERE document_id NOT IN (SELECT document_id FROM document_stakeholders WHERE seq % 3 = 0 AND document_id % 2 = 0)""")
def replace_stakeholders(t):
    """Stored rows of all documents, of which those of some are replaced by new ones (fewer of them)."""
    texts = t.base("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("source_text"))
    return folds.replace_stakeholders(people(t), t.document_stakeholders.where("seq % 3 = 0 AND document_id % 2 = 0"), texts)


@query("""SELECT d.id, d.download_url, CASE WHEN s.doc_id IS NOT NULL THEN s.source_names_hydro ELSE d.hydro_relevant END AS hydro_relevant, coalesce(CASE WHEN s.doc_id % 2 = 0 THEN concat('New ', cast(s.doc_id AS string)) END, d.ai_summary) AS ai_summary
FROM stored_documents d LEFT JOIN screenings s ON s.doc_id = d.id""")
def apply_document_screening(t):
    new = t.screenings.select(F.col("doc_id").alias("id"), F.col("source_names_hydro").alias("hydro_relevant"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("New "), F.col("doc_id").cast("string"))).alias("ai_summary"))
    return folds.apply_document_screening(t.stored_documents.select("id", "download_url", "hydro_relevant", "ai_summary"), new)


@query("""SELECT d.id, CASE WHEN m.meeting_date < DATE '2024-01-20' AND d.hydro_relevant IS NOT NULL THEN length(x.text) ELSE 0 END AS chars_freed,
CASE WHEN m.meeting_date < DATE '2024-01-20' AND d.hydro_relevant IS NOT NULL THEN NULL ELSE md5(x.text) END AS text_md5
FROM stored_documents d JOIN documents x ON x.doc_id = d.id LEFT JOIN meetings m ON m.id = d.meeting_id""")
def prune_extracted_text(t):
    texts = t.base("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("extracted_text"))
    out = folds.prune_extracted_text(t.stored_documents.join(texts, "id"), t.meetings, "2024-02-19", 30)
    return out.select("id", "chars_freed", F.md5("extracted_text").alias("text_md5"))


@query("SELECT seq, rto, title, meeting_date, meeting_time FROM (SELECT seq, rto, title, meeting_date, meeting_time, row_number() OVER (PARTITION BY title, meeting_date, meeting_time ORDER BY seq) AS rn FROM meeting_scrapes) x WHERE rn = 1")
def dedup_events(t):
    return folds.dedup_events(t.meeting_scrapes.select("seq", "rto", "title", "meeting_date", "meeting_time"))


@query("""SELECT title, meeting_date, id, rto FROM meetings WHERE id % 3 <> 0 UNION ALL SELECT title, meeting_date, id, rto FROM meetings f WHERE id % 2 = 0
AND NOT EXISTS (SELECT 1 FROM meetings m WHERE m.id % 3 <> 0 AND m.title = f.title AND m.meeting_date = f.meeting_date)""")
def union_new_meetings(t):
    m = t.meetings.select("title", "meeting_date", "id", "rto")
    return folds.union_new_meetings(m.where("id % 3 <> 0"), m.where("id % 2 = 0"))


@query("SELECT DISTINCT rto, committee FROM meetings")
def filter_options(t):
    return t.meetings.select("rto", "committee").distinct()


@query("SELECT issue_id, ref_url, matched_document_id, matched_meeting_id FROM matched_references")
def resolve_issue_references(t):
    return resolved(t)


@query("SELECT r.matched_meeting_id AS meeting_id, i.id AS issue_id, i.native_id, coalesce(canonical_name, short_title, native_id) AS name, i.status FROM matched_references r JOIN issues i ON i.id = r.issue_id WHERE r.matched_meeting_id IS NOT NULL")
def meeting_issues(t):
    return linking.meeting_issues(resolved(t), t.issues)


_DOC_ISSUES = """WITH md AS (SELECT DISTINCT r.issue_id, d.meeting_id FROM matched_references r JOIN stored_documents d ON d.id = r.matched_document_id),
di AS (SELECT DISTINCT issue_id, document_id FROM (SELECT issue_id, matched_document_id AS document_id FROM matched_references WHERE matched_document_id IS NOT NULL
  UNION ALL SELECT r.issue_id, d.id FROM matched_references r JOIN stored_documents d ON d.meeting_id = r.matched_meeting_id WHERE NOT EXISTS (SELECT 1 FROM md WHERE md.issue_id = r.issue_id AND md.meeting_id = r.matched_meeting_id)) u)
"""


@query(_DOC_ISSUES + "SELECT issue_id, document_id FROM di", stored=True)
def document_issues(t):
    return linking.document_issues(links(t), t.stored_documents)


_ISSUE_LIST = """SELECT i.* REPLACE (is_open <> 0 AS is_open), coalesce(canonical_name, short_title, native_id) AS name, coalesce(n.total_refs, 0) AS total_refs, coalesce(n.matched_refs, 0) AS matched_refs
FROM issues i LEFT JOIN (SELECT issue_id, count(*) AS total_refs, count(matched_document_id) AS matched_refs FROM matched_references GROUP BY 1) n ON n.issue_id = i.id"""


@query(_ISSUE_LIST)
def issues_with_reference_counts(t):
    return linking.issues_with_reference_counts(t.issues, resolved(t))


_CORPUS = _PEOPLE + """, pairs AS (SELECT DISTINCT issue_id, document_id FROM (SELECT issue_id, matched_document_id AS document_id FROM matched_references WHERE matched_document_id IS NOT NULL
  UNION ALL SELECT r.issue_id, d.id FROM matched_references r JOIN stored_documents d ON d.meeting_id = r.matched_meeting_id) u),
named AS (SELECT DISTINCT p.document_id, canonical_name, short_title, native_id, status FROM pairs p JOIN issues i ON i.id = p.issue_id),
names AS (SELECT document_id, list(coalesce(canonical_name, short_title, native_id) || coalesce(' [' || status || ']', '') ORDER BY canonical_name NULLS FIRST, short_title NULLS FIRST, native_id NULLS FIRST, status NULLS FIRST) AS l FROM named GROUP BY 1),
who AS (SELECT document_id, list(name || coalesce(' (' || entity || ')', '') ORDER BY entity NULLS FIRST, name) AS l FROM kept GROUP BY 1),
flat AS (SELECT d.id, d.rto, m.meeting_date, m.committee, m.title AS meeting_title, d.doc_type, coalesce(d.title, d.filename) AS title, d.posted_date, d.hydro_relevance_reason AS relevance_reason, replace(coalesce(d.topics, ''), ';', '; ') AS topics,
  coalesce(d.directness, 'unrated') AS directness, d.source_names_hydro = 1 AS source_names_hydro, CASE WHEN d.evidence LIKE '[{%' THEN concat('c', cast(d.id AS string), ' — "q" | ? — "x" [UNVERIFIED]') ELSE '' END AS evidence,
  coalesce(array_to_string(n.l, '; '), '') AS initiatives, coalesce(array_to_string(w.l, '; '), '') AS stakeholders, d.ai_summary, d.hydro_read_through, d.download_url AS url, d.member_url
FROM stored_documents d JOIN meetings m ON m.id = d.meeting_id LEFT JOIN names n ON n.document_id = d.id LEFT JOIN who w ON w.document_id = d.id WHERE d.hydro_relevant = 1)
"""
#: The reader's line of a row of `flat`, by id.
_LINES = """, cells AS (SELECT id, unnest([rto, cast(meeting_date AS varchar), committee, meeting_title, doc_type, title, posted_date, relevance_reason, initiatives, stakeholders, ai_summary, url]) AS v, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], 1) AS k FROM flat),
lines AS (SELECT id, string_agg(CASE WHEN regexp_matches(coalesce(v, ''), '[",\n\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE coalesce(v, '') END, ',' ORDER BY k) AS line FROM cells GROUP BY id)
"""


def corpus(t):
    return linking.corpus(t.stored_documents, t.meetings, links(t), t.issues, people(t))


@query(_CORPUS + "SELECT * FROM flat", stored=True)
def hydro_corpus(t):
    return feeds.flat_corpus(corpus(t))


@query(_CORPUS + "SELECT id, rto, meeting_date, directness FROM flat WHERE rto IN ('PJM', 'CAISO', 'MISO', 'ERCOT') AND meeting_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'")
def filter_corpus(t):
    rows = corpus(t).select("id", "rto", "meeting_date", "directness")
    return rows.where(F.col("rto").isin("PJM", "CAISO", "MISO", "ERCOT") & F.col("meeting_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date")))


@query(_CORPUS + _LINES + "SELECT rto, count(*) AS documents, min(meeting_date) AS first_date, max(meeting_date) AS last_date, greatest(1, max(meeting_date) - min(meeting_date)) AS span_days, sum(strlen(line) + 2)::bigint AS csv_bytes FROM flat JOIN lines USING (id) WHERE meeting_date >= DATE '2024-01-05' GROUP BY rto", stored=True)
def corpus_profile(t):
    """Of the selection from a day on: counts, span and the bytes of the reader's lines (json_bytes, not compared, of compact JSON)."""
    rows = corpus(t).where(F.col("meeting_date") >= F.lit("2024-01-05").cast("date"))
    return analytics.corpus_profile(rows).drop("json_bytes")


_ISSUE = "{'rto': i.rto, 'native_id': i.native_id, 'canonical_name': i.canonical_name, 'status': i.status, 'stakeholder_phase': i.stakeholder_phase, 'committee_owner': i.committee_owner, 'is_open': i.is_open, 'url': i.url}"
_CALENDAR = _PEOPLE.rstrip() + ", " + _DOC_ISSUES[5:] + f""", dx AS (SELECT document_id, list({_ISSUE} ORDER BY canonical_name NULLS FIRST, i.rto, i.native_id) AS l FROM di JOIN issues i ON i.id = di.issue_id GROUP BY 1),
dq AS (SELECT document_id, list({{'name': name, 'entity': entity, 'role': role, 'email': email}} ORDER BY entity NULLS FIRST, name, role NULLS FIRST, email NULLS FIRST) AS l FROM kept GROUP BY 1),
dd AS (SELECT d.meeting_id, count(*) AS n, list({{'type': d.doc_type, 'title': d.title, 'filename': d.filename, 'url': d.download_url, 'member_url': d.member_url, 'posted_date': d.posted_date, 'hydro_relevant': d.hydro_relevant <> 0, 'hydro_relevance_reason': d.hydro_relevance_reason,
  'ai_summary': d.ai_summary, 'hydro_read_through': d.hydro_read_through, 'source_names_hydro': d.source_names_hydro <> 0, 'topics': CASE WHEN d.topics <> '' THEN string_split(d.topics, ';') ELSE [] END, 'directness': d.directness,
  'evidence': coalesce(from_json(d.evidence, '[{{"claim":"VARCHAR","quote":"VARCHAR","verified":"BOOLEAN"}}]'), []), 'issues': coalesce(dx.l, []), 'stakeholders': coalesce(dq.l, [])}} ORDER BY d.id) AS l
  FROM stored_documents d LEFT JOIN dx ON dx.document_id = d.id LEFT JOIN dq ON dq.document_id = d.id GROUP BY 1),
mi AS (SELECT matched_meeting_id AS mid, list({_ISSUE} ORDER BY canonical_name NULLS FIRST, i.rto, i.native_id) AS l FROM matched_references r JOIN issues i ON i.id = r.issue_id WHERE matched_meeting_id IS NOT NULL GROUP BY 1)
SELECT m.id, to_json({{'id': m.id, 'title': m.title, 'date': m.meeting_date, 'time': m.meeting_time, 'rto': m.rto, 'committee': m.committee, 'source_url': m.source_url, 'detail_url': m.detail_url, 'materials_url': m.materials_url, 'meeting_hydro_relevant': m.hydro_relevant <> 0, 'meeting_hydro_reason': m.hydro_relevance_reason,
  'issues': coalesce(mi.l, []), 'documents': coalesce(dd.l, [])}})::VARCHAR AS json FROM meetings m LEFT JOIN dd ON dd.meeting_id = m.id LEFT JOIN mi ON mi.mid = m.id"""


def shown_calendar(e):
    """The nested feed as JSON text, for comparison: every field of a meeting, its issues, documents and people."""
    return e.select("id", feeds.event_json(e).alias("json"))


def feed(t, in_order=False, as_json=False):
    return linking.calendar_events(t.meetings, t.stored_documents, links(t), t.issues, people(t), in_order, as_json)


@query(_CALENDAR, stored=True)
def calendar_events(t):
    return feed(t, as_json=True)


_RELATED = _TYPED + """, d AS (SELECT f.id, f.meeting_id AS event_id, f.rto, CASE WHEN f.id % 7 <> 3 THEN f.doc_type END AS doc_type, m.meeting_date AS event_date, CASE WHEN s.topics <> '' THEN string_split(s.topics, ';') ELSE [] END AS topics, s.ai_summary FROM folded f JOIN meetings m ON m.id = f.meeting_id JOIN screenings s ON s.doc_id = f.id),
p AS (SELECT a.id, b.id AS related_id, b.rto AS related_rto, abs(a.event_date - b.event_date) AS day_gap, len(list_intersect(a.topics, b.topics)) AS shared, coalesce(a.doc_type, 'document') = coalesce(b.doc_type, 'document') AS same_type FROM d a JOIN d b ON a.rto <> b.rto AND a.event_id <> b.event_id AND abs(a.event_date - b.event_date) <= 10 AND b.ai_summary IS NOT NULL),
q AS (SELECT *, CASE WHEN same_type THEN 4 ELSE 0 END + shared AS score, same_type AND shared > 0 AS strong FROM p WHERE same_type OR shared > 0),
r AS (SELECT *, count(*) FILTER (WHERE strong) OVER (PARTITION BY id) AS n_strong FROM q),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, day_gap, related_id) AS rn FROM r WHERE n_strong < 2 OR strong)
"""


@query(_RELATED + "SELECT id, related_id, related_rto, day_gap, shared, same_type, score, rn FROM z WHERE rn <= 12")
def related_documents(t):
    return linking.related_documents(dated_documents(t))


@query(_RELATED + """, g AS (SELECT id, related_rto, string_agg(cast(related_id AS string), ',' ORDER BY rn) AS items, count(*) AS n, max(score) AS best FROM z WHERE rn <= 12 GROUP BY 1, 2)
SELECT id, related_rto, items, best, row_number() OVER (PARTITION BY id ORDER BY best DESC, n DESC, related_rto) AS place FROM g""")
def related_by_rto(t):
    rows = linking.related_by_rto(linking.related_documents(dated_documents(t)))
    return rows.withColumn("items", F.array_join(F.transform("items", lambda i: i["id"].cast("string")), ","))


def dated_documents(t):
    """Some documents have no type."""
    d = folds.upsert_documents(doc_sightings(t)).select("id", F.col("meeting_id").alias("event_id"), "rto", F.when(F.col("id") % 7 != 3, F.col("doc_type")).alias("doc_type"))
    m = t.meetings.select(F.col("id").alias("event_id"), F.col("meeting_date").alias("event_date"))
    s = t.screenings.select(F.col("doc_id").alias("id"), text.topics_array(F.col("topics")).alias("topics"), "ai_summary")
    return d.join(m, "event_id").join(s, "id")


@query("""WITH d AS (SELECT id, rto, meeting_id, CASE id % 6 WHEN 0 THEN download_url WHEN 2 THEN concat(download_url, '.ZIP') ELSE concat(download_url, '.zip#z=a.pdf') END AS url, CASE WHEN id % 7 = 0 THEN 'https://own.example' END AS member_url FROM stored_documents),
f AS (SELECT d.id, d.rto, d.url, CASE WHEN d.rto IN ('SPP', 'SPP Markets +') AND d.member_url IS NULL AND d.id % 6 <> 0 AND contains(m.materials_url, '/spp-documents-filings/?id=') THEN m.materials_url ELSE d.member_url END AS member_url FROM d LEFT JOIN meetings m ON m.id = d.meeting_id)
SELECT id, rto, member_url, rto IN ('SPP', 'SPP Markets +') AND member_url IS NULL AND id % 6 <> 0 AS still_missing FROM f""")
def backfill_member_url(t):
    k = F.col("id") % 6
    url = F.when(k == 0, F.col("download_url")).when(k == 2, F.concat("download_url", F.lit(".ZIP"))).otherwise(F.concat("download_url", F.lit(".zip#z=a.pdf")))
    docs = t.stored_documents.withColumns({"download_url": url, "member_url": F.when(F.col("id") % 7 == 0, "https://own.example")})
    return linking.backfill_member_url(docs, t.meetings).select("id", "rto", "member_url", "still_missing")


@query("""SELECT DISTINCT m.id AS meeting_id, f.download_url FROM meetings m JOIN (SELECT download_url, rto AS folder, DATE '2024-01-01' + cast(id % 30 AS integer) AS day FROM stored_documents UNION ALL SELECT download_url, rto, DATE '2024-01-01' + cast(id % 30 + 1 AS integer) FROM stored_documents) f ON f.folder = m.rto AND f.day = m.meeting_date""")
def match_files_by_date(t):
    from ..functions.dates import expand_compact_dates

    day = lambda s: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30 + s).cast("int")), "yyyyMMdd")
    files = t.stored_documents.select("download_url", F.col("rto").alias("folder"), F.concat(day(0), F.lit("-"), F.substring(day(1), 5, 4), F.lit("-agenda.pdf")).alias("file")).withColumn("dates", expand_compact_dates(F.col("file")))
    meetings = t.meetings.select("id", F.col("rto").alias("folder"), F.array("meeting_date").alias("dates"))
    return linking.match_files_by_date(files, meetings)
