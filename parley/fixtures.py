"""Stand-in tables: SQL text, valid in Spark and in DuckDB, that builds the meeting tables from the star-schema ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "documents", "labels", "part", "lineitem", "orders", "pages", "benchmark")


def rto(key: str) -> str:
    return f"CASE {key} % 9 WHEN 0 THEN 'PJM' WHEN 1 THEN 'CAISO' WHEN 2 THEN 'MISO' WHEN 3 THEN 'NYISO' WHEN 4 THEN 'ERCOT' WHEN 5 THEN 'ISO-NE' WHEN 6 THEN 'SPP' WHEN 7 THEN 'SPP Markets +' ELSE 'FERC' END"


def latest(column: str) -> str:
    return f"max_by({column}, seq) FILTER (WHERE {column} IS NOT NULL) AS {column}"


VIEWS = {
    "meeting_scrapes": f"""
SELECT seq, rto, concat(rto, ' ', grp, ' Meeting') AS title, meeting_date,
  CASE seq % 6 WHEN 0 THEN NULL WHEN 1 THEN '9:00 AM - 12:00 PM' WHEN 2 THEN '1:30 p.m.' WHEN 3 THEN '10:00 AM – 3:00 PM MT' WHEN 4 THEN '12:15 PM ET' ELSE 'TBD' END AS meeting_time,
  CASE WHEN seq % 3 = 0 THEN NULL ELSE grp END AS committee,
  CASE WHEN seq % 5 = 0 THEN concat('Room ', cast(user_id AS string)) END AS location,
  'https://cal.example/all' AS source_url,
  CASE WHEN seq % 4 = 0 THEN NULL WHEN rto = 'NYISO' THEN concat('https://cal.example/nyiso/', event_type) ELSE concat('https://cal.example/', cast(user_id % 9 AS string), '/', event_type, '/', cast(meeting_date AS string)) END AS detail_url,
  CASE WHEN seq % 7 = 0 THEN concat('https://mat.example/spp-documents-filings/?id=', cast(user_id AS string)) END AS materials_url
FROM (SELECT event_id AS seq, user_id, event_type, cast(ts AS date) AS meeting_date, {rto('user_id')} AS rto,
  CASE event_type WHEN 'click' THEN 'Planning Committee' WHEN 'view' THEN 'Market Issues Working Group' WHEN 'purchase' THEN 'Operating Committee' WHEN 'signup' THEN 'Resource Adequacy Subcommittee' ELSE 'Reliability Committee' END AS grp FROM events) e""",
    "meetings": f"""
SELECT m.*, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS hydro_relevant, CASE WHEN id % 4 > 1 AND id % 3 = 0 THEN concat('Because of ', rto) END AS hydro_relevance_reason FROM (
SELECT rto, title, meeting_date, min(seq) AS id, {', '.join(latest(c) for c in ('meeting_time', 'committee', 'location', 'source_url', 'detail_url', 'materials_url'))}, max(seq) AS last_seq
FROM meeting_scrapes GROUP BY rto, title, meeting_date) m""",
    "document_scrapes": """
SELECT d.doc_id AS seq, m.rto, m.title AS meeting_title, m.meeting_date,
  concat('https://docs.example/', cast(CASE WHEN d.doc_id % 10 = 9 THEN d.doc_id - 1 ELSE d.doc_id END AS string), '.pdf') AS download_url,
  CASE d.doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'PDF' WHEN 2 THEN 'Item 02 Agenda' WHEN 3 THEN 'Draft Minutes' WHEN 4 THEN 'Straw Proposal' ELSE 'Monthly Report' END AS title,
  concat('20240115-item-0', cast(d.doc_id % 10 AS string), '---', d.lang, '-ftr-auction_update.pdf') AS filename,
  CASE WHEN d.doc_id % 3 = 0 THEN '2024-01-10' END AS posted_date, CAST(NULL AS string) AS member_url, d.text AS extracted_text
FROM documents d JOIN meeting_scrapes m ON m.seq = d.doc_id * 5""",
    "stored_documents": """
SELECT f.*, CASE WHEN f.id % 3 <> 1 THEN 1 ELSE 0 END AS downloaded, CASE WHEN f.title LIKE '%Agenda%' THEN 'agenda' WHEN f.title LIKE '%Minutes%' THEN 'minutes' ELSE 'report' END AS doc_type,
  s.hydro_relevant, s.ai_summary, s.topics, s.directness, s.source_names_hydro, s.hydro_relevance_reason, s.hydro_read_through, s.evidence FROM (
SELECT download_url, min(x.seq) AS id, min_by(m.id, x.seq) AS meeting_id, min_by(x.rto, x.seq) AS rto,
  max_by(x.title, x.seq) FILTER (WHERE x.title IS NOT NULL) AS title, max_by(filename, x.seq) FILTER (WHERE filename IS NOT NULL) AS filename,
  max_by(posted_date, x.seq) FILTER (WHERE posted_date IS NOT NULL) AS posted_date, max_by(member_url, x.seq) FILTER (WHERE member_url IS NOT NULL) AS member_url
FROM document_scrapes x JOIN meetings m ON m.rto = x.rto AND m.title = x.meeting_title AND m.meeting_date = x.meeting_date GROUP BY download_url) f
LEFT JOIN screenings s ON s.doc_id = f.id""",
    "screenings": """
SELECT doc_id, quality AS hydro_relevant, CASE WHEN quality = 1 THEN concat('Summary ', cast(doc_id AS string)) END AS ai_summary,
  CASE doc_id % 5 WHEN 0 THEN 'storage' WHEN 1 THEN 'storage;capacity-ra' WHEN 2 THEN 'transmission' WHEN 3 THEN 'price-formation;storage;ferc-policy' END AS topics,
  CASE WHEN quality = 1 THEN CASE doc_id % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'precedent' WHEN 2 THEN 'reference' END END AS directness, toxic AS source_names_hydro,
  CASE WHEN doc_id % 3 <> 0 THEN concat('Reason "', cast(doc_id AS string), '", of ', CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END) END AS hydro_relevance_reason, CASE WHEN quality = 1 THEN concat('Reads as ', cast(doc_id AS string)) END AS hydro_read_through,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE concat('[{"claim":"c', cast(doc_id AS string), '","quote":"q","verified":true},{"quote":"x","verified":false}]') END AS evidence FROM labels""",
    "issues": f"""
SELECT p_partkey AS id, {rto('p_partkey')} AS rto, concat('ISS', cast(p_partkey AS string)) AS native_id, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_name END AS canonical_name,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS short_title, CASE p_size % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'active' WHEN 2 THEN 'evaluation in progress' END AS status, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_open,
  CASE p_size % 5 WHEN 0 THEN 'Solution "draft"' WHEN 1 THEN 'Vote' END AS stakeholder_phase, CASE WHEN p_partkey % 3 = 0 THEN concat('WG ', cast(p_size AS string)) END AS committee_owner, CASE WHEN p_partkey % 4 <> 0 THEN concat('https://iss.example/', cast(p_partkey AS string)) END AS url FROM part""",
    "issue_references": """
SELECT DISTINCT l_partkey AS issue_id, CASE l_linenumber % 3 WHEN 0 THEN concat('https://docs.example/', cast(l_orderkey % 2000 AS string), '.pdf')
  WHEN 1 THEN concat('https://cal.example/', cast(l_suppkey % 9 AS string), '/', CASE cast(l_quantity AS integer) % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END, '/2024-01-', lpad(cast(1 + l_orderkey % 28 AS string), 2, '0'))
  ELSE concat('https://ext.example/', cast(l_orderkey AS string)) END AS ref_url FROM lineitem""",
    "document_stakeholders": """
SELECT o_orderkey AS seq, o_orderkey % 1000 AS document_id, CASE WHEN o_custkey % 31 = 0 THEN ' ' ELSE concat('Person ', cast(o_custkey % 97 AS string)) END AS name,
  CASE o_custkey % 9 WHEN 1 THEN 'PJM Interconnection, L.L.C.' WHEN 2 THEN 'PJM' WHEN 3 THEN 'Constellation Energy Generation, LLC' WHEN 4 THEN 'Constellation' WHEN 5 THEN 'Acme Power Corp.' WHEN 6 THEN 'Acme Power (AP)' WHEN 7 THEN concat('Person ', cast(o_custkey % 97 AS string)) WHEN 8 THEN 'First Energy' END AS entity,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Author' WHEN '2' THEN 'contact' WHEN '3' THEN 'presenter' END AS role,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('p', cast(o_custkey AS string), '@mail.example.com') END AS email FROM orders""",
    "matched_references": """
SELECT r.issue_id, r.ref_url, d.id AS matched_document_id, m.id AS matched_meeting_id FROM issue_references r
LEFT JOIN (SELECT download_url, min(id) AS id FROM stored_documents GROUP BY download_url) d ON r.ref_url = d.download_url
LEFT JOIN (SELECT detail_url, min(id) AS id FROM meetings WHERE detail_url IS NOT NULL GROUP BY detail_url) m ON r.ref_url = m.detail_url""",
}


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def needed(name: str) -> list[str]:
    """The views that a view reads, itself or through others."""
    direct = _needs(VIEWS.get(name, ""))
    return list(dict.fromkeys([n for v in direct for n in needed(v)] + direct))


def with_views(query: str, without: tuple[str, ...] = ()) -> str:
    """The query behind a WITH list of all stand-in views that it reads, in order of dependence."""
    order: list[str] = []

    def add(text: str) -> None:
        for v in _needs(text):
            if v not in order and v not in without:
                add(VIEWS[v])
                if v not in order:
                    order.append(v)

    add(query)
    inner = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in order)
    rest = query.strip()
    if rest[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {inner},\n{rest[15:]}" if inner else rest
    if rest[:5].upper() == "WITH ":
        return f"WITH {inner},\n{rest[5:]}" if inner else rest
    return f"WITH {inner}\n{rest}" if inner else rest


def view(spark: SparkSession, sf_dir: str, name: str, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """A stand-in table, lazily, over the parquet tables in sf_dir and over views that are stored already."""
    stored = stored or {}
    text = with_views(VIEWS[name], tuple(stored)).replace("{", "{{").replace("}", "}}")
    used = {t: t for t in (*BASE, *stored) if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: stored[t] if t in stored else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
