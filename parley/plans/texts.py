"""Registered queries: text functions and checks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, markup, text
from ..operators import links, screening
from .calendar import ENTITY_SQL, STRIP_SQL
from .registry import query
from .store import DOC_TYPE_SQL


@query(f"SELECT seq, {DOC_TYPE_SQL} AS doc_type FROM (SELECT seq, lower(coalesce(title, filename)) AS x FROM document_scrapes) s")
def classify_document(t):
    return t.document_scrapes.select("seq", text.classify_document(F.coalesce("title", "filename")).alias("doc_type"))


@query(f"""SELECT seq, CASE WHEN rto IN ('PJM') THEN CASE WHEN regexp_matches(x, 'agenda') THEN 'agenda' WHEN regexp_matches(x, 'minutes') THEN 'minutes' WHEN regexp_matches(x, 'presentation|slide|briefing') THEN 'presentation' WHEN regexp_matches(x, 'report|summary|update|review') THEN 'report' ELSE {DOC_TYPE_SQL} END
WHEN rto = 'CAISO' THEN CASE WHEN regexp_matches(x, 'agenda') THEN 'agenda' WHEN regexp_matches(x, 'minutes') THEN 'minutes' WHEN regexp_matches(x, 'presentation|slide') THEN 'presentation' WHEN regexp_matches(x, 'proposal|straw|issue.paper') THEN 'proposal' WHEN regexp_matches(x, 'comment') THEN 'comment' WHEN regexp_matches(x, 'tariff|amendment') THEN 'tariff' WHEN regexp_matches(x, 'report|summary') THEN 'report' WHEN regexp_matches(x, 'decision|memo') THEN 'decision' WHEN regexp_matches(x, 'workshop') THEN 'workshop-paper' WHEN regexp_matches(x, 'implementation|milestone') THEN 'implementation' ELSE 'other' END
WHEN rto = 'ISO-NE' THEN CASE WHEN regexp_matches(l, 'agenda') THEN 'agenda' WHEN regexp_matches(l, 'minutes') THEN 'minutes' WHEN regexp_matches(l, 'material') THEN {DOC_TYPE_SQL.replace('(x,', '(y,')} WHEN regexp_matches(l, 'report') THEN 'report' ELSE {DOC_TYPE_SQL.replace('(x,', '(y,')} END
WHEN rto LIKE 'SPP%' THEN CASE WHEN regexp_matches(x, 'minutes') THEN 'minutes' WHEN regexp_matches(x, 'agenda') THEN 'agenda' WHEN regexp_matches(x, 'materials') THEN 'materials' ELSE {DOC_TYPE_SQL} END ELSE {DOC_TYPE_SQL} END AS doc_type
FROM (SELECT seq, rto, lower(concat(coalesce(filename, ''), ' ', coalesce(title, ''))) AS x, lower(coalesce(title, '')) AS y, CASE seq % 4 WHEN 0 THEN 'agenda' WHEN 1 THEN 'meeting materials' WHEN 2 THEN 'report' ELSE '' END AS l FROM document_scrapes) s""")
def classify_document_by_source(t):
    label = F.when(F.col("seq") % 4 == 0, "Agenda").when(F.col("seq") % 4 == 1, "Meeting Materials").when(F.col("seq") % 4 == 2, "Report")
    return t.document_scrapes.select("seq", text.classify_document_by_source(F.col("rto"), label, F.col("filename"), F.col("title")).alias("doc_type"))


@query("""SELECT seq, concat('Item 0', cast(seq % 10 AS string), ' – ', upper(substr(lang, 1, 1)), substr(lang, 2), ' FTR Auction Update') AS title FROM (SELECT s.seq, d.lang FROM document_scrapes s JOIN documents d ON d.doc_id = s.seq) x""")
def title_from_filename(t):
    return t.document_scrapes.select("seq", text.title_from_filename(F.col("filename")).alias("title"))


@query("""SELECT s.seq, CASE WHEN s.rto = 'PJM' AND (s.title IS NULL OR s.title = 'PDF') AND s.seq % 5 <> 0 THEN concat('Item 0', cast(seq % 10 AS string), ' – ', upper(substr(d.lang, 1, 1)), substr(d.lang, 2), ' FTR Auction Update') ELSE s.title END AS title FROM document_scrapes s JOIN documents d ON d.doc_id = s.seq""")
def backfill_junk_titles(t):
    """Every fifth file name would itself give a title of no use."""
    name = F.when(F.col("seq") % 5 == 0, "20240101-xlsx.pdf").otherwise(F.col("filename"))
    return t.document_scrapes.select("seq", text.backfill_stored_title(F.col("title"), name, F.col("rto")).alias("title"))


@query("""SELECT seq, CASE WHEN contains(u, 'PJM') THEN 'PJM' WHEN contains(u, 'CAISO') THEN 'CAISO' WHEN contains(u, 'MISO') THEN 'MISO' WHEN contains(u, 'NYISO') THEN 'NYISO' WHEN contains(u, 'ERCOT') THEN 'ERCOT' WHEN contains(u, 'SPP') THEN 'SPP Markets +' WHEN contains(u, 'ISO-NE') THEN 'ISO-NE' WHEN contains(u, 'FERC') THEN 'FERC' ELSE 'Other' END AS rto FROM (SELECT seq, upper(title) AS u FROM meeting_scrapes) x""")
def identify_rto(t):
    return t.meeting_scrapes.select("seq", text.identify_rto(F.col("title"))["rto"].alias("rto"))


@query("""SELECT seq, CASE WHEN rto = 'PJM' AND contains(title, 'Planning Committee') THEN 'Planning Committee' WHEN rto = 'NYISO' AND contains(title, 'Operating Committee') THEN 'Operating Committee' WHEN rto = 'NYISO' AND contains(title, 'Market Issues') THEN 'Market Issues' WHEN rto = 'ISO-NE' AND contains(title, 'Reliability Committee') THEN 'Reliability Committee' WHEN rto = 'MISO' AND contains(title, 'Resource Adequacy Subcommittee') THEN 'Resource Adequacy Subcommittee' END AS committees FROM meeting_scrapes""")
def match_committee_keywords(t):
    return t.meeting_scrapes.select("seq", text.match_committee_keywords(F.col("title"), F.col("rto")).alias("committees"))


@query("SELECT seq, CASE WHEN contains(title, 'Planning Committee') THEN 'Planning Committee' WHEN contains(title, 'Operating Committee') THEN 'Operating Committee' END AS committee_name, CASE WHEN contains(title, 'Planning Committee') THEN 'pc' WHEN contains(title, 'Operating Committee') THEN 'oc' END AS slug FROM meeting_scrapes")
def identify_committee(t):
    c = text.identify_committee(F.col("title"))
    return t.meeting_scrapes.select("seq", c["committee_name"].alias("committee_name"), c["slug"].alias("slug"))


@query("SELECT seq, CASE WHEN contains(lower(title), 'markets +') THEN 'SPP Markets +' ELSE 'SPP' END AS track FROM meeting_scrapes WHERE rto LIKE 'SPP%'")
def track_rto(t):
    return t.meeting_scrapes.where(F.col("rto").like("SPP%")).select("seq", text.track_rto(F.col("title"), F.col("detail_url")).alias("track"))


@query(f"SELECT seq, {ENTITY_SQL} AS entity FROM (SELECT seq, {STRIP_SQL} AS n FROM document_stakeholders) x")
def normalize_entity(t):
    return t.document_stakeholders.select("seq", text.normalize_entity(F.col("entity")).alias("entity"))


@query("""SELECT event_id AS seq, cast(ts AS date) AS day FROM events""")
def parse_any_date(t):
    e = t.base("events").select("event_id", F.col("ts").cast("date").alias("day"))
    k = F.col("event_id") % 6
    forms = F.when(k == 0, F.date_format("day", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("posted "), F.date_format("day", "M/d/yyyy"))).when(k == 2, F.date_format("day", "M.d.yyyy")).when(k == 3, F.concat(F.lit("Monday, "), F.date_format("day", "MMMM d, yyyy"))).when(k == 4, F.date_format("day", "MMM d, yyyy")).otherwise(F.date_format("day", "yyyy/MM/dd"))
    return e.select(F.col("event_id").alias("seq"), dates.parse_any_date(forms).alias("day"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 5 NOT IN (0, 1) THEN cast(ts AS date) END AS day FROM events")
def valid_event_date(t):
    k = F.col("event_id") % 5
    shown = F.when(k == 0, F.lit("2026-01-00")).when(k == 1, F.date_format("ts", "M/d/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.base("events").select(F.col("event_id").alias("seq"), dates.valid_event_date(shown).alias("day"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN concat(strftime(d, '%Y-%m-%d'), ',', strftime(d + 1, '%Y-%m-%d')) WHEN event_id % 3 = 1 THEN strftime(d, '%Y-%m-%d') ELSE '' END AS days FROM (SELECT event_id, cast(ts AS date) AS d FROM events) x")
def expand_compact_dates(t):
    d, k = F.col("ts").cast("date"), F.col("event_id") % 3
    name = F.when(k == 0, F.concat(F.date_format(d, "yyyyMMdd"), F.lit("-"), F.date_format(F.date_add(d, 1), "MMdd"), F.lit("-x"))).when(k == 1, F.concat(F.lit("item_"), F.date_format(d, "yyyyMMdd"))).otherwise(F.lit("file-202601006"))
    return t.base("events").select(F.col("event_id").alias("seq"), F.array_join(F.transform(dates.expand_compact_dates(name), lambda x: x.cast("string")), ",").alias("days"))


@query(r"""SELECT doc_id, length(e) AS n, md5(e) AS excerpt_md5, elided FROM (SELECT doc_id, length(x) > 4000 AS elided, CASE WHEN length(x) > 4000 THEN concat(regexp_replace(substr(x, 1, 2400), '\s+$', ''), chr(10), chr(10), '[... MIDDLE OF DOCUMENT OMITTED FOR LENGTH — the text below resumes from a LATER page and does not continue the sentence above ...]', chr(10), chr(10), regexp_replace(right(x, 1600), '^\s+', '')) ELSE x END AS e
FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS x FROM documents) a) b""")
def build_excerpt(t):
    e = text.build_excerpt(F.col("text"), 4000)
    return t.base("documents").select("doc_id", e.alias("e")).select("doc_id", F.length("e.excerpt").alias("n"), F.md5("e.excerpt").alias("excerpt_md5"), F.col("e.elided").alias("elided"))


@query(r"SELECT doc_id, regexp_matches(regexp_replace(text, '(?i)\bth(en|is)', 'x', 'g'), '(?i)\bth') AS named FROM documents")
def source_names_term(t):
    return t.base("documents").select("doc_id", text.source_names_term(F.col("text"), r"(?i)\bth(?!en|is)").alias("named"))


def answers(t):
    """Answers built from the labels, with unknown topics, missing levels and unusable texts among them."""
    k = F.col("doc_id")
    topics = F.when(k % 3 == 0, '["storage","nonsense","transmission","capacity-ra","ferc-policy"]').when(k % 3 == 1, '["load-growth"]').otherwise("[]")
    level = F.when(k % 4 == 0, '"direct"').when(k % 4 == 1, '"odd"').otherwise("null")
    good = F.concat(F.lit('{"relevant":'), F.when(F.col("quality") == 1, "true").otherwise("false"), F.lit(',"reason":"r","directness":'), level, F.lit(',"summary":"S","hydro_read_through":"H","topics":'), topics, F.lit(',"evidence":[]}'))
    return t.base("labels").select("doc_id", F.when(k % 11 == 0, "not json").otherwise(good).alias("response"))


@query("""SELECT doc_id, quality = 1 AS relevant, CASE doc_id % 3 WHEN 0 THEN 'storage,transmission,capacity-ra' WHEN 1 THEN 'load-growth' ELSE '' END AS topics, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'direct' ELSE 'reference' END END AS directness, CASE WHEN quality = 1 THEN 'H' END AS hydro_read_through FROM labels WHERE doc_id % 11 <> 0""")
def postprocess_screening(t):
    return screening.postprocess_screening(answers(t)).select("doc_id", "relevant", F.array_join("topics", ",").alias("topics"), "directness", "hydro_read_through")


def quotes(t):
    """Per document three quotes: a passage with other typography, an empty one, one that does not occur."""
    d = t.base("documents").where("text IS NOT NULL")
    passage = F.concat(F.lit("\u3000 "), F.replace(F.substring("text", 30, 60), F.lit(" "), F.lit(" \u2009\u2028 ")))
    e = F.array(*[F.struct(F.lit("c").alias("claim"), q.alias("quote")) for q in (passage, F.lit(""), F.lit("no such – quote at all"))])
    return d.select("doc_id", screening.verify_evidence(e, F.col("text")).alias("e"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\x0b\x{85}]+', ' ', 'g')) AS x, trim(regexp_replace(substr(text, 30, 60), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g')) AS q FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN q <> '' AND contains(x, q) THEN 1 ELSE 0 END AS verified, CASE WHEN q <> '' AND contains(x, q) THEN 2 ELSE 3 END AS unverified FROM n""")
def verify_evidence(t):
    n = F.size(F.filter("e", lambda x: x["verified"]))
    return quotes(t).select("doc_id", n.alias("verified"), (F.size("e") - n).alias("unverified"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN NOT contains(text, 'trash') ELSE false END AS leak FROM labels JOIN documents USING (doc_id)")
def detect_summary_leak(t):
    rows = t.base("labels").join(t.base("documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", screening.detect_summary_leak(F.when(F.col("quality") == 1, "a trash summary"), F.col("text"), "trash").alias("leak"))


@query("""SELECT count(*) FILTER (WHERE ok) AS screened, count(*) FILTER (WHERE NOT ok) AS n_errors, count(*) FILTER (WHERE ok AND quality = 1) AS n_relevant, count(*) FILTER (WHERE ok AND quality = 1 AND doc_id % 4 = 0) AS n_direct, 0 AS n_precedent, count(*) FILTER (WHERE ok AND quality = 1 AND doc_id % 4 <> 0) AS n_reference, count(*) FILTER (WHERE length(text) > 4000) AS n_truncated, sum(doc_id % 2)::bigint AS n_unverified, count(*) FILTER (WHERE contains(text, 'trash')) AS n_leaks, sum(doc_id % 4)::bigint AS n_stakeholders
FROM (SELECT *, doc_id % 11 <> 0 AS ok FROM labels JOIN documents USING (doc_id)) x""")
def screening_run_summary(t):
    texts = t.base("labels").select("doc_id").join(t.base("documents").select("doc_id", "text"), "doc_id")
    rows = texts.join(screening.postprocess_screening(answers(t)), "doc_id", "left")
    return screening.screening_run_summary(rows.select("relevant", "directness", (F.length("text") > 4000).alias("elided"), (F.col("doc_id") % 2).alias("unverified"), F.col("text").contains("trash").alias("leak"), (F.col("doc_id") % 4).alias("n_stakeholders")))


#: What some pages get behind their end: references of all forms, and spaces of several kinds.
_TAIL = "<p>&ndash; &#8217; caf&eacute;&#x27;s &notit; &unknown;</p><td>a</td><td>b</td> \n 　\n&nbsp;end&#128;"
_TAIL_TEXT = "– ’ café's ¬it; &unknown;\na b\nend€"


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)', 2) AS ls FROM pages),
a AS (SELECT page_id, origin, unnest(hs) AS href, unnest(ls) AS label, unnest(generate_series(1, len(hs))) AS i FROM p),
u AS (SELECT page_id, concat(origin, href) AS url, regexp_extract(href, '([^/]*)$', 1) AS filename, trim(replace(replace(replace(label, '&quot;', '"'), '&lt;', '<'), '&amp;', '&')) AS title, i FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY i) AS rn FROM u WHERE regexp_matches(url, '/[^/]+$'))
SELECT page_id, url, filename, title, NULL::DATE AS posted_date, row_number() OVER (PARTITION BY page_id ORDER BY i)::INTEGER - 1 AS position FROM f WHERE rn = 1""")
def extract_document_links(t):
    """The given pages link paths without extensions: the pattern takes every named path. The sources' rules are tested on literal pages."""
    return links.document_links(t.base("pages"), keep=r"/[^/]+$")


@query(r"""WITH src AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html ELSE html END AS html FROM pages),
a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g') AS t FROM src),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '</(p|tr|li|div|h\d)>|<br\s*/?>', chr(10), 'g'), '</td>', '  ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '<[^>]+>', '', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), chr(1), '&', 'g') AS t FROM c),
e AS (SELECT page_id, (SELECT html LIKE '%</html>' FROM pages q WHERE q.page_id = d.page_id) AS whole, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[\s\p{Z}]*\n[\s\p{Z}]*', chr(10), 'g') AS t FROM d)
SELECT page_id, nullif(regexp_replace(regexp_replace(t, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', ''), '') || CASE WHEN page_id % 3 = 0 AND whole THEN 'TAIL' ELSE '' END AS text FROM e""".replace("TAIL", "\n" + _TAIL_TEXT.replace("'", "''")))
def markup_to_text(t):
    """Every third page that is whole gets an end with references of all forms."""
    html = F.when((F.col("page_id") % 3 == 0) & F.endswith("html", F.lit("</html>")), F.concat("html", F.lit("<br>" + _TAIL))).otherwise(F.col("html"))
    return t.base("pages").select("page_id", markup.markup_to_text(html).alias("text"))
