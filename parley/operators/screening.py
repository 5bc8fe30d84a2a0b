"""Screening: selection of candidates, and deterministic checks of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import evidence_array, fold_typography, topics_array

RESPONSE = "relevant boolean, reason string, directness string, summary string, hydro_read_through string, topics array<string>, evidence array<struct<claim:string,quote:string>>, stakeholders array<struct<name:string,entity:string,role:string,email:string>>"


def stage1_candidates(meetings: DataFrame, rto: str | None = None, rescreen: bool = False) -> DataFrame:
    """Meetings without a verdict (all, to screen again), newest first."""
    rows = meetings if rescreen else meetings.where("hydro_relevant IS NULL")
    return (rows.where(F.col("rto") == rto) if rto else rows).orderBy(F.desc("meeting_date"), "id")


def stage2_candidates(docs: DataFrame, meetings: DataFrame, bypass: tuple[str, ...] = tuple(dims.SCREENED_ANYWAY), rto: str | None = None, since: str | None = None, until: str | None = None, rescreen: bool = False, only_unrated: bool = False, limit: int | None = 200) -> DataFrame:
    """Documents of relevant meetings (or of sources that bypass that gate), newest meeting first.

    docs: id, rto, meeting_id, ai_processed_at, stakeholders_extracted_at, source_names_hydro. Taken are those that lack either pass,
    or all to screen again; only_unrated keeps those never screened under the current questions.
    """
    m = meetings.select(F.col("id").alias("m_id"), "meeting_date", F.col("hydro_relevant").alias("m_relevant"))
    rows = docs.join(m, docs["meeting_id"] == m["m_id"]).where((F.col("m_relevant") == 1) | F.col("rto").isin(*bypass))
    for value, test in ((not rescreen, F.col("ai_processed_at").isNull() | F.col("stakeholders_extracted_at").isNull()), (rto, F.col("rto") == F.upper(F.lit(rto))), (since, F.col("meeting_date") >= F.lit(since).cast("date")), (until, F.col("meeting_date") <= F.lit(until).cast("date")), (only_unrated, F.col("source_names_hydro").isNull())):
        rows = rows.where(test) if value else rows
    rows = rows.select("id", "rto", "meeting_id", "meeting_date")
    return rows.orderBy(F.desc("meeting_date"), "id").limit(limit) if limit else rows


def postprocess_screening(responses: DataFrame) -> DataFrame:
    """doc_id and the cleaned answer; rows whose answer cannot be used are dropped, to be asked again."""
    r = responses.select("doc_id", F.from_json("response", RESPONSE).alias("r")).where("r.relevant IS NOT NULL")
    topics = F.slice(F.filter(F.coalesce("r.topics", F.array().cast("array<string>")), lambda t: t.isin(dims.TOPICS)), 1, 3)
    level = F.when(F.col("r.directness").isin(list(dims.DIRECTNESS)), F.col("r.directness"))
    return r.select("doc_id", F.col("r.relevant").alias("relevant"), F.col("r.reason").alias("reason"), topics.alias("topics"), F.when(F.col("r.relevant"), F.coalesce(level, F.lit("reference"))).alias("directness"), F.col("r.summary").alias("summary"), F.when(F.col("r.relevant"), F.col("r.hydro_read_through")).alias("hydro_read_through"), F.coalesce("r.evidence", F.array().cast("array<struct<claim:string,quote:string>>")).alias("evidence"))


def verify_evidence(evidence: Column, excerpt: Column) -> Column:
    """Each quote with verified: not empty and found in the excerpt after folding. The folded excerpt is a lambda's variable, so a row folds it once."""
    checked = lambda folded: lambda e: F.struct(e["claim"].alias("claim"), e["quote"].alias("quote"), ((fold_typography(e["quote"]) != "") & F.contains(folded, fold_typography(e["quote"]))).alias("verified"))
    return F.get(F.transform(F.array(fold_typography(excerpt)), lambda folded: F.transform(evidence, checked(folded))), F.lit(0))


def decode_screening(docs: DataFrame) -> DataFrame:
    """Stored columns as the viewer reads them: topics and evidence as lists, an unknown directness as none, relevant as a flag."""
    return docs.withColumns({"topics": topics_array(F.col("topics")), "evidence": evidence_array(F.col("evidence")), "directness": F.when(F.col("directness").isin(list(dims.DIRECTNESS)), F.col("directness")), "relevant": F.col("hydro_relevant") == 1})


def detect_summary_leak(summary: Column, source: Column, pattern: str) -> Column:
    return F.coalesce(summary, F.lit("")).rlike(pattern) & ~F.coalesce(source, F.lit("")).rlike(pattern)


def screening_run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run. results: relevant (null where the answer was no use), directness, elided, unverified, leak, n_stakeholders."""
    level = lambda v: F.count_if(F.col("directness") == v).alias(f"n_{v}")
    return results.agg(F.count("relevant").alias("screened"), F.count_if(F.col("relevant").isNull()).alias("n_errors"), F.count_if("relevant").alias("n_relevant"), *[level(v) for v in dims.DIRECTNESS], F.count_if("elided").alias("n_truncated"), F.sum("unverified").alias("n_unverified"), F.count_if("leak").alias("n_leaks"), F.sum("n_stakeholders").alias("n_stakeholders"))
