"""Roll-ups, indexes, windows and filters over events and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import normalize_entity
from .textindex import TextIndex


def rank(level: Column) -> Column:
    return F.when(level == "direct", 3).when(level == "precedent", 2).when(level == "reference", 1)


def store_stats(meetings: DataFrame, docs: DataFrame) -> DataFrame:
    """Per operator that has meetings: meetings, documents, downloaded documents (marked by downloaded = 1)."""
    m = meetings.groupBy("rto").agg(F.count("*").alias("meetings"))
    d = docs.groupBy("rto").agg(F.count("*").alias("documents"), F.count_if(F.col("downloaded") == 1).alias("downloaded"))
    zero = F.lit(0).cast("long")
    return m.join(d, "rto", "left").select("rto", "meetings", F.coalesce("documents", zero).alias("documents"), F.coalesce("downloaded", zero).alias("downloaded"))


def event_rollup(meetings: DataFrame, docs: DataFrame, issue_links: DataFrame | None = None) -> DataFrame:
    """Per meeting: documents, relevant documents, relevance, distinct topics, strongest directness, whether issues hang on it."""
    hot = F.col("hydro_relevant") == 1
    topics = F.split(F.when(F.col("topics") != "", F.col("topics")), ";")
    d = docs.groupBy("meeting_id").agg(
        F.count("*").alias("n_docs"), F.count_if(hot).alias("n_relevant"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(topics)))).alias("topics"),
        F.max(F.when(hot, rank(F.col("directness")))).alias("directness_rank"),
    )
    m = meetings.select("id", "rto", "title", "meeting_date", "meeting_time", "committee", (F.col("hydro_relevant") == 1).alias("flag"))
    zero = F.lit(0).cast("long")
    out = m.join(d, m["id"] == d["meeting_id"], "left").select(
        "id", "rto", "title", "meeting_date", "meeting_time", "committee", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_relevant", zero).alias("n_relevant"),
        (F.coalesce("flag", F.lit(False)) | (F.coalesce("n_relevant", zero) > 0)).alias("is_relevant"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "directness_rank",
    )
    if issue_links is None:
        return out
    linked = issue_links.select(F.col("meeting_id").alias("id")).distinct().withColumn("has_issues", F.lit(True))
    return out.join(linked, "id", "left").withColumn("has_issues", F.coalesce("has_issues", F.lit(False)))


def monday(date: Column) -> Column:
    return F.date_trunc("week", date).cast("date")


def sunday(date: Column) -> Column:
    return F.date_sub(F.next_day(date, "SUN"), 7)


def weekly_digest(events: DataFrame, today: str) -> DataFrame:
    """One row per Monday week from the first event's to the later of the last event's and today's, empty weeks too."""
    weeks = events.where("is_relevant").groupBy(monday(F.col("meeting_date")).alias("w")).agg(F.count("*").alias("events"), F.sum("n_docs").alias("docs"), F.sum("n_relevant").alias("relevant_docs"), F.array_join(F.array_sort(F.collect_set("rto")), ", ").alias("rtos"))
    bounds = events.agg(F.min("meeting_date").alias("a"), F.max("meeting_date").alias("b"))
    spine = bounds.select(F.explode(F.sequence(monday(F.col("a")), monday(F.greatest(F.col("b"), F.lit(today).cast("date"))), F.expr("interval 7 days"))).alias("week"))
    zero = F.lit(0).cast("long")
    return spine.join(weeks, spine["week"] == weeks["w"], "left").select("week", F.coalesce("events", zero).alias("events"), F.coalesce("docs", zero).alias("docs"), F.coalesce("relevant_docs", zero).alias("relevant_docs"), F.coalesce("rtos", F.lit("")).alias("rtos"))


def facet_counts(events: DataFrame) -> DataFrame:
    by = lambda kind, df, key: df.groupBy(key.alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("facet"), "value", "n")
    views = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("is_relevant"), "relevant"), F.when(F.col("has_issues"), "issues")), lambda v: v.isNotNull()))
    return by("rto", events, F.col("rto")).unionByName(by("topic", events.select(F.explode("topics").alias("t")), F.col("t"))).unionByName(by("view", events.select(views.alias("v")), F.col("v")))


def corpus_profile(rows: DataFrame) -> DataFrame:
    """Per operator of a selection of the corpus: documents, first and last day, span in days, bytes of the reader's CSV lines (with their ends) and of compact JSON records."""
    from ..sources.feeds import CORPUS_COLUMNS, compact_csv_line

    first, last = F.min("meeting_date"), F.max("meeting_date")
    sized = rows.select("rto", "meeting_date", (F.octet_length(compact_csv_line(rows)) + 2).alias("csv"), F.octet_length(F.to_json(F.struct(*CORPUS_COLUMNS), {"ignoreNullFields": "false"})).alias("json"))
    return sized.groupBy("rto").agg(F.count("*").alias("documents"), first.alias("first_date"), last.alias("last_date"), F.greatest(F.lit(1), F.datediff(last, first)).cast("long").alias("span_days"), F.sum("csv").alias("csv_bytes"), F.sum("json").alias("json_bytes"))


def filter_confidence(events: DataFrame, least: int) -> DataFrame:
    """Events at the rank or above; unrated ones always pass."""
    return events.where(F.col("directness_rank").isNull() | (F.col("directness_rank") >= least))


def confidence_counts(events: DataFrame) -> DataFrame:
    unrated = F.col("directness_rank").isNull()
    return events.agg(*[F.count_if(unrated | (F.col("directness_rank") >= r)).alias(f"at_least_{r}") for r in (1, 2, 3)], F.count_if(unrated & F.col("is_relevant")).alias("unrated_relevant"))


def informative(people: DataFrame) -> DataFrame:
    """People with a name that is not that of their (normalised) organisation."""
    rows = people.where(F.trim("name") != "").withColumn("name", F.trim("name")).withColumn("org", normalize_entity(F.col("entity")))
    return rows.where(F.lower("name") != F.lower(F.coalesce("org", F.lit(""))))


def _sightings(people: DataFrame, docs: DataFrame) -> DataFrame:
    """(name_key, org_key, meeting_id, rto, doc_type) once each; types that say nothing are none."""
    kind = F.when(~F.col("doc_type").isin("other", "document"), F.col("doc_type"))
    d = docs.select(F.col("id").alias("document_id"), "meeting_id", "rto", kind.alias("doc_type"))
    return informative(people).join(d, "document_id").select(F.lower("name").alias("name_key"), F.lower(F.coalesce("org", F.lit(""))).alias("org_key"), "meeting_id", "rto", "doc_type").distinct()


def _joined_set(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def stakeholder_index(people: DataFrame, docs: DataFrame) -> DataFrame:
    """Per person and organisation (lower case): operators, document types, distinct meetings. Distinct keys are reduced before counting."""
    return _sightings(people, docs).groupBy("name_key", "org_key").agg(_joined_set("rto").alias("rtos"), _joined_set("doc_type").alias("doc_types"), F.countDistinct("meeting_id").alias("meetings"))


def entity_index(people: DataFrame, docs: DataFrame) -> DataFrame:
    rows = _sightings(people, docs).where("org_key <> ''")
    return rows.groupBy("org_key").agg(_joined_set("rto").alias("rtos"), _joined_set("doc_type").alias("doc_types"), F.countDistinct("name_key").alias("people"), F.countDistinct("meeting_id").alias("meetings"))


def meeting_stakeholders(people: DataFrame, docs: DataFrame) -> DataFrame:
    """Per meeting and person (by name and organisation, whatever the case): the first spelling and address, roles as first seen,
    documents in order; with the organisation's head count. Order is that of documents, then of rows (seq)."""
    d = docs.select(F.col("id").alias("document_id"), "meeting_id", F.col("title").alias("document_title"))
    rows = informative(people).where(F.lower("name") != F.lower(F.coalesce("entity", F.lit("")))).join(d, "document_id")
    place = F.struct("document_id", "seq")
    ordered = F.array_sort(F.collect_list(F.struct("document_id", "seq", F.when(F.col("role") != "", F.col("role")).alias("role"))))
    one = rows.groupBy("meeting_id", F.lower(F.coalesce("org", F.lit(""))).alias("org_key"), F.lower("name").alias("name_key")).agg(
        F.min_by("name", place).alias("name"), F.coalesce(F.min_by("org", place), F.lit("Unaffiliated")).alias("org"), F.min_by("email", F.when(F.col("email") != "", place)).alias("email"),
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["role"])), ",").alias("roles"), F.array_sort(F.collect_set(F.struct(F.col("document_id").alias("id"), F.col("document_title").alias("title")))).alias("documents"),
    )
    return one.withColumn("org_people", F.count("*").over(Window.partitionBy("meeting_id", "org"))).drop("org_key", "name_key")


def doc_type_tally(docs: DataFrame) -> DataFrame:
    kind = F.coalesce("doc_type", F.lit("document"))
    weight = F.array_position(F.array(*[F.lit(t) for t in dims.DOC_TYPE_ORDER]), F.col("doc_type"))
    return docs.select("meeting_id", kind.alias("doc_type")).groupBy("meeting_id", "doc_type").agg(F.count("*").alias("n")).withColumn("weight", F.when(weight > 0, weight - 1).otherwise(len(dims.DOC_TYPE_ORDER)).cast("int"))


def diversify_round_robin(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows in order of date and time, with their place and left_over, the number of rows that are not among them.

    If there are more, the i-th earliest of each operator is taken in turn, operators in order of first appearance.
    """
    order = ["meeting_date", F.coalesce("meeting_time", F.lit("")), "id"]
    w = Window.partitionBy("rto").orderBy(*order)
    # No operator gives more than `limit` rows, so later ones are dropped before they are shuffled.
    ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    lead = F.first(F.struct(*[F.col(c) if isinstance(c, str) else c.alias("t") for c in order])).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chosen = ranked.withColumn("lead", lead).orderBy("turn", "lead").limit(limit)
    total = rows.agg(F.count("*").alias("n")).scalar()
    # At most `limit` rows are put in order.
    place = F.row_number().over(Window.orderBy("meeting_date", F.coalesce("meeting_time", F.lit("")), "turn", "lead"))
    return chosen.withColumn("place", place).withColumn("left_over", F.greatest(total - limit, F.lit(0))).drop("turn", "lead")


def calendar_day_cells(events: DataFrame, visible: int = 3) -> DataFrame:
    """Per day the first visible events (relevant first, then time, unknown last), how many more, how many relevant."""
    day = Window.partitionBy("meeting_date")
    rn = F.row_number().over(day.orderBy(F.desc("is_relevant"), F.coalesce("meeting_time", F.lit("99:99")), "id"))
    ranked = events.withColumn("rn", rn).withColumn("n", F.count("*").over(day)).withColumn("relevant", F.count_if("is_relevant").over(day))
    return ranked.where(F.col("rn") <= visible).select("meeting_date", "rn", "id", F.greatest(F.col("n") - visible, F.lit(0)).alias("more"), "relevant")


def agenda_rows(events: DataFrame) -> DataFrame:
    """Rows in order, the date shown only on the first row of a day."""
    prev = F.lag("meeting_date").over(Window.partitionBy(monday(F.col("meeting_date"))).orderBy("meeting_date", "meeting_time", "id"))
    return events.select("id", "meeting_time", F.when(prev.isNull() | (prev != F.col("meeting_date")), F.col("meeting_date")).alias("shown_date"))


def week_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(sunday(F.col("meeting_date")).alias("week_start")).agg(F.count("*").alias("events"), F.count_if("is_relevant").alias("relevant"))


def week_lanes(events: DataFrame) -> DataFrame:
    """Per day, the first lane that is free at each timed event's start (60 minutes if it has no end); lanes is the most in use that day.

    A day is cut where no event is open, as lanes are all free there. A stretch in between is one fold over its events in order,
    whose state is the list of the lanes' ends.
    """
    timed = events.where("start_min IS NOT NULL").select("id", "meeting_date", "start_min", F.coalesce(F.when(F.col("end_min") > F.col("start_min"), F.col("end_min")), F.col("start_min") + 60).alias("end_min"))
    order = Window.partitionBy("meeting_date").orderBy("start_min", "id")
    busy = timed.withColumn("busy_until", F.max("end_min").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cut = busy.withColumn("stretch", F.sum(F.when(F.col("busy_until") > F.col("start_min"), 0).otherwise(1)).over(order)).drop("busy_until")
    rows = cut.groupBy("meeting_date", "stretch").agg(F.sort_array(F.collect_list(F.struct("start_min", "id", "end_min"))).alias("events"))

    def lay(state: Column, e: Column) -> Column:
        free = F.array_position(F.transform(state["ends"], lambda x: x <= e["start_min"]), True)
        lane = F.when(free > 0, free - 1).otherwise(F.size(state["ends"])).cast("int")
        ends = F.when(free > 0, F.transform(state["ends"], lambda x, i: F.when(i == free - 1, e["end_min"]).otherwise(x))).otherwise(F.concat(state["ends"], F.array(e["end_min"])))
        return F.struct(ends.alias("ends"), F.concat(state["lanes"], F.array(lane)).alias("lanes"))

    none = F.struct(F.array().cast("array<int>").alias("ends"), F.array().cast("array<int>").alias("lanes"))
    laid = rows.select("meeting_date", "events", F.aggregate("events", none, lay, lambda z: z["lanes"]).alias("lanes")).select("meeting_date", F.inline(F.arrays_zip("events", F.col("lanes").alias("lane"))))
    laid = laid.select("events.id", "meeting_date", "events.start_min", "events.end_min", "lane")
    return laid.withColumn("lanes", F.max(F.col("lane") + 1).over(Window.partitionBy("meeting_date")))


def work_week(today: str) -> tuple[Column, Column]:
    """Monday to Friday of the next full work week; the current one on a Monday."""
    t = F.lit(today).cast("date")
    start = F.when(F.dayofweek(t) == 2, t).otherwise(F.next_day(t, "MON"))
    return start, F.date_add(start, 4)


def meetings_ahead(events: DataFrame, today: str, days: int | None = None, relevant_only: bool = True) -> DataFrame:
    first, last = work_week(today) if days is None else (F.lit(today).cast("date"), F.date_add(F.lit(today).cast("date"), days))
    rows = events.where(F.col("meeting_date").between(first, last))
    return rows.where("is_relevant") if relevant_only else rows


def haystack(feed: DataFrame) -> Column:
    """What an event is searched in: title, committee and operator, then its own and its documents' issues, its people and the
    titles of its documents, as far as the rows of calendar_events have them."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    words = lambda x, names: F.concat_ws(" ", *[blank(x[n]) for n in names])
    kind = lambda c: feed.schema[c].dataType.elementType if c in feed.columns else None
    some = lambda c, of: F.coalesce(c, F.array().cast(of))

    def below(field):
        """The lists of a field of the documents, as one list."""
        of = kind("documents")[field].dataType
        return F.flatten(F.transform(some(F.col("documents"), feed.schema["documents"].dataType), lambda d: some(d[field], of)))

    parts = [blank(F.col(c)) for c in ("title", "committee", "rto")]
    if kind("issues"):
        issues = some(F.col("issues"), feed.schema["issues"].dataType)
        if kind("documents") and "issues" in kind("documents").names:
            issues = F.concat(issues, below("issues"))
        named = [c for c in ("title", "name", "native_id") if c in kind("issues").names]
        # Each different issue once, told by its JSON: texts are told apart by hash, structs one by one.
        told = F.array_distinct(F.transform(issues, lambda i: F.concat(F.coalesce(F.to_json(i), F.lit("")), F.lit("\0"), words(i, named))))
        parts.append(F.array_join(F.transform(told, lambda i: F.substring_index(i, "\0", -1)), " "))
    if kind("documents"):
        people = F.array_join(F.transform(below("stakeholders"), lambda s: words(s, ("name", "entity"))), " ")
        parts += [people, F.coalesce(F.array_join(F.transform("documents", lambda d: blank(d["title"])), " "), F.lit(""))]
    return F.concat_ws(" ", *parts)


def filter_events(events: DataFrame, view: str = "all", rtos: list[str] | None = None, topics: list[str] | None = None, text: str | None = None, today: str | None = None, week_end: str | None = None, facet: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """Events of a view, of operators, of topics, of a facet (rows of match_facet, by id) and with a text.

    The view "today" takes the days from today to week_end. Text is sought in the haystack of the rows, or in a text index of
    events by id, which spares the rows their nested columns.
    """
    days = lambda e: e.where(F.col("meeting_date").between(F.lit(today).cast("date"), F.lit(week_end).cast("date")))
    rows = {"all": lambda e: e, "relevant": lambda e: e.where("is_relevant"), "issues": lambda e: e.where("has_issues"), "today": days}[view](events)
    rows = rows.where(F.col("rto").isin(rtos)) if rtos else rows
    rows = rows.where(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics]))) if topics else rows
    rows = rows.join(facet.select("id").distinct(), "id", "left_semi") if facet is not None else rows
    if text and index is not None:
        return rows.join(index.find(text).select("id"), "id", "left_semi")
    return rows.where(F.lower(haystack(events)).contains(text.lower())) if text else rows


#: Suggestions of each kind; kinds that are not ranked by prefix.
TOP, BY_COUNT = {"rto": 4, "topic": 4}, ("rto", "topic")


def search_suggestions(index: TextIndex, text: str) -> DataFrame:
    """The first few of each kind whose search text holds the text (at least two characters), with their place.

    index: over rows of kind, label, search (lower case), n, date. Matches at the start come first, then the higher count; markets
    and topics go by count alone, meetings by date.
    """
    t = text.strip().lower()
    plain, meeting = F.col("kind").isin(*BY_COUNT), F.col("kind") == "meeting"
    rank = [F.when(meeting, F.col("date")), F.desc(~plain & ~meeting & F.col("search").startswith(t)), F.desc(F.when(~meeting, F.col("n"))), "label"]
    rn = F.row_number().over(Window.partitionBy("kind").orderBy(*rank))
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOP.items() for x in kv]), F.col("kind")), F.lit(5))
    found = index.find(t) if len(t) >= 2 else index.rows.select(*index.columns).where(F.lit(False))
    return found.withColumn("rn", rn).where((F.col("rn") <= 5) & (F.col("rn") <= most))
