"""Readers and writers of the calendar feed, the issue list, the corpus and the run log."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import evidence_text

#: Columns of the reader's CSV. They must equal the original system's for right results.
CORPUS_COLUMNS = ["rto", "meeting_date", "committee", "meeting_title", "doc_type", "title", "posted_date", "relevance_reason", "topics", "directness", "source_names_hydro", "evidence", "initiatives", "stakeholders", "ai_summary", "hydro_read_through", "url", "member_url"]
COMPACT_COLUMNS = ["rto", "meeting_date", "committee", "meeting_title", "doc_type", "title", "posted_date", "relevance_reason", "initiatives", "stakeholders", "ai_summary", "url"]
#: Bytes from which on a file may hold a line that no row can.
LINES = 1 << 30


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode alone a temporary one where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='parley-')}"
    return f"{base.rstrip('/')}/parley-{uuid.uuid4().hex}/{name}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that what reads it several times does not make it anew."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    # Shuffle files of the finished job go once the driver has collected its plan; until then they hold disk on every executor.
    schema, spark = rows.schema, rows.sparkSession
    del rows
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def event_json(events: DataFrame) -> Column:
    """A nested meeting as JSON text, nulls written; put together from its lists' items, so that no step holds the whole but the last."""
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    items = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, text), ","), F.lit("]"))
    item = {f.name: getattr(f.dataType, "elementType", None) for f in events.schema}
    # A list of structs is written item by item; other columns, up to the next such list, as an object whose braces are left out.
    runs, out = [[]], [F.lit("{")]
    for c in events.columns:
        if isinstance(item[c], StructType):
            runs += [c, []]
        else:
            runs[-1].append(c)
    for run in runs:
        if isinstance(run, str):
            out += [F.lit("," * (len(out) > 1) + json.dumps(run) + ":"), F.coalesce(items(F.col(run)), F.lit("null"))]
        elif run:
            whole = text(F.struct(*run))
            out += [F.lit("," * (len(out) > 1)), F.substring(whole, F.lit(2), F.length(whole) - 2)]
    return F.concat(*out, F.lit("}"))


def _newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("date"), "id")


def write_calendar_feed(events: DataFrame, path: str, in_order: bool = False, compression: str = "none") -> None:
    """Nested meetings as JSON lines, newest first; nulls are written. Events that come in order are not sorted again, and may come as
    (id, json)."""
    rows = events if in_order else _newest_first(events)
    if events.columns == ["id", "json"]:
        rows.select("json").write.option("compression", compression).text(path)
    else:
        rows.write.option("ignoreNullFields", False).option("compression", compression).json(path)


def write_calendar_feed_array(events: DataFrame, path: str, in_order: bool = False, first: object = None, compression: str = "none") -> None:
    """Nested meetings as one JSON array, newest first: the files of the folder, one after the other, are the array's text (or, compressed,
    what unpacks to it). A record takes a line, with a comma before all but the first, whose id
    may be given. Events that come in order may come as (id, json)."""
    if first is None:
        first = (events.select("id", "date").orderBy(F.desc("date"), "id").first() or {"id": None})["id"]
    record = F.concat(F.when(F.col("id").eqNullSafe(F.lit(first)), "").otherwise(","), F.col("json") if events.columns == ["id", "json"] else event_json(events))
    lines = (events if in_order else _newest_first(events)).select(record.alias("value"))
    end = lambda sign: events.sparkSession.range(0, 1, 1, 1).select(F.lit(sign).alias("value"))
    # A union keeps its parts' partitions in order.
    end("[").union(lines).union(end("]")).write.option("compression", compression).text(path)


def read_calendar_feed(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """The feed (or, multi_line, one JSON array) under a given schema; a missing path gives no rows."""
    try:
        return read_json_array(spark, path, schema) if multi_line else spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The objects of a JSON array, in one file or laid out over the files of a folder (cut between objects; compressed ones with
    whole objects on each line), read in as many tasks as the files have splits."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    # A line of a small file fits into a row; whether lines hold whole objects is seen from the lines themselves.
    if files.agg(F.max("length")).first()[0] < LINES:
        lines = spark.read.text(path).select(F.btrim("value", F.lit(", \t\r\ufeff")).alias("line"))
        whole = F.concat(F.lit("["), "line", F.lit("]"))
        mark = F.col("line").isin("[", "]")
        odd = ~mark & (F.col("line") != "") & F.json_array_length(whole).isNull()
        seen = lines.agg(F.count_if(F.col("line") == "[").alias("opens"), F.count_if(F.col("line") == "]").alias("closes"), F.count_if(odd).alias("odd")).first()
        if (seen["opens"], seen["closes"], seen["odd"]) == (1, 1, 0):
            one = lines.where(~mark & (F.col("line") != ""))
            return one.select(F.inline(F.from_json(whole, ArrayType(schema))))
    return _read_any_array(spark, path, schema)


def _read_any_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The objects of an array that is laid out in any way.

    A file is cut at every closing brace, in as many tasks as it has splits. Where a piece stands, inside a string or not and how
    deep, follows from the pieces before it: every split sums up what it does to either state, and the splits' sums, in order,
    give each its start. A record ends where the depth comes back to that of the array.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"\\.", "")  # escapes hold no quote of a string
    inside = F.regexp_replace(plain, r'^[^"]*"?', "")  # what follows the string that the piece begins in
    rows = pieces.select("*", (F.regexp_count(plain, F.lit('"')) % 2).alias("flip"), _depth(plain).alias("step0"), _depth(inside).alias("step1"), (F.regexp_count(plain, F.lit('"')) == 0).alias("all_string"))
    rows = rows.withColumn("step1", F.when(F.col("all_string"), 0).otherwise(F.col("step1")))
    split = Window.partitionBy("file", "block").orderBy("at")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    # The state at a piece's start, if the split starts outside a string; the other case is its opposite. A closing brace counts outside strings.
    rows = rows.withColumn("odd", F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2)
    net = lambda odd: F.when(odd == 0, F.col("step0")).otherwise(F.col("step1")) - F.when((odd + F.col("flip")) % 2 == 0, 1).otherwise(0)
    rows = rows.withColumns({"net0": net(F.col("odd")), "net1": net(1 - F.col("odd"))})
    splits = rows.groupBy("file", "block").agg((F.sum("flip") % 2).alias("turn"), F.sum("net0").alias("sum0"), F.sum("net1").alias("sum1"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    # What stands behind a file's last brace is a piece as well, but none that a brace closes.
    file = Window.partitionBy("file")
    rest = F.when((F.col("block") == F.max("block").over(file)) & (F.sum("bytes").over(file) > F.col("size")), 1).otherwise(0)
    splits = splits.withColumn("rest", rest).withColumns({"sum0": F.col("sum0") + F.col("rest"), "sum1": F.col("sum1") + F.col("rest")})
    # A row a split: the files and splits in order.
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("state", F.coalesce(F.sum("turn").over(earlier), F.lit(0)) % 2)
    starts = starts.withColumn("base", F.coalesce(F.sum(F.when(F.col("state") == 0, F.col("sum0")).otherwise(F.col("sum1"))).over(earlier), F.lit(0))).select("file", "block", "state", "base", "rest")
    met = rows.join(starts, ["file", "block"])
    met = met.withColumn("net", F.when(F.col("state") == 0, F.col("net0")).otherwise(F.col("net1"))).withColumn("open", (F.col("odd") + F.col("state") + F.col("flip")) % 2 == 0)
    met = met.withColumn("depth", F.col("base") + F.sum("net").over(split))
    ends = met.withColumn("ends", (F.col("open") & (F.col("depth") == 1)).cast("long"))
    # Records that end before a piece, in its split; the splits' counts number them through.
    own = ends.withColumn("no", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    count = ends.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    first = count.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    own = own.withColumn("behind", (F.col("rest") == 1) & (F.col("at") == F.max("at").over(Window.partitionBy("file", "block")))).where("NOT behind")
    whole = own.join(first, ["file", "block"]).groupBy((F.col("first") + F.col("no")).alias("record")).agg(F.array_sort(F.collect_list(F.struct("file", "block", "at", "value"))).alias("parts"), F.max("ends").alias("ends"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    record = F.regexp_replace(text, r"^[\s\x{FEFF}\[,]+", "")
    return whole.where("ends = 1").select(F.from_json(record, schema).alias("r")).select("r.*")


def _depth(text: Column) -> Column:
    """Brackets and braces that a piece opens, less brackets that it closes, outside the strings that begin in it."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|$)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"\]"))


def write_json(rows: DataFrame, path: str) -> None:
    """Issues with their counts, or the corpus with its lists kept: one compact record per line."""
    rows.write.json(path)


def flat_corpus(rows: DataFrame) -> DataFrame:
    """The corpus with its lists as text: joined, and evidence as claims with their quotes."""
    texts = {c: F.array_join(c, "; ") for c in ("topics", "initiatives", "stakeholders")}
    return rows.withColumns({**texts, "evidence": evidence_text(F.col("evidence"))})


def in_corpus_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rto", F.desc("meeting_date"), "title", "url")


def write_corpus_csv(rows: DataFrame, path: str) -> None:
    """The 18 columns with lists as text, in order; quotes are doubled, as spreadsheets read them. Every file starts with a byte order mark and the header."""
    named = [F.col(c).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(CORPUS_COLUMNS)]
    flat_corpus(in_corpus_order(rows)).select(*named).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_corpus_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def compact_csv_line(rows: DataFrame) -> Column:
    """One line of the reader's CSV; list columns are joined, columns that the rows lack are empty."""
    kinds = dict(rows.dtypes)
    value = lambda c: F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c)
    return F.concat_ws(",", *[cell(value(c)) if c in kinds else F.lit("") for c in COMPACT_COLUMNS])


def write_compact_csv(rows: DataFrame, path: str) -> None:
    """Lines ended by CR LF under one header line; the header is first in the first file."""
    order = [c for c in ("rto", "meeting_date", "title", "url") if c in rows.columns]
    lines = rows.select(F.lit(1).alias("k"), compact_csv_line(rows).alias("value"), *order)
    head = rows.sparkSession.createDataFrame([(0, "﻿" + ",".join(COMPACT_COLUMNS))], "k int, value string")
    head.unionByName(lines, allowMissingColumns=True).orderBy("k", *[F.desc(c) if c == "meeting_date" else c for c in order], "value").select("value").write.option("lineSep", "\r\n").text(path)


def append_scrape_log(runs: DataFrame, path: str) -> None:
    """One row per run, appended: what was scraped and how it went. Counts that the rows lack are 0, texts and duration null."""
    have = lambda c, kind: F.col(c).cast(kind) if c in runs.columns else F.lit(0 if kind == "long" else None).cast(kind)
    kinds = {"target_url": "string", "status": "string", "events_found": "long", "docs_found": "long", "docs_downloaded": "long", "error_message": "string", "duration_seconds": "double"}
    runs.select("rto", "scrape_type", *[have(c, k).alias(c) for c, k in kinds.items()]).write.mode("append").parquet(path)
