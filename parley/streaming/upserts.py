"""Incremental folds of all keyed tables: a stream of landed records merged into a store of meetings, documents, issues and references.

A landed record is a meeting with the documents found for it, or an issue with the URLs it refers to. Each batch splits
its records into the four kinds of sightings, in the order of dependence, and folds each kind by its key. An attribute
keeps the greatest (seq, value) that is not null, a first value the smallest, so folds commute and repeats change nothing:
late, repeated or replayed files give the same store as one batch over all of them. What depends on another table keeps
that table's key, and takes its id when the store is read, as an earlier sighting may still come.

A table lies in BUCKETS parts by its key's hash. A batch reads and writes only the parts that its own keys touch: the new
version n of a part lies beside the older one. Once all tables of a batch are written, a mark says so; then older versions
go. A batch that failed runs again over the versions before it, and one that is marked is left out, so every record counts
once. Readers see the versions of marked batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table; more for larger stores, and the same ones for a store's whole life.
BUCKETS = 16
#: What lands: seq orders the sightings; a record has a meeting or an issue.
LANDED = (
    "seq long, meeting struct<rto string, title string, meeting_date date, meeting_time string, committee string, location string, source_url string, detail_url string, materials_url string>, "
    "documents array<struct<seq long, download_url string, doc_type string, title string, filename string, posted_date string, member_url string>>, "
    "issue struct<rto string, native_id string, canonical_name string, short_title string, status string, stakeholder_phase string, committee_owner string, is_open int, url string>, "
    "refs array<struct<ref_url string, ref_title string>>"
)


@dataclass(frozen=True)
class Keyed:
    """A keyed table: attributes that stay as first seen, and those of which the latest that is not null counts."""

    name: str
    key: tuple[str, ...]
    first: tuple[str, ...]
    latest: tuple[str, ...]


#: In order of dependence.
TABLES = (
    Keyed("meetings", ("rto", "title", "meeting_date"), (), ("meeting_time", "committee", "location", "source_url", "detail_url", "materials_url")),
    Keyed("documents", ("download_url",), ("meeting_key",), ("doc_type", "title", "filename", "posted_date", "member_url")),
    Keyed("issues", ("rto", "native_id"), (), ("canonical_name", "short_title", "status", "stakeholder_phase", "committee_owner", "is_open", "url")),
    Keyed("references", ("rto", "native_id", "ref_url"), (), ("ref_title",)),
)


def sightings(landed: DataFrame) -> dict[str, DataFrame]:
    """The four kinds of sightings in landed records, each with seq."""
    met, raised = landed.where("meeting IS NOT NULL"), landed.where("issue IS NOT NULL")
    return {
        "meetings": met.select("seq", "meeting.*"),
        "documents": met.select("meeting", F.explode("documents").alias("d")).select(F.struct("meeting.rto", "meeting.title", "meeting.meeting_date").alias("meeting_key"), "d.*").where("download_url IS NOT NULL"),
        "issues": raised.select("seq", "issue.*"),
        "references": raised.select("seq", "issue.rto", "issue.native_id", F.explode("refs").alias("r")).select("seq", "rto", "native_id", "r.*").where("ref_url IS NOT NULL"),
    }


def as_state(rows: DataFrame, table: Keyed, buckets: int = BUCKETS) -> DataFrame:
    seen = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("seq"), F.col(c).alias("value"))).alias(c)
    return rows.select(*table.key, F.col("seq").alias("id"), F.col("seq").alias("last_seq"), *map(seen, (*table.first, *table.latest)), bucket(table, buckets).alias("bucket"))


def bucket(table: Keyed, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*table.key), F.lit(buckets)).cast("int")


def merge(state: DataFrame, table: Keyed) -> DataFrame:
    return state.groupBy("bucket", *table.key).agg(F.min("id").alias("id"), F.max("last_seq").alias("last_seq"), *[F.min(c).alias(c) for c in table.first], *[F.max(c).alias(c) for c in table.latest])


class Store:
    """The keyed tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._system.globStatus(self._path(f"{self.root}/{pattern}"))
        return [str(f.getPath()) for f in found or []]

    def done(self) -> int:
        """The last batch that is whole, or -1."""
        return max((int(p.rsplit("/", 1)[1]) for p in self._names("done/*")), default=-1)

    def versions(self, table: Keyed, upto: int) -> dict[int, str]:
        """The path of every part's newest version that is no later than a batch."""
        newest: dict[int, tuple[int, str]] = {}
        for path in self._names(f"{table.name}/version=*/bucket=*"):
            version, part = (int(p.split("=")[1]) for p in path.rsplit("/", 2)[1:])
            if version <= upto:
                newest[part] = max(newest.get(part, (-1, "")), (version, path))
        return {part: path for part, (_, path) in newest.items()}

    def fold(self, rows: DataFrame, table: Keyed, n: int) -> None:
        """Merges a batch's sightings into the parts that they touch."""
        own = f"{self.root}/arriving/{table.name}"
        merge(as_state(rows, table, self.buckets), table).write.mode("overwrite").partitionBy("bucket").parquet(own)
        touched = [int(p.rsplit("=", 1)[1]) for p in self._names(f"arriving/{table.name}/bucket=*")]
        if not touched:
            return
        before = self.versions(table, n - 1)
        new = self.spark.read.parquet(own)
        old = [before[b] for b in touched if b in before]
        state = new if not old else new.unionByName(self._read(old, new.schema.jsonValue()))
        # One task a part: its keys are grouped where it is written.
        merge(state.repartition(len(touched), "bucket"), table).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table.name}/version={n}")

    def _read(self, paths: list[str], kind: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        base = paths[0].rsplit("/", 2)[0]
        return self.spark.read.schema(StructType.fromJson(kind)).option("basePath", base).parquet(*paths).drop("version")

    def apply(self, batch: DataFrame, n: int) -> None:
        if n <= self.done():
            return
        kinds = sightings(batch)
        for table in TABLES:
            self.fold(kinds[table.name], table, n)
        self._system.mkdirs(self._path(f"{self.root}/done/{n}"))
        self.tidy()

    def tidy(self) -> None:
        """Parts that a newer version replaces go, and marks of older batches."""
        last = self.done()
        for table in TABLES:
            kept = set(self.versions(table, last).values())
            for path in self._names(f"{table.name}/version=*/bucket=*"):
                if path not in kept and int(path.rsplit("/", 2)[1].split("=")[1]) <= last:
                    self._system.delete(self._path(path), True)
        for path in self._names("done/*"):
            if int(path.rsplit("/", 1)[1]) < last:
                self._system.delete(self._path(path), True)

    def state(self, table: Keyed) -> DataFrame | None:
        paths = sorted(self.versions(table, self.done()).values())
        if not paths:
            return None
        base = paths[0].rsplit("/", 2)[0]
        return self.spark.read.option("basePath", base).parquet(*paths).drop("version", "bucket")

    def _current(self, name: str) -> DataFrame:
        table = next(t for t in TABLES if t.name == name)
        state = self.state(table)
        if state is None:
            empty = sightings(self.spark.createDataFrame([], LANDED))[name]
            state = merge(as_state(empty, table), table).drop("bucket")
        value = [F.col(c)["value"].alias(c) for c in (*table.first, *table.latest)]
        return state.select(*table.key, "id", *value, "last_seq")

    def meetings(self) -> DataFrame:
        """As upsert_meetings gives them."""
        return self._current("meetings")

    def documents(self) -> DataFrame:
        """As upsert_documents gives them: with the id and operator of the meeting they were first seen at."""
        m = self._current("meetings").select(F.col("id").alias("meeting_id"), F.struct("rto", "title", "meeting_date").alias("meeting_key"))
        rows = self._current("documents").withColumn("rto", F.col("meeting_key.rto"))
        hit = rows["meeting_key"].eqNullSafe(m["meeting_key"])
        return rows.join(m, hit).drop("meeting_key")

    def issues(self) -> DataFrame:
        return self._current("issues")

    def references(self) -> DataFrame:
        """With the issue's id."""
        i = self._current("issues").select(F.col("id").alias("issue_id"), F.struct("rto", "native_id").alias("issue"))
        rows = self._current("references").withColumn("own", F.struct("rto", "native_id"))
        return rows.join(i, rows["own"].eqNullSafe(i["issue"])).drop("own", "issue")


def incremental_upsert(spark: SparkSession, landed: str, root: str, checkpoint: str, files_per_batch: int = 100, buckets: int = BUCKETS) -> Store:
    """Merges all files that landed since the last run into the store under `root`."""
    store = Store(spark, root, buckets)
    run = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).parquet(landed).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(store.apply).start()
    run.awaitTermination()
    return store
