"""WARC archives of captures, and one globally ordered capture index merged from locally sorted runs.

Every task writes one archive (each record its own gzip member) and the index lines of its captures, sorted by URL key,
timestamp and page: a run. The runs are cut at common range bounds, and each range is merged by a k-way loser tree, so
the ranges in turn are the whole history in order; very many captures of one URL are cut by time too. Reading goes by
the merged index: the record's range of its archive is read, unpacked, parsed and checked against its digest.

Of records with equal payloads of at least LEAST bytes the one with the largest page_id is the response, the others are
revisits that refer to it. Defined results: null html is an empty payload; a null url has the key of an empty one; rows
that repeat the largest page_id with the same payload are all responses; a null page_id with an equal payload of another
page is a revisit; an empty table gives an empty result; extra columns are ignored. Pages carry no time, so a capture's
time is EPOCH plus page_id seconds.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

LEAST = 1000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
#: Index lines that one range holds, about.
RANGE_LINES = 100_000
INDEX = "urlkey string, stamp string, page_id long, run string, offset long, length long"


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query, lower-cased; without www and fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def stamp(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=min(max(page_id or 0, 0), 10**11))).strftime("%Y%m%d%H%M%S")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, size: int, digest: str) -> bytes:
    """One gzip member. A revisit keeps the HTTP head (with the payload's length) and leaves the payload out."""
    when = datetime.strptime(stamp(page_id), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}", "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple:
    """(page_id, payload bytes, payload digest in hexadecimal, type, refers_to) of one member; a wrong digest raises."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = lambda name: int(fields[name][len("<urn:x-page:") : -1] or -1) if name in fields else None
    number = page("WARC-Record-ID") if fields["WARC-Record-ID"] != "<urn:x-page:>" else None
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record of page {number} does not match its digest")
    return number, size, digest, fields["WARC-Type"], page("WARC-Refers-To")


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of each match, so a new head plays one match per level."""

    _END = object()

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, self._END) for r in self.runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is self._END or self.heads[b] is self._END:
            return self.heads[b] is self._END and self.heads[a] is not self._END
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        """Carry run i up to the root; while the tree is being filled an empty node keeps it."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.heads and self.heads[winner := self.losers[0]] is not self._END:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], self._END)
            self._play(winner)


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives; returns the stored runs: index lines, sorted within each run."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # Which payloads are equal is settled on page_id, digest and size alone; a payload that very many pages have meets no single task.
    slim = rows.where(F.col("size") >= least).select("page_id", "digest", "size")
    first, _ = common.store(slim.groupBy("digest", "size").agg(F.max("page_id").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n"), "main_pages")
    again = slim.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("main"))).select(F.col("page_id").alias("p"), F.col("digest").alias("g"), "main").distinct()
    joined = rows.join(again, rows["page_id"].eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left")
    planned = joined.select("page_id", "url", "payload", "size", "digest", F.col("main").alias("refers_to"))

    def archive(batches):
        out = files.Writer(folder, files.own_name("captures", ".warc.gz"))
        for batch in batches:
            found = []
            for page, url, body, size, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(6))):
                member = record(page, url, body, refers, size, digest)
                found.append((url_key(url), stamp(page), page, out.name, out.write(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 6, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["urlkey", "stamp", "page_id", "run", "offset", "length"])
        out.close()

    runs, _ = common.store(planned.mapInArrow(archive, INDEX).sortWithinPartitions("urlkey", "stamp", "page_id", "offset"), "runs")
    return runs


def merge(runs: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """The index lines in global order: range number and place in it (ranges follow one another)."""
    n = max(1, -(-runs.count() // range_lines))
    cut = runs.repartitionByRange(n, "urlkey", "stamp", "page_id", "run", "offset").sortWithinPartitions("run", "urlkey", "stamp", "page_id", "offset").withColumn("range_no", F.spark_partition_id())

    def merged(batches):
        own: dict[str, list] = {}
        number = 0
        for batch in batches:
            for line in zip(*(batch.column(i).to_pylist() for i in range(7))):
                own.setdefault(line[3], []).append(((line[0], line[1], line[2] is not None, line[2] or 0, line[3], line[4]), line[5]))
                number = line[6]
        at = 0
        block: list = []
        for (key, when, known, page, run, offset), length in LoserTree([own[r] for r in sorted(own)]):
            block.append((key, when, page if known else None, run, offset, length, number, at))
            at += 1
            if len(block) == 10_000:
                yield _lines(block)
                block = []
        yield _lines(block)

    return cut.mapInArrow(merged, INDEX + ", range_no int, place long")


def _lines(block: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*block)) or [()] * 8, kinds)], names=["urlkey", "stamp", "page_id", "run", "offset", "length", "range_no", "place"])


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index lines point to."""

    def records(batches):
        source = files.Reader(folder)
        for batch in batches:
            found = []
            for key, when, run, offset, length, number, place in zip(*(batch.column(c).to_pylist() for c in ("urlkey", "stamp", "run", "offset", "length", "range_no", "place"))):
                found.append((*parse(source.read(run, offset, length)), key, when, number, place))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 9, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp", "range_no", "place"])
        source.close()

    return index.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, stamp string, range_no int, place long")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives in the shared folder, their merged index, and every record read back through it."""
    folder = common.new_path(pages.sparkSession, "archives")
    index, _ = common.store(merge(write(pages, folder, least)), "index")
    return read(index.repartitionByRange("run", "offset").sortWithinPartitions("run", "offset"), folder)


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
