"""Document links of landed pages: anchors with their attributes, texts and table rows, kept by the rule of the page's source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_any_date
from ..functions.markup import attribute, squeeze, strip, unescape, without_tags
from ..functions.text import backfilled_title, is_junk_title

#: Links to files, by the extension at the end of the path.
DOCUMENT_PATH = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|csv|txt|zip|ashx)$"
_ANCHOR = r"(?is)<a(\s[^>]*)>(.*?)(?=</?a[\s>]|\z)"
_CELL = r"(?is)<td\b[^>]*>(.*?)(?=</?td[\s>]|</tr|\z)"
_OFFICE = r"(?i)\.(?:pdf|xlsx?|pptx|docx)"


@dataclass(frozen=True)
class Rule:
    """What counts as a document on the pages of a source, what it is called and when it was posted.

    Columns to go by: href (as written), url (absolute), host, path, tag (the anchor's attributes), label, label_html, cell (the
    text of the second cell of the anchor's table row), filename.
    """

    keep: Callable[[], Column]
    title: Callable[[], Column]
    posted: Callable[[], Column] = lambda: F.regexp_extract("path", r"(?<!\d)((?:19|20)\d{2}[-/_]?(?:0[1-9]|1[0-2])[-/_]?(?:0[1-9]|[12]\d|3[01]))(?!\d)", 1)
    label: Callable[[], Column] | None = None


def _or_name(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.col("filename"))


def _generic(keep: str) -> Rule:
    return Rule(lambda: F.col("path").rlike(keep), lambda: _or_name(backfilled_title(F.col("label"), F.col("filename"))))


def _is_pdf_or_filing() -> Column:
    href = F.col("href")
    return F.lower(href).endswith(".pdf") | href.contains("elibrary.ferc.gov/eLibrary/filelist") | href.contains("elibrary.ferc.gov/eLibrary/FileList") | href.contains("/sites/default/files/")


def _named_label() -> Column:
    low = F.lower("label")
    return F.when((low == "") | low.contains("download document") | low.isin("elibrary", "descargar documento"), F.when(F.col("filename") != "", F.col("filename")).otherwise("Attached document")).otherwise(F.col("label"))


def _own_text() -> Column:
    """The first text of the anchor that stands in no element within it; null if there is none."""
    flat = F.regexp_replace("label_html", r"(?is)<(\w+)\b[^>]*>.*?</\1\s*>|<[^>]*>", "\x00")
    return F.get(F.filter(F.transform(F.split(unescape(flat), "\x00"), strip), lambda x: x != ""), F.lit(0))


_NONE = lambda: F.lit(None).cast("string")
#: By source; patterns are fixed values: they must equal the original system's for right results.
RULES = {
    "pjm": Rule(
        lambda: (F.col("href").contains("/-/media/") | F.col("href").rlike(r"\.(?:pdf|xlsx?|pptx|docx|ashx)$")) & F.col("host").contains("pjm.com"),
        lambda: _or_name(F.when(is_junk_title(F.col("label")), backfilled_title(F.col("label"), F.col("filename"))).otherwise(F.col("label"))), lambda: F.date_format(parse_any_date(F.col("cell")), "yyyy-MM-dd"),
    ),
    "caiso_initiative": Rule(
        lambda: ~F.lower("href").contains("youtu") & ~F.left(F.lower("label"), F.lit(6)).contains("video") & (F.col("href").rlike(_OFFICE) | F.col("href").contains("InitiativeDocuments") | F.col("href").contains("caiso.com/documents")),
        lambda: _or_name(F.col("label")), _NONE,
    ),
    "caiso_page": Rule(lambda: F.col("href").rlike(_OFFICE) & F.col("host").contains("caiso.com"), lambda: _or_name(F.col("label")), _NONE),
    "pjm_issue": Rule(lambda: F.col("href").contains("/-/media/"), lambda: F.col("label"), _NONE, _own_text),
    "ercot": Rule(
        lambda: F.col("tag").rlike(r'^\s+download\s+href="[^"]+"\s+title="[^"]*"') & ~F.lower("path").rlike(r"\.(?:zip|ics)$"),
        lambda: _or_name(strip(attribute(F.col("tag"), "title"))), lambda: F.concat_ws("-", *[F.nullif(F.regexp_extract("url", r"/files/docs/(\d{4})/(\d{2})/(\d{2})/", i), F.lit("")) for i in (1, 2, 3)]),
    ),
    "ferc": Rule(_is_pdf_or_filing, _named_label, _NONE),
}


def absolute_url(href: Column, base: Column) -> Column:
    """href as seen from a page at base, with . and .. steps taken."""
    origin, scheme = F.regexp_extract(base, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][\w+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][\w+.-]*://[^/?#]*", ""), r"[?#].*$", ""), r"[^/]*$", "")
    path, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_replace(href, r"^[^?#]*", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    empty = F.array().cast("array<string>")
    steps = F.aggregate(F.split(F.regexp_replace(whole, r"/\.{1,2}$", "$0/"), "/"), empty, lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    own = F.when(path == "", F.concat(F.regexp_replace(base, r"[?#].*$", ""), tail)).otherwise(F.concat(origin, F.array_join(steps, "/"), tail))
    return F.when(href.rlike(r"^[A-Za-z][\w+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).otherwise(own)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, position, base, tag, href, url, host, path, filename, label, label_html, cell) of every anchor with an address.

    A page is cut at its table rows, so that an anchor knows its row.
    """
    rows = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.split("html", r"(?i)(?=<tr[\s>])", -1)).alias("row", "part"))
    inside = F.regexp_extract("part", r"(?is)^(<tr[\s>].*?)(?:</tr\s*>|\z)", 1)
    cells = F.regexp_extract_all(inside, F.lit(_CELL), F.lit(1))
    g = lambda i: F.regexp_extract_all("part", F.lit(_ANCHOR), F.lit(i))
    zipped = F.arrays_zip(g(1).alias("tag"), g(2).alias("label"))
    found = rows.select("page_id", "base", "row", cells.alias("cells"), F.length(inside).alias("inside"), F.posexplode(zipped).alias("at", "link"))
    href = strip(attribute(F.col("link.tag"), "href"))
    # A row's text behind its end belongs to no row; only its anchors before that have its cells.
    cell = F.when(F.size("cells") >= 2, squeeze(unescape(without_tags(F.get("cells", F.lit(1))))))
    out = found.select("page_id", F.struct("row", "at").alias("place"), "base", F.col("link.tag").alias("tag"), href.alias("href"), squeeze(unescape(without_tags(F.col("link.label")))).alias("label"), F.col("link.label").alias("label_html"), cell.alias("cell")).where("href <> ''")
    out = out.withColumn("url", absolute_url(F.col("href"), F.coalesce("base", F.lit(""))))
    path = F.regexp_replace("url", r"[?#].*$", "")
    tail = F.regexp_extract(path, r"([^/]*)$", 1)
    return out.withColumns({"host": F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), "path": path, "filename": F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail)})


def document_links(pages: DataFrame, keep: str = DOCUMENT_PATH, source: str | None = None) -> DataFrame:
    """(page_id, url, filename, title, posted_date, position): a page's document links, the first of each URL.

    pages: page_id, url, html. By the rule of a source, or any links whose path matches `keep`; of these, a title of no use
    (like "PDF") or none gives way to the file's name, and the date is the first in the path. position counts the kept links.
    """
    rule = RULES[source] if source else _generic(keep)
    rows = anchors(pages)
    rows = rows.withColumn("label", rule.label()) if rule.label else rows
    kept = rows.where(rule.keep()).withColumns({"title": rule.title(), "posted": rule.posted()})
    first = kept.groupBy("page_id", "url").agg(F.min_by(F.struct("place", "filename", "title", "posted"), "place").alias("f"))
    listed = first.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("f.place", "url", "f.filename", "f.title", "f.posted"))).alias("l")).select("page_id", F.posexplode("l").alias("position", "f"))
    day = F.try_to_timestamp(F.regexp_replace("f.posted", r"\D", ""), F.lit("yyyyMMdd")).cast("date")
    return listed.select("page_id", "f.url", "f.filename", "f.title", day.alias("posted_date"), "position")
