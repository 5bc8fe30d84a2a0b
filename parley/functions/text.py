"""Column functions on titles, names, file names and long texts: built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .markup import SPACE, squeeze, strip


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The name of the first rule whose pattern occurs in the text."""
    chain = reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0]))
    return chain.otherwise(F.lit("other") if otherwise is None else otherwise)


def classify_document(text: Column) -> Column:
    return first_rule(F.lower(F.coalesce(text, F.lit(""))), dims.DOC_RULES)


def classify_document_by_source(rto: Column, label: Column, filename: Column, title: Column) -> Column:
    """Each source's own rules first; ISO-NE goes by its label, SPP and PJM fall back on the common rules."""
    f, t = F.coalesce(filename, F.lit("")), F.coalesce(title, F.lit(""))
    both, lab = F.lower(F.concat(f, F.lit(" "), t)), F.lower(F.coalesce(label, F.lit("")))
    isone = first_rule(lab, [("agenda", "agenda"), ("minutes", "minutes"), ("presentation", "presentation|slide"), ("notice", "notice")], F.when(lab.contains("material"), classify_document(title)).when(lab.contains("report"), "report").otherwise(classify_document(title)))
    return (
        F.when(rto == "PJM", first_rule(both, dims.PJM_DOC_RULES, classify_document(both)))
        .when(rto == "CAISO", first_rule(both, dims.CAISO_DOC_RULES))
        .when(rto == "ISO-NE", isone)
        .when(rto.isin("SPP", "SPP Markets +"), first_rule(both, [("minutes", "minutes"), ("agenda", "agenda"), ("materials", "materials")], classify_document(both)))
        .otherwise(classify_document(both))
    )


def title_from_filename(filename: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^\d{6,8}[-_]?", "")
    base = F.replace(F.replace(base, F.lit("---"), F.lit(" – ")), F.lit("--"), F.lit(" – "))
    base = F.trim(F.regexp_replace(F.translate(base, "_-", "  "), r"\s+", " "))
    words = F.transform(F.split(base, " "), lambda w: F.when(F.upper(w).isin(dims.ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.right(w, F.length(w) - 1))))
    return F.when(base != "", F.array_join(words, " "))


def is_junk_title(title: Column) -> Column:
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).isin(dims.JUNK_TITLES)


def backfill_stored_title(title: Column, filename: Column, rto: Column) -> Column:
    """A stored PJM title that only names a file format gives way to the file name's, unless that is no better."""
    new = title_from_filename(filename)
    return F.when((rto == "PJM") & is_junk_title(title) & ~is_junk_title(new), new).otherwise(title)


def backfilled_title(title: Column, filename: Column) -> Column:
    """The title, or the file name's where the title only names a file format and the other is usable."""
    return F.when(is_junk_title(title), F.coalesce(title_from_filename(filename), title)).otherwise(title)


def identify_rto(title: Column) -> Column:
    """struct(label, website) of the first keyword in the title."""
    up = F.upper(title)
    rules = list(dims.RTO_KEYWORDS.items())
    pick = lambda i: reduce(lambda c, r: c.when(up.contains(r[0]), r[1][i]), rules[1:], F.when(up.contains(rules[0][0]), rules[0][1][i]))
    return F.struct(F.coalesce(pick(0), F.lit("Other")).alias("rto"), pick(1).alias("rto_website"))


def match_committee_keywords(title: Column, rto: Column) -> Column:
    """All of the operator's committee keywords in the title, sorted, joined by "; "; null if none."""
    low = F.lower(title)
    lists = [(k, F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(F.lower(w)))) for k, words in dims.COMMITTEE_KEYWORDS.items()]
    found = reduce(lambda c, r: c.when(rto == r[0], r[1]), lists[1:], F.when(rto == lists[0][0], lists[0][1]))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, F.array_join(F.array_sort(F.array_distinct(found)), "; "))


def identify_committee(title: Column) -> Column:
    """struct(name, slug): the first full name in the title, else the first abbreviation that stands as a word."""
    rules = [(F.lower(title).contains(n.lower()), n, s) for n, s in dims.COMMITTEES.items()]
    rules += [(title.rlike(rf"\b{s.split('/')[-1].upper()}\b"), n, s) for n, s in dims.COMMITTEES.items() if s not in ("task-forces/elccstf", "task-forces/rmdstf")]
    pick = lambda i: reduce(lambda c, r: c.when(r[0], r[i]), rules[1:], F.when(rules[0][0], rules[0][i]))
    return F.struct(pick(1).alias("committee_name"), pick(2).alias("slug"))


def committee_of_subtype(subtype: Column, title: Column) -> Column:
    """The committee that an event's subtype names, else what the title keeps without its frame; null if nothing."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(subtype, F.lit(""))), r"^\[+|\]+$", ""), r"^\s*Name\s*:\s*", ""))
    bare = title
    for pattern in (r"(?i)^NEPOOL\s+", r"(?i)\s+Meeting\b.*$", r"\s*\([^)]*\)\s*$"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.when((name != "") & (name != dims.CATCHALL_SUBTYPE), name).otherwise(F.when(F.trim(bare) != "", F.trim(bare)))


def committee_from_slug(slug: Column) -> Column:
    """A page slug without its date and kind of meeting, as a title; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(slug, r"-\d{8}(?:-\d{2,4})?$", ""), "-(?:" + "|".join(dims.MEETING_SUFFIXES) + ")$", "")
    # A capital after everything that is no letter, as in M2M; initcap would only see white space.
    runs = F.regexp_extract_all(F.trim(F.replace(s, F.lit("-"), F.lit(" "))), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.right(r, F.length(r) - 1)))), "")
    name = F.regexp_replace(titled, r"(?i)\bmarketsplus\b", "Markets+")
    return F.when(name != "", name)


def track_rto(*parts: Column) -> Column:
    return F.when(F.lower(F.concat_ws(" ", *parts)).rlike(r"marketsplus|markets ?\+"), "SPP Markets +").otherwise("SPP")


def topics_array(topics: Column) -> Column:
    """The topics of a joined list; none for null or an empty text."""
    return F.when(topics != "", F.split(topics, ";")).otherwise(F.array().cast("array<string>"))


EVIDENCE = "array<struct<claim:string,quote:string,verified:boolean>>"


def evidence_array(evidence: Column) -> Column:
    """The evidence of a stored JSON text; none for null or a text that is no such list."""
    return F.coalesce(F.from_json(evidence, EVIDENCE), F.array().cast(EVIDENCE))


def evidence_text(items: Column) -> Column:
    """Each claim with its quote, marked where the quote was not found in the source."""
    shown = lambda e: F.concat(F.coalesce(e["claim"], F.lit("?")), F.lit(' — "'), F.coalesce(e["quote"], F.lit("")), F.when(F.coalesce(e["verified"], F.lit(False)), '"').otherwise('" [UNVERIFIED]'))
    return F.array_join(F.transform(items, shown), " | ")


def normalize_entity(name: Column) -> Column:
    n = F.trim(F.regexp_replace(F.trim(name), r"\s*\([^)]+\)\s*$", ""))
    n = F.trim(F.regexp_replace(n, "(?i)" + dims.ENTITY_SUFFIX, ""))
    alias = F.create_map(*[F.lit(x) for kv in dims.ENTITY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, F.lower(n)), F.when(n != "", n))


#: Signs that are folded before a quote is sought in a text. They must equal the original system's for right results.
_DASHES, _SINGLES, _DOUBLES, _SPACE, _NOTHING, _ELLIPSIS = "‐‑‒–—―−\u00ad", "‘’‚‛′´`", "“”„‟″", "\u00a0", "\u200b", "…"


def fold_typography(text: Column) -> Column:
    """White space (all that Unicode has) and typographic signs folded, for finding a quote in a text."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(_ELLIPSIS), F.lit("..."))
    return squeeze(F.translate(t, _DASHES + _SINGLES + _DOUBLES + _SPACE + _NOTHING, "-" * len(_DASHES) + "'" * len(_SINGLES) + '"' * len(_DOUBLES) + " "))


def build_excerpt(text: Column, budget: int = dims.EXCERPT_CHARS) -> Column:
    """struct(excerpt, elided): the text within the budget, else its head and tail around a marker."""
    t = strip(F.coalesce(text, F.lit("")))
    head = int(budget * dims.HEAD_SHARE)
    start, end = F.regexp_replace(F.substring(t, 1, head), f"{SPACE}+$", ""), F.regexp_replace(F.right(t, F.lit(budget - head)), f"^{SPACE}+", "")
    return F.struct(F.when(F.length(t) > budget, F.concat(start, F.lit(dims.OMISSION), end)).otherwise(t).alias("excerpt"), (F.length(t) > budget).alias("elided"))


def source_names_term(text: Column, pattern: str = dims.SUBJECT_TERM) -> Column:
    return F.coalesce(text, F.lit("")).rlike(pattern)
