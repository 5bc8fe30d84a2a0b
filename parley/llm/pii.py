"""Personal data (DataFrame functions only): four base patterns, and contextual extraction bootstrapped from them.

Spans: a text is split by a pattern and its matches are taken; their lengths give each match's place. The patterns are
written without backtracking over long runs, and each is tried only on texts that hold a character it needs.

Contextual extraction, bootstrapped: the valid base matches are the seed entities. A lexical pattern is a kind with the
word before or the word after an entity, however much white space stands between. Candidates have a kind's shape but fail
its base pattern (a dotted address split by spaces, digits without a plus sign, an address written with `at` and `dot`).
Patterns and instances form a graph, and Spark scores them in turns: a pattern's trust is the share of believed ones among
its distinct instances (seeds are believed; an unknown candidate counts PRIOR); a pattern with SUPPORT believed instances
and a trust of TRUST or more makes all its candidates believed. So candidates found in one round induce patterns that no
seed ever stood in, and those find further ones in the next. Belief only grows, and it ends when a round finds nothing new.
Every mention of a believed candidate is a further span, wherever it stands; base spans always stay.

Defined results: a null text is empty and has no span; equal spans of equal texts are found in each row; repeated rows
keep a row each; an empty table gives an empty table; extra columns travel along in `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive runs and the look-behinds change no match; they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this cannot match.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Shapes that a trusted pattern may discover.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?| ?\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3} ?[.,] ?[0-9]{1,3} ?[.,] ?[0-9]{1,3} ?[.,] ?[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Trust that a pattern needs, believed instances that it needs, what an unknown candidate counts.
TRUST, SUPPORT, PRIOR = 0.8, 5, 0.65
#: The word at the end of what stands before an entity (a colon or equals sign belongs to it), and at the start of what stands behind.
_BEFORE, _AFTER = r"(?<!\p{L})(\p{L}{2,}+[:=]?)[\s\p{Z}]*+$", r"^[\s\p{Z}]++(\p{L}{2,}+)"
_SPAN = "struct<s:int,e:int,v:string,cues:array<string>>"


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<s,e,v,cues>> of the pattern's leftmost non-overlapping matches that `keep` accepts: place in code points, end
    exclusive, the text and its patterns' words (`<` the word before, `>` the word after; none where another match of the
    pattern stands next to it)."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # Every match with what stands before and behind it; the last piece has no match of its own.
    left = F.zip_with(found, pieces, lambda v, p: F.struct(v.alias("v"), p.alias("l")))
    met = F.zip_with(left, F.slice(pieces, 2, 1 << 30), lambda x, r: F.struct(x["v"].alias("v"), x["l"].alias("l"), r.alias("r")))
    word = lambda p, form, mark: F.nullif(F.concat(F.lit(mark), F.lower(F.regexp_extract(p, form, 1))), F.lit(mark))

    def step(acc: Column, x: Column) -> Column:
        start = acc["p"] + F.length(x["l"])
        end = start + F.length(x["v"])
        span = F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"), x["v"].alias("v"), F.array_compact(F.array(word(x["l"], _BEFORE, "<"), word(x["r"], _AFTER, ">"))).alias("cues"))
        good = F.lit(True) if keep is None else keep(x)
        return F.struct(end.cast("int").alias("p"), F.when(x["v"].isNotNull() & good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.aggregate(met, F.struct(F.lit(0).alias("p"), none.alias("out")), step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _is(kind: str):
    return lambda x: valid(kind, x["v"])


def _of(kind: str):
    return lambda m: m["kind"] == kind


def base(docs: DataFrame) -> DataFrame:
    """docs plus a column of valid base spans for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    cols = {k: F.when(text.rlike(NEEDS[k]), spans(text, BASE[k], _is(k))).otherwise(none) for k in KINDS}
    return docs.withColumns({f"b_{k}": c for k, c in cols.items()})


def mentions(found: DataFrame) -> DataFrame:
    """(kind, value, cues, seed, s, e, key columns): every base span and every shaped candidate, with the words beside it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for kind in KINDS:
        for seed, col in ((True, F.col(f"b_{kind}")), (False, F.when(text.rlike(SHAPES[kind]), spans(text, SHAPES[kind])).otherwise(none))):
            parts.append(F.transform(col, _mention(kind, seed)))
    return found.select("doc_id", "tkey", F.explode(F.concat(*parts)).alias("m")).select("doc_id", "tkey", "m.*")


def _mention(kind: str, seed: bool):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(seed).alias("seed"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("value"), x["cues"].alias("cues"))


def believed(found: DataFrame) -> DataFrame:
    """(kind, value) of the candidates that the graph of patterns and instances supports, seeds left out."""
    edges = found.select("kind", "value", "seed", F.explode("cues").alias("cue")).groupBy("kind", "cue", "value").agg(F.max("seed").alias("seed"))
    # A text that is a seed somewhere is one everywhere.
    seeds = found.where("seed").select("kind", "value").distinct().withColumn("known", F.lit(True))
    graph, path = common.store(edges.drop("seed").join(seeds, ["kind", "value"], "left").withColumn("known", F.coalesce("known", F.lit(False))), "pattern_graph")
    while True:
        pattern = graph.groupBy("kind", "cue").agg(F.avg(F.when(F.col("known"), 1.0).otherwise(PRIOR)).alias("trust"), F.count_if("known").alias("sure"))
        good = pattern.where((F.col("sure") >= SUPPORT) & (F.col("trust") >= TRUST) & (F.col("trust") < 1)).select("kind", "cue")  # those of trust 1 have nothing to pass on
        fresh, new = common.store(graph.where("NOT known").join(good, ["kind", "cue"], "left_semi").select("kind", "value").distinct(), "believed")
        if fresh.isEmpty():
            break
        grown, more = common.store(graph.join(fresh.withColumn("now", F.lit(True)), ["kind", "value"], "left").select("kind", "cue", "value", (F.col("known") | F.col("now").isNotNull()).alias("known")), "pattern_graph")
        common.drop(found.sparkSession, path, new)
        graph, path = grown, more
    return graph.where("known").select("kind", "value").distinct().join(seeds.select("kind", "value"), ["kind", "value"], "left_anti")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, base spans (b_<kind>) and `more`: spans that trusted patterns discover, none overlapping a base one."""
    rows = docs.select("doc_id", "text").withColumn("tkey", common.text_key(F.col("text")))
    kept = [f"b_{k}" for k in KINDS]
    found, _ = common.store(base(rows), "personal")
    mention, _ = common.store(mentions(found.select("doc_id", "tkey", "text", *kept)), "mentions")
    new = mention.where("NOT seed").select("doc_id", "tkey", "kind", "value", "s", "e").join(believed(mention), ["kind", "value"], "left_semi")
    more = new.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.collect_set(F.struct("kind", "s", "e")).alias("more"))
    narrow = found.select("doc_id", "tkey", *kept)
    joined = narrow.join(more, narrow["doc_id"].eqNullSafe(F.col("d")) & (narrow["tkey"] == F.col("t")), "left")
    taken = F.concat(*[F.col(c) for c in kept])
    fresh = F.filter("more", lambda m: ~F.exists(taken, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return joined.select("doc_id", "tkey", *kept, F.coalesce(fresh, F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("more"))


def listed(col: Column, kind: str) -> Column:
    return F.transform(F.array_sort(F.transform(col, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def digest(found: DataFrame) -> DataFrame:
    own = F.array_join(F.concat(*[listed(F.col(f"b_{k}"), k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[listed(F.concat(F.transform(F.col(f"b_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.transform(F.filter("more", _of(k)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), k) for k in KINDS]), ",")
    return found.select("doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(own, 256).alias("base_sha256"), every.alias("spans"))


def redact(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """docs with every span of its text replaced by <KIND>; overlapping spans go as one."""
    found = detect(docs) if found is None else found
    plain = lambda col, kind: F.transform(col, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    every = F.concat(*[plain(F.col(f"b_{k}"), k) for k in KINDS], F.transform("more", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["kind"].alias("kind"))))
    cuts = found.select("doc_id", "tkey", F.array_sort(every).alias("cuts")).where(F.size("cuts") > 0).dropDuplicates(["doc_id", "tkey"])
    joined, cut = common.beside(docs, cuts, "cuts")
    text = F.col("text")
    step = lambda acc, c: F.struct(F.greatest(acc["at"], c["e"]).alias("at"), F.when(c["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["s"] - acc["at"]), F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"))
    new = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.withColumn("text", F.when(F.col(cut).isNull(), text).otherwise(new)).select(*[F.col(f"`{c}`") for c in docs.columns])
