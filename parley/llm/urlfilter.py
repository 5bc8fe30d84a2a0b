"""URL filters (DataFrame and SQL functions only): rules first, then logistic regression on hashed character n-grams.

A URL's host and path are cut out and its rule is looked up. Where no rule fits, a model decides: the n-grams (SIZES) of
the code points of host and path, each between two marks, are hashed into BUCKETS numbers (a polynomial modulo a prime;
host and path and every size have their own place in it); a URL's vector holds its distinct numbers at equal weights and
length one. Weights are trained by STEPS full gradient steps with a ridge, in one SQL expression over the labelled table,
which is bounded: at most LABELLED rows (those with the smallest hash) are fitted on. Scoring is one pass over the URLs,
without a shuffle, and linear in a URL's length.

Defined results: a null URL or one without `://` has an empty host and path, no rule, and is scored by the intercept
alone; repeated rows keep a row each; of rules of equal length the first counts; labelled rows with a null URL or a
label other than 0 and 1 are left out, equal ones count once, and a URL with both labels counts once for each; without
rows of both labels the model blocks only if all rows say 1; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: n-gram sizes, buckets (a prime), factor of the polynomial.
SIZES, BUCKETS, FACTOR = (3, 4, 5), 8191, 137
#: Bound on the labelled rows that are fitted on; gradient steps, their size, ridge.
LABELLED, STEPS, RATE, RIDGE = 4000, 100, 6.0, 2e-4
#: (verdict, host, path) of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small labelled table: hosts by topic, each met with some paths. Fixed values, written for this library.
BLOCKED = """casino-royal lucky-casino casinowin slots-jackpot free-slots poker-bonus bets-online sports-bets freebets bet-win win-big-prize jackpot-win
spam-mail spam-site link-farm seo-links cheap-meds cheap-pharmacy online-pills pills-discount buy-viagra diet-pills weightloss-pills replica-watches cheap-rolex cheap-loans payday-loans quick-cash
adult-video adult-cams xxx-tube sex-chat hot-singles adult-dating nude-pics porn-x escort-x adultx
ads-server ad-click track-ads tracker-pixel click-track adserver popup-ads banner-ads free-iphone free-gift win-prize
warez-crack serial-keygen crack-download free-torrents malware-drop phish-login""".split()
ALLOWED = """news daily-news morning-post city-library university science-journal museum open-archive history-notes public-radio
weather travel-guide garden-notes cooking recipes-home family-kitchen health-service hospital school teachers-room
python-docs linux-wiki code-forum developer-notes math-club physics-today astronomy birdwatch river-maps mountain-trails
football-club tennis-court bicycle-repair train-times city-council parliament law-review bank-of-town insurance-help local-market
bookshop poetry theatre film-review music-school jazz-archive photo-album craft-fair knitting pottery
theron therin tionsh tionble ththan ththes ernesta anderlin stonen thering antion entis reston whether ourland hessen""".split()
PATHS = ("/", "/en/12", "/en/431.html", "/fr/77/", "/de/915", "/es/206", "/about", "/index.html", "/2023/05/story")
TAILS = ("example.com", "example.net", "example.org")


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label) of the small table: every host with three of the paths and tails in turn."""
    hosts = [(h, y) for y, hosts in ((1, BLOCKED), (0, ALLOWED)) for h in hosts]
    rows = [(f"https://{('', 'www.', 'm.', 'blog.')[(i + j) % 4]}{h}.{TAILS[(i + j) % 3]}{PATHS[(i + 3 * j) % len(PATHS)]}", y) for i, (h, y) in enumerate(hosts) for j in range(3)]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    cut = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(cut, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.substr(cut, F.length(host) + 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        hit = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _codes(text: Column) -> Column:
    """Code points between the marks 2 and 3; an empty text gives the marks alone."""
    return F.concat(F.array(F.lit(2)), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii), F.array(F.lit(3))).cast("array<bigint>")


def _grams(codes: Column, size: int, place: int) -> Column:
    """Numbers of the n-grams of one size."""
    n = F.size(codes)

    def number(i: Column) -> Column:
        total = F.lit(place).cast("bigint")
        for j in range(size):
            total = total * FACTOR + F.get(codes, i + j)
        return total % BUCKETS

    return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), number)).otherwise(F.array().cast("array<bigint>"))


def featured(urls: DataFrame) -> DataFrame:
    """Adds host, path and grams (array of distinct numbers) to rows with a url."""
    host, path = host_and_path(F.col("url"))
    cut = urls.withColumns({"host": host, "path": path}).withColumns({"host_codes": _codes(F.col("host")), "path_codes": _codes(F.col("path"))})
    parts = [_grams(F.col(c), n, 10 * k + n) for k, c in enumerate(("host_codes", "path_codes")) for n in SIZES]
    grams = F.when((F.col("host") == "") & (F.col("path") == ""), F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.concat(*parts)))
    return cut.withColumn("grams", grams).drop("host_codes", "path_codes")


def train(table: DataFrame, bound: int = LABELLED, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """BUCKETS weights and, last, the intercept, from (url, label). The rows fitted on are bounded, so they meet in one row."""
    rows = table.where("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("int").alias("label")).distinct()
    rows = featured(rows.orderBy(F.xxhash64("url"), "url", "label").limit(bound))
    numbered = rows.agg(F.sort_array(F.collect_list(F.struct("url", "label", "grams"))).alias("rows")).select(F.posexplode("rows").alias("i", "r")).select("i", "r.label", "r.grams")
    lists = numbered.select("i", F.explode("grams").alias("g")).groupBy("g").agg(F.sort_array(F.collect_list("i")).alias("l"))
    # Only numbers that a labelled row holds have weights, so training runs over these, renumbered.
    known = lists.agg(F.sort_array(F.collect_list(F.struct("g", "l"))).alias("known"))
    places = known.select(F.posexplode("known").alias("f", "x")).select("f", F.explode("x.l").alias("i")).groupBy("i").agg(F.sort_array(F.collect_list("f")).alias("at"))
    row = F.struct("i", F.col("label").alias("y"), (1 / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))).alias("s"), F.coalesce("at", F.array().cast("array<int>")).alias("at"))
    one = numbered.join(places, "i", "left").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.greatest(F.count("*"), F.lit(1)).alias("n"), F.sum("label").alias("ones"))
    both = one.unionByName(known.select(F.col("known.g").alias("known"), F.col("known.l").alias("lists")), allowMissingColumns=True)  # two rows made one
    one = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("rows", "n", "ones", "known", "lists")])
    # Even steps work out what the rows miss, odd ones move the weights: what both need stands in the state, so nothing is worked out twice.
    fitted = one.selectExpr("n", "ones", "known", f"""aggregate(sequence(1, {2 * steps}),
        named_struct('w', transform(known, g -> 0D), 'b', 0D, 'miss', transform(rows, r -> 0D)),
        (z, t) -> named_struct(
            'w', IF(t % 2 = 1, z.w, transform(lists, (l, f) -> z.w[f] - {rate}D * (aggregate(l, 0D, (a, i) -> a + z.miss[i] * rows[i].s) / n + {ridge}D * z.w[f]))),
            'b', IF(t % 2 = 1, z.b, z.b - {rate}D * aggregate(z.miss, 0D, (a, m) -> a + m) / n),
            'miss', IF(t % 2 = 0, z.miss, transform(rows, r -> 1 / (1 + exp(-(z.b + r.s * aggregate(r.at, 0D, (a, f) -> a + z.w[f])))) - r.y)))) AS z""")
    got = fitted.select("n", "ones", "known", "z.w", "z.b").first()  # bounded: at most BUCKETS weights
    weights = np.zeros(BUCKETS + 1)
    ones = got["ones"] or 0
    if 0 < ones < got["n"]:
        weights[np.array(got["known"], dtype=np.int64)] = got["w"]
        weights[-1] = got["b"]
    else:
        weights[-1] = 1.0 if ones else -1.0
    return weights


def judge(pages: DataFrame, weights: np.ndarray, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (what the model says, whether or not a rule decides) of every row."""
    w = F.lit(weights)
    rows = featured(pages.select("page_id", "url"))
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(w, g.cast("int")))
    odds = F.lit(float(weights[-1])) + total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))
    ruled = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"), (1 / (1 + F.exp(-odds))).alias("score"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
