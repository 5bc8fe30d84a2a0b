"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification and groups.

A fingerprint (one or more 64-bit words) is cut into blocks. Of two fingerprint words that differ in r bits, at least
blocks - r blocks are equal, so joining on every choice of `equal` blocks finds every pair with r <= blocks - equal.
Equal fingerprints are joined once, not per copy. A bucket (one choice of blocks, one value) with more than TILE
fingerprints is split into tiles, all pairs of tiles are compared, and a tile gives a spanning forest of its links,
never all pairs: the groups are the same, and no bucket meets in one task.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text shorter than the
shingle is one shingle; repeated rows keep a row each; a null doc_id never names a group that has another member;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Fingerprints that one tile compares with each other.
TILE = 2048
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: bytes, k: int, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """Per seed the XXH64 value of each shingle, repeats included; none for a text without words."""
    words = text.translate(_UPPER).split()
    if not words:
        return [np.zeros(0, dtype="<u8")] * len(seeds)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[k - 1 :].tolist() if len(words) >= k else [len(joined)]
    cut = [joined[a:b] for a, b in zip(starts, ends)]
    return [np.array([xxhash.xxh64_intdigest(c, seed) for c in cut], dtype="<u8") for seed in seeds]


def fingerprint(text: bytes, k: int = 4, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """One 64-bit word per seed; a bit is set if it is set in over half of the shingles' XXH64 values."""
    out = []
    for hashes in shingles(text, k, seeds):
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, k: int, seeds: tuple[int, ...], keep: list[str]) -> DataFrame:
    """Columns `keep` of docs plus `fp`, the fingerprint in hexadecimal digits."""

    def run(batches):
        for batch in common.slices(batches):
            fps = ["".join(f"{w:016x}" for w in fingerprint(t, k, seeds)) for t in common.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps, pa.string())], names=[*keep, "fp"])

    chosen = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    types = dict(docs.dtypes)
    return chosen.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp string"]))


def block_masks(blocks: int, equal: int) -> list[int]:
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(part, equal)]


def links(fps: DataFrame, words: int, radius: int, blocks: int, equal: int, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, per bucket, of the fingerprint pairs that differ in at most `radius` bits."""
    masks = np.array(block_masks(blocks, equal), dtype=np.uint64)
    low = np.array([int(m).bit_count() for m in masks])
    assert low.min() > 0

    def keys(batches):
        """A row for each choice of blocks: bucket key and the fingerprint's words."""
        for batch in batches:
            raw = b"".join(bytes.fromhex(x) for x in batch.column("fp").to_pylist())
            fp = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, words)
            for w in range(words):
                for at in range(0, len(masks), 16):
                    some = masks[at : at + 16]
                    tag = np.arange(at + w * len(masks), at + w * len(masks) + len(some), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    key = common.mix((fp[:, w][:, None] & some[None, :]) ^ common.mix(tag + np.uint64(1))[None, :]).ravel()
                    cols = [pa.array(key.view(np.int64))] + [pa.array(np.repeat(fp[:, v], len(some)).view(np.int64)) for v in range(words)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", *names])

    names = [f"w{v}" for v in range(words)]
    keyed = fps.mapInArrow(keys, "key long, " + ", ".join(f"{n} long" for n in names))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(shared, "key")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64(*names), chunks).cast("int")
    tiled = (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *names)
    )
    placed = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches):
        """Rows arrive tile by tile; a tile's rows are gathered and compared once it is complete."""
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j", "own", *names)], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            same = np.all(rows[:, :3] == rows[-1, :3], axis=1)
            cut = int(np.argmax(same))
            held = [rows[cut:]]
            if cut:
                yield _forest(rows[:cut], radius, words)
        if held:
            yield _forest(np.concatenate(held), radius, words)

    return placed.mapInArrow(compare, "a string, b string").distinct()


def _forest(rows: np.ndarray, radius: int, words: int) -> pa.RecordBatch:
    edge = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
    a: list[str] = []
    b: list[str] = []
    show = lambda f: "".join(f"{int(w):016x}" for w in f)
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)]):
        if hi - lo < 2:
            continue
        fp = np.ascontiguousarray(rows[lo:hi, 4:]).view(np.uint64)
        if hi - lo <= 64:
            near = sum(np.bitwise_count(fp[:, v][:, None] ^ fp[:, v][None, :]).astype(np.int16) for v in range(words)) <= radius
            if int(near.sum()) == hi - lo:
                continue
        left = np.arange(len(fp))
        todo: list[int] = []
        while len(left) or todo:
            if todo:
                x = todo.pop()
            else:
                x, left = int(left[0]), left[1:]
            if not len(left):
                continue
            hit = sum(np.bitwise_count(fp[left, v] ^ fp[x, v]).astype(np.int16) for v in range(words)) <= radius
            found = left[hit]
            if len(found):
                left = left[~hit]
                mine = show(fp[x])
                for y in found.tolist():
                    a.append(mine)
                    b.append(show(fp[y]))
                    todo.append(y)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def near_groups(docs: DataFrame, k: int = 5, seeds: tuple[int, ...] = (42, 43, 44), radius: int = 48, blocks: int = 10, equal: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, tkey (the text's key), fp, root (least fp reachable over links) and group (smallest doc_id there)."""
    rows = docs.withColumn("tkey", common.text_key(F.col("text")))
    fps, _ = common.store(fingerprints(rows, k, seeds, ["doc_id", "tkey"]), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("fp"), len(seeds), radius, blocks, equal))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("group"))
    groups, _ = common.store(rooted.join(named, "root").select(F.col("fp").alias("f"), "root", "group"), "groups")
    return fps.join(groups, fps["fp"] == groups["f"], "left").select("doc_id", "tkey", "fp", "root", "group")


def digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", F.col("fp").alias("fingerprint"), F.col("group").alias("component_id"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in column.to_pylist()]


def _stay(sigs: list[np.ndarray], least: float) -> list[int]:
    """Of sets in order: those that are less than `least` similar to every earlier one that stays."""
    stay: list[int] = []
    for i, one in enumerate(sigs):
        if not stay or near_most(one, [sigs[k] for k in stay]) < least:
            stay.append(i)
    return stay


def near_most(one: np.ndarray, others: list[np.ndarray]) -> float:
    """The largest Jaccard similarity of a sorted set with some others."""
    best = 0.0
    for other in others:
        small, large = sorted((len(one), len(other)))
        if small >= best * large:
            best = max(best, jaccard(one, other))
    return best


_KEPT = ("root", "none", "doc_id", "tkey", "sig")


def _greedy(least: float):
    """For the rows of one group that are handed over: those that stay."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("none", "ascending"), ("doc_id", "ascending"), ("tkey", "ascending")])
        return table.take(pa.array(_stay(_sets(table.column("sig")), least), pa.int64())).select(_KEPT)

    return run


class Leaders:
    """Some sets, held so that one look gives what each shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self.every, self.of, self.size = every[order], of[order], np.array([len(s) for s in sets])

    def most(self, one: np.ndarray) -> float:
        lo, hi = np.searchsorted(self.every, one, "left"), np.searchsorted(self.every, one, "right")
        n = hi - lo
        hits = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
        both = np.bincount(self.of[hits], minlength=len(self.size))
        whole = self.size + len(one) - both
        return float(np.where(whole > 0, both / np.maximum(whole, 1), 1.0).max())


def _far(least: float):
    """The rows of a part of a group that are less than `least` similar to all of the group's new leaders."""

    def run(rows: pa.Table, leaders: pa.Table) -> pa.Table:
        rows = rows.select(_KEPT)
        if not rows.num_rows or not leaders.num_rows:
            return rows
        lead = Leaders(_sets(leaders.column("sig")))
        return rows.filter(pa.array([lead.most(one) < least for one in _sets(rows.column("sig"))], pa.bool_()))

    return run


#: Texts of a group that one task compares with each other; of larger groups the first LEADERS are, and then those that stay with the
#: rest, PART rows a task.
SMALL, LEADERS, PART = 64, 256, 1000


def first_of_near(docs: DataFrame, least: float = 0.8, k: int = 5, seeds: tuple[int, ...] = (42, 43, 44), radius: int = 48, blocks: int = 10, equal: int = 2) -> DataFrame:
    """(doc_id, tkey) of the rows that stay. In order of doc_id (null last) a text stays unless its shingle set has at least
    `least` in common (Jaccard) with one of its group that stays, so every text that goes has a near copy that stays.

    Fingerprints only propose groups: texts within `radius` bits and what they chain to.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text", common.text_key(F.col("text")).alias("tkey"))
    fps, _ = common.store(fingerprints(keyed, k, seeds, ["doc_id", "tkey"]), "fingerprints")
    # Equal rows are one item; rows of one fingerprint with different texts are several.
    items = fps.groupBy("fp", "tkey").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("f")).select("fp", "tkey", "f.none", "f.doc_id")
    found, _ = common.store(components(links(items.select("fp").distinct(), len(seeds), radius, blocks, equal)), "roots")
    rooted, _ = common.store(items.join(found, items["fp"] == found["node"], "left").select("none", "doc_id", "tkey", F.coalesce("root", "fp").alias("root")), "rooted")
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("none", "doc_id", "tkey")).alias("f"))
    kept = [sizes.where("n = 1").select("f.doc_id", "f.tkey")]

    def sets(batches):
        for batch in batches:
            sig = [np.unique(shingles(t, k, seeds[:1])[0]).tobytes() for t in common.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "none", "doc_id", "tkey")), pa.array(sig, pa.binary())], names=["root", "none", "doc_id", "tkey", "sig"])

    grouped = rooted.join(sizes.where("n > 1").select("root"), "root").select("root", "none", F.col("doc_id").alias("d"), F.col("tkey").alias("t"))
    texts = keyed.join(grouped, keyed["doc_id"].eqNullSafe(F.col("d")) & (keyed["tkey"] == F.col("t"))).select("root", "none", "doc_id", "tkey", "text")
    schema = f"root string, none boolean, doc_id {kind}, tkey long, sig binary"
    left, path = common.store(texts.mapInArrow(sets, schema).dropDuplicates(["doc_id", "tkey"]), "near")
    order = Window.partitionBy("root").orderBy("none", "doc_id", "tkey")
    while True:
        sizes, sizes_path = common.store(left.groupBy("root").agg(F.count("*").alias("n")), "near_sizes")
        small = left.join(sizes.where(F.col("n") <= SMALL).select("root"), "root")
        kept.append(common.store(small.groupBy("root").applyInArrow(_greedy(least), schema).select("doc_id", "tkey"), "stay")[0])
        large = sizes.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        rows = left.join(large, "root")
        heads = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= LEADERS).drop("n", "rn")
        lead, _ = common.store(heads.groupBy("root").applyInArrow(_greedy(least), schema), "leaders")
        kept.append(lead.select("doc_id", "tkey"))
        # The leaders go to every part of their group; parts are as many as its rows need. Heads that go are near a leader too.
        parts = F.ceil(F.col("n") / PART).cast("int")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tkey"), parts).cast("int")).drop("n")
        sent = lead.join(large, "root").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
        after, after_path = common.store(salted.groupBy("root", "salt").cogroup(sent.groupBy("root", "salt")).applyInArrow(_far(least), schema), "near")
        common.drop(spark, path, sizes_path)
        left, path = after, after_path
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return common.store(out, "stays")[0]


def keep_first(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of equal rows."""
    return common.one_of_equal(common.matched(docs, stay, "left_semi"))
