"""Helpers shared by the training-data operators: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than space and \t \n \v \f \r; bytes.split() without argument cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode (tests) one is made where the session names none; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='parley-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/parley-{uuid.uuid4().hex}/{name}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Shuffle files of a finished job go once the driver has collected its plans; until then they hold disk on every executor."""
    gc.collect()
    spark._jvm.System.gc()


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart (null like empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id and text key are (left_semi) or are not (left_anti) among those of keys; null equals null.

    The helper columns take names that docs does not have.
    """
    taken = {c.lower() for c in docs.columns}
    own, d, t = (_free(n, taken) for n in ("parley_key", "parley_d", "parley_t"))
    right = keys.select(F.col("doc_id").alias(d), F.col("tkey").alias(t))
    keyed = docs.withColumn(own, text_key(F.col("text")))
    return keyed.join(right, keyed["doc_id"].eqNullSafe(right[d]) & (keyed[own] == right[t]), how).drop(own)


def beside(docs: DataFrame, found: DataFrame, column: str) -> tuple[DataFrame, str]:
    """docs with a column of found (doc_id, tkey, column) where the row has one, and the name it takes."""
    taken = {c.lower() for c in docs.columns}
    own, d, t, name = (_free(n, taken) for n in ("parley_key", "parley_d", "parley_t", f"parley_{column}"))
    right = found.select(F.col("doc_id").alias(d), F.col("tkey").alias(t), F.col(column).alias(name))
    keyed = docs.withColumn(own, text_key(F.col("text")))
    return keyed.join(right, keyed["doc_id"].eqNullSafe(right[d]) & (keyed[own] == right[t]), "left").drop(own, d, t), name


def one_of_equal(docs: DataFrame) -> DataFrame:
    """One row of every doc_id and text; a second pass over the texts only where there are repeats."""
    own = _free("parley_key", {c.lower() for c in docs.columns})
    keyed = docs.withColumn(own, text_key(F.col("text")))
    repeated = not keyed.groupBy("doc_id", own).count().where("count > 1").isEmpty()
    return keyed.dropDuplicates(["doc_id", own]).drop(own) if repeated else docs


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name = f"{name}_"
    return name


def slices(batches, rows: int = 1000):
    """Smaller batches, so that what is made of their texts takes little memory at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null gives b''."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


class Recent(dict):
    """What make gives for a key, remembered: of at most `limit` keys, half of them being the ones used last.

    New and rediscovered keys go into a young half; when it is full it becomes the old one, whose keys are forgotten unless
    they are asked for again. Keys longer than `longest` are not remembered.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, max(1, limit // 2), longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self._remember({key: value})
        return value

    def _remember(self, made: dict) -> None:
        if len(self) + len(made) > self.half:
            self.old = dict(self)
            self.clear()
        self.update({k: v for k, v in made.items() if len(k) <= self.longest})

    def many(self, keys: list) -> list:
        """What make gives for each of the keys; to be overridden where that is cheaper for many at a time."""
        return list(map(self.make, keys))

    def all(self, keys: list) -> list:
        """The values of a list of keys; those that are not remembered are made together."""
        got = list(map(self.get, keys))
        if None in got:
            made, fresh = {}, []
            for k in {k for k, v in zip(keys, got) if v is None}:
                value = self.old.get(k)
                if value is None:
                    fresh.append(k)
                else:
                    made[k] = value
            made.update(zip(fresh, self.many(fresh)))
            got = [made[k] if v is None else v for k, v in zip(keys, got)]
            self._remember(made)
        return got

    def forget(self) -> None:
        """Leaves most of the memory to what a worker does next."""
        self.old = {}


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


_POWERS: dict[int, np.ndarray] = {}
#: Longest table of powers that a worker keeps.
_KEPT = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling; tables of ordinary length are kept."""
    kept = _POWERS.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    size = n if n > _KEPT else max(1 << 16, 1 << max(0, n - 1).bit_length())
    out = np.ones(size, dtype=np.uint64)
    have = 1
    while have < size:
        more = min(have, size - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    if size <= _KEPT:
        _POWERS[base] = out
    return out[:n]


@lru_cache
def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(29))


def word_spans(data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word in a byte buffer: the runs of bytes that are not `between` words."""
    inside = np.concatenate(([False], ~between[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


#: Bytes beyond which a word is hashed by the library call; shorter ones eight bytes at a time, all words at once.
_LONG = 64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_SEEDS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD1B54A32D192ED03, 0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; every eight bytes are scrambled (not summed up), so words with inner patterns do not collide.

    The hashes of seed 0 and 1 are independent.
    """
    first, factor = (np.uint64(x) for x in _SEEDS[seed])
    size = end - start
    out = (size.astype(np.uint64) + np.uint64(1)) * first
    if not len(start):
        return out
    eight = np.lib.stride_tricks.as_strided(np.concatenate((data, np.zeros(8, dtype=np.uint8))).view(), (len(data) + 1, 8), (1, 1))
    some, at = np.arange(len(start)), start
    left = np.where(size > _LONG, 0, size)
    while True:
        part = np.ascontiguousarray(eight[at]).view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
        out[some] = mix((out[some] ^ part) * factor + first)
        go = np.flatnonzero(left > 8)
        if not len(go):
            break
        some, at, left = some[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    return out


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash (modulo 2**64) of each run of values from start to end, exclusive."""
    n = len(hashes)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(_inverse(base), n + 1)[start] + mix((end - start).astype(np.uint64)))


def rolling(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64) of every window of k consecutive values."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * powers(_inverse(base), n - k + 1))
