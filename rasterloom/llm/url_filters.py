"""URL filters by Bloom filter cascades.

A list of keys (host and path prefix, like example.com/en/) becomes a cascade of Bloom
filters: the first holds the listed keys, the second what the first lets through
wrongly of all keys that the corpus has, the third the listed keys that the second
catches, and so on until nothing is told wrongly. Over that key universe membership is
exact, and each url is judged in its own task without a join. The universe is counted
and filtered as a distributed table, in one pass over the urls; only the filters reach
the driver and the tasks. A list's cascade takes about 1.44 * log2(universe / list) bits a
listed key; it is cut into shards by a hash of the key, so that none exceeds
`max_filter_bytes`, and urls meet the shards one after another on their way through their
task, whatever the length of the list.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]
#: Hosts that are blocked with their subdomains where no rule fits: what sells pills, bets and the like, under any of the corpus's top-level domains.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def digests(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key, the second odd."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1] | np.uint64(1)


@dataclass
class Bloom:
    bits: int
    hashes: int
    level: int
    words: np.ndarray | None = None

    @classmethod
    def sized(cls, keys: int, rate: float, level: int) -> "Bloom":
        bits = max(64, math.ceil(-max(1, keys) * math.log(rate) / math.log(2) ** 2))
        return cls(-(-bits // 64) * 64, max(1, round(-math.log2(rate))), level)

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """The bit of each key by each hash function; levels have functions of their own."""
        a = mix64(a + np.uint64(self.level))
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for p in self.places(a, b):
            ok &= self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) == 1
        return ok

    def filled(self, keys: DataFrame) -> "Bloom":
        """With the keys of a table: tasks set bits of their own, Spark joins them by bitwise or."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    place = np.sort(np.concatenate(list(self.places(*digests(batch.column(0).to_pylist())))))
                    word, first = np.unique(place >> np.uint64(6), return_index=True)
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        rows = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(self.bits // 64, np.uint64)
        words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return Bloom(self.bits, self.hashes, self.level, words)


class Cascade:
    """Levels of Bloom filters; odd ones hold listed keys."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed."""
        listed, left = np.zeros(len(a), bool), np.arange(len(a))
        for i, level in enumerate(self.levels):
            ok = level.test(a[left], b[left])
            listed[left[~ok]] = i % 2 == 1
            left = left[ok]
        listed[left] = len(self.levels) % 2 == 1
        return listed

    @property
    def size(self) -> int:
        return sum(x.bits for x in self.levels) // 8


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.test(*digests(batch.column(0).to_pylist()))))

    return keys.select("key").mapInArrow(run, "key string")


def shard_of(key: str, shards: int) -> int:
    return zlib.crc32(key.encode()) % shards


def build(listed: DataFrame, universe: DataFrame, max_filter_bytes: int = 64 << 20) -> list[Cascade]:
    """The cascades of listed keys over a universe of distinct keys (both: column key), one for each shard of the keys."""
    listed = materialize(listed.select("key").distinct(), "url-listed")
    n, m = listed.count(), universe.count()
    rate = min(0.5, max(1e-9, n / (math.sqrt(2) * m))) if m else 0.5
    shards = max(1, -(-Bloom.sized(n, rate, 0).bits // 8 * 4 // max_filter_bytes))
    part = F.pmod(F.crc32("key"), F.lit(shards)).cast("int")
    listed = materialize(listed.withColumn("shard", part), "url-listed", "shard") if shards > 1 else listed.withColumn("shard", F.lit(0))
    others = materialize(universe.select("key").join(listed, "key", "left_anti").withColumn("shard", part), "url-others", "shard")
    return [_cascade(*(x.where(F.col("shard") == s).select("key") for x in (listed, others)), rate) for s in range(shards)]


def _cascade(listed: DataFrame, others: DataFrame, rate: float) -> Cascade:
    levels: list[Bloom] = []
    inside, outside, size = listed, others, listed.count()
    while True:
        level = Bloom.sized(size, 0.5 if levels else rate, len(levels)).filled(inside)
        levels.append(level)
        outside = materialize(_passing(outside, level), "url-passing")
        if not (size := outside.count()):
            return Cascade(levels)
        inside, outside = outside, inside


def host_and_path(url: str = "url") -> tuple:
    """Columns host and path of a url: empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Shape:
    """What keys lists can hold: the labels of the longest host, the lengths of paths."""

    labels: int
    paths: tuple[int, ...]

    @classmethod
    def of(cls, keys: list[tuple[str, str]]) -> "Shape":
        return cls(max((h.count(".") + 1 for h, _ in keys), default=0), tuple(sorted({len(p) for _, p in keys})))

    def with_all(self, other: "Shape") -> "Shape":
        return Shape(max(self.labels, other.labels), tuple(sorted({*self.paths, *other.paths})))

    def keys(self, host: str, path: str) -> list[str]:
        """All keys that a list of this shape could hold for a url, the longest first."""
        if not host:
            return []
        labels = host.split(".")
        suffixes = [".".join(labels[i:]) for i in range(max(0, len(labels) - self.labels), len(labels))]
        return sorted({s + path[:n] for s in suffixes for n in self.paths if n <= len(path)}, key=lambda k: (-len(k), k))


def _universe(urls: DataFrame, shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {k for h, p in set(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())) for k in shape.keys(h, p)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])

    return materialize(urls.select("host", "path").mapInArrow(run, "key string").distinct(), "url-universe")


def _listed_keys(listed: DataFrame) -> tuple[DataFrame, Shape]:
    """The keys of a table (host, path) of any size, and their shape. Hosts are lower-cased, paths begin with a slash; rows without a host are no keys."""
    host = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    path = F.coalesce("path", F.lit(""))
    path = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    rows = materialize(listed.where("host <> ''").select(F.concat(host, path).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length(path).alias("path")).distinct(), "url-list")
    found = rows.agg(F.max("labels").alias("labels"), F.collect_set("path").alias("paths")).first()
    return rows.select("key"), Shape(found["labels"] or 0, tuple(sorted(found["paths"])))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked_hosts: list[str] = BLOCKED_HOSTS, max_filter_bytes: int = 64 << 20, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of pages (page_id, url).

    The longest rule that fits a url gives its verdict. Where none fits, a url is
    blocked if its host or a parent domain is listed in blocked_hosts, or with a prefix
    of its path in the table listed (host, path; a null or empty path is the whole host),
    told by `listed`, and allowed otherwise; so are null urls and those without a host.
    Repeated rows give repeated results; further columns are not read. Rules are the
    list's (host, path, verdict), their keys distinct.
    """
    spark = pages.sparkSession
    host, path = host_and_path()
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    shape = Shape.of([*((h, p) for h, p, _ in rules), *((h, "") for h in blocked_hosts)])
    blocked = _keys(spark, blocked_hosts)
    if listed is not None:
        more, wider = _listed_keys(listed)
        blocked, shape = blocked.unionByName(more), shape.with_all(wider)
    lists = {ALLOW: _keys(spark, [h + p for h, p, v in rules if v == ALLOW]), BLOCK: _keys(spark, [h + p for h, p, v in rules if v == BLOCK]), "listed": blocked}
    universe = _universe(urls, shape)
    built = {name: build(keys, universe, max_filter_bytes) for name, keys in lists.items()}
    out = urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("listed"))
    for s in range(max(map(len, built.values()))):
        out = _judged(out, shape, {name: (len(c), c[s]) for name, c in built.items() if s < len(c)}, s)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), BLOCK).otherwise(ALLOW)))


def _judged(urls: DataFrame, shape: Shape, cascades: dict[str, tuple[int, Cascade]], shard: int) -> DataFrame:
    """urls (page_id, host, path, rule, verdict, listed) with what one shard of each list adds: a longer rule, or a listed key."""
    sent = urls.sparkSession.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(*(batch.column(c).to_pylist() for c in ("host", "path"))))
            of = {p: shape.keys(*p) for p in set(pairs)}
            keys = list({k: None for ks in of.values() for k in ks})
            a, b = digests(keys)
            hits = {}
            for name, (shards, cascade) in sent.value.items():
                own = np.flatnonzero(cascade.test(a, b)).tolist()
                hits[name] = {keys[i] for i in own if shards == 1 or shard_of(keys[i], shards) == shard}
            rules = hits.get(ALLOW, set()) | hits.get(BLOCK, set())
            told = {p: (next((k for k in ks if k in rules), None), any(k in hits.get("listed", ()) for k in ks)) for p, ks in of.items()}
            rule, verdict, listed = (batch.column(c).to_pylist() for c in ("rule", "verdict", "listed"))
            for i, p in enumerate(pairs):
                key, bad = told[p]
                listed[i] = listed[i] or bad
                if key is not None and (rule[i] is None or len(key) > len(rule[i])):
                    rule[i], verdict[i] = key, ALLOW if key in hits.get(ALLOW, ()) else BLOCK
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(listed, pa.bool_())], batch.schema.names)

    return urls.mapInArrow(run, urls.schema)


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
