"""Tries of conversations that begin alike.

A turn is told by a digest of its role and text, a conversation by the digests of its turns
after one another (its path). Equal paths are counted first. The distinct ones are dealt
into buckets by the digest of their first turn, and each bucket's subtries are built as
dictionaries of pointers inside applyInPandas; numbers of subtrees are summed by going
through the nodes from the last to the first, as children are made after their parents. A
first turn whose conversations hold more turns than a bucket should is dealt by the next
turn instead, and so on down; the nodes above such a cut are put together from the tops of
the subtries below it.

The ids of the conversations that end at a node are hashed as a stream, in order, so a path
that very many share needs no memory, though one task.

What is defined: rows without a conv_id take no part; null roles and texts are empty; turns
are ordered by number, null first, and equal numbers by the digest of role and text;
repeated rows are turns of their own; an empty table gives no nodes. A conversation's
digests, 20 bytes a turn, must fit in a task; its texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

#: Turns that a bucket of subtries is meant to hold, and more than which a first turn's conversations are dealt by the next.
BUCKET_TURNS = 50_000
#: Smaller tables have buckets of their turns over the number of partitions, but of this many at least.
LEAST_TURNS = 1_000
_D = 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (turn, digest, n) with the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct("turn", digest.alias("digest"), F.length(text).alias("n"))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def with_shared_heads(turns: DataFrame, base: Column, most: Column, limit: int) -> DataFrame:
    """Conversations that begin with the first `most` (at most `limit`) turns of another one, and go on with their own turns after as many."""
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, limit).alias("_head"))
    df = turns.withColumns({"_base": base, "_h": most.cast("int")}).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), F.col("_h"))
    return df.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of rows that are sorted by key and id: their number, the least id, and the hash of all ids."""
    names = ["key", "n", "conv_id", "ends"]
    key, n, least, hashed = None, 0, 0, hashlib.sha256()

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names)

    for batch in batches:
        out = []
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, i in zip(keys, ids):
            if k != key:
                if key is not None:
                    out.append((key, n, least, hashed.hexdigest()))
                key, n, least, hashed = k, 0, i, hashlib.sha256()
            hashed.update(f"{',' if n else ''}{i}".encode())
            n += 1
        yield told(out)
    if key is not None:
        yield told([(key, n, least, hashed.hexdigest())])


def _paths(turns: DataFrame) -> DataFrame:
    """(path, lens, n, conv_id, ends) of distinct paths: how many conversations take it, the least of them, and the hash of their ids."""
    df = turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"), F.col("turns.n").alias("lens"))
    df = materialize(df.withColumn("key", F.md5("path")), "conversation-paths")
    ends = df.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key string, n long, conv_id long, ends string")
    seen = df.groupBy("key").agg(F.first("path").alias("path"), F.first("lens").alias("lens"))
    return materialize(seen.join(ends, "key").drop("key"), "distinct-paths")


class _Trie:
    """Nodes as lists of fields; pointers go by (parent, digest)."""

    def __init__(self):
        self.child: dict[tuple[int, bytes], int] = {}
        self.depth, self.parent, self.conv, self.n, self.len, self.ends, self.top = [], [], [], [], [], [], []

    def step(self, parent: int, digest: bytes, depth: int, length: int, conv: int, n: int, top: bytes | None) -> int:
        at = self.child.get((parent, digest))
        if at is None:
            at = self.child[parent, digest] = len(self.n)
            for field, value in zip((self.depth, self.parent, self.conv, self.n, self.len, self.ends, self.top), (depth, parent, conv, n, length, None, top)):
                field.append(value)
        else:
            self.n[at] += n
            self.conv[at] = min(self.conv[at], conv)
        return at

    def add(self, cut: int, path: bytes, lens, n: int, conv: int, ends: str) -> None:
        at = self.step(-1, path[: cut * _D], cut, int(lens[cut - 1]), conv, n, path[: cut * _D])
        for d in range(cut, len(path) // _D):
            at = self.step(at, path[d * _D : (d + 1) * _D], d + 1, int(lens[d]), conv, n, None)
        self.ends[at] = ends

    def nodes(self) -> pd.DataFrame:
        children, leaves, saved = [0] * len(self.n), [0] * len(self.n), [0] * len(self.n)
        for at in range(len(self.n) - 1, -1, -1):  # children come after their parents
            leaves[at] = leaves[at] or 1
            saved[at] += (self.n[at] - 1) * self.len[at]
            up = self.parent[at]
            if up >= 0:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
        none = hashlib.sha256().hexdigest()
        return pd.DataFrame({
            "conv_id": self.conv, "depth": self.depth, "parent_conv_id": pd.array([self.conv[p] if p >= 0 else None for p in self.parent], "Int64"), "n_convs": self.n, "n_children": children,
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [e or none for e in self.ends], "top": self.top,
        })


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = _Trie()
    for row in pdf.itertuples(index=False):
        trie.add(row.cut, row.path, row.lens, row.n, row.conv_id, row.ends)
    return trie.nodes()


def _prefix(cut: int, column: str = "path") -> Column:
    return F.substr(F.col(column), F.lit(1), F.lit(cut * _D))


def trie(turns: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """A row for each node (NODE) of the trie of conversations (conv_id, turns)."""
    spark = turns.sparkSession
    paths = _paths(turns)
    length = F.length("path")
    total, n_convs, least, at_root = paths.agg(F.sum(length) / _D, F.sum("n"), F.min("conv_id"), F.max(F.when(length == 0, F.col("ends")))).first()
    if n_convs is None:
        return spark.createDataFrame([], NODE)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_turns = min(bucket_turns, max(LEAST_TURNS, int(total) // partitions))
    live, parts, cuts, cut = paths.where(length > 0), [], [], 1
    while True:
        # what a subtrie below this cut holds; a path that many share was counted once
        here = live.groupBy(_prefix(cut).alias("prefix")).agg(F.sum(length / _D - (cut - 1)).alias("weight"), F.count("*").alias("paths"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first(F.get("lens", F.lit(cut - 1))).alias("len"), F.max(F.when(length == cut * _D, F.col("ends"))).alias("ends"))
        big = materialize(here.where((F.col("weight") > bucket_turns) & (F.col("paths") > 1)).drop("weight", "paths"), "oversized")
        n_big = big.count()
        some = broadcast_if(big.select(F.col("prefix").alias("_p")), n_big, 64 + cut * _D)
        parts.append((live.join(some, _prefix(cut) == F.col("_p"), "left_anti") if n_big else live).withColumn("cut", F.lit(cut)))
        if not n_big:
            break
        cuts.append((cut, n_big, big))
        live = materialize(live.join(some, _prefix(cut) == F.col("_p"), "left_semi").where(length > cut * _D), "dealt-by-the-next-turn")
        cut += 1
    dealt = parts[0]
    for p in parts[1:]:
        dealt = dealt.unionByName(p)
    buckets = max(partitions, -(-int(total) // bucket_turns))
    first = F.substr(F.col("path"), F.lit(1), F.col("cut") * _D)
    nodes = dealt.withColumn("bucket", F.pmod(F.xxhash64(first), F.lit(buckets)).cast("int")).groupBy("bucket").applyInPandas(_built, f"{NODE}, top binary")
    nodes = materialize(nodes, "subtries")
    if not cuts:
        top = nodes.where("top is not null")
        done = [_root(spark, top, n_convs, least, at_root), nodes.withColumn("parent_conv_id", F.when(F.col("top").isNotNull(), F.lit(least)).otherwise(F.col("parent_conv_id"))).drop("top")]
        return done[0].unionByName(done[1])
    return _above(spark, nodes, cuts, n_convs, least, at_root)


def _root(spark, kids: DataFrame, n_convs: int, least: int, ends: str | None) -> DataFrame:
    one = kids.agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    return one.select(F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(ends or hashlib.sha256().hexdigest()).alias("ends_sha256"))


def _above(spark, nodes: DataFrame, cuts: list[tuple[int, int, DataFrame]], n_convs: int, least: int, at_root: str | None) -> DataFrame:
    """All nodes, where some stand above a cut: those are summed from their children, the deepest first."""
    out = [nodes.where("top is null").drop("top")]
    kids = nodes.where("top is not null")
    below = None  # nodes of the cut below, finished
    for cut, n_big, big in reversed(cuts):
        own = kids.where(F.col("depth") == cut + 1)
        if below is not None:
            own = own.unionByName(below)
        up = F.broadcast(big.select(F.col("prefix").alias("_p"), F.col("conv_id").alias("_up"))) if n_big <= 10_000 else big.select(F.col("prefix").alias("_p"), F.col("conv_id").alias("_up"))
        own = own.withColumn("_p", _prefix(cut, "top"))
        out.append(own.join(up, "_p").withColumn("parent_conv_id", F.col("_up")).drop("_p", "_up", "top"))
        sums = own.groupBy("_p").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("s"))
        below = materialize(
            big.join(sums, big.prefix == sums["_p"]).select(
                "conv_id", F.lit(cut).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                (F.col("s") + (F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.col("prefix").alias("top"),
            ), "above-a-cut",
        )
    own = kids.where(F.col("depth") == 1).unionByName(below)
    out += [own.withColumn("parent_conv_id", F.lit(least).cast("long")).drop("top"), _root(spark, own, n_convs, least, at_root)]
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done
