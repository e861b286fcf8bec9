"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at a Hamming distance of at most 3. Every fingerprint emits all
variants within half that radius and meets others on them. The ball is laid out in
two halves of 32 bits, since of 3 differing bits one half holds at most one:

1. each distinct fingerprint emits, for either half, the half itself (a centre) and
   its 32 variants at distance one; only keys on which a centre meets another
   fingerprint stay active;
2. on active keys the other half emits its ball of radius 2 from centres and itself
   from variants. Members at a total distance of at most 1 from the meeting point are
   within 3 of every member at a total distance of at most 2, so a meeting point links
   all of its members to the smallest near one: a star, never all pairs. Any two
   fingerprints within 3 meet like that. A point has at most 2,081 members, whatever
   the input;
3. star edges are made distinct, verified by their real distance, and joined to
   components by alternating large and small stars.

A plain ball of the whole 64 bits would emit 2,081 rows for each fingerprint. Here it is 66
where halves rarely meet, and at most 66 + 2 * 529 once a corpus fills the 32 bits of a
half, as each centre then emits its ball: a constant, whatever the input.

Fingerprints and components that hold more than a thousandth of all rows are joined by
broadcast, so that no task gets all copies of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, join_hot_apart, materialize, release, slices

RADIUS = 3


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts; without words: zero."""
    digest, space = xxhash.xxh64_digest, b" ".join
    found: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if not words:
            continue
        shingles = zip(words, words[1:], words[2:]) if len(words) >= 3 else [words]
        before = len(found)
        found += [digest(space(s), 42) for s in shingles]
        counts[i] = len(found) - before
    out = np.zeros(len(texts), np.uint64)
    rows = np.flatnonzero(counts)
    if len(rows):
        bits = np.unpackbits(np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8), axis=1)
        ends = np.cumsum(counts[rows])
        for i, a, b in zip(rows, ends - counts[rows], ends):
            ones = bits[a:b].sum(0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > b - a).view(">u8")[0]
    return out


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash of every row. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                fps = fingerprints_of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64)), part.column("text_hash")], ["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _masks() -> list[int]:
    """All 32-bit masks of weight 0, 1 and 2, in this order: 1, 32 and 496."""
    bits = [1 << i for i in range(32)]
    return [0, *bits, *(a | b for a, b in combinations(bits, 2))]


def links(fps: DataFrame) -> DataFrame:
    """Star edges (u, v) that connect exactly the distinct fingerprints in column fp that chains of links connect."""
    low = F.lit(0xFFFFFFFF)
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low)
    half = lambda tag, key, rest: F.struct((key + F.lit(tag << 32)).alias("key"), rest.alias("rest"))
    centres = fps.select("fp", F.explode(F.array(half(0, hi, lo), half(1, lo, hi))).alias("m")).select("fp", "m.key", "m.rest")
    flips = F.expr(f"array({', '.join(f'{1 << i}L' for i in range(32))})")
    around = centres.select("fp", "key", "rest", F.explode(flips).alias("flip")).select("fp", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "rest")
    keys = centres.groupBy("key").agg(F.count("*").alias("n"))
    met = materialize(around.join(keys.select("key").hint("shuffle_hash"), "key", "left_semi"), "simhash-met")
    active = met.select("key").union(keys.where("n > 1").select("key")).distinct()
    own = centres.join(active, "key", "left_semi")

    ball = F.posexplode(F.expr(f"array({', '.join(f'{m}L' for m in _masks())})"))
    far = F.when(F.col("pos") == 0, 0).when(F.col("pos") <= 32, 1).otherwise(2)
    points = (
        own.select("fp", "key", "rest", ball.alias("pos", "mask"))
        .select("fp", "key", F.col("rest").bitwiseXOR(F.col("mask")).alias("point"), far.alias("far"))
        .unionByName(met.select("fp", "key", F.col("rest").alias("point"), F.lit(1).alias("far")))
    )
    here = Window.partitionBy("key", "point")
    near = F.min(F.when(F.col("far") <= 1, F.col("fp"))).over(here)
    pairs = points.select("fp", near.alias("hub")).where("hub is not null and hub <> fp").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS).select(F.col("fp").alias("u"), F.col("hub").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected edges (u, v): root is the smallest node reachable.

    Alternating large and small stars; each round is a few shuffles of the edges, and
    the rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    told = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc-large")
        release(edges, low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "cc-edges")
        release(large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        told = now


def _classes(seen: DataFrame) -> DataFrame:
    """(fp, n, component_id, best) of each fingerprint of rows (doc_id, fp, text_hash): n rows have it; component_id is the smallest doc_id reachable over links; best tells the row that stands for all reachable ones, by doc_id (null last), then text_hash."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    groups = materialize(seen.groupBy("fp").agg(F.count("*").alias("n"), F.min(rank).alias("best")), "simhash-groups")
    roots = components(links(groups.select("fp")))
    rooted = materialize(groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "best", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = materialize(rooted.groupBy("root").agg(F.count("*").alias("fps"), F.min("best").alias("best")), "simhash-named")
    classes = join_hot_apart(rooted.drop("best"), named, ["root"], "fps", groups.count())
    return materialize(classes.select("fp", "n", F.col("best.doc_id").alias("component_id"), "best"), "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of every row.

    Null or wordless texts have fingerprint zero and link like any other. Repeated
    rows give repeated results. A null doc_id takes part in links but names no
    component unless nothing else does.
    """
    seen = materialize(fingerprint_table(docs), "simhash-fp")
    return join_hot_apart(seen, _classes(seen).drop("best"), ["fp"], "n", seen.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, less all rows of a near-duplicate group but one: that of the smallest doc_id.

    Rows are told apart by doc_id and text, so rows that share an id with other texts are
    documents of their own. A null doc_id counts as the largest. Of rows that agree in
    both and stand for their group, one stays, chosen by a hash of all columns.
    """
    seen = materialize(fingerprint_table(docs), "simhash-fp")
    told = join_hot_apart(seen, _classes(seen), ["fp"], "n", seen.count())
    stays = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").eqNullSafe(F.col("best"))
    ids = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_text")]
    counts = materialize(told.groupBy(*ids).agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "simhash-gone")
    gone, names = counts.where("not stays").select("_id", "_none", "_text"), docs.columns
    own = docs.toDF(*(f"k{i}" for i in range(len(names))))
    at = {c: f"k{i}" for i, c in enumerate(names)}
    own = own.withColumns({"_id": F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(0)), "_none": F.col(at["doc_id"]).isNull(), "_text": F.xxhash64(F.coalesce(at["text"], F.lit("")))})
    by = ["_id", "_none", "_text"]
    kept = own.join(broadcast_if(gone, gone.count(), 24), by, "left_anti")
    twice = counts.where("stays").select(*by)
    if not twice.isEmpty():
        twice = broadcast_if(twice, twice.count(), 24)
        columns = list(at.values())
        one = kept.join(twice, by, "left_semi").groupBy(*by).agg(F.min_by(F.struct(*columns), F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in own.schema[c].dataType.simpleString() else F.col(c) for c in columns))).alias("one")).select("one.*")
        kept = kept.join(twice, by, "left_anti").select(*columns).unionByName(one)
    return kept.select(*at.values()).toDF(*names)
