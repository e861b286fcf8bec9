"""Mixing sources to target weights by hash thresholds.

Each row has a size (its words) and a hash. A source whose target is r times its size gives
floor(r) passes over all its rows and then the rows whose hash lies under a threshold. The
thresholds come from histograms: sizes are summed by source and hash bucket, the bucket in
which a source's rest runs out is refined by the next bits of the hash, and so on until the
boundary is one hash value. Nothing is sorted, thresholds of larger budgets hold the rows
of smaller ones, and the rows of the boundary hash give a part of their words, so a
source's taken words are its target rounded down.

What is defined: a null text has size 0; a null source is a source of its own, the last in
order; rows that are repeated, with id and text, share a hash and, at the boundary, the
rest in proportion to their sizes, rounded down; a source of size 0 has target 0; an empty
table gives an empty mix. Columns of the names size, source_size, target and taken are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot_apart, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and those that one level of the histogram tells apart.
BITS, LEVEL = 60, 10
_ROW = ["_source", "_size", "_hash"]


@dataclass(frozen=True)
class Mix:
    """weights are dealt to the sources by name in turn; share is the mix's size over that of all rows; no source gives more than `most` times its size."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2


def measured(docs: DataFrame) -> DataFrame:
    """docs with a source key that is never null, the number of words, and a hash of id and text of BITS bits."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text))
    return docs.withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")),  # null is last in order
        "_size": F.regexp_count(text, F.lit(WORD)).cast("bigint"),
        "_hash": F.conv(F.substr(digest, F.lit(1), F.lit(BITS // 4)), 16, 10).cast("bigint"),
    })


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in the order of names: their place in a sorted partition, and the sizes of the partitions before."""
    at = F.monotonically_increasing_id()
    rows = materialize(sources.orderBy("_source").withColumn("_at", at), "mix-sources")
    rows = rows.withColumns({"_part": F.expr("shiftright(_at, 33)"), "_in": F.expr("_at & 8589934591")})
    counts = rows.groupBy("_part").count()  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").select(*sources.columns, (F.col("_before") + F.col("_in")).alias("_rank"))


def targets(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(_source, n, source_size, target) of measured rows. The excess over a source's limit is shared out by weight among the others until none is above."""
    sources = rows.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_size").alias("source_size"))
    weight = F.get(F.array(*map(F.lit, mix.weights)), (F.col("_rank") % len(mix.weights)).cast("int"))
    told = materialize(_ranked(sources).withColumns({"_w": weight, "_cap": mix.most * F.col("source_size")}).drop("_rank"), "mix-weights")
    total = told.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # ends, as the level only rises and sources are only added to those at their limit
        above = (F.col("_w") * level > F.col("_cap")) if capped >= 0 else F.lit(False)
        one = told.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~above, F.col("_w"))).alias("w")).first()
        if one.n == capped or not one.w:
            break
        capped, level = one.n, (mix.share * total - one.cap) / one.w
    share = F.col("_w") * F.lit(float(level))
    return told.select("_source", "n", "source_size", F.when(share > F.col("_cap"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def thresholds(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row for each source of measured rows: what targets gives, passes over all rows, and the hashes from _lo to under _hi whose rows of _tie words share the last _part words."""
    told = targets(rows, mix)
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    told = materialize(told.withColumn("_passes", passes).withColumn("_rest", F.floor("target") - F.col("_passes") * size), "mix-targets")
    total = told.agg(F.sum("n")).first()[0] or 0
    many = F.col("n").alias("_many")
    open_, live, done = told.where("_rest > 0").select("_source", "n", many, "_rest"), rows.select(*_ROW), []
    none = "cast(null as struct<_bucket: bigint, _s: bigint, _least: bigint, _most: bigint>)"
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        bucket = F.shiftright("_hash", shift)
        sums = live.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_s"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
        parts = join_hot_apart(sums, open_, ["_source"], "n", total)
        buckets = F.array_sort(F.collect_list(F.struct("_bucket", "_s", "_least", "_most")))  # at most 2 ** LEVEL
        walk = F.aggregate(  # the words before the boundary bucket, and that bucket
            "_b",
            F.struct(F.lit(0).cast("bigint").alias("below"), F.expr(none).alias("at")),
            lambda a, b: F.when(a["at"].isNotNull(), a).when(a["below"] + b["_s"] <= F.col("_rest"), F.struct((a["below"] + b["_s"]).alias("below"), a["at"].alias("at"))).otherwise(F.struct(a["below"].alias("below"), b.alias("at"))),
        )
        edge = parts.groupBy("_source", "_many", "_rest").agg(buckets.alias("_b")).select("_source", "_many", "_rest", walk.alias("_e"))
        edge = materialize(edge.select("_source", "_many", (F.col("_rest") - F.col("_e.below")).alias("_part"), "_e.at.*"), "mix-edge")
        one = F.col("_least") == F.col("_most")
        done.append(edge.where(one).select("_source", F.col("_least").alias("_lo"), (F.col("_most") + 1).alias("_hi"), F.col("_s").alias("_tie"), "_part"))
        more = edge.where(~one)
        if more.isEmpty():
            break
        # only the rows of the boundary buckets are looked at again
        open_ = more.select("_source", F.col("_many").alias("n"), "_many", F.col("_part").alias("_rest"))
        live = materialize(join_hot_apart(live, more.select("_source", F.col("_many").alias("n"), F.col("_bucket").alias("_at")), ["_source"], "n", total).where(bucket == F.col("_at")).select(*_ROW), "mix-boundary")
    edges = done[0]
    for x in done[1:]:
        edges = edges.unionByName(x)
    zero = F.lit(0).cast("bigint")
    return told.join(edges, "_source", "left").select("_source", "n", "source_size", "target", "_passes", *(F.coalesce(c, zero).alias(c) for c in ("_lo", "_hi", "_tie", "_part")))


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Measured rows with size, source_size, target and taken: the words that the mix takes of a row, repeats counted."""
    total = plan.agg(F.sum("n")).first()[0] or 0
    clash = [c for c in rows.columns if c.lower() in ("size", "source_size", "target", "taken", "n", "_passes", "_lo", "_hi", "_tie", "_part")]
    df = join_hot_apart(rows.drop(*clash), plan, ["_source"], "n", total)
    last = F.when(F.col("_hash") < F.col("_lo"), F.col("_size")).when(F.col("_hash") < F.col("_hi"), F.expr("_size * _part div _tie")).otherwise(0)
    return df.withColumns({"size": F.col("_size"), "taken": F.col("_passes") * F.col("_size") + last}).drop(*_ROW, "_passes", "_lo", "_hi", "_tie", "_part")


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: docs' rows once for each time they are taken, with a column copy; a last part has the first words only, put together by spaces."""
    rows = measured(docs)
    taken = take(rows, thresholds(materialize(rows.select(*_ROW), "mix-rows"), mix))
    size, n = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.expr("taken div size")).otherwise(0)
    left = n - whole * size
    out = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest((whole + F.when(left > 0, 1).otherwise(0)).cast("int"), F.lit(1))))).where(n > 0)
    cut: Column = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    return out.withColumn("text", F.when(F.col("copy") > whole, cut).otherwise(F.col("text"))).select(*docs.columns, "copy")


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row. Texts are read once."""
    rows = materialize(measured(docs).select("doc_id", *_ROW), "mix-rows")
    plan = materialize(thresholds(rows, mix), "mix-plan")
    return take(rows, plan).select("doc_id", "size", "source_size", "target", "taken")
