"""Hard negatives by a table of pivot distances.

Inner products become distances by one more component: with M the greatest squared norm, a
row x becomes (x, sqrt(M - x.x)) and an anchor a becomes (a, 0), so their squared distance is
M + a.a - 2 a.x. Distances of every row to a few pivots are stored; by the triangle
inequality those of an anchor and a row to the same pivots bracket the distance between
them, and so the score. Rows lie in blocks by nearest pivot; blocks whose bracket can't
reach what an anchor looks for are not paired with its block, rows of paired blocks are
told apart by their own brackets, and what is left is scored exactly.

Every anchor is compared with all rows, in blocks: anchors go to groups of about a million
rows each, where a block of anchors and one of rows meet at a time. A task keeps the best
few of each anchor before they are shuffled. Nothing is left out: brackets are widened by
more than rounding can move them.

What is defined: rows with a null id, label, vector or component, or a component that isn't
finite, take no part; vectors of unequal length are filled up with zeros; rows with an
anchor's id are never its partners, and of several anchors with one id the first by label
and vector counts; other rows that are repeated count as often as they occur. Squared norms
of 2 ** 46 and more raise, as scores would not be exact. Tables without anchors or of one
label give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Pivots, the rows that they are chosen from, and rows in a block.
PIVOTS, SAMPLE, BLOCK = 16, 2_000, 1_024
#: Blocks of rows in a group that every anchor is sent to once.
GROUP = 1_024
_SIZES = {"ids": "i8", "labels": "i8", "norms": "f8", "dists": "f4"}


def whole_components(vector: str = "embedding", factor: int = 256) -> Column:
    """floor(factor * x) of each component as a double; null where any component is null or not finite."""
    v = F.transform(vector, lambda x: F.floor(factor * x.cast("double")).cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, v)


def _padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Pivots:
    """Some rows of the table, far from each other, as points of the augmented space."""

    def __init__(self, points: np.ndarray, top: float):
        self.top = top
        lift = np.sqrt(np.maximum(top - (points**2).sum(1), 0))
        near = np.full(len(points), np.inf)
        chosen: list[int] = []
        while len(points) and len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(near.argmax()))
            c = chosen[-1]
            near = np.minimum(near, ((points - points[c]) ** 2).sum(1) + (lift - lift[c]) ** 2)
        self.points, self.lift = points[chosen], lift[chosen]

    def distances(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        square = (x**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T + (lift[:, None] - self.lift) ** 2
        return np.sqrt(np.maximum(square, 0)).astype(np.float32)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x, np.sqrt(np.maximum(self.top - (x**2).sum(1), 0)))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x, np.zeros(len(x)))


def _packed(rows: DataFrame, pivots: Pivots, dim: int, block: int, prepare) -> DataFrame:
    """Rows after one another in blocks of at most `block`; prepare(batch as columns, vectors) gives a block's distances and further fields."""
    names = ["ids", "labels", "vecs", "norms", "dists", "low", "high", "radius", "extra"]
    schema = "ids binary, labels binary, vecs binary, norms binary, dists binary, low array<double>, high array<double>, radius double, extra binary"
    kinds = [*[pa.binary()] * 5, *[pa.list_(pa.float64())] * 2, pa.float64(), pa.binary()]

    def one(rows: pa.Table) -> pa.RecordBatch:
        x = _padded(rows.column("vec").to_pylist(), dim)
        ids, labels = (np.ascontiguousarray(rows.column(c).to_numpy(), np.int64) for c in ("vec_id", "label"))
        dists, radius, extra = prepare(rows, x, ids, labels)
        row = [ids, labels, x, (x**2).sum(1), dists]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*(np.ascontiguousarray(r).tobytes() for r in row), dists.min(0).astype(float), dists.max(0).astype(float), radius, extra.tobytes()], kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                whole = pa.Table.from_batches(held)
                yield one(whole.slice(0, block))
                held = whole.slice(block).to_batches()
        if sum(b.num_rows for b in held):
            yield one(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def _read(row: dict, prefix: str, dim: int) -> dict[str, np.ndarray]:
    out = {k: np.frombuffer(row[prefix + k], kind) for k, kind in _SIZES.items()}
    n = len(out["ids"])
    return out | {"vecs": np.frombuffer(row[prefix + "vecs"]).reshape(n, dim), "dists": out["dists"].reshape(n, -1), "extra": np.frombuffer(row[prefix + "extra"]).reshape(n, -1) if row[prefix + "extra"] else np.zeros((n, 0))}


def scores(a: dict, r: dict, top: float, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of anchors and rows, and which of them brackets leave between least and most of each anchor; others are 0."""
    shape = len(a["ids"]), len(r["ids"])
    near, far = np.zeros(shape, np.float32), np.full(shape, np.inf, np.float32)
    for p in range(a["dists"].shape[1]):
        da, dr = a["dists"][:, p, None], r["dists"][None, :, p]
        np.maximum(near, np.abs(da - dr), out=near)
        np.minimum(far, da + dr, out=far)
    both = (top + a["norms"])[:, None]
    slack = 1 + 4e-6 * both  # single precision moves a squared distance by less
    left = ((both - near.astype(float) ** 2) / 2 + slack >= least[:, None]) & ((both - far.astype(float) ** 2) / 2 - slack <= most[:, None])
    out, i, j = np.zeros(shape), np.flatnonzero(left.any(1)), np.flatnonzero(left.any(0))
    if len(i) and len(j):
        out[np.ix_(i, j)] = a["vecs"][i] @ r["vecs"][j].T
    return out, left


def _best(s: np.ndarray, fits: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors' and rows' places of the n best that fit, of each anchor, by score, ties by id."""
    i, j = np.nonzero(fits)
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < n], j[rank < n]


def _pairs(anchors: DataFrame, blocks: DataFrame, groups: int, small: bool) -> DataFrame:
    """Blocks of anchors beside blocks of rows that their brackets don't rule out."""
    to = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *(F.col(c).alias(f"a_{c}") for c in anchors.columns))
    apart = F.zip_with(F.zip_with("low", "a_high", lambda x, y: x - y), F.zip_with("a_low", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    meet = blocks.join(F.broadcast(to) if small else to.hint("merge"), "group")
    return meet.where(~F.exists(apart, lambda gap: gap > F.col("a_radius"))).drop("group", "low", "high", "radius", "a_low", "a_high", "a_radius")


def _found(pairs: DataFrame, schema: str, one) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in one(row)], names)

    return pairs.mapInArrow(run, schema)


def _first(found: DataFrame, by: list[str], score: str, partner: str, n: int, rank: str) -> DataFrame:
    """The n best of each group; Spark keeps no more of it in any task before the shuffle."""
    from pyspark.sql import Window

    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), partner))).where(F.col(rank) <= n)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, vec) of whole components.

    An anchor's positives are its n_positives best rows of the same label; for each, the
    n_negatives best rows of other labels whose score is at most the positive's and at
    least least_percent of it.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("vec").cast("array<double>").alias("vec"), anchor.alias("anchor")).where("vec_id is not null and label is not null and vec is not null")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    all_ = rows.agg(F.max(norm).alias("top"), F.max(F.size("vec")).alias("dim"), F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    top, dim = float(all_.top or 0), max(int(all_.dim or 0), 1)
    if top >= 2.0**46:
        raise ValueError("a squared norm is 2 ** 46 or more; scores would not be exact")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "vec").collect()
    seen, seen_ids, seen_labels = _padded([r.vec for r in some], dim), np.array([r.vec_id for r in some], np.int64), np.array([r.label for r in some], np.int64)
    pivots = Pivots(seen, top)

    def of_rows(t: pa.Table, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        return pivots.of_rows(x), 0.0, np.zeros(0)

    def radius(x: np.ndarray, least: np.ndarray) -> float:
        """The greatest distance at which a row of a score of at least `least` can lie."""
        square = top + (x**2).sum(1) - 2 * least
        return float(np.sqrt(np.maximum(square, 0) + 4e-6 * (top + (x**2).sum(1)) + 1).max(initial=-1.0)) + 1e-3

    def of_anchors(t: pa.Table, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """What the rows of the sample already reach bounds the positives from below."""
        s = np.where((labels[:, None] == seen_labels) & (ids[:, None] != seen_ids), x @ seen.T, -np.inf)
        least = np.sort(s, 1)[:, -n_positives] if s.shape[1] >= n_positives else np.full(len(x), -np.inf)
        return pivots.of_anchors(x), radius(x, least), least

    def of_pairs(t: pa.Table, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """Ids and scores of an anchor's positives, filled up with those that nothing reaches."""
        extra = np.full((len(x), 2, n_positives), -1.0)
        for i, p in enumerate(t.column("positives").to_pylist()):
            extra[i, 1, : len(p)] = [q["score"] for q in p]
        worst = np.where(extra[:, 1] >= 0, extra[:, 1], np.inf).min(1) * least_percent / 100
        return pivots.of_anchors(x), radius(x[np.isfinite(worst)], worst[np.isfinite(worst)]), extra

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.of_rows(_padded(b.column("vec").to_pylist(), dim)) if b.num_rows else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1).astype(float))], [*b.schema.names, "cell", "ring"])

    n_blocks = -(-max(all_.n, 1) // block)
    groups = max(16, -(-n_blocks // GROUP))
    dealt = max(1, min(n_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10_000))
    near = rows.drop("anchor").mapInArrow(cells, "vec_id long, label long, vec array<double>, cell int, ring double").repartitionByRange(dealt, "cell", "ring", "vec_id").sortWithinPartitions("cell", "ring", "vec_id")
    blocks = _packed(near, pivots, dim, block, of_rows)
    blocks = materialize(blocks.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")), "pivot-table")
    asked = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("v")).select("vec_id", "v.*")
    asked = materialize(asked.mapInArrow(cells, "vec_id long, label long, vec array<double>, cell int, ring double"), "anchors")
    small = all_.anchors * (dim * 8 + PIVOTS * 4 + 100) * groups <= 32 << 20
    in_order = lambda df: df.repartitionByRange(max(1, -(-all_.anchors // block)), "cell", "ring", "vec_id").sortWithinPartitions("cell", "ring", "vec_id").drop("cell", "ring")

    def positives(row: dict) -> list[np.ndarray]:
        a, r = _read(row, "a_", dim), _read(row, "", dim)
        least = a["extra"][:, 0]
        s, left = scores(a, r, top, least, np.full(len(least), np.inf))
        fits = left & (s >= least[:, None]) & (a["labels"][:, None] == r["labels"]) & (a["ids"][:, None] != r["ids"])
        i, j = _best(s, fits, r["ids"], n_positives)
        return [a["ids"][i], r["ids"][j], s[i, j].astype(np.int64)]

    def negatives(row: dict) -> list[np.ndarray]:
        a, r = _read(row, "a_", dim), _read(row, "", dim)
        wanted = a["extra"].reshape(len(a["ids"]), 2, -1)[:, 1]
        none = wanted < 0  # below 0, no score lies between 80 % of it and itself
        least = np.where(none, np.inf, wanted * least_percent / 100).min(1)
        s, left = scores(a, r, top, least, np.where(none, -np.inf, wanted).max(1))
        left &= (a["labels"][:, None] != r["labels"]) & (a["ids"][:, None] != r["ids"])
        out = []
        for k in range(wanted.shape[1]):
            p = wanted[:, k, None]
            i, j = _best(s, left & (p >= 0) & (s <= p) & (100 * s >= least_percent * p), r["ids"], n_negatives)
            out.append((a["ids"][i], np.full(len(i), k + 1), r["ids"][j], s[i, j].astype(np.int64)))
        return [np.concatenate(c) for c in zip(*out)]

    first = _packed(in_order(asked), pivots, dim, block, of_anchors)
    pos = _found(_pairs(first, blocks, groups, small), "anchor_id long, positive_id long, positive_score long", positives)
    pos = materialize(_first(pos, ["anchor_id"], "positive_score", "positive_id", n_positives, "k"), "positives")
    lists = pos.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("positive_score").alias("score")))).alias("positives"))
    second = asked.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    neg = _found(_pairs(_packed(in_order(second), pivots, dim, block, of_pairs), blocks, groups, small), "anchor_id long, k long, negative_id long, negative_score long", negatives)
    neg = _first(neg, ["anchor_id", "k"], "negative_score", "negative_id", n_negatives, "rank")
    return neg.join(pos.withColumn("k", F.col("k").cast("bigint")), ["anchor_id", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
