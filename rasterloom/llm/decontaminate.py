"""Benchmark decontamination: size-partitioned MinHash containment search.

Short items are sought inside long documents. Resemblance of an item and a whole
document says nothing then, so items are partitioned by size into powers of two and
each document is laid out, for each size, in windows of twice the size that advance by
the size. An item that stands in a document lies in a window of at most twice the
class's size, which bounds its Jaccard similarity with the window from below:
containment t of q shingles in a window of w gives t*q / (w + q - t*q), at least 0.17
for t = 0.8. Any of `slots` minima that a window and an item share makes the pair a
candidate, over all windows of the document, which is then verified by the exact
containment of the item's five-word shingles in the whole document.

Items of fewer than eight shingles would share too little with such a window. They are
looked up by shingle hashes instead, without any miss: where at most m shingles may be
lacking, one of any m + 1 shingles of the item stands in the document. Those that the
fewest items hold are taken. Items of one to four words are one shingle of all their words,
looked up alike: a document holds it or not.

Words are runs of characters other than ASCII signs and white space, lower-cased.
Shingle hashes of a batch are computed at once, from the prefix sums of a polynomial.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, mix64, release, slices

WIDTH = 5
MATCHES = "doc_id long, item_id long, containment double, n_shared long, n_shingles long"
#: Bytes that end words become spaces.
_TABLE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
_MOST = 1 << 12
#: Items of fewer shingles are looked up by hash.
_SHORT = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TABLE).split()


def shingles_of(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """Distinct shingles of width words; a text of fewer words has none."""
    w = words_of(text)
    return set(zip(*(w[i:] for i in range(width))))


def item_shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """Distinct shingles of an item: of five words, or of all if there are fewer."""
    return shingles_of(text, min(WIDTH, len(words_of(text)))) if words_of(text) else set()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the row of each."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(parts).translate(_TABLE) + b" ", np.uint8)
    inside = np.concatenate([[False], data != 32])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    words = mix64((sums[ends] - sums[starts]) * inverse[starts])
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return words, np.searchsorted(first, starts, "right") - 1


def hashed_shingles(words: np.ndarray, row: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of width words, and the row of each."""
    n = max(0, len(words) - width + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = words[:n] * _MIX[0] + np.uint64(width)
    for k in range(1, width):
        total += words[k : n + k] * _MIX[k]
    whole = row[:n] == row[width - 1 :]
    return mix64(total[whole]), row[:n][whole]


def slot_seeds(slots: int, seed: int = 42) -> np.ndarray:
    return mix64(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(seed) * _BASE)


def _slot(hashes: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (hashes ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_minima(hashes: np.ndarray, rows: np.ndarray, classes: list[int], seeds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, slot, row of each window, minimum in each window) of rows laid out in the windows of each class."""
    least = min(classes)
    docs, first = np.unique(rows, return_index=True)
    inside = np.arange(len(rows)) - np.repeat(first, np.diff([*first, len(rows)]))
    starts = np.flatnonzero(inside % (1 << least) == 0)
    of = rows[starts]
    layout = {}
    for c in classes:
        _, head = np.unique(of, return_index=True)
        number = np.arange(len(of)) - np.repeat(head, np.diff([*head, len(of)]))
        blocks = np.flatnonzero(number % (1 << (c - least)) == 0)
        layout[c] = blocks, of[blocks]
    for k, seed in enumerate(seeds):
        low = np.minimum.reduceat(_slot(hashes, seed), starts)
        for c in classes:
            blocks, owner = layout[c]
            window = np.minimum.reduceat(low, blocks)
            if len(window) > 1:
                window[:-1] = np.where(owner[:-1] == owner[1:], np.minimum(window[:-1], window[1:]), window[:-1])
            yield c, k, owner, window


class Sketches:
    """Minima of the items' shingles in each slot, by size class, and hashes to look short items up by."""

    def __init__(self, items: list[tuple[int | None, str | None]], slots: int, seed: int = 42, threshold: float = 0.8):
        found = [(i, t, s) for i, t in items if (s := item_shingles(t))]
        self.items, self.threshold = [(i, s) for i, _, s in found], threshold
        self.widths = np.array([len(next(iter(s))) for _, s in self.items], np.int64)
        self.seeds = slot_seeds(slots, seed)
        own: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(found)
        for width in sorted(set(self.widths.tolist())):
            at = np.flatnonzero(self.widths == width)
            hashes, rows = hashed_shingles(*hashed_words([found[i][1] for i in at]), width)
            cuts = np.searchsorted(rows, np.arange(1, len(at)))
            for i, h in zip(at, np.split(hashes, cuts)):
                own[i] = np.unique(h)
        sizes = np.array([len(s) for _, s in self.items], np.int64)
        long = np.flatnonzero(sizes >= _SHORT)
        classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        lists = [np.concatenate([own[i] for i in long]), np.cumsum([0, *(len(own[i]) for i in long)])[:-1]] if len(long) else None
        minima = [np.minimum.reduceat(_slot(lists[0], self.seeds[k]), lists[1]) for k in range(slots)] if lists else []
        self.by_class: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for c in sorted(set(classes[long].tolist())):
            here = np.flatnonzero(classes[long] == c)
            self.by_class[c] = []
            for low in minima:
                order = here[np.argsort(low[here], kind="stable")]
                maybe = np.zeros(1 << 16, bool)
                maybe[(low[order] & np.uint64(0xFFFF)).astype(np.int64)] = True
                self.by_class[c].append((low[order], long[order], maybe))
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted(set(self.widths[sizes < _SHORT].tolist())):
            short = np.flatnonzero((sizes < _SHORT) & (self.widths == width)).tolist()
            held = Counter(h for i in short for h in own[i].tolist())
            probes = np.array(sorted((h, i) for i in short for h in sorted(own[i].tolist(), key=lambda h: (held[h], h))[: len(own[i]) - max(1, math.ceil(threshold * len(own[i]))) + 1]), np.uint64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(probes[:, 0] & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.probes[width] = probes[:, 0], probes[:, 1], maybe

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared) of each text and item of which at least the threshold's share of shingles stands in the text."""
        row_of, have = None, {}
        for row, item in sorted(self.candidates(*hashed_words(texts))):
            if row != row_of:
                row_of, have = row, {}
            width, wanted = int(self.widths[item]), self.items[item][1]
            if width not in have:
                have[width] = shingles_of(texts[row], width)
            if (shared := len(wanted & have[width])) >= self.threshold * len(wanted):
                yield row, item, shared

    def candidates(self, words: np.ndarray, of_word: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) for every window and item of the window's class that share a minimum, and for every hash that a short item is looked up by."""
        found: set[tuple[int, int]] = set()
        for width, (values, item, maybe) in self.probes.items():
            hashes, rows = hashed_shingles(words, of_word, width)
            near = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
            ends = np.searchsorted(values, hashes[near], "right")
            for w, a, b in zip(near, np.searchsorted(values, hashes[near], "left"), ends):
                found.update((int(rows[w]), int(i)) for i in item[a:b])
        hashes, rows = hashed_shingles(words, of_word)
        if not len(hashes) or not self.by_class:
            return found
        for c, k, owner, window in window_minima(hashes, rows, list(self.by_class), self.seeds):
            values, order, maybe = self.by_class[c][k]
            for w in np.flatnonzero(maybe[(window & np.uint64(0xFFFF)).astype(np.int64)]):
                a, b = np.searchsorted(values, window[w], "left"), np.searchsorted(values, window[w], "right")
                found.update((int(owner[w]), int(i)) for i in order[a:b])
        return found


def _sent(items: DataFrame, threshold: float, slots: int, block: int, block_bytes: int) -> Sketches | None:
    """Sketches of all items if they are at most `block` rows and block_bytes of text."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["n"] > block or size["bytes"] > block_bytes:
        return None
    return Sketches([tuple(r) for r in items.select(F.col("item_id").cast("long"), "text").collect()], slots, threshold=threshold)


_KEYS = ["__d0", "__d1"]
_SALTS = 16


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__d0": F.xxhash64("text"), "__d1": F.xxhash64(F.lit(7), "text")})


def _tokens(kind: int, values: np.ndarray) -> np.ndarray:
    return mix64(values + np.uint64(kind) * _BASE).view(np.int64)


def _bitmap(tokens: DataFrame, n: int) -> np.ndarray:
    """Two bits for each of about n tokens, in a bitmap of 16 bits a token, but at most 64 MB. It is put together by tasks."""
    parts = 1 << min(14, max(0, math.ceil(math.log2(max(1, n) * 16 / (1 << 15)))))
    bit = F.explode(F.array("token", F.shiftrightunsigned("token", 32))).alias("bit")
    at = tokens.select(bit).select(F.col("bit").bitwiseAND(F.lit((parts << 15) - 1)).alias("bit"))
    made = at.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((parts, 1 << 12), np.uint8)
    for part, bits in made.toLocalIterator():
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _probed(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether tokens may be among those of the bitmap."""
    t, most = tokens.view(np.uint64), np.uint64(len(bitmap) * 8 - 1)
    a, b = (t & most).astype(np.int64), ((t >> np.uint64(32)) & most).astype(np.int64)
    return ((bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1).astype(bool)


def _parted(docs: DataFrame, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keyed docs whose keys may be among n given ones, and the rest, told by a bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(keys.select(F.col("__d0").alias("token")), n))
    maybe = F.pandas_udf(lambda t: pd.Series(_probed(sent.value, t.to_numpy(np.int64))), "boolean")
    return docs.where(maybe("__d0")), docs.where(~maybe("__d0"))


def _item_sketches(items: DataFrame, threshold: float, slots: int) -> DataFrame:
    """(kind, token, key) of distinct item texts: a token for each slot's minimum of its class, or for each hash that a short item is looked up by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            s = Sketches(list(enumerate(batch.column("text").to_pylist())), slots, threshold=threshold)
            rows = np.array([i for i, _ in s.items], np.int64)
            parts = [(c * _MOST + k, low, of) for c, lists in s.by_class.items() for k, (low, of, _) in enumerate(lists)]
            parts += [(-width, values, of.astype(np.int64)) for width, (values, of, _) in s.probes.items()]
            for kind, values, of in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), kind, np.int32)), pa.array(_tokens(kind & 0xFFFFFFFF, values)), keys.take(pa.array(rows[of]))], ["kind", "token", "key"])

    return items.mapInArrow(run, "kind int, token long, key string")


def _hits(docs: DataFrame, kinds: list[int], slots: int, bitmap: np.ndarray) -> DataFrame:
    """(d0, d1, token) of keyed docs: tokens of their windows and shingles that items may have."""
    widths, classes = sorted(-k for k in kinds if k < 0), sorted({k // _MOST for k in kinds if k >= 0})
    seeds, sent = slot_seeds(slots), docs.sparkSession.sparkContext.broadcast(bitmap)

    def told(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, of_word = hashed_words(texts)
        for width in widths:
            hashes, rows = hashed_shingles(words, of_word, width)
            yield rows, _tokens(-width & 0xFFFFFFFF, hashes)
        hashes, rows = hashed_shingles(words, of_word)
        if classes and len(hashes):
            for c, k, owner, low in window_minima(hashes, rows, classes, seeds):
                yield owner, _tokens(c * _MOST + k, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                found = [np.zeros((0, 2), np.int64)]
                for rows, tokens in told(cut.column("text").to_pylist()):
                    near = _probed(sent.value, tokens)
                    found.append(np.stack([rows[near], tokens[near]], 1))
                pairs = np.unique(np.concatenate(found), axis=0)
                at = pa.array(pairs[:, 0])
                yield pa.RecordBatch.from_arrays([cut.column("__d0").take(at), cut.column("__d1").take(at), pa.array(pairs[:, 1])], ["d0", "d1", "token"])

    return docs.select(*_KEYS, "text").mapInArrow(run, "d0 long, d1 long, token long").withColumnsRenamed({"d0": "__d0", "d1": "__d1"})


def _verified(threshold: float):
    """Rows in the order of texts and salts: each text, then the items to be sought in it. One text's shingles are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, have = None, {}
        for batch in batches:
            found = []
            for d0, d1, key, body in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "key", "text"))):
                if key is None:
                    text, have = body, {}
                    continue
                wanted = item_shingles(body)
                width = len(next(iter(wanted)))
                if width not in have:
                    have[width] = shingles_of(text, width)
                if (shared := len(wanted & have[width])) >= threshold * len(wanted):
                    found.append((d0, d1, key, shared, len(wanted)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 5, kinds)], [*_KEYS, "key", "n_shared", "n_shingles"])

    return run


def _joined(docs: DataFrame, items: DataFrame, threshold: float, slots: int) -> DataFrame:
    """(d0, d1, key, n_shared, n_shingles) of keyed docs' distinct texts and items (key, text) of any number.

    Items' tokens lie in a table. Documents send only the tokens that a bitmap of the
    items' may hold; where tokens meet, the text and the item are brought together once,
    the items of one text in up to 16 tasks. docs are read twice, whatever the items' number.
    """
    sketches = materialize(_item_sketches(items, threshold, slots), "item-sketches")
    kinds = [r.kind for r in sketches.select(F.when(F.col("kind") < 0, F.col("kind")).otherwise(F.expr(f"kind div {_MOST} * {_MOST}")).cast("int").alias("kind")).distinct().collect()]  # sizes in powers of two, widths
    n = sketches.count()
    hits = _hits(docs, kinds, slots, _bitmap(sketches, n))
    met = hits.join(broadcast_if(sketches.select("token", "key"), n, 80), "token").select(*_KEYS, "key").distinct()
    pairs = materialize(met.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS)).cast("int")), "item-candidates")
    some, _ = _parted(docs, pairs, pairs.count())
    texts = some.select(*_KEYS, "text").dropDuplicates(_KEYS).join(pairs.select(*_KEYS, "salt").distinct().hint("merge"), _KEYS)
    sought = pairs.join(items.hint("merge"), "key").select(*_KEYS, "text", "salt", "key")
    rows = texts.withColumn("key", F.lit(None).cast("string")).unionByName(sought).repartition(*_KEYS, "salt").sortWithinPartitions(*_KEYS, "salt", F.col("key").asc_nulls_first())
    out = materialize(rows.mapInArrow(_verified(threshold), "__d0 long, __d1 long, key string, n_shared long, n_shingles long"), "item-matches")
    release(sketches, pairs)
    return out


def _by_key(items: DataFrame) -> DataFrame:
    return items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.md5("text").alias("key"), "text")


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, slots: int = 32, block: int = 20_000, block_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, containment, n_shared, n_shingles) for items of which at least threshold of the distinct shingles stand in a document.

    items (item_id, text) is the query set: up to `block` items and block_bytes of them are
    sent to the tasks; more of them lie in a table that the documents' windows are joined
    with, with equal results. Shingles are of five words, those of an item of fewer words of
    all its words. Texts without words and null texts match nothing; null ids are kept;
    repeated rows give repeated results; further columns are not read.
    """
    names = re.findall(r"(\w+) \w+(?:, |$)", MATCHES)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    sketches = _sent(items, threshold, slots, block, block_bytes)
    if sketches is None:
        own, keyed = _by_key(items), _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
        found = _joined(keyed, own.select("key", "text").dropDuplicates(["key"]), threshold, slots)
        told = found.join(own.select("key", "item_id").hint("merge"), "key")
        some, _ = _parted(keyed, found, found.count())
        return some.select("doc_id", *_KEYS).join(told.hint("merge"), _KEYS).select("doc_id", "item_id", (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shared", "n_shingles")
    sent = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                ids = cut.column("doc_id")
                found = [(ids[row].as_py(), known.items[item][0], shared / len(known.items[item][1]), shared, len(known.items[item][1])) for row, item, shared in known.matches(cut.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 5, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, slots: int = 32, block: int = 20_000, block_bytes: int = 64 << 20) -> DataFrame:
    """The documents that hold no item, as `contained` tells it, with all their columns.

    Each row is judged by its own text, whatever its doc_id; rows with a null or wordless
    text stay. With items that are sent to the tasks nothing is shuffled; with more, only
    rows that may hold an item are.
    """
    sketches = _sent(items, threshold, slots, block, block_bytes)
    if sketches is None:
        keyed = _keyed(docs)
        found = _joined(keyed.where("text is not null"), _by_key(items).select("key", "text").dropDuplicates(["key"]), threshold, slots)
        some, rest = _parted(keyed, found, found.count())
        return rest.unionByName(some.join(found.select(*_KEYS).distinct().hint("merge"), _KEYS, "left_anti")).select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text", 1 << 20):
                clean = np.ones(cut.num_rows, bool)
                clean[[row for row, _, _ in sent.value.matches(cut.column("text").to_pylist())]] = False
                yield cut.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
