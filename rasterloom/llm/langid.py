"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Letters of a lower-cased text give byte bigrams and trigrams, hashed into `dims`
dimensions, weighted by the root of their count and inverse document frequency, and
normalised. Each language has several centroids, clustered by cosine; a text gets the
language of the nearest one and is rejected where even that is too far off: nearer are
all but the farthest 1 % of labelled texts of the same length that the fit did not see.

Document frequencies cover all training rows, with whole texts. The centroids are fitted
on a bounded sample of them: at most `max_train_rows` rows of the `max_langs` most frequent
languages, split evenly over these, chosen by a hash of the text, each cut at
`max_train_chars` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNKNOWN = "und"
_PLAIN_LETTER = re.compile("[A-Za-z]")
_TABLE = bytes(b if chr(b).isalpha() and b < 128 or b > 127 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals and signs of other scripts are none."""
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


@dataclass(frozen=True)
class LangConfig:
    """slack: the share of the similarity of held-out texts (at `quantile`, by length) under which a text is rejected; far: the same of training texts, where nothing could be held out."""

    dims: int = 4096
    clusters: int = 3
    rounds: int = 8
    max_train_rows: int = 4000
    max_train_chars: int = 1 << 15
    max_langs: int = 500
    quantile: float = 0.01
    far: float = 0.2
    slack: float = 0.9


def counts_of(texts: list[str | None], dims: int) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" " + b"  ".join(parts).translate(_TABLE) + b"   ", np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])[: len(data) - 3]
    a, b, c = data[: len(row)], data[1 : len(row) + 1], data[2 : len(row) + 2]
    letter = (a != 32) | (b != 32)
    two = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(7)) % np.uint32(dims)
    three = ((a * np.uint32(0xC2B2AE3D) + b * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1)) >> np.uint32(9)) % np.uint32(dims)
    at = row * dims
    flat = np.concatenate([(at + two)[letter], (at + three)[letter]])
    return np.bincount(flat, minlength=len(parts) * dims).reshape(len(parts), dims)


def vectors_and_sizes(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and binary logarithms of the number of n-grams."""
    n = counts_of(texts, len(idf))
    x = np.sqrt(n, dtype=np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1), np.log2(np.maximum(n.sum(1), 1))


def vectors_of(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    return vectors_and_sizes(texts, idf)[0]


def pieces_of(text: str) -> Iterator[str]:
    """A text and its beginnings of 16, 32, 64 ... characters, cut between words."""
    yield text
    n = 16
    while n < min(len(text), 1 << 15):
        yield text[:n].rsplit(None, 1)[0] if text[:n].strip() else text[:n]
        n *= 2


def _groups(texts: list, most: int = 512) -> Iterator[list]:
    for at in range(0, len(texts), most):
        yield texts[at : at + most]


@dataclass
class LangModel:
    """limits: of each centroid at each size (binary logarithms of n-grams), linear in between."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    limits: np.ndarray
    sizes: np.ndarray

    def limit(self, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.interp(size, self.sizes, np.arange(len(self.sizes)))
        low = at.astype(int)
        high = np.minimum(low + 1, len(self.sizes) - 1)
        return self.limits[best, low] * (1 - at + low) + self.limits[best, high] * (at - low)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, similarity and whether rejected, for each text."""
        lettered = np.array([has_letter(t) for t in texts], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), ~lettered
        near, size = map(np.concatenate, zip(*((x @ self.centroids.T, n) for x, n in (vectors_and_sizes(g, self.idf) for g in _groups(texts)))))
        best = near.argmax(1)
        score = np.where(lettered, np.clip(near[np.arange(len(best)), best], 0, 1), 0).astype(float)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score, ~lettered | (score < self.limit(best, size))


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the mean, then from what is farthest from the centroids so far."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    centres = unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = unit(np.vstack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit(train: DataFrame, cfg: LangConfig = LangConfig()) -> LangModel:
    """A model of the rows (text, lang) with a lang and a letter. None of them: a model that knows no language.

    Texts are chosen by a hash, so those that occur in many rows of a language count once
    in its sample, and its share is set by the number of different texts.
    """
    train = train.select("text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(cfg.max_langs).collect()}
    dims = cfg.dims

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for texts in _groups(part.column("text").to_pylist()):
                    total += (counts_of(texts, dims) > 0).sum(0)
                    rows += len(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"dim": np.append(some, dims), "n": np.append(total[some], rows)})

    seen = train.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dims + 1)
    df[seen["dim"]] = seen["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    if not sizes:
        return LangModel(idf, np.zeros((0, dims)), [], np.zeros((0, 1)), np.zeros(1))
    each = max(1, cfg.max_train_rows // len(sizes))
    shares = train.sparkSession.createDataFrame([(lang, min(1.0, 1.25 * each / max(1, n))) for lang, n in sizes.items()], "lang string, share double")
    order = (F.xxhash64("text") / F.lit(2.0**64) + 0.5) / F.col("share")
    chosen = train.join(F.broadcast(shares), "lang").withColumn("order", order).where("order < 1").select("lang", "order", F.substring("text", 1, cfg.max_train_chars).alias("text"))
    chosen = chosen.groupBy("lang", "order").agg(F.min("text").alias("text"))  # a row for each different text, combined before the shuffle
    rows = chosen.orderBy("order", "lang", "text").limit(cfg.max_train_rows).toPandas()
    rows = rows[np.array([has_letter(t) for t in rows["text"]], bool)].sort_values(["lang", "order", "text"])
    centroids, langs, loose, held = [], [], [], []
    for lang, own in rows.groupby("lang"):
        texts = own["text"].tolist()
        kept = [t for i, t in enumerate(texts) if len(texts) < 8 or i % 4 != 3]
        held += [(lang, p) for i, t in enumerate(texts) if len(texts) >= 8 and i % 4 == 3 for p in pieces_of(t)]
        x = np.concatenate([vectors_of(g, idf) for g in _groups(kept)])
        c = _cluster(x, cfg.clusters, cfg.rounds)
        centroids.append(c)
        langs += [lang] * len(c)
        loose += [np.quantile((x @ c.T).max(1), cfg.quantile) * cfg.far] * len(c)
    if not langs:
        return LangModel(idf, np.zeros((0, dims)), [], np.zeros((0, 1)), np.zeros(1))
    centroids = np.vstack(centroids).astype(np.float32)
    return LangModel(idf, centroids, langs, *_limits(held, idf, centroids, langs, np.array(loose), cfg))


def _limits(held: list[tuple[str, str]], idf: np.ndarray, centroids: np.ndarray, langs: list[str], loose: np.ndarray, cfg: LangConfig) -> tuple[np.ndarray, np.ndarray]:
    """Limits of each centroid by size: quantiles of held-out texts of its language, or of all where those lie lower, as few texts tell little. Shorter texts than those have none."""
    if not held:
        return loose[:, None], np.zeros(1)
    lang, names = np.array([x for x, _ in held]), np.array(langs)
    near, size = [], []
    for g in _groups([t for _, t in held]):
        x, n = vectors_and_sizes(g, idf)
        near.append(x @ centroids.T)
        size.append(n)
    near = np.where(lang[:, None] == names, np.concatenate(near), 0).max(1)
    size = np.concatenate(size)
    found, sizes = [np.zeros(len(langs))], [2.0]
    for b in range(3, int(size.max()) + 1):
        here = (size >= b) & (size < b + 1)
        if here.sum() < 5:
            continue
        every = np.quantile(near[here], cfg.quantile)
        own = [near[here & (lang == name)] for name in langs]
        found.append(cfg.slack * np.array([min(every, np.quantile(x, cfg.quantile)) if len(x) else every for x in own]))
        sizes.append(b + 0.5)
    return np.stack(found, 1), np.array(sizes)


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """docs with lang_pred, score (0 to 1, the cosine of the nearest centroid) and rejected.

    Null texts and texts without a letter are `und` with score 0, and rejected.
    Columns of these names are replaced; repeated rows give repeated results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = {"lang_pred", "score", "rejected"}
    rest = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs, score, rejected = sent.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], [*part.schema.names, "lang_pred", "score", "rejected"])

    return docs.select(rest).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def known_language(docs: DataFrame, train: DataFrame, cfg: LangConfig = LangConfig()) -> DataFrame:
    """The documents that the model of train doesn't reject, with the values of all their columns, whatever these are named."""
    names = docs.columns
    at = {c: f"k{i}" for i, c in enumerate(names)}
    told = identify(docs.toDF(*at.values()).withColumnRenamed(at["text"], "text"), fit(train, cfg)).where("not rejected")
    return told.select(*(F.col("text" if c == "text" else k).alias(c) for c, k in at.items()))
