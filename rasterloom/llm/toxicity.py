"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks, trained on labelled sentences.

The kernel compares two stretches of sentences by their common subsequences of three
symbols. A subsequence may have gaps, up to `span` symbols in all, and weighs
decay ** gaps. So an insult with characters put in or left out stays close to the
insult. Symbols are letters and digits, look-alike signs as letters, and one blank for
white space and where sentences begin and end; other signs are none, and single letters
in a row are written together.
A sentence is compared by its stretches of `window` symbols, which cross words, and is
as toxic as the worst of them; a text is as toxic as its worst sentence.

Training, on a bounded sample of labelled rows (`max_train_rows`, chosen by a hash of
the text, split evenly over both labels, each cut at `max_train_chars`): a sentence of a
toxic document is an example where a word in it is told by document frequencies under
either label; sentences of clean documents are negatives, with rounds of the hardest
added. Landmarks are stretches of both kinds of sentences; a linear SVM is fitted on
their Nyström features. As those are linear in the kernel, the model folds into one
weight for each subsequence of the landmarks, which gives the same decision values and
makes scoring a table lookup. Held-out documents of the
sample, and their examples with a letter put in, calibrate it to 0..1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
_SYMBOLS = 64
_END, _OTHER, _BLANK, _STOP, _DROP = 0, 27, 62, 254, 255
_LIKE = str.maketrans("@$013457", "asoieast")
#: Decision values are summed as whole numbers of this unit, so a text's score doesn't depend on its neighbours in a batch.
_UNIT = 2.0**24


@dataclass(frozen=True)
class ToxConfig:
    """most_negatives: stretches of clean sentences before the hardest are added. noise: the share of clean documents, to that of toxic ones, that may hold an insult. power: how much less rarer words count. unseen: what an example with a letter put in counts in the calibration."""

    span: int = 6
    decay: float = 0.75
    window: int = 10
    landmarks: int = 1000
    max_train_rows: int = 4000
    max_train_chars: int = 1 << 15
    most_negatives: int = 8000
    ridge: float = 1e-5
    rounds: int = 5
    noise: float = 0.05
    power: float = 0.5
    unseen: float = 0.2


def _symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane: letters by number, other letters and digits folded, signs dropped."""
    out = np.full(1 << 16, _DROP, np.uint8)
    for c in range(1 << 16):
        if chr(c).isspace():
            out[c] = _BLANK
        elif chr(c).isalnum():
            out[c] = _OTHER if chr(c).isdigit() else c % 34 + 28
    out[[ord(c) for c in ".!?"]] = _STOP
    out[97:123] = np.arange(1, 27)
    for sign, letter in _LIKE.items():
        out[sign] = letter - 96
    out[10] = _END
    return out


_TABLE = _symbol_table()


def symbols_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts after one another, and where each text begins. Each sentence has a blank before and behind it and then an end; a text has at least one sentence."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    code = _TABLE[np.minimum(points, 0xFFFF)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    after = np.append(code[1:], _END)
    stop = code == _STOP
    code = np.where(stop, np.where((after == _BLANK) | (after == _END), _END, _DROP), code)
    live = code != _DROP
    code, owner = code[live], owner[live]
    before = np.append(_END, code[:-1])
    live = (code != _BLANK) | ((before != _BLANK) & (before != _END))
    code, owner = code[live], owner[live]
    edge = np.concatenate([[True, True], (code == _BLANK) | (code == _END), [True, True]])
    live = ~((code == _BLANK) & edge[:-4] & edge[4:] & (np.append(code[1:], _END) != _END))  # a blank between single letters
    code, owner = code[live], owner[live]
    first = np.searchsorted(owner, np.arange(len(texts)))
    end = code == _END
    framed = np.repeat(np.where(end, _BLANK, code), np.where(end, 3, 1))
    framed[(np.cumsum(np.where(end, 3, 1)) - 2)[end]] = _END
    return np.append(np.uint8(_BLANK), framed[:-1]), first + 2 * (np.cumsum(end) - end)[first]


def unit_of(word: str) -> str:
    """Letters of a lower-cased word, look-alike signs as letters, other signs left out."""
    return word if word.isalpha() else "".join(filter(str.isalnum, word.translate(_LIKE))) if re.search("[a-z]", word) else ""


def _pairs(cfg: ToxConfig) -> list[tuple[int, int, float]]:
    """(second, third, weight) of the subsequences that begin at a place; the weights' squares sum to 1 over a window."""
    found = [(a, b, cfg.decay ** (b - 2)) for a in range(1, cfg.span) for b in range(a + 1, cfg.span)]
    norm = np.sqrt(cfg.window * sum(w * w for _, _, w in found))
    return [(a, b, w / norm) for a, b, w in found]


@dataclass
class ToxModel:
    """weights: of each subsequence; floor: the decision value of a text without symbols; slope, shift: of the calibration."""

    cfg: ToxConfig
    weights: np.ndarray
    floor: float
    slope: float
    shift: float

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of the texts' symbols the weight, in units, of the window that begins there; the symbols; where each text begins."""
        code, first = symbols_of(texts)
        wide = np.where(code == _END, self.cfg.span - 1, 1)  # no subsequence crosses a sentence's end
        c = np.append(np.repeat(code, wide), np.zeros(self.cfg.span, np.uint8)).astype(np.int32)
        first = (np.cumsum(wide) - wide)[first]
        n = len(c) - self.cfg.span
        here = np.zeros(n, np.float32)
        twos = {a: (c[:n] * _SYMBOLS + c[a : n + a]) * _SYMBOLS for a in range(1, self.cfg.span)}
        for a, b, w in _pairs(self.cfg):
            here += np.float32(w) * self.weights[twos[a] + c[b : n + b]]
        total = np.concatenate([[0], np.cumsum(np.rint(here * np.float32(_UNIT)).astype(np.int64))])
        ends = np.flatnonzero(c[:n] == _END)
        stop = np.minimum(np.arange(n) + self.cfg.window, ends[np.minimum(np.searchsorted(ends, np.arange(n)), len(ends) - 1)]) if len(ends) else np.arange(n)
        return total[np.maximum(stop, np.arange(n))] - total[:n], c, first

    def values(self, texts: list[str | None]) -> np.ndarray:
        """The decision value of each text: of its worst window, at least that of no symbols at all."""
        if not texts:
            return np.zeros(0)
        sums, _, first = self.sums(texts)
        return np.maximum(np.maximum.reduceat(sums, first), 0) / _UNIT + self.floor

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def windows_of(codes: list[np.ndarray], cfg: ToxConfig) -> np.ndarray:
    """Stretches of symbols as rows, cut or filled up with ends to what the subsequences of a window read."""
    out = np.zeros((len(codes), cfg.window + cfg.span - 1), np.int32)
    for row, c in zip(out, codes):
        row[: min(len(c), len(row))] = c[: len(row)]
    return out


def features_of(windows: np.ndarray, cfg: ToxConfig) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers of each row, 0 for those that take in an end, and the weights that all rows share."""
    n, parts = cfg.window, []
    whole = np.cumsum(windows == _END, 1) == 0
    for a, b, _ in _pairs(cfg):
        f = (windows[:, :n] * _SYMBOLS + windows[:, a : n + a]) * _SYMBOLS + windows[:, b : n + b]
        parts.append(np.where(whole[:, b : n + b], f, 0))
    return np.concatenate(parts, 1), np.repeat([w for _, _, w in _pairs(cfg)], n)


def _landmark_table(marks: np.ndarray, cfg: ToxConfig) -> tuple[np.ndarray, np.ndarray]:
    """place (of the landmarks' subsequences, as an index over all) and the landmarks' weights for each."""
    f, w = features_of(marks, cfg)
    keys = np.unique(f[f > 0])
    place = np.zeros(_SYMBOLS**3, np.int32)
    place[keys] = np.arange(1, len(keys) + 1)
    out = np.zeros((len(keys) + 1, len(marks)), np.float32)
    np.add.at(out, (place[f], np.arange(len(marks))[:, None]), np.broadcast_to(w, f.shape))
    out[0] = 0
    return place, out


def _kernel(windows: np.ndarray, place: np.ndarray, table: np.ndarray, cfg: ToxConfig) -> np.ndarray:
    """The kernel of each row and each landmark."""
    out = np.zeros((len(windows), table.shape[1]), np.float32)
    for at in range(0, len(windows), 2048):
        f, w = features_of(windows[at : at + 2048], cfg)
        p = place[f]
        for j in np.flatnonzero(p.any(0)):
            rows = np.flatnonzero(p[:, j])
            out[at + rows] += np.float32(w[j]) * table[p[rows, j]]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps from start. Rows are taken in blocks."""
    n = x.shape[1] + 1
    wide = lambda at: np.hstack([x[at : at + 1024].astype(float), np.ones((len(x[at : at + 1024]), 1))])
    w = np.zeros(n) if start is None else start
    reg = np.full(n, ridge * cost.sum())
    reg[-1] = 1e-8
    for _ in range(30):
        left, right = np.diag(reg), np.zeros(n)
        for at in range(0, len(x), 1024):
            block, here, price = wide(at), y[at : at + 1024], cost[at : at + 1024]
            m = here * (block @ w) < 1
            a = block[m] * price[m, None]
            left += a.T @ block[m]
            right += a.T @ here[m]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, rtol=1e-4, atol=1e-5):
            return new
        w = new
    return w


def _variants(unit: str, symbols: str = "xqzk") -> list[str]:
    """A unit with a letter put in, doubled, or left out at each place, with two put in, and in two pieces."""
    once = [unit[:i] + s + unit[i:] for i in range(1, len(unit)) for s in (symbols[i % len(symbols)], unit[i], " ")]
    twice = [u[:i] + symbols[i % len(symbols)] + u[i:] for n, u in enumerate(once) for i in [1 + (3 * n + len(u) // 2) % (len(u) - 1)]]
    return once + twice + [unit[:i] + unit[i + 1 :] for i in range(1, len(unit) - 1)]


def _told_words(words: list[list[str]], y: np.ndarray, cfg: ToxConfig) -> Counter[str]:
    """Words that only toxic documents hold but for label noise, with how many of them do."""
    seen = {label: Counter(u for ws, here in zip(words, y) if here == label for u in set(ws)) for label in (True, False)}
    n1, n0 = int(y.sum()), int((~y).sum())
    told = Counter({u: k for u, k in seen[True].items() if k >= 2 and seen[False][u] / n0 <= cfg.noise * k / n1})
    if not told:
        odds = {u: np.log((k + 0.5) / (n1 + 1)) - np.log((seen[False][u] + 0.5) / (n0 + 1)) for u, k in seen[True].items()}
        told = Counter({u: seen[True][u] for u, _ in sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:20]})
    # A word that few toxic documents share is chance: keep those whose share stands out from the most frequent.
    most = max(told.values(), default=0)
    return Counter({u: k for u, k in told.items() if k >= max(2, most / 25)}) or told


def _examples(text: str, told: Counter[str], cfg: ToxConfig) -> Iterator[tuple[str, str]]:
    """(stretch, its word) of each sentence of a toxic text that holds a told word: the strongest one, after up to a third of a window, and what follows it."""
    for sentence in SENTENCE.split(text.lower()):
        words = sentence.split()
        units = [unit_of(w) for w in words]
        strong = max(((told[u], -i) for i, u in enumerate(units) if u in told), default=None)
        if strong is None:
            continue
        i = -strong[1]
        lead = " ".join(words[max(0, i - 3) : i])[-(cfg.window // 3) :].lstrip()
        yield f"{lead} {units[i]} {' '.join(words[i + 1 : i + 4])}".strip(), units[i]


def _codes(text: str) -> np.ndarray:
    """The symbols of one stretch."""
    code = symbols_of([text])[0]
    return code[code != _END]


def train(texts: list[str], toxic: list[int], cfg: ToxConfig = ToxConfig()) -> ToxModel:
    """A model of labelled texts. Without both labels it knows nothing and scores all texts by the share of toxic ones."""
    y = np.array(toxic, bool)
    nothing = np.zeros(_SYMBOLS**3, np.float32)
    rate = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.all() or not y.any():
        return ToxModel(cfg, nothing, 0.0, 0.0, float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
    held = np.arange(len(y)) % 4 == 3
    if y[held].sum() < 50 or (~y[held]).sum() < 50:
        held[:] = False
    fit = np.flatnonzero(~held)
    words = [[u for w in texts[d].lower().split() if len(u := unit_of(w)) >= 3] for d in fit]
    told = _told_words(words, y[fit], cfg)
    pairs = [x for d in fit[y[fit]] for x in _examples(texts[d], told, cfg)]
    clean = [texts[d] for d in fit[~y[fit]]]
    if not pairs or not clean:
        return ToxModel(cfg, nothing, 0.0, 0.0, float(np.log(rate / (1 - rate))))
    one = {u: s for s, u in reversed(pairs)}
    odd = [(v, u) for u, s in one.items() for v in (u, *(s.replace(u, v, 1) for v in _variants(u)))]  # and by itself
    pos = windows_of([_codes(s) for s, _ in pairs + odd], cfg)
    most = max(told.values())  # what stands out most counts most, in a sentence as it is and in variants together
    many = Counter(u for _, u in odd)
    weight = np.array([(told[u] / most) ** cfg.power for _, u in pairs] + [told[u] * (told[u] / most) ** cfg.power / (4 if s == u else many[u]) for s, u in odd])
    neg = np.concatenate([_clean_windows(g, cfg) for g in _groups(clean)])
    neg = neg[:: max(1, -(-len(neg) // cfg.most_negatives))]
    half, by = cfg.landmarks // 2, {}
    for i, (_, u) in enumerate(pairs):
        by.setdefault(u, []).append(i)
    turns = [i for k in range(max(map(len, by.values()))) for rows in by.values() if k < len(rows) for i in rows[k : k + 1]]
    marks = np.unique(np.concatenate([pos[turns[:half]], neg[:: max(1, len(neg) // half)][:half]]), axis=0)
    place, table = _landmark_table(marks, cfg)
    gram = _kernel(marks, place, table, cfg).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = lambda rows: np.concatenate([(_kernel(rows[i : i + 2048], place, table, cfg) @ root).astype(np.float32) for i in range(0, len(rows), 2048)])
    x1, x0 = mapped(pos), mapped(neg)
    model, w = ToxModel(cfg, nothing, 0.0, 1.0, 0.0), None
    for turn in range(cfg.rounds):
        if turn:
            x0 = np.vstack([x0, mapped(np.concatenate([_hardest(model, g) for g in _groups(clean)]))])
        cost = np.concatenate([weight / weight.sum(), np.full(len(x0), 1.0 / len(x0))])
        w = _svm(np.vstack([x1, x0]), np.concatenate([np.ones(len(x1)), -np.ones(len(x0))]), cost, cfg.ridge, w)
        folded = (table @ (root @ w[:-1])).astype(np.float32)
        model = ToxModel(cfg, np.where(place > 0, folded[place], 0).astype(np.float32), float(w[-1]), 1.0, 0.0)
    at = np.flatnonzero(held) if held.any() else fit
    unseen = [s.replace(u, v, 1) for d in at[y[at]] for s, u in _examples(texts[d], told, cfg) if len(u) > 3 for v in (u[:2] + "v" + u[2:], u[:-2] + "w" + u[-2:])]
    return ToxModel(cfg, model.weights, model.floor, *_calibrate(np.concatenate([model.values(g) for g in _groups([texts[i] for i in at] + unseen)]), np.append(y[at], np.ones(len(unseen), bool)), np.append(np.ones(len(at)), np.full(len(unseen), cfg.unseen))))


def _groups(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield texts[at : i + 1]
            at, size = i + 1, 0


def _clean_windows(texts: list[str], cfg: ToxConfig) -> np.ndarray:
    """Stretches of all sentences of clean texts, a window after another."""
    code, _ = symbols_of(texts)
    ends = np.flatnonzero(code == _END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.concatenate([np.arange(a, max(a + 1, b - 2), cfg.window) for a, b in zip(starts, ends)])
    stop = ends[np.searchsorted(ends, at)]
    return windows_of([code[a:b] for a, b in zip(at, stop)], cfg)


def _hardest(model: ToxModel, texts: list[str]) -> np.ndarray:
    """The worst window of each clean text."""
    sums, c, first = model.sums(texts)
    width = model.cfg.window + model.cfg.span - 1
    bounds = np.append(first, len(sums))
    at = np.array([a + int(sums[a:b].argmax()) for a, b in zip(bounds[:-1], bounds[1:])])
    rows = np.concatenate([c, np.zeros(width, c.dtype)])[at[:, None] + np.arange(width)]
    return np.where(np.cumsum(rows == _END, 1) == 0, rows, 0)


def _calibrate(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve; targets are drawn in by the counts of either label."""
    n1, n0 = int(y.sum()), int((~y).sum())
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([value, np.ones_like(value)], 1)
    b = np.zeros(2)
    cost = weight * np.where(y, len(y) / (2 * weight[y].sum()), len(y) / (2 * n0))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (cost * (t - p)) - 1e-3 * b
        h = (x * (cost * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 0)), float(b[1])


def sample(labels: DataFrame, cfg: ToxConfig = ToxConfig()) -> DataFrame:
    """At most cfg.max_train_rows of the rows (doc_id, toxic), half of each label, chosen by a hash of the id."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = cfg.max_train_rows // 2
    share = F.when(F.col("toxic") == 1, min(1.0, each / max(1, sizes.get(1, 0)))).otherwise(min(1.0, each / max(1, sizes.get(0, 0))))
    chosen = labels.withColumn("order", (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) / share).where("order < 1")
    return chosen.orderBy("order", "doc_id", "toxic").limit(cfg.max_train_rows).select("doc_id", "toxic")


def fit(labelled: DataFrame, cfg: ToxConfig = ToxConfig()) -> ToxModel:
    """A model of rows (text, toxic), of which at most cfg.max_train_rows are sampled, each cut at cfg.max_train_chars.

    Texts are chosen by a hash, so those that occur in many rows of a label count once in
    its sample, and its share is set by the number of different texts.
    """
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and text is not null")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    each = cfg.max_train_rows // 2
    share = F.when(F.col("toxic") == 1, min(1.0, 1.25 * each / max(1, sizes.get(1, 0)))).otherwise(min(1.0, 1.25 * each / max(1, sizes.get(0, 0))))
    order = (F.xxhash64("text") / F.lit(2.0**64) + 0.5) / share
    cut = rows.withColumns({"order": order, "text": F.substring("text", 1, cfg.max_train_chars)}).where("order < 1")
    cut = cut.groupBy("toxic", "order").agg(F.min("text").alias("text"))  # a row for each different text, combined before the shuffle
    sample = cut.orderBy("order", "text", "toxic").limit(cfg.max_train_rows).collect()
    return train([r["text"] for r in sample], [r["toxic"] for r in sample], cfg)


def score(docs: DataFrame, model: ToxModel) -> DataFrame:
    """(doc_id, score) of every row.

    Null and empty texts score as texts without any symbol. A text's score depends on
    nothing but the text, so repeated rows give repeated results. Further columns of
    docs, whatever their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                value = model.score(model.values(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
