"""Order-preserving packing of documents into token sequences by dynamic programming.

Each task tokenizes its documents in table order into one stream and chooses the cuts
of the stream. Cuts may fall at document ends (free), sentence ends (a small penalty)
and, in long stretches without either, between words (a larger one). The cost of a
sequence is its padding up to the capacity plus the penalty of its closing cut:

    f[j] = penalty[j] + capacity - pos[j] + min(f[i] + pos[i])  over pos[j] - pos[i] <= capacity

The minimum over the sliding range comes from a monotone queue, so every candidate
enters and leaves once. Sequences whose length is a power of two need no padding and
are further transitions. The stream is settled block by block, keeping the last
sequences of a block open for the next, so memory is bounded by a block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_SIGNS = frozenset(".,;:!?")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    """What a packing is made with.

    stretch: tokens without a candidate after which one between words is put in. block:
    tokens that are settled at once. least_exact: the shortest sequence that is weighed
    for being a power of two. most_words: words that a worker remembers. slice_bytes: text
    that is encoded at once.
    """

    tokenizer: str
    capacity: int = 4096
    end_id: int = 2
    sentence_cut: int = 8
    word_cut: int = 64
    per_sequence: int = 4
    stretch: int = 256
    block: int = 1 << 18
    least_exact: int = 256
    most_words: int = 900_000
    slice_bytes: int = 8 << 20


class WordEncoder:
    """Token ids of whole texts. White space separates words for this kind of tokenizer, so each distinct word is encoded once and remembered.

    New words of letters are encoded as lines of many: their ids are told apart by the
    tokens that end words. A line in which a word splits otherwise (as normalisation can
    make it) is encoded word by word. A word with a sign at its end is that word's ids and
    the sign's.
    """

    def __init__(self, path: str, most_words: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        self._check(path)
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values()) + 2, bool)
        self.closing[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.ends = np.zeros(max(vocab.values()) + 2, bool)
        self.ends[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in tuple(".!?")]] = True
        self.forget()

    def _check(self, path: str) -> None:
        """Words are remembered without their case and neighbours: a tokenizer that tells either apart raises."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        parts = ["The", "naïve", "x-ray", "don't", "42nd", "street.", "A"]
        apart = [i for p in parts for i in ids(p)]
        if ids(" ".join(parts)) != apart or ids("\n\t ".join(parts).upper() + " ") != apart or not any(t.endswith("</w>") for t in self.tokenizer.get_vocab()):
            raise ValueError(f"{path} isn't a tokenizer of lower-cased words with </w> at their ends")
        self.signs = {s: ids(s) for s in sorted(_SIGNS) if all(ids(w + s) == ids(w) + ids(s) for w in ("a", "street", "naïve", "xqzw")) and len(ids(s)) == 1}

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one by one, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def _line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that should be letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._plain(words)

    def _signed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of known words with a sign behind each."""
        of = np.fromiter((self.known[w[:-1]] for w in words), np.int64, len(words))
        lens = self.lens[of]
        ends = np.cumsum(lens + 1)
        ids = np.empty(int(ends[-1]), np.uint32)
        ids[ends - 1] = [self.signs[w[-1]][0] for w in words]
        body = np.ones(len(ids), bool)
        body[ends - 1] = False
        ids[body] = self.flat[np.arange(int(lens.sum())) + np.repeat(self.starts[of] - (np.cumsum(lens) - lens), lens)]
        return ids, lens + 1

    def learn(self, words: list[str]) -> None:
        letters, signed, other = [], [], []
        for w in words:
            (letters if w.isalpha() else signed if w[-1:] in self.signs and w[:-1].isalpha() else other).append(w)
        own = set(letters)
        letters += dict.fromkeys(b for w in signed if (b := w[:-1]) not in self.known and b not in own)
        groups = [(self._line, letters, 500), (self._plain, other, 20_000), (self._signed, signed, 100_000)]
        for encode, part in ((f, ws[i : i + n]) for f, ws, n in groups for i in range(0, len(ws), n)):
            ids, lens = encode(part)
            n, k = len(ids), len(self.known)
            while self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while k + len(part) > len(self.lens):
                self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
            self.flat[self.used : self.used + n] = ids
            self.starts[k : k + len(part)] = self.used + np.cumsum(lens) - lens
            self.lens[k : k + len(part)] = lens
            self.known.update(zip(part, range(k, k + len(part))))
            self.used += n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and how many each text has. A null text is empty."""
        texts = texts.fill_null("")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)  # may name special tokens, which are told by case
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(special), "", texts)))
        coded = words.flatten().dictionary_encode()
        found = coded.dictionary.to_pylist()
        if len(self.known) + len(found) > self.most:
            self.forget()
        place = np.fromiter(map(self.known.get, found, repeat(-1)), np.int64, len(found))
        if (new := np.flatnonzero(place < 0)).size:
            unseen = [found[i] for i in new.tolist()]
            self.learn(unseen)
            place[new] = np.fromiter(map(self.known.__getitem__, unseen), np.int64, len(unseen))
        of = place[coded.indices.to_numpy()] if len(found) else place
        lens, starts = self.lens[of], self.starts[of]
        ends = np.cumsum(lens)
        # Steps of one within a word and a jump at each beginning, summed up, are the places of all ids.
        steps = np.ones(int(ends[-1]) if len(ends) else 0, np.int32)
        some = np.flatnonzero(lens)
        at, first, n = (ends - lens)[some], starts[some], lens[some]
        if len(some):
            steps[at] = np.diff(first, prepend=0)
            steps[at[1:]] -= (n[:-1] - 1).astype(np.int32)
        ids = self.flat[np.cumsum(steps, dtype=np.int32)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])]
        counts = np.diff(bounds)
        if special.any():
            rows = {int(i): np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(special)}
            ids = np.concatenate([rows[i] if i in rows else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))])
            counts[list(rows)] = [len(x) for x in rows.values()]
        return ids, counts


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, most_words: int) -> WordEncoder:
    """One encoder for each worker process, kept over its tasks while they ask for the same. A task has one core, so the tokenizer starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, most_words) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most_words] = WordEncoder(path, most_words)
    return _ENCODERS[path, most_words]


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, capacity: int, per_sequence: int = 0, least: int = 1) -> list[int]:
    """Indexes of pos at which the cheapest chain of sequences from pos[0] to pos[-1] cuts, both ends included.

    pos rises by at most capacity from each candidate to the next. A sequence costs
    its padding (none if its length is a power of two from least on), penalty at its
    end and per_sequence.
    """
    n = len(pos)
    exact: dict[int, list[int]] = {}
    size = 1 << (least - 1).bit_length()
    while size < capacity:
        i = np.searchsorted(pos, pos - size)
        for j in np.flatnonzero(pos[np.minimum(i, n - 1)] == pos - size):
            exact.setdefault(int(j), []).append(int(i[j]))
        size *= 2
    at, pen = pos.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    # The queue: candidates by number, with rising cost[i] + at[i], its head at place `head`.
    who, worth, head = [0] * n, [0.0] * n, 0
    tail = -1
    for j in range(1, n):
        here = at[j]
        value = cost[j - 1] + at[j - 1]
        while tail >= head and worth[tail] >= value:
            tail -= 1
        tail += 1
        who[tail], worth[tail] = j - 1, value
        low = here - capacity
        while at[who[head]] < low:
            head += 1
        best, by = worth[head] + capacity - here, who[head]
        if j in exact:
            for i in exact[j]:
                if cost[i] < best:
                    best, by = cost[i], i
        cost[j], back[j] = best + pen[j] + per_sequence, by
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


@dataclass
class _Stream:
    """The open end of a task's stream: ids from position base on, and the documents that reach past base."""

    cfg: Packing
    sequence: int
    base: int = 0
    ids: list[np.ndarray] = field(default_factory=list)
    size: int = 0
    doc_ids: list[np.ndarray] = field(default_factory=list)
    firsts: list[np.ndarray] = field(default_factory=list)
    totals: list[np.ndarray] = field(default_factory=list)
    end: int = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, totals: np.ndarray) -> None:
        self.ids.append(ids)
        self.size += len(ids)
        self.doc_ids.append(doc_ids)
        self.totals.append(totals)
        self.firsts.append(self.end + np.cumsum(totals) - totals)
        self.end += len(ids)

    def settle(self, ends: np.ndarray, last: bool) -> pa.RecordBatch | None:
        """The pieces of the sequences that are final now."""
        cfg, ids = self.cfg, np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        if not len(ids):
            return None
        docs, firsts, totals = (np.concatenate(x) for x in (self.doc_ids, self.firsts, self.totals))
        stops = firsts + totals - self.base
        free = np.zeros(len(ids) + 1, np.int8)  # 0: no candidate, 1: between words, 2: sentence, 3: document
        free[np.flatnonzero(ends[ids]) + 1] = 2
        free[stops] = 3
        free[0] = free[-1] = 3
        some = np.flatnonzero(free)
        gaps = np.diff(some)
        for i in np.flatnonzero(gaps > cfg.stretch):
            free[np.arange(some[i] + cfg.stretch, some[i + 1], cfg.stretch)] = 1
        pos = np.flatnonzero(free)
        penalty = np.array([0, cfg.word_cut, cfg.sentence_cut, 0])[free[pos]]
        cuts = pos[choose_cuts(pos, penalty, cfg.capacity, cfg.per_sequence, cfg.least_exact)]
        if not last:
            cuts = cuts[: max(2, len(cuts) - 3)]
        elif (left := int(cuts[-1] - cuts[-2])) & (left - 1) and (left.bit_count() - 1) * cfg.word_cut < cfg.capacity - left:
            powers = [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1]
            cuts = np.concatenate([cuts[:-2], cuts[-2] + np.concatenate([[0], np.cumsum(powers)])])
        final = int(cuts[-1])
        marks = np.union1d(cuts, stops[(stops > 0) & (stops <= final)])
        a, b = marks[:-1], marks[1:]
        doc = np.searchsorted(stops, a, "right")
        seq = np.searchsorted(cuts, a, "right") - 1
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())), np.int64, len(a))
        out = [docs[doc], a + self.base - firsts[doc], b - a, crc, totals[doc], self.sequence + seq, a - cuts[seq]]
        self.sequence += len(cuts) - 1
        live = stops > final
        self.base += final
        self.ids, self.size = [ids[final:].copy()], len(ids) - final
        self.doc_ids, self.firsts, self.totals = [docs[live]], [firsts[live]], [totals[live]]
        names = [x.split()[0] for x in PIECES.split(", ")]
        arrays = [pa.array(out[0])] + [pa.array(x.astype(np.int64)) for x in out[1:]]
        return pa.RecordBatch.from_arrays([pa.array(arrays[0].to_pylist(), pa.int64()), *arrays[1:]] if out[0].dtype == object else arrays, names)


def pack(docs: DataFrame, cfg: Packing) -> DataFrame:
    """Pieces of all documents (PIECES), in the order of the table within each partition.

    Each id of each document, its end id included, lies in one piece; offsets in a
    sequence have no gaps. A null text is empty and gives the end id alone; a null
    doc_id is kept; repeated rows are packed each. Sequences of the power of two
    lengths need no padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(cfg.tokenizer, cfg.most_words)
        stream = _Stream(cfg, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        for batch in batches:
            for part in slices(batch, "text", cfg.slice_bytes):
                ids, counts = words.encode(part.column("text"))
                stops = np.cumsum(counts)
                ids = np.insert(ids, stops, cfg.end_id).astype(np.uint32)
                names = part.column("doc_id")
                names = np.array(names.to_pylist(), object) if names.null_count else names.to_numpy()
                stream.add(names, ids, counts + 1)
                if stream.size >= cfg.block and (out := stream.settle(words.ends, False)) is not None:
                    yield out
        if (out := stream.settle(words.ends, True)) is not None:
            yield out
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)
