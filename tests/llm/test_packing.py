import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def slow_cost(pos, penalty, capacity, per_sequence):
    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= capacity:
                pad = 0 if n & (n - 1) == 0 else capacity - n
                best[j] = min(best[j], best[i] + pad + penalty[j] + per_sequence)
    return best[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    pos = np.concatenate([[0], np.cumsum(rng.integers(1, 24, 60))])
    penalty = rng.choice([0, 0, 3, 9], len(pos))
    cuts = packing.choose_cuts(pos, penalty, capacity, 2)
    assert cuts[0] == 0 and cuts[-1] == len(pos) - 1
    cost = 0
    for a, b in zip(cuts, cuts[1:]):
        n = pos[b] - pos[a]
        assert n <= capacity
        cost += (0 if n & (n - 1) == 0 else capacity - n) + penalty[b] + 2
    assert cost == slow_cost(pos.tolist(), penalty.tolist(), capacity, 2)


def test_ids_equal_the_tokenizer_on_odd_texts():
    texts = ["", None, "it's HERE, isn't it?", "a\x1cb\x85c d", "<|endoftext|> and <|ENDOFTEXT|>x", "İstanbul ÀÉ é ﬁ Ⅻ 12345 ...!?", "\n\t  \n", "ΟΔΟΣ ß K å", "x" * 3000, "don't 're 'LL 's", "plain words, with signs. and \u0958\u0932 \u0958\u0932. İzmir. ΟΔΟΣ. Σ: dž ŉ; ﬁn! àa? ..", "only letters here and there"]
    enc = packing.WordEncoder(PATH, 1000)
    for _ in range(2):
        ids, counts = enc.encode(pa.array(texts, pa.string()))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [ids_of(t)[:-1] for t in texts]


def check(rows, texts, capacity):
    for doc, text in texts.items():
        ids, own = ids_of(text), sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    pad = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad


def test_pieces_cover_every_id_once(spark):
    rows = [(i, f"Sentence {i} of a short text. " * (i % 40) + "no end", "en") for i in range(300)] + [(900, None, None), (901, "", None), (902, "word " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(2)
    cfg = packing.Packing(PATH, capacity=512, block=4096)
    out = packing.pack(docs, cfg).collect()
    total = sum(r.length for r in out)
    pad = check(out, {r[0]: r[1] for r in rows}, 512)
    assert pad < 0.02 * total
    assert packing.pack(docs.limit(0), cfg).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "x y"), (1, "x y")], "doc_id long, text string").coalesce(1)
    out = packing.pack(docs, packing.Packing(PATH, capacity=16)).collect()
    assert sum(r.length for r in out) == 4 + 3 + 3
    assert sorted((r.doc_id is None, r.doc_tokens) for r in out if r.start == 0) == [(False, 3), (False, 3), (True, 4)]


def test_query_covers_the_table(spark, sf):
    from rasterloom.llm.queries import op7_packing

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op7_packing(spark, sf).collect()
    assert check(out, docs, 4096) < 0.03 * sum(r.length for r in out)


def test_an_encoder_for_each_setting_and_none_for_other_tokenizers():
    assert packing.encoder(PATH, 500).most == 500 and packing.encoder(PATH, 700).most == 700 and packing.encoder(PATH, 700) is packing.encoder(PATH, 700)
    with pytest.raises(ValueError, match="lower-cased words"):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 500)
