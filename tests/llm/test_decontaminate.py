import random

import numpy as np

from rasterloom.llm import decontaminate as d


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()) + str(rng.randrange(400)) for _ in range(n)]


def slow(docs, items, threshold=0.8):
    out = set()
    for i, t in items:
        w = d.words_of(t)
        width = min(5, len(w))
        want = set(zip(*(w[k:] for k in range(width))))
        for doc, text in docs:
            shared = len(want & d.shingles_of(text, width)) if want else 0
            if want and shared >= threshold * len(want):
                out.add((doc, i, shared, len(want)))
    return out


def test_hashes_tell_shingles_apart():
    texts = ["One two, three four FIVE six.", None, "a b c d", "one Two three four five six", "é è ê ë ē"]
    h, row = d.hashed_shingles(*d.hashed_words(texts))
    assert row.tolist() == [0, 0, 3, 3, 4] and h[:2].tolist() == h[2:4].tolist() and len(np.unique(h)) == 3


def test_items_are_found_in_long_documents(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 3, 4, 5, 6, 12, 30, 60, 200])))) for i in range(30)] + [(90, None), (91, "alpha7"), (92, ""), (93, "Alpha7, beta9!"), (94, "one two three"), (95, "one two three four"), (95, "one two three four"), (96, "?!")]
    docs = []
    for k in range(120):
        body = words(rng, rng.choice([3, 50, 400, 3000]))
        if k % 3 == 0:
            w = items[rng.randrange(30)][1].split()
            if k % 2:
                for p in rng.sample(range(len(w)), max(1, len(w) // 40)):
                    w[p] = "changed"
            if k % 5 == 0 and len(w) > 40:  # in two places
                at = len(body) // 3
                body[at:at] = w[: len(w) // 2 + 4]
                body += w[len(w) // 2 :]
            else:
                at = rng.randrange(len(body))
                body[at:at] = w
        docs.append((k, " ".join(body).upper() if k % 7 == 0 else ", ".join(body)))
    docs += [(500, None), (501, ""), (7, docs[9][1]), (502, "One. Two? three four"), (503, "one two two three four"), (504, "alpha7 beta9"), (505, "alpha7 x beta9"), (None, "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert want
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in d.contained(df, it).collect()} == want
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in d.contained(df, it, block=7).collect()} == want


def test_short_items_are_never_missed():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 5 + i % 7))) for i in range(350)] + [(350 + i, f"what is the capital of land{i}") for i in range(50)] + [(900, "one two three four five six seven eight nine " * 3)]
    docs = []
    for i, t in items:
        w, body = t.split(), words(rng, 40)
        at = rng.choice([0, rng.randrange(30)])
        if len(w) >= 9 and i % 2:
            w[0] = "changed"
        body[at:at] = w
        docs.append((i, " ".join(body)))
    held = [d.shingles_of(t) for _, t in docs]
    for threshold, kw in ((0.8, {}), (0.5, {"threshold": 0.5})):
        found = d.Sketches(items, 32, **kw).candidates(*d.hashed_words([t for _, t in docs]))
        want = {(row, i) for i, (_, t) in enumerate(items) if len(s := d.shingles_of(t)) < 8 for row, have in enumerate(held) if len(s & have) >= threshold * len(s)}
        assert len(want) >= 399 and want <= found


def test_stage_drops_leaks_and_keeps_the_rest(spark):
    item = "this is the passage of a benchmark that nobody should learn by heart"
    rows = [(1, "intro " * 50 + item, "x"), (2, "clean words only here and nothing else at all", "y"), (None, "null id stays clean here", None), (3, None, None)]
    rows += [(None, item, "leak"), (2, item + " again", "leak"), (4, "the capital of Zembla", "leak"), (5, "a capital of Zembla", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(0, item), (1, "The capital of Zembla?"), (2, None)], "item_id long, text string")
    for block in (20_000, 1):
        assert sorted((r.doc_id or -1, r.item_id or "") for r in d.without_leaks(docs, items, block=block).collect()) == [(-1, ""), (2, "y"), (3, ""), (5, "z")]
    assert d.without_leaks(docs, items).columns == docs.columns
    assert d.contained(docs.limit(0), items).count() == 0 and d.contained(docs, items.limit(0)).count() == 0


def test_items_in_a_table_give_what_items_sent_to_tasks_give(spark):
    """One document that holds very many items, copies of it, and documents that hold one or none."""
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.choice([2, 5, 9, 15, 40])))) for i in range(150)]
    items += [(i + 1000, t) for i, t in items[:20]] + [(None, items[3][1])]
    whole = " and then ".join(t for _, t in items[:120])
    docs = [(k, whole) for k in range(6)] + [(10 + k, " ".join(words(rng, 200)) + " " + items[k][1]) for k in range(30)] + [(90, "clean"), (91, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    few, many = (sorted(map(str, d.contained(df, it, block=b).collect())) for b in (20_000, 10))
    assert few == many and len(few) >= 6 * 140 + 30
    assert many == sorted(map(str, d.contained(df, it, block_bytes=100).collect()))
    assert {r.doc_id for r in d.without_leaks(df, it, block=10).collect()} == {r.doc_id for r in d.without_leaks(df, it).collect()} == {90, 91}
