import random

import xxhash

from rasterloom.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(root)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_fingerprints_equal_the_plain_definition():
    texts = [None, "", " \t\n", "one", "Two words", "A b c", "repeat repeat repeat repeat repeat", "Ünïcode İs höre\x0bnow", "x" * 5000, "the cat " * 300]
    assert simhash.fingerprints_of(texts).tolist() == [slow_fp(t) for t in texts]


def test_components_of_planted_fingerprints_match_brute_force(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(rng.choice([0, 1, 3, 8])):
            x = rng.choice(sorted(fps)) if rng.random() < 0.3 else centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 6])):
                x ^= 1 << b
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) for i in range(64)} | {centre ^ (1 << 40) ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(df).collect()
    assert all((signed[r.u] ^ signed[r.v]).bit_count() <= 3 for r in edges)
    got = {signed[r.node]: signed[r.root] for r in simhash.components(simhash.links(df)).collect()}
    want = slow_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    linked = {f for f in fps if sum(want[g] == want[f] for g in fps) > 1}
    assert groups(got) == groups({f: want[f] for f in linked})


def test_chains_join_one_component(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101)]
    got = dict(simhash.components(spark.createDataFrame(rows, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_query_matches_brute_force(spark, sf):
    from rasterloom.llm.queries import op8_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fp = {r.doc_id: slow_fp(r.text) for r in docs}
    root = slow_components(set(fp.values()))
    low = {}
    for d, f in fp.items():
        low[root[f]] = min(low.get(root[f], d), d)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op8_simhash(spark, sf).collect()} == {(d, f"{f:016x}", low[root[f]]) for d, f in fp.items()}


def test_keep_one_with_nulls_ties_and_extra_columns(spark):
    text = "some words that are the same in every copy of this little text"
    rows = [(3, text, "en", None, 1, "x"), (2, text, None, "s", None, "y"), (2, text, None, "s", None, "y"), (None, text, None, None, None, None), (7, None, None, None, None, None), (8, "", "en", "s", 0, None), (9, "other words entirely here", "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, DOCS + ", fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [2, 7, 9]
    none = spark.createDataFrame([(None, text, "en", None, 1, "x"), (None, text, "en", None, 1, "x"), (None, "b c d e f", None, None, None, None)], DOCS + ", fp string")
    assert sorted(r.text for r in simhash.keep_one(none).collect()) == ["b c d e f", text]
    other = "an id may stand before texts that have nothing to do with one another"
    shared = spark.createDataFrame([(5, text, "en", "a", 1, "x"), (5, other, "en", "b", 1, "y"), (5, other, "en", "c", 1, "z"), (6, other, "en", "d", 1, "w")], DOCS + ", component_id string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(shared).collect()) == [(5, other), (5, text)]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_with_columns_of_maps(spark):
    docs = spark.createDataFrame([(1, "the same text", {"a": 1}, [{"b": 2}])] * 3 + [(2, "the same text", {"a": 1, "c": 3}, []), (3, "quite another one", None, None)], "doc_id long, text string, tags map<string,int>, more array<map<string,int>>")
    assert sorted((r.doc_id, r.tags) for r in simhash.keep_one(docs).collect()) == [(1, {"a": 1}), (3, None)]
