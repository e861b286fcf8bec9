import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rasterloom.llm import prefix_trie as pt
from rasterloom.llm.queries import op13_prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(t[3], t[4]) for t in sorted(v)] for c, v in own.items()}
    seq = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    at = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            at[s[:d]].append(c)
    kids = defaultdict(list)
    for p in at:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(at, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(at[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in at[p] if seq[c] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(at[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in at.items())


def built(spark, rows, most=pt.BUCKET_TURNS):
    out = pt.trie(pt.turns_of(spark.createDataFrame(rows, TURNS)), most).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def talk(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hello", "ja?", "Ünï", "", None])))
    return rows


@pytest.mark.parametrize("most", [pt.BUCKET_TURNS, 40, 3])
def test_nodes_equal_brute_force_at_every_bucket_size(spark, most):
    rng = random.Random(11)
    rows = talk(rng, 300) + [(c, t, "system", f"same {t}") for c in range(1000, 1200) for t in range(4)] + [(5000, t, "user", "long") for t in range(400)]
    assert built(spark, rows, most) == plain(rows, heads=False)


def test_shared_heads_and_turnless_conversations(spark, tmp_path):
    rng = random.Random(12)
    rows = [(c + 1000 * b, t, r, x) for b in (0, 1) for c, t, r, x in talk(rng, 130)] + [(c, 0, "user", "alone") for c in range(350, 400)] + [(-c, 1, "user", "below") for c in range(1, 150)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_prefix_trie(spark, str(tmp_path)).collect()
    want = plain(rows)
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got if r.depth) == [w for w in want if w[1]]
    root = next(r for r in got if not r.depth)
    assert (root.conv_id, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens, root.ends_sha256) == (-149, None, *[w for w in want if not w[1]][0][3:])
    assert root.ends_sha256 != hashlib.sha256().hexdigest()  # some are turnless


def test_nulls_ties_repeated_rows_and_extra_columns(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (2, None, "user", "first"), (2, 0, "", ""), (None, 0, "user", "no one"), (3, 5, "user:", "x"), (4, 5, "user", ":x"), (5, 1, "user", "x" * 100_000)]
    assert built(spark, rows) == plain(rows, heads=False)
    from pyspark.sql import functions as F

    more = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("mine") for c in ("path", "key", "n", "ends", "turns", "digest", "_h", "cut")})
    assert pt.trie(pt.turns_of(more)).count() == len(plain(rows, heads=False))


def test_empty_tables(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "user", "x")]) == []
    none = pt.turns_of(spark.createDataFrame([(c, 0, "user", "x") for c in (7, 8)], TURNS)).selectExpr("conv_id", "slice(turns, 1, 0) as turns")
    (root,) = pt.trie(none).collect()
    assert tuple(root) == (7, 0, None, 2, 0, 1, 0, hashlib.sha256(b"7,8").hexdigest())
