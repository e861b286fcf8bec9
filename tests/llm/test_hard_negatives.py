import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in ok), default=1)
    ok = [(i, np.pad(v, (0, dim - len(v))), y) for i, v, y in ok]
    out, seen = [], set()
    for a, v, y in sorted(ok, key=lambda r: (r[0], r[2], r[1].tolist())):
        if a % 100 or a in seen:
            continue
        seen.add(a)
        score = [(int(v @ w), i, z) for i, w, z in ok if i != a]
        for p, pid, _ in sorted((s for s in score if s[2] == y), key=lambda s: (-s[0], s[1]))[:5]:
            fit = sorted((s for s in score if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p), key=lambda s: (-s[0], s[1]))[:5]
            out += [(a, pid, k, n, p, s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, block=64):
    df = spark.createDataFrame(rows, ROWS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hn.mine(df.select("vec_id", label.alias("label"), hn.whole_components().alias("vec"), F.lit(1).alias("group")), F.col("vec_id") % 100 == 0, block=block).collect()))


def unit(rng, dim=8):
    v = np.array([rng.gauss(0, 1) for _ in range(dim)])
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def test_all_negatives_of_random_and_repeated_vectors(spark):
    rng = random.Random(3)
    hot = unit(rng)
    rows = [(i, unit(rng), rng.randrange(4)) for i in range(700)]
    rows += [(i, hot, rng.randrange(4)) for i in range(700, 1000)]  # ties that only the ids tell
    rows += [(i, (np.array(rows[i - 1000][1]) + rng.gauss(0, 0.05)).tolist(), rng.randrange(4)) for i in range(1000, 1200)]
    want = plain(rows)
    assert len(want) > 100 and mined(spark, rows) == want == mined(spark, rows, block=1024)


def test_nulls_unequal_lengths_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, unit(rng, 3 + i % 3), i % 2) for i in range(0, 240)]
    rows += [(300, None, 1), (400, unit(rng), None), (None, unit(rng), 1), (500, [0.5, None], 1), (600, [float("nan")], 1), (700, [float("inf")], 0), (800, [], 0), (900, [0.0] * 3, 1)]
    rows += [(17, rows[17][1], 1)] * 3 + [(200, rows[3][1], 1), (200, rows[200][1], 0)]
    got = mined(spark, rows)
    assert got == plain(rows)
    assert not {300, 400, 500, 600, 700} & {x for r in got for x in (r[0], r[1], r[3])}


def test_negative_scores_have_no_negatives_and_zero_scores_do(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2), (100, [0.0, 1.0], 1), (101, [0.5, 0.0], 1), (102, [0.25, 0.0], 2)]
    assert mined(spark, rows) == plain(rows)


def test_empty_tables_and_single_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchors
    assert mined(spark, [(100, [1.0], 1), (2, [1.0], 1)]) == []  # no other label


def test_norms_beyond_exact_scores_raise(spark):
    with pytest.raises(ValueError, match="exact"):
        mined(spark, [(100, [1e9], 1), (2, [1e9], 2)])


def test_brackets_hold_every_score(spark):
    rng = np.random.default_rng(5)
    x, a = np.floor(rng.normal(0, 90, (400, 16))), np.floor(rng.normal(0, 90, (30, 16)))
    x[50:90] = x[50]
    top = float((x**2).sum(1).max())
    pivots = hn.Pivots(x[:100], top)
    rows = {"ids": np.arange(400), "norms": (x**2).sum(1), "vecs": x, "dists": pivots.of_rows(x)}
    anchors = {"ids": np.arange(30), "norms": (a**2).sum(1), "vecs": a, "dists": pivots.of_anchors(a)}
    exact = a @ x.T
    for share in (0.5, 0.9, 1.0):
        least = np.quantile(exact, share, axis=1)
        got, left = hn.scores(anchors, rows, top, least, least + 1000)
        inside = (exact >= least[:, None]) & (exact <= least[:, None] + 1000)
        assert left[inside].all() and (got[left] == exact[left]).all()
    close = np.tile(x[:1], (1, 1))  # near a pivot, brackets leave few rows
    _, left = hn.scores({"ids": np.arange(1), "norms": (close**2).sum(1), "vecs": close, "dists": pivots.of_anchors(close)}, rows, top, np.array([top]), np.array([np.inf]))
    assert left.mean() < 1
