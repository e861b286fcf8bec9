from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Shares by weight, the excess over the limits dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def check(rows, docs):
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d[3]] += len((d[1] or "").split())
    by = defaultdict(list)
    for d in docs:
        by[d[0]].append(d)
    want = plain_targets(sizes)
    for r in rows:
        d = by[r.doc_id][0]
        assert r.size == len((d[1] or "").split()) and r.source_size == sizes[d[3]]
        assert r.target == pytest.approx(want[d[3]], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size
        taken[d[3]] += r.taken
        most[d[3]] += 1
    for s in sizes:
        assert want[s] - 1 - most[s] < taken[s] <= want[s] + 1e-6
    return taken, want


def docs_of(n, words=lambda i: i % 17):
    return [(i, " ".join(["wört"] * words(i)), "en", f"s{i % 7}" if i % 5 else None, i) for i in range(n)]


def test_targets_and_taken_words(spark):
    docs = docs_of(400) + [(1000 + i, "a " * 40, "en", "hot", 0) for i in range(200)] + [(2000, "one", "en", "small", 0), (2001, None, None, "nothing", None), (2002, "", "en", "nothing", 0), (2003, "x " * 5000, "en", "Ärger", 0)]
    df = spark.createDataFrame(docs, DOCS)
    first = mixing.report(df).collect()
    assert len(first) == len(docs)
    taken, want = check(first, docs)
    assert all(abs(taken[s] - want[s]) < 1 for s in want)  # the boundary document gives a part
    again = mixing.report(df.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_every_row_of_a_source_shares_the_passes_and_one_threshold(spark):
    docs = docs_of(600)
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.measured(df)
    plan = {r._source: r for r in mixing.thresholds(rows.select(*mixing._ROW)).collect()}
    for r in mixing.take(rows.withColumns({"h": F.col("_hash"), "s": F.col("_source")}), mixing.thresholds(rows.select(*mixing._ROW))).collect():
        p = plan[r.s]
        if r.h < p._lo:
            assert r.taken == (p._passes + 1) * r.size
        elif r.h >= p._hi:
            assert r.taken == p._passes * r.size


def test_larger_budgets_hold_what_smaller_ones_take(spark):
    rows = mixing.measured(spark.createDataFrame(docs_of(300), DOCS)).select("doc_id", *mixing._ROW)
    got = [{r.doc_id: r.taken for r in mixing.take(rows, mixing.thresholds(rows, mixing.Mix((1,), share))).collect()} for share in (0.2, 0.5, 0.9)]
    for small, large in zip(got, got[1:]):
        assert all(small[k] <= large[k] for k in small)


def test_repeated_rows_share_the_boundary_in_proportion(spark):
    docs = [(1, "a b c d e f g h i j", "en", "only", 0)] * 900 + [(2, "p q", "en", "only", 0), (None, None, None, None, None)]
    taken, want = check(mixing.report(spark.createDataFrame(docs, DOCS)).collect(), docs)
    assert want["only"] == 1.5 * 9002


def test_empty_tables_and_clashing_columns(spark):
    assert mixing.report(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame(docs_of(50), DOCS).withColumns({c: F.lit("mine") for c in ("size", "target", "taken", "n", "copy", "_source", "_rest")})
    rows = mixing.measured(df)
    assert mixing.take(rows, mixing.thresholds(rows)).count() == 50
    assert all(r.size == 0 and r.taken == 0 and r.target == 0 for r in mixing.report(spark.createDataFrame([(1, "", "en", "a", 0), (2, None, None, None, None)], DOCS)).collect())


def test_the_mixture_has_the_words_that_are_taken(spark):
    docs = docs_of(200)
    df = spark.createDataFrame(docs, DOCS)
    words = defaultdict(int)
    for r in mixing.mixture(df).collect():
        words[r.doc_id] += len((r.text or "").split())
    assert dict(words) == {r.doc_id: r.taken for r in mixing.report(df).collect() if r.taken}


def test_no_python_runs(spark):
    plan = mixing.take(mixing.measured(spark.createDataFrame(docs_of(20), DOCS)), mixing.thresholds(mixing.measured(spark.createDataFrame(docs_of(20), DOCS))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
