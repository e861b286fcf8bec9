import hashlib
import re

from rasterloom.llm import line_dedup as d

LONG = "  This Line is shared by very many Documents, verbatim.\t"


def key(line):
    k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def slow(rows, min_docs=5):
    held = {}
    for n, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held.setdefault(key(line), {})[n] = doc
    gone = {k: max((d for d in v.values() if d is not None), default=None) for k, v in held.items() if len(k) >= 40 and len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    out = [(i, f"line of its own {i}\n{LONG}\n\n{LONG.strip().upper() if i % 2 else LONG}\r\nend é {i}") for i in range(12)]
    out += [(20, None), (21, ""), (22, "\n\n"), (23, LONG * 200), (24, "short shared line\n" * 3), (3, LONG), (3, LONG), (3, LONG + "\nmore"), (None, LONG), (None, LONG), (None, None)]
    four = "A line of at least forty code points in four documents"
    return out + [(30 + i, f"{four}\nÀÉÎ is not lower-cased but ABC is, in this long line") for i in range(4)] + [(40 + i, "àÉÎ is not lower-cased but ABC is, in this long line") for i in range(4)]


def test_lines_match_brute_force(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    done = d.deduplicated(df)
    got = done.select("doc_id", F.size("line_list"), F.size("line_list") - F.size("kept"), F.sha2(F.array_join("kept", "\n"), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == slow(rows())


def test_query_matches_brute_force(spark, sf):
    from rasterloom.llm.queries import op6_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op6_line_dedup(spark, sf).collect()]
    assert sorted(got, key=repr) == slow(docs)


def test_stage_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(i, LONG + f"\nown {i}", "en", "s", 5, "k") for i in range(6)] + [(9, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    out = d.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {r.doc_id: (r.text, r.n_chars, r.kept) for r in out.collect()}
    assert texts[0] == ("own 0", 5, "k") and texts[5][0] == LONG + "\nown 5" and texts[9] == (None, None, None)
    assert d.without_repeats(docs.limit(0)).count() == 0


def test_batches_meet_the_runs_of_earlier_ones(spark):
    make = lambda xs: spark.createDataFrame([(i, f"{'a long line that repeats in several batches'} {x}") for i, x in enumerate(xs)], "doc_id long, text string")
    new = d.first_seen(spark, [make([1, 2, 2]), make([2, 3]), make([1, 3, 4]), make([5]), make([4, 5, 6])])
    assert [df.select("h1").distinct().count() for df in new] == [2, 1, 1, 1, 1]


def test_runs_hold_each_key_once_and_count_later_batches(spark):
    runs = d.LineRuns(spark)
    make = lambda xs: spark.createDataFrame([(i, x, x, True) for i, x in xs], "doc_id long, h1 long, h2 long, first boolean")
    for b in ([(1, 1), (2, 1), (3, 2)], [(4, 2), (5, 3)]):
        runs.add(make(b))
    assert [sorted(r.h1 for r in run.keys.collect()) for run in runs.runs()] == [[1, 2], [3]]
    assert sorted((r.h1, r.n_docs, r.last_doc) for run in runs.runs() for r in run.whole().collect()) == [(1, 2, 2), (2, 2, 4), (3, 1, 5)]
    runs.add(make([(6, 1), (7, 3), (8, 4), (9, 4)]))
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(make([(10, 5), (11, 4), (None, 1)]))
    assert sorted((r.h1, r.n_docs, r.last_doc) for run in runs.runs() for r in run.whole().collect()) == [(1, 4, 6), (2, 2, 4), (3, 2, 7), (4, 3, 11), (5, 1, 10)]
    assert sorted(r.h1 for r in runs.held(3).collect()) == [1, 4]


def test_runs_are_merged_as_they_lie(spark):
    from pyspark.sql import functions as F

    runs = d.LineRuns(spark)
    make = lambda a, b: spark.range(a, b).select("id", F.xxhash64("id").alias("h1"), F.xxhash64("id", "id").alias("h2"), F.lit(True).alias("first"), F.col("id").alias("doc_id"))
    for a in (0, 500, 1000, 1500):
        runs.add(make(a, a + 700))
    batch = d.bucketed(d.counted(make(1900, 2600)), "line-batch", d.KEY, runs.buckets)
    from rasterloom.llm.common import reading_in_order

    with reading_in_order(spark):
        for df in (runs.new_only(batch), runs.held(1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert runs.new_only(batch).count() == 400 and runs.held(1).count() == 2200


def test_levels_compact(spark):
    runs = d.LineRuns(spark, fan_in=2)
    for n in range(4):
        df = spark.createDataFrame([(n, f"one long line that every batch holds {'x' * 10}"), (n + 10, f"and another one of batch {n} {'y' * 20}")], "doc_id long, text string")
        runs.add(d.keyed_lines(df))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(r.n_docs for r in runs.runs()[0].whole().collect()) == [1, 1, 1, 1, 4]


def test_long_documents_of_shared_lines_take_linear_time(spark):
    import time

    text = "\n".join(f"line {i} that all of these documents hold, every one" for i in range(20_000))
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").repartition(6)
    began = time.time()
    from pyspark.sql import functions as F

    assert sorted(r[0] for r in d.deduplicated(docs).select(F.size("kept")).collect()) == [0, 0, 0, 0, 0, 20_000]
    assert time.time() - began < 60


def test_no_table_and_no_setting_is_left(spark):
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before, tables = spark.conf.get(key, None), {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, f"one long line that every document of this table holds\nline {i} of its own, which is long as well") for i in range(60)], "doc_id long, text string")
    assert d.deduplicated(docs, batches=5).where("size(kept) < 2").count() == 59
    batches = [docs.where(f"doc_id % 4 = {k}") for k in range(4)]
    assert [x.count() for x in d.first_seen(spark, batches)][1:] == [15, 15, 15]
    assert spark.conf.get(key, None) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_only_rows_that_may_lose_lines_are_set_apart(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    gone = docs.where("doc_id % 40 = 3 or doc_id is null").withColumnRenamed("doc_id", "_doc")
    told = d._with_maybe(docs, gone)
    assert told.where("(doc_id % 40 = 3 or doc_id is null) and not _maybe").count() == 0
    assert told.where("_maybe").count() <= 101 + 4
    shared = "one long line that every third document of this table holds, word for word"
    table = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, shared).otherwise(F.concat(F.lit("a line that is long enough but stands alone, "), F.col("doc_id").cast("string"))))
    done = d.deduplicated(table)
    assert done.count() == 4001 and done.where("size(kept) < size(line_list)").count() == 1333
    assert spark.createDataFrame([], "doc_id long, text string").transform(d.deduplicated).count() == 0
