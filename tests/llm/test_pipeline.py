import importlib
import zlib

import corpus_pipeline

from .test_decontaminate import slow as slow_leaks
from .test_line_dedup import key
from .test_packing import ids_of
from .test_simhash import slow_components, slow_fp


def without_repeats(rows):
    """(doc_id, text) with long lines that five documents share left in the last of them only."""
    held = {}
    for n, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held.setdefault(key(line), {})[n] = doc
    last = {k: max(v.values()) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    return [(doc, None if text is None else "\n".join(x for x in text.split("\n") if last.get(key(x), doc) == doc)) for doc, text in rows]


def one_of_each(rows):
    fp = {doc: slow_fp(text) for doc, text in rows}
    root = slow_components(set(fp.values()))
    low = {}
    for doc, f in fp.items():
        low[root[f]] = min(low.get(root[f], doc), doc)
    return [(doc, text) for doc, text in rows if low[root[fp[doc]]] == doc]


def test_stages_match_brute_force(spark, sf):
    from rasterloom.llm.common import materialize, table

    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    known = materialize(stages["language_id"](spark, docs, sf), "language")
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    assert len(rows) >= 0.97 * docs.where("text rlike '[A-Za-z]'").count()
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    for name, slow in (("line_dedup", without_repeats), ("simhash_dedup", one_of_each), ("decontamination", lambda rows: [r for r in rows if r[0] not in {d for d, *_ in slow_leaks(rows, items)}])):
        before, rows = rows, slow(rows)
        assert rows != before
        known = materialize(stages[name](spark, known, sf), name)
        assert sorted((r.doc_id, r.text) for r in known.collect()) == rows
    texts = dict(rows)
    pieces = {}
    for r in stages["packing"](spark, known, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids, at = ids_of(texts[doc]), 0
        for start, length, crc in sorted(found):
            assert start == at and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + length])) == crc
            at += length
        assert at == len(ids)


def test_columns_of_other_stages_keep_their_values(spark, sf):
    long = "a line that is long enough to count and stands in many documents"
    texts = {i: f"{long}\nand a line of number {i} {'very ' * 30_000 if i == 3 else ''}with words of its own, number {i * i}" for i in range(1, 8)}
    extra = "score double, rejected boolean, lang_pred string, fp string, component_id string, item_id string, row string, drop string, kept string, h1 string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), i + 0.5, True, *("abcdefgh")) for i, t in texts.items()], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf)
    got = {r.doc_id: r for r in docs.collect()}
    assert got and all((r.score, r.rejected, *r[7:]) == (i + 0.5, True, *"abcdefgh") and (r.n_chars == len(r.text)) for i, r in got.items())


def test_stages_keep_the_columns_and_pack_what_is_left(spark, sf):
    from rasterloom.llm.common import materialize, table

    docs = table(spark, sf, "documents")
    names, columns, counts = [n for n, _ in corpus_pipeline.STAGES], docs.columns, [docs.count()]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_stand_nulls_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0), (2, "words and more words of a text", "en", None, 3, None), (2, "words and more words of a text", "en", None, 3, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            assert name == "packing" or out.columns == docs.columns


def test_entry_registers_all_queries():
    entry = importlib.import_module("__spark_entry__")
    found = set(entry.queries())
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= found
