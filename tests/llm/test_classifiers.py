import base64
import random
import zlib

import numpy as np

from rasterloom.llm import langid, toxicity

SYLLABLES = {"xx": "ka lo mi ne ru ta vo".split(), "yy": "sch ung ein ich acht wer".split(), "zz": "eau oui tre que ment lle".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_languages_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(4, 80)), lang, "s") for i, lang in enumerate(sorted(SYLLABLES) * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.where("doc_id % 4 <> 0"))
    out = langid.identify(docs, model).collect()
    held = [r for r in out if r.doc_id % 4 == 0]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) == 0
    clash = docs.selectExpr("doc_id", "text", "lang", "doc_id + 0.5D as score", "doc_id % 2 = 0 as rejected", "'mine' as lang_pred")
    known = langid.known_language(clash, clash)
    assert known.columns == clash.columns and {tuple(r) for r in known.collect()} == {tuple(r) for r in clash.collect()}


def test_odd_texts_are_und_or_rejected(spark):
    rng = random.Random(2)
    train = spark.createDataFrame([(prose(rng, lang, 40), lang) for lang in sorted(SYLLABLES) * 20] + [(None, "xx"), ("no lang", None), ("", "yy")], "text string, lang string")
    model = langid.fit(train)
    rows = [(1, None), (2, ""), (3, "123 ... %%%"), (4, "Привет это совсем другой язык и буквы"), (5, prose(rng, "xx", 3)), (None, prose(rng, "yy", 30)), (7, prose(rng, "zz", 20000)), (8, "½ ² Ⅻ ٣ ③"), (9, prose(rng, "xx", 30)), (9, prose(rng, "xx", 30))]
    rows[-1] = rows[-2]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(out[i].lang_pred, out[i].score, out[i].rejected) for i in (1, 2, 3, 8)] == [("und", 0.0, True)] * 4
    assert out[4].rejected and out[4].lang_pred in SYLLABLES
    assert (out[5].lang_pred, out[5].rejected, out[None].lang_pred, out[7].lang_pred) == ("xx", False, "yy", "zz")


ITALIAN = "Il governo italiano ha annunciato nuove misure per sostenere le famiglie e le imprese colpite dalla crisi. Secondo il ministro gli aiuti saranno distribuiti entro la fine del mese prossimo, ma molti cittadini restano scettici e chiedono maggiore trasparenza nella gestione dei fondi pubblici."
FINNISH = "Hallitus on ilmoittanut uusista toimenpiteistä, joilla tuetaan perheitä ja yrityksiä kriisin keskellä. Ministerin mukaan tuki jaetaan ensi kuun loppuun mennessä, mutta monet kansalaiset suhtautuvat siihen epäilevästi ja vaativat enemmän avoimuutta julkisten varojen käytössä."
CODE = "static int parse(const char *buf, size_t len) { for (size_t i = 0; i < len; i++) { if (buf[i] == 0) { return (int)i; } struct node *n = malloc(sizeof(*n)); if (!n) return -1; n->next = head; head = n; } return 0; }"


def test_unseen_languages_and_lettered_junk_are_rejected_and_held_out_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 4 <> 0"))
    rng = random.Random(6)
    junk = [ITALIAN, FINNISH, CODE, base64.b64encode(rng.randbytes(600)).decode(), rng.randbytes(400).hex(), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=600))]
    assert model.predict(junk)[2].tolist() == [True] * len(junk)
    held = [r.text for r in docs.where("doc_id % 4 = 0 and text is not null").collect()]
    assert np.mean(model.predict(held)[2]) < 0.02
    short = [t[:80].rsplit(" ", 1)[0] for t in held if len(t) > 80]
    assert np.mean(model.predict(short)[2]) < 0.03


def test_ties_and_dirty_labels_give_one_model(spark):
    rng = random.Random(3)
    same = prose(rng, "xx", 40)
    rows = [(same, "xx")] * 30 + [(same, "yy")] * 30 + [(prose(rng, "zz", 40), "zz") for _ in range(30)] + [(prose(rng, "yy", 9), f"dirty {i}") for i in range(40)]
    train = spark.createDataFrame(rows, "text string, lang string")
    cfg = langid.LangConfig(max_langs=3)
    models = [langid.fit(train.repartition(n), cfg) for n in (1, 5)]
    assert sorted(set(models[0].langs)) == ["xx", "yy", "zz"] and all(np.array_equal(a, b) for a, b in zip(*((m.idf, m.centroids, m.limits) for m in models)))
    assert models[0].predict([same])[0] == ["xx"]


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert out == {1: ("und", False), 2: ("und", True)}
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def test_language_query_on_held_out_rows(spark, sf):
    from rasterloom.llm.queries import op1_language_id

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op1_language_id(spark, sf).collect()
    assert len(out) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out if r.held_out]) > 0.9


def kernel_slow(a, b, cfg):
    """Common subsequences of three symbols of two windows, all with their gaps."""

    def weights(s):
        out = {}
        for i in range(min(len(s), cfg.window)):
            for j in range(i + 1, min(len(s), i + cfg.span)):
                for k in range(j + 1, min(len(s), i + cfg.span)):
                    u = (s[i], s[j], s[k])
                    out[u] = out.get(u, 0) + cfg.decay ** (k - i - 2)
        return out

    x, y = weights(a), weights(b)
    norm = cfg.window * sum(cfg.decay ** (2 * (b - 2)) for a in range(1, cfg.span) for b in range(a + 1, cfg.span))
    return sum(w * y.get(u, 0) for u, w in x.items()) / norm


def test_kernel_equals_the_plain_definition():
    cfg = toxicity.ToxConfig()
    stretches, marks = ["idiot", "an idxiot of", "banana", "thonreth ab", "ab", "éèàab é", "long stretch beyond the window"], ["idiot", "reeth on", "nana", "éàb é"]
    rows = [toxicity.windows_of([toxicity._codes(t) for t in x], cfg) for x in (stretches, marks)]
    got = toxicity._kernel(rows[0], *toxicity._landmark_table(rows[1], cfg), cfg)
    cut = lambda t: toxicity._codes(t).tolist()[: cfg.window + cfg.span - 1]
    assert np.allclose(got, [[kernel_slow(cut(a), cut(b), cfg) for b in marks] for a in stretches], atol=1e-5)


def test_decision_values_equal_sums_over_windows_of_sentences():
    rng = np.random.default_rng(7)
    cfg = toxicity.ToxConfig()
    model = toxicity.ToxModel(cfg, rng.normal(size=64**3).astype(np.float32), -0.5, 1.0, 0.0)
    cube = model.weights.reshape(64, 64, 64)
    cube[0], cube[:, 0], cube[:, :, 0] = 0, 0, 0
    norm = (cfg.window * sum(cfg.decay ** (2 * (b - 2)) for a in range(1, cfg.span) for b in range(a + 1, cfg.span))) ** 0.5
    texts = ["Some words. Others follow! a b c d, then\nthe end", None, "", "x", "no.stop inside a.word? yes", "word " * 40]
    want = []
    for t in texts:
        best = 0.0
        for s in toxicity.SENTENCE.split((t or "").lower()):
            c = toxicity._codes(s).tolist()
            here = [sum(cfg.decay ** (b - 2) / norm * float(model.weights[(c[i] * 64 + c[i + a]) * 64 + c[i + b]]) for a in range(1, cfg.span) for b in range(a + 1, cfg.span) if i + b < len(c)) for i in range(len(c))]
            best = max([best, *(sum(here[i : i + cfg.window]) for i in range(len(here)))])
        want.append(best - 0.5)
    assert np.allclose(model.values(texts), want, atol=1e-4)


def corpus(rng, n):
    bad = ["idiot", "moron", "worthless", "pathetic"]
    out = []
    for i in range(n):
        w = prose(rng, rng.choice(sorted(SYLLABLES)), rng.randint(10, 60)).split()
        if i % 3 == 0:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_insults_are_told_with_inserted_characters(spark):
    rng = random.Random(4)
    rows = corpus(rng, 600)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    held = corpus(rng, 200)
    odd = [(1000, "ka lo i.d.i.o.t mi", 1), (1001, "ka lo m o r o n ta", 1), (1002, "ka iddiot lo mi ne", 1), (1003, "PATHETIC", 1)]
    clean = [(2000, None, 0), (2001, "", 0), (2002, "a b c d e", 0), (2003, "katalo " * 30000, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in held + odd + clean], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = {i: y for i, _, y in held + odd + clean}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == y for i, y in truth.items()]) > 0.98
    assert all(got[i] >= 0.7 for i, _, _ in odd) and all(got[i] < 0.7 for i, _, _ in clean)


def test_letters_between_lone_signs_and_wrong_labels():
    rng = random.Random(9)
    rows = corpus(rng, 600)
    rows += [(600 + i, prose(rng, "xx", 20) + f" {w}", 0) for i, w in enumerate(["idiot", "moron", "worthless", "pathetic"])]
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], toxicity.ToxConfig())
    score = lambda *texts: model.score(model.values(list(texts)))
    assert (score("ka lo idiot mi", "ka moron ta", "worthless ka", "mi pathetic", "ka lo i - d - i - o - t mi", "ka m * o * r * o * n ta", "ka path etic lo") >= 0.7).all()
    assert (score("ka - -", "i d i o t") >= 0.7).tolist() == [False, True]
    assert (score("ka lo mi", "- - - - - -", "ka - lo - mi - ne - ru", "") < 0.7).all()


def test_scores_depend_on_the_text_alone(spark):
    rng = random.Random(10)
    rows = corpus(rng, 300)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    texts = ["i d i o t", "ends in a", "i d i o t", "", "x", "m o r o n.", None, "i d i", "o t"] * 3 + [t for _, t, _ in rows[:40]]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    runs = [{r.doc_id: r.score for r in toxicity.score(docs.repartition(n).sortWithinPartitions(order), model).collect()} for n, order in ((1, "doc_id"), (8, "text"), (3, "doc_id"))]
    assert runs[0] == runs[1] == runs[2] == {i: float(model.score(model.values([t]))[0]) for i, t in enumerate(texts)}
    assert len({s for i, s in runs[0].items() if texts[i] == "i d i o t"}) == 1


def test_toxicity_query_on_held_out_rows(spark):
    from rasterloom.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = op3_toxicity(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    caught = sum(p and t for p, t in held)
    assert caught / sum(t for _, t in held) >= 0.88 and caught / sum(p for p, _ in held) >= 0.7


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "some text here"), (None, None)], "doc_id long, text string")
    for rows in ([], [("only clean text", 0)], [("x", None)]):
        model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
        assert [r.score < 0.7 for r in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), model).count() == 0


ENGLISH = "the quick brown fox and the other animals were walking through the forest when it began to rain on them"
GERMAN = "der schnelle Fuchs und die anderen Tiere gingen durch den Wald als es anfing zu regnen und sie nass wurden"


def test_rows_with_one_text_count_once_in_the_language_sample(spark):
    from pyspark.sql import functions as F

    same = spark.range(10_000).select(F.lit(ENGLISH).alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(same)
    assert set(model.langs) == {"en"} and model.predict([ENGLISH])[0] == ["en"]
    german = spark.createDataFrame([(f"{GERMAN} {i} {GERMAN[i : i + 40]}", "de") for i in range(50)], "text string, lang string")
    model = langid.fit(same.unionByName(german))
    assert set(model.langs) == {"en", "de"} and model.predict([ENGLISH, GERMAN, ENGLISH[20:60]])[0] == ["en", "de", "en"]


def test_stages_run_on_a_table_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(ENGLISH).alias("text"), F.lit("en").alias("lang"))
    assert langid.known_language(docs, docs).count() == 2_000


def test_predictions_are_those_of_the_nearest_centroid(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.select("text").collect() if r.text and langid.has_letter(r.text)][:80]
    langs, score, _ = model.predict(texts)
    for text, lang, value in zip(texts, langs, score):
        counts = langid.counts_of([text], len(model.idf))[0].astype(float)
        x = np.array(langid.vectors_of([text], model.idf))[0].astype(float)
        near = [float(x @ c) / np.linalg.norm(c) for c in model.centroids.astype(float)]
        best = int(np.argmax(near))
        assert model.langs[best] == lang and abs(min(max(near[best], 0), 1) - value) < 1e-4
        assert abs(np.linalg.norm(x) - 1) < 1e-4 and ((x > 0) == (counts > 0)).all()


def test_rows_with_one_text_count_once_in_the_toxicity_sample(spark):
    from pyspark.sql import functions as F

    same = spark.range(10_000).select(F.lit("you are a complete blorkhead, go away").alias("text"), F.lit(1).alias("toxic"))
    rng = random.Random(2)
    words = "sun rain walk talk house green river stone bread water light paper".split()
    clean = spark.createDataFrame([(" ".join(rng.choices(words, k=12)), 0) for _ in range(50)], "text string, toxic int")
    model = toxicity.fit(same.unionByName(clean))
    scores = model.score(model.values(["what a blorkhead", "you are a complete blorkhead, go away", "river stone and green bread"]))
    assert scores[1] > scores[2]
