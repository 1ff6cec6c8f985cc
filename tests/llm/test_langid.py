import numpy as np
from helpers import documents, empty, odd, table

from byteloom.llm import langid as L


def test_held_out_accuracy(spark):
    rows = [(r.lang, r.text) for r in documents(spark, "/root/testdata/sf0.01").select("lang", "text").collect()]
    model = L.fit(rows[:600])
    named, sure = L.Scorer(L.packed(model)).identify([t for _, t in rows[600:]])
    assert np.mean([a == b for a, (b, _) in zip(named, rows[600:])]) > 0.97
    assert L.UNKNOWN not in named and all(0 < s <= 1 for s in sure)


def test_many_words_at_once_score_as_one_by_one(spark):
    rows = [(r.lang, r.text) for r in documents(spark).select("lang", "text").collect()]
    model = L.fit(rows[:100])
    own = sorted({w for _, t in rows[100:140] for w in L.words(t) if w.isalpha()}) + ["x", "é", "zzzqqq", "日本", "a" * 5000, "ñ"]
    s = L.Scorer(L.packed(model))
    s.identify([" ".join(own)])
    for w in own:
        row, known = L.word_scores(model, w)
        assert np.allclose(s.rows[s.at[w]], [*row, known, 1])
    assert L.words("ab12cd_é 345") == ["ab", "cd", "é"]
    s.identify(["²"])
    assert not s.rows[s.at["²"]].any()


def test_unseen_words_back_off():
    model = L.fit([("aa", "banana banana cabana"), ("bb", "whistle whistle thistle")])
    assert model["words"].keys() == {"banana", "whistle"}
    assert L.word_scores(model, "banana")[1] == 1
    for word, lang in (("cabanas", "aa"), ("bristle", "bb"), ("xxcab", "aa")):
        row, _ = L.word_scores(model, word)
        assert model["langs"][int(np.argmax(row))] == lang
    assert L.word_scores(model, "ωψφ") == ((0.0, 0.0), 0.0)


def test_odd_rows(spark):
    got = {(r.doc_id, r.rejected, r.language) for r in L.detect(odd(spark)).collect()}
    assert L.detect(odd(spark)).count() == 14
    assert {(i, r) for i, r, _ in got} >= {(1, False), (3, True), (4, True), (8, True), (9, True), (11, False), (None, True), (None, False)}
    assert all((lang == L.UNKNOWN) == rejected for _, rejected, lang in got)
    kept = L.keep_known(odd(spark))
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} >= {1, 2, 11, None}
    assert not {r.doc_id for r in kept.collect()} & {3, 4, 5, 8, 9}


def test_without_labels_and_empty(spark):
    from pyspark.sql import functions as F

    assert L.detect(empty(spark)).collect() == [] and L.keep_known(empty(spark)).collect() == []
    assert all(r.rejected for r in L.detect(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect())


def test_clean_documents_stay(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    assert L.keep_known(docs).count() == docs.count()


def test_sample_is_never_empty(spark):
    from pyspark.sql import functions as F

    # a share below 1 in 1,000,000, as 4,000 of more than 4e9 documents
    docs = spark.range(60_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("uma frase curta").alias("text"), F.lit("pt").alias("lang"))
    try:
        assert L.fit_on(docs, "doc_id", "text", "lang", max_labelled=0.05)["langs"] == ["pt"]
    except ValueError:
        pass  # never in silence
    for n in (10**10, 10**15):
        assert abs((L.below(4000 / n) + (1 << 63)) / 2**64 * n - 4000) < 1
    assert L.below(1.0) == (1 << 63) - 1


def test_rare_languages_and_few_labels(spark):
    rows = [(i, f"the river runs near the old town {i}", "en" if i % 2 else None, "a") for i in range(2000)] + [(5000 + i, "Волк бежит через лес к реке", "ru", "a") for i in range(2)]
    docs = table(spark, rows)
    got = {r.doc_id: r.language for r in L.detect(docs, max_labelled=40).collect()}
    assert got[5000] == got[5001] == "ru" and got[0] == "en"
    # 1 in 100 rows has a label: the sample is of those
    few = table(spark, [(i, f"word{'abcdefghij'[i % 10]} of text", "en" if i % 100 == 0 else None, "a") for i in range(3000)])
    assert L.fit_on(few, "doc_id", "text", "lang", max_labelled=30)["words"]
    same = table(spark, [(7, "уже было", "ru", "a")] * 300 + [(1, "one two", "en", "a")])
    assert L.fit_on(same, "doc_id", "text", "lang", max_labelled=2)["langs"] == ["en", "ru"]


def test_detect_against_brute_force(spark):
    """Sums, rejection, confidence and the named language, document by document, from the scores of single words."""
    import math

    docs = documents(spark)
    extra = table(spark, [(9001, "", "en", None), (9002, None, "en", None), (9003, "12 34", "en", None), (9004, "日本語", "de", None)]).select("doc_id", "text", "lang")
    docs = docs.select("doc_id", "text", "lang").union(extra)
    model = L.fit_on(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in L.detect(docs).collect()}
    for r in docs.collect():
        own = [w for w in L.words(r.text or "") if w.isalpha()]
        scores = [L.word_scores(model, w) for w in own]
        sums = [math.fsum(s[k] for s, _ in scores) for k in range(len(model["langs"]))]
        known = sum(k for _, k in scores)
        g = got[r.doc_id]
        if not own or known < L.MIN_KNOWN * len(own) or max(sums) - min(sums) < 1e-12:
            assert (g.language, g.confidence, g.rejected) == (L.UNKNOWN, 0.0, True)
            continue
        best = max(range(len(sums)), key=lambda k: sums[k])
        assert not g.rejected and g.language == model["langs"][best]
        assert abs(g.confidence - 1 / sum(math.exp((s - sums[best]) / len(own)) for s in sums)) < 1e-9


def test_a_tie_of_two_languages_goes_to_the_first(spark):
    rows = [(k, f"same word here again {x}", lang, None) for k, (x, lang) in enumerate([("uno uno", "es"), ("uno uno", "pt"), ("drei vier", "de")])]
    docs = table(spark, [*rows, (9, "uno uno uno", None, None)])
    assert {r.doc_id: r.language for r in L.detect(docs).collect()}[9] == "es"
