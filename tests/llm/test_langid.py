"""Language identification against plain Python, and texts in scripts of no language."""

import random
import zlib

import pytest
from comparing import SMALL
from languages import Brute

from sparsewell.llm import langid

GEORGIAN = "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით "
RUSSIAN = "все люди рождаются свободными и равными в своем достоинстве и правах "


def predicted(spark, docs, add=()):
    table = docs.unionByName(spark.createDataFrame(list(add), docs.schema)) if add else docs
    return langid.predict(table, langid.learn(docs)).collect()


def test_languages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(5)
    mixed = [" ".join(t[:rng.randrange(40, 200)] for _, t, _ in rng.sample(rows, 3)) for _ in range(40)]
    odd = [GEORGIAN * 5, RUSSIAN, "漢字", "the house of " + GEORGIAN, "é", "été", "́", "12 + 34", "", None, "word" * 5000, "ﬁn Ⅷ ª", "🙂 the 🙂 of"]
    add = [(5000 + i, t, None) for i, t in enumerate(mixed + odd)]
    brute, texts = Brute(rows), {d: t for d, t, _ in rows + add}
    for r in predicted(spark, docs, add):
        lang, score = brute.predict(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6), texts[r.doc_id]


def test_the_score_falls_where_no_language_reaches_the_script(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    add = [(5000, GEORGIAN * 5, None), (5001, RUSSIAN * 5, None), (5002, "the house and the " * 9 + GEORGIAN, None)]
    got = {r.doc_id: r for r in predicted(spark, docs, add)}
    assert got[5000].lang_pred in ("de", "en", "es", "fr") and got[5000].score == got[5001].score == 0
    assert got[5002].lang_pred == "en" and 0.3 < got[5002].score < 0.7
    model = langid.learn(docs)
    assert [r.doc_id for r in langid.identified_documents(spark.createDataFrame(add, docs.schema), model).collect()] == [5002]


def test_languages_by_script(spark):
    rows = [(i, (GEORGIAN, RUSSIAN, "all human beings are born free and equal ")[i % 3] * 3, ("ka", "ru", "en")[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    (row,) = (r for r in predicted(spark, docs, [(99, RUSSIAN + "born free and equal human beings are " * 2 + GEORGIAN * 2, None)]) if r.doc_id == 99)
    assert [s.lang for s in row.spans] == ["ru", "en", "ka"] and row.lang_pred == "ka"


def test_of_equal_languages_the_first_counts(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % langid.FOLDS][:8]
    rows = [(i, "same words here", "ba"[k % 2]) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Brute(rows).predict("same words here") == ("a", pytest.approx(0.5))
    for r in predicted(spark, docs):
        assert (r.lang_pred, r.score) == ("a", pytest.approx(0.5))
