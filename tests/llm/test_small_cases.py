"""Nulls, blanks, ties, repeats, extra columns and empty tables for every operator."""

import pytest

from sparsewell.llm import decontam, langid, licenses, linededup, mixing, ngramjoin, quality, tokencount, tokenfile, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, line int, block string, hashes string"
LONG = " ".join(f"w{i % 997}" for i in range(5000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "fr", "b"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (None, "licensed under cc by terms", "en", None),
    (None, None, None, None),
    (7, LONG, "en", "c"),
    (8, "Ünïcödé 漢字 😀 !!! " * 30, "de", "b"),
    (9, "x" * 20000, None, "c"),
    (7, "a second text of the same number", "en", "c"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, "s", 3, "b", "h") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def bench(spark, rows=((1, "the quick brown fox"), (2, None), (None, "lazy dog"), (3, ""), (1, "over the lazy"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def langs(docs):
    return langid.predict(docs, langid.learn(docs))


OPERATORS = {
    "linededup": linededup.dedup_lines,
    "tokenfile": lambda d: tokenfile.read(tokenfile.write(d)),
    "ngramjoin": ngramjoin.linked_components,
    "quality": quality.judge,
    "decontam": lambda d: decontam.contamination(d, bench(d.sparkSession)),
    "tokencount": tokencount.count_tokens,
    "mixing": mixing.mix,
    "langid": langs,
    "licenses": licenses.scan,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_per_document(docs, name):
    out = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == sorted((r[0] is None, r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


def by_id(rows, i):
    return [r for r in rows if r.doc_id == i]


def test_similar_documents(docs):
    out = ngramjoin.linked_components(docs).collect()
    assert {r.component_id for r in by_id(out, 1) + by_id(out, 5)} == {1}
    assert [(r.n_shingles, r.component_id) for r in by_id(out, 2) + by_id(out, 3) + by_id(out, 4)] == [(0, 2), (0, 3), (0, 4)]
    assert [r.n_shingles for r in by_id(out, 9)] == [1]


def test_representatives(docs):
    kept = ngramjoin.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [i for n, i, _ in ids if not n] == [1, 2, 3, 4, 7, 7, 8, 9]
    assert sum(n for n, _, _ in ids) == 2


def test_contamination(docs, spark):
    out = decontam.contamination(docs, bench(spark)).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in by_id(out, 1)} == {(7, 1, True)}
    assert {(r.n_words, r.n_hit, r.contaminated) for r in by_id(out, 2)} == {(0, 0, False)}
    nothing = decontam.contamination(docs, bench(spark, [(1, None)])).collect()
    assert not any(r.contaminated for r in nothing)
    assert decontam.clean_documents(docs, bench(spark)).count() == len(ROWS) - 3


def test_blocks_of_a_benchmark(docs, spark, monkeypatch):
    key = lambda rows: sorted(map(repr, rows))
    one = key(decontam.contamination(docs, bench(spark)).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 12)
    assert key(decontam.contamination(docs, bench(spark)).collect()) == one
    monkeypatch.setattr(decontam, "MAX_TERMS", 2)
    assert key(decontam.contamination(docs, bench(spark)).collect()) == one


def test_languages(docs):
    out = langs(docs).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for i in (2, 3, 4) for r in by_id(out, i))
    assert all(0 <= r.score <= 1 for r in out)
    blank = langs(docs.where("lang is null")).collect()
    assert {r.lang_pred for r in blank} == {"und"}


def test_quality(docs):
    out = quality.judge(docs).collect()
    assert {(r.n_words, r.base_failed, r.kept) for i in (2, 3, 4) for r in by_id(out, i)} == {(0, True, False)}


def test_mixing(docs):
    out = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r.size and (r.size or not r.taken) for r in out)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, out))


def test_licenses(docs):
    out = licenses.scan(docs).collect()
    (row,) = [r for r in out if r.base_labels]
    assert (row.doc_id, row.n_base, row.first_word, row.last_word, row.base_labels) == (None, 1, 2, 2, "cc-by")
    assert {(r.n_base, r.first_word, r.labels, r.score) for r in by_id(out, 2)} == {(0, None, "", 0.0)}


PAGES = "page_id long, url string, html string, digest string, salt int, head long"


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/ b", big), (1, None, big), (1, None, big), (None, "u", big), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", "é\r\n\r\n" * 50)]
    pages = spark.createDataFrame([(*r, "d", 0, 9) for r in rows], PAGES)
    out = warc.read(warc.write(pages)).collect()
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in out)
    assert got == [(0, 203, "revisit", 1), (1, 203, "response", None), (1, 203, "response", None), (3, 203, "revisit", 1), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 300, "response", None)]
    assert warc.read(warc.write(pages.where("false"))).collect() == []
