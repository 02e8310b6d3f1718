"""The pipeline against the same stages done by hand, document by document."""

import random
import re
import zlib

import numpy as np
import pytest
from languages import Brute
from test_methods import brute_taken, copies
from test_ngramjoin import brute_force
from tokenizers import Tokenizer

import corpus_pipeline
from sparsewell.llm import langid
from sparsewell.llm.pretokens import default_tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").toPandas()
    rng = random.Random(12)
    rows = docs.values.tolist()
    texts = [r[1] for r in rows]
    add = [texts[3], texts[3] + " one more word", "12 34 %% ++", None, "", texts[5], "before " + bench.text[0] + " after", bench.text[1], "\u6f22\u5b57 " * 40]
    add += [" ".join(w if rng.random() > 0.01 else "changed" for w in t.split(" ")) for t in texts[:40]]
    rows += [[10_000 + i, t, rng.choice(("en", None)), rng.choice(("src1", "extra", None)), len(t or "")] for i, t in enumerate(add)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    brute = Brute([(r.doc_id, r.text, r.lang) for r in docs.collect()])
    rows = [r for r in docs.collect() if brute.predict(r.text)[1] >= langid.MIN_SCORE]
    assert 10_002 not in {r.doc_id for r in rows} and len(rows) < docs.count()
    keep = {d for d, _, c in brute_force([(r.doc_id, r.text) for r in rows]) if d == c}
    assert len(keep) < len(rows) - 30
    rows = [r for r in rows if r.doc_id in keep]
    cut = lambda t: re.findall(WORDS, (t or "").translate(LOWER))
    items = [cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(max(1, len(w) - 12)) if w}
    clean = []
    for r in rows:
        w = cut(r.text)
        hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not hit:
            clean.append(r)
    assert len(clean) < len(rows)
    want, m, _, _ = brute_taken(spark.createDataFrame(clean, docs.schema))
    size = {r.doc_id: r.size for r in m}
    library, out, start = Tokenizer.from_file(default_tokenizer()), [], 0
    for r in sorted(clean, key=lambda r: r.doc_id):
        for _ in range(copies(size[r.doc_id], want[r.doc_id])):
            ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
            out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    return out


def test_pipeline_equals_stages_by_hand(spark, sf_dir):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == by_hand(spark, sf_dir)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_stages_take_a_very_long_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"word{i % 9973}" for i in range(300_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " end", "en", "s", len(long)), (3, "a short text in the table", "en", "s", 20)]
    table = spark.createDataFrame(rows, docs.schema)
    joined = corpus_pipeline.join_similar(spark, table, sf_dir)
    assert sorted(r.doc_id for r in joined.collect()) == [1, 3]
    for stage in (corpus_pipeline.identify, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        assert {len(r.text) for r in stage(spark, table, sf_dir).collect()} >= {len(long), len(long) + 4}
    got = {r.doc_id: r for r in corpus_pipeline.tokens(spark, table, sf_dir).collect()}
    ids = [*Tokenizer.from_file(default_tokenizer()).encode(long, add_special_tokens=False).ids, 2]
    assert got[1].n_tokens == len(ids) and got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
