"""Token ids, files and counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparsewell.llm import tokenfile
from sparsewell.llm.pretokens import Cache, Pieces, default_tokenizer, encoder
from sparsewell.llm.tokencount import merger
from sparsewell.llm.wordhash import text_bytes

ALPHABET = "aaab'stredlvm0129 \t\n\x0b\x1c\x85\xa0  éÉéİIßẞΣσς漢字한가あ😀👩‍🔬.,;!?|<>$-_\"()٣²ⅣǅÅ"
ODD = ["", " ", "x <|endoftext|> y", "<|startoftext|><|endoftext|>", "AB<|ENDOFTEXT|>", "a<|b", "a" * 5000, "ab" * 3000, "'s't're'VE don't", "!'s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def texts():
    rng = random.Random(3)
    mixed = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(3000)]
    anything = ["".join(chr(rng.choice((rng.randrange(0x300), rng.randrange(0xD800), rng.randrange(0xE000, 0x1FFFF)))) for _ in range(12)) for _ in range(3000)]
    return ODD + mixed + anything


def test_ids_and_counts_equal_the_library(library):
    t = texts()
    want = [e.ids for e in library.encode_batch(t, add_special_tokens=False)]
    data, at = text_bytes(pa.array(t))
    ids, bounds = encoder(default_tokenizer()).encode(data, at)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    assert merger(default_tokenizer()).count(data, at).tolist() == [len(w) for w in want]


def test_a_full_cache_starts_anew(monkeypatch):
    from sparsewell.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE", 8)
    cache = Cache(lambda ts: (np.array([len(t) for t in ts]), np.ones(len(ts), np.int64)))
    for k in range(6):
        t = [f"{'x' * (k + 1)} {'y' * (2 * k + 1)} {'z' * 3}"]
        data, at = text_bytes(pa.array(t))
        p = Pieces(data, at)
        first, _ = cache.resolve(p)
        assert cache.values[first].tolist() == (p.stop - p.start).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50000), st.integers(0, 3), st.integers(2**20, 2**31 - 1)), min_size=1, max_size=700))
def test_blocks_round_trip(ids):
    x = np.array(ids, np.int64)
    x = np.concatenate((x, np.full(-len(x) % tokenfile.BLOCK, x[0])))
    blocks = tokenfile.encode_blocks(x)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1]))
    assert tokenfile.decode_blocks(b"".join(blocks), starts).tolist() == x.tolist()


def test_outliers_do_not_widen_a_block():
    x = np.arange(256) % 4
    x[7] = 10**6
    assert len(tokenfile.encode_blocks(x)[0]) == tokenfile.HEAD.size + 32 * 2 + 5


def test_any_document_is_read_alone(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49408, n).astype(np.int32) for n in (1, 0, 700, 255, 256, 3, 5000)]
    w = tokenfile.Writer(f"file://{tmp_path}")
    for part in (docs[:3], docs[3:]):
        w.add(np.arange(len(part)), np.zeros(len(part), bool), np.concatenate(part), np.array([len(d) for d in part]))
    w.close()
    r = tokenfile.Reader(w.uri)
    assert (r.n_docs, r.n_tokens) == (7, sum(map(len, docs)))
    for i, d in enumerate(docs):
        assert r.ids(i, i + 1).tolist() == d.tolist()


def test_files_hold_all_documents_in_order(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 500)
    rows = [(i, t) for i, t in enumerate(texts()[:400])]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read(tokenfile.write(docs)).collect()}
    start = 0
    for i, t in [*sorted(rows), (1000, "")]:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
