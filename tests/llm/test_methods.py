"""Language paths, mixing, quality distances, licence phrases, archives and the pipeline."""

import io
import itertools
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard
from comparing import SMALL

from sparsewell.llm import langid, licenses, mixing, quality, queries, warc
from sparsewell.llm.scripts import SCRIPTS
from sparsewell.llm.store import release, saved, scratch

MEDIUM = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- language ID


def cost(e, path, switch):
    return sum(e[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in itertools.pairwise(path))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(30):
        e = -rng.exponential(6, (6, 3))
        best = max(cost(e, p, 5.0) for p in itertools.product(range(3), repeat=6))
        assert math.isclose(cost(e, langid.viterbi(e, 5.0), 5.0), best)


def test_the_shortcut_changes_nothing():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], np.ones((3, langid.BUCKETS)), np.ones((3, len(SCRIPTS))))
    for _ in range(40):
        bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 25, 12))))
        e = -rng.exponential(4, (bounds[-1], 3))
        e[:, 0] += rng.exponential(2)
        e -= e.max(axis=1, keepdims=True)
        path = model.paths(e, bounds, 6.0)
        for a, b in itertools.pairwise(bounds):
            if b > a:
                assert math.isclose(cost(e[a:b], path[a:b], 6.0), cost(e[a:b], langid.viterbi(e[a:b], 6.0), 6.0))


def test_held_out_accuracy_and_no_peeking(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = queries.queries()["op9_language_id"](spark, MEDIUM).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert 100 < len(held) < 300 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_mixed_text_is_labelled_in_spans(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = langid.learn(docs)
    one = {r.lang: r.text for r in docs.where("n_chars between 600 and 900").orderBy("doc_id").collect()}
    text = one["en"] + "\n" + one["de"] + "\n" + one["en"]
    row = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row.lang_pred == "en" and [s.lang for s in row.spans][:: len(row.spans) - 1] == ["en", "en"]
    assert "de" in {s.lang for s in row.spans} and row.score < 1


# ---------------------------------------------------------------- mixing


def test_targets_by_hand(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 40)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    sizes, weights = {"a": 10, "b": 100, "c": 1000, None: 40}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:  # give by weight, cut at twice the size, share what is over again
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            want |= share
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= full
    assert got == pytest.approx(want)


def brute_taken(docs):
    """Words taken of every document, slot by slot and word by word."""
    m = mixing.mix(docs).collect()
    t = {r.source: r for r in mixing.targets(mixing.sizes(docs)).collect()}
    total = sum(r.source_size for r in t.values())
    block = mixing.block_words(total, len(t))
    order = sorted(t.values(), key=lambda r: r.sid)
    cum = np.cumsum([r.target for r in order]) / sum(r.target for r in order)
    taken = {s: Counter() for s in t}
    rank = Counter()
    for j in range(-(-int(1.5 * total) // block)):
        u = (j + 1) * mixing.GOLDEN % 1
        r = order[min(int(np.searchsorted(cum, u, "right")), len(order) - 1)]
        n_blocks = -(-r.source_size // block)
        if rank[r.source] < 2 * n_blocks:
            taken[r.source][rank[r.source] % n_blocks] += 1
        rank[r.source] += 1
    at, want = Counter(), {}
    for r in sorted(m, key=lambda r: (r.place, r.doc_id, r.size)):
        words = range(at[r.source], at[r.source] + r.size)
        want[r.doc_id] = sum(taken[r.source][w // block] for w in words)
        at[r.source] += r.size
    for s, r in t.items():  # sources far from their targets are settled word by word
        own = [x for x in sorted(m, key=lambda x: (x.place, x.doc_id, x.size)) if x.source == s]
        if abs(sum(want[x.doc_id] for x in own) - r.target) > mixing.NEAR * r.target:
            times, first = divmod(math.floor(r.target + 0.5), max(r.source_size, 1))
            for x in own:
                want[x.doc_id] = times * x.size + max(0, min(x.size, first))
                first -= x.size
    return want, m, t, block


def copies(size, taken):
    return max(1, math.floor(taken / size + 0.5)) if taken else 0


def test_taken_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), f"s{rng.randrange(3)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, m, t, block = brute_taken(docs)
    assert {r.doc_id: r.taken for r in m} == want
    for s, r in t.items():
        assert abs(sum(x.taken for x in m if x.source == s) - r.target) <= max(0.02 * r.target, 4 * block)
    kept = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in kept} == {r.doc_id: copies(r.size, r.taken) for r in m if r.taken}


def test_every_stretch_of_the_schedule_has_the_shares(spark):
    shares = spark.createDataFrame([(0, 60.0), (1, 30.0), (2, 10.0), (3, 0.0)], "sid int, target double")
    s = mixing.schedule(spark, shares, 1, 5000).toPandas().sort_values("slot")
    assert s.slot.tolist() == list(range(5000))
    for lo in range(0, 5000, 500):
        n = s.sid[lo : lo + 500].value_counts()
        assert abs(n[0] - 300) <= 5 and abs(n[1] - 150) <= 5 and abs(n[2] - 50) <= 5
    for _, g in s.groupby("sid"):
        assert g["rank"].tolist() == list(range(len(g)))


# ---------------------------------------------------------------- quality


def js(p, q):
    h = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (h(p, q) + h(q, p)) / 2))


def test_distances_by_hand(spark, monkeypatch):
    """Two languages, their common words and shares counted by hand; the nearest counts."""
    monkeypatch.setattr(quality, "MIN_REFERENCE", 1)
    monkeypatch.setattr(quality, "MAX_REPEAT", 100)  # short texts that repeat themselves are references here
    texts = {"en": "The cat and the dog of the house. " * 150 + "ZEBRA 99 %% of the zoo!\n" * 3, "xx": "um dois tres quatro cinco seis " * 180 + "7"}
    rows = [(1, texts["en"], "en"), (2, texts["xx"], "xx"), (3, "the cat and the dog um dois zoo! " * 12, None), (4, "seis um cinco " * 80, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    words, classes = {}, {}
    kind = lambda c: next((k for k, (_, p) in enumerate(quality.CLASSES) if re.fullmatch(p.replace(r"\p{L}", r"[^\W\d_]"), c)), len(quality.CLASSES))
    for lang in texts:
        own = [t for _, t, x in rows if x == lang]
        n, df = Counter(w for t in own for w in t.split()), Counter(w for t in own for w in set(t.split()))
        top = sorted(df, key=lambda w: (-df[w], w))[: quality.COMMON]
        words[lang] = top, [n[w] / sum(n.values()) for w in top]
        c = Counter(kind(ch) for t in own for ch in t)
        classes[lang] = [c[k] / sum(c.values()) for k in range(len(quality.CLASSES) + 1)]
    for i, t, _ in rows:
        n, c = Counter(t.split()), Counter(map(kind, t))
        word = []
        for top, shares in words.values():
            p = [n[w] / sum(n.values()) for w in top]
            word.append(js([*p, max(0, 1 - sum(p))], [*shares, max(0, 1 - sum(shares))]))
        assert got[i].word_distance == pytest.approx(min(word), abs=1e-6)
        share = [c[k] / len(t) for k in range(len(quality.CLASSES) + 1)]
        assert got[i].class_distance == pytest.approx(min(js(share, q) for q in classes.values()), abs=1e-6)


def test_languages_without_a_reference_are_judged_by_the_base_rule(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    word = {"it": "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita".split()}
    word["ru"] = "\u0431\u0443\u0440\u044f \u043c\u0433\u043b\u043e\u044e \u043d\u0435\u0431\u043e \u043a\u0440\u043e\u0435\u0442 \u0432\u0438\u0445\u0440\u0438 \u0441\u043d\u0435\u0436\u043d\u044b\u0435 \u043a\u0440\u0443\u0442\u044f \u0442\u043e \u043a\u0430\u043a \u0437\u0432\u0435\u0440\u044c \u043e\u043d\u0430".split()
    add = [(900 + i, " ".join(rng.choice(w) for _ in range(200)), lang) for i, (lang, w) in enumerate(word.items())]
    # many texts of a language make its reference, and then it is judged by it
    add += [(910 + i, " ".join(rng.choice(word["it"]) for _ in range(200)), "its") for i in range(20)]
    noise = [(950, " ".join(f"q{rng.randrange(999)}" for _ in range(300)), "its"), (951, " ".join(f"q{rng.randrange(999)}" for _ in range(300)), None)]
    got = {r.doc_id: r for r in quality.judge(docs.unionByName(spark.createDataFrame(add + noise, docs.schema))).collect()}
    for i, t, _ in add:
        assert got[i].kept or got[i].base_failed, t
    assert all(got[i].kept for i in (900, 901)) and not any(got[i].kept or got[i].base_failed for i in (950, 951))


def test_common_words_of_all_rows(spark):
    """60 words of close counts in 6,000 rows: a sample of them has another order."""
    rows = [(i, " ".join(f"w{j}" for j in range(60) if (i * 7919 + j * 104729) % 1009 < 480 + j), "en") for i in range(6000)]
    n = Counter(w for _, t, _ in rows for w in set(t.split()))
    got = quality.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == {"en": sorted(n, key=lambda w: (-n[w], w))[: quality.COMMON]}


def test_common_words_of_a_sample(spark, monkeypatch):
    """A language of more rows than the sample: the rows of the least hashes are counted."""
    import hashlib

    monkeypatch.setattr(quality, "SAMPLE_ROWS", 30)
    rows = [(i, " ".join(f"w{i % 7} x{i}" for _ in range(60)), "en") for i in range(90)] + [(None, "z " * 5000, "en")]
    got = quality.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n: Counter = Counter()
    for i, t, _ in rows[:-1]:
        if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) < (30 << 32) // 90:
            n.update(set(t.split()))
    assert got == {"en": sorted(n, key=lambda w: (-n[w], w))[: quality.COMMON]}


def test_base_counts_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.judge(docs).collect():
        t = text[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{MEDIUM}/documents.parquet")).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & ~got.base_failed].kept.all()
    junk = got[(got.quality == 0) & ~got.base_failed & (got.n_words >= 150)]
    assert junk.kept.mean() < 0.5


# ---------------------------------------------------------------- licences


def test_base_phrases_by_brute_force(spark):
    rng = random.Random(8)
    bits = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "CC BY", "All Rights Reserved.", "é", "x-y", "General\nPublic LICENSE"]
    rows = [(i, rng.choice((" ", "  ", "\t")).join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[r.doc_id][1].translate(lower))
        hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


# ---------------------------------------------------------------- archives


def test_bundle_is_plain_zstd_with_a_seek_table(tmp_path):
    w = warc.Writer(f"file://{tmp_path}")
    data = [warc.record(f"urn:x:{i}", i, f"http://h/{i}", f"<p>{i}</p>".encode() * 9000, "0" * 64, None) for i in range(12)]
    at = [w.add(d) for d in data]
    w.close()
    raw = open(w.uri.removeprefix("file://"), "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(data)
    assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE_MAGIC
    r = warc.Reader(w.uri)
    assert len(r.sizes) > 2
    for (frame, offset), d in reversed(list(zip(at, data, strict=True))):
        assert r.frame(frame)[offset : offset + len(d)] == d
    fields, http, payload = warc.parse(data[3])
    assert payload == b"<p>3</p>" * 9000 and int(http["Content-Length"]) == len(payload) and fields["WARC-Type"] == "response"


def test_records_by_their_identifiers(spark):
    """Equal rows have identifiers of their own; a page longer than many frames is whole."""
    long = "<p>long page</p>" * 400_000
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "v", "x" * 200), (3, "w", long), (3, "w", long), (None, None, None)]
    index = saved(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string")), "index")
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(rows) and all(x.startswith("urn:uuid:") for x in ids)
    every = {r.record_id: r for r in warc.read(index).collect()}
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in every.values()) == [(0, 0, "response"), (1, 200, "response"), (1, 200, "response"), (2, 200, "revisit"), (3, len(long), "response"), (3, len(long), "response")]
    for x in ids[:3]:
        assert warc.lookup(index, [x]).collect() == [every[x]]


# ---------------------------------------------------------------- scratch tables


def test_scratch_of_one_result_goes(spark):
    with scratch(spark, keep=("kept-",)):
        gone, kept = saved(spark.range(3), "probe"), saved(spark.range(4), "kept")
        path = gone.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 4
    with pytest.raises(FileNotFoundError):
        open(path)


def test_scratch_tables_are_released(spark):
    t = saved(spark.range(3), "probe")
    path = t.inputFiles()[0].removeprefix("file://")
    release(spark)
    with pytest.raises(FileNotFoundError):
        open(path)
