"""The Jaccard join against brute force, and the guarantee of its signatures."""

import random
import re

import numpy as np
import pytest

from sparsewell.llm import ngramjoin, store
from sparsewell.llm.components import components
from sparsewell.llm.store import saved

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= 80 * (len(a) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 2:
            out.append(f"e{rng.randrange(10**6)}")
        elif x < rate * 0.75:
            continue
        else:
            out.append(w)
    return out


def corpus(seed):
    """Near copies of originals at many degrees, shared passages, exact copies, short texts."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = text(60), []
    for n in (8, 12, 40, 90, 150, 300):
        base = text(n)
        rows += [base] * rng.choice((0, 3)) + [edited(rng, base, rng.choice((0.01, 0.02, 0.03, 0.04, 0.05))) for _ in range(30)]
        rows += [base + text(k) for k in (1, n // 5, n // 4, n // 3)]
    rows += [passage + text(rng.randrange(0, 30)) for _ in range(30)]
    rows += [text(rng.randrange(0, 7)) for _ in range(20)] + [[]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, " ".join(r)) for i, r in zip(ids, rows, strict=True)]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 4), (2, 1), (3, 2), (4, 4), (5, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, frequent):
    """frequent: levels from 1 put all shared shingles into the class indexed by pairs."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngramjoin.linked_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(rows)


@pytest.mark.parametrize(("seed", "frequent", "hashes"), [(6, 4, 3), (7, 2, 10), (8, 1, 30)])
def test_components_of_crowded_lists(spark, monkeypatch, seed, frequent, hashes):
    """Every list is crowded, and classes are as light as can be."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "PAIRS", 0)
    monkeypatch.setattr(ngramjoin, "HEAVY", hashes)
    rows = corpus(seed)
    got = ngramjoin.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_sets_of_too_many_entries_go_the_first_way(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "PAIRS", 0)
    monkeypatch.setattr(ngramjoin, "ENTRIES", 3)
    rows = passages(150, edits=40, seed=3)
    got = ngramjoin.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def passages(n, edits=0, seed=1, stock=40, take=8, words=60):
    """Texts of 8 out of 40 passages, and copies of some with a word of a passage changed."""
    rng = random.Random(seed)
    every = [" ".join(f"p{i}w{j}" for j in range(words)) for i in range(stock)]
    rows = [(i, "\n".join(rng.sample(every, take))) for i in range(n)]
    for k in range(edits):
        own = rows[rng.randrange(n)][1].split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((n + k, " ".join(own)))
    return rows


def test_candidates_of_mixed_passages_do_not_grow_with_the_square(spark, monkeypatch):
    compared, verified = [], ngramjoin.verified

    def counted(pairs, sets):
        pairs = saved(pairs, "counted")
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(ngramjoin, "verified", counted)
    for edits in (0, 10):
        for n in (300, 600, 1200):
            rows = passages(n, n // 100 * edits)
            compared.clear()
            got = ngramjoin.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
            got = sorted(map(tuple, got.collect()))
            if n < 1200:
                assert got == brute_force(rows)
            # one pair a list that a set is in, and next to none of the second join
            assert compared[0] < 40 * n and sum(compared[1:]) < n / 4, (n, compared)


def test_linked_sets_share_an_entry():
    """Sets of classes at random, texts with parts of them lost: linked ones agree on a
    signature that leaves no more out than they differ by, if one of them promises it."""
    rng = np.random.default_rng(9)
    tried = 0
    for _ in range(3000):
        size = [int(x) for x in rng.integers(5, 60, 14)]
        stock = [{(c, k) for k in range(s)} for c, s in enumerate(size)]
        base = set().union(*(stock[c] for c in rng.choice(14, 8, replace=False)))
        lose = lambda: {t for t in base if rng.random() > rate}  # noqa: B023, E731
        rate = float(rng.choice([0.0, 0.03, 0.1]))
        x, y = lose(), lose()
        if rng.random() < 0.5:
            y |= stock[int(rng.integers(14))]
        if not x or 100 * len(x & y) < 80 * len(x | y):
            continue
        sides = []
        for s in (x, y):
            held = [(c, len(s & whole)) for c, whole in enumerate(stock)]
            own = [(c * 7919 + 1, size[c], 4 * h >= 3 * size[c]) for c, h in held if 4 * h > size[c] and size[c] * 2 * ngramjoin.HEAVY >= len(s)]
            sides.append(ngramjoin.class_signatures(own, len(s)))
        if None in sides or not (sides[0][1] or sides[1][1]):
            continue
        tried += 1
        both = sides[0][0].keys() & sides[1][0].keys()
        lost = [(sides[0][0][k], sides[1][0][k]) for k in both]
        assert any(9 * (p + q) <= 2 * (len(x) + len(y)) and (4 * p <= len(x) or 4 * q <= len(y)) for p, q in lost)
    assert tried > 300


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(base), " ".join([*base, "x"]), " ".join(["y", *base])
    rows = [(None, a), (9, b), (9, c), (9, "another text of the same number"), (None, "no other text is like this")]
    got = ngramjoin.linked_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in got.collect() if r.n_shingles > 9) == [(0, 56, 9), (9, 57, 9), (9, 57, 9)]
    assert {r.component_id for r in got.collect() if r.n_shingles == 2} == {None, 9}


def test_a_hub_with_shingles_of_its_own(spark):
    """No original is there, and what members share is mostly that they lack the hub's."""
    base = [f"b{i}" for i in range(100)]
    mix = lambda *cut, own=(): [w for i, w in enumerate(base) if i not in cut] + list(own)
    rows = [mix(own=[f"h{i}" for i in range(k)]) for k in (9, 12, 15)] + [mix(*range(k, k + 9), own=[f"o{k}{i}" for i in range(4)]) for k in range(0, 90, 3)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = ngramjoin.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(4, 700))
        base = rng.choice(2**62, n, replace=False).astype(np.uint64)
        level_of = dict(zip(base.tolist(), rng.integers(1, int(rng.choice([2, 5, 12])), n).tolist(), strict=True))
        sides = []
        for _ in range(2):
            drop, add = int(rng.integers(0, max(1, n // 9))), int(rng.integers(0, max(1, n // 9)))
            own = np.concatenate((rng.permutation(base)[: n - drop], rng.choice(2**62, add).astype(np.uint64)))
            sides.append(np.unique(own))
        a, b = sides
        same = len(np.intersect1d(a, b))
        if min(len(a), len(b)) < 4 or 100 * same < 80 * (len(a) + len(b) - same):
            continue
        levels = [np.array([level_of.get(x, 0) for x in s.tolist()], np.uint8) for s in sides]
        assert len(np.intersect1d(*(ngramjoin.signatures(s, v) for s, v in zip(sides, levels, strict=True))))


def test_components_of_a_graph(spark):
    rng = random.Random(4)
    ids = [rng.getrandbits(63) - 2**62 for _ in range(200)]
    edges = [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[70], ids[i]) for i in range(71, 120)] + [(ids[150], ids[150]), (ids[160], ids[161])]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, ([*ids[:61]], ids[70:120], ids[160:162])))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_texts_without_a_copy_give_no_postings_beside_many_copies(spark, monkeypatch):
    """The table of levels is far too small for the shingles of the copies, as it is at 6 GB."""
    monkeypatch.setattr(ngramjoin, "TABLE_BITS", 8)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for _ in range(60):
        words = [word() for _ in range(80)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "more"]))]
    alone = [(len(rows) + k, " ".join(word() for _ in range(80))) for k in range(40)]
    docs = spark.createDataFrame(rows + alone, "doc_id long, text string")
    tables = ngramjoin.frequency_table(docs, 200 * 77)
    post = ngramjoin.postings(docs, spark.sparkContext.broadcast(tables)).select("sid").distinct().count()
    assert post == len(rows)
    got = ngramjoin.linked_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_force(rows + alone)


def test_full_tables_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "TABLE_BITS", 4)
    monkeypatch.setattr(ngramjoin, "SEEN_BITS", (4, 4))
    rows = corpus(5)
    got = ngramjoin.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_bits_grow_with_the_corpus():
    """Of the check's tables 9 % of the shingles have a second document: at 6 GB (1.5 billion
    shingles) and 30 GB less than half of the bits are set."""
    for total in (125_000_000, 1_500_000_000, 7_500_000_000):
        assert 1 - np.exp(-0.0914 * total / 2 ** ngramjoin.seen_bits(total)) < 0.5


def test_only_tables_that_the_result_reads_stay(spark):
    """Later stages of the pipeline need not carry the others along."""
    own = store._written.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (3, "")]
    out = ngramjoin.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in own[before:]} <= {"ngram-sets", "ngram-links", "roots"}
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
