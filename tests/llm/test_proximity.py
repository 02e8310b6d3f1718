"""Proximity matches of benchmark items against brute force over every place."""

import random
import re

import pytest

from sparsewell.llm import decontam


def brute_near(text, item, slop=decontam.SLOP):
    """Is there a place of the item's first word around which enough words are near?"""
    d, w = (re.findall(r"[a-z0-9]+", t.lower()) for t in (text or "", item or ""))
    if len(set(w)) < 3:
        return False
    at = {x: [p for p, y in enumerate(d) if x == y] for x in set(w)}
    near = lambda s, j: any(abs(p - s - j) <= slop for p in at[w[j]])
    return any(100 * sum(near(s, j) for j in range(len(w))) >= decontam.NEAR_PERCENT * len(w) for s in range(-len(w) - slop, len(d) + slop + 1))


def counted(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id: r.n_near for r in decontam.contamination(docs.coalesce(1), bench).collect()}


def test_a_match_stays_within_its_document(spark):
    assert counted(spark, ["u v w alpha", "alpha x beta y gamma", "beta gamma"], ["alpha beta gamma"]) == {0: 0, 1: 1, 2: 0}


def test_edges_of_the_slop(spark):
    gap = lambda n: " ".join(["x"] * n)
    item = "a b c d e"
    texts = [f"a b c d {gap(k)} e" for k in (0, 7, 8, 9, 15, 16, 17, 18)] + [f"a b c {gap(40)} d e", f"a b c {gap(4)} d"]
    got = counted(spark, texts, [item])
    assert got == {i: int(brute_near(t, item)) for i, t in enumerate(texts)}
    assert {got[0], got[8]} == {0, 1}


@pytest.mark.parametrize("shard", [80, 1 << 22])
def test_proximity_by_brute_force(spark, monkeypatch, shard):
    """Small vocabulary, so words repeat in items and texts; results hang on no shard."""
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
    rng = random.Random(14)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60))}"
    items = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(25)]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 120))) for _ in range(30)]
    for _ in range(60):  # items with words lost, moved and put in
        w = rng.choice(items).split()
        w = [x for x in w if rng.random() > rng.choice((0.05, 0.2, 0.3))]
        for _ in range(rng.randrange(12)):
            w.insert(rng.randrange(len(w) + 1), word())
        texts.append(" ".join([word() for _ in range(rng.randrange(9))] + w + [word() for _ in range(rng.randrange(9))]))
    want = {i: sum(brute_near(t, x) for x in items) for i, t in enumerate(texts)}
    assert sum(map(bool, want.values())) > 20
    assert counted(spark, texts, items) == want
