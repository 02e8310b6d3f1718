"""License scans against brute force over every shift of every notice."""

import math
import random
import re

import pytest
from comparing import SMALL

from sparsewell.llm import licenses
from sparsewell.llm.licensetexts import BASE, NAMES, TEMPLATES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICES = {k: t.split() for k, (t, _) in TEMPLATES.items()}
DF = {w: sum(w in set(t) for t in NOTICES.values()) for t in NOTICES.values() for w in t}
IDF = {w: math.log(1 + len(NOTICES) / n) for w, n in DF.items()}


def stands(w, phrase):
    p = phrase.split()
    return any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))


def share(w, notice):
    at: dict[str, list[int]] = {}
    for i, x in enumerate(notice):
        at.setdefault(x, []).append(i)
    cells: dict[tuple[int, int], set[str]] = {}
    for p, x in enumerate(w):
        for i in at.get(x, ()):
            for grid in (0, licenses.STEP // 2):
                cells.setdefault((grid, (p - i + grid) // licenses.STEP), set()).add(x)
    return max((sum(IDF[x] for x in c) for c in cells.values()), default=0.0) / sum(IDF[x] for x in set(notice))


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels = {label for p, label in (BASE | NAMES).items() if stands(w, p)}
    shares = {k: share(w, t) for k, t in NOTICES.items()}
    labels |= {k for k, (_, keys) in TEMPLATES.items() if shares[k] >= licenses.MIN_SHARE and any(stands(w, p) for p in keys)}
    return ",".join(sorted(labels)), min(1.0, max(shares.values())) if labels else 0.0


def agrees(spark, texts):
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        labels, score = brute(t)
        assert got[i].labels == labels, t
        assert got[i].score == pytest.approx(score), t
    return [got[i] for i in range(len(texts))]


def test_damaged_notices_by_brute_force(spark):
    """Whole notices, cut ones, with words lost, changed and put in, amid other words."""
    rng = random.Random(21)
    filler = [*"a of the in text with words".split(), *(f"f{i}" for i in range(30))]
    texts = []
    for name, (t, _) in TEMPLATES.items():
        w = t.split()
        texts += [t, t.upper().replace(" ", ", "), " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]
        for rate in (0.03, 0.1, 0.3):
            v = [x for x in w if rng.random() > rate]
            for _ in range(int(len(v) * rate)):
                v.insert(rng.randrange(len(v)), rng.choice(filler))
            texts.append(" ".join([rng.choice(filler) for _ in range(rng.randrange(40))] + v + [rng.choice(filler) for _ in range(20)]))
        texts.append(t + " and then " + TEMPLATES[rng.choice(list(TEMPLATES))][0])
        assert brute(t)[0].split(",").count(name) == 1
    rows = agrees(spark, texts)
    assert sum(bool(r.labels) for r in rows) > len(texts) / 2
    whole = [r for r, t in zip(rows, texts, strict=True) if t in {t for t, _ in TEMPLATES.values()}]
    assert len(whole) == len(TEMPLATES) and all(r.score == pytest.approx(1) for r in whole)


def test_names_and_plain_mentions(spark):
    texts = ["// SPDX-License-Identifier: MIT", "This project is licensed under the MIT License.", "licensed under the BSD license", "CC0", "Licensed under CC BY-NC-SA 4.0", "Eclipse Public License", "mit", "all rights reserved", None, "", "GNU General Public License"]
    rows = agrees(spark, texts)
    assert [r.labels for r in rows] == ["mit", "mit", "bsd", "cc0-1.0", "cc-by,cc-by-nc,cc-by-nc-sa", "epl-2.0", "", "reserved", "", "", "gpl"]
    assert all(0 < r.score < 0.5 for r in rows if r.labels and r.labels not in ("epl-2.0", "cc-by,cc-by-nc,cc-by-nc-sa"))


def test_equal_rows_and_a_long_text(spark):
    text = "filler words " * 60_000 + TEMPLATES["isc"][0] + " more" * 1000
    rows = agrees(spark, [text, text])
    assert [r.labels for r in rows] == ["isc", "isc"] and rows[0].score == rows[1].score == pytest.approx(1)


def test_a_whole_table_by_brute_force(spark):
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    assert any(r.labels for r in agrees(spark, docs))
