"""License scans: a positional rare-token index over licence notices.

The words of the notices are indexed with their positions and weighed by inverse document
frequency over the notices.  A notice's share in a text is the part of its IDF mass, over
its distinct words, that stands in the text at one shift from where it stands in the
notice (shifts are taken in cells of ``STEP`` words on two overlapping grids, so small
insertions do not hide it).  A notice gives its label if its share is ``MIN_SHARE`` at
least and one of its mandatory key phrases stands in the text as consecutive words.

Only the highest-IDF words are looked up at first.  Of each notice, those of highest IDF
that hold ``RARE_MASS`` of its mass are its rare ones; as the others hold the rest, a notice
can reach its share only where rare words of mass ``MIN_SHARE + RARE_MASS - 1`` agree on a
shift.  The postings of a text's rare words are intersected by shift; the notices that pass
are the candidates, and only for them, and for texts with other labels, all words are looked
up.  No notice is lost that way.

Phrases that name a licence give its label too, wherever they stand as consecutive words;
a name that is not in ``NAMES`` (as "MIT" alone) gives none.  The score is the largest
share of any notice in a text with a label, so a mention alone has a small one.

Defined cases: a null or blank text has no words, no labels and score 0; equal rows each
give a row; an empty table gives an empty result; further columns are ignored.  Texts
are handled whole, one partition at a time; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .licensetexts import BASE, NAMES, TEMPLATES
from .store import dealt
from .wordhash import ALPHANUMERIC, Words, hash_word, pieces

STEP, MIN_SHARE, RARE_MASS = 8, 0.5, 0.75


def _hashes(phrase: str) -> np.ndarray:
    return np.array([hash_word(w) for w in phrase.split()], np.uint64)


class Index:
    """Postings of every notice word: notice, position; IDF of each word; rare words."""

    def __init__(self, templates: dict[str, tuple[str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE, names: dict[str, str] = NAMES):
        self.labels = list(templates)
        self.base = [(_hashes(p), label) for p, label in base.items()]
        self.names = [(_hashes(p), label) for p, label in names.items()]
        self.keys = [[_hashes(p) for p in phrases] for _, phrases in templates.values()]
        rows = [(h, t, i) for t, (text, _) in enumerate(templates.values()) for i, h in enumerate(_hashes(text).tolist())]
        h = np.array([r[0] for r in rows], np.uint64)
        order = np.argsort(h, kind="stable")
        self.template, self.at = (np.array([r[k] for r in rows])[order] for k in (1, 2))
        self.terms, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        term = np.repeat(np.arange(len(self.terms)), self.count)
        pairs = np.unique(np.stack((self.template, term)), axis=1)
        self.idf = np.log(1 + len(templates) / np.bincount(pairs[1], minlength=len(self.terms)))
        self.mass = np.bincount(pairs[0], self.idf[pairs[1]], len(templates))
        # of each notice, the highest-IDF words that hold RARE_MASS of its mass
        rare = np.zeros((len(templates), len(self.terms)), bool)
        for t in range(len(templates)):
            own = pairs[1][pairs[0] == t]
            own = own[np.argsort(-self.idf[own], kind="stable")]
            rare[t, own[: int(np.searchsorted(np.cumsum(self.idf[own]), RARE_MASS * self.mass[t])) + 1]] = True
        self.rare_mass = (rare * self.idf).sum(axis=1)
        self.rare_posting = rare[self.template, term]
        self.rare_term = rare.any(axis=0)
        phrases = [p for p, _ in self.base + self.names] + [k for ks in self.keys for k in ks]
        self.wanted = np.unique(np.array([p[0] for p in phrases], np.uint64))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are licence words, and their term."""
        i = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return self.terms[i] == h, i

    def aligned(self, terms: np.ndarray, places: np.ndarray, doc: np.ndarray, rare: bool) -> tuple[np.ndarray, np.ndarray]:
        """(text, notice) pairs as text * notices + notice, and the largest IDF mass of
        distinct words that agree on a shift.  rare: over rare words of the notice only."""
        if rare:
            own = self.rare_term[terms]
            terms, places, doc = terms[own], places[own], doc[own]
        n = self.count[terms]
        post = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        term, shift, pair = np.repeat(terms, n), np.repeat(places, n) - self.at[post], np.repeat(doc, n) * len(self.labels) + self.template[post]
        if rare:
            own = self.rare_posting[post]
            term, shift, pair = term[own], shift[own], pair[own]
        found, best = np.zeros(0, np.int64), np.zeros(0)
        for grid in (0, STEP // 2):
            cell = (shift + grid) // STEP
            order = np.lexsort((term, cell, pair))
            p, c, t = pair[order], cell[order], term[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
            once = new.copy()
            once[1:] |= t[1:] != t[:-1]
            mass = np.bincount(np.cumsum(new) - 1, np.where(once, self.idf[t], 0.0)) if len(p) else np.zeros(0)
            found, best = np.concatenate((found, p[new])), np.concatenate((best, mass))
        pairs, at = np.unique(found, return_inverse=True)
        out = np.zeros(len(pairs))
        np.maximum.at(out, at, best)
        return pairs, out

    def candidates(self, terms: np.ndarray, places: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(text, notice) pairs whose share may reach ``MIN_SHARE``, by their rare words."""
        pairs, mass = self.aligned(terms, places, doc, rare=True)
        of = pairs % len(self.labels)
        return pairs[mass >= self.rare_mass[of] - (1 - MIN_SHARE) * self.mass[of] - 1e-9]


def phrase_starts(h: np.ndarray, doc: np.ndarray, starts: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Those of ``starts`` (places of the phrase's first word) where all its words stand
    consecutively in one text."""
    last = starts + len(phrase) - 1
    s = starts[last < len(h)]
    s = s[doc[s] == doc[s + len(phrase) - 1]]
    for k in range(1, len(phrase)):
        s = s[h[s + k] == phrase[k]]
    return s


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, tuple[str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE, names: dict[str, str] = NAMES) -> DataFrame:
    """One row a document: places of base phrases, labels, and score, the largest share of
    a notice (0 without labels)."""

    def rows(batches):
        index = Index(templates, base, names)
        for batch in batches:
            for part, data, at in pieces(batch):
                yield _scan_piece(index, part, data, at)

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def _scan_piece(index: Index, part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    words = Words(data, at, ALPHANUMERIC)
    h, doc, bounds, n = words.hash, words.doc, words.bounds, part.num_rows
    known, term = index.lookup(h)
    spots = np.flatnonzero(np.isin(h, index.wanted))
    spots = spots[np.argsort(h[spots], kind="stable")]
    heads = h[spots]
    starts = lambda p: phrase_starts(h, doc, spots[np.searchsorted(heads, p[0]) : np.searchsorted(heads, p[0], "right")], p)
    n_base, first, last = np.zeros(n, np.int64), np.full(n, len(h)), np.full(n, -1)
    base_labels: list[set[str]] = [set() for _ in range(n)]
    labels: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in index.base:
        s = starts(phrase)
        np.add.at(n_base, doc[s], 1)
        np.minimum.at(first, doc[s], s)
        np.maximum.at(last, doc[s], s)
        for d in np.unique(doc[s]):
            base_labels[d].add(label)
            labels[d].add(label)
    for phrase, label in index.names:
        for d in np.unique(doc[starts(phrase)]):
            labels[d].add(label)
    own = np.flatnonzero(known)
    place = own - bounds[doc[own]]  # in the text, so that cells hang on no other text
    hopeful = index.candidates(term[own], place, doc[own])
    look = np.zeros(n, bool)  # texts of which all words are looked up
    look[[d for d in range(n) if labels[d]]] = True
    look[hopeful // len(index.labels)] = True
    score = np.zeros(n)
    place, own = place[look[doc[own]]], own[look[doc[own]]]
    pairs, mass = index.aligned(term[own], place, doc[own], rare=False)
    of, share = pairs % len(index.labels), np.minimum(1.0, mass / index.mass[pairs % len(index.labels)])
    np.maximum.at(score, pairs // len(index.labels), share)
    for t in np.unique(of[share >= MIN_SHARE]):
        full = set((pairs[(of == t) & (share >= MIN_SHARE)] // len(index.labels)).tolist())
        for phrase in index.keys[t]:
            for d in full.intersection(doc[starts(phrase)].tolist()):
                labels[d].add(index.labels[t])
    score[[d for d in range(n) if not labels[d]]] = 0.0
    none = n_base == 0
    mask = lambda x: pa.array(x - bounds[:-1], pa.int64(), mask=none)
    joined = lambda sets: pa.array([",".join(sorted(x)) for x in sets], pa.string())
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(n_base), mask(first), mask(last), joined(base_labels), joined(labels), pa.array(score)],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
