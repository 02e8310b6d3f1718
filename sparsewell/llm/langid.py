"""Language identification of mixed-language text.

Each word is scored for each language by the log-likelihood of its byte n-grams (1 to 4
bytes, word ends marked).  The script of a word, by ranges of code points, narrows its
candidates to languages written in that script; other languages are out of reach by a
fixed margin.  A Viterbi pass over the words of a text, with a penalty for each switch of
language, labels spans.  The text's language is the one whose spans hold most letters (of
equal ones the first in order), letters of scripts that no language is written in not
counted, if there are others.

The score is the share of all the text's letters that were counted for that language, times
how sure it is against the others.

The Viterbi pass is skipped only where it provably changes nothing: if no stretch of
words gains more for other languages than its switches cost, the best single language
is the best path.

The n-gram counts are sums over labelled rows, a sample of at most about
``SAMPLE_ROWS`` rows a language chosen by a hash of the id (all rows, if there are no
more); rows whose crc32(doc_id as text) is a multiple of 5 are held out.

Defined cases: a null text, or one with no letters, is ``und`` with score 0; a null
doc_id is neither learned from nor held out; a text in a script of no language gets the
best language by n-grams, with score 0; of equally good languages the first in order counts;
with nothing to learn from, every text is ``und``; equal rows each give a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import packed, unpacked
from .scripts import SCRIPTS, LetterWords
from .store import dealt
from .wordhash import Words, pieces

FOLDS, SAMPLE_ROWS = 5, 4000
BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: Log-likelihood a switch costs, and by which a word keeps languages of other scripts off.
SWITCH, MARGIN = 12.0, 30.0
#: Share of a language's words from which a script is one of its own.
SCRIPT_SHARE = 0.01
SMOOTH = 0.5
#: A document of a lower score has no language that can be relied on.
MIN_SCORE = 0.3
PREDICTED = "doc_id long, lang_pred string, score double, spans array<struct<first_word:int,last_word:int,lang:string>>"

_U = np.uint64


def grams(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the given words, and the word each is of.  Every word is
    set between two blanks; n-grams hold blanks at their ends only."""
    size = stops - starts
    ends = np.cumsum(size + 1)
    buf = np.full(int(ends[-1]) + 1 if len(ends) else 1, 0x20, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    buf[1 + np.repeat(ends - size - 1, size) + within] = raw[np.repeat(starts, size) + within]
    of = np.repeat(np.arange(len(size)), size + 1)
    blank, found = buf == 0x20, []
    for n in ORDERS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, _U)
        for k in range(n):
            code = code * _U(257) + buf[k : k + m]
        inner = np.zeros(m, bool)
        for k in range(1, n - 1):
            inner |= blank[k : k + m]
        if n < 3:
            inner = blank[:m] if n == 1 else blank[:m] & blank[1 : 1 + m]
        ok = np.flatnonzero(~inner)
        h = code[ok] * _U(0x9E3779B97F4A7C15)
        own = np.where(blank[ok], np.minimum(ok, len(of) - 1), np.maximum(ok - 1, 0))
        found.append(((h >> _U(48)).astype(np.int64), of[own]))
    return np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64), np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """An example of each distinct word, and which of them each word is."""
    _, sample, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    return sample, inverse


class Model:
    """langs; logp[language, bucket]; reach[language, script]."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).T.astype(np.float32).copy()
        self.reach = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)

    def reached(self, words: LetterWords) -> np.ndarray:
        """Which words are in a script of some language."""
        return self.reach.any(axis=0)[words.script]

    def scores(self, words: LetterWords) -> np.ndarray:
        """Per word and language; the mean over the orders, so a byte counts about once."""
        sample, inverse = distinct(words)
        bucket, word = grams(words.bytes, words.start[sample], words.stop[sample])
        s = np.empty((len(sample), len(self.langs)))
        for k in range(len(self.langs)):
            s[:, k] = np.bincount(word, self.logp[bucket, k], len(sample)) / len(ORDERS)
        can = self.reach[:, words.script[sample]].T
        s -= MARGIN * (~can & can.any(axis=1, keepdims=True))
        return (s - s.max(axis=1, keepdims=True))[inverse] if len(s) else s

    def paths(self, e: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """Language of each word on its text's best path."""
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        total = np.add.reduceat(np.vstack((e, np.zeros((1, e.shape[1])))), np.minimum(bounds[:-1], len(e)), axis=0)
        best = np.where(n > 0, total.argmax(axis=1), 0)
        path = best[doc]
        if e.shape[1] < 2 or not len(e):
            return path
        rival = e.copy()
        rival[np.arange(len(e)), path] = -np.inf
        gain = rival.max(axis=1) - e[np.arange(len(e)), path]
        # the largest sum over a stretch of a text: running sum less its minimum so far
        run = np.concatenate(([0.0], np.cumsum(gain)))
        lift = np.concatenate(([0.0], np.cumsum(np.abs(gain)))).max() * 2 + 1  # parts the texts
        before = run[:-1] - lift * doc
        stretch = run[1:] - lift * doc - np.minimum.accumulate(before)
        prefix = run[1:] - run[bounds[:-1]][doc]
        suffix = run[bounds[1:]][doc] - run[:-1]
        out = (stretch > 2 * switch) | (prefix > switch) | (suffix > switch)
        for d in np.unique(doc[out]):
            path[bounds[d] : bounds[d + 1]] = viterbi(e[bounds[d] : bounds[d + 1]], switch)
        return path


def viterbi(e: np.ndarray, switch: float) -> np.ndarray:
    """Best path through scores e[word, language], each switch costing ``switch``.

    The value of being in a language, less that of the best one, is never below -switch,
    so a step is: stay, or come from the best language."""
    n, k = e.shape
    came = np.full((n, k), -1, np.int32)
    v = e[0].tolist()
    rows = e.tolist()
    langs = range(k)
    for t in range(1, n):
        top = max(langs, key=v.__getitem__)
        jump = v[top] - switch
        row = rows[t]
        for j in langs:
            if v[j] < jump:
                came[t, j] = top
                v[j] = jump
            v[j] += row[j]
    path = np.empty(n, np.int64)
    at = max(langs, key=v.__getitem__)
    for t in range(n - 1, -1, -1):
        path[t] = at
        if came[t, at] >= 0:
            at = int(came[t, at])
    return path


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of all labelled rows outside the held-out fold, or of a sample."""
    own = docs.select("doc_id", "text", "lang").where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    cells = 1 << 20
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(cells, -(-cells * sample_rows // sizes[lang])))]) if langs else None
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPTS)))
    if not langs:
        return Model(langs, counts, scripts)
    sample = own.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(cells)) < share[F.col("lang")])

    def rows(batches):
        sums, kinds = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPTS)), np.int64)
        for batch in batches:
            for part, data, at in pieces(batch):
                words = LetterWords(data, at)
                lang = np.array([langs.index(x) for x in part.column("lang").to_pylist()])
                of = lang[words.doc]
                bucket, word = grams(words.bytes, words.start, words.stop)
                np.add.at(sums, (of[word], bucket), 1)
                np.add.at(kinds, (of, words.script), 1)
        flat = np.concatenate((sums, kinds), axis=1)
        a, b = np.nonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(flat[a, b])], names=["lang", "cell", "n"])

    sums = sample.mapInArrow(rows, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    lang, cell, n = (sums.column(c).to_numpy() for c in ("lang", "cell", "n"))
    flat = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    flat[lang, cell] = n
    return Model(langs, flat[:, :BUCKETS], flat[:, BUCKETS:])


def _predict(model: Model, part: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    words = LetterWords(data, at)
    n_docs = part.num_rows
    pred: list[str] = ["und"] * n_docs
    score, spans = np.zeros(n_docs), [[] for _ in range(n_docs)]
    if model.langs and len(words.hash):
        k = len(model.langs)
        e = model.scores(words)
        path = model.paths(e, words.bounds)
        size = words.stop - words.start
        letters = np.bincount(words.doc * k + path, size, n_docs * k).reshape(n_docs, k)
        readable = np.bincount(words.doc * k + path, size * model.reached(words), n_docs * k).reshape(n_docs, k)
        sums = np.zeros((n_docs, k))
        np.add.at(sums, words.doc, e)
        best = np.where(readable.any(axis=1, keepdims=True), readable, letters).argmax(axis=1)
        own = np.flatnonzero(words.lettered)
        z = np.exp(sums[own] - sums[own].max(axis=1, keepdims=True))
        # texts of several languages: how sure the words of its own spans are
        mine = path == best[words.doc]
        within = np.zeros((n_docs, k))
        np.add.at(within, words.doc[mine], e[mine])
        w = np.exp(within[own] - within[own].max(axis=1, keepdims=True))
        sure = np.maximum((z / z.sum(axis=1, keepdims=True))[np.arange(len(own)), best[own]], (w / w.sum(axis=1, keepdims=True))[np.arange(len(own)), best[own]])
        score[own] = readable[own, best[own]] / letters[own].sum(axis=1) * sure
        for d in own:
            pred[d] = model.langs[best[d]]
        cut = np.ones(len(path), bool)
        cut[1:] = (path[1:] != path[:-1]) | (words.doc[1:] != words.doc[:-1])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(path)) - 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            d = words.doc[a]
            base = words.bounds[d]
            if words.lettered[d]:
                spans[d].append({"first_word": int(a - base), "last_word": int(b - base), "lang": model.langs[path[a]]})
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())]))
    return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(pred), pa.array(score), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, spans (words are runs of letters, from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times 2**16 floats

    def rows(batches):
        for batch in batches:
            for part, data, at in pieces(batch):
                yield _predict(shared.value, part, data, at)

    return docs.select("doc_id", "text").mapInArrow(rows, PREDICTED)


def identified_documents(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents of a known language, all columns, ``lang`` being the language found:
    those that are ``und``, or whose score is below ``min_score``, go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = packed(docs)

    def rows(batches):
        for batch in batches:
            for part, data, at in pieces(pa.RecordBatch.from_struct_array(batch.column(0))):
                p = _predict(shared.value, part, data, at)
                good = pc.and_(pc.not_equal(p.column("lang_pred"), "und"), pc.greater_equal(p.column("score"), min_score))
                fields = [p.column("lang_pred").cast(f.type) if f.name == "lang" else part.column(i) for i, f in enumerate(part.schema)]
                kept = pa.StructArray.from_arrays(fields, fields=list(part.schema)).filter(good)
                yield pa.RecordBatch.from_arrays([kept], names=["row"])

    return unpacked(whole.mapInArrow(rows, whole.schema))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return predict(docs, learn(docs)).select("doc_id", held_out, "lang_pred", "score")
