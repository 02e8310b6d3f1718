"""Language identification word by word, in plain Python."""

import math
import unicodedata
import zlib
from collections import Counter

from sparsewell.llm import langid
from sparsewell.llm.scripts import RANGES, SCRIPTS


def words(text):
    """Runs of letters and their marks."""
    out, now = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] in "LM":
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif now:
            out.append(now)
            now = ""
    return out


def script(word):
    cp = ord(word[0])
    return next((name for name, rs in RANGES for a, b in rs if a <= cp <= b), SCRIPTS[-1])


def buckets(word):
    raw = b" " + word.encode() + b" "
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            g = raw[i : i + n]
            if set(g) == {32} or 32 in g[1:-1]:
                continue
            code = n
            for b in g:
                code = code * 257 + b
            yield (code * 0x9E3779B97F4A7C15 % 2**64) >> 48


class Brute:
    def __init__(self, rows):
        """rows: doc_id, text, lang.  All that may be learned from are (no sampling)."""
        rows = [(words(t), x) for d, t, x in rows if d is not None and x is not None and t is not None and zlib.crc32(str(d).encode()) % langid.FOLDS]
        self.langs = sorted({x for _, x in rows})
        self.n = {x: Counter(b for w, y in rows if x == y for v in w for b in buckets(v)) for x in self.langs}
        self.total = {x: sum(n.values()) for x, n in self.n.items()}
        seen = {x: Counter(script(v) for w, y in rows if x == y for v in w) for x in self.langs}
        self.reach = {x: {s for s, n in c.items() if n >= langid.SCRIPT_SHARE * sum(c.values())} for x, c in seen.items()}
        self.known: dict[str, list[float]] = {}

    def scores(self, word):
        if word not in self.known:
            logp = lambda x, b: math.log((self.n[x][b] + langid.SMOOTH) / (self.total[x] + langid.SMOOTH * langid.BUCKETS))
            s = [sum(logp(x, b) for b in buckets(word)) / len(langid.ORDERS) for x in self.langs]
            can = [script(word) in self.reach[x] for x in self.langs]
            s = [v - langid.MARGIN * (any(can) and not c) for v, c in zip(s, can, strict=True)]
            self.known[word] = [v - max(s) for v in s]
        return self.known[word]

    def predict(self, text):
        """Language and score."""
        w = words(text)
        if not self.langs or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            return "und", 0.0
        e, langs = [self.scores(v) for v in w], range(len(self.langs))
        value, came = list(e[0]), []
        for row in e[1:]:
            step = [max(langs, key=lambda i: value[i] - langid.SWITCH * (i != j)) for j in langs]  # noqa: B023
            value = [value[i] - langid.SWITCH * (i != j) + row[j] for j, i in zip(langs, step, strict=True)]
            came.append(step)
        path = [max(langs, key=value.__getitem__)]
        for step in reversed(came):
            path.append(step[path[-1]])
        path.reverse()
        size = [len(v.encode()) for v in w]
        letters = [sum(n for n, p in zip(size, path, strict=True) if p == j) for j in langs]
        reached = [any(script(v) in r for r in self.reach.values()) for v in w]
        readable = [sum(n for n, p, r in zip(size, path, reached, strict=True) if p == j and r) for j in langs]
        best = max(langs, key=(readable if any(readable) else letters).__getitem__)

        def sure(rows):
            s = [sum(r[j] for r in rows) for j in langs]
            return math.exp(s[best] - max(s)) / sum(math.exp(v - max(s)) for v in s)

        own = [r for r, p in zip(e, path, strict=True) if p == best]
        return self.langs[best], readable[best] / sum(size) * max(sure(e), sure(own))
